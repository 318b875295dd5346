"""Training-data preparation: thirteen operators over `documents`, `embeddings` and `pages`.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
