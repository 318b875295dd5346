"""The stages against plain forms, and near copies against pairwise similarity."""

import random

import pytest

import brute
import corpus_pipeline
from tonearchive.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = brute.WORD.findall((text or "").translate(brute.LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    out = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(120)]
        out.append((10 * i, " ".join(words)))
        for k in range(i % 4):  # copies with a few words changed
            near = list(words)
            for _ in range(k):
                near[rng.randrange(120)] = "changed"
            out.append((10 * i + k + 1, " ".join(near).upper() if k == 2 else " ".join(near)))
    return [(d, t, "en", "ab"[(d or 0) % 2], len(t or "")) for d, t in out + [(901, ""), (902, None), (903, "one two"), (904, "one two"), (None, "one two")]]


@pytest.mark.parametrize("tile", [8192, 2])
def test_near_copies(spark, rows, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "MEETING", tile)
    sets = [shingles(t) for _, t, *_ in rows]
    root = brute.groups(len(rows), lambda i, j: similar(sets[i], sets[j]))
    got = near_copies.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in got.collect()) == sorted({rows[i][0] for i in range(len(rows)) if root[i] == i})
    assert near_copies.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_template_does_not_hide_copies(spark, monkeypatch):
    """Texts of one template, all about 0.7 alike, in several blocks: pairs of copies among them are still found."""
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    template, rows = [word() for _ in range(100)], []
    for i in range(200):
        own = [word() for _ in range(19)]
        rows.append((i, " ".join(template + own)))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join(template + own[:7] + [word() for _ in range(12)])))
    rng.shuffle(rows)
    sets = [shingles(t) for _, t in rows]
    root = brute.groups(len(rows), lambda i, j: similar(sets[i], sets[j]))
    assert len(set(root)) == 200
    got = near_copies.near_copies(spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], SCHEMA).repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == list(range(200))


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    good, bad = ["alpha", "beta", "gamma", "delta", "omega", "sigma"], ["$$$", "BUY!!", "###", "alpha***"]
    rows = [(i, " ".join(rng.choice(good if i % 4 else bad) for _ in range(rng.randint(30, 60))), "en", "abc"[i % 3], 0) for i in range(300)]
    rows += [(1000 + i, rows[4 * i + 1][1], "en", "a", 0) for i in range(20)] + [(2000, rows[1][1] + " token=0123456789abcdefXYZ", "en", "b", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append(docs.collect())
    quality, distinct, clean, mixed, packed = seen
    kept = {r.doc_id for r in quality}
    assert len([d for d in kept if d < 300 and d % 4 == 0]) <= 2 and len([d for d in kept if d < 300 and d % 4]) >= 223
    assert not {r.doc_id for r in distinct} & {1000 + i for i in range(20)} and len({r.text for r in distinct}) == len(distinct)
    assert not any("0123456789abcdefXYZ" in r.text for r in clean) and len(clean) == len(distinct) and all(r.n_chars == len(r.text) for r in clean)
    words = {s: sum(len(r.text.split()) for r in clean if r.source == s) for s in "abc"}
    aim = brute.targets(words)
    for s in "abc":
        assert abs(sum(len(r.text.split()) for r in mixed if r.source == s) - aim[s]) <= 0.02 * aim[s] + 60
    assert set(mixed) <= set(clean)
    pieces = sorted((r.doc_id, r.start) for r in packed)
    assert len(pieces) >= len(mixed) and {d for d, _ in pieces} == {r.doc_id for r in mixed}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
