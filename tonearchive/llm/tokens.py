"""Token ids of whole texts by a public tokenizer, encoding each distinct chunk once."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import WHITE, ragged, worker_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: The id that ends every document.
END_ID = 1
#: White space other than single blanks and line ends between other characters: texts that hold it are cut with more care.
_ODD = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Letters, other ASCII signs, or a line end: no token crosses from one to the next, but for
#: contractions and special tokens, which are left whole as is all else (the last branch).
_PARTS = re.compile(rf" ?[{_L}]++(?![^\x00-\x7F])| ?[!-&(-@\[-`{{-~]++(?![^\x00-\x7F{_L}])|\n(?!\s)|[\s\S]+")


class WordMemo:
    """Distinct words -> ids, for arrays of distinct words. ``missing`` encodes unseen ones to (flat ids, counts).

    Words met first are remembered as Arrow arrays, up to a limit; later unseen ones are encoded each time.
    """

    def __init__(self, missing: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1_000_000):
        self.missing, self.limit, self.words = missing, limit, pa.array([], pa.string())
        self.flat, self.counts = np.empty(0, np.int32), np.empty(0, np.int32)

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where each word's begin there and how many they are."""
        at = pc.index_in(words, self.words)
        unseen = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        at = at.fill_null(0).to_numpy().copy()
        flat, counts = self.flat, self.counts
        if len(unseen):
            fresh, known = words.take(pa.array(unseen)), len(counts)
            new_flat, new_counts = self.missing(fresh.to_pylist())
            flat, counts = np.concatenate([flat, new_flat]), np.concatenate([counts, new_counts.astype(np.int32)])
            at[unseen] = known + np.arange(len(unseen))
            take = min(len(unseen), self.limit - known)
            if take > 0:
                self.words = pa.concat_arrays([self.words, fresh.slice(0, take)])
                self.counts = counts[: known + take]
                self.flat = flat[: int(self.counts.sum(dtype=np.int64))]
        return flat, (np.cumsum(counts, dtype=np.int64) - counts)[at], counts[at]


class Encoder:
    """Ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them.

    Neither tokenizer has tokens that cross from a non-blank character to a blank one. A
    text is therefore cut before each single blank or line end between two other characters,
    Arrow finds the distinct words of a batch, unseen words are cut further, and the library
    encodes every distinct part once (bounded memos). Texts with other white space are cut
    before single blanks alone; the chunks around what else there is stay whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.folds = self._encode(["Ab"])[0].tolist() == self._encode(["ab"])[0].tolist()
        self.parts = WordMemo(self._encode)
        self.words = WordMemo(self._unseen)

    def _unseen(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of unseen words, from their parts. A word that begins with no white space stood after a blank."""
        parts, sizes = [], []
        for word in words:
            word = word if word[:1] in WHITE else " " + word
            whole = not word or "'" in word or "<|" in word
            cut = [word] if whole else _PARTS.findall(word.lower() if self.folds and word.isascii() else word)
            parts += cut
            sizes.append(len(cut))
        flat, counts = self._of(pa.array(parts, pa.string()), self.parts)
        return flat, np.add.reduceat(counts, np.cumsum([0, *sizes[:-1]]))

    @staticmethod
    def _of(words: pa.Array, memo: WordMemo) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that may repeat, one after the other, and how many each has."""
        words = words.dictionary_encode()
        flat, starts, counts = memo.encode(words.dictionary)
        nth = words.indices.to_numpy()
        counts = counts[nth]
        return flat[ragged(starts[nth], counts)], counts

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return np.array(list(itertools.chain.from_iterable(ids)), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text cut before single blanks between other characters; every chunk but the first begins with one."""
        parts = text.split(" ")
        out = [parts[0]]
        for p in parts[1:]:
            if out[-1] and not out[-1][-1].isspace() and p and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without other white space, one after the other, and where each text ends."""
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        firsts = words.offsets.to_numpy()
        firsts, total = firsts[:-1] - firsts[0], int(firsts[-1] - firsts[0])
        each = words.flatten()
        heads, head_counts = self._encode(each.take(pa.array(firsts)).to_pylist())
        each = each.dictionary_encode()
        flat, starts, counts = self.words.encode(each.dictionary)
        nth = each.indices.to_numpy()
        start, count = starts[nth], counts[nth]
        start[firsts], count[firsts] = len(flat) + np.cumsum(head_counts) - head_counts, head_counts
        ids = np.concatenate([flat, heads])[ragged(start, count)]
        return ids, np.cumsum(count)[np.append(firsts[1:], total) - 1]

    def _careful(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_plain``, of any texts."""
        cut = [self.chunks(t) for t in texts]
        heads, head_counts = self._encode([c[0] for c in cut])
        rest, counts = self._of(pa.array([c for chunks in cut for c in chunks[1:]], pa.string()), self.words)
        sizes = np.add.reduceat(np.append(counts, 0), np.minimum(np.cumsum([0, *(len(c) - 1 for c in cut[:-1])]), len(counts)))
        sizes[[len(c) == 1 for c in cut]] = 0
        lengths = np.stack([head_counts, sizes], axis=1).ravel()
        starts = np.stack([np.cumsum(head_counts) - head_counts, len(heads) + np.cumsum(sizes) - sizes], axis=1).ravel()
        return np.concatenate([heads, rest])[ragged(starts, lengths)], np.cumsum(head_counts + sizes)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each ended by ``END_ID``, as unsigned 32 bits; and where each text ends."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        ids, ends = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        starts, base = np.zeros(len(texts), np.int64), 0
        for which, encode in ((~odd, self._plain), (odd, lambda t: self._careful(t.to_pylist()))):
            if which.any():
                own, end = encode(texts.filter(pa.array(which)))
                starts[which], ends[which] = base + np.append(0, end[:-1]), base + end
                ids.append(own)
                base += len(own)
        lengths = ends - starts + 1
        out = np.full(int(lengths.sum()), END_ID, np.uint32)
        stops = np.cumsum(lengths)
        out[ragged(stops - lengths, lengths - 1)] = np.concatenate(ids)[ragged(starts, lengths - 1)]
        return out, stops


def gathered(batches: Iterator[pa.RecordBatch], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold some ``size`` bytes: the more text at once, the fewer distinct words a byte."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file."""
    return worker_cache(path, lambda: Encoder(path))
