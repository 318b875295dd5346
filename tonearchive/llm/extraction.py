"""Main text of HTML pages: flat text blocks, classified by a decision tree over words and link density of a block and its neighbours.

The tree is grown here, on blocks of the small labelled table ``PAGES``: outlines of pages whose blocks are marked + (main text)
or - (the rest), filled with words by a fixed seed. Beside the block's own numbers and those of its neighbours it sees the element
and the innermost container that tells (an article, a menu, an advert ...), and so learns when to trust which.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare
from .html_blocks import Block, blocks

#: Fillings of each outline, and limits of the tree.
FILLINGS, DEPTH, LEAST_LEAF = 40, 10, 4
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "item", "kind", "main_words", "share", "article")

#: The labelled table. Each line is a piece of a page: + main text, - the rest, a blank for mere markup; {a-b} stands for so many words, [a-b] for so many in a link.
PAGES = (
    """
 <nav><ul>
-<li>[1-2]</li><li>[1-2]</li><li>[1-3]</li><li>[1-2]</li>
 </ul></nav>
-<div class="ad">{2-20}</div>
 <article>
+<h1>{1-12}</h1><p>{20-90}</p><p>{1-4}</p><p>{10-60}<p>{1-80}</p>
 </article>
-<footer>{3-25}</footer>
""",
    """
-<header><h1>[1-4]</h1><p>{3-12}</p></header>
-<div class="cookie-notice"><p>{8-40}</p>[1-2]</div>
 <main><article><header>
+<h1>{2-12}</h1>
 </header>
-<p class="byline">{2-6}</p>
+<p>{1-90}</p><h2>{1-6}</h2><p>{10-80}</p><ul><li>{1-12}</li><li>{3-30}</li><li>{1-5} [1-3]</li></ul><blockquote>{2-40}</blockquote><p>{1-60}</p>
-<div class="share">[1-2] [1-2] [1-2]</div>
 </article></main>
-<aside><h3>{1-4}</h3><ul><li>[3-10]</li><li>[3-10]</li></ul><p>{10-60}</p></aside>
-<section id="comments"><h3>{1-3}</h3><div class="comment"><p>{1-60}</p></div><div class="comment"><p>{5-80}</p></div></section>
-<form><label>{1-4}</label><p>{2-20}</p></form>
-<footer><p>{3-20}</p>[1-2] [1-2]</footer>
""",
    """
-<div id="menu">[1-2] | [1-2] | [1-2]</div>
 <div class="content">
+<h1>{1-10}</h1><p>{15-90}</p><p>{1-3}</p><p>{2-50} [1-4] {2-40}</p>
 </div>
-<div class="sidebar"><h4>{1-4}</h4><p>{10-70}</p><a href="/">{1-4}</a></div>
-<div id="footer">{2-30}</div>
""",
    """
-<div>[1-3]</div><div>[1-3] [1-3] [1-2]</div>
+<h1>{3-12}</h1><p>{18-90}</p><p>{25-90}</p><p>{3-40}</p><p>{30-90}</p>
-<p>[2-6]</p><p>[2-8]</p><div>{1-5} [1-3]</div><div>{1-6}</div>
""",
    """
-<ul><li>[1-3]</li><li>[1-3]</li><li>[1-4]</li></ul>
-<div>{1-5}</div>
+<h2>{3-12}</h2><div>{25-90}</div><div>{20-90} [1-3] {5-30}</div><div>{4-30}</div><div>{30-90}</div>
-<div>[1-4]</div><div>{1-6}</div><table><tr><td>[1-3]</td><td>[1-3]</td><td>[1-3]</td></tr></table>
""",
    """
+<p>{15-80}</p><p>{15-80}</p>
-<p>[1-5]</p>
""",
    """
-<div>{1-4}</div><p>[1-4]</p><p>[1-4]</p><p>{1-3} [1-6]</p><div>{1-5}</div>
""",
    """
 <article>
+<p>{1-6}</p>
 </article>
-<footer>{2-20}</footer>
""",
    """
-<div class="topbar">{1-20}</div>
 <article class="post">
+<h1>{2-9}</h1><p>{10-60}</p>
-<div class="advert">{3-50}</div>
+<p>[3-20]</p><p>{1-50}</p><pre>{2-40}</pre><table><tr><th>{1-3}</th><td>{1-9}</td></tr></table>
-<aside class="related"><p>{5-40}</p>[2-8]</aside><nav>[1-3] [1-3]</nav>
+<p>{1-60}</p>
-<footer>{2-12}</footer>
 </article>
-<div class="comments"><p>{1-90}</p><p>{10-90}</p></div>
-<div role="dialog">{5-60}</div>
""",
    """
 <article>
+<h1>{1-12}</h1><p>{1-90}</p><p>{1-90}</p><p>{1-4}</p>
 </article>
""",
    """
 <main>
+{1-90}<h2>{1-8}</h2>{1-40}<figure><figcaption>{1-20}</figcaption></figure><dl><dt>{1-3}</dt><dd>{1-20}</dd></dl><p>[1-6]</p>
 </main>
""",
    """
 <div class="entry-content">
+<p>{1-4}</p><p>{1-90}</p><ol><li>{1-4}</li><li>[1-6]</li><li>{1-30}</li></ol><h3>{1-5}</h3><p>{1-8}</p>
 </div>
""",
    """
-<div>[1-3]</div><p>{1-3} [1-4]</p>
+<div>{40-90}</div><p>{1-6}</p><p>{40-90}</p>
-<p>[1-4]</p><p>{1-6}</p>
""",
    """
+<p>{8-90}</p>
""",
    """
+<h1>{1-9}</h1><p>{12-90}</p><p>{12-90}</p><p>{1-60}</p>
""",
    """
+{15-90}
""",
    """
-<div>{1-40}</div><p>{5-40}</p>
 <article>
+<h1>{1-12}</h1><p>{10-90}</p><p>{1-5}</p><p>{40-90}</p>
 </article>
-<p>{1-40}</p><div>{10-60}</div><div>[1-5]</div>
""",
    """
-<div>{1-40}</div><p>{5-40}</p>
 <main>
+<p>{1-20}</p>
 </main>
-<p>{1-40}</p><div>{10-60}</div>
""",
    """
-<div class="header">[1-5]</div><div class="nav">[1-2] [1-2]</div><form>{1-10}</form>
 <article>
+<p>{1-90}</p>
 </article>
-<div class="comments"><p>{1-90}</p></div>
""",
    """
 <form>
-<div class="menu">[1-4]</div>
 <div class="main">
+<h1>{2-9}</h1><p>{12-80}</p><p>{10-60}</p>
 </div>
-<div class="footer">{1-20}</div>
 </form>
""",
)
_PIECE = re.compile(r"([{\[])(\d+)-(\d+)[}\]]")


def _filled(outline: str, rng: random.Random) -> str:
    """A page of the outline; words of main text begin with w, others with q."""
    lines = []
    for line in outline.strip("\n").split("\n"):
        first = "w" if line[0] == "+" else "q"

        def words(m: re.Match) -> str:
            text = " ".join(f"{first}{rng.randrange(1000)}" for _ in range(rng.randint(int(m[2]), int(m[3]))))  # noqa: B023
            return f'<a href="/x">{text}</a>' if m[1] == "[" else text

        lines.append(_PIECE.sub(words, line[1:]))
    return "<html><body>" + "\n".join(lines) + "</body></html>"


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the filled table."""
    rng, x, y = random.Random(13), [], []
    for outline in PAGES:
        for _ in range(FILLINGS):
            found = blocks(_filled(outline, rng))
            x.append(features(found))
            y += [b.text[0] == "w" for b in found]
    return np.concatenate(x), np.array(y)


def features(found: list[Block]) -> np.ndarray:
    """One row a block, as ``FEATURES`` says; beyond the ends of a page stand blocks of no words and full link density."""
    n = len(found)
    words = np.array([0, *(b.words for b in found), 0], float)
    density = np.array([1.0, *(min(1.0, b.linked / b.words) for b in found), 1.0])
    kind = np.array([min(b.kind, 2) for b in found], float)
    name = [b.name for b in found]
    own = words[1:-1]
    plain = own * (1 - density[1:-1])
    main = plain[kind == 1].sum()
    columns = [
        own, density[1:-1], words[:-2], density[:-2], words[2:], density[2:], [x[:1] == "h" and x[1:].isdigit() for x in name], [x in ("li", "td", "th", "dt", "dd") for x in name],
        kind, np.full(n, main), np.full(n, main / max(1.0, plain.sum())), np.full(n, any(b.inside and b.kind == 1 for b in found)),
    ]
    return np.column_stack([np.asarray(c, float) for c in columns]) if n else np.empty((0, len(FEATURES)))


class Tree:
    """A binary decision tree by Gini impurity: at each node the feature and threshold that part the labels best."""

    def __init__(self, depth: int = DEPTH, least: int = LEAST_LEAF):
        self.depth, self.least = depth, least
        self.feature, self.threshold, self.low, self.high, self.share = [], [], [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self._grow(x, y.astype(float), self.depth)
        self.arrays = tuple(np.array(a) for a in (self.feature, self.threshold, self.low, self.high, self.share))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        at = len(self.feature)
        for column, value in zip((self.feature, self.threshold, self.low, self.high, self.share), (-1, 0.0, at, at, y.mean() if len(y) else 0.0)):
            column.append(value)
        best = self._split(x, y) if depth and 0 < y.mean() < 1 else None
        if best:
            self.feature[at], self.threshold[at] = best
            left = x[:, best[0]] <= best[1]
            self.low[at] = self._grow(x[left], y[left], depth - 1)
            self.high[at] = self._grow(x[~left], y[~left], depth - 1)
        return at

    def _split(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        best, least = None, len(y) * y.mean() * (1 - y.mean()) - 1e-9
        n = np.arange(1, len(y))
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            a, b = ones[:-1], ones[-1] - ones[:-1]
            impure = a - a * a / n + b - b * b / (len(y) - n)
            impure[(v[1:] == v[:-1]) | (n < self.least) | (len(y) - n < self.least)] = np.inf
            k = int(impure.argmin()) if len(impure) else 0
            if len(impure) and impure[k] < least:
                best, least = (f, float(v[k] + v[k + 1]) / 2), impure[k]
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Share of main text in the leaf of each row."""
        feature, threshold, low, high, share = self.arrays
        at = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            inner = feature[at] >= 0
            goes = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(goes, low[at], high[at]), at)
        return share[at]


@functools.lru_cache(maxsize=1)
def block_tree() -> Tree:
    return Tree().fit(*labelled_blocks())


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = tree.predict(features(found)) >= 0.5
    return "\n".join(b.text for b, k in zip(found, keep.tolist()) if k)


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``carry``, text and n_chars (its code points) for every row of ``pages``: the main text of the whole ``html``, blocks joined by line ends.

    Null and empty pages have an empty text; null ids, repeated rows and other columns do no harm; one page is held at a time;
    an empty table gives an empty result. White space is what Unicode calls so. Pages need no shuffle.
    """
    prepare(pages.sparkSession)
    tree = block_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "", tree) for page in batch.column("html")]
            columns = [*(batch.column(c) for c in carry), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, "text", "n_chars"])

    wanted = pages.select(*carry, F.col("html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema if f.name != "html")
    return wanted.mapInArrow(lean(run), f"{schema}, text string, n_chars long")
