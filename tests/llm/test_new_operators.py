"""Divergence, whitening and extraction: against plain forms, and over odd rows."""

import html
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor

import duckdb
import numpy as np
import pytest

from tonearchive.llm import divergence, extraction, whitening
from tonearchive.llm.html_blocks import blocks
from tonearchive.llm.oracle import ORACLE_SQL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, word long, n string, p string, tile int, value int"


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, words in own for t in set(words))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for _, source, words in own:
            counts[source].update(w for w in words if seen[w] >= least)
        total = sum(counts.values(), Counter())
        share = lambda c: {t: 1 + floor(Fraction(10**9 * (c[t] + 2), sum(c.values()) + 2 * len(kept))) for t in kept}  # noqa: B023, E731
        p, q = {s: share(c) for s, c in counts.items()}, share(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("tile", [256, 2])
def test_divergence(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "STRETCH", 64)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcXYZé🙂") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = [(" ".join(rng.choice(words[: rng.choice([5, 150])]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "d", "Ö", None])) for _ in range(250)]
    rows += [(None, "en", "silent"), ("", "en", "empty"), ("7 !", "fr", "x"), ("7 !", "fr", "y"), ("alone", "it", "z"), ("a1b-C" * 400, "en", "a"), ("é" * 300, "en", "a")] + [rows[0]] * 12
    frame = spark.createDataFrame([(1, t, lang, s, 1, 1, "x", "x", 1, 1) for t, lang, s in rows], DOCS).repartition(5)
    got = sorted(tuple(r) for r in divergence.divergence(frame, least_docs=4, top=5).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == plain_divergence(rows, 4, 5)
    assert {r[3] for r in got if r[:3] == ("fr", "x", "pair")} == {"y"} and not any(r[0] == "it" for r in got)
    assert divergence.divergence(frame.limit(0)).count() == 0


def test_divergence_shares_of_large_counts(spark):
    """Counts beyond what longs times 10^9 hold."""
    from pyspark.sql import functions as F

    n = 40_000_000_000
    row = spark.range(1).select(divergence._share(F.lit(n), F.lit(3 * n), F.lit(7).cast("long")).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (3 * n + 14)


def test_divergence_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    names = ["lang", "source", "part", "item", "value", "rank"]
    expect = sorted(con.execute(f"select {', '.join(names)} from ({ORACLE_SQL['op11_divergence']})").fetchall())
    got = divergence.divergence(spark.read.parquet(f"{sf}/documents.parquet")).select(names).collect()
    assert sorted(map(tuple, got)) == expect


def test_rank_one_updates():
    rng = np.random.default_rng(0)
    for k in (1, 2, 5, 30):
        for kind in range(4):
            values = np.sort(rng.choice([0.0, 1.0, 1.0, 3.0, 1e-9, 100.0], k) if kind else rng.uniform(0, 5, k))
            vectors = np.linalg.qr(rng.standard_normal((k, k)))[0]
            x = vectors @ (rng.standard_normal(k) * (rng.random(k) < 0.6) * 10.0 ** rng.integers(-9, 2, k))
            new, turned = whitening.rank_one(values, vectors, x)
            whole = vectors * values @ vectors.T + np.outer(x, x)
            scale = max(1e-300, np.abs(whole).max())
            assert np.abs(turned * new @ turned.T - whole).max() <= 1e-13 * k * scale
            assert np.abs(turned.T @ turned - np.eye(k)).max() <= 1e-13 * k and (np.diff(new) >= 0).all()


@pytest.mark.parametrize("stretch", [1, 50, 4096])
def test_spectrum_of_any_stretch(monkeypatch, stretch):
    monkeypatch.setattr(whitening, "STRETCH", stretch)
    rng = np.random.default_rng(1)
    x = np.round(rng.standard_normal((400, 12)) * rng.uniform(1, 40, 12))
    x[:, 5] = x[:, 4]
    parts = [whitening.Spectrum(12) for _ in range(3)]
    for part, rows in zip(parts, np.split(x, [30, 31])):
        for low in range(0, len(rows), stretch):
            part.add(rows[low : low + stretch])
    whole = whitening.Spectrum(12)
    for part in parts:
        whole.merge(part.n, part.mean, part.rows)
    scatter = np.cov(x.T, bias=True) * len(x)
    assert whole.n == 400 and np.allclose(whole.mean, x.mean(axis=0)) and np.abs(whole.rows.T @ whole.rows - scatter).max() <= 1e-11 * scatter.max()


def whitened(rows, k):
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - sums) ** 2).sum(axis=1), ((n * x - sums) / n) @ vectors[:, :k] / np.sqrt(values[:k]), (values / values.sum())[:k]


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening(spark, parts):
    rng = np.random.default_rng(7)
    base = (rng.standard_normal((500, 20)) * np.linspace(3, 0.4, 20)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(300)] + [(3, base[4].tolist())]
    odd = [(None, None), (2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [float("nan")] * 20), (2004, [None] + [1.0] * 19), (2005, [float("inf")] + [1.0] * 19)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, n int, component int").repartition(parts)
    got = whitening.whiten(frame, components=16).collect()
    n, deviation, expect, explained = whitened(rows, 16)
    of = {i: k for k, (i, _) in enumerate(rows) if i != 3}
    assert len(got) == 16 * len(rows) and {r.component for r in got} == set(range(1, 17))
    sign = {}
    for r in got:
        if r.vec_id != 3:
            k, c = of[r.vec_id], r.component - 1
            sign.setdefault(c, np.sign(expect[k, c] * r.whitened))
            assert r.n == n and r.deviation == deviation[k] and r.whitened == pytest.approx(sign[c] * expect[k, c], abs=1e-9) and r.explained == pytest.approx(explained[c], rel=1e-10) and r.identity_error < 1e-10
    assert sum(r.vec_id == 3 for r in got) == 32


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<double>"
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0])] * 3)).count() == 0  # no variance
    got = whitening.whiten(frame([(1, [0.0, 0.0, 5.0]), (2, [1.0, 0.0, 5.0]), (None, [0.0, 2.0, 5.0])])).collect()
    assert len(got) == 6 and {r.component for r in got} == {1, 2} and all(r.identity_error < 1e-12 for r in got)
    got = whitening.whiten(frame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [0.0, -1e6])])).collect()
    assert len(got) == 3 and all(np.isfinite(r.whitened) for r in got) and any(r.deviation is None for r in got)  # the other variance is below rounding
    many = frame([(i, (np.eye(120)[i % 120] * (1 + i / 7)).tolist()) for i in range(300)])  # more dimensions than the refined subspace
    got = whitening.whiten(many, components=3).collect()
    n, deviation, expect, explained = whitened([(r.vec_id, r.embedding) for r in many.orderBy("vec_id").collect()], 3)
    assert len(got) == 900 and all(abs(abs(r.whitened) - abs(expect[r.vec_id, r.component - 1])) < 1e-7 for r in got)


def test_extraction_of_the_pages(spark):
    """The article of every page of the driver's tables, by its marks."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extraction.extract(pages).join(pages, "page_id").collect():
        parts = re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        expect = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in parts]
        assert r.text == "\n".join(filter(None, expect)) and r.n_chars == len(r.text)


PARAGRAPH = "This is a paragraph of the article that goes on for quite a few words so that it looks like one."
CASES = [
    ("<nav><a href=/>Home</a></nav><article><h1>Title &amp; more</h1><p>Hi.</p><p>One\n two&nbsp;<b>th</b>ree</p></article><footer>&copy; x</footer>", "Title & more\nHi.\nOne two three"),
    (f"<div><a href=/>Home</a> <a href=/a>About</a></div><div>{PARAGRAPH}</div><div>{PARAGRAPH}</div><div><a href=/b>Next page</a></div>", f"{PARAGRAPH}\n{PARAGRAPH}"),
    (f"<main><p>a</p><aside>{PARAGRAPH}</aside><form>{PARAGRAPH}</form><div class='comments'><p>{PARAGRAPH}</p></div><div class=adverts>{PARAGRAPH}</div><p>b</p></main>", "a\nb"),
    (f"<div class='cookie-notice'>{PARAGRAPH}</div><div id=sidebar>{PARAGRAPH}</div><article class='post category-privacy'><header><h1>Head</h1></header><p>x</p></article><section id='comments'><article>{PARAGRAPH}</article></section>", "Head\nx"),
    ("<body class='has-sidebar'><div class='content with-sidebar'><p>x</p></div></body>", "x"),
    ("<form id=page><div class=content><p>x</p></div></form>", "x"),
    ("<article><script>var t = '</p>' < 3</script><style>p{}</style><!-- no --><p>x<textarea>no</textarea><noscript>no</noscript></p><p hidden>no</p>", "x"),
    ("<article><p>cut &amp &lt;b&gt; &#x41;&#66; &bogus; a < b <", "cut & <b> AB &bogus; a < b <"),
    ("<article><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>g<br>h</article>", "a\nb\nc\nd\ne\nf\ng h"),
    (f"<nav><p>{PARAGRAPH}</p></nav>", ""), ("", ""), (None, ""), ("<div></div>", ""), ("<article>\x00 </article>", "\x00"),
]


def test_extraction_cases(spark):
    rows = [(None if k == 0 else k, f"u{k}", page, "clash", 5) for k, (page, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows + rows[1:2], "page_id long, url string, html string, text string, n_chars int")
    got = extraction.extract(frame).collect()
    assert sorted((r.url, r.text, r.n_chars) for r in got) == sorted([(f"u{k}", t, len(t)) for k, (_, t) in enumerate(CASES)] + [("u1", CASES[1][1], len(CASES[1][1]))])
    assert extraction.extract(frame.limit(0)).count() == 0 and extraction.extract(frame).columns == ["page_id", "url", "text", "n_chars"]


def test_tree_learns_the_labelled_table():
    x, y = extraction.labelled_blocks()
    assert ((extraction.block_tree().predict(x) >= 0.5) == y).mean() > 0.99
    rng = random.Random(99)  # other fillings
    x, y = [], []
    for outline in extraction.PAGES:
        found = blocks(extraction._filled(outline, rng))
        x.append(extraction.features(found))
        y += [b.text[0] == "w" for b in found]
    assert ((extraction.block_tree().predict(np.concatenate(x)) >= 0.5) == np.array(y)).mean() > 0.97


@pytest.mark.parametrize("piece", ["<b", '<a "', "<a x='", '<a b="', "<div>", "</div>", "<!-- ", "&amp", "<p><a href=x>", "<script>", "word "])
def test_extraction_is_linear(piece):
    extraction.main_text(piece * (2_000_000 // len(piece)), extraction.block_tree())
