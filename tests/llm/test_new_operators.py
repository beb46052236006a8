"""Search, URL filters and whitening against brute force, and their odd inputs."""

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from headerloom.llm import lexical, urls, whitening

DOCS = "doc_id long, text string, score long, block long, term string, item long"


def docs_of(spark, *rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], DOCS)


def ranked(docs, items, best):
    """Every document scored for every item."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = set()
    for item, words in wanted.items():
        scores = []
        for doc, c in counts:
            m = 100 - 50 + 50 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 20 * m)) for w in words if c[w])
            if s > 0:
                scores.append((-s, doc is None, doc))
        out |= {(item, k, doc, -s) for k, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:best], 1)}
    return out


def test_search_is_brute_force_over_blocks_and_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "ÀB", "x_y", "3"]
    text = lambda n: " ".join(rng.choice(words, n, p=np.arange(len(words), 0, -1) / sum(range(1, len(words) + 1))))
    docs = [(int(i), text(int(rng.integers(1, 90)))) for i in rng.permutation(300)]
    docs += [(1000 + i, "w1 w2 same") for i in range(40)] + [(7, docs[3][1]), (None, "w1 w2 same"), (None, None), (2000, ""), (2001, "!!"), (2002, "w5 " * 50_000), (2003, "W5-w5")]
    items = [(k, text(9)) for k in range(20)] + [(20, "same"), (21, None), (22, "?"), (23, "nowhere"), (24, "w1"), (24, "w59"), (None, "w5 w6")]
    monkeypatch.setattr(lexical, "ITEMS_AT_ONCE", 6)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 50)
    frame = docs_of(spark, *docs).repartition(3)
    item_frame = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, block string")
    got = [tuple(r) for r in lexical.search(lexical.build(frame), item_frame, best=12).collect()]
    assert len(got) == len(set(got)) or len([g for g in got if g[2] is None]) > 1
    assert set(got) == ranked(docs, items, 12)


def test_bounds_hold_and_search_of_nothing_is_empty(spark):
    index = lexical.build(docs_of(spark, (1, "a b b c"), (2, "a " * 400), (3, "c")))
    for r in index.postings.collect():
        impacts, bounds = np.frombuffer(r.impacts, "<u4").astype(int), np.frombuffer(r.bounds, np.uint8).astype(int)
        assert (bounds * lexical.STEP >= impacts).all() and ((bounds - 1) * lexical.STEP < impacts).all() and impacts.max() < lexical.IMPACTS
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build(none), items).count() == 0
    assert lexical.search(index, items.where("false")).count() == 0


RULED = [
    ("https://a.net/en/x", "a.net", "/en/x", "net/", "block"), ("http://X.example.NET/en/1?q#f", "x.example.net", "/en/1", "example.net/en/", "allow"), ("https://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("https://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
    ("ftp://o.org/fr/a", "o.org", "/fr/a", "org/fr/", "allow"), ("https://o.org/FR/a", "o.org", "/FR/a", None, "allow"), ("https://a.net", "a.net", "", None, "allow"), ("https://a.net?x=/en/", "a.net", "", None, "allow"), ("no scheme.net/", "", "", None, "allow"), (None, "", "", None, "allow"), ("://", "", "", None, "allow"),
    ("x://h#/", "h", "", None, "allow"), ("https://example.net/en", "example.net", "/en", "net/", "block"), ("https://net/" + "a" * 100_000, "net", "/" + "a" * 100_000, "net/", "block"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, (u, *_) in enumerate(RULED)], "page_id long, url string, host string, n int")
    got = urls.judged(pages, spark.createDataFrame([], "page_id long, bad boolean")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [tuple(x[1:]) for x in RULED]


def test_reputation_is_shrunk_by_level(spark):
    """Hosts against the same levels computed here; a domain of bad hosts carries over to a new one, a suffix is no domain."""
    rng = np.random.default_rng(3)
    known, rows = [], []
    for d, (domain, share) in enumerate((("good.com", 0.05), ("bad.com", 0.95), ("mixed.co.uk", 0.5), ("fine.co.uk", 0.02))):
        for h in range(12):
            host = f"h{h}.{domain}"
            for _ in range(int(rng.integers(1, 60))):
                rows.append((len(rows), host))
                known.append((rows[-1][0], bool(rng.random() < share)))
        rows += [(len(rows), f"new.{domain}")]
    rows += [(len(rows) + 1, "other.example"), (len(rows) + 2, "192.0.2.1"), (len(rows) + 3, "")]
    pages = spark.createDataFrame(rows, "page_id long, host string")
    outcomes = spark.createDataFrame([*known, (10**9, True)], "page_id long, bad boolean")
    got = urls.reputations(pages, outcomes).toPandas().set_index("host")
    bad = dict(known)
    frame = pd.DataFrame([(h, h.split(".", 1)[1] if h[:1] in "hn" and "." in h else h, bad.get(i)) for i, h in rows], columns=["host", "domain", "bad"])
    frame.loc[frame.host == "192.0.2.1", "domain"] = "2.1"
    frame["suffix"] = frame.domain.map(lambda d: "co.uk" if d.endswith("co.uk") else d.split(".")[-1])
    count = lambda keys: frame.groupby(keys).bad.agg(n="count", k=lambda x: (x == True).sum()).reset_index()  # noqa: E712, E731

    def level(f):
        met = f[f.n > 0]
        chance = met["mean"] * (1 - met["mean"])
        r = (((met.k - met.n * met["mean"]) ** 2 / met.n).sum() - chance.sum()) / ((met.n - 1) * chance).sum()
        w = min(urls.MOST_WEIGHT, max(urls.LEAST_WEIGHT, 1 / r - 1 if r > 0 else urls.MOST_WEIGHT))
        return f.assign(a=f.k + w * f["mean"], b=f.n - f.k + w * (1 - f["mean"]))

    n, k = len(known), sum(bad.values())
    tops = level(count(["suffix"]).assign(mean=(k + 1) / (n + 2)))
    domains = level(count(["suffix", "domain"]).merge(tops.assign(mean=tops.a / (tops.a + tops.b))[["suffix", "mean"]], on="suffix"))
    hosts = level(count(["domain", "host"]).merge(domains.assign(mean=domains.a / (domains.a + domains.b))[["domain", "mean"]], on="domain")).set_index("host")
    both = got.join(hosts, rsuffix="_x")
    assert len(both) == len(got) == len(hosts) and np.allclose(both.a, both.a_x) and np.allclose(both.b, both.b_x) and (both.n == both.n_x).all()
    assert (got.loc[[f"h{h}.bad.com" for h in range(12)], "lower"] > urls.MOST_BAD).sum() >= 8 and got.loc["new.bad.com", "n"] == 0
    assert got.loc["new.bad.com", "lower"] > got.loc["new.mixed.co.uk", "lower"] > got.loc["new.good.com", "lower"]
    assert (got.loc[[f"h{h}.good.com" for h in range(12)], "lower"] < 0.3).all()
    # The bound is near the exact one, found by adding the density up.
    x = np.linspace(0, 1, 200_001)[1:-1]
    for a, b, lower in got[["a", "b", "lower"]].itertuples(index=False):
        if min(a, b) > 1:
            logs = (a - 1) * np.log(x) + (b - 1) * np.log1p(-x)
            mass = np.cumsum(np.exp(logs - logs.max()))
            assert abs(x[np.searchsorted(mass, 0.05 * mass[-1])] - lower) < 0.06


def test_outcomes_follow_titles(spark):
    docs = spark.createDataFrame([(1, "Alpha & <b> beta\nrest"), (2, "x" * 100), (3, "Alpha & <b> beta"), (4, None), (5, ""), (6, "lonely")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 1, 0), (4, 1, 1), (5, 1, 1), (6, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    html = ["<title>Alpha &amp; &lt;b&gt; beta</title>", f"<title>{'x' * 60}</title>", "<title></title>", None, "<title>lonely</title>", "<title>Alpha &amp; &lt;b&gt; beta</title>", "<title>" * 50_000]
    pages = spark.createDataFrame([(i if i < 5 else 0 if i == 5 else i, h) for i, h in enumerate(html)] + [(None, html[1])], "page_id long, html string")
    assert {tuple(r) for r in urls.outcomes_by_title(pages, docs, labels).collect()} == {(1, True)}
    single = urls.outcomes_by_title(pages.where("html like '%Alpha%'").limit(1), docs, labels).collect()
    assert [r.bad for r in single] == [True]


def whiten(x, components):
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1][:components], vectors[:, ::-1][:, :components], values.sum()


def test_whitening_is_that_of_the_covariance(spark):
    rng = np.random.default_rng(11)
    x = (rng.normal(size=(400, 6)) @ np.diag([9, 5, 3, 1, 0.5, 0.2]) + rng.normal(size=6) * 50).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i + 1000, x[0].tolist()) for i in range(300)]
    odd = [(-1, None), (-2, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (-3, [math.nan] * 6), (-4, [math.inf] * 6), (-5, []), (-6, [1.0, 2.0]), (None, x[1].tolist())]
    frame = spark.createDataFrame([(i, v, 1.0, "s") for i, v in rows + odd], "vec_id long, embedding array<float>, whitened double, deviation string")
    got = whitening.whitened(frame, components=5).toPandas()
    n, sums, values, vectors, total = whiten(np.floor(256 * x.astype(float)), 5)
    assert set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    assert sorted(got[got.component == 1].vec_id.fillna(-9)) == sorted([i for i, _ in rows] + [-9])
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, values / total, rtol=1e-10)
    one = got[got.vec_id < 400].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    expected = (np.floor(256 * x.astype(float)) - sums / n) @ vectors / np.sqrt(values)
    assert np.abs(np.abs(one) - np.abs(expected)).max() < 1e-8
    deviations = {int(r.vec_id): int(r.deviation) for r in got[got.vec_id < 400].itertuples()}
    whole = np.floor(256 * x.astype(float)).astype(int).astype(object)
    assert all(deviations[i] == int(((n * v - sums.astype(int).astype(object)) ** 2).sum()) for i, v in enumerate(whole))


def test_whitening_of_little(spark):
    kinds = "vec_id long, embedding array<double>"
    frame = lambda *v: spark.createDataFrame(list(enumerate(v)), kinds)
    assert whitening.whitened(spark.createDataFrame([], kinds)).count() == 0
    assert whitening.whitened(frame([1.0, 2.0], [1.0, 2.0])).count() == 0
    assert whitening.whitened(frame(None, [])).count() == 0
    line = whitening.whitened(frame([0.0, 0.0, 0.0], [1.0, 1.0, 0.0], [2.0, 2.0, 0.0])).toPandas()
    assert set(line.component) == {1} and line.explained.iloc[0] == pytest.approx(1) and np.allclose(sorted(line.whitened.abs()), [0, math.sqrt(1.5), math.sqrt(1.5)])
    far = whitening.whitened(frame([2.0**50, 0.0], [-(2.0**50), 1.0])).toPandas()
    assert int(far.deviation.iloc[0]) == (2**59) ** 2 + 256**2
    with pytest.raises(Exception, match="CAST_OVERFLOW|overflow"):
        whitening.whitened(frame([2.0**50, 0.0], [-(2.0**50), 1.0])).select(F.col("deviation").cast("long")).collect()
