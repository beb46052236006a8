"""Language identification by Bayesian evidence fusion (operator 3).

For each page four pieces of evidence on its language are combined:

* the text: hashed byte trigrams of the visible text under a naive Bayes model
  (trained on about ``SAMPLE_PER_LANGUAGE`` labelled documents of each
  language, chosen by hash), tempered to at most ``TEXT_WEIGHT`` trigrams;
* the language that the markup declares, and the address's suffix, each with
  P(value | language) counted over all pages;
* the prior of the host, smoothed towards that of its domain and of all pages.

Counts are sums of the pages' text posteriors by grouped aggregation (map-side
sums, so a host of a third of all pages is no heavier than others); a page's
own share is taken out of what its host and domain say about it. Host counts
are joined back without a limit; Spark splits a hot host's pages.

Edge cases: a null or empty page has no text evidence and follows its host; a
null or odd address has an empty host; an undeclared language is a value of
its own; without training documents or with one language, that is the answer;
an empty table gives an empty result; repeated rows each keep their row;
other columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerloom.llm.common import staged, text_or_empty

BUCKETS = 1 << 14
SAMPLE_PER_LANGUAGE = 3000
MAX_LANGUAGES = 200
TEXT_WEIGHT = 40.0
#: Pages' worth of belief in the domain for a host, and in all pages for a domain.
HOST_SMOOTHING, DOMAIN_SMOOTHING = 5.0, 20.0
VALUE_SMOOTHING = 0.5

_HIDDEN = ("script", "style", "nav", "noscript", "template")
_OPENS = re.compile(rf"<({'|'.join(_HIDDEN)})\b", re.IGNORECASE)
_CLOSES = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in _HIDDEN}
_NOT_LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def visible_text(page: str) -> str:
    """The text outside tags, comments and hidden elements; an element or comment that isn't closed hides nothing.

    What has no end is looked for once in a page, so that thousands of open tags cost no more than one.
    """
    out, at, endless = [], 0, set()
    while (start := page.find("<", at)) >= 0:
        end = -1
        if "<!--" not in endless and page.startswith("<!--", start):
            end = page.find("-->", start + 4) + 3
            if end == 2:
                endless.add("<!--")
                end = -1
        elif (m := _OPENS.match(page, start)) and (name := m[1].lower()) not in endless:
            closing = _CLOSES[name].search(page, m.end())
            if closing:
                end = closing.end()
            else:
                endless.add(name)
        if end < 0:
            end = page.find(">", start) + 1
        if not end:
            break
        out += [page[at:start], " "]
        at = end
    text = "".join([*out, page[at:]])
    return markup.unescape(text) if "&" in text else text


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a lower-cased text; runs of other characters than letters are one space."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_NOT_LETTERS) + b" ", np.uint8)
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, dtype=np.int64)
    h = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return ((h >> np.uint32(12)) % np.uint32(BUCKETS)).astype(np.int64)


def train(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language)) from labelled documents (doc_id, text, lang)."""
    labelled = docs.where("lang is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return ["und"], np.zeros((1, BUCKETS))
    share = F.element_at(F.create_map(*[F.lit(x) for s in names for x in (s, min(1.0, sample / sizes[s]))]), F.col("lang"))
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < share * (1 << 20)).select("lang", text_or_empty("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(names), BUCKETS), dtype=np.int64)
        at = {s: i for i, s in enumerate(names)}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[at[lang]] += np.bincount(trigrams(text), minlength=BUCKETS)
        langs, buckets = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(langs.astype(np.int32)), pa.array(buckets.astype(np.int32)), pa.array(n[langs, buckets])], names=["lang", "bucket", "n"])

    counts = np.full((len(names), BUCKETS), 0.5)
    # At most MAX_LANGUAGES * BUCKETS sums.
    for r in picked.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r[0], r[1]] += r[2]
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, loglik (tempered) and own (text posterior) of each page."""
    table = np.ascontiguousarray(logs.T)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((len(batch.column(0)), len(names)))
            for k, page in enumerate(batch.column(2).to_pylist()):
                h = trigrams(visible_text(page))
                if len(h):
                    # n trigrams count as n * W / (n + W), at most W: neighbours in a text aren't independent.
                    out[k] = table[h].mean(axis=0) * (len(h) * TEXT_WEIGHT / (len(h) + TEXT_WEIGHT))
            out -= out.max(axis=1, keepdims=True) if out.size else 0
            own = np.exp(out)
            own /= own.sum(axis=1, keepdims=True) if out.size else 1
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(names)), pa.array(x.ravel())) for x in (out, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *lists], names=["page_id", "host", "declared", "loglik", "own"])

    host = F.lower(F.regexp_extract(text_or_empty("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    # The first such tag alone is looked at: a page of beginnings of tags is read once.
    tag = F.regexp_extract(text_or_empty("html"), r"(?i)<html\b([^>]*+)", 1)
    declared = F.lower(F.regexp_extract(tag, r"(?i)\slang\s*+=\s*+[\"']?([a-zA-Z]++)", 1))
    narrow = pages.select("page_id", host.alias("host"), text_or_empty("html").alias("html"), declared.alias("declared"))
    kind = pages.schema["page_id"].dataType.simpleString()
    found = narrow.mapInArrow(work, f"page_id {kind}, host string, declared string, loglik array<double>, own array<double>")
    return found.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})


def _sums(rows: DataFrame, keys: list[str], value: str, size: int, name: str) -> DataFrame:
    """Element-wise sums of an array column by ``keys``."""
    got = rows.groupBy(*keys).agg(*[F.sum(F.get(F.col(value), F.lit(i))).alias(f"__{i}") for i in range(size)])
    return got.select(*keys, F.array(*[f"__{i}" for i in range(size)]).alias(name))


def _given_language(values: DataFrame, key: str, size: int) -> DataFrame:
    """(key, log P(value | language)) from sums by value, smoothed over the values met and one more."""
    totals = values.agg(F.count("*").alias("kinds"), *[F.sum(F.get("n", F.lit(i))).alias(f"t{i}") for i in range(size)])
    total = F.array(*[f"t{i}" for i in range(size)])
    share = F.zip_with("n", total, lambda a, b: F.log((a + VALUE_SMOOTHING) / (b + VALUE_SMOOTHING * (F.col("kinds") + 1))))
    return values.join(F.broadcast(totals), F.lit(True)).select(key, share.alias(f"{key}_log"))


def _added(*parts: Column) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = F.zip_with(out, p, lambda a, b: a + b)
    return out


def languages(pages: DataFrame, names: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, host, declared, text_lang, lang and confidence of each page."""
    size = len(names)
    rows = staged(text_evidence(pages, names, logs), "language")
    by_value = _sums(rows, ["host", "domain", "suffix"], "own", size, "host_n")
    hosts = staged(by_value.join(rows.groupBy("host").agg(F.count("*").alias("host_pages")), "host"), "hosts")
    domains = _sums(hosts, ["domain"], "host_n", size, "domain_n").join(hosts.groupBy("domain").agg(F.sum("host_pages").alias("domain_pages")), "domain")
    suffixes = _given_language(_sums(hosts, ["suffix"], "host_n", size, "n"), "suffix", size)
    everything = _sums(hosts.withColumn("all", F.lit(1)), ["all"], "host_n", size, "all_n").join(hosts.agg(F.sum("host_pages").alias("all_pages")), F.lit(True)).drop("all")
    hosts = hosts.join(domains, "domain").join(suffixes, "suffix").join(F.broadcast(everything), F.lit(True)).drop("domain", "suffix")
    declared = _given_language(_sums(rows, ["declared"], "own", size, "n"), "declared", size)
    met = rows.select("page_id", "host", "declared", "loglik", "own").join(hosts, "host").join(declared, "declared")

    overall = F.transform("all_n", lambda a: (a + 1.0) / (F.col("all_pages") + size))
    domain = F.zip_with(F.zip_with("domain_n", "own", lambda a, b: a - b), overall, lambda a, p: (a + DOMAIN_SMOOTHING * p) / (F.col("domain_pages") - 1 + DOMAIN_SMOOTHING))
    host = F.zip_with(F.zip_with("host_n", "own", lambda a, b: a - b), domain, lambda a, p: (a + HOST_SMOOTHING * p) / (F.col("host_pages") - 1 + HOST_SMOOTHING))
    prior = F.transform(host, lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    met = met.withColumn("log", _added(F.col("loglik"), F.col("suffix_log"), F.col("declared_log"), prior))
    top = F.array_max("log")
    weight = F.aggregate(F.transform("log", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
    names_column = F.array(*[F.lit(s) for s in names])
    named = lambda c: F.element_at(names_column, F.array_position(c, F.array_max(c)).cast("int"))
    return met.select("page_id", "host", "declared", named(F.col("own")).alias("text_lang"), named(F.col("log")).alias("lang"), F.round(1 / weight, 6).alias("confidence"))


def op3_language(spark, sf_dir: str) -> DataFrame:
    """Language of every page."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return languages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), *train(docs))
