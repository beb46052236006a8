"""Toxicity by a weighted lexicon (operator 9).

Texts are folded (lower case, look-alike letters of other scripts to Latin,
digits and signs that touch a letter to the letters they stand for, l to i, as 1
stands for both), other characters become spaces, and an Aho-Corasick automaton
finds the lexicon's words and word beginnings at word boundaries. Phrases that
excuse a word are found by the same automaton and cancel the matches inside
them. The weights of a text's matches, alone and in proportion to its length, go
through a logistic curve.

Lexicon and exceptions are learned: from labelled rows, terms (whole words and
word beginnings of ``PREFIXES`` letters) are counted once per different text and
label; those that toxic texts hold significantly more often are kept with their
log odds. An exception is a word of the lexicon with a neighbour, which
``LEAST_EXCUSED`` clean texts hold and clean texts hold more often than toxic
ones. Training takes about ``SAMPLE_PER_LABEL`` rows of each label at most,
chosen by hash. The curve is fitted on what each half's texts score under the
lexicon of the other half; the lexicon is then that of both.

Edge cases: a null or empty text has no matches and the score of a text
without any; without labels of both kinds all scores are 0; repeated rows each
keep their row; rows with a null label are not trained on; an empty table
gives an empty result; columns besides the id, the text and the labels are
ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.common import staged, text_or_empty

SAMPLE_PER_LABEL = 10_000
PREFIXES = (4, 5, 6, 7)
#: Least texts with a term, and least log-likelihood ratio of its excess among toxic ones.
LEAST_TEXTS, LEAST_RATIO, LEAST_ODDS = 3, 12.0, 1.5
#: Least clean texts with a phrase that excuses a word.
LEAST_EXCUSED = 5
REJECT_AT = 0.7

#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t",
    "α": "a", "ο": "o", "ρ": "p", "υ": "u", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "ε": "e",
}
#: Digits and signs written for letters; l is read as i, so that 1 and | have one reading.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}

_LETTER, _STANDING = r"[^\W\d_]", r"[0134578@$!|9]"
#: Runs that touch a letter; each place is looked at once, however long a run is.
_SIGNS = re.compile(rf"(?<={_LETTER}){_STANDING}++|(?<!{_STANDING}){_STANDING}++(?={_LETTER})")
_MARKS = re.compile(r"[!|]+$")
_SPELLED = re.compile(r"(?<!\w)(?:\w[.\-*_]){3,}\w(?!\w)")
_READ = str.maketrans(STANDS_FOR)


def _read(m: re.Match) -> str:
    """The letters of a run; marks at the end of a word end it."""
    run = m[0]
    if m.end() == len(m.string) or not m.string[m.end()].isalpha():
        run = _MARKS.sub(" ", run)
    return run.translate(_READ)


class _Folding(dict):
    """Code points to letters or a space; filled as characters come up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = LOOK_ALIKES.get(c) or (c if c.isalpha() else " ")
        self[code] = out = "i" if out == "l" else out
        return out


_fold = _Folding()
_ascii = bytes(ord("i") if chr(c) == "l" else c if chr(c).isalpha() and c < 128 else 32 for c in range(256))


def fold(text: str) -> str:
    """The text's words in folded letters, with a space before and after each."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if _SIGNS.search(text):
        text = _SIGNS.sub(_read, text)
    if "." in text or "*" in text or "-" in text or "_" in text:
        text = _SPELLED.sub(lambda m: m[0][::2], text)
    folded = text.encode().translate(_ascii).decode("ascii") if text.isascii() else text.translate(_fold)
    return f" {folded} "


def terms_of(text: str) -> set[str]:
    """Words as ' word ' and word beginnings as ' wor', the form the automaton looks for."""
    words = set(fold(text).split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) > k}


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    curve: tuple[float, ...]
    exceptions: tuple[str, ...] = ()


def build(model: Model):
    """The automaton of a model, or None without a lexicon."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in model.lexicon.items():
        found.add_word(term, (len(term), weight))
    for phrase in model.exceptions:
        found.add_word(f" {phrase} ", (len(phrase) + 2, None))
    if model.lexicon:
        found.make_automaton()
        return found
    return None


def _outside(at: dict[int, float], spans: list[tuple[int, int]]) -> dict[int, float]:
    """The matches that begin in none of ``spans``; both are walked once, in order."""
    spans = sorted(spans)
    kept, k, until = {}, 0, -1
    for start in sorted(at):
        while k < len(spans) and spans[k][0] <= start:
            until = max(until, spans[k][1])
            k += 1
        if start >= until:
            kept[start] = at[start]
    return kept


def features(text: str, automaton) -> tuple[float, float, float]:
    """(log of the summed weights, log of that for 1000 words, largest weight); each word counts once with its largest weight."""
    if automaton is None or not text:
        return 0.0, 0.0, 0.0
    folded = fold(text)
    at: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            excused.append((start, end))
        elif weight > at.get(start, 0.0):
            at[start] = weight
    if excused:
        at = _outside(at, excused)
    if not at:
        return 0.0, 0.0, 0.0
    total = sum(at.values())
    return float(np.log1p(total)), float(np.log1p(1000 * total / max(20, len(folded.split())))), max(at.values())


def curve_score(x: np.ndarray, curve: tuple[float, ...]) -> np.ndarray:
    """0 to 1; weights that would lower the score with more matches are not allowed by the fit."""
    if not curve:
        return np.zeros(len(x))
    return 1 / (1 + np.exp(-np.clip(x @ np.array(curve[1:]) + curve[0], -40, 40)))


def fit_curve(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small penalty; features that come out negative are left out."""
    used = list(range(x.shape[1]))
    while True:
        z = np.column_stack([np.ones(len(x)), x[:, used]])
        b = np.zeros(z.shape[1])
        penalty = np.diag([1e-3, *[0.05] * len(used)])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -40, 40)))
            step = np.linalg.solve((z * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + penalty, z.T @ (weights * (y - p)) - penalty @ b)
            b = b + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        bad = [k for k, v in zip(used, b[1:], strict=True) if v < 0]
        if not bad:
            out = np.zeros(x.shape[1] + 1)
            out[0] = b[0]
            out[[k + 1 for k in used]] = b[1:]
            return tuple(out.tolist())
        used = [k for k in used if k not in bad]


def _without_longer(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log odds of the terms kept: a beginning whose excess is all due to a longer one goes, and so does a longer one that adds nothing."""

    def odds(p: int, n: int) -> float:
        return float(np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1)))

    counts = {t: (p, n) for t, p, n in rows}
    kept: dict[str, float] = {}
    for term in sorted(counts, key=len):
        p, n = counts[term]
        stem = term.rstrip()
        shorter = next((term[:k] for k in range(len(stem) if term != stem else len(stem) - 1, 2, -1) if term[:k] in kept), None)
        if shorter is not None:
            q, m = counts[shorter]
            if odds(max(0, q - p), max(0, m - n)) < LEAST_ODDS or m > n and odds(p, n) > kept[shorter] + 1:
                del kept[shorter]
            else:
                continue
        kept[term] = odds(p, n)
    return kept


def _lexicon(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms that toxic texts hold significantly more often, from (term, toxic texts, clean texts), with their weights."""
    kept = []
    for term, p, n in rows:
        if p < LEAST_TEXTS or np.log((p + 0.5) / (toxic + 1)) - np.log((n + 0.5) / (clean + 1)) < LEAST_ODDS:
            continue
        expected = (p + n) * toxic / (toxic + clean)
        if 2 * (p * np.log(p / expected) + (n * np.log(n / (p + n - expected)) if n else 0.0)) >= LEAST_RATIO:
            kept.append((term, p, n))
    return _without_longer(kept, toxic, clean)


def phrases_of(text: str, words: set[str], beginnings: set[str]) -> set[str]:
    """Words of the lexicon in a text, each with the word before and the word after it."""
    found = fold(text).split()
    at = [i for i, w in enumerate(found) if w in words or any(w[:k] in beginnings for k in PREFIXES)]
    return {" ".join(found[i + d : i + d + 2]) for i in at for d in (-1, 0) if 0 <= i + d < len(found) - 1}


def _exceptions(rows: DataFrame, lexicon: dict[str, float], toxic: int, clean: int) -> tuple[str, ...]:
    """Phrases around words of the lexicon that speak for a clean text."""
    words, beginnings = {t.strip() for t in lexicon if t.endswith(" ")}, {t.strip() for t in lexicon if not t.endswith(" ")}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[label].update(phrases_of(text, words, beginnings))
        yield from _counted(n, "phrase")

    counted = rows.select("text", "toxic").mapInArrow(count, "phrase string, p long, n long").groupBy("phrase").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    # A phrase of the sample's texts each: the sample bounds them.
    kept = counted.where((F.col("n") >= LEAST_EXCUSED) & (F.col("n") * toxic > F.col("p") * clean)).select("phrase").collect()
    return tuple(sorted(r[0] for r in kept))


def _counted(n: dict[int, Counter], name: str) -> Iterator[pa.RecordBatch]:
    terms = list(n[0].keys() | n[1].keys())
    for i in range(0, len(terms), 50_000):
        some = terms[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *[pa.array([n[k][t] for t in some], pa.int64()) for k in (1, 0)]], names=[name, "p", "n"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_PER_LABEL) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    labels = labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r[0]: r[1] for r in labels.where("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Model({}, ())
    # A hash below the label's share takes about ``sample`` rows of it, without sorting or gathering.
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20))
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / sizes[1]))).otherwise(F.lit(min(1.0, sample / sizes[0])))
    picked = labels.where(F.col("toxic").isin(0, 1)).where(place < share * (1 << 20)).withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(2)))
    # At most about 2 * sample ids are broadcast.
    rows = docs.select("doc_id", text_or_empty("text").alias("text")).join(F.broadcast(picked), "doc_id")
    # Copies count once, so that a much-copied text doesn't make its words toxic.
    rows = staged(rows.groupBy("text", "toxic").agg(F.min("half").cast("int").alias("half")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, dict[int, Counter]] = {h: {0: Counter(), 1: Counter()} for h in (0, 1)}
        for batch in batches:
            for text, toxic, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n[half][toxic].update(terms_of(text))
        for half in (0, 1):
            for out in _counted(n[half], "term"):
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([half] * out.num_rows, pa.int32())], names=[*out.schema.names, "half"])

    have = {(r[0], r[1]): r[2] for r in rows.groupBy("half", "toxic").count().collect()}
    toxic, clean = ([have.get((h, k), 0) for h in (0, 1)] for k in (1, 0))
    if not sum(toxic) or not sum(clean):
        return Model({}, ())
    by_half = [F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for c in "pn" for h in (0, 1)]
    terms = rows.select("text", "toxic", "half").mapInArrow(count, "term string, p long, n long, half int").groupBy("term").agg(*by_half)
    # Terms of the sample's texts that at least LEAST_TEXTS toxic ones hold, and too often: the sample bounds them.
    excess = F.log((F.col("p0") + F.col("p1") + 0.5) / (sum(toxic) + 1)) - F.log((F.col("n0") + F.col("n1") + 0.5) / (sum(clean) + 1))
    some = terms.where((F.col("p0") + F.col("p1") >= LEAST_TEXTS) & (excess >= LEAST_ODDS)).collect()
    lexicons = [_lexicon([(r["term"], r[f"p{h}"], r[f"n{h}"]) for r in some], toxic[h], clean[h]) for h in (0, 1)]
    lexicon = _lexicon([(r["term"], r["p0"] + r["p1"], r["n0"] + r["n1"]) for r in some], sum(toxic), sum(clean))
    exceptions = _exceptions(rows, lexicon, sum(toxic), sum(clean)) if lexicon else ()
    # Each half is scored by what the other one taught.
    seen = [r for h in (0, 1) for r in feature_rows(rows.where(F.col("half") == 1 - h).select("toxic", "text"), Model(lexicons[h], (), exceptions), "toxic").collect()]
    x = np.array([[r["total"], r["dense"], r["largest"]] for r in seen])
    y = np.array([r["toxic"] for r in seen], dtype=float)
    # Each label weighs as many rows as it has, not as many as were taken.
    scale = np.where(y == 1, sizes[1] / max(1, y.sum()), sizes[0] / max(1, (1 - y).sum()))
    return Model(lexicon, fit_curve(x, y, scale * len(y) / scale.sum()), exceptions)


def feature_rows(rows: DataFrame, model: Model, key: str) -> DataFrame:
    """``key`` with total, dense, largest and score of each row's text (second column)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(model)
        for batch in batches:
            x = np.array([features(t, automaton) for t in batch.column(1).to_pylist()]).reshape(-1, 3)
            columns = [pa.array(x[:, k]) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(curve_score(x, model.curve))], names=[key, "total", "dense", "largest", "score"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.mapInArrow(work, f"`{key}` {kind}, total double, dense double, largest double, score double")


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score of each row."""
    rows = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    return feature_rows(rows, model, id_col).select(id_col, "score")


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    found = scores(docs, train(docs, labels))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= REJECT_AT).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score under REJECT_AT, with their own columns; the model learns from those of them that aren't held out."""
    model = train(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))))
    places = {c: F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(docs.columns)}

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = build(model)
        for texts in batches:
            x = np.array([features(t, automaton) for t in texts]).reshape(-1, 3)
            yield pd.Series(curve_score(x, model.curve))

    return docs.select(*places.values(), score(text_or_empty("text")).alias("s")).where(F.col("s") < REJECT_AT).select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])
