"""Ranked lexical search over a two-level quantised index (operator 11).

The index is inverted in blocks of documents. A row (block, term) holds the
places of the term's documents in the block, and two levels of impacts: the
exact ones, integers below ``IMPACTS``, and the same rounded up to one byte. A
weighted sum of bytes bounds a document's score from above, one of the bytes
less one from below. In each block the k-th best lower bound of an item decides
which documents can be among its best; all of those, and only those, are scored
again from the exact impacts, in integers. The best of all blocks meet in one
ranking. So no pair of an item and a document is ever a row, but the k best of
each block.

A block holds at most ``BLOCK_DOCS`` documents and closes at ``BLOCK_POSTINGS``
postings, whatever its texts are; a frequent term has one row in each block. Items are
dealt over groups of about ``ITEMS_AT_ONCE``, each of which meets each block in a task of
its own, so neither many items nor many documents make a task larger.

Edge cases: null texts, and texts without a term, are no documents of the
index; very long texts count whole; rows that repeat an id are documents of
their own, with a rank each; rows without an id come after others of their score; rows of one
item_id, null too, are one item with the terms of all its texts; an item without terms has no
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerloom.llm.common import ascii_lower, staged

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 50
BLOCK_DOCS = 4096
BLOCK_POSTINGS = 1_000_000
ITEMS_AT_ONCE = 256
#: Exact impacts lie below this; a byte stands for STEP of them.
IMPACTS = 1_000_000_000 // 1000
STEP = -(-IMPACTS // 255)

#: What separates terms becomes a space, A-Z become small: splitting bytes then gives the terms.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_BLOCKS = "block long, term string, docs binary, bounds binary, impacts binary, ids array<long>"


def terms_of(text: Column) -> Column:
    """All terms of a text, with repeats."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def split_terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLDED).split(b" ")


@dataclass(frozen=True)
class Index:
    """``postings``: (block, term, docs, bounds, impacts); ``places``: (block, ids), the ids of a block's documents by place."""

    postings: DataFrame
    places: DataFrame
    n_docs: int


def corpus_sizes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """(documents with a term, terms of all documents with repeats)."""
    n = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(TERM)).cast("long")
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return row.docs, row.terms


def _block(number: int, ids: list, counts: list[Counter], n_docs: int, n_terms: int) -> pa.RecordBatch:
    """Rows of one block. Documents stand in the order of their ids, those without one last."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    ids, counts = [ids[i] for i in order], [counts[i] for i in order]
    terms = pa.array([t for c in counts for t in c], pa.binary()).dictionary_encode()
    codes = terms.indices.to_numpy()
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(codes))
    doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    # Sizes are Python integers, which don't overflow.
    length = np.array([50 + 50 * c.total() * n_docs // n_terms for c in counts], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 20 * length[doc])
    bound = (-(-impact // STEP)).astype(np.uint8)
    by_term = np.argsort(codes, kind="stable")
    docs, bounds, impacts = doc[by_term].astype("<u2"), bound[by_term], impact[by_term].astype("<u4")
    ends = np.cumsum(np.bincount(codes, minlength=len(terms.dictionary)))
    spans = list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True))
    # The first row, of no term, holds the ids.
    cut = lambda a: pa.array([None, *(a[i:j].tobytes() for i, j in spans)], pa.binary())
    names = pa.concat_arrays([pa.array([None], pa.string()), terms.dictionary.cast(pa.string())])
    rows = len(spans) + 1
    columns = [pa.array([number] * rows, pa.int64()), names, cut(docs), cut(bounds), cut(impacts), pa.array([ids, *[None] * len(spans)], pa.list_(pa.int64()))]
    return pa.record_batch(columns, names=["block", "term", "docs", "bounds", "impacts", "ids"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all rows of ``docs``, written to the shared folder."""
    n_docs, n_terms = corpus_sizes(docs, text_col)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids, counts, postings = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                count = Counter(split_terms(text.as_py()))
                del count[b""]
                if not count:
                    continue
                ids.append(doc_id.as_py())
                counts.append(count)
                postings += len(count)
                if len(ids) == BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                    yield _block(number, ids, counts, n_docs, n_terms)
                    number, ids, counts, postings = number + 1, [], [], 0
        if ids:
            yield _block(number, ids, counts, n_docs, n_terms)

    rows = staged(docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(blocks, _BLOCKS), "lexical-index")
    return Index(rows.where("term is not null").drop("ids"), rows.where("term is null").select("block", "ids"), n_docs)


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, item_id, term): each term of an item once; ``item`` numbers the items."""
    terms = items.select(F.col(id_col).alias("item_id"), F.explode(terms_of(F.col(text_col))).alias("term")).distinct()
    numbers = staged(terms.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    return staged(terms.join(numbers, terms["item_id"].eqNullSafe(numbers["item_id"])).select("item", numbers["item_id"], "term"), "item-terms")


def weighted(index: Index, terms: DataFrame) -> DataFrame:
    """(term, part, items): the items of each group of items that hold a term, with the term's weight."""
    wanted = terms.select("term").distinct()
    df = index.postings.select("term", F.octet_length("bounds").alias("n")).join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * index.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = df.select("term", weight.alias("w"))
    groups = max(1, -(-terms.select("item").distinct().count() // ITEMS_AT_ONCE))
    part = F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int")
    held = F.struct("item", "w")
    return terms.join(weights, "term").withColumn("part", part).groupBy("term", "part").agg(F.collect_list(held).alias("items"))


def _best_of_block(best: int):
    """The best documents of one block for the items of one group, from its posting rows."""

    def scored(rows: pa.Table) -> pa.Table:
        held = rows.column("items").combine_chunks()
        pairs, ends = held.flatten(), held.offsets.to_numpy() - held.offsets[0].as_py()
        numbers, item = np.unique(pairs.field("item").to_numpy(), return_inverse=True)
        weight = pairs.field("w").to_numpy()
        level = lambda name, kind: [np.frombuffer(x.as_py(), kind) for x in rows.column(name)]
        docs, bounds = level("docs", "<u2"), level("bounds", np.uint8)
        size = max(int(d.max()) for d in docs) + 1
        upper = np.zeros((len(numbers), size), np.int64)
        slack = np.zeros_like(upper)
        for r, (d, b) in enumerate(zip(docs, bounds, strict=True)):
            at = slice(ends[r], ends[r + 1])
            where = np.ix_(item[at], d)
            upper[where] += np.outer(weight[at], b.astype(np.int64))
            # A byte of 0 stands for 0 itself.
            slack[where] += np.outer(weight[at], b > 0)
        lower = upper - slack
        least = np.partition(lower, -best, axis=1)[:, -best] if size > best else np.zeros(len(numbers), np.int64)
        # Upper bounds are reached, lower ones are not: a score is above (bytes - 1) * STEP.
        chosen = (upper >= least[:, None]) & (upper > 0)
        exact = np.zeros_like(upper)
        for r, (d, i) in enumerate(zip(docs, rows.column("impacts"), strict=True)):
            at = slice(ends[r], ends[r + 1])
            a, b = np.nonzero(chosen[np.ix_(item[at], d)])
            exact[item[at][a], d[b]] += weight[at][a] * np.frombuffer(i.as_py(), "<u4")[b].astype(np.int64)
        out = []
        for k in range(len(numbers)):
            found = np.flatnonzero(exact[k])
            # By place for equal scores, which is by id.
            found = found[np.argsort(-exact[k, found], kind="stable")[:best]]
            out.append((np.full(len(found), numbers[k]), found, exact[k, found]))
        item_, place, score = (np.concatenate(x) for x in zip(*out, strict=True))
        block = np.full(len(item_), rows.column("block")[0].as_py())
        return pa.table({"item": item_, "block": block, "place": place.astype(np.int32), "score": score.astype(np.int64)})

    return scored


def search(index: Index, items: DataFrame, best: int = BEST, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item with a score above 0, equal ones by id."""
    terms = item_terms(items, id_col, text_col)
    met = index.postings.join(weighted(index, terms), "term").select("block", "part", "docs", "bounds", "impacts", "items")
    found = met.groupBy("block", "part").applyInArrow(_best_of_block(best), "item long, block long, place int, score long")
    # Documents with the score of the last one stay, until ids are known.
    ranked = found.withColumn("r", F.rank().over(Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("r") <= best)
    named = ranked.join(index.places, "block").select("item", F.get("ids", F.col("place")).alias("doc_id"), "score")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return top.join(terms.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The best documents of every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return search(build(docs), items)


def oracle() -> str:
    """Every document scored for every item, in DuckDB."""
    terms = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
    return f"""
WITH t AS (SELECT doc_id, {terms} AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
all_ AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
m AS (SELECT doc_id, 100 - 50 + ((50 * n * docs) // terms) AS m FROM len, all_),
q AS (SELECT DISTINCT item_id, {terms} AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, all_ GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= {BEST}"""
