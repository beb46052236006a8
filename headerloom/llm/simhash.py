"""SimHash near-duplicate detection by pigeonhole blocks (operator 7).

Fingerprints that differ in at most ``max_distance`` bits agree on enough of
``blocks`` bit blocks that every such pair shares one combination of
``blocks - max_distance`` of them; those combinations are the join keys. The
number of blocks follows the number of distinct fingerprints, so that chance
meetings on a key stay rare; any number of blocks finds every pair.

Copies share a fingerprint and are one node. Inside a key, all points are first
compared with one pivot, another one in each key. What that leaves outside the
pivot's component is compared with all points of the key. So a dense group of near
copies costs a few passes over its points instead of all its pairs, and no link
between different components is lost.

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle hash as one; repeated rows each keep their
row; rows without an id are rows like others, and a component of them alone has
a null component_id; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerloom.llm.common import WAYS, hex_digits, spread_join, staged, text_or_empty

SHINGLE_WORDS = 4
MAX_DISTANCE = 4
SEED = 42
#: Random pairs expected on one key for each fingerprint, at most; more blocks are taken beyond.
CHANCE_PER_POINT = 4.0
#: Points of one key beyond which they are dealt over several tasks.
OFTEN = 200


def fingerprint(text: str, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of one text; XXH64 of word shingles, seed 42."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not found:
        return 0
    last = max(1, len(found) - words + 1)
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, last, 65_536):
        hashes = [xxh64_intdigest(b" ".join(found[i : i + words]), SEED) for i in range(start, min(last, start + 65_536))]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > last).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of each row."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.select(F.col(id_col), simhash(text_or_empty(text_col)).alias("fp"))


def block_count(points: int, max_distance: int = MAX_DISTANCE) -> int:
    """The fewest blocks whose keys make chance meetings rare among ``points`` fingerprints."""
    for blocks in range(max_distance + 1, 2 * max_distance + 5):
        keys = len(list(combinations(range(blocks), max_distance)))
        bits = 64 * (blocks - max_distance) / blocks
        if points * keys / 2**bits <= CHANCE_PER_POINT:
            return blocks
    return 2 * max_distance + 4


def _block_masks(blocks: int, max_distance: int) -> list[int]:
    """Signed masks of every combination of blocks that a close pair may agree on."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(parts, blocks - max_distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _close(a: str, b: str, max_distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_distance


def components(points: DataFrame, edges: DataFrame) -> DataFrame:
    """(fp, root) of each point: the least point of its component.

    Least-label propagation with pointer jumping; every round is written to the
    shared folder, so neither the plan nor the lineage grows. The hub of a star
    of edges and the root of a large component are join keys of many rows: these
    are dealt over several tasks. Only labels that differ from their point are
    passed on, as the first labels already know every neighbour.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    # Only points with an edge can move.
    labels = staged(both.groupBy(F.col("a").alias("fp")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        moving = labels.where("root <> fp")
        near = spread_join(both, moving.withColumnRenamed("fp", "b"), ["b"], F.col("a")).groupBy(F.col("a").alias("fp")).agg(F.min("root").alias("near"))
        moved = staged(labels.join(near, "fp", "left").select("fp", F.col("root").alias("was"), F.least("root", "near").alias("root")), "moved")
        ahead = moved.where("root <> fp").select(F.col("fp").alias("root"), F.col("root").alias("ahead"))
        jumped = staged(spread_join(moved, ahead, ["root"], F.col("fp"), "left").select("fp", "was", F.coalesce("ahead", "root").alias("root")), "labels")
        labels = jumped.select("fp", "root")
        if jumped.where("root <> was").isEmpty():
            break
    return points.join(labels, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def shared_keys(keyed: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (key, fp) whose key another point has too, with the key's pivot and the ways over which its rows are dealt.

    The pivot is a point that the key chooses by hash, so that the keys of a
    group of near copies have different ones: a group hangs together by what its
    points share with many pivots, even where one of them is far from most.
    """
    first = F.min(F.struct(F.xxhash64("key", "fp").alias("h"), "fp"))["fp"]
    ways = F.when(F.col("n") > OFTEN, WAYS).otherwise(1)
    shared = staged(keyed.groupBy("key").agg(first.alias("pivot"), F.count("*").alias("n")).where("n > 1").select("key", "pivot", ways.alias("ways")), "shared")
    # Only keys of many points are copied; all other rows have way 0.
    often = staged(shared.where("ways > 1").select("key", "ways"), "often")
    dealt = spread_join(keyed, often, ["key"], F.col("fp"), "left").withColumn("way", way_of(F.col("fp"))).drop("ways")
    return staged(dealt.join(shared.withColumn("way", each_way()), ["key", "way"]).drop("way"), "keyed")


def way_of(by: Column) -> Column:
    return F.when(F.col("ways") > 1, F.pmod(F.xxhash64(by), F.col("ways")).cast("int")).otherwise(0)


def each_way() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("ways") - 1))


def meetings(keyed: DataFrame, roots: DataFrame, close: Callable[[str, str], Column], carried: tuple[str, ...] = ()) -> DataFrame:
    """(a, b): ``close`` pairs of points of one key that no link connects yet, without pairs with the pivot.

    Points of the pivot's component are settled among themselves; each other
    point of a key meets all points of the key that lie in another component.
    ``close`` takes the suffixes of both sides' columns fp and ``carried``.
    """
    pivot_roots = roots.select(F.col("fp").alias("pivot"), F.col("root").alias("pivot_root"))
    placed = staged(spread_join(keyed.join(roots, "fp"), pivot_roots, ["pivot"], F.col("fp")), "placed")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("fp", "root", *carried)]
    others = placed.where("root <> pivot_root").select("key", each_way().alias("way"), *side("a"))
    meets = placed.where("fp <> pivot").select("key", way_of(F.col("fp")).alias("way"), *side("b"), (F.col("root") != F.col("pivot_root")).alias("other"))
    met = meets.join(others, ["key", "way"]).where(F.col("root_a") != F.col("root_b"))
    return met.where((F.col("fp_a") < F.col("fp_b")) | ~F.col("other")).where(close("a", "b")).select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def near_pairs(points: DataFrame, max_distance: int = MAX_DISTANCE, blocks: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect what links of at most ``max_distance`` bits connect."""
    blocks = blocks or block_count(points.count(), max_distance)
    masks = _block_masks(blocks, max_distance)
    parts = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    keyed = shared_keys(points.select("fp", F.explode(parts).alias("key")))
    pivots = keyed.where(F.col("fp") != F.col("pivot")).where(_close("fp", "pivot", max_distance))
    first = staged(pivots.select(F.col("pivot").alias("a"), F.col("fp").alias("b")).distinct(), "pivots")
    second = meetings(keyed, components(points, first), lambda a, b: _close(f"fp_{a}", f"fp_{b}", max_distance))
    return first.union(second.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fp, component_id) of each row; component_id is the least id of the component, null if none of its rows has an id."""
    prints = staged(fingerprints(docs, id_col, text_col, words).withColumn("row", F.monotonically_increasing_id()), "prints")
    points = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("n")), "points")
    named = points.join(components(points.select("fp"), near_pairs(points.select("fp"), max_distance)), "fp")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    classes = spread_join(named.select("fp", "root"), least, ["root"], F.col("fp")).select("fp", "component_id", F.lit(True).alias("shared"))
    # A row that is alone in its component needs no class.
    met = spread_join(prints, classes, ["fp"], F.col("row"), "left")
    return met.select(id_col, "fp", F.when(F.col("shared"), F.col("component_id")).otherwise(F.col(id_col)).alias("component_id"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")
