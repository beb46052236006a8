"""Mixing sources to target weights by Pfair scheduling (operator 1).

Every source's rows are cut into blocks of ``block_rows``. With an integer
weight of ``w`` out of ``W``, block ``j`` of a source is released at slot
``floor(j W / w)`` and due before slot ``ceil((j + 1) W / w)``. Earliest
deadline first meets every deadline where the weights fill the slots exactly,
so after any number of slots each source is less than one block away from its
share. The schedule repeats after ``W`` slots: one period is computed from the
weights alone (at most ``MAX_PARTS`` slots) and joined to the rows.

Weights that are whole parts of at most ``MAX_PARTS`` are kept exactly. Others
are rounded to parts, and these parts are what the bound holds for.

Up to ``most`` sources are scheduled together on the driver. More are first
put into groups of ``FAN`` neighbours by name: each group is scheduled in a
task of its own by the same method, and the group then stands as one source of
its members' rows and weights, level by level until ``most`` are left. Each
level adds less than one block to the deviation; a group's members take over
the weight of a member that runs out.

When a source runs out, a phase ends and the others go on with their own
weights from there; the deviation bound holds inside each phase. No row is
dropped or repeated. Rows are numbered inside their source by a range
partitioning on (source, hash, id), so a hot source spreads over many tasks.

Edge cases: a null source is a source of its own (named ``NO_SOURCE``); null
ids and repeated rows are rows like others; an empty table gives an empty
result; a source without a given weight gets one part; columns besides those
named are carried along unchanged by ``interleaved`` and ignored by the query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerloom.llm.common import in_order, spread_join

NO_SOURCE = "<none>"
BLOCK_ROWS = 8
PARTS = 1000
MAX_PARTS = 20_000
#: Sources scheduled on the driver, and members of a group where there are more.
MOST_TOGETHER = 128
FAN = 64
#: Weights follow rows ** TEMPERATURE where none are given: large sources are damped.
TEMPERATURE = 0.5


def weight_parts(shares: Mapping[str, float], parts: int | None = None) -> dict[str, int]:
    """Shares as ``parts`` whole parts by largest remainder, each source one part at least; without ``parts`` exactly where MAX_PARTS allow."""
    if not shares:
        return {}
    if any(not x >= 0 for x in shares.values()):
        raise ValueError("a share is negative or not a number")
    given = {s: Fraction(str(x)) for s, x in shares.items()}
    whole = sum(given.values())
    if parts is None and all(given.values()):
        fine = math.lcm(*[(x / whole).denominator for x in given.values()])
        if fine <= MAX_PARTS:
            return {s: int(x / whole * fine) for s, x in given.items()}
    parts = parts or min(MAX_PARTS, max(PARTS, 4 * len(shares)))
    names, total = sorted(shares), sum(shares.values()) or 1.0
    exact = {s: shares[s] / total * parts for s in names}
    out = {s: max(1, int(exact[s])) for s in names}
    for s in sorted(names, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, parts - sum(out.values()))]:
        out[s] += 1
    return out


def period(weights: Mapping[str, int]) -> dict[str, list[int]]:
    """Slots of each source in one period of sum(weights) slots, earliest deadline first, ties by name."""
    total = sum(weights.values())
    released: list[tuple[int, str, int]] = []
    waiting = [(0, s, 0) for s in sorted(weights)]
    heapq.heapify(waiting)
    slots: dict[str, list[int]] = {s: [] for s in weights}
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(released, (-(-(j + 1) * total // weights[s]), s, j))
        _, s, j = heapq.heappop(released)
        slots[s].append(slot)
        if j + 1 < weights[s]:
            heapq.heappush(waiting, ((j + 1) * total // weights[s], s, j + 1))
    return slots


def phases(weights: Mapping[str, int], rows: Mapping[str, int], block_rows: int = BLOCK_ROWS) -> list[dict]:
    """One dict for each phase and source in it: its blocks, first slot, period, slots, and rows that earlier last blocks lack."""
    left = {s: -(-n // block_rows) for s, n in rows.items() if n > 0}
    done = dict.fromkeys(left, 0)
    base = lacking = phase = 0
    out = []
    while left:
        total = sum(weights[s] for s in left)
        slots = period({s: weights[s] for s in left})
        last = {s: (n - 1) // weights[s] * total + slots[s][(n - 1) % weights[s]] for s, n in left.items()}
        ends = min(last, key=lambda s: last[s])
        length = last[ends] + 1
        rounds, rest = divmod(length, total)
        taken = {s: rounds * weights[s] + sum(x < rest for x in slots[s]) for s in left}
        out += [
            {"name": s, "phase": phase, "first_block": done[s], "blocks": taken[s], "weight": weights[s], "period": total, "base_slot": base, "lacking": lacking, "slots": slots[s]}
            for s in left
        ]
        base, phase = base + length, phase + 1
        lacking += -rows[ends] % block_rows
        for s in list(left):
            done[s] += taken[s]
            left[s] -= taken[s]
            if not left[s]:
                del left[s]
    return out


PHASE_SCHEMA = "name string, phase int, first_block long, blocks long, weight long, period long, base_slot long, lacking long, slots array<int>"


def _slots(block_rows: int) -> tuple[Column, Column]:
    """(slot, position) of a row n of a source beside its row of the plan."""
    j = F.col("block") - F.col("first_block")
    turn = F.get(F.col("slots"), (j % F.col("weight")).cast("int"))
    slot = F.col("base_slot") + F.floor(j / F.col("weight")).cast("long") * F.col("period") + turn
    return slot, slot * block_rows - F.col("lacking") + F.col("n") % block_rows


def _grouped(placed: DataFrame, level: DataFrame, depth: int, fan: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows and sources one level up: groups of ``fan`` sources as sources, rows numbered in their group's order."""
    parent = F.concat_ws("/", F.lit(depth), "part", F.floor(F.col("nth") / fan))
    level = in_order(level, [F.col("name")], "mix-sources").select("name", "rows", "share", parent.alias("parent"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        shares, rows = (dict(zip(group["name"], group[c].tolist(), strict=True)) for c in ("share", "rows"))
        told = pd.DataFrame(phases(weight_parts(shares), rows, block_rows))
        return told.assign(parent=group["parent"].iloc[0])

    plan = level.groupBy("parent").applyInPandas(work, f"{PHASE_SCHEMA}, parent string")
    # A source is in as many phases as its group has members, at most.
    met = spread_join(placed.withColumn("block", F.floor(F.col("n") / block_rows).cast("long")), plan, ["name"], F.col("n"))
    met = met.where("block >= first_block and block < first_block + blocks")
    _, position = _slots(block_rows)
    above = met.select(F.col("parent").alias("name"), *[c for c in placed.columns if c not in ("name", "n")], position.alias("n"))
    return above, level.groupBy(F.col("parent").alias("name")).agg(F.sum("rows").alias("rows"), F.sum("share").alias("share"))


def _placed(docs: DataFrame, source: str, key: str, weights: Mapping[str, float] | None, block_rows: int, tie: Column | None, most: int = MOST_TOGETHER, fan: int = FAN) -> DataFrame:
    """Columns of ``docs`` as c_0, c_1 and so on, with mix_phase, mix_block, mix_slot and mix_position."""
    spark = docs.sparkSession
    order = [F.md5(F.col(key).cast("string")), F.col(key), *([tie] if tie is not None else [])]
    named = docs.select(
        F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)).alias("name"),
        *[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(docs.columns)],
        *[o.alias(f"o_{i}") for i, o in enumerate(order)],
    )
    rows = in_order(named, [F.col("name"), *[F.col(f"o_{i}") for i in range(len(order))]], "mix")
    pieces = rows.groupBy("name", "part").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    # One row for each part and source that meet: at most parts plus sources, and parts are a setting.
    w = Window.partitionBy("name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)) - F.col("first")).select("name", "part", "before")
    level = rows.groupBy("name").agg(F.count("*").alias("rows"))
    if weights is None:
        level = level.withColumn("share", F.pow("rows", F.lit(TEMPERATURE)))
    else:
        given = spark.createDataFrame([(s, float(x)) for s, x in weights.items()], "name string, share double")
        level = level.join(given, "name", "left").fillna(0.0, ["share"])
    together = level.limit(most + 1).collect()
    placed = rows.join(F.broadcast(pieces) if len(together) <= most else pieces, ["name", "part"])
    placed = placed.select("name", *[f"c_{i}" for i in range(len(docs.columns))], (F.col("nth") + F.col("before")).alias("n"))
    depth = 0
    while len(together) > most:
        placed, level = _grouped(placed, level, depth, fan, block_rows)
        depth += 1
        together = level.limit(most + 1).collect()
    shares, counts = {r["name"]: r["share"] for r in together}, {r["name"]: r["rows"] for r in together}
    plan = spark.createDataFrame(phases(weight_parts(shares), counts, block_rows), PHASE_SCHEMA)
    placed = placed.withColumn("block", F.floor(F.col("n") / block_rows).cast("long"))
    first = F.col("first_block")
    met = placed.join(F.broadcast(plan), (placed["name"] == plan["name"]) & (F.col("block") >= first) & (F.col("block") < first + F.col("blocks")))
    slot, position = _slots(block_rows)
    return met.select(
        *[F.col(f"c_{i}") for i in range(len(docs.columns))],
        F.col("phase").alias("mix_phase"),
        F.col("block").alias("mix_block"),
        slot.alias("mix_slot"),
        position.alias("mix_position"),
    )


MIX_COLUMNS = ("mix_phase", "mix_block", "mix_slot", "mix_position")


def interleaved(docs: DataFrame, source: str = "source", key: str = "doc_id", weights: Mapping[str, float] | None = None, block_rows: int = BLOCK_ROWS, tie: Column | None = None, most: int = MOST_TOGETHER, fan: int = FAN) -> DataFrame:
    """``docs`` with (mix_phase, mix_block, mix_slot, mix_position), which replace columns of these names; position counts from 0 over all rows."""
    placed = _placed(docs, source, key, weights, block_rows, tie, most, fan)
    return placed.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns) if c not in MIX_COLUMNS], *MIX_COLUMNS)


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Phase, block, slot and position of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return interleaved(docs)


def in_mix_order(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with their own columns, sorted by their place in the mix."""
    mixed = _placed(docs, "source", "doc_id", None, BLOCK_ROWS, F.xxhash64("text"))
    mixed = mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return mixed.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])
