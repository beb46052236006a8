"""Whitening of embeddings by the singular values of centred rows (operator 13).

Entries become integers, so that sums over any number of rows are exact and in
any order the same. Each distinct vector is taken once; MLlib's distributed
``computeSVD`` runs over these rows, centred. Its singular values, squared and divided by the number of
rows n, are the variances of the components. The total variance comes from exact integer deviations,
not from the singular values. All rows, repeated ones too, are then projected.

What comes to the driver is of the size of one covariance: the sums of the
dimensions, the singular vectors and the covariance of the whitened rows.

Edge cases: a null vector, and one with null or non-finite entries, is left
out; so are empty vectors and, where lengths differ, those that don't have the most frequent length (of
equally frequent ones the largest); ids may be null or repeat; repeated vectors weigh once but each row is projected;
components whose variance is below ``LEAST_SHARE`` of the first one's don't exist, so vectors that are all alike give no
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerloom.llm.common import staged

SCALE = 256
COMPONENTS = 4
#: Smaller variances are rounding: whole numbers this unlike can't be told from 0 in doubles.
LEAST_SHARE = 1e-11
#: Rows turned into matrices at once.
ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Fit:
    """What whitening needs: n vectors, exact sums by dimension, components (dimensions x components), their variances and the total variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    total: float


def usable(vector: Column) -> Column:
    big = F.lit(float("inf"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x): the usable rows with entries as whole numbers, rounded down."""
    entries = F.col(vector_col).cast("array<double>")
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), F.transform(entries, lambda c: F.floor(c * scale).cast("long")).alias("x"))
    rows = staged(rows, "vectors")
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(2).collect()
    return rows.where(F.size("x") == lengths[0].size) if len(lengths) > 1 else rows


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of rows and sum of each dimension: each task sums up its rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in _pieces(batches):
            x = _matrix(batch.column(0))
            # Whole numbers beyond 64 bits stay Python's.
            part = x.sum(axis=0) if np.abs(x.astype(float)).max() * len(x) < 2**62 else x.astype(object).sum(axis=0)
            n, total = n + len(x), part.astype(object) if total is None else total + part
        if n:
            at = range(len(total))
            yield pa.record_batch([pa.array([n] * len(total)), pa.array(at, pa.int32()), pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["n", "at", "s"])

    sums = rows.select("x").mapInArrow(partial, "n long, at int, s decimal(38,0)").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).orderBy("at").collect()
    return (sums[0].n, [int(r.s) for r in sums]) if sums else (0, [])


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exact: of 64 bits where that is enough, else of Python's whole numbers."""
    most = n * int(np.abs(x.astype(float)).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _deviations(centred: np.ndarray) -> list[int]:
    """Exact sums of squares of each row."""
    if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * centred.shape[1] < 2**62:
        return (centred * centred).sum(axis=1).tolist()
    wide = centred.astype(object)
    return (wide * wide).sum(axis=1).tolist()


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit:
    """The components of ``rows`` (x), each distinct vector once."""
    distinct = staged(rows.select("x").distinct(), "fit-list")
    n, sums = exact_sums(distinct)
    if not n:
        return Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            c = _centred(_matrix(batch.column(0)), n, sums)
            y = (c / n).astype(float)
            deviations = pa.array([Decimal(d) for d in _deviations(c)], pa.decimal128(38, 0))
            yield pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), y.shape[1]).cast(pa.list_(pa.float64())), deviations], names=["y", "deviation"])

    rows_ = staged(distinct.mapInArrow(centred, "y array<double>, deviation decimal(38,0)"), "centred")
    total = rows_.agg(F.sum("deviation")).first()[0]
    if not total:
        return Fit(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows_.select(array_to_vector("y").alias("y")), "y"))
    # All singular values are asked for: MLlib then decomposes the Gramian with LAPACK, to double precision.
    found = matrix.computeSVD(len(sums), rCond=LEAST_SHARE**0.5)
    variances = np.array(found.s.toArray()) ** 2 / n
    return Fit(n, sums, found.V.toArray()[:, :components], variances[:components], float(Decimal(int(total)) / Decimal(n) ** 3))


def projected(rows: DataFrame, model: Fit) -> DataFrame:
    """(id, deviation, whitened) of each of ``rows`` (id, x); whitened has one entry for each component."""
    n, sums, to = model.n, model.sums, model.vectors / np.sqrt(model.variances)

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            c = _centred(_matrix(batch.column(1)), n, sums)
            z = (c / n).astype(float) @ to
            whitened = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), pa.array([Decimal(d) for d in _deviations(c)], pa.decimal128(38, 0)), whitened], names=["id", "deviation", "whitened"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "x").mapInArrow(whiten, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over each distinct vector of ``rows`` once."""
    distinct = projected(rows.select("x").distinct().withColumn("id", F.lit(0)), model).select("whitened")
    distinct = staged(distinct, "whitened")
    k = len(model.variances)
    means = [distinct.agg(F.avg(F.get("whitened", F.lit(i)))).first()[0] for i in range(k)]
    product = lambda i, j: F.avg((F.get("whitened", F.lit(i)) - means[i]) * (F.get("whitened", F.lit(j)) - means[j]))
    covariance = distinct.agg(*[product(i, j).alias(f"{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    return max(abs(covariance[f"{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of each usable row and component."""
    rows = integers(vectors, id_col, vector_col)
    model = fit(rows, components)
    kinds = f"{id_col} {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not len(model.variances):
        return vectors.sparkSession.createDataFrame([], kinds)
    error = identity_error(rows, model)
    shares = F.array(*[F.lit(float(v / model.total)) for v in model.variances])
    out = projected(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """The first components of every embedding; a deviation beyond 64 bits is an error, never another number."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).withColumn("deviation", F.col("deviation").cast("long"))
