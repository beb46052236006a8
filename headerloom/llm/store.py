"""Content-addressed store of token ids (operator 10).

A document's ids, closed by ``END_ID``, are cut where a rolling hash of the
last ``LOOK_BACK`` ids falls under a mask, so equal passages give equal chunks
wherever they stand. A chunk is addressed by the BLAKE2b digest of its bytes
and stored once; a document is a recipe of addresses. The store is three
tables under one folder:

* ``objects/kind=chunk``: key, ids (little-endian, 2 bytes each where the
  vocabulary has at most 65,536 ids, else 4);
* ``recipes``: documents in order as (part, nth, local_start, n_tokens, root,
  chunks), one file for each part; root is the Merkle root of the addresses;
* ``manifest``: for each part its first position, counts and the Merkle root
  of its documents' roots, ``FAN_OUT`` at a level.

Reading verifies every level: each object's bytes against its address, each
recipe against its root, each part against the manifest. A document's CRC32 is
put together from those of its stored chunks: a chunk's share is its CRC
shifted by the bytes that follow, and shares are XORed, so a passage that many
documents hold is read and summed once.

Tasks drop repeats of a chunk that they have met, so a chunk of a third of all
documents arrives at most once from each task.

Edge cases: a null text counts as empty (the end id alone); null ids come
first; rows that repeat an id or a whole row keep a recipe each; an empty table
gives an empty store; columns besides the id, the text and the order are
ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headerloom.llm.common import new_path, text_or_empty
from headerloom.llm.tokens import byte_batches, encoder, tokenizer_path

END_ID = 2
LOOK_BACK = 32
LEAST, MEAN, MOST = 64, 512, 4096
FAN_OUT = 1024
DIGEST = 16
CRC_POLYNOMIAL = 0xEDB88320


def id_bytes(path: str) -> int:
    return 2 if encoder(path).tokenizer.get_vocab_size() <= 65_536 else 4


def rolling(ids: np.ndarray) -> np.ndarray:
    """For each place, a hash of the LOOK_BACK ids that end there (of fewer at the beginning): mixed ids, rotated by their age, XORed."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h = h.astype(np.uint32)
    width = 1
    while width < LOOK_BACK:
        h[width:] ^= _rotated(h[:-width], width)
        width *= 2
    return h


def _rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint32(by)) | (h >> np.uint32(32 - by))


def cut_places(start: int, end: int, candidates: np.ndarray, closed: bool) -> list[int]:
    """Ends of the chunks of ids[start:end]; the last piece is cut only if the document is closed."""
    cuts, at = [], start
    for c in candidates[np.searchsorted(candidates, start) : np.searchsorted(candidates, end)].tolist():
        while c + 1 - at > MOST:
            at += MOST
            cuts.append(at)
        if c + 1 - at >= LEAST:
            at = c + 1
            cuts.append(at)
    while end - at > MOST:
        at += MOST
        cuts.append(at)
    if closed and at < end:
        cuts.append(end)
    return cuts


class Cutter:
    """Chunks of a run of documents; a document may come in several spans."""

    def __init__(self, path: str, width: int):
        self.encoder, self.width = encoder(path), width
        self.lead = self.rest = np.zeros(0, dtype=np.uint32)

    def spans(self, data: np.ndarray, offsets: np.ndarray, closed: bool) -> Iterator[list[np.ndarray]]:
        """Chunks of each document of a batch; closed tells if the last one ends here."""
        flat, begins = self.encoder.ids(data, offsets)
        ends = begins[1:]
        if not closed:
            ends = ends[:-1]
        flat = np.insert(flat, ends, END_ID)
        begins = begins + np.minimum(np.arange(len(begins)), len(ends))
        before = len(self.lead)
        whole = np.concatenate([self.lead, self.rest, flat])
        hashes = rolling(whole)
        candidates = np.flatnonzero(hashes % np.uint32(MEAN) == 0)
        starts = begins[:-1] + before + len(self.rest)
        starts[0] = before
        stops = begins[1:] + before + len(self.rest)
        for k, (a, b) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            ended = closed or k + 1 < len(starts)
            cuts = cut_places(a, b, candidates, ended)
            yield [whole[x:y] for x, y in zip([a, *cuts[:-1]], cuts, strict=False)]
            if not ended:
                at = cuts[-1] if cuts else a
                self.lead, self.rest = whole[max(0, at - LOOK_BACK + 1) : at], whole[at:b]
        if closed:
            self.lead = self.rest = whole[:0]


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last one goes up as it is."""
    level = leaves or [b""]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\x01" + level[i] + level[i + 1], digest_size=DIGEST).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) & ~1 :]
    return level[0]


def address(ids: bytes) -> bytes:
    return hashlib.blake2b(b"\x00" + ids, digest_size=DIGEST).digest()


def cut_documents(docs: DataFrame, path: str, id_col: str, order: dict[str, Column]) -> DataFrame:
    """Rows of two kinds: chunk (key, ids) and doc (key, id, order, n_tokens, root, chunks)."""
    width = id_bytes(path)
    names = list(order)
    narrow = docs.select(text_or_empty("text").alias("text"), F.col(id_col).alias("id"), *[c.alias(n) for n, c in order.items()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, met, task, serial = Cutter(path, width), set(), TaskContext.get().partitionId(), 0
        leaf = pa.struct([("chunk", pa.binary()), ("n", pa.int32()), ("after", pa.int64())])
        for batch in batches:
            objects: list[tuple[bytes, bytes]] = []
            recipes: list[list[tuple[bytes, int]]] = []
            spans = byte_batches(batch.column(0))
            ahead = next(spans, None)
            while ahead is not None:
                (data, offsets, rows), ahead = ahead, next(spans, None)
                closed = ahead is None or ahead[2][0] != rows[-1]
                for row, chunks in zip(rows.tolist(), cutter.spans(data, offsets, closed), strict=True):
                    if row == len(recipes):
                        recipes.append([])
                    for ids in chunks:
                        raw = ids.astype(f"<u{width}").tobytes()
                        key = address(raw)
                        recipes[row].append((key, len(ids)))
                        if key not in met:
                            met.add(key)
                            objects.append((key, raw))
            n = len(objects)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["chunk"] * n), pa.array([k for k, _ in objects], pa.binary()), pa.array([r for _, r in objects], pa.binary()), *[pa.nulls(n, f.type) for f in list(batch.schema)[1:]], pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(leaf))],
                names=["kind", "key", "ids", "id", *names, "n_tokens", "root", "chunks"],
            )
            m = len(recipes)
            totals = [sum(k for _, k in r) for r in recipes]
            chunks = []
            for r, left in zip(recipes, totals, strict=True):
                listed = []
                for key, k in r:
                    left -= k
                    listed.append({"chunk": key, "n": k, "after": 4 * left})
                chunks.append(listed)
            keys = [task.to_bytes(8, "big") + i.to_bytes(8, "big") + b"d" for i in range(serial, serial + m)]
            serial += m
            yield pa.RecordBatch.from_arrays(
                [pa.array(["doc"] * m), pa.array(keys, pa.binary()), pa.nulls(m, pa.binary()), *batch.columns[1:], pa.array(totals, pa.int64()), pa.array([merkle_root([k for k, _ in r]) for r in recipes], pa.binary()), pa.array(chunks, pa.list_(leaf))],
                names=["kind", "key", "ids", "id", *names, "n_tokens", "root", "chunks"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    own = ", ".join(f"`{n}` {kinds[n]}" for n in ["id", *names])
    return narrow.mapInArrow(work, f"kind string, key binary, ids binary, {own}, n_tokens long, root binary, chunks array<struct<chunk binary, n int, after long>>")


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", order: dict[str, Column] | None = None) -> str:
    """Write the documents' ids, in ``order`` (the id by default), and return the store's folder."""
    spark = docs.sparkSession
    where = new_path(spark, "store")
    order = order if order is not None else {"by_id": F.col(id_col)}
    rows = cut_documents(docs, path, id_col, order)
    rest = [c for c in rows.columns if c not in ("kind", "key")]
    once = rows.groupBy("kind", "key").agg(*[F.first(c).alias(c) for c in rest])
    once.write.partitionBy("kind").option("compression", "zstd").parquet(f"{where}/objects")
    recipes = spark.read.schema(once.schema).parquet(f"{where}/objects").where("kind = 'doc'").drop("kind", "key", "ids")
    by = [F.col(n).asc_nulls_first() for n in order] + [F.col("root")]
    ordered = recipes.repartitionByRange(*by).sortWithinPartitions(*by)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, start = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
            ends = start + np.cumsum(n)
            added = [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(np.arange(nth, nth + len(n))), pa.array(ends - n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "part", "nth", "local_start"])
            nth, start = nth + len(n), int(ends[-1]) if len(n) else start

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in recipes.schema)
    ordered.mapInArrow(place, f"{kinds}, part int, nth long, local_start long").write.option("compression", "zstd").parquet(f"{where}/recipes")
    _manifest(spark.read.parquet(f"{where}/recipes")).coalesce(1).write.parquet(f"{where}/manifest")
    return where


def _manifest(recipes: DataFrame) -> DataFrame:
    """(part, start, n_docs, n_tokens, root) of each part; a level takes FAN_OUT digests at most at once, the last one a part's groups."""
    joined = F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "leaf"))), lambda x: x["leaf"])), 256)
    groups = recipes.groupBy("part", F.floor(F.col("nth") / FAN_OUT).alias("group"))
    level = recipes.select("part", F.floor(F.col("nth") / FAN_OUT).alias("group"), F.col("nth").alias("at"), F.hex("root").alias("leaf")).groupBy("part", "group").agg(joined.alias("leaf"))
    roots = level.select("part", F.col("group").alias("at"), "leaf").groupBy("part").agg(joined.alias("root"))
    sizes = groups.agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # One row for each part: a setting bounds their number.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(roots, "part").select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_docs", "n_tokens", "root")


def _times(a: np.ndarray | int, b: np.ndarray) -> np.ndarray:
    """Products of reflected polynomials modulo the CRC's."""
    a = np.asarray(a, dtype=np.uint32)
    out, b = np.zeros(np.broadcast(a, b).shape, dtype=np.uint32), b.astype(np.uint32)
    for bit in range(31, -1, -1):
        out ^= b * ((a >> np.uint32(bit)) & np.uint32(1))
        b = (b >> np.uint32(1)) ^ (np.uint32(CRC_POLYNOMIAL) * (b & np.uint32(1)))
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each CRC32 adds to that of a stream in which ``after`` bytes follow."""
    out, power, left = crc.astype(np.uint32), np.array([1 << 23], dtype=np.uint32), after.astype(np.int64)
    while left.any():
        odd = (left & 1).astype(bool)
        out[odd] = _times(power[0], out[odd])
        power, left = _times(power[0], power), left >> 1
    return out


def _objects(spark: SparkSession, where: str, width: int) -> DataFrame:
    """(key, crc, n) of each stored chunk whose bytes have the digest that addresses it; another one is an error."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if address(ids) != key:
                    raise ValueError(f"stored chunk {key.hex()} is damaged")
                wide = ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()
                crcs.append(zlib.crc32(wide))
                sizes.append(len(wide) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())], names=["key", "crc", "stored"])

    found = spark.read.schema("kind string, key binary, ids binary").parquet(f"{where}/objects").where("kind = 'chunk'").select("key", "ids")
    return found.mapInArrow(work, "key binary, crc long, stored int")


def read_store(spark: SparkSession, where: str, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, start, n_tokens and ids_crc32 of each document, all from the files, each level verified."""

    @F.pandas_udf("long")
    def share(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(shifted_crc(crc.to_numpy(), after.to_numpy()).astype(np.int64))

    @F.pandas_udf("binary")
    def root_of(recipes: pd.Series) -> pd.Series:
        return pd.Series([merkle_root([bytes(k) for k in keys]) for keys in recipes])

    recipes = spark.read.parquet(f"{where}/recipes")
    manifest = spark.read.parquet(f"{where}/manifest")
    now = _manifest(recipes).select("part", F.col("root").alias("found"), F.col("n_tokens").alias("found_tokens"))
    sound = (F.col("root") == F.col("found")) & (F.col("n_tokens") == F.col("found_tokens"))
    parts = manifest.join(now, "part", "left").select("part", F.when(sound, F.col("start")).otherwise(F.raise_error(F.lit("a part differs from the manifest")).cast("long")).alias("part_start"))
    kept = F.when(root_of(F.transform("chunks", lambda c: c["chunk"])) == F.col("root"), F.col("chunks")).otherwise(F.raise_error(F.lit("a recipe differs from its root")).cast(recipes.schema["chunks"].dataType))
    # Parts are as many as the setting for shuffles allows.
    placed = recipes.join(F.broadcast(parts), "part").select("id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", F.explode(kept).alias("c"))
    refs = placed.select("id", "start", "n_tokens", F.col("c.chunk").alias("key"), F.col("c.n").alias("n"), F.col("c.after").alias("after"))
    met = refs.join(_objects(spark, where, id_bytes(path)), "key").select("id", "start", "n_tokens", "stored", share("crc", "after").alias("share"))
    docs = met.groupBy("start", "id", "n_tokens").agg(F.sum("stored").alias("got"), F.bit_xor("share").alias("crc"))
    crc = F.when(F.col("got") == F.col("n_tokens"), F.col("crc")).otherwise(F.raise_error(F.lit("a document lacks chunks")).cast("long"))
    return docs.select(F.col("id").alias(id_col), "start", "n_tokens", crc.alias("ids_crc32"))


def read_ids(spark: SparkSession, where: str, path: str) -> DataFrame:
    """(start, id, ids) of each document, rebuilt from the store: ids as little-endian integers of the store's width."""
    recipes = spark.read.parquet(f"{where}/recipes").join(F.broadcast(spark.read.parquet(f"{where}/manifest").select("part", F.col("start").alias("first"))), "part")
    refs = recipes.select((F.col("first") + F.col("local_start")).alias("start"), "id", F.posexplode("chunks").alias("at", "c")).select("start", "id", "at", F.col("c.chunk").alias("key"))
    objects = spark.read.schema("kind string, key binary, ids binary").parquet(f"{where}/objects").where("kind = 'chunk'").select("key", "ids")
    pieces = refs.join(objects, "key").groupBy("start", "id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("p"))
    return pieces.select("start", "id", F.aggregate("p", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"])).alias("ids"))


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    """Start, length and CRC32 of every document's ids, read back from the store."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = tokenizer_path()
    return read_store(spark, write_store(docs, path), path)


def store_in_file_order(docs: DataFrame) -> DataFrame:
    """The ids of ``docs`` in the order of its files, by their numbers, and rows, written and read back; rows that don't come straight from files are taken in the order that they have."""
    path = tokenizer_path()
    try:
        docs.select("_metadata.file_name")
        name = F.col("_metadata.file_name")
        number = F.expr("try_cast(regexp_extract(_metadata.file_name, 'part-([0-9]+)', 1) as bigint)")
        order = {"by_number": number, "by_file": name, "by_row": F.col("_metadata.row_index")}
    except AnalysisException:
        order = {"by_row": F.monotonically_increasing_id()}
    return read_store(docs.sparkSession, write_store(docs, path, order=order), path)
