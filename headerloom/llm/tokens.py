"""Token counts by batch encoding in Arrow functions (operator 4).

A byte-level BPE encodes a text piece by piece: no token spans a place where a
white-space character follows any other character, nor one where a mark such as
a comma follows an ASCII letter. Texts are cut at those safe boundaries, every distinct piece of a byte-balanced batch is encoded once by
the tokenizers library, and lengths (or ids) are gathered from there. Pieces
seen lately stay in a cache of bounded size in each worker.

Edge cases: a null text counts as empty (0 tokens); a text without any
boundary is encoded whole; repeated rows each keep their row; an empty table
gives an empty result; columns besides the id and the text are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headerloom.llm.common import text_or_empty

BATCH_BYTES = 16 << 20
CACHED_PIECES = 400_000
OVER_LIMIT = 1024

MARKS = ",.;:!?"

_SPACE, _NEWLINE = 32, 10
_IS_MARK = np.isin(np.arange(256), [ord(c) for c in MARKS])
_IS_LETTER = np.array([chr(i).isalpha() and i < 0x80 for i in range(256)])


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes batches of texts through their distinct pieces."""

    def __init__(self, path: str, cached: int = CACHED_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cached = cached
        self.pieces: dict[bytes, bytes] = {}
        # Joined pieces are told apart by tokens that begin with a space or a newline; "Ġ" and "Ċ" are
        # their forms in a byte-level vocabulary.
        size = self.tokenizer.get_vocab_size()
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "x")[0] in "ĠĊ" for i in range(size)])
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)).encode() or rb"(?!)").search
        if any(mark in s for s in special for mark in MARKS):
            raise ValueError("an added token holds a mark that texts are cut at")

    def _encode_each(self, pieces: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _encode_joined(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces that begin with their only space or newline and end otherwise: runs of them are encoded as one text."""
        out: list[bytes] = []
        runs = [pieces[i : i + 2000] for i in range(0, len(pieces), 2000)]
        texts = [b"".join(run).decode("utf-8", "replace") for run in runs]
        for run, found in zip(runs, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(run) or starts[0] != 0:
                out += self._encode_each(run)
                continue
            raw, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), len(ids) * 4]
            out += [raw[a:b] for a, b in zip((starts * 4).tolist(), ends, strict=True)]
        return out

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        known = [self.pieces.get(p) for p in pieces]
        missing = [i for i, k in enumerate(known) if k is None]
        if not missing:
            return known
        joined, single = [], []
        for i in missing:
            p = pieces[i]
            plain = p[0] in b" \n" and p.count(b" ") + p.count(b"\n") == 1 and p[-1:].strip() and p[-1] < 0x80
            (joined if plain and not self.special(p) else single).append(i)
        if len(self.pieces) + len(missing) > self.cached:
            self.pieces.clear()
        for places, encode in ((joined, self._encode_joined), (single, self._encode_each)):
            for i, ids in zip(places, encode([pieces[i] for i in places]) if places else [], strict=True):
                known[i] = ids
                if len(pieces[i]) <= 64:
                    self.pieces[pieces[i]] = ids
        return known

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, list[bytes]]:
        """Texts data[offsets[i]:offsets[i + 1]] as (each piece's place among the distinct ones, each text's first piece, lengths of the distinct ones, their ids)."""
        ends = np.zeros(len(data) + 1, dtype=bool)
        ends[safe_cuts(data)] = True
        ends[offsets] = True
        cuts = np.flatnonzero(ends)
        found = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        ids = self._ids_of(found.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first = np.searchsorted(cuts, offsets)
        return found.indices.to_numpy(zero_copy_only=False), first, lengths, ids

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if offsets[-1] == offsets[0]:
            return np.zeros(len(offsets) - 1, dtype=np.int64)
        places, first, lengths, _ = self.encode(data, offsets)
        total = np.concatenate([[0], np.cumsum(lengths[places])])
        return total[first[1:]] - total[first[:-1]]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text begins and the last ends."""
        if offsets[-1] == offsets[0]:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        places, first, lengths, ids = self.encode(data, offsets)
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        begin = np.concatenate([[0], np.cumsum(lengths)])
        size = lengths[places]
        total = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(begin[places] - total[:-1], size) + np.arange(total[-1])], total[first]


def _unicode_space_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For places of non-ASCII bytes: whether a Unicode white-space character ends there."""
    c, b, a = (data[np.maximum(at - k, 0)] for k in range(3))
    two = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
    e280 = (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | np.isin(c, (0xA8, 0xA9, 0xAF)))
    rest = ((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & (b == 0x81) & (c == 0x9F)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    return two | e280 | rest


def safe_cuts(data: np.ndarray) -> np.ndarray:
    """Places of a space or newline after a character that is no white space, or of a mark after an ASCII letter."""
    at = np.flatnonzero((data[1:] == _SPACE) | (data[1:] == _NEWLINE)) + 1
    before = data[at - 1]
    at = at[(before > _SPACE) | ((before < 9) | ((before > 13) & (before < _SPACE)))]
    far = data[at - 1] >= 0x80
    if far.any():
        keep = np.ones(len(at), dtype=bool)
        keep[far] = ~_unicode_space_ends(data, at[far] - 1)
        at = at[keep]
    marks = np.flatnonzero(_IS_MARK[data[1:]] & _IS_LETTER[data[:-1]]) + 1
    return np.concatenate([at, marks])


def byte_batches(texts: pa.Array, limit: int = BATCH_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(data, offsets, row of each span): runs of texts of up to ``limit`` bytes; a longer text comes in spans cut at safe boundaries."""
    texts = texts.fill_null("").cast(pa.binary())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        lo, hi = offsets[i], offsets[j]
        if hi - lo <= limit:
            yield data[lo:hi], offsets[i : j + 1] - lo, np.arange(i, j)
        else:
            while lo < hi:
                end, step = hi, limit
                while lo + step < hi:
                    cuts = safe_cuts(data[lo : lo + step])
                    if len(cuts):
                        end = lo + cuts.max()
                        break
                    step *= 2
                yield data[lo:end], np.array([0, end - lo]), np.array([i])
                lo = end
        i = j


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a file; tasks that follow in the same worker find its cache warm."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes (UTF-8) and n_tokens of each row's whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1)
            n = np.zeros(len(texts), dtype=np.int64)
            for data, offsets, rows in byte_batches(texts):
                np.add.at(n, rows, enc.lengths(data, offsets))
            size = texts.cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.compute.binary_length(size).cast(pa.int64()), pa.array(n)], names=[id_col, "n_bytes", "n_tokens"])

    narrow = docs.select(F.col(id_col), text_or_empty(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return narrow.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document under byte_bpe_50k.json; over_limit marks more than 1024."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, tokenizer_path()).withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)
