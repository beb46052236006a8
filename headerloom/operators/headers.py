"""Header blocks to fields.

A header is split where a line begins that doesn't continue the one before, so
a message stays in its row until its fields are exploded: no shuffle.
"""

from __future__ import annotations

import re
from email.errors import HeaderParseError
from email.header import decode_header

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from headerloom.functions.text import one_line
from headerloom.sources.messages import with_newlines

#: Fields that a message has once at most.
SINGLETONS = ("date", "from", "sender", "reply-to", "to", "cc", "bcc", "message-id", "subject", "in-reply-to", "references")
UNPARSABLE = "(unparsable)"
_FIELD = r"^[\x21-\x39\x3b-\x7e]+[ \t]*:"


def _decoded(value: str | None) -> tuple[str | None, str | None]:
    """A value with its encoded words decoded, and what went wrong."""
    if value is None:
        return None, None
    try:
        parts = decode_header(value)
    except (HeaderParseError, ValueError):
        return value, "an encoded word is malformed"
    out, warning = [], None
    for raw, charset in parts:
        if isinstance(raw, str):
            out.append(raw)
            continue
        try:
            out.append(raw.decode(charset or "ascii"))
        except (LookupError, UnicodeDecodeError):
            out.append(raw.decode("utf-8", "replace"))
            warning = f"charset {charset} could not be used"
    text = re.sub(r"\s+", " ", "".join(out)).strip()
    return text, warning or ("some characters could not be decoded" if "�" in text else None)


WORDS = pa.struct([("text", pa.string()), ("warning", pa.string())])


def words_of(values: pa.Array) -> pa.Array:
    """Each value decoded; null for null."""
    if values.null_count == len(values):
        return pa.nulls(len(values), WORDS)
    return pa.array([None if v is None else dict(zip(("text", "warning"), _decoded(v), strict=True)) for v in values.to_pylist()], WORDS)


decode_words = F.arrow_udf(words_of, from_arrow_type(WORDS))


def _blocks(raw_header: Column) -> Column:
    """A header cut where a line begins that doesn't continue the one before."""
    return F.split(with_newlines(F.coalesce(raw_header, F.lit(""))), r"\n(?![ \t])")


def _is_field(block: Column) -> Column:
    return block.rlike(_FIELD) & ~F.startswith(block, F.lit("From "))


def field_blocks(raw_header: Column) -> Column:
    """The fields of a header as they stand there, folded lines included."""
    return F.filter(_blocks(raw_header), _is_field)


def parse_fields(messages: DataFrame) -> DataFrame:
    """(msg_id, ord, name, name_lc, raw_value, normalized_value, kind) of every field in order; kind is field, no_colon or orphan.

    Lines without a colon and continuations of nothing become fields named
    UNPARSABLE; mbox separators and blank lines become none.
    """
    # A block that isn't a field falls apart into its lines: what follows it continues nothing.
    lines = lambda blocks: F.flatten(F.transform(blocks, lambda b: F.when(_is_field(b), F.array(b)).otherwise(F.split(b, "\n"))))
    kept = lambda blocks: F.filter(lines(blocks), lambda b: b.rlike(r"[^ \t]") & ~F.startswith(b, F.lit("From ")))
    blocks = messages.select("msg_id", _blocks(F.col("raw_header")).alias("blocks"))
    # Most headers hold fields only.
    lines = blocks.select("msg_id", F.posexplode(F.when(F.forall("blocks", _is_field), F.col("blocks")).otherwise(kept(F.col("blocks")))).alias("ord", "block"))
    lines = lines.withColumn("colon", F.when(_is_field(F.col("block")), F.instr("block", ":")))
    # A name holds no colon: the first one ends it.
    raw = F.when(F.col("colon").isNotNull(), F.substr("block", F.col("colon") + 1)).otherwise(F.col("block"))
    name = F.when(F.col("colon").isNotNull(), F.rtrim(F.substring_index("block", ":", 1), F.lit(" \t"))).otherwise(F.lit(UNPARSABLE))
    kind = F.when(F.col("colon").isNotNull(), "field").when(F.col("block").rlike(r"^[ \t]"), "orphan").otherwise("no_colon")
    rows = lines.select("msg_id", "ord", name.alias("name"), raw.alias("raw_value"), kind.alias("kind"))
    return rows.select("msg_id", "ord", "name", F.lower("name").alias("name_lc"), "raw_value", one_line(F.col("raw_value")).alias("normalized_value"), "kind")


def coded(value: Column) -> Column:
    """The value if it may hold encoded words."""
    return F.when(F.contains(value, F.lit("=?")), value)


def with_decoded(fields: DataFrame) -> DataFrame:
    """decoded_value and decode_warning; only values with encoded words go to Python, the rest passes as nulls, so that fields are read once."""
    rows = fields.withColumn("d", decode_words(coded(F.col("normalized_value"))))
    return rows.withColumns({"decoded_value": F.col("d.text"), "decode_warning": F.col("d.warning")}).drop("d")


def duplicate_singletons(fields: DataFrame) -> DataFrame:
    """(msg_id, name_lc, n) of fields that a message has too often."""
    return fields.where(F.col("name_lc").isin(*SINGLETONS)).groupBy("msg_id", "name_lc").agg(F.count("*").alias("n")).where("n > 1")


def first_value(name: str, column: str = "normalized_value") -> Column:
    """Aggregate: the first value of a field in a message."""
    return F.min_by(F.when(F.col("name_lc") == name, F.col(column)), F.when(F.col("name_lc") == name, F.col("ord")))
