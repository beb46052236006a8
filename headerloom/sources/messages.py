"""Messages as rows of (msg_id, raw_header, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headerloom.config import EngineConfig

DNS_SCHEMAS = {
    "dns_txt": "name string, seq int, value string, unavailable boolean",
    #: Addresses of both families.
    "dns_a": "name string, value string, unavailable boolean",
    "dns_mx": "name string, preference int, value string, unavailable boolean",
    "dns_ptr": "ip string, value string, unavailable boolean",
    "dns_listed": "name string",
    "intel": "provider string, ioc_type string, ioc string, status string, malicious boolean, reputation string, suspicious boolean",
}


def with_newlines(text: Column) -> Column:
    # A pattern looks at every character; most texts hold no such sign.
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def split_header_body(messages: DataFrame, text: str = "text") -> DataFrame:
    """msg_id, raw_header and body: the body begins after the first blank line; null without one."""
    plain = messages.select("msg_id", with_newlines(F.col(text)).alias("t"))
    at = F.regexp_instr("t", F.lit(r"\n[ \t]*\n"))
    body = F.regexp_replace(F.expr("substring(t, regexp_instr(t, '\\\\n[ \\\\t]*\\\\n'))"), r"^\n[ \t]*\n", "")
    return plain.select("msg_id", F.when(at > 0, F.expr("substring(t, 1, regexp_instr(t, '\\\\n[ \\\\t]*\\\\n') - 1)")).otherwise(F.col("t")).alias("raw_header"), F.when(at > 0, body).alias("body"))


def read_files(spark: SparkSession, path: str, config: EngineConfig | None = None) -> DataFrame:
    """Messages in .eml and .txt files; invalid UTF-8 is replaced, larger files than allowed are left out before they are read: ``rejected_files`` names them."""
    config = config or EngineConfig()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.col("path").rlike(r"(?i)\.(eml|txt)$") & (F.col("length") <= config.max_header_bytes))
    return split_header_body(files.select(F.col("path").alias("msg_id"), F.expr("make_valid_utf8(cast(content as string))").alias("text")))


def rejected_files(spark: SparkSession, path: str, config: EngineConfig | None = None) -> DataFrame:
    """(msg_id, n_bytes, reason) of the files that ``read_files`` leaves out for their size; they aren't read."""
    config = config or EngineConfig()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    large = files.where(F.col("path").rlike(r"(?i)\.(eml|txt)$") & (F.col("length") > config.max_header_bytes))
    return large.select(F.col("path").alias("msg_id"), F.col("length").alias("n_bytes"), F.lit(f"larger than {config.max_header_bytes} bytes").alias("reason"))


def within_size(messages: DataFrame, config: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the bytes of the header."""
    small = F.coalesce(F.octet_length("raw_header"), F.lit(0)) <= config.max_header_bytes
    return messages.where(small), messages.where(~small)


def empty_lookups(spark: SparkSession) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], schema) for name, schema in DNS_SCHEMAS.items()}
