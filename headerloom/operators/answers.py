"""Answers of providers: read from their responses, kept for a time, and asked for again after it.

A lookup is named by (provider, kind, ioc). Only successes are kept; whether one still counts depends on a
time that the caller gives, so the same input has the same answer every day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from headerloom.operators import intel

KEY = ["provider", "kind", "ioc"]
KEPT = "provider string, kind string, ioc string, asked_at timestamp, status string, malicious boolean, reputation string, suspicious boolean"
RESPONSES = "provider string, kind string, ioc string, code int, body string"
SAID = ("status", "malicious", "reputation", "suspicious")
TTL_SECONDS = 3600
#: Answers of every lookup, from a provider and an indicator to an HTTP code and a body.
Call = Callable[[str, str, str], tuple[int | None, str | None]]


def read_responses(responses: DataFrame) -> DataFrame:
    """``responses`` (provider, kind, ioc, code, body and more) with status, malicious, reputation and suspicious in place of code and body.

    A body counts with code 200 only; one that can't be read and an unknown provider are errors. No code is a timeout.
    """
    body, null = F.col("body"), F.lit(None)
    full = lambda a, reputation, suspicious: F.struct(a["status"].alias("status"), a["malicious"].alias("malicious"), reputation.cast("string").alias("reputation"), suspicious.cast("boolean").alias("suspicious"))
    abuse, mail, virus = intel.abuseipdb_answer(body), intel.emailrep_answer(body), intel.virustotal_answer(body)
    told = (
        F.when(F.col("provider") == "abuseipdb", full(abuse, null, null))
        .when(F.col("provider") == "emailrep", full(mail, mail["reputation"], mail["suspicious"]))
        .when(F.col("provider") == "virustotal", full(virus, null, null))
    )
    status = F.when(F.col("code") == 200, F.coalesce(F.col("__told.status"), F.lit("provider_error"))).otherwise(intel.http_status(F.col("code"), F.col("provider")))
    rows = responses.withColumn("__told", told).withColumn("status", status)
    rows = rows.withColumns({n: F.when(F.col("status") == "success", F.col(f"__told.{n}")) for n in SAID[1:]})
    return rows.drop("__told", "code", "body")


def unexpired(kept: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Kept successes that count at this time: not from later, and less old than their time to live."""
    age = F.unix_micros(now) - F.unix_micros("asked_at")
    return kept.where((F.col("status") == "success") & (age >= 0) & (age < ttl_seconds * 1_000_000))


def to_ask(wanted: DataFrame, kept: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The lookups of ``wanted`` that no kept success answers, each once; one with a null names nothing and isn't asked."""
    return wanted.select(*KEY).dropna().distinct().join(unexpired(kept, now, ttl_seconds).select(*KEY), KEY, "left_anti")


def renewed(kept: DataFrame, fresh: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """What to keep after ``fresh`` answers (columns of KEPT) came in: the newest unexpired success of each lookup; of equally old ones the least."""
    names = [f.split()[0] for f in KEPT.split(", ")]
    both = unexpired(kept.select(*names).unionByName(fresh.select(*names)), now, ttl_seconds)
    # The newest, then what sorts first; an aggregate, so a lookup that comes often is reduced before it is shuffled.
    order = F.struct((-F.unix_micros("asked_at")).alias("age"), *SAID, "asked_at")
    return both.groupBy(*KEY).agg(F.min(order).alias("b")).select(*KEY, "b.asked_at", *[f"b.{n}" for n in SAID])


def answered(wanted: DataFrame, kept: DataFrame, fresh: DataFrame, now: Column, ttl_seconds: int = TTL_SECONDS, fixtures: DataFrame | None = None) -> DataFrame:
    """(provider, ioc_type, ioc, status, malicious, reputation, suspicious, cached): one row for each lookup of ``wanted``, a table for ``intel.lookups``.

    A kept success comes first and is marked as cached, then the fresh answer, else the lookup is ``disabled``. With
    ``fixtures`` (provider, kind, ioc, malicious, reputation, suspicious) nothing fresh is used: what has none is
    ``disabled`` and gets no verdict.
    """
    names = [*KEY, *SAID]
    held = renewed(kept, kept.limit(0), now, ttl_seconds).select(*names).withColumn("cached", F.lit(True))
    if fixtures is None:
        order = F.struct((F.col("status") != "success").alias("failed"), *SAID)
        second = fresh.groupBy(*KEY).agg(F.min(order).alias("b")).select(*KEY, *[f"b.{n}" for n in SAID])
    else:
        rows = fixtures.withColumn("status", F.lit("demo_fixture"))
        second = rows.groupBy(*KEY).agg(F.min(F.struct(*SAID)).alias("b")).select(*KEY, *[f"b.{n}" for n in SAID])
    pick = lambda n: F.when(F.col("cached"), F.col(f"k.{n}")).otherwise(F.col(f"f.{n}")).alias(n)
    rows = wanted.select(*KEY).dropna().distinct().join(held.select(*KEY, F.struct(*SAID).alias("k"), "cached"), KEY, "left")
    rows = rows.join(second.select(*KEY, F.struct(*SAID).alias("f")), KEY, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    return rows.select("provider", F.col("kind").alias("ioc_type"), "ioc", F.coalesce(pick("status"), F.lit("disabled")).alias("status"), *[pick(n) for n in SAID[1:]], "cached")


def asked(wanted: DataFrame, call: Call) -> DataFrame:
    """The responses (RESPONSES) to each lookup of ``wanted``, asked for in the tasks; a call that can't connect or takes too long has no code."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = []
            for key in zip(frame["provider"], frame["kind"], frame["ioc"], strict=True):
                try:
                    got.append((*key, *call(*key)))
                except OSError:
                    got.append((*key, None, None))
            told = pd.DataFrame(got, columns=[*KEY, "code", "body"])
            yield told.astype({"code": "Int32"})

    return wanted.select(*KEY).mapInPandas(batches, RESPONSES)


def stream_answers(lookups: DataFrame, call: Call, kept: str, checkpoint: str, clock: Callable[[], datetime], ttl_seconds: int = TTL_SECONDS) -> StreamingQuery:
    """Keeps answers for a stream of lookups: each micro-batch asks only for what is new, failed or has expired.

    What is kept after batch n is the folder ``kept``/batch=n. It is made of the folder before it, so a batch that is
    repeated after a failure asks again and replaces its own folder; folders before the last two aren't needed any more.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, now = batch.sparkSession, F.lit(clock())
        before = spark.read.schema(KEPT).parquet(f"{kept}/batch={number - 1}") if number else spark.createDataFrame([], KEPT)
        fresh = read_responses(asked(to_ask(batch, before, now, ttl_seconds), call)).withColumn("asked_at", now)
        renewed(before, fresh, now, ttl_seconds).write.mode("overwrite").parquet(f"{kept}/batch={number}")

    return lookups.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
