"""Received fields to hops, delays, trust boundary and routes."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headerloom.config import EngineConfig
from headerloom.functions.net import classify_ip, ips
from headerloom.functions.scan import received, with_usual
from headerloom.functions.text import found

LATE_SECONDS = 3600


#: Fixed value: what is shown as the offset of a date.
OFFSET = r"([+-]\d{4}|\b(?:UT|GMT|[ECMP][SD]T|Z)\b)"
#: Fixed value: what a host's name looks like.
HOST = r"[A-Za-z0-9_](?:[A-Za-z0-9_.-]*[A-Za-z0-9_])?"


def _host(text: str) -> Column:
    """The first word of a column that looks like a host and isn't a number; only a text that begins with a number is searched for all of them."""
    first, words = F.regexp_extract(text, HOST, 0), F.regexp_extract_all(text, F.lit(HOST), F.lit(0))
    return F.when(~first.rlike(r"^\d"), F.nullif(first, F.lit(""))).otherwise(F.get(F.filter(words, lambda x: ~x.rlike(r"^\d+$")), F.lit(0)))


def received_value() -> Column:
    """The value of a Received field, null for others."""
    return F.when(F.col("name_lc") == "received", F.col("normalized_value"))


def with_clauses(fields: DataFrame) -> DataFrame:
    """The fields with ``hop``: clauses and date of a Received field, read once; only values of unusual form go to Python."""
    value = received_value()
    rows = with_usual(fields, value)
    return rows.withColumn("hop", F.coalesce("usual", received(F.when(F.col("usual").isNull(), value)))).drop("usual")


def parse_received(fields: DataFrame) -> DataFrame:
    """One row for each Received field: (msg_id, hop_idx from the newest, from_host, from_rdns, by_host, protocol, via, tls_info, queue_id, for_recipient, ip_addresses, primary_ip, timestamp_utc, original_offset, has_zone, date_text, has_from, has_by, used_tls)."""
    # Texts are taken apart where the fields are read; the window that numbers hops comes last and moves only what was found.
    fields = fields if "hop" in fields.columns else with_clauses(fields)
    rows = fields.where(F.col("name_lc") == "received").select("msg_id", "ord", F.col("normalized_value").alias("raw"), "hop")
    # Through a generator, filters on what follows can't repeat the work above.
    rows = rows.select("msg_id", "ord", "raw", F.inline(F.array("hop")))
    word = lambda c: F.nullif(F.regexp_extract(c, r"^\s*+(\S++)", 1), F.lit(""))
    before = lambda c: F.split_part(c, F.lit("("), F.lit(1))
    # The first parenthesis, up to the first that closes.
    inside = lambda c: found(c, r"\(([^)]*+)\)")
    # What several columns need is a column of its own, so that it isn't worked out for each use.
    at_end = F.when(F.col("date").isNotNull(), F.regexp_replace("raw", r";[^;]*+$", "")).otherwise(F.col("raw"))
    rows = rows.withColumns({"in_from": inside(F.col("from")), "in_with": inside(F.col("with")), "from_name": before(F.col("from")), "at_end": at_end})
    rows = rows.withColumn("observed", F.regexp_replace(F.regexp_replace("in_from", r"\[[^\]]*+\]", " "), r"(?i)\bhelo\s*+=?\s*+", " "))
    tls = F.when(F.col("in_with").rlike(r"(?i)tls|cipher|version="), F.trim("in_with")).when(F.col("with").rlike(r"(?i)tls|cipher"), F.col("with"))
    rows = rows.select(
        "msg_id",
        "ord",
        "raw",
        _host("from_name").alias("from_host"),
        _host("observed").alias("from_rdns"),
        _host("by").alias("by_host"),
        word(before(F.col("with"))).alias("protocol"),
        F.nullif(F.col("via"), F.lit("")).alias("via"),
        tls.alias("tls_info"),
        word(F.col("id")).alias("queue_id"),
        word(F.col("for")).alias("for_recipient"),
        ips(F.col("at_end")).alias("ip_addresses"),
        ips(F.col("from")).alias("from_ips"),
        F.col("at").alias("timestamp_utc"),
        found(F.col("date"), OFFSET).alias("original_offset"),
        F.col("zone").alias("has_zone"),
        F.col("date").alias("date_text"),
        F.col("from").isNotNull().alias("has_from"),
        F.col("by").isNotNull().alias("has_by"),
    )
    rows = rows.withColumn("primary_ip", F.coalesce(F.get("from_ips", F.lit(0)), F.get("ip_addresses", F.lit(0)))).drop("from_ips")
    protocol = F.upper("protocol")
    tls = F.when(protocol.isin("ESMTPS", "ESMTPSA", "UTF8SMTPS", "UTF8SMTPSA") | F.col("tls_info").isNotNull(), True).when(protocol.isin("SMTP", "ESMTP", "ESMTPA"), False)
    rows = rows.withColumns({"used_tls": tls, "primary_ip_class": F.when(F.col("primary_ip").isNotNull(), classify_ip(F.col("primary_ip")))})
    return rows.withColumn("hop_idx", F.row_number().over(Window.partitionBy("msg_id").orderBy("ord")) - 1).drop("ord")


def hop_delays(hops: DataFrame) -> DataFrame:
    """(msg_id, from_hop, to_hop, seconds, is_clock_skew, is_late) between neighbours in time order; pairs with an unknown time are left out."""
    w = Window.partitionBy("msg_id").orderBy(F.desc("hop_idx"))
    before = F.lag(F.struct("hop_idx", "timestamp_utc")).over(w)
    pairs = hops.select("msg_id", "hop_idx", "timestamp_utc", before.alias("b"))
    seconds = (F.unix_micros("timestamp_utc") - F.unix_micros("b.timestamp_utc")) / 1e6
    return pairs.select("msg_id", F.col("b.hop_idx").alias("from_hop"), F.col("hop_idx").alias("to_hop"), seconds.alias("seconds")).where("seconds is not null").withColumns({"is_clock_skew": F.col("seconds") < 0, "is_late": F.col("seconds") > LATE_SECONDS})


def is_trusted(host: Column, config: EngineConfig) -> Column:
    """Equal to a trusted host, or a trusted domain or a name under it."""
    h = F.lower(host)
    tests = [h == x.lower() for x in config.trusted_hosts] + [(h == d.lower()) | F.endswith(h, F.lit(f".{d.lower()}")) for d in config.trusted_domains]
    return F.coalesce(reduce(or_, tests), F.lit(False)) if tests else F.lit(False)


def routes(messages: DataFrame, hops: DataFrame, config: EngineConfig) -> DataFrame:
    """One row for each message, without hops too: counts, transit, origin, first trusted hop with confidence, private-to-public steps, connecting address."""
    w = Window.partitionBy("msg_id").orderBy(F.desc("hop_idx"))
    last = F.lag(F.struct("primary_ip_class", "timestamp_utc")).over(w)
    rows = hops.select("*", last.alias("b"), is_trusted(F.col("by_host"), config).alias("trusted"))
    seconds = (F.unix_micros("timestamp_utc") - F.unix_micros("b.timestamp_utc")) / 1e6
    inner = F.col("b.primary_ip_class").isin("private", "loopback", "link_local") & (F.col("primary_ip_class") == "public")
    oldest = -F.col("hop_idx")
    per = rows.withColumns({"seconds": seconds, "crosses": inner}).groupBy("msg_id").agg(
        F.count("*").alias("n_hops"),
        F.sum(F.when(F.col("seconds") >= 0, F.col("seconds"))).alias("total_transit_seconds"),
        F.count_if(F.col("seconds") < 0).alias("n_skews"),
        F.min("seconds").alias("least_delay"),
        F.max("hop_idx").alias("origin_hop"),
        F.min_by(F.when(F.col("trusted"), F.struct("hop_idx", "primary_ip")), F.when(F.col("trusted"), oldest)).alias("t"),
        F.min_by(F.when(F.col("primary_ip").isNotNull(), F.col("primary_ip")), F.when(F.col("primary_ip").isNotNull(), oldest)).alias("first_ip"),
        F.count_if("crosses").alias("n_crossings"),
        F.count_if(F.col("used_tls") == F.lit(False)).alias("n_plain_hops"),
        F.collect_set(F.lower("from_host")).alias("from_hosts"),
        F.collect_set(F.lower("from_rdns")).alias("from_names"),
        F.collect_set(F.lower("by_host")).alias("by_hosts"),
    )
    sure = F.when(F.col("t").isNull(), "low").when(F.col("t.primary_ip").isNotNull(), "high").otherwise("medium")
    return messages.select("msg_id").join(per, "msg_id", "left").select(
        "msg_id",
        F.coalesce("n_hops", F.lit(0)).alias("n_hops"),
        "total_transit_seconds",
        F.coalesce("n_skews", F.lit(0)).alias("n_skews"),
        "least_delay",
        "origin_hop",
        F.col("t.hop_idx").alias("trusted_hop"),
        sure.alias("boundary_confidence"),
        F.coalesce("n_crossings", F.lit(0)).alias("n_crossings"),
        F.coalesce("n_plain_hops", F.lit(0)).alias("n_plain_hops"),
        F.coalesce("t.primary_ip", "first_ip").alias("connecting_ip"),
        F.array_distinct(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in ("from_hosts", "from_names", "by_hosts")]))).alias("hosts"),
    )
