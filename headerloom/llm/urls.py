"""URL filters: rules first, then the reputation of hosts (operator 12).

A page whose outcome is known, good or bad, counts for its host. How bad a host's pages
are is estimated by empirical Bayes: a host's share has a beta prior around
that of its registered domain, a domain around that of its public suffix, a suffix around
the share of all. How strong each level's prior is, is estimated from how far the level's
children spread beyond chance (moments of the beta-binomial). Hosts with few
known pages so keep to what their domain shows, and hosts with none have it alone.

A host is blocked where even the lower bound of its posterior is above
``MOST_BAD``. The bound is taken on the arcsine scale, on which a share spreads
by the number of observations alone: it stays within 0 and 1 for small counts.

Everything is grouped sums: counts by host are made where the pages are and
only then shuffled, the levels above are sums of those. A host, domain or title with a third of
all rows is one key of a join whose other side has one row for it: Spark splits such partitions at run time (adaptive
skew joins), and nothing is copied for the other keys.

Edge cases: a null url, or one without ``://``, has an empty host and path,
which is a host like others; rows that repeat an id are pages of their own; an outcome of a page
that isn't there counts for nothing; without outcomes every host has the uniform prior and is
allowed; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerloom.functions.suffixes import SHORT, Suffixes, organizational_domain, public_suffix
from headerloom.llm.common import ascii_lower, staged, text_or_empty

#: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A host is blocked if more than this share of its pages is bad, but for a chance of about one in twenty.
MOST_BAD = 0.5
DEVIATIONS = 1.645
#: Weights of a prior in pages, at least and at most.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0
#: Characters of a text's first line that a page's title shows.
TITLE = 60


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty without ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.substr(url, F.instr(url, "://") + 3))
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*+", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null; of equally long ones the first."""
    fitting = [
        F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    ]
    return F.coalesce(*fitting) if fitting else F.lit(None).cast("struct<rule:string,verdict:string>")


def _spread(children: DataFrame) -> Column:
    """Aggregate over (n, k, mean): the weight of a level's prior, from moments of the beta-binomial.

    With a correlation r within children, n (k/n - mean)^2 has mean(1 - mean) (1 + (n - 1) r) in the mean.
    """
    chance = F.col("mean") * (1 - F.col("mean"))
    beyond = F.sum(F.pow(F.col("k") - F.col("n") * F.col("mean"), 2) / F.col("n")) - F.sum(chance)
    r = F.coalesce(beyond / F.nullif(F.sum((F.col("n") - 1) * chance), F.lit(0.0)), F.lit(0.0))
    weight = F.when(r > 0, 1 / r - 1).otherwise(MOST_WEIGHT)
    return F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), weight))


def reputations(pages: DataFrame, outcomes: DataFrame, suffixes: Suffixes = SHORT) -> DataFrame:
    """(host, domain, suffix, n, k, a, b, lower): each host of ``pages`` (page_id, host) with known outcomes, bad ones, its posterior and its lower bound.

    ``outcomes`` are (page_id, bad), at most one for an id.
    """
    known = pages.join(outcomes.select("page_id", "bad"), "page_id", "left")
    counts = known.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k"))
    # A name without a known suffix, or an address, is under its last label. A domain has one suffix, whatever its hosts are.
    suffix = F.coalesce(public_suffix(F.col("domain"), suffixes), F.substring_index("domain", ".", -1))
    hosts = staged(counts.select("host", organizational_domain(F.col("host"), suffixes).alias("domain"), "n", "k").withColumn("suffix", suffix), "host-counts")
    domains = staged(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domain-counts")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = tops.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    level = tops.withColumn("mean", F.lit((total.k + 1) / (total.n + 2)))
    weights = []
    for below, key in ((domains, "suffix"), (hosts, "domain"), (None, None)):
        weight = level.where("n > 0").agg(_spread(level).alias("w")).first().w
        weights.append(weight)
        a, b = F.col("k") + F.lit(weight) * F.col("mean"), F.col("n") - F.col("k") + F.lit(weight) * (1 - F.col("mean"))
        level = level.withColumns({"a": a, "b": b})
        if below is not None:
            above = level.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
            level = staged(below.join(above, key), "level")
    share = F.col("a") / (F.col("a") + F.col("b"))
    angle = F.asin(F.sqrt(share)) - DEVIATIONS / (2 * F.sqrt(F.col("a") + F.col("b") + 1))
    return level.select("host", "domain", "suffix", "n", "k", "a", "b", F.pow(F.sin(F.greatest(F.lit(0.0), angle)), 2).alias("lower"))


def judged(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, most_bad: float = MOST_BAD, suffixes: Suffixes = SHORT) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_known, n_bad, lower) of each row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = matching_rule(F.col("host"), F.col("path"), rules)
    hosts = reputations(read.select("page_id", "host"), outcomes, suffixes).select("host", F.col("n").alias("n_known"), F.col("k").alias("n_bad"), "lower")
    met = read.join(hosts, "host").withColumn("found", found)
    own = F.when(F.col("lower") > most_bad, "block").otherwise("allow")
    return met.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", own).alias("verdict"), "n_known", "n_bad", "lower")


def _unescaped(text: Column) -> Column:
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def outcomes_by_title(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad) of pages (page_id, html) that show a labelled document: their title is the beginning of its first line.

    A document is bad if it is toxic or of no quality; where documents with other labels begin alike, most of them decide, a tie is bad.
    Pages that repeat an id, and those without one, have no outcome.
    """
    first_line = F.rtrim(F.substring(F.substring_index(text_or_empty(), "\n", 1), 1, TITLE))
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    marked = labels.where("doc_id is not null and (toxic is not null or quality is not null)").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    begun = docs.select("doc_id", first_line.alias("title")).join(marked, "doc_id").where("title <> ''")
    by_title = begun.groupBy("title").agg((2 * F.count_if("bad") >= F.count("*")).alias("bad"))
    title = F.rtrim(_unescaped(F.regexp_extract(F.coalesce("html", F.lit("")), r"<title>([^<]*+)</title>", 1)))
    shown = pages.where("page_id is not null").select("page_id", title.alias("title")).where("title <> ''")
    return shown.join(by_title, "title").groupBy("page_id").agg(F.first("bad").alias("bad"), F.count("*").alias("n")).where("n = 1").drop("n")


def op12_url_filter(spark, sf_dir: str) -> DataFrame:
    """A verdict on every page."""
    pages, docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "documents", "labels"))
    return judged(pages.select("page_id", "url"), outcomes_by_title(pages.select("page_id", "html"), docs.select("doc_id", "text"), labels)).drop("lower")


def oracle(rules: tuple = RULES, most_bad: float = MOST_BAD) -> str:
    """The same in DuckDB, for hosts of three or two labels under suffixes of one, which those of the tables are."""
    fits = "\n".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for h, p, _ in sorted(rules, key=lambda r: -len(r[0] + r[1])))
    said = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in rules)
    unescaped = "regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        unescaped = f"replace({unescaped}, '{a}', '{b}')"

    def level(name: str, rows: str) -> str:
        return f"""
{name}_w AS (SELECT least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, CASE WHEN r > 0 THEN 1 / r - 1 ELSE {MOST_WEIGHT} END)) AS w FROM (
  SELECT coalesce((sum(pow(k - n * mean, 2) / n) - sum(mean * (1 - mean))) / nullif(sum((n - 1) * mean * (1 - mean)), 0), 0) AS r FROM {rows} WHERE n > 0)),
{name}_p AS (SELECT l.*, k + w * mean AS a, n - k + w * (1 - mean) AS b FROM {rows} l, {name}_w)"""

    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(regexp_extract(rest, '^[^?#]*'), '/.*$') AS path, rtrim({unescaped}, ' ') AS title FROM u),
d AS (SELECT rtrim(substr(split_part(text, chr(10), 1), 1, {TITLE}), ' ') AS title, toxic = 1 OR quality = 0 AS bad FROM documents JOIN labels USING (doc_id)),
o AS (SELECT title, 2 * count(*) FILTER (WHERE bad) >= count(*) AS bad FROM d WHERE title <> '' GROUP BY title),
h AS (SELECT host, CASE WHEN host LIKE '%.%' THEN regexp_extract(host, '[^.]+\\.[^.]+$') ELSE host END AS domain, split_part(host, '.', -1) AS suffix, count(bad) AS n, count(*) FILTER (WHERE bad) AS k FROM p LEFT JOIN o USING (title) GROUP BY host),
dd AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, (sum(sum(k)) OVER () + 1)::DOUBLE / (sum(sum(n)) OVER () + 2) AS mean FROM dd GROUP BY suffix),
{level("s", "s")},
e AS (SELECT dd.*, a / (a + b) AS mean FROM dd JOIN s_p USING (suffix)),
{level("e", "e")},
g AS (SELECT h.*, a / (a + b) AS mean FROM h JOIN (SELECT domain, a, b FROM e_p) USING (domain)),
{level("g", "g")},
z AS (SELECT host, n, k, pow(sin(greatest(0, asin(sqrt(a / (a + b))) - {DEVIATIONS} / (2 * sqrt(a + b + 1)))), 2) AS lower_ FROM g_p),
f AS (SELECT page_id, host, path, n, k, lower_, CASE {fits} END AS rule FROM p JOIN z USING (host))
SELECT page_id, host, path, rule, coalesce(CASE rule {said} END, CASE WHEN lower_ > {most_bad} THEN 'block' ELSE 'allow' END) AS verdict, n AS n_known, k AS n_bad FROM f"""
