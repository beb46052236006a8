"""Benchmark decontamination by a prefix-filtered set join (operator 6).

Each benchmark item is a set of windows of ``window`` consecutive words (an
item of fewer words is one window). A document that holds a window holds all of
its words, so one necessary prefix token, the window's rarest word in the
corpus, is enough to join on. Where that word stands in the window gives the
only start it can have; length bounds cut starts that would leave the
document; what remains is verified word by word over the item-sized window.

DataFrame functions only. The documents are tokenised twice: once to count how
often the benchmark's words occur, once to find the windows.

The scan for windows passes over words that are no prefix word by a bitmap of
word hashes, one row of at most ``MOST_BITS`` bits that no size of the benchmark enlarges; what
it lets through by chance the join drops. So a benchmark of any size takes one pass.

Edge cases: null or empty texts have no words and are clean; rows that repeat
an id and a text are one document; an empty benchmark leaves all clean; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerloom.llm.common import ascii_lower, staged

WINDOW = 10
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the bitmap for each prefix word, and of it as a whole.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 16, 1 << 24


def words_of(text: Column) -> Column:
    """Words are what stands between runs of other characters; splitting is much cheaper than extracting every match."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, words) of every window of every item."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, F.lit(window)))).alias("words"))


def word_rarity(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(word, seen): occurrences in the corpus of each word of the benchmark."""
    wanted = windows.select(F.explode("words").alias("word")).distinct()
    seen = docs.select(F.explode(words_of(F.col("text"))).alias("word")).join(wanted, "word").groupBy("word").agg(F.count("*").alias("seen"))
    return wanted.join(seen, "word", "left").select("word", F.coalesce("seen", F.lit(0)).alias("seen"))


def prefix_index(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(word, at, words, items): each distinct window under its rarest word, where that stands (from 0), and the items that hold the window."""
    windows = staged(item_windows(benchmark, window), "windows")
    rarity = word_rarity(docs, windows)
    distinct = windows.groupBy("words").agg(F.collect_set("item_id").alias("items"))
    placed = distinct.select("words", "items", F.posexplode("words").alias("at", "word")).join(rarity, "word")
    return placed.groupBy("words").agg(F.min_by(F.struct("word", "at", "items"), F.struct("seen", "at")).alias("x")).select("x.word", "x.at", "words", "x.items")


def bitmap(index: DataFrame) -> tuple[DataFrame, int]:
    """(bits,) in one row, an array of longs with two bits set for each prefix word's hash, and the number of bits."""
    words = index.select("word").distinct()
    size = LEAST_BITS
    while size < min(MOST_BITS, BITS_EACH * words.count()):
        size *= 2
    hash_ = F.xxhash64("word")
    place = words.select(F.explode(F.array(*[h.bitwiseAND(F.lit(size - 1)) for h in (hash_, F.shiftright(hash_, 32))])).alias("h"))
    set_ = place.groupBy(F.shiftright("h", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b"))
    every = words.sparkSession.range(size >> 6).join(set_, F.col("id") == F.col("at"), "left").select("id", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    return staged(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("bits")), "bitmap"), size


def occurrences(docs: DataFrame, index: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_key, n_words, start, n, items) of each verified occurrence; a document without any has one row of nulls."""
    bits, size = bitmap(index)
    found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    found = found.select("*", F.transform("w", lambda x: F.xxhash64(x)).alias("h")).join(F.broadcast(bits), F.lit(True))

    def marked(h: Column) -> Column:
        place = h.bitwiseAND(F.lit(size - 1))
        return F.getbit(F.get(F.col("bits"), F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1

    hashed = lambda i: F.get(F.col("h"), i - 1)
    places = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: marked(hashed(i)) & marked(F.shiftright(hashed(i), 32)))
    # A prefix word at place i can only begin a window from i - window + 1 on and end it before i + window.
    around = F.transform(
        F.when(F.size("w") > 0, places),
        lambda i: F.struct(
            i.alias("place"),
            F.get(F.col("w"), i - 1).alias("word"),
            F.greatest(F.lit(1), i - window + 1).alias("low"),
            F.slice("w", F.greatest(F.lit(1), i - window + 1), F.least(i, F.lit(window)) + window - 1).alias("near"),
        ),
    )
    rows = found.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), F.explode_outer(around).alias("c")).select("doc_id", "text_key", "n_words", "c.*")
    within = F.slice("near", F.col("place") - F.col("at") - F.col("low") + 1, F.size("words"))
    bounds = (F.col("place") > F.col("at")) & (F.col("place") - F.col("at") + F.size("words") - 1 <= F.col("n_words"))
    # A clean document's row has a word that no index holds, its own: such rows are dealt over all tasks.
    own = F.concat(F.lit("\0"), F.xxhash64("doc_id", "text_key").cast("string"))
    met = rows.withColumn("word", F.coalesce("word", own)).join(index, "word", "left")
    # Without a verified window, a row still says how many words its document has.
    start = F.when(bounds & F.when(bounds, within == F.col("words")), F.col("place") - F.col("at"))
    return met.select("doc_id", "text_key", "n_words", start.alias("start"), F.when(start.isNotNull(), F.size("words")).alias("n"), F.when(start.isNotNull(), F.col("items")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, text_key, n_words, n_hit (words inside any occurrence) and item_ids (array of strings, sorted)."""
    found = occurrences(docs, staged(prefix_index(docs, benchmark, window), "prefixes"), window)
    # One row per document and start, with the longest window there; the rows of clean places fall together first.
    starts = found.groupBy("doc_id", "text_key", "start").agg(F.max("n_words").alias("n_words"), F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    spans = F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", (F.col("start") + F.col("n")).alias("end")))))
    per_doc = starts.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["to"], s["end"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["to"], s["start"]))).alias("n")),
    )["n"]
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return per_doc.select("doc_id", "text_key", "n_words", covered.cast("long").alias("n_hit"), ids.alias("item_ids"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark words in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    bad = contamination(docs.select("doc_id", "text"), benchmark.select("item_id", "text")).where("n_hit > 0").select("doc_id", "text_key")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["text_key"]), "left_anti")
