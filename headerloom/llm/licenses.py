"""Licence scans by sentence and rule recognition (operator 2).

Texts are cut at line ends and sentence ends; pieces in lower case and single
spaces, alone or joined with those that follow, are looked up among known licence
sentences, and each document's sequence of sentence identifiers is matched
against ordered licence rules. A rule matches its identifiers in a row; what a
rule has matched is taken out before the next one. Pieces are joined up to the
words of the longest known sentence, so it doesn't matter over how many lines a
sentence is wrapped; a sentence inside a longer known one doesn't count.

Nothing is shuffled: a document is one row throughout. Only documents with one
of the words that every known sentence contains are cut up, and only pieces of documents in which
a sentence may begin go to Python, where a tree of the sentences' words is walked from each such place: the work
grows with the text. A sentence with a name in it, free between fixed parts, is written with a
fixed name before it is looked up. An SPDX tag with an expression (OR, AND, WITH, parentheses) counts as one
tag for each licence in it, in order; exceptions after WITH are left out, and the kind is that of the strictest licence
even where there is a choice.

Edge cases: a null or empty text has no licence; repeated rows each keep their
row; an empty table gives an empty result; columns besides the id and the text
are ignored; known sentences that no rule explains are counted as unexplained.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerloom.llm.common import ascii_lower
from headerloom.llm.licence_texts import KEYWORDS, KINDS, NAMED, RULES, SENTENCES, Rule

#: A run of marks is left at once if no space follows, however long it is.
_BREAK = r"(?<![.!?])[.!?]++\s+|[\r\n]+"
TAG = "spdx-license-identifier:"
#: A tag after the marks of a comment; what makes its value an expression; an exception; the words of an expression.
_TAGGED, _COMPOUND, _EXCEPTION, _WORD = f"^[^a-z0-9]*{TAG}", r"[ \t)](or|and|with)[ \t(]|[()]", r"[ \t)]with[ \t]+[a-z0-9.-]+", "[a-z0-9][a-z0-9.+-]*"
_OPERATORS = ("or", "and", "with")


def normalised(piece: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(piece), "[^a-z0-9]+", " "))


def _runs(sentences: dict[str, str]):
    """A function of pieces and of the places where sentences may begin: the identifiers of the known sentences, in order."""
    tree: dict = {}
    for sentence, name in sentences.items():
        at = tree
        for word in sentence.split():
            at = at.setdefault(word, {})
        at[""] = name

    def ids(pieces: list[str], starts: list[int]) -> list[str]:
        runs = []
        for start in starts:
            at = tree
            for end in range(start, len(pieces)):
                for word in pieces[end].split():
                    at = at.get(word)
                    if at is None:
                        break
                if at is None:
                    break
                if "" in at:
                    runs.append((start, -end, at[""]))
        # A sentence inside a longer one ends no later than one that began before it or with it.
        kept, until = [], -1
        for _, end, name in sorted(runs):
            if -end > until:
                kept.append(name)
                until = -end
        return kept

    @F.pandas_udf("array<string>")
    def known_runs(pieces: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else ids(list(p), list(s)) for p, s in zip(pieces, starts, strict=True)], dtype=object)

    return lambda pieces, starts: known_runs(F.when(F.size(starts) > 0, F.col(pieces)), F.when(F.size(starts) > 0, F.col(starts)))


def _with_fixed_names(text: Column) -> Column:
    """The text with fixed names in sentences that hold somebody's; most texts have none of their first words and are left at once."""
    for word, pattern, fixed in NAMED:
        text = F.when(F.contains(F.lower(text), F.lit(word)), F.regexp_replace(text, pattern, fixed)).otherwise(text)
    return text


def _tags(piece: Column) -> Column:
    """The piece in an array, or one tag for each licence if it is a tag with an expression."""
    low = ascii_lower(piece)
    value = F.regexp_replace(low, _TAGGED, "")
    words = F.regexp_extract_all(F.regexp_replace(value, _EXCEPTION, " "), F.lit(_WORD), F.lit(0))
    tags = F.transform(F.filter(words, lambda w: ~w.isin(*_OPERATORS)), lambda w: F.concat(F.lit(f"{TAG} "), w))
    return F.when(low.rlike(_TAGGED) & value.rlike(_COMPOUND), tags).otherwise(F.array(piece))


def with_sentence_ids(docs: DataFrame, id_col: str, text_col: str, sentences: dict[str, str] = SENTENCES) -> DataFrame:
    """``id_col`` and ids: the identifiers of each text's known sentences, in order.

    Each step is a projection of its own, so that no text is cut up twice.
    """
    loose = [s for s in sentences if not any(k in w for w in s.split() for k in KEYWORDS)]
    if loose:
        raise ValueError(f"without a keyword: {loose}")
    known_runs = _runs(dict(sentences))
    begins = F.array(*[F.lit(f"{s} ") for s in sentences])
    lower = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(id_col, _with_fixed_names(F.col("text")).alias("text"), F.lower("text").alias("low"))
    marked = reduce(or_, [F.contains(F.col("low"), F.lit(k)) for k in KEYWORDS])
    raw = lower.select(id_col, F.when(marked, F.split("text", _BREAK)).otherwise(F.array().cast("array<string>")).alias("raw"), F.contains("low", F.lit(TAG)).alias("tagged"))
    raw = raw.select(id_col, F.when(F.col("tagged"), F.flatten(F.transform("raw", _tags))).otherwise(F.col("raw")).alias("raw"))
    pieces = raw.select(id_col, F.filter(F.transform("raw", normalised), lambda p: p != "").alias("p"))
    # A piece that begins no known sentence can't be the first line of one; few are left.
    starts = pieces.select(id_col, "p", F.filter(F.transform("p", lambda p, i: F.when(F.exists(begins, lambda s: F.startswith(s, F.concat(p, F.lit(" ")))), i)), lambda i: i.isNotNull()).alias("at"))
    runs = starts.select(id_col, F.when(F.size("at") > 0, known_runs("p", "at")).alias("ids"))
    return runs.select(id_col, F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col``, sentence_ids (in order), licenses (sorted), kind (the strictest) and n_unexplained of each row."""
    named = with_sentence_ids(docs, id_col, text_col, sentences)
    found = named.select(id_col, F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("sentence_ids"))
    ordered = F.array(*[F.struct(F.lit("".join(f"<{s}>" for s in r.sentences)).alias("mark"), F.lit(r.licence).alias("licence"), F.lit(r.kind).alias("kind")) for r in rules])
    none = F.struct(F.col("sentence_ids").alias("left"), F.array().cast("array<struct<licence:string,kind:string>>").alias("met"))
    step = lambda acc, r: F.when(F.contains(acc["left"], r["mark"]), F.struct(F.replace(acc["left"], r["mark"], F.lit("|")).alias("left"), F.array_append(acc["met"], F.struct(r["licence"].alias("licence"), r["kind"].alias("kind"))).alias("met"))).otherwise(acc)
    # Only short strings of identifiers are matched here, and mostly empty ones.
    met = found.select(id_col, "sentence_ids", F.when(F.col("sentence_ids") == "", none).otherwise(F.aggregate(ordered, none, step)).alias("m")).select(id_col, "sentence_ids", "m.met", "m.left")
    kinds = F.transform("met", lambda r: r["kind"])
    kind = F.coalesce(*[F.when(F.array_contains(kinds, k), F.lit(k)) for k in KINDS], F.lit("none"))
    return met.select(
        id_col,
        "sentence_ids",
        F.array_join(F.array_sort(F.array_distinct(F.transform("met", lambda r: r["licence"]))), ",").alias("licenses"),
        kind.alias("kind"),
        (F.length("left") - F.length(F.replace(F.col("left"), F.lit("<"), F.lit("")))).cast("long").alias("n_unexplained"),
    )


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same rows in DuckDB: every run of lines is tried, and rules are applied one after another."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in SENTENCES.items())
    named = "coalesce(text, '')"
    for _, pattern, fixed in NAMED:
        named = f"regexp_replace({named}, {quote(pattern)}, {quote(fixed)}, 'g')"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    value = f"regexp_replace({lower('p')}, '{_TAGGED}', '')"
    words = f"list_filter(regexp_extract_all(regexp_replace({value}, '{_EXCEPTION}', ' ', 'g'), '{_WORD}'), lambda w: w NOT IN {_OPERATORS})"
    tags = f"flatten(list_transform(raw, lambda p: CASE WHEN regexp_matches({lower('p')}, '{_TAGGED}') AND regexp_matches({value}, '{_COMPOUND}') THEN list_transform({words}, lambda w: '{TAG} ' || w) ELSE [p] END))"
    steps, left = [], "s0"
    for k, rule in enumerate(RULES):
        mark = "".join(f"<{s}>" for s in rule.sentences)
        steps.append(f"r{k} AS (SELECT * EXCLUDE (rest), replace(rest, {quote(mark)}, '|') AS rest, CASE WHEN contains(rest, {quote(mark)}) THEN list_append(met, {{'licence': {quote(rule.licence)}, 'kind': {quote(rule.kind)}}}) ELSE met END AS met2 FROM {left})")
        steps.append(f"q{k} AS (SELECT * EXCLUDE (met, met2), met2 AS met FROM r{k})")
        left = f"q{k}"
    kind = " ".join(f"WHEN list_contains(list_transform(met, lambda x: x.kind), {quote(k)}) THEN {quote(k)}" for k in KINDS)
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
rows AS (SELECT row_number() OVER () AS n, doc_id, string_split_regex({named}, '[.!?]+\\s+|[\\r\\n]+') AS raw FROM documents),
pieces AS (SELECT n, doc_id, list_filter(list_transform({tags}, lambda p: trim(regexp_replace({lower("p")}, '[^a-z0-9]+', ' ', 'g'))), lambda p: p <> '') AS p FROM rows),
places AS MATERIALIZED (SELECT n, p, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM pieces),
begun AS MATERIALIZED (SELECT n, p, i, sentence, id FROM places JOIN known ON starts_with(sentence || ' ', piece || ' ')),
tried AS MATERIALIZED (SELECT *, unnest(range(1, len(string_split(sentence, ' ')) + 1)) AS k FROM begun),
runs AS (SELECT n, i, i + k AS e, id FROM tried WHERE i + k - 1 <= len(p) AND array_to_string(list_slice(p, i, i + k - 1), ' ') = sentence),
ids AS (SELECT n, string_agg('<' || id || '>', '' ORDER BY i) AS ids FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.n = r.n AND o.i <= r.i AND o.e >= r.e AND o.e - o.i > r.e - r.i) GROUP BY n),
s0 AS (SELECT rows.n, rows.doc_id, coalesce(ids, '') AS sentence_ids, coalesce(ids, '') AS rest, [{{'licence': '', 'kind': ''}}][2:] AS met FROM rows LEFT JOIN ids USING (n)),
{", ".join(steps)}
SELECT doc_id, sentence_ids, array_to_string(list_sort(list_distinct(list_transform(met, lambda x: x.licence))), ',') AS licenses,
       CASE {kind} ELSE 'none' END AS kind, CAST(length(rest) - length(replace(rest, '<', '')) AS BIGINT) AS n_unexplained
FROM {left}
"""
