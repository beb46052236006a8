"""Public suffixes: under which names others register theirs.

A list of rules becomes one regular expression that shares beginnings, so a
name is looked up in a few steps however long the list is, inside any
expression, without a join. Rules are those of the public list: ``co.uk``, ``*.ck``
(any label before it), ``!www.ck`` (an exception to it).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels that countries keep for others to register under, and countries that don't; a full list is a parameter (``from_table``).
KEPT = "ac co com edu gov net org".split()
FLAT = "aq ax be bg bv ca cc cd cf cg ch cz de dj dk eu fi fo ga gd gf gq gs li lu mc md mh mp mq nc ne nl no nu pm sj sk sm sr su tc td tf tg tk us va vg wf yt".split()
#: Such labels of single countries.
OTHERS = "gv.at or.at or.jp ne.jp go.jp ad.jp ed.jp gr.jp lg.jp or.kr ne.kr go.kr re.kr pe.kr or.id go.id web.id or.th go.th in.th me.uk ltd.uk plc.uk nhs.uk police.uk sch.uk gob.ar gob.cl gob.es gob.mx gob.pe gob.ve gouv.ci gouv.fr gouv.sn firm.in gen.in ind.in nic.in geek.nz gen.nz kiwi.nz maori.nz school.nz id.au asn.au info.pl biz.pl waw.pl art.br blog.br eco.br adv.br ind.br inf.br web.tr gen.tr bel.tr av.tr dr.tr k12.tr idf.il k12.il muni.il idv.tw idv.hk web.za law.za nom.za mil.br mil.co msk.ru spb.ru".split()
#: Countries in which every label is such a name, exceptions there, and names of hosts that give names away.
WILDCARDS = "bd ck er fk jm kh mm np pg kawasaki.jp kitakyushu.jp kobe.jp nagoya.jp sapporo.jp sendai.jp yokohama.jp".split()
EXCEPTIONS = "www.ck city.kawasaki.jp city.kitakyushu.jp city.kobe.jp city.nagoya.jp city.sapporo.jp city.sendai.jp city.yokohama.jp".split()
PRIVATE = "github.io gitlab.io blogspot.com herokuapp.com netlify.app vercel.app pages.dev workers.dev web.app firebaseapp.com appspot.com cloudfront.net azurewebsites.net s3.amazonaws.com co.com uk.com us.com".split()
#: Top-level names that aren't countries'; a part of the public list. Countries are all names of two letters.
GENERIC = "aero app arpa asia biz blog cat cloud club com coop dev edu gov info int jobs live mil mobi museum name net news online org page post pro shop site store tech tel top travel vip work xxx xyz".split()
#: Every country, and the kept labels under each but the flat ones.
COUNTRIES = rf"(?:(?:{'|'.join(KEPT)})\.(?!(?:{'|'.join(FLAT)})$))?[a-z][a-z]"
#: Labels of the longest rule that is looked for.
MOST_LABELS = 8


@dataclass(frozen=True)
class Suffixes:
    """Patterns of a list of rules: ``rules`` match whole suffixes, ``exceptions`` whole registrable names."""

    rules: str
    exceptions: str


def _together(words: Iterable[str]) -> str:
    """A pattern of all words that shares their beginnings."""
    tree: dict = {}
    for word in sorted(set(words)):
        at = tree
        for c in word:
            at = at.setdefault(c, {})
        at[""] = {}

    def pattern(at: dict) -> str:
        text = ""
        while len(at) == 1 and "" not in at:
            (c, at), *_ = at.items()
            text += re.escape(c)
        if list(at) in ([], [""]):
            return text
        kinds = [re.escape(c) + pattern(below) for c, below in at.items() if c]
        return f"{text}(?:{'|'.join(kinds)}){'?' if '' in at else ''}"

    return pattern(tree)


def compiled(rules: Iterable[str], countries: bool = False) -> Suffixes:
    """``countries`` adds COUNTRIES to the rules."""
    forms: set[str] = set()
    for rule in rules:
        mark = re.match(r"!|\*\.|", rule)[0]
        name = rule.strip().lower()[len(mark) :].strip(".")
        forms.add(mark + name)
        try:
            forms.add(mark + name.encode("idna").decode("ascii"))
        except UnicodeError:
            pass
    plain = [f for f in forms if f and f[0] not in "!*"]
    wild = [f[2:] for f in forms if f.startswith("*.") and f[2:]]
    kinds = [*([_together(plain)] if plain else []), *([rf"[^.]+\.{_together(wild)}"] if wild else []), *([COUNTRIES] if countries else [])]
    barred = [f[1:] for f in forms if f.startswith("!") and f[1:]]
    return Suffixes("|".join(kinds) or "(?!)", _together(barred) if barred else "(?!)")


def short_rules() -> list[str]:
    """The part of the public list that is stated here."""
    return [*GENERIC, *OTHERS, *(f"*.{w}" for w in WILDCARDS), *(f"!{e}" for e in EXCEPTIONS)]


SHORT = compiled(short_rules(), countries=True)
#: With the names under which hosts give names away, too.
SHORT_AND_PRIVATE = compiled([*short_rules(), *PRIVATE], countries=True)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule, private) of a file in the public list's form: one rule a line, ``//`` before remarks, which also bound its private part."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"), F.split("value", r"\r?\n").alias("lines"))
    # The line on which the private part begins, if there is one.
    starts = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("===BEGIN PRIVATE DOMAINS==="))), True)
    rule = F.lower(F.regexp_extract("line", r"^\s*(\S*)", 1))
    return lines.select(rule.alias("rule"), ((starts > 0) & (F.col("at") >= starts)).alias("private")).where("rule <> '' and not startswith(rule, '//')")


#: Rules that a table may have: they come to the driver and into expressions.
MOST_RULES = 50_000


def from_table(table: DataFrame, private: bool = False) -> Suffixes:
    """Patterns of a table (rule, private), at most MOST_RULES of them; the public list has about 10,000."""
    rows = table if private else table.where("not coalesce(private, false)")
    found = [r.rule for r in rows.select("rule").where("rule is not null").distinct().limit(MOST_RULES + 1).collect()]
    if len(found) > MOST_RULES:
        raise ValueError(f"a table of suffixes has at most {MOST_RULES} rules")
    return compiled(found)


def _tail(domain: Column) -> Column:
    """As many labels as rules look at: names of any number of labels cost the same."""
    return F.substring_index(domain, ".", -MOST_LABELS)


def _match(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def public_suffix(domain: Column, suffixes: Suffixes = SHORT) -> Column:
    """The suffix that the longest rule gives, or null; a name that is a suffix is its own."""
    barred = _match(_tail(domain), rf"(?:^|\.)({suffixes.exceptions})$")
    # Of all ends that are rules the leftmost one is found, which is the longest.
    return F.coalesce(F.substr(barred, F.instr(barred, ".") + 1), _match(_tail(domain), rf"(?:^|\.)({suffixes.rules})$"))


def organizational_domain(domain: Column, suffixes: Suffixes = SHORT) -> Column:
    """The registrable name: one label more than the suffix; the last two labels of a suffix itself and of names without a known one."""
    barred = _match(_tail(domain), rf"(?:^|\.)({suffixes.exceptions})$")
    # A name that is a rule as a whole has no label before it: its longest rule counts, not a shorter one.
    whole = _tail(domain).rlike(rf"^(?:{suffixes.rules})$")
    registered = F.when(~whole, _match(_tail(domain), rf"(?:^|\.)([^.]+\.(?:{suffixes.rules}))$"))
    return F.coalesce(barred, registered, F.substring_index(domain, ".", -2))


def suffix_is_known(domain: Column, suffixes: Suffixes = SHORT) -> Column:
    return public_suffix(domain, suffixes).isNotNull()


def subdomain_depth(domain: Column, suffixes: Suffixes = SHORT) -> Column:
    """Labels before the registrable name."""
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    return F.when(domain.isNotNull(), dots(domain) - dots(organizational_domain(domain, suffixes))).otherwise(0)
