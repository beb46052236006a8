"""Structured field values, read from left to right once.

What divides a value doesn't count inside quotes and comments, and these nest to any depth: no
pattern can follow them. Each reader below takes its text apart into marks and the runs between them and
keeps a depth; the work grows with the text alone, whatever stands in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

#: An escaped character, a mark, white space, or a run of other characters.
_MARKS = re.compile(r'\\.?|[()";]|\s+|[^\\()";\s]+', re.S)
_NESTED = re.compile(r"[()\[\];]|\s+|[^()\[\];\s]+")
CLAUSES = ("from", "by", "with", "via", "id", "for")


def segments(text: str, divide: bool = True) -> Iterator[tuple[list[str], list[str]]]:
    """(words, comments) of each part between semicolons; without ``divide`` of the whole text.

    Quotes hold words together, semicolons and parentheses too; inside a comment quotes are text.
    A comment that never ends is none, and neither is what follows it.
    """
    words, comments, word, comment = [], [], [], []
    depth, quoted = 0, False

    def ended() -> None:
        if word:
            words.append("".join(word))
            word.clear()

    for mark in _MARKS.findall(text):
        if depth:
            depth += (mark == "(") - (mark == ")")
            if depth:
                comment.append(mark)
            else:
                comments.append("".join(comment).strip())
                comment.clear()
        elif mark == '"':
            quoted = not quoted
            word.append(mark)
        elif quoted:
            word.append(mark)
        elif mark == "(":
            depth = 1
        elif mark == ";" and divide:
            ended()
            yield words, comments
            words, comments = [], []
        elif mark.isspace():
            ended()
        else:
            word.append(mark)
    ended()
    yield words, comments


def unquoted(value: str) -> str:
    return value[1:-1].replace('\\"', '"') if len(value) >= 2 and value[0] == value[-1] == '"' else value


def _pairs(words: list[str], end: str = "") -> dict[str, str]:
    """name=value words; the last of a name counts."""
    split = (w.partition("=") for w in words if "=" in w)
    return {name.strip().lower().rstrip(end or None): unquoted(value.rstrip(end) if end else value) for name, _, value in split}


_CLAIM = pa.struct([("part", pa.int32()), ("method", pa.string()), ("result", pa.string()), ("props", pa.map_(pa.string(), pa.string())), ("reason", pa.string())])
RESULTS = pa.struct([("server", pa.string()), ("claims", pa.list_(_CLAIM))])


def recorded_results(text: str) -> dict:
    """Server and claims of an Authentication-Results value: the first part that isn't empty names the server."""
    parts = [p for p in segments(text) if p[0] or p[1]]
    server = parts[0][0][0] if parts and parts[0][0] else None
    claims = []
    for number, (words, comments) in enumerate(parts[1:], 1):
        method, equals, result = words[0].partition("=") if words else ("", "", "")
        if equals:
            props = _pairs(words[1:])
            reason = props.pop("reason", comments[0] if comments else None)
            claims.append({"part": number, "method": method.strip().lower().split("/")[0], "result": result.strip().lower(), "props": list(props.items()), "reason": reason})
    return {"server": server, "claims": claims}


def recorded_spf(text: str) -> dict:
    """The claim of a Received-SPF value; the first comment names its server, if one word stands before a colon there."""
    ((words, comments),) = segments(text, divide=False)
    if not words:
        return {"server": None, "claims": []}
    told = comments[0].split(":")[0].strip() if comments else ""
    claim = {"part": 1, "method": "spf", "result": words[0].lower(), "props": list(_pairs(words[1:], ";").items()), "reason": comments[0] if comments else None}
    return {"server": told if told and " " not in told else None, "claims": [claim]}


def recorded_of(values: pa.Array, spf: pa.Array) -> pa.Array:
    """Server and claims of each value; ``spf`` says which are those of Received-SPF."""
    if values.null_count == len(values):
        return pa.nulls(len(values), RESULTS)
    read = [None if v is None else (recorded_spf if s else recorded_results)(v) for v, s in zip(values.to_pylist(), spf.to_pylist(), strict=True)]
    return pa.array(read, RESULTS)


recorded = F.arrow_udf(recorded_of, from_arrow_type(RESULTS))


def tag_values(text: str) -> dict[str, str]:
    """tag=value parts of a signature; white space in those that are base64 doesn't count."""
    parts, last, depth, quoted = [], 0, 0, False
    for m in _MARKS.finditer(text):
        mark = m[0]
        if mark == '"' and not depth:
            quoted = not quoted
        elif not quoted:
            depth = max(0, depth + (mark == "(") - (mark == ")"))
            if mark == ";" and not depth:
                parts.append(text[last : m.start()])
                last = m.end()
    split = (p.partition("=") for p in [*parts, text[last:]] if "=" in p)
    tags = ((name.strip().lower(), value.strip()) for name, _, value in split)
    return {name: re.sub(r"\s+", "", value) if name in ("b", "bh") else value for name, value in tags if name}


TAGS = pa.map_(pa.string(), pa.string())


def tags_of(values: pa.Array) -> pa.Array:
    """Tags of each value; null for null."""
    if values.null_count == len(values):
        return pa.nulls(len(values), TAGS)
    return pa.array([None if v is None else list(tag_values(v).items()) for v in values.to_pylist()], TAGS)


tags = F.arrow_udf(tags_of, from_arrow_type(TAGS))


#: Beginnings of the months' names.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_ZONE = re.compile(r"(?:UTC|GMT|Z)?([+-])(\d{2}):?(\d{2})$|(UTC|GMT|UT|Z)$", re.I)
_DATE_WORDS = re.compile(r"\d+(?::\d+)+(?:\.\d+)?|[+-]\d{2}:?\d{2}(?!\d)|[A-Za-z]+|\d+")
_ISO = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ]+|$)")


def _by_kind(text: str) -> datetime | None:
    """A date whose parts are told by what they look like; one without a year, month or day is none, one without a time is midnight."""
    year = month = day = None
    clock, zone, numbers = None, None, []
    iso = _ISO.search(text)
    if iso:
        year, month, day = map(int, iso.groups())
        text = text[iso.end() :]
        glued = re.match(r"(\d{2})(\d{2})(\d{2})?(?=\D|$)", text)
        text = f"{glued[1]}:{glued[2]}:{glued[3] or '00'}{text[glued.end():]}" if glued and ":" not in text[:6] else text
    for word in _DATE_WORDS.findall(text):
        low = word.lower()
        found = _ZONE.match(word) if word[0] in "+-" or low in ("utc", "gmt", "ut", "z") else None
        if ":" in word and word[0] not in "+-":
            clock = clock or word
        elif found and (clock or word[0] not in "+-"):
            minutes = int(found[2]) * 60 + int(found[3]) if found[1] else 0
            zone = zone or timezone(timedelta(minutes=-minutes if found[1] == "-" else minutes))
        elif low in ("am", "pm") and clock:
            hour, _, rest = clock.partition(":")
            clock = f"{int(hour) % 12 + 12 * (low == 'pm')}:{rest}"
        elif word.isalpha():
            if month is None and low[:3] in MONTHS and len(low) >= 3:
                month = MONTHS.index(low[:3]) + 1
        elif word.isdigit():
            numbers.append(word)
    for word in numbers:
        if len(word) == 4 and year is None:
            year = int(word)
        elif len(word) <= 2 and day is None and 1 <= int(word) <= 31:
            day = int(word)
        elif len(word) <= 2 and month is None and 1 <= int(word) <= 12:
            month = int(word)
        elif len(word) == 2 and year is None:
            year = int(word) + (2000 if int(word) < 69 else 1900)
    if None in (year, month, day):
        return None
    parts = [*(clock or "0").split(":"), "0", "0"][:3]
    seconds = float(parts[2])
    return datetime(year, month, day, int(parts[0]), int(parts[1]), int(seconds), round(seconds % 1 * 1e6), zone)


def date_of(text: str) -> tuple[datetime | None, bool]:
    """UTC time and whether a zone was written: as the mail standard has it, else by the look of its parts.

    Without a zone it counts as UTC. ``-0000`` says that the zone is unknown.
    """
    text = re.sub(r"\s+", " ", text).strip()
    for read in (parsedate_to_datetime, _by_kind):
        try:
            found = read(text)
            if found is not None:
                return found.replace(tzinfo=found.tzinfo or UTC).astimezone(UTC), found.tzinfo is not None
        except (TypeError, ValueError, IndexError, OverflowError):
            continue
    return None, False


HOP = pa.struct([("date", pa.string()), ("at", pa.timestamp("us", "UTC")), ("zone", pa.bool_()), *((c, pa.string()) for c in CLAUSES)])


def received_parts(text: str) -> dict:
    """Clauses and date of a Received value: keywords and the last semicolon count outside parentheses and brackets only; the first clause of a name counts."""
    depth, end, places = 0, None, []
    for m in _NESTED.finditer(text):
        mark = m[0]
        if mark in "([":
            depth += 1
        elif mark in ")]":
            depth = max(0, depth - 1)
        elif depth == 0:
            if mark == ";":
                end = m.start()
            elif mark.lower() in CLAUSES:
                places.append((m.start(), m.end(), mark.lower()))
    main = text if end is None else text[:end]
    places = [p for p in places if p[0] < len(main)]
    clauses: dict[str, str] = {}
    for (_, start, name), (stop, *_) in zip(places, [*places[1:], (len(main),)], strict=False):
        clauses.setdefault(name, main[start:stop].strip())
    date = text[end + 1 :].strip() if end is not None else ""
    at, zone = date_of(date) if date else (None, False)
    return {"date": date or None, "at": at, "zone": zone} | {c: clauses.get(c) for c in CLAUSES}


def received_of(values: pa.Array) -> pa.Array:
    """Clauses and date of each value; null for null."""
    if values.null_count == len(values):
        return pa.nulls(len(values), HOP)
    return pa.array([None if v is None else received_parts(v) for v in values.to_pylist()], HOP)


received = F.arrow_udf(received_of, from_arrow_type(HOP))


_END = r"(?![^()\[\];\s])"
_INNER = r"[(\[](?:[^()\[\]]++|[(\[][^()\[\]]*+[)\]])*+[)\]]"
_BODY = rf"(?:\s++|(?!(?:{'|'.join(CLAUSES)}){_END})[^()\[\];\s]++|{_INNER})*+"
#: A value whose clauses come once, in the usual order, with at most two levels of brackets; the first part says nothing.
_USUAL = rf"(?i)^{_BODY}{''.join(rf'({c}{_END}{_BODY})?' for c in CLAUSES)}(;(?:[^()\[\];]++|{_INNER})*+)?$"
_MONTH = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
#: A date as most programs write it, of a day that exists, with a known zone.
_USUAL_DATE = rf"^(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun), )?((?:0?[1-9]|1\d|2[0-8])(?= )|(?:29|30)(?= (?!Feb))|31(?= (?:Jan|Mar|May|Jul|Aug|Oct|Dec))) ({_MONTH}) (19\d\d|20\d\d) ([01]\d|2[0-3]):([0-5]\d):([0-5]\d) (?!-0000)([+-](?:0\d|1[0-4])[0-5]\d)(?: {_INNER})?$"


#: What divides parts of a usual value, which holds printable ASCII only.
_MARK = "\u0001"


def _parted(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a text that a pattern fits as a whole, else the text alone."""
    return F.split(F.regexp_replace(text, pattern, _MARK.join(f"${i + 1}" for i in range(groups))), _MARK)


def with_usual(rows: DataFrame, value: Column) -> DataFrame:
    """The rows with ``usual``: what ``received_parts`` reads of a usual value, by patterns; null for all others.

    Each step is a column of its own, so that it isn't worked out for each use.
    """
    get = lambda name, i: F.get(name, F.lit(i))
    number = lambda i: get("d", i).cast("long")
    n = len(CLAUSES)
    rows = rows.withColumn("p", F.when(value.rlike(r"^[\x20-\x7E]*+$"), _parted(value, _USUAL, n + 1)))
    rows = rows.withColumn("t", F.when(F.size("p") == n + 1, F.nullif(F.trim(F.substr(get("p", n), F.lit(2))), F.lit(""))))
    rows = rows.withColumn("d", _parted(F.col("t"), _USUAL_DATE, 7))
    day = F.unix_date(F.make_date(number(2).cast("int"), (F.floor(F.instr(F.lit(_MONTH), get("d", 1)) / 4) + 1).cast("int"), number(0).cast("int"))).cast("long")
    off = (F.substring(get("d", 6), 2, 2).cast("long") * 60 + F.substring(get("d", 6), 4, 2).cast("long")) * F.when(F.startswith(get("d", 6), F.lit("-")), -60).otherwise(60)
    rows = rows.withColumn("s", F.when(F.size("d") == 7, day * 86_400 + number(3) * 3600 + number(4) * 60 + number(5) - off))
    clauses = [F.when(get("p", i) != "", F.trim(F.substr(get("p", i), F.lit(len(c) + 1)))).alias(c) for i, c in enumerate(CLAUSES)]
    # A date of another form has to be read by the reader of all forms.
    known = (F.size("p") == n + 1) & (F.col("t").isNull() | F.col("s").isNotNull())
    return rows.withColumn("usual", F.when(known, F.struct(F.col("t").alias("date"), F.timestamp_seconds("s").alias("at"), F.col("s").isNotNull().alias("zone"), *clauses))).drop("p", "t", "d", "s")
