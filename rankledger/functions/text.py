"""Text functions as Column expressions; NFKC is the one step without a JVM built-in and only non-ASCII text takes it."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\u0085   -     　]"

# Round labels, letters and digits only, by the stage they mean. Labels that are persons' names are left out on purpose; ``named_rounds`` takes such.
ROUND_LABELS = {
    "octafinal": ["octafinal", "octafinals", "octofinal", "octofinals", "octas", "octa", "octo", "of", "top16", "roundof16"],
    "quarterfinal": ["quarterfinal", "quarterfinals", "quarter", "quarters", "qtr", "qtrs", "qrt", "qrts", "qf", "top8", "roundof8"],
    "semifinal": ["semifinal", "semifinals", "semi", "semis", "sem", "sems", "sf", "top4", "roundof4", "roundbeforefinal"],
    "final": ["final", "finals", "f", "finalround", "championshipfinal", "exhibition"],
}
# Event names of a division, as exact keys.
DIVISION_KEYS = {"ix": ["international extemporaneous speaking", "international extemp", "ix"], "usx": ["united states extemporaneous speaking", "united states extemp", "usx"]}
# Marks of how an event was held, at the end of its name.
HELD = ["online", "in person"]
# Words of an event name that tell its division.
DIVISION_WORDS = {"ix": ["international"], "usx": ["national", "united states", r"\bus extemp"]}
# Words of events for beginners.
BEGINNERS = ["jv", "junior varsity", "novice"]


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(T.StringType())
def _entities(s: pd.Series) -> pd.Series:
    """Decimal and hexadecimal character references."""

    def char(digits: str, base: int, whole: str) -> str:
        point = int(digits, base)
        return chr(point) if point <= 0x10FFFF and unicodedata.category(chr(point)) != "Cs" else whole

    s = s.str.replace(r"&#(\d{1,8});", lambda m: char(m[1], 10, m[0]), regex=True)
    return s.str.replace(r"&#[xX]([0-9a-fA-F]{1,8});", lambda m: char(m[1], 16, m[0]), regex=True)


def is_ascii(c: Column) -> Column:
    return c.rlike(r"^[\x00-\x7F]*$")


def nfkc(c: Column) -> Column:
    return F.when(is_ascii(c), c).otherwise(_nfkc(c))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def identity_text(c: Column) -> Column:
    """NFKC, lower case, apostrophes only between letters, no other punctuation, single spaces; null if nothing is left."""
    t = F.lower(nfkc(collapse(c)))
    t = F.regexp_replace(t, r"(?<!\p{L})'|'(?!\p{L})", "")
    t = collapse(F.regexp_replace(t, r"[\p{P}&&[^']]", ""))
    return F.when(t != "", t)


def display_name(c: Column) -> Column:
    return collapse(c)


def name_sort_key(c: Column) -> Column:
    return F.lower(nfkc(collapse(c)))


def exact_key(c: Column) -> Column:
    """NFKC, lower case, runs of punctuation and symbols as one space."""
    return collapse(F.regexp_replace(F.lower(nfkc(c)), r"[\p{P}\p{S}]+", " "))


def event_key(c: Column) -> Column:
    """Letters and digits with single spaces, without a trailing mark of how the event was held."""
    t = F.trim(F.regexp_replace(F.lower(nfkc(c)), r"[^\p{L}\p{N}]+", " "))
    return F.regexp_replace(t, rf"\s+({'|'.join(HELD)})$", "")


def listed_event(name: Column, keys: list[str]) -> Column:
    """Whether an event is one of ``keys``: not one for beginners; a single letter before it and ' varsity' behind it don't count."""
    key = event_key(name)
    bare = F.regexp_replace(F.regexp_replace(key, "^[a-z] +", ""), " +varsity$", "")
    padded = F.concat(F.lit(" "), key, F.lit(" "))
    beginners = reduce(lambda x, y: x | y, [padded.contains(f" {w} ") for w in BEGINNERS])
    return F.coalesce(~beginners & bare.isin(keys), F.lit(False))


def round_stage(label: Column, named_rounds: dict[str, str] | None = None) -> Column:
    """Stage of a round label, tried again without trailing digits; null if unknown.

    named_rounds: further labels (letters and digits only) and their stages, such as rounds named after somebody.
    """
    known = {name: stage for stage, names in ROUND_LABELS.items() for name in names} | (named_rounds or {})
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    key = F.regexp_replace(F.lower(label), r"[^a-z0-9]", "")
    return F.coalesce(F.try_element_at(names, key), F.try_element_at(names, F.regexp_replace(key, r"\d+$", "")))


def numeric_placement(c: Column) -> Column:
    """Positive integer of '3', '3rd' or the like; null for anything else."""
    n = F.regexp_extract(F.trim(c), r"^(?i)(\d+)(?:st|nd|rd|th)?$", 1).try_cast("int")
    return F.when(n > 0, n)


def is_preliminary(c: Column) -> Column:
    return F.trim(c).rlike(r"^(?i)prelim(?:inary)?$")


def placement_error(c: Column, label_allowed: Column) -> Column:
    """INVALID_PLACEMENT where a non-blank text is neither a placement nor a label that may stand there."""
    fine = c.isNull() | (c == "") | numeric_placement(c).isNotNull()
    number = F.trim(c).rlike(r"^(?i)\d+(?:st|nd|rd|th)?$")
    label = round_stage(F.trim(c)).isNotNull() | is_preliminary(c) | label_allowed
    return F.when(~fine & (number | ~label), F.lit("INVALID_PLACEMENT"))


def strict_placement(c: Column) -> Column:
    return F.when(c.rlike(r"^[1-9]\d*$"), c.try_cast("int"))


def division_by_key(name: Column) -> Column:
    key = exact_key(name)
    out = F.lit("combined")
    for division, keys in DIVISION_KEYS.items():
        out = F.when(key.isin(keys), division).otherwise(out)
    return out


def division_by_pattern(name: Column) -> Column:
    """The first division one of whose words the name holds."""
    out = F.lit("combined")
    for division, words in reversed(DIVISION_WORDS.items()):
        out = F.when(name.rlike(f"(?i){'|'.join(words)}"), division).otherwise(out)
    return out


def member_number(c: Column) -> Column:
    t = F.regexp_replace(nfkc(c), f"(?:{SPACE}|-)+", "")
    return F.when(t.rlike(r"^\d{5,12}$"), t)


def masked(c: Column) -> Column:
    return F.concat(F.lit("•••"), F.right(c, F.lit(4)))


def plain_text(html: Column) -> Column:
    """Tags to spaces, character references decoded, single spaces."""
    t = F.regexp_replace(html, r"<[^>]*>", " ")
    t = F.when(t.contains("&#"), _entities(t)).otherwise(t)
    for name, char in (("amp", "&"), ("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">")):
        t = F.regexp_replace(t, f"(?i)&{name};", char)
    return collapse(t)


def person_key(provider: Column, person_id: Column) -> Column:
    """``provider:id`` unless the id has that prefix; null stays null."""
    prefix = F.concat(provider, F.lit(":"))
    return F.when(person_id.startswith(prefix), person_id).otherwise(F.concat(prefix, person_id))


def encode_component(c: Column) -> Column:
    """Percent-encoding of all but A-Z a-z 0-9 - _ . ! ~ * ' ( )."""
    t = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        t = F.replace(t, F.lit(code), F.lit(char))
    return t


def unknown_school_id(name: Column) -> Column:
    return F.concat(F.lit("unknown-school:"), encode_component(identity_text(name)))


def similar_98(a: Column, b: Column) -> Column:
    """At least 98 % alike: 50 d <= longer length, so texts under 50 characters must be equal."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    far = F.abs(F.char_length(a) - F.char_length(b)) * 50 > longest
    return F.when(a == b, True).when((longest < 50) | far, False).otherwise(F.levenshtein(a, b) * 50 <= longest)


def csv_field(c: Column) -> Column:
    t = c.cast("string")
    return F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def safe_relative_path(c: Column) -> Column:
    """No absolute path, drive, backslash or empty, '.' or '..' step."""
    steps = F.split(c, "/")
    return (c != "") & ~c.rlike(r"^/|\\|^[A-Za-z]:") & F.forall(steps, lambda s: ~s.isin("", ".", ".."))


def in_order(text: Column, parts: Column) -> Column:
    """All parts occur in text one behind the other: a fold that carries the position reached."""

    def step(at: Column, part: Column) -> Column:
        found = F.position(part, text, F.greatest(at, F.lit(1)))
        return F.when((at < 0) | (found == 0), -1).otherwise(found + F.length(part))

    return F.aggregate(parts, F.lit(1), step) > 0


def placements_named(text: Column, names: Column, reach: int = 18) -> Column:
    """All names occur in text one behind the other, each with its place (1, 2nd, 3.) at most ``reach`` characters before it.

    A fold that carries the position reached; -1 once a name or its place is missing. names is an array in order.
    """

    def step(at: Column, item: Column) -> Column:
        found = F.position(item.n, text, F.greatest(at, F.lit(1)))
        before = F.substring(text, F.greatest(found - reach, F.lit(1)), F.least(found - 1, F.lit(reach)))
        place = F.regexp_extract(F.lower(before), r"(\d+)(st|nd|rd|th)?[.)\s:-]*$", 1)
        return F.when((at < 0) | (found == 0) | (place != item.i.cast("string")), -1).otherwise(found + F.length(item.n))

    items = F.transform(names, lambda n, i: F.struct(n.alias("n"), (i + 1).alias("i")))
    return F.coalesce(F.aggregate(items, F.lit(1), step) > 0, F.lit(False))


def with_evidence_error(df: DataFrame, text: str, titles: list[str], year: Column, names: Column, out: str = "error") -> DataFrame:
    """Adds the first thing that a document lacks as evidence of placements: a title, the year, the names in order with their places."""
    flat = F.col("_flat")
    titled = reduce(lambda x, y: x | y, [F.lower(flat).contains(t.lower()) for t in titles])
    error = F.when(~F.coalesce(titled, F.lit(False)), "WRONG_TOURNAMENT").when(~F.coalesce(flat.contains(year), F.lit(False)), "WRONG_SEASON").when(~placements_named(flat, names), "PLACEMENTS_MISMATCH")
    return df.withColumn("_flat", collapse(nfkc(F.col(text)))).withColumn(out, error).drop("_flat")


def utf8_error(content: Column) -> Column:
    """NOT_UTF8 or BOM of a binary column, else null."""
    return F.when(~F.is_valid_utf8(content.cast("string")), "NOT_UTF8").when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", "BOM")


def placeholder_school(c: Column, phrase: str) -> Column:
    """Whether a school is only a numbered placeholder, ``phrase`` and a number."""
    return F.coalesce(c.startswith(phrase + " ") & F.substring(c, len(phrase) + 2, 2**20).rlike(r"\A\d+\z"), F.lit(False))
