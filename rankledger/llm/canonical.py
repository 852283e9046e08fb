"""One form for text that looks alike: DuckDB inside Arrow partitions.

Each Arrow batch is a DuckDB relation; one embedded SQL statement (``canonical_sql``) maps it:

1. control characters and other spaces become a space, invisible characters go; joiners stay between letters of scripts
   that are written with them (Arabic, Indic and like ones) and between pictographs, variation selectors behind pictographs;
2. compatibility forms (full-width, mathematical, circled letters, ligatures, Roman numeral signs) and small capitals
   become the plain characters; signs that keyboards have (ordinals, fractions, superscripts of Latin-1, trade mark) stay;
3. ``nfc_normalize``: combining marks and jamo join their letters;
4. look-alike letters of other scripts: in a value with Latin letters, a Cyrillic or Greek letter with a Latin twin
   becomes Latin, if all foreign letters of the word have twins. In a word with letters that only Cyrillic (or Greek) has,
   Latin twins become letters of that script, unless it also has letters that only Latin has and at least as many Latin
   letters as others; then its foreign twins become Latin. Words that belong wholly to one script stay as they are.

Typographic quotes and dashes, letter case, accents and repeated spaces are kept. Null stays null, the empty string
stays empty, texts of any length are taken whole, and the mapping applied twice changes nothing more.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame


# Invisible characters, as ranges of code points.
INVISIBLE = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFDD0, 0xFDD2), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE01EF)]
# Characters shown as a space.
SPACES = [(0x09, 0x0D), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x2800, 0x2800), (0x3000, 0x3000)]
# Compatibility characters that are typed as such, and the Hangul letters of keyboards.
TYPED_AS_SUCH = set("ªº²³¹¼½¾´¨¯¸µ…™№€") | {chr(c) for c in range(0x3131, 0x318F)}
# Letters of other scripts and their Latin twins, by the usual printed shapes (no table of confusables was at hand).
CYRILLIC_TWINS = ("АВЕЅІЈКМНОРСТУХЁЇԌԚԜһаеѕіјорсухԁԛԝёїӏѵ", "ABESIJKMHOPCTYXËÏGQWhaesijopcyxdqwëïlv")
GREEK_TWINS = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿοναικρυάίόϲϳ", "ABEZHIKMNOPTYXCJovaikpuáíócj")
OTHER_TWINS = ("ɑɡɩǀօսհոᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ‐‑−⁃", "agilouhnABCDEHJKLMPRSTVWZ----")
# Letters in the shape of small capitals.
SMALL_CAPITALS = ("ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "ABCDEFGHIJKLMNOPRSTUVWYZ")
# Scripts that are written with joiners, pictographs, and what may stand between them and a joiner.
JOINING = [(0x600, 0x8FF), (0x900, 0xDFF), (0x1000, 0x109F), (0x1780, 0x18AF), (0x2190, 0x2BFF), (0x3030, 0x303D), (0xFB50, 0xFDCF), (0xFDD2, 0xFDD2), (0xFE70, 0xFEFE), (0x1F000, 0x1FAFF)]
#: Code points that are no characters, in the place of joiners and selectors that stay.
KEPT = {0x200C: 0xFDD0, 0x200D: 0xFDD1, 0xFE0F: 0xFDD2}


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@cache
def compatibility_forms() -> tuple[tuple[str, str], tuple[tuple[str, str], ...]]:
    """By rule: every letter, number, punctuation or symbol with a compatibility decomposition, and its plain form.

    (from, to) of single characters, and the pairs whose plain form is several characters (letters and numbers only).
    """
    skip = {c for a, b in (*INVISIBLE, *SPACES) for c in range(a, b + 1)}
    one, many = list(zip(*SMALL_CAPITALS)), []
    for cp in (*range(0xA0, 0x3400), *range(0xA640, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F170)):
        ch = chr(cp)
        if cp in skip or ch in TYPED_AS_SUCH or ch in GREEK_TWINS[0] or not unicodedata.decomposition(ch).startswith("<") or unicodedata.category(ch)[0] not in "LNPS":
            continue
        plain = unicodedata.normalize("NFKC", ch)
        if len(plain) == 1:
            one.append((ch, plain))
        elif plain.isalnum() and plain.isascii():
            many.append((ch, plain))
    return ("".join(a for a, _ in one), "".join(b for _, b in one)), tuple(many)


def _twin_sql() -> str:
    """The form of a word t of a value _v3 that has Latin letters and foreign ones."""
    latin = "[A-Za-z\\x{C0}-\\x{24F}]"
    cyr, lat_c = CYRILLIC_TWINS
    gre, lat_g = GREEK_TWINS
    without = lambda text, letters: f"translate({text}, {_quote(letters)}, {_quote(' ' * len(letters))})"
    count = lambda letters: f"length(regexp_replace(t, '[^{letters[1:-1]}]', '', 'g'))"
    to_latin = f"translate(t, {_quote(cyr + gre + OTHER_TWINS[0])}, {_quote(lat_c + lat_g + OTHER_TWINS[1])})"

    def belongs(script: str, own: str, own_latin: str) -> str:
        only_own = lambda text: f"regexp_matches({without(text, own)}, '{script}')"
        word = f"({only_own('t')} AND NOT (regexp_matches({without('t', own_latin)}, '{latin}') AND {count(latin)} >= {count(script)}))"
        return f"regexp_matches(_v3, '{script}') AND ({word} OR ({only_own('_v3')} AND NOT regexp_matches({without('_v3', lat_c + lat_g)}, '[A-Za-z]')))"

    back = lambda own, own_latin, other, other_latin: f"translate(translate(t, {_quote(other)}, {_quote(other_latin)}), {_quote(own_latin)}, {_quote(own)})"
    return f"""CASE WHEN {belongs(CYRILLIC, cyr, lat_c)} THEN {back(cyr, lat_c, gre, lat_g)}
      WHEN {belongs(GREEK, gre, lat_g)} THEN {back(gre, lat_g, cyr, lat_c)}
      ELSE {to_latin} END"""


def _joiners_sql(value: str) -> str:
    """``value`` with the joiners and selectors that stay replaced by KEPT."""
    beside = f"[{_class(JOINING)}]"
    done = f"regexp_replace({value}, '[{_class([(min(KEPT.values()), max(KEPT.values()))])}]', '', 'g')"
    for left, (char, to) in zip(("[\\p{So}0-9#*]", beside, beside), sorted(KEPT.items(), reverse=True)):
        done = f"regexp_replace({done}, '({left})\\x{{{char:X}}}', '\\1' || chr({to}), 'g')"
    done = f"regexp_replace({done}, '[\\x{{{KEPT[0x200C]:X}}}\\x{{{KEPT[0x200D]:X}}}]+([^{_class(JOINING)}]|$)', '\\1', 'g')"
    return f"CASE WHEN regexp_matches({value}, '[\\x{{200C}}\\x{{200D}}\\x{{FE0F}}{_class([(min(KEPT.values()), max(KEPT.values()))])}]') THEN {done} ELSE {value} END"


# Letters of the two scripts.
CYRILLIC, GREEK = "[\\x{400}-\\x{52F}]", "[\\x{370}-\\x{3FF}]"


@cache
def canonical_sql(relation: str, value: str = "value", out: str = "form") -> str:
    """SELECT of ``relation`` with the canonical form of column ``value`` added as ``out``."""
    (source, target), many = compatibility_forms()
    plain = "_v1"
    for ch, text in many:
        plain = f"replace({plain}, {_quote(ch)}, {_quote(text)})"
    any_compat = f"[{''.join(f'{chr(92)}x{{{ord(c):X}}}' for c in source)}{''.join(f'{chr(92)}x{{{ord(c):X}}}' for c, _ in many)}]"
    foreign = "[\\x{1C0}\\x{251}\\x{261}\\x{269}\\x{370}-\\x{3FF}\\x{400}-\\x{58F}\\x{13A0}-\\x{13F4}\\x{2010}\\x{2011}\\x{2212}\\x{2043}]"
    ascii_only = "'[ -~]*'"
    kept, back = "".join(map(chr, KEPT.values())), "".join(map(chr, KEPT))
    gone = [r for r in INVISIBLE if r[0] != min(KEPT.values())]  # those that stand for a kept joiner are no longer in the text otherwise
    visible = f"regexp_replace(regexp_replace(_v0, '[{_class(SPACES)}]', ' ', 'g'), '[{_class(gone)}]', '', 'g')"
    sigma = "CASE WHEN regexp_matches(_v4, '[\\x{3F2}\\x{3F9}]') THEN translate(regexp_replace(_v4, '\\x{3F2}(\\P{L}|$)', chr(962) || '\\1', 'g'), chr(1010) || chr(1017), chr(963) || chr(931)) ELSE _v4 END"
    return f"""SELECT * EXCLUDE (_v0, _v1, _v3, _v4), CASE WHEN {value} IS NULL THEN NULL WHEN regexp_full_match({value}, {ascii_only}) THEN {value} ELSE {sigma} END AS {out}
    FROM (SELECT *, CASE WHEN regexp_matches(_v3, '{foreign}') AND regexp_matches(_v3, '[A-Za-z\\x{{C0}}-\\x{{24F}}]')
      THEN nfc_normalize(array_to_string(list_transform(string_split(_v3, ' '), lambda t: {_twin_sql()}), ' ')) ELSE _v3 END AS _v4
    FROM (SELECT *, translate(nfc_normalize(CASE WHEN regexp_matches(_v1, '{any_compat}') THEN translate({plain}, {_quote(source)}, {_quote(target)}) ELSE _v1 END), {_quote(kept)}, {_quote(back)}) AS _v3
    FROM (SELECT *, CASE WHEN regexp_full_match({value}, {ascii_only}) THEN {value} ELSE {visible} END AS _v1
    FROM (SELECT *, CASE WHEN regexp_full_match({value}, {ascii_only}) THEN {value} ELSE {_joiners_sql(value)} END AS _v0 FROM {relation}))))"""


def add_form(df: DataFrame, value: str, out: str = "form", extra: str | None = None) -> DataFrame:
    """``df`` with the canonical form of a text column; extra is more SQL on that form, named ``<out>_extra``.

    Rows stay in their partitions; a batch is handed to DuckDB as it comes. Other columns of these names are replaced.
    """
    if out == value:
        raise ValueError("the form needs a name of its own")
    df = df.drop(*[c for c in (out, f"{out}_extra") if c in df.columns and c != value])
    carried = [c for c in df.columns]
    names = {c: f"c{i}" for i, c in enumerate(carried)}
    sql = canonical_sql("batch", names[value], "form")
    if extra:
        sql = f"SELECT *, {extra.replace('{form}', 'form')} AS form_extra FROM ({sql})"
    schema = [f"`{c.replace('`', '``')}` {t}" for c, t in df.dtypes] + [f"{out} string"] + ([f"{out}_extra string"] if extra else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        for b in batches:
            batch = pa.Table.from_batches([b]).rename_columns([names[c] for c in carried])  # noqa: F841 - the SQL reads it
            con.register("batch", batch)
            done = con.sql(sql).to_arrow_table()
            yield from done.rename_columns(carried + [out] + ([f"{out}_extra"] if extra else [])).to_batches()
            con.unregister("batch")

    return df.mapInArrow(run, ", ".join(schema))


def not_plain_ascii(column) -> Column:
    """A cheap filter on the JVM's side: printable ASCII is its own canonical form."""
    return ~column.rlike(r"\A[\x20-\x7E]*\z")
