"""Names of persons and schools as words: folding, abbreviations, nicknames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .canonical import add_form
from .variants import best_in_columns, best_in_rows, edit_similarity, monge_elkan, word_matrix

#: DuckDB SQL on the canonical form: lower case, no accents or apostrophes, letters, digits and full stops kept.
FOLD = "trim(regexp_replace(replace(replace(translate(strip_accents(lower({form})), 'øłđ''’‘`´', 'old'), 'æ', 'ae'), 'ß', 'ss'), '[^\\p{L}\\p{N}.]+', ' ', 'g'))"

# Kinds of schools, places in school names, and their abbreviations.
KINDS = ["senior", "high", "secondary", "preparatory", "charter", "collegiate", "academy", "day", "elementary", "middle", "college", "institute", "grammar", "technical", "catholic", "christian", "international", "community", "regional", "county", "central", "magnet"]
PLACES = ["heights", "springs", "valley", "ridge", "grove", "junction", "crossing", "harbor", "mountain", "meadows", "prairie", "point", "park", "hills", "lake", "river", "creek", "island", "village", "beach", "forest", "city"]
ABBREVIATIONS = {
    "hs": "high", "hi": "high", "sr": "senior", "snr": "senior", "shs": "senior high", "srhs": "senior high", "ss": "secondary", "sec": "secondary", "prep": "preparatory", "pr": "prairie", "chtr": "charter", "cs": "charter", "coll": "collegiate",
    "acad": "academy", "acdmy": "academy", "ds": "day", "elem": "elementary", "intl": "international", "tech": "technical", "comm": "community", "hts": "heights", "hgts": "heights", "spgs": "springs", "sprgs": "springs", "spg": "springs", "vly": "valley", "val": "valley",
    "rdg": "ridge", "grv": "grove", "jct": "junction", "junc": "junction", "xing": "crossing", "crssng": "crossing", "crsg": "crossing", "hbr": "harbor", "harbour": "harbor", "mt": "mountain", "mtn": "mountain", "mdws": "meadows", "meadow": "meadows", "prarie": "prairie", "pt": "point", "pointe": "point",
}
FILLERS = ["the", "of", "at", "school", "sch", "schl", "team", "varsity", "jv", "novice", "east", "west", "north", "south"]
# Forms of address and generation marks.
TITLES = ["mr", "mrs", "ms", "mx", "miss", "dr", "prof", "sir", "capt", "captain", "coach", "jr", "sr", "ii", "iii", "iv", "esq", "rev", "hon"]
# Short forms of given names.
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex al sandy xander lex sasha", "alexandra": "alex sandra lexi sandy alexa sasha", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben benny benji", "bernadette": "bernie detta", "bradley": "brad", "cameron": "cam", "cassandra": "cass cassie sandra",
    "catherine": "cathy kate cat katie cate", "charles": "charlie chuck chas", "charlotte": "charlie lottie char", "christina": "chris tina christy chrissy", "christopher": "chris topher kit", "constance": "connie", "daniel": "dan danny", "david": "dave davey", "deborah": "deb debbie", "dmitri": "dima mitya",
    "dorothy": "dot dottie dory", "edward": "ed eddie ted ned teddy", "eleanor": "ellie nell nora ella", "elizabeth": "liz beth lizzie eliza betty betsy libby", "emmanuel": "manny manu", "ezekiel": "zeke", "florence": "flo florrie flossie", "francesca": "fran frankie chess", "frederick": "fred freddie rick freddy",
    "gabriel": "gabe", "genevieve": "gen evie viv", "gerald": "gerry jerry", "gregory": "greg", "gwendolyn": "gwen wendy", "harold": "hal harry", "henrietta": "etta hettie hetty", "isabella": "bella izzy isa", "jacqueline": "jackie jacqui", "james": "jim jimmy jamie", "jeffrey": "jeff", "jennifer": "jen jenny", "jessica": "jess jessie",
    "jonathan": "jon jonny nathan", "joseph": "joe joey", "josephine": "jo josie", "joshua": "josh", "jose": "pepe", "judith": "judy jude", "katherine": "kathy kate katie kat kit", "kenneth": "ken kenny", "kimberly": "kim", "lawrence": "larry lawrie laurie", "leonard": "len lenny leo", "lillian": "lil lily lilly", "madeleine": "maddie maddy",
    "margaret": "maggie meg peggy marge margie", "matthew": "matt matty", "maximilian": "max", "melissa": "mel missy lissa", "michael": "mike mick mickey", "miranda": "mira randi mandy", "nathaniel": "nate nat nathan", "nicholas": "nick nicky nico", "oliver": "ollie", "olivia": "liv livvy ollie", "pamela": "pam", "patricia": "pat patty tricia trish", "patrick": "pat paddy", "penelope": "penny nell",
    "philip": "phil pip", "priscilla": "cilla prissy", "quentin": "quin quinn", "rebecca": "becky becca", "reginald": "reg reggie", "richard": "rick dick rich ricky", "robert": "rob bob bobby robbie bert", "roberta": "bobbie robbie bobby", "rosemary": "rose rosie romy", "samantha": "sam sammy sammie", "samuel": "sam sammy sammie", "sebastian": "seb bas",
    "stephanie": "steph stevie", "stephen": "steve steph", "susannah": "sue susie suzie anna", "tabitha": "tabby", "theodore": "ted theo teddy", "theresa": "terry tess tessa", "thomas": "tom tommy", "timothy": "tim timmy", "valentina": "val tina", "veronica": "ronnie vera roni", "victoria": "vicky tori vic", "vikram": "vik", "vincent": "vince vinny vin",
    "walter": "walt wally", "wilhelmina": "mina billie willa", "william": "will bill billy liam", "winifred": "winnie fred freddie", "zachary": "zach zack zac", "nadia": "nadya", "leila": "lee", "lukasz": "luke luki",
}


def folded(strings: DataFrame, value: str) -> DataFrame:
    """Distinct non-null values with their folded form ``fold``."""
    distinct = strings.select(F.col(value).alias("value")).where("value IS NOT NULL").distinct()
    return add_form(distinct, "value", extra=FOLD).select("value", F.col("form_extra").alias("fold"))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _nearest(word: Column, vocabulary: list[str]) -> Column:
    """The listed word that ``word`` is, or is one slip away from if both are long; else null."""
    known = F.array(*[F.lit(v) for v in vocabulary])
    long = F.array(*[F.lit(v) for v in vocabulary if len(v) >= 5])
    near = F.filter(long, lambda v: (F.abs(F.length(word) - F.length(v)) <= 1) & (F.levenshtein(word, v, 2) >= 0) & (edit_similarity(word, v) >= 1 - 1.01 / F.greatest(F.length(word), F.length(v))))
    return F.when(F.array_contains(known, word), word).when(F.length(word) >= 5, F.element_at(F.concat(near, F.array(F.lit(None).cast("string"))), 1))


def school_words(schools: DataFrame) -> DataFrame:
    """(value, node) of (value, fold): the own name, written together, then place and kind words; a node without own name begins with a space or is empty."""
    s = F.concat(F.lit(" "), F.regexp_replace(F.col("fold"), r"\.", ""), F.lit(" "))
    for pattern, to in ((r" h s(?= )", " hs"), (r" s h s(?= )", " shs"), (r" hi sch(?= )", " high"), (r" sr h s(?= )", " shs"), (r" dist(rict)? \d+(?= )", ""), (r" \d+ team(?= )", ""), (r" no \d+(?= )", "")):
        s = F.regexp_replace(s, pattern, to)
    abbreviations = _literal_map(ABBREVIATIONS)
    words = F.filter(F.split(F.trim(s), r"\s+"), lambda w: (w != "") & ~w.isin(FILLERS))
    words = F.flatten(F.transform(words, lambda w: F.split(F.coalesce(F.try_element_at(abbreviations, w), w), " ")))
    out = schools.withColumn("_w", F.transform(words, lambda w: F.struct(w.alias("w"), _nearest(w, KINDS + PLACES + ["school"]).alias("m"))))
    core = F.concat_ws("", F.transform(F.filter("_w", lambda x: x.m.isNull()), lambda x: x.w))
    marks = F.array_sort(F.array_distinct(F.filter(F.transform("_w", lambda x: x.m), lambda m: m.isNotNull() & (m != "school"))))
    return out.select("value", F.concat_ws(" ", F.array(core), marks).alias("node"))


def marks_of(words: Column) -> tuple[Column, Column]:
    """The places and the kinds among a school's words."""
    return F.filter(words, lambda w: w.isin(PLACES)), F.filter(words, lambda w: w.isin(KINDS))


def with_school_scores(pairs: DataFrame, words: str, marks: str, listed: str, listed_marks: str) -> DataFrame:
    """``pairs`` with the Monge-Elkan ``score`` of two schools' words; words that the spelling leaves out weigh less than words that differ.

    0 if both name places, or both name kinds, and share none: such schools are neighbours, not variants. marks are
    structs of ``marks_of``.
    """
    of = lambda marks, kind: F.col(f"{marks}.{kind}")
    apart = lambda kind: (F.size(of(marks, kind)) > 0) & (F.size(of(listed_marks, kind)) > 0) & ~F.arrays_overlap(of(marks, kind), of(listed_marks, kind))
    a, b = F.split(words, " "), F.split(listed, " ")
    word = lambda x, y: F.when(x == y, 1.0).otherwise(edit_similarity(x, y))
    size = lambda x: F.length(x).cast("double")
    rows = pairs.withColumn("_m", F.when((F.col(words) != F.col(listed)) & ~apart("places") & ~apart("kinds"), word_matrix(a, b, word)))
    found = 0.8 * monge_elkan(best_in_rows("_m"), a, size) + 0.2 * monge_elkan(best_in_columns("_m"), b, size)
    return rows.withColumn("score", F.when(F.col(words) == F.col(listed), 1.0).when(F.col("_m").isNull(), 0.0).otherwise(found)).drop("_m")


def person_words(names: DataFrame) -> DataFrame:
    """(value, person) of (value, fold): the words without titles; an empty person if there is none."""
    words = F.filter(F.split(F.trim(F.regexp_replace(F.col("fold"), r"\.", " ")), r"\s+"), lambda w: (w != "") & ~w.isin(TITLES))
    return names.select("value", F.concat_ws(" ", words).alias("person"))


def person_parts(person: Column) -> Column:
    """The words t of a person, each with the full names f that it may be short for."""
    full: dict[str, str] = {}
    for formal, shorts in NICKNAMES.items():
        for s in shorts.split():
            full[s] = f"{full[s]} {formal}" if s in full else formal
    formals = _literal_map(full)
    return F.transform(F.split(person, " "), lambda w: F.struct(w.alias("t"), F.split(F.coalesce(F.try_element_at(formals, w), F.lit("")), " ").alias("f")))


def all_words(parts: Column) -> Column:
    """The words by which a person is found: those of the parts, the full names, and every two neighbouring words written as one."""
    words = F.transform(parts, lambda p: p.t)
    full = F.filter(F.flatten(F.transform(parts, lambda p: p.f)), lambda w: w != "")
    together = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda x, y: F.concat(x, y))
    return F.array_distinct(F.concat(words, full, together))


def _name_part(x: Column, y: Column) -> Column:
    short = F.array_contains(x.f, y.t) | F.array_contains(y.f, x.t)
    begins = (F.least(F.length(x.t), F.length(y.t)) >= 5) & (x.t.startswith(y.t) | y.t.startswith(x.t))
    initial = (F.length(x.t) == 1) | (F.length(y.t) == 1)
    return F.when(x.t == y.t, 1.0).when(short, 0.97).when(initial, F.when(F.substring(x.t, 1, 1) == F.substring(y.t, 1, 1), 0.9).otherwise(0.0)).when(begins, 0.92).otherwise(edit_similarity(x.t, y.t))


#: Least similarity of some part of a spelling to the given name of the listed person.
LEAST_GIVEN = 0.6


def with_person_scores(pairs: DataFrame, person: str, parts: str, listed: str, listed_parts: str) -> DataFrame:
    """``pairs`` with the Monge-Elkan ``score`` of name parts; listed parts that the spelling leaves out weigh less.

    0 if no part of the spelling can be the listed given name, which comes first: kin share a school and a surname.
    """
    size = lambda x: F.length(x.t).cast("double")
    rows = pairs.withColumn("_m", F.when(F.col(person) != F.col(listed), word_matrix(F.col(parts), F.col(listed_parts), _name_part)))
    given = F.array_max(F.transform("_m", lambda row: F.element_at(row, 1)))
    found = 0.75 * monge_elkan(best_in_rows("_m"), F.col(parts), size) + 0.25 * monge_elkan(best_in_columns("_m"), F.col(listed_parts), size)
    return rows.withColumn("score", F.when(F.col(person) == F.col(listed), 1.0).when(given >= LEAST_GIVEN, found).otherwise(0.0)).drop("_m")
