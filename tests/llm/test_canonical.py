import unicodedata

from rankledger.llm.canonical import add_form, not_plain_ascii

CASES = {
    "Plain O'Neil-Smith": None, "José Núñez": None, "Søren Łukasz": None, "Павел Хромайский": None, "Γιώργος": None, "김다솔": None, "佐々木": None, "The “Open”": None, "O’Hara": None, "": None, "  two  spaces ": None, "IVAN Öz": None,
    "Ｊａｎｅ": "Jane", "Jóse": "Jóse", "a b": "a b", "a　b": "a b", "Mi​ke": "Mike", "so­ft": "soft", "Саm": "Cam", "Vеra Н Smith": "Vera H Smith", "ﬁeld": "field", "𝐑𝐚𝐯𝐢": "Ravi", "Οrlο": "Orlo",
    "Тaрвелин": "Тарвелин", "가": "가", "Jo﻿hn": "John", "Coop Ⅷ": "Coop VIII", "Καλoς": "Καλος",
    "ϲat": "cat", "ϲοφόϲ": "σοφός", "Ϲat": "Cat", "ɑвbey": "aвbey", "Дaвid Brown": "Давіԁ Brown", "ᴊᴀɴᴇ": "JANE", "ǀsaac": "lsaac", "A\u3164b": "Ab", "A\u2800b": "A b", "A\u115fb": "Ab",
    "می\u200cخواهم": None, "क्\u200dष": None, "\U0001f469\u200d\u2764\ufe0f\u200d\U0001f468": None, "می\u200c": "می", "a\u200db": "ab", "\u200dक": "क", "x\ufe0f": "x", "a\ufdd0b": "ab", "김\u200d다": "김다",
}


def test_cases_null_and_clashing_columns(spark):
    rows = [(i, v, "keep", "c") for i, v in enumerate([None, *CASES])]
    df = spark.createDataFrame(rows, "k int, value string, c1 string, _v1 string")
    got = {r["k"]: (r["value"], r["form"], r["c1"], r["_v1"]) for r in add_form(df, "value").collect()}
    assert got[0] == (None, None, "keep", "c")
    for i, (v, want) in enumerate(CASES.items(), 1):
        assert got[i] == (v, v if want is None else want, "keep", "c"), ascii(v)


def test_idempotent_and_long(spark):
    long = "Ａb " * 50_000
    df = spark.createDataFrame([(v,) for v in [*CASES, long]], "value string")
    once = add_form(df, "value").select("form")
    twice = add_form(once.withColumnRenamed("form", "value"), "value").collect()
    assert all(r["value"] == r["form"] for r in twice)
    assert any(r["form"] == "Ab " * 50_000 for r in twice)


def test_full_width_agrees_with_nfkc(spark):
    text = [chr(c) for c in range(0xFF01, 0xFF5F)] + [chr(c) for c in range(0x1D400, 0x1D454)]
    df = spark.createDataFrame([(t,) for t in text], "value string")
    assert all(r["form"] == unicodedata.normalize("NFKC", r["value"]) for r in add_form(df, "value").collect())


def test_empty(spark):
    assert add_form(spark.createDataFrame([], "value string"), "value").collect() == []


def test_a_final_line_end_is_not_plain(spark):
    values = ["Ann Lee", "", *("Ann Lee" + end for end in ("\n", "\r", "\r\n", "\x85", "\u2028", "\u2029"))]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert {r["value"] for r in df.where(not_plain_ascii(df["value"])).collect()} == set(values[2:])


def test_a_column_of_the_result_is_replaced(spark):
    got = add_form(spark.createDataFrame([("Ａ", "old", "x")], "value string, form string, form_extra string"), "value", extra="upper({form})").collect()
    assert [r.asDict() for r in got] == [{"value": "Ａ", "form": "A", "form_extra": "A"}]
