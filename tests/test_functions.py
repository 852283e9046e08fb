import hashlib
import hmac
import unicodedata
from urllib.parse import quote

from pyspark.sql import functions as F

from rankledger.functions import canon, text, time, url


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", make(F.col("v")).alias("o")).orderBy("i").collect()]


def brute_identity(v):
    if v is None:
        return None
    chars, out = list(unicodedata.normalize("NFKC", v.strip()).lower()), ""
    for i, c in enumerate(chars):
        if c == "'":
            near = chars[i - 1] if i else "", chars[i + 1] if i + 1 < len(chars) else ""
            out += c if all(x and unicodedata.category(x)[0] == "L" for x in near) else ""
        elif c.isspace():
            out += " "
        elif unicodedata.category(c)[0] != "P":
            out += c
    return " ".join(out.split()) or None


def test_identity_text_against_brute_force(spark):
    values = [None, "", "  ", "O'Neil", "'tis", "Ann  Lee-Roe", "Ｊａｎｅ Ｄｏｅ.", "José", "a'b'c", "x''y", "ÉCOLE \u3000B", "!!!", "D’Arc", "a_b", "St. Mary's (East)"]
    assert column(spark, values, text.identity_text) == [brute_identity(v) for v in values]


def test_labels_and_placements(spark):
    assert column(spark, ["Quarter-Finals", "Octas", "SF 2", "Finals", "top 8", "Prelim", "", None, "Round of 16"], text.round_stage) == ["quarterfinal", "octafinal", "semifinal", "final", "quarterfinal", None, None, None, "octafinal"]
    assert column(spark, ["1st", " 22ND ", "3", "0", "-1", "x", None, "99999999999"], text.numeric_placement) == [1, 22, 3, None, None, None, None, None]
    assert column(spark, ["1st", "0", "", None, "QF", "prelim", "odd"], lambda c: text.placement_error(c, F.lit(False))) == [None, "INVALID_PLACEMENT", None, None, None, None, "INVALID_PLACEMENT"]
    assert column(spark, ["odd", "0"], lambda c: text.placement_error(c, F.lit(True))) == [None, "INVALID_PLACEMENT"]
    assert column(spark, ["1", "01", " 1", "10", None], text.strict_placement) == [1, None, None, 10, None]


def test_keys_numbers_paths(spark):
    assert column(spark, ["X Extemp (Online)", "IX - In Person", None], text.event_key) == ["x extemp", "ix", None]
    assert column(spark, ["12 34-5", "1234", "１２３４５", "x12345"], text.member_number) == ["12345", None, "12345", None]
    assert column(spark, ["a/b", "/a", "a//b", "../a", "a\\b", "c:/x", "", "a/./b"], text.safe_relative_path) == [True, False, False, False, False, False, False, False]
    values = ["a b", "é&=+", "-_.!~*'()", "100%", "", "/?#"]
    assert column(spark, values, text.encode_component) == [quote(v, safe="-_.!~*'()") for v in values]
    assert column(spark, ["&lt;b&gt; <i>x</i>&#65;&#x42;&amp;nbsp;", None], text.plain_text) == ["<b> x AB&nbsp;", None]
    assert column(spark, ['a,"b', "x\ny", "plain", None], text.csv_field) == ['"a,""b"', '"x\ny"', "plain", None]


def test_similarity_boundary(spark):
    a49, a50 = "a" * 48 + "b", "a" * 49 + "b"
    pairs = [(a49, "a" * 49, False), (a50, "a" * 50, True), (a50, "a" * 48 + "cc", False), ("x", "x", True), ("a" * 99 + "bc", "a" * 101, True), ("a" * 60, "a" * 62, False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", text.similar_98(F.col("a"), F.col("b")).alias("got")).collect())


def test_in_order(spark):
    df = spark.createDataFrame([("one two three", ["one", "three"]), ("one two three", ["three", "one"]), ("a a", ["a", "a"]), ("a", ["a", "a"]), ("x", [])], "t string, p array<string>")
    assert [r[0] for r in df.select(text.in_order(F.col("t"), F.col("p"))).collect()] == [True, False, True, False, True]


def test_dates(spark):
    rows = [("Aug 30 - Sep 1", "2024-25", "2024-08-30 00:00:00", "2024-09-01 23:59:59.999", None), ("Dec 30 to Jan 2", "2024-25", "2024-12-30 00:00:00", "2025-01-02 23:59:59.999", None), ("March 1, 2023 - 3", "2024-25", "2023-03-01 00:00:00", "2023-03-03 23:59:59.999", None),
            ("Feb 30 - 31", "2024-25", None, None, "INVALID_DATE"), ("Foo 1 - 2", "2024-25", None, None, "UNKNOWN_MONTH"), ("May 5 - 4", "2024-25", None, None, "END_BEFORE_START"), ("soon", "2024-25", None, None, "MALFORMED"), ("May 1 - 2", "2024-26", None, None, "INVALID_SEASON"), (None, "2024-25", None, None, "MALFORMED")]
    df = spark.createDataFrame(rows, "t string, s string, a string, b string, e string")
    start, end, error = time.date_range(F.col("t"), F.col("s"))
    for r in df.select("t", "a", "b", "e", start.cast("string").alias("x"), end.cast("string").alias("y"), error.alias("z")).collect():
        assert (r["x"], r["y"], r["z"]) == (r["a"], r["b"], r["e"]), r["t"]
    assert column(spark, ["2024-07-31 23:59:59", "2024-08-01 00:00:00", "1999-12-31 00:00:00"], lambda c: time.season_id(c.cast("timestamp_ntz"))) == ["2023-24", "2024-25", "1999-00"]
    assert column(spark, ["2024-25", "1999-00", "2024-26", "x", None], time.valid_season) == [True, True, False, False, False]


def test_canonical_json_and_hashes(spark):
    df = spark.createDataFrame([(1, ("x", None), [(2, "b")])], "b int, a struct<z:string,y:int>, c array<struct<q:int,p:string>>")
    assert df.select(canon.canonical_json(df)).first()[0] == '{"a":{"y":null,"z":"x"},"b":1,"c":[{"p":"b","q":2}]}'
    empty = df.where("false")
    assert canon.table_hash(empty, ["b"], ["b"]).first()[0] == hashlib.sha256(b"[]").hexdigest()
    many = spark.range(50).withColumn("v", F.col("id") * 2)
    assert canon.table_hash(many, ["id", "v"], ["id"]).first()[0] == canon.table_hash(many.repartition(7).orderBy(F.rand(1)), ["v", "id"], ["id"]).first()[0]
    assert column(spark, ["a", None, "é"], canon.hmac_sha256(b"k")) == [hmac.new(b"k", v.encode(), hashlib.sha256).hexdigest() if v else None for v in ("a", None, "é")]


def test_urls(spark):
    hosts = F.array(F.lit("H.example"))
    assert column(spark, ["https://h.EXAMPLE/a", "http://h.example/", "https://u@h.example/", "https://h.example:443/", "https://x.example/", None, "not a url"], lambda c: url.allowed_source(c, hosts)) == [True, False, False, False, False, False, False]
    assert column(spark, ["https://h/?tourn_id=12", "https://h/?tourn_id=x", "https://h/"], lambda c: url.digits_param(c, "tourn_id")) == ["12", None, None]
