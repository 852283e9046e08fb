import json

import pytest
from pyspark.sql import functions as F

from rankledger.sources import archives, calendar, documents, pdf_rows, provider

ALIASES = {"competitor": ["competitor", "name"], "school": ["school"], "place": ["place", "rank"], "stage": ["stage", "round"]}
HEAD = ["Name", "School", "Place", "Stage"]
BODY = [["Ann Lee", 'North "A", High', "1", "final"], ["Bo Roe", "East", "2", "final"], ["Cy Doe", "West", "", "semifinal"]]


def html(rows, attrs='id="results"'):
    line = lambda cells, t: "<tr>" + "".join(f"<{t}>{c}</{t}>" for c in cells) + "</tr>"
    return f"<p>x</p><table id='other'><tbody><tr><td>1</td></tr></tbody></table><table {attrs}><thead>{line(HEAD, 'th')}</thead><tbody>{''.join(line(r, 'td') for r in rows)}</tbody></table>"


def as_csv(rows):
    quote = lambda c: '"' + c.replace('"', '""') + '"'
    return "\r\n".join(",".join(map(quote, r)) for r in [HEAD, *rows])


def test_formats_agree(spark):
    make = lambda body: spark.createDataFrame([("d1", body)], "id string, body string")
    got = []
    for t in (documents.csv_tables(make(as_csv(BODY)), "id", "body"), documents.html_tables(make(html(BODY)), "id", "body", "results"), documents.json_tables(make(json.dumps({"rows": [HEAD, *BODY], "x": [["1"]]})), "id", "body", "rows")):
        rows = documents.document_results(documents.map_columns(t, ALIASES), "m1").orderBy("row_no").collect()
        got.append([r.asDict() for r in rows])
    assert got[0] == got[1] == got[2]
    assert [(r["published_name"], r["placement"], r["furthest_stage"], r["won_final_round"], r["error"]) for r in got[0]] == [("Ann Lee", 1, "final", True, None), ("Bo Roe", 2, "final", False, None), ("Cy Doe", None, "semifinal", False, None)]
    assert got[0][0]["source_entry_id"] == "document:m1:d1:Ann%20Lee:North%20%22A%22%2C%20High"


@pytest.mark.parametrize("body, code", [
    ("<p>none</p>", "SELECTOR_NOT_FOUND"), (html(BODY) + html(BODY), "SELECTOR_AMBIGUOUS"), ("<div id='results'></div>", "SELECTOR_NOT_TABLE"), (html(BODY, "id='results' hidden"), "HTML_UNSAFE_CONTENT"),
    (html([["<script>x</script>", "a", "1", "final"]]), "HTML_UNSAFE_CONTENT"), (html(BODY).replace("<tbody><tr><td>Ann", "<tbody><tr><th>Q</th><td>Ann"), "TABLE_INVALID"), ("<table id='results'><tbody></tbody></table>", "HEADER_ROW_COUNT"),
])
def test_html_errors(spark, body, code):
    got = documents.html_tables(spark.createDataFrame([("d", body), ("e", None)], "id string, body string"), "id", "body", "results").collect()
    assert {r["id"]: r["error"] for r in got} == {"d": code, "e": "SELECTOR_NOT_FOUND"}


def test_csv_and_header_errors(spark):
    df = spark.createDataFrame([("bom", "﻿a,b"), ("ragged", "a,b\n1"), ("extra", "Name,School,Place,Stage,More\n1,2,3,4,5"), ("twice", "Name,Competitor,School,Place,Stage\na,b,c,1,final"), ("none", None)], "id string, body string")
    t = documents.csv_tables(df, "id", "body")
    assert {r["id"]: r["error"] for r in t.where("error IS NOT NULL").collect()} == {"bom": "BOM", "ragged": "RAGGED", "none": "RAGGED"}
    assert {r["id"]: r["error"] for r in documents.map_columns(t, ALIASES).collect()} == {"bom": "BOM", "ragged": "RAGGED", "none": "RAGGED", "extra": "EXTRA_COLUMN", "twice": "COLUMN_competitor"}


def export():
    entry = lambda i, ev, s: {"id": i, "event": ev, "students": [s], "name": f"Entry {i}"}
    return {
        "id": 1, "extra": {"x": 1}, "categories": [{"id": 10, "events": [{
            "id": 100, "name": "IX", "rounds": [
                {"id": "r1", "label": "Quarterfinals", "sections": [{"id": 1, "round": "r1", "ballots": [{"entry": i} for i in (1, 2, 3, 4)]}]},
                {"id": "r2", "label": None, "type": "final", "sections": [{"id": 2, "round": "r2", "ballots": [{"entry": 1, "scores": [{"tag": "Rank", "value": 1}]}, {"entry": 2, "scores": [{"tag": "rank", "value": 2}]}]}]}],
            "result_sets": [
                {"label": "Final Places", "tag": "final", "bracket": 0, "published": True, "results": [{"entry": 1, "place": "1st", "round": "r2"}, {"entry": 2, "place": 2, "round": "r2"}, {"entry": 3, "place": "prelim"}, {"entry": 4, "place": "9"}, {"entry": 5, "place": "3"}, {"entry": 99, "place": "4"}, {"entry": 6, "place": "1", "round": "nowhere"}]},
                {"label": "Final Places", "published": 0, "results": []}, {"label": "Other", "published": 1, "results": []}],
        }]}],
        "schools": [{"id": 7, "name": "North", "entries": [entry(1, 100, "s1"), entry(2, 100, "s2"), entry(3, 100, "s3"), entry(4, 100, "s4"), entry(5, 100, "s9"), entry(6, 100, "s4")], "students": [{"id": f"s{i}", "first": "A", "last": "B"} for i in range(1, 5)]}],
    }


def test_provider_export(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps(export(), indent=1))
    e = provider.read_export(spark, str(tmp_path))
    rules = spark.createDataFrame([("10", "100", "lin", "ix", ["Final Places"])], "category_id string, event_id string, lineage_id string, division string, labels array<string>")
    results, errors = provider.normalize(e, rules)
    assert sorted((r["source_entry_id"], r["placement"], r["furthest_stage"], r["explicit_final"], r["won_final_round"]) for r in results.collect()) == [
        ("provider:entry:1", 1, "final", True, True), ("provider:entry:2", 2, "final", True, False), ("provider:entry:4", 9, "quarterfinal", True, False)]
    assert sorted((r["entry_id"], r["code"]) for r in errors.collect()) == [("5", "MISSING_PERSON"), ("6", "UNKNOWN_ROUND_LABEL"), ("99", "MISSING_ENTRY")]
    winners, bad = provider.final_winners(e)
    assert [(r["event_id"], r["entry_id"], r["total"]) for r in winners.collect()] == [("100", "1", 1)] and bad.count() == 0
    assert provider.duplicate_ids(e).count() == 0
    assert provider.compact(e, F.col("event_name") == "IX").count() == 6
    again = provider.parse_exports(spark.createDataFrame([(1, json.dumps(export()))], "k int, body string"), "body")
    assert provider.entries(again).count() == 6


def test_calendar(spark):
    page = "<a href='/index/tourn/index.mhtml?tourn_id=5'>First &amp; <b>best</b></a> <A HREF=\"https://h.example/x?tourn_id=5\">again</A><a href='http://h.example/x?tourn_id=6'>plain</a><a href='https://other.example/?tourn_id=7'>o</a><a href='/y?tourn_id=8x'>n</a><a href='/z?tourn_id=9'> </a>"
    got = calendar.calendar_entries(spark.createDataFrame([(1, page), (2, None), (3, "")], "p int, html string"), "p", "html", "h.example").collect()
    assert [(r["id"], r["tournament"], r["title"]) for r in got] == [(1, "5", "First & best")]
    got = calendar.details(spark.createDataFrame([(1, "<h1></h1><h2 data-x='St. John&#39;s'>Two</h2>"), (2, "<title>T</title><p data-x=1></p><p data-x=2>"), (3, ""), (4, "<h1>A</h1><i data-x='a&lt;b'>"), (5, None)], "p int, h string"), "p", "h", ["data-x"]).collect()
    assert sorted((r["id"], r["title"], r["data_x"], r["error"]) for r in got) == [(1, "Two", "St. John's", None), (2, "T", None, "DUPLICATE_ATTRIBUTE"), (3, None, None, "MISSING_TITLE"), (4, "A", "a<b", "UNSAFE_ATTRIBUTE"), (5, None, None, "MISSING_TITLE")]


def test_quotes_in_links_and_known_titles(spark):
    page = "<a href=\"/t?tourn_id=5&n=St.John's\">St. John&rsquo;s</a><a href='/t?tourn_id=6'>The <b>OPEN</b></a><a href=/t?tourn_id=7>Other<a href='/t?tourn_id=8'>the open!"
    df = spark.createDataFrame([(1, page)], "p int, html string")
    got = calendar.calendar_entries(df, "p", "html", "h.example").collect()
    assert sorted((r["tournament"], r["href"]) for r in got) == [("5", "https://h.example/t?tourn_id=5&n=St.John's"), ("6", "https://h.example/t?tourn_id=6"), ("7", "https://h.example/t?tourn_id=7")]
    known = spark.createDataFrame([("the-open",), (None,)], "title string")
    assert [r["tournament"] for r in calendar.calendar_entries(df, "p", "html", "h.example", titles=known).collect()] == ["6"]


def item(doc, text, x, y, w=1.0, page=1):
    return (doc, page, text, float(x), float(y), float(w))


def test_pdf_rows(spark):
    rows = [item("a", "B", 10, 99.5), item("a", "A", 1, 100), item("a", "C", 1, 90), item("a", "D", 1, 100, page=2),
            item("amb", "1", 1, 100), item("amb", "2", 5, 98.5), item("amb", "3", 9, 97), item("over", "1", 1, 50, 9), item("over", "2", 5, 50), item("nan", "1", float("nan"), 5)]
    df = spark.createDataFrame(rows, "document string, page_number int, text string, x double, y double, width double")
    got = {(r["document"], r["page_number"], r["row_no"]): (r["cells"], r["error"]) for r in pdf_rows.cluster_rows(df).collect()}
    assert got == {("a", 1, 0): (["A", "B"], None), ("a", 1, 1): (["C"], None), ("a", 2, 0): (["D"], None), ("amb", 1, None): (None, "AMBIGUOUS_ROW"), ("over", 1, None): (None, "OVERLAPPING_TEXT"), ("nan", 1, None): (None, "INVALID_POSITION")}
    table = spark.createDataFrame([("d", 1, 0, 9.0, ["x"], None), ("d", 1, 1, 8.0, ["N", "P"], None), ("d", 1, 2, 7.0, ["a", "1"], None), ("d", 2, 0, 9.0, ["b", "2"], None), ("d", 2, 1, 8.0, ["foot"], None), ("d", 2, 2, 8.0, ["c", "3"], None)], pdf_rows.ROWS)
    assert [(r["cells"], r["last_of_block"]) for r in pdf_rows.table_block(table, ["N", "P"]).orderBy("page_number", "row_no").collect()] == [(["a", "1"], False), (["b", "2"], True)]


def test_files_and_archive(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/one.json").write_text('{\n"season": "2020-21", "policy": "p", "standings": [{"rank": 1, "name": "A", "points": 5}]}')
    (tmp_path / "big.bin").write_bytes(b"x" * 100)
    assert [(r["rank"], r["name"], r["wins"]) for r in archives.read_archive(spark, str(tmp_path / "a")).collect()] == [(1, "A", None)]
    assert documents.read_manifests(spark, str(tmp_path), "season string").count() == 1
    assert documents.read_blobs(spark, str(tmp_path), 50).where("path LIKE '%big%'").count() == 0
    wide = spark.createDataFrame([("A", 8, 5, 3), ("B", 9, 5, None), ("C", None, None, None)], "name string, total int, t1 int, t2 int")
    assert [r["name"] for r in archives.season_errors(wide, ["name", "total"], "name", "total").collect()] == ["B"]
    assert [r["r"] for r in spark.createDataFrame([("T12",), ("3",), ("x",)], "c string").select(archives.parse_rank(F.col("c")).alias("r")).collect()] == [12, 3, None]
    (tmp_path / "t.csv").write_text('a,b\n"x ""y""",2\n')
    assert documents.read_csv(spark, str(tmp_path / "t.csv"), "a string, b int").first()["a"] == 'x "y"'


def test_one_reviewed_packet_at_most(spark):
    rows = spark.createDataFrame([("p", 1), ("p", 2)], "packet string, place int")
    assert archives.single_packet(rows, "packet").count() == 2 and archives.single_packet(rows.where("false"), "packet").count() == 0
    with pytest.raises(ValueError):
        archives.single_packet(rows.unionAll(spark.createDataFrame([("q", 1)], rows.schema)), "packet")
