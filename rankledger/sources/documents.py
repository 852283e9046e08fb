"""Official documents as tables: CSV, JSON and HTML text columns to rows of cells, and header mapping.

Each parser takes a DataFrame with an id and a text column, so a million documents parse in parallel; a document that
breaks a rule gives a row with an error code instead of cells.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon
from ..functions import text as tx

CELLS = "id string, row_no int, cells array<string>, error string"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header row; ragged rows fail the read."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("quote", '"').option("escape", '"').option("multiLine", True).option("enforceSchema", False).csv(path)


def read_manifests(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """All files of that name below a folder, one JSON object each."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_blobs(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """Files with digest, at most max_bytes each: the size filter is decided from metadata, before a byte is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= max_bytes)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def bounded(contents: DataFrame, order: list[str], content: str, max_bytes: int) -> DataFrame:
    """``contents`` with the bytes read up to and with each in the given total order, its digest, and SOURCE_TOO_LARGE (without a digest) once they pass the limit."""
    read = canon.running_total(contents, order, F.octet_length(F.col(content)), "bytes_read")
    fits = F.col("bytes_read") <= max_bytes
    return read.withColumns({"sha256": F.when(fits, F.sha2(F.col(content).cast("binary"), 256)), "error": F.when(~fits, "SOURCE_TOO_LARGE")})


def _csv_rows(body: str) -> list[list[str]]:
    if body.startswith("﻿"):
        raise ValueError("BOM")
    rows = list(csv.reader(io.StringIO(body, newline=""), strict=True))
    if not rows or any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("RAGGED")
    return rows


class _Table(HTMLParser):
    """Cells of the only table with a given id; anything that must not be in it raises."""

    UNSAFE = {"script", "style", "iframe", "object", "embed", "form", "input", "template", "noscript", "svg", "table"}
    VOID = {"br", "img", "hr", "col", "wbr"}

    def __init__(self, wanted: str):
        super().__init__(convert_charrefs=True)
        self.wanted, self.found, self.depth = wanted, 0, 0
        self.section, self.rows, self.cell = "", [], None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if not self.depth:
            if a.get("id") == self.wanted:
                self.found += 1
                if tag != "table":
                    raise ValueError("SELECTOR_NOT_TABLE")
                if "hidden" in a:
                    raise ValueError("HTML_UNSAFE_CONTENT")
                self.depth = 1
            return
        if tag in self.UNSAFE or "hidden" in a:
            raise ValueError("HTML_UNSAFE_CONTENT")
        if tag in self.VOID:
            return
        self.depth += 1
        if tag in ("thead", "tbody"):
            self.section = tag
        elif tag == "tr":
            if not self.section:
                raise ValueError("TABLE_INVALID")
            self.rows.append((self.section, []))
        elif tag in ("td", "th"):
            if not self.rows or (tag == "th") != (self.rows[-1][0] == "thead"):
                raise ValueError("HEADER_ROW_INVALID" if self.section == "thead" else "TABLE_INVALID")
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if not self.depth or tag in self.VOID:
            return
        self.depth -= 1
        if tag in ("thead", "tbody"):
            self.section = ""
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1][1].append("".join(self.cell))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


def _html_rows(body: str, table_id: str) -> list[list[str]]:
    parser = _Table(table_id)
    parser.feed(body)
    parser.close()
    if parser.found != 1:
        raise ValueError("SELECTOR_NOT_FOUND" if not parser.found else "SELECTOR_AMBIGUOUS")
    heads = [cells for section, cells in parser.rows if section == "thead"]
    if len(heads) != 1:
        raise ValueError("HEADER_ROW_COUNT")
    if not heads[0]:
        raise ValueError("HEADER_ROW_INVALID")
    return heads + [cells for section, cells in parser.rows if section == "tbody"]


def _parsed(df: DataFrame, id_column: str, text_column: str, parse) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, body in zip(b[id_column], b[text_column]):
                try:
                    out += [(key, i, cells, None) for i, cells in enumerate(parse(body or ""))]
                except (ValueError, csv.Error) as e:
                    out.append((key, None, None, str(e).split(" ")[0] if isinstance(e, ValueError) else "MALFORMED"))
            frame = pd.DataFrame(out, columns=["id", "row_no", "cells", "error"])
            frame["row_no"] = frame["row_no"].astype("Int32")
            yield frame

    return df.select(F.col(id_column).cast("string").alias(id_column), text_column).mapInPandas(run, CELLS)


def csv_tables(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return _parsed(df, id_column, text_column, _csv_rows)


def html_tables(df: DataFrame, id_column: str, text_column: str, table_id: str) -> DataFrame:
    return _parsed(df, id_column, text_column, lambda body: _html_rows(body, table_id))


def json_tables(df: DataFrame, id_column: str, text_column: str, selector: str) -> DataFrame:
    """The array of string arrays under one key of a JSON object; no Python involved."""
    rows = F.from_json(text_column, "map<string,array<array<string>>>")[selector]
    t = df.select(F.col(id_column).cast("string").alias("id"), rows.alias("_r"))
    exploded = t.select("id", F.col("_r").isNull().alias("_none"), F.posexplode_outer("_r").alias("row_no", "cells"))
    return exploded.where("_none OR row_no IS NOT NULL").select("id", "row_no", "cells", F.when(F.col("_none"), "SELECTOR_NOT_FOUND").alias("error"))


def map_columns(tables: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rows with one column a field, by the header row: every field must match one header, every header one field."""
    heads = tables.where("row_no = 0").select("id", F.transform("cells", lambda c: tx.collapse(F.lower(c))).alias("_h"))
    places = {}
    for field, names in aliases.items():
        hits = F.filter(F.transform("_h", lambda h, i: F.when(h.isin([n.lower() for n in names]), i)), lambda i: i.isNotNull())  # noqa: B023
        places[field] = F.when(F.size(hits) == 1, F.try_element_at(hits, F.lit(1)))
    heads = heads.select("id", F.size("_h").alias("_w"), *[p.alias(f"_at_{f}") for f, p in places.items()])
    missing = F.array_compact(F.array(*[F.when(F.col(f"_at_{f}").isNull(), F.lit(f)) for f in aliases]))
    code = F.when(F.size(missing) > 0, F.concat(F.lit("COLUMN_"), F.try_element_at(missing, F.lit(1)))).when(F.col("_w") != len(aliases), "EXTRA_COLUMN")
    body = tables.where("row_no > 0").join(heads.withColumn("_code", code), "id")
    broken = tables.where("error IS NOT NULL").select("id", F.lit(None).cast("int").alias("row_no"), *[F.lit(None).cast("string").alias(f) for f in aliases], "error")
    cells = [F.when(F.col("_code").isNull(), F.try_element_at("cells", F.col(f"_at_{f}") + 1)).alias(f) for f in aliases]
    return body.select("id", "row_no", *cells, F.coalesce("error", "_code").alias("error")).unionByName(broken)


def document_results(mapped: DataFrame, document: str) -> DataFrame:
    """competitor, school, place and stage texts as normalized results with deterministic entry ids."""
    place = tx.strict_placement(F.trim("place"))
    stage = F.when(F.trim("stage").isin("octafinal", "quarterfinal", "semifinal", "final"), F.trim("stage"))
    code = F.coalesce(F.col("error"), F.when(place.isNull() & (F.trim("place") != ""), "INVALID_PLACEMENT"), F.when(stage.isNull(), "INVALID_STAGE"), F.when(F.trim("competitor") == "", "EMPTY_NAME"))
    entry = F.concat_ws(":", F.lit("document"), tx.encode_component(F.lit(document)), tx.encode_component(F.col("id")), tx.encode_component(F.trim("competitor")), tx.encode_component(F.trim("school")))
    return mapped.select("id", "row_no", entry.alias("source_entry_id"), F.trim("competitor").alias("published_name"), F.trim("school").alias("published_school"), place.alias("placement"), stage.alias("furthest_stage"),
                         F.coalesce((place == 1) & (stage == "final"), F.lit(False)).alias("won_final_round"), code.alias("error"))
