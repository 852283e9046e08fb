"""Positioned PDF text to rows: anchor clustering by page.

A row starts at its first (highest) text and takes what lies at most ``tolerance`` below that anchor; text that is too
far from the anchor but close to the row's last text cannot be assigned and makes the page ambiguous. The anchor makes
it a fold over sorted text, so it runs per (document, page): the largest group is one page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "document string, page_number int, row_no int, y double, cells array<string>, error string"


def cluster_rows(items: DataFrame, tolerance: float = 2.0, slack: float = 0.25) -> DataFrame:
    """items: document, page_number, text, x, y, width. One row a text row, or one with an error a page."""

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x", "text"], ascending=[False, True, True], kind="stable")
        key = (str(pdf["document"].iloc[0]), int(pdf["page_number"].iloc[0]))

        def failed(code: str) -> pd.DataFrame:
            return pd.DataFrame([(*key, None, None, None, code)], columns=["document", "page_number", "row_no", "y", "cells", "error"])

        if not pdf[["x", "y", "width"]].apply(lambda c: c.notna() & c.abs().lt(float("inf"))).all(axis=None):
            return failed("INVALID_POSITION")
        rows, anchor, last = [], None, None
        for t, x, y, w in pdf[["text", "x", "y", "width"]].itertuples(index=False):
            if anchor is None or anchor - y > tolerance:
                if anchor is not None and last - y <= tolerance:
                    return failed("AMBIGUOUS_ROW")
                anchor = y
                rows.append((y, []))
            rows[-1][1].append((x, t, w))
            last = y
        out = []
        for i, (y, cells) in enumerate(rows):
            cells.sort(key=lambda c: (c[0], c[1]))
            if any(b[0] < a[0] + a[2] - slack for a, b in zip(cells, cells[1:])):
                return failed("OVERLAPPING_TEXT")
            out.append((*key, i, y, [c[1] for c in cells], None))
        return pd.DataFrame(out, columns=["document", "page_number", "row_no", "y", "cells", "error"])

    typed = items.select(F.col("document").cast("string").alias("document"), F.col("page_number").cast("int").alias("page_number"), "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width")])
    return typed.groupBy("document", "page_number").applyInPandas(page, ROWS)


def table_block(rows: DataFrame, header: list[str]) -> DataFrame:
    """Rows behind the page's only row that equals ``header``, while they have as many cells; AMBIGUOUS if it recurs."""
    from pyspark.sql import Window

    w = Window.partitionBy("document").orderBy("page_number", "row_no")
    is_head = F.coalesce(F.col("cells") == F.array(*[F.lit(h) for h in header]), F.lit(False))
    r = rows.where("error IS NULL").withColumn("_h", is_head).withColumns({"_seen": F.sum(F.col("_h").cast("int")).over(w), "_heads": F.sum(F.col("_h").cast("int")).over(Window.partitionBy("document")), "_next": F.lead(F.size("cells")).over(w)})
    stop = F.sum(F.when((F.col("_seen") > 0) & (F.size("cells") != len(header)), 1).otherwise(0)).over(w)
    inside = r.withColumn("_stop", stop).where("_seen = 1 AND _stop = 0 AND NOT _h")
    return inside.select("document", "page_number", "row_no", "cells", F.when(F.col("_heads") > 1, "AMBIGUOUS_TABLE").alias("error"), (F.coalesce("_next", F.lit(0)) != len(header)).alias("last_of_block"))
