"""Tables and reading order on scanned and marked-up pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window


class _Tables(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cells: list[tuple[int, int, int, int, int, str]] = []
        self.stack: list[dict] = []
        self.n = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        span = lambda k: max(1, int(a[k])) if (a.get(k) or "").isdigit() else 1
        if tag == "table":
            self.stack.append({"id": self.n, "row": -1, "taken": {}, "cell": None})
            self.n += 1
        elif self.stack and tag == "tr":
            self._close()
            self.stack[-1]["row"] += 1
        elif self.stack and tag in ("td", "th"):
            self._close()
            t = self.stack[-1]
            t["row"] = max(t["row"], 0)
            col = 0
            while (t["row"], col) in t["taken"]:
                col += 1
            t["cell"] = [t["row"], col, span("rowspan"), span("colspan"), ""]
            for r in range(t["cell"][2]):
                for c in range(t["cell"][3]):
                    t["taken"][t["row"] + r, col + c] = True

    def _close(self) -> None:
        if self.stack and (c := self.stack[-1]["cell"]):
            self.cells.append((self.stack[-1]["id"], *c[:4], " ".join(unescape(c[4]).split())))
            self.stack[-1]["cell"] = None

    def handle_endtag(self, tag: str) -> None:
        if self.stack and tag in ("td", "th", "tr", "table"):
            self._close()
            if tag == "table":
                self.stack.pop()

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1]["cell"]:
            self.stack[-1]["cell"][4] += data


def html_cells(html: str | None) -> list[tuple[int, int, int, int, int, str]]:
    """(table, row, column, row span, column span, text) of all cells; spans push later cells aside."""
    if not html or "<t" not in html.lower():
        return []
    p = _Tables()
    p.feed(html)
    p._close()
    return sorted(p.cells)


def tables_of(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Cells of the tables of pages."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = [(i, *c) for i, h in zip(df[id_col], df[html_col]) for c in html_cells(h)]
            yield pd.DataFrame(out, columns=[id_col, "table_id", "row", "col", "row_span", "col_span", "text"])

    return pages.select(id_col, html_col).mapInPandas(run, f"`{id_col}` {id_type}, table_id int, row int, col int, row_span int, col_span int, text string")


def grid_to_markdown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """One Markdown table per group of cells; spans are repeated over the places that they cover. Of several texts for one
    place the least counts."""
    wide = cells.withColumn("_r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))).withColumn("_c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    wide = wide.groupBy(*keys, "_r", "_c").agg(F.min("text").alias("text"))
    size = wide.groupBy(*keys).agg(F.max("_c").alias("_w"))
    rows = wide.groupBy(*keys, "_r").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_c", "text")))).alias("_m")).join(size, keys)
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), F.col("_w")), lambda c: F.regexp_replace(F.coalesce(F.try_element_at("_m", c), F.lit("")), r"\|", r"\\|")), " | "), F.lit(" |"))
    rule = F.concat(F.lit("\n|"), F.repeat(F.lit("---|"), F.col("_w") + 1))
    lines = rows.select(*keys, "_r", F.concat(line, F.when(F.col("_r") == 0, rule).otherwise(F.lit(""))).alias("_l"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_l"))), lambda x: x["_l"]), "\n").alias("markdown"))


def reading_order(blocks: DataFrame, tolerance: float = 0.6) -> DataFrame:
    """Blocks (page_id, text, x0, y0, x1, y1) with (line, pos): a block joins the line while its centre is near the line's
    mean centre; one without a centre is a line of its own, at the end. Pages follow each other sorted, so each task
    numbers all lines in one pass and keeps only the sums of the present line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, total, n, height = -1, 0.0, 0, 0.0
        for b in batches:
            lines = []
            for k, y0, y1 in zip(*(b.column(c).to_pylist() for c in ("_k", "y0", "y1"))):
                if k == 1:
                    line, n = -1, 0
                if y0 is None or y1 is None:
                    line, n = line + 1, 0
                    lines.append(line)
                    continue
                y, h = (y0 + y1) / 2, y1 - y0
                if n == 0 or abs(y - total / n) > tolerance * max(height / n, h):
                    line, total, n, height = line + 1, y, 1, h
                else:
                    total, n, height = total + y, n + 1, height + h
                lines.append(line)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(lines, pa.int32())], [*columns, "line"])

    columns = ["page_id", "text", "x0", "y0", "x1", "y1"]
    order = lambda first: Window.partitionBy("page_id").orderBy(*(c.asc_nulls_last() for c in (first, F.col("x0"), F.col("text"))))
    x = blocks.select(*columns).withColumn("_k", F.row_number().over(order(F.col("y0") + F.col("y1"))))
    x = x.mapInArrow(run, T.StructType([*x.select(*columns).schema, T.StructField("line", T.IntegerType())]))
    return x.withColumn("pos", F.row_number().over(order(F.col("line"))) - 1)


def column_clusters(blocks: DataFrame, tolerance: int) -> DataFrame:
    """(page_id, x0, column): a new column where the gap between sorted left edges is over the tolerance."""
    w = Window.partitionBy("page_id").orderBy("x0")
    x = blocks.select("page_id", "x0").distinct().withColumn("_new", (F.coalesce(F.col("x0") - F.lag("x0").over(w), F.lit(0)) > tolerance).cast("int"))
    return x.select("page_id", "x0", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("column"))


def table_regions(blocks: DataFrame, keys: list[str], tolerance: float = 30.0, columns: int = 2, rows: int = 3) -> DataFrame:
    """(keys, region, first_line, last_line) of tables on pages of blocks (keys, line, x0, x1).

    A line's signature are the centres of the gaps between its blocks. Lines that follow each other and have equally
    many gaps, of which three fifths lie near one of the line before, make a region; of ``columns`` blocks a line and
    ``rows`` lines at least.
    """
    block = F.struct(((F.col("x0") + F.col("x1")) / 2).alias("c"), "x0", "x1")
    x = blocks.groupBy(*keys, "line").agg(F.sort_array(F.collect_list(block)).alias("_b"))
    n = F.size("_b")
    gaps = F.when(n > 1, F.zip_with(F.slice("_b", 1, F.greatest(n - 1, F.lit(1))), F.slice("_b", 2, F.greatest(n - 1, F.lit(1))), lambda a, b: (a["x1"] + b["x0"]) / 2)).otherwise(F.array().cast("array<double>"))
    w = Window.partitionBy(*keys).orderBy("line")
    x = x.select(*keys, "line", gaps.alias("_g")).withColumn("_p", F.lag("_g").over(w))
    near = F.size(F.filter("_g", lambda a: F.exists("_p", lambda b: F.abs(a - b) <= tolerance)))
    able = F.size("_g") >= columns - 1
    follows = F.coalesce((F.size("_g") == F.size("_p")) & (F.size("_g") > 0) & (near >= F.size("_g") * 0.6), F.lit(False))
    x = x.withColumn("_able", able).withColumn("_new", (~(follows & F.coalesce(F.lag(able).over(w), F.lit(False)))).cast("int"))
    x = x.withColumn("region", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_able")
    return x.groupBy(*keys, "region").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("_n")).filter(F.col("_n") >= rows).drop("_n")


def blocks_in_boxes(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blocks whose centre lies in a box (page_id, box_id, bx0, by0, bx1, by1), borders included. Joined by page, then by range."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return blocks.join(boxes, "page_id").filter(cx.between(F.col("bx0"), F.col("bx1")) & cy.between(F.col("by0"), F.col("by1")))


def fill_ratio(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Share of cells that hold text."""
    return cells.groupBy(*keys).agg(F.avg(F.when(F.length(F.trim("text")) > 0, 1.0).otherwise(0.0)).alias("confidence"))


def page_kind(pages: DataFrame, key: str) -> DataFrame:
    """(key, kind) of pages (n_chars, image_share): text, image_only or mixed; any page with both makes the document mixed."""
    both = (F.col("n_chars") > 0) & (F.col("image_share") > 0)
    x = pages.groupBy(key).agg(F.max(both).alias("_mixed"), F.avg((F.col("image_share") > 0.5).cast("double")).alias("_share"))
    return x.select(key, F.when(F.col("_mixed"), "mixed").when(F.col("_share") > 0.5, "image_only").otherwise("text").alias("kind"))


def fuse_cells(first: DataFrame, second: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """Cells of the first reading; empty ones are filled from the second, if enough of the cells of both agree."""
    b = second.select(*keys, "row", "col", F.col("text").alias("_t"))
    x = first.join(b, [*keys, "row", "col"], "left")
    has = (F.length(F.trim("text")) > 0) & (F.length(F.trim("_t")) > 0)
    agree = x.groupBy(*keys).agg((F.count_if(has & (F.trim("text") == F.trim("_t"))) / F.greatest(F.count_if(has), F.lit(1))).alias("_ok"), F.count_if(has).alias("_n"))
    y = x.join(agree, keys)
    return y.select(*keys, "row", "col", F.when((F.length(F.trim("text")) == 0) & ((F.col("_ok") >= least) | (F.col("_n") == 0)), F.coalesce("_t", "text")).otherwise(F.col("text")).alias("text"))


def is_contents_table(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, contents): whether a table is a table of contents: its rows mostly end in a page number after dots or a gap."""
    row = cells.groupBy(*keys, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " ").alias("_t"))
    score = F.when(F.col("_t").rlike(r"(\.{3,}|…|\s{2,}|·{3,})\s*\d{1,4}\s*$"), 2).when(F.col("_t").rlike(r"^\s*(第.+[章节]|\d+(\.\d+)*)\s.*\d{1,4}\s*$"), 1).otherwise(0)
    return row.groupBy(*keys).agg((F.sum(score) >= F.count("*")).alias("contents"))


def clean_cell(text: str | None) -> str:
    """One line without doubled blanks, and without a tail that repeats what stands before it."""
    x = re.sub(r"\s+", " ", text or "").strip()
    for n in range(len(x) // 2, 2, -1):
        if x[-n:] == x[-2 * n : -n]:
            return x[:-n].rstrip()
    return x
