"""Queries of cleaning, splitting, parsing, streaming and the whole search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import providers
from ..functions import text
from ..operators import chunking, layout, rank
from ..params import SearchParams
from ..plans import search as plan
from ..session import table
from ..streaming.ingest import windowed_counts
from .tables import model, with_sql

Q: dict = {}
S: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model(spark, sf_dir, "kb_documents")


@query(with_sql("kb_documents") + " SELECT id, md5(regexp_replace(content, '</?\\s*[a-z][a-z0-9]*\\b[^>]*>', '', 'g')) AS stripped FROM m_documents")
def c1_strip_html(spark, d):
    return _docs(spark, d).select("id", F.md5(F.encode(text.strip_html(F.col("content")), "UTF-8")).alias("stripped"))


@query(with_sql("kb_documents") + " SELECT id, md5(regexp_replace(content, '\\r\\n?', chr(10), 'g')) AS lines, md5(content) AS checksum FROM m_documents")
def c2_c21_newlines_checksum(spark, d):
    return _docs(spark, d).select("id", F.md5(F.encode(text.normalize_newlines(F.col("content")), "UTF-8")).alias("lines"), F.md5(F.encode("content", "UTF-8")).alias("checksum"))


# White space as it is stripped, in the patterns of the SQL.
_WS = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_C3 = "array_to_string(list_transform(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \\t\\x{3000}]+', ' ', 'g'), '^" + _WS + "+|" + _WS + "+$', '', 'g')), chr(10))"


@query(with_sql("kb_documents") + f" SELECT id, md5({_C3}) AS cleaned FROM m_documents")
def c3_spaces(spark, d):
    return _docs(spark, d).select("id", F.md5(F.encode(text.collapse_spaces(text.normalize_newlines(F.col("content"))), "UTF-8")).alias("cleaned"))


def _item(x: str) -> str:
    return f"regexp_matches({x}, '^{_WS}*(?:[-*+]{_WS}+|[0-9]+[.)]{_WS}+)')"




@query(with_sql("kb_documents") + f""", l AS (SELECT id, string_split({_C3}, chr(10)) AS ls FROM m_documents),
j AS (SELECT id, array_to_string([(CASE WHEN i = 1 THEN '' WHEN ls[i] = '' OR ls[i-1] = '' OR {_item('ls[i]')} OR {_item('ls[i-1]')} THEN chr(10) ELSE ' ' END) || ls[i] FOR i IN range(1, len(ls) + 1)], '') AS t FROM l)
SELECT id, md5(t) AS joined FROM j""")
def c4_join_lines(spark, d):
    x = text.join_lines(text.collapse_spaces(text.normalize_newlines(F.col("content"))))
    return _docs(spark, d).select("id", F.md5(F.encode(x, "UTF-8")).alias("joined"))


@query(with_sql("kb_documents") + " SELECT id, md5(regexp_replace(regexp_replace(content, '\\n{3,}', chr(10) || chr(10), 'g'), '^" + _WS + "+|" + _WS + "+$', '', 'g')) AS cleaned FROM m_documents")
def c6_blank_lines(spark, d):
    return _docs(spark, d).select("id", F.md5(F.encode(text.limit_blank_lines(F.col("content")), "UTF-8")).alias("cleaned"))


def _limited(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{_WS}+|{_WS}+$', '', 'g')"


@query(with_sql("kb_documents") + f""", l AS (SELECT id, file_type, {_C3} AS plain, string_split({_C3}, chr(10)) AS ls FROM m_documents),
j AS (SELECT id, file_type, plain, array_to_string([(CASE WHEN i = 1 THEN '' WHEN ls[i] = '' OR ls[i-1] = '' OR {_item('ls[i]')} OR {_item('ls[i-1]')} THEN chr(10) ELSE ' ' END) || ls[i] FOR i IN range(1, len(ls) + 1)], '') AS joined FROM l),
k AS (SELECT id, CASE WHEN lower(coalesce(file_type, '')) IN ('md', 'markdown', 'xlsx', 'xls', 'csv') THEN plain ELSE joined END AS t FROM j)
SELECT id, md5({_limited('t')}) AS cleaned FROM k""")
def c_clean_documents(spark, d):
    return _docs(spark, d).select("id", F.md5(F.encode(text.clean_text(F.col("content"), F.col("file_type")), "UTF-8")).alias("cleaned"))


@query(with_sql("kb_documents") + f""", l AS (SELECT id, string_split({_C3}, chr(10)) AS ls FROM m_documents),
j AS (SELECT id, array_to_string([(CASE WHEN i = 1 THEN '' WHEN (ls[i-1] = '' AND i > 2) OR (ls[i] = '' AND i < len(ls)) THEN chr(10) ELSE ' ' END) || ls[i] FOR i IN range(1, len(ls) + 1)], '') AS t FROM l)
SELECT id, md5(t) AS joined FROM j""")
def c5_join_all_lines(spark, d):
    """Without protection of lists every lone line end becomes a blank."""
    x = text.join_lines(text.collapse_spaces(text.normalize_newlines(F.col("content"))), protect_lists=False)
    return _docs(spark, d).select("id", F.md5(F.encode(x, "UTF-8")).alias("joined"))


@query(with_sql("kb_documents") + """ SELECT id, CASE WHEN lower(coalesce(file_type, '')) IN ('xlsx', 'xls', 'csv') THEN 'table' WHEN lower(coalesce(file_type, '')) IN ('md', 'markdown') THEN 'markdown' ELSE 'sentence' END AS route FROM m_documents""")
def c7_route(spark, d):
    return _docs(spark, d).select("id", text.route_splitter(F.col("file_type")).alias("route"))


@query()
def c8_c10_split_documents(spark, d):
    return chunking.split_documents(_docs(spark, d))


_REST = "regexp_replace(regexp_replace(x, '^(?:{mark})', ''), '^" + _WS + "+|" + _WS + "+$', '', 'g')"
_HASHES, _CHAPTER, _ORDINAL, _NUMBER = "#{1,6}", "第[一二三四五六七八九十百]+[章节部分](?:[\\s、．.])?", "[一二三四五六七八九十]+、", "[0-9]+(?:\\.[0-9]+)*[\\s、．.]"
_HEADING = f"""(SELECT id, document_id, rank_index, heading, substr(coalesce(list_filter(list_transform(list_filter(list_transform(string_split(content, chr(10))[1:5], lambda x: regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), lambda x: x <> ''), lambda x:
CASE WHEN regexp_matches(x, '^{_HASHES}\\s') AND {_REST.replace('{mark}', _HASHES)} <> '' THEN {_REST.replace('{mark}', _HASHES)}
WHEN regexp_matches(x, '^{_CHAPTER}') THEN coalesce(nullif({_REST.replace('{mark}', _CHAPTER)}, ''), x)
WHEN regexp_matches(x, '^{_ORDINAL}') AND {_REST.replace('{mark}', _ORDINAL)} <> '' THEN {_REST.replace('{mark}', _ORDINAL)}
WHEN regexp_matches(x, '^{_NUMBER}') AND length({_REST.replace('{mark}', _NUMBER)}) BETWEEN 2 AND 60 AND regexp_matches({_REST.replace('{mark}', _NUMBER)}, '[一-龥]') THEN {_REST.replace('{mark}', _NUMBER)} END), lambda x: x IS NOT NULL)[1], ''), 1, 80) AS found FROM m_chunks)"""


@query(with_sql("kb_chunks") + " SELECT id, found FROM " + _HEADING)
def c11_headings(spark, d):
    return model(spark, d, "kb_chunks").select("id", F.coalesce(text.heading_from_text(F.col("content")), F.lit("")).alias("found"))


@query(with_sql("kb_chunks", "kb_documents") + ", h AS " + _HEADING + """,
o AS (SELECT id, document_id, rank_index, coalesce(nullif(trim(heading), ''), nullif(found, '')) AS own FROM h),
l AS (SELECT id, document_id, last_value(own IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY rank_index NULLS FIRST, id ROWS UNBOUNDED PRECEDING) AS last FROM o)
SELECT l.id, substr(coalesce(last, nullif(trim(regexp_replace(d.title, '\\.[^.]*$', '')), ''), 'Introduction'), 1, 512) AS heading FROM l LEFT JOIN m_documents d ON d.id = l.document_id""")
def w3_carry_heading(spark, d):
    titles = _docs(spark, d).select(F.col("id").alias("document_id"), F.regexp_replace("title", r"\.[^.]*$", "").alias("_title"))
    return chunking.carry_headings(model(spark, d, "kb_chunks"), titles).select("id", "heading")


@query(with_sql("kb_events") + " SELECT id, lag(summary) OVER (PARTITION BY document_id ORDER BY rank_index, id) AS previous_summary FROM m_events")
def w4_previous_summary(spark, d):
    return providers.with_previous_summary(model(spark, d, "kb_events")).select("id", "previous_summary")


@query()
def w5_w10_c12_c18_tables(spark, d):
    sheets = _docs(spark, d).filter(F.col("content").rlike("(?m)^#[A-Z_]+#"))
    return chunking.split_documents(sheets.withColumn("file_type", F.lit("xlsx")))


@query(with_sql("kb_chunks") + """, t AS (SELECT document_id AS conv_id, rank_index AS turn, CASE WHEN rank_index % 3 = 2 THEN 'system' WHEN rank_index % 3 = 0 THEN 'user' ELSE 'assistant' END AS role, content AS text FROM m_chunks),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t WHERE role <> 'system' AND length(trim(text)) > 0)
SELECT conv_id, turn, role, md5(text) AS text FROM r WHERE n <= 10""")
def w9_history(spark, d):
    turns = model(spark, d, "kb_chunks").select(F.col("document_id").alias("conv_id"), F.col("rank_index").alias("turn"), F.when(F.col("rank_index") % 3 == 2, "system").when(F.col("rank_index") % 3 == 0, "user").otherwise("assistant").alias("role"), F.col("content").alias("text"))
    return rank.history(turns, 5).withColumn("text", F.md5(F.encode("text", "UTF-8")))


@query(with_sql("kb_documents") + " SELECT id, md5(regexp_replace(content, '(?m)^#(?:TITLE|FORM|SIGNING|GROUP_HEADER|DATA)#', '', 'g')) AS plain FROM m_documents")
def c19_strip_roles(spark, d):
    return _docs(spark, d).select("id", F.md5(F.encode(text.strip_roles(F.col("content")), "UTF-8")).alias("plain"))


@query(with_sql("kb_events") + " SELECT id, coalesce(nullif(trim(summary), ''), 'empty') AS safe FROM m_events")
def c25_safe_text(spark, d):
    return model(spark, d, "kb_events").select("id", text.safe_for_embedding(F.col("summary")).alias("safe"))


@query(with_sql("kb_chunks") + """, x AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM m_chunks ORDER BY id LIMIT 5)
SELECT md5(string_agg('[' || n || '] ' || coalesce(heading, '') || ' (source, 0.50)' || chr(10) || coalesce(content, ''), chr(10) || chr(10) ORDER BY n)) AS context FROM x""")
def c24_context(spark, d):
    """The context of five chunks: one text of a few sections is meant, not of a whole table."""
    x = model(spark, d, "kb_chunks").orderBy("id").limit(5)
    return rank.context_text(x.select((F.row_number().over(Window.orderBy("id")) - 1).alias("pos"), "heading", "content", F.lit("source").alias("source_name"), F.lit(0.5).alias("score"))).select(F.md5(F.encode("context", "UTF-8")).alias("context"))


@query()
def d25_html_tables(spark, d):
    return layout.tables_of(_docs(spark, d), "id", "content")


@query()
def d27_markdown_tables(spark, d):
    return layout.grid_to_markdown(layout.tables_of(_docs(spark, d), "id", "content"), ["id", "table_id"])


@query(with_sql("kb_documents") + " SELECT id, CASE WHEN t IN ('md', 'markdown') THEN 'md' WHEN t IN ('txt', 'text', 'log') THEN 'txt' WHEN t IN ('csv', 'xlsx', 'docx', 'pdf') THEN t WHEN t IN ('png', 'jpg', 'jpeg', 'bmp', 'tif', 'tiff', 'webp') THEN 'image' END AS kind FROM (SELECT id, lower(regexp_extract(source_path, '\\.([^./\\\\]+)$', 1)) AS t FROM m_documents)")
def s1_file_types(spark, d):
    return _docs(spark, d).select("id", text.file_type_of(F.col("source_path")).alias("kind"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def st_windowed_counts(spark, d):
    return windowed_counts(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(with_sql("kb_documents") + " SELECT id, CASE WHEN lower(coalesce(file_type, '')) IN ('xlsx', 'xls', 'csv') THEN 'tabular' ELSE 'generic' END AS genre FROM m_documents")
def u1_genres(spark, d):
    return providers.with_genre(_docs(spark, d)).select("id", "genre")


@query("""SELECT id, trim(regexp_replace(regexp_replace(trim(told), '^(?:user|assistant|query|question|用户|助手|问题|改写)\\s*[:：]\\s*', ''), '^["''“”‘’「」]+|["''“”‘’「」]+$', '', 'g')) AS question
FROM (SELECT DISTINCT id, CASE length(title) % 3 WHEN 0 THEN 'query: "' || title || '"' WHEN 1 THEN '问题：「' || title || '」' ELSE title END AS told FROM kb_events)""")
def c23_rewrites(spark, d):
    """What is left of a rewritten question, with titles of events as questions."""
    t = F.col("title")
    told = F.when(F.length(t) % 3 == 0, F.concat(F.lit('query: "'), t, F.lit('"'))).when(F.length(t) % 3 == 1, F.concat(F.lit("问题：「"), t, F.lit("」"))).otherwise(t)
    return table(spark, d, "kb_events").select("id", told.alias("told")).distinct().select("id", text.clean_rewrite(F.col("told")).alias("question"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line number of an order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")))


_LINES = "lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)"


# Pages, made of the lines of orders: an order is a page, a line a block


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("l_partkey") % 500).cast("int"), (F.col("l_suppkey") % 90 * 10).cast("int")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("string").alias("text"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 10).alias("y1"))


_BLOCKS = "b AS (SELECT l_orderkey AS page_id, l_linenumber::VARCHAR AS text, l_partkey % 500 AS x0, l_suppkey % 90 * 10 AS y0, l_partkey % 500 + 40 AS x1, l_suppkey % 90 * 10 + 10 AS y1 FROM lineitem)"


@query("WITH " + _BLOCKS + ", n AS (SELECT DISTINCT page_id, x0 FROM b), g AS (SELECT page_id, x0, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page_id ORDER BY x0) > 60 THEN 1 ELSE 0 END AS new FROM n)"
       " SELECT page_id, x0, sum(new) OVER (PARTITION BY page_id ORDER BY x0) AS \"column\" FROM g")  # fmt: skip
def w7_columns(spark, d):
    return layout.column_clusters(_blocks(spark, d), 60)


@query("WITH RECURSIVE " + _BLOCKS + """, o AS (SELECT *, (y0 + y1) / 2.0 AS mid, y1 - y0 AS h, row_number() OVER (PARTITION BY page_id ORDER BY (y0 + y1) / 2.0, x0, text) AS k FROM b),
w AS (SELECT page_id, text, x0, k, 0 AS line, mid AS total, 1 AS n, h::DOUBLE AS height FROM o WHERE k = 1
UNION ALL SELECT o.page_id, o.text, o.x0, o.k, CASE WHEN near THEN line ELSE line + 1 END, CASE WHEN near THEN total + mid ELSE mid END, CASE WHEN near THEN n + 1 ELSE 1 END, CASE WHEN near THEN height + h ELSE h END
FROM (SELECT w.page_id AS wp, w.k AS wk, w.line, w.total, w.n, w.height, o.*, abs(o.mid - w.total / w.n) <= 0.6 * greatest(w.height / w.n, o.h) AS near FROM w JOIN o ON o.page_id = w.page_id AND o.k = w.k + 1) o)
SELECT page_id, text, line, row_number() OVER (PARTITION BY page_id ORDER BY line, x0, text) - 1 AS pos FROM w""")
def w6_reading_order(spark, d):
    return layout.reading_order(_blocks(spark, d)).select("page_id", "text", "line", "pos")


@query("WITH " + _LINES + """, b AS (SELECT l_orderkey AS page_id, l_linenumber AS line, u.x0, u.x1 FROM lines, LATERAL (VALUES (0, 40 + l_partkey % 3 * 20), (100 + l_suppkey % 4 * 20, 160 + l_suppkey % 4 * 20), (300, 340)) u(x0, x1) WHERE u.x0 < 300 OR l_partkey % 5 > 0),
s AS (SELECT page_id, line, list(struct_pack(c := (x0 + x1) / 2.0, a := x0, z := x1) ORDER BY (x0 + x1) / 2.0, x0, x1) AS l FROM b GROUP BY 1, 2),
g AS (SELECT page_id, line, [(l[i].z + l[i + 1].a) / 2.0 FOR i IN range(1, len(l))] AS g FROM s), p AS (SELECT *, lag(g) OVER (PARTITION BY page_id ORDER BY line) AS p FROM g),
n AS (SELECT *, CASE WHEN p IS NOT NULL AND len(g) = len(p) AND len(list_filter(g, lambda a: len(list_filter(p, lambda b: abs(a - b) <= 30)) > 0)) >= 0.6 * len(g) THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT page_id, line, sum(new) OVER (PARTITION BY page_id ORDER BY line) AS region FROM n)
SELECT page_id, region, min(line) AS first_line, max(line) AS last_line FROM r GROUP BY 1, 2 HAVING count(*) >= 3""")
def w8_table_regions(spark, d):
    """Regions of tables: lines of orders stand for lines of two or three blocks."""
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    block = lambda a, b: F.struct(F.lit(a).alias("x0") if isinstance(a, int) else a.alias("x0"), F.lit(b).alias("x1") if isinstance(b, int) else b.alias("x1"))
    as_long = lambda c: c.cast("bigint")
    b = F.explode(F.array(block(as_long(F.lit(0)), as_long(40 + p % 3 * 20)), block(as_long(100 + q % 4 * 20), as_long(160 + q % 4 * 20)), block(as_long(F.lit(300)), as_long(F.lit(340))))).alias("b")
    x = _lines(spark, d).select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("line"), "l_partkey", b).filter("b.x0 < 300 or l_partkey % 5 > 0")
    return layout.table_regions(x.select("page_id", "line", "b.x0", "b.x1"), ["page_id"])


@query("WITH " + _BLOCKS + """, x AS (SELECT o_orderkey AS page_id, unnest([0, 1]) AS box_id, o_custkey % 300 AS bx0, o_custkey % 400 AS by0 FROM orders)
SELECT b.page_id, text, box_id FROM b JOIN x ON x.page_id = b.page_id WHERE (x0 + x1) / 2.0 BETWEEN bx0 + box_id * 150 AND bx0 + box_id * 150 + 200 AND (y0 + y1) / 2.0 BETWEEN by0 AND by0 + 300""")
def j11_blocks_in_boxes(spark, d):
    boxes = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("box_id"), (F.col("o_custkey") % 300).alias("bx"), (F.col("o_custkey") % 400).alias("by0"))
    boxes = boxes.select("page_id", "box_id", (F.col("bx") + F.col("box_id") * 150).alias("bx0"), "by0", (F.col("bx") + F.col("box_id") * 150 + 200).alias("bx1"), (F.col("by0") + 300).alias("by1"))
    return layout.blocks_in_boxes(_blocks(spark, d), boxes).select("page_id", "text", "box_id")


@query("""WITH p AS (SELECT l_orderkey AS doc, CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END AS n_chars, CASE WHEN l_returnflag = 'N' THEN 0.0 ELSE l_discount * 10 END AS image_share FROM lineitem)
SELECT doc, CASE WHEN bool_or(n_chars > 0 AND image_share > 0) THEN 'mixed' WHEN avg((image_share > 0.5)::INT) > 0.5 THEN 'image_only' ELSE 'text' END AS kind FROM p GROUP BY 1""")
def d16_page_kinds(spark, d):
    """Kinds of documents from characters and pictures of their pages; lines of orders stand for pages."""
    x = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0).alias("n_chars"), F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_discount") * 10).alias("image_share"))
    return layout.page_kind(x, "doc")


# Tables: the lines of an order are rows, three of their values cells


def _cells(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    part = F.when(F.lit(second) | (F.col("l_partkey") % 4 != 0), F.col("l_partkey").cast("string")).otherwise(F.lit(""))
    supplier = F.when(F.lit(second) & (F.col("l_suppkey") % 3 == 0), F.lit("?")).otherwise(F.col("l_suppkey").cast("string"))
    cells = F.posexplode(F.array(part, supplier, F.col("l_returnflag"))).alias("col", "text")
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row"), cells)


_CELLS = _LINES + """, c AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS row, u.col, u.text, u.other FROM lines, LATERAL (VALUES
(0, CASE WHEN l_partkey % 4 <> 0 THEN l_partkey::VARCHAR ELSE '' END, l_partkey::VARCHAR), (1, l_suppkey::VARCHAR, CASE WHEN l_suppkey % 3 = 0 THEN '?' ELSE l_suppkey::VARCHAR END), (2, l_returnflag, l_returnflag)) u(col, text, other))"""


@query("WITH " + _CELLS + " SELECT table_id, round(avg(CASE WHEN length(trim(text)) > 0 THEN 1.0 ELSE 0.0 END), 6) AS confidence FROM c GROUP BY 1")
def a8_fill_ratio(spark, d):
    return layout.fill_ratio(_cells(spark, d), ["table_id"]).withColumn("confidence", F.round("confidence", 6))


@query("WITH " + _CELLS + """, g AS (SELECT table_id, count(*) FILTER (trim(text) <> '' AND trim(other) <> '') AS n, count(*) FILTER (trim(text) <> '' AND trim(other) <> '' AND trim(text) = trim(other)) AS ok FROM c GROUP BY 1)
SELECT table_id, row, col, CASE WHEN trim(text) = '' AND (ok >= 0.5 * n OR n = 0) THEN other ELSE text END AS text FROM c JOIN g USING (table_id)""")
def d19_fused_cells(spark, d):
    """Empty cells of one reading filled from a second one, where both agree."""
    return layout.fuse_cells(_cells(spark, d), _cells(spark, d, second=True), ["table_id"])


@query("WITH " + _LINES + """, r AS (SELECT l_orderkey AS table_id, CASE WHEN l_partkey % 3 = 0 THEN 'Part ' || l_suppkey || ' ..... ' || l_linenumber WHEN l_partkey % 3 = 1 THEN '1.' || l_linenumber || ' Part ' || l_linenumber ELSE 'Part of ' || l_suppkey || ' lots' END AS t FROM lines),
s AS (SELECT table_id, CASE WHEN regexp_matches(t, '(\\.{3,}|…|\\s{2,}|·{3,})\\s*[0-9]{1,4}\\s*$') THEN 2 WHEN regexp_matches(t, '^\\s*(第.+[章节]|[0-9]+(\\.[0-9]+)*)\\s.*[0-9]{1,4}\\s*$') THEN 1 ELSE 0 END AS score FROM r)
SELECT table_id, sum(score) >= count(*) AS contents FROM s GROUP BY 1""")
def d21_contents_tables(spark, d):
    t = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("Part "), "l_suppkey", F.lit(" ..... "), "l_linenumber")).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("1."), "l_linenumber", F.lit(" Part "), "l_linenumber")).otherwise(F.concat(F.lit("Part of "), "l_suppkey", F.lit(" lots")))
    return layout.is_contents_table(_lines(spark, d).select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("row"), F.lit(0).alias("col"), t.alias("text")), ["table_id"])


@query("WITH " + _CELLS + """, r AS (SELECT table_id, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' || CASE WHEN row = 0 THEN chr(10) || '|---|---|---|' ELSE '' END AS line FROM c GROUP BY 1, 2)
SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS markdown FROM r GROUP BY 1""")
def d27_grid_to_markdown(spark, d):
    return layout.grid_to_markdown(_cells(spark, d).withColumn("row_span", F.lit(1)).withColumn("col_span", F.lit(1)), ["table_id"])


_PAGE = "'<p>x</p><TABLE><tr><th rowspan=2>' || o_orderkey || '</th><td>' || o_orderstatus || '</td></tr><tr><td> ' || o_orderpriority || ' <b>&amp;</b></td></tr></table>'"


@query("""SELECT o_orderkey AS page_id, 0 AS table_id, u.row, u.col, u.row_span, 1 AS col_span, u.text FROM orders, LATERAL (VALUES (0, 0, 2, o_orderkey::VARCHAR), (0, 1, 1, o_orderstatus), (1, 1, 1, o_orderpriority || ' &')) u(row, col, row_span, text)""")
def d25_order_tables(spark, d):
    """Cells of a small table with a spanning cell for each order."""
    return layout.tables_of(table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.expr(_PAGE).alias("html")), "page_id", "html")


@query()
def u6_embed_texts(spark, d):
    return providers.embed(model(spark, d, "kb_events").select("id", "title"), "title")


@query()
def search_end_to_end(spark, d):
    names = {"sources": "kb_sources", "documents": "kb_documents", "chunks": "kb_chunks", "events": "kb_events", "entities": "kb_entities", "links": "kb_event_entities"}
    tables = {k: model(spark, d, v) for k, v in names.items()} | {"vectors": table(spark, d, "vectors").filter((F.size("embedding") == 64) & ~F.exists("embedding", F.isnan))}
    v = tables["vectors"].filter("collection = 'event_titles'").orderBy("id").first()
    return plan.search(tables, v.text or "credit review", SearchParams(), vector=list(v.embedding)).sections
