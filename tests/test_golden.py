"""Results that follow from the definitions, row by row."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wovenkb import providers
from wovenkb.functions import text
from wovenkb.functions import vectors as V
from wovenkb.operators import chunking, expand, layout, rank, stats, store
from wovenkb.params import IngestParams, SearchParams
from wovenkb.plans import ingest as plan
from wovenkb.plans import search as search_plan
from wovenkb.sources import office, readers
from wovenkb.streaming.ingest import ingest_stream

P = SearchParams()


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "given,kind,out",
    [("a\r\nb\rc", "md", "a\nb\nc"), ("  a \t　b  ", "md", "a b"), ("a\nb\n\nc", "txt", "a b\n\nc"), ("intro\n- x\n- y", "txt", "intro\n- x\n- y"), ("a,b\n1,2", "csv", "a,b\n1,2"), ("a\n\n\n\nb", "txt", "a\n\nb")],
)
def test_cleaning(spark, given, kind, out):
    assert one(spark, text.clean_text(F.col("t"), F.col("k")), t=given, k=kind) == out


def test_text_functions(spark):
    assert one(spark, text.strip_html(F.col("t")), t="<b>x</b> a<b 1 <B>y</B>") == "x ay</B>"
    assert one(spark, text.normalize_name(F.col("t")), t=" New  York　") == "newyork"
    assert one(spark, text.heading_from_text(F.col("t")), t="## Title\ntext") == "Title"
    assert one(spark, text.heading_from_text(F.col("t")), t="第一章 总则\n正文") == "总则"
    assert one(spark, text.heading_from_text(F.col("t")), t="just text") == ""
    assert one(spark, text.heading_from_text(F.col("t")), t="\n  # set in \nx") == "set in" and one(spark, text.heading_from_text(F.col("t")), t="1.2 中文标题") == "中文标题"
    long = "key" + "x" * 500
    assert one(spark, text.snippet(F.col("t"), "KEY"), t=long) == long[:83] + "..."
    assert one(spark, text.snippet(F.col("t"), "absent"), t=long) == long[:160]
    assert one(spark, text.clean_rewrite(F.col("t")), t='user: "what is it"') == "what is it"


def _values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "v double")


def _otsu(xs):
    a = np.asarray(xs, dtype=float)
    if len(a) < 2 or a.max() == a.min():
        return float(a.max())
    hist, edges = np.histogram(a, bins=min(20, len(a)))
    best, cut, wb, sb = 0.0, float(a.max()), 0, 0.0
    for i, h in enumerate(hist):
        wb, sb = wb + h, sb + h * (edges[i] + edges[i + 1]) / 2
        wf = len(a) - wb
        if wb and wf:
            v = wb * wf * (sb / wb - (a.sum() - sb) / wf) ** 2
            if v > best * (1 + 1e-12):
                best, cut = v, (edges[i] + edges[i + 1]) / 2
    return cut


def test_thresholds(spark):
    t = lambda f, xs, *a: f(_values(spark, xs), "v", *a).first().threshold
    assert t(stats.percentile_threshold, [1, 2, 3, 10]) == pytest.approx(8.95)
    assert t(stats.mad_threshold, [4, 4, 4, 4]) == 8.0
    assert t(stats.mad_threshold, [1, 2, 3, 4, 100]) == pytest.approx(3 + 3 / 0.6745)
    assert t(stats.tukey_threshold, [4, 4, 4, 4]) == 8.0
    assert t(stats.otsu_threshold, [7, 7, 7]) == 7.0
    for xs in ([1, 1, 2, 2, 30, 31], [1, 5, 9, 9, 40, 41, 42, 80, 3, 3, 3], list(range(50)) + [200, 210]):
        assert t(stats.otsu_threshold, xs) == pytest.approx(_otsu(xs))


def _winsor(spark, xs):
    df = _values(spark, xs)
    return [r.s for r in df.crossJoin(stats.winsor_bounds(df, "v")).select("v", stats.winsor_scale(F.col("v"), F.col("lo"), F.col("hi")).alias("s")).orderBy("v").collect()]


def test_winsor_and_vectors(spark):
    assert _winsor(spark, [1, 2, 3]) == [0, 0.5, 1] and _winsor(spark, [5] * 4) == [1.0] * 4
    q = F.array(F.lit(1.0), F.lit(0.0))
    df = spark.createDataFrame([([2.0, 0.0],), ([0.0, 0.0],), (None,)], "e array<double>")
    assert [round(r.c, 6) for r in df.select(V.cosine(F.col("e"), q).alias("c")).collect()] == [1.0, 0.0, 0.0]
    assert spark.range(1).select(rank.decayed(F.lit(0.5), F.lit(2), P).alias("x")).first().x == pytest.approx(0.18)


def test_frontier_filter_branches(spark):
    def run(degrees, seeds=False, **k):
        df = spark.createDataFrame([(f"e{i:02}", d) for i, d in enumerate(degrees)], "entity_id string, degree long")
        rows = expand.degree_filter(df, SearchParams(**k), seeds).collect()
        return {r.entity_id for r in rows if r.kept}, {r.entity_id for r in rows if r.rejected}

    assert run([60, 70]) == ({"e00", "e01"}, set())  # nothing left: all are kept
    assert run([1, 2, 60]) == ({"e00", "e01"}, {"e02"})
    kept, gone = run([1] * 12 + [40, 45])  # an outlier drop may return
    assert kept == {f"e{i:02}" for i in range(12)} and gone == set()
    kept, gone = run([1] * 12 + [40, 45], seeds=True)  # for seeds it may not
    assert gone == {"e12", "e13"}
    assert run([1, 60], seeds=True, degree_most=0) == ({"e00", "e01"}, set())
    kept, _ = run([1, 1, 1] + [20] * 8 + [60])  # too few left and the limit removed some: the limit alone decides
    assert len(kept) == 11


def test_expansion_depths(spark):
    links = spark.createDataFrame([(f"v{i}", f"n{j}") for i, j in [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2), (2, 3), (4, 3)]], "event_id string, entity_id string")
    seeds = spark.createDataFrame([("v0",)], "event_id string")
    found = {r.event_id: r.depth for r in expand.expand(seeds, links, SearchParams(strategy="multi", max_hops=3)).collect()}
    assert found == {"v0": 0, "v1": 1, "v2": 2, "v4": 3}


def test_fusion(spark):
    f = lambda ids: spark.createDataFrame([(str(i), k) for k, i in enumerate(ids)], "chunk_id string, pos int")
    got = lambda p, a, b: [r.chunk_id for r in rank.fuse(f(a), f(b), p).orderBy("pos").collect()]
    assert got(P, [1, 2], [2, 3, 4, 5, 6, 7, 8, 9]) == list("123456789")
    assert got(SearchParams(fusion="supplement"), [1, 2], [2, 3, 4, 5]) == list("12345")


def test_tables_of_sheets():
    rows = "#TITLE#T\n#GROUP_HEADER#g,h\n#DATA#a,b\n#DATA#1,2\n#DATA#a,2\n#DATA#\"x,y\",3\n#DATA#合计,5"
    (sheet, chunk), = chunking.table_chunks(rows, 4000)
    assert chunk == "标题: T\n表头: a | b\n\na: 1\nb: 2\n\nb: 2\n\na: x,y\nb: 3\n\n[汇总] a: 合计\nb: 5\n\n"
    assert len(chunking.table_chunks("a,b\n" + "\n".join(f"{i},{'x' * 100}" for i in range(20)), 512)) == 5  # four rows of 110 or 111 characters and the header fit


def test_splitting(spark):
    docs = spark.createDataFrame([("1", "s", "T.md", "# A\ntext\n# B\nmore", "md"), ("2", "s", "U", "One. Two. " * 30, "txt"), ("3", "s", "V", " ", "txt"), ("4", "s", "W", None, None)], "id string, source_id string, title string, content string, file_type string")
    rows = chunking.split_documents(docs, IngestParams(chunk_size=100, overlap=20)).orderBy("document_id", "rank_index").collect()
    assert [(r.document_id, r.heading) for r in rows[:2]] == [("1", "A"), ("1", "B")]
    assert {r.heading for r in rows if r.document_id == "2"} == {"U"} and all(len(r.content) <= 100 for r in rows) and {r.document_id for r in rows} == {"1", "2"}


def test_html_cells_with_spans():
    assert layout.html_cells("<table><tr><td rowspan=2>x</td><td>1</td></tr><tr><td>2</td></tr></table>") == [(0, 0, 0, 2, 1, "x"), (0, 0, 1, 1, 1, "1"), (0, 1, 1, 1, 1, "2")]
    assert layout.clean_cell("total  total  ") == "total" or layout.clean_cell("abcabc") == "abc"


def test_layout(spark):
    blocks = spark.createDataFrame([(1, "b", 50, 0, 60, 10), (1, "a", 0, 1, 10, 11), (1, "c", 0, 40, 10, 50)], "page_id long, text string, x0 int, y0 int, x1 int, y1 int")
    assert [r.text for r in layout.reading_order(blocks).orderBy("pos").collect()] == ["a", "b", "c"]
    boxes = spark.createDataFrame([(1, 7, 0, 0, 20, 20)], "page_id long, box_id int, bx0 int, by0 int, bx1 int, by1 int")
    assert [r.text for r in layout.blocks_in_boxes(blocks, boxes).collect()] == ["a"]
    assert sorted((r.x0, r.column) for r in layout.column_clusters(blocks, 20).collect()) == [(0, 0), (50, 1)]


def test_reading_order_without_a_call_for_each_page(spark):
    rng = np.random.default_rng(5)
    blocks = [(p, str(t), int(x), None if rng.random() < 0.05 else int(y), int(y + h)) for p in range(300) for t, (x, y, h) in enumerate(rng.integers([0, 0, 5], [9, 60, 20], (rng.integers(1, 12), 3)))]
    told = []
    for p in range(300):
        line, held, numbered = -1, [], []
        for t, x, y, z in sorted((b[1:] for b in blocks if b[0] == p), key=lambda b: (b[2] is None, 0 if b[2] is None else (b[2] + b[3]) / 2, b[1], b[0])):
            if y is None or not held or abs((y + z) / 2 - sum(m for m, _ in held) / len(held)) > 0.6 * max(sum(h for _, h in held) / len(held), z - y):
                line, held = line + 1, []
            held = [] if y is None else [*held, ((y + z) / 2, z - y)]
            numbered.append((line, x, t))
        told += [(p, t, line, pos) for pos, (line, x, t) in enumerate(sorted(numbered))]
    df = layout.reading_order(spark.createDataFrame(blocks, "page_id long, text string, x0 int, y0 int, y1 int").withColumn("x1", F.col("x0") + 5))
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()  # a Python call for each page doesn't scale with pages
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # pages go on over batches
    try:
        assert sorted((r.page_id, r.text, r.line, r.pos) for r in df.collect()) == sorted(told)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def _zip(files):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return b.getvalue()


def test_workbook_and_word(tmp_path, spark):
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    c = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = f'<worksheet {m}><sheetData><row r="1">{c("A1", "Report")}</row><row r="2">{c("A2", "item")}{c("B2", "n")}</row><row r="3">{c("A3", "x")}<c r="B3"><v>5</v></c></row><row r="4"><c r="B4" s="1"><v>0.25</v></c></row><row r="5" hidden="1">{c("A5", "no")}</row></sheetData><mergeCells><mergeCell ref="A3:A4"/></mergeCells></worksheet>'
    book = _zip({"xl/workbook.xml": f'<workbook {m}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": sheet, "xl/styles.xml": f'<styleSheet {m}><cellXfs><xf numFmtId="0"/><xf numFmtId="9"/></cellXfs></styleSheet>'})
    assert office.workbook_text(book) == "=== S ===\n#TITLE#Report,\n#DATA#item,n\n#DATA#x,5\n#DATA#x,25%"
    assert office.workbook_arrays(book)["S"] == [["Report", None], ["item", "n"], ["x", 5], ["x", "25%"]]
    assert office.workbook_sections(book)[0]["rows"] == [{"item": "x", "n": "5"}, {"item": "x", "n": "25%"}] and office.workbook_sections(book)[0]["title"] == "Report"
    assert office.workbook_markdown(book) == "## S\n\n### Report\n\n| item | n |\n|---|---|\n| x | 5 |\n| x | 25% |"
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    doc = _zip({"word/document.xml": f'<w:document {w}><w:body>{p("Head", "Heading1")}{p("Text")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl></w:body></w:document>', "word/styles.xml": f'<w:styles {w}><w:style w:styleId="Heading1"><w:name w:val="heading 1"/></w:style></w:styles>'})
    assert office.word_text(doc) == "# Head\n\nText\n\n| a | b |\n|---|---|"
    for name, data in {"a.xlsx": book, "b.docx": doc, "c.csv": "名,1".encode("gbk"), "d.txt": b"hello", "e.zzz": b"x", "~$f.txt": b"lock", "g.xlsx": b"bad", "h.txt": b" "}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.title: r for r in readers.load_files(spark, str(tmp_path)).collect()}
    assert set(got) == set("abcdegh") and got["c"].content == "名,1" and got["d"].file_type == "txt"
    assert [bool(got[k].error) for k in "abcdegh"] == [False, False, False, False, True, True, True]


def test_ingest_search_delete(spark, tmp_path):
    catalog = readers.Catalog(spark, str(tmp_path / "kb"))
    docs = spark.createDataFrame([("p1", "Alpha", "Alpha Works signed a lease. The lease runs long.", "p1", "txt", None), ("p2", "Beta", "Beta Ltd sold a pump to Alpha Works.", "p2", "txt", None), ("p3", "Bad", None, "p3", "txt", "broken")], readers.LOADED)
    known = [("organization", "Alpha Works"), ("organization", "Beta Ltd"), ("product", "pump")]
    assert plan.ingest(catalog, docs, known) == 1
    t = catalog.all()
    assert (t["sources"].count(), t["chunks"].count(), t["events"].count(), t["entities"].count(), t["links"].count()) == (2, 2, 2, 3, 4)
    assert plan.ingest(catalog, docs, known) == 2 and catalog.read("sources").count() == 2  # nothing new
    result = search_plan.search(catalog.all(), "Who sold the pump to Alpha Works?", SearchParams(similarity_threshold=0.05))
    rows = result.sections.orderBy("pos").collect()
    assert rows and {r.source_name for r in rows} <= {"Alpha", "Beta"} and result.trace.filter("stage = 'seeds'").count() >= 1
    own = catalog.read("sources").filter("name = 'Beta'").first().id
    plan.delete(catalog, own)
    t = catalog.all()
    assert (t["sources"].count(), t["entities"].count(), t["links"].count()) == (1, 1, 1)
    assert t["vectors"].filter("collection = 'entities'").count() == 1
    assert search_plan.search(t, "  ").sections.count() == 0 and providers.answer("q", " ") == providers.NO_ANSWER


def test_ingest_stream(spark, tmp_path):
    folder, catalog = str(tmp_path / "in"), readers.Catalog(spark, str(tmp_path / "kb"))
    spark.createDataFrame([("p", "Gamma", "Gamma text here.", "p", "txt", None)], readers.LOADED).write.parquet(folder)
    stream = spark.readStream.schema(readers.LOADED).parquet(folder)
    ingest_stream(catalog, stream, str(tmp_path / "cp")).awaitTermination(120)
    assert catalog.version() == 1 and catalog.read("chunks").count() == 1


def test_store_rules(spark):
    v = spark.createDataFrame([("chunks", "1", "a"), ("entities", "1", "b")], "collection string, id string, text string")
    batch = spark.createDataFrame([("chunks", "1", "x", 0), ("chunks", "1", "y", 1)], "collection string, id string, text string, pos int")
    assert sorted(r.text for r in store.add_vectors(v, batch).collect()) == ["b", "x"]
    assert providers.detect_genre("t", "c", "xlsx") == "tabular" and providers.rewrite("q", []) == "q"
    with pytest.raises(ValueError):
        office.check_workbook("a.xls", b"PK\x03\x04")


def test_rules_of_lists_roles_and_flags(spark):
    assert one(spark, text.clean_text(F.col("t"), F.col("k")), t="grew by\n3.5 percent in\n2024.06 report", k="txt") == "grew by 3.5 percent in 2024.06 report"
    assert one(spark, text.clean_text(F.col("t"), F.col("k")), t="a\n1) b\n2. c\n+ d\n• e", k="txt") == "a\n1) b\n2. c\n+ d\n• e".replace("\n• e", "\n• e")
    assert one(spark, text.clean_text(F.col("t"), F.col("k")), t="x\n• y", k="txt") == "x • y"
    assert one(spark, text.strip_roles(F.col("t")), t="#DATA#1\n#ABC#2\nx#DATA#") == "1\n#ABC#2\nx#DATA#"
    assert chunking.role_rows("#ABC#a,b\n#FORM#c") == [("data", ["#ABC#a", "b"]), ("form", ["c"])]
    assert [one(spark, text.parse_flag(F.col("t"), True), t=v) for v in (" On", "0", "yes", "no", " ")] == [True, False, True, True, None]
    assert one(spark, text.clean_text(F.col("t"), F.col("k"), spaces=False, hard_breaks=False, blank_lines=False), t=" a  b\r\nc\n\n\n\n", k="txt") == " a  b\nc\n\n\n\n"
    assert one(spark, text.clean_text(F.col("t"), F.col("k"), protect_lists=False), t="a\n- b\n\nc", k="txt") == "a - b\n\nc"


def _sources(spark, *ids):
    return spark.createDataFrame([(i, i.upper()) for i in ids], "id string, name string").selectExpr("id", "name", "cast(null as string) as description", "id as md5", "true as vector_synced", "cast(null as timestamp_ntz) as archived_at", "cast(null as timestamp_ntz) as created_at", "cast(null as timestamp_ntz) as updated_at")


def test_a_crash_between_writing_and_publishing_leaves_the_version_before(spark, tmp_path, monkeypatch):
    catalog = readers.Catalog(spark, str(tmp_path / "kb"))
    assert catalog.version() == 0 and catalog.read("sources").count() == 0
    catalog.publish({"sources": _sources(spark, "a")})
    commit = readers.Catalog._commit

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(readers.Catalog, "_commit", crash)
    with pytest.raises(OSError):
        catalog.publish(added={"sources": _sources(spark, "b")})
    monkeypatch.setattr(readers.Catalog, "_commit", commit)
    again = readers.Catalog(spark, str(tmp_path / "kb"))
    assert again.version() == 1 and [r.id for r in again.read("sources").collect()] == ["a"]
    assert again.publish(added={"sources": _sources(spark, "c")}) == 2 and again.read("sources").count() == 2
    assert again.read("sources", 1).count() == 1  # the version before stays readable


def test_of_two_writers_one_gets_a_conflict(spark, tmp_path):
    one_, two = (readers.Catalog(spark, str(tmp_path / "kb")) for _ in range(2))
    base = one_.version()
    one_.publish({"sources": _sources(spark, "a")}, base=base)
    with pytest.raises(readers.Conflict):
        two.publish({"sources": _sources(spark, "b")}, base=base)
    assert [r.id for r in two.read("sources").collect()] == ["a"]
    parts = two.manifest()
    assert two.publish(added={"sources": _sources(spark, "b")}) == 2 and two.manifest()["sources"][0] == parts["sources"][0]
    assert two.publish(rewritten={"sources": lambda x: (x.filter("id = 'b'"), x.filter("id != 'b'"))}) == 3
    assert two.manifest()["sources"][0] == parts["sources"][0] and [r.id for r in two.read("sources").collect()] == ["a"]
    assert two.compact("sources") == 4 and two.clean(1) > 0 and two.read("sources").count() == 1


def test_a_rebuilt_source_is_replaced_in_one_version(spark, tmp_path):
    catalog = readers.Catalog(spark, str(tmp_path / "kb"))
    row = lambda title, content: spark.createDataFrame([("p", title, content, "p", "txt", None)], readers.LOADED)
    known = [("organization", "Alpha Works"), ("organization", "Beta Ltd")]
    plan.ingest(catalog, row("Alpha", "Alpha Works signed a lease."), known)
    own = catalog.read("sources").first().id
    assert plan.rebuild(catalog, own, row("other", "Beta Ltd signed a lease."), known=known) == 2
    t = catalog.all()
    assert [r.name for r in t["sources"].collect()] == ["Alpha"] and t["documents"].count() == t["events"].count() == t["chunks"].count() == 1
    assert [r.name for r in t["entities"].collect()] == ["Beta Ltd"] and t["vectors"].filter("collection = 'entities'").count() == 1
    assert plan.rebuild(catalog, t["sources"].first().id, row("other", "Beta Ltd signed a lease.")) == 2
    assert {r.what: r.n for r in search_plan.stats(t).collect()}["links"] == 1 and search_plan.sources(t).first().n_chunks == 1


def test_semantic_splitting():
    alike = lambda texts: [[1.0, 0.0] if "sea" in t else [0.0, 1.0] for t in texts]
    content = "The sea is calm. A sea bird. More sea. Now of taxes. Taxes rise. Taxes fall."
    assert chunking.semantic_parts(content, 80, alike) == ["The sea is calm. A sea bird. More sea.", "Now of taxes. Taxes rise. Taxes fall."]
    assert chunking.semantic_parts("One. Two.", 95, alike) == ["One. Two."]


def test_models_of_the_scenes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(providers, "REGISTRY", {})
    providers.register("extract", lambda prompt: '{"title": "T", "summary": "' + ("after" if "What came before" in prompt else "first") + '", "entities": [{"type": "person", "name": "Ann", "weight": 0.9}]}')
    rows = spark.createDataFrame([("c1", "d", 0, "h", "x", "generic"), ("c2", "d", 1, "h", "y", "generic"), ("c3", "e", 0, "h", "z", "tabular"), ("c4", "e", 1, "h", "z", "tabular")], "id string, document_id string, rank_index int, heading string, content string, genre string")
    told = {r.id: r.event.summary for r in providers.extract_events(rows, []).collect()}
    assert told == {"c1": "first", "c2": "after", "c3": "first", "c4": "first"}
    assert {r.event.summary for r in providers.extract_events(rows, [], p=IngestParams(parallel=True)).collect()} == {"first"}
    providers.register("entities", lambda prompt: '["Ann", "Bob"]')
    entities = spark.createDataFrame([("1", "ann", "Ann"), ("2", "bobby", "Bobby")], "id string, normalized_name string, name string")
    assert [r.entity_id for r in providers.query_entities("who?", entities).collect()] == ["1"]
    providers.register("entities", lambda prompt: "no list")
    assert providers.query_entities("who?", entities).count() == 0
    providers.register("rerank", lambda prompt: "2, 9, 0, 2")
    coarse = spark.createDataFrame([("a", 0.9, 0), ("b", 0.8, 1), ("c", 0.7, 2)], "event_id string, score double, pos int")
    depths, counts = spark.createDataFrame([], "event_id string, depth int"), spark.createDataFrame([], "event_id string, strong long, medium long, weak long")
    texts = spark.createDataFrame([("a", "A", "s")], "event_id string, title string, summary string")
    run = lambda order: [r.event_id for r in rank.rerank_with(coarse, depths, counts, texts, order, P).orderBy("pos").collect()]
    assert run(providers.model_order("q")) == ["c", "a", "b"]

    def fails(rows):
        raise OSError

    assert run(fails) == ["a", "b", "c"] and run(None) == ["a", "b", "c"]


def test_pages_are_checked():
    with pytest.raises(ValueError):
        store.checked_page(501)
    with pytest.raises(ValueError):
        store.checked_page(5, 0, "context")
    assert store.checked_page(100, 3, "search") == (100, 3) and store.changes(a=None, b=1) == {"b": 1} and not store.changes(a=None)


def test_fill_down_keeps_to_data_rows_and_word_tables_have_sections():
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    c = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    sheet = f'<worksheet {m}><sheetData><row r="1">{c("A1", "Report")}</row><row r="2">{c("B2", "Signed by: X")}{c("C2", "2020")}</row><row r="3">{c("A3", "item")}{c("B3", "n")}</row><row r="4">{c("A4", "x")}{c("B4", "1")}</row><row r="5">{c("B5", "2")}</row></sheetData><mergeCells><mergeCell ref="A1:A2"/><mergeCell ref="A4:A5"/></mergeCells></worksheet>'
    book = _zip({"xl/workbook.xml": f'<workbook {m}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": sheet})
    assert office.workbook_text(book) == "=== S ===\n#TITLE#Report,,\n#SIGNING#,Signed by: X,2020\n#DATA#item,n,\n#DATA#x,1,\n#DATA#x,2,"
    assert [(r["row"], r["col"], r["text"]) for r in office.workbook_raw(book)][-1] == (4, 1, "2") and len(office.workbook_raw(book)) == 8
    assert office._sections_markdown([["a", "b"], ["1", "2"], ["Part two", "Part two"], ["3", "4"]]) == "| a | b |\n|---|---|\n| 1 | 2 |\n\n**Part two**\n\n|  |  |\n|---|---|\n| 3 | 4 |"
    assert office.word_text(_zip({"word/document.xml": "<w:document><w:p><w:t>one &amp; two</w:t></w:p><w:p><w:t xml:space='preserve'>three</w:t></w:p>"})) == "one & two\n\nthree"
