"""Each operator against brute force, and its defined results for nulls, empty and very long texts, ties, repeats, empty tables and clashing columns."""

import math
import random
import re
import sys

import numpy as np
import pytest

pytest.importorskip("wovenkb.llm")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from wovenkb.llm import common, graph  # noqa: E402
from wovenkb.llm import p01_split as p1  # noqa: E402
from wovenkb.llm import p02_distinctive as p2  # noqa: E402
from wovenkb.llm import p03_neighbours as p3  # noqa: E402
from wovenkb.llm import p04_scans as p4  # noqa: E402
from wovenkb.llm import p05_lookalike as p5  # noqa: E402
from wovenkb.llm import p06_variants as p6  # noqa: E402
from wovenkb.llm import p07_markup as p7  # noqa: E402
from wovenkb.llm import p08_tokenize as p8  # noqa: E402
from wovenkb.llm import p09_leaks as p9  # noqa: E402
from wovenkb.llm import p10_repetition as p10  # noqa: E402

TEXT = st.text(alphabet="ab c.\n中文。，é", max_size=400)


# 1


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(5, 60), st.integers(0, 4))
def test_split_covers_the_text(text, limit, overlap):
    spans = p1.split_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    for (a, b), (c, e) in zip(spans, spans[1:]):
        assert a < c <= b < e and b - c <= overlap


def test_split_prefers_natural_boundaries():
    text = "First sentence here. " * 10 + "\n\n" + "Second part. " * 20
    for a, b in p1.split_spans(text, 100, 20)[:-1]:
        assert text[b - 1].isspace() or text[b - 1] in ".。"


def test_split_by_token_lengths():
    text = "abcdefghij"
    spans = p1.split_spans(text, 6, 0, np.full(10, 2))
    assert spans == [(0, 3), (3, 6), (6, 9), (9, 10)]


def test_split_frames(spark):
    rows = [("a", "d", None, 3, None), ("b", "d", "h", None, ""), ("c", "d", "h", 9, "x" * 5000), ("c", "d", "h", 9, "x" * 5000), ("e", None, None, 1, "y" * 2048)]
    df = spark.createDataFrame(rows, "id string, document_id string, heading string, rank_index int, content string").selectExpr("*", "1 as piece")
    out = {(r.chunk_id, r.piece): r for r in p1.split_chunks(df).collect()}
    assert sorted(k for k in out) == [("a", 0), ("b", 0), ("c", 0), ("c", 1), ("c", 2), ("e", 0)]
    assert out["a", 0].content is None and out["b", 0].content == ""
    assert sorted(r.rank_index for k, r in out.items() if k[0] != "e") == [0, 1, 2, 3, 4]
    assert out["c", 1].heading == "h" and out["c", 0].end_at - out["c", 1].start_at == 200
    assert p1.split_chunks(df.limit(0)).count() == 0


def test_split_frames_by_tokens_and_bytes(spark):
    text = "Größe und Maß. " * 40 + "文字的长度不同。" * 30
    df = spark.createDataFrame([("a", text), ("b", None), ("c", "")], "id string, content string")
    for lengths, limit, overlap in ((p1.token_lengths(), 60, 8), (p1.byte_lengths, 120, 20)):
        own = lengths(text)
        assert own.sum() == (len(p8._encoder("byte_bpe_50k", p8.VOCABULARY_DIR).encode_ordinary(text)) if limit == 60 else len(text.encode()))
        pieces = sorted((r.piece, r.start_at, r.end_at) for r in p1.split_pieces(df, limit=limit, overlap=overlap, lengths=lengths).filter("id = 'a'").collect())
        assert pieces[0][1] == 0 and pieces[-1][2] == len(text) and all(own[a:b].sum() <= limit for _, a, b in pieces)
        assert all(a < c <= b and own[c:b].sum() <= overlap for (_, a, b), (_, c, _) in zip(pieces, pieces[1:]))


def test_ranks_of_a_document_without_old_ranks_are_running(spark):
    rows = [(f"{i:03}", "d" if i % 3 else None, None if i % 2 else 7, "x" * (100 + 50 * i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id string, document_id string, rank_index int, content string").selectExpr("*", "cast(null as string) as heading")
    got: dict = {}
    for r in p1.split_chunks(df, limit=500, overlap=50).collect():
        got.setdefault(r.document_id, []).append((r.rank_index, r.chunk_id, r.piece))
    for own in got.values():
        assert [k for k, _, _ in sorted(own)] == list(range(len(own)))
        by_rank = [(7 if int(i) % 2 == 0 else -1, i, k) for _, i, k in sorted(own)]
        assert by_rank == sorted(by_rank)


# 2


def test_z_falls_with_the_number_of_records(spark):
    n = 50_000
    df = spark.range(1, 3000).selectExpr("cast(id as double) y", f"cast({n} as double) n", "cast(7 as double) s")
    z = [r.z for r in df.select(p2.log_odds_z(p2.F.lit(1.0), p2.F.col("s"), p2.F.col("y"), p2.F.col("n")).alias("z"), "y").orderBy("y").collect()][1:]
    assert all(a > b for a, b in zip(z, z[1:]))


def test_distinctive_edge_cases(spark):
    rows = [("e1", "a"), ("e1", "a"), ("e1", "b"), ("e2", "a"), ("e2", "c"), ("e3", "c"), ("e3", None), (None, "a"), ("e4", "z")] + [(f"x{i}", "hub") for i in range(30)] + [("e1", "hub")]
    df = spark.createDataFrame(rows, "event_id string, entity_id string").selectExpr("*", "1 as n_records", "2 as z")
    s = p2.distinctive_terms(df)
    assert s.count() == 31 + 6
    best = {(r.event_id, r.entity_id) for r in p2.most_characteristic(s).collect()}
    assert best == {("e1", "a"), ("e2", "a"), ("e2", "c"), ("e3", "c")} | {(f"x{i}", "hub") for i in range(30)}
    assert p2.distinctive_terms(df.limit(0)).count() == 0


# 3


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(30, 64))
    x = centres[rng.integers(0, 30, 900)] + 0.8 * rng.normal(size=(900, 64))
    x[1] = x[0]
    rows = [("c", f"{i:04}", [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [("c", "bad1", None), ("c", "bad2", [1.0] * 48), ("c", "bad3", [0.0] * 64), ("c", "bad4", [math.nan] * 64), rows[5], ("one", "z", [1.0] * 64), (None, "n", [1.0] * 64)]
    df = spark.createDataFrame(rows, "collection string, id string, embedding array<float>").selectExpr("*", "1 as shard", "2 as rank")
    got = {}
    for r in p3.nearest(df, shard=300).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -3)
    top = np.argsort(-s, axis=1)[:, :5]
    hit = sum(len(got[f"{i:04}"] & {f"{j:04}" for j in top[i]}) for i in range(900))
    assert hit / 4500 >= 0.9
    assert "0001" in got["0000"] and len(got) == 900
    assert p3.nearest(df.limit(0)).count() == 0


def test_neighbours_where_most_shards_are_not_asked(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 1500)] + 0.6 * rng.normal(size=(1500, 64))
    df = spark.createDataFrame([("c", f"{i:04}", [float(v) for v in r]) for i, r in enumerate(x)], "collection string, id string, embedding array<float>")
    assert len(p3.fit_shards(p3.valid_vectors(df), 45)["c"]) >= 5 * p3.PROBES
    got: dict = {}
    for r in p3.nearest(df, shard=45).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -3)
    top = np.argsort(-s, axis=1)[:, :5]
    assert sum(len(got[f"{i:04}"] & {f"{j:04}" for j in top[i]}) for i in range(1500)) / 7500 >= 0.9


def test_every_node_of_a_graph_is_reachable():
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.002 * rng.normal(size=(40, 64)) for c in rng.normal(size=(25, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph, entries = p3.build_graph(x)
    assert p3.reachable(graph, entries).all()
    few = np.array([0], dtype=np.int32)
    broken = graph.copy()
    broken[broken >= 500] = -1
    assert not p3.reachable(broken, few).all() and p3.reachable(p3.connect(x, broken, few), few).all()


# 4


def _vocabulary(n=100):
    words = "the valuation of inspection record keeping long-term lease archive committee until and".split()
    counts = dict.fromkeys(words, n)
    return p4.Vocabulary(counts, 1000, frozenset())


def test_scan_repair():
    page = "ACME Annual Report 2016\n{} the valu-\nation of the long-\nterm lease unti1 2O21 and\nthe record\n- {} -\n"
    first = ("archive committee", "record keeping", "inspection until")
    text = "".join(page.format(first[i - 4], i) + "\f" for i in range(4, 7))
    kinds, fixed = p4.repair(text, _vocabulary())
    assert kinds == ["hyphen", "misread", "header", "page_number"]
    assert "valuation" in fixed and "long-term" in fixed and "until 2021" in fixed and "Report" not in fixed and "- 5 -" not in fixed
    assert p4.repair(None, _vocabulary()) == ([], None) and p4.repair("", _vocabulary()) == ([], "")


def test_scan_leaves_clean_text_alone():
    text = "The record of the lease under file DK-23K3 and\nthe archive until 2021.\n\nOpen points\nThe lease of the record.\n\nOpen points\nThe archive of the committee."
    assert p4.repair(text, _vocabulary())[0] == []


def test_scan_guards_dont_depend_on_size():
    counts = {"invoice": 500, "invoicc": 5, "iron": 500, "form": 500, "of": 5000, "archive": 500, "board": 500}
    for size in (1, 200):
        v = p4.Vocabulary({w: n * size for w, n in counts.items()}, 10000 * size, frozenset())
        assert p4.repair("of the invoicc of\nthe board.\nInvoicc of the form. Iron of the form.", v) == (["misread"], "of the invoice of the board. Invoice of the form. Iron of the form.")
        assert not p4.joins("archive", "board", v)
    v = p4.Vocabulary({"archive": 80, "board": 80, "of": 10**6}, 10**7, frozenset())
    assert p4.joins("archive", "board", v)


def test_scan_counts_of_rare_words_are_exact(spark, monkeypatch):
    long = "of the\n" * 300
    texts = [long, *["the east of\nthe signed"] * 7, "the cast of\nthe siqned", "the long-term of\nthe term", "of the long-\nterm of the\nlong term", "long term\n" * 20, "Eust of the\neust of", "the siqn-\ned of"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, content string")
    for common in (1e-6, 0.05):
        monkeypatch.setattr(p4, "COMMON", common)
        out = {r.id: r for r in p4.repair_scans(df).collect()}
        assert len(out) == len(texts)
        # 'cast' occurs once, 'east' 7 times: not 8 times as often; 'siqned' is corrected only where its own count allows it.
        assert out["8"].repaired_text == "the cast of the siqned" and out["8"].noise == []
        assert "long-term" in out["10"].repaired_text and out["10"].noise == []
    more = df.unionByName(spark.createDataFrame([(f"m{i}", "the signed\nthe east") for i in range(3)], "id string, content string"))
    for common in (1e-6, 0.05):
        monkeypatch.setattr(p4, "COMMON", common)
        out = {r.id: r for r in p4.repair_scans(more).collect()}
        assert out["8"].repaired_text == "the east of the signed" and out["8"].noise == ["misread"]
        assert out["13"].noise == ["hyphen", "misread"] and out["13"].repaired_text == "the signed of"


def test_scan_frames(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "one line"), ("c", "one line"), (None, "x\n" * 5000)], "id string, content string").selectExpr("*", "1 as noise")
    out = p4.repair_scans(df).collect()
    assert len(out) == 5 and all(r.noise == [] for r in out if r.id in ("a", "b", "c"))
    assert p4.repair_scans(df.limit(0)).count() == 0


def test_marked_and_single_lines_are_repaired_too(spark):
    words = "the modern contract was signed in the office of the company by the clerk".split()
    docs = [(f"d{i}", " ".join(words)) for i in range(60)]
    docs += [("one", "the contract was siqned in the office"), ("marked", "# Head\n\nthe **contract** was siqned in the office\n\n```\nx = siqned\n```\n- siqned"), ("two", "the contract of the office was\nsiqned by the com-\npany")]
    got = {r.id: r for r in p4.repair_scans(spark.createDataFrame(docs, "id string, content string")).collect()}
    assert got["one"].noise == ["misread"] and got["one"].repaired_text == "the contract was signed in the office"
    assert got["marked"].noise == ["misread"] and got["marked"].repaired_text == "# Head\n\nthe **contract** was signed in the office\n\n```\nx = siqned\n```\n- siqned"
    assert got["two"].noise == ["hyphen", "misread"] and got["two"].repaired_text == "the contract of the office was signed by the company"


def test_header_lines_may_differ_by_a_letter():
    pages = [f"Report on the harbour dues {n}" for n in (1, 2, 3)]
    pages[1] = pages[1].replace("harbour", "harbur")
    text = "\f".join(f"{h}\n{w} of the text that runs on\nand more of {w}" for h, w in zip(pages, ("Boats", "Ferries", "Bridges")))
    page = p4.Page(text)
    assert sorted(page.lines[i] for i in page.headers) == sorted(pages)
    long = "Minutes of the committee on harbours, ferries and bridges of the northern districts with an appendix of all tolls and dues levied"
    page = p4.Page("\f".join(f"{long}\n{w} of the text that runs on\nand more of {w}" for w in ("Boats", "Ferries", "Bridges")))
    assert len(page.headers) == 3


def test_scan_repair_steps_go_with_distinct_words_and_lines():
    page = "ACME Annual Report 2016\n" + "the record of the archive committee until the inspection of the lease\n" * 20 + "the unti1 lease\n- {} -\n"
    text = "\f".join(page.format(i) for i in range(1, 21))
    v = p4.Vocabulary({w: 400 for w in text.lower().split() if w.isalpha()}, 10**4, frozenset({"annual report #"}))
    steps = 0

    def count(frame, event, arg):
        nonlocal steps
        steps += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        kinds, body = p4.without_furniture(text, v)
        p4.asked(body, v)
        kinds, fixed = p4.repair_words(kinds, body, v)
    finally:
        sys.setprofile(None)
    assert kinds == ["misread", "header", "page_number"] and "unti1" not in fixed and fixed.count("the until lease") == 20
    assert steps < 2.5 * len(text.split())


NOISE = st.text(alphabet="abilorns1530OISB|'’-¬ \t\n\f\xa0.,:/·—第页日曰年\u0663", max_size=60)


@settings(max_examples=500, deadline=None)
@given(NOISE)
def test_scan_patterns_equal_their_plain_forms(text):
    h = re.escape(p4.HYPHENS)
    assert p4._LOWER.findall(text) == re.findall(r"(?<![\w’'-])[a-z]{2,}(?:-[a-z]+)*(?![\w’'-])", text)
    assert p4._MIXED.findall(text) == re.findall(rf"(?<![\w’'{p4.HYPHENS}])[A-Za-z0-9|]+(?![\w’'-])", text)
    assert bool(p4._PARTED.search(text)) == bool(re.search(r"\s\s|[\t|·—/]", text))
    assert bool(p4._DIGIT_LETTER.search(text)) == bool(re.search(r"\d[.,]?[OolISBZ]|[OolISBZ][.,]?\d", text))
    assert p4._LONE.sub("#", text) == re.sub(r"(?<![A-Za-z0-9-])[OolISB](?=[年月日曰])", "#", text)
    assert p4._one_number(text.lower()) == re.sub(r"[oilsb|]*\d[\doilsb|]*", "#", text.lower())
    split = re.compile(rf"(?<![A-Za-z0-9|])([A-Za-z0-9|]+)[{h}][ \t]*\n[ \t]*([A-Za-z0-9|]+)")
    assert p4.divisions(text) == [(*m.span(), m[1], m[2]) for m in split.finditer(text)]
    lines = text.replace("\f", "\n\f\n").split("\n")
    beside = {i for i, x in enumerate(lines) if x.strip(" \t\f") and any("".join(y).strip(" \t")[:1] in ("", "\f") for y in (lines[i + 1 :], lines[:i][::-1]))}
    assert not hasattr(p4.Page(text), "beside") or p4.Page(text).beside == beside


# 5


def test_lookalikes_have_one_form(spark):
    model = p5.Model({("G", "a"): 9, ("a", "n"): 9, ("o", "z"): 9, ("^", "I"): 9, ("I", "n"): 9, ("n", "c"): 9, ("c", "$"): 9})
    assert {model.canonical(x) for x in ("Ganzozelde Inc", "Ganzοzelde Ιnc", "Ｇａｎｚｏｚｅｌｄｅ\u3000Ｉｎｃ", "Gan\u200bzo\u00adzelde\u202fInc")} == {"Ganzozelde Inc"}
    assert model.canonical("office") == model.canonical("oﬃce") and model.canonical("é") == model.canonical("e\u0301")
    assert len({model.canonical(x) for x in ("m2", "m²", "M2", "é", "e", "a-b", "b-a")}) == 7
    rows = [("1", "t", "Aa"), ("2", "t", "Аa"), ("3", "u", "Аa"), ("4", "t", None), (None, "t", "Aa"), ("5", "t", "Aa"), ("2", "t", "Аa")]
    df = spark.createDataFrame(rows, "id string, g string, name string")
    got = {(r.id_a, r.id_b) for r in p5.lookalike_pairs(df, "id", "name", "g", model).collect()}
    assert got == {("1", "2"), ("2", "5")}
    assert p5.lookalike_pairs(df.limit(0), "id", "name", "g", model).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="Aaocер Οοi\u0456x", max_size=12))
def test_lookalike_form_depends_on_the_look_alone(text):
    model = p5.Model({("a", "o"): 3})
    other = "".join(p5.CLASSES.get(ch, (ch,))[-1] for ch in text)
    assert model.canonical(text) == model.canonical(other)


def test_words_keep_the_script_of_their_other_letters():
    words = "вода город молоко хорошо слово δρόμος λόγος water model house cope score".split()
    counts = {}
    for w in words:
        for pair, n in p5.bigrams(p5.compatible(w)).items():
            counts[pair] = counts.get(pair, 0) + n
    for model in (p5.Model(counts), p5.Model({k: n for k, n in counts.items() if not any("\u0370" <= ch <= "\u03ff" for ch in k)})):
        for w in words:
            mixed = "".join({"о": "o", "ο": "о", "o": "ο", "а": "a", "a": "а", "e": "е", "е": "e", "ρ": "p", "c": "с"}.get(ch, ch) for ch in w)
            assert model.canonical(mixed) == model.canonical(w)
            if not set(w) <= set("cope score"):
                assert model.canonical(mixed) == w


def test_model_counts_all_neighbours(spark):
    df = spark.createDataFrame([("вода дом",), ("δρόμος",), (None,), ("",)], "t string")
    model = p5.fit_model(df, "t")
    assert model.counts[("д", "а")] == 1 and model.counts[("δ", "ρ")] == 1 and model.canonical("вoдa") == "вода" and model.canonical("δpόμoς") == "δρόμος"


# 6


def _edits(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=8), st.text(alphabet="abc", max_size=8))
def test_band_of_one(a, b):
    assert p6.within_one(a, b) == (_edits(a, b) <= 1)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", min_size=4, max_size=14), st.integers(0, 13), st.sampled_from("abcd"), st.sampled_from("idst"))
def test_segments_find_every_edit(a, at, ch, how):
    at %= len(a)
    b = {"i": a[:at] + ch + a[at:], "d": a[:at] + a[at + 1 :], "s": a[:at] + ch + a[at + 1 :], "t": a[:at] + a[at : at + 2][::-1] + a[at + 2 :]}[how]
    if len(b) < 4:
        return
    x, y = p6.segment_keys(a, "", 4, 2), p6.segment_keys(b, "", 4, 2)
    index = lambda k: {v for side, v in k if side}
    assert {v for _, v in x} & index(y) or {v for _, v in y} & index(x)


def test_formulas_of_any_length():
    long = "a + b - " * 1000 + "c"
    for formula in (f"${long}$", f"$${long}$$", f"\\[{long}\\]", f"\\({long}\\)"):
        assert p7._MATH.fullmatch(formula) and p7.kinds(f"So {formula} holds") == ["latex"]
    assert p7._MATH.fullmatch("\\[ a \\\\[2pt] b \\]")
    for open_mark in ("\\[ ", "\\( ", "$ ", "$$ x ", "$x "):
        p7.kinds(open_mark * 20000)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc", max_size=9), st.text(alphabet="abc", max_size=9), st.integers(0, 3))
def test_band_of_any_width(a, b, most):
    assert p6.distance(a, b, most) == min(_edits(a, b), most + 1)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abcd", min_size=4, max_size=16), st.integers(1, 3), st.lists(st.tuples(st.sampled_from("ids"), st.integers(0, 15), st.sampled_from("abcd")), max_size=3))
def test_one_of_k_and_one_segments_stays(a, k, edits):
    b = a
    for how, at, ch in edits[:k]:
        at %= max(1, len(b))
        b = {"i": b[:at] + ch + b[at:], "d": b[:at] + b[at + 1 :], "s": b[:at] + ch + b[at + 1 :]}[how]
    if min(len(a), len(b)) <= k:
        return
    x, y = p6.shifted_keys(a, "", k), p6.shifted_keys(b, "", k)
    index = lambda keys: {v for side, v in keys if side}
    assert {v for side, v in x if not side} & index(y) or {v for side, v in y if not side} & index(x)


def test_short_forms_are_learned_from_the_collection():
    lexicon = p6.Lexicon({"maximilian": 30, "konstantin": 40, "anna": 50, "hannah": 50}, {"fisheries": 40, "breweries": 50, "finance": 30, "inc": 90})
    assert [lexicon.word(x) for x in ("fshrs", "brwrs", "fin", "ii", "inc", "zzz")] == ["fisheries", "breweries", "finance", "ii", "inc", "zzz"]
    assert lexicon.roots("maxi") == ["maxi", "maximilian"] and lexicon.roots("konny") == ["konny", "konstantin"] and lexicon.roots("bob") == ["bob", "robert"] and lexicon.roots("anna") == ["anna"]
    assert p6.typed_alike("rizorhelmo", "konstntin", "rizorhalmo", "konstantin", 2, lexicon) and not p6.typed_alike("rizor", "anna", "rizor", "hanna", 0, lexicon)
    assert not p6.typed_alike("fund", "breweries ii", "fund", "breweries iii", 2, lexicon)


def test_two_edits_are_linked_between_equal_descriptions(spark):
    rows = [
        ("1", "person", "Konstanze Uhlenbrockmeier", "pilot, Rye"), ("2", "person", "Konstanze Uhlnbrockmeyer", "pilot, Rye"), ("3", "person", "Konstanzze Uhlenbrokmeier", "pilot at Rye"), ("4", "person", "Konstanze Uhlnbrockmeyrr", "baker, Rye"),
        ("5", "person", "Konstanze Ehlonbrickmeier", "pilot, Rye"), ("6", "person", "龚骁骐", "驾驶员"), ("7", "person", "龚晓琪", "驾驶员"), ("8", "person", "GONG XIAOQI", None), ("9", "person", "龚骁峻", "驾驶员"), ("10", "person", "Lü Ruihua", None), ("11", "person", "吕瑞桦", None), ("12", "person", "Lv Ruihua", None),
        *((f"f{i}", "organization", f"{name} Fisheries plc", None) for i, name in enumerate(("Quandorjan", "Wexlebury", "Marrowick", "Tolspinney", "Brackenfold"))), ("20", "organization", "Quandorjan Fshrs", None),
    ]
    by = {}
    for r in p6.link_variants(spark.createDataFrame(rows, "id string, entity_type string, name string, description string"), p5.Model({})).collect():
        by.setdefault(r["class"], set()).add(r.id)
    classes = sorted(map(sorted, by.values()))
    for own in (["1", "2", "3"], ["4"], ["5"], ["6", "7", "8"], ["9"]):
        assert own in classes
    assert any({"11", "12"} <= set(c) for c in classes) and any({"f0", "20"} <= set(c) for c in classes)


def test_variants_are_linked(spark):
    rows = [
        ("1", "person", "Elizabeth Rizorhelmo", "auditor, Quenby"), ("2", "person", "Rizorhelmo, E.C.", "auditor at Quenby"), ("3", "person", "Liz Rizorheelmo", None), ("4", "person", "Samuel Rizorhelmo", "treasurer, Quenby"),
        ("5", "organization", "Teltortoban Dairy Industries Inc", "dairy company in Q"), ("6", "organization", "TELTORTOBAN DAIRY INDS.", None), ("7", "organization", "Dairy Industries Teltortoban", None), ("8", "organization", "Teltortoban Mining Industries Inc", "mining company in Q"),
        ("9", "organization", "Abcdefgh Foods Fund II", None), ("10", "organization", "Abcdefgh Foods Fund III", None), ("11", "person", None, None), ("12", "person", " ", None), (None, "person", "x", None), ("13", "product", "Elizabeth Rizorhelmo", None),
        ("14", "person", "秦慧苗", None), ("15", "person", "秦惠苗", "云栈厂长"), ("16", "person", "QIN HUIMIAO", None), ("17", "person", "秦群萱", None), ("1", "person", "Elizabeth Rizorhelmo", "auditor, Quenby"),
    ]
    df = spark.createDataFrame(rows, "id string, entity_type string, name string, description string").selectExpr("*", "1 as node", "2 as class")
    by = {}
    for r in p6.link_variants(df, p5.Model({})).collect():
        by.setdefault(r["class"], set()).add(r.id)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, [{"1", "2", "3"}, {"4"}, {"5", "6", "7"}, {"8"}, {"9"}, {"10"}, {"11"}, {"12"}, {"14", "15", "16"}, {"17"}]))
    assert p6.link_variants(df.limit(0), p5.Model({})).count() == 0


def test_variants_with_an_edit_keep_to_their_description(spark):
    rows = [
        ("1", "person", "Jonas Rizorhelmo", "auditor"), ("2", "person", "Rizorhelmo, Jonas", "treasurer"), ("3", "person", "Jonas Rizorhellmo", "treasurer"), ("4", "person", "Jonas Rizorhemo", "clerk"), ("5", "person", "Jonas Rizzorhelmo", None),
        ("6", "person", "Samuel Quentovar", None), ("7", "person", "Quentovar, Samuel", "auditor"), ("8", "person", "Samuel Quentovaar", "auditor"),
    ]
    by = {}
    for r in p6.link_variants(spark.createDataFrame(rows, "id string, entity_type string, name string, description string"), p5.Model({})).collect():
        by.setdefault(r["class"], set()).add(r.id)
    assert sorted(map(sorted, by.values())) == [["1", "5"], ["2", "3"], ["4"], ["6", "7", "8"]]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcd", min_size=2, max_size=6), st.integers(0, 6), st.sampled_from("abcd"), st.sampled_from("idst"), st.sampled_from(["full", "zh"]))
def test_short_parts_are_proposed(a, at, ch, how, kind):
    at %= len(a)
    b = {"i": a[:at] + ch + a[at:], "d": a[:at] + a[at + 1 :], "s": a[:at] + ch + a[at + 1 :], "t": a[:at] + a[at : at + 2][::-1] + a[at + 2 :]}[how]
    if len(b) < 2 or len(a) + len(b) < 5:
        return
    rest = "" if kind == "zh" else "rizorhelmo"
    x, y = p6.reading_keys(kind, a, rest), p6.reading_keys(kind, b, rest)
    index = lambda k: {v for side, v in k if side}
    assert {v for _, v in x} & index(y) or {v for _, v in y} & index(x)


def test_components_say_when_they_are_not_whole(spark):
    edges = spark.createDataFrame([(f"a{i:02}", f"a{i + 1:02}") for i in range(25)], "u string, v string")
    with pytest.raises(RuntimeError):
        graph.components(edges, rounds=1)
    assert {r.component for r in graph.components(edges).collect()} == {"a00"}


def test_components(spark):
    random.seed(2)
    edges = [(f"a{i}", f"a{i + 1}") for i in range(25)] + [("hub", f"h{i}") for i in range(40)] + [("x", "x"), (None, "y"), ("p", "q"), ("p", "q")]
    random.shuffle(edges)
    out = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert len({out[f"a{i}"] for i in range(26)}) == 1 and len({out[f"h{i}"] for i in range(40)} | {out["hub"]}) == 1 and out["q"] == "p" and "x" not in out


# 7


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("The area is 5 * 3 * 2 metres.\nFees are $40 and $60, tax not included.\nThe path is C:\\temp\\notes on it.", []),
        ("R&D and M&A share one desk; C#\nUse the type Map<String, Integer>\na < b and c > d\nSet {a, b}\n#DATA#x,y\n- point\n1. point\n- 5 -", []),
        ("<p>x</p>", ["html"]), ("a &nbsp; b", ["html"]), ("**bold** text", ["markdown"]), ("# Head\ntext", ["markdown"]), ("Title\n=====\n", ["markdown"]),
        ("a [[b|c]] {{stub}}", ["wiki"]), ("== Notes ==", ["wiki"]), ("see $x^2 = y$ here", ["latex"]), ("\\section{A}", ["latex"]),
        ("```\n<div> **x** [[y]] \\frac{1}{2}\n```", ["markdown"]), ("<pre>**x** {{y}}</pre>", ["html"]), ("\\begin{verbatim}\n<b>x</b>\n\\end{verbatim}", ["latex"]), (None, []), ("", []),
    ],
)
def test_markup_kinds(text, kinds):
    assert p7.kinds(text) == kinds


def test_markup_cleaning():
    assert p7.clean("<h2>Head</h2><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table><pre>x &lt; y</pre>").split() == "## Head - a - b 1 | 2 ``` x < y ```".split()
    assert p7.clean("\\section{A}\n\\begin{itemize}\n\\item one\n\\end{itemize}\n\\textbf{b} $x_1$ 5\\%") == "# A\n\n- one\n\nb $x_1$ 5%"
    assert p7.clean("== H ==\n'''b''' [[x|y]] {{stub}}\n{|\n|-\n| 1 || 2\n|}") == "## H\nb y\n\n1 | 2"
    assert p7.clean("Head\n====\n**b** [t](http://u) `c`\n\n| a | b |\n|---|---|\n| 1 | 2 |") == "# Head\nb t c\n\na | b\n1 | 2"
    assert p7.clean("plain *") == "plain *" and p7.clean(None) is None


def test_shared_marks_go_to_the_kind_that_scores():
    assert p7.kinds("== Notes ==\n\nText.\n\n# ''one''\n# ''two''\n\n # set in\n") == ["wiki"]
    assert p7.kinds("# Head\n\nText with [[a link]] of another kind.") == ["markdown", "wiki"]
    assert p7.clean("== H ==\n\n# one\n# two\n** deep\n\n code x") == "## H\n\n1. one\n2. two\n  - deep\n\n```\ncode x\n```"


def test_markup_of_any_length_and_depth():
    formula = "$$" + "x+" * 5_000 + "y$$"
    assert p7.kinds(formula) == ["latex"] and formula in p7.clean(f"See {formula} there.")
    nested = "w"
    for _ in range(10):
        nested = "\\textbf{\\emph{" + nested + "}}"
    assert p7.clean(nested) == "w" and p7.clean("\\textbf{open \\emph{x}") == "\\textbf{open x"


def test_boilerplate_paths_fall_under_the_threshold():
    long = "A paragraph with many words, and marks; it goes on and on. It has text enough to be content, surely."
    page = f"<div><p>{long}</p><div>Copyright</div><ul><li><a href='x'>home</a></li><li><a href='y'>more</a></li></ul><h2>Head</h2><ul><li>item</li></ul></div>"
    assert p7.clean(page).split("\n") == [long, "", "## Head", "", "- item"]
    assert p7.clean("<div>only</div><div>short</div>").split() == ["only", "short"]


def test_markup_frames(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), (None, "<b>x</b>"), ("c", "x" * 100_000), ("c", "x" * 100_000)], "id string, content string").selectExpr("*", "1 as markup")
    assert sorted((r.id or "", tuple(r.markup)) for r in p7.clean_markup(df).collect()) == [("", ("html",)), ("a", ()), ("b", ()), ("c", ()), ("c", ())]
    assert p7.clean_markup(df.limit(0)).count() == 0


# 8


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_merge_gives_the_ids_of_the_vocabulary(text):
    from tokenizers import Tokenizer

    text = text.encode("utf-8", "ignore").decode()
    ranks = _RANKS.setdefault("r", None) or _RANKS.__setitem__("r", p8.load_ranks("byte_bpe_50k")) or _RANKS["r"]
    t = _RANKS.setdefault("t", Tokenizer.from_file(f"{p8.VOCABULARY_DIR}/byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert p8.encode_text(text, ranks) == p8._encoder("byte_bpe_50k", p8.VOCABULARY_DIR).encode_ordinary(text) == t.encode(text, add_special_tokens=False).ids


_RANKS: dict = {}


def test_encode_frames(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello <|endoftext|>"), (3, "Hello <|endoftext|>"), (None, "你好"), (4, "ab " * 50_000)], "doc_id long, text string").selectExpr("*", "1 as ids")
    out = p8.encode_corpus(df).collect()
    assert len(out) == 6 and [r.ids for r in out if r.doc_id in (1, 2)] == [[], []] and 50256 not in next(r.ids for r in out if r.doc_id == 3)
    core = p8._encoder("byte_bpe_50k", p8.VOCABULARY_DIR)
    assert core.decode(next(r.ids for r in out if r.doc_id == 4)) == "ab " * 50_000
    assert p8.encode_corpus(df.limit(0)).count() == 0


# 9


def test_leaks_against_brute_force(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(random.choices(words, k=random.randint(10, 40))), "en") for i in range(12)] + [(100 + i, "".join(random.choices("天地玄黄宇宙洪荒日月盈昃", k=50)), "zh-CN") for i in range(6)] + [(200, None, "en"), (201, "", None), (202, "short", "zh")]
    docs = []
    for d in range(60):
        body = random.choices(words, k=60)
        if d % 3 == 0:
            x = random.choice(items[:12])[1].split()
            n = random.choice([13, 14, 15, 16])
            body[20:20] = x[:n]
        t = " ".join(body)
        if d % 5 == 0:
            z = random.choice(items[12:18])[1]
            a = random.randint(0, 15)
            t += "。" + z[a : a + 15] + "，" + z[a + 15 : a + random.choice([29, 30, 31])]
        docs.append((d, t.upper() if d % 2 else t))
    docs += [(900, None), (901, ""), (3, docs[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id")
    it = spark.createDataFrame(items, "item_id long, text string, lang string")
    got = {(r.doc_id, r.item_id) for r in p9.find_leaks(df, it).collect()}
    want = set()
    for i, t, lang in items:
        if not t:
            continue
        if lang.startswith("zh"):
            grams = {t[k : k + 30] for k in range(len(t) - 29)}
        else:
            w = t.split()
            grams = {tuple(w[k : k + 15]) for k in range(len(w) - 14)}
        for d, x in docs:
            if not x:
                continue
            if lang.startswith("zh"):
                s = "".join(c for c in x.lower() if c.isalnum())
                own = {s[k : k + 30] for k in range(len(s) - 29)}
            else:
                w = x.lower().replace("。", " ").replace("，", " ").split()
                own = {tuple(w[k : k + 15]) for k in range(len(w) - 14)}
            if grams & own:
                want.add((d, i))
    assert got == want and want
    assert p9.find_leaks(df.limit(0), it).count() == 0 and p9.find_leaks(df, it.limit(0)).count() == 0


# 10


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab ,文中", max_size=160))
def test_repetition_against_brute_force(text):
    s = "".join(c.lower() for c in text if c.isalnum())
    w = 20 if 2 * sum("一" <= c <= "鿿" for c in s) > len(s) else 40
    seen, marks = set(), set()
    for i in range(len(s) - w + 1):
        if s[i : i + w] in seen:
            marks.update(range(i, i + w))
        seen.add(s[i : i + w])
    assert p10.measure(text)[:2] == (len(s), len(marks))


def test_ledger(spark):
    long = "the same sentence is written here again and again. " * 2000
    rows = [(1, None), (2, ""), (3, " .,"), (4, long), (4, long), (None, "x"), (5, "All of this is said only once, so nothing repeats in it.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as failed")
    x = p10.repetition_ledger(df)
    bad = [r.doc_id for r in x.filter(p10.rejected("v1")).collect()]
    assert x.count() == 7 and bad == [4, 4]
    a = {(r.policy, r.rule): r for r in p10.ablations(x).collect()}
    assert a["v1", "passages"].only_this_rule == 2 and a["v3", "passages"].only_this_rule == 0
    assert p10.ablations(p10.repetition_ledger(df.limit(0))).count() == 0


def test_window_hashes_are_equal_for_equal_windows():
    codes = common.letter_codes()[common.code_points("abcXabcabcd")]
    h = common.window_hashes(codes, 3)
    assert h[0] == h[4] == h[7] and len(set(h.tolist())) == 7
