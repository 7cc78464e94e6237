"""Small cases of the operators that SQL doesn't cover, and of their edges."""

from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.config import ChunkingConfig, RetrievalConfig, chunking_config, env_bool, env_list
from lodestack.functions import text
from lodestack.operators import chunking, context, history, layout, limits, ocr_plan, retrieval, structure


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_settings():
    assert env_bool(" Yes ") and not env_bool("0") and env_bool(None, True)
    assert env_list("a/, ,b") == ["a", "b"]
    assert chunking_config({"OCR_MAX_PAGES": "3", "OCR_FIGURES": "off"}) == ChunkingConfig(ocr_max_pages=3, ocr_figures=False)


def test_text(spark):
    assert one(spark, text.clean(F.lit("  ﬁne­   x\x00 "))) == "fine x"
    assert one(spark, text.join_lines(F.array(F.lit("exam-"), F.lit("ple of"), F.lit("Text")))) == "example of Text"
    assert one(spark, text.norm_title(F.lit("3.2_Été — Data!"))) == "3 2 été data"
    assert one(spark, text.half_points(F.lit(10.25))) == 10.0
    assert one(spark, text.sentences(F.lit("A b. C d! e? 5"))) == ["A b.", "C d! e?", "5"]
    assert one(spark, text.strip_fence(F.lit("```md\n# a\nb\n```"))) == "# a\nb"
    assert one(spark, text.retry_delay(F.lit("Please retry in 7.5s."))) == 7.5
    assert one(spark, text.clean_grid(F.expr("array(array('a','',null),array('','',''),array('b|','c\nd'))"))) == [["a", ""], ["b\\|", "c d"]]


def test_contextualized_edges(spark):
    def run(crumb, a, b, kind):
        body, offset = text.contextualized(F.lit("x"), F.lit(crumb), F.lit(a).cast("int"), F.lit(b).cast("int"), F.lit(kind))
        return one(spark, body), one(spark, offset)

    assert run("", None, None, "text") == ("x", 0)
    assert run("", 0, 3, "text") == ("x", 0)
    assert run("A > B", 2, 3, "table") == ("[Section: A > B | Pages 2-3 | Table]\n\nx", 38)
    assert run(None, 2, None, "text")[0] == "[Page 2]\n\nx"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Aa bb.", "C" * 45, "dd ee ff!", "G h i j k l m n o p."]), max_size=12), st.integers(20, 60), st.integers(0, 25))
def test_long_pieces_keep_words_and_limit(parts, limit, overlap):
    whole = " ".join(parts)
    pieces = chunking.long_pieces(whole, limit, overlap)
    assert all(0 < len(p) <= limit for p in pieces)
    assert set("".join(pieces).replace(" ", "")) == set(whole.replace(" ", ""))


def test_long_pieces_overlap():
    assert chunking.long_pieces("Aaaa. Bbbb. Cccc. Dddd.", 12, 6) == ["Aaaa. Bbbb.", "Bbbb. Cccc.", "Cccc. Dddd."]
    assert chunking.long_pieces("Aaaa. Bbbb. Cccc.", 12, 5) == ["Aaaa. Bbbb.", "Cccc."]
    assert chunking.long_pieces("abcdefghij klmnop", 8, 0) == ["abcdefgh", "ij klmno", "p"]


def test_section_chunks(spark):
    rows = [("d", 0, "paragraph", "p" * 40, 1, 1, None, "", 0), ("d", 1, "heading", "H", 1, 1, None, "", 1), ("d", 2, "paragraph", "q" * 30, 1, 1, None, "", 1), ("d", 3, "table", "", 2, 2, [["a", "b"], ["1", "2"]], "Table 1: t", 1), ("d", 4, "paragraph", "r" * 10, 2, 2, None, "", 1), ("d", 5, "list", "- a\n- b", 3, 3, None, "", 1)]
    elements = spark.createDataFrame(rows, "doc_id string, pos int, kind string, text string, page int, page_end int, rows array<array<string>>, caption string, section_id int")
    found = [tuple(r) for r in chunking.chunk_sections(elements, ChunkingConfig(max_chars=50, min_chars=5)).orderBy("seq").select("section_id", "seq", "kind", "text", "page_start", "page_end").collect()]
    assert found == [(0, 0, "text", "p" * 40, 1, 1), (1, 1, "text", "q" * 30, 1, 1), (1, 2, "table", "Table 1: t\n\n| a | b |\n| --- | --- |\n| 1 | 2 |", 2, 2), (1, 3, "text", "r" * 10 + "\n\n- a\n- b", 2, 3)]


def test_assemble(spark):
    items = [
        ("d", 0, 1, "paragraph", "It goes", 0, 0.0, None, False),
        ("d", 1, 2, "paragraph", "on here.", 0, 0.0, None, False),
        ("d", 2, 2, "paragraph", "Table 1: counts", 0, 0.0, None, False),
        ("d", 3, 2, "table", "", 0, 0.0, [["a", "b"], ["1", "2"]], False),
        ("d", 4, 3, "table", "", 0, 0.0, [["a", "b"], ["3", "4"]], True),
        ("d", 5, 3, "markdown", "# *Top*\n\n- x\ny\n\n| k | v |\n|--|--|\n| 1 | 2 |", 0, 0.0, None, False),
    ]
    frame = spark.createDataFrame(items, "doc_id string, pos int, page int, kind string, text string, level int, size double, rows array<array<string>>, at_page_top boolean")
    found = structure.assemble(frame).orderBy("pos").collect()
    assert [(r.kind, r.text, r.page, r.page_end) for r in found] == [("paragraph", "It goes on here.", 1, 2), ("table", "", 2, 3), ("heading", "Top", 3, 3), ("list", "- x y", 3, 3), ("table", "", 3, 3)]
    assert found[1].caption == "Table 1: counts" and found[1].rows == [["a", "b"], ["1", "2"], ["3", "4"]]


def test_outline(spark):
    blocks = spark.createDataFrame([("d", 1, 0, "intro"), ("d", 1, 1, "intro"), ("d", 1, 2, "methods and data")], "doc_id string, page int, pos int, norm string")
    outline = spark.createDataFrame([("d", 1, 0, 1, "intro"), ("d", 1, 1, 1, "methods and"), ("d", 2, 2, 1, "x")], "doc_id string, page int, entry int, level int, title string")
    matches = structure.match_outline(blocks, outline)
    assert {(r.pos, r.entry) for r in matches.collect()} == {(0, 0), (2, 1)}
    assert structure.trusted_outlines(matches, outline).count() == 1


def test_bm25_slices_before_the_score_filter(spark):
    docs = spark.createDataFrame([("s", f"s:{i}", i, t) for i, t in enumerate(["a b", "a c", "a d", "e"])], "session_id string, chunk_id string, seq int, content string")
    asked = spark.createDataFrame([(1, "s", "a a e")], "query_id int, session_id string, text string")
    hits = retrieval.bm25(retrieval.postings(docs), retrieval.corpus(docs), asked, 3).collect()
    n, avg = 4, 7 / 4
    idf = {t: np.log(n - d + 0.5) - np.log(d + 0.5) for t, d in {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1}.items()}
    low = 0.25 * np.mean(list(idf.values()))
    score = lambda w, tf, dl: w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    want = sorted([(round(score(idf["e"], 1, 1), 6), "s:3"), *((round(2 * score(low, 1, 2), 6), f"s:{i}") for i in range(2))], reverse=True)
    assert sorted(((round(h.score, 6), h.chunk_id) for h in hits), reverse=True) == want


def test_fusion_ranks_from_zero_and_keeps_first_sight(spark):
    a = spark.createDataFrame([(1, "x", 0), (1, "y", 1)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(1, "z", 0), (1, "y", 1)], "query_id int, chunk_id string, rank int")
    found = [(r.chunk_id, round(r.score, 9)) for r in retrieval.fuse([a, b]).orderBy("rank").collect()]
    assert found == [("y", round(2 / 61, 9)), ("x", round(1 / 60, 9)), ("z", round(1 / 60, 9))]


def test_expand(spark):
    chunks = spark.createDataFrame([("s", 1, i, "c" * 10, 1, 1) for i in range(4)] + [("s", 2, 4, "d", 2, 2)], "session_id string, section_id int, seq int, text string, page_start int, page_end int")
    shape = "query_id int, session_id string, rank int, chunk_id string, section_id int, seq int, chunk_type string, breadcrumb string, text string, page_start int, page_end int"
    hits = spark.createDataFrame([(1, "s", 0, "s:1", 1, 1, "text", "A", "c" * 10, 1, 1), (1, "s", 1, "s:2", 1, 2, "text", "A", "c" * 10, 1, 1), (1, "s", 2, "s:3", 1, 3, "table", "A", "c" * 10, 1, 1), (1, "s", 3, "s:9", None, None, "text", "", "old", None, None)], shape)
    found = [(r.chunk_id, r.text.count("c"), r.expanded) for r in context.expand(hits, chunks).orderBy("rank").collect()]
    assert found == [("s:1", 30, True), ("s:3", 10, False), ("s:9", 0, False)]
    assert context.expand(hits, chunks, RetrievalConfig(window=0)).count() == 4


def test_history(spark):
    said = spark.createDataFrame([("a", i, "user" if i % 2 else "assistant", f"m{i}") for i in range(5)], "session_id string, sequence long, role string, content string")
    assert history.history_text(said, RetrievalConfig(history_messages=2)).first()["history"] == "user: m3\nassistant: m4"
    assert [r.sequence for r in history.recent(said, 2).orderBy("place").collect()] == [3, 4]
    owned = spark.createDataFrame([("a", "u")], "session_id string, user_id string")
    turn = spark.createDataFrame([("a", 9, "user", "x", "v")], "session_id string, sequence long, role string, content string, user_id string")
    with pytest.raises(LookupError):
        history.save_turn(said, owned, turn)
    assert history.save_turn(said, owned, turn.withColumn("user_id", F.lit("u"))).count() == 6


def test_limits(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([("k", at(m), m) for m in (0, 1, 15, 16)], "client_key string, ts timestamp, id int")
    assert [(r.attempt, r.allowed) for r in limits.attempts(rows, 2).orderBy("id").collect()] == [(1, True), (2, True), (3, False), (1, True)]
    assert not limits.daily_budget(rows, 0).where("allowed").count()
    starts = [r.start_us for r in limits.spacing(rows, 120.0).orderBy("id").collect()]
    assert [s - starts[0] for s in starts] == [0, 120_000_000, 900_000_000, 1_020_000_000]


def test_ocr(spark):
    wanted = spark.createDataFrame([("d", i, i) for i in (1, 2, 3, 7)], "doc_id string, page int, place int")
    back = spark.createDataFrame([("d", 1, "a"), ("d", 9, "b")], "doc_id string, page int, markdown string")
    skipped = spark.createDataFrame([("d", 7, "limit")], "doc_id string, page int, reason string")
    got, lost = ocr_plan.reconcile(wanted, back, skipped)
    assert [r.page for r in got.collect()] == [1]
    assert {r.warning for r in ocr_plan.warnings(lost).collect()} == {"Pages 7 were not OCR'd: limit.", "Pages 2-3 were not OCR'd: OCR returned no output."}
    assert one(spark, ocr_plan.figure_note(F.lit("```\nNone.\n```"))) is None


def test_ocr_provider(spark):
    pages = spark.createDataFrame([("d", i, 0 if i < 4 else 100, 0.5, 0.4) for i in range(1, 6)], "doc_id string, page int, chars int, image_coverage double, biggest_image double")

    def provider(asked):
        if any(x["page"] == 3 for x in asked) and len(asked) == 1:
            raise RuntimeError("down")
        return {x["page"]: f"# {x['page']} {x['mode']}" for x in asked if x["page"] != 3}

    read, told = ocr_plan.read_pages(pages, provider, ChunkingConfig(ocr_max_pages=4), 3)
    assert sorted((r.page, r.markdown) for r in read.collect()) == [(1, "# 1 full"), (2, "# 2 full"), (4, "# 4 figures")]
    assert sorted(r.warning for r in told.collect()) == ["Pages 3 were not OCR'd: the OCR service failed.", "Pages 5 were not OCR'd: over the per-document OCR limit of 4 pages."]
    none, told = ocr_plan.read_pages(pages)
    assert none.count() == 0 and sorted(r.warning[:9] for r in told.collect()) == ["Pages 1-3", "Pages 4-5"]


def test_images_and_empty_tables(spark):
    images = spark.createDataFrame([("d", 1, -10.0, 0.0, 50.0, 100.0, 100.0, 100.0), ("d", 1, 0.0, 5.0, 1.0, 6.0, 100.0, 100.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, width double, height double")
    r = layout.image_coverage(images).first()
    assert (r.image_coverage, r.biggest_image) == (0.5, 0.5)
    none = spark.createDataFrame([], "doc_id string, pos int, page int, text string")
    assert chunking.pack_paragraphs(none).count() == 0


def test_plans_have_no_cartesian_products(spark, sf):
    from lodestack.plans import catalog

    for name in ("bm25_topk", "rrf_fuse", "table_overlap_anti", "upsert_sessions"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan, name
    assert "WindowGroupLimit" in catalog.QUERIES["bm25_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_attempt_stream(spark, tmp_path):
    from lodestack.streaming.limits import attempt_stream, daily_counts

    rows = spark.createDataFrame([("k", datetime(2024, 1, 1, 0, m), m) for m in (0, 1, 2)], "client_key string, ts timestamp, id int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = attempt_stream(stream(), limit=2).writeStream.format("memory").queryName("attempts_out").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.id, r.attempt, r.allowed) for r in spark.table("attempts_out").collect()) == [(0, 1, True), (1, 2, True), (2, 3, False)]
    assert daily_counts(stream()).isStreaming
