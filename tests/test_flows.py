"""Documents from blocks to answers: elements, OCR, sinks, questions."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import schemas
from lodestack.config import ChunkingConfig
from lodestack.functions import text
from lodestack.operators import chunking, context, layout, limits, ocr_plan, retrieval, structure
from lodestack.plans import flows
from lodestack.plugins import Plugins, hashing_embedder, ocr_plugin, rewritten
from lodestack.sources import adapters, tables

ITEMS = "doc_id string, pos int, page int, kind string, text string, level int, size double, rows array<array<string>>, at_page_top boolean"
GRID = [["a", "b"], ["1", "2"]]


def items(spark, *rows):
    """Rows of (page, kind, text) or (page, 'table', grid, at_page_top)."""
    full = [("d", i, r[0], r[1], "" if r[1] == "table" else r[2], 0, 0.0, r[2] if r[1] == "table" else None, r[1] == "table" and r[3]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, ITEMS)


def elements(frame):
    return [(r.kind, r.text, r.page, r.page_end, r.caption, r.rows) for r in structure.assemble(frame).orderBy("pos").collect()]


def test_captions(spark):
    found = elements(items(spark, (1, "table", GRID, False), (1, "paragraph", "Table 1: below"), (2, "table", GRID, True), (2, "paragraph", "Table 2: above"), (2, "table", GRID, False), (3, "paragraph", "x")))
    # The first caption goes to the table above it, over which the next page's table goes on; the second is the third table's.
    assert found == [
        ("table", "", 1, 2, "Table 1: below", [*GRID, GRID[1]]),
        ("table", "", 2, 2, "Table 2: above", GRID),
        ("paragraph", "x", 3, 3, "", None),
    ]
    long = "Table 3: " + "w" * 300
    assert [x[0] for x in elements(items(spark, (1, "paragraph", long), (1, "table", GRID, False), (3, "paragraph", "Table 4: far")))] == ["paragraph", "table", "paragraph"]
    # A caption that goes on is one paragraph, and belongs to the table as a whole.
    found = elements(items(spark, (1, "paragraph", "Table 5: exam-"), (2, "paragraph", "ples of it"), (2, "table", GRID, False)))
    assert found == [("table", "", 1, 2, "Table 5: examples of it", GRID)]


def test_merges(spark):
    found = elements(items(spark, (1, "paragraph", "one"), (2, "paragraph", "two."), (2, "paragraph", "three"), (2, "list", "- a"), (3, "list", "- b"), (5, "list", "- c"), (5, "heading", "H"), (5, "paragraph", "low")))
    assert [x[:4] for x in found] == [("paragraph", "one two.", 1, 2), ("paragraph", "three", 2, 2), ("list", "- a\n- b", 2, 3), ("list", "- c", 5, 5), ("heading", "H", 5, 5), ("paragraph", "low", 5, 5)]
    assert elements(items(spark, (1, "table", [], False))) == []


def test_markdown_pages(spark):
    md = "intro\nline exam-\nple\n\n|a|b|\n|:--|--|\n|1\\|x|2|\n| | |\ntext\n- x\nmore\n* y\n\n|only one|\n# **\n## Using C# \n```"
    rows = spark.createDataFrame([("d", 1, md), ("e", 1, "```md\n|k|v|\n|--|--|\n|1|2|\n```"), ("f", 1, ""), ("g", 1, "```\n```")], "doc_id string, page int, markdown string")
    found = [(r.doc_id, r.kind, r.text, r.level, r.rows, r.at_page_top) for r in structure.markdown_items(rows).orderBy("doc_id", "sub").collect()]
    assert found == [
        ("d", "paragraph", "intro line example", 0, None, False),
        ("d", "table", "", 0, [["a", "b"], ["1\\|x", "2"]], False),
        ("d", "paragraph", "text", 0, None, False),
        ("d", "list", "- x more\n* y", 0, None, False),
        ("d", "paragraph", "only one", 0, None, False),
        ("d", "heading", "Using C", 2, None, False),
        ("d", "paragraph", "```", 0, None, False),
        ("e", "table", "", 0, [["k", "v"], ["1", "2"]], True),
    ]


def test_reading_order_with_blocks_of_no_height(spark):
    shape = "doc_id string, page int, pos int, x0 double, y0 double, x1 double, y1 double"
    rows = [("d", 1, 0, 0.0, 5.0, 40.0, 5.0), ("d", 1, 1, 0.0, 50.0, 40.0, 60.0), ("d", 1, 2, 60.0, 0.0, 100.0, 10.0), ("d", 1, 3, 60.0, 70.0, 100.0, 80.0)]
    order = lambda rows: [r.pos for r in layout.reading_order(spark.createDataFrame(rows, shape), F.lit(100.0)).orderBy("reading_pos").collect()]
    assert order(rows) == [0, 1, 2, 3]  # the first is beside the third
    apart = [rows[0][:4] + (10.0, 40.0, 10.0), rows[1], rows[2], rows[3]]
    assert order(apart) == [2, 0, 1, 3]  # it only touches it


def blocks(spark, *rows):
    """Rows of (doc_id, page, pos, text, y0, size, is_list)."""
    return spark.createDataFrame([(d, p, n, t, 20.0, y, 500.0, y + 10, s, False, 1, li, len(t)) for d, p, n, t, y, s, li in rows], schemas.BLOCKS)


def test_document_elements(spark):
    found = blocks(
        spark,
        ("d", 1, 0, "Intro", 100.0, 10.0, False),
        ("d", 1, 1, "some words.", 200.0, 10.0, False),
        ("d", 1, 2, "cell text in a table", 310.0, 30.0, False),
        ("d", 1, 3, "Methods and data", 500.0, 10.0, False),
        ("d", 3, 4, "A picture page with enough text to be read as it is.", 100.0, 10.0, False),
        ("e", 1, 0, "Big", 100.0, 20.0, False),
        ("e", 1, 1, "plain words here.", 200.0, 10.0, False),
        ("e", 1, 2, "- item", 300.0, 10.0, True),
    )
    pages = spark.createDataFrame([("d", 1, 600.0, 800.0), ("d", 2, 600.0, 800.0), ("d", 3, 600.0, 800.0), ("e", 1, 600.0, 800.0)], "doc_id string, page int, width double, height double")
    grids = spark.createDataFrame([("d", 1, 10.0, 300.0, 590.0, 400.0, GRID), ("d", 1, 10.0, 150.0, 590.0, 160.0, GRID)], schemas.TABLES)
    images = spark.createDataFrame([("d", 2, 0.0, 0.0, 600.0, 800.0), ("d", 3, 0.0, 0.0, 300.0, 300.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    marks = spark.createDataFrame([("d", 0, 1, "Intro", 1), ("d", 1, 2, "Methods and Data", 1), ("d", 2, 1, "ﬁnal Ⅳ", 2), ("d", 3, 1, " ", 1), ("d", 4, 1, "x", 0)], "doc_id string, entry int, level int, title string, page int")
    outline = adapters.outline_entries(marks)
    assert sorted((r.title, r.page) for r in outline.collect()) == [("final iv", 2), ("intro", 1), ("methods and data", 1)]

    def ocr(asked):
        return {x["page"]: "# Final IV\n\nscanned words" if x["mode"] == "full" else "```\na chart\n```" for x in asked}

    made, read, warnings = flows.document_elements(found, pages, grids, images, outline, Plugins(ocr=ocr))
    rows = [(r.kind, r.text, r.page, r.level) for r in made.where("doc_id = 'd'").orderBy("pos").collect()]
    assert rows == [
        ("heading", "Intro", 1, 1),
        ("table", "", 1, 0),
        ("paragraph", "some words.", 1, 0),
        ("table", "", 1, 0),
        ("heading", "Methods and data", 1, 2),
        ("heading", "Final IV", 2, 1),
        ("paragraph", "scanned words", 2, 0),
        ("paragraph", text.FIGURE_LABEL + "a chart", 3, 0),
        ("paragraph", "A picture page with enough text to be read as it is.", 3, 0),
    ]
    assert [(r.kind, r.text, r.level) for r in made.where("doc_id = 'e'").orderBy("pos").collect()] == [("heading", "Big", 1), ("paragraph", "plain words here.", 0), ("list", "- item", 0)]
    chunks, summary = flows.ingest(made, ChunkingConfig(), pages, read, warnings)
    d = {r.doc_id: r for r in summary.collect()}["d"]
    assert (d.pages, d.sections, d.tables, d.ocr_pages, d.warnings) == (3, 3, 2, [2, 3], [])
    assert "Intro > Final IV" not in {r.breadcrumb for r in chunks.collect()} and "Final IV" in {r.breadcrumb for r in chunks.collect()}


def pages_of(spark, n):
    return spark.createDataFrame([("d", i, 0, 0.5, 0.4) for i in range(1, n + 1)], "doc_id string, page int, chars int, image_coverage double, biggest_image double")


class Failure(Exception):
    def __init__(self, code, message=""):
        super().__init__(message)
        self.code = code


def test_ocr_asks_once_and_retries(tmp_path, spark):
    log = tmp_path / "calls"

    def provider(asked):
        with open(log, "a") as file:
            file.write(",".join(str(x["page"]) for x in asked) + "\n")
        return {x["page"]: "text" for x in asked}

    read, told = ocr_plan.read_pages(pages_of(spark, 4), provider)
    assert read.count() == 4 and told.count() == 0 and read.count() == 4
    assert sorted(log.read_text().split()) == ["1,2,3", "4"]


def test_ocr_documents():
    asked = [{"doc_id": "d", "page": i, "mode": "full"} for i in range(1, 6)]
    waits, calls = [], []

    def busy(pages):
        calls.append([x["page"] for x in pages])
        if len(calls) < 3:
            raise Failure(503 if len(calls) == 1 else 429, "Please retry in 7s")
        return {x["page"]: "t" for x in pages}

    out = ocr_plan.read_document(asked, busy, sleep=waits.append)
    assert waits == [7.0, 7.0] and {p: m for p, (m, _) in out.items()} == dict.fromkeys(range(1, 6), "t") and calls == [[1, 2, 3]] * 3 + [[4, 5]]

    def down(pages):
        raise TimeoutError

    waits.clear()
    out = ocr_plan.read_document(asked[:1], down, sleep=waits.append)
    assert waits == [5.0, 10.0, 20.0] and out == {1: (None, ocr_plan.FAILED)}
    left = iter([True, False])
    out = ocr_plan.read_document(asked, lambda p: {x["page"]: "t" for x in p}, budget=lambda: next(left))
    assert {p: r for p, (_, r) in out.items()} == {1: None, 2: None, 3: None, 4: ocr_plan.BUDGET_USED, 5: ocr_plan.BUDGET_USED}

    def quota(pages):
        raise Failure(429, "GenerateRequestsPerDay")

    assert set(ocr_plan.read_document(asked, quota).values()) == {(None, ocr_plan.QUOTA_USED)}
    assert ocr_plan.read_document(asked[:2], lambda p: ({}, {1: "blank"})) == {1: (None, "blank"), 2: (None, ocr_plan.NO_TEXT)}
    assert set(ocr_plan.read_document(asked, lambda p: {}, budget=lambda: 1 / 0).values()) == {(None, ocr_plan.BUDGET_DOWN)}


def test_page_chars(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page int")
    grids = spark.createDataFrame([("d", 1, [["ab", None], ["c", ""]])], "doc_id string, page int, rows array<array<string>>")
    there = spark.createDataFrame([("d", 1, 5)], "doc_id string, page int, chars int")
    assert {r.page: r.chars for r in layout.page_chars(there, pages, grids).collect()} == {1: 8, 2: 0}


def test_tables_of_pages(spark):
    pages = spark.createDataFrame([("d", 1, b"x"), ("d", 2, b"y")], "doc_id string, page int, content binary")

    def finder(content, strategy):
        if content == b"y":
            raise RuntimeError("broken page")
        return [{"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "rows": [["a|", "ﬁ"], ["b", None]]}, {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "rows": [["lone"]]}]

    assert [r.rows for r in adapters.found_tables(pages, finder).collect()] == [[["a\\|", "fi"], ["b", ""]]]
    assert adapters.found_tables(pages, finder, ChunkingConfig(detect_tables=False)).count() == 0


def test_publish_is_all_or_nothing(spark, tmp_path):
    good = spark.range(3)
    tables.publish(spark, {str(tmp_path / "a"): good, str(tmp_path / "b"): good})
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3
    bad = good.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(Exception):
        tables.publish(spark, {str(tmp_path / "c"): good, str(tmp_path / "d"): bad})
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    with pytest.raises(FileExistsError):
        tables.publish(spark, {str(tmp_path / "a"): good})


def test_vectors_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "chunk_id string, x int")
    path = str(tmp_path / "v")
    tables.append_vectors(spark, path, rows)
    tables.append_vectors(spark, path, rows.unionByName(spark.createDataFrame([("c", 3)], "chunk_id string, x int")))
    assert sorted(r.chunk_id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    spark.sql(f"CREATE DATABASE IF NOT EXISTS lode_test LOCATION '{tmp_path / 'db'}'")
    try:
        names = tables.create_tables(spark, "lode_test")
        assert tables.create_tables(spark, "lode_test") == names and names[0].endswith("sessions")
        assert "sources" in spark.table("lode_test.chat_messages").columns
    finally:
        spark.sql("DROP DATABASE lode_test CASCADE")


def corpus(spark):
    texts = ["apples grow on trees", "the sea is deep", "stars burn for long"]
    rows = [("s", f"s:{i}", 0, i, "text", "text", t, i + 1, i + 1, "") for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "session_id string, chunk_id string, section_id int, seq int, chunk_type string, kind string, text string, page_start int, page_end int, breadcrumb string")
    content, offset = text.contextualized(F.col("text"), F.col("breadcrumb"), F.col("page_start"), F.col("page_end"), F.col("kind"))
    return chunks.withColumn("content", content).withColumn("body_offset", offset)


def test_answer(spark):
    chunks = corpus(spark)
    vectors = retrieval.embed(chunks.select("session_id", "chunk_id", "content"), hashing_embedder())
    asked = spark.createDataFrame([(1, "s", "And how deep?"), (2, "s", "   "), (3, "s", "apples")], "query_id int, session_id string, text string")
    said = spark.createDataFrame([(1, "user: tell me of the sea")], "query_id int, history string")
    plug = Plugins(rewrite=lambda p: "the sea is deep" if "sea" in p else "  ", answer=lambda p: f"{len(p)} characters")
    answers, cited = flows.answer(chunks, vectors, asked, said, plugins=plug)
    rows = {r.query_id: r for r in answers.collect()}
    assert set(rows) == {1, 3} and rows[1].answer == f"{len(rows[1].prompt)} characters"
    assert "Question: And how deep?" in rows[1].prompt and "tell me of the sea" in rows[1].prompt
    first = {r.query_id: r.page for r in cited.where("rank = 0").collect()}
    assert first == {1: 2, 3: 1}
    # An empty rewrite keeps the question.
    blank = rewritten(asked, said, Plugins(rewrite=lambda p: " "))
    assert {r.search_text for r in blank.collect()} == {r.text for r in asked.collect()}


def test_ingest_is_published(spark, tmp_path):
    items_ = items(spark, (1, "heading", "H"), (1, "paragraph", "words."))
    chunks, summary = flows.ingest(structure.assemble(items_))
    flows.publish_ingest(spark, str(tmp_path / "s1"), chunks, summary)
    assert spark.read.parquet(str(tmp_path / "s1/vectors")).count() == spark.read.parquet(str(tmp_path / "s1/chunks")).count() == 1


def test_accounts_and_keys(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert one(text.valid_name(F.lit(" Ada "))) and not one(text.valid_name(F.lit("  "))) and not one(text.valid_name(F.lit("x" * 81)))
    assert one(text.valid_password(F.lit("x" * 12))) and not one(text.valid_password(F.lit("x" * 11))) and one(text.valid_password(F.lit("x"), False))
    assert one(text.document_key(F.lit(None).cast("string"), F.lit(3), F.lit("c"))).startswith("3:") and one(text.document_key(F.lit("k"), F.lit(3), F.lit("c"))) == "k"
    assert one(text.elapsed(F.lit(1.0005))) == 1.0 and len(one(text.new_id())) == 36
    assert one(text.ocr_json(F.lit("no json"))) is None and one(text.ocr_json(F.lit('{"pages":[{"markdown":"x"}]}'))) is None
    assert one(text.norm_title(F.lit("ﬁnance Ⅳ"))) == "finance iv" and one(text.furniture_key(F.lit("Page ٣ of 9"))) == "page # of #"
    assert ocr_plugin(False, "k", str) is None and ocr_plugin(True, "", str) is None and ocr_plugin(True, "k", str) == "k"


def test_folds_are_linear(spark):
    n = 300_000
    many = spark.range(n).select(F.lit("k").alias("client_key"), F.timestamp_seconds(F.col("id")).alias("ts"), F.col("id").cast("int").alias("id"))
    assert limits.attempts(many, 20, 15).agg(F.max("attempt")).first()[0] == 901
    assert len(chunking.filled(np.full(1_000_000, 100), 1200, 2)) == 1_000_000
    heads = spark.range(50_000).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("pos"), (F.col("id") % 5 + 1).cast("int").alias("level"), F.col("id").cast("string").alias("text"))
    assert structure.section_paths(heads).where("size(path) = level").count() == 50_000


def test_budget_by_place(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, d, 12, m), i) for i, (d, m) in enumerate([(1, 3), (1, 1), (1, 2), (2, 0), (1, 3)])], "ts timestamp, id int")
    assert {r.id for r in limits.daily_budget(rows, 3).where("allowed").collect()} == {0, 1, 2, 3}


def test_expand_carries_content(spark):
    chunks = corpus(spark)
    hits = chunks.withColumn("query_id", F.lit(1)).withColumn("rank", F.col("seq")).where("seq = 1")
    r = context.expand(hits, chunks).first()
    assert r.expanded and r.content[r.body_offset :] == r.text and r.content.startswith("[Pages 1-3]")
