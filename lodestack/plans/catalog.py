"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import geometry, text
from lodestack.operators import chunking, context, history, layout, limits, ocr_plan, retrieval, structure
from lodestack.plans import flows
from lodestack.sources import adapters, tables
from lodestack.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a data directory by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a function of ``Tables`` under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Lines of documents and their greedy packing, for the SQL of several queries.
LINES = r"""
    lines AS (
        SELECT doc_id, pos - 1 AS pos, CAST(floor((pos - 1) / 40) + 1 AS INTEGER) AS page, line AS text
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
        WHERE length(trim(line)) > 0
    ), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM lines),
    filled AS (
        SELECT doc_id, n, 0 AS run, length(text) AS size FROM numbered WHERE n = 1
        UNION ALL
        SELECT x.doc_id, x.n, CASE WHEN f.size + 2 + length(x.text) > 1200 THEN f.run + 1 ELSE f.run END,
               CASE WHEN f.size + 2 + length(x.text) > 1200 THEN length(x.text) ELSE f.size + 2 + length(x.text) END
        FROM filled f JOIN numbered x ON x.doc_id = f.doc_id AND x.n = f.n + 1
    ), packed AS (
        SELECT x.doc_id, CAST(f.run AS INTEGER) AS seq, string_agg(x.text, chr(10) || chr(10) ORDER BY x.pos) AS text,
               min(x.page) AS page_start, max(x.page) AS page_end
        FROM filled f JOIN numbered x USING (doc_id, n) GROUP BY ALL
    )"""


@query(rf"WITH RECURSIVE {LINES} SELECT doc_id, seq, length(text) AS chars, md5(text) AS digest, page_start, page_end FROM packed")
def chunk_pack(t: Tables) -> DataFrame:
    packed = chunking.pack_paragraphs(adapters.document_lines(t.documents))
    return packed.select("doc_id", "seq", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"), "page_start", "page_end")


@query(rf"""WITH RECURSIVE {LINES}, o AS (
        SELECT *, lead(seq) OVER w IS NULL AND length(text) < 250 AND lag(length(text)) OVER w + 2 + length(text) <= 1500 AS fold
        FROM packed WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
    ), p AS (
        SELECT *, lead(fold) OVER w AS next_fold, lead(text) OVER w AS next_text, lead(page_end) OVER w AS next_end
        FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
    )
    SELECT doc_id, seq, md5(CASE WHEN next_fold THEN text || chr(10) || chr(10) || next_text ELSE text END) AS digest,
           page_start, CASE WHEN next_fold THEN greatest(page_end, next_end) ELSE page_end END AS page_end
    FROM p WHERE NOT coalesce(fold, false)""")
def tail_merge(t: Tables) -> DataFrame:
    folded = chunking.fold_tail(chunking.pack_paragraphs(adapters.document_lines(t.documents)))
    return folded.select("doc_id", "seq", F.md5("text").alias("digest"), "page_start", "page_end")


@query(rf"""WITH RECURSIVE {LINES}, c AS (
        SELECT *, 'Section: ' || d.source || ' > ' || d.lang AS crumb,
               CASE WHEN page_end <> page_start THEN 'Pages ' || page_start || '-' || page_end ELSE 'Page ' || page_start END AS shown,
               CASE WHEN doc_id % 7 = 0 THEN ' | Table' ELSE '' END AS kind
        FROM packed JOIN (SELECT doc_id, source, lang FROM documents) d USING (doc_id)
    )
    SELECT doc_id || ':' || seq AS chunk_id, length('[' || crumb || ' | ' || shown || kind || ']') + 2 AS body_offset,
           md5('[' || crumb || ' | ' || shown || kind || ']' || chr(10) || chr(10) || text) AS digest
    FROM c""")
def contextualize(t: Tables) -> DataFrame:
    packed = chunking.pack_paragraphs(adapters.document_lines(t.documents))
    crumb = t.documents.select("doc_id", F.array_join(F.array("source", "lang"), " > ").alias("breadcrumb"))
    rows = packed.join(crumb, "doc_id").withColumn("kind", F.when(F.col("doc_id") % 7 == 0, "table").otherwise("text"))
    return chunking.with_context(rows).select("chunk_id", F.col("body_offset").cast("long").alias("body_offset"), F.md5("content").alias("digest"))


@query(r"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS t FROM documents)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos,
           md5(regexp_replace(regexp_replace(t, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS cleaned,
           trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')) AS title,
           trim(regexp_replace(regexp_replace(lower(t), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS furniture_key,
           regexp_matches(t, '(?i)^\s*(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\s*$') AS is_page_number,
           regexp_matches(t, '^\s*(?:[\x{2022}\x{25CF}\x{25AA}\x{25E6}\x{2023}\x{2219}\x{B7}\x{2013}\x{2014}*-]|\d{1,3}[.)]|\(\d{1,3}\)|[a-z]\)|\([a-z]\))\s+') AS is_list
    FROM l""")
def text_lines(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    return rows.select("doc_id", "pos", F.md5(text.clean(F.col("t"))).alias("cleaned"), text.norm_title(F.col("t")).alias("title"), text.furniture_key(F.col("t")).alias("furniture_key"), text.is_page_number(F.col("t")).alias("is_page_number"), text.is_list_item(F.col("t")).alias("is_list"))


@query(r"""
    WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"\x{201C}(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS p FROM documents)
    SELECT doc_id, CAST(len(p) AS INTEGER) AS n, md5(array_to_string(p, chr(1))) AS digest FROM s""")
def sentence_split(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", text.sentences(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n"), F.md5(F.array_join("p", "\x01")).alias("digest"))


@query(r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS INTEGER) AS n, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct, md5(array_to_string(w, ' ')) AS digest FROM w""")
def tokenizer(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", text.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("n_distinct"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(r"""
    WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<(h[1-6]|p|li)>(.*?)</(?:h[1-6]|p|li)>', 1) AS t, regexp_extract_all(html, '(?s)<(h[1-6]|p|li)>(.*?)</(?:h[1-6]|p|li)>', 2) AS b FROM pages),
    e AS (SELECT page_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tag, unnest(b) AS body FROM p),
    x AS (SELECT page_id, pos, tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n]+', ' ', 'g')) AS text FROM e)
    SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list' ELSE 'paragraph' END AS kind,
           CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2, 1) AS INTEGER) ELSE 0 END AS level, text
    FROM x WHERE text <> ''""")
def html_elements(t: Tables) -> DataFrame:
    return adapters.html_elements(t.pages)


HEADINGS = """SELECT p_brand AS doc_id, CAST(p_partkey AS INTEGER) AS pos, CAST(p_size % 5 + 1 AS INTEGER) AS level, p_name AS text FROM part"""


@query(f"""
    WITH h AS ({HEADINGS}), a AS (
        SELECT h.doc_id, h.pos, g.pos AS up, g.text FROM h JOIN h g ON g.doc_id = h.doc_id AND g.pos <= h.pos
        WHERE g.pos = h.pos OR g.level < (SELECT min(m.level) FROM h m WHERE m.doc_id = h.doc_id AND m.pos > g.pos AND m.pos <= h.pos)
    )
    SELECT doc_id, pos, string_agg(left(text, 120), ' > ' ORDER BY up) AS breadcrumb FROM a GROUP BY ALL""")
def section_paths(t: Tables) -> DataFrame:
    heads = t.part.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").cast("int").alias("pos"), (F.col("p_size") % 5 + 1).cast("int").alias("level"), F.col("p_name").alias("text"))
    return structure.section_paths(heads).select("doc_id", "pos", F.array_join("path", " > ").alias("breadcrumb"))


ELEMENTS = """SELECT p_brand AS doc_id, CAST(p_partkey AS INTEGER) AS pos, CASE WHEN p_size % 6 = 0 THEN 'heading' WHEN p_size % 6 < 3 THEN 'list' ELSE 'paragraph' END AS kind,
    CAST(p_partkey / 40 AS INTEGER) AS page, CASE WHEN p_size % 4 = 0 THEN p_name ELSE upper(p_name) || '.' END AS text FROM part"""


def part_elements(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "p_brand AS doc_id", "CAST(p_partkey AS INT) AS pos", "CASE WHEN p_size % 6 = 0 THEN 'heading' WHEN p_size % 6 < 3 THEN 'list' ELSE 'paragraph' END AS kind",
        "CAST(round(p_partkey / 40) AS INT) AS page", "CASE WHEN p_size % 4 = 0 THEN p_name ELSE upper(p_name) || '.' END AS text",
    )


@query(f"""
    WITH e AS ({ELEMENTS.replace("CAST(p_partkey / 40 AS INTEGER)", "CAST(round(p_partkey / 40) AS INTEGER)")})
    SELECT doc_id, pos, kind, CAST(sum(CASE WHEN kind = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS section_id,
           CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS seq
    FROM e""")
def section_ids(t: Tables) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    return structure.section_ids(part_elements(t)).select("doc_id", "pos", "kind", "section_id", seq.cast("int").alias("seq"))


@query(f"""
    WITH e AS ({ELEMENTS.replace("CAST(p_partkey / 40 AS INTEGER)", "CAST(round(p_partkey / 40) AS INTEGER)")}),
    l AS (SELECT *, page - lag(page) OVER w <= 1 AND kind = lag(kind) OVER w AND (kind = 'list' OR kind = 'paragraph'
                 AND (lag(text) OVER w LIKE '%-' OR NOT regexp_matches(rtrim(lag(text) OVER w), '[.!?\\x{{2026}}"\\x{{201D}}\\x{{2019}}]$')) AND regexp_matches(text, '^\\p{{Ll}}')) AS joins
          FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    r AS (SELECT *, sum(CASE WHEN coalesce(joins, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l)
    SELECT doc_id, min(pos) AS pos, min(kind) AS kind, min(page) AS page, max(page) AS page_end,
           CASE WHEN min(kind) = 'list' THEN string_agg(text, chr(10) ORDER BY pos) ELSE string_agg(text, ' ' ORDER BY pos) END AS text
    FROM r GROUP BY doc_id, run""")
def merge_runs(t: Tables) -> DataFrame:
    return structure.merge_runs(part_elements(t).withColumn("page_end", F.col("page")))


@query(r"""
    WITH RECURSIVE p AS (SELECT page_id, regexp_extract_all(html, '<li>([^\n]*?)</li>', 1) AS items FROM pages),
    i AS (SELECT page_id, generate_subscripts(items, 1) AS n, unnest(items) AS item FROM p),
    f AS (SELECT page_id, n, 0 AS run, length(item) + 1 AS size FROM i WHERE n = 1
          UNION ALL
          SELECT i.page_id, i.n, CASE WHEN f.size + 1 + length(i.item) > 120 THEN f.run + 1 ELSE f.run END,
                 CASE WHEN f.size + 1 + length(i.item) > 120 THEN 0 ELSE f.size END + length(i.item) + 1
          FROM f JOIN i ON i.page_id = f.page_id AND i.n = f.n + 1)
    SELECT page_id, CAST(run AS INTEGER) AS piece, string_agg(item, chr(10) ORDER BY n) AS text FROM f JOIN i USING (page_id, n) GROUP BY ALL""")
def list_split(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", F.regexp_extract_all("html", F.lit("<li>([^\\n]*?)</li>"), F.lit(1)).alias("i")).where(F.size("i") > 0)
    return rows.select("page_id", F.posexplode(chunking.split_list(F.array_join("i", "\n"), 120)).alias("piece", "text"))


def supplier_grids(t: Tables) -> DataFrame:
    row = F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_shipdate").cast("date").cast("string"), "l_returnflag")
    rows = t.lineitem.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", row.alias("r")))).alias("g"))
    head = F.array(F.array(F.lit("order"), F.lit("line"), F.lit("shipped"), F.lit("flag")))
    return rows.select("l_suppkey", F.concat(head, F.transform("g", lambda x: x["r"])).alias("rows"), F.when(F.col("l_suppkey") % 2 == 0, "Table 1: lines").otherwise("").alias("caption"))


@query(r"""
    WITH RECURSIVE r AS (
        SELECT l_suppkey, '| ' || l_orderkey || ' | ' || l_linenumber || ' | ' || strftime(l_shipdate, '%Y-%m-%d') || ' | ' || l_returnflag || ' |' AS line,
               row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'), l_returnflag) AS n,
               CASE WHEN l_suppkey % 2 = 0 THEN 'Table 1: lines' ELSE '' END AS cap
        FROM lineitem
    ), h AS (SELECT '| order | line | shipped | flag |' || chr(10) || '| --- | --- | --- | --- |' AS head
    ), b AS (SELECT l_suppkey, cap, max(length(head)) + length(cap) + 30 AS base,
                    sum(length(line) + 1) + max(length(head)) + CASE WHEN cap <> '' THEN length(cap) + 2 ELSE 0 END AS whole FROM r, h GROUP BY l_suppkey, cap
    ), f AS (SELECT l_suppkey, n, 0 AS run, base + length(line) + 1 AS size FROM r JOIN b USING (l_suppkey) WHERE n = 1
             UNION ALL
             SELECT r.l_suppkey, r.n, CASE WHEN b.whole > 3000 AND f.size + length(r.line) + 1 > 3000 THEN f.run + 1 ELSE f.run END,
                    CASE WHEN b.whole > 3000 AND f.size + length(r.line) + 1 > 3000 THEN b.base ELSE f.size END + length(r.line) + 1
             FROM f JOIN r ON r.l_suppkey = f.l_suppkey AND r.n = f.n + 1 JOIN b ON b.l_suppkey = f.l_suppkey
    ), g AS (SELECT l_suppkey, run, cap, string_agg(line, chr(10) ORDER BY n) AS body FROM f JOIN r USING (l_suppkey, n) GROUP BY ALL)
    SELECT l_suppkey, CAST(run AS INTEGER) AS piece,
           md5(CASE WHEN run = 0 AND cap = '' THEN '' WHEN run = 0 THEN cap || chr(10) || chr(10) WHEN cap = '' THEN '(table continued)' || chr(10) || chr(10) ELSE cap || ' (continued)' || chr(10) || chr(10) END
               || head || chr(10) || body) AS digest
    FROM g, h""")
def table_split(t: Tables) -> DataFrame:
    return chunking.table_pieces(supplier_grids(t)).select("l_suppkey", "piece", F.md5("text").alias("digest"))


@query(r"""
    SELECT r_name, 'Nations of ' || r_name || chr(10) || chr(10) || '| key | name |' || chr(10) || '| --- | --- |' || chr(10)
           || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def table_render(t: Tables) -> DataFrame:
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    grid = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("n", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"])))
    return rows.select("r_name", text.render_table(grid, F.concat(F.lit("Nations of "), "r_name")).alias("markdown"))


@query(r"""
    WITH c AS (
        SELECT p_brand, p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE replace(p_name, ' ', chr(10)) END AS a,
               CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 5 = 0 THEN p_type || '|' ELSE p_type END AS b,
               CASE WHEN p_brand LIKE '%1' THEN '' ELSE CASE WHEN p_size % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END END AS d
        FROM part
    ), k AS (SELECT p_brand, p_partkey, trim(regexp_replace(replace(replace(a, chr(10), ' '), '|', '\|'), '[ \t]+', ' ', 'g')) AS a,
                    trim(regexp_replace(replace(b, '|', '\|'), '[ \t]+', ' ', 'g')) AS b, d FROM c WHERE a <> '' OR b <> '' OR d <> '')
    SELECT p_brand, CAST(count(*) AS INTEGER) AS n_rows, CASE WHEN max(d) = '' THEN 2 ELSE 3 END AS n_columns,
           md5(string_agg(CASE WHEN d_any = '' THEN a || '~' || b ELSE a || '~' || b || '~' || d END, chr(10) ORDER BY p_partkey)) AS digest
    FROM (SELECT *, max(d) OVER (PARTITION BY p_brand) AS d_any FROM k) GROUP BY p_brand""")
def table_clean(t: Tables) -> DataFrame:
    blank = F.col("p_size") % 3 == 0
    row = F.array(
        F.when(blank, "").otherwise(F.replace("p_name", F.lit(" "), F.lit("\n"))),
        F.when(blank, "").when(F.col("p_size") % 5 == 0, F.concat("p_type", F.lit("|"))).otherwise(F.col("p_type")),
        F.when(F.col("p_brand").endswith("1") | blank, "").otherwise(F.col("p_size").cast("string")),
        F.lit(None).cast("string"),
    )
    grids = t.part.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda x: x["r"]).alias("g"))
    grids = grids.select("p_brand", text.clean_grid(F.col("g")).alias("g")).where(text.is_real_table(F.col("g")))
    return grids.select("p_brand", F.size("g").alias("n_rows"), F.size(F.col("g")[0]).alias("n_columns"), F.md5(F.array_join(F.transform("g", lambda r: F.array_join(r, "~")), "\n")).alias("digest"))


def paged_blocks(t: Tables, lines_a_page: int = 6) -> tuple[DataFrame, DataFrame]:
    """A block per document line, stacked on pages of a few lines, and the pages."""
    lines = t.documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    at = F.col("pos") % lines_a_page
    blocks = lines.select("doc_id", (F.floor(F.col("pos") / lines_a_page) + 1).cast("int").alias("page"), "pos", "text", (at * 100.0).alias("y0"), (at * 100.0 + 40).alias("y1"))
    return blocks, blocks.groupBy("doc_id", "page").agg(F.lit(600.0).alias("height"))


@query(r"""
    WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents),
    b AS (SELECT doc_id, CAST(floor(pos / 6) + 1 AS INTEGER) AS page, pos, text, pos % 6 * 100.0 + 40 <= 48 OR pos % 6 * 100.0 >= 552 AS margin,
                 trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS key FROM l),
    n AS (SELECT doc_id, count(DISTINCT page) AS of_pages FROM b GROUP BY 1)
    SELECT doc_id, key, count(DISTINCT page) AS n_pages FROM b JOIN n USING (doc_id) WHERE margin
    GROUP BY doc_id, key, of_pages HAVING count(DISTINCT page) >= greatest(3, floor(of_pages * 0.4))""")
def furniture(t: Tables) -> DataFrame:
    return layout.furniture_keys(*paged_blocks(t))


@query(r"""
    WITH b AS (SELECT p_brand AS doc_id, round_even(p_size / 4.0 * 2, 0) / 2 AS half, sum(length(p_name)) AS n, min(p_partkey) AS pos FROM part GROUP BY ALL)
    SELECT doc_id, half AS body FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1""")
def body_font(t: Tables) -> DataFrame:
    return layout.body_size(t.part.select(F.col("p_brand").alias("doc_id"), (F.col("p_size") / 4.0).alias("size"), F.length("p_name").alias("chars"), F.col("p_partkey").alias("pos")))


@query(r"""
    WITH h AS (SELECT p_brand AS doc_id, p_partkey AS pos, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE CAST(p_size % 9 AS DOUBLE) END AS size FROM part),
    d AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, size > 0 ORDER BY size DESC) AS r FROM h),
    c AS (SELECT doc_id, count(DISTINCT size) FILTER (size > 0) AS sizes FROM h GROUP BY 1)
    SELECT doc_id, pos, size, CAST(least(CASE WHEN size > 0 THEN r ELSE sizes + 1 END, 6) AS INTEGER) AS level FROM d JOIN c USING (doc_id)""")
def heading_levels(t: Tables) -> DataFrame:
    size = F.when(F.col("p_size") % 7 == 0, 0.0).otherwise((F.col("p_size") % 9).cast("double"))
    heads = t.part.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("pos"), size.alias("size"), F.lit(0).alias("level"))
    return layout.heading_levels(heads).select("doc_id", "pos", "size", F.col("level").cast("int").alias("level"))


@query(r"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS t FROM documents),
    s AS (SELECT *, 10 + pos % 5 * 0.5 AS size, pos % 3 = 0 AS bold, 1 + pos % 4 AS n_lines, pos % 11 = 0 AS is_list, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters FROM l)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos,
           CAST(CASE WHEN is_list OR n_lines > 3 OR length(t) NOT BETWEEN 2 AND 200 OR regexp_matches(t, '(?i)^(?:table|tab\.|figure|fig\.|chart|exhibit)\s*[A-Z]?\d+')
                     OR t LIKE '%,' OR t LIKE '%;' OR letters < 2 OR letters / length(t) < 0.4 OR (t LIKE '%.' AND size < 13) THEN NULL
                WHEN size >= 10 * 1.12 THEN size
                WHEN bold AND size >= 9.8 AND n_lines <= 2 AND length(t) <= 120 THEN 0.0
                WHEN t = upper(t) AND t <> lower(t) AND letters >= 3 AND size >= 9.8 AND n_lines <= 2 AND length(t) <= 100 THEN 0.0 END AS DOUBLE) AS style
    FROM s""")
def heading_style(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    p = F.col("pos")
    style = geometry.heading_style(F.col("t"), 10 + p % 5 * 0.5, p % 3 == 0, 1 + p % 4, p % 11 == 0, F.lit(10.0))
    return lines.select("doc_id", "pos", style.alias("style"))


BOXES = """SELECT CAST(l_orderkey % 3000 AS VARCHAR) AS doc_id, 1 AS page, CAST(row_number() OVER (PARTITION BY l_orderkey % 3000 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS pos,
    CAST(CASE WHEN l_partkey % 2 = 0 THEN 20 ELSE 320 END AS DOUBLE) AS x0, CAST(l_suppkey % 60 * 12 AS DOUBLE) AS y0,
    CAST(CASE WHEN l_partkey % 13 = 0 THEN 580 WHEN l_partkey % 2 = 0 THEN 280 ELSE 580 END AS DOUBLE) AS x1,
    CAST(l_suppkey % 60 * 12 + l_quantity AS DOUBLE) AS y1 FROM lineitem"""


@query(f"""
    WITH b AS ({BOXES}), s AS (SELECT *, CASE WHEN x1 - x0 > 360 THEN 0 WHEN (x0 + x1) / 2 < 300 THEN 1 ELSE 2 END AS side FROM b),
    t AS (SELECT doc_id, page, count(*) FILTER (side = 1) >= 2 AND count(*) FILTER (side = 2) >= 2 AND EXISTS (
              SELECT 1 FROM s l JOIN s r ON l.doc_id = r.doc_id AND l.page = r.page AND l.side = 1 AND r.side = 2 AND l.y0 < r.y1 AND r.y0 < l.y1
              WHERE l.doc_id = s.doc_id AND l.page = s.page) AS two FROM s GROUP BY doc_id, page),
    g AS (SELECT *, CASE WHEN two THEN sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, pos) ELSE 0 END AS seg FROM s JOIN t USING (doc_id, page))
    SELECT doc_id, page, pos, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY seg, CASE WHEN two THEN side ELSE 0 END, y0, x0, pos) - 1 AS INTEGER) AS reading_pos FROM g""")
def reading_order(t: Tables) -> DataFrame:
    t.lineitem.createOrReplaceTempView("lodestack_lineitem")
    boxes = t.spark.sql(BOXES.replace("VARCHAR", "STRING").replace("FROM lineitem", "FROM lodestack_lineitem"))
    return layout.reading_order(boxes, F.lit(600.0)).select("doc_id", "page", "pos", F.col("reading_pos").cast("int").alias("reading_pos"))


@query(f"""
    WITH b AS ({BOXES}), t AS (SELECT doc_id, page, x0 - 5 AS x0, y0 AS y0, x1 - 60 AS x1, y0 + 15 AS y1 FROM b WHERE pos % 5 = 0)
    SELECT doc_id, page, pos FROM b WHERE NOT EXISTS (
        SELECT 1 FROM t WHERE t.doc_id = b.doc_id AND t.page = b.page AND least(b.x1, t.x1) > greatest(b.x0, t.x0) AND least(b.y1, t.y1) > greatest(b.y0, t.y0)
          AND (b.x1 - b.x0) * (b.y1 - b.y0) > 0
          AND (least(b.x1, t.x1) - greatest(b.x0, t.x0)) * (least(b.y1, t.y1) - greatest(b.y0, t.y0)) / ((b.x1 - b.x0) * (b.y1 - b.y0)) > 0.5)""")
def table_overlap_anti(t: Tables) -> DataFrame:
    t.lineitem.createOrReplaceTempView("lodestack_lineitem")
    boxes = t.spark.sql(BOXES.replace("VARCHAR", "STRING").replace("FROM lineitem", "FROM lodestack_lineitem"))
    found = boxes.where("pos % 5 = 0").selectExpr("doc_id", "page", "x0 - 5 AS x0", "y0", "x1 - 60 AS x1", "y0 + 15 AS y1")
    return layout.outside_tables(boxes, found).select("doc_id", "page", "pos")


@query(r"""
    WITH n AS (SELECT DISTINCT user_id, CAST(strftime(ts, '%d') AS BIGINT) AS n FROM events),
    g AS (SELECT user_id, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS g, n FROM n),
    i AS (SELECT user_id, min(n) AS a, max(n) AS b FROM g GROUP BY user_id, g)
    SELECT user_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) AS ranges FROM i GROUP BY user_id""")
def page_ranges(t: Tables) -> DataFrame:
    return ocr_plan.page_ranges(t.events.select("user_id", F.dayofmonth("ts").alias("page")), "user_id")


@query(r"""
    WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, CAST(l_orderkey AS INTEGER) AS page, sum(CAST(l_quantity AS BIGINT)) AS chars,
                      least(sum(l_discount) FILTER (l_discount >= 0.03), 1.0) AS cover, max(l_discount) FILTER (l_discount >= 0.03) AS biggest FROM lineitem GROUP BY ALL),
    m AS (SELECT *, CASE WHEN chars < 40 AND cover >= 0.10 THEN 'full' WHEN chars >= 40 AND cover >= 0.12 AND biggest < 0.80 THEN 'figures' END AS mode FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mode = 'figures', page) - 1 AS place FROM m WHERE mode IS NOT NULL)
    SELECT doc_id, page, mode, CAST(place AS INTEGER) AS place, place < 24 AS wanted FROM o""")
def ocr_pages(t: Tables) -> DataFrame:
    return ocr_plan.plan(lineitem_pages(t)).withColumn("place", F.col("place").cast("int"))


def lineitem_pages(t: Tables) -> DataFrame:
    """A page per supplier and order, with made-up characters and images."""
    big = F.when(F.col("l_discount") >= 0.03, F.col("l_discount"))
    return t.lineitem.groupBy(F.col("l_suppkey").cast("string").alias("doc_id"), F.col("l_orderkey").cast("int").alias("page")).agg(F.sum(F.col("l_quantity").cast("long")).alias("chars"), F.least(F.sum(big), F.lit(1.0)).alias("image_coverage"), F.max(big).alias("biggest_image"))


BM25 = r"""
    docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
    stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM docs),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM docs) GROUP BY ALL),
    raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, stats GROUP BY term, n),
    idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
    asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY ALL),
    scored AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
               FROM tf JOIN idf USING (term) JOIN asked USING (term), stats GROUP BY query_id, doc_id),
    bm AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM scored) WHERE rank < 20 AND score > 0)"""


def whole_documents(t: Tables) -> DataFrame:
    return t.documents.select(F.lit("all").alias("session_id"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.lit("all").alias("session_id"), "text")


def document_postings(t: Tables) -> DataFrame:
    return materialize(retrieval.postings(whole_documents(t)), "postings")


def bm25_hits(t: Tables) -> DataFrame:
    posts = document_postings(t)
    return retrieval.bm25(posts, retrieval.corpus(posts), questions(t))


@query(f"WITH {BM25} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM bm")
def bm25_topk(t: Tables) -> DataFrame:
    return bm25_hits(t).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


DENSE = """
    q AS (SELECT item_id AS query_id, e.embedding FROM benchmark JOIN embeddings e ON e.vec_id = item_id),
    cos AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) AS score FROM q, embeddings e),
    dn AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM cos) WHERE rank < 20)"""


def dense_hits(t: Tables) -> DataFrame:
    vectors = t.embeddings.select(F.lit("all").alias("session_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = questions(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return retrieval.dense(vectors, asked)


@query(f"WITH {DENSE} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM dn")
def dense_topk(t: Tables) -> DataFrame:
    return dense_hits(t).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


FUSED = f"""WITH {BM25}, {DENSE},
    u AS (SELECT query_id, doc_id, 0 AS list, rank FROM dn UNION ALL SELECT query_id, doc_id, 1, rank FROM bm),
    s AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list * 1000 + rank) AS seen FROM u GROUP BY ALL),
    fused AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) - 1 AS rank FROM s)"""


@query(f"{FUSED} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 9) AS score FROM fused WHERE rank < 20")
def rrf_fuse(t: Tables) -> DataFrame:
    return retrieval.fuse([dense_hits(t), bm25_hits(t)]).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("int").alias("rank"), F.round("score", 9).alias("score"))


@query(f"{FUSED} SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM fused WHERE rank < 5")
def hybrid(t: Tables) -> DataFrame:
    posts, vectors = document_postings(t), t.embeddings.select(F.lit("all").alias("session_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = questions(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")
    return retrieval.hybrid(posts, retrieval.corpus(posts), vectors, asked).select("query_id", F.col("chunk_id").alias("doc_id"), F.col("rank").cast("int").alias("rank"))


@query(rf"""WITH RECURSIVE {LINES}, c AS (
        SELECT *, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, seq) - 1 AS rank FROM packed
    ), f AS (
        SELECT DISTINCT doc_id, CAST(-1 AS BIGINT) AS rank, CAST([] AS INTEGER[]) AS taken, CAST(NULL AS INTEGER) AS low, CAST(NULL AS INTEGER) AS high FROM c
        UNION ALL
        SELECT doc_id, rank, CASE WHEN gone THEN taken ELSE list_concat(taken, CAST(range(a, b + 1) AS INTEGER[])) END, CASE WHEN NOT gone THEN a END, CASE WHEN NOT gone THEN b END
        FROM (
            SELECT *, seq - CASE WHEN before THEN 1 ELSE 0 END AS a,
                   seq + CASE WHEN behind AND n + CASE WHEN before THEN 2 + before_n ELSE 0 END + 2 + behind_n <= 3600 THEN 1 ELSE 0 END AS b
            FROM (
                SELECT f.doc_id, h.rank, f.taken, h.seq, h.n, l.n AS before_n, r.n AS behind_n, list_contains(f.taken, h.seq) AS gone,
                       l.n IS NOT NULL AND NOT list_contains(f.taken, h.seq - 1) AND h.n + 2 + l.n <= 3600 AS before,
                       r.n IS NOT NULL AND NOT list_contains(f.taken, h.seq + 1) AS behind
                FROM f JOIN c h ON h.doc_id = f.doc_id AND h.rank = f.rank + 1
                LEFT JOIN c l ON l.doc_id = h.doc_id AND l.seq = h.seq - 1 LEFT JOIN c r ON r.doc_id = h.doc_id AND r.seq = h.seq + 1
            )
        )
    ), w AS (
        SELECT f.doc_id, f.rank, f.high > f.low AS expanded, string_agg(c.text, chr(10) || chr(10) ORDER BY c.seq) AS text, min(c.page_start) AS page_start, max(c.page_end) AS page_end
        FROM f JOIN c ON c.doc_id = f.doc_id AND c.seq BETWEEN f.low AND f.high GROUP BY ALL
    )
    SELECT doc_id AS query_id, CAST(rank AS INTEGER) AS rank, expanded, md5(text) AS digest, page_start, page_end,
           CAST(length('[Page' || CASE WHEN page_end <> page_start THEN 's ' || page_start || '-' || page_end ELSE ' ' || page_start END || ']') + 2 AS BIGINT) AS body_offset
    FROM w""")
def expand_context(t: Tables) -> DataFrame:
    chunks = materialize(flows.document_chunks(t.spark, t.sf_dir), "chunks")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("text").desc(), "seq")) - 1
    wide = context.expand(chunks.withColumn("query_id", F.col("doc_id")).withColumn("rank", rank), chunks)
    return wide.select("query_id", "rank", "expanded", F.md5("text").alias("digest"), "page_start", "page_end", F.col("body_offset").cast("long").alias("body_offset"))


@query(f"""WITH RECURSIVE {LINES}, c AS (SELECT *, '[Page' || CASE WHEN page_end <> page_start THEN 's ' || page_start || '-' || page_end ELSE ' ' || page_start END || ']' AS head FROM packed)
    SELECT doc_id AS query_id, seq AS rank, page_start AS page, CASE WHEN page_end <> page_start THEN page_end END AS page_end, CAST(NULL AS VARCHAR) AS section, 'text' AS type,
           CASE WHEN length(text) > 400 THEN left(text, 400) || '…' ELSE text END AS excerpt FROM c""")
def citations(t: Tables) -> DataFrame:
    chunks = flows.document_chunks(t.spark, t.sf_dir)
    return context.citations(chunks.withColumn("query_id", F.col("doc_id")).withColumn("rank", F.col("seq")))


def messages(t: Tables) -> DataFrame:
    return t.conversations.where("role <> 'system'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence"), "role", F.col("text").alias("content"))


@query("""SELECT conv_id AS session_id, turn AS sequence, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system') WHERE n <= 3""")
def recent_history(t: Tables) -> DataFrame:
    return history.recent(messages(t), 3).select("session_id", "sequence", "role", F.col("place").cast("int").alias("place"))


@query("""SELECT conv_id AS session_id, right(string_agg(role || ': ' || left(text, 2000), chr(10) ORDER BY turn), 12000) AS history
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role <> 'system') WHERE n <= 12 GROUP BY conv_id""")
def history_text(t: Tables) -> DataFrame:
    return history.history_text(messages(t))


def sessions(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("doc_name"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("make_dt_interval(0, o_orderkey % 24)")).alias("updated_at"))


SESSIONS = "s AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderpriority AS doc_name, o_orderdate AS created_at, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS updated_at FROM orders)"


@query(f"""WITH {SESSIONS} SELECT conv_id AS session_id, turn AS sequence, user_id FROM conversations JOIN s ON s.session_id = conv_id WHERE role <> 'system'""")
def owner_messages(t: Tables) -> DataFrame:
    return history.owner_messages(messages(t), sessions(t)).select("session_id", "sequence", "user_id")


@query(f"""WITH {SESSIONS} SELECT session_id, doc_name, updated_at FROM s WHERE user_id = 7 ORDER BY updated_at DESC, session_id""")
def list_sessions(t: Tables) -> DataFrame:
    return history.list_sessions(sessions(t), 7).select("session_id", "doc_name", "updated_at")


@query(f"""WITH {SESSIONS} SELECT session_id, doc_name FROM s WHERE contains(lower(doc_name), 'high')""")
def session_search(t: Tables) -> DataFrame:
    return history.search_sessions(sessions(t), " High ").select("session_id", "doc_name")


@query(f"""WITH {SESSIONS}, n AS (SELECT max(updated_at) AS now FROM s), b AS (
        SELECT session_id, CASE WHEN updated_at >= date_trunc('day', now) THEN 'Today' WHEN updated_at >= date_trunc('day', now) - INTERVAL 1 DAY THEN 'Yesterday'
               WHEN updated_at >= date_trunc('day', now) - INTERVAL 7 DAY THEN 'Previous 7 days' ELSE 'Earlier' END AS bucket FROM s, n)
    SELECT session_id, bucket, CASE bucket WHEN 'Today' THEN 0 WHEN 'Yesterday' THEN 1 WHEN 'Previous 7 days' THEN 2 ELSE 3 END AS bucket_order FROM b""")
def date_buckets(t: Tables) -> DataFrame:
    rows = sessions(t)
    now = rows.agg(F.max("updated_at").alias("now"))
    return history.grouped_sessions(rows.join(F.broadcast(now)), F.col("now")).select("session_id", "bucket", "bucket_order")


@query(f"""WITH {SESSIONS}, n AS (SELECT session_id, -1 AS user_id, doc_name || '+' AS doc_name, created_at + INTERVAL 1 DAY AS created_at, updated_at + INTERVAL 1 DAY AS updated_at FROM s WHERE session_id % 3 = 0
        UNION ALL SELECT session_id + 100000000, user_id, doc_name, created_at, updated_at FROM s WHERE session_id % 5 = 0)
    SELECT coalesce(n.session_id, s.session_id) AS session_id, coalesce(s.user_id, n.user_id) AS user_id, coalesce(n.doc_name, s.doc_name) AS doc_name,
           coalesce(s.created_at, n.created_at) AS created_at, coalesce(n.updated_at, s.updated_at) AS updated_at
    FROM s FULL JOIN n ON s.session_id = n.session_id""")
def upsert_sessions(t: Tables) -> DataFrame:
    old = sessions(t)
    later = old.where("session_id % 3 = 0").selectExpr("session_id", "CAST(-1 AS BIGINT) AS user_id", "doc_name || '+' AS doc_name", "created_at + INTERVAL 1 DAY AS created_at", "updated_at + INTERVAL 1 DAY AS updated_at")
    more = old.where("session_id % 5 = 0").selectExpr("session_id + 100000000 AS session_id", "user_id", "doc_name", "created_at", "updated_at")
    return history.upsert_sessions(old, later.unionByName(more))


@query("""SELECT doc_id AS chunk_id, source AS section FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'new' FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 = 0""")
def insert_ignore(t: Tables) -> DataFrame:
    old = t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("section"))
    return tables.insert_ignore(old, t.documents.where("doc_id % 3 = 0").select(F.col("doc_id").alias("chunk_id"), F.lit("new").alias("section")))


@query("""SELECT 'session' AS kind, o_orderkey AS session_id, CAST(NULL AS BIGINT) AS sequence FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'message', conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def delete_cascade(t: Tables) -> DataFrame:
    gone = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("session_id"))
    left, said = history.delete_sessions(gone, t.orders.select(F.col("o_orderkey").alias("session_id")), t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence")))
    return left.select(F.lit("session").alias("kind"), "session_id", F.lit(None).cast("long").alias("sequence")).unionByName(said.withColumn("kind", F.lit("message")))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, ts AS begin_ts, 1 AS attempt FROM e WHERE n = 1
          UNION ALL
          SELECT e.user_id, e.event_id, e.n, CASE WHEN e.ts - f.begin_ts > INTERVAL 720 MINUTE THEN e.ts ELSE f.begin_ts END,
                 CASE WHEN e.ts - f.begin_ts > INTERVAL 720 MINUTE THEN 1 ELSE f.attempt + 1 END
          FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id AS client_key, event_id AS id, attempt, attempt <= 2 AS allowed FROM f""")
def auth_window(t: Tables) -> DataFrame:
    return limits.attempts(t.events.select(F.col("user_id").alias("client_key"), "ts", F.col("event_id").alias("id")), limit=2, minutes=720)


@query("""WITH e AS (SELECT event_id AS id, ts, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS DATE) AS day FROM events)
    SELECT id, day, row_number() OVER (PARTITION BY day ORDER BY ts, id) <= 100 AS allowed FROM e""")
def daily_budget(t: Tables) -> DataFrame:
    return limits.daily_budget(t.events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts")), 100).select("id", "day", "allowed")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    f AS (SELECT user_id, event_id, n, t AS start_us FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.event_id, e.n, greatest(e.t, f.start_us + 21600000000) FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT user_id AS client_key, event_id AS id, start_us FROM f""")
def request_spacing(t: Tables) -> DataFrame:
    return limits.spacing(t.events.select(F.col("user_id").alias("client_key"), "ts", F.col("event_id").alias("id")), 21600.0).select("client_key", "id", "start_us")


ERRORS = """SELECT event_id AS id, CAST([429, 429, 429, 500, 503, 401, 404, 400, 0][event_id % 9 + 1] AS INTEGER) AS code,
    CASE event_id % 9 WHEN 0 THEN 'quota GenerateRequestsPerDay ' WHEN 1 THEN 'Please retry in ' || (event_id % 150) || '.5s' WHEN 2 THEN 'retryDelay: ' || (event_id % 120) || 's' ELSE event_type END AS message,
    CASE WHEN event_id % 18 = 8 THEN 'ReadTimeout' WHEN event_id % 9 = 8 THEN 'ValueError' ELSE 'ApiError' END AS name FROM events"""


@query(f"""WITH e AS ({ERRORS}), d AS (SELECT *, CAST(coalesce(nullif(regexp_extract(lower(message), 'retrydelay\\W+(\\d+(?:\\.\\d+)?)s', 1), ''), nullif(regexp_extract(lower(message), 'retry in (\\d+(?:\\.\\d+)?)\\s*s', 1), '')) AS DOUBLE) AS delay FROM e)
    SELECT id, delay, CASE WHEN code = 429 AND (contains(replace(replace(lower(message), ' ', ''), '_', ''), 'perday') OR contains(lower(message), 'daily')) THEN 'abort'
        WHEN code = 429 AND delay > 90 THEN 'abort' WHEN code IN (429, 500, 502, 503, 504) THEN 'retry' WHEN code IN (401, 403, 404) THEN 'abort'
        WHEN regexp_matches(lower(name), 'timeout|connect') THEN 'retry' ELSE 'fail' END AS action,
        least(coalesce(delay, 5 * pow(2.0, id % 6)), 90.0) AS wait FROM d""")
def error_classify(t: Tables) -> DataFrame:
    t.events.createOrReplaceTempView("lodestack_events")
    sql = ERRORS.replace("[429, 429, 429, 500, 503, 401, 404, 400, 0][event_id % 9 + 1]", "element_at(array(429, 429, 429, 500, 503, 401, 404, 400, 0), CAST(event_id % 9 + 1 AS INT))").replace("FROM events", "FROM lodestack_events")
    rows = t.spark.sql(sql)
    delay = text.retry_delay(F.col("message"))
    return rows.select("id", delay.alias("delay"), text.error_action(F.col("code"), F.col("message"), F.col("name")).alias("action"), text.backoff(delay, F.col("id") % 6).cast("double").alias("wait"))


@query("""SELECT c_custkey, sha256(c_name) AS token_hash, trim(lower(c_name)) || '@' || lower(c_mktsegment) || '.org' AS email,
    regexp_matches(lower(trim(c_name || '@' || c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '.org' END)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS valid FROM customer""")
def accounts(t: Tables) -> DataFrame:
    mail = F.concat("c_name", F.lit("@"), "c_mktsegment", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(".org"))
    return t.customer.select("c_custkey", F.sha2("c_name", 256).alias("token_hash"), F.concat(F.trim(F.lower("c_name")), F.lit("@"), F.lower("c_mktsegment"), F.lit(".org")).alias("email"), text.valid_email(mail).alias("valid"))


@query("""WITH a AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS token_hash, o_custkey AS user_id, o_orderdate + INTERVAL 7 DAY AS expires_at FROM orders WHERE o_orderkey % 4 <> 0)
    SELECT token_hash, c_custkey AS id, c_name AS name, c_mktsegment AS email FROM a JOIN customer ON user_id = c_custkey
    WHERE expires_at > TIMESTAMP '1997-01-01' AND token_hash IN (SELECT sha256(CAST(o_orderkey AS VARCHAR)) FROM orders WHERE o_orderkey % 3 = 0)""")
def current_users(t: Tables) -> DataFrame:
    key = F.sha2(F.col("o_orderkey").cast("string"), 256).alias("token_hash")
    live = t.orders.where("o_orderkey % 4 <> 0").select(key, F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    users = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"))
    return history.current_users(users, live, t.orders.where("o_orderkey % 3 = 0").select(key), F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, json_valid(props) AS valid, md5(props) AS digest FROM events""")
def json_sources(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"), F.md5("props").alias("digest"))


@query(r"""SELECT page_id, CAST(1 + page_id % 6 AS INTEGER) AS level, 'Page ' || page_id AS title FROM pages UNION ALL SELECT page_id, 2, 'Sub' || page_id FROM pages
    UNION ALL SELECT page_id, 1, 'Using C' FROM pages UNION ALL SELECT page_id, 3, 'fi ' || page_id FROM pages""")
def markdown_headings(t: Tables) -> DataFrame:
    md = F.concat(F.lit("```markdown\n"), F.expr("repeat('#', CAST(1 + page_id % 6 AS INT))"), F.lit(" *Page* "), "page_id", F.lit(" ##\ntext\n   ## Sub_"), "page_id", F.lit("\n# Using C#\n# **\n#no heading\n### \ufb01 "), "page_id", F.lit("\n```"))
    return text.markdown_headings(t.pages.select("page_id", md.alias("md")), "md").select("page_id", "level", "title")


@query(r"""SELECT page_id, '' AS fenced, CAST(NULL AS VARCHAR) AS note, 'x' AS inner_text, '[Text and data from a figure/image on this page]' || chr(10) || 'n' || page_id AS told FROM pages""")
def fences(t: Tables) -> DataFrame:
    empty, inner, note = F.lit("```md\n```"), F.lit("\u00a0```\nx\n```\u2003"), F.concat(F.lit("```markdown\nn"), "page_id", F.lit("\n```"))
    return t.pages.select("page_id", text.strip_fence(empty).alias("fenced"), ocr_plan.figure_note(empty).alias("note"), text.strip_fence(inner).alias("inner_text"), ocr_plan.figure_note(note).alias("told"))


@query(r"""
    WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)<(h[1-6]|p|li)>(.*?)</(?:h[1-6]|p|li)>', 1) AS t, regexp_extract_all(html, '(?s)<(h[1-6]|p|li)>(.*?)</(?:h[1-6]|p|li)>', 2) AS b FROM pages),
    e AS (SELECT page_id, generate_subscripts(t, 1) AS n, unnest(t) AS tag, unnest(b) AS body FROM p),
    x AS (SELECT page_id, n, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'list' ELSE 'paragraph' END AS kind, CASE WHEN tag LIKE 'h%' THEN CAST(substr(tag, 2, 1) AS INTEGER) ELSE 0 END AS level,
                 trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n]+', ' ', 'g')) AS text FROM e),
    k AS (SELECT *, CASE WHEN kind = 'list' AND lag(kind) OVER w = 'list' THEN 0 ELSE 1 END AS starts FROM x WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY n)),
    g AS (SELECT *, sum(starts) OVER (PARTITION BY page_id ORDER BY n) AS run FROM k)
    SELECT CAST(page_id AS VARCHAR) AS doc_id, CAST(run - 1 AS INTEGER) AS sub, min(kind) AS kind, max(level) AS level,
           md5(string_agg(CASE WHEN kind = 'list' THEN '- ' || text WHEN kind = 'heading' THEN trim(regexp_replace(regexp_replace(text, '\s*#*$', ''), '[*_`]', '', 'g')) ELSE text END, chr(10) ORDER BY n)) AS digest
    FROM g GROUP BY page_id, run""")
def markdown_elements(t: Tables) -> DataFrame:
    mark = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).when(F.col("kind") == "list", "- ").otherwise("")
    before = F.lag("kind").over(Window.partitionBy("page_id").orderBy("pos"))
    gap = F.when((F.col("kind") == "list") & (before == "list"), "\n").otherwise("\n\n")
    lines = adapters.html_elements(t.pages).select("page_id", "pos", F.concat(gap, mark, "text").alias("line"))
    md = lines.groupBy(F.col("page_id").cast("string").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("markdown"))
    found = structure.markdown_items(md.withColumn("page", F.lit(1)))
    return found.select("doc_id", "sub", "kind", "level", F.md5("text").alias("digest"))


def ocr_answers(asked: list[dict]) -> tuple[dict, dict]:
    """A made-up service: some pages have no text, some are skipped, some make a request fail, and some end the work."""
    numbers = [x["page"] for x in asked]
    if any(p % 29 == 0 for p in numbers):
        raise type("Refused", (Exception,), {"code": 401})("no access")
    if any(p % 13 == 0 for p in numbers):
        raise ValueError("bad request")
    return {p: f"# Page {p}" for p in numbers if p % 7 and p % 17}, {p: "a blank page" for p in numbers if p % 17 == 0}


@query(r"""
    WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, CAST(l_orderkey AS INTEGER) AS page, sum(CAST(l_quantity AS BIGINT)) AS chars,
                      least(sum(l_discount) FILTER (l_discount >= 0.03), 1.0) AS cover, max(l_discount) FILTER (l_discount >= 0.03) AS biggest FROM lineitem GROUP BY ALL),
    m AS (SELECT *, CASE WHEN chars < 40 AND cover >= 0.10 THEN 1 WHEN chars >= 40 AND cover >= 0.12 AND biggest < 0.80 THEN 2 END AS mode FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mode, page) - 1 AS place FROM m WHERE mode IS NOT NULL),
    b AS (SELECT *, place // 3 AS batch FROM o WHERE place < 24),
    s AS (SELECT *, min(CASE WHEN page % 29 = 0 THEN batch END) OVER (PARTITION BY doc_id) AS stopped, bool_or(page % 13 = 0) OVER (PARTITION BY doc_id, batch) AS failed FROM b),
    r AS (SELECT doc_id, page, CASE WHEN batch >= stopped THEN 'the OCR service rejected the request (401)' WHEN page % 13 = 0 THEN 'the OCR service failed' WHEN page % 17 = 0 THEN 'a blank page'
                 WHEN page % 7 = 0 AND failed THEN 'the OCR service failed' WHEN page % 7 = 0 THEN 'the model returned no text for this page' END AS reason FROM s)
    SELECT doc_id, page, CASE WHEN reason IS NULL THEN '# Page ' || page END AS markdown, reason FROM r""")
def ocr_run(t: Tables) -> DataFrame:
    return ocr_plan.call_provider(ocr_plan.plan(lineitem_pages(t)).where("wanted"), ocr_answers)


PART_BLOCKS = """SELECT p_brand AS doc_id, CAST(p_partkey DIV 40 + 1 AS INT) AS page, CAST(p_partkey AS INT) AS pos,
    CASE WHEN p_size % 6 = 0 THEN p_name WHEN p_size % 6 < 3 THEN '- ' || p_name WHEN p_size % 4 = 0 THEN p_name ELSE upper(p_name) || '.' END AS text,
    20.0D AS x0, CAST(p_partkey % 40 * 14 + 60 AS DOUBLE) AS y0, 280.0D AS x1, CAST(p_partkey % 40 * 14 + 72 AS DOUBLE) AS y1,
    CAST(CASE WHEN p_size % 12 = 0 THEN 16 WHEN p_size % 6 = 0 THEN 14 ELSE 10 END AS DOUBLE) AS size, false AS bold, 1 AS n_lines, p_size % 6 IN (1, 2) AS is_list FROM part"""


@query(f"""
    WITH b AS ({PART_BLOCKS.replace(" DIV ", " // ").replace(".0D", ".0::DOUBLE")}),
    m AS (SELECT doc_id, size AS body FROM (SELECT doc_id, size, sum(length(text)) AS n, min(pos) AS pos FROM b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) = 1),
    s AS (SELECT b.*, body, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters FROM b JOIN m USING (doc_id)),
    k AS (SELECT *, CASE WHEN is_list OR length(text) NOT BETWEEN 2 AND 200 OR letters < 2 OR letters / length(text) < 0.4 OR (text LIKE '%.' AND size < body * 1.3) THEN NULL
                         WHEN size >= body * 1.12 THEN size WHEN text = upper(text) AND text <> lower(text) AND letters >= 3 AND size >= body * 0.98 AND length(text) <= 100 THEN 0.0 END AS style FROM s),
    e AS (SELECT *, CASE WHEN style IS NOT NULL THEN 'heading' WHEN is_list THEN 'list' ELSE 'paragraph' END AS kind FROM k),
    l AS (SELECT *, page - lag(page) OVER w <= 1 AND kind = lag(kind) OVER w AND (kind = 'list' OR kind = 'paragraph' AND NOT regexp_matches(lag(text) OVER w, '[.!?]$') AND regexp_matches(text, '^\\p{{Ll}}')) AS joins
          FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    r AS (SELECT *, sum(CASE WHEN coalesce(joins, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l),
    x AS (SELECT doc_id, CAST(run - 1 AS INTEGER) AS pos, min(kind) AS kind, min(page) AS page, max(page) AS page_end, max(coalesce(style, 0.0)) AS size,
                 md5(CASE WHEN min(kind) = 'list' THEN string_agg(text, chr(10) ORDER BY r.pos) ELSE string_agg(text, ' ' ORDER BY r.pos) END) AS digest FROM r GROUP BY doc_id, run),
    d AS (SELECT doc_id, size, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS rank FROM (SELECT DISTINCT doc_id, size FROM x WHERE kind = 'heading' AND size > 0)),
    c AS (SELECT doc_id, max(rank) AS sizes FROM d GROUP BY 1)
    SELECT x.doc_id, x.pos, kind, page, page_end, x.size, digest, CAST(CASE WHEN kind = 'heading' THEN least(coalesce(rank, coalesce(sizes, 0) + 1), 6) ELSE 0 END AS INTEGER) AS level
    FROM x LEFT JOIN d ON d.doc_id = x.doc_id AND d.size = x.size AND kind = 'heading' LEFT JOIN c ON c.doc_id = x.doc_id""")
def assemble_blocks(t: Tables) -> DataFrame:
    t.part.createOrReplaceTempView("lodestack_part")
    blocks = t.spark.sql(PART_BLOCKS.replace("FROM part", "FROM lodestack_part")).withColumn("chars", F.length("text"))
    pages = blocks.select("doc_id", "page").distinct().withColumn("width", F.lit(600.0)).withColumn("height", F.lit(700.0))
    elements, _, _ = flows.document_elements(blocks, pages)
    return elements.select("doc_id", "pos", "kind", "page", "page_end", "size", F.md5("text").alias("digest"), "level")


@query("""SELECT c_custkey, CAST(c_custkey % 9 + 1 AS INTEGER) AS page, '# ' || c_name AS markdown, '[{"page":' || (c_custkey % 9 + 1) || ',"page_end":null,"section":"' || c_mktsegment || '","type":"text","excerpt":"' || c_name || '"}]' AS sources FROM customer""")
def ocr_json(t: Tables) -> DataFrame:
    page = (F.col("c_custkey") % 9 + 1).cast("int")
    listed = F.concat(F.lit('[{"page":'), page, F.lit(',"markdown":"```md\\n# '), "c_name", F.lit('\\n```"}]'))
    response = F.when(F.col("c_custkey") % 2 == 0, listed).when(F.col("c_custkey") % 2 == 1, F.concat(F.lit('{"pages":'), listed, F.lit("}")))
    sources = F.to_json(F.array(text.sources_json(page, F.lit(None), F.col("c_mktsegment"), F.lit("text"), F.col("c_name"))), {"ignoreNullFields": "false"})
    return t.customer.select("c_custkey", F.explode(text.ocr_json(response)).alias("p"), sources.alias("sources")).select("c_custkey", "p.page", "p.markdown", "sources")


@query(r"""SELECT n_nationkey, 'key~name' || chr(10) || n_nationkey || '~' || n_name || '\|x' AS grid FROM nation""")
def markdown_tables(t: Tables) -> DataFrame:
    lines = F.array(F.lit("| key | name |"), F.lit("|---|:--:|"), F.concat(F.lit("| "), "n_nationkey", F.lit(" | "), "n_name", F.lit("\\|x |")))
    return t.nation.select("n_nationkey", F.array_join(F.transform(text.parse_markdown_table(lines), lambda r: F.array_join(r, "~")), "\n").alias("grid"))


@query(r"""
    WITH r AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS pos, CAST(l_linenumber AS INTEGER) AS page, l_partkey % 3 <> 0 AS top,
                      CASE WHEN l_suppkey % 2 = 0 THEN ['a', 'b'] ELSE ['a', 'b', 'c'] END AS head, CAST(l_partkey AS VARCHAR) AS cell FROM lineitem),
    l AS (SELECT *, page - 1 = lag(page) OVER w AND top AND len(head) = lag(len(head)) OVER w AS joins FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    g AS (SELECT *, sum(CASE WHEN coalesce(joins, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM l)
    SELECT doc_id, min(pos) AS pos, min(page) AS page, max(page) AS page_end, CAST(count(*) + 1 AS INTEGER) AS n_rows, string_agg(cell, ',' ORDER BY pos) AS cells FROM g GROUP BY doc_id, run""")
def stitch_tables(t: Tables) -> DataFrame:
    head = F.when(F.col("l_suppkey") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    cell = F.col("l_partkey").cast("string")
    rows = F.array(head, F.when(F.col("l_suppkey") % 2 == 0, F.array(cell, cell)).otherwise(F.array(cell, cell, cell)))
    found = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("pos"), F.col("l_linenumber").alias("page"), rows.alias("rows"), (F.col("l_partkey") % 3 != 0).alias("at_page_top"))
    return structure.stitch_tables(found).select("doc_id", "pos", "page", "page_end", F.size("rows").alias("n_rows"), F.array_join(F.transform(F.slice("rows", 2, F.size("rows") - 1), lambda r: r[0]), ",").alias("cells"))


@query(r"""
    WITH RECURSIVE s AS (
        SELECT doc_id, generate_subscripts(x, 1) AS n, trim(unnest(x)) AS rest
        FROM (SELECT doc_id, string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\s+([A-Z0-9"\x{201C}(\[])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS x FROM documents WHERE length(text) > 1200)
    ), c AS (
        SELECT doc_id, n, 0 AS k, rest, CAST(NULL AS VARCHAR) AS part FROM s
        UNION ALL
        SELECT doc_id, n, k + 1, CASE WHEN length(rest) > 1200 THEN trim(substr(rest, cut + 1)) ELSE '' END, CASE WHEN length(rest) > 1200 THEN trim(substr(rest, 1, cut)) ELSE rest END
        FROM (SELECT *, CASE WHEN contains(substr(rest, 1, 1200), ' ') AND 1200 - strpos(reverse(substr(rest, 1, 1200)), ' ') >= 600 THEN 1200 - strpos(reverse(substr(rest, 1, 1200)), ' ') ELSE 1200 END AS cut FROM c WHERE rest <> '')
    ), u AS (
        SELECT doc_id, list(part ORDER BY n, k) AS p, list(length(part) ORDER BY n, k) AS l FROM c WHERE part <> '' GROUP BY doc_id
    ), v AS (
        SELECT *, list_prepend(0, list_transform(range(1, len(l) + 1), lambda j: list_sum(l[1:j]))) AS cs FROM u
    ), f AS (
        SELECT doc_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS start, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b FROM v
        UNION ALL
        SELECT doc_id, i + 1, CASE WHEN NOT full_up THEN start WHEN keep IS NOT NULL AND cs[i] - cs[keep] + (i - 1 - keep) + 1 + l[i] <= 1200 THEN keep ELSE i END,
               CASE WHEN full_up THEN start END, CASE WHEN full_up THEN i - 1 END
        FROM (
            SELECT f.doc_id, f.i, f.start, v.l, v.cs, f.i > f.start AND v.cs[f.i] - v.cs[f.start] + (f.i - 1 - f.start) + 1 + v.l[f.i] > 1200 AS full_up,
                   CASE WHEN f.i > f.start AND v.cs[f.i] - v.cs[f.start] + (f.i - 1 - f.start) + 1 + v.l[f.i] > 1200
                        THEN list_filter(range(f.start, f.i), lambda y: v.cs[f.i] - v.cs[y] + (f.i - 1 - y) <= 150 AND (y < f.i - 1 OR v.l[y] <= 149))[1] END AS keep
            FROM f JOIN v ON v.doc_id = f.doc_id AND f.i <= len(v.l)
        )
    ), e AS (
        SELECT doc_id, a, b FROM f WHERE a IS NOT NULL
        UNION ALL SELECT f.doc_id, f.start, CAST(len(v.l) AS BIGINT) FROM f JOIN v ON v.doc_id = f.doc_id AND f.i = len(v.l) + 1
    )
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS INTEGER) AS piece, array_to_string(p[a:b], ' ') AS text FROM e JOIN v USING (doc_id)""")
def long_split(t: Tables) -> DataFrame:
    return t.documents.where(F.length("text") > 1200).select("doc_id", F.posexplode(chunking.split_long(F.regexp_replace("text", "\n", " "))).alias("piece", "text"))


@query(r"""
    WITH RECURSIVE p AS (SELECT page_id, regexp_extract_all(html, '(?s)<(h[1-6]|p|li)>(.*?)</(?:h[1-6]|p|li)>', 1) AS t, regexp_extract_all(html, '(?s)<(h[1-6]|p|li)>(.*?)</(?:h[1-6]|p|li)>', 2) AS b FROM pages),
    e AS (SELECT page_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tag, unnest(b) AS body FROM p),
    x AS (SELECT page_id, pos, trim(regexp_replace(lower(replace(replace(replace(replace(replace(replace(regexp_replace(body, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm FROM e WHERE tag <> 'li'),
    c AS (SELECT b.page_id, b.pos, list(o.pos ORDER BY o.pos) AS entries FROM x b JOIN x o ON o.page_id = b.page_id AND b.norm <> ''
              AND (b.norm = o.norm OR least(length(b.norm), length(o.norm)) >= 6 AND (starts_with(b.norm, o.norm) OR starts_with(o.norm, b.norm)) AND least(length(b.norm), length(o.norm)) / greatest(length(b.norm), length(o.norm)) >= 0.6)
          GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM c),
    f AS (SELECT DISTINCT page_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS entry, CAST([] AS BIGINT[]) AS taken FROM n
          UNION ALL
          SELECT page_id, n, pos, entry, CASE WHEN entry IS NULL THEN taken ELSE list_append(taken, entry) END
          FROM (SELECT n.page_id, n.n, n.pos, f.taken, list_filter(n.entries, lambda y: NOT list_contains(f.taken, y))[1] AS entry FROM f JOIN n ON n.page_id = f.page_id AND n.n = f.n + 1))
    SELECT page_id AS doc_id, 1 AS page, CAST(pos AS INTEGER) AS pos, CAST(entry AS INTEGER) AS entry, 1 AS level FROM f WHERE entry IS NOT NULL""")
def outline_match(t: Tables) -> DataFrame:
    heads = adapters.html_elements(t.pages).where("kind <> 'list'").select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), "pos", text.norm_title(F.col("text")).alias("norm"))
    outline = heads.select("doc_id", "page", F.col("pos").alias("entry"), F.lit(1).alias("level"), F.col("norm").alias("title"))
    return structure.match_outline(heads, outline)


def page_items(t: Tables) -> DataFrame:
    """Items of the HTML pages."""
    return adapters.html_elements(t.pages).select(F.col("page_id").cast("string").alias("doc_id"), "pos", F.lit(1).alias("page"), "kind", "text", "level", F.lit(0.0).alias("size"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(False).alias("at_page_top"))


@query()
def ingest_pages(t: Tables) -> DataFrame:
    chunks, _ = flows.ingest(structure.assemble(page_items(t)))
    return chunks.select("chunk_id", "section_id", "seq", "kind", "breadcrumb", "content", "body_offset", "page_start", "page_end", "overlaps_prev")


@query(f"""WITH RECURSIVE {LINES}, c AS (
        SELECT *, doc_id * 100000 + seq AS ord, doc_id || ':' || seq AS chunk_id,
               '[Page' || CASE WHEN page_end <> page_start THEN 's ' || page_start || '-' || page_end ELSE ' ' || page_start END || ']' || chr(10) || chr(10) || text AS content FROM packed
    ), docs AS (SELECT chunk_id, ord, regexp_extract_all(lower(content), '[a-z0-9]+') AS w FROM c),
    {BM25[BM25.index("stats AS"):BM25.index("bm AS")].replace("doc_id", "chunk_id, ord").replace("documents", "c")}
    bm AS (SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord, chunk_id) - 1 AS rank FROM scored) WHERE rank < 5 AND score > 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, page_start AS page, CASE WHEN page_end <> page_start THEN page_end END AS page_end, CAST(NULL AS VARCHAR) AS section, 'text' AS type,
           CASE WHEN length(text) > 400 THEN left(text, 400) || '…' ELSE text END AS excerpt, chunk_id, round(score, 6) AS score
    FROM bm JOIN c USING (chunk_id)""")
def flagship(t: Tables) -> DataFrame:
    return flows.flagship(t.spark, t.sf_dir).withColumn("rank", F.col("rank").cast("int"))


@query("""WITH i AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, CAST(l_orderkey AS INTEGER) AS page, CAST(l_partkey % 700 AS DOUBLE) - 60 AS x0, CAST(l_linenumber * 90 AS DOUBLE) - 120 AS y0,
        CAST(l_partkey % 700 + l_quantity * 5 AS DOUBLE) - 60 AS x1, CAST(l_linenumber * 90 + l_quantity * 6 AS DOUBLE) - 120 AS y1 FROM lineitem),
    a AS (SELECT *, greatest(least(greatest(x1, 0), 600) - least(greatest(x0, 0), 600), 0) * greatest(least(greatest(y1, 0), 800) - least(greatest(y0, 0), 800), 0) / (600.0 * 800.0) AS share FROM i)
    SELECT doc_id, page, round(least(sum(share), 1.0), 9) AS image_coverage, round(max(share), 9) AS biggest_image, min(y0) AS first_y FROM a WHERE share >= 0.03 GROUP BY ALL""")
def image_scan(t: Tables) -> DataFrame:
    x, y, q = (F.col("l_partkey") % 700).cast("double") - 60, (F.col("l_linenumber") * 90).cast("double") - 120, F.col("l_quantity").cast("double")
    images = t.lineitem.select(F.col("l_suppkey").cast("string").alias("doc_id"), F.col("l_orderkey").cast("int").alias("page"), x.alias("x0"), y.alias("y0"), (x + q * 5).alias("x1"), (y + q * 6).alias("y1"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))
    found = layout.image_coverage(images)
    return found.withColumn("image_coverage", F.round("image_coverage", 9)).withColumn("biggest_image", F.round("biggest_image", 9))


@query(r"""
    WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS text FROM documents),
    b AS (SELECT doc_id, CAST(floor(pos / 6) + 1 AS INTEGER) AS page, pos, text, pos % 6 * 100.0 + 40 <= 48 OR pos % 6 * 100.0 >= 552 AS margin,
                 trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS key FROM l),
    n AS (SELECT doc_id, count(DISTINCT page) AS of_pages FROM b GROUP BY 1),
    k AS (SELECT doc_id, key FROM b JOIN n USING (doc_id) WHERE margin GROUP BY doc_id, key, of_pages HAVING count(DISTINCT page) >= greatest(3, floor(of_pages * 0.4))),
    f AS (SELECT b.*, margin AND (k.key IS NOT NULL OR regexp_matches(text, '(?i)^\s*(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\s*$')) AS is_furniture FROM b LEFT JOIN k USING (doc_id, key))
    SELECT doc_id, page, CAST(count(*) FILTER (is_furniture) AS BIGINT) AS furniture, CAST(coalesce(sum(length(text)) FILTER (NOT is_furniture), 0) AS BIGINT) AS chars FROM f GROUP BY ALL""")
def page_chars(t: Tables) -> DataFrame:
    blocks, pages = paged_blocks(t)
    marked = layout.mark_furniture(blocks, pages).withColumn("chars", F.length("text"))
    count = marked.groupBy("doc_id", "page").agg(F.count_if("is_furniture").alias("furniture"))
    return layout.page_chars(marked.where("NOT is_furniture"), pages).join(count, ["doc_id", "page"])


@query("""WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, CAST(l_orderkey AS INTEGER) AS page, sum(CAST(l_quantity AS BIGINT)) AS chars,
                      least(sum(l_discount) FILTER (l_discount >= 0.03), 1.0) AS cover, max(l_discount) FILTER (l_discount >= 0.03) AS biggest FROM lineitem GROUP BY ALL),
    m AS (SELECT *, CASE WHEN chars < 40 AND cover >= 0.10 THEN 'full' WHEN chars >= 40 AND cover >= 0.12 AND biggest < 0.80 THEN 'figures' END AS mode FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mode = 'figures', page) - 1 AS place FROM m WHERE mode IS NOT NULL),
    r AS (SELECT doc_id, page, 'were not OCR''d: over the per-document OCR limit of 24 pages.' AS told FROM o WHERE place >= 24
          UNION ALL SELECT doc_id, page, CASE mode WHEN 'full' THEN 'look like scanned images with no text layer. OCR is not available, so their content cannot be searched.' ELSE 'contain images whose text is not indexed (OCR is not available).' END FROM o),
    g AS (SELECT doc_id, told, page, page - row_number() OVER (PARTITION BY doc_id, told ORDER BY page) AS g FROM (SELECT DISTINCT * FROM r)),
    i AS (SELECT doc_id, told, min(page) AS a, max(page) AS b FROM g GROUP BY doc_id, told, g)
    SELECT doc_id, 'Pages ' || string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ', ' ORDER BY a) || ' ' || told AS warning FROM i GROUP BY doc_id, told""")
def ocr_warnings(t: Tables) -> DataFrame:
    planned = ocr_plan.plan(lineitem_pages(t))
    return ocr_plan.warnings(ocr_plan.over_limit(planned)).unionByName(ocr_plan.warnings_without_provider(planned))


@query("""WITH p AS (SELECT *, p_size % 2 = 0 AS heavy, p_size % 3 = 0 AS listed, split_part(p_name, ' ', 1) AS a, substr(p_name, length(split_part(p_name, ' ', 1)) + 2) AS b FROM part)
    SELECT p_brand AS doc_id, CAST(p_partkey AS INTEGER) AS pos,
           CASE WHEN listed THEN '1. ' || a || chr(10) || '- ' || b ELSE a || ' ' || b END AS text,
           2 AS n_lines, listed AS is_list, CAST(length(a) + length(b) + CASE WHEN listed THEN 4 ELSE 0 END AS INTEGER) AS chars,
           CASE WHEN length(a) >= length(b) THEN 9.5 ELSE 12.0 END::DOUBLE AS size,
           CASE WHEN heavy THEN length(a) + CASE WHEN listed THEN 2 ELSE 0 END ELSE 0 END / (length(a) + length(b) + CASE WHEN listed THEN 4 ELSE 0 END) >= 0.8 AS bold
    FROM p WHERE b <> '' AND a <> ''""")
def span_blocks(t: Tables) -> DataFrame:
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.expr("substr(p_name, length(split_part(p_name, ' ', 1)) + 2)")
    listed = F.col("p_size") % 3 == 0
    part = t.part.select("p_brand", "p_partkey", "p_size", listed.alias("listed"), a.alias("a"), b.alias("b")).where("a <> '' AND b <> ''")
    flags = F.when(F.col("p_size") % 2 == 0, 16).otherwise(0)
    span = lambda line, n, words, size, flag, font: F.struct(F.lit(line).alias("line"), F.lit(n).alias("span"), words.alias("text"), F.lit(size).alias("size"), flag.alias("flags"), F.lit(font).alias("font"))
    plain = F.lit(0)
    # A mark on a line of its own goes before the next line; the second line of a list begins with a dash.
    marked = F.array(span(0, 0, F.lit("1."), 9.6, flags, "Text"), span(1, 0, F.col("a"), 9.6, flags, "Text"), span(2, 0, F.concat(F.lit("- "), F.col("b")), 12.1, plain, "Text"))
    two = F.array(span(0, 0, F.col("a"), 9.4, flags, "Text"), span(0, 1, F.lit("  "), 30.0, plain, "Text-Bold"), span(1, 0, F.col("b"), 12.1, plain, "Text"))
    spans = part.select(F.col("p_brand").alias("doc_id"), F.lit(1).alias("page"), F.col("p_partkey").cast("int").alias("block"), F.inline(F.when(F.col("listed"), marked).otherwise(two)))
    box = [F.lit(float(v)).alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 1), ("y1", 1))]
    return adapters.blocks_from_spans(spans.select("*", *box)).select("doc_id", "pos", "text", "n_lines", "is_list", "chars", "size", "bold")


CHUNK_TABLE = """SELECT CAST(o_orderkey AS VARCHAR) AS chunk_id, o_custkey AS session_id, CAST(o_orderkey % 5 AS INTEGER) AS section_id, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey AS INTEGER) END AS seq,
    CAST(o_orderkey % 9 AS INTEGER) AS page, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 9 + 1 AS INTEGER) END AS page_start, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 9 + 2 AS INTEGER) END AS page_end,
    CASE WHEN o_orderkey % 3 = 0 THEN 'table' END AS chunk_type, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS breadcrumb FROM orders"""


@query(f"""WITH c AS ({CHUNK_TABLE}) SELECT chunk_id, session_id, section_id, seq, page, coalesce(page_start, page + 1) AS page_start, coalesce(page_end, page_start, page + 1) AS page_end,
    coalesce(chunk_type, 'text') AS chunk_type, coalesce(breadcrumb, '') AS breadcrumb, CAST(row_number() OVER (ORDER BY seq NULLS LAST, chunk_id) AS INTEGER) AS place FROM c
    WHERE session_id = 7 AND section_id IN (SELECT section_id FROM c WHERE session_id = 7 AND chunk_type = 'table')""")
def chunk_scan(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("lodestack_orders")
    chunks = t.spark.sql(CHUNK_TABLE.replace("VARCHAR", "STRING").replace("FROM orders", "FROM lodestack_orders"))
    mine = tables.session_chunks(tables.section_chunks(chunks, chunks.where("chunk_type = 'table'").select("session_id", "section_id").distinct()), 7)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("seq").asc_nulls_last(), "chunk_id"))
    return tables.chunk_rows(mine).withColumn("place", place)


@query(f"""WITH c AS ({CHUNK_TABLE}) SELECT chunk_id, to_json({{'chunk_id': chunk_id, 'page': page_start - 1, 'breadcrumb': nullif(breadcrumb, '')}}) AS json FROM c WHERE chunk_id IN (SELECT chunk_id FROM c WHERE session_id <= 20)""")
def chunk_json(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("lodestack_orders")
    chunks = t.spark.sql(CHUNK_TABLE.replace("VARCHAR", "STRING").replace("FROM orders", "FROM lodestack_orders"))
    ids = chunks.where("session_id <= 20").select("chunk_id")
    stored = tables.chunk_sink(chunks.join(ids, "chunk_id", "left_semi")).select("chunk_id", "page", "breadcrumb")
    return tables.to_json(stored).withColumn("chunk_id", F.get_json_object("json", "$.chunk_id"))


@query("""WITH a AS (SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS token_hash, o_custkey AS user_id, o_orderdate + INTERVAL 7 DAY AS expires_at, o_orderkey FROM orders)
    SELECT token_hash, user_id, expires_at FROM a WHERE expires_at > TIMESTAMP '1995-01-01' AND o_orderkey % 3 <> 0 AND token_hash <> sha256('1')
    UNION ALL SELECT sha256('new' || c_custkey), c_custkey, TIMESTAMP '1999-01-01' FROM customer""")
def token_changes(t: Tables) -> DataFrame:
    there = t.orders.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("token_hash"), F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))
    gone = t.orders.where("o_orderkey % 3 = 0").select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("token_hash"))
    issued = t.customer.select(F.sha2(F.concat(F.lit("new"), F.col("c_custkey")), 256).alias("token_hash"), F.col("c_custkey").alias("user_id"), F.expr("TIMESTAMP_NTZ '1999-01-01 00:00:00'").alias("expires_at"))
    return history.rotate_tokens(history.revoke_token(there, "1"), gone, issued, F.expr("TIMESTAMP_NTZ '1995-01-01 00:00:00'"))


@query("""SELECT s_suppkey AS id, s_name AS name, 'm' || (s_suppkey % 50) AS email FROM supplier WHERE s_suppkey <= 50
    UNION ALL SELECT -n_nationkey - 1, n_name, 'n' || n_nationkey FROM nation""")
def user_inserts(t: Tables) -> DataFrame:
    there = t.supplier.where("s_suppkey <= 50").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("m"), F.col("s_suppkey") % 50).alias("email"))
    new = t.nation.select((-F.col("n_nationkey") - 1).cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("email"))
    taken = t.supplier.select((F.col("s_suppkey") + 100_000).alias("id"), F.lit("late").alias("name"), F.concat(F.lit("m"), F.col("s_suppkey") % 50).alias("email"))
    return history.insert_users(there, new.unionByName(taken))  # whose addresses are all taken


@query("""SELECT conv_id AS session_id, turn AS sequence, role, text AS content FROM conversations
    UNION ALL SELECT o_orderkey, 1000 + r, CASE r WHEN 0 THEN 'user' ELSE 'assistant' END, o_orderpriority FROM orders, range(2) t(r)""")
def save_turns(t: Tables) -> DataFrame:
    said = t.conversations.select(F.col("conv_id").alias("session_id"), F.col("turn").cast("long").alias("sequence"), "role", F.col("text").alias("content"))
    both = F.array(F.struct(F.lit(1000).cast("long").alias("sequence"), F.lit("user").alias("role")), F.struct(F.lit(1001).cast("long").alias("sequence"), F.lit("assistant").alias("role")))
    turn = t.orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("content"), F.inline(both))
    return history.save_turn(said, sessions(t), turn)


@query(r"""SELECT c_custkey, length(trim(c_name)) > 0 AND c_custkey % 4 > 0 AS name_ok, c_custkey % 20 BETWEEN 12 AND 128 AS password_ok, c_custkey % 5 > 0 AS asked, round_even(c_acctbal / 7, 3) AS elapsed,
    CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey ELSE c_custkey % 9 || ':' || sha256(c_name) END AS key, least(150 / 72, 1800 / greatest(612.0, c_custkey * 10.0)) AS zoom FROM customer""")
def account_rules(t: Tables) -> DataFrame:
    n = F.col("c_custkey")
    return t.customer.select(
        "c_custkey", text.valid_name(F.when(n % 4 > 0, F.col("c_name")).otherwise("  ")).alias("name_ok"), text.valid_password(F.repeat(F.lit("x"), (n % 20).cast("int"))).alias("password_ok"),
        text.asked(F.when(n % 5 > 0, F.col("c_name")).otherwise(" \n")).alias("asked"), text.elapsed(F.col("c_acctbal") / 7).alias("elapsed"),
        text.document_key(F.when(n % 2 == 0, F.concat(F.lit("c"), n)), (n % 9).cast("int"), F.col("c_name")).alias("key"), geometry.render_zoom(F.lit(612.0), n * 10.0).alias("zoom"),
    )


@query("""WITH o AS (SELECT o_custkey, count(*) AS entries, count(*) FILTER (o_orderkey % 2 = 0) AS found FROM orders GROUP BY 1) SELECT o_custkey AS doc_id FROM o WHERE entries >= 3 AND found / entries >= 0.5""")
def outline_trust(t: Tables) -> DataFrame:
    outline = t.orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("entry"))
    return structure.trusted_outlines(outline.where("entry % 2 = 0"), outline)


@query("""SELECT 'all' AS kind, count(*) AS sessions FROM orders UNION ALL SELECT 'mine', count(*) FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'one', count(*) FROM orders WHERE o_custkey = 7 AND o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_custkey = 7)""")
def session_totals(t: Tables) -> DataFrame:
    rows = sessions(t)
    first = rows.where("user_id = 7").agg(F.min("session_id").alias("session_id"))
    mine = rows.join(first, "session_id", "left_semi")
    named = lambda kind, n: n.select(F.lit(kind).alias("kind"), "sessions")
    return named("all", history.session_count(rows)).unionByName(named("mine", history.session_count(rows, 7))).unionByName(named("one", history.session_count(mine, 7)))


@query(r"""WITH p AS (SELECT CAST(page_id AS VARCHAR) AS doc_id, len(regexp_extract_all(html, '(?s)<(h[1-6])>(.*?)</h[1-6]>')) AS sections FROM pages)
    SELECT doc_id, 1 AS pages, CAST(sections AS BIGINT) AS sections, CAST(0 AS BIGINT) AS tables FROM p""")
def ingest_summary(t: Tables) -> DataFrame:
    _, summary = flows.ingest(structure.assemble(page_items(t)))
    return summary.select("doc_id", "pages", "sections", "tables")
