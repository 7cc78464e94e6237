"""Text functions as columns. ``nfkc`` alone needs Python; all else is built in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lodestack import schemas

# Fixed values of the domain: page numbers, marks of list items, captions, ends and breaks of sentences, markdown.
# Python and the JVM both read these patterns; \s, \d and \w stand for Unicode's classes (see ``wide``).
PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\s*$"
_MARK = r"(?:[•●▪◦‣∙·\-–—*]|\d{1,3}[.)]|\(\d{1,3}\)|[a-z]\)|\([a-z]\))"
LIST_MARK = rf"^\s*{_MARK}\s+"
MARK_ONLY = rf"^\s*{_MARK}\s*$"
CAPTION = r"(?i)^(?:table|tab\.|figure|fig\.|chart|exhibit)\s*[A-Z]?\d+"
CAPTION_SEPARATED = r"(?i)^(?:table|tab\.|figure|fig\.|chart|exhibit)\s*[A-Z]?\d+[a-z]?\s*[.:–—-]"
CAPTION_CHARS = 300
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9\"“(\[])"
SENTENCE_FINAL = r"[.!?…\"”’]$"
MD_HEADING = r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$"
MD_RULE_CELL = r"^:?-{2,}:?$"
MD_EMPHASIS = r"[*_`]+"
MD_FENCE = r"(?s)^```(?:markdown|md)?\s*\n(.*?)\n?```$"
FIGURE_LABEL = "[Text and data from a figure/image on this page]\n"


def wide(pattern: str) -> str:
    """The pattern for the JVM with Unicode's classes, as Python reads it."""
    return f"(?U){pattern}"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, wide(r"^\s+|\s+$"), "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which the JVM functions lack."""
    return text.str.normalize("NFKC")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def nfkc_cells(rows: pd.Series) -> pd.Series:
    """``nfkc`` of each cell of a grid; null cells are empty."""
    cell = lambda c: c if c.isascii() else unicodedata.normalize("NFKC", c)
    return rows.map(lambda r: None if r is None else [[cell(c or "") for c in x] if x is not None else [] for x in r])


def squeeze(text: Column) -> Column:
    """``clean`` without the normalisation: exact for text that NFKC leaves alone."""
    bare = F.regexp_replace(text, "[\\x{00AD}\\x{0000}]", "")
    return strip(F.regexp_replace(bare, "[ \\t\\x{00A0}]+", " "))


def clean(text: Column) -> Column:
    """NFKC, no soft hyphens or NULs, single spaces, stripped."""
    return squeeze(nfkc(text))


def join_lines(lines: Column) -> Column:
    """Wrapped lines as one string; a hyphen between a letter and a small letter goes."""

    def add(so_far: Column, line: Column) -> Column:
        broken = so_far.rlike("\\p{L}-$") & line.rlike("^\\p{Ll}")
        return F.when(so_far == "", line).when(broken, F.concat(F.substring(so_far, F.lit(1), F.length(so_far) - 1), line)).otherwise(F.concat(so_far, F.lit(" "), line))

    return F.aggregate(lines, F.lit("").cast("string"), add)


def norm_title(text: Column) -> Column:
    """Lower-case words of a title (NFKC) with single spaces between."""
    return F.trim(F.regexp_replace(F.lower(nfkc(text)), wide(r"[\W_]+"), " "))


def half_points(size: Column) -> Column:
    """Nearest half with ties to even."""
    return F.bround(size * 2) / 2


def furniture_key(text: Column) -> Column:
    """Lower case, numbers as #, single spaces, stripped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), wide(r"\d+"), "#"), wide(r"\s+"), " "))


def is_page_number(text: Column) -> Column:
    return text.rlike(wide(PAGE_NUMBER))


def is_list_item(text: Column) -> Column:
    return text.rlike(wide(LIST_MARK))


def is_mark_only(text: Column) -> Column:
    return text.rlike(wide(MARK_ONLY))


def is_caption(text: Column, separated: bool = False) -> Column:
    return text.rlike(wide(CAPTION_SEPARATED)) & (F.length(text) <= CAPTION_CHARS) if separated else text.rlike(wide(CAPTION))


def continues(previous: Column, text: Column) -> Column:
    """Whether ``text`` goes on with the paragraph before: a small letter, and no sentence end (a hyphen is none) before it."""
    return F.coalesce(~F.rtrim(previous).rlike(SENTENCE_FINAL) & text.rlike("^\\p{Ll}"), F.lit(False))


def sentences(text: Column) -> Column:
    """Sentences: cut at white space behind . ! ? and before a capital, a digit or an opening mark."""
    return F.split(text, wide(SENTENCE_BREAK))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers; other letters cut words."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def strip_fence(text: Column) -> Column:
    """The content of a ``` fence (with md or markdown behind it or nothing), also an empty one, else the text, stripped."""
    bare = strip(text)
    return F.when(bare.rlike(wide(MD_FENCE)), F.regexp_extract(bare, wide(MD_FENCE), 1)).otherwise(bare)


def markdown_title(line: Column) -> Column:
    """Title of a # heading's line without emphasis marks and closing #; it may be empty."""
    return clean(F.regexp_replace(F.regexp_extract(line, wide(MD_HEADING), 2), MD_EMPHASIS, ""))


def markdown_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, wide(MD_HEADING), 1))


def markdown_headings(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` without ``text``, with line, level and title of each # heading that has a title."""
    lines = F.split(strip_fence(F.col(text)), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
    found = rows.select(*[c for c in rows.columns if c != text], F.posexplode(lines).alias("line", "__line")).where(F.col("__line").rlike(wide(MD_HEADING)))
    return found.withColumn("level", markdown_level(F.col("__line"))).withColumn("title", markdown_title(F.col("__line"))).drop("__line").where("title <> ''")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside lambdas a column would be computed at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_grid(rows: Column) -> Column:
    """Cells on one line with pipes escaped; no empty rows or columns; rows padded on the right."""
    cell = lambda c: F.replace(squeeze(F.replace(c, F.lit("\n"), F.lit(" "))), F.lit("|"), F.lit("\\|"))
    filled = F.filter(F.transform(nfkc_cells(rows), lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    # The columns with text, as an array of flags that grows with the widest row.
    flags = lambda grid: F.aggregate(grid, F.array().cast("array<boolean>"), lambda a, r: F.zip_with(a, r, lambda x, c: F.coalesce(x, F.lit(False)) | F.coalesce(c != "", F.lit(False))))
    kept = lambda grid, some: F.transform(grid, lambda r: F.transform(F.filter(F.zip_with(some, r, lambda x, c: F.struct(x.alias("x"), F.coalesce(c, F.lit("")).alias("c"))), lambda z: z["x"]), lambda z: z["c"]))
    return let(filled, lambda grid: let(flags(grid), lambda some: kept(grid, some)))


def is_real_table(grid: Column) -> Column:
    """Of a clean grid: two rows and two columns at least, and 30 % of the cells filled."""
    cells = F.flatten(grid)
    return (F.size(grid) >= 2) & (F.size(F.get(grid, F.lit(0))) >= 2) & (F.size(F.filter(cells, lambda c: c != "")) >= 0.3 * F.size(cells))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def render_table(grid: Column, caption: Column | None = None, continued: bool = False) -> Column:
    """Markdown of a grid: caption, header, rule, body; ``continued`` marks a later piece."""
    head = F.get(grid, F.lit(0))
    rule = markdown_row(F.transform(head, lambda _: F.lit("---")))
    body = F.transform(F.slice(grid, 2, F.greatest(F.size(grid) - 1, F.lit(0))), markdown_row)
    label = F.trim(F.coalesce(caption if caption is not None else F.lit(""), F.lit("")))
    if continued:
        label = F.when(label != "", F.concat(label, F.lit(" (continued)"))).otherwise("(table continued)")
    return F.concat(F.when(label != "", F.concat(label, F.lit("\n\n"))).otherwise(""), F.array_join(F.concat(F.array(markdown_row(head), rule), body), "\n"))


def parse_markdown_table(lines: Column) -> Column:
    """Clean grid of markdown table lines: outer pipes off, cut at plain pipes, unescaped, without the rule."""
    inner = lambda x: F.regexp_replace(strip(x), r"^\||(?<!\\)\|$", "")
    cells = F.transform(lines, lambda x: F.transform(F.split(inner(x), r"(?<!\\)\|", -1), lambda c: F.replace(strip(c), F.lit("\\|"), F.lit("|"))))
    # A rule has a cell with text, and all such cells are dashes.
    rule = lambda r: F.exists(r, lambda c: c != "") & F.forall(r, lambda c: (c == "") | c.rlike(MD_RULE_CELL))
    return clean_grid(F.filter(cells, lambda r: ~rule(r)))


def contextualized(body: Column, breadcrumb: Column, page_start: Column, page_end: Column, kind: Column) -> tuple[Column, Column]:
    """(text with a ``[Section | Page | Table]`` prefix, length of the prefix); no parts, no prefix."""
    has_page = F.coalesce(page_start, F.lit(0)) != 0
    one = F.coalesce(page_end, page_start) == page_start
    page = F.when(has_page & one, F.concat(F.lit("Page "), page_start)).when(has_page, F.concat(F.lit("Pages "), page_start, F.lit("-"), page_end))
    parts = F.concat_ws(" | ", F.when(breadcrumb != "", F.concat(F.lit("Section: "), breadcrumb)), page, F.when(kind == "table", F.lit("Table")))
    prefix = F.when(parts == "", F.lit("")).otherwise(F.concat(F.lit("["), parts, F.lit("]\n\n")))
    return F.concat(prefix, body), F.length(prefix)


def valid_name(name: Column) -> Column:
    """1 to 80 characters, not white space alone."""
    return F.length(name).between(1, 80) & (strip(name) != "")


def valid_password(password: Column, new: bool = True) -> Column:
    """12 to 128 characters for a new account, 1 to 128 to sign in."""
    return F.length(password).between(12 if new else 1, 128)


def asked(question: Column) -> Column:
    """Whether a question holds more than white space."""
    return F.coalesce(strip(question) != "", F.lit(False))


def elapsed(seconds: Column) -> Column:
    """Seconds rounded to milliseconds, ties to even."""
    return F.bround(seconds, 3)


def document_key(chunk_id: Column, page: Column, content: Column) -> Column:
    """The chunk id, or for rows without one their page and the hash of their content."""
    other = F.concat(F.coalesce(page.cast("string"), F.lit("None")), F.lit(":"), F.sha2(content, 256))
    return F.coalesce(F.nullif(chunk_id, F.lit("")), other)


def new_id() -> Column:
    """A random UUID, another one for each row and run."""
    return F.uuid()


def sources_json(page: Column, page_end: Column, section: Column, kind: Column, excerpt: Column) -> Column:
    """A citation as an entry of a message's sources; collect and serialise them with ``to_json``."""
    return F.struct(page.cast("int").alias("page"), page_end.cast("int").alias("page_end"), section.alias("section"), kind.alias("type"), excerpt.alias("excerpt"))


def ocr_json(response: Column) -> Column:
    """Pages (page, markdown without its fence) of a model's JSON, an object with pages or a bare list; null if it is neither."""
    pages = F.coalesce(F.from_json(response, schemas.OCR_RESPONSE)["pages"], F.from_json(response, schemas.OCR_PAGES))
    bad = F.exists(pages, lambda p: p["page"].isNull())
    return F.when(~bad, F.transform(pages, lambda p: F.struct(p["page"].alias("page"), strip_fence(F.coalesce(p["markdown"], F.lit(""))).alias("markdown"))))


def valid_email(email: Column) -> Column:
    tidy = F.lower(strip(email))
    return tidy.rlike("^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$") & F.length(tidy).between(3, 254)


def retry_delay(message: Column) -> Column:
    """Seconds that an error text asks to wait; null if it names none."""
    low = F.lower(message)
    named = F.regexp_extract(low, "retrydelay\\W+(\\d+(?:\\.\\d+)?)s", 1)
    told = F.regexp_extract(low, "retry in (\\d+(?:\\.\\d+)?)\\s*s", 1)
    return F.when(named != "", named.cast("double")).when(told != "", told.cast("double"))


def error_action(code: Column, message: Column, exception: Column) -> Column:
    """retry, abort or fail for a provider's error."""
    low, delay = F.lower(F.coalesce(message, F.lit(""))), retry_delay(message)
    name = F.lower(F.coalesce(exception, F.lit("")))
    return (
        F.when((code == 429) & (F.regexp_replace(low, "[ _]", "").contains("perday") | low.contains("daily")), "abort")
        .when((code == 429) & (delay > 90), "abort")
        .when(code.isin(429, 500, 502, 503, 504), "retry")
        .when(code.isin(401, 403, 404), "abort")
        .when(name.rlike("timeout|connect"), "retry")
        .otherwise("fail")
    )


def backoff(delay: Column, attempt: Column) -> Column:
    return F.least(F.coalesce(delay, 5 * F.pow(F.lit(2.0), attempt)), F.lit(90.0))


def date_bucket(ts: Column, now: Column) -> Column:
    """Today, Yesterday, Previous 7 days or Earlier, by the midnight before ``now``."""
    day = F.date_trunc("day", now)
    return (
        F.when(ts >= day, "Today")
        .when(ts >= day - F.expr("INTERVAL 1 DAY"), "Yesterday")
        .when(ts >= day - F.expr("INTERVAL 7 DAYS"), "Previous 7 days")
        .otherwise("Earlier")
    )
