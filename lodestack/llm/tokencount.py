"""Token counts with a digest cache.

The cache is a table of content digest, tokenizer digest and count in the shared folder, and
stays there: later calls encode only texts that no call before has seen.
Texts are joined to it by both digests; each distinct text without a count is encoded once,
and the new counts are appended. The content digest is SHA-256 of the text with null read
as empty; nothing else may be normalised, since counts depend on every character.

Inside a task, counts of pieces between white space are kept too: a pre-tokenizer of the
byte-level kind never joins characters across such a border, so a text's count is the sum
of its pieces' counts, which the library gives. Texts with special strings or unusual
white space go to the library whole.

Edge cases: an empty text has no tokens; texts are encoded whole; repeated rows and copies
are encoded once and each gets the count; an empty table gives no rows and appends
nothing; other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import hadoop_path, map_texts, shared_dir, tokenizer_file

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Pieces between borders: a space belongs to the word behind it, of longer white space the last character.
PIECE = re.compile(r" ?[^\s]+|\s+(?!\S)|\s")
#: White space on which libraries differ, and control characters.
UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
SCHEMA = "content string, tokenizer string, n_tokens long"


class Counts(dict):
    """Token counts of pieces, from the library when first asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def fill(self, pieces: list[str]) -> None:
        new = list({p for p in pieces if p not in self})
        if len(self) + len(new) > 400_000:
            self.clear()
            new = list(set(pieces))
        if new:
            self.update(zip(new, map(len, self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))


@functools.lru_cache(maxsize=8)
def loaded(path: str, version: tuple[int, int]):
    """The library's tokenizer of a file, with its special strings and whether counts of pieces add up.

    A worker process keeps it for all its tasks: what the library has cached for a tokenizer stays behind
    when that is dropped, so one for each task would make the worker grow with its tasks. ``version``: the
    file's time and size.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path), [], False
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    special = [x["content"] for x in made.get("added_tokens", [])]
    steps = made.get("pre_tokenizer") or {}
    by_piece = steps.get("type") == "ByteLevel" and not steps.get("add_prefix_space") and steps.get("use_regex", True) and not made.get("normalizer")
    return tokenizer, special, by_piece


def counter(name: str = TOKENIZER):
    """A function from texts to the library's token counts.

    Its ``parts(text)`` gives pieces that are the text, put together, with their counts, which add up to
    the count of any run of pieces; None where the tokenizer or the text has no such pieces.
    """
    import os

    path = tokenizer_file(name)
    stat = os.stat(path)
    tokenizer, special, by_piece = loaded(path, (stat.st_mtime_ns, stat.st_size))
    if name.endswith(".model"):

        def whole(texts):
            return [len(x) for x in tokenizer.encode(texts, num_threads=1)]

        whole.parts = lambda text: None
        return whole
    memo = Counts(tokenizer)

    def parts(text):
        if not by_piece or UNUSUAL.search(text) or any(s in text for s in special):
            return None
        pieces = PIECE.findall(text)
        try:
            return pieces, [memo[p] for p in pieces]
        except KeyError:
            memo.fill(pieces)
            return pieces, [memo[p] for p in pieces]

    def function(texts):
        return [sum(found[1]) if (found := parts(t)) else len(tokenizer.encode_batch_fast([t], add_special_tokens=False)[0]) for t in texts]

    function.parts = parts
    return function


def tokenizer_digest(name: str = TOKENIZER) -> str:
    """SHA-256 of the tokenizer's file and of how it is called."""
    with open(tokenizer_file(name), "rb") as file:
        return hashlib.sha256(file.read() + b"|no special tokens added|no truncation|no padding").hexdigest()


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows; none if there is no cache yet."""
    store, path = hadoop_path(spark, cache)
    return spark.read.schema(SCHEMA).parquet(cache) if store.exists(path) else spark.createDataFrame([], SCHEMA)


def counted(docs: DataFrame, columns: list[Column], cache: str | None = None, tokenizer: str = TOKENIZER) -> DataFrame:
    """``columns`` of ``docs``, content (digest) and n_tokens; a row per row of ``docs``.

    ``cache``: where counts are kept between calls; by default one place in the shared folder for each
    tokenizer digest.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    cache = cache or f"{shared_dir(spark)}/lodestack-token-counts-{version[:16]}"
    text = F.coalesce(docs["text"], F.lit(""))
    content = F.sha2(text.cast("binary"), 256)
    rows = docs.select(docs["doc_id"], content.alias("content"), text.alias("text"))
    known = cached(spark, cache).where(F.col("tokenizer") == version).select("content")
    # Copies meet once per task before the exchange, and once per digest behind it.
    misses = rows.select("content", "text").join(known.distinct(), "content", "left_anti").groupBy("content").agg(F.first("text").alias("text"))

    def make():
        count = counter(tokenizer)
        return lambda texts: [[version] * len(texts), count(texts)]

    new = map_texts(misses, ["content"], [T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())], make)
    new.write.mode("append").parquet(cache)
    counts = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    rows = docs.select(*columns, content.alias("__content"))
    return rows.join(counts, F.col("__content") == F.col("content")).drop("__content")


def token_counts(docs: DataFrame, cache: str | None = None, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, content; a row per row of ``docs``. ``cache`` as in ``counted``."""
    n_bytes = F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long")  # before the join, which texts don't pass
    rows = counted(docs, [docs["doc_id"], n_bytes.alias("n_bytes")], cache, tokenizer)
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content")
