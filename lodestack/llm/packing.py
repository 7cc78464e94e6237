"""Packing: optimal length buckets and token-budget batches.

Sequences are whole texts, or pieces of at most ``max_len`` tokens of longer ones, so
the global histogram of lengths has at most ``max_len`` entries. Dynamic programming
over it picks the bucket boundaries with the least padding. Inside a bucket, batches
take as many sequences as the token budget allows at the bucket's length. A row carries its
sequence's text; the pieces of a text, put together in order, are the text.

Tokens are words (runs between white space), counted by DataFrame functions, or those of a
tokenizer, counted through the digest cache of ``tokencount``. A text beyond ``max_len``
tokens is then cut between its words, and the words of a piece are as many as fit.

A bucket's sequences are dealt by hash to shards of about ``shard_batches`` batches, and
each shard forms its batches alone, so no task holds a bucket. Only a shard's last
batch can be short of sequences.

Edge cases: a null or empty text has no tokens, one row of length 0 and no bucket or
batch; a long text gives one row per piece; a word of more than ``max_len`` tokens is cut
inside; repeated rows are separate sequences, told apart by ``copy``; rows with a null id are
dealt by their place in the input; an empty table gives no rows; columns of the input other than doc_id
and text aren't read, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import map_texts, materialize
from lodestack.llm.mixing import word_count

MAX_LEN, BUCKETS, BUDGET, SHARD_BATCHES = 2048, 16, 16_384, 64


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Ends of at most ``buckets`` ranges of lengths with the least padding, in order.

    ``lengths`` ascend and are distinct. The cost of the range i..j is
    lengths[j] * sequences - tokens; it satisfies the quadrangle inequality, so the best
    split of a row of the table moves one way and is found by divide and conquer.
    """
    n = len(lengths)
    if not n:
        return []
    lengths = np.asarray(lengths, np.int64)
    seqs = np.r_[0, np.cumsum(counts, dtype=np.int64)]
    tokens = np.r_[0, np.cumsum(np.asarray(counts, np.int64) * lengths)]
    far = np.iinfo(np.int64).max // 4
    best = np.full(n + 1, far)
    best[0] = 0
    splits = []
    for _ in range(min(buckets, n)):
        row, split = np.full(n + 1, far), np.zeros(n + 1, np.int64)
        row[0] = 0
        todo = [(1, n, 0, n - 1)]
        while todo:
            low, high, left, right = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(left, min(j - 1, right) + 1)
            cost = best[i] + lengths[j - 1] * (seqs[j] - seqs[i]) - (tokens[j] - tokens[i])
            at = int(cost.argmin())
            row[j], split[j] = cost[at], i[at]
            todo += [(low, j - 1, left, i[at]), (j + 1, high, i[at], right)]
        splits.append(split)
        best = row
    ends, j = [], n
    for split in reversed(splits):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(split[j])
    return ends[::-1]


#: A word with the white space behind it; the first one with the white space before it as well.
WORD_AND_SPACE = r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"
PIECE = "array<struct<start:bigint,length:bigint,text:string>>"


def word_sequences(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """doc_id, n_tokens, piece, start, length, text: each text whole or in pieces of ``max_len`` words."""
    rows = docs.select(docs["doc_id"], docs["text"].alias("text"), word_count(docs["text"]).alias("n_tokens"))

    def cut(words: Column) -> Column:
        piece = lambda i: F.struct(
            (i * max_len).cast("long").alias("start"),
            F.least(F.lit(max_len).cast("long"), F.col("n_tokens") - i * max_len).alias("length"),
            F.array_join(F.slice(words, (i * max_len + 1).cast("int"), F.lit(max_len)), "").alias("text"),
        )
        return F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n_tokens") / max_len) - 1), piece)

    # Inside a lambda the words are found once, not for each piece.
    long = F.get(F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD_AND_SPACE), F.lit(0))), cut), F.lit(0))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_tokens").alias("length"), F.col("text")))
    pieces = F.when(F.col("n_tokens") > max_len, long.cast(PIECE)).otherwise(whole.cast(PIECE))
    return rows.select("doc_id", "n_tokens", F.posexplode(pieces).alias("piece", "s")).select("doc_id", "n_tokens", "piece", "s.*")


def cut_at_words(text: str, count, max_len: int) -> list[str]:
    """Parts of at most ``max_len`` tokens by ``count`` (of a list of texts), between words where that is possible."""
    if count([text])[0] <= max_len or len(text) < 2:
        return [text]
    words = re.findall(WORD_AND_SPACE, text)
    if len(words) < 2:
        half = len(text) // 2
        parts = [text[:half], text[half:]]
    else:
        cuts, size = [0], 0
        for i, n in enumerate(count(words)):
            if i > cuts[-1] and size + n > max_len:
                cuts.append(i)
                size = 0
            size += n
        # The tokens of a part can be more than those of its words; it is cut again then.
        cuts = cuts if len(cuts) > 1 else [0, len(words) // 2]
        parts = ["".join(words[i:j]) for i, j in zip(cuts, [*cuts[1:], len(words)])]
    return [y for x in parts for y in cut_at_words(x, count, max_len)]


def token_parts(text: str, count, max_len: int) -> tuple[list[str], list[int]]:
    """Parts of at most ``max_len`` tokens that are the text, put together, and their tokens."""
    found = count.parts(text)
    if found is None:
        parts = cut_at_words(text, count, max_len)
        return parts, count(parts)
    parts, lengths, held, size = [], [], [], 0
    for piece, n in zip(*found):
        if held and size + n > max_len:
            parts.append("".join(held))
            lengths.append(size)
            held, size = [], 0
        if n > max_len:
            cut = cut_at_words(piece, count, max_len)
            parts += cut
            lengths += count(cut)
            continue
        held.append(piece)
        size += n
    if held or not parts:
        parts.append("".join(held))
        lengths.append(size)
    return parts, lengths


def token_sequences(docs: DataFrame, tokenizer: str, max_len: int = MAX_LEN, cache: str | None = None) -> DataFrame:
    """As ``word_sequences``, with the tokens of ``tokenizer``; counts come through the digest cache."""
    from lodestack.llm import tokencount

    rows = tokencount.counted(docs, [docs["doc_id"], docs["text"].alias("text")], cache, tokenizer)

    def make():
        count = tokencount.counter(tokenizer)

        def function(texts):
            return [list(x) for x in zip(*(token_parts(t, count, max_len) for t in texts))]

        return function

    fields = [T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("lengths", T.ArrayType(T.LongType()))]
    long = map_texts(rows.where(F.col("n_tokens") > max_len), ["doc_id", "n_tokens"], fields, make)
    long = long.select("doc_id", "n_tokens", "lengths", F.posexplode("parts").alias("piece", "text"))
    before = F.aggregate(F.slice("lengths", F.lit(1), F.col("piece")), F.lit(0).cast("long"), lambda a, x: a + x)
    long = long.select("doc_id", "n_tokens", "piece", before.alias("start"), F.get("lengths", F.col("piece")).alias("length"), "text")
    zero = F.lit(0)
    short = rows.where(F.col("n_tokens") <= max_len).select("doc_id", "n_tokens", zero.alias("piece"), zero.cast("long").alias("start"), F.col("n_tokens").alias("length"), "text")
    return short.unionByName(long)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    max_len: int = MAX_LEN,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
    shard_batches: int = SHARD_BATCHES,
) -> DataFrame:
    """A row per sequence: doc_id, n_tokens, piece, start, length, text, bucket, bucket_len, shard, batch, slot, copy, padding.

    ``tokenizer``: a file of public_tokenizers; without it words are counted. ``batch`` numbers
    a shard's batches and ``slot`` the places in a batch; bucket, shard and batch together name a batch.
    ``copy`` counts equal sequences of one doc_id from 0.
    """
    if tokenizer is None:
        found = word_sequences(docs, max_len)
        n = word_count(docs["text"])  # of whole texts: no piece is made for the histogram
        whole, rest = F.floor(n / max_len), n % max_len
        lengths = F.array(F.struct(F.lit(max_len).cast("long").alias("length"), whole.alias("times")), F.struct(rest.alias("length"), F.lit(1).cast("long").alias("times")))
        counted = docs.select(F.inline(lengths)).where("length > 0 AND times > 0").groupBy("length").agg(F.sum("times").alias("count"))
    else:
        found = materialize(token_sequences(docs, tokenizer, max_len), "sequences")
        counted = found.where("length > 0").groupBy("length").count()
    histogram = counted.orderBy("length").collect()  # max_len rows at most
    lengths, counts = [r["length"] for r in histogram], [r["count"] for r in histogram]
    ends = boundaries(np.array(lengths, np.int64), np.array(counts, np.int64), buckets)
    at = np.searchsorted(ends, lengths) if ends else np.zeros(0, int)
    sizes = np.bincount(at, counts, len(ends)) if ends else []
    room = [max(1, budget // e) for e in ends]
    shards = [max(1, -(-int(s) // (r * shard_batches))) for s, r in zip(sizes, room)]
    pick = lambda values, kind="int": (F.element_at(F.array(*[F.lit(v) for v in values]), F.col("bucket") + 1) if values else F.lit(None)).cast(kind)
    bucket = F.lit(None).cast("int")
    for k, e in reversed(list(enumerate(ends))):
        bucket = F.when(F.col("length") <= e, F.lit(k)).otherwise(bucket)
    placed = found.withColumn("bucket", F.when(F.col("length") > 0, bucket)).withColumn("bucket_len", pick(ends, "long"))
    salt = F.xxhash64("doc_id", "piece", "n_tokens", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    placed = placed.withColumn("shard", F.pmod(salt, pick(shards, "long")).cast("int")).withColumn("__text", F.xxhash64("text"))
    # Rows without a bucket need no place in one, so they don't meet in one task.
    order = Window.partitionBy("bucket", "shard").orderBy("doc_id", "piece", "__text")
    same = Window.partitionBy("bucket", "shard", "doc_id", "piece", "__text").orderBy("bucket")
    rows = placed.where("bucket IS NOT NULL").withColumn("__row", F.row_number().over(order) - 1).withColumn("copy", F.row_number().over(same) - 1)
    rows = rows.withColumn("batch", F.floor(F.col("__row") / pick(room)).cast("int")).withColumn("slot", (F.col("__row") % pick(room)).cast("int"))
    none = F.lit(None).cast("int")
    rest = placed.where("bucket IS NULL").withColumn("copy", none).withColumn("batch", none).withColumn("slot", none)
    out = rows.drop("__row").unionByName(rest).withColumn("padding", F.col("bucket_len") - F.col("length"))
    return out.select("doc_id", "n_tokens", "piece", "start", "length", "text", "bucket", "bucket_len", "shard", "batch", "slot", "copy", "padding")
