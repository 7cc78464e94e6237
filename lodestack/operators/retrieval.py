"""Retrieval: BM25 over postings, exact vector search, reciprocal-rank fusion, reranking, the hybrid of all."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lodestack.config import RetrievalConfig
from lodestack.functions.text import document_key, tokens
from lodestack.storage import materialize

CONFIG = RetrievalConfig()
#: Questions that tasks hold at once; more of them take turns. Chunks that are scored against a block at once.
QUESTIONS, CHUNKS = 4096, 512


def postings(chunks: DataFrame, text: str = "content") -> DataFrame:
    """session_id, chunk_id, seq, terms: what BM25 needs of each chunk; worth writing once."""
    return chunks.select("session_id", "chunk_id", "seq", tokens(F.col(text)).alias("terms"))


def corpus(chunks: DataFrame, text: str = "content") -> DataFrame:
    """session_id, n, avgdl: chunks of a session and their mean length, from postings or from chunks."""
    terms = F.col("terms") if "terms" in chunks.columns else tokens(F.col(text))
    return chunks.select("session_id", F.size(terms).alias("dl")).groupBy("session_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def inverse_frequencies(posts: DataFrame, stats: DataFrame, config: RetrievalConfig = CONFIG) -> DataFrame:
    """session_id, term, idf, avgdl: ln(N - df + 0.5) - ln(df + 0.5), a negative one raised to epsilon times the mean."""
    df = posts.select("session_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("session_id", "term").agg(F.count("*").alias("df"))
    raw = df.join(stats, "session_id").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("session_id").agg(F.avg("raw").alias("mean"))
    return raw.join(mean, "session_id").select("session_id", "term", F.when(F.col("raw") < 0, config.epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"), "avgdl")


def top(rows: DataFrame, k: int, *order: Column, key: str = "query_id") -> DataFrame:
    """The first k rows of each query in the given order, with rank from 0."""
    numbered = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.where(F.col("__n") <= k).withColumn("rank", F.col("__n") - 1).drop("__n")  # this filter becomes a group limit


def question_blocks(queries: DataFrame, columns: list[str]) -> Iterator[list]:
    """The rows of ``queries`` in blocks of about ``QUESTIONS``, dealt by hash; the blocks are read one by one."""
    blocks = max(1, -(-queries.count() // QUESTIONS))
    for i in range(blocks):
        yield queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).select(*columns).collect()


def bm25(posts: DataFrame, stats: DataFrame, queries: DataFrame, k: int = CONFIG.candidates, config: RetrievalConfig = CONFIG) -> DataFrame:
    """query_id, chunk_id, seq, score, rank: top k, then without scores of 0 or less; ties by seq.

    ``queries``: query_id, session_id, text. A term asked twice counts twice. Questions go to the chunks
    in blocks: a task scores its chunks against a block's terms and keeps k chunks a question of each
    slice, so no posting is shuffled and a common term meets no other task.
    """
    asked = queries.select("query_id", "session_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "session_id", "term").agg(F.count("*").alias("times"))
    weighed = materialize(asked.join(inverse_frequencies(posts, stats, config), ["session_id", "term"]).select("query_id", "session_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "avgdl"), "weights")
    kinds = dict(queries.dtypes) | {"chunk_id": dict(posts.dtypes)["chunk_id"], "seq": dict(posts.dtypes)["seq"]}
    shape = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, seq {kinds['seq']}, score double"
    found = None
    blocks = max(1, -(-queries.count() // QUESTIONS))
    for i in range(blocks):
        mine = weighed.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).toPandas()
        part = posts.mapInArrow(bm25_scan(posts, mine, k, config, shape), shape)
        found = part if found is None else found.unionByName(part)
    return top(found, k, F.col("score").desc(), F.col("seq").asc_nulls_last(), F.col("chunk_id"))


def bm25_scan(posts: DataFrame, weights, k: int, config: RetrievalConfig, shape: str) -> Callable:
    """A function from batches of postings to their k best (query_id, chunk_id, seq, score) per slice for the questions of ``weights``."""
    by_session = {}
    for session, part in weights.groupby("session_id", sort=False, dropna=False):
        ids, terms = part["query_id"].unique(), {}
        row = {q: i for i, q in enumerate(ids)}
        for q, term, w in zip(part["query_id"], part["term"], part["weight"]):
            terms.setdefault(term, ([], []))[0].append(row[q])
            terms[term][1].append(w)
        by_session[session] = (ids, float(part["avgdl"].iloc[0]), {x: (np.array(r), np.array(w)) for x, (r, w) in terms.items()})
    shared = posts.sparkSession.sparkContext.broadcast(by_session)
    columns = [posts.columns.index(c) for c in ("session_id", "chunk_id", "seq", "terms")]
    arrow = to_arrow_schema(_parse_datatype_string(shape))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sessions = batch.column(columns[0]).to_pylist()
            for start in range(0, batch.num_rows, CHUNKS):
                part = batch.slice(start, CHUNKS)
                lists = part.column(columns[3])
                sizes = np.diff(lists.offsets.to_numpy())
                words = lists.flatten().dictionary_encode()
                names = words.dictionary.to_pylist()
                owner, term = np.repeat(np.arange(part.num_rows), sizes), words.indices.to_numpy()
                pair, tf = np.unique(term.astype(np.int64) * part.num_rows + owner, return_counts=True)
                term, owner = pair // part.num_rows, pair % part.num_rows
                bounds = np.searchsorted(term, np.arange(len(names) + 1))
                here = sessions[start : start + CHUNKS]
                for session in dict.fromkeys(here):
                    if session not in shared.value:
                        continue
                    ids, avgdl, terms = shared.value[session]
                    mine = np.array([x == session for x in here])
                    scores = np.zeros((len(ids), part.num_rows))
                    for j, name in enumerate(names):
                        if name in terms:
                            at, n = owner[bounds[j] : bounds[j + 1]], tf[bounds[j] : bounds[j + 1]]
                            part_of = n * (config.k1 + 1) / (n + config.k1 * (1 - config.b + config.b * sizes[at] / avgdl))
                            rows, weight = terms[name]
                            scores[np.ix_(rows, at)] += weight[:, None] * part_of
                    scores = np.where(mine, np.round(scores, 9), 0.0)
                    seqs = [tuple(x.values()) if isinstance(x, dict) else x for x in part.column(columns[2]).to_pylist()]
                    picked = best_places(scores, k, seqs, part.column(columns[1]).to_pylist())
                    if picked:
                        q, c = np.array(picked).T
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([ids[i].item() if hasattr(ids[i], "item") else ids[i] for i in q], type=arrow.field(0).type),
                                part.column(columns[1]).take(pa.array(c)).cast(arrow.field(1).type),
                                part.column(columns[2]).take(pa.array(c)).cast(arrow.field(2).type),
                                pa.array(scores[q, c], type=arrow.field(3).type),
                            ],
                            schema=arrow,
                        )

    return run


def best_places(scores: np.ndarray, k: int, seqs: list, ids: list) -> list[tuple[int, int]]:
    """(row, column) of the k best positive scores of each row; ties by seq (null last), then id."""
    out = []
    for i in np.flatnonzero((scores > 0).any(1)).tolist():
        s = scores[i]
        at = np.flatnonzero(s > 0)
        if len(at) > k:
            least = np.partition(s[at], len(at) - k)[len(at) - k]
            at = np.flatnonzero((s > 0) & (s >= least))
            if len(at) > k:
                at = sorted(at.tolist(), key=lambda c: (-s[c], seqs[c] is None, () if seqs[c] is None else seqs[c], ids[c]))[:k]
        out += [(i, int(c)) for c in at]
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays in double precision; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def dense(vectors: DataFrame, queries: DataFrame, k: int = CONFIG.candidates) -> DataFrame:
    """query_id, chunk_id, score, rank: most similar vectors of the query's session, ties by chunk id.

    Questions go to all tasks that scan vectors in blocks of ``QUESTIONS``; a task keeps k rows a question of
    each Arrow batch. Vectors without length and those of other lengths than the question's have no score.
    """
    id_type, chunk_type = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]
    found = None
    for asked in question_blocks(queries, ["query_id", "session_id", "embedding"]):
        part = vectors.select("session_id", "chunk_id", "embedding").mapInPandas(dense_scan(vectors, asked, k), f"query_id {id_type}, chunk_id {chunk_type}, score double")
        found = part if found is None else found.unionByName(part)
    return top(found, k, F.col("score").desc(), F.col("chunk_id"))


def dense_scan(vectors: DataFrame, asked: list, k: int) -> Callable:
    """A function from frames of vectors to their k most similar ones for each question."""
    by_session: dict = {}
    for q in asked:
        if q["embedding"] is not None:
            by_session.setdefault((q["session_id"], len(q["embedding"])), []).append((q["query_id"], q["embedding"]))
    packed = {s: ([i for i, _ in v], np.array([e for _, e in v], float)) for s, v in by_session.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(packed)

    def run(frames):
        import pandas as pd

        for frame in frames:
            frame = frame[frame["embedding"].notna()]
            for (session, dim), part in frame.groupby([frame["session_id"], frame["embedding"].map(len)], sort=False, dropna=False):
                if (session, dim) not in shared.value or not dim:
                    continue
                names, q = shared.value[session, dim]
                x = np.stack(part["embedding"].to_numpy()).astype(float)
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = (q @ x.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
                ids = part["chunk_id"].to_numpy()
                for name, s in zip(names, np.round(score, 9)):
                    best = np.lexsort((ids, -s))[:k]
                    best = best[~np.isnan(s[best])]
                    yield pd.DataFrame({"query_id": [name] * len(best), "chunk_id": ids[best], "score": s[best]})

    return run


def fuse(lists: list[DataFrame], k: int = CONFIG.candidates, rrf_k: int = CONFIG.rrf_k) -> DataFrame:
    """query_id, chunk_id, score, rank: sums of 1 / (60 + rank) with ranks from 0.

    Ties keep the order of first sight: the first list's rows, then the next list's.
    """
    rows = None
    for i, part in enumerate(lists):
        one = part.select("query_id", "chunk_id", F.lit(i).alias("list"), F.col("rank").alias("place"))
        rows = one if rows is None else rows.unionByName(one)
    summed = rows.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (rrf_k + F.col("place"))).alias("score"), F.min(F.struct("list", "place")).alias("seen"))
    return top(summed.withColumn("score", F.round("score", 12)), k, F.col("score").desc(), F.col("seen")).select("query_id", "chunk_id", "score", "rank")


def keyed(chunks: DataFrame) -> DataFrame:
    """``chunks`` (chunk_id, page, content) whose rows without an id get one of their page and content."""
    return chunks.withColumn("chunk_id", document_key(F.col("chunk_id"), F.col("page"), F.col("content")))


def rerank(hits: DataFrame, n: int = CONFIG.final, score: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """The first n hits of each query, in the order of a plug-in's scores, or as they are."""
    if score is None:
        return hits.where(F.col("rank") < n)
    return top(hits.drop("rank").withColumn("__model", score(hits)), n, F.col("__model").desc(), F.col("chunk_id")).drop("__model")


def hybrid(posts: DataFrame, stats: DataFrame, vectors: DataFrame, queries: DataFrame, config: RetrievalConfig = CONFIG, score=None) -> DataFrame:
    """Dense and BM25 candidates, fused and reranked; ``queries``: query_id, session_id, text, embedding."""
    fused = fuse([dense(vectors, queries, config.candidates), bm25(posts, stats, queries, config.candidates, config)], config.candidates, config.rrf_k)
    return rerank(fused, config.final, score)


def embed(rows: DataFrame, embedder: Callable[[list[str]], np.ndarray], text: str = "content", batch: int = 100) -> DataFrame:
    """``rows`` with embedding: texts go to the plug-in in batches of ``batch``."""

    def run(frames):
        for frame in frames:
            vectors = []
            for start in range(0, len(frame), batch):
                vectors += [list(map(float, v)) for v in embedder(frame[text].iloc[start : start + batch].tolist())]
            frame["embedding"] = vectors
            yield frame

    from pyspark.sql import types as T

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
