"""Toxicity by maximum-scoring segments of token log-odds.

Token features (a word and its first 4, 5 and 6 letters, hashed) are counted in toxic and
other labelled texts. Their log-odds have a Dirichlet prior in proportion to the labelled
texts that are counted, toxic and clean together; texts without a label, held out or kept
for calibration have no part in it. A feature scores the end of its log-odds' confidence interval that is nearer to zero,
and zero if the interval holds zero. A token has the score of its most toxic feature, or else of its word as
evidence for a clean text, less a drift. One pass over the tokens finds all maximal
segments. A segment's score S in n tokens of clean text is exceeded K*n*exp(-lambda*S)
times by chance; lambda solves E[exp(lambda*s)] = 1 over clean tokens. Segments with
an expectation below ``significant`` are passages, and a logistic function of their
extreme-value scores is the text's score.

Labels come only from rows with crc32(doc_id) mod 5 <> 0: remainders 1 to 3 are counted,
remainder 4 calibrates (at most ``calibration_rows`` rows, those with the smallest hashes).

Edge cases: a null or empty text has no passage and gets the score of no evidence; texts
are read whole; a doc_id labelled twice is toxic if one label says so; without labels of
both classes every score is 0; a null id counts as the id of an empty text; repeated rows
are scored one by one; other columns aren't read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import map_texts, materialize, scratch
from lodestack.llm.neardup import few, words_of

BUCKETS, PREFIXES = 1 << 20, (4, 5, 6)
PRIOR_SHARE, SIGMAS, DRIFT, SIGNIFICANT = 0.05, 2.33, 1.0, 0.01
CALIBRATION_ROWS = 50_000


def features(word: bytes) -> list[int]:
    """Hashed features of a word: itself and its first letters."""
    letters = word.decode("utf-8", "replace")
    names = [b"=" + word] + [b"^" + letters[:p].encode() for p in PREFIXES if len(letters) >= p]
    return [zlib.crc32(x) % BUCKETS for x in names]


@dataclass
class Model:
    scores: np.ndarray  # by feature, ``BUCKETS`` numbers
    rate: float  # lambda
    log_k: float
    weights: np.ndarray
    drift: float
    significant: float


class Scores(dict):
    """Token scores by word, found when first asked for."""

    def __init__(self, by_feature: np.ndarray):
        super().__init__()
        self.by_feature = by_feature

    def __missing__(self, word: bytes) -> float:
        if len(self) > 400_000:
            self.clear()
        each = self.by_feature[features(word)]
        found = self[word] = float(max(each) if max(each) > 0 else each[0])
        return found


def segments(at: list[int], gains: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first token, last token) in linear time.

    The tokens at positions ``at`` score their gain (of either sign) less ``drift``, all others -drift. A
    stack holds candidates with the running total before and after each.
    """
    stack: list[tuple[float, float, int, int, int]] = []  # before, after, first, last, place of the nearest lower one
    total, done = 0.0, 0
    for p, g in zip(at, gains):
        total -= drift * (p - done)
        before, after, first = total, total + g - drift, p
        total, done = after, p + 1
        if g <= drift:
            continue
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= after:
                stack.append((before, after, first, p, j))
                break
            before, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a - b, first, last) for b, a, first, last, _ in stack]


def evidence(words: list[bytes], scores: Scores, drift: float) -> tuple[int, list[tuple[float, int, int]], list[float]]:
    """Tokens, maximal segments and the token scores other than 0 of a text."""
    found = [scores[w] for w in words]
    gains = [s for s in found if s]
    if not gains or max(gains) <= drift:
        return len(words), [], gains
    return len(words), segments([i for i, s in enumerate(found) if s], gains, drift), gains


def summary(n: int, parts: list[tuple[float, int, int]], model: Model) -> tuple[list[float], list[tuple[float, int, int]]]:
    """Extreme-value scores of a text (best, sum over passages, their number) and its passages.

    A segment counts by -log of its expected number, lambda * S - log_k - log n; a text
    without a segment has no evidence.
    """
    base = model.log_k + np.log(max(n, 1))
    strong = [(model.rate * s - base, s, a, b) for s, a, b in parts]
    passages = [(e, a, b) for e, s, a, b in strong if e > -np.log(model.significant)]
    best = np.log1p(max((x[0] for x in strong if x[0] > 0), default=0.0))
    return [best, np.log1p(sum(e for e, _, _ in passages)), np.log1p(len(passages))], [(e, a, b) for e, a, b in passages]


def solve_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """The positive lambda with E[exp(lambda * s)] = 1; 1 where none is needed or found."""
    share = counts / counts.sum()
    if not (scores > 0).any() or (share * scores).sum() >= 0:
        return 1.0
    low, high = 1e-3, 50.0
    excess = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum() - 1)
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return min(max(low, 0.05), 5.0)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights, the last for 1, by Newton's method with shrinking steps; none of the features may lower the score.

    Features are scaled to one spread, and a step is halved until the penalised likelihood grows, so that
    classes that features tell apart without error give finite weights with the border between them.
    """
    spread = np.where(x.std(0) > 0, x.std(0), 1.0)
    a = np.column_stack([(x - x.mean(0)) / spread, np.ones(len(x))])
    use = np.ones(a.shape[1], bool)
    use[:-1] = x.std(0) > 0

    def loss(w: np.ndarray) -> float:
        z = a[:, use] @ w
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * (w @ w))

    while True:
        w, now = np.zeros(use.sum()), loss(np.zeros(use.sum()))
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a[:, use] @ w, -500, 500)))
            g = a[:, use].T @ (p - y) + ridge * w
            h = (a[:, use] * (p * (1 - p))[:, None]).T @ a[:, use] + ridge * np.eye(len(w))
            step, size = np.linalg.solve(h, g), 1.0
            while (new := loss(w - size * step)) > now and size > 1e-6:
                size /= 2
            if new >= now - 1e-10 * max(1.0, now):
                break
            w, now = w - size * step, new
        found = np.zeros(a.shape[1])
        found[use] = w
        if not (found[:-1] < 0).any():
            break
        use[:-1] &= found[:-1] >= 0
    found[:-1] /= spread
    found[-1] -= found[:-1] @ x.mean(0)
    return found


def feature_counts(labelled: DataFrame) -> DataFrame:
    """bucket, toxic, clean: token features of the labelled texts by class.

    A task adds up its own counts in two arrays of ``BUCKETS`` numbers.
    """

    def run(batches):
        import pyarrow as pa

        from lodestack.llm.common import slices

        total = np.zeros((2, BUCKETS), np.int64)
        memo: dict[bytes, list[int]] = {}
        for batch in batches:
            for part in slices(batch, 1):
                for toxic, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    flat: list[int] = []
                    for w in words_of(text or ""):
                        found = memo.get(w)
                        if found is None:
                            if len(memo) > 200_000:
                                memo.clear()
                            found = memo[w] = features(w)
                        flat += found
                    if flat:
                        bucket, count = np.unique(np.array(flat), return_counts=True)
                        total[int(toxic > 0), bucket] += count
        some = np.flatnonzero(total.any(0))
        for start in range(0, len(some), 50_000):
            b = some[start : start + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(total[1, b], pa.int64()), pa.array(total[0, b], pa.int64())], names=["bucket", "toxic", "clean"])

    rows = labelled.select("toxic", "text").mapInArrow(run, "bucket int, toxic long, clean long")
    return rows.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def feature_scores(counts: DataFrame, prior_share: float = PRIOR_SHARE, sigmas: float = SIGMAS) -> np.ndarray | None:
    """Log-odds by bucket, drawn towards zero by ``sigmas`` standard deviations; None without texts of both classes."""
    total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    if not total[0] or not total[1]:
        return None
    n_toxic, n_clean = float(total[0]), float(total[1])
    prior = prior_share * min(n_toxic, n_clean)
    a = F.lit(prior / (n_toxic + n_clean)) * (F.col("toxic") + F.col("clean"))
    part = lambda y, n: F.log((F.col(y) + a) / (n + prior - F.col(y) - a))
    odds, off = part("toxic", n_toxic) - part("clean", n_clean), sigmas * F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    bound = F.greatest(odds - off, F.lit(0.0)) + F.least(odds + off, F.lit(0.0))
    rows = counts.select("bucket", bound.cast("float").alias("bound")).where("bound <> 0").toArrow()
    scores = np.zeros(BUCKETS, np.float32)
    scores[rows.column("bucket").to_numpy()] = rows.column("bound").to_numpy()
    return scores


def train(docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Model | None:
    """The model, from labels of rows that aren't held out; None without both classes."""
    with scratch(docs.sparkSession):
        return fitted(docs, labels, calibration_rows)


def fitted(docs: DataFrame, labels: DataFrame, calibration_rows: int) -> Model | None:
    """``train``, with tables that go when it ends."""
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(part != 0)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(docs["doc_id"], docs["text"])
    counted = known.where(part != 4)
    counts = materialize(feature_counts(texts.where(part.between(1, 3)).join(few(counted, counted.count()), "doc_id")), "features")
    scores = feature_scores(counts)
    if scores is None or not (scores > 0).any():
        return None
    chosen = known.where(part == 4).orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows)
    model = Model(scores, 1.0, 0.0, np.zeros(4), DRIFT, SIGNIFICANT)

    def make():
        memo = Scores(scores)

        def function(texts):
            out = [[], [], [], []]
            for t in texts:
                n, parts, gains = evidence(words_of(t), memo, DRIFT)
                steps, counts = np.unique(np.round(gains, 2), return_counts=True)
                for column, value in zip(out, (n, [p[0] for p in parts], steps, counts)):
                    column.append(value)
            return out

        return function

    fields = [T.StructField("n", T.LongType()), T.StructField("parts", T.ArrayType(T.DoubleType())), T.StructField("gains", T.ArrayType(T.DoubleType())), T.StructField("times", T.ArrayType(T.LongType()))]
    found = materialize(map_texts(texts.where(part == 4).join(F.broadcast(chosen), "doc_id"), ["doc_id", "toxic"], fields, make), "calibration")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("n", "parts", "gains", "times")).limit(calibration_rows) if found.count() > calibration_rows else found
    # Of the token scores the driver gets a histogram in steps of 0.01, of the rows their segments.
    clean = rows.where("toxic <= 0")
    tokens, found = clean.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("parts")), F.lit(0))).first()
    steps = clean.select(F.inline(F.arrays_zip("gains", "times"))).groupBy(F.col("gains").alias("g")).agg(F.sum("times").alias("count")).orderBy("g").toPandas()
    rows = rows.select("doc_id", "toxic", "n", "parts").orderBy("doc_id", F.xxhash64("n", "parts")).toPandas()
    y = (rows["toxic"].to_numpy() > 0).astype(float)
    if not len(y) or y.min() == y.max():
        return None
    counts = steps["count"].to_numpy(float)
    model.rate = solve_rate(np.r_[steps["g"].to_numpy(float) - DRIFT, -DRIFT], np.r_[counts, max(1.0, tokens - counts.sum())])
    # K: segments a token of clean text.
    model.log_k = min(0.0, max(float(np.log((found + 1) / (tokens + 1))), -6.0))
    x = np.array([summary(n, [(p, 0, 0) for p in parts], model)[0] for n, parts in zip(rows["n"], rows["parts"])])
    model.weights = logistic(x, y)
    return model


def probability(x: list[float], model: Model) -> float:
    return float(1 / (1 + np.exp(-np.clip(np.dot(model.weights[:-1], x) + model.weights[-1], -30, 30))))


def toxicity_report(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passages ("first:last" token of each), a row per row."""

    def make():
        memo = Scores(model.scores) if model else None

        def function(texts):
            if model is None:
                return [[0.0] * len(texts), [0] * len(texts), [""] * len(texts)]
            out = [[], [], []]
            for t in texts:
                n, parts, _ = evidence(words_of(t), memo, model.drift)
                x, passages = summary(n, parts, model)
                out[0].append(probability(x, model))
                out[1].append(len(passages))
                out[2].append(",".join(f"{a}:{b}" for _, a, b in passages))
            return out

        return function

    fields = [T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType()), T.StructField("passages", T.StringType())]
    rows = map_texts(docs, ["doc_id"], fields, make)
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    return rows.select("doc_id", (part == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages", "passages")
