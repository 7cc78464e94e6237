"""Quality rules: gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``sample_rows``),
flattened into numpy node arrays, and scored for whole batches at once. Splits on
chosen features are monotonic: more symbols, repeated lines, repeated words or
capitals never raise a document's quality.

Edge cases: an empty table gives no rows; rows with a null id are judged like others and fit no
trees; a null text counts as empty (no words, fails the base rule); texts of
any length are read whole; repeated rows and ids are scored row by row; without
labels of both classes the verdict is the base rule's alone; other columns of the
input are not read by ``quality_report`` and are carried along by ``quality_filter``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import map_rows, map_texts

MIN_WORDS, WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 20_000
#: Probability of good quality below which a document is rejected.
THRESHOLD = 0.5
#: Features of the trees and the sign that each may have on quality (0: free).
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "bang_share": -1,
    "pipe_share": -1,
    "words_a_line": 0,
    "distinct_share": 1,
    "punctuation_share": 0,
}
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, bounds: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Per text, the words in windows of ``window`` words that the text has twice or more.

    ``ids``: word numbers of several texts, one after another; ``bounds``: where each
    text starts, and the end. Windows are grouped by a 64-bit hash, and what shares a
    hash is compared word by word.
    """
    texts, n = len(bounds) - 1, len(ids)
    starts = n - window + 1
    if starts < 2:
        return np.zeros(texts, np.int64)
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    h = np.zeros(starts, np.uint64)
    for j in range(window):
        h = h * np.uint64(0x100000001B3) + mixed[j : j + starts]
    whole = np.flatnonzero(owner[:starts] == owner[window - 1 :])
    key = h[whole] ^ (owner[whole].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    covered = np.zeros(n + 1, np.int64)
    if same.any():
        twin = np.zeros(len(ranked), bool)
        twin[1:] |= same
        twin[:-1] |= same
        members = whole[order[twin]]
        group = np.cumsum(np.r_[True, ~(ranked[twin][1:] == ranked[twin][:-1])]) - 1
        first = np.r_[True, group[1:] != group[:-1]]
        span = np.arange(window)
        rows = np.column_stack([owner[members], ids[members[:, None] + span]])
        if not np.array_equal(rows, rows[np.flatnonzero(first)[group]]):  # a collision of hashes
            _, back, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
            members = members[count[np.ravel(back)] > 1]
        np.add.at(covered, members, 1)
        np.add.at(covered, np.minimum(members + window, n), -1)
    hit = np.r_[0, np.cumsum(np.cumsum(covered[:n]) > 0)]
    return hit[bounds[1:]] - hit[bounds[:-1]]


def statistics(texts: list[str]) -> tuple[dict[str, list[int]], np.ndarray]:
    """Counts of the base rule, and a row of ``FEATURES`` for each text."""
    n_words, lines_with_words, dup_lines, distinct = [], [], [], []
    ids: list[int] = []
    numbers: dict[bytes, int] = {}
    histogram = np.zeros((len(texts), 256), np.int64)
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()  # bytes split at \x20 and \x09-\x0D alone
        n_words.append(len(words))
        distinct.append(len(set(words)))
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        if raw:
            histogram[i] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        lines_with_words.append(len(lines))
        dup_lines.append(len(lines) - len(set(lines)))
    bounds = np.r_[0, np.cumsum(n_words)].astype(np.int64)
    repeats = repeated_words(np.array(ids, np.int64), bounds)
    blank = histogram[:, 9:14].sum(1) + histogram[:, 32]
    chars = histogram.sum(1) - histogram[:, 0x80:0xC0].sum(1) - blank
    symbols = histogram[:, list(SYMBOLS)].sum(1)
    words, c = np.array(n_words, float), np.maximum(chars, 1)
    w, lines = np.maximum(words, 1), np.array(lines_with_words, float)
    marks = histogram[:, 33:48].sum(1) + histogram[:, 58:65].sum(1) + histogram[:, 91:97].sum(1) + histogram[:, 123:127].sum(1)
    features = np.column_stack(
        [
            np.log1p(words),
            chars / w,
            symbols / c,
            np.array(dup_lines) / np.maximum(lines, 1),
            repeats / w,
            histogram[:, 65:91].sum(1) / c,
            histogram[:, 48:58].sum(1) / c,
            histogram[:, 33] / w,
            histogram[:, 124] / w,
            words / np.maximum(lines, 1),
            np.array(distinct) / w,
            marks / c,
        ]
    ) if texts else np.zeros((0, len(FEATURES)))
    counts = {
        "n_words": n_words,
        "word_chars": chars.tolist(),
        "n_symbols": symbols.tolist(),
        "n_dup_lines": dup_lines,
        "n_repeat_words": repeats.tolist(),
    }
    return counts, features


@dataclass
class Trees:
    """Node arrays of all trees: a node is a leaf where ``feature`` is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees together."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    signs: list[int],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 64,
    ridge: float = 1.0,
    least: float = 2.0,
) -> Trees | None:
    """Second-order boosting of the logistic loss with histogram splits.

    A split on a feature with a sign is refused if its children's values are in the
    wrong order, and the children's descendants stay on their side of the middle
    value, so the whole model is monotonic. None if ``y`` has one class.
    """
    if len(y) == 0 or y.min() == y.max():
        return None
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node() -> int:
        for a, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        me, total_g, total_h = node(), g[rows].sum(), h[rows].sum()
        clip = lambda a, b: np.clip(-a / (b + ridge), low, high)
        gain = lambda a, b, v: -(a * v + 0.5 * (b + ridge) * v * v)
        own = clip(total_g, total_h)
        best = (1e-6, None)
        if level < depth:
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                size = len(c) + 1
                lg = np.bincount(codes[rows, j], g[rows], size).cumsum()[:-1]
                lh = np.bincount(codes[rows, j], h[rows], size).cumsum()[:-1]
                a, b = clip(lg, lh), clip(total_g - lg, total_h - lh)
                gains = gain(lg, lh, a) + gain(total_g - lg, total_h - lh, b) - gain(total_g, total_h, own)
                ok = (lh >= least) & (total_h - lh >= least) & (signs[j] * (b - a) >= 0)
                gains = np.where(ok, gains, -np.inf)
                k = int(gains.argmax())
                if gains[k] > best[0]:
                    best = (gains[k], (j, k, float((a[k] + b[k]) / 2)))
        if best[1] is None:
            value[me] = rate * float(own)
            score[rows] += value[me]
            return me
        j, k, middle = best[1]
        goes = codes[rows, j] <= k
        sides = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}.get(signs[j], ((low, high),) * 2)
        feature[me], threshold[me] = j, float(cuts[j][k])
        left[me] = grow(rows[goes], g, h, level + 1, *sides[0])
        right[me] = grow(rows[~goes], g, h, level + 1, *sides[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -5.0, 5.0))
    as_int = lambda a: np.array(a, np.int64)
    return Trees(as_int(feature), np.array(threshold), as_int(left), as_int(right), np.array(value), as_int(roots), base, depth)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees fitted on at most ``sample_rows`` labelled rows, those with the smallest hashes of doc_id.

    The sample's bound is a parameter, so it may be broadcast and collected.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("__quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    rows = docs.select(docs["doc_id"], docs["text"]).join(F.broadcast(chosen), "doc_id")
    sample = map_texts(
        rows,
        ["doc_id", "__quality"],
        [T.StructField("x", T.ArrayType(T.DoubleType(), False), True)],
        lambda: lambda texts: [statistics(texts)[1].tolist()],
    )
    first = sample.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(sample_rows)  # of repeated ids always the same rows
    found = sorted((r.doc_id, r["__quality"], r.x) for r in first.collect())
    if not found:
        return None
    y = np.array([float(r[1] > 0) for r in found])
    return fit_trees(np.array([r[2] for r in found]), y, list(FEATURES.values()))


def verdicts(texts: list[str], model: Trees | None, threshold: float = THRESHOLD) -> tuple[dict[str, list[int]], list[bool], list[bool], list[float]]:
    """Counts, base_failed, kept and probability of good quality for each text."""
    counts, x = statistics(texts)
    n, r = np.array(counts["n_words"], np.int64), np.array(counts["n_repeat_words"], np.int64)
    failed = (n < MIN_WORDS) | (100 * r > REPEAT_PERCENT * n)
    good = model.probability(x) if model is not None and len(texts) else np.ones(len(texts))
    return counts, failed.tolist(), (~failed & (good >= threshold)).tolist(), good.tolist()


def quality_report(docs: DataFrame, model: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base rule's counts, base_failed, kept and the trees' probability, a row per row."""

    def function(texts):
        counts, failed, kept, good = verdicts(texts, model, threshold)
        return [*counts.values(), failed, kept, good]

    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("quality_score", T.DoubleType())]
    return map_texts(docs, ["doc_id"], fields, lambda: function)


def quality_filter(docs: DataFrame, model: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return map_rows(docs, lambda: lambda texts: (verdicts(texts, model, threshold)[2], None))
