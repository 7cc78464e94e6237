"""Exact top-k inner products by best-first search in M-trees.

Vectors of integers are lifted to one norm (one more component), which turns the largest
inner product into the smallest Euclidean distance, a metric. Vectors are dealt to cells
around pivots, and cells to cells of their own pivots, until about ``TREE_ROWS`` are in each;
a cell is a tree, and every vector is in one. A tree has pages of entries with covering radii
and distances to their parent; the distance to the parent rules entries out before any
distance is computed, and of a page of points only a range by their distance to its centre
is looked at.

A block of queries is searched together: each takes its first pages by the best score that they can
hold, and then all go to the pages that may still hold a better row; queries that come to the same page share one matrix product. A query searches its
own tree first. With its k-th score there, roots' radii rule out whole trees for whole blocks
of queries (of neighbouring trees); the rest is searched, nearest trees first.

Trees hold vectors whose scaled squared norm is below 2**50, so that products are exact
in doubles. The others, the heavy ones, are compared with
every query, and heavy queries with every vector, in blocks: doubles with a bound on their
error leave the rows that may be among the k best, and whole numbers of Python rank those.

Edge cases: vectors that are null or hold null or non-finite components and rows with a
null id take no part; a score beyond 64 bits is null, and its rank is right; vectors are
compared with those of the same length; rows with the query's vec_id are its own; repeated candidate
rows each count; repeated query rows with the same vector are one query; many copies of one vector
are dealt to trees by id; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import io
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import materialize, scratch

SCALE, K, QUERY_EVERY = 256, 5, 50
#: Rows of a tree (up to twice as many), of a page, pages of a page; pivots of a cell, and levels of cells.
TREE_ROWS, LEAF, FAN, PIVOTS, LEVELS = 4096, 256, 16, 64, 6
#: Pages that each query takes in its own order before queries go to pages together.
FIRST = 3
#: Queries of a block, trees that a task searches for a block, rows that a task deals to cells.
BLOCK, UNIT, DEAL_ROWS = 1024, 8, 16_384
NONE = -(1 << 62)
#: Scaled squared norm that trees hold less than.
HEAVY = float(1 << 50)


class Best:
    """The k best (score, vec_id) of each query, ties to smaller ids; scores below ``floor`` don't count."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.own, self.floor, self.k = ids, floor.astype(float), k
        self.scores = np.full((len(ids), k), -np.inf)
        self.ids = np.full((len(ids), k), 1 << 62)

    def least(self, rows: np.ndarray) -> np.ndarray:
        """The score that a vector needs to be among the best of each of ``rows``."""
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the vectors ``ids`` (columns) for the queries ``rows``."""
        least = self.least(rows)
        for i in np.flatnonzero(scores.max(1) >= least).tolist():
            row, s = rows[i], scores[i]
            at = np.flatnonzero((s >= least[i]) & (ids != self.own[row]))
            if len(at) > self.k:
                at = at[s[at] >= np.partition(s[at], -self.k)[-self.k]]
            both, names = np.r_[self.scores[row], s[at]], np.r_[self.ids[row], ids[at]]
            order = np.lexsort((names, -both))[: self.k]
            self.scores[row], self.ids[row] = both[order], names[order]

    def rows(self) -> list[tuple[int, int, int]]:
        """(query's number, vec_id, score) of all that was found, best first."""
        return [(q, int(i), int(s)) for q in range(len(self.own)) for i, s in zip(self.ids[q], self.scores[q]) if s > -np.inf]


class MTree:
    """Arrays of a tree: points in leaf order, by distance to their leaf's centre, and nodes with their pages."""

    NAMES = ("points", "ids", "center", "radius", "parent", "first", "count", "leaf", "own")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)
        self.points = self.points.astype(float)
        norms = (self.points**2).sum(1)
        self.top = int(norms.max()) if len(norms) else 0
        self.lift = np.sqrt(self.top - norms)
        self.computed = 0  # distances and products so far

    @classmethod
    def build(cls, points: np.ndarray, ids: np.ndarray) -> MTree:
        order = np.argsort(ids, kind="stable")
        points, ids = points[order], ids[order]
        norms = (points.astype(float) ** 2).sum(1)
        lifted = np.column_stack([points.astype(float), np.sqrt(norms.max() - norms)])
        nodes: list[list] = []  # center, radius, parent distance, first, count, leaf
        places: list[np.ndarray] = []
        own = np.zeros(len(points))
        random = np.random.default_rng(1)

        def node(members: np.ndarray) -> list:
            c = lifted[members].mean(0)
            center = members[int(((lifted[members] - c) ** 2).sum(1).argmin())]
            own[members] = np.sqrt(((lifted[members] - lifted[center]) ** 2).sum(1))
            return [int(center), float(own[members].max()), 0.0, 0, 0, False]

        nodes.append(node(np.arange(len(points))))
        todo = [(0, np.arange(len(points)))]
        placed = 0
        while todo:
            at, members = todo.pop(0)
            if len(members) <= LEAF:
                own[members] = np.sqrt(((lifted[members] - lifted[nodes[at][0]]) ** 2).sum(1))
                nodes[at][3:6] = [placed, len(members), True]
                places.append(members[np.argsort(own[members], kind="stable")])
                placed += len(members)
                continue
            fan = min(FAN, -(-len(members) * 2 // LEAF))
            picks = members[random.choice(len(members), fan, replace=False)]
            # |a - b|^2 through one product; exactness is not needed to deal members out
            cross = lifted[members] @ lifted[picks].T
            near = ((lifted[picks] ** 2).sum(1)[None, :] - 2 * cross).argmin(1)
            if np.bincount(near, minlength=fan).max() > 0.9 * len(members):  # copies: cut by id
                near = np.arange(len(members)) * fan // len(members)
            parts = [members[near == j] for j in range(fan)]
            parts = [p for p in parts if len(p)]
            nodes[at][3:6] = [len(nodes), len(parts), False]
            for p in parts:
                nodes.append(node(p))
                nodes[-1][2] = float(np.sqrt(((lifted[nodes[-1][0]] - lifted[nodes[at][0]]) ** 2).sum()))
                todo.append((len(nodes) - 1, p))
        new = np.concatenate(places)
        back = np.empty(len(new), np.int64)
        back[new] = np.arange(len(new))
        columns = list(zip(*nodes))
        return cls(
            points=points[new], ids=ids[new], own=own[new], center=back[np.array(columns[0])], radius=np.array(columns[1]), parent=np.array(columns[2]),
            first=np.array(columns[3]), count=np.array(columns[4]), leaf=np.array(columns[5]),
        )

    def dump(self) -> bytes:
        out = io.BytesIO()
        # Components are below 2**25, as squared norms are below 2**50.
        np.savez(out, **{n: getattr(self, n).astype(np.int32) if n == "points" else getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> MTree:
        with np.load(io.BytesIO(data)) as found:
            return cls(**{n: found[n] for n in cls.NAMES})

    def search_block(self, q: np.ndarray, best: Best, rows: np.ndarray | None = None) -> None:
        """Adds what this tree has for the queries ``q`` (or those of ``rows``) to ``best``."""
        rows = np.arange(len(q)) if rows is None else rows
        whole = (q**2).sum(1) + self.top
        slack = 1e-6 + 1e-9 * whole

        def apart(some, nodes):
            self.computed += len(some) * len(nodes)
            return np.sqrt(np.maximum(0.0, whole[some][:, None] - 2.0 * (q[some] @ self.points[self.center[nodes]].T)))

        def most(some, far):  # the largest scores at distances of at least far
            return np.floor((whole[some][:, None] - np.maximum(0.0, far - 1e-9 * (1 + far)) ** 2) / 2 + slack[some][:, None])

        bound, far = np.full((len(q), len(self.center)), -np.inf), np.zeros((len(q), len(self.center)))
        root = np.zeros(1, np.int64)
        far[rows, 0] = apart(rows, root)[:, 0]
        bound[rows, 0] = most(rows, np.maximum(0.0, far[rows, :1] - self.radius[0]))[:, 0]
        todo = [0] if not self.leaf[0] else []
        while todo:
            at = todo.pop(0)
            some = rows[bound[rows, at] >= best.least(rows)]
            span = np.arange(self.first[at], self.first[at] + self.count[at])
            gap = np.abs(far[some, at][:, None] - self.parent[span]) - self.radius[span]
            may = most(some, np.maximum(0.0, gap)) >= best.least(some)[:, None]
            some, may, span = some[may.any(1)], may[may.any(1)][:, may.any(0)], span[may.any(0)]
            if len(some):
                d = apart(some, span)
                far[np.ix_(some, span)] = d
                bound[np.ix_(some, span)] = np.where(may, most(some, np.maximum(0.0, d - self.radius[span])), -np.inf)
                todo += [n for n in span.tolist() if not self.leaf[n]]
        leaves = np.flatnonzero(self.leaf)
        order = leaves[np.argsort(-bound[:, leaves], axis=1, kind="stable")]
        for turn in range(min(FIRST, len(leaves))):  # each query's next best page
            page = order[:, turn]
            some = rows[bound[rows, page[rows]] >= best.least(rows)]
            for leaf in np.unique(page[some]).tolist():
                self.read_page(leaf, some[page[some] == leaf], q, whole, slack, far, best)
            bound[rows, page[rows]] = -np.inf
        # By now the k-th scores are nearly the last ones; queries go to the other pages together.
        for leaf in leaves[np.argsort(-bound[:, leaves].max(0), kind="stable")].tolist():
            self.read_page(leaf, rows[bound[rows, leaf] >= best.least(rows)], q, whole, slack, far, best)

    def read_page(self, leaf: int, mine: np.ndarray, q: np.ndarray, whole: np.ndarray, slack: np.ndarray, far: np.ndarray, best: Best) -> None:
        """Scores the points of a page that can be near enough for one of the queries ``mine``."""
        if not len(mine):
            return
        reach = np.sqrt(np.maximum(0.0, whole[mine] - 2 * best.least(mine))) * (1 + 1e-9) + np.sqrt(slack[mine]) + 1e-6
        own = self.own[self.first[leaf] : self.first[leaf] + self.count[leaf]]
        low = int(np.searchsorted(own, (far[mine, leaf] - reach).min(), "left"))
        high = int(np.searchsorted(own, (far[mine, leaf] + reach).max(), "right"))
        if low < high:
            span = slice(self.first[leaf] + low, self.first[leaf] + high)
            self.computed += len(mine) * (high - low)
            best.offer(mine, q[mine] @ self.points[span].T, self.ids[span])

    def search(self, query: np.ndarray, query_id: int, k: int = K, floor: int = NONE) -> list[tuple[int, int]]:
        """The k best (score, vec_id) with scores of ``floor`` at least, ties to smaller ids."""
        best = Best(np.array([query_id]), np.array([floor]), k)
        self.search_block(np.asarray(query, float)[None, :], best)
        return [(s, i) for _, i, s in best.rows()]


def finite(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding (doubles), heavy, dim of the vectors that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & good)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (F.abs(x * scale) + 1) * (F.abs(x * scale) + 1))
    return rows.select("vec_id", "embedding", (norm >= HEAVY).alias("heavy"), F.size("embedding").alias("dim"))


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (whole numbers), dim of the vectors of ``finite`` that aren't heavy."""
    return vectors.where(~F.col("heavy")).select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("v"), "dim")


def whole(vector, scale: int) -> list[int]:
    """The scaled vector in Python's whole numbers; ``floor(x * scale)`` as in ``scaled``."""
    return [math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in map(float, vector)]


def best_of(query: list[int], query_id: int, ids: np.ndarray, rows: np.ndarray, exact, k: int) -> list[tuple[int, int]]:
    """The k best (score, vec_id) of ``rows`` (whole numbers as doubles), exactly; ``exact`` gives a row's whole numbers."""
    at = np.flatnonzero(ids != query_id)
    if len(at) > k:
        with np.errstate(all="ignore"):
            try:
                q = np.array(query, float)
            except OverflowError:
                q = np.full(len(query), np.inf)
            near = rows[at] @ q
            off = (len(query) + 2) * 2.0**-51 * (np.abs(rows[at]) @ np.abs(q))
        if np.isfinite(near).all() and np.isfinite(off).all():
            least = np.partition(near - off, len(at) - k)[len(at) - k]
            at = at[near + off >= least]
    found = [(sum(a * b for a, b in zip(query, exact(i))), int(ids[i])) for i in at.tolist()]
    return sorted(found, key=lambda x: (-x[0], x[1]))[:k]


def heavy_answers(vectors: DataFrame, queries: Column, k: int, scale: int) -> DataFrame:
    """query_id, mark (the query's whole numbers), vec_id, score, tier, big: the k best of each block, of pairs with a heavy side.

    A score that 64 bits can't hold is 0, with its sign in ``tier`` and its order in ``big``.
    """

    def marked(frames):
        for frame in frames:
            frame["mark"] = [",".join(map(str, whole(v, scale))) for v in frame["embedding"]]
            yield frame[["query_id", "mark", "dim", "heavy"]]

    asked = vectors.where(queries).select(F.col("vec_id").alias("query_id"), "embedding", "dim", "heavy")
    asked = materialize(asked.mapInPandas(marked, "query_id long, mark string, dim int, heavy boolean").distinct(), "heavy-queries")

    def scan(key, wanted, found):
        import pandas as pd

        out, memo = [], {}
        if len(wanted) and len(found):
            ids, raw = found["vec_id"].to_numpy(np.int64), np.stack(found["embedding"].to_numpy()).astype(float)
            with np.errstate(all="ignore"):
                rows = np.floor(raw * scale)

            def exact(i):
                if i not in memo:
                    memo[i] = whole(raw[i], scale)
                return memo[i]

            for i, mark in zip(wanted["query_id"], wanted["mark"]):
                for s, n in best_of(list(map(int, mark.split(","))), i, ids, rows, exact, k):
                    tier = (s >= 1 << 63) - (s < -(1 << 63))
                    # 1 << 4399 is beyond any sum of products of doubles
                    out.append((i, mark, n, 0 if tier else s, tier, (s + (1 << 4399)).to_bytes(550, "big") if tier else None))
        return pd.DataFrame(out, columns=["query_id", "mark", "vec_id", "score", "tier", "big"])

    def pairs(wanted: DataFrame, found: DataFrame) -> DataFrame:
        shards, blocks = max(1, -(-wanted.count() // BLOCK)), max(1, -(-found.count() // TREE_ROWS))
        left = wanted.withColumn("shard", F.pmod(F.xxhash64("query_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = found.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        keys = ["dim", "block", "shard"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(scan, "query_id long, mark string, vec_id long, score long, tier int, big binary")

    return pairs(asked, vectors.where("heavy")).unionByName(pairs(asked.where("heavy"), vectors.where(~F.col("heavy"))))


def matrix(rows, dim: int) -> np.ndarray:
    return np.array([np.asarray(v, np.int64) for v in rows], np.int64).reshape(len(rows), dim)


def root_bounds(q: np.ndarray, trees) -> np.ndarray:
    """The largest score that each tree (column) of a frame of roots can hold for each query (row)."""
    whole = (q**2).sum(1)[:, None] + trees["top"].to_numpy()[None, :].astype(float)
    far = np.sqrt(np.maximum(0.0, whole - 2.0 * (q @ matrix(trees["root"].tolist(), q.shape[1]).T)))
    low = np.maximum(0.0, far - trees["radius"].to_numpy()[None, :])
    return (whole - np.maximum(0.0, low - 1e-9 * (1 + low)) ** 2) / 2 + 1e-6 + 1e-9 * whole


def cells(vectors: DataFrame) -> DataFrame:
    """``vectors`` (vec_id, v, dim) with tree: the cell of about ``TREE_ROWS`` rows that each is in.

    A cell that is too large gets up to ``PIVOTS`` pivots, its rows of smallest hashes, and a cell
    around each. What pivots can't cut (copies) is cut by id.
    """
    rows = materialize(vectors.withColumn("tree", F.concat(F.col("dim").cast("string"), F.lit("/"))), "cells")
    for level in range(LEVELS):
        sizes = rows.groupBy("tree").agg(F.count("*").alias("n")).where(F.col("n") > 2 * TREE_ROWS)
        sizes = materialize(sizes.withColumn("salts", F.ceil(F.col("n") / DEAL_ROWS).cast("int")), "sizes")
        if sizes.isEmpty():
            return rows
        large = rows.join(sizes, "tree")
        nearest = Window.partitionBy("tree").orderBy(F.xxhash64("vec_id", F.lit(level)), "vec_id")
        pivots = large.withColumn("p", F.row_number().over(nearest)).where(F.col("p") <= PIVOTS)
        pivots = pivots.where(F.col("p") <= F.ceil(F.col("n") / TREE_ROWS)).select("tree", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "p", "v")
        dealt = large.select("tree", F.pmod(F.xxhash64("vec_id", F.lit("deal")), F.col("salts")).cast("int").alias("salt"), "vec_id", "v", "dim")

        def deal(key, members, found):
            dim = int(members["dim"].iloc[0]) if len(members) else 0
            if len(members) and len(found) and dim:
                x, p = matrix(members["v"], dim).astype(float), matrix(found.sort_values("p")["v"], dim).astype(float)
                near = ((p**2).sum(1)[None, :] - 2 * x @ p.T).argmin(1)
                members["tree"] = members["tree"] + np.char.add(near.astype(str), "/")
            return members[["vec_id", "v", "dim", "tree"]]

        pivots = pivots.select(*[F.col(c).alias(c) for c in pivots.columns])  # names of their own for the cogroup
        new = dealt.groupBy("tree", "salt").cogroup(pivots.groupBy("tree", "salt")).applyInPandas(deal, rows.schema)
        rows = materialize(rows.join(sizes.select("tree"), "tree", "left_anti").select(*rows.columns).unionByName(new), "cells")
    n = F.count("*")
    sizes = rows.groupBy("tree").agg(F.when(n > 2 * TREE_ROWS, F.ceil(n / TREE_ROWS)).otherwise(1).cast("int").alias("cuts"))
    cut = F.concat("tree", F.lit("#"), F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("string"))
    return rows.join(sizes, "tree").select("vec_id", "v", "dim", cut.alias("tree"))


def top_k(embeddings: DataFrame, queries: Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row where ``queries`` (of vec_id) holds."""
    with scratch(embeddings.sparkSession) as keep:
        return keep(materialize(answers(embeddings, queries, k, scale), "topk"))


def answers(embeddings: DataFrame, queries: Column, k: int, scale: int) -> DataFrame:
    """``top_k`` as a plan over written tables."""
    import pandas as pd

    vectors = finite(embeddings, scale)
    placed = materialize(cells(scaled(vectors, scale)), "placed")

    def build(frame):
        dim = int(frame["dim"].iloc[0])
        tree = MTree.build(matrix(frame["v"].tolist(), dim), frame["vec_id"].to_numpy(np.int64))
        root = tree.points[tree.center[0]].astype(np.int64).tolist()
        return pd.DataFrame({"tree": [frame["tree"].iloc[0]], "dim": [dim], "root": [root], "radius": [float(tree.radius[0])], "top": [tree.top], "data": [tree.dump()]})

    trees = materialize(placed.groupBy("tree").applyInPandas(build, "tree string, dim int, root array<long>, radius double, top long, data binary"), "trees")
    asked = placed.where(queries).select(F.col("vec_id").alias("query_id"), "v", "dim", "tree").distinct()
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "asked")

    def searched(wanted, found, floors, elsewhere: bool) -> pd.DataFrame:
        """What the trees of ``found`` have for the queries of ``wanted``, nearest trees first; ``elsewhere``: but their own."""
        names = ["q", "vec_id", "score"]
        if not len(wanted) or not len(found):
            return pd.DataFrame([], columns=names)
        q = matrix(wanted["v"].tolist(), int(wanted["dim"].iloc[0])).astype(float)
        best, everyone = Best(wanted["query_id"].to_numpy(np.int64), floors, k), np.arange(len(q))
        bounds = root_bounds(q, found)
        if elsewhere:
            bounds[wanted["tree"].to_numpy()[:, None] == found["tree"].to_numpy()[None, :]] = -np.inf
        for j in np.argsort(-bounds.max(0), kind="stable").tolist():
            rows = np.flatnonzero(bounds[:, j] >= best.least(everyone))
            if len(rows):
                MTree.load(found["data"].iloc[j]).search_block(q, best, rows)
        at = wanted["q"].to_numpy()
        return pd.DataFrame([(at[i], n, s) for i, n, s in best.rows()], columns=names)

    def search_own(wanted, found):
        return searched(wanted, found, np.full(len(wanted), NONE), False)

    def search_others(wanted, found):
        return searched(wanted, found, wanted["floor"].to_numpy(), True)

    shape = "q long, vec_id long, score long"
    first = materialize(asked.groupBy("tree").cogroup(trees.groupBy("tree")).applyInPandas(search_own, shape), "own")
    floors = first.groupBy("q").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).select("q", F.col("score").alias("floor"))
    # Blocks of queries of neighbouring trees; a row for each tree passes through the window, not one for each query.
    counts = asked.groupBy("dim", "tree").count()
    so_far = Window.partitionBy("dim").orderBy("tree").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shards = counts.select("tree", F.floor((F.sum("count").over(so_far) - 1) / BLOCK).alias("shard"))
    known = asked.join(shards, "tree").join(floors, "q", "left").select("q", "query_id", "v", "dim", "tree", "shard", F.coalesce("floor", F.lit(NONE)).alias("floor"))
    known = materialize(known, "queries")

    def route(wanted, found):
        """The trees that may hold a better row for some query of the block."""
        names = ["dim", "shard", "tree"]
        if not len(wanted) or not len(found):
            return pd.DataFrame([], columns=names)
        dim, shard = int(wanted["dim"].iloc[0]), int(wanted["shard"].iloc[0])
        may = root_bounds(matrix(wanted["v"].tolist(), dim).astype(float), found) >= wanted["floor"].to_numpy()[:, None]
        may &= wanted["tree"].to_numpy()[:, None] != found["tree"].to_numpy()[None, :]
        return pd.DataFrame([(dim, shard, t) for t in found["tree"][may.any(0)]], columns=names)

    blocks = max(1, -(-trees.count() // BLOCK))
    roots = known.select("dim", "shard").distinct().join(trees.drop("data"), "dim").withColumn("block", F.pmod(F.xxhash64("tree"), F.lit(blocks)).cast("int"))
    roots = roots.select(*[F.col(c).alias(c) for c in roots.columns])  # names of their own for the cogroup
    left = known.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ["dim", "shard", "block"]
    routed = materialize(left.groupBy(*keys).cogroup(roots.groupBy(*keys)).applyInPandas(route, "dim int, shard long, tree string"), "routed")
    units = routed.groupBy("dim", "shard").agg(F.ceil(F.count("*") / UNIT).cast("int").alias("units"))
    units = routed.join(units, ["dim", "shard"]).select("dim", "shard", "tree", F.pmod(F.xxhash64("tree"), F.col("units")).cast("int").alias("unit"))
    units = materialize(units, "units")
    keys = ["dim", "shard", "unit"]
    left = known.join(units.select(*keys).distinct(), ["dim", "shard"])
    right = units.join(trees.drop("dim"), "tree")
    left, right = (x.select(*[F.col(c).alias(c) for c in x.columns]) for x in (left, right))
    rest = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search_others, shape)
    found = first.unionByName(rest).join(asked.select("q", "query_id", "v"), "q")
    if vectors.where("heavy").isEmpty():
        order = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return ranked.select("query_id", "rank", "vec_id", "score")
    light = found.select("query_id", F.concat_ws(",", F.col("v").cast("array<string>")).alias("mark"), "vec_id", "score", F.lit(0).alias("tier"), F.lit(None).cast("binary").alias("big"))
    order = Window.partitionBy("query_id", "mark").orderBy(F.col("tier").desc(), F.col("score").desc(), F.col("big").desc(), "vec_id")
    ranked = light.unionByName(heavy_answers(vectors, queries, k, scale)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("tier") == 0, F.col("score")).alias("score"))
