"""MinHash near-dedup with DartMinHash signatures of weighted word shingles.

Texts with the same words are one node. A node's shingles (five words, weight: how often
it occurs) are weighted elements; hashed darts are thrown at the region below each weight
in order of rank, and each of the signature's coordinates keeps its earliest dart, so two
coordinates agree with the probability of the weighted Jaccard similarity. Bands of
coordinates are joined; similarities of candidates are then computed exactly.

Nothing is expanded into all pairs of a bucket. Every member is compared with the bucket's
hub, and links contract to components. Buckets that still hold several components are cut by
a further band and get a hub for each part. What is then left is done exactly: in every
bucket the members outside its largest component are compared with all members of other
components, in blocks of bounded size, inside the tasks; a row is written only where two
components meet. The rows of all steps grow with the members of buckets. Only the comparisons
of the last step grow with a bucket's outsiders times its members.

A pair at the threshold shares no band with probability (1 - 0.8**7)**44, about 3e-5; a link
that shares one is never lost.

Edge cases: a null id or an empty text takes no part and is a class of its own
(``class_id`` is its doc_id); a text without a word meets its exact copies alone; a text of fewer than five words is one shingle of all its
words; texts are read whole; repeated rows have the same class; an empty table gives no
rows; other columns aren't read by ``near_classes`` and stay as they are in ``dedup``.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import map_texts, materialize, remove, scratch, shared_path

WORDS_A_SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 44, 7
#: Ids that may be broadcast at 8 bytes each; with more, the sides are shuffled.
BROADCAST_IDS = 500_000
#: Rounds in which buckets with several components are cut by a further band.
ROUNDS = 1
#: Members that meet a copy of their hub's shingles in one group, and shingles of a block in the last step.
HUB_ROWS, VOLUME = 1024, 1_000_000
#: Edges that a task contracts, and levels of contraction before star rounds.
EDGES, LEVELS = 50_000, 6

_LOWER = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def words_of(text: str) -> list[bytes]:
    """Lower-cased words: runs of letters, digits and characters beyond ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_LOWER).split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[list[bytes]], memo: dict[bytes, int], size: int = WORDS_A_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of the distinct shingles of each text, in order."""
    import xxhash

    if len(memo) > 400_000:
        memo.clear()
    hashes: list[int] = []
    for words in texts:
        for w in words:
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            hashes.append(h)
    counts = np.array([len(w) for w in texts], np.int64)
    bounds = np.r_[0, np.cumsum(counts)]
    flat = np.array(hashes, np.uint64)
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = owner[: max(0, len(flat) - size + 1)] == owner[size - 1 :] if len(flat) >= size else np.zeros(0, bool)
    h = np.zeros(len(whole), np.uint64)
    for j in range(size):
        h = mixed(h * _A + flat[j : j + len(whole)] + np.uint64(j + 1))
    h, of = h[whole], owner[: len(whole)][whole]
    short = [i for i in range(len(texts)) if 0 < counts[i] < size]
    if short:
        single = np.zeros(len(short), np.uint64)
        for at, i in enumerate(short):
            one = counts[i : i + 1].astype(np.uint64)
            for j in range(bounds[i], bounds[i + 1]):
                one = mixed(one * _A + flat[j : j + 1])
            single[at] = one[0]
        h, of = np.r_[h, single], np.r_[of, short]
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    if not len(h):
        return of, h, np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
    return of[first], h[first], np.diff(np.r_[first, len(h)])


def dart_ranks(of: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """The earliest rank per coordinate, a row of ``k`` for each of ``n`` texts (inf: no element).

    The region of an element is [0, weight) x rank. Its dyadic bands of weight [0, 1),
    [1, 2), [2, 4), ... each have a Poisson process of darts, rate = width, that depends on
    the element and the band alone; a dart beyond the weight misses. Darts up to a
    rank that fills k coordinates likely are made, and more where one stays empty.
    """
    best = np.full((n, k), np.inf)
    if not len(of):
        return best
    weight = weight.astype(float)
    total = np.bincount(of, weight, n)
    parts = [(of, mixed(element * _A), weight, np.zeros(len(of)), np.ones(len(of)))]
    low = 1.0
    while (over := weight > low).any():
        seed = mixed(element[over] * _A + np.full(over.sum(), low).astype(np.uint64) * _B)
        parts.append((of[over], seed, weight[over], np.full(over.sum(), low), np.full(over.sum(), low)))
        low *= 2
    of, seed, weight, low, width = (np.concatenate(x) for x in zip(*parts))
    with np.errstate(divide="ignore"):
        reach = np.where(total > 0, k * (np.log(k) + 2) / np.maximum(total, 1e-300), 0.0)
    live = total > 0
    while live.any():
        rows = np.flatnonzero(live[of])
        area = reach[of[rows]] * width[rows]
        for least, most, block in ((0, 4, 1), (4, 64, 16), (64, np.inf, 256)):
            at = rows[(area >= least) & (area < most)]
            t, m = np.zeros(len(at)), 0
            while len(at):
                number = np.arange(m + 1, m + block + 1, dtype=np.uint64)
                draw = mixed(seed[at][:, None] + number * _C)
                step = -np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / width[at][:, None]
                ranks = np.cumsum(np.column_stack([t, step]), axis=1)[:, 1:]
                t, m = ranks[:, -1], m + block
                within = ranks <= reach[of[at]][:, None]
                other = mixed(draw[within] + _A)
                row = np.nonzero(within)[0]
                place = low[at][row] + (other >> np.uint64(32)).astype(float) * 2.0**-32 * width[at][row]
                hit = place < weight[at][row]
                coordinate = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(k)) >> np.uint64(32)
                np.minimum.at(best, (of[at][row][hit], coordinate[hit].astype(np.int64)), ranks[within][hit])
                on = within[:, -1]
                at, t = at[on], t[on]
        live &= ~np.isfinite(best).all(1)
        reach = np.where(live, reach * 2, reach)
    return best


def band_keys(ranks: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band from the bits of its ranks; equal ranks come from the same dart."""
    bits = np.ascontiguousarray(ranks).view(np.uint64).reshape(len(ranks), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _C, (len(ranks), bands)).copy()
    for j in range(rows):
        key = mixed(key * _A + bits[:, :, j])
    return key.view(np.int64)


def node_of(words: list[bytes]) -> bytes | None:
    """128 bits that name a sequence of words; None without a word."""
    import hashlib

    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def place_of(text: str, words: list[bytes]) -> bytes | None:
    """A text's node; without words the node of its bytes, and none if it is empty."""
    # A word holds no zero byte, so the two kinds don't meet.
    return node_of(words) if words or not text else node_of([b"\0" + text.encode("utf-8", "surrogatepass")])


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (16 bytes, null without text), bands (array of keys, null without words)."""

    def make():
        memo: dict[bytes, int] = {}

        def function(texts):
            words = [words_of(t) for t in texts]
            keys = band_keys(dart_ranks(*shingles(words, memo), len(texts), bands * rows), bands, rows)
            return [[place_of(t, w) for t, w in zip(texts, words)], [k if w else None for k, w in zip(keys, words)]]

        return function

    fields = [T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    return map_texts(docs, ["doc_id"], fields, make)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingle hashes, weights)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum() if len(both) else 0
    return float(least / (a[1].sum() + b[1].sum() - least))


def lists(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column, and where each row's begin and end."""
    column = batch.column(name)
    bounds = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    return (values.view(np.uint64) if values.dtype == np.int64 else values), bounds - bounds[0]


def similarities(hub: tuple[np.ndarray, np.ndarray], h: np.ndarray, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of the sorted shingles of a hub and those of the rows between ``bounds``."""
    at = np.minimum(np.searchsorted(hub[0], h), len(hub[0]) - 1)
    least = np.where(hub[0][at] == h, np.minimum(hub[1][at], w), 0)
    both, own = np.add.reduceat(least, bounds[:-1]), np.add.reduceat(w, bounds[:-1])
    return both / (own + hub[1].sum() - both)


def hub_links(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a: a hub, b: a member) of similarity ``threshold`` or more.

    A hub's shingles go once to each group of about ``HUB_ROWS`` of its members.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_ROWS).cast("int").alias("salts"))
    dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b")
    hubs = many.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("b"))
    rows = hubs.withColumn("part", F.lit(0)).unionByName(dealt.withColumn("part", F.lit(1)))
    rows = rows.join(sets.select(F.col("node").alias("b"), "h", "w"), "b").select("a", "salt", "part", "b", "h", "w")

    def run(batches):
        import pyarrow as pa

        hub, of = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, salt, part, b = (batch.column(c).to_pylist() for c in ("a", "salt", "part", "b"))
            (h, bounds), (w, _) = lists(batch, "h"), lists(batch, "w")
            out, start = [], 0
            while start < len(a):
                if part[start] == 0:
                    low, high = bounds[start], bounds[start + 1]
                    hub, of = (h[low:high].copy(), w[low:high].copy()), (a[start], salt[start])
                    start += 1
                    continue
                stop = start + 1
                while stop < len(a) and part[stop] and (a[stop], salt[stop]) == of:
                    stop += 1
                low, high = bounds[start], bounds[stop]
                found = similarities(hub, h[low:high], w[low:high], bounds[start : stop + 1] - low)
                out += (np.flatnonzero(found >= threshold) + start).tolist()
                start = stop
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in out], pa.binary()), pa.array([b[i] for i in out], pa.binary())], names=["a", "b"])

    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "part").mapInArrow(run, "a binary, b binary")


def contracted(edges: DataFrame) -> DataFrame:
    """The edges (a, b) of each partition as stars (u, v): each node with the smallest of what is connected to it there."""

    def run(batches):
        import pyarrow as pa

        above: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        def stars():
            u = list(above)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array([top(x) for x in u], pa.binary())], names=["u", "v"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = sorted((top(x), top(y)))
                above[y] = x
            if len(above) > 200_000:  # what is held stays bounded; the next level joins the stars
                yield stars()
                above.clear()
        if above:
            yield stars()

    return edges.select("a", "b").mapInArrow(run, "u binary, v binary")


def star_rounds(edges: DataFrame) -> DataFrame:
    """``components`` by large-star and small-star rounds on written tables, till nothing changes."""
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    path, seen = None, None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = large.groupBy("u").agg(F.min("v").alias("m"))  # here v < u
        stars = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = shared_path(spark, "stars")
        stars.where("u <> v").distinct().write.parquet(new)
        now = spark.read.schema("u binary, v binary").parquet(new)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if path:
            remove(spark, path)
        path = new
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def components(edges: DataFrame, level: int = 0) -> DataFrame:
    """node, component (its smallest node) for every node of the edges (a, b).

    Each task turns its edges into stars. A node that several tasks have seen joins their
    centres, which are the edges of the next level and far fewer. Should ``LEVELS`` not
    be enough, star rounds do the rest. A task takes about ``EDGES`` edges.
    """
    count = edges.count()
    grouped = contracted(edges.coalesce(max(1, -(-count // EDGES)))).groupBy("u").agg(F.min("v").alias("m"), F.collect_set("v").alias("centres"))
    roots = materialize(grouped, "roots")
    open_ends = roots.where("size(centres) > 1").select(F.explode("centres").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    open_ends = materialize(open_ends, "ends")
    named = roots.select(F.col("u").alias("node"), "m")
    if open_ends.isEmpty():
        return named.withColumnRenamed("m", "component")
    above = (components(open_ends, level + 1) if level < LEVELS else star_rounds(open_ends)).select(F.col("node").alias("m"), "component")
    return named.join(above, "m", "left").select("node", F.coalesce("component", "m").alias("component"))


def few(df: DataFrame, count: int) -> DataFrame:
    """``df``, broadcast if ``count``, its number of ids, is within the bound."""
    return F.broadcast(df) if count <= BROADCAST_IDS else df


def sets_of(docs: DataFrame, signed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, h (sorted shingle hashes), w (their weights) for each of ``nodes``, from one document's text each."""
    ids = materialize(signed.join(nodes, "node").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "ids")
    chosen = docs.select(docs["doc_id"], docs["text"]).join(few(ids, ids.count()), "doc_id", "left_semi")

    def make():
        memo: dict[bytes, int] = {}

        def function(texts):
            words = [words_of(t) for t in texts]
            of, h, w = shingles(words, memo)
            cuts = np.searchsorted(of, np.arange(1, len(texts)))
            return [[place_of(t, x) for t, x in zip(texts, words)], np.split(h.view(np.int64), cuts), np.split(w.astype(np.int32), cuts)]

        return function

    fields = [T.StructField("node", T.BinaryType()), T.StructField("h", T.ArrayType(T.LongType())), T.StructField("w", T.ArrayType(T.IntegerType()))]
    named = map_texts(chosen, ["doc_id"], fields, make)
    # An id may have several rows; those of other nodes fall out, and of equal ones one stays.
    return named.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("h").alias("h"), F.first("w").alias("w"))


def outside_links(mixed_buckets: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components: in each bucket (key, node, component) members outside its largest component against all.

    A bucket's members are dealt to blocks and its outsiders to chunks of about ``VOLUME``
    shingles. A task reads a chunk and then streams the block; the links it finds are
    written once for each pair of components that they join.
    """
    sized = mixed_buckets.join(sets.select("node", F.size("h").alias("size")), "node")
    parts = sized.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    top = parts.groupBy("key").agg(F.max(F.struct("n", "component", "size")).alias("top"), F.sum("size").alias("size"))
    cuts = top.select(
        "key",
        F.col("top.component").alias("largest"),
        F.ceil(F.col("size") / VOLUME).cast("int").alias("blocks"),
        F.ceil((F.col("size") - F.col("top.size")) / VOLUME).cast("int").alias("chunks"),
    )
    rows = mixed_buckets.join(cuts, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    asking = rows.where("component <> largest").select("key", one("chunks", 1).alias("chunk"), every("blocks").alias("block"), F.lit(0).alias("part"), "node", "component")
    asked = rows.select("key", every("chunks").alias("chunk"), one("blocks", 2).alias("block"), F.lit(1).alias("part"), "node", "component")
    dealt = asking.unionByName(asked).join(sets, "node").select("key", "chunk", "block", "part", "node", "component", "h", "w")

    def run(batches):
        import pyarrow as pa

        now, held, above = None, [], {}

        def top(x: bytes) -> bytes:
            while (y := above.setdefault(x, x)) != x:
                above[x] = x = above[y]
            return x

        def meet(nodes, components, h, w, bounds):
            """Links of the held outsiders with these members that join components."""
            words, place = np.unique(h, return_inverse=True)
            own = np.add.reduceat(w, bounds[:-1])
            found = []
            for node, component, hx, wx in held:
                other = np.array([top(c) != top(component) for c in components])
                if not other.any():
                    continue
                at = np.minimum(np.searchsorted(words, hx), len(words) - 1)
                hit = words[at] == hx
                weight = np.zeros(len(words), w.dtype)
                weight[at[hit]] = wx[hit]
                both = np.add.reduceat(np.minimum(weight[place], w), bounds[:-1])
                near = other & (both / (own + wx.sum() - both) >= threshold)
                for i in np.flatnonzero(near).tolist():
                    x, y = sorted((top(component), top(components[i])))
                    if x != y:
                        above[y] = x
                        found.append((node, nodes[i]))
            return found

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "chunk", "block"))))
            part, node, component = (batch.column(c).to_pylist() for c in ("part", "node", "component"))
            (h, bounds), (w, _) = lists(batch, "h"), lists(batch, "w")
            out, start = [], 0
            while start < len(keys):
                if keys[start] != now:
                    now, held, above = keys[start], [], {}
                if part[start] == 0:
                    low, high = bounds[start], bounds[start + 1]
                    held.append((node[start], component[start], h[low:high].copy(), w[low:high].copy()))
                    start += 1
                    continue
                stop = start + 1
                while stop < len(keys) and keys[stop] == now:
                    stop += 1
                low, high = bounds[start], bounds[stop]
                out += meet(node[start:stop], component[start:stop], h[low:high], w[low:high], bounds[start : stop + 1] - low)
                start = stop
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])

    return dealt.repartition("key", "chunk", "block").sortWithinPartitions("key", "chunk", "block", "part").mapInArrow(run, "a binary, b binary")


def linked_nodes(docs: DataFrame, signed: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """node, component of all nodes with a link.

    A bucket's hub is its member with the most company over all its buckets: of edited copies
    the one nearest to their source.
    """
    nodes = signed.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.first("bands").alias("bands"))
    exploded = nodes.select("node", F.explode("bands").alias("key"))
    counts = exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(exploded.join(counts, "key").select("key", "node", "n"), "members")
    profiles = materialize(nodes.join(members.groupBy("node").agg(F.sum("n").alias("company")), "node"), "profiles")
    company = profiles.select("node", "company")
    sets = materialize(sets_of(docs, signed, company.select("node")), "sets")

    def meetings(placed: DataFrame) -> DataFrame:
        """Pairs (a: a bucket's hub, b: a member of another component), each once, of placed (key, node, component, company)."""
        hubs = placed.groupBy("key").agg(F.max(F.struct("company", "node", "component")).alias("hub"))
        found = placed.join(hubs, "key").where(F.col("component") != F.col("hub.component"))
        return materialize(found.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct(), "pairs")

    def apart(linked: DataFrame | None) -> DataFrame:
        """key, node, component, company of the members of buckets with several components."""
        placed = members.select("key", "node").join(company, "node")
        if linked is None:
            return placed.withColumn("component", F.col("node"))
        placed = placed.join(linked, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"), "company")
        several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        return materialize(placed.join(several, "key", "left_semi"), "apart")

    links = materialize(hub_links(meetings(apart(None)), sets, threshold), "links")
    linked = materialize(components(links), "linked")
    for turn in range(ROUNDS):
        rest = apart(linked)
        if rest.isEmpty():
            return linked
        # A part is what agrees in one more band, another one for each bucket and turn.
        band = F.get("bands", F.pmod(F.xxhash64("key", F.lit(turn)), F.size("bands")).cast("int"))
        cut = rest.join(profiles.select("node", "bands"), "node").select(F.xxhash64("key", band).alias("key"), "node", "component", "company")
        links = links.unionByName(materialize(hub_links(meetings(cut), sets, threshold), "links"))
        linked = materialize(components(links), "linked")
    rest = apart(linked)
    if rest.isEmpty():
        return linked
    more = materialize(outside_links(rest.select("key", "node", "component"), sets, threshold), "links")
    return linked if more.isEmpty() else materialize(components(links.unionByName(more)), "linked")


def placed(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, node, component, class_id (the smallest doc_id of its class), class_size; a row per row of ``docs``."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        signed = keep(materialize(signatures(docs), "signed"))
        linked = keep(linked_nodes(docs, signed, threshold))
    named = signed.select("doc_id", "node").join(linked, "node", "left")
    alone = named.where("node IS NULL OR doc_id IS NULL").select("doc_id", "node", F.lit(None).cast("binary").alias("component"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    rows = named.where("node IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "node", F.coalesce("component", "node").alias("component"))
    classes = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(classes, "component").select("doc_id", "node", "component", "class_id", "class_size").unionByName(alone)


def near_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size; a row per row of ``docs``."""
    return placed(docs, threshold).select("doc_id", "class_id", "class_size")


def dedup(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: one whose id names the class, of several texts with that id the smallest node.

    Rows with a null id stay. Where several rows have an id without text, one of them stays.
    """
    with scratch(docs.sparkSession) as keep:
        classes = keep(materialize(placed(docs, threshold).drop("class_size"), "classes"))
    gone = classes.where("doc_id <> class_id").select("doc_id").distinct()
    twice = classes.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    count = twice.count()
    if not count:
        return docs.join(few(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    twice = materialize(twice, "twice")
    once = docs.join(few(twice, count), "doc_id", "left_anti").join(few(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
    # An id with several rows doesn't tell which of them stays; its text does.
    rows = docs.join(few(twice, count), "doc_id", "left_semi").select(*docs.columns)
    rows = map_texts(rows, docs.columns, [T.StructField("__node", T.BinaryType())], lambda: lambda texts: [[place_of(t, words_of(t)) for t in texts]])
    stay = classes.where("doc_id = class_id").join(few(twice, count), "doc_id", "left_semi").groupBy("doc_id", "component").agg(F.min("node").alias("node"))
    stay = stay.select(F.col("doc_id").alias("__id"), F.col("node").alias("__stays"))
    rows = rows.join(stay, (F.col("doc_id") == F.col("__id")) & F.col("__node").eqNullSafe(F.col("__stays")), "left_semi")
    return once.unionByName(rows.dropDuplicates(["doc_id", "__node"]).select(*docs.columns))
