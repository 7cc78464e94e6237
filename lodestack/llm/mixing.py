"""Mixing sources to target weights, with DataFrame functions alone.

Sizes are added up per source, targets follow from weights by water-filling, and a
source's repetition rate is target over size. A document is taken floor(rate) times,
and once more if the hash of its id and the seed falls below the rate's fraction.

Edge cases: a null text has size 0 and a source of size 0 has target 0; the null source
is a source of its own and comes last; rows with the same doc_id in a source fall alike; an
empty table gives no rows; other columns, also ones named as those made here, stay as they are in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import materialize, scratch

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE_PERCENT, MOST = (5, 2, 1), 150, 2
SEED = "mix-1"
#: Sources that may be broadcast, one row each; with more, both sides are shuffled.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def ranged(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each name of ``sums``, the sum of its column over all rows before in ``order``.

    Rows are dealt to tasks by ranges of the order and written; each task adds up its own, and the sums of
    the tasks before it, one row a task, are added.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranged")
    parts = dealt.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__{n}") for n in sums])
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()])
    joined = own.join(F.broadcast(parts), "__part")
    return joined.select(*rows.columns, *[(F.col(n) + F.col(f"__{n}")).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST) -> DataFrame:
    """source, source_size, target for each source of ``sizes`` (columns source, size).

    A target is min(most * size, level * weight) with the level at which the targets
    add up to the share. In order of most * size / weight, a source stops at its limit
    exactly if the level left for it and those after it isn't below that ratio.
    Sources are ranked and added up in ranges, so any number of them spreads over tasks; the totals
    and the level's two numbers are all that the driver gets.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__place") % len(weights) + 1).cast("int"))
    weighed = ranged(by_source, [named], {"__place": F.lit(1)}).withColumn("__weight", weight).drop("__place")
    weighed = weighed.withColumn("__limit", F.lit(float(most)) * F.col("source_size")).withColumn("__ratio", F.col("__limit") / F.col("__weight"))
    filled = ranged(weighed, [F.col("__ratio").asc_nulls_last(), named], {"__limits": F.col("__limit"), "__earlier": F.col("__weight")})
    filled = materialize(filled, "filled")
    total = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"), F.coalesce(F.sum("__weight"), F.lit(0.0)).alias("weight")).first()
    left, rest = F.lit(total["size"] * (share_percent / 100)) - F.col("__limits"), F.lit(total["weight"]) - F.col("__earlier")
    filled = filled.withColumn("__left", left).withColumn("__weights", rest)
    filled = filled.withColumn("__capped", F.col("__left") * F.col("__weight") >= F.col("__limit") * F.col("__weights"))
    level = filled.where(~F.col("__capped")).agg(F.min(F.struct("__ratio", F.col("source").isNull().alias("none"), "source", "__left", "__weights")).alias("open")).first()["open"]
    open_left, open_weights = (level["__left"], level["__weights"]) if level else (0.0, 1.0)
    target = F.when(F.col("__capped"), F.col("__limit")).otherwise(F.lit(open_left) * F.col("__weight") / F.lit(open_weights))
    return filled.select("source", "source_size", target.alias("target"))


def chance(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone: 48 bits of SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(2**48)


def _small(goals: DataFrame) -> DataFrame:
    """``goals``, a written table, broadcast if there are few enough sources."""
    return F.broadcast(goals) if goals.count() <= BROADCAST_SOURCES else goals


def _copies(seed: str) -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (F.floor(rate) + (chance(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mix_report(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies, a row per row of ``docs``.

    The sizes are written once to the shared folder, so texts are read once.
    """
    with scratch(docs.sparkSession) as keep:
        sized = keep(materialize(docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size")), "mix"))
        goals = keep(materialize(targets(sized), "goals"))
    goals = _small(goals)
    joined = sized.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")))
    flat = joined.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target").withColumn("copies", _copies(seed))
    return flat.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    sized = docs.select(docs["source"], word_count(docs["text"]).alias("size"))
    with scratch(docs.sparkSession) as keep:
        goals = keep(materialize(targets(sized).select(F.col("source").alias("__ls_source"), F.col("source_size").alias("__ls_size"), F.col("target").alias("__ls_target")), "goals"))
    goals = _small(goals)
    joined = docs.join(goals, docs["source"].eqNullSafe(F.col("__ls_source")))
    rate = F.when(F.col("__ls_size") > 0, F.col("__ls_target") / F.col("__ls_size")).otherwise(0.0)
    copies = (F.floor(rate) + (chance(docs["doc_id"], seed) < rate - F.floor(rate)).cast("long")).cast("int")
    kept = joined.withColumn("__ls_copies", copies).where(F.col("__ls_copies") > 0)
    return kept.withColumn("__ls_copy", F.explode(F.sequence(F.lit(1), F.col("__ls_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
