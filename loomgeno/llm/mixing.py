"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; the bucket in which a source's budget ends is split further, level by
level, until the threshold is exact; a document is then taken by comparing its own hash with its source's threshold.
Nothing is sorted, and thresholds are nested: a larger budget takes a superset.

Defined cases: null or blank text has size 0 and takes nothing; a null source is one source, last in order; rows that
are alike in id and text share a hash and are taken together; an empty table gives an empty result; other columns,
whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgeno.llm.common import drop_table, global_rank, join_small, materialize, n_words

#: Levels of the histogram: their bits add up to the 63 bits of the hash.
LEVELS = (13, 13, 13, 12, 12)


def order_hash(id_col: str, text_col: str) -> Column:
    """63-bit place of a row in its source's order."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col)), 1)


def targets(sources: DataFrame, weights: tuple[int, ...], ratio: float, repeat: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights by rank, `ratio` of all words shared, no target
    above `repeat` times its source. Each round is one aggregate; only two sums come to the driver."""
    ranked = global_rank(sources, [F.col("source").isNull(), F.col("source").asc()])
    at = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        at = F.when(F.col("rank") % len(weights) == i, w).otherwise(at)
    ranked = materialize(ranked.withColumn("w", at.cast("double")).withColumn("cap", (F.col("source_size") * repeat).cast("double")).drop("rank"), "weights")
    total, weight = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    budget = ratio * (total or 0)
    level, capped = (budget / weight if weight else 0.0), -1
    while True:
        # Sources filled at this level stay filled at any higher one.
        n, used, rest = ranked.agg(F.count(F.when(F.col("cap") <= F.col("w") * level, 1)), F.sum(F.when(F.col("cap") <= F.col("w") * level, F.col("cap"))), F.sum(F.when(F.col("cap") > F.col("w") * level, F.col("w")))).first()
        if n == capped or not rest:
            break
        level, capped = (budget - (used or 0.0)) / rest, n
    return ranked.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def thresholds(narrow: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, whole, below, target, source_size): every row of the source is taken `whole` times, rows with a hash
    under `below` once more. narrow has (source, h, size)."""
    state = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    state = state.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    tables = [state := materialize(state, "state")]
    done = [state.where("left <= 0").select("source", "source_size", "target", "whole", F.lit(0).cast("long").alias("below"))]
    state = state.where("left > 0")
    used = 0
    for bits in LEVELS:
        used += bits
        open_ = state.withColumnRenamed("source", "s").select("s", "prefix")
        rows = narrow.join(open_, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", 63 - used + bits) == F.col("prefix")))
        hist = rows.groupBy("source", F.shiftright("h", 63 - used).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("h0"), F.max("h").alias("h1"))
        # At most 2^bits buckets for a source, so the window is bounded.
        w = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("words").over(w))
        s = state.withColumnsRenamed({"source": "s"})
        cut = hist.join(s, F.col("source").eqNullSafe(F.col("s"))).where(F.col("upto") > F.col("left"))
        cut = cut.groupBy("s").agg(F.min_by(F.struct("bucket", "words", "upto", "h0", "h1"), "bucket").alias("c"))
        found = s.join(cut.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
        found = materialize(found, "cut")
        tables.append(found)
        # No bucket goes beyond the budget: the whole prefix is taken.
        end = F.shiftleft(F.col("prefix") + 1, 63 - used + bits)
        if used == bits:
            end = F.lit((1 << 63) - 1)
        keep = ["s as source", "source_size", "target", "whole"]
        done.append(found.where("c is null").withColumn("below", end.cast("long")).selectExpr(*keep, "below"))
        # One hash value alone in the bucket: in, if that brings the sum nearer.
        over, under = F.col("c.upto") - F.col("left"), F.col("left") - (F.col("c.upto") - F.col("c.words"))
        one = found.where("c.h0 = c.h1").withColumn("below", F.when(over < under, F.col("c.h1") + 1).otherwise(F.col("c.h0")))
        done.append(one.selectExpr(*keep, "below"))
        state = found.where("c.h0 < c.h1").select(F.col("s").alias("source"), "source_size", "target", "whole", under.alias("left"), F.col("c.bucket").alias("prefix"))
        if state.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = materialize(out, "thresholds")
    for t in tables:
        drop_table(t)
    return out


def plan_mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), ratio: float = 1.5, repeat: int = 2) -> tuple[DataFrame, DataFrame, int]:
    """(narrow, thresholds, number of sources); narrow: id, source, size, h of every row."""
    narrow = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), order_hash(id_col, text_col).alias("h")), "narrow")
    sources = materialize(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    cuts = thresholds(narrow, targets(sources, weights, ratio, repeat))
    return narrow, cuts, sources.count()


def copies() -> Column:
    """How often a row is taken, given its source's thresholds."""
    return F.col("whole") + (F.col("h") < F.col("below")).cast("long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """For each row: doc_id, size, source_size, target, taken (words, repeats counted), copies."""
    narrow, cuts, n = plan_mix(docs, **options)
    out = join_small(narrow, cuts, "source", n)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"), copies().alias("copies"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: docs' own columns, each row as often as it is taken."""
    _, cuts, n = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    cuts = cuts.select("source", "whole", "below")
    mine = docs.select(F.col(source_col).alias("source"), order_hash(id_col, text_col).alias("h"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    out = join_small(mine, cuts, "source", n).withColumn("times", copies().cast("int")).where("times > 0")
    out = out.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("times"))))
    return out.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
