"""Merges, as-of lookups, set relations, pedigree closures and accuracy joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgeno.operators.graph import checkpoint


def merge_calls(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer merge of (marker, ind, ref, alt, gt): equal cells stay, a swapped REF/ALT pair is flipped, conflicting or
    mismatching cells become `.`. One shuffle join on (marker, ind)."""
    y = b.select(*[F.col(c).alias(f"__{c}") for c in ("marker", "ind", "ref", "alt", "gt")])
    j = a.join(y, (F.col("marker") == F.col("__marker")) & (F.col("ind") == F.col("__ind")), "full_outer")
    swapped = (F.col("ref") == F.col("__alt")) & (F.col("alt") == F.col("__ref"))
    same = (F.col("ref") == F.col("__ref")) & (F.col("alt") == F.col("__alt"))
    other = F.when(swapped, F.translate("__gt", "01", "10")).when(same | F.col("ref").isNull(), F.col("__gt")).otherwise(F.lit("."))
    gt = F.when(F.col("gt").isNull(), F.col("__gt")).when(F.col("__gt").isNull(), F.col("gt")).when(F.col("gt") == other, F.col("gt")).when(F.col("gt") == ".", other).when((other == ".") & (swapped | same), F.col("gt")).otherwise(".")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"__{c}")).alias(c)
    return j.select(pick("marker"), pick("ind"), pick("ref"), pick("alt"), gt.alias("gt"))


def reset_map(geno: DataFrame, positions: DataFrame) -> DataFrame:
    """geno's markers that the map has, with the map's group and position."""
    return geno.drop("lg", "pos").join(positions.select("marker", "lg", "pos"), "marker")


def neighbours(points: DataFrame, markers: DataFrame) -> DataFrame:
    """points(lg, id, at), markers(lg, marker, pos): nearest marker at or left of each point, and strictly right of it. Of markers
    at one place, the last is left of what follows and the first right of what comes before.

    Both are sorted once into ranges of (group, position), so a group may fill any number of tasks, and filled from either side by
    running windows over a range; what a range lacks comes from the last marker before it or the first one after it, which are
    carried along as one row a range."""
    kind, place = points.schema["id"].dataType, points.schema["at"].dataType
    m = markers.select("lg", F.col("pos").cast(place).alias("at"), F.lit(0).alias("kind"), F.struct("pos", "marker").alias("m"), F.lit(None).cast(kind).alias("id"))
    p = points.select("lg", "at", F.lit(1).alias("kind"), F.lit(None).cast(m.schema["m"].dataType).alias("m"), "id")
    order = ["lg", "at", "kind", "m", "id"]
    both = checkpoint(m.unionByName(p).repartitionByRange(*[F.col(c) for c in order]).withColumn("r", F.spark_partition_id()))
    w = Window.partitionBy("r", "lg").rowsBetween(Window.unboundedPreceding, 0)
    left = F.last("m", ignorenulls=True).over(w.orderBy(*order[1:]))
    right = F.last("m", ignorenulls=True).over(w.orderBy(*[F.desc(c) for c in order[1:]]))
    filled = both.withColumn("l", left).withColumn("g", right).where("kind = 1")
    # One row for each range and group: what lies before and after it. At most a row a task and a row a group.
    ends = both.groupBy("r", "lg").agg(F.min("m").alias("lo"), F.max("m").alias("hi"))
    e = Window.partitionBy("lg").rowsBetween(Window.unboundedPreceding, -1)
    before, after = F.last("hi", ignorenulls=True).over(e.orderBy("r")), F.last("lo", ignorenulls=True).over(e.orderBy(F.desc("r")))
    ends = ends.select(F.col("r").alias("er"), F.col("lg").alias("elg"), before.alias("before"), after.alias("after"))
    out = filled.join(ends, (F.col("r") == F.col("er")) & F.col("lg").eqNullSafe(F.col("elg")))
    return out.select("lg", "id", "at", F.coalesce("l", "before")["marker"].alias("left"), F.coalesce("g", "after")["marker"].alias("right"))


def match_groups(a: DataFrame, b: DataFrame, least_share: float = 0.1, least_shared: int = 5) -> DataFrame:
    """(lga, lgb, shared, share, best): groups of map a against those of b by shared markers; best is the largest, then first."""
    c = a.select("marker", F.col("lg").alias("lga")).join(b.select("marker", F.col("lg").alias("lgb")), "marker").groupBy("lga", "lgb").agg(F.count("*").alias("shared"))
    c = c.withColumn("share", F.col("shared") / F.sum("shared").over(Window.partitionBy("lga")))
    best = F.row_number().over(Window.partitionBy("lga").orderBy(F.desc("shared"), "lgb")) == 1
    return c.withColumn("best", best).where(F.col("best") | ((F.col("share") >= least_share) & (F.col("shared") > least_shared)))


def set_relations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): common, left or right of two id sets."""
    x, y = a.select(F.col(key).alias("k")).distinct(), b.select(F.col(key).alias("__k")).distinct()
    side = F.when(F.col("__k").isNull(), "left").when(F.col("k").isNull(), "right").otherwise("common")
    return x.join(y, F.col("k") == F.col("__k"), "full_outer").select(F.coalesce("k", "__k").alias(key), side.alias("side"))


def ancestors(ped: DataFrame, members: DataFrame, most: int = 64) -> DataFrame:
    """(member, ancestor): the members themselves and all above them; founders' parent 0 is nobody. Each generation is one
    join of the last one's pairs, that is those at one distance; pairs met at several are put together at the end, once."""
    edges = checkpoint(ped.select(F.col("member").alias("child"), F.explode(F.array("mother", "father")).alias("parent")).where("parent <> 0").distinct())
    new = members.select("member", F.col("member").alias("ancestor")).distinct()
    found = [new]
    for _ in range(most):
        new = checkpoint(new.join(edges.hint("shuffle_hash"), new["ancestor"] == edges["child"]).select("member", F.col("parent").alias("ancestor")).distinct())
        if new.isEmpty():
            return reduce(DataFrame.unionByName, found).distinct()
        found.append(new)
    raise RuntimeError("pedigree deeper than expected, or cyclic")


def generations(ped: DataFrame, most: int = 64) -> DataFrame:
    """(member, generation): founders 0, others one more than their later parent, which is the longest line down from a founder.
    Each step is one join of the last generation's members with their children; a member may be met in several steps, the last of
    which counts."""
    edges = checkpoint(ped.select(F.col("member").alias("child"), F.explode(F.array("mother", "father")).alias("parent")).where("parent <> 0").distinct())
    now = checkpoint(ped.where("mother = 0 and father = 0").select("member").distinct())
    met = []
    for k in range(most):
        met.append(now.withColumn("generation", F.lit(k)))
        # Both grow with the pedigree, so neither is broadcast.
        now = checkpoint(now.join(edges.hint("merge"), now["member"] == edges["parent"]).select(F.col("child").alias("member")).distinct())
        if now.isEmpty():
            out = met[0]
            for m in met[1:]:
                out = out.unionByName(m)
            return out.groupBy("member").agg(F.max("generation").alias("generation"))
    raise RuntimeError("pedigree deeper than expected, or cyclic")


def adjacency(lists: DataFrame, sep: str = "||") -> DataFrame:
    """lists(marker, neighbours text): symmetric pairs (a, b)."""
    out = lists.select(F.col("marker").cast("string").alias("a"), F.explode(F.split("neighbours", sep.replace("|", "\\|"))).alias("b")).where("b <> ''")
    return out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def expand_bins(bins: DataFrame, sep: str = "||") -> DataFrame:
    """bins(representative, lg, pos, members text): a row a member."""
    return bins.select("representative", "lg", "pos", F.explode(F.split("members", sep.replace("|", "\\|"))).alias("marker"))


def imputation_accuracy(truth: DataFrame, est: DataFrame, masked: Column) -> DataFrame:
    """truth, est (marker, ind, pop, gt): by pop, masked cells, share still missing, share right among the imputed."""
    t = truth.where(masked).select("marker", "ind", "pop", F.col("gt").alias("t"))
    j = t.join(est.select("marker", "ind", F.col("gt").alias("e")), ["marker", "ind"], "left")
    imputed = F.coalesce(~F.col("e").contains("N"), F.lit(False))
    out = j.groupBy("pop").agg(F.count("*").alias("n"), F.sum(imputed.cast("long")).alias("imputed"), F.sum((imputed & (F.col("e") == F.col("t"))).cast("long")).alias("right"))
    return out.select("pop", "n", ((F.col("n") - F.col("imputed")) / F.col("n")).alias("missing"), F.when(F.col("imputed") > 0, F.col("right") / F.col("imputed")).alias("accuracy"))


def map_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (pairs_a, pairs_b, both, f1, only_a, only_b): agreement of two groupings by pair counts, from the contingency
    of groups, so no pair of markers is formed."""
    c = a.select("marker", F.col("lg").alias("x")).join(b.select("marker", F.col("lg").alias("y")), "marker").groupBy("x", "y").agg(F.count("*").alias("n"))
    pairs = lambda n: n * (n - 1) / 2
    cells = c.agg(F.sum(pairs(F.col("n"))).alias("both"))
    rows = c.groupBy("x").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("pairs_a"))
    cols = c.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("pairs_b"))
    only = set_relations(a, b, "marker").agg(F.sum((F.col("side") == "left").cast("long")).alias("only_a"), F.sum((F.col("side") == "right").cast("long")).alias("only_b"))
    one = cells.withColumn("k", F.lit(1))
    for part in (rows, cols, only):
        one = one.join(part.withColumn("k", F.lit(1)), "k")
    return one.select("pairs_a", "pairs_b", "both", (2 * F.col("both") / (F.col("pairs_a") + F.col("pairs_b"))).alias("f1"), "only_a", "only_b")


def order_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(lga, lgb, n, tau): Kendall's tau of marker order in matched groups. Inversions are counted by merging in numpy, one
    pair of groups a task, n log n."""
    import numpy as np
    import pandas as pd

    best = match_groups(a, b, 2.0).where("best").select("lga", "lgb")
    j = a.select("marker", F.col("lg").alias("lga"), F.col("pos").alias("pa")).join(b.select("marker", F.col("lg").alias("lgb"), F.col("pos").alias("pb")), "marker").join(best, ["lga", "lgb"])

    def tau(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pa", "marker"])
        rank = pdf.pb.rank(method="first").to_numpy().astype(np.int64)
        n, bad, width = len(rank), 0, 1
        x = rank.copy()
        while width < n:
            for lo in range(0, n, 2 * width):
                left, right = x[lo : lo + width], x[lo + width : lo + 2 * width]
                if len(right):
                    bad += int((len(left) - np.searchsorted(left, right)).sum())
                    x[lo : lo + 2 * width] = np.sort(np.concatenate([left, right]))
            width *= 2
        return pd.DataFrame({"lga": [pdf.lga.iloc[0]], "lgb": [pdf.lgb.iloc[0]], "n": [n], "tau": [1 - 4 * bad / (n * (n - 1)) if n > 1 else None]})

    return j.groupBy("lga", "lgb").applyInPandas(tau, "lga string, lgb string, n long, tau double")
