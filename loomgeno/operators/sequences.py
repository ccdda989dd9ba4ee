"""Ordered operators: segments, jump paths, recombination counts, peaks, spacing, nearest neighbours, top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(key, value, first, last, n): runs of equal consecutive values; null equals null."""
    w = Window.partitionBy(key).orderBy(t)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | F.lag(F.lit(1)).over(w).isNull()
    runs = df.withColumn("__c", change.cast("int")).withColumn("__r", F.sum("__c").over(w))
    return runs.groupBy(key, "__r").agg(F.first(value).alias(value), F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n")).drop("__r")


def jump_paths(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(key, path): `start-state-start-state-...-end`, the end one beyond the last step."""
    s = segments(df, key, t, value)
    steps = F.transform(F.sort_array(F.collect_list(F.struct("first", value))), lambda x: F.concat_ws("-", x["first"], F.coalesce(x[value].cast("string"), F.lit("NA"))))
    return s.groupBy(key).agg(F.concat_ws("-", F.concat_ws("-", steps), (F.max("last") + 1).cast("string")).alias("path"))


def states_of_path(paths: DataFrame, key: str, path: str = "path") -> DataFrame:
    """(key, t, state): the inverse of jump_paths()."""
    p = F.split(path, "-")
    n = (F.size(p) - 1) / 2
    runs = F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(F.get(p, 2 * i).cast("long").alias("a"), F.get(p, 2 * i + 1).alias("state"), F.get(p, 2 * i + 2).cast("long").alias("b")))
    out = paths.select(key, F.explode(runs).alias("r"))
    return out.select(key, F.explode(F.sequence(F.col("r.a"), F.col("r.b") - 1)).alias("t"), F.col("r.state").alias("state"))


def recombinations(df: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(key, n): changes of state along each key, nulls skipped."""
    seen = df.where(F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(t)
    moved = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("long"), F.lit(0))
    return seen.withColumn("__m", moved).groupBy(key).agg(F.sum("__m").alias("n"))


def distances(markers: DataFrame) -> DataFrame:
    """markers(lg, marker, pos in cM): adds `morgan`, the distance to the next marker, null at a group's end."""
    w = Window.partitionBy("lg").orderBy("pos", "marker")
    return markers.withColumn("morgan", (F.lead("pos").over(w) - F.col("pos")) * 0.01)


def close_runs(markers: DataFrame, eps: float) -> DataFrame:
    """(lg, run, n, first, last): runs of markers within eps of the one before."""
    w = Window.partitionBy("lg").orderBy("pos", "marker")
    new = F.coalesce((F.col("pos") - F.lag("pos").over(w) > eps).cast("int"), F.lit(1))
    out = markers.withColumn("__n", new).withColumn("run", F.sum("__n").over(w))
    return out.groupBy("lg", "run").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def contiguous(states: DataFrame, positions: DataFrame) -> DataFrame:
    """states(ind, lg, t, state), positions(lg, t, pos): (ind, lg, state, start, stop) segments; a boundary lies midway
    between the markers around it."""
    j = states.join(positions, ["lg", "t"])
    w = Window.partitionBy("ind", "lg").orderBy("t")
    j = j.withColumn("prev", F.lag("pos").over(w)).withColumn("next", F.lead("pos").over(w))
    change = (~F.col("state").eqNullSafe(F.lag("state").over(w))) | F.lag(F.lit(1)).over(w).isNull()
    j = j.withColumn("__c", change.cast("int")).withColumn("run", F.sum("__c").over(w))
    return j.groupBy("ind", "lg", "run").agg(F.first("state").alias("state"), F.min(F.coalesce((F.col("pos") + F.col("prev")) / 2, F.col("pos"))).alias("start"), F.max(F.coalesce((F.col("pos") + F.col("next")) / 2, F.col("pos"))).alias("stop")).drop("run")


def at_positions(segments_: DataFrame, points: DataFrame) -> DataFrame:
    """Piecewise-constant lookup: segments(lg, start, state), points(lg, id, at) -> state of the last start at or before."""
    s = segments_.select("lg", F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("start", "state").alias("s"), F.lit(None).cast("long").alias("id"))
    p = points.select("lg", "at", F.lit(1).alias("kind"), F.lit(None).cast(s.schema["s"].dataType).alias("s"), F.col("id").cast("long").alias("id"))
    w = Window.partitionBy("lg").orderBy("at", "kind", "s", "id").rowsBetween(Window.unboundedPreceding, 0)
    return s.unionByName(p).withColumn("s", F.last("s", ignorenulls=True).over(w)).where("kind = 1").select("lg", "id", "at", F.col("s.state").alias("state"))


def reversed_distances(markers: DataFrame) -> DataFrame:
    """The same markers in the other direction, positions measured from the end."""
    end = F.max("pos").over(Window.partitionBy("lg"))
    w = Window.partitionBy("lg").orderBy(F.desc("pos"), F.desc("marker"))
    return markers.select("lg", "marker", (end - F.col("pos")).alias("pos"), F.row_number().over(w).alias("nth"))


def peaks(scan: DataFrame, share: float = 0.95) -> DataFrame:
    """scan(lg, marker, pos, lod): by group, the first marker of greatest LOD, and the interval that holds `share` of the
    normalised mass of 10^LOD times the marker's width, one marker wider on either side."""
    w = Window.partitionBy("lg").orderBy("pos", "marker")
    top = F.max("lod").over(Window.partitionBy("lg"))
    width = (F.coalesce(F.lead("pos").over(w), F.col("pos")) - F.coalesce(F.lag("pos").over(w), F.col("pos"))) / 2
    s = scan.withColumn("m", width * F.pow(F.lit(10.0), F.col("lod") - top)).withColumn("nth", F.row_number().over(w))
    s = s.withColumn("cum", F.sum("m").over(w) / F.sum("m").over(Window.partitionBy("lg")))
    tail = (1 - share) / 2
    return s.groupBy("lg").agg(
        F.min_by("marker", F.struct(-F.col("lod"), "nth")).alias("peak"), F.max("lod").alias("lod"), F.max(F.when(F.col("cum") < tail, F.col("nth"))).alias("lo"), F.min(F.when(F.col("cum") > 1 - tail, F.col("nth"))).alias("hi"), F.max("nth").alias("n"),
    ).select("lg", "peak", "lod", F.greatest(F.coalesce("lo", F.lit(1)), F.lit(1)).alias("first"), F.least(F.coalesce(F.col("hi") + 1, F.col("n")), F.col("n")).alias("last"))


def nearest(pairs: DataFrame, k: int, always: float) -> DataFrame:
    """pairs(a, b, v): each row's k largest values, and all of at least `always`, made symmetric by the larger."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "v")).where("a <> b")
    rn = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("v"), "b"))
    kept = both.withColumn("__n", rn).where((F.col("__n") <= k) | (F.col("v") >= always)).drop("__n")
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "v").groupBy("a", "b").agg(F.max("v").alias("v"))


def neighbour_lists(pairs: DataFrame, k: int) -> DataFrame:
    """(marker, neighbours): ids of the k largest values, best first, joined by ||."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "v")).where("a <> b")
    rn = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("v"), "b"))
    return both.withColumn("n", rn).where(F.col("n") <= k).groupBy(F.col("a").alias("marker")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", F.col("b").cast("string").alias("b")))), lambda x: x["b"]), "||").alias("neighbours"))


#: A similarity of row ids with column ids: arrays (rows x 1) and (1 x columns) to values (rows x columns), symmetric.
Similarity = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Values held at once while rows meet all columns.
VALUES = 1 << 21


def _rows_of(ids: DataFrame, similarity: Similarity, k: int, always: float, links: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame], schema: str, later: bool = False) -> DataFrame:
    """ids(id), distinct longs: each row's similarities to all ids, some rows and columns at a time. What stays of a row are its k largest
    values, the first id of equals, and those of at least `always`; NaN is no value. With `later`, only ids from the row's on are met. The ids alone go to every task; no pair is a row
    of a table before it is kept."""
    every = np.sort(np.array([r[0] for r in ids.select(F.col("id").cast("long")).distinct().collect()], dtype=np.int64))
    spark = ids.sparkSession
    shared = spark.sparkContext.broadcast(every)
    step = max(1, min(64, VALUES // max(1, len(every))))
    columns = max(1, VALUES // step)
    tasks = max(1, min(len(every), max(64, len(every) * len(every) // 200_000_000)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        for b in batches:
            for part in b["id"]:
                mine = x[part::tasks]
                for at in range(0, len(mine), step):
                    a = mine[at : at + step]
                    top = [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)]
                    for lo in range(int(np.searchsorted(x, a[0])) if later else 0, len(x), columns):
                        c = x[lo : lo + columns]
                        v = similarity(a[:, None], c[None, :])
                        v = np.where((a[:, None] == c[None, :]) | np.isnan(v), -np.inf, v)
                        least = np.partition(v, -k, axis=1)[:, -k][:, None] if 0 < k < len(c) else np.full((len(a), 1), -np.inf if k else np.inf)
                        r, j = np.nonzero((v > -np.inf) & ((v >= least) | (v >= always)))
                        top = [np.concatenate(z) for z in zip(top, (r, c[j], v[r, j]))]
                        order = np.lexsort((top[1], -top[2], top[0]))
                        top = [z[order] for z in top]
                        n = np.arange(len(top[0])) - np.searchsorted(top[0], top[0]) + 1
                        top = [z[(n <= k) | (top[2] >= always)] for z in top]
                    n = np.arange(len(top[0])) - np.searchsorted(top[0], top[0]) + 1
                    yield links(a[top[0]], top[1], top[2], n)

    return spark.range(0, tasks, 1, tasks).mapInPandas(run, schema)


def nearest_of(ids: DataFrame, similarity: Similarity, k: int, always: float) -> DataFrame:
    """nearest() of all pairs of ids(id) by a similarity, without a row a pair. A pair of at least `always` is given by its lesser id."""

    def links(a: np.ndarray, b: np.ndarray, v: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "v": v})

    def once(a: np.ndarray, b: np.ndarray, v: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return links(*(x[a < b] for x in (a, b, v, n)))

    schema = "a long, b long, v double"
    # Both ends may have chosen a pair below `always`; those above are many and are taken in a pass of their own, so they aren't shuffled.
    return _rows_of(ids, similarity, 0, always, once, schema, True).unionByName(_rows_of(ids, similarity, k, np.inf, links, schema).where(F.col("v") < always).distinct())


def neighbour_lists_of(ids: DataFrame, similarity: Similarity, k: int) -> DataFrame:
    """neighbour_lists() of all pairs of ids(id) by a similarity, without a row a pair."""

    def links(a: np.ndarray, b: np.ndarray, v: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        first = np.flatnonzero(n == 1)
        return pd.DataFrame({"marker": a[first], "neighbours": ["||".join(map(str, x)) for x in np.split(b, first[1:])] if len(first) else []})

    return _rows_of(ids, similarity, k, np.inf, links, "marker long, neighbours string")


def ancestry_call(post: DataFrame, keys: list[str], least: float) -> DataFrame:
    """post(keys, state, prob): the most likely state, the first of equals, if its probability exceeds `least`."""
    return post.groupBy(*keys).agg(F.min_by(F.struct("state", "prob"), F.struct(-F.col("prob"), F.col("state"))).alias("b")).select(*keys, F.when(F.col("b.prob") > least, F.col("b.state")).alias("state"), F.col("b.prob").alias("prob"))


def array_call(probs: Column, least: float) -> tuple[Column, Column]:
    """(state, prob) of ancestry_call() where a row holds the probabilities of states 1, 2, ... as an array: nothing is grouped."""
    best = F.array_max(F.transform(probs, lambda p, i: F.struct(p.alias("prob"), (-1 - i).alias("back"))))
    return F.when(best["prob"] > least, -best["back"]), best["prob"]


def bins(markers: DataFrame, width: float) -> DataFrame:
    """markers(lg, marker, pos, miss): bins start at a marker and hold those within `width` of the start; the representative is
    the one with least missing, the first of equals. Where a bin starts depends on the last, so this runs group by group."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "marker"])
        out, start, nth = [], None, 0
        for p in pdf.pos:
            if start is None or p - start > width:
                start, nth = p, nth + 1
            out.append(nth)
        return pdf.assign(bin=out)

    kind = markers.schema["marker"].dataType.simpleString()
    b = markers.select("lg", "marker", "pos", "miss").groupBy("lg").applyInPandas(run, f"lg string, marker {kind}, pos double, miss double, bin long")
    return b.groupBy("lg", "bin").agg(F.min_by("marker", F.struct("miss", "pos", "marker")).alias("representative"), F.count("*").alias("n"), F.min("pos").alias("pos"))


def phase_switches(df: DataFrame) -> DataFrame:
    """df(ind, t, truth, est) of phased genotypes a|b: over sites heterozygous in truth and agreeing in alleles, sites, and
    changes of orientation."""
    het = df.where((F.substring("truth", 1, 1) != F.substring("truth", 3, 1)) & ((F.col("est") == F.col("truth")) | (F.col("est") == F.reverse("truth"))))
    w = Window.partitionBy("ind").orderBy("t")
    same = F.col("est") == F.col("truth")
    het = het.withColumn("o", same.cast("int")).withColumn("s", F.coalesce((F.col("o") != F.lag("o").over(w)).cast("long"), F.lit(0)))
    return het.groupBy("ind").agg(F.count("*").alias("sites"), F.sum("s").alias("switches"))


def sort_markers(markers: DataFrame, position: str = "pos") -> DataFrame:
    """Markers by group and position; left as they are if any position is missing."""
    if not markers.where(F.col(position).isNull()).isEmpty():
        return markers
    return markers.orderBy("lg", position, "marker")


def span(pos: Column) -> Column:
    return F.max(pos) - F.min(pos)
