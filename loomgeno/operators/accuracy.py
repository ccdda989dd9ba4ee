"""Agreement of estimated founders, ancestries and genotypes with truth, and map end trimming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_founders(truth: DataFrame, est: DataFrame) -> DataFrame:
    """truth, est (marker, founder, allele), integer founders: (estimated, matched, mismatches). Each estimated founder, in order, takes
    the unused true one with fewest mismatches, the first of equals; those that share no marker come last. Pairs are counted where
    founders share markers. As each takes one, a founder needs only as many candidates as there are estimated founders; one task
    reads them in order and holds which are taken."""
    a = est.select("marker", F.col("founder").cast("long").alias("e"), F.col("allele").alias("x"))
    b = truth.select("marker", F.col("founder").cast("long").alias("t"), F.col("allele").alias("y"))
    cost = a.join(b.hint("merge"), "marker").groupBy("e", "t").agg(F.sum((F.col("x") != F.col("y")).cast("long")).alias("n"))
    takers = a.select("e").distinct().count()
    best = cost.withColumn("k", F.row_number().over(Window.partitionBy("e").orderBy("n", "t"))).where(F.col("k") <= takers)
    # Candidates come after the list of the true founders, which is who is free.
    free = b.join(a.select("marker").distinct().hint("merge"), "marker", "left_semi").select("t").distinct().select(F.lit(0).alias("kind"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("long").alias("n"), "t")
    rows = free.unionByName(best.select(F.lit(1).alias("kind"), "e", "n", "t")).repartition(1).sortWithinPartitions("kind", "e", "n", "t")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, taken, next_free = [], set(), 0
        now, done, every = None, True, np.zeros(0, dtype=np.int64)

        def rest() -> tuple[int, int, int] | None:
            """For a founder whose candidates are all taken: the first free one."""
            nonlocal next_free
            while next_free < len(every) and int(every[next_free]) in taken:
                next_free += 1
            if next_free == len(every):
                return None
            taken.add(int(every[next_free]))
            return now, int(every[next_free]), 0

        for b in batches:
            out = []
            kind = b["kind"].to_numpy()
            names.append(b["t"].to_numpy()[kind == 0])
            b = b[kind == 1]
            if len(b) and not len(every):
                every = np.concatenate(names)
            for e, n, t in zip(b["e"].to_numpy(dtype=np.int64).tolist(), b["n"].to_numpy(dtype=np.int64).tolist(), b["t"].tolist()):
                if e != now:
                    if not done and (r := rest()):
                        out.append(r)
                    now, done = e, False
                if not done and t not in taken:
                    taken.add(t)
                    out.append((e, t, n))
                    done = True
            yield pd.DataFrame(out, columns=["estimated", "matched", "mismatches"])
        if not done and (r := rest()):
            yield pd.DataFrame([r], columns=["estimated", "matched", "mismatches"])

    return rows.mapInPandas(run, "estimated long, matched long, mismatches long")


def ancestry_accuracy(post: DataFrame, truth: DataFrame, least: float = 0.6) -> DataFrame:
    """post(ind, t, state, prob), truth(ind, t, state): (ind, n, assign_error, call_error, call_missing): mean posterior missed,
    wrong among calls above `least`, and share without a call."""
    best = post.groupBy("ind", "t").agg(F.min_by(F.struct("state", "prob"), F.struct(-F.col("prob"), F.col("state"))).alias("b"))
    right = post.join(truth, ["ind", "t", "state"]).select("ind", "t", F.col("prob").alias("p"))
    j = truth.select("ind", "t", F.col("state").alias("s")).join(best, ["ind", "t"], "left").join(right, ["ind", "t"], "left")
    called = F.coalesce(F.col("b.prob") > least, F.lit(False))
    return j.groupBy("ind").agg(
        F.count("*").alias("n"), (1 - F.avg(F.coalesce("p", F.lit(0.0)))).alias("assign_error"),
        (F.sum((called & (F.col("b.state") != F.col("s"))).cast("long")) / F.sum(called.cast("long"))).alias("call_error"), F.avg((~called).cast("double")).alias("call_missing"),
    )


def genotype_error(truth: DataFrame, est: DataFrame) -> DataFrame:
    """(marker, n, errors, missing): errors over cells known in truth; half calls count as missing."""
    j = truth.where("gt not like '%N%'").select("marker", "ind", F.col("gt").alias("t")).join(est.select("marker", "ind", F.col("gt").alias("e")), ["marker", "ind"], "left")
    known = F.coalesce(~F.col("e").contains("N"), F.lit(False))
    return j.groupBy("marker").agg(F.count("*").alias("n"), F.sum((known & (F.col("e") != F.col("t"))).cast("long")).alias("errors"), F.sum((~known).cast("long")).alias("missing"))


def trim_ends(markers: DataFrame, gap: float, share: float = 0.05, rounds: int = 5) -> DataFrame:
    """markers(lg, marker, pos): drops end pieces, cut off by a gap wider than `gap`, that hold at most `share` of the group;
    repeated until nothing goes, a group a task."""
    kind = markers.schema["marker"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "marker"])
        most = share * len(pdf)
        for _ in range(rounds):
            cuts = np.flatnonzero(np.diff(pdf.pos.to_numpy()) > gap) + 1
            if not len(cuts):
                break
            lo = cuts[0] if cuts[0] <= most else 0
            hi = cuts[-1] if len(pdf) - cuts[-1] <= most else len(pdf)
            if lo == 0 and hi == len(pdf):
                break
            pdf = pdf.iloc[lo:hi]
        return pdf

    return markers.select("lg", "marker", "pos").groupBy("lg").applyInPandas(run, f"lg string, marker {kind}, pos double")


def skeleton(markers: DataFrame, size: int) -> DataFrame:
    """markers(lg, marker, pos, err): about `size` markers a group, the least error of each of as many equal stretches."""
    span = markers.groupBy(F.col("lg").alias("__lg")).agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    j = markers.join(span, F.col("lg") == F.col("__lg"))
    bin_ = F.least(F.floor((F.col("pos") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-9)) * size), F.lit(size - 1)).alias("bin")
    return j.groupBy("lg", bin_).agg(F.min_by(F.struct("marker", "pos"), F.struct("err", "pos", "marker")).alias("m")).select("lg", F.col("m.marker").alias("marker"), F.col("m.pos").alias("pos"))
