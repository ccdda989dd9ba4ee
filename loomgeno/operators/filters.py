"""Marker and individual filters on long genotype tables (marker, ind, pop, gt)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgeno.functions import genotype as G
from loomgeno.operators.graph import checkpoint

#: Copies of each allele that a code shows for certain.
ONES = {"11": 2, "12": 1, "1N": 1, "2N": 0, "22": 0, "NN": 0}
TWOS = {"11": 0, "12": 1, "1N": 0, "2N": 1, "22": 2, "NN": 0}


def n_ones(gt: Column) -> Column:
    return G._lookup(gt, ONES, 0)


def n_twos(gt: Column) -> Column:
    return G._lookup(gt, TWOS, 0)


def marker_summary(geno: DataFrame) -> DataFrame:
    """(marker, n, n_miss, fmiss, n1, n2, freq2, maf, het): one partial aggregate by marker."""
    called = F.col("gt").isin("11", "12", "22")
    out = geno.groupBy("marker").agg(
        F.count("*").alias("n"), F.sum((F.col("gt") == "NN").cast("long")).alias("n_miss"), F.sum(n_ones(F.col("gt"))).cast("long").alias("n1"), F.sum(n_twos(F.col("gt"))).cast("long").alias("n2"),
        F.sum((F.col("gt") == "12").cast("long")).alias("n12"), F.sum(called.cast("long")).alias("n_called"),
    )
    freq = F.when(F.col("n1") + F.col("n2") > 0, F.col("n2") / (F.col("n1") + F.col("n2")))
    out = out.withColumn("fmiss", F.col("n_miss") / F.col("n")).withColumn("freq2", freq)
    return out.withColumn("maf", F.least(F.col("freq2"), 1 - F.col("freq2"))).withColumn("het", F.when(F.col("n_called") > 0, F.col("n12") / F.col("n_called")))


def filter_markers(geno: DataFrame, *, miss: Column | str = "fmiss <= 0.2", min_maf: float = 0.05, max_het: float = 1.0, inconsistent: DataFrame | None = None) -> DataFrame:
    """(marker, reason): reason is the first that applies of inconsistent, missing, maf, hetero; null keeps the marker.
    `miss` is any predicate over marker_summary(); an undefined maf keeps, and heterozygotes count only below 1."""
    s = marker_summary(geno)
    bad = F.lit(False)
    if inconsistent is not None:
        s = s.join(inconsistent.select("marker").distinct().withColumn("__bad", F.lit(True)), "marker", "left")
        bad = F.coalesce("__bad", F.lit(False))
    miss = F.expr(miss) if isinstance(miss, str) else miss
    reason = F.when(bad, "inconsistent").when(~miss, "missing").when(F.col("maf") < min_maf, "maf")
    if max_het < 1:
        reason = reason.when(F.col("het") > max_het, "hetero")
    return s.select("marker", reason.alias("reason"))


def individual_missing(geno: DataFrame, most: float = 1.0, keep_suffix: str = "_virtualoffspring") -> DataFrame:
    """(ind, n, fmiss, kept)."""
    out = geno.groupBy("ind").agg(F.count("*").alias("n"), F.avg((F.col("gt") == "NN").cast("double")).alias("fmiss"))
    return out.withColumn("kept", (F.col("fmiss") <= most) | F.col("ind").cast("string").endswith(keep_suffix))


def subpop_sizes(geno: DataFrame, least: int) -> DataFrame:
    """Rows of subpopulations with at least `least` individuals."""
    size = geno.groupBy("pop").agg(F.countDistinct("ind").alias("size")).where(F.col("size") >= least).select("pop")
    return geno.join(size, "pop", "left_semi")


def founder_progeny(parents: DataFrame, least: int, most_rounds: int = 50) -> DataFrame:
    """parents(ind, founder): removes founders with fewer than `least` progeny, with all those progeny, until none is left.
    Each round is two semi joins; the loop ends when a count repeats."""
    now, before = parents, -1
    for _ in range(most_rounds):
        few = now.groupBy("founder").agg(F.countDistinct("ind").alias("n")).where(F.col("n") < least)
        gone = now.join(few, "founder", "left_semi").select("ind").distinct()
        now = checkpoint(now.join(gone, "ind", "left_anti"))
        if (n := now.count()) == before:
            return now
        before = n
    raise RuntimeError("no fixpoint")


def allele_frequencies(nf: int, err: float = 0.005, uniform: bool = False) -> list[float]:
    """Frequencies of allele 2 that nf founders with equal shares can give, mixed with error."""
    return [i / nf * (1 - err) + (1 - i / nf) * err for i in range(nf + 1)]


def monomorphic(geno: DataFrame, nf: int, min_test: int = 20, least_maf: float = 0.05, err: float = 0.005, sure: float = 0.99) -> DataFrame:
    """(marker, pop, n1, n2, mono): mono is 1 or 2 if the subpopulation's minor allele is rarer than least_maf, alleles are
    enough, and the binomial posterior over possible founder frequencies gives that allele alone more than `sure`."""
    c = geno.groupBy("marker", "pop").agg(F.sum(n_ones(F.col("gt"))).cast("long").alias("n1"), F.sum(n_twos(F.col("gt"))).cast("long").alias("n2"))
    freqs = allele_frequencies(nf, err)
    logs = F.array(*[F.col("n2") * F.log(F.lit(f)) + F.col("n1") * F.log(F.lit(1 - f)) for f in freqs])
    p = G.softmax(logs)
    n = F.col("n1") + F.col("n2")
    rare = F.least("n1", "n2") < least_maf * n
    tested = rare & (n >= 2 * min_test)
    return c.withColumn("p", p).select("marker", "pop", "n1", "n2", F.when(tested & (F.col("p")[0] > sure), 1).when(tested & (F.col("p")[nf] > sure), 2).alias("mono"))


def conflicts(wanted: DataFrame) -> DataFrame:
    """wanted(marker, founder, allele): (marker, founder, allele, inconsistent); a founder asked to be both is neither."""
    return wanted.groupBy("marker", "founder").agg(F.min("allele").alias("lo"), F.max("allele").alias("hi")).select("marker", "founder", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("allele"), (F.col("lo") != F.col("hi")).alias("inconsistent"))


def mask(geno: DataFrame, share: float, min_reads: int = 1, seed: int = 1, skip_missing: float = 0.99) -> DataFrame:
    """Adds `masked`: a fixed share of observed cells of markers that aren't nearly all missing, by hash, so reruns agree."""
    skip = geno.groupBy("marker").agg(F.avg((F.col("gt") == "NN").cast("double")).alias("m")).where(F.col("m") >= skip_missing)
    drawn = F.pmod(F.xxhash64(F.lit(seed), "marker", "ind"), F.lit(1_000_000)) < share * 1_000_000
    enough = (F.col("n1") + F.col("n2") >= min_reads) if {"n1", "n2"} <= set(geno.columns) else F.lit(True)
    marked = geno.join(skip.select(F.col("marker").alias("__m"), F.lit(True).alias("__skip")), F.col("marker") == F.col("__m"), "left").drop("__m")
    return marked.withColumn("masked", drawn & (F.col("gt") != "NN") & enough & F.col("__skip").isNull()).drop("__skip")


def frequencies(geno: DataFrame, least_maf: float = 0.05) -> DataFrame:
    """(marker, table, het, freq2): counts n11|n12|n22 of each subpopulation, zeros where it is monomorphic, and the
    heterozygote and allele-2 frequency over the polymorphic ones."""
    gt = F.col("gt")
    c = geno.groupBy("marker", "pop").agg(*[F.sum((gt == g).cast("long")).alias(f"n{g}") for g in ("11", "12", "22")])
    n = F.col("n11") + F.col("n12") + F.col("n22")
    f = F.when(n > 0, (F.col("n12") + 2 * F.col("n22")) / (2 * n))
    poly = F.coalesce((f >= least_maf) & (f <= 1 - least_maf), F.lit(False))
    c = c.withColumn("poly", poly)
    for g in ("11", "12", "22"):
        c = c.withColumn(f"m{g}", F.when(F.col("poly"), F.col(f"n{g}")).otherwise(0))
    cell = F.concat_ws("|", "m11", "m12", "m22")
    out = c.groupBy("marker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pop", cell.alias("c")))), lambda s: s["c"]), ";").alias("table"), *[F.sum(f"m{g}").alias(f"t{g}") for g in ("11", "12", "22")])
    total = F.col("t11") + F.col("t12") + F.col("t22")
    return out.select("marker", "table", F.when(total > 0, F.col("t12") / total).alias("het"), F.when(total > 0, (F.col("t12") + 2 * F.col("t22")) / (2 * total)).alias("freq2"))


def thin(positions: DataFrame, gap: float) -> DataFrame:
    """positions(lg, marker, pos): markers further than `gap` from the one before; the first and last of a group stay."""
    w = Window.partitionBy("lg").orderBy("pos", "marker")
    out = positions.withColumn("__prev", F.lag("pos").over(w)).withColumn("__next", F.lead("pos").over(w))
    return out.where(F.col("__prev").isNull() | F.col("__next").isNull() | (F.col("pos") - F.col("__prev") > gap)).drop("__prev", "__next")


def tukey(values: DataFrame, key: str, value: str, k: float = 1.5) -> DataFrame:
    """Rows with an added `outlier`: beyond q3 + k times the interquartile range of their key; exact type-7 quantiles."""
    q = values.groupBy(F.col(key).alias("__k")).agg(F.percentile(value, [0.25, 0.75]).alias("__q"))
    fence = F.col("__q")[1] + k * (F.col("__q")[1] - F.col("__q")[0])
    return values.join(q, F.col(key) == F.col("__k")).withColumn("outlier", F.col(value) > fence).drop("__k", "__q")


def anscombe(n: Column) -> Column:
    """Square-root transform of a count whose variance is nearly constant."""
    return 2 * F.sqrt(n + 0.375)
