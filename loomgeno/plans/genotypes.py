"""Queries of scalar functions, filters and pair statistics over the genotype view."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgeno.functions import genotype as G
from loomgeno.operators import filters, pairs
from loomgeno.plans.registry import query
from loomgeno.plans.views import GENO, MAP, geno, marker_map

ONES = "CASE gt WHEN '11' THEN 2 WHEN '12' THEN 1 WHEN '1N' THEN 1 ELSE 0 END"
TWOS = "CASE gt WHEN '22' THEN 2 WHEN '12' THEN 1 WHEN '2N' THEN 1 ELSE 0 END"
SUMMARY = f"""summ0 AS (SELECT marker, count(*) AS n, count(*) FILTER (gt = 'NN') AS n_miss, sum({ONES})::BIGINT AS n1, sum({TWOS})::BIGINT AS n2, count(*) FILTER (gt = '12') AS n12, count(*) FILTER (gt IN ('11','12','22')) AS n_called FROM geno GROUP BY 1),
summ AS (SELECT *, n_miss / n AS fmiss, CASE WHEN n1 + n2 > 0 THEN n2 / (n1 + n2) END AS freq2, CASE WHEN n_called > 0 THEN n12 / n_called END AS het FROM summ0)"""


def r(c, d=6):
    return F.round(c, d)


@query(f"WITH {GENO}, {SUMMARY} SELECT marker, n, n_miss, n1, n2, round(fmiss, 6) AS fmiss, round(freq2, 6) AS freq2, round(least(freq2, 1 - freq2), 6) AS maf, round(het, 6) AS het FROM summ")
def marker_summary(spark, d):
    return filters.marker_summary(geno(spark, d)).select("marker", "n", "n_miss", "n1", "n2", *[r(c).alias(c) for c in ("fmiss", "freq2", "maf", "het")])


@query(f"""WITH {GENO}, {SUMMARY} SELECT marker, CASE WHEN marker % 17 = 0 THEN 'inconsistent' WHEN NOT fmiss <= 0.03 THEN 'missing' WHEN least(freq2, 1 - freq2) < 0.45 THEN 'maf' WHEN het > 0.1 THEN 'hetero' END AS reason FROM summ""")
def filter_markers(spark, d):
    g = geno(spark, d)
    return filters.filter_markers(g, miss="fmiss <= 0.03", min_maf=0.45, max_het=0.1, inconsistent=g.where("marker % 17 = 0"))


@query(f"WITH {GENO} SELECT ind, count(*) AS n, round(avg(CASE WHEN gt = 'NN' THEN 1.0 ELSE 0.0 END), 6) AS fmiss, avg(CASE WHEN gt = 'NN' THEN 1.0 ELSE 0.0 END) <= 0.03 AS kept FROM geno GROUP BY 1")
def individual_missing(spark, d):
    return filters.individual_missing(geno(spark, d), 0.03).withColumn("fmiss", r("fmiss"))


@query(f"WITH {GENO}, g AS (SELECT marker, ind, floor(sqrt(ind))::BIGINT AS pop FROM geno) SELECT marker, ind, pop FROM g WHERE pop IN (SELECT pop FROM g GROUP BY 1 HAVING count(DISTINCT ind) >= 5)")
def subpop_filter(spark, d):
    return filters.subpop_sizes(geno(spark, d).withColumn("pop", F.floor(F.sqrt("ind"))), 5).select("marker", "ind", "pop")


@query(f"""WITH {GENO} SELECT marker, ind, round(CASE gt WHEN '11' THEN 1 WHEN '1N' THEN 1.5 WHEN '12' THEN 2 WHEN '2N' THEN 2.5 WHEN '22' THEN 3 END::DOUBLE, 2) AS dose,
 round(CASE WHEN gt IN ('11', '1N') THEN 1 WHEN gt IN ('2N', '22') THEN 2 END::DOUBLE, 2) AS haplo, CASE WHEN gt = '12' THEN 'NN' ELSE gt END AS homo, CASE WHEN gt IN ('11', '1N') THEN '1' WHEN gt IN ('22', '2N') THEN '2' ELSE 'N' END AS inbred, gt = 'NN' AS missing FROM geno""")
def genotype_codes(spark, d):
    gt = F.col("gt")
    return geno(spark, d).select("marker", "ind", G.dose(gt).alias("dose"), G.dose(gt, True).alias("haplo"), G.hetero_to_missing(gt).alias("homo"), G.inbred(gt).alias("inbred"), G.is_missing(F.lit("GT"), gt).alias("missing"))


@query("""WITH c AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE (l_orderkey + l_linenumber) % 9 WHEN 0 THEN '21' WHEN 1 THEN 'N1' WHEN 2 THEN 'N2' WHEN 3 THEN '12' WHEN 4 THEN '1N' ELSE 'NN' END AS code FROM lineitem)
SELECT id, line, CASE code WHEN '21' THEN '12' WHEN 'N1' THEN '1N' WHEN 'N2' THEN '2N' ELSE code END AS canonical FROM c""")
def canonical_codes(spark, d):
    n = (F.col("l_orderkey") + F.col("l_linenumber")) % 9
    code = F.when(n == 0, "21").when(n == 1, "N1").when(n == 2, "N2").when(n == 3, "12").when(n == 4, "1N").otherwise("NN")
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), G.canonical(code).alias("canonical"))


POST = f"""{GENO}, lg AS (SELECT *, n1 * ln(0.995) + n2 * ln(0.005) AS a, (n1 + n2) * ln(0.5) AS b, n1 * ln(0.005) + n2 * ln(0.995) AS c FROM geno),
ex AS (SELECT *, exp(a - greatest(a, b, c)) AS ea, exp(b - greatest(a, b, c)) AS eb, exp(c - greatest(a, b, c)) AS ec FROM lg),
post AS (SELECT *, ea / (ea + eb + ec) AS p1, eb / (ea + eb + ec) AS p12, ec / (ea + eb + ec) AS p2 FROM ex)"""


def _posterior(spark, d):
    return geno(spark, d).withColumn("gp", G.depth_posterior(F.col("n1"), F.col("n2")))


@query(f"""WITH {POST} SELECT marker, ind, round(p1, 6) AS p1, round(p12, 6) AS p12, round(p2, 6) AS p2,
 CASE WHEN p1 > 0.95 THEN '11' WHEN p12 > 0.95 THEN '12' WHEN p2 > 0.95 THEN '22' WHEN p1 + p12 > 0.95 AND p1 + p12 >= p2 + p12 THEN '1N' WHEN p2 + p12 > 0.95 THEN '2N' ELSE 'NN' END AS called,
 round(CASE WHEN greatest(p1, p12, p2) > 0.7 THEN 1 + p12 + 2 * p2 END, 6) AS dose,
 round(CASE WHEN n1 > 0 AND n2 = 0 THEN 1 WHEN n2 > 0 AND n1 = 0 THEN 0 WHEN p12 >= 0.5 THEN 0.5 ELSE p1 + p12 / 2 END, 6) AS haplo1,
 CASE WHEN n1 > 0 AND n2 > 0 THEN '-1' WHEN n1 > 0 THEN '1' WHEN n2 > 0 THEN '2' ELSE 'N' END AS seen FROM post""")
def depth_calls(spark, d):
    gp = F.col("gp")
    return _posterior(spark, d).select("marker", "ind", *[r(gp[i]).alias(n) for i, n in enumerate(("p1", "p12", "p2"))], G.call(gp, 0.95).alias("called"), r(G.dose_of_posterior(gp)).alias("dose"), r(G.depth_haplo(F.col("n1"), F.col("n2"), gp)[0]).alias("haplo1"), G.depth_to_haplo(F.col("n1"), F.col("n2")).alias("seen"))


@query(f"""WITH {POST}, z AS (SELECT *, p12 + 2 * p2 AS u, p12 + 4 * p2 AS w, CASE WHEN p1 >= p12 AND p1 >= p2 THEN 0.0 WHEN p12 >= p2 THEN 1.0 ELSE 2.0 END::DOUBLE AS z FROM post),
s AS (SELECT marker, count(*) AS n, sum(u) AS su, sum(w) AS sw, sum(z) AS sz, sum(z * z) AS szz, sum(z * u) AS szu FROM z GROUP BY 1)
SELECT marker, round(CASE WHEN szz - sz * sz / n > 0 THEN (szu - su * sz / n) ** 2 / ((sw - su * su / n) * (szz - sz * sz / n)) END, 5) AS ar2 FROM s""")
def allelic_r2(spark, d):
    return pairs.allelic_r2(_posterior(spark, d)).select("marker", r("ar2", 5).alias("ar2"))


@query(f"""WITH {GENO}, c AS (SELECT marker, pop, sum({ONES})::BIGINT AS n1, sum({TWOS})::BIGINT AS n2 FROM geno GROUP BY ALL),
l AS (SELECT *, [n2 * ln(0.005 + i / 4.0 * 0.99) + n1 * ln(1 - (0.005 + i / 4.0 * 0.99)) FOR i IN [0, 1, 2, 3, 4]] AS logs FROM c),
p AS (SELECT *, list_sum([exp(x - list_max(logs)) FOR x IN logs]) AS total FROM l),
t AS (SELECT *, least(n1, n2) < 0.25 * (n1 + n2) AND n1 + n2 >= 8 AS tested, exp(logs[1] - list_max(logs)) / total AS first, exp(logs[5] - list_max(logs)) / total AS last FROM p)
SELECT marker, pop, n1, n2, CASE WHEN tested AND first > 0.6 THEN 1 WHEN tested AND last > 0.6 THEN 2 END AS mono FROM t""")
def monomorphic_test(spark, d):
    return filters.monomorphic(geno(spark, d), 4, min_test=4, least_maf=0.25, sure=0.6)


@query(f"""WITH {GENO}, w AS (SELECT marker, pop AS founder, CASE WHEN gt IN ('11', '1N') THEN 1 WHEN gt IN ('22', '2N') THEN 2 END AS allele FROM geno WHERE gt IN ('11', '22', '1N', '2N'))
SELECT marker, founder, CASE WHEN min(allele) = max(allele) THEN min(allele) END AS allele, min(allele) <> max(allele) AS inconsistent FROM w GROUP BY 1, 2""")
def founder_conflicts(spark, d):
    g = geno(spark, d).where("gt in ('11', '22', '1N', '2N')")
    return filters.conflicts(g.select("marker", F.col("pop").alias("founder"), F.when(F.col("gt").isin("11", "1N"), 1).otherwise(2).alias("allele")))


@query(f"""WITH {GENO}, c AS (SELECT marker, pop, count(*) FILTER (gt = '11') AS a, count(*) FILTER (gt = '12') AS b, count(*) FILTER (gt = '22') AS c FROM geno GROUP BY 1, 2),
f AS (SELECT *, coalesce((b + 2 * c) / (2 * (a + b + c)) BETWEEN 0.3 AND 1 - 0.3, false) AS poly FROM c),
m AS (SELECT marker, pop, CASE WHEN poly THEN a ELSE 0 END AS a, CASE WHEN poly THEN b ELSE 0 END AS b, CASE WHEN poly THEN c ELSE 0 END AS c FROM f)
SELECT marker, string_agg(a || '|' || b || '|' || c, ';' ORDER BY pop) AS "table", round(CASE WHEN sum(a + b + c) > 0 THEN sum(b) / sum(a + b + c) END, 6) AS het, round(CASE WHEN sum(a + b + c) > 0 THEN (sum(b) + 2 * sum(c)) / (2 * sum(a + b + c)) END, 6) AS freq2 FROM m GROUP BY 1""")
def genotype_frequencies(spark, d):
    return filters.frequencies(geno(spark, d), 0.3).select("marker", "table", r("het").alias("het"), r("freq2").alias("freq2"))


PAIRS = "seen AS (SELECT marker, ind, gt, CASE gt WHEN '11' THEN 1 WHEN '12' THEN 2 ELSE 3 END AS dose FROM geno WHERE gt IN ('11', '12', '22')), pairs AS (SELECT a.marker AS m1, b.marker AS m2, a.ind, a.gt AS g1, b.gt AS g2, a.dose AS d1, b.dose AS d2 FROM seen a JOIN seen b ON a.ind = b.ind AND a.marker < b.marker)"


#: Least r2, individuals, G and LOD that tables of pairs keep.
LEAST_R2, LEAST_N, LEAST_G, LEAST_LOD = 0.5, 9, 12.0, 2.0


@query(f"""WITH {GENO}, {PAIRS}, s AS (SELECT m1, m2, count(*) AS n, sum(d1)::BIGINT AS sx, sum(d2)::BIGINT AS sy, sum(d1 * d1)::BIGINT AS sxx, sum(d2 * d2)::BIGINT AS syy, sum(d1 * d2)::BIGINT AS sxy FROM pairs GROUP BY 1, 2),
v AS (SELECT *, (n * sxy - sx * sy)::DOUBLE AS cov, (n * sxx - sx * sx)::DOUBLE AS vx, (n * syy - sy * sy)::DOUBLE AS vy FROM s)
SELECT m1, m2, n, round(cov * cov / (vx * vy), 6) AS r2 FROM v WHERE n >= {LEAST_N} AND vx > 0 AND vy > 0 AND cov * cov / (vx * vy) >= {LEAST_R2}""")
def ld_r2(spark, d):
    return pairs.ld_r2(geno(spark, d), least=LEAST_R2, least_n=LEAST_N).withColumn("r2", r("r2"))


CELLS = f"""{GENO}, {PAIRS}, cells AS (SELECT m1, m2, g1, g2, count(*) AS c FROM pairs GROUP BY ALL),
t AS (SELECT *, sum(c) OVER (PARTITION BY m1, m2) AS n, sum(c) OVER (PARTITION BY m1, m2, g1) AS r FROM cells),
k1 AS (SELECT *, least(greatest(1.0, 0.005 * n), 5.0) AS few FROM t), k2 AS (SELECT *, sum(c) OVER (PARTITION BY m1, m2, g2) AS k FROM k1 WHERE r > few),
k3 AS (SELECT m1, m2, g1, g2, c FROM k2 WHERE k > few),
w AS (SELECT *, sum(c) OVER (PARTITION BY m1, m2) AS n, sum(c) OVER (PARTITION BY m1, m2, g1) AS r, sum(c) OVER (PARTITION BY m1, m2, g2) AS k FROM k3),
gs AS (SELECT m1, m2, 2 * sum(c * ln(c * n / (r * k))) + 0.0 AS g, (count(DISTINCT g1) - 1) * (count(DISTINCT g2) - 1) AS df FROM w GROUP BY 1, 2)"""


@query(f"WITH {CELLS} SELECT m1, m2, round(g, 5) AS g, df FROM gs WHERE g + 1e-9 >= {LEAST_G}")
def ld_contingency(spark, d):
    return pairs.contingency_g(geno(spark, d), least=LEAST_G).select("m1", "m2", r(F.col("g"), 5).alias("g"), "df")


@query()
def ld_lod(spark, d):
    """The table of linkage disequilibrium; chi-square tails have no SQL form."""
    return pairs.ld_lod(geno(spark, d), LEAST_LOD).withColumn("lod", r("lod", 5)).select("m1", "m2", r("r2").alias("r2"), r("g", 5).alias("g"), "df", "lod")


@query(f"""WITH {GENO}, {PAIRS}, n AS (SELECT marker, count(*) AS seen FROM seen GROUP BY 1), p AS (SELECT m1, m2, count(*) AS n, count(*) FILTER (g1 <> g2) AS differ FROM pairs GROUP BY 1, 2)
SELECT m1, m2, p.n, differ FROM p JOIN n a ON m1 = a.marker JOIN n b ON m2 = b.marker WHERE p.n >= 8 AND p.n >= 0.3 * greatest(a.seen, b.seen) AND differ <= 0.2 * p.n""")
def duplicate_markers(spark, d):
    return pairs.duplicate_markers(geno(spark, d), 8, 0.3, most_differ=0.2)


CORR = f"""{GENO}, s0 AS (SELECT marker, ind, CASE gt WHEN '11' THEN 1 WHEN '12' THEN 2 ELSE 3 END AS dose FROM geno WHERE gt IN ('11', '12', '22')),
s AS (SELECT a.ind AS i1, b.ind AS i2, count(*) AS n, sum(a.dose)::BIGINT AS sx, sum(b.dose)::BIGINT AS sy, sum(a.dose * a.dose)::BIGINT AS sxx, sum(b.dose * b.dose)::BIGINT AS syy, sum(a.dose * b.dose)::BIGINT AS sxy FROM s0 a JOIN s0 b ON a.marker = b.marker AND a.ind < b.ind GROUP BY 1, 2),
corr AS (SELECT i1, i2, n, CASE WHEN n * sxx > sx * sx AND n * syy > sy * sy THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx)::DOUBLE * (n * syy - sy * sy)::DOUBLE) END AS r FROM s)"""


@query(f"WITH {CORR} SELECT i1, i2, n, round(r, 6) + 0.0 AS r FROM corr WHERE r >= -1")
def individual_correlation(spark, d):
    return pairs.individual_correlation(geno(spark, d)).withColumn("r", r("r") + 0.0)


@query(f"""WITH {CORR}, n AS (SELECT ind, count(*) AS seen FROM geno WHERE gt <> 'NN' GROUP BY 1)
SELECT DISTINCT CASE WHEN a.seen <= b.seen THEN i1 ELSE i2 END AS ind FROM corr JOIN n a ON i1 = a.ind JOIN n b ON i2 = b.ind WHERE r > 0.3""")
def duplicate_individuals(spark, d):
    return pairs.duplicate_individuals(geno(spark, d), 0.3)


@query()
def mask_cells(spark, d):
    """Which cells are masked is decided by a hash that SQL lacks."""
    return filters.mask(geno(spark, d), 0.1).groupBy("marker").agg(F.sum(F.col("masked").cast("long")).alias("masked"), F.count("*").alias("n"))


@query(f"""WITH {MAP}, w AS (SELECT *, lag(pos) OVER o AS p, lead(pos) OVER o AS q FROM map WINDOW o AS (PARTITION BY lg ORDER BY pos, marker))
SELECT lg, marker, round(pos, 4) AS pos FROM w WHERE p IS NULL OR q IS NULL OR pos - p > 0.85""")
def thin_markers(spark, d):
    return filters.thin(marker_map(spark, d), 0.85).select("lg", "marker", r("pos", 4).alias("pos"))


@query("""WITH q AS (SELECT c_mktsegment AS k, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1)
SELECT c_custkey AS id, c_acctbal > q3 + 0.3 * (q3 - q1) AS outlier FROM customer JOIN q ON c_mktsegment = k""")
def tukey_outliers(spark, d):
    return filters.tukey(spark.read.parquet(f"{d}/customer.parquet"), "c_mktsegment", "c_acctbal", 0.3).select(F.col("c_custkey").alias("id"), "outlier")


@query("""WITH v AS (SELECT c_custkey AS id, (c_custkey % 97 + 1) / 100.0::DOUBLE AS p, (c_custkey * 7 % 13)::DOUBLE AS a, (c_custkey * 5 % 11)::DOUBLE AS b FROM customer)
SELECT id, round(ln(p / (1 - p)), 6) + 0.0 AS logit, round(atanh(p), 6) AS z, round(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS lse, round(p + a / 13 - p * a / 13, 6) AS joint, round(2 * sqrt(a + 0.375), 6) AS root FROM v""")
def scalar_functions(spark, d):
    c = F.col("c_custkey")
    v = spark.read.parquet(f"{d}/customer.parquet").select(c.alias("id"), ((c % 97 + 1) / 100).alias("p"), (c * 7 % 13).cast("double").alias("a"), (c * 5 % 11).cast("double").alias("b"))
    p, a = F.col("p"), F.col("a")
    return v.select("id", (r(G.logit(p)) + 0.0).alias("logit"), r(G.fisher_z(p)).alias("z"), r(G.logsumexp(F.array("a", "b"))).alias("lse"), r(G.joint_error(p, a / 13)).alias("joint"), r(filters.anscombe(a)).alias("root"))
