"""Queries of accuracy, pedigree tables and map cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgeno.operators import accuracy
from loomgeno.plans.registry import query
from loomgeno.plans.views import GENO, MAP, PED, geno, marker_map, pedigree, table
from loomgeno.sources import pedigrees


@query(f"""WITH {GENO}, e AS (SELECT marker, ind, CASE k % 5 WHEN 0 THEN '11' WHEN 1 THEN gt WHEN 2 THEN 'NN' WHEN 3 THEN '1N' ELSE '22' END AS e FROM geno)
SELECT marker, count(*) AS n, count(*) FILTER (e NOT LIKE '%N%' AND e <> gt) AS errors, count(*) FILTER (e LIKE '%N%') AS missing FROM geno JOIN e USING (marker, ind) WHERE gt NOT LIKE '%N%' GROUP BY 1""")
def genotype_error(spark, d):
    g = geno(spark, d)
    e = g.withColumn("gt", F.when(F.col("k") % 5 == 0, "11").when(F.col("k") % 5 == 1, F.col("gt")).when(F.col("k") % 5 == 2, "NN").when(F.col("k") % 5 == 3, "1N").otherwise("22"))
    return accuracy.genotype_error(g, e)


@query(f"""WITH {GENO}, p AS (SELECT ind, marker AS t, unnest([1, 2]) AS state, unnest([(n1 + 1) / (n1 + n2 + 2), (n2 + 1) / (n1 + n2 + 2)]) AS prob FROM geno), tr AS (SELECT ind, marker AS t, 1 + marker % 2 AS s FROM geno),
b AS (SELECT ind, t, arg_min((state, prob), (-prob, state)) AS b FROM p GROUP BY 1, 2), j AS (SELECT tr.ind, tr.t, s, b[1] AS state, b[2] > 0.6 AS called, p.prob AS p FROM tr JOIN b USING (ind, t) JOIN p ON p.ind = tr.ind AND p.t = tr.t AND p.state = tr.s)
SELECT ind, count(*) AS n, round(1 - avg(p), 6) AS assign_error, round(count(*) FILTER (called AND state <> s) / count(*) FILTER (called), 6) AS call_error, round(count(*) FILTER (NOT called) / count(*), 6) AS call_missing FROM j GROUP BY 1""")
def ancestry_accuracy(spark, d):
    n = F.col("n1") + F.col("n2") + 2
    p = geno(spark, d).select("ind", F.col("marker").alias("t"), F.posexplode(F.array((F.col("n1") + 1) / n, (F.col("n2") + 1) / n)).alias("state", "prob")).withColumn("state", (F.col("state") + 1).cast("long"))
    truth = geno(spark, d).select("ind", F.col("marker").alias("t"), (1 + F.col("marker") % 2).alias("state"))
    out = accuracy.ancestry_accuracy(p, truth)
    return out.select("ind", "n", *[F.round(c, 6).alias(c) for c in ("assign_error", "call_error", "call_missing")])


@query()
def founder_matching(spark, d):
    """Greedy by order; SQL can't carry which founders are taken."""
    g = geno(spark, d).where("gt in ('11', '22')").select("marker", F.col("ind").alias("founder"), F.col("gt").alias("allele"))
    return accuracy.match_founders(g, g.withColumn("founder", F.col("founder") * 7 % 1009))


_TRIM = """w{k} AS (SELECT *, row_number() OVER (PARTITION BY lg ORDER BY pos, marker) AS nth, count(*) OVER (PARTITION BY lg) AS n, pos - lag(pos) OVER (PARTITION BY lg ORDER BY pos, marker) > 1.5 AS gap FROM t{j}),
c{k} AS (SELECT lg, any_value(n) AS n, min(nth - 1) FILTER (gap) AS a, max(nth - 1) FILTER (gap) AS b, any_value(most) AS most FROM w{k} GROUP BY 1),
t{k} AS (SELECT w.lg, marker, pos, w.most FROM w{k} w JOIN c{k} c USING (lg) WHERE nth > CASE WHEN a <= c.most THEN a ELSE 0 END AND nth <= CASE WHEN c.n - b <= c.most THEN b ELSE c.n END)"""


@query(f"""WITH {MAP}, t0 AS (SELECT *, 0.2 * count(*) OVER (PARTITION BY lg) AS most FROM map), {", ".join(_TRIM.format(k=k + 1, j=k) for k in range(5))} SELECT lg, marker, round(pos, 4) AS pos FROM t5""")
def trimmed_maps(spark, d):
    """Five rounds at most."""
    return accuracy.trim_ends(marker_map(spark, d), 1.5, 0.2).withColumn("pos", F.round("pos", 4))


@query(f"""WITH {MAP}, s AS (SELECT lg, min(pos) AS lo, max(pos) AS hi FROM map GROUP BY 1), b AS (SELECT m.lg, marker, pos, marker % 13 AS err, least(floor((pos - lo) / greatest(hi - lo, 1e-9) * 40), 39) AS bin FROM map m JOIN s USING (lg))
SELECT lg, arg_min(marker, (err, pos, marker)) AS marker, round(arg_min(pos, (err, pos, marker)), 4) AS pos FROM b GROUP BY lg, bin""")
def skeleton_markers(spark, d):
    return accuracy.skeleton(marker_map(spark, d).withColumn("err", F.col("marker") % 13), 40).withColumn("pos", F.round("pos", 4))


@query(f"WITH {PED}, u AS (SELECT * FROM ped WHERE member % 3 <> 0 UNION SELECT member, CASE WHEN member % 10 = 0 THEN 1 ELSE mother END, father FROM ped WHERE member % 2 = 0) SELECT member, count(*) AS n FROM u GROUP BY 1 HAVING count(*) > 1")
def pedigree_conflicts(spark, d):
    p = pedigree(spark, d)
    other = p.where("member % 2 = 0").withColumn("mother", F.when(F.col("member") % 10 == 0, 1).otherwise(F.col("mother")))
    return pedigrees.conflicts(pedigrees.union([p.where("member % 3 <> 0"), other]))


@query("""SELECT c_mktsegment AS pop, count(DISTINCT c_custkey) AS n, (SELECT string_agg(f, '||' ORDER BY f) FROM (SELECT DISTINCT (b.c_nationkey % 7)::VARCHAR AS f FROM customer b WHERE b.c_mktsegment = a.c_mktsegment)) AS founders FROM customer a GROUP BY 1""")
def subpop_relations(spark, d):
    c = table(spark, d, "customer")
    return pedigrees.relations(c.select(F.col("c_custkey").alias("ind"), F.col("c_mktsegment").alias("pop")), c.select(F.col("c_mktsegment").alias("pop"), (F.col("c_nationkey") % 7).alias("founder")))


@query("""SELECT 'lg' || (p_partkey % 4) AS lg, 'group lg' || (p_partkey % 4) || chr(10) || string_agg(p_partkey || ' ' || (p_size + 0.5)::DECIMAL(9,1), chr(10) ORDER BY p_size, p_partkey) || chr(10) || ';' AS "value" FROM part GROUP BY p_partkey % 4""")
def merge_map_groups(spark, d):
    k = F.col("p_partkey")
    return pedigrees.merge_map_groups(table(spark, d, "part").select(F.concat(F.lit("lg"), k % 4).alias("lg"), k.alias("marker"), (F.col("p_size") + 0.5).alias("pos")))


@query()
def breeder_pedigree(spark, d):
    """A parser of text; its rows are the breeder's."""
    rows = [("a", "P1/P2", "DH"), ("b", "P1/P2//P3", "S3"), ("c", "P4/3/P2/P3//P5/P6", "2"), ("P3", "P1/P4", "1")]
    ped, off = pedigrees.breeder_pedigree(rows)
    return spark.createDataFrame([(m, a, b, "member") for m, a, b in ped] + [(i, line, line, "offspring") for i, line in off], "member string, mother string, father string, role string")
