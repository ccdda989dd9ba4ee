"""Queries of merges, lookups, sets, pedigrees and accuracy."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgeno.operators import filters, graph, joins
from loomgeno.plans.registry import query
from loomgeno.plans.views import GENO, MAP, PED, geno, marker_map, pedigree, table


def _calls(spark, d, side):
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    if side == "a":
        c = c.where(k % 5 != 0)
        return c.select(k.alias("marker"), (k % 3).alias("ind"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.element_at(F.array(*map(F.lit, ("0/0", "0/1", "1/1", "."))), (k % 4 + 1).cast("int")).alias("gt"))
    c = c.where(k % 7 != 0)
    return c.select(k.alias("marker"), (k % 3).alias("ind"), F.when(k % 2 == 0, "A").when(k % 11 == 0, "G").otherwise("C").alias("ref"), F.when(k % 2 == 0, "C").otherwise("A").alias("alt"), F.element_at(F.array(*map(F.lit, ("1/1", "0/0", "."))), (k % 3 + 1).cast("int")).alias("gt"))


@query("""WITH a AS (SELECT c_custkey AS marker, c_custkey % 3 AS ind, 'A' AS ref, 'C' AS alt, ['0/0', '0/1', '1/1', '.'][c_custkey % 4 + 1] AS gt FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey AS marker, c_custkey % 3 AS ind, CASE WHEN c_custkey % 2 = 0 THEN 'A' WHEN c_custkey % 11 = 0 THEN 'G' ELSE 'C' END AS ref, CASE WHEN c_custkey % 2 = 0 THEN 'C' ELSE 'A' END AS alt, ['1/1', '0/0', '.'][c_custkey % 3 + 1] AS gt FROM customer WHERE c_custkey % 7 <> 0),
j AS (SELECT coalesce(a.marker, b.marker) AS marker, coalesce(a.ind, b.ind) AS ind, coalesce(a.ref, b.ref) AS ref, coalesce(a.alt, b.alt) AS alt, a.gt AS x, b.gt AS y, a.ref = b.alt AND a.alt = b.ref AS swapped, a.ref = b.ref AND a.alt = b.alt AS same,
  CASE WHEN a.ref = b.alt AND a.alt = b.ref THEN translate(b.gt, '01', '10') WHEN a.ref = b.ref AND a.alt = b.alt THEN b.gt ELSE '.' END AS z FROM a FULL JOIN b ON a.marker = b.marker AND a.ind = b.ind)
SELECT marker, ind, ref, alt, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x WHEN x = z THEN x WHEN x = '.' THEN z WHEN z = '.' AND (swapped OR same) THEN x ELSE '.' END AS gt FROM j""")
def merge_calls(spark, d):
    return joins.merge_calls(_calls(spark, d, "a"), _calls(spark, d, "b"))


@query(f"WITH {GENO}, {MAP} SELECT g.marker, ind, gt, lg, round(pos, 4) AS pos FROM geno g JOIN map m ON g.marker = m.marker")
def reset_map(spark, d):
    return joins.reset_map(geno(spark, d), marker_map(spark, d)).select("marker", "ind", "gt", "lg", F.round("pos", 4).alias("pos"))


@query(f"""WITH {MAP}, p AS (SELECT s_suppkey AS id, 'lg' || (s_suppkey % 4) AS lg, ((s_suppkey * 53) % 5000 / 10.0)::DOUBLE AS place FROM supplier),
m AS (SELECT lg, pos, min(marker) AS lo, max(marker) AS hi FROM map GROUP BY 1, 2)
SELECT id, lg, round(place, 4) AS "at", (SELECT arg_max(hi, pos) FROM m WHERE m.lg = p.lg AND m.pos <= p.place) AS "left", (SELECT arg_min(lo, pos) FROM m WHERE m.lg = p.lg AND m.pos > p.place) AS "right" FROM p""")
def nearest_markers(spark, d):
    k = F.col("s_suppkey")
    p = table(spark, d, "supplier").select(k.alias("id"), F.concat(F.lit("lg"), k % 4).alias("lg"), ((k * 53) % 5000 / F.lit(10.0)).alias("at"))
    return joins.neighbours(p, marker_map(spark, d)).withColumn("at", F.round("at", 4))


OTHER = "other AS (SELECT marker, 'x' || (marker % 3) AS lg, pos FROM map WHERE marker % 6 <> 0)"


def _other(m):
    return m.where("marker % 6 <> 0").select("marker", F.concat(F.lit("x"), F.col("marker") % 3).alias("lg"), "pos")


@query(f"""WITH {MAP}, {OTHER}, c AS (SELECT a.lg AS lga, b.lg AS lgb, count(*) AS shared FROM map a JOIN other b USING (marker) GROUP BY 1, 2),
s AS (SELECT *, shared / sum(shared) OVER (PARTITION BY lga) AS share, row_number() OVER (PARTITION BY lga ORDER BY shared DESC, lgb) = 1 AS best FROM c)
SELECT lga, lgb, shared, round(share, 6) AS share, best FROM s WHERE best OR (share >= 0.34 AND shared > 5)""")
def match_groups(spark, d):
    m = marker_map(spark, d)
    return joins.match_groups(m, _other(m), 0.34).withColumn("share", F.round("share", 6))


@query(f"""WITH {MAP} SELECT coalesce(a.marker, b.marker) AS marker, CASE WHEN b.marker IS NULL THEN 'left' WHEN a.marker IS NULL THEN 'right' ELSE 'common' END AS side
FROM (SELECT marker FROM map WHERE marker % 2 = 0) a FULL JOIN (SELECT marker FROM map WHERE marker % 3 = 0) b ON a.marker = b.marker""")
def marker_sets(spark, d):
    m = marker_map(spark, d)
    return joins.set_relations(m.where("marker % 2 = 0"), m.where("marker % 3 = 0"), "marker")


@query(f"""WITH {MAP} SELECT marker, 'both' AS kind FROM (SELECT marker FROM map WHERE marker % 2 = 0 INTERSECT SELECT marker FROM map WHERE marker % 3 = 0) UNION ALL SELECT marker, 'except' FROM (SELECT marker FROM map WHERE marker % 2 = 0 EXCEPT SELECT marker FROM map WHERE marker % 3 = 0)""")
def common_markers(spark, d):
    m = marker_map(spark, d).select("marker")
    a, b = m.where("marker % 2 = 0"), m.where("marker % 3 = 0")
    return a.intersect(b).withColumn("kind", F.lit("both")).unionByName(a.exceptAll(b).withColumn("kind", F.lit("except")))


@query(f"""WITH {PED}, RECURSIVE up(member, ancestor) AS (SELECT member, member FROM ped UNION SELECT up.member, p.parent FROM up JOIN (SELECT member, mother AS parent FROM ped UNION SELECT member, father FROM ped) p ON up.ancestor = p.member WHERE p.parent <> 0)
SELECT member, count(*) AS n, min(ancestor) AS first, sum(ancestor)::BIGINT AS total FROM up GROUP BY 1""".replace("WITH ped", "WITH RECURSIVE ped").replace(", RECURSIVE up", ", up"))
def pedigree_ancestors(spark, d):
    p = pedigree(spark, d)
    return joins.ancestors(p, p.select("member")).groupBy("member").agg(F.count("*").alias("n"), F.min("ancestor").alias("first"), F.sum("ancestor").alias("total"))


@query(f"""WITH RECURSIVE {PED}, down(member, generation) AS (SELECT member, 0 FROM ped WHERE mother = 0 AND father = 0 UNION SELECT p.member, generation + 1 FROM down JOIN ped p ON p.mother = down.member OR p.father = down.member)
SELECT member, max(generation)::INT AS generation FROM down GROUP BY 1""")
def pedigree_generations(spark, d):
    return joins.generations(pedigree(spark, d))


@query("""WITH l AS (SELECT s_suppkey AS marker, (s_suppkey * 3 % 50) || '||' || (s_suppkey * 7 % 40) AS n FROM supplier), e AS (SELECT marker::VARCHAR AS a, unnest(string_split(n, '||')) AS b FROM l)
SELECT a, b FROM e UNION SELECT b, a FROM e""")
def neighbour_graph(spark, d):
    k = F.col("s_suppkey")
    return joins.adjacency(table(spark, d, "supplier").select(k.alias("marker"), F.concat_ws("||", k * 3 % 50, k * 7 % 40).alias("neighbours")))


@query("""SELECT p_partkey AS representative, 'lg' || (p_partkey % 4) AS lg, p_size / 2.0::DOUBLE AS pos, unnest(['m' || p_partkey, 'm' || (p_partkey + p_size)]) AS marker FROM part""")
def expand_bins(spark, d):
    k = F.col("p_partkey")
    b = table(spark, d, "part").select(k.alias("representative"), F.concat(F.lit("lg"), k % 4).alias("lg"), (F.col("p_size") / 2).alias("pos"), F.concat(F.lit("m"), k, F.lit("||m"), k + F.col("p_size")).alias("members"))
    return joins.expand_bins(b)


@query(f"""WITH {GENO}, j AS (SELECT pop, gt AS t, CASE k % 5 WHEN 0 THEN '11' WHEN 1 THEN gt WHEN 2 THEN 'NN' WHEN 3 THEN '1N' ELSE '22' END AS e FROM geno WHERE (marker + ind) % 3 = 0 AND gt NOT LIKE '%N%')
SELECT pop, count(*) AS n, round(count(*) FILTER (e LIKE '%N%') / count(*), 6) AS missing, round(CASE WHEN count(*) FILTER (e NOT LIKE '%N%') > 0 THEN count(*) FILTER (e = t) / count(*) FILTER (e NOT LIKE '%N%') END, 6) AS accuracy FROM j GROUP BY 1""")
def imputation_accuracy(spark, d):
    g = geno(spark, d)
    e = g.withColumn("gt", F.when(F.col("k") % 5 == 0, "11").when(F.col("k") % 5 == 1, F.col("gt")).when(F.col("k") % 5 == 2, "NN").when(F.col("k") % 5 == 3, "1N").otherwise("22"))
    return joins.imputation_accuracy(g, e, F.expr("(marker + ind) % 3 = 0 and gt not like '%N%'")).select("pop", "n", F.round("missing", 6).alias("missing"), F.round("accuracy", 6).alias("accuracy"))


@query(f"""WITH {MAP}, {OTHER}, c AS (SELECT a.lg AS x, b.lg AS y, count(*) AS n FROM map a JOIN other b USING (marker) GROUP BY 1, 2),
x AS (SELECT sum(n) AS n FROM c GROUP BY x), y AS (SELECT sum(n) AS n FROM c GROUP BY y),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM x)::DOUBLE AS pairs_a, (SELECT sum(n * (n - 1) / 2) FROM y)::DOUBLE AS pairs_b, (SELECT sum(n * (n - 1) / 2) FROM c)::DOUBLE AS "both")
SELECT pairs_a, pairs_b, "both", round(2 * "both" / (pairs_a + pairs_b), 6) AS f1, (SELECT count(*) FROM map WHERE marker % 6 = 0) AS only_a, 0::BIGINT AS only_b FROM s""")
def map_agreement(spark, d):
    m = marker_map(spark, d)
    return joins.map_agreement(m, _other(m)).withColumn("f1", F.round("f1", 6))


@query(f"""WITH {MAP}, j AS (SELECT lg, marker, pos AS pa, round(pos * 7 % 311, 3) + marker / 1000000.0 AS pb FROM map),
k AS (SELECT a.lg, count(*) FILTER ((a.pb < b.pb) <> (a.pa < b.pa OR (a.pa = b.pa AND a.marker < b.marker))) AS bad, count(*) AS pairs FROM j a JOIN j b ON a.lg = b.lg AND a.marker < b.marker GROUP BY 1)
SELECT lg AS lga, lg AS lgb, (SELECT count(*) FROM j WHERE j.lg = k.lg) AS n, round(1 - 2 * bad / pairs, 6) AS tau FROM k""")
def order_agreement(spark, d):
    m = marker_map(spark, d)
    return joins.order_agreement(m, m.withColumn("pos", F.round(F.col("pos") * 7 % 311, 3) + F.col("marker") / 1000000)).withColumn("tau", F.round("tau", 6))


_ROUND = "f{k} AS (SELECT * FROM f{j} WHERE ind NOT IN (SELECT ind FROM f{j} WHERE founder IN (SELECT founder FROM f{j} GROUP BY 1 HAVING count(DISTINCT ind) < 3)))"
ROUNDS = 12


@query(f"""WITH f0 AS (SELECT c_custkey AS ind, unnest([c_custkey // 4, (c_custkey * 7 % 1001) // 5 + 1000000]) AS founder FROM customer), {", ".join(_ROUND.format(k=k + 1, j=k) for k in range(ROUNDS))}
SELECT ind, founder FROM f{ROUNDS}""")
def founder_progeny(spark, d):
    """SQL has a fixed number of rounds, enough for the smaller tables."""
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("ind"), F.explode(F.array(F.floor(k / 4), F.floor((k * 7 % 1001) / 5) + 1000000)).alias("founder"))
    return filters.founder_progeny(p, 3)


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 10 * 10 + (3 * (c_custkey % 10) + 1) % 10 AS b FROM customer), n AS (SELECT a AS id FROM e UNION SELECT b FROM e),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, root) AS (SELECT id, id FROM n UNION SELECT s.b, r.root FROM r JOIN s ON r.id = s.a)
SELECT id, min(root) AS root FROM r GROUP BY 1""")
def connected_founders(spark, d):
    k = F.col("c_custkey")
    return graph.components(table(spark, d, "customer").select(k.alias("a"), (F.floor(k / 10) * 10 + (3 * (k % 10) + 1) % 10).alias("b")))
