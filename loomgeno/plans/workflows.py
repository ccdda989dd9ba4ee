"""Queries of whole analyses over a population made of the tables: line items are genotyped, parts are markers, suppliers individuals."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomgeno.functions import likelihood, prior, special
from loomgeno.operators import hmm, sequences
from loomgeno.operators import workflow as W
from loomgeno.plans.models import CHAIN, EMIT, INIT, RATE, _chains, two_state
from loomgeno.plans.registry import query
from loomgeno.plans.views import GENO, MAP, OBS, POPS, geno, marker_map, observations, table
from loomgeno.sources import population as P

DESIGN = "4ril-self4"
#: Alleles of a subpopulation's four founders at a marker.
ALLELES = ("1122", "1212", "1221", "2112", "1N22", "2211")
FOUNDERS = "founders AS (SELECT m.marker, p.pop, ['1122', '1212', '1221', '2112', '1N22', '2211'][(m.marker + p.pop) % 6 + 1] AS alleles FROM (SELECT p_partkey AS marker FROM part) m, (SELECT unnest([0, 1, 2, 3, 4]) AS pop) p)"


def population(spark, d):
    pops = F.explode(F.array(*[F.lit(k).cast("long") for k in range(POPS)]))
    founders = marker_map(spark, d).select("marker", pops.alias("pop"))
    founders = founders.withColumn("alleles", F.element_at(F.array(*map(F.lit, ALLELES)), ((F.col("marker") + F.col("pop")) % 6 + 1).cast("int")))
    return P.Population(geno(spark, d).select("marker", "ind", "pop", "gt"), founders, marker_map(spark, d), {str(k): DESIGN for k in range(POPS)})


@query(f"""WITH {GENO}, miss AS (SELECT ind, avg(CASE WHEN gt = 'NN' THEN 1.0 ELSE 0.0 END) AS f FROM geno GROUP BY 1), g AS (SELECT * FROM geno WHERE ind IN (SELECT ind FROM miss WHERE f <= 0.035)),
s AS (SELECT marker, count(*) AS n, count(*) FILTER (gt = 'NN') AS nm, sum(CASE gt WHEN '11' THEN 2 WHEN '12' THEN 1 WHEN '1N' THEN 1 ELSE 0 END)::BIGINT AS n1, sum(CASE gt WHEN '22' THEN 2 WHEN '12' THEN 1 WHEN '2N' THEN 1 ELSE 0 END)::BIGINT AS n2 FROM g GROUP BY 1),
r AS (SELECT marker, CASE WHEN NOT nm / n <= 0.1 THEN 'missing' WHEN least(n2 / (n1 + n2), 1 - n2 / (n1 + n2)) < 0.3 THEN 'maf' END AS reason FROM s)
SELECT 'individual' AS kind, ind::VARCHAR AS name, 'missing' AS reason FROM miss WHERE NOT f <= 0.035 UNION ALL SELECT 'marker', marker::VARCHAR, reason FROM r WHERE reason IS NOT NULL""")
def filtered_population(spark, d):
    return W.filter_population(population(spark, d), most_missing=0.1, most_missing_individual=0.035, least_maf=0.3).audit


@query()
def disequilibrium_table(spark, d):
    """Chi-square tails have no SQL form; the least LOD grows with the tables."""
    p = W.filter_population(population(spark, d), most_missing=0.1)
    return W.disequilibrium(p).select("m1", "m2", "n", "df", F.round("lod", 5).alias("lod"))


@query()
def reconstructed_origins(spark, d):
    """Matrix exponentials of a rate matrix have no SQL form; tests hold it against sums over all paths."""
    return W.reconstruct(population(spark, d), least=0.01).select("lg", "ind", "marker", "state", F.round("prob", 6).alias("prob"))


@query()
def imputed_population(spark, d):
    """Founders, then offspring."""
    return W.impute(population(spark, d)).geno.select("marker", "ind", "pop", "gt")


@query()
def marker_errors(spark, d):
    return W.estimate_errors(population(spark, d), "marker", rounds=1).withColumn("error", F.round("error", 6))


@query()
def individual_errors(spark, d):
    return W.estimate_errors(population(spark, d), "ind").withColumn("error", F.round("error", 6))


@query()
def corrected_founders(spark, d):
    return W.correct_founders(population(spark, d)).withColumn("gain", F.round("gain", 4))


@query(f"WITH {GENO}, {FOUNDERS} SELECT g.marker, ind, CASE WHEN regexp_full_match(alleles, '1+') THEN '11' WHEN regexp_full_match(alleles, '2+') THEN '22' ELSE gt END AS gt FROM geno g JOIN founders f ON g.marker = f.marker AND g.pop = f.pop")
def nonsegregating_fixed(spark, d):
    return W.fix_nonsegregating(population(spark, d)).geno.select("marker", "ind", "gt")


@query(f"""WITH {OBS}, c AS (SELECT seq, t, coalesce(sym, 0) AS s, sym FROM obs), m AS (SELECT seq, CASE WHEN sym <> lag(sym) OVER (PARTITION BY seq ORDER BY t) THEN 1 ELSE 0 END AS m FROM c WHERE sym IS NOT NULL),
len AS (SELECT (max(t) - min(t)) * 0.2 AS morgan FROM obs), n AS (SELECT seq, sum(m)::BIGINT AS n FROM m GROUP BY 1)
SELECT o.seq AS ind, coalesce(n, 0) AS recomnum, round(coalesce(n, 0) / morgan, 6) AS recomden FROM (SELECT DISTINCT seq FROM obs) o LEFT JOIN n USING (seq), len""")
def recombination_density(spark, d):
    o = observations(spark, d).withColumn("lg", F.lit("a"))
    post = o.select("lg", F.col("seq").alias("ind"), "t", F.coalesce("sym", F.lit(1)).alias("state"), F.when(F.col("sym").isNull(), 0.5).otherwise(0.9).alias("prob"))
    marks = o.select("lg", (F.col("t") * 20.0).alias("pos")).distinct()
    return W.recombination_posterior(post, marks).withColumn("recomden", F.round("recomden", 6))


@query()
def recombination_priors(spark, d):
    """Priors come from recursions over the design's pedigree."""
    off = population(spark, d).geno.select("ind", "pop").distinct()
    return W.recombination_prior(off, {str(k): c for k, c in enumerate(("4ril-self4", "2ril-self6", "8ril-self4", "bc2-self3", "A/B//C=>DH"))}).select("ind", F.round("prior_inbredcoef", 8).alias("prior_inbredcoef"), F.round("prior_recomden", 8).alias("prior_recomden"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS ind FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT DISTINCT c_custkey AS ind FROM customer WHERE c_custkey % 3 > 0) SELECT ind, 'truth' AS side FROM a WHERE ind IN (SELECT ind FROM b) UNION ALL SELECT ind, 'estimate' FROM b WHERE ind IN (SELECT ind FROM a)""")
def aligned_individuals(spark, d):
    a = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("ind")).distinct()
    b = table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("ind"))
    x, y = W.aligned(a, b)
    return x.withColumn("side", F.lit("truth")).unionByName(y.withColumn("side", F.lit("estimate")))


@query()
def simulated_phenotypes(spark, d):
    """Effects and noise are drawn by hash."""
    g = geno(spark, d).where("gt in ('11', '12', '22')").select("marker", "ind", F.when(F.col("gt") == "11", 1.0).when(F.col("gt") == "12", 2.0).otherwise(3.0).alias("x"))
    return W.simulate_phenotype(g, 50, 0.5)[1].select("ind", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE {CHAIN}, mx AS (SELECT seq, max(t) AS n FROM e GROUP BY 1),
bk(seq, t, b1, b2) AS (SELECT seq, n, 1.0::DOUBLE, 1.0::DOUBLE FROM mx UNION ALL SELECT bk.seq, bk.t - 1,
  (s * e1 * b1 + (1 - s) * e2 * b2) / (s * e1 * b1 + (1 - s) * e2 * b2 + (1 - s) * e1 * b1 + s * e2 * b2), ((1 - s) * e1 * b1 + s * e2 * b2) / (s * e1 * b1 + (1 - s) * e2 * b2 + (1 - s) * e1 * b1 + s * e2 * b2)
  FROM bk JOIN e ON e.seq = bk.seq AND e.t = bk.t, stay WHERE bk.t > 1)
SELECT f.seq, f.t, round(a1 * b1 / (a1 * b1 + a2 * b2), 5) AS p1 FROM f JOIN bk ON f.seq = bk.seq AND f.t = bk.t""")
def hmm_posterior(spark, d):
    p = hmm.decode(_chains(spark, d), INIT, RATE, two_state, "posterior", keys=("seq",))
    return p.where("state = 1").select("seq", "t", F.round("prob", 5).alias("p1"))


@query(f"""WITH {MAP}, w AS (SELECT lg, count(*) AS n FROM map GROUP BY 1) SELECT lg, n, row_number() OVER (ORDER BY n DESC, lg)::INT AS turn FROM w""")
def chromosome_schedule(spark, d):
    return P.schedule(marker_map(spark, d))


@query(f"""WITH {MAP}, w AS (SELECT *, marker % 13 AS k FROM map), n AS (SELECT k, row_number() OVER (ORDER BY k)::VARCHAR AS lg FROM (SELECT DISTINCT k FROM w)) SELECT marker, 'LG' || n.lg AS lg FROM w JOIN n USING (k)""")
def natural_group_names(spark, d):
    m = marker_map(spark, d).select("marker", F.concat(F.lit("chr"), F.col("marker") % 13).alias("lg"))
    return P.group_names(m, "LG").select("marker", "lg")


@query(f"""WITH {GENO}, m AS (SELECT ind, avg(CASE WHEN gt = 'NN' THEN 1.0 ELSE 0.0 END) AS miss FROM geno GROUP BY 1) SELECT ind AS founder, ((row_number() OVER (ORDER BY miss, ind) - 1) // 8)::INT AS block FROM m""")
def founder_blocks(spark, d):
    m = geno(spark, d).groupBy(F.col("ind").alias("founder")).agg(F.avg((F.col("gt") == "NN").cast("double")).alias("miss"))
    return P.founder_blocks(m, 8)


@query("""SELECT user_id AS ind, count(*) AS n, string_agg(printf('%.1f', (event_id % 97) * 1.5), '|' ORDER BY (event_id % 97) * 1.5, event_id) || '=>' || string_agg(event_id::VARCHAR, '|' ORDER BY (event_id % 97) * 1.5, event_id) AS text FROM events GROUP BY 1""")
def segment_texts(spark, d):
    """Written, read and written again."""
    k = F.col("event_id")
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("ind")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(((k % 97) * 1.5).cast("double").alias("start"), k.alias("label")))).alias("s"))
    return e.select("ind", "n", P.text_of_segments(P.segments_of_text(P.text_of_segments(F.col("s")))).alias("text"))


@query(f"""WITH {OBS} SELECT seq AS ind, t, sym AS state, round(1.0 / (sym + 2), 4)::DOUBLE AS prob FROM obs WHERE sym IS NOT NULL""")
def ancestry_text_round_trip(spark, d):
    o = observations(spark, d).where("sym is not null").select(F.lit("a").alias("lg"), F.col("seq").alias("ind"), "t", F.col("sym").cast("int").alias("state"), (1.0 / (F.col("sym") + 2)).alias("prob"))
    return P.ancestry_long(P.ancestry_lines(o)).select("ind", "t", F.col("state").cast("long").alias("state"), "prob")


@query(f"""WITH {GENO}, {MAP}, c AS (SELECT marker, string_agg(gt, ',' ORDER BY ind::VARCHAR) AS cells FROM geno GROUP BY 1) SELECT marker, marker || ',' || lg || ',' || CASE WHEN round(pos, 4) = floor(pos) THEN printf('%.1f', pos) ELSE rtrim(printf('%.4f', pos), '0') END || ',NA,NA,NA,NA,GT_unphased,NA,NA,NA,NA,NA,NA,' || cells AS "value" FROM map JOIN c USING (marker)""")
def csv_genotypes(spark, d):
    return P.csv_lines(population(spark, d)).select("marker", "value")


@query(f"""WITH {MAP}, s AS (SELECT lg, marker, pos, ((marker * 13) % 400) / 100.0::DOUBLE AS lod FROM map), e AS (SELECT lg, max(pos) + 20 AS e FROM s GROUP BY 1), b AS (SELECT lg, coalesce(sum(e) OVER (ORDER BY lg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e)
SELECT lg, marker, round(b + pos, 4) AS x FROM s JOIN b USING (lg)""")
def manhattan_positions(spark, d):
    return W.manhattan_table(marker_map(spark, d).withColumn("lod", (F.col("marker") * 13) % 400 / 100)).select("lg", "marker", F.round("x", 4).alias("x"))


@query(f"""WITH {GENO}, s AS (SELECT marker, count(*) AS n, count(*) FILTER (gt = 'NN') AS m, sum(CASE gt WHEN '11' THEN 2 WHEN '12' THEN 1 WHEN '1N' THEN 1 ELSE 0 END)::BIGINT AS n1, sum(CASE gt WHEN '22' THEN 2 WHEN '12' THEN 1 WHEN '2N' THEN 1 ELSE 0 END)::BIGINT AS n2 FROM geno GROUP BY 1)
SELECT marker, round(m / n, 6) AS fmiss, round(CASE WHEN n1 + n2 > 0 THEN least(n1, n2) / (n1 + n2) END, 6) AS maf FROM s""")
def missing_by_maf(spark, d):
    return W.missing_by_maf(geno(spark, d)).select("marker", F.round("fmiss", 6).alias("fmiss"), F.round("maf", 6).alias("maf"))


@query(f"WITH {GENO} SELECT marker, ind, gt = 'NN' AS missing FROM geno")
def missing_cells(spark, d):
    return W.missing_table(geno(spark, d))


@query(f"WITH {MAP} SELECT lg, marker, round(pos, 4) AS pos, row_number() OVER (PARTITION BY lg ORDER BY pos, marker)::INT AS nth FROM map")
def map_positions(spark, d):
    return W.map_table(marker_map(spark, d)).withColumn("pos", F.round("pos", 4))


@query(f"""WITH {GENO}, {MAP}, {FOUNDERS}, x AS (SELECT lg, count(*) AS cells, count(DISTINCT g.marker) AS markers FROM geno g JOIN map m ON g.marker = m.marker GROUP BY 1) SELECT lg, cells, markers, (SELECT count(*) FROM founders f JOIN map m USING (marker) WHERE m.lg = x.lg) AS founders FROM x""")
def chromosomes_apart_and_together(spark, d):
    """Each linkage group by itself, then all together."""
    p = population(spark, d)
    p = replace(p, markers=p.markers.join(p.geno.select("marker").distinct(), "marker", "left_semi"))
    q = P.merged([P.chromosome(p, f"lg{k}") for k in range(4)])
    lg = marker_map(spark, d).select("marker", "lg")
    c = q.geno.join(lg, "marker").groupBy("lg").agg(F.count("*").alias("cells"), F.countDistinct("marker").alias("markers"))
    f = population(spark, d).founders.join(lg, "marker").groupBy("lg").agg(F.count("*").alias("founders"))
    return c.join(f, "lg")


@query("""WITH v AS (SELECT c_custkey AS id, c_custkey % 7 AS n1, c_custkey * 3 % 5 AS n2 FROM customer)
SELECT id, round(CASE WHEN n1 + n2 = 0 THEN 1 ELSE exp(n1 * ln(0.995) + n2 * ln(0.005) - greatest(n1 * ln(0.995) + n2 * ln(0.005), n1 * ln(0.005) + n2 * ln(0.995), (n1 + n2) * ln(0.5))) END, 6) AS l11,
 round(CASE WHEN n1 + n2 = 0 THEN 1 ELSE exp((n1 + n2) * ln(0.5) - greatest(n1 * ln(0.995) + n2 * ln(0.005), n1 * ln(0.005) + n2 * ln(0.995), (n1 + n2) * ln(0.5))) END, 6) AS l12 FROM v""")
def depth_likelihoods(spark, d):
    @F.pandas_udf("l11 double, l12 double")
    def like(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        x = np.array([likelihood.depth_given_true(int(i), int(j)) for i, j in zip(a, b)]).reshape(len(a), 4)
        return pd.DataFrame({"l11": x[:, 0], "l12": x[:, 1]})

    k = F.col("c_custkey")
    v = table(spark, d, "customer").select(k.alias("id"), (k % 7).alias("a"), (k * 3 % 5).alias("b"))
    return v.select("id", like("a", "b").alias("l")).select("id", F.round("l.l11", 6).alias("l11"), F.round("l.l12", 6).alias("l12"))


@query("""WITH c(code, k) AS (VALUES ('11', 0), ('12', 1), ('22', 2), ('NN', 3)), v AS (SELECT c_custkey AS id, (c_custkey % 50 + 1) / 1000.0::DOUBLE AS e, c_custkey % 4 AS k FROM customer)
SELECT id, code, round(CASE code WHEN '11' THEN (1 - e) ** 2 WHEN '12' THEN 2 * e * (1 - e) WHEN '22' THEN e * e ELSE 1 END, 8) AS given11, round(CASE code WHEN '11' THEN e * (1 - e) WHEN '12' THEN (1 - e) ** 2 + e * e WHEN '22' THEN e * (1 - e) ELSE 1 END, 8) AS given12 FROM v JOIN c USING (k)""")
def genotype_likelihoods(spark, d):
    @F.pandas_udf("given11 double, given12 double")
    def like(code: pd.Series, e: pd.Series) -> pd.DataFrame:
        x = np.array([likelihood.observed_given_true(float(v))[c] for c, v in zip(code, e)]).reshape(len(e), 4)
        return pd.DataFrame({"given11": x[:, 0], "given12": x[:, 1]})

    k = F.col("c_custkey")
    v = table(spark, d, "customer").select(k.alias("id"), ((k % 50 + 1) / 1000).alias("e"), F.element_at(F.array(*map(F.lit, ("11", "12", "22", "NN"))), (k % 4 + 1).cast("int")).alias("code"))
    return v.select("id", "code", like("code", "e").alias("l")).select("id", "code", F.round("l.given11", 8).alias("given11"), F.round("l.given12", 8).alias("given12"))


@query("""SELECT c_custkey AS id, round((1 + exp(-2 * (c_custkey % 300) * 0.01::DOUBLE)) / 2, 8) AS stay FROM customer""")
def transition_probabilities(spark, d):
    rate = np.array([[-1.0, 1.0], [1.0, -1.0]])

    @F.pandas_udf("double")
    def stay(k: pd.Series) -> pd.Series:
        seen = {g: 1.0 if (t := hmm.transition(rate, g * 0.01)) is None else float(t[0, 0]) for g in set(k)}
        return k.map(seen)

    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.round(stay((k % 300).cast("double")), 8).alias("stay"))


@query("""WITH v AS (SELECT c_custkey % 100 AS g, (c_custkey * 7 % 23) / 10.0::DOUBLE AS x FROM customer), s AS (SELECT g, count(*) AS n, sum(x) AS total, var_samp(x) AS v FROM v GROUP BY 1)
SELECT g, round(CASE WHEN v > 0 THEN total / sqrt(n * v) END, 5) + 0.0 AS z FROM s""")
def vuong_statistics(spark, d):
    k = F.col("c_custkey")
    v = table(spark, d, "customer").select((k % 100).alias("g"), (k * 7 % 23 / 10).alias("x"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        z = special.vuong(pdf.x.to_numpy(dtype=float), np.zeros(len(pdf)))
        return pd.DataFrame({"g": [key[0]], "z": [None if z != z else z]})

    return v.groupBy("g").applyInPandas(run, "g long, z double").withColumn("z", F.round("z", 5) + 0.0)


@query("""WITH v AS (SELECT c_custkey AS id, (c_custkey % 40 - 20) / 4.0::DOUBLE AS c FROM customer) SELECT id, round(least(greatest(c, -3), 4), 4) + 0.0 AS x, round(-power(least(greatest(c, -3), 4) - c, 2), 4) + 0.0 AS top FROM v""")
def bounded_maxima(spark, d):
    @F.pandas_udf("x double, top double")
    def best(c: pd.Series) -> pd.DataFrame:
        seen = {v: special.maximise(lambda x, v=v: -((x - v) ** 2), -3, 4, tol=1e-9) for v in set(c)}
        return pd.DataFrame([seen[v] for v in c], columns=["x", "top"])

    k = F.col("c_custkey")
    v = table(spark, d, "customer").select(k.alias("id"), ((k % 40 - 20) / 4.0).alias("c"))
    return v.select("id", best("c").alias("b")).select("id", (F.round("b.x", 4) + 0.0).alias("x"), (F.round("b.top", 4) + 0.0).alias("top"))


@query("""WITH g AS (SELECT unnest(range(1, 9)) AS k) SELECT '2ril-self' || k AS design, round(1 - power(0.5, k), 8) AS inbreeding, round(2 - power(0.5, k - 1), 8) AS expansion FROM g""")
def selfing_identity(spark, d):
    """Selfing from a cross of two lines: 1 - 2^-k inbred after k generations, and 2 - 2^(1 - k) junctions a Morgan."""
    rows = []
    for k in range(1, 9):
        ped = prior.design_pedigree(f"2ril-self{k}")
        i = prior.Identity(ped)
        rows.append((f"2ril-self{k}", float(i.inbreeding(ped[-1][0])), float(i.expansion(ped[-1][0], 0))))
    return spark.createDataFrame(rows, "design string, inbreeding double, expansion double").select("design", F.round("inbreeding", 8).alias("inbreeding"), F.round("expansion", 8).alias("expansion"))


@query(f"""WITH {MAP}, s AS (SELECT lg, marker, pos, row_number() OVER (PARTITION BY lg ORDER BY pos, marker)::INT AS nth FROM map) SELECT lg, marker, nth FROM s""")
def sorted_markers(spark, d):
    from pyspark.sql import Window

    m = sequences.sort_markers(marker_map(spark, d))
    return m.withColumn("nth", F.row_number().over(Window.partitionBy("lg").orderBy("pos", "marker"))).select("lg", "marker", "nth")
