"""Queries of hidden-Markov models, scans, maps, calling, imputation and simulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomgeno.functions import genotype as G
from loomgeno.functions import prior
from loomgeno.operators import graph, hmm, impute, maps, pairs, scan
from loomgeno.plans.registry import query
from loomgeno.plans.views import GENO, GROUPS, OBS, PHENO, geno, observations, phenotype, table

INIT, RATE, EMIT = np.array([0.5, 0.5]), np.array([[-1.0, 1.0], [1.0, -1.0]]), np.array([[0.9, 0.1], [0.2, 0.8]])


def two_state(pdf: pd.DataFrame) -> np.ndarray:
    s = pdf["sym"].fillna(0).to_numpy(dtype=int)
    return np.column_stack([np.ones(2), EMIT])[:, s].T


def _chains(spark, d):
    return observations(spark, d).withColumn("pos", F.col("t") * 20.0)


CHAIN = f"""{OBS}, e AS (SELECT seq, t, CASE sym WHEN 1 THEN 0.9 WHEN 2 THEN 0.1 ELSE 1.0 END::DOUBLE AS e1, CASE sym WHEN 1 THEN 0.2 WHEN 2 THEN 0.8 ELSE 1.0 END::DOUBLE AS e2 FROM obs), stay AS (SELECT (1 + exp(-0.4::DOUBLE)) / 2 AS s),
f(seq, t, a1, a2, ll) AS (SELECT seq, t, 0.5 * e1 / (0.5 * e1 + 0.5 * e2), 0.5 * e2 / (0.5 * e1 + 0.5 * e2), ln(0.5 * e1 + 0.5 * e2) FROM e WHERE t = 1
 UNION ALL SELECT e.seq, e.t, (a1 * s + a2 * (1 - s)) * e1 / ((a1 * s + a2 * (1 - s)) * e1 + (a1 * (1 - s) + a2 * s) * e2), (a1 * (1 - s) + a2 * s) * e2 / ((a1 * s + a2 * (1 - s)) * e1 + (a1 * (1 - s) + a2 * s) * e2), ll + ln((a1 * s + a2 * (1 - s)) * e1 + (a1 * (1 - s) + a2 * s) * e2)
 FROM f JOIN e ON f.seq = e.seq AND e.t = f.t + 1, stay)"""


@query(f"WITH RECURSIVE {CHAIN} SELECT seq, round(arg_max(ll, t), 5) AS loglik FROM f GROUP BY 1")
def hmm_loglik(spark, d):
    return hmm.decode(_chains(spark, d), INIT, RATE, two_state, "loglik", keys=("seq",)).withColumn("loglik", F.round("loglik", 5))


@query(f"""WITH RECURSIVE {CHAIN}, last AS (SELECT seq, max(t) AS t FROM e GROUP BY 1) SELECT f.seq, round(a1, 5) AS p1, round(a2, 5) AS p2 FROM f JOIN last ON f.seq = last.seq AND f.t = last.t""")
def hmm_last_posterior(spark, d):
    p = hmm.decode(_chains(spark, d), INIT, RATE, two_state, "posterior", keys=("seq",))
    end = p.groupBy("seq").agg(F.max("t").alias("t"))
    return p.join(end, ["seq", "t"]).groupBy("seq").agg(*[F.round(F.max(F.when(F.col("state") == k, F.col("prob"))), 5).alias(f"p{k}") for k in (1, 2)])


@query()
def hmm_viterbi(spark, d):
    """A change of state just before or just after a gap is equally likely, so SQL's rounding may choose otherwise."""
    return hmm.decode(_chains(spark, d), INIT, RATE, two_state, "viterbi", keys=("seq",))


@query()
def hmm_sampled_paths(spark, d):
    return hmm.decode(_chains(spark, d), INIT, RATE, two_state, "sample", keys=("seq",))


@query(f"""WITH {GENO}, {PHENO}, j AS (SELECT marker, CASE gt WHEN '11' THEN 1 WHEN '12' THEN 2 ELSE 3 END::DOUBLE AS x, y FROM geno JOIN pheno USING (ind) WHERE gt IN ('11', '12', '22')),
s AS (SELECT marker, count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM j GROUP BY 1) SELECT marker, n, round(slope, 5) + 0.0 AS slope, round(-n / 2 * log10(1 - r2), 5) + 0.0 AS lod FROM s""")
def scan_dose(spark, d):
    g = geno(spark, d).where("gt in ('11', '12', '22')").select("marker", "ind", G.dose(F.col("gt")).alias("x"))
    return scan.scan_dose(g, phenotype(spark, d)).select("marker", "n", (F.round("slope", 5) + 0.0).alias("slope"), (F.round("lod", 5) + 0.0).alias("lod"))


@query()
def scan_ancestry(spark, d):
    """Matrix solves have no SQL form."""
    g = geno(spark, d).withColumn("gp", G.depth_posterior(F.col("n1"), F.col("n2"))).select("marker", "ind", F.col("gp").alias("p"))
    return scan.scan(g, phenotype(spark, d))


@query()
def scan_threshold(spark, d):
    g = geno(spark, d).where("gt in ('11', '12', '22')").select("marker", "ind", G.dose(F.col("gt")).alias("x"))
    return spark.createDataFrame([(float(scan.permutation_threshold(g, phenotype(spark, d), 200)),)], "threshold double")


@query()
def call_depths(spark, d):
    return impute.call(geno(spark, d).select("marker", "ind", "n1", "n2"))


DESIGN = "4ril-self3"


def _chromosomes(spark, d):
    """Every supplier is a marker, of the linkage group and place it has in nearest_markers."""
    k = F.col("s_suppkey")
    out = {}
    for r in table(spark, d, "supplier").select((k % GROUPS).alias("lg"), ((k * 53) % 5000 / F.lit(10.0)).alias("pos"), k.alias("marker")).orderBy("lg", "pos", "marker").collect():
        markers, positions = out.setdefault(r.lg, ([], []))
        markers.append(r.marker)
        positions.append(r.pos)
    return out


def _population(spark, d, alleles=False):
    """Every customer is an individual."""
    chromosomes = _chromosomes(spark, d)
    keys = table(spark, d, "customer").select(F.explode(F.array(*[F.lit(lg).cast("long") for lg in chromosomes])).alias("lg"), F.col("c_custkey").cast("long").alias("ind"))
    return impute.simulate_over(keys, chromosomes, DESIGN, err=0.005, missing=0.1, alleles=alleles), impute.founder_rows(spark, DESIGN, chromosomes)


@query()
def simulated_population(spark, d):
    """Random by seed."""
    return _population(spark, d)[0]


@query()
def impute_offspring(spark, d):
    return impute.offspring(_population(spark, d, True)[0], sum(a == "0" for _, a, _ in prior.design_pedigree(DESIGN)), 2.5)


@query()
def linkage_pairs(spark, d):
    g, founders = _population(spark, d)
    return maps.linkage(g.select("marker", "ind", "gt"), founders)


@query()
def linkage_map(spark, d):
    p = linkage_pairs(spark, d).select(F.col("m1").alias("a"), F.col("m2").alias("b"), "rf", "lod")
    sim = maps.similarity(p, 1.0, 0.4).persist()
    groups = graph.components(sim).withColumnRenamed("root", "lg")
    return maps.order_groups(sim, groups)


@query()
def duplicate_bins(spark, d):
    g = geno(spark, d)
    dup = pairs.duplicate_markers(g, 8, 0.3, most_differ=0.1).select(F.col("m1").alias("a"), F.col("m2").alias("b"))
    miss = g.groupBy(F.col("marker").alias("id")).agg(F.avg((F.col("gt") == "NN").cast("double")).alias("miss"))
    return graph.duplicate_bins(spark, dup, miss)


@query()
def pedigree_identity(spark, d):
    """Inbreeding and map expansion of each member of a design's pedigree."""
    ped = prior.design_pedigree(DESIGN)
    i = prior.Identity(ped)
    return spark.createDataFrame([(m, float(i.inbreeding(m)), float(i.expansion(m, 0)), float(i.expansion(m, 1))) for m, _, _ in ped], "member string, inbreeding double, junctions_m double, junctions_p double")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT label AS a, vec_id + 1000000 AS b FROM embeddings), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a AS id FROM s),
r(id, root) AS (SELECT id, id FROM n UNION SELECT s.b, r.root FROM r JOIN s ON r.id = s.a) SELECT id::BIGINT AS id, min(root)::BIGINT AS root FROM r GROUP BY 1""")
def marker_components(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("a"), (F.col("vec_id") + 1000000).alias("b"))
    return graph.components(e)
