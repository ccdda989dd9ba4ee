"""Genotype-shaped views of the star schema, in Spark and, as WITH parts, in SQL. Integer arithmetic makes both agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Subpopulations and linkage groups of the views. Markers are parts and individuals suppliers, so both grow with the tables.
POPS, GROUPS = 5, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(marker, ind, pop, k, gt, n1, n2): one row for each part and supplier that share a line item."""
    li = table(spark, sf_dir, "lineitem")
    key = F.col("l_partkey").alias("marker"), F.col("l_suppkey").alias("ind")
    one = li.groupBy(*key).agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seed"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    # A shared factor of the individual makes neighbouring markers agree more often than chance.
    k = ((F.col("ind") * 7 + F.floor(F.col("marker") / 10) * 3) % 6 + F.when(F.col("seed") % 4 == 0, F.col("seed") % 7).otherwise(0)).cast("long") % 11
    gt = F.when(F.col("k") <= 2, "11").when(F.col("k") <= 5, "22").when(F.col("k") <= 7, "12").when(F.col("k") == 8, "1N").when(F.col("k") == 9, "2N").otherwise("NN")
    return one.withColumn("k", k).select("marker", "ind", (F.col("ind") % POPS).alias("pop"), "k", gt.alias("gt"), (F.col("q") % 13).alias("n1"), (F.col("seed") % 9).alias("n2"))


GENO = f"""one AS (SELECT l_partkey AS marker, l_suppkey AS ind, min(l_orderkey * 8 + l_linenumber) AS seed, sum(CAST(l_quantity AS BIGINT))::BIGINT AS q FROM lineitem GROUP BY ALL),
geno0 AS (SELECT *, ((ind * 7 + (marker // 10) * 3) % 6 + CASE WHEN seed % 4 = 0 THEN seed % 7 ELSE 0 END) % 11 AS k FROM one),
geno AS (SELECT marker, ind, ind % {POPS} AS pop, k, CASE WHEN k <= 2 THEN '11' WHEN k <= 5 THEN '22' WHEN k <= 7 THEN '12' WHEN k = 8 THEN '1N' WHEN k = 9 THEN '2N' ELSE 'NN' END AS gt, q % 13 AS n1, seed % 9 AS n2 FROM geno0)"""


def marker_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(marker, lg, pos): one row a part."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("marker"), F.concat(F.lit("lg"), (F.col("p_partkey") % GROUPS).cast("string")).alias("lg"), ((F.col("p_partkey") * 37 + F.col("p_size") * 11) % 5000 / F.lit(10.0)).alias("pos"))


MAP = f"""map AS (SELECT p_partkey AS marker, 'lg' || (p_partkey % {GROUPS}) AS lg, ((p_partkey * 37 + p_size * 11) % 5000) / 10.0::DOUBLE AS pos FROM part)"""


def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(member, mother, father): parents by integer division; members up to 4 are founders with parents 0. Members count
    from 1, as 0 is nobody."""
    c = table(spark, sf_dir, "customer")
    m = F.col("c_custkey") + 1
    return c.select(m.alias("member"), F.when(m <= 4, 0).otherwise(F.floor(m / 2)).cast("long").alias("mother"), F.when(m <= 4, 0).otherwise(F.floor(m / 3)).cast("long").alias("father"))


PED = """ped AS (SELECT c_custkey + 1 AS member, CASE WHEN c_custkey < 4 THEN 0 ELSE (c_custkey + 1) // 2 END AS mother, CASE WHEN c_custkey < 4 THEN 0 ELSE (c_custkey + 1) // 3 END AS father FROM customer)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, t, sym): a user's events in order; sym is 1 or 2, or null for every ninth event."""
    e = table(spark, sf_dir, "events")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    sym = F.when(F.col("event_id") % 9 == 0, None).otherwise(F.floor(F.col("event_id") / 3) % 2 + 1)
    return e.select(F.col("user_id").alias("seq"), t.cast("long").alias("t"), sym.cast("long").alias("sym"))


OBS = """obs AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id // 3) % 2 + 1 END AS sym FROM events)"""


def phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ind, y, pop): mean price of a supplier's line items."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("ind")).agg((F.sum(F.floor("l_extendedprice").cast("long")) / F.count("*") / 1000).alias("y")).withColumn("pop", F.col("ind") % POPS)


PHENO = f"""pheno AS (SELECT l_suppkey AS ind, sum(CAST(floor(l_extendedprice) AS BIGINT))::DOUBLE / count(*) / 1000 AS y, l_suppkey % {POPS} AS pop FROM lineitem GROUP BY ALL)"""
