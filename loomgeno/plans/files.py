"""Queries of readers and writers over text made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgeno.plans.registry import query
from loomgeno.plans.views import table
from loomgeno.sources import variants as V

SAMPLES = ("a", "b", "c", "d")
_GT = ("0/0", "0|1", "./.", "1/1", "2/1")


def _vcf(spark, d):
    k = F.col("p_partkey")
    gts = F.array(*map(F.lit, _GT))
    cell = lambda i: F.when((k + i) % 4 == 0, F.element_at(gts, ((k + i) % 5 + 1).cast("int"))).when(k % 3 == 0, F.concat(F.element_at(gts, ((k + i) % 5 + 1).cast("int")), F.lit(":."))).otherwise(F.concat(F.element_at(gts, ((k + i) % 5 + 1).cast("int")), F.lit(":"), F.col("p_size"), F.lit(","), k % 7))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), k % 4), (k * 100).cast("string"), F.when(k % 10 == 0, ".").otherwise(F.concat(F.lit("m"), k)), F.lit("A"), F.when(k % 13 == 0, "C,G").otherwise("C"), F.lit("."), F.lit("PASS"), F.concat(F.lit("LINKAGEGROUP=g"), k % 3, F.lit(";POSCM="), F.col("p_size"), F.lit(".5;DP=1,2;X")), F.lit("GT:AD"), *[cell(i) for i in range(4)])
    head = spark.createDataFrame([("##fileformat=VCFv4.3",), ("#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *SAMPLES]),)], "value string")
    return head.unionByName(table(spark, d, "part").select(line.alias("value")))


@query("""WITH p AS (SELECT *, unnest([0, 1, 2, 3]) AS i FROM part WHERE p_partkey % 13 <> 0),
c AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'chr' || (p_partkey % 4) || '_' || (p_partkey * 100) ELSE 'm' || p_partkey END AS marker, ['a', 'b', 'c', 'd'][i + 1] AS sample, CASE WHEN p_partkey % 3 = 0 THEN 'GT' ELSE 'AD' END AS fmt,
  (p_partkey + i) % 4 = 0 AS short, p_size || '&' || (p_partkey % 7) AS ad, ['1/1', '1|2', 'NN', '2/2', '2/2'][(p_partkey + i) % 5 + 1] AS gt FROM p)
SELECT marker, sample, fmt, CASE WHEN fmt = 'GT' THEN gt WHEN short THEN NULL ELSE ad END AS "value" FROM c""")
def read_vcf_lines(spark, d):
    return V.vcf_long(_vcf(spark, d)).select("marker", "sample", "fmt", "value")


@query("""SELECT CASE WHEN p_partkey % 10 = 0 THEN 'chr' || (p_partkey % 4) || '_' || (p_partkey * 100) ELSE 'm' || p_partkey END AS marker, 'g' || (p_partkey % 3) AS linkagegroup, p_size + 0.5::DOUBLE AS poscm, 'DP=1|2;X' AS rest FROM part WHERE p_partkey % 13 <> 0""")
def vcf_info(spark, d):
    c = V.vcf_long(_vcf(spark, d)).where("sample = 'a'").select("marker", V.info_fields(F.col("info")).alias("i"))
    return c.select("marker", "i.linkagegroup", "i.poscm", "i.rest")


@query("""WITH p AS (SELECT p_partkey AS k, unnest([0, 1, 2, 3]) AS i FROM part), c AS (SELECT 'm' || k AS marker, ['a', 'b', 'c', 'd'][i + 1] AS sample, ['AA', 'AC', 'CC', 'NN', 'CA'][(k * 3 + i) % 5 + 1] AS cell FROM p),
n AS (SELECT marker, count(*) FILTER (x = 'A') AS a, count(*) FILTER (x = 'C') AS c FROM (SELECT marker, unnest(string_split(cell, '')) AS x FROM c) GROUP BY 1),
r AS (SELECT marker, CASE WHEN a >= c THEN 'A' ELSE 'C' END AS ref, CASE WHEN a = 0 OR c = 0 THEN NULL WHEN a >= c THEN 'C' ELSE 'A' END AS alt, greatest(a, c) / (a + c) AS freq FROM n)
SELECT c.marker, sample, ref, alt, CASE WHEN cell[1] = ref THEN '0' WHEN cell[1] = alt THEN '1' ELSE '.' END || '/' || CASE WHEN cell[2] = ref THEN '0' WHEN cell[2] = alt THEN '1' ELSE '.' END AS gt, round(freq, 6) AS freq FROM c JOIN r USING (marker)""")
def array_calls(spark, d):
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k, F.posexplode(F.array(*map(F.lit, SAMPLES))).alias("i", "sample"))
    cells = p.select(F.concat(F.lit("m"), k).alias("marker"), "sample", F.element_at(F.array(*map(F.lit, ("AA", "AC", "CC", "NN", "CA"))), ((k * 3 + F.col("i")) % 5 + 1).cast("int")).alias("cell"))
    return V.letters_to_gt(cells).join(V.allele_frequencies(cells).select("marker", F.round("freq", 6).alias("freq")), "marker").select("marker", "sample", "ref", "alt", "gt", "freq")


@query("""SELECT 'lg' || (p_partkey % 4) || chr(9) || 'm' || p_partkey || chr(9) || (p_partkey + 0.5)::DECIMAL(18,1) || chr(9) || (p_partkey * 1000) AS "value" FROM part""")
def plink_map(spark, d):
    k = F.col("p_partkey")
    m = table(spark, d, "part").select(F.concat(F.lit("m"), k).alias("marker"), F.concat(F.lit("lg"), k % 4).alias("lg"), (k + 0.5).alias("pos"), F.lit("c").alias("chrom"), (k * 1000).alias("bp"))
    return V.plink_map(m)


@query("""WITH e AS (SELECT s_suppkey AS a, s_suppkey * 7 % 50 + 200 AS b, (s_suppkey % 9) / 2.0::DOUBLE AS v FROM supplier), s AS (SELECT a, b, v FROM e UNION ALL SELECT b, a, v FROM e)
SELECT a, b, v FROM s UNION ALL SELECT a, a, max(v) FROM s GROUP BY a""")
def symmetric_pairs(spark, d):
    k = F.col("s_suppkey")
    return V.symmetric(table(spark, d, "supplier").select(k.alias("a"), (k * 7 % 50 + 200).alias("b"), (k % 9 / 2).alias("v")))


@query("""WITH m AS (SELECT c_custkey AS nth, c_custkey % 700 AS marker, c_custkey // 300 % 3 AS lg, c_custkey % 50 AS pos FROM customer), w AS (SELECT *, lag(nth) OVER o AS pn, lag(pos) OVER o AS pp FROM m WINDOW o AS (PARTITION BY lg ORDER BY nth))
SELECT 'repeated' AS issue, marker FROM m GROUP BY marker HAVING count(*) > 1 UNION ALL SELECT 'not consecutive', marker FROM w WHERE nth - pn > 1 UNION ALL SELECT 'falling', marker FROM w WHERE pos < pp""")
def map_issues(spark, d):
    k = F.col("c_custkey")
    return V.map_issues(table(spark, d, "customer").select(k.alias("nth"), (k % 700).alias("marker"), (F.floor(k / 300) % 3).alias("lg"), (k % 50).alias("pos")))


@query("""WITH g AS (SELECT o_custkey + 7 AS ind FROM orders), p AS (SELECT c_custkey AS ind FROM customer UNION ALL SELECT c_custkey // 100 FROM customer)
SELECT 'not genotyped' AS issue, ind FROM p WHERE ind NOT IN (SELECT ind FROM g) UNION ALL SELECT 'not in pedigree', ind FROM (SELECT DISTINCT ind FROM g) WHERE ind NOT IN (SELECT ind FROM p) UNION ALL SELECT 'repeated', ind FROM p GROUP BY ind HAVING count(*) > 1""")
def input_issues(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    return V.input_issues(table(spark, d, "orders").select((F.col("o_custkey") + 7).alias("ind")), c.select(k.alias("ind")).unionByName(c.select(F.floor(k / 100).alias("ind"))))


@query("""WITH RECURSIVE p AS (SELECT *, unnest([0, 1, 2, 3]) AS i FROM part),
c AS (SELECT p_partkey AS k, i, ['0/0', '0|1', '..', '1/1', '1/1'][(p_partkey + i) % 5 + 1] AS v FROM p),
s AS (SELECT 'chr' || (k % 4) AS chrom, k * 100 AS pos, CASE WHEN k % 10 = 0 THEN 'chr' || (k % 4) || '_' || (k * 100) ELSE 'm' || k END AS marker, k % 13 = 0 AS multi, sum(length(v) - length(replace(v, '0', ''))) AS n0, sum(length(v) - length(replace(v, '1', ''))) AS n1, avg(CASE WHEN contains(v, '.') THEN 1.0 ELSE 0.0 END) AS miss, string_agg(v, ',' ORDER BY i) AS h FROM c GROUP BY k),
o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos, marker) AS nth, length(marker) % 5 = 0 AS bad FROM s),
r AS (SELECT chrom, 0::BIGINT AS nth, NULL::BIGINT AS last_pos, NULL::VARCHAR AS last_h, NULL::VARCHAR AS why FROM (SELECT DISTINCT chrom FROM o)
 UNION ALL SELECT chrom, nth, CASE WHEN why IS NULL THEN pos ELSE last_pos END, CASE WHEN why IS NULL OR why NOT IN ('filter', 'duplicate') THEN h ELSE last_h END, why FROM (SELECT o.chrom, o.nth, o.pos, o.h, r.last_pos, r.last_h,
  CASE WHEN bad THEN 'filter' WHEN o.h = r.last_h THEN 'duplicate' WHEN o.pos - r.last_pos < 300 THEN 'stretch' WHEN multi THEN 'multiallelic' WHEN least(n0, n1) = 0 THEN 'monomorphic' WHEN miss > 0.3 THEN 'missing' WHEN least(n0, n1) / (n0 + n1) < 0.1 THEN 'maf' END AS why FROM r JOIN o ON o.chrom = r.chrom AND o.nth = r.nth + 1))
SELECT chrom, pos, marker, why AS reason FROM r JOIN o USING (chrom, nth)""")
def vcf_line_filter(spark, d):
    """Compares each marker with the last one kept."""
    c = V.vcf_long(_vcf(spark, d), priority=("GT",), keep_multiallelic=True)
    c = c.select("chrom", "pos", "marker", "alt", F.when(F.length("marker") % 5 == 0, "q10").otherwise("PASS").alias("filter"), "sample", F.translate("value", "12N", "01.").alias("value"))
    return V.filter_lines(c, stretch=300, most_missing=0.3, least_maf=0.1)
