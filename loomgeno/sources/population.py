"""A population as tables: offspring cells, founders' alleles, marker map, audit; loading, saving, parts of it as text.

Nothing is held in memory: a population is a handful of DataFrames and the short list of its subpopulations' designs."""

from __future__ import annotations

import ast
import os
import re
import tarfile
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgeno.functions import genotype as G
from loomgeno.functions import prior
from loomgeno.sources import variants


@dataclass
class Population:
    """geno(marker, ind, pop, gt): offspring; founders(marker, pop, alleles): a letter for each of the subpopulation's founders, in
    order; markers(marker, lg, pos); designs: a design code for each subpopulation; audit(kind, name, reason): what was dropped."""

    geno: DataFrame
    founders: DataFrame
    markers: DataFrame
    designs: dict
    audit: DataFrame | None = field(default=None)

    def noted(self, rows: DataFrame) -> Population:
        """With rows (kind, name, reason) added to the audit."""
        rows = rows.select(F.col("kind").cast("string"), F.col("name").cast("string"), F.col("reason").cast("string"))
        return replace(self, audit=rows if self.audit is None else self.audit.unionByName(rows, allowMissingColumns=True))


TABLES = ("geno", "founders", "markers", "audit")


def assemble(cells: DataFrame, markers: DataFrame, pedigree: DataFrame, designs: dict, inbred: bool = True) -> Population:
    """cells(marker, sample, gt) as unphased codes, pedigree(sample, pop, role, place): role is founder or offspring, and founders of a
    subpopulation have places from 1. A sample may be a founder of several subpopulations."""
    g = cells.select("marker", "sample", G.canonical(F.translate("gt", "|/", "")).alias("gt"))
    allele = G.inbred(F.col("gt")) if inbred else F.col("gt")
    f = g.join(pedigree.where("role = 'founder'").select("sample", "pop", "place"), "sample").select("marker", "pop", "place", allele.alias("a"))
    # As many letters as a subpopulation has founders.
    founders = f.groupBy("marker", "pop").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "a"))), lambda x: x["a"]), "").alias("alleles"))
    own = g.join(pedigree.where("role = 'offspring'").select("sample", "pop"), "sample").select("marker", F.col("sample").alias("ind"), "pop", "gt")
    return Population(own, founders, markers.select("marker", "lg", "pos"), dict(designs))


def load(lines: DataFrame, pedigree: DataFrame, designs: dict, priority: tuple[str, ...] = ("GT",), recombination: float = 1.0) -> Population:
    """assemble() from VCF lines; a marker without group and position takes its chromosome and `recombination` cM a megabase."""
    long = variants.vcf_long(lines, priority=priority)
    info = variants.info_fields(F.col("info"))
    markers = long.select("marker", "chrom", "pos", "info").distinct().select("marker", F.coalesce(info["linkagegroup"], F.col("chrom")).alias("lg"), F.coalesce(info["poscm"], F.col("pos") * recombination * 1e-6).alias("pos"))
    return assemble(long.select("marker", "sample", F.coalesce("value", F.lit("NN")).alias("gt")), markers, pedigree, designs)


def pedigree_of_samples(spark: SparkSession, samples: list[str], design: str, pop: str = "pop") -> DataFrame:
    """(sample, pop, role, place): the first samples, or those that a cross names, are the design's founders, all others its
    offspring. The list is a file's header."""
    d = prior.parse_design(design)
    names = prior.founders_of(d["tree"]) if d["kind"] == "cross" else samples[: d["founders"]]
    if missing := [n for n in names if n not in samples]:
        raise ValueError(f"founders without a sample: {missing}")
    rows = [(n, pop, "founder", k + 1) for k, n in enumerate(names)] + [(s, pop, "offspring", None) for s in samples if s not in names]
    return spark.createDataFrame(rows, "sample string, pop string, role string, place int")


def save(p: Population, path: str) -> None:
    """Parquet tables in a folder; cells are partitioned by linkage group, so one chromosome can be read alone."""
    spark = p.geno.sparkSession
    lg = p.markers.select("marker", "lg")
    p.geno.join(lg, "marker").write.mode("overwrite").partitionBy("lg").parquet(f"{path}/geno")
    p.founders.write.mode("overwrite").parquet(f"{path}/founders")
    p.markers.write.mode("overwrite").parquet(f"{path}/markers")
    if p.audit is not None:
        p.audit.write.mode("overwrite").parquet(f"{path}/audit")
    spark.createDataFrame(list(p.designs.items()), "pop string, design string").write.mode("overwrite").parquet(f"{path}/designs")


def reopen(spark: SparkSession, path: str, groups: list[str] | None = None) -> Population:
    """What save() wrote, whole or some linkage groups of it."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    geno, markers = read("geno"), read("markers")
    if groups is not None:
        geno, markers = geno.where(F.col("lg").cast("string").isin(groups)), markers.where(F.col("lg").cast("string").isin(groups))
    founders = read("founders").join(markers.select("marker"), "marker", "left_semi")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/audit")
    audit = read("audit") if at.getFileSystem(conf).exists(at) else None
    return Population(geno.drop("lg"), founders, markers, {r.pop: r.design for r in read("designs").collect()}, audit)


def chromosome(p: Population, lg: str) -> Population:
    """One linkage group."""
    m = p.markers.where(F.col("lg") == lg)
    return replace(p, geno=p.geno.join(m, "marker", "left_semi"), founders=p.founders.join(m, "marker", "left_semi"), markers=m)


def merged(parts: list[Population]) -> Population:
    """Linkage groups put together again."""
    out = parts[0]
    for q in parts[1:]:
        audit = out.audit if q.audit is None else q.audit if out.audit is None else out.audit.unionByName(q.audit, allowMissingColumns=True)
        out = Population(out.geno.unionByName(q.geno), out.founders.unionByName(q.founders), out.markers.unionByName(q.markers), out.designs | q.designs, audit)
    return out


def schedule(markers: DataFrame) -> DataFrame:
    """(lg, n, turn): linkage groups with most markers first, as long tasks should start first."""
    n = markers.groupBy("lg").agg(F.count("*").alias("n"))
    return n.withColumn("turn", F.row_number().over(Window.orderBy(F.desc("n"), "lg")))


def csv_lines(p: Population, missing: str = "NA") -> DataFrame:
    """(lg, pos, marker, value): a line a marker of the fourteen map columns and a column a sample; samples are in order of name and
    named by csv_header(). A row holds all samples, as the format demands."""
    cells = p.geno.groupBy("marker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("ind").cast("string").alias("i"), "gt"))), lambda x: x["gt"]), ",").alias("cells"))
    rows = p.markers.join(cells, "marker")
    na = [F.lit(missing)] * 3
    return rows.select("lg", "pos", "marker", F.concat_ws(",", F.col("marker").cast("string"), F.coalesce(F.col("lg").cast("string"), F.lit(missing)), F.coalesce(F.round("pos", 4).cast("string"), F.lit(missing)), *na, F.lit(missing), F.lit("GT_unphased"), *[F.lit(missing)] * 6, "cells").alias("value"))


def csv_header(p: Population) -> str:
    names = sorted(str(r[0]) for r in p.geno.select("ind").distinct().collect())
    return ",".join([*variants.MAP_COLUMNS, *names])


def segments_of_text(text: Column) -> Column:
    """`b1|b2=>l1|l2` as an array of (start, label)."""
    starts, labels = F.split(F.split(text, "=>")[0], r"\|"), F.split(F.split(text, "=>")[1], r"\|")
    return F.transform(F.arrays_zip(starts.alias("start"), labels.alias("label")), lambda x: F.struct(x["start"].cast("double").alias("start"), x["label"].cast("int").alias("label")))


def text_of_segments(segments: Column) -> Column:
    return F.concat(F.array_join(F.transform(segments, lambda s: s["start"].cast("string")), "|"), F.lit("=>"), F.array_join(F.transform(segments, lambda s: s["label"].cast("string")), "|"))


def ancestry_lines(post: DataFrame, least: float = 1e-4, digits: int = 4) -> DataFrame:
    """post(lg, ind, t, state, prob): a row (lg, ind, nmarker, nstate, markerindex, stateindex, probability) an individual and linkage
    group; the last three are texts of the entries from `least` up, joined by bars."""
    kept = post.withColumn("prob", F.round("prob", digits)).groupBy("lg", "ind").agg(F.max("t").alias("nmarker"), F.max("state").alias("nstate"), F.sort_array(F.collect_list(F.when(F.col("prob") >= least, F.struct("t", "state", "prob")))).alias("e"))
    text = lambda c: F.array_join(F.transform("e", lambda x: x[c].cast("string")), "|")
    return kept.select("lg", "ind", "nmarker", "nstate", text("t").alias("markerindex"), text("state").alias("stateindex"), text("prob").alias("probability"))


def ancestry_long(lines: DataFrame) -> DataFrame:
    """The inverse of ancestry_lines(): (lg, ind, t, state, prob)."""
    part = lambda c, kind: F.transform(F.split(c, r"\|"), lambda x: x.cast(kind))
    z = F.arrays_zip(part("markerindex", "long").alias("t"), part("stateindex", "int").alias("state"), part("probability", "double").alias("prob"))
    return lines.select("lg", "ind", F.inline(z)).toDF("lg", "ind", "t", "state", "prob")


def archive(folder: str, to: str) -> str:
    """A folder's files as one .tar.gz, on the driver: for hand-over, not for work."""
    with tarfile.open(to, "w:gz") as t:
        for name in sorted(os.listdir(folder)):
            t.add(os.path.join(folder, name), arcname=name)
    return to


def array_samples(header: str, sep: str = "\t", suffix: str = "Top Alleles") -> list[str]:
    """Sample names in the header of a vendor's wide report."""
    return [c.replace(suffix, "").strip(" .-_") for c in header.split(sep)[1:] if suffix in c]


def parse_parameters(text: str, defaults: dict) -> dict:
    """`name=value` pairs in brackets or bare, over defaults; values are literals or priors such as Beta(1, 199). Names that the
    defaults lack are an error, and nothing is evaluated."""
    out = dict(defaults)
    body = re.sub(r"^\s*\w+\s*\(|\)\s*$", "", text) if re.match(r"\s*[A-Z]\w*\s*\(", text) else text
    for m in re.finditer(r"(\w+)\s*=\s*([A-Za-z]+\([^)]*\)|[^,;]+)", body):
        if m[1] not in out:
            raise ValueError(f"no parameter: {m[1]}")
        call = re.fullmatch(r"([A-Za-z]+)\(([^)]*)\)", m[2].strip())
        out[m[1]] = (call[1], *(float(x) for x in call[2].split(","))) if call else None if m[2].strip() == "nothing" else ast.literal_eval(m[2].strip().replace("true", "True").replace("false", "False"))
    return out


def split_extensions(name: str) -> tuple[str, str]:
    """A file's stem and all its extensions: `a.b/x.vcf.gz` is (`a.b/x`, `.vcf.gz`)."""
    folder, base = os.path.split(name)
    stem, dot, rest = base.partition(".")
    return os.path.join(folder, stem), dot + rest


def group_names(markers: DataFrame, prefix: str = "") -> DataFrame:
    """markers with linkage groups renamed 1, 2, ... in natural order of their names: chr2 before chr10."""
    names = markers.select("lg").distinct()
    digits, text = F.regexp_extract(F.col("lg").cast("string"), r"(\d+)", 1), F.regexp_replace(F.col("lg").cast("string"), r"\d+", "")
    order = Window.orderBy(text, F.when(digits != "", digits.try_cast("long")).asc_nulls_last(), "lg")
    new = names.select("lg", F.concat(F.lit(prefix), F.row_number().over(order).cast("string")).alias("__new"))
    return markers.join(F.broadcast(new), "lg").withColumn("lg", F.col("__new")).drop("__new")


def founder_blocks(missing: DataFrame, size: int) -> DataFrame:
    """missing(founder, miss): (founder, block): founders in blocks of `size`, those with least missing first."""
    nth = F.row_number().over(Window.orderBy("miss", "founder")) - 1
    return missing.withColumn("block", F.floor(nth / size).cast("int")).select("founder", "block")


def triangular_ranges(n: int, parts: int) -> list[tuple[int, int]]:
    """Ranges of first members of the pairs i < j among n, with about equal numbers of pairs."""
    total, out, start = n * (n - 1) / 2, [], 0
    for k in range(1, parts + 1):
        left = total * (1 - k / parts)
        # The least stop whose later pairs number no more than `left`.
        stop = n if k == parts else max(start, int(-(-(n - (1 + (1 + 8 * left) ** 0.5) / 2) // 1)))
        out.append((start, stop))
        start = stop
    return out
