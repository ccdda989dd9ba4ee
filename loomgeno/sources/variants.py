"""Readers and writers of genotype text: VCF, HapMap, two-letter arrays, JoinMap, multi-table CSV, pair tables, pedigrees.

Files are read as lines and split by SQL functions; nothing but headers comes to the driver. gzip files are read whole by one
task each, as the format demands, and should be repartitioned after reading."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of a marker's INFO that become columns.
INFO_FIELDS = ("LINKAGEGROUP", "POSCM", "FOUNDERERROR", "OFFSPRINGERROR", "BASEERROR", "ALLELICBIAS", "ALLELICOVERDISPERSION", "ALLELEDROPOUT", "AR2")
#: The fourteen columns before the samples of a CSV genotype file.
MAP_COLUMNS = ("marker", "linkagegroup", "poscm", "physchrom", "physposbp", "info", "founderformat", "offspringformat", "foundererror", "offspringerror", "baseerror", "allelicbias", "allelicoverdispersion", "allelicdropout")


def info_fields(info: Column) -> Column:
    """Struct of the known fields of `k=v;...` text and the rest as text with commas turned to bars."""
    m = F.str_to_map(F.coalesce(info, F.lit("")), F.lit(";"), F.lit("="))
    num = lambda k: m[k].try_cast("double")
    rest = F.map_filter(m, lambda k, v: ~k.isin(*INFO_FIELDS) & (k != "") & (k != "."))
    text = F.array_join(F.transform(F.map_entries(rest), lambda e: F.when(e["value"].isNull(), e["key"]).otherwise(F.concat(e["key"], F.lit("="), F.translate(e["value"], ",", "|")))), ";")
    return F.struct(m["LINKAGEGROUP"].alias("linkagegroup"), *[num(k).alias(k.lower()) for k in INFO_FIELDS[1:]], text.alias("rest"))


def vcf_long(lines: DataFrame, samples: list[str] | None = None, priority: tuple[str, ...] = ("AD", "GT"), keep_multiallelic: bool = False) -> DataFrame:
    """lines(value) of a VCF: (marker, chrom, pos, ref, alt, info, sample, fmt, value). A marker has one format, the first of
    `priority` that any of its cells shows; cells without it are missing. Alleles are 1 and 2 (any further one is 2), phase
    stays as | or /, depths and probabilities are joined by &."""
    if samples is None:
        head = lines.where(F.col("value").startswith("#CHROM")).first()
        samples = head.value.split("\t")[9:]
    c = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("c"))
    ids = F.array(*map(F.lit, samples))
    c = c.select(
        F.when(F.col("c")[2] == ".", F.concat_ws("_", F.col("c")[0], F.col("c")[1])).otherwise(F.col("c")[2]).alias("marker"), F.col("c")[0].alias("chrom"), F.col("c")[1].cast("long").alias("pos"), F.col("c")[3].alias("ref"), F.col("c")[4].alias("alt"),
        F.col("c")[7].alias("info"), F.split(F.col("c")[8], ":").alias("fields"), F.slice("c", 10, len(samples)).alias("cells"),
    )
    if not keep_multiallelic:
        c = c.where(~F.col("alt").contains(","))
    c = c.withColumn("cells", F.transform("cells", lambda x: F.split(x, ":")))

    def field(cell: Column, name: str) -> Column:
        at = F.array_position(F.col("fields"), F.lit(name))
        v = F.when(at > 0, F.get(cell, (at - 1).cast("int")))
        return F.when(v.rlike(r"^[.,/|]*$"), None).otherwise(v)

    shows = lambda n: F.exists("cells", lambda x: field(x, n).isNotNull())
    has = [shows(n) for n in priority]
    fmt = F.lit(None).cast("string")
    for h, n in reversed(list(zip(has, priority))):
        fmt = F.when(h, n).otherwise(fmt)
    c = c.withColumn("fmt", fmt)
    raw = F.lit(None).cast("string")
    for n in priority:
        raw = F.when(F.col("fmt") == n, field(F.col("cell"), n)).otherwise(raw)
    out = c.select("marker", "chrom", "pos", "ref", "alt", "info", "fmt", "fields", F.posexplode("cells").alias("k", "cell")).withColumn("raw", raw)
    gt = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"[1-9]\d*", "2"), "0", "1"), r"\.", "N")
    value = F.when(F.col("raw").isNull(), F.when(F.col("fmt") == "GT", "NN")).when(F.col("fmt") == "GT", gt).otherwise(F.translate("raw", ",", "&"))
    return out.select("marker", "chrom", "pos", "ref", "alt", "info", F.get(ids, F.col("k")).alias("sample"), "fmt", value.alias("value"))


def read_vcf(spark: SparkSession, path: str, **options) -> DataFrame:
    return vcf_long(spark.read.text(path), **options)


def to_vcf_lines(cells: DataFrame, samples: list[str]) -> DataFrame:
    """cells(chrom, pos, marker, ref, alt, info, fmt, sample, value) to (chrom, pos, value): a line a marker. A row holds all
    samples, as the format demands; samples without a cell are missing."""
    table = F.map_from_entries(F.collect_list(F.struct("sample", "value")))
    g = cells.groupBy("chrom", "pos", "marker", "ref", "alt", "info", "fmt").agg(table.alias("m"))
    body = F.array_join(F.array(*[F.coalesce(F.col("m")[s], F.lit(".")) for s in samples]), "\t")
    return g.select("chrom", "pos", F.concat_ws("\t", "chrom", F.col("pos").cast("string"), "marker", "ref", "alt", F.lit("."), F.lit("PASS"), F.coalesce("info", F.lit(".")), "fmt", body).alias("value"))


def write_vcf(cells: DataFrame, path: str, samples: list[str]) -> None:
    """Sorted part files whose concatenation after the returned header is a VCF."""
    to_vcf_lines(cells, samples).orderBy("chrom", "pos").select("value").write.mode("overwrite").text(path, compression="gzip")


def header(samples: list[str]) -> str:
    return "##fileformat=VCFv4.3\n#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])


def rename_samples(cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """New names where the dictionary has the old; the dictionary is the header's size."""
    if not names:
        return cells
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return cells.withColumn("sample", F.coalesce(m[F.col("sample")], F.col("sample")))


def drop_samples(cells: DataFrame, samples: list[str]) -> DataFrame:
    return cells.where(~F.col("sample").isin(samples)) if samples else cells


def pad_samples(cells: DataFrame, samples: list[str]) -> DataFrame:
    """Missing cells for samples that aren't there yet: each marker's row is exploded over the short list of new names."""
    old = {r[0] for r in cells.select("sample").distinct().collect()}
    new = [s for s in samples if s not in old]
    if not new:
        return cells
    rows = cells.drop("sample", "value").distinct().withColumn("sample", F.explode(F.array(*map(F.lit, new)))).withColumn("value", F.lit("."))
    return cells.unionByName(rows)


def filter_lines(cells: DataFrame, *, stretch: int = 0, most_missing: float = 1.0, least_maf: float = 0.0, only_pass: bool = True) -> DataFrame:
    """cells(chrom, pos, marker, alt, filter, sample, value as GT): (chrom, pos, marker, reason) by the first rule that applies of
    filter, duplicate, stretch, multiallelic, monomorphic, missing, maf. Duplicate and stretch look at the last marker kept so
    far, so each chromosome's summaries, one row a marker, are walked in order."""
    import pandas as pd

    a = lambda x: F.regexp_count("value", F.lit(x))
    order = F.transform(F.sort_array(F.collect_list(F.struct("sample", "value"))), lambda s: s["value"])
    s = cells.groupBy("chrom", "pos", "marker", "alt", "filter").agg(F.sum(a("0")).alias("n0"), F.sum(a("[1-9]")).alias("n1"), F.avg(F.col("value").contains(".").cast("double")).alias("miss"), F.xxhash64(order).alias("h"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pos", "marker"])
        last_pos, last_h, out = None, None, []
        for r in pdf.itertuples():
            n = r.n0 + r.n1
            maf = min(r.n0, r.n1) / n if n else 0.0
            why = None
            if only_pass and r.filter not in ("PASS", "."):
                why = "filter"
            elif last_h is not None and r.h == last_h:
                why = "duplicate"
            elif last_pos is not None and r.pos - last_pos < stretch:
                why = "stretch"
            elif "," in r.alt:
                why = "multiallelic"
            elif min(r.n0, r.n1) == 0:
                why = "monomorphic"
            elif r.miss > most_missing:
                why = "missing"
            elif maf < least_maf:
                why = "maf"
            if why is None:
                last_pos = r.pos
            if why not in ("filter", "duplicate"):
                last_h = r.h
            out.append(why)
        return pd.DataFrame({"chrom": pdf.chrom, "pos": pdf.pos, "marker": pdf.marker, "reason": out})

    return s.groupBy("chrom").applyInPandas(walk, "chrom string, pos long, marker string, reason string")


def hapmap_long(lines: DataFrame) -> DataFrame:
    """HapMap lines: (marker, chrom, pos, sample, ref, alt, gt), REF the commoner allele, ties by letter; N is missing."""
    head = lines.where(F.col("value").rlike("^rs#?\\t")).first().value.split("\t")
    c = lines.where(~F.col("value").rlike("^rs#?\\t")).select(F.split("value", "\t").alias("c"))
    out = c.select(F.col("c")[0].alias("marker"), F.col("c")[2].alias("chrom"), F.col("c")[3].cast("long").alias("pos"), F.posexplode(F.slice("c", 12, len(head) - 11)).alias("k", "cell"))
    return letters_to_gt(out.select("marker", "chrom", "pos", F.get(F.array(*map(F.lit, head[11:])), F.col("k")).alias("sample"), "cell"))


def letters_to_gt(cells: DataFrame) -> DataFrame:
    """cells(marker, ..., cell of two letters): adds ref, alt (by frequency, then letter) and gt in place of cell."""
    a = cells.select("marker", F.explode(F.split("cell", "")).alias("allele")).where("allele rlike '[ACGT]'").groupBy("marker", "allele").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("marker").orderBy(F.desc("n"), "allele"))
    # At most four alleles a marker.
    dims = a.withColumn("r", rank).groupBy("marker").agg(F.max(F.when(F.col("r") == 1, F.col("allele"))).alias("ref"), F.max(F.when(F.col("r") == 2, F.col("allele"))).alias("alt"))
    j = cells.join(dims, "marker", "left")
    one = lambda k: F.when(F.substring("cell", k, 1) == F.col("ref"), "0").when(F.substring("cell", k, 1) == F.col("alt"), "1").otherwise(".")
    return j.withColumn("gt", F.concat(one(1), F.lit("/"), one(2))).drop("cell")


def allele_frequencies(cells: DataFrame) -> DataFrame:
    """cells(marker, cell of two letters): (marker, major, minor, freq of the major)."""
    a = cells.select("marker", F.explode(F.split("cell", "")).alias("allele")).where("allele rlike '[ACGT]'").groupBy("marker", "allele").agg(F.count("*").alias("n"))
    w = Window.partitionBy("marker").orderBy(F.desc("n"), "allele")
    r = a.withColumn("r", F.row_number().over(w))
    pick = lambda k, c: F.max(F.when(F.col("r") == k, F.col(c)))
    return r.groupBy("marker").agg(pick(1, "allele").alias("major"), pick(2, "allele").alias("minor"), (pick(1, "n") / F.sum("n")).alias("freq"))


def report_columns(df: DataFrame, suffix: str = "Top Alleles") -> DataFrame:
    """The first column of a vendor's wide report and those whose name holds the suffix, without it."""
    keep = [c for c in df.columns[1:] if suffix in c]
    return df.select(F.col(f"`{df.columns[0]}`"), *[F.col(f"`{c}`").alias(c.replace(suffix, "").strip(" .-_")) for c in keep])


def joinmap_long(lines: DataFrame) -> DataFrame:
    """Lines `marker <axb> cells...` of a cross-pollinated JoinMap file: (marker, p1, p2, k, gt); alleles are numbered from 0 in
    order of letter, - and u are missing."""
    c = lines.where(F.col("value").rlike(r"<\w+x\w+>")).select(F.regexp_extract("value", r"^(\S+)", 1).alias("marker"), F.regexp_extract("value", r"<(\w+)x(\w+)>", 1).alias("m"), F.regexp_extract("value", r"<(\w+)x(\w+)>", 2).alias("f"), F.split(F.regexp_replace("value", r"^\S+\s+<\w+x\w+>\s*(\(\S+\)\s*)?", ""), r"\s+").alias("cells"))
    letters = F.array_sort(F.array_distinct(F.filter(F.split(F.concat("m", "f"), ""), lambda x: x != "")))
    c = c.withColumn("alleles", letters)
    code = lambda x, k: F.when(F.array_position("alleles", F.substring(x, k, 1)) > 0, (F.array_position("alleles", F.substring(x, k, 1)) - 1).cast("string")).otherwise(".")
    gt = lambda x: F.concat(code(x, 1), F.lit("/"), code(x, 2))
    return c.select("marker", gt(F.col("m")).alias("p1"), gt(F.col("f")).alias("p2"), F.posexplode("cells").alias("k", "cell"), "alleles").withColumn("gt", gt(F.col("cell"))).drop("cell", "alleles")


def sections(lines: DataFrame, mark: str, comment: str = "##") -> DataFrame:
    """lines(nth, value) of a file of several tables: (section, nth, value) without the rows `<mark>,<name>` that open them.
    One file's lines are one sequence."""
    named = F.when(F.col("value").startswith(mark + ","), F.regexp_extract("value", "^" + re.escape(mark) + ",([^,]*)", 1))
    body = lines.where(~F.col("value").startswith(comment)).withColumn("__name", named)
    w = Window.partitionBy(F.lit(0)).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    return body.withColumn("section", F.last("__name", ignorenulls=True).over(w)).where("__name is null and section is not null").select("section", "nth", "value")


def section_table(parts: DataFrame, section: str) -> DataFrame:
    """A section as a table; its first line names the columns."""
    rows = parts.where(F.col("section") == section)
    first = rows.orderBy("nth").first()
    names = first.value.split(",")
    return rows.where(F.col("nth") > first.nth).select(*[F.when(~F.get(F.split("value", ","), F.lit(i)).isin("NA", "missing"), F.get(F.split("value", ","), F.lit(i))).alias(n) for i, n in enumerate(names)])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(nth, value) in file order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("nth"), "value")


def plink_map(markers: DataFrame, cm_per_mb: float = 1.0) -> DataFrame:
    """markers(marker, lg, pos, chrom, bp): one tab-separated line each; positions fall back to physical ones."""
    cm = F.coalesce("pos", F.col("bp") * cm_per_mb * 1e-6)
    return markers.select(F.concat_ws("\t", F.coalesce("lg", "chrom"), "marker", F.round(cm, 6).cast("string"), F.col("bp").cast("string")).alias("value"))


def genetic_map(markers: DataFrame, cm_per_mb: float = 1.0) -> DataFrame:
    """Positions and groups from physical ones."""
    return markers.withColumn("lg", F.col("chrom")).withColumn("pos", F.col("bp") * cm_per_mb * 1e-6)


def symmetric(pairs: DataFrame, value: str = "v") -> DataFrame:
    """pairs(a, b, v) in both directions, with the greatest value of each node on its diagonal."""
    both = pairs.select("a", "b", value).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), value))
    diag = both.groupBy("a").agg(F.max(value).alias(value)).select("a", F.col("a").alias("b"), value)
    return both.unionByName(diag)


def map_issues(markers: DataFrame) -> DataFrame:
    """markers(nth, marker, lg, pos): (issue, marker) for repeated ids, groups that aren't consecutive and falling positions."""
    dup = markers.groupBy("marker").count().where("count > 1").select(F.lit("repeated").alias("issue"), "marker")
    w = Window.partitionBy("lg").orderBy("nth")
    m = markers.withColumn("pn", F.lag("nth").over(w)).withColumn("pp", F.lag("pos").over(w))
    split = m.where("nth - pn > 1").select(F.lit("not consecutive").alias("issue"), "marker")
    falls = m.where("pos < pp").select(F.lit("falling").alias("issue"), "marker")
    return dup.unionByName(split).unionByName(falls)


def input_issues(genotyped: DataFrame, pedigree: DataFrame) -> DataFrame:
    """Individuals that only one of the two tables has, or that the pedigree repeats."""
    a = genotyped.select("ind").distinct()
    x = pedigree.select("ind").join(a, "ind", "left_anti").select(F.lit("not genotyped").alias("issue"), "ind")
    y = a.join(pedigree.select("ind"), "ind", "left_anti").select(F.lit("not in pedigree").alias("issue"), "ind")
    z = pedigree.groupBy("ind").count().where("count > 1").select(F.lit("repeated").alias("issue"), "ind")
    return x.unionByName(y).unionByName(z)
