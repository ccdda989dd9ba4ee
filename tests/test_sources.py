"""Readers and writers of genotype text on small files."""

from loomgeno.sources import pedigrees
from loomgeno.sources import variants as V

SAMPLES = ["s1", "s2"]
VCF = [
    "##fileformat=VCFv4.3",
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2",
    "1\t10\tm1\tA\tC\t.\tPASS\tLINKAGEGROUP=g1;POSCM=1.5\tGT:AD\t0/1:3,4\t1|1:.",
    "1\t20\t.\tA\tC\t.\tPASS\t.\tGT\t./.\t0/0",
    "2\t5\tm3\tA\tC,G\t.\tPASS\t.\tGT\t0/2\t1/1",
]


def lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_vcf_cells(spark):
    out = {(r.marker, r.sample): (r.fmt, r.value) for r in V.vcf_long(lines(spark, VCF)).collect()}
    assert out == {("m1", "s1"): ("AD", "3&4"), ("m1", "s2"): ("AD", None), ("1_20", "s1"): ("GT", "NN"), ("1_20", "s2"): ("GT", "1/1")}
    gt = {(r.marker, r.sample): r.value for r in V.vcf_long(lines(spark, VCF), priority=("GT", "AD"), keep_multiallelic=True).collect()}
    assert gt["m1", "s2"] == "2|2" and gt["m3", "s1"] == "1/2"


def test_vcf_round_trip(spark, tmp_path):
    cells = spark.createDataFrame([("1", i, f"m{i}", "A", "C", None, "GT", s, g) for i in range(3) for s, g in zip(SAMPLES, ("0/1", "1/1"))], "chrom string, pos long, marker string, ref string, alt string, info string, fmt string, sample string, value string")
    V.write_vcf(cells, str(tmp_path / "v"), SAMPLES)
    body = spark.read.text(str(tmp_path / "v"))
    back = V.vcf_long(body, SAMPLES).select("marker", "sample", "value").collect()
    assert sorted(map(tuple, back)) == sorted((f"m{i}", s, g) for i in range(3) for s, g in zip(SAMPLES, ("1/2", "2/2")))
    assert V.header(SAMPLES).split("\n")[1].endswith("FORMAT\ts1\ts2")


def test_sample_columns(spark):
    cells = V.vcf_long(lines(spark, VCF))
    assert {r[0] for r in V.rename_samples(cells, {"s1": "x", "zz": "y"}).select("sample").distinct().collect()} == {"x", "s2"}
    assert {r[0] for r in V.drop_samples(cells, ["s2"]).select("sample").distinct().collect()} == {"s1"}
    padded = V.pad_samples(cells, ["s1", "new"]).collect()
    assert {(r.marker, r.value) for r in padded if r.sample == "new"} == {("m1", "."), ("1_20", ".")} and len(padded) == 6


def test_line_filter_remembers_the_last_kept_marker(spark):
    rows = []
    for pos, marker, filt, alt, gts in [(10, "a", "PASS", "C", "0/1 1/1"), (12, "b", "PASS", "C", "0/0 0/1"), (30, "c", "q10", "C", "0/1 0/1"), (40, "d", "PASS", "C", "0/0 0/1"), (50, "e", "PASS", "C", "0/0 0/1"), (60, "f", "PASS", "C,G", "0/2 0/1"), (70, "g", "PASS", "C", "0/0 0/0")]:
        rows += [("1", pos, marker, alt, filt, s, g) for s, g in zip(SAMPLES, gts.split())]
    df = spark.createDataFrame(rows, "chrom string, pos long, marker string, alt string, filter string, sample string, value string")
    got = {r.marker: r.reason for r in V.filter_lines(df, stretch=5).collect()}
    assert got == {"a": None, "b": "stretch", "c": "filter", "d": "duplicate", "e": "duplicate", "f": "multiallelic", "g": "monomorphic"}


def test_hapmap_and_joinmap(spark):
    head = "\t".join(["rs#", "alleles", "chrom", "pos", "strand", "assembly#", "center", "protLSID", "assayLSID", "panelLSID", "QCcode", "i1", "i2", "i3"])
    row = "\t".join(["m", "T/G", "1", "7", "+", *["NA"] * 6, "GG", "GT", "NN"])
    out = {r.sample: (r.ref, r.alt, r.gt) for r in V.hapmap_long(lines(spark, [head, row])).collect()}
    assert out == {"i1": ("G", "T", "0/0"), "i2": ("G", "T", "0/1"), "i3": ("G", "T", "./.")}
    jm = sorted((r.k, r.p1, r.p2, r["gt"]) for r in V.joinmap_long(lines(spark, ["name = x", "L1 <abxcd> ac bd - uu", "L2 <lmxll> {1-} ll"])).where("marker = 'L1'").collect())
    assert jm == [(0, "0/1", "2/3", "0/2"), (1, "0/1", "2/3", "1/3"), (2, "0/1", "2/3", "./."), (3, "0/1", "2/3", "./.")]


def test_sections(spark):
    rows = ["## a comment", "start,first", "a,b", "1,NA", "2,x", "start,second", "c", "9"]
    parts = V.sections(spark.createDataFrame(list(enumerate(rows)), "nth long, value string"), "start")
    assert [tuple(r) for r in V.section_table(parts, "first").collect()] == [("1", None), ("2", "x")]
    assert V.section_table(parts, "second").columns == ["c"]


def test_reports_and_issues(spark):
    wide = spark.createDataFrame([("m", "AA", 1.0)], "marker string, `s1.Top Alleles` string, `s1.Score` double")
    assert V.report_columns(wide).columns == ["marker", "s1"]
    a = spark.createDataFrame([(1,), (2,)], "ind long")
    p = spark.createDataFrame([(2,), (3,), (3,)], "ind long")
    assert sorted(map(tuple, V.input_issues(a, p).distinct().collect())) == [("not genotyped", 3), ("not in pedigree", 1), ("repeated", 3)]


def test_breeders_list():
    ped, off = pedigrees.breeder_pedigree([("a", "P1/P2", "DH"), ("P1", "P1/P3", "S2")])
    assert ("(P1/P2).DH1", "(P1/P2)", "(P1/P2)") in ped and off == [("a", "(P1/P2).DH1"), ("P1_virtualoffspring", "(P1/P3).S1.S2")]
    seen: set[str] = {"0"}
    for m, x, y in ped:
        assert x in seen and y in seen
        seen.add(m)
