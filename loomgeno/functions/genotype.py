"""Column builders for genotype cells: missing, dose, calls, posteriors. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical unphased codes.
CODES = ("NN", "1N", "2N", "11", "12", "22")
DOSE = {"11": 1.0, "1N": 1.5, "12": 2.0, "2N": 2.5, "22": 3.0}
HAPLO_DOSE = {"11": 1.0, "1N": 1.0, "2N": 2.0, "22": 2.0}


def _lookup(col: Column, table: dict, other=None) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(col == k, F.lit(v)) if out is None else out.when(col == k, F.lit(v))
    return out.otherwise(other)


def canonical(code: Column) -> Column:
    """Unphased spelling: 21 is 12, N1 is 1N, N2 is 2N."""
    return _lookup(code, {"21": "12", "N1": "1N", "N2": "2N"}, code)


def is_missing(fmt: Column, gt: Column, ad: Column | None = None, gp: Column | None = None) -> Column:
    """Missing by format: N or NN; depths all zero; GP at its prior .25 .5 .25; GL all zero."""
    ad = F.lit(None).cast("array<int>") if ad is None else ad
    gp = F.lit(None).cast("array<double>") if gp is None else gp
    flat = (F.size(gp) == 3) & (gp[0] == 0.25) & (gp[1] == 0.5) & (gp[2] == 0.25)
    return F.when(fmt == "AD", F.coalesce(F.forall(ad, lambda n: n == 0), F.lit(True))).when(fmt == "GP", F.coalesce(flat, F.lit(True))).when(fmt == "GL", F.coalesce(F.forall(gp, lambda x: x == 0), F.lit(True))).otherwise(F.coalesce(gt.isin("N", "NN", "."), F.lit(True)))


def dose(code: Column, haploid: bool = False) -> Column:
    """Allele dose 1 to 3 (1 or 2 for haploid designs, in which heterozygotes are missing); null if missing."""
    return _lookup(canonical(code), HAPLO_DOSE if haploid else DOSE).cast("double")


def dose_of_posterior(gp: Column, least: float = 0.7) -> Column:
    """Expected dose if the most likely genotype exceeds `least`."""
    return F.when(F.array_max(gp) > least, 1 + gp[1] + 2 * gp[2])


def call(gp: Column, least: float = 0.9) -> Column:
    """Genotype of a posterior (11, 12, 22): strictly above the threshold, else the half call it allows, else NN."""
    p1, p12, p2 = gp[0], gp[1], gp[2]
    return F.when(p1 > least, "11").when(p12 > least, "12").when(p2 > least, "22").when((p1 + p12 > least) & ((p1 + p12 >= p2 + p12)), "1N").when(p2 + p12 > least, "2N").otherwise("NN")


def call_haplo(p: Column, least: float = 0.9) -> Column:
    return F.when(p[0] > least, "1").when(p[1] > least, "2").otherwise("N")


def depth_posterior(n1: Column, n2: Column, err: float = 0.005) -> Column:
    """Posterior of 11, 12, 22 from two read depths under a flat prior, with base error `err`."""
    good, bad, het = math.log(1 - err), math.log(err), math.log(0.5)
    logs = F.array(n1 * good + n2 * bad, (n1 + n2) * het, n1 * bad + n2 * good)
    return softmax(logs)


def softmax(logs: Column) -> Column:
    """Normalised exponentials, shifted by the maximum."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def logsumexp(logs: Column) -> Column:
    """Stable log of the sum of exponentials; 0 for an empty array."""
    top = F.array_max(logs)
    return F.when(F.size(logs) == 0, 0.0).otherwise(top + F.log(F.aggregate(F.transform(logs, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)))


def depth_haplo(n1: Column, n2: Column, gp: Column) -> Column:
    """Haploid posterior: certain with one allele only, undecided if a heterozygote is likelier than not, else its mass is
    shared."""
    half = F.lit(0.5)
    return F.when((n1 > 0) & (n2 == 0), F.array(F.lit(1.0), F.lit(0.0))).when((n2 > 0) & (n1 == 0), F.array(F.lit(0.0), F.lit(1.0))).when(gp[1] >= 0.5, F.array(half, half)).otherwise(F.array(gp[0] + gp[1] / 2, gp[2] + gp[1] / 2))


def hetero_to_missing(code: Column) -> Column:
    """Heterozygotes and what may be one become missing."""
    return F.when(canonical(code) == "12", "NN").otherwise(canonical(code))


def inbred(code: Column) -> Column:
    """Diploid code of an inbred line as a haploid one: homozygotes and half calls keep their allele."""
    c = canonical(code)
    return F.when(c.isin("11", "1N"), "1").when(c.isin("22", "2N"), "2").otherwise("N")


def depth_to_haplo(n1: Column, n2: Column) -> Column:
    """Allele seen alone; N for none, -1 for both."""
    return F.when((n1 > 0) & (n2 > 0), "-1").when(n1 > 0, "1").when(n2 > 0, "2").otherwise("N")


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def fisher_z(r: Column) -> Column:
    return F.atanh(r)


def joint_error(marker: Column, individual: Column) -> Column:
    """Chance that at least one of two independent errors strikes."""
    return marker + individual - marker * individual
