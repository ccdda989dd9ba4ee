"""Pedigree tables: breeders' lists, unions, relations between subpopulations, founders and offspring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgeno.functions import prior


def breeder_pedigree(rows: list[tuple[str, str, str]]) -> tuple[list[tuple[str, str, str]], list[tuple[str, str]]]:
    """rows (individual, cross such as P1/P2, selfing as DH, FIXED, Sn or n): pedigree rows (member, mother, father), parents
    first, and (offspring, member). An individual that is a parent as well gets a second self for its offspring role."""
    ped: dict[str, tuple[str, str]] = {}
    parents: set[str] = set()

    def grow(tree) -> str:
        if isinstance(tree, str):
            ped.setdefault(tree, ("0", "0"))
            parents.add(tree)
            return tree
        a, b = grow(tree[0]), grow(tree[1])
        ped.setdefault(name := f"({a}/{b})", (a, b))
        return name

    offspring = []
    for ind, cross, selfing in rows:
        line = grow(prior.parse_cross(cross))
        text = selfing.upper().lstrip("S")
        n = 1 if text == "DH" else 8 if text == "FIXED" else int(text)
        for k in range(n):
            ped.setdefault(name := f"{line}.{'DH' if text == 'DH' else 'S'}{k + 1}", (line, line))
            line = name
        offspring.append((ind, line))
    out = [(m, a, b) for m, (a, b) in ped.items()]
    return out, [(f"{i}_virtualoffspring" if i in parents else i, line) for i, line in offspring]


def union(parts: list[DataFrame]) -> DataFrame:
    """Distinct (member, mother, father) rows of several pedigrees."""
    out = parts[0].select("member", "mother", "father")
    for p in parts[1:]:
        out = out.unionByName(p.select("member", "mother", "father"))
    return out.distinct()


def conflicts(ped: DataFrame) -> DataFrame:
    """(member, n): members with more than one pair of parents."""
    return ped.groupBy("member").agg(F.count("*").alias("n")).where("n > 1")


def relations(offspring: DataFrame, founders: DataFrame) -> DataFrame:
    """offspring(ind, pop), founders(pop, founder): (pop, n, founders as sorted text). Individuals are counted, not listed."""
    n = offspring.groupBy("pop").agg(F.countDistinct("ind").alias("n"))
    f = founders.groupBy("pop").agg(F.array_join(F.array_sort(F.collect_set(F.col("founder").cast("string"))), "||").alias("founders"))
    return n.join(f, "pop", "left")


def merge_map_groups(markers: DataFrame) -> DataFrame:
    """markers(lg, marker, pos): one text a group, `group lg`, a line a marker in order, `;` as the end. A group's markers are
    one value, as the format has it."""
    line = F.concat_ws(" ", F.col("marker").cast("string"), F.round("pos", 4).cast("string"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "marker", line.alias("l")))), lambda x: x["l"]), "\n")
    return markers.groupBy("lg").agg(body.alias("b")).select("lg", F.concat(F.lit("group "), F.col("lg"), F.lit("\n"), F.col("b"), F.lit("\n;")).alias("value"))
