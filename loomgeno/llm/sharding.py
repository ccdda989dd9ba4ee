"""Sharding by Karmarkar-Karp differencing: shards of near-equal bytes from indivisible groups.

A partial partition is one sum of bytes per shard. The two partial partitions of largest spread are combined, the largest
sums of one with the smallest of the other, again and again until one is left. Groups (equal texts) are split over tasks of
bounded size; each task differences its own groups, and the tasks' partial partitions, one per task, are differenced in the
same way, level after level, until one is left. At every size the rule is the same; what more levels cost in balance is measured
in the README.

Defined cases: a null text is no group with others: every such row is its own group of size 1; an empty text has size 1;
ties are broken by group hash, so reruns agree; a group larger than a shard's share fills its shard alone as far as the
others balance; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgeno.llm.common import drop_table, join_unique, materialize, ordinals

#: Groups differenced in one task, partial partitions differenced in one task of a higher level, and rows numbered in one window.
GROUPS_PER_TASK, PARTS_PER_TASK, ROWS_PER_WINDOW = 100_000, 4096, 50_000


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combines partial partitions (n x shards sums). Returns the sums of the last one, and for each part the shard that
    each of its columns goes to (n x shards)."""
    n, k = parts.shape
    if not n:
        return np.zeros(k, dtype=np.int64), np.zeros((0, k), dtype=np.int32)
    sums = [sorted(range(k), key=lambda c, r=row: -r[c]) for row in parts.tolist()]
    rows = parts.tolist()
    ordered = [[r[c] for c in s] for r, s in zip(rows, sums)]
    # Node: (order of own columns by sum). A merge's columns are positions of its result.
    heap = [(o[-1] - o[0], i) for i, o in enumerate(ordered)]
    heapq.heapify(heap)
    children: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = ordered[a], ordered[b]
        merged = [x[j] + y[k - 1 - j] for j in range(k)]
        order = sorted(range(k), key=merged.__getitem__, reverse=True)
        ordered.append(m := [merged[j] for j in order])
        children.append((a, b, order))
        ordered[a] = ordered[b] = None
        heapq.heappush(heap, (m[-1] - m[0], len(ordered) - 1))
    # From the top down: position of a node's j-th largest sum -> shard.
    to: list[list[int] | None] = [None] * len(ordered)
    to[heap[0][1]] = list(range(k))
    for at in range(len(children) - 1, -1, -1):
        a, b, order = children[at]
        own, left, right = to[n + at], [0] * k, [0] * k
        for place, j in enumerate(order):
            left[j], right[k - 1 - j] = own[place], own[place]
        to[a], to[b], to[n + at] = left, right, None
    out = np.zeros((n, k), dtype=np.int32)
    for i in range(n):
        out[i, sums[i]] = to[i]
    return np.array(ordered[heap[0][1]], dtype=np.int64), out


def place_groups(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each indivisible size."""
    parts = np.zeros((len(sizes), shards), dtype=np.int64)
    parts[:, 0] = sizes
    return difference(parts)[1][:, 0]


def _local(shards: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "g1", "g2"], ascending=[False, True, True], kind="stable")
        return pd.DataFrame({"g1": pdf.g1, "g2": pdf.g2, "size": pdf["size"], "rows": pdf.rows, "task": pdf.task, "part": place_groups(pdf["size"].to_numpy(), shards)})

    return run


def _higher(shards: int):
    """Differences the partial partitions (task, part, size) of one group of tasks; `to` is the place of each part."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tasks, at = np.unique(pdf.task.to_numpy(), return_inverse=True)
        parts = np.zeros((len(tasks), shards), dtype=np.int64)
        parts[at, pdf.part] = pdf["size"]
        to = difference(parts)[1]
        grid = np.indices(parts.shape)
        return pd.DataFrame({"task": tasks[grid[0].ravel()], "part": grid[1].ravel(), "size": parts.ravel(), "up": key[0], "to": to.ravel()})

    return run


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", groups_per_task: int = GROUPS_PER_TASK, parts_per_task: int = PARTS_PER_TASK, rows_per_window: int = ROWS_PER_WINDOW) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row: size is UTF-8 bytes + 1, slot numbers a shard's rows from 0."""
    text, doc_id = F.col(text_col), F.col(id_col)
    # 128 bits of digest name a group; a row without text is named by its id and its number among those of that id.
    digest = F.unhex(F.md5(text.cast("binary")))
    half = lambda at: F.conv(F.hex(F.substring(digest, at, 8)), 16, -10).cast("long")
    narrow = docs.select(
        doc_id.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        half(1).alias("g1"), half(9).alias("g2"), F.monotonically_increasing_id().alias("__uid"),
    )
    narrow = materialize(narrow, "narrow")
    bare = ordinals(narrow.where("g1 is null"), ["doc_id"], "g2n").withColumn("g1", F.xxhash64(F.lit("null"), "doc_id")).withColumn("g2", F.col("g2n")).drop("g2n")
    named = materialize(narrow.where("g1 is not null").unionByName(bare), "named")
    drop_table(narrow)
    groups = materialize(named.groupBy("g1", "g2").agg(F.sum("size").alias("size"), F.count("*").alias("rows")), "groups")
    n, total = groups.agg(F.count("*"), F.sum("rows")).first()
    tasks = max(1, -(-n // groups_per_task))
    placed = groups.withColumn("task", F.pmod(F.xxhash64("g1", "g2", F.lit("task")), F.lit(tasks)).cast("long"))
    placed = materialize(placed.groupBy("task").applyInPandas(_local(shards), "g1 long, g2 long, size long, rows long, task long, part int"), "placed")
    drop_table(groups)
    # Level after level, the partial partitions of a bounded number of tasks are differenced in one.
    where, level = placed.groupBy("task", "part").agg(F.sum("size").alias("size")), None
    while True:
        up = where.withColumn("up", F.floor(F.col("task") / parts_per_task)).groupBy("up").applyInPandas(_higher(shards), "task long, part int, size long, up long, to int")
        up = materialize(up, "level")
        # task, part: those of the first level; at, now: the partial partition that holds them.
        level = up.select("task", "part", F.col("up").alias("at"), F.col("to").alias("now")) if level is None else level.join(up.select(F.col("task").alias("at"), F.col("part").alias("now"), "up", "to"), ["at", "now"]).select("task", "part", F.col("up").alias("at"), F.col("to").alias("now"))
        tasks = -(-tasks // parts_per_task)
        if tasks <= 1:
            break
        where = up.groupBy(F.col("up").alias("task"), F.col("to").alias("part")).agg(F.sum("size").alias("size"))
    shard_of = materialize(placed.join(level.select("task", "part", F.col("now").alias("shard")), ["task", "part"]).select("g1", "g2", "rows", "shard"), "shards")
    out = materialize(join_unique(named, shard_of, ["g1", "g2"], "rows", total or 0).drop("g1", "g2", "__uid").withColumn("__uid", F.monotonically_increasing_id()), "assigned")
    for t in (placed, named, shard_of):
        drop_table(t)
    return with_slots(out, rows_per_window)


def with_slots(rows: DataFrame, rows_per_window: int) -> DataFrame:
    """Numbers the rows of each shard, written rows with __uid: distinct rows in buckets of bounded size by hash, with their offsets,
    and rows that are alike one after the other."""
    key = ["shard", "doc_id", "text_crc32", "size"]
    kinds = materialize(rows.groupBy(*key).agg(F.count("*").alias("n")), "kinds")
    buckets = max(1, -(-kinds.count() // rows_per_window))
    kinds = kinds.withColumn("b", F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit("slot")), F.lit(buckets)).cast("int"))
    offsets = kinds.groupBy("shard", "b").agg(F.sum("n").alias("rows"))
    offsets = offsets.select("shard", "b", (F.sum("rows").over(Window.partitionBy("shard").orderBy("b")) - F.col("rows")).alias("first"))
    inner = F.sum("n").over(Window.partitionBy("shard", "b").orderBy("doc_id", "text_crc32", "size")) - F.col("n")
    kinds = kinds.withColumn("inner", inner).join(offsets, ["shard", "b"]).select(*key, "n", (F.col("first") + F.col("inner")).alias("first"))
    many = kinds.where("n > 1").select(*key, "n", "first")
    total = rows.count()
    # Rows of their own kind need no number among their like.
    one = kinds.where("n = 1").select("doc_id", "size", "text_crc32", "shard", F.col("first").alias("slot"))
    like = join_unique(rows, many, key, "n", total).where("first is not null")
    like = materialize(like, "alike")
    numbered = ordinals(like, key).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("ordinal")).alias("slot"))
    return one.unionByName(numbered).withColumn("slot", F.col("slot").cast("long"))


def shard_report(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """assign() with the law it holds, `bytes`; grown_shard is null, as the shard depends on all sizes."""
    out = assign(docs, shards, **options)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
