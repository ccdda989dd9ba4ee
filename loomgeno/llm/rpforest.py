"""Embedding near-duplicates by a forest of random-projection trees with spill.

Each tree splits the vectors again and again: a level has one random direction, a node the median of its projections as
threshold, and a vector within `spill` of it goes to both sides (while it has gone to both sides less than `most_spills`
times; after that to its own side). Medians are fitted on a bounded sample; every row is routed. Vectors that share a leaf of
some tree are compared, block by block, so leaves of any size are compared whole. Leaves are large and trees few: a leaf is one
matrix product, while each tree more is one more copy of every vector in the shuffle. Vectors travel as integers of 16 bits with
a scale; a pair so near `least` that rounding could decide it is looked up and compared in double precision, so links are those of
the vectors themselves. A pair that meets in several leaves counts in the first only: routes are recomputed for the pairs found, not
shipped. Leaves return link counts and a spanning forest, never all their pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths never link; equal vectors are one node and link with each other; a null vec_id takes part, is ignored in
the least id of its component, and is kept only if no other id is in its component; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgeno.llm.common import components, drop_table, join_unique, materialize

SEED = 20
#: Vectors in the sample that thresholds are fitted on, rows of a block of a leaf, and rows or pairs handled at once.
SAMPLE, BLOCK, AT_ONCE = 20_000, 8192, 1024


class Forest:
    """Directions and thresholds of all trees for vectors of one length."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, spill: float, most_spills: int):
        self.trees, self.depth, self.spill, self.most = trees, depth, spill, most_spills
        rng = np.random.default_rng(SEED)
        d = sample.shape[1]
        self.dirs = rng.standard_normal((trees, depth, d))
        self.dirs /= np.linalg.norm(self.dirs, axis=2, keepdims=True)
        self.cuts: list[list[np.ndarray]] = []
        for t in range(trees):
            node, levels = np.zeros(len(sample), dtype=np.int64), []
            for level in range(depth):
                p = sample @ self.dirs[t, level]
                # Below the nodes that the sample can tell apart, all share one threshold.
                if 1 << level > max(1, len(sample) // 16):
                    levels.append(np.array([np.median(p) if len(p) else 0.0]))
                    continue
                cut = np.full(1 << level, np.median(p) if len(p) else 0.0)
                order = np.argsort(node, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    if len(part):
                        cut[node[part[0]]] = np.median(p[part])
                levels.append(cut)
                node = 2 * node + (p > cut[node])
            self.cuts.append(levels)

    def route(self, x: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each place of each row of x in tree t."""
        row, leaf, spilled = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int8)
        for level in range(self.depth):
            cuts = self.cuts[t][level]
            # Row by row, so that a row's places don't depend on the rows routed with it.
            gap = np.einsum("ij,j->i", x, self.dirs[t, level])[row] - cuts[leaf if len(cuts) > 1 or level == 0 else np.zeros_like(leaf)]
            both = (np.abs(gap) < self.spill) & (spilled < self.most)
            side = (gap > 0).astype(np.int64)
            spilled = spilled + both
            row, spilled = np.concatenate([row, row[both]]), np.concatenate([spilled, spilled[both]])
            leaf = np.concatenate([2 * leaf + side, 2 * leaf[both] + 1 - side[both]])
        return row, leaf


@lru_cache(2)
def _unpack(raw: bytes) -> Forest:
    return pickle.loads(raw)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; extreme magnitudes are scaled first."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as 16-bit integers and the value of one unit of each."""
    step = (np.abs(x).max(axis=1) / 32767).astype(np.float32)
    return np.rint(x / step[:, None]).clip(-32767, 32767).astype(np.int16), step


def restore(q: np.ndarray, step: np.ndarray) -> np.ndarray:
    """What quantise() kept, in single precision. A component is off by half a step at most, by rounding of the product a little
    more."""
    return q.astype(np.float32) * step[:, None]


def _route(raw: bytes, whole: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _unpack(raw)
        for b in batches:
            if not b.num_rows:
                continue
            q, step = quantise(unit(_matrix(b.column(1))))
            # Routed by what leaves get, so that they can route again.
            x = restore(q, step).astype(np.float64)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * q.shape[1]), len(q), [None, pa.py_buffer(np.ascontiguousarray(q))]).cast(pa.binary())
            for t in range(f.trees):
                row, leaf = f.route(x, t)
                tree = pa.array(np.full(len(row), t, dtype=np.int32))
                if not whole:
                    yield pa.RecordBatch.from_arrays([tree, pa.array(leaf)], ["tree", "leaf"])
                    continue
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(2).take(take), tree, pa.array(leaf), packed.take(take), pa.array(step[row])], ["rid", "n", "tree", "leaf", "q", "step"])

    return run


def _first_meeting(f: Forest, x: np.ndarray, a: np.ndarray, b: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Whether rows a and b of x meet in no earlier tree and in no lesser leaf of this one."""
    first = np.ones(len(a), dtype=bool)
    used = np.unique(np.concatenate([a, b]))
    at = np.searchsorted(used, a), np.searchsorted(used, b)
    for t in range(tree + 1):
        row, leaves = f.route(x[used].astype(np.float64), t)
        if t == tree:
            row, leaves = row[leaves < leaf], leaves[leaves < leaf]
        order = np.lexsort((leaves, row))
        row, leaves = row[order], leaves[order]
        start = np.searchsorted(row, np.arange(len(used) + 1))
        wide = np.full((len(used), max(1, int(np.diff(start).max(initial=0)))), -1, dtype=np.int64)
        wide[row, np.arange(len(row)) - start[row]] = leaves
        for k in range(wide.shape[1]):
            own = wide[at[0], k]
            first &= ~((own[:, None] == wide[at[1]]) & (own[:, None] >= 0)).any(axis=1)
    return first


def _union(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Root of each of n items under links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, root):
            return root
        root = new


def _compare(raw: bytes, least: float):
    """Of a leaf, or two blocks of one: rows (rid, links, root) of its vectors, and (rid, other) of pairs too near to tell."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        f = _unpack(raw)
        tree, leaf, i, j = key
        pdf = pdf.sort_values("rid", kind="stable")
        step, n, block, rid = (pdf[c].to_numpy() for c in ("step", "n", "block", "rid"))
        x = restore(np.frombuffer(b"".join(pdf.q), dtype=np.int16).reshape(len(pdf), -1), step)
        # Furthest that rounding to integers, to single precision and of the product can move a cosine.
        off = step.astype(np.float64) * x.shape[1] ** 0.5 * 0.51
        slack = 2 * off.max() + 4e-7 * x.shape[1] ** 0.5
        links, doubt = np.zeros(len(x)), []
        root = np.arange(len(x))
        for at in range(0, len(x), AT_ONCE):
            rows = x[at : at + AT_ONCE]
            near = rows @ x[at:].T
            a, b = np.nonzero(near >= least - slack)
            a, b, dot = a + at, b + at, near[a, b]
            # Within a block, or across the two blocks of this task.
            own = (a < b) if i == j else (a < b) & (block[a] != block[b])
            a, b, dot = a[own], b[own], dot[own]
            for part in np.array_split(np.arange(len(a)), max(1, -(-len(a) // (1 << 19)))):
                if not len(part):
                    continue
                c, d = a[part], b[part]
                sure = dot[part] >= least + slack
                new = _first_meeting(f, x, c, d, tree, leaf)
                both = new & sure
                links += np.bincount(c[both], weights=n[d[both]], minlength=len(x)) + np.bincount(d[both], weights=n[c[both]], minlength=len(x))
                root = _union(len(x), root[c[sure]], root[d[sure]])[root]
                doubt.append(np.stack([rid[c[new & ~sure]], rid[d[new & ~sure]]]))
        keep = (links > 0) | (root != np.arange(len(x)))
        pairs = np.concatenate(doubt, axis=1) if doubt else np.zeros((2, 0), dtype=np.int64)
        out = pd.DataFrame({"rid": rid[keep], "links": links[keep].astype(np.int64), "root": rid[root[keep]], "other": np.full(keep.sum(), -1, dtype=np.int64)})
        return pd.concat([out, pd.DataFrame({"rid": pairs[0], "links": np.zeros(len(pairs[0]), dtype=np.int64), "root": pairs[0], "other": pairs[1]})])

    return run


def _doubtful(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(rid, links, root) of those pairs (rid, other) whose vectors themselves are near enough, from both sides."""

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", unit(np.stack(a)), unit(np.stack(b))) >= least) if len(a) else pd.Series([], dtype=bool)

    own = nodes.select("rid", "n", "v")
    j = pairs.join(own.withColumnsRenamed({"n": "na", "v": "va"}), "rid").join(own.withColumnsRenamed({"rid": "other", "n": "nb", "v": "vb"}), "other")
    sure = j.where(near("va", "vb")).select("rid", "other", "na", "nb")
    return sure.select("rid", F.col("nb").alias("links"), F.col("rid").alias("root")).unionByName(sure.select(F.col("other").alias("rid"), F.col("na").alias("links"), F.col("rid").alias("root")))


def link(rows: DataFrame, least: float = 0.9, *, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 6, leaf_rows: int = 4096, spill: float = 0.02, most_spills: int = 2, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = rows.sparkSession
    v = F.col(vector_col).cast("array<double>")
    wide = dict(rows.dtypes)[vector_col]
    fine = F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(v, lambda e: e != 0), F.lit(False))
    clean = F.transform(F.col(vector_col), lambda e: e + F.lit(0).cast(wide[6:-1]))
    named = rows.select(F.col(id_col).alias("vec_id"), F.when(fine, clean).alias("v"))
    named = named.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v", F.size("v")))
    nodes = named.where("v is not null").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    nodes = materialize(nodes.withColumn("rid", F.monotonically_increasing_id()), "nodes")
    parts, tables = [], []
    for length, count in sorted(map(tuple, nodes.groupBy(F.size("v")).count().collect())):
        own = nodes.where(F.size("v") == length)
        depth = max(0, int(np.ceil(np.log2(count / leaf_rows))))
        # A bounded sample, least hashes of a part of about that size, to fit thresholds.
        share = min(1.0, sample / count)
        some = own.where(F.pmod(F.xxhash64("k1", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)).select("v").limit(2 * sample)
        fit = np.stack([np.array(r.v, dtype=np.float64) for r in some.collect()] or [np.eye(1, length)[0]])
        raw = pickle.dumps(Forest(unit(fit), trees, depth, spill, most_spills))
        routed = own.select("rid", "v", "n").mapInArrow(_route(raw), "rid long, n long, tree int, leaf long, q binary, step float")
        sizes = own.select("rid", "v").mapInArrow(_route(raw, False), "tree int, leaf long").groupBy("tree", "leaf").agg(F.count("*").alias("rows"))
        # Leaves over one block are compared as pairs of blocks.
        large = materialize(sizes.where(F.col("rows") > block).select("tree", "leaf", F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "large")
        tables.append(large)
        if large.isEmpty():
            cells = routed.withColumn("blocks", F.lit(1))
        else:
            cells = routed.join(large, ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        cells = cells.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
        cells = cells.select("tree", "leaf", "rid", "block", "n", "q", "step", F.inline(others))
        # A leaf is much work for its bytes: a partition a leaf, or so, while there are few.
        cells = cells.repartition(min(4096, max(8, trees << depth)), "tree", "leaf", "i", "j")
        parts.append(cells.groupBy("tree", "leaf", "i", "j").applyInPandas(_compare(raw, least), "rid long, links long, root long, other long"))
    if parts:
        all_ = parts[0]
        for p in parts[1:]:
            all_ = all_.unionByName(p)
        found = materialize(all_, "hits")
        tables.append(found)
        hits = found.where("other < 0").drop("other").unionByName(_doubtful(found.where("other >= 0").select("rid", "other"), nodes, least))
    else:
        hits = spark.createDataFrame([], "rid long, links long, root long")
    hits = materialize(hits, "links")
    tables.append(hits)
    counts = hits.groupBy("rid").agg(F.sum("links").alias("links"))
    roots = components(hits.where("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    state = nodes.drop("v").join(counts, "rid", "left").join(roots.withColumnRenamed("id", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    state = materialize(state, "state")
    comp = state.groupBy("root").agg(F.min("least").alias("component_id"))
    by_key = materialize(state.join(comp, "root").select("k1", "k2", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "bykey")
    ids = materialize(named.select("vec_id", F.when(F.col("v").isNotNull(), F.col("k1")).alias("k1"), F.when(F.col("v").isNotNull(), F.col("k2")).alias("k2")), "ids")
    total = ids.count()
    for t in [*tables, nodes, state]:
        drop_table(t)
    out = join_unique(ids.where("k1 is not null"), by_key, ["k1", "k2"], "n", total).select("vec_id", "n_links", "component_id")
    alone = ids.where("k1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).select("vec_id", F.col("n_links").cast("long"), F.col("component_id").cast("long"), F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
