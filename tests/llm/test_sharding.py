import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from loomgeno.llm import sharding
from tests.llm.helpers import docs, odd_docs


def brute_kk(sizes, k):
    """Differencing with explicit lists of items."""
    parts = [(s, i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[2][0][0] - p[2][-1][0]), p[1]))
        a, b = parts.pop(0), parts.pop(0)
        new = sorted([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[2], reversed(b[2]))], key=lambda c: -c[0])
        parts.append((0, made, new))
        made += 1
    return sorted(c[0] for c in parts[0][2])


@pytest.mark.parametrize("k,n", [(2, 9), (3, 40), (8, 300), (8, 5)])
def test_differencing_against_brute_force(k, n):
    rng = random.Random(n)
    sizes = np.array([rng.randint(1, 10**6) for _ in range(n)])
    at = sharding.place_groups(sizes, k)
    assert sorted(np.bincount(at, weights=sizes, minlength=k).astype(int).tolist()) == brute_kk(sizes.tolist(), k)


def check(df, **options):
    rows = df.select("doc_id", "text").collect()
    out = sharding.shard_report(df, **options).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str) == sorted(((i, size(t), crc(t)) for i, t in rows), key=str)
    slots, bytes_ = defaultdict(list), defaultdict(int)
    for r in out:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    return rows, out, bytes_


@pytest.mark.parametrize("options", [{}, {"groups_per_task": 20, "rows_per_window": 5}, {"groups_per_task": 6, "parts_per_task": 3}])
def test_whole_table(spark, sf, options):
    rows, out, sizes = check(spark.read.parquet(f"{sf}/documents.parquet"), **options)
    groups, shard = defaultdict(int), {r.doc_id: r.shard for r in out}
    for i, t in rows:
        groups[t] += len((t or "").encode()) + 1
    where = defaultdict(set)
    for i, t in rows:
        where[t].add(shard[i])
    assert all(len(w) == 1 for t, w in where.items() if t is not None)
    assert max(sizes.values()) - min(sizes.values()) <= max(groups.values())


def test_odd_rows(spark):
    check(odd_docs(spark))
    assert sharding.shard_report(odd_docs(spark).limit(0)).collect() == []
    check(docs(spark, [(i, None, None, None, None) for i in range(20)]))


def test_reruns_over_another_layout_agree(spark):
    """Half of the rows have no id, many are alike, many have no text."""
    rows = [(None if i % 2 else i % 37, None if i % 3 == 0 else f"text {i % 11}" * (i % 5), "en", "a", 1) for i in range(400)]
    df = docs(spark, rows)
    plain = lambda d: sorted(map(tuple, sharding.shard_report(d, groups_per_task=50, rows_per_window=20).collect()), key=str)
    check(df, groups_per_task=50, rows_per_window=20)
    assert plain(df.repartition(7, "n_chars", "doc_id")) == plain(df.coalesce(1))


def test_spread_by_number_of_tasks():
    """More tasks are differenced in more levels; the spread stays far below the largest size."""
    rng = np.random.default_rng(1)
    sizes = rng.lognormal(7, 1, 4000).astype(np.int64) + 1
    for tasks in (1, 2, 20):
        sums = []
        for part in np.array_split(sizes, tasks):
            at = sharding.place_groups(np.sort(part)[::-1], 8)
            sums.append(np.bincount(at, weights=part[np.argsort(-part, kind="stable")], minlength=8).astype(np.int64))
        last = sharding.difference(np.array(sums))[0]
        assert last.max() - last.min() <= 3
