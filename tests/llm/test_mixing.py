import re
from collections import defaultdict

from loomgeno.llm import mixing
from tests.llm.helpers import docs, odd_docs


def brute_targets(sizes, weights=(5, 2, 1), ratio=1.5, repeat=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, active, out = ratio * sum(sizes.values()), set(order), {}
    while active:
        total = sum(w[s] for s in active)
        full = {s for s in active if left * w[s] / total >= repeat * sizes[s]}
        if not full:
            return out | {s: left * w[s] / total for s in active}
        out |= {s: float(repeat * sizes[s]) for s in full}
        left -= sum(repeat * sizes[s] for s in full)
        active -= full
    return out


def check(df):
    rows = df.collect()
    size = [len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in rows]
    by = defaultdict(int)
    for r, n in zip(rows, size):
        by[r.source] += n
    target = brute_targets(by)
    out = mixing.mix_report(df).collect()
    assert sorted(((r.doc_id, r.size) for r in out), key=str) == sorted(((r.doc_id, n) for r, n in zip(rows, size)), key=str)
    taken, biggest = defaultdict(int), defaultdict(int)
    where = {r.doc_id: r.source for r in rows}
    for r in out:
        s = where[r.doc_id]
        assert r.source_size == by[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert r.taken <= 2 * r.size
        taken[s] += r.taken
        biggest[s] = max(biggest[s], r.size)
    assert sorted(out, key=str) == sorted(mixing.mix_report(df).collect(), key=str)
    return taken, target, biggest, out


def test_whole_table(spark, sf):
    taken, target, biggest, _ = check(spark.read.parquet(f"{sf}/documents.parquet"))
    for s in target:
        assert abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6


def test_odd_rows_and_empty_table(spark):
    df = odd_docs(spark)
    check(df)
    out = mixing.mix(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
    times = {(r.doc_id, r.size): r.copies for r in mixing.mix_report(df).collect()}
    assert out.count() == sum(r.copies for r in mixing.mix_report(df).collect()) and times
    assert mixing.mix_report(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []


def test_thresholds_are_nested(spark):
    df = docs(spark, [(i, "a " * (i % 7), "en", "s", 1) for i in range(300)])
    sets = []
    for ratio in (0.2, 0.5, 0.9):
        sets.append({r.doc_id for r in mixing.mix_report(df, ratio=ratio).collect() if r.taken})
    assert sets[0] <= sets[1] <= sets[2] and len(sets[0]) < len(sets[2])
