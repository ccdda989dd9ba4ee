import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from loomgeno.llm import simhash
from tests.llm.helpers import docs, odd_docs, union_find


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(rows):
    fps = {}
    for i, t in rows:
        fps.setdefault(brute_fingerprint(t), []).append(i)
    keys = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if bin(a ^ b).count("1") <= 3]
    root = union_find(keys, pairs)
    least = {}
    for k, r in root.items():
        own = [i for i in fps[k] if i is not None]
        if own:
            least[r] = min(least.get(r, own[0]), *own)
    return sorted(((i, f"{k:016x}", least.get(root[k])) for k, ids in fps.items() for i in ids), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_whole_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(simhash.classes(df)) == brute_components([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_odd_rows_and_empty_table(spark):
    df = odd_docs(spark)
    assert got(simhash.classes(df)) == brute_components([(r.doc_id, r.text) for r in df.collect()])
    assert simhash.classes(df.limit(0)).collect() == []


def brute_sets(text, k=5):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    return frozenset(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def brute_groups(texts, similarity=0.8):
    """Groups of texts connected by Jaccard similarity of their shingle sets: text -> group."""
    sets = {t: brute_sets(t) for t in texts}
    keys = sorted(set(sets.values()), key=sorted)
    place, pairs = defaultdict(list), set()
    for n, k in enumerate(keys):
        for x in k:
            place[x].append(n)
    shared = Counter(p for v in place.values() for i, p1 in enumerate(v) for p in [(p1, q) for q in v[i + 1 :]])
    pairs = [(a, b) for (a, b), n in shared.items() if n >= similarity * (len(keys[a]) + len(keys[b]) - n) - 1e-9]
    root = union_find(range(len(keys)), pairs)
    at = {k: n for n, k in enumerate(keys)}
    return {t: root[at[k]] for t, k in sets.items()}


def check_dedup(spark, df):
    """One row of each group stays, with the least id that it has, and other rows are as they were."""
    before = Counter(map(tuple, df.collect()))
    out = simhash.dedup(df)
    assert out.columns == df.columns
    after = Counter(map(tuple, out.collect()))
    assert not after - before
    i, t = df.columns.index("doc_id"), df.columns.index("text")
    group = brute_groups({r[t] for r in before})
    assert sorted(group[r[t]] for r in after.elements()) == sorted(set(group.values()))
    least = {}
    for r in before:
        g = group[r[t]]
        least[g] = min(least.get(g, (True, 0)), (r[i] is None, r[i] or 0))
    assert all((r[i] is None, r[i] or 0) == least[group[r[t]]] for r in after)
    return len(after)


def test_dedup_of_a_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check_dedup(spark, df) < df.count()


def test_dedup_row_by_row(spark):
    same, other = "alpha beta gamma delta", "something entirely different and unique here"
    rows = [(3, same), (5, same), (5, other), (7, "a text twice, alike in all columns"), (7, "a text twice, alike in all columns"), (None, same), (None, "only without an id")]
    df = docs(spark, [(i, t, "en", "a", len(t)) for i, t in rows])
    assert check_dedup(spark, df) == 4
    assert sorted((r.doc_id, r.text) for r in simhash.dedup(df).collect() if r.doc_id) == [(3, same), (5, other), (7, "a text twice, alike in all columns")]
    odd = odd_docs(spark)
    assert check_dedup(spark, odd) == 6
    assert simhash.dedup(odd.limit(0)).collect() == []
    assert check_dedup(spark, odd.withColumn("root", F.lit(1)).withColumn("fate", F.lit("none"))) == 6


@pytest.mark.parametrize("seed", [2, 6])
def test_dedup_of_long_lists(spark, seed):
    """A chain of texts, each like the next one only, and a group around one text: lists of all lengths."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    texts, now = [], list(base)
    for _ in range(40):
        at = rng.randrange(190)
        now[at] = word()
        texts.append(" ".join(now))
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randint(1, 4)):
            near[rng.randrange(200)] = word()
        texts.append(" ".join(near))
    texts += [" ".join(base[:30] + [word() for _ in range(170)]) for _ in range(40)]
    df = docs(spark, [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)])
    assert check_dedup(spark, df) < len(texts)


@pytest.mark.parametrize("longest", [1, 3, 1000])
def test_links_through_each_level(spark, longest):
    rng = random.Random(longest)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for f in list(fps):
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.add(g)
    # A dense ball: only the three last bytes differ.
    fps |= {(0xABCDEF0123 << 24) | rng.getrandbits(6) for _ in range(40)}
    want = {(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 3}
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(sign(f),) for f in fps], "fp long")
    have = {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)))) for r in simhash.links(df, longest).collect()}
    assert have == want


def test_copies_in_one_class(spark):
    words = " ".join(f"w{i}" for i in range(400))
    rows = [(i, words, "en", "a", 1) for i in range(50)] + [(100, "something else entirely here now", "en", "a", 1)]
    out = {r.doc_id: r.component_id for r in simhash.classes(docs(spark, rows)).collect()}
    assert out == {i: 0 for i in range(50)} | {100: 100}
