import hashlib
import random

import xxhash

from loomgeno.llm import fingerprint as fp
from tests.llm.helpers import docs, odd_docs


def plain_ends(data):
    """Chunk ends by the definition alone: a gear hash of 16 bytes at each place, byte by byte."""
    out, last = [], 0
    for end in range(1, len(data) + 1):
        h = 0
        for b in data[max(0, end - fp.REACH) : end]:
            h = (2 * h + int(fp.GEAR[b])) % 2**32
        long_, easy, strict = end - last, h & fp.EASY == 0, h & fp.STRICT == 0
        if long_ == fp.MOST and not (easy and long_ >= fp.USUAL) or easy and long_ >= fp.USUAL or strict and long_ >= fp.LEAST:
            out.append(end)
            last = end
    return out + [len(data)] * (last < len(data))


def plain_chunks(text):
    out, last, data = {}, 0, text.encode()
    for end in plain_ends(data):
        out[xxhash.xxh3_64_intdigest(data[last:end]) >> 16] = end - last
        last = end
    return out


def plain_text(found):
    return "".join(f"{d:012x}{n:02x}" for d, n in sorted(found.items()))


def plain_likeness(a, b):
    return sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b)


def by_text(row):
    return row[0] is None, -(row[0] or 0), row[1] is not None, row[1] or ""


def brute(rows, key=by_text):
    order = sorted(rows, key=key)
    known = {}

    def chunked(t):
        if t not in known:
            known[t] = plain_chunks(t) if len(t) < 3000 else fp.chunks(t.encode())
        return known[t]

    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        a, b, c = map(chunked, (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_text(a), plain_text(b), plain_likeness(a, b), plain_likeness(a, c)))
    return sorted(out, key=str)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_whole_table_and_many_ranges(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute(rows_of(df))
    for n in (7, 4000):
        assert sorted(map(tuple, fp.edit_report(df, rows_per_range=n).collect()), key=str) == want
    near = [r[5] for r in want if r[1] > 400]
    assert sum(near) / len(near) > 0.4


def test_odd_rows(spark):
    df = odd_docs(spark)
    for n in (2, 4000):
        assert sorted(map(tuple, fp.edit_report(df, rows_per_range=n).collect()), key=str) == brute(rows_of(df))
    assert fp.edit_report(df.limit(0)).collect() == []
    one = fp.edit_report(docs(spark, [(5, "a text", None, None, 1)])).collect()[0]
    assert one.near_next == 1.0


def test_boundaries_against_the_definition():
    rng = random.Random(4)
    for n in (0, 1, 11, 12, 160, 161, 700, 4000):
        raw = bytes(rng.choice(b"abcdefgh \n") for _ in range(n))
        assert fp.boundaries(raw) == plain_ends(raw), n
    assert fp.boundaries(b"a" * 1000) == plain_ends(b"a" * 1000)


def test_half_of_the_ids_are_null(spark):
    """A hot id is cut by the hash of its texts."""
    rng = random.Random(5)
    rows = [(None if i % 2 else i % 90, f"text {i} " + "abcde"[: rng.randint(0, 5)] * rng.randint(0, 9)) for i in range(400)]
    df = docs(spark, [(i, t, "en", "a", 1) for i, t in rows])
    k = -(-200 // 10)

    def place(row):
        h = xxhash.xxh64_intdigest(row[1].encode(), 42)
        h -= (h >> 63) << 64
        return row[0] is None, -(row[0] or 0), ((h >> 24) + (1 << 39)) * k // (1 << 40) if row[0] is None else 0, row[1]

    assert sorted(map(tuple, fp.edit_report(df, rows_per_range=10).collect()), key=str) == brute(rows, place)


def test_half_of_the_rows_are_alike(spark):
    rows = [(7, "the same text of one id")] * 300 + [(i, f"another text {i}") for i in range(200)]
    out = fp.edit_report(docs(spark, [(i, t, "en", "a", 1) for i, t in rows]), rows_per_range=10).collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    same = [r.near_next for r in out if r.n_chars == 23]
    assert sum(x == 1.0 for x in same) == 299


def test_shift_resistance_and_round_trip():
    rng = random.Random(1)
    t = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(2000))
    a, b = fp.chunks(t.encode()), fp.chunks(("inserted words " + t).encode())
    assert fp.likeness(a, b) > 0.97
    assert fp.from_text(fp.to_text(a)) == a
    assert max(a.values()) <= fp.MOST


def test_blocks_of_a_long_text(monkeypatch):
    rng = random.Random(2)
    raw = bytes(rng.randrange(256) for _ in range(30000))
    whole = fp.boundaries(raw)
    monkeypatch.setattr(fp, "BLOCK", 1000)
    assert fp.boundaries(raw) == whole
