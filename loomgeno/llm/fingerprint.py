"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes marks candidate boundaries; chunking is normalised: before the usual length a
candidate must also pass a stricter mask. A fingerprint is the set of a text's chunk digests with chunk lengths, as sorted
text of 14 hex digits each (12 of digest, 2 of length), so it is shift-resistant: an edit changes only chunks near it.
The likeness of A to B is containment: the share of A's chunk bytes that are in B.

Defined cases: null is the empty text; an empty text has the empty fingerprint, which is wholly like another empty one
and unlike all others; equal texts have equal fingerprints; rows with the same doc_id follow in order of their texts (one with
more rows than a range holds: in order of hashes of the texts first), null ids come last; a single row's next document is itself;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgeno.llm.common import bounded_batches, materialize

#: Least, usual and greatest chunk length in bytes.
LEAST, USUAL, MOST = 12, 32, 160
#: A candidate has these bits zero; a strict one all of STRICT.
EASY, STRICT = 0x0F00, 0x7F00
#: An id or text is hot if more than one row in HOT_SHARE has it.
HOT_SHARE = 512
#: Bytes hashed at once.
BLOCK = 1 << 22
GEAR = np.frombuffer(hashlib.shake_256(b"gear").digest(1024), dtype="<u4").astype(np.uint32)
REACH = 16


def candidates(data: bytes) -> tuple[list[int], list[bool]]:
    """Ends of possible chunks (exclusive), and whether each is strict."""
    ends, strict = [], []
    for at in range(0, len(data), BLOCK):
        lead = min(at, REACH - 1)
        h = GEAR[np.frombuffer(data, dtype=np.uint8, count=min(BLOCK, len(data) - at) + lead, offset=at - lead)]
        step = 1
        while step < REACH:
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        hit = np.flatnonzero((h & np.uint32(EASY)) == 0)
        hit = hit[hit >= lead]
        ends.append(hit + (at - lead + 1))
        strict.append((h[hit] & np.uint32(STRICT)) == 0)
    return (np.concatenate(ends).tolist(), np.concatenate(strict).tolist()) if ends else ([], [])


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of data."""
    out, last, n = [], 0, len(data)
    for end, hard in zip(*candidates(data)):
        long_ = end - last
        while long_ > MOST:
            last += MOST
            out.append(last)
            long_ = end - last
        if long_ >= USUAL or hard and long_ >= LEAST:
            out.append(end)
            last = end
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def chunks(data: bytes) -> dict[int, int]:
    """Digest (48 bits) -> length of the distinct chunks of data."""
    hashed, out, last, cut = xxhash.xxh3_64_intdigest, {}, 0, data
    for end in boundaries(data):
        out[hashed(cut[last:end]) >> 16] = end - last
        last = end
    return out


def to_text(found: dict[int, int]) -> str:
    return "".join(["%012x%02x" % x for x in sorted(found.items())])


def from_text(s: str) -> dict[int, int]:
    return {int(s[i : i + 12], 16): int(s[i + 12 : i + 14], 16) for i in range(0, len(s), 14)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment of a in b by chunk length, 0 to 1."""
    if not a:
        return 0.0 if b else 1.0
    return sum(map(a.__getitem__, a.keys() & b.keys())) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as much of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edit_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a group in order, the last of them the next group's first; each but the last is reported."""
    before = None
    out: list[tuple] = []
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def flush(kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        cols = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names)

    for b in batches:
        kind, size = b.schema.field(1).type, 0
        for group, doc_id, text, guest in zip(*(b.column(i) for i in range(4))):
            group, doc_id, text = group.as_py(), doc_id.as_py(), text.as_py() or ""
            own = chunks(text.encode())
            if before and before[0] == group:
                _, i, t, a = before
                raw = edited(t, text).encode()
                e = chunks(raw)
                out.append((i, len(t), hashlib.sha256(raw).hexdigest(), to_text(a), to_text(e), likeness(a, e), likeness(a, own)))
                size += len(t)
                if size > 1 << 22:
                    yield flush(kind)
                    size = 0
            before = None if guest.as_py() else (group, doc_id, text, own)
        if out:
            yield flush(kind)


def _place(cuts: list[int]):
    """Range of an id among descending ranges; null ids come after all."""

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        at = len(cuts) - np.searchsorted(np.array(cuts, dtype=np.int64), ids.fillna(0).to_numpy(dtype=np.int64), side="left")
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, at).astype(np.int32))

    return place


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_range: int = 4000, most_ranges: int = 20_000, hot_share: int = HOT_SHARE) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Ids are integers.

    Ranges of doc_id are cut at approximate quantiles, so each row's next one lies in the same range except at a range's
    end; there the next range's first row comes as a guest. Texts move once and stream through sorted partitions, so a range
    needs no memory of its own. An id with more than one row in hot_share (a null one, say) is a range by itself, cut further by
    the hash of its texts, and a text of such an id with as many rows is dealt out in turn, its rows being alike."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    total, known = rows.agg(F.count("*"), F.count("doc_id")).first()
    parts = min(most_ranges, max(1, -(-total // rows_per_range)))
    # Fewer than hot_share ids, and texts of them, are hot.
    hot = [(r.doc_id, r["count"]) for r in rows.groupBy("doc_id").count().where((F.col("count") * hot_share > total) & (F.col("count") > rows_per_range)).collect()] if parts > 1 else []
    cuts = []
    if known and parts > 1:
        shares = [i / parts for i in range(1, parts)]
        cuts = set(rows.agg(F.percentile_approx("doc_id", shares, 10 * parts)).first()[0])
        # A range holds the ids above one cut up to the next.
        cuts = sorted(cuts | {c for i, _ in hot if i is not None for c in (i - 1, i)})
    pieces = lambda n: max(1, -(-n // rows_per_range))
    by_id = spark.createDataFrame([(i, pieces(n)) for i, n in hot], "hi long, k long")
    wide = rows.join(F.broadcast(by_id), F.col("doc_id").eqNullSafe(F.col("hi")), "left").drop("hi") if hot else rows.withColumn("k", F.lit(None).cast("long"))
    alike = wide.where("k is not null").groupBy("doc_id", "h").count().where((F.col("count") * hot_share > total) & (F.col("count") > rows_per_range)) if hot else None
    same = [(r.doc_id, r.h, pieces(r["count"])) for r in alike.collect()] if hot else []
    if same:
        by_text = spark.createDataFrame(same, "hi long, hh long, turns long")
        wide = wide.join(F.broadcast(by_text), F.col("doc_id").eqNullSafe(F.col("hi")) & (F.col("h") == F.col("hh")), "left").drop("hi", "hh")
    else:
        wide = wide.withColumn("turns", F.lit(None).cast("long"))
    # Rows of one id are in order of these two, then of their texts.
    part = F.coalesce(F.floor((F.shiftright("h", 24) + F.lit(1 << 39)) * F.col("k") / F.lit(float(1 << 40))), F.lit(0)).cast("long")
    turn = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("turns")), F.lit(0)).cast("long")
    g = F.shiftleft(_place(cuts)(F.col("doc_id")).cast("long"), 40) + F.shiftleft(part, 20) + turn
    # Range 0 holds the greatest ids. At most `most_ranges` cuts, and those of hot ids, go to the workers.
    placed = wide.select(g.alias("g"), "doc_id", "text")
    # The first row of each range: one id a range, and of rows that share it the least text. The windows hold a row a range.
    heads = placed.groupBy("g").agg(F.max("doc_id").alias("head"))
    one = Window.partitionBy(F.lit(0))
    heads = materialize(heads.select(F.col("g").alias("hg"), "head", F.coalesce(F.lag("g").over(one.orderBy("g")), F.max("g").over(one)).alias("to")), "heads")
    guests = placed.join(F.broadcast(heads), (F.col("g") == F.col("hg")) & F.col("doc_id").eqNullSafe(F.col("head")))
    guests = guests.groupBy("hg").agg(F.min(F.struct(F.col("text").isNotNull().alias("has"), F.col("text").alias("text"))).alias("t"), F.first("to").alias("to"), F.first("doc_id").alias("doc_id"))
    both = placed.select("g", "doc_id", "text", F.lit(False).alias("guest")).unionByName(guests.select(F.col("to").alias("g"), "doc_id", "t.text", F.lit(True).alias("guest")))
    # A range a partition; the parts of hot ids lie over the others in turn.
    spot = F.pmod(F.shiftright("g", 40) + F.shiftright("g", 20).bitwiseAND(F.lit((1 << 20) - 1)) + F.col("g").bitwiseAND(F.lit((1 << 20) - 1)), F.lit(len(cuts) + 2)).cast("int")
    ordered = both.repartitionById(len(cuts) + 2, spot).sortWithinPartitions("g", "guest", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())
    return ordered.select("g", "doc_id", "text", "guest").mapInArrow(_edit_pass, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
