"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight (position, byte) tokens. At most 3 differing bits touch at most 3 bytes, so a linked
pair shares at least 5 of its 8 tokens. By the same count, it shares at least 3 of any 6 and 5 of all 8. The index
therefore posts sets of tokens rather than single ones, whose lists would hold one row in 256 and yield quadratically
many pairs: first the 20 triples of positions 0 to 5; a list too long for pairing is posted again under its triple with
two of the five other positions, of which a link shares two; a list still too long has only three free bytes, and
each of its fingerprints looks up all its neighbours at 3 bits or fewer there. Candidates are tallied on all eight
tokens, kept from 5 up, and verified by their differing bits. No list is cut short and no pair is lost. A posting carries its
fingerprint, which is its row's whole set of tokens, so the tally over the index is taken where two postings of a list meet.

dedup() is the same method at a similarity of shingle sets; see near_classes() for what stands in for the fingerprint's bytes.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; equal fingerprints are one
node, however many rows have them; a null doc_id takes part and is ignored in the least doc_id of its component; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgeno.llm.common import bounded_batches, components, drop_table, join_unique, materialize

#: Longest posting list whose pairs are formed directly.
LONGEST = 256
#: Shingles hashed at once, which bounds memory for very long texts.
BLOCK = 1 << 16
TRIPLES = list(combinations(range(6), 3))
#: XOR masks of 1 to 3 bits in three bytes.
FLIPS = [sum(c) for k in (1, 2, 3) for c in combinations([1 << i for i in range(24)], k)]


def fingerprint(text: bytes | None, k: int = 3) -> int:
    """SimHash of the k-word shingles of a text, repeats included, A-Z lower-cased, as an unsigned 64-bit integer."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    hashed = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : min(at + BLOCK, n) + k - 1]
        if len(part) < k:
            hs = [hashed(b" ".join(part), 42)]
        else:
            hs = [hashed(x, 42) for x in map(b" ".join, zip(*(part[i:] for i in range(k))))]
        bits = np.unpackbits(np.array(hs, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = np.fromiter((fingerprint(x.as_py()) for x in b.column(1)), dtype=np.uint64, count=b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long."""
    bounded_batches(docs.sparkSession)
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return ids.mapInArrow(_fingerprints, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def _byte(fp: Column, position: int) -> Column:
    return F.shiftrightunsigned(fp, 56 - 8 * position).bitwiseAND(F.lit(255))


def _tokens(fp: Column, positions: tuple[int, ...]) -> Column:
    """The bytes at these positions, the others zero."""
    mask = sum(255 << (56 - 8 * p) for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _post(rows: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(fp, slot, key) for each set of positions."""
    each = F.array(*[F.struct(F.lit(i).cast("int").alias("slot"), _tokens(F.col("fp"), s).alias("key")) for i, s in enumerate(sets)])
    return rows.select("fp", F.inline(each))


def _split(posts: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """Posts in lists of 2 to `longest`, and in longer ones. Counting combines before the shuffle, so long lists are cheap."""
    n = posts.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    found = posts.join(n, ["slot", "key"])
    return found.where(F.col("n") <= longest), found.where(F.col("n") > longest)


def _near(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= 3


def _tally(a: Column, b: Column) -> Column:
    """Number of shared positional bytes."""
    x, total = a.bitwiseXOR(b), F.lit(0)
    for p in range(8):
        total = total + (_byte(x, p) == 0).cast("int")
    return total


def _pairs(posts: DataFrame) -> DataFrame:
    a, b = posts.select("slot", "key", F.col("fp").alias("a")), posts.select("slot", "key", F.col("fp").alias("b"))
    found = a.join(b, ["slot", "key"]).where("a < b")
    return found.where(_tally(F.col("a"), F.col("b")) >= 5).where(_near(F.col("a"), F.col("b"))).select("a", "b")


def _finer() -> list[tuple[int, ...]]:
    """Five positions each, that hold a triple of the first index."""
    return [s for s in combinations(range(8), 5) if any(set(t) <= set(s) for t in TRIPLES)]


def links(fps: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Every pair (a, b), a < b, of the distinct fingerprints in fps(fp) that differ in 3 bits or fewer."""
    spark = fps.sparkSession
    short, long_ = _split(_post(fps, TRIPLES), longest)
    out = _pairs(materialize(short.select("fp", "slot", "key"), "lists"))
    # Long lists: only fingerprints in them, under the sets that refine their own triple.
    finer = _finer()
    mine = [[i for i, s in enumerate(finer) if set(t) <= set(s)] for t in TRIPLES]
    long_ = materialize(long_.select("fp", "slot"), "long")
    if not long_.isEmpty():
        which = F.element_at(F.array(*[F.array(*map(F.lit, m)) for m in mine]), F.col("slot") + 1)
        wanted = long_.select("fp", F.explode(which).alias("set")).distinct()
        keys = F.array(*[_tokens(F.col("fp"), s) for s in finer])
        posts = wanted.select("fp", F.col("set").alias("slot"), F.element_at(keys, F.col("set") + 1).alias("key"))
        short, rest = _split(posts, longest)
        out = out.unionByName(_pairs(short))
        rest = materialize(rest.select("fp", "slot"), "dense")
        if not rest.isEmpty():
            shifts = [[56 - 8 * p for p in range(8) if p not in s] for s in finer]
            put = [F.element_at(F.array(*[F.lit(x[k]) for x in shifts]), F.col("slot") + 1) for k in range(3)]
            mask = F.lit(0).cast("long")
            for k in range(3):
                mask = mask.bitwiseOR(F.call_function("shiftleft", F.shiftright("flip", 8 * k).bitwiseAND(F.lit(255)), put[k]))
            probes = rest.withColumn("flip", F.explode(F.lit(FLIPS).cast("array<long>")))
            probes = probes.select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(mask).alias("b")).where("a < b").distinct()
            out = out.unionByName(probes.join(fps.select(F.col("fp").alias("b")), "b").select("a", "b"))
    return out.distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document. component_id is the least doc_id that can
    be reached by links."""
    rows = materialize(fingerprints(docs, id_col, text_col), "fps")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), longest))
    labelled = nodes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = materialize(labelled, "roots")
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps"))
    # Fingerprints of one class number far fewer than rows; the class side is unique.
    by_fp = labelled.select("fp", "n", "root").join(least.select("root", "component_id"), "root").drop("root")
    total = int(labelled.agg(F.sum("n")).first()[0] or 0)
    by_fp = materialize(by_fp, "byfp")
    out = join_unique(rows, by_fp, ["fp"], "n", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Positional bytes of a signature, and bytes of a band. A pair of shingle sets with similarity 0.8 shares a byte with a chance of
#: 0.8: it misses all 24 bands once in 300,000 times, and shares fewer than LEAST_BYTES bytes once in 100,000 times.
WIDTH, BAND, LEAST_BYTES = 96, 4, 60
_ODD = np.random.default_rng(7).integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SIGNATURE = [f"g{i}" for i in range(WIDTH // 8)]


def shingle_set(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text, A-Z lower-cased; fewer words are one shingle."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(w) - k + 1)
    h = w[:n].copy()
    for j in range(1, min(k, len(w))):
        h = h * _STEP + w[j : n + j]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One byte of the least of the shingles under each of WIDTH hash functions; zeros for no shingles."""
    if not len(shingles):
        return np.zeros(WIDTH, dtype=np.uint8)
    low = np.full(WIDTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * _ODD).min(axis=0), out=low)
    return (low >> np.uint64(16)).astype(np.uint8)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("__text")
            keys, sigs = np.empty((b.num_rows, 2), dtype=np.int64), np.empty((b.num_rows, WIDTH), dtype=np.uint8)
            for i, x in enumerate(b.column(at)):
                own = shingle_set(x.as_py(), k)
                keys[i] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), dtype="<i8")
                sigs[i] = signature(own)
            rest = [c for c in range(b.num_columns) if c != at]
            new = [pa.array(np.ascontiguousarray(x)) for x in (*keys.T, *sigs.view("<i8").T)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *new], [*(b.schema.names[c] for c in rest), "s1", "s2", *SIGNATURE])

    return run


def _shared(a: str, b: str) -> Column:
    """Number of equal positional bytes of two signatures, eight at a time: shifts gather the bits of each byte of the xor in its
    lowest bit."""
    total = F.lit(WIDTH)
    for g in SIGNATURE:
        x = F.col(f"{a}.{g}").bitwiseXOR(F.col(f"{b}.{g}"))
        for step in (4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, step))
        total = total - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, k: int) -> DataFrame:
    """(rid, shingles) of the texts named by wanted(rid, t1, rh); shingles as the upper halves of their hashes, little-endian. Two of a
    text's n shingles share one with a chance of n^2 / 2^33, which moves a similarity by 1 / n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique((shingle_set(x.as_py(), k) >> np.uint64(32)).astype("<u4")).tobytes() for x in b.column(1)], pa.binary())], ["rid", "shingles"])

    rows = docs.select(*_row_key(docs, text_col), F.col(text_col).cast("binary").alias("__text")).join(wanted, ["t1", "rh"]).select("rid", "__text")
    # Rows that are alike in all columns name one text several times.
    return rows.mapInArrow(run, "rid long, shingles binary").groupBy("rid").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have at least the given Jaccard similarity."""

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = np.empty(len(x))
        for i, (a, b) in enumerate(zip(x, y)):
            a, b = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[i] = both / max(1, len(a) + len(b) - both)
        return pd.Series(out)

    j = pairs.join(sets.withColumnsRenamed({"rid": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"rid": "b", "shingles": "y"}), "b")
    # Sizes alone refuse some pairs: the lesser set must hold the similarity's share of the greater.
    sized = F.least(F.length("x"), F.length("y")) >= similarity * F.greatest(F.length("x"), F.length("y")) - 4
    return j.where(sized).where(jaccard("x", "y") >= similarity - 1e-12).select("a", "b")


def _row_key(docs: DataFrame, text_col: str) -> list[Column]:
    """(t1, rh): 128 bits that name a row by its text and all its columns; rows alike in all columns share them."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    digest = F.conv(F.hex(F.substring(F.unhex(F.md5(F.col(text_col).cast("binary"))), 1, 8)), 16, -10).cast("long")
    return [F.coalesce(digest, F.lit(0).cast("long")).alias("t1"), F.xxhash64(*plain).alias("rh")]


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, t1, rh, m, root): the distinct rows of docs, how often each is there, and the class of each: texts that a chain of pairs
    with Jaccard similarity of k-word shingle sets from `similarity` up connects. Written to the shared folder.

    A 64-bit SimHash can't find these pairs: at similarity 0.8 a pair differs in some 10 of 64 bits, which no number of shared
    bytes of 8 guarantees. So the positional bytes are those of minimum hashes, of which such a pair shares 77 of 96; the index,
    the tally, the minimum of matches and the verification are the method's. Lists are posted under bands of four positions. The
    members of a list are compared with its least one first. After that, where a list holds several classes, those of its members
    that aren't in the largest class are compared with all members of other classes: pairs within a class need no comparison, so
    a group of copies costs what it has members, and no list is cut."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(id_col).alias("id"), *_row_key(docs, text_col), F.col(text_col).cast("binary").alias("__text"))
    schema = f"id {kind}, t1 long, rh long, s1 long, s2 long, " + ", ".join(f"{g} long" for g in SIGNATURE)
    rows = materialize(narrow.mapInArrow(_signed(k), schema), "signed")
    nodes = rows.groupBy("s1", "s2").agg(F.min(F.struct("t1", "rh")).alias("rep"), *[F.first(g).alias(g) for g in SIGNATURE])
    nodes = materialize(nodes.select("s1", "s2", "rep.t1", "rep.rh", *SIGNATURE, F.monotonically_increasing_id().alias("rid")), "nodes")
    half = [F.shiftrightunsigned(g, 32 * s).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit((2 * i + s) << 32)) for i, g in enumerate(SIGNATURE) for s in (0, 1)]
    posts = materialize(nodes.select("rid", F.explode(F.array(*half)).alias("list")), "posts")
    sizes = posts.groupBy("list").agg(F.count("*").alias("n"), F.min("rid").alias("least")).where("n > 1")
    found = materialize(posts.join(sizes, "list"), "lists")
    drop_table(posts)

    def confirm(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).distinct()
        sets = materialize(_sets(docs, wanted.join(nodes.select("rid", "t1", "rh"), "rid"), text_col, k), "sets")
        out = materialize(_verified(pairs, sets, similarity), "links")
        drop_table(sets)
        return out

    sigs = nodes.select("rid", F.struct(*SIGNATURE).alias("sig"))
    stars = found.where("rid <> least").select(F.col("least").alias("a"), F.col("rid").alias("b")).distinct()
    stars = stars.join(sigs.withColumnsRenamed({"rid": "a", "sig": "x"}), "a").join(sigs.withColumnsRenamed({"rid": "b", "sig": "y"}), "b")
    pairs = materialize(stars.where(_shared("x", "y") >= LEAST_BYTES).select("a", "b"), "pairs")
    links = confirm(pairs)
    roots = components(links)
    # A list of two has been compared whole; a longer one too, if the links around its least member made it one class.
    rooted = found.where("n > 2").select("list", "rid").join(roots.withColumnRenamed("id", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    rooted = materialize(rooted, "rooted")
    classes_ = rooted.groupBy("list", "root").agg(F.count("*").alias("c"))
    mixed = classes_.groupBy("list").agg(F.max_by("root", F.struct("c", "root")).alias("top"), F.count("*").alias("classes")).where("classes > 1").select("list", "top")
    members = materialize(rooted.join(mixed, "list").join(sigs, "rid"), "mixed")
    other = members.where("root <> top").select("list", F.col("rid").alias("a"), F.col("root").alias("ra"), F.col("sig").alias("x")).join(members.select("list", F.col("rid").alias("b"), F.col("root").alias("rb"), F.col("sig").alias("y")), "list")
    # The tally is taken as postings meet, so pairs that fall short are rows of no table.
    other = other.where("ra <> rb").where(_shared("x", "y") >= LEAST_BYTES).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = materialize(other.join(pairs, ["a", "b"], "left_anti"), "pairs")
    if not more.isEmpty():
        again = confirm(more)
        roots = components(links.unionByName(again))
        drop_table(again)
    for t in (rooted, members, more):
        drop_table(t)
    named = nodes.select("rid", "s1", "s2").join(roots.withColumnRenamed("id", "rid"), "rid", "left").select("s1", "s2", F.coalesce("root", "rid").alias("root"))
    distinct = rows.groupBy("id", "t1", "rh", "s1", "s2").agg(F.count("*").alias("m"))
    out = materialize(distinct.join(named, ["s1", "s2"]).select("id", "t1", "rh", "m", "root"), "classes")
    for t in (rows, nodes, found, pairs, links):
        drop_table(t)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each class of near_classes(): the one of least id (null last), then of least row digest. Which row goes is
    decided row by row: an id that has several texts keeps those that are in other classes, and of rows alike in all columns one
    stays. Null, empty and blank texts have no shingle and are one class."""
    rows = near_classes(docs, id_col, text_col, k, similarity)
    order = F.struct(F.col("id").isNull().alias("last"), "id", "t1", "rh")
    first = rows.groupBy("root").agg(F.min(order).alias("best"), F.sum("m").alias("rows")).where("rows > 1").select("root", "best")
    # Few rows of a class stay, many go: both are named by row, and counted for the join.
    fate = rows.join(first, "root").select("t1", "rh", "m", F.when((F.col("t1") == F.col("best.t1")) & (F.col("rh") == F.col("best.rh")), "one").otherwise("none").alias("fate")).where("fate = 'none' or m > 1")
    fate = materialize(fate, "fate")
    total = rows.agg(F.sum("m")).first()[0] or 0
    drop_table(rows)
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    mine = docs.select(*_row_key(docs, text_col), *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    joined = join_unique(mine, fate, ["t1", "rh"], "m", total)
    kept = joined.where("fate is null").select(*names.values())
    once = joined.where("fate = 'one'").groupBy("t1", "rh").agg(*[F.first(n).alias(n) for n in names.values()]).select(*names.values())
    return kept.unionByName(once).withColumnsRenamed({n: c for c, n in names.items()})
