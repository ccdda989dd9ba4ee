import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from loomgeno.llm import bpe
from loomgeno.llm.queries import vocabulary
from tests.llm.helpers import odd_docs

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    return bpe.transducer(vocabulary()), tokenizers.Tokenizer.from_file(vocabulary())


def digest(x):
    return hashlib.sha256(x).hexdigest()


def brute(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    return len(ids), digest(np.array(ids, dtype="<u4").tobytes()), digest(lib.decode(ids, skip_special_tokens=False).encode())


@pytest.mark.parametrize("odd", [True, False])
def test_tables(spark, sf, both, odd):
    df = odd_docs(spark) if odd else spark.read.parquet(f"{sf}/documents.parquet")
    want = [(r.doc_id, *brute(both[1], r.text)) for r in df.select("doc_id", "text").collect()]
    assert sorted(map(tuple, bpe.round_trip(df, vocabulary()).collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0), vocabulary()).collect() == []


def test_random_strings(both):
    own, lib = both
    rng = random.Random(3)
    parts = ["a", "b", " ", "the", "in", "'s", "'ll", "\n", "\x1c", "\x85", "　", "½", "Ⅷ", "٣", "_", "é", "́", "中", "\U0001f600", "<|endoftext|>", "<|", "  ", "!?", "\x00"]
    for _ in range(1500):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        assert own.ids(s) == lib.encode(s, add_special_tokens=False).ids, s
        assert "".join(own.decode([own.ids(s)])) == s


@pytest.mark.parametrize("piece", ["a" * 30000, "ab" * 15000, "=" * 20000, "é" * 9000, "x" + " " * 20000 + "y"])
def test_window_shorter_than_piece(both, piece):
    assert both[0].ids(piece) == both[1].encode(piece, add_special_tokens=False).ids


def test_stream_equals_whole(both):
    own = both[0]
    rng = random.Random(5)
    raw = "".join(rng.choice("thereinandinghtonaexyz") for _ in range(40000)).encode()
    cuts = [raw[i : i + 997] for i in range(0, len(raw), 997)]
    assert list(own.stream(cuts)) == own._merge(raw)


def test_memory_does_not_grow_with_the_text(both):
    """Ids come in blocks: neither a long text nor a long piece is held as ids."""
    own = both[0]
    for text in ("the thing in the " * 60_000, "ab" * 300_000):
        n = 0
        tracemalloc.start()
        back = hashlib.sha256()
        for s in own.decode(np.frombuffer(b, dtype="<u4") for b in own.encode(text)):
            back.update(s.encode())
            n += len(s)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == len(text) and back.hexdigest() == digest(text.encode())
        assert most < 12 << 20


def test_decoder_state_across_blocks(both):
    ids = both[0].ids("naïve 中文 \U0001f600")
    assert "".join(both[0].decode([[i] for i in ids])) == "naïve 中文 \U0001f600"
    assert "".join(both[0].decode([ids[:-1]])) == both[1].decode(ids[:-1], skip_special_tokens=False)


def test_encode_decode_frames(spark):
    df = odd_docs(spark)
    out = bpe.decode(bpe.encode(df, vocabulary()), vocabulary())
    assert sorted((r.text for r in out.collect())) == sorted(r.text or "" for r in df.collect())
