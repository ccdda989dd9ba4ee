import random
import zlib

import numpy as np

from loomgeno.llm import langid
from tests.llm.helpers import docs, odd_docs

SYLLABLES = {"xx": ["ka", "ro", "ti", "mo", "shi"], "yy": ["gul", "brek", "staf", "olm", "irp"], "zz": ["ée", "ouça", "ñil", "vra", "üe"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    true = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    out = langid.report(df).collect()
    assert len(out) == len(true)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and true[r.doc_id]]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.99 * len(held)
    again = langid.report(df).collect()
    assert sorted(out) == sorted(again)


def test_mixtures(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, lang, 80), lang, "s", 1) for i, lang in enumerate(["xx", "yy", "zz"] * 30)]
    p = langid.Predictor(langid.fit(docs(spark, rows)))
    for share in (0.25, 0.4):
        text = sentence(rng, "xx", int(400 * (1 - share))) + " " + sentence(rng, "zz", int(400 * share))
        lang, score, n, _, named = p.predict(text)
        assert (lang, n) == ("xx", 2) and abs(score - (1 - share)) < 0.08 and named.startswith(f"xx:{score:.3f}|zz:")
    assert p.predict(sentence(rng, "yy", 5))[:3:2] == ("yy", 1)
    # The proportions agree with EM over every word, one by one.
    text = sentence(rng, "xx", 30) + " " + sentence(rng, "yy", 50)
    ll = p.model.likelihood([w.encode() for w in text.split()])
    pi = np.full(3, 1 / 3)
    for _ in range(300):
        r = pi * np.exp(ll - ll.max(axis=1, keepdims=True))
        pi = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    words = langid.words_of(text)
    rel = p._likelihoods(list(words))
    own, _ = p.mixture(np.exp(np.maximum(rel - rel.max(axis=1, keepdims=True), -60)), np.array(list(words.values()), dtype=float))
    assert np.allclose(pi, own, atol=2e-3)


def brute_set(e, c, penalty):
    """Every nested set by itself, its proportions by a long EM over words taken one by one."""
    full = long_em(e, c)
    order = sorted(range(e.shape[1]), key=lambda k: -full[k])
    scores = []
    for k in range(1, e.shape[1] + 1):
        own = e[:, order[:k]]
        pi = long_em(own, c)
        scores.append(sum(n * np.log(row @ pi) for row, n in zip(own, c)) - penalty * np.log(c.sum() + 1) * (k - 1))
    return 1 + int(np.argmax(scores)), order


def long_em(e, c, rounds=3000):
    pi = np.full(e.shape[1], 1 / e.shape[1])
    for _ in range(rounds):
        r = pi * e
        pi = (c[:, None] * r / r.sum(axis=1, keepdims=True)).sum(axis=0) / c.sum()
    return pi


class Table:
    """A model of given likelihoods."""

    def __init__(self, rows):
        self.langs, self.rows = [f"l{k}" for k in range(len(next(iter(rows.values()))))], rows

    def likelihood(self, words):
        return np.log([self.rows[w.decode()] for w in words])


def test_choice_of_the_set_against_brute_force():
    rng = np.random.default_rng(3)
    sizes = set()
    for case in range(40):
        k = int(rng.integers(2, 6))
        words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(30)]
        truth = rng.choice(k, size=int(rng.integers(1, k + 1)), replace=False)
        rows = {w: np.exp(rng.normal(-12, 1, k) + 5 * (np.arange(k) == rng.choice(truth))) for w in words}
        c = rng.integers(1, 6, len(words))
        p = langid.Predictor(Table(rows), tol=1e-9, most_rounds=3000)
        text = " ".join(w for w, n in zip(words, c) for _ in range(n))
        found = langid.words_of(text)
        e = np.array([rows[w] / max(rows[w]) for w in found])
        want, order = brute_set(e, np.array(list(found.values()), dtype=float), p.penalty)
        lang, score, n, _, named = p.predict(text)
        assert n == want and {x.split(":")[0] for x in named.split("|")} == {f"l{k}" for k in order[:n]}
        sizes.add(n)
    assert len(sizes) > 2


def test_sets_that_pay_only_together():
    """Three languages that pay together, though neither pair of them does."""
    one, none = 1.0, 1e-9
    rows = {"a" * 5: [one, none, none], "b" * 5: [none, one, none], "c" * 5: [none, none, one]}
    p = langid.Predictor(Table(rows), tol=1e-9)
    assert p.predict(" ".join(["a" * 5, "b" * 5, "c" * 5]))[2] == brute_set(np.array(list(rows.values())), np.ones(3), p.penalty)[0] == 3


def test_odd_rows(spark):
    df = odd_docs(spark)
    out = {r.doc_id: r for r in langid.report(df).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and out[1].score == 0
    assert {r.lang_pred for r in out.values()} <= {"und", "en", "de", "fr", "es"}
    assert langid.report(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.report(docs(spark, [(1, "a text", None, "s", 1), (2, "1 ½ Ⅷ 。", "en", "s", 1)])).collect()} == {"und"}
    kept = langid.identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} <= {4, 5, None, 7, 8, 9, 10}


def test_clean_documents_stay(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert langid.identified(df).count() >= 0.99 * df.where("text is not null and text <> ''").count()
