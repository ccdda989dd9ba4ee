"""Language identification of mixed texts by expectation-maximisation over n-gram likelihoods.

Each language has a trigram model of its words' bytes, backed off to bigrams and bytes. A document is a mixture: every
distinct word has a likelihood in every language, and EM estimates the proportions. The set of languages is then chosen
by penalised likelihood among all the nested sets in order of proportion, and the most frequent language of the set is
predicted.

Models are fitted on at most `most_docs` labelled documents a language (about that many, by hash), which are counted
where they lie; every document is predicted, over its whole text.

Defined cases: null text, or text without a letter, is `und` with score 0; with nothing to learn from, every document is
`und`; null or absent languages teach nothing; an id that is null counts as the empty text in the split; equal
proportions go to the first language in order; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgeno.llm.common import bounded_batches

#: Documents a language that models are fitted on.
MOST_DOCS = 3000
#: Buckets of the trigram table, and words whose likelihoods a worker remembers.
BUCKETS, REMEMBERED = 1 << 17, 100_000
WORDS = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words_of(text: str) -> Counter:
    """Lower-cased words with their counts; numerals that aren't letters are left out."""
    found = Counter(WORDS.findall(text.lower()))
    if not text.isascii():
        for w in [w for w in found if not any(map(str.isalpha, w))]:
            del found[w]
    return found


def _grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every byte of every word and its end: (word, trigram bucket, bigram before it, byte)."""
    flat = np.frombuffer(b"".join([b"\x01\x01" + w + b"\x02" for w in words]), dtype=np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 3
    word = np.repeat(np.arange(len(words)), size)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.flatnonzero(np.arange(len(flat)) - start[word] >= 2)
    before, own = flat[at - 2] * 256 + flat[at - 1], flat[at]
    tri = ((before * 256 + own) * 0x9E3779B1 >> 7) % BUCKETS
    return word[at], tri, before, own


class Model:
    """Likelihoods of words in each language, from trigram, bigram and byte counts."""

    def __init__(self, langs: list[str], tri: np.ndarray, bi: np.ndarray):
        self.langs = langs
        self.tri, self.bi = tri.astype(np.float32), bi.astype(np.float32)
        self.context = self.bi.reshape(-1, 256, 256)
        # bi counts (byte before, byte); tri's context is the pair before.
        one = self.context.sum(axis=1)
        self.one = (one + 0.5) / (one + 0.5).sum(axis=1, keepdims=True)
        self.row = self.context.sum(axis=2)

    def likelihood(self, words: list[bytes]) -> np.ndarray:
        """Log likelihood (words x languages)."""
        word, tri, before, own = _grams(words)
        last = before % 256
        low = (self.bi[:, last * 256 + own] + 8 * self.one[:, own]) / (self.row[:, last] + 8)
        p = (self.tri[:, tri] + 4 * low) / (np.maximum(self.bi[:, before], self.tri[:, tri]) + 4)
        out = np.empty((len(words), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(word, weights=np.log(p[k]), minlength=len(words))
        return out


class Predictor:
    def __init__(self, model: Model, most_rounds: int = 500, penalty: float = 3.0, tol: float = 1e-4):
        self.model, self.most_rounds, self.penalty, self.tol = model, most_rounds, penalty, tol
        self.known: dict[str, int] = {}
        self.rows = np.empty((0, len(model.langs)))

    def _likelihoods(self, words: list[str]) -> np.ndarray:
        known = self.known
        if new := [w for w in words if w not in known]:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = words
            n = len(known)
            if n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows[:n], np.empty((max(1024, n, len(new)), self.rows.shape[1]))])
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                self.rows[n : n + len(part)] = self.model.likelihood([w.encode() for w in part])
                known.update(zip(part, range(n, n + len(part))))
                n += len(part)
        return self.rows[[known[w] for w in words]]

    def mixture(self, e: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions by EM, until none moves by more than `tol`, and the log likelihood under them. e: relative likelihoods,
        c: counts."""
        pi, share = np.full(e.shape[1], 1 / e.shape[1]), c / c.sum()
        for _ in range(self.most_rounds):
            new = pi * ((share / (e @ pi)) @ e)
            moved, pi = np.abs(new - pi).max(), new
            if moved < self.tol:
                break
        return pi, float(c @ np.log(e @ pi))

    def predict(self, text: str | None) -> tuple[str, float, int, float, str]:
        """(language, its proportion, number of languages, log likelihood a byte, proportions of the set's languages)."""
        found = words_of(text or "")
        if not found or not self.model.langs:
            return "und", 0.0, 0, 0.0, ""
        words = list(found)
        c = np.fromiter(found.values(), dtype=np.float64, count=len(words))
        ll = self._likelihoods(words)
        top = ll.max(axis=1, keepdims=True)
        rel = np.maximum(ll - top, -60)
        e = np.exp(rel)
        each = sum(k * (len(w.encode()) + 1) for w, k in found.items()) if not text.isascii() else sum(k * (len(w) + 1) for w, k in found.items())
        base = float(c @ top[:, 0])
        pi, _ = self.mixture(e, c)
        order = np.argsort(-pi, kind="stable")
        price = self.penalty * math.log(c.sum() + 1)
        # All nested sets, until the price of one is more than any set can gain: no likelihood exceeds 0 here.
        best, value, shares = 1, float(c @ rel[:, order[0]]), None
        for k in range(2, len(order) + 1):
            if value - price * (best - 1) >= -price * (k - 1):
                break
            s, now = self.mixture(e[:, order[:k]], c)
            if now - price * (k - 1) > value - price * (best - 1):
                best, value, shares = k, now, s
        if shares is None:
            lang = self.model.langs[order[0]]
            return lang, float(min(1.0, pi[order[0]])), 1, (base + value) / each, f"{lang}:1.000"
        at = int(np.argmax(shares))
        named = "|".join(f"{self.model.langs[order[k]]}:{shares[k]:.3f}" for k in np.argsort(-shares, kind="stable"))
        return self.model.langs[order[at]], float(min(1.0, shares[at])), best, (base + value) / each, named


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS) -> Model:
    """Models of the languages in docs(id, text, lang). The driver gets the count tables: one a language, of fixed size."""
    bounded_batches(docs.sparkSession)
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    have = dict(map(tuple, known.groupBy("lang").count().collect()))
    if not have:
        return Model([], np.zeros((0, BUCKETS)), np.zeros((0, 65536)))
    share = F.lit(1.0)
    if large := {k: most_docs / n for k, n in have.items() if n > most_docs}:
        share = F.coalesce(F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("lang")], F.lit(1.0))
    some = known.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tri: dict[str, np.ndarray] = {}
        bi: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                found = words_of(text.as_py())
                if not found:
                    continue
                lang = lang.as_py()
                word, t, before, own = _grams([w.encode() for w in found])
                w = np.fromiter(found.values(), dtype=np.float64, count=len(found))[word]
                tri.setdefault(lang, np.zeros(BUCKETS))
                bi.setdefault(lang, np.zeros(65536))
                tri[lang] += np.bincount(t, weights=w, minlength=BUCKETS)
                bi[lang] += np.bincount(before % 256 * 256 + own, weights=w, minlength=65536)
        for lang, table, kind in [(k, v, 0) for k, v in tri.items()] + [(k, v, 1) for k, v in bi.items()]:
            at = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(table[at])], ["lang", "kind", "at", "n"])

    counts = some.select("text", "lang").mapInArrow(count, "lang string, kind int, at long, n double").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(have, key=lambda s: s.encode())
    place = {k: i for i, k in enumerate(langs)}
    tri, bi = np.zeros((len(langs), BUCKETS), dtype=np.float32), np.zeros((len(langs), 65536), dtype=np.float32)
    if counts.num_rows:
        at = np.array([place[x] for x in counts["lang"].to_pylist()])
        kind, where, n = (counts[c].to_numpy() for c in ("kind", "at", "n"))
        tri[at[kind == 0], where[kind == 0]] = n[kind == 0]
        bi[at[kind == 1], where[kind == 1]] = n[kind == 1]
    taught = np.flatnonzero(bi.sum(axis=1) > 0)
    return Model([langs[i] for i in taught], tri[taught], bi[taught])


@lru_cache(1)
def _predictor(raw: bytes) -> Predictor:
    return Predictor(pickle.loads(raw))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score, n_langs, fit_per_byte and mixture added (columns of these names are replaced); mixture holds the
    proportions of the chosen languages, as `en:0.700|fr:0.300`. Only the text goes to
    Python; the model is of fixed size for each language."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    bounded_batches(docs.sparkSession)
    new = ["lang_pred", "score", "n_langs", "fit_per_byte", "mixture"]

    @F.pandas_udf("lang_pred string, score double, n_langs int, fit_per_byte double, mixture string")
    def predicted(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = _predictor(shared.value)
        for texts in parts:
            yield pd.DataFrame([p.predict(x) for x in texts], columns=new)

    return docs.withColumn("__predicted", predicted(F.col(text_col))).drop(*new).select("*", "__predicted.*").drop("__predicted")


def report(docs: DataFrame, most_docs: int = MOST_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_langs, mixture) for every document; models learn from those not held out."""
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.where(~held_out(F.col("doc_id"))), most_docs=most_docs)
    out = predict(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "n_langs", "mixture")


def identified(docs: DataFrame, least_share: float = 0.35, least_fit: float = -math.log(256)) -> DataFrame:
    """docs in some language: rejected are those of none (`und`), those in which no language has `least_share`, and those
    that fit their languages worse than bytes drawn at random. With nothing to learn from, all stay."""
    model = fit(docs)
    if not model.langs:
        return docs
    mine = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = f"c{docs.columns.index('text')}"
    out = predict(mine, model, text).where((F.col("lang_pred") != "und") & (F.col("score") >= least_share) & (F.col("fit_per_byte") > least_fit))
    return out.select([F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
