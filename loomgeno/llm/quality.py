"""Quality classification by co-training of two views.

One view sees only a text's content (shape of words, lines and symbols, repetition), the other only what is known of its page
(source, language, recorded length). Both start from the labelled rows; in each round, each view labels the unlabelled rows
it is surest of among all, by calibrated probability, and hands them to the other. Each view is calibrated on labelled rows kept
apart, the calibrated log odds are combined by a small regression, and all documents are scored over their whole texts.

Fitting uses at most about `most_labels` labelled rows, chosen by hash; what a view hands over is chosen among every unlabelled
row, and scoring covers every row.

Defined cases: null text counts as empty; null source, language or length are values of their own; a document labelled
more than once takes its least label, and an id with several rows teaches by the least of them; a score of just `least` is accepted;
rows of which a view is equally sure are handed over in order of their features; with no labels, or labels of one class, every document scores 1 and stays; labels
without a document teach nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgeno.llm.common import bounded_batches, drop_table, materialize

MOST_LABELS = 12_000
ROUNDS, HANDED, SURE = 3, 400, 0.97
#: Bins of each content feature, and hash buckets of the page's source and language.
BINS, SOURCES, LANGS = 10, 64, 16
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
SPACE, DIGITS, UPPER = b" \t\n\r\x0b\x0c", b"0123456789", bytes(range(65, 91))


def content(text: str | None) -> list[float]:
    """Features of a whole text."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    left = lambda drop: len(raw) - len(raw.translate(None, drop))
    words, lines = raw.split(), raw.split(b"\n")
    w, seen = max(1, len(words)), Counter(words)
    top = max(seen.values(), default=0)
    same = sum(map(bytes.__eq__, words, words[1:]))
    letters, space, digits = left(LETTERS), left(SPACE), left(DIGITS)
    chars = sum(map(len, words))
    line = Counter(lines)
    ends = left(b".!?")
    return [
        math.log1p(len(raw)), math.log1p(len(words)), len(seen) / w, top / w, same / w, letters / n, digits / n, (n - letters - space - digits) / n, left(b"|") / w, left(b"#$%&*@") / w,
        left(UPPER) / n, chars / w, ends / w, (len(lines) - len(line)) / len(lines), len(words) / len(lines), left(b"<>{}[]\\/=_") / n, left(b",;:") / w, len(seen) / math.sqrt(w),
    ]


def page(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Cells of the page view: source, language, length, and language with length."""
    s = zlib.crc32(repr(source).encode()) % SOURCES
    g = zlib.crc32(repr(lang).encode()) % LANGS
    size = 0 if n_chars is None else 1 + min(14, int(math.log2(max(1, n_chars))))
    return [s, SOURCES + g, SOURCES + LANGS + size, SOURCES + LANGS + 16 + g * 16 + size]


PAGE_CELLS = SOURCES + LANGS + 16 + LANGS * 16


class View:
    """Ridge logistic regression on one-hot cells, and its calibration."""

    def __init__(self, cells: int, ridge: float = 1.0):
        self.cells, self.ridge, self.w, self.slope, self.base = cells, ridge, np.zeros(cells + 1), 1.0, 0.0

    def fit(self, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Newton steps; at: cell numbers (rows x active cells)."""
        x = np.zeros((len(at), self.cells + 1))
        x[np.arange(len(at))[:, None], at] = 1
        x[:, -1] = 1
        w = np.zeros(self.cells + 1)
        ridge = np.full(len(w), self.ridge)
        ridge[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def raw(self, at: np.ndarray) -> np.ndarray:
        return self.w[at].sum(axis=1) + self.w[-1]

    def calibrate(self, at: np.ndarray, y: np.ndarray) -> None:
        self.base, self.slope = logistic(self.raw(at)[:, None], y)

    def odds(self, at: np.ndarray) -> np.ndarray:
        return np.clip(self.base + self.slope * self.raw(at), -12, 12)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slopes, with a weak ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(len(w)) * 0.1, x.T @ (y - p) - 0.1 * w)
    return w


#: Feature values, page cells and labels of rows that a view hands over.
Chosen = tuple[np.ndarray, np.ndarray, np.ndarray]


class Judge:
    """Both views and their combination."""

    def __init__(self, edges: np.ndarray, rounds: int):
        self.edges, self.rounds, self.fitted = edges, rounds, False
        self.text, self.page = View(len(edges) * (BINS + 1)), View(PAGE_CELLS)
        self.mix = np.array([0.0, 1.0, 0.0])

    def cells(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, k], side="right") + k * (BINS + 1) for k, e in enumerate(self.edges)], axis=1)

    def train(self, text: np.ndarray, page_: np.ndarray, y: np.ndarray, apart: np.ndarray, choose: Callable[[Judge, int], list[Chosen]]) -> None:
        """Rounds of co-training. text: feature values, page_: cells; apart: rows kept for calibration. After each round but the last,
        choose() gives the unlabelled rows that either view is surest of, to be handed to the other."""
        own, out = ~apart, apart
        views, data = (self.text, self.page), (self.cells(text), page_)
        handed = [(np.zeros((0, text.shape[1])), np.zeros((0, page_.shape[1]), dtype=int), np.zeros(0))] * 2
        for r in range(self.rounds + 1):
            for k, v in enumerate(views):
                features, pages, label = handed[1 - k]
                more = self.cells(features) if k == 0 else pages
                v.fit(np.concatenate([data[k][own], more]), np.concatenate([y[own], label]), np.concatenate([np.ones(own.sum()), np.full(len(label), 0.5)]))
                v.calibrate(data[k][out], y[out])
            if r < self.rounds:
                handed = choose(self, r)
        odds = np.column_stack([v.odds(d[out]) for v, d in zip(views, data)])
        self.mix = logistic(odds, y[out])
        if (bad := np.flatnonzero(self.mix[1:] < 0)).size:
            # A view that speaks against itself once the other is known has no say.
            rest = [k for k in (0, 1) if k not in bad]
            w = logistic(odds[:, rest], y[out])
            self.mix = np.zeros(3)
            self.mix[[0, *(k + 1 for k in rest)]] = w
        self.fitted = True

    def wanted(self, r: int, share: float) -> tuple[int, int]:
        """How many good and bad rows a view hands over after round r: as many of each as their share among the labelled."""
        return round(HANDED * (r + 1) * share), round(HANDED * (r + 1) * (1 - share))

    def both_odds(self, text: np.ndarray, page_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.text.odds(self.cells(text)), self.page.odds(page_)

    def score(self, text: np.ndarray, page_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.fitted:
            one = np.ones(len(text))
            return one, one, one
        a, b = self.both_odds(text, page_)
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p(a), p(b), p(self.mix[0] + self.mix[1] * a + self.mix[2] * b)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [content(x.as_py()) for x in b.column(1)]
        pages = [page(*x) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64())), pa.array(pages, pa.list_(pa.int64()))], ["y", "content", "page"])


def _columns(docs: DataFrame) -> list:
    return [F.col("text").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars")]


def _surest(raw: bytes, good: int, bad: int):
    """Of a task's rows (content, page): the surest good and bad ones by each view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, best = pickle.loads(raw), {}
        sure = math.log(SURE / (1 - SURE))
        for b in batches:
            text, pages = _arrays(b.column(0), b.column(1))
            for view, odds in enumerate(judge.both_odds(text, pages) if len(text) else ()):
                for sign, most in ((1, good), (-1, bad)):
                    at = np.flatnonzero(sign * odds >= sure)
                    new = np.column_stack([-sign * odds[at], text[at], pages[at]])
                    held = np.concatenate([best[view, sign], new]) if (view, sign) in best else new
                    best[view, sign] = held[np.lexsort(held.T[::-1])[:most]]
        for (view, sign), held in best.items():
            n, width = len(held), len(content(""))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, view, dtype=np.int32)), pa.array(np.full(n, sign, dtype=np.int32)), pa.array(held[:, 0]), pa.array(held[:, 1 : 1 + width].tolist(), pa.list_(pa.float64())), pa.array(held[:, 1 + width :].astype(np.int64).tolist(), pa.list_(pa.int64()))], ["view", "sign", "place", "content", "page"])

    return run


def _arrays(text: pa.Array, pages: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(text.flatten(), dtype=float).reshape(len(text), len(content(""))), np.asarray(pages.flatten(), dtype=np.int64).reshape(len(pages), len(page(None, None, None)))


def chooser(pool: DataFrame, share: float) -> Callable[[Judge, int], list[Chosen]]:
    """Picks from pool(content, page), every unlabelled row, the surest ones of all: the best of each task, then the best of those.
    Equally sure rows go by their features."""

    def choose(judge: Judge, r: int) -> list[Chosen]:
        most = dict(zip((1, -1), judge.wanted(r, share)))
        best = materialize(pool.mapInArrow(_surest(pickle.dumps(judge), most[1], most[-1]), "view int, sign int, place double, content array<double>, page array<long>"), "surest")
        out = []
        for view in (0, 1):
            rows = [(row.content, row.page, float(sign > 0)) for sign in (1, -1) for row in best.where((F.col("view") == view) & (F.col("sign") == sign)).orderBy("place", "content", "page").limit(most[sign]).collect()]
            out.append((np.array([x[0] for x in rows], dtype=float).reshape(len(rows), len(content(""))), np.array([x[1] for x in rows], dtype=int).reshape(len(rows), len(page(None, None, None))), np.array([x[2] for x in rows], dtype=float)))
        drop_table(best)
        return out

    return choose


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_labels: int = MOST_LABELS, rounds: int = ROUNDS) -> Judge:
    """A judge from docs(doc_id, text, source, lang, n_chars) and labels(doc_id, quality). At most about most_labels labelled documents
    teach; the unlabelled rows that views hand over are chosen among all others, whose features are written once."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.min(F.col(label_col)).cast("int").alias("y"))
    place = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20))
    n_known = known.count()
    share = min(1.0, most_labels / n_known) if n_known else 0.0
    some = known.where(place < share * (1 << 20))
    rows = docs.select("doc_id", *_columns(docs))
    names = ["text", "source", "lang", "n_chars"]
    # The sample of ids is bounded by most_labels, so it is broadcast and no text but the sample's is shuffled. One row an id.
    taught = rows.join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct(*names)).alias("row")).select("y", "row.*")
    schema = "y int, content array<double>, page array<long>"
    got = taught.mapInArrow(_features, schema).toArrow()
    y = got["y"].to_numpy() if got.num_rows else np.zeros(0, dtype=int)
    text, pages = _arrays(got["content"].combine_chunks(), got["page"].combine_chunks()) if got.num_rows else (np.zeros((0, len(content("")))), np.zeros((0, 4), dtype=int))
    # Rows arrive in any order: sorted, so that reruns agree.
    order = np.lexsort([*text.T, *pages.T, y]) if len(y) else np.zeros(0, dtype=int)
    y, text, pages = y[order], text[order], pages[order]
    if len(set(y.tolist())) < 2 or len(y) < 20:
        return Judge(np.zeros((len(content("")), BINS)), rounds)
    judge = Judge(edges_of(text, y), rounds)
    pool = rows.join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti").select(F.lit(-1).alias("y"), *names)
    pool = materialize(pool.mapInArrow(_features, schema).select("content", "page"), "pool") if rounds else None
    judge.train(text, pages, y.astype(float), np.arange(len(y)) % 4 == 0, chooser(pool, y.mean()) if rounds else lambda judge, r: [])
    drop_table(pool)
    return judge


def edges_of(text: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bin edges of each feature: quantiles, and as rare values matter, the extremes of the lesser class."""
    edges = np.quantile(text, np.linspace(0, 1, BINS + 2)[1:-1], axis=0).T
    for k, f in enumerate(text.T):
        few = f[y == (0 if y.mean() > 0.5 else 1)]
        edges[k] = np.sort(np.concatenate([edges[k][1::2], np.quantile(few, [0.05, 0.25, 0.5, 0.75, 0.95])]))[:BINS]
    return edges


@lru_cache(1)
def _judge(raw: bytes) -> Judge:
    return pickle.loads(raw)


def score(docs: DataFrame, judge: Judge) -> DataFrame:
    """docs with score_text, score_page and quality_score added (columns of these names are replaced). The judge is of
    fixed size. Only the four columns it needs go to Python, and three numbers come back."""
    raw = pickle.dumps(judge)
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("score_text double, score_page double, quality_score double")
    def judged(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        j = _judge(raw)
        for texts, sources, langs, sizes in parts:
            text = np.array([content(x) for x in texts]).reshape(len(texts), -1)
            pages = np.array([page(s, g, None if pd.isna(n) else int(n)) for s, g, n in zip(sources, langs, sizes)])
            yield pd.DataFrame(dict(zip(("score_text", "score_page", "quality_score"), j.score(text, pages))))

    new = ["score_text", "score_page", "quality_score"]
    return docs.withColumn("__judged", judged(*_columns(docs))).drop(*new).select("*", "__judged.*").drop("__judged")


def report(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """(doc_id, score_text, score_page, quality_score, kept) for every document."""
    judge = fit(docs, labels)
    out = score(docs.select("doc_id", "text", "source", "lang", "n_chars"), judge)
    return out.select("doc_id", "score_text", "score_page", "quality_score", (F.col("quality_score") >= least).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """docs that the judge accepts."""
    mine = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    at = {c: f"c{docs.columns.index(c)}" for c in ("text", "source", "lang", "n_chars")}
    named = mine.withColumnsRenamed({v: k for k, v in at.items()})
    out = score(named, fit(docs, labels)).where(F.col("quality_score") >= least)
    return out.select([F.col(c if c in at else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
