import numpy as np

from loomgeno.llm import quality
from tests.llm.helpers import odd_docs


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    judge = quality.fit(df, labels.where("doc_id % 5 <> 0"))
    some = labels.where("doc_id % 5 = 0").select("doc_id", "quality")
    out = quality.score(df.select("doc_id", "text", "source", "lang", "n_chars"), judge).join(some, "doc_id").select("quality", "quality_score", "score_text", "score_page").toArrow()
    y, p = out["quality"].to_numpy(), out["quality_score"].to_numpy()
    assert (p[y == 1] >= 0.5).mean() > 0.98 and (p[y == 0] < 0.5).mean() > 0.95
    # Calibrated: mean score near the share of good documents.
    assert abs(p.mean() - y.mean()) < 0.05


def test_every_row_is_scored_and_reruns_agree(spark):
    at = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    a, b = (sorted(quality.report(df, labels).collect()) for _ in range(2))
    assert a == b and [r.doc_id for r in a] == sorted(r.doc_id for r in df.select("doc_id").collect())
    brute = [quality.content(r.text) for r in df.select("text").limit(5).collect()]
    assert np.isfinite(np.array(brute)).all()


def test_odd_rows(spark):
    df = odd_docs(spark)
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (4, None, 0), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.report(df, labels).collect()
    assert len(out) == df.count() and all(r.quality_score == 1.0 and r.kept for r in out)
    assert quality.accepted(df, labels).columns == df.columns
    assert quality.report(df.limit(0), labels).collect() == [] and quality.report(df.limit(0), labels.limit(0)).collect() == []
    many = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    texts = spark.createDataFrame([(i, "bad " * 30 if i % 2 == 0 else "some good and varied words here", None, None, None) for i in range(40)], df.select("doc_id", "text", "lang", "source", "n_chars").schema)
    kept = {r.doc_id for r in quality.accepted(texts.selectExpr("*", "1 as quality_score"), many).collect()}
    assert kept == {i for i in range(40) if i % 2}


def brute_rounds(rows, labels, rounds):
    """Co-training in plain lists: rows (id, text, source, lang, n_chars), labels id -> quality."""
    cells = lambda x, edges: [sum(e <= v for e in es) + k * (quality.BINS + 1) for k, (v, es) in enumerate(zip(x, edges))]
    seen = [(quality.content(t), quality.page(s, g, n), labels.get(i)) for i, t, s, g, n in rows]
    known = sorted((x for x in seen if x[2] is not None), key=lambda x: (x[2], x[1][::-1], x[0][::-1]))
    y = np.array([x[2] for x in known], dtype=float)
    edges = quality.edges_of(np.array([x[0] for x in known]), y)
    data = [[cells(x[0], edges) for x in known], [x[1] for x in known]]
    pool = [(x[0], [cells(x[0], edges), x[1]]) for x in seen if x[2] is None]
    apart = [k % 4 == 0 for k in range(len(known))]
    handed = [[], []]
    views = quality.View(len(edges) * (quality.BINS + 1)), quality.View(quality.PAGE_CELLS)
    for r in range(rounds + 1):
        for k, v in enumerate(views):
            at = [d for d, out in zip(data[k], apart) if not out] + [p[1][k] for p, _ in handed[1 - k]]
            lab = [z for z, out in zip(y, apart) if not out] + [z for _, z in handed[1 - k]]
            v.fit(np.array(at), np.array(lab), np.array([1.0] * (len(apart) - sum(apart)) + [0.5] * len(handed[1 - k])))
            v.calibrate(np.array([d for d, out in zip(data[k], apart) if out]), y[np.array(apart)])
        if r < rounds:
            handed = []
            for k, v in enumerate(views):
                odds = [float(v.odds(np.array([p[1][k]]))[0]) for p in pool]
                own = []
                for sign, share in ((1, y.mean()), (-1, 1 - y.mean())):
                    order = sorted(range(len(pool)), key=lambda i: (-sign * odds[i], pool[i][0], pool[i][1][1]))
                    own += [(pool[i], float(sign > 0)) for i in order[: round(quality.HANDED * (r + 1) * share)] if sign * odds[i] >= np.log(quality.SURE / (1 - quality.SURE))]
                handed.append(own)
    return views


def test_rounds_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quality, "HANDED", 60)
    at = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    known = {}
    for r in labels.collect():
        if r.quality is not None:
            known[r.doc_id] = min(r.quality, known.get(r.doc_id, 1))
    judge = quality.fit(df, labels, rounds=2)
    text, page = brute_rounds([tuple(r) for r in df.select("doc_id", "text", "source", "lang", "n_chars").collect()], known, 2)
    assert np.allclose(judge.text.w, text.w, atol=1e-6) and np.allclose(judge.page.w, page.w, atol=1e-6)
    alone = quality.fit(df, labels, rounds=0)
    assert not np.allclose(alone.page.w, page.w, atol=1e-3)


def test_a_view_is_the_maximum_of_its_likelihood():
    rng = np.random.default_rng(2)
    at, y, w = rng.integers(0, 6, (200, 2)) + np.array([0, 6]), rng.integers(0, 2, 200).astype(float), rng.uniform(0.5, 1, 200)
    v = quality.View(12)
    v.fit(at, y, w)

    def value(c):
        z = c[at].sum(axis=1) + c[-1]
        return (w * (y * z - np.logaddexp(0, z))).sum() - 0.5 * (c[:-1] ** 2).sum()

    assert all(value(v.w) >= value(v.w + rng.normal(0, 0.01, 13)) for _ in range(200))


def test_accuracy_by_view_and_rounds(spark):
    """The text view carries these tables; rounds and the page view do no harm."""
    at = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    some = labels.where("doc_id % 5 = 0").select("doc_id", "quality")
    right = {}
    for rounds in (0, quality.ROUNDS):
        judge = quality.fit(df, labels.where("doc_id % 5 <> 0"), rounds=rounds)
        out = quality.score(df.select("doc_id", "text", "source", "lang", "n_chars").join(some, "doc_id"), judge).toArrow()
        y = out["quality"].to_numpy() == 1
        right[rounds] = [((out[c].to_numpy() >= 0.5) == y).mean() for c in ("quality_score", "score_text", "score_page")]
    print(right)
    assert right[quality.ROUNDS][0] >= max(right[0][0], right[quality.ROUNDS][1]) - 0.01


def test_pseudo_labels_pass_between_views():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    text = np.stack([y * 11 + rng.integers(0, 3, 400)], axis=1)
    page = np.stack([np.where(rng.random(400) < 0.9, y, 1 - y) + 2 * rng.integers(0, 2, 400)], axis=1)
    judge = quality.Judge(np.zeros((2, quality.BINS)), 2)
    judge.text, judge.page = quality.View(22), quality.View(4)
    few = np.arange(60)
    judge.cells = lambda x: x.astype(int)

    def choose(j, r):
        out = []
        for v, d in ((j.text, text[60:]), (j.page, page[60:])):
            odds = v.odds(d)
            at = np.flatnonzero(np.abs(odds) > np.log(quality.SURE / (1 - quality.SURE)))
            out.append((text[60:][at].astype(float), page[60:][at], (odds[at] > 0).astype(float)))
        return out

    judge.train(text[few], page[few], y[few].astype(float), few % 4 == 0, choose)
    a, b, c = judge.score(text[60:], page[60:])
    assert ((c > 0.5) == y[60:]).mean() > 0.97 and ((b > 0.5) == y[60:]).mean() > 0.85
