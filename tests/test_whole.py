"""Queries without SQL take in all that their operators should."""

import numpy as np
from pyspark.sql import functions as F

from loomgeno.functions import genotype as G
from loomgeno.functions import special
from loomgeno.operators import impute, pairs, scan
from loomgeno.plans import registry
from loomgeno.plans.views import geno, phenotype, table


def test_ld_lod_keeps_what_ld_contingency_finds(spark, sf):
    g = geno(spark, sf)
    lods = {(r.m1, r.m2): r for r in pairs.ld_lod(g).collect()}
    want = {(r.m1, r.m2): (round(r.g, 5), r.df) for r in pairs.contingency_g(g).collect() if r.df > 0}
    assert {k: (round(r.g, 5), r.df) for k, r in lods.items()} == want
    assert max(b - a for a, b in lods) > 100
    assert all(abs(r.lod - special.equivalent_lod(r.g, r.df)) < 1e-5 for r in lods.values())
    few = {(r.m1, r.m2) for r in pairs.ld_lod(g, 1.0, 0.3).collect()}
    assert few == {k for k, r in lods.items() if r.lod >= 1 and r.r2 >= 0.3} and few


def test_blocks_of_markers_change_nothing(spark, sf):
    g = geno(spark, sf).where("marker < 60")
    plain = lambda df: sorted(map(tuple, df.withColumn("r2", F.round("r2", 9)).collect()), key=str)
    whole = plain(pairs.ld_r2(g))
    assert plain(pairs.ld_r2(g, block=7)) == whole and len(whole) > 1000
    assert plain(pairs.ld_r2(g, band=5, block=7)) == [r for r in whole if r[1] - r[0] <= 5]


def test_founder_matching_of_every_individual(spark, sf):
    rows = [tuple(r) for r in registry.queries()["founder_matching"](spark, sf).collect()]
    calls = {}
    for g in geno(spark, sf).where("gt in ('11', '22')").collect():
        calls.setdefault(g.ind, {})[g.marker] = g.gt
    assert len(calls) > 6
    differ = lambda a, b: sum(calls[a][m] != calls[b][m] for m in calls[a] if m in calls[b])
    free, want = set(calls), []
    for e, back in sorted((i * 7 % 1009, i) for i in calls):
        # Those that share no marker come last.
        t = min(free, key=lambda t: (not set(calls[back]) & set(calls[t]), differ(back, t), t))
        free.remove(t)
        want.append((e, t, differ(back, t)))
    assert rows == want


def test_population_is_made_of_whole_tables(spark, sf):
    q = registry.queries()
    markers = {r[0] for r in table(spark, sf, "supplier").select("s_suppkey").collect()}
    individuals = {r[0] for r in table(spark, sf, "customer").select("c_custkey").collect()}
    cells = {(m, i) for m in markers for i in individuals}
    pop = q["simulated_population"](spark, sf).collect()
    assert len(pop) == len(cells) and {(r.marker, r.ind) for r in pop} == cells
    assert len({r.lg for r in pop}) > 1
    imputed = q["impute_offspring"](spark, sf).collect()
    assert len(imputed) == len(cells) and {(r.marker, r.ind) for r in imputed} == cells
    pairs = {(r.m1, r.m2) for r in q["linkage_pairs"](spark, sf).collect()}
    assert pairs == {(a, b) for a in markers for b in markers if a < b}


def test_groups_with_their_own_markers(spark):
    chromosomes = {0: ([5, 3, 9], [0.0, 2.0, 4.0]), 2: ([4, 8, 1, 7], [0.0, 1.0, 2.0, 2.0])}
    keys = spark.createDataFrame([(lg, i) for lg in chromosomes for i in range(40)], "lg long, ind long")
    pop = impute.simulate_over(keys, chromosomes, "2ril-self4", missing=0.2)
    founders = impute.founder_tables("2ril-self4", chromosomes)
    rows = pop.collect()
    assert all({r.true[0], r.true[1]} == {founders[r.marker][r.o1], founders[r.marker][r.o2]} for r in rows)
    imputed = {(r.marker, r.ind): r.gt for r in impute.offspring(pop, impute.founder_rows(spark, "2ril-self4", chromosomes), 2.5).collect()}
    assert len(imputed) == len(rows) == 40 * 7
    assert sum(imputed[r.marker, r.ind] == r.true for r in rows) > 0.9 * len(rows)


def test_threshold_of_200_permutations(spark, sf):
    g = geno(spark, sf).where("gt in ('11', '12', '22')").select("marker", "ind", G.dose(F.col("gt")).alias("x"))
    assert registry.queries()["scan_threshold"](spark, sf).first()[0] == scan.permutation_threshold(g, phenotype(spark, sf), 200)


def test_shared_cells_give_what_products_give(spark, sf):
    """Markers whose individuals are few of all are counted cell by cell, over many ranges."""
    from loomgeno.operators.pairs import block_pairs

    g = geno(spark, sf).where("marker < 90")
    # Two copies with other keys, which share nothing.
    twice = g.unionByName(g.withColumn("marker", F.col("marker") + 1000).withColumn("ind", F.col("ind") + 1000))

    def stat(c):
        return {f"n{i}{j}": c[i, j] for i in range(3) for j in range(3)}, c.sum(axis=(0, 1)) >= 2

    columns = ", ".join(f"n{i}{j} long" for i in range(3) for j in range(3))
    plain = lambda df: sorted(map(tuple, df.collect()))
    want = plain(block_pairs(twice, stat, columns, least_n=2, filled=0.0))
    assert len(want) > 1000
    for block in (None, 7, 500):
        assert plain(block_pairs(twice, stat, columns, block, least_n=2, filled=9.0)) == want
    assert plain(block_pairs(twice, stat, columns, 7, 5, least_n=2, filled=9.0)) == [r for r in want if r[1] - r[0] <= 5]


def test_neighbours_of_a_similarity(spark):
    """Rows that meet all others block by block keep what the table of all pairs keeps; no pair is a row before."""
    import numpy as np

    from loomgeno.operators import sequences as S

    rng = np.random.default_rng(3)
    ids = np.sort(rng.choice(100_000, 300, replace=False))
    like = lambda a, b: np.where((a + b) % 3 == 0, np.minimum(a, b) * 31 % 97 * (np.maximum(a, b) % 89) % 50 / 50.0, np.nan)
    rows = [(int(a), int(b), float(like(a, b))) for i, a in enumerate(ids) for b in ids[i + 1 :] if (a + b) % 3 == 0]
    pairs, table = spark.createDataFrame(rows, "a long, b long, v double"), spark.createDataFrame([(int(i),) for i in ids], "id long")
    plain = lambda df: sorted(map(tuple, df.collect()))
    old = S.VALUES
    for most in (old, 1000):
        S.VALUES = most
        assert plain(S.nearest_of(table, like, 4, 0.97)) == plain(S.nearest(pairs, 4, 0.97))
        assert plain(S.neighbour_lists_of(table, like, 3)) == plain(S.neighbour_lists(pairs, 3))
    S.VALUES = old


def test_calls_of_arrays(spark):
    from loomgeno.operators import sequences as S

    rows = [(k, [(k * 7 % 5) / 10, (k * 3 % 5) / 10, 0.3]) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, p array<double>")
    state, prob = S.array_call(F.col("p"), 0.35)
    long = df.select("k", F.posexplode("p").alias("state", "prob")).withColumn("state", F.col("state") + 1)
    want = sorted(map(tuple, S.ancestry_call(long, ["k"], 0.35).select("k", "state", "prob").collect()))
    assert sorted(map(tuple, df.select("k", state, prob).collect())) == want


def test_chains_of_different_steps_go_together(spark):
    import numpy as np

    from loomgeno.operators import hmm

    rng = np.random.default_rng(4)
    rate, init = np.array([[-1.0, 0.6, 0.4], [0.5, -1.0, 0.5], [0.2, 0.8, -1.0]]), np.array([0.2, 0.3, 0.5])
    lengths = [5, 1, 9, 5, 3]
    start, emit, gaps = np.cumsum(lengths) - lengths, rng.random((23, 3)), rng.choice([0.0, 5e-6, 0.02, 0.3], 23)
    post, ll = hmm.posterior_mixed(init, rate, gaps, start, emit, {})
    for lo, n, own in zip(start, lengths, ll):
        p, want = hmm.posterior(init, [hmm.transition(rate, g) for g in gaps[lo + 1 : lo + n]], emit[lo : lo + n])
        assert np.allclose(post[lo : lo + n], p, atol=1e-12) and np.isclose(own, want)


def test_founders_are_not_broadcast(spark, sf):
    """Their tables grow with the markers, though a plan thinks them small."""
    for name in ("marker_errors", "individual_errors", "corrected_founders", "reconstructed_origins"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "BroadcastHashJoin" not in plan and plan.count("MapInPandas") > 0


def test_founders_whose_candidates_are_taken(spark):
    """The first free one is left to those whose candidates are taken, and nobody is left to the last."""
    from loomgeno.operators import accuracy

    truth = spark.createDataFrame([(1, 5, "11"), (1, 6, "22"), (2, 9, "11")], "marker long, founder long, allele string")
    est = spark.createDataFrame([(1, 1, "22"), (2, 2, "11"), (2, 3, "11"), (1, 4, "11")], "marker long, founder long, allele string")
    assert sorted(map(tuple, accuracy.match_founders(truth, est).collect())) == [(1, 6, 0), (2, 9, 0), (3, 5, 0)]


def test_imputation_moves_no_cell(spark, sf):
    """Simulated chains lie whole, so only their keys are shuffled; the general way gives the same."""
    from loomgeno.plans.models import _population

    df = registry.queries()["impute_offspring"](spark, sf)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString() and df._jdf.queryExecution().analyzed().toString().count("Repartition") == 1
    plain = lambda x: sorted((r.lg, r.ind, r.marker, r["gt"], round(r.p1, 9), round(r.p2, 9)) for r in x.collect())
    assert plain(df) == plain(impute.offspring(*_population(spark, sf), 2.5))


def test_permutations_some_at_a_time(spark, sf):
    """However few permutations a task may hold, the threshold is the same, and no cell carries its permutations."""
    g = geno(spark, sf).where("gt in ('11', '12', '22')").select("marker", "ind", G.dose(F.col("gt")).alias("x"))
    want, old = scan.permutation_threshold(g, phenotype(spark, sf), 60), (scan.MOST_BYTES, scan.TASK)
    scan.MOST_BYTES, scan.TASK = 8 * 10 * 7, 500
    try:
        assert abs(scan.permutation_threshold(g, phenotype(spark, sf), 60) - want) < 1e-12
    finally:
        scan.MOST_BYTES, scan.TASK = old


def test_ancestors_at_several_distances(spark):
    """4 is above 7 as a parent and as a grandparent, and counts once; no generation is compared with all before it."""
    from loomgeno.operators import joins

    ped = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (4, 1, 2), (5, 4, 1), (7, 5, 4)], "member long, mother long, father long")
    found = joins.ancestors(ped, ped.select("member"))
    want = {1: {1}, 2: {2}, 4: {1, 2, 4}, 5: {1, 2, 4, 5}, 7: {1, 2, 4, 5, 7}}
    assert sorted(map(tuple, found.collect())) == sorted((m, a) for m, x in want.items() for a in x)
    assert "LeftAnti" not in found._jdf.queryExecution().toString()
    assert {r.member: r.generation for r in joins.generations(ped).collect()} == {1: 0, 2: 0, 4: 1, 5: 2, 7: 3}


def _brute(cells, least_n):
    """(m1, m2, nine counts) of pairs of markers that share enough individuals."""
    of = {}
    for m, i, g in cells:
        of.setdefault(int(m), {})[int(i)] = int(g)
    out = []
    for a in sorted(of):
        for b in sorted(of):
            both = of[a].keys() & of[b].keys()
            if a < b and len(both) >= least_n:
                c = [0] * 9
                for i in both:
                    c[of[a][i] * 3 + of[b][i]] += 1
                out.append((a, b, *c))
    return out


def _some_cells(markers, people, n, copies=1, seed=1):
    """Cells (marker, ind, g), no two alike in marker and ind; every third marker is a near copy of the one before."""
    rng = np.random.default_rng(seed)
    cells = {}
    for m in range(markers):
        if m % 3 == 2:
            for i, g in list(cells[m - 1].items()):
                cells.setdefault(m, {})[i] = g if rng.random() < 0.95 else (g + 1) % 3
        else:
            cells[m] = {int(i): int(rng.integers(3)) for i in rng.choice(people, n, replace=False)}
    return np.array([(m + k * markers, i + k * people, g) for k in range(copies) for m in cells for i, g in cells[m].items()])


def test_shared_cells_are_counted_alike_in_three_ways(monkeypatch):
    cells = _some_cells(60, 40, 20)
    m, i, g = cells[np.argsort(cells[:, 0], kind="stable")].T
    names = [f"n{k}" for k in range(9)]

    def counted(least_n, same=0, band=None, cut=30):
        def stat(c):
            c = c.reshape(9, -1)
            return dict(zip(names, c)), c[[0, 4, 8]].sum(axis=0) >= same

        own = pairs.Cells(*(x[m < cut] for x in (m, i, g)), same)
        met = [own.meet(*(x[s] for x in (m, i, g)), stat, names, band, least_n) for s in (m < cut, m >= cut)]
        return sorted(tuple(r.values()) for tables in met for t in tables for r in t.to_pylist())

    want = {n: [r for r in _brute(cells, n) if r[0] < 30] for n in (1, 12)}
    assert 0 < len(want[12]) < len(want[1])
    for sparse in (0, 1 << 30):
        for step in (1 << 21, 50):
            monkeypatch.setattr(pairs, "SPARSE", sparse)
            monkeypatch.setattr(pairs, "STEP", step)
            monkeypatch.setattr(pairs, "BUCKETS", 1 << 20 if step > 50 else 64)
            for n in (1, 12):
                assert counted(n) == want[n]
                assert counted(n, band=4) == [r for r in want[n] if r[1] - r[0] <= 4]
                alike = [r for r in want[n] if r[2] + r[6] + r[10] >= 8]
                assert counted(n, 8) == alike and alike


def test_duplicates_of_many_markers_are_all_pairs(spark):
    """Where few cells are filled, over many ranges, as by counting all pairs."""
    cells = _some_cells(45, 30, 15, copies=6)
    g = spark.createDataFrame([(int(m) * 10**12 - 7, int(i) - 3, ("11", "12", "22")[x]) for m, i, x in cells], "marker long, ind long, gt string")
    seen = np.bincount(cells[:, 0])
    for least, share, most in ((8, 0.3, 0.1), (10, 0.9, 0.3), (6, 0.0, 1.0)):
        want = [(a * 10**12 - 7, b * 10**12 - 7, sum(c), sum(c) - c[0] - c[4] - c[8]) for a, b, *c in _brute(cells, least) if sum(c) >= share * max(seen[a], seen[b])]
        want = [r for r in want if r[3] <= most * r[2]]
        for block in (None, 7, 500):
            assert sorted(map(tuple, pairs.duplicate_markers(g, least, share, most_differ=most, block=block).collect())) == want and len(want) > 50


def test_pairs_that_share_nothing_take_no_room(monkeypatch):
    """Tables of counts grow with shared cells, not with pairs of markers."""
    n, tables = 20_000, []
    counted = np.bincount

    def bincount(x, minlength=0, **k):
        tables.append(minlength)
        assert sum(tables) < 50 * n + (1 << 23)
        return counted(x, minlength=minlength, **k)

    monkeypatch.setattr(pairs.np, "bincount", bincount)
    for least_n in (1, 2):
        marker, ind = np.repeat(np.arange(n), least_n), np.repeat(np.arange(n) // 2, least_n) * least_n + np.tile(np.arange(least_n), n)
        own = pairs.Cells(marker, ind, np.ones(n * least_n, dtype=np.int8))
        found = [t.num_rows for t in own.meet(marker, ind, np.ones(n * least_n, dtype=np.int8), lambda c: ({"n": c.sum(axis=(0, 1))}, np.ones(c.shape[2], dtype=bool)), ["n"], None, least_n)]
        assert sum(found) == n // 2
