"""Searches and joins against brute force."""

import itertools
import random

import numpy as np
import pytest

from veridex.llm import ann, ngram_join

from .helpers import frame, hard_rows, prose


def brute_components(rows):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(x for x in sets if x is not None), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= 90 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families():
    """Copies with a few edits, chains whose ends do not link, and a passage that many documents share."""
    rnd = random.Random(4)
    passage, out = prose(900, 60), []
    for f in range(6):
        base = prose(1000 + f, 120).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = f"edit{rnd.randrange(10**6)}"
            out.append(" ".join(w))
    chain = prose(2000, 150).split()
    for k in range(10):
        out.append(" ".join([f"c{k}x{j}" for j in range(4 * k)] + chain[4 * k :]))
    out += [prose(3000 + i, 90) + " " + passage for i in range(40)] + [passage + f" end{i}" for i in range(10)]
    rnd.shuffle(out)
    return [(5000 + i, t, "en", "s0", 0, 0, "", "", "") for i, t in enumerate(out)]


@pytest.mark.parametrize("make", [hard_rows, families])
def test_ngram_join(spark, make, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    rows = make()
    got = ngram_join.join(frame(spark, rows)).collect()
    want = brute_components(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (want[r["doc_id"]][0], want[r["doc_id"]][1]), r
    if make is hard_rows:
        kept = ngram_join.one_of_each(frame(spark, rows)).collect()
        assert sorted(str(r["doc_id"]) for r in kept) == sorted({str(i) for i, (_, c) in want.items() if c == i})


def test_ngram_join_empty(spark):
    assert ngram_join.join(frame(spark, [])).collect() == []


def test_divide_skip_counts():
    rnd = random.Random(3)
    sets = [np.unique(np.array([rnd.randrange(60) for _ in range(rnd.randrange(20, 60))], np.int64)) for _ in range(40)]
    sets += [s[rnd.randrange(3) :] for s in sets[:20]]
    index = ngram_join.Index(sets)
    for q, s in enumerate(sets):
        want = [i for i, t in enumerate(sets) if i != q and 100 * len(np.intersect1d(s, t)) >= 90 * len(np.union1d(s, t))]
        assert sorted(index.search(q)) == want


def vectors(n=1500, dim=16):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8, dim))[rng.integers(0, 8, n)] + 0.7 * rng.normal(size=(n, dim))
    return x * rng.uniform(0.5, 1.5, size=(n, 1))


def test_nearest_neighbours(spark):
    x = vectors()
    x[700:760] = x[699]  # a group of equal vectors, larger than k
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, []), (5040, [0.0] * 16), (5060, [float("nan")] * 16), (5080, [None] * 16), (5100, [float("inf")] * 16), (5120, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(1500) if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = sorted(range(len(x)), key=lambda i: (-round(s[i], 9), i))[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in found)
        assert all((round(-a, 9), i) <= (round(-b, 9), j) for (_, i, a), (_, j, b) in zip(found, found[1:]))
        hits += len({i for _, i, _ in found} & set(want))
    assert hits / (20 * len(got)) >= 0.9
    for q in got:  # of equal vectors, the smallest ids come first and none is left out
        twins = [i for _, i, _ in got[q] if 699 <= i < 760]
        assert twins == [i for i in range(699, 760) if i != q][: len(twins)]
    assert ann.search(df.where("vec_id < 0"), df.where("vec_id < 0")).collect() == []
    few = ann.search(df.where("vec_id < 5"), df.where("vec_id = 0")).collect()
    assert len(few) == 4


def test_nearest_neighbours_all_have_k(spark):
    """Most vectors in tight groups of near copies, the rest far apart: the sparse ones get their k rows too."""
    rng = np.random.default_rng(5)
    tight = np.repeat(rng.normal(size=(20, 16)), 50, axis=0) + 1e-4 * rng.normal(size=(1000, 16))
    x = np.vstack([tight, 3 * rng.normal(size=(40, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, [1.0, float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in ann.search(df, df.where("vec_id % 10 = 0 or vec_id >= 1000")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in [*range(0, 1000, 10), *range(1000, 1040)]:
        assert [r for r, _ in got[q]] == list(range(1, 21)), q
    for q in range(2000, 2006):  # fewer candidates than k: all of them
        assert {i for _, i in got[q]} == set(range(2000, 2006)) - {q}
    hits = 0
    for q in range(1000, 1040):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({i for _, i in got[q]} & set(np.argsort(-s)[:20].tolist()))
    assert hits >= 0.9 * 800


def test_nearest_neighbours_clash_and_scale(spark):
    """Extra columns with the names that the search uses, large norms and near ties: the same ranks as brute force."""
    rng = np.random.default_rng(9)
    x = 1e9 * (rng.normal(size=(1, 8)) + 1e-8 * rng.normal(size=(300, 8)))
    df = spark.createDataFrame([(i, v.tolist(), "a", 1, 2.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, class_id string, cell int, score double")
    got: dict = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum(len(set(got[q]) & set(sorted((i for i in range(300) if i != q), key=lambda i: (-(x[i] * x[q]).sum(), i))[:20])) for q in got)
    assert len(got) == 15 and hits >= 0.9 * 300


def test_hashing_scans_little_where_data_allow(spark, monkeypatch):
    """Groups far apart: a query meets under a tenth of the vectors and still finds its neighbours."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(100, 16))
    x = np.repeat(centres, 40, axis=0) + 0.02 * rng.normal(size=(4000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = ann.expected(x, 1.0, 20)
    tables = ann.Tables(16, 1.0, near)
    met = np.zeros((100, len(x)), bool)
    for t in range(ann.TABLES):
        own = ann._codes(tables.places(tables.completed(x), t)[0])
        h, rest = tables.places(tables.scaled(x[:100]), t)
        for i, (o, steps) in enumerate(zip(ann._codes(h), tables.probes(rest))):
            with np.errstate(over="ignore"):
                met[i] |= np.isin(own, ann._codes(tables.steps)[steps] + o)
    assert met.mean() < 0.1
    s = x[:100] @ x.T
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([met[i, w].mean() for i, w in enumerate(want)]) >= 0.9


def test_nearest_neighbours_rows_made(spark, monkeypatch):
    """Vectors spread evenly over many cells: what the cells give back does not grow with their number, and all that counts is there."""
    monkeypatch.setattr(ann, "CELL", 16)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    classes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "class_id long, e array<double>").cache()
    tables = ann.Tables(8, 1.0, ann.expected(x, 1.0, 6))
    got: dict = {}
    rows = ann.hashed(classes, classes.where("class_id % 20 = 0"), len(x), lambda dim: tables, 6).collect()
    for r in rows:
        got.setdefault(r["class_id"], {})[r["near_id"]] = r["score"]
    classes.unpersist()
    first, every, met = 3, 0, np.zeros((50, len(x)), bool)
    for t in range(ann.TABLES):
        slots = tables.places(tables.completed(x), t)[0]
        own, cell = ann._codes(slots), ann._codes(slots[:, :first])
        h, rest = tables.places(tables.scaled(x[::20]), t)
        for i, (o, steps) in enumerate(zip(ann._codes(h), tables.probes(rest))):
            with np.errstate(over="ignore"):
                here = np.isin(own, ann._codes(tables.steps)[steps] + o)
            met[i] |= here
            every += np.minimum(np.unique(cell[here], return_counts=True)[1], 6).sum()  # the 6 best of each cell
    for i in range(50):
        s = np.where(met[i], (x * x[20 * i]).sum(axis=1), -np.inf)
        want = sorted(np.flatnonzero(met[i]).tolist(), key=lambda j: (-s[j], j))[:6]
        assert sorted(got[20 * i], key=lambda j: (-got[20 * i][j], j))[:6] == want
    assert len(rows) < every / 3, (len(rows), every)
