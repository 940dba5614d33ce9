"""The n-gram join with other shingles and similarities than those of op10."""

import itertools
import random

from veridex.llm import ngram_join

from .helpers import frame, prose
from .test_pairs import families


def components(rows, size, percent):
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_five_words_at_80(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 5)
    base = prose(77, 200, [f"w{i}" for i in range(5000)]).split()
    edited = [f"edit{i}" if i in (30, 70, 110, 150) else w for i, w in enumerate(base)]  # 0.815 with five words, 0.886 with three
    rows = families() + [(i, t, "en", "s0", 0, 0, "", "", "") for i, t in ((1, " ".join(base)), (2, " ".join(edited)), (3, "one two three four"), (4, "One two three four"), (5, None))]
    want = components(rows, 5, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame(spark, rows), 5, 80).collect()}
    assert got == want and want[2][1] == 1 and want[4][1] == 3
    assert components(rows, 3, 90)[2][1] == 2


def test_linked_sets_share_enough_of_what_is_kept():
    """Sets just similar enough, their common shingles as late in the order as can be or anywhere."""
    rnd = random.Random(6)
    for percent in (80, 90, 100):
        for n in [*range(1, 120), 333, 1000]:
            for m in sorted({n, -(-percent * n // 100), rnd.randrange(-(-percent * n // 100), n + 1)}):
                both = ngram_join.needed(n, m, percent)
                if both > m:
                    continue
                for late in (True, False):
                    order = list(range(n + m - both))
                    if not late:
                        rnd.shuffle(order)
                    a, b, common = order[: n - both], order[n - both : n + m - 2 * both], order[n + m - 2 * both :]
                    x, y = sorted(a + common)[: ngram_join.kept(n, percent)], sorted(b + common)[: ngram_join.kept(m, percent)]
                    assert len(set(x) & set(y)) >= max(ngram_join.least_shared(n, percent), ngram_join.least_shared(m, percent)), (percent, n, m)
