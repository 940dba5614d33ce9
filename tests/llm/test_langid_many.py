"""Language id with more languages than the given tables have."""

import random

import numpy as np

from veridex.llm import langid


def words(letters, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 7))) for _ in range(150)]


def test_second_language_among_relatives_of_the_first():
    latin = words("abcdefghij", 0)
    lists = {f"en{k}": latin[: 120 - 4 * k] + words("abcdefghij", k + 1)[: 30 + 4 * k] for k in range(9)} | {"ja": words("あいうえおかきくけこ", 50)}
    rnd, rows = random.Random(1), []
    for lang, known in lists.items():
        n = np.bincount(langid.grams(" ".join(rnd.choice(known) for _ in range(4000))), minlength=langid.BUCKETS)
        rows += [{"lang": lang, "bucket": int(b), "n": int(n[b])} for b in np.flatnonzero(n)]
    model = langid.Model(rows)
    text = " ".join([*(rnd.choice(lists["en0"]) for _ in range(240)), *(rnd.choice(lists["ja"]) for _ in range(160))])
    langs, share, _ = model.mixture(text)
    got = dict(zip(langs, share))
    assert langs[0] == "en0" and abs(got["ja"] - 0.4) < 0.1 and abs(share.sum() - 1) < 1e-6
    assert model.predict(" ".join(rnd.choice(lists["en3"]) for _ in range(300)))[0] == "en3"
