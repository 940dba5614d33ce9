"""Token counts of a byte-level BPE vocabulary, with a shortcut for whole tokens.

Before any text is read, the driver proves by running the merges which vocabulary strings encode alone as one token, once for a
vocabulary, and broadcasts the proven set, which the vocabulary bounds. A text is split at the special strings and then into
pre-tokens; those in the proven set count one each, and only the others are merged (their counts are kept in a bounded memo). Texts of any length are counted whole.

Defined cases: null text is empty and has no tokens; repeated rows are counted each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

LIMIT = 1024
MEMO = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The printable stand-in for every byte, by the rule of byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counts:
    def __init__(self, path: str, whole: frozenset[str] | None = None):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        self.ranks = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.letters = byte_letters()
        self.special = [t["content"] for t in model["added_tokens"]]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.whole = self.prove(model["model"]["vocab"]) if whole is None else whole
        self.memo: dict[str, int] = {}

    def prove(self, vocabulary) -> frozenset[str]:
        """The strings of the vocabulary that encode alone as one token."""
        back = {c: b for b, c in self.letters.items()}
        proven = set()
        for t in vocabulary:
            if t in self.special or not all(c in back for c in t):
                continue
            try:
                s = bytes(back[c] for c in t).decode()
            except UnicodeDecodeError:
                continue
            if self.merged(s) == 1:
                proven.add(s)
        return frozenset(proven)

    def merged(self, s: str) -> int:
        """Tokens after all merges, lowest rank first, leftmost of equal ones; O(n log n) by a heap over a linked list."""
        part = [self.letters[b] for b in s.encode("utf-8", "replace")]
        n = len(part)
        if n < 2:
            return n
        ranks, left, right = self.ranks, list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = n
        while heap:
            r, i = heapq.heappop(heap)
            j = right[i] if part[i] is not None else -1
            if j < 0 or ranks.get((part[i], part[j])) != r:
                continue
            part[i] += part[j]
            part[j] = None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            alive -= 1
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (q := ranks.get((part[a], part[b]))) is not None:
                    heapq.heappush(heap, (q, a))
        return alive

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, texts = 0, [text]
        if self.split_special and any(s in text for s in self.special):
            texts = self.split_special.split(text)
            total = len(texts) - 1
        whole, memo = self.whole, self.memo
        for t in texts:
            for token, n in Counter(self.find(t)).items():
                if token in whole:
                    total += n
                    continue
                if (k := memo.get(token)) is None:
                    k = self.merged(token)
                    if len(token) < 64:
                        if len(memo) >= MEMO:
                            memo.clear()
                        memo[token] = k
                total += n * k
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counts:
    """The counts with their proof, for the driver."""
    return Counts(path)


WORKERS: dict[str, Counts] = {}


def of_worker(path: str, proven) -> Counts:
    """The counts of a worker, which keeps them from task to task; the proof comes from the broadcast."""
    if path not in WORKERS:
        WORKERS[path] = Counts(path, proven.value)
    return WORKERS[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    path = path or default_vocabulary()
    proven = docs.sparkSession.sparkContext.broadcast(counter(path).whole)

    def run(batches):
        c = of_worker(path, proven)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
