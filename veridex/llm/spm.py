"""SentencePiece encoding and decoding by a batched Viterbi recursion in numpy.

A text is cut where no piece can cross (before a run of space marks), and its distinct segments of equal length advance
together, one end position at a time. All substrings up to the longest piece are hashed at once from prefix hashes and
probed in sorted arrays of piece hashes, one for each length. At each position a vectorised maximum over the piece
lengths stores the backpointer.

For a unigram model the maximum is over summed piece scores. For a merge (BPE) model, whose scores only order merges, a
path scores 0 if it is the merge result of its prefix and minus infinity if not: a sequence of pieces is the merge result
exactly if each piece merges to itself and each two neighbours stay two pieces when merged together, so a candidate is
scored by a table of neighbours that is filled as pairs turn up. Both give the library's own ids.

Characters without a piece become byte pieces, or the unknown piece where the model has none. Empty and null texts have
no ids. Repeated rows are encoded each, texts of any length are encoded whole, an empty table gives an empty result, and
extra columns are kept by ``encode``.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

MARK = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
MEMO = 300_000
#: Slots of the table of neighbours, a power of two; a pair that meets a taken slot replaces it.
PAIRS = 1 << 22
UNIGRAM = 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A SentencePiece model file, or its bytes, as sorted hash tables."""

    def __init__(self, model: str | bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        if isinstance(model, str):
            with open(model, "rb") as f:
                model = f.read()
        proto.ParseFromString(model)
        spec, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are read")
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.unigram = proto.trainer_spec.model_type == UNIGRAM
        self.names = [p.piece for p in proto.pieces]
        self.size = len(self.names)
        self.score = np.array([p.score for p in proto.pieces])
        self.byte_ids = np.full(256, -1, np.int64)
        self.unk, self.raw, usable = 0, [], {}
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:-1], 16)] = i
                self.raw.append(bytes([int(p.piece[3:-1], 16)]))
            elif p.type == kinds.CONTROL:
                self.raw.append(b"")
            elif p.type == kinds.UNKNOWN:
                self.unk = i
                self.raw.append(" ⁇ ".encode())
            else:
                usable[p.piece] = i
                self.raw.append(p.piece.replace(MARK, " ").encode())
        self.ids = usable
        self.fallback = bool((self.byte_ids >= 0).all())
        self.longest = max(map(len, usable), default=1)
        self.powers = np.ones(self.longest + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, self.longest + 1):
                self.powers[k] = self.powers[k - 1] * BASE
        self.crossing = any(MARK in x.lstrip(MARK) for x in usable)
        self.segments = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.traces: dict[str, list[tuple[float, str, str]]] = {}
        self.pair_key = np.full(PAIRS, -1, np.int64)
        self.pair_stays = np.zeros(PAIRS, bool)
        whole = usable if self.unigram else {x: i for x, i in usable.items() if self.merge(x) == [x]}
        self.tables = self.keyed(whole)
        low = min((self.score[i] for i in usable.values()), default=0.0)
        self.unk_score = low - 10.0
        # ids as int32 bytes, by segment less its first space mark; what the older one has moves to the newer one when met
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        lengths = np.array([len(x) for x in self.raw])
        self.raw_ends = np.concatenate(([0], np.cumsum(lengths)))
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)

    def keyed(self, pieces: dict[str, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length, sorted hashes of the pieces, their ids and their characters."""
        tables = []
        for n in range(1, self.longest + 1):
            own = [(x, i) for x, i in pieces.items() if len(x) == n]
            codes = np.array([[ord(c) for c in x] for x, _ in own], np.uint64).reshape(len(own), n)
            keys = self.hashes(codes)[:, -1] if own else np.zeros(0, np.uint64)
            order = np.argsort(keys)
            if (np.diff(keys[order].astype(object)) == 0).any():
                raise ValueError("two pieces share a hash")
            tables.append((keys[order], np.array([i for _, i in own], np.int64)[order], codes[order].astype(np.uint32)))
        return tables

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Polynomial hashes of all prefixes, (n, length)."""
        out = np.zeros(codes.shape, np.uint64)
        h = np.zeros(len(codes), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(codes.shape[1]):
                h = h * BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
                out[:, j] = h
        return out

    def found(self, words: list[str]) -> np.ndarray:
        """For words of one length: ids[word, end, k] of the piece of k + 1 characters ending there, or -1."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, length)
        upto = np.zeros((n, length + 1), np.uint64)
        upto[:, 1:] = self.hashes(codes)
        out = np.full((n, length, min(self.longest, length)), -1, np.int64)
        for k in range(1, out.shape[2] + 1):
            keys, ids, spelt = self.tables[k - 1]
            if not len(keys):
                continue
            with np.errstate(over="ignore"):
                h = upto[:, k:] - upto[:, :-k] * self.powers[k]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            w, begin = np.nonzero(keys[at] == h)
            hit = at[w, begin]
            # equal hashes only propose a piece: its characters decide
            same = np.ones(len(w), bool)
            for c in range(k):
                same &= codes[w, begin + c] == spelt[hit, c]
            out[w[same], begin[same] + k - 1, k - 1] = ids[hit[same]]
        return out

    def merge(self, text: str) -> list[str]:
        """Plain merging of a short string: the best-scored adjacent pair first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.score[k] > best):
                    best, at = self.score[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def trace(self, piece: str) -> list[tuple[float, str, str]]:
        """The states of merging a piece alone: score of the next merge, first part, last part."""
        if (got := self.traces.get(piece)) is None:
            parts, got = list(piece), []
            while True:
                best, at = float("-inf"), -1
                for i in range(len(parts) - 1):
                    k = self.ids.get(parts[i] + parts[i + 1])
                    if k is not None and self.score[k] > best:
                        best, at = float(self.score[k]), i
                got.append((best, parts[0], parts[-1]))
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.traces[piece] = got
        return got

    def two(self, a: str, b: str) -> bool:
        """Whether the merges of a and of b finish before any merge across: both run by score, the left one first of equals."""
        left, right, i, j = self.trace(a), self.trace(b), 0, 0
        ids, score = self.ids, self.score
        while True:
            x, y = left[i], right[j]
            k = ids.get(x[2] + y[1])
            if k is not None and score[k] > x[0] and score[k] >= y[0]:
                return False
            if x[0] >= y[0] and i + 1 < len(left):
                i += 1
            elif j + 1 < len(right):
                j += 1
            elif i + 1 < len(left):
                i += 1
            else:
                return True

    def stay(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether two neighbouring pieces stay two when merged, by the table of neighbours."""
        keys = before * self.size + after
        with np.errstate(over="ignore"):
            slot = ((keys.astype(np.uint64) * BASE) >> np.uint64(42)).astype(np.int64)
        out, miss = self.pair_stays[slot], np.flatnonzero(self.pair_key[slot] != keys)
        if len(miss):
            new, first, back = np.unique(keys[miss], return_index=True, return_inverse=True)
            names = self.names
            got = np.array([self.two(names[k // self.size], names[k % self.size]) for k in new.tolist()], bool)
            out[miss] = got[back]
            at = slot[miss][first]
            self.pair_key[at], self.pair_stays[at] = new, got
            # of new pairs that share a slot the last one written stays, so the flag has to be that one's
            held = self.pair_key[at]
            self.pair_stays[at] = got[np.searchsorted(new, held)]
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words of one length, as int32 bytes."""
        ids = self.found(words)
        n, length, most = ids.shape
        step = np.ones((n, length + 1), np.int64)
        last = np.full((n, length + 1), -1, np.int64)
        row = np.arange(n)
        best = np.full((n, length + 1), -np.inf if self.unigram else 0.0)
        best[:, 0] = 0
        for j in range(1, length + 1):
            k = min(j, most)
            cand = ids[:, j - 1, :k]
            if self.unigram:
                gain = np.where(cand >= 0, self.score[cand], -np.inf)
                gain[:, 0] = np.where(cand[:, 0] >= 0, gain[:, 0], self.unk_score)
                total = best[:, j - k : j][:, ::-1] + gain
                pick = k - 1 - np.argmax(total[:, ::-1], axis=1)  # of equals, the longest last piece
                best[:, j] = total[row, pick]
            else:
                score = np.full((n, k), -np.inf)  # 0 for merge results
                score[:, 0] = np.where(cand[:, 0] < 0, 0.0, -np.inf)
                w, at = np.nonzero(cand >= 0)
                before, after = last[w, j - 1 - at], cand[w, at]
                fine = before < 0
                inner = np.flatnonzero(~fine)
                fine[inner] = self.stay(before[inner], after[inner])
                score[w[fine], at[fine]] = 0.0
                pick = np.argmax(score, axis=1)
            step[:, j], last[:, j] = pick + 1, cand[row, pick]
        j, columns = np.full(n, length), []
        while (j > 0).any():
            columns.append(np.where(j > 0, last[row, j], -2))
            odd = np.flatnonzero((j > 0) & (columns[-1] == -1))
            columns[-1][odd] = -3 - (j[odd] - 1)  # a character without a piece, by its place
            j = np.where(j > 0, j - step[row, j], 0)
        got = np.stack(columns[::-1], axis=1).astype(np.int32)
        start = (got == -2).sum(axis=1)  # shorter ones are filled up on the left
        raw, width = got.tobytes(), 4 * got.shape[1]
        out = [raw[i * width + 4 * s : (i + 1) * width] for i, s in enumerate(start.tolist())]
        for i in np.flatnonzero((got < -2).any(axis=1)).tolist():
            w, row = words[i], got[i, start[i] :].tolist()
            out[i] = np.array([y for x in row for y in ((x,) if x >= 0 else self.char_ids(w[-3 - x]))], np.int32).tobytes()
        return out

    def char_ids(self, c: str) -> list[int]:
        return self.byte_ids[list(c.encode("utf-8", "surrogatepass"))].tolist() if self.fallback else [self.unk]

    def learn(self, missing: set[str], head: str) -> dict[str, bytes]:
        by_length: dict[int, list[str]] = {}
        for w in missing:
            by_length.setdefault(len(w), []).append(w)
        got: dict[str, bytes] = {}
        for length, words in by_length.items():
            share = max(1, 2_000_000 // ((length + 1) * self.longest))
            for i in range(0, len(words), share):
                got.update(zip(words[i : i + share], self.viterbi([head + w for w in words[i : i + share]])))
        return got

    def cut(self, text: str | None) -> tuple[str | None, list[str]]:
        """A first segment without a space mark, or None, and the others less their first mark."""
        if not text:
            return None, []
        if self.crossing:
            return self.prefix + text.replace(" ", MARK), []
        if self.prefix and MARK not in text:
            words = text.split(" ")
            if "" not in words:
                return None, words
        got = self.segments(self.prefix + text.replace(" ", MARK))
        return (None, [w[1:] for w in got]) if got[0][0] == MARK else (got[0], [w[1:] for w in got[1:]])

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        if len(self.memo) > MEMO:
            self.older, self.memo = self.memo, {}
        memo, older = self.memo, self.older
        missing = set().union(*(words for _, words in cut)).difference(memo)
        again = missing.intersection(older)
        for w in again:
            memo[w] = older[w]
        memo.update(self.learn(missing - again, MARK))
        bare = self.learn({w for w, _ in cut if w is not None}, "")
        return [b"".join(map(memo.__getitem__, words)) if w is None else bare[w] + b"".join(map(memo.__getitem__, words)) for w, words in cut]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_bytes(texts)]

    def encode_arrow(self, texts: list[str | None]) -> pa.Array:
        got = self.encode_bytes(texts)
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in got]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))

    def decode(self, ids: list[int]) -> str:
        s = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return s[1:] if self.prefix and s[:1] == " " else s

    def decode_arrow(self, lists: pa.Array) -> list[str]:
        """All bytes of all ids in one gather."""
        if not len(lists):
            return []
        lists = lists.fill_null([]) if lists.null_count else lists
        ids = np.asarray(lists.flatten(), np.int64)
        n = self.raw_ends[ids + 1] - self.raw_ends[ids]
        ends = np.concatenate(([0], np.cumsum(n)))
        place = np.arange(ends[-1]) + np.repeat(self.raw_ends[ids] - ends[:-1], n)
        raw = self.raw_bytes[place].tobytes()
        counts = np.asarray(lists.value_lengths(), np.int64)
        cuts = ends[np.concatenate(([0], np.cumsum(counts)))].tolist()
        skip = b" " if self.prefix else None
        return [raw[a + (raw[a : a + 1] == skip and a < b) : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=2)
def pieces(model: str | bytes) -> Pieces:
    return Pieces(model)


def encode(docs: DataFrame, model: str | None = None, column: str = "text", to: str = "ids") -> DataFrame:
    """All rows and columns, with the ids added (a column of that name is replaced)."""
    docs = docs.drop(to)
    model = model or default_model()

    def run(batches):
        p = pieces(model)
        for b in batches:
            yield b.append_column(to, p.encode_arrow(b.column(column).to_pylist()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.selectExpr("*", f"cast(null as array<int>) as `{to}`").schema)


def decode(encoded: DataFrame, model: str | None = None, column: str = "ids", to: str = "decoded") -> DataFrame:
    """All rows and columns, with the decoded text added (a column of that name is replaced); null ids are empty."""
    encoded = encoded.drop(to)
    model = model or default_model()

    def run(batches):
        p = pieces(model)
        for b in batches:
            yield b.append_column(to, pa.array(p.decode_arrow(b.column(column)), pa.string()))

    small_batches(encoded.sparkSession)
    return encoded.mapInArrow(run, encoded.selectExpr("*", f"'' as `{to}`").schema)
