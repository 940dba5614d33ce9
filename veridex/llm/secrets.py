"""Secret scans: fixed patterns, and assignments found by lexing.

The lexer reads source and configuration syntax (``name = "x"``, ``name: x``, ``"name": "x"``, ``name := x``,
``name => x``, ``name[i] = x``, ``name: type = x``, ``name = name = x``, ``<name>x</name>``) into (name, literal) pairs in
the order of the text. Strings may be quoted by ``"``, ``'`` or a backtick, hold escapes, or stand in triple quotes over lines.
Constants are propagated: a bare identifier on the right is replaced by the literal it was last given, a sum of literals
and known names is joined (a plus sign within a bare literal joins only known names or quotes), and of a call the
strings and known names among the arguments are taken, never the function's name. What a function assigns is known up to
its end only, which is the next line that is indented no deeper than its header. A pair scores by how sensitive its name is and how random its literal looks; from ``THRESHOLD``
on, the place of each of the literal's pieces in the text is reported as a span of kind ``pair``. For a propagated name
that is the place where the literal was written.

Defined cases: null text is empty and has no spans; repeated rows are scanned each; texts of any length are scanned whole;
an empty table gives an empty result; extra columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from itertools import chain
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("assign", "access", "hex", "pair")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so asking for 24 at once finds the same as dropping shorter runs later.
HEX = re.compile(r"[0-9a-f]{24,}")
#: A name, maybe subscripted or quoted, and its operator. A value's first character follows.
HEAD = re.compile(
    r"""(?<![A-Za-z0-9_.\-])(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+(?:\[[^\[\]\n]*+\])*+)["']?\]?[ \t]*+(?P<op>:=|=>|==|=|:)[ \t]*+(?=["'`&*A-Za-z0-9+/_.=\-])"""
)
QUOTED = r"""\"\"\"(?P<{0}3>(?:[^"\\]|\\.|"(?!""))*+)\"\"\"|'''(?P<{0}4>(?:[^'\\]|\\.|'(?!''))*+)'''|"(?P<{0}1>(?:[^"\\\n]|\\.)*+)"|'(?P<{0}2>(?:[^'\\\n]|\\.)*+)'|`(?P<{0}5>(?:[^`\\]|\\.)*+)`"""
PIECE = re.compile(QUOTED.format("q") + r"""|(?P<bare>[A-Za-z0-9+/_.=\-]+)""", re.DOTALL)
LATER = re.compile(r"""[ \t]*\+[ \t]*(?:""" + QUOTED.format("q") + r"""|(?P<bare>[A-Za-z_][A-Za-z0-9_]*))""", re.DOTALL)
#: Inside the brackets of a call, on its line: a string, a name, or a bracket.
ARGUMENT = re.compile(QUOTED.format("q") + r"""|(?P<bare>[A-Za-z_][A-Za-z0-9_.]*+)(?![A-Za-z0-9_.]*[ \t]*\()|(?P<open>\()|(?P<close>\))|(?P<end>\n)""", re.DOTALL)
ELEMENT = re.compile(r"""<([A-Za-z_][A-Za-z0-9_.:\-]*+)(?:[ \t][^<>]*+)?>[ \t\n]*+([^<>]*[^<> \t\n])[ \t\n]*</\1[ \t]*>""")
#: The header line of a function or class.
HEADER = re.compile(r"""^(?P<in>[ \t]*+)(?:(?:export|default|public|private|protected|static|async|pub|final)[ \t]++)*+(?:def|function|func|fn|class)[ \t]++[A-Za-z_(]""", re.MULTILINE)
LINE = re.compile(r"""^(?P<in>[ \t]*+)[^ \t\n]""", re.MULTILINE)
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
#: Where a value may stand: a name or an annotation with an operator and a value of its own.
TYPE = r"""[&*]*(?:'[a-z]+[ \t]+)?[A-Za-z_][A-Za-z0-9_.\-]*+(?:\[[^\[\]\n]*+(?:\[[^\[\]\n]*+\][^\[\]\n]*+)*+\])?+"""
INNER = re.compile(rf"""{TYPE}(?:[ \t]*\|[ \t]*{TYPE})*+["']?[ \t]*+(?P<op>:=|=>|=(?!=)|:)[ \t]*+(?=["'&*A-Za-z0-9+/_.\-])""")
#: Sensitive parts of names and their weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0,
    "credential": 0.9, "private_key": 1.0, "privatekey": 1.0, "access_key": 1.0, "accesskey": 1.0, "auth": 0.5, "bearer": 0.8, "signing_key": 1.0,
    "client_secret": 1.0, "connection_string": 0.7,
}
NAME = re.compile("|".join(sorted(SENSITIVE, key=len, reverse=True)), re.IGNORECASE | re.ASCII)
#: Values that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?i)^(true|false|null|none|nil|undefined|example|changeme|placeholder|redacted|x+|\*+|your[_-].*|<.*>|\$\{.*\}|\.\.\.)$")
THRESHOLD = 1.6


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in Counter(s).values()) if n else 0.0


def name_weight(name: str) -> float:
    return max((SENSITIVE[m.lower()] for m in NAME.findall(name)), default=0.0)


def literal_weight(value: str) -> float:
    """0 for what cannot be a secret, up to 1.5 for long random strings over mixed kinds of characters."""
    if len(value) < 6 or PLACEHOLDER.match(value):
        return 0.0
    kinds = bool(re.search("[a-z]", value)) + bool(re.search("[A-Z]", value)) + bool(re.search("[0-9]", value)) + bool(re.search(r"[^A-Za-z0-9]", value))
    return min(1.5, 0.25 * (kinds - 1) + 0.25 * min(entropy(value), 4.0))


def _text(m: re.Match) -> tuple[str, int] | None:
    """What a quoted part holds, and where it begins; None for a bare part."""
    k = m.lastgroup
    return (m[k], m.start(k)) if k and k.startswith("q") else None


def _arguments(text: str, at: int, known) -> tuple[int, list[tuple[str, tuple]]]:
    """The end of a call whose bracket opens at ``at``, no later than its line's, and the strings and known names in it."""
    out, depth, end = [], 0, at
    for m in ARGUMENT.finditer(text, at):
        end = m.end()
        if got := _text(m):
            if got[0]:
                out.append((got[0], ((got[1], got[1] + len(got[0])),)))
        elif m["bare"]:
            if m["bare"] in known:
                out.append(known[m["bare"]])
        elif m["open"]:
            depth += 1
        elif m["close"]:
            depth -= 1
            if depth <= 0:
                break
        else:
            break
    return end, out


def _value(text: str, at: int, known) -> tuple[int, str, tuple, int] | None:
    """End, value, places of its pieces, and the end of a bare first piece (else 0); None if there is no literal."""
    first = PIECE.match(text, at)
    if not first:
        return None
    end, run = first.end(), 0
    pieces: list[tuple[str, tuple]] = []

    def add(piece: str, s: int) -> None:
        if piece in known:
            pieces.append(known[piece])
        elif piece:
            pieces.append((piece, ((s, s + len(piece)),)))

    unsure = False
    if got := _text(first):
        if got[0]:
            pieces.append((got[0], ((got[1], got[1] + len(got[0])),)))
    elif text[end : end + 1] == "(" and IDENTIFIER.fullmatch(first["bare"]):
        end, pieces = _arguments(text, end, known)
    else:
        bare, run = first["bare"], end
        if bare.endswith("+") and (LATER.match(text, end - 1) and (text[end:end + 64].lstrip(" \t")[:1] in ('"', "'", "`") or bare[:-1] in known)):
            bare, end = bare[:-1], end - 1
        if "+" in bare and any(x in known for x in bare.split("+")):
            s = at
            for x in bare.split("+"):
                add(x, s)
                s += len(x) + 1
        else:
            unsure = bare not in known and IDENTIFIER.fullmatch(bare) is not None
            add(bare, at)
    joined = False
    while p := LATER.match(text, end):
        end, joined = p.end(), True
        if got := _text(p):
            if got[0]:
                pieces.append((got[0], ((got[1], got[1] + len(got[0])),)))
        elif p["bare"] in known:
            pieces.append(known[p["bare"]])
    if joined and unsure:  # a name without a known literal
        pieces = pieces[1:]
    places = tuple(dict.fromkeys(x for _, where in pieces for x in where))
    return end, "".join(v for v, _ in pieces), places, run


def scopes(text: str) -> list[tuple[int, int]]:
    """(start, end) of functions and classes, by the indentation of their lines."""
    headers = {m.start(): len(m["in"]) for m in HEADER.finditer(text)}
    if not headers:
        return []
    out, open_ = [], []
    for m in LINE.finditer(text):
        deep = len(m["in"])
        while open_ and deep <= open_[-1][1]:
            out.append((open_.pop()[0], m.start()))
        if m.start() in headers:
            open_.append((m.start(), deep))
    return sorted([*out, *((s, len(text)) for s, _ in open_)])


class Known:
    """Names with their literals, innermost scope first. Moves on with the text."""

    def __init__(self, text: str):
        self.coming, self.levels = scopes(text)[::-1], [(-1, {})]

    def move(self, at: int) -> None:
        while self.coming and self.coming[-1][0] <= at:
            s, e = self.coming.pop()
            while len(self.levels) > 1 and self.levels[-1][0] <= s:
                self.levels.pop()
            self.levels.append((e, {}))
        while len(self.levels) > 1 and self.levels[-1][0] <= at:
            self.levels.pop()

    def __contains__(self, name: str) -> bool:
        return any(name in names for _, names in self.levels)

    def __getitem__(self, name: str):
        return next(names[name] for _, names in reversed(self.levels) if name in names)

    def __setitem__(self, name: str, value) -> None:
        self.levels[-1][1][name] = value


def pairs(text: str):
    """(name, value, places) of every assignment, constants propagated; the places bound the pieces of the literal as written."""
    known = Known(text)
    at = run = 0
    waiting: list[str] = []  # names before the one whose value follows: of annotations and chains
    target = 0
    while m := HEAD.search(text, at):
        start = at = m.end()
        known.move(m.start())
        if start > target:
            waiting = []
        if m["op"] == "==":
            continue
        inner = INNER.match(text, start)
        names = [m["name"]] if inner or start != target else [*waiting, m["name"]]
        if inner:
            # the value is itself a name with a value, unless they are one run of characters: then it is taken both ways
            whole = start >= run and text[start] not in "&*"
            if inner["op"] in ("=", ":="):
                if start != target:
                    waiting = []
                waiting.append(m["name"])
                target = inner.end()
                whole = whole and (bare := PIECE.match(text, start)) is not None and bare.end() > target
            if not whole:
                continue
        got = _value(text, start, known)
        if not got:
            continue
        end, value, places, bare_end = got
        run = max(run, bare_end)
        if not inner:
            at = max(end, start)
            waiting = []
        if places:
            for name in names:
                known[name] = (value, places)
                yield name, value, places


def elements(text: str):
    """(name, value, places) of XML elements that hold text only."""
    if "</" in text:
        for m in ELEMENT.finditer(text):
            yield m[1], m[2], ((m.start(2), m.end(2)),)


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index in KINDS, end) of all spans, sorted. Places are code points, ends exclusive."""
    if not text:
        return []
    out = {(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6}
    out |= {(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20}
    out |= {(m.start(), 2, m.end()) for m in HEX.finditer(text)}
    if "=" in text or ":" in text or "</" in text:
        if NAME.search(text):
            weights: dict[str, float] = {}
            for name, value, places in chain(pairs(text), elements(text)):
                w = name_weight(name)
                if w:
                    if value not in weights:
                        weights[value] = literal_weight(value)
                    if w + weights[value] >= THRESHOLD:
                        out.update((s, 3, e) for s, e in places)
    return sorted(out)


def say(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _row(text):
    spans = find_spans(text)
    base = [x for x in spans if x[1] < 3]
    n = Counter(k for _, k, _ in spans)
    return n[0], n[1], n[2], n[3], hashlib.sha256(say(base).encode()).hexdigest(), say(spans)


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, n_pair long, base_sha256 string, spans string"


def _scan(batches):
    for b in batches:
        rows = list(map(_row, b.column("text").to_pylist()))
        cols = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[x.split()[0] for x in SCANNED.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, SCANNED)


def redacted(text: str | None) -> str | None:
    """The text with every span replaced by ``[kind]``; of overlapping spans, the union under the first one's kind."""
    spans = find_spans(text)
    if not spans:
        return text
    merged: list[list[int]] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    out, at = [], 0
    for s, k, e in merged:
        out += [text[at:s], f"[{KINDS[k]}]"]
        at = e
    return "".join([*out, text[at:]])


def _redact(batches):
    for b in batches:
        i = b.schema.get_field_index("text")
        yield b.set_column(i, "text", pa.array([redacted(t) for t in b.column("text").to_pylist()], pa.string()))


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, secrets in ``text`` replaced."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_redact, docs.schema)
