"""The schema language: text to definitions, relations, permissions and caveats.

``definition``, ``relation``, ``permission``, ``caveat`` and ``use`` statements. In permissions ``+`` binds tightest, then
``&``, then ``-``; unions and intersections are flattened, exclusions nest to the left. ``a->b`` and ``a.any(b)`` walk
through a relation, ``a.all(b)`` asks all that it leads to.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

ELLIPSIS, WILDCARD = "...", "*"


class SchemaError(ValueError):
    pass


# Expressions of permissions -------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Ref:
    """Another relation or permission of the same object."""

    name: str


@dataclass(frozen=True)
class Arrow:
    relation: str
    target: str
    every: bool = False


@dataclass(frozen=True)
class Nil:
    pass


@dataclass(frozen=True)
class Self:
    """The object itself, as a subject."""


@dataclass(frozen=True)
class SetOp:
    kind: str  # union, intersection, exclusion
    parts: tuple


@dataclass(frozen=True)
class Allowed:
    """A subject type a relation may hold."""

    type: str
    relation: str = ELLIPSIS
    wildcard: bool = False
    caveat: str | None = None
    expiration: bool = False

    def __str__(self):
        s = self.type + (":*" if self.wildcard else "" if self.relation == ELLIPSIS else f"#{self.relation}")
        traits = [x for x in (self.caveat, "expiration" if self.expiration else None) if x]
        return s + (" with " + " and ".join(traits) if traits else "")


@dataclass(frozen=True)
class Member:
    """A relation (``allowed``) or a permission (``expr``) of a definition."""

    name: str
    allowed: tuple[Allowed, ...] = ()
    expr: object = None
    comment: str = ""

    @property
    def is_permission(self) -> bool:
        return self.expr is not None


@dataclass
class Definition:
    name: str
    members: dict[str, Member] = field(default_factory=dict)
    comment: str = ""


@dataclass(frozen=True)
class Caveat:
    name: str
    parameters: tuple[tuple[str, str], ...]
    expression: str
    comment: str = ""


@dataclass
class Schema:
    definitions: dict[str, Definition] = field(default_factory=dict)
    caveats: dict[str, Caveat] = field(default_factory=dict)
    uses: tuple[str, ...] = ()

    def member(self, type_: str, name: str) -> Member | None:
        d = self.definitions.get(type_)
        return d.members.get(name) if d else None


LEX = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<space>\s+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:/[A-Za-z_][A-Za-z0-9_]*)*)|(?P<sign>->|\.\.\.|[{}():|#*+&\-=,.<>;])|(?P<odd>.)",
    re.DOTALL,
)
PATTERN_TYPE = re.compile(r"^([a-z][a-z0-9_]{1,61}[a-z0-9]/)*[a-z][a-z0-9_]{1,62}[a-z0-9]$")
PATTERN_NAME = re.compile(r"^[a-z][a-z0-9_]{1,62}[a-z0-9]$")


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, comments = text, [], []
        at = 0
        while at < len(text):
            m = LEX.match(text, at)
            at = m.end()
            kind = m.lastgroup
            if kind == "comment":
                comments.append(m[0])
            elif kind != "space":
                self.tokens.append((kind, m[0], m.start(), "\n".join(comments)))
                comments = []
        self.tokens.append(("end", "", len(text), ""))
        self.i = 0

    @property
    def now(self) -> str:
        return self.tokens[self.i][1]

    @property
    def comment(self) -> str:
        return self.tokens[self.i][3]

    def fail(self, wanted: str):
        line = self.text.count("\n", 0, self.tokens[self.i][2]) + 1
        raise SchemaError(f"line {line}: expected {wanted}, found {self.now or 'the end'!r}")

    def take(self, sign: str) -> None:
        if self.now != sign:
            self.fail(repr(sign))
        self.i += 1

    def maybe(self, sign: str) -> bool:
        if self.now == sign:
            self.i += 1
            return True
        return False

    def name(self, what: str = "a name") -> str:
        kind, s, _, _ = self.tokens[self.i]
        if kind != "name":
            self.fail(what)
        self.i += 1
        return s

    def braces(self) -> str:
        """The raw text between braces; strings may hold braces."""
        start = at = self.tokens[self.i][2] + 1
        self.take("{")
        depth, quote = 1, ""
        while at < len(self.text):
            c = self.text[at]
            if quote:
                if c == "\\":
                    at += 1
                elif c == quote:
                    quote = ""
            elif c in "\"'":
                quote = c
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if not depth:
                    break
            at += 1
        else:
            self.fail("'}'")
        while self.tokens[self.i][2] <= at and self.tokens[self.i][0] != "end":
            self.i += 1
        return self.text[start:at].strip()


def parse(text: str) -> Schema:
    r, schema, uses = _Reader(text), Schema(), []
    while r.tokens[r.i][0] != "end":
        if r.maybe(";"):
            continue
        comment, word = r.comment, r.name("definition, caveat or use")
        if word == "use":
            uses.append(r.name())
        elif word == "definition":
            d = _definition(r, comment, uses)
            if d.name in schema.definitions or d.name in schema.caveats:
                raise SchemaError(f"{d.name} is defined twice")
            schema.definitions[d.name] = d
        elif word == "caveat":
            name = r.name()
            r.take("(")
            params = []
            while not r.maybe(")"):
                if params:
                    r.take(",")
                params.append((r.name(), _param_type(r)))
            body = r.braces()
            if name in schema.caveats or name in schema.definitions:
                raise SchemaError(f"{name} is defined twice")
            if len({p for p, _ in params}) < len(params):
                raise SchemaError(f"caveat {name} repeats a parameter")
            schema.caveats[name] = Caveat(name, tuple(params), body, comment)
        else:
            r.i -= 1
            r.fail("definition, caveat or use")
    schema.uses = tuple(uses)
    return schema


def _param_type(r: _Reader) -> str:
    t = r.name("a type")
    if r.maybe("<"):
        t += f"<{_param_type(r)}>"
        r.take(">")
    return t


def _definition(r: _Reader, comment: str, uses) -> Definition:
    d = Definition(r.name(), comment=comment)
    r.take("{")
    while not r.maybe("}"):
        if r.maybe(";"):
            continue
        note, word = r.comment, r.name("relation, permission or '}'")
        name = r.name()
        if name in d.members:
            raise SchemaError(f"{d.name}#{name} is defined twice")
        if word == "relation":
            r.take(":")
            allowed = [_allowed(r)]
            while r.maybe("|"):
                allowed.append(_allowed(r))
            d.members[name] = Member(name, allowed=tuple(allowed), comment=note)
        elif word == "permission":
            if r.maybe(":"):  # subject types the author expects; they bind nothing
                _allowed(r)
                while r.maybe("|"):
                    _allowed(r)
            r.take("=")
            d.members[name] = Member(name, expr=_exclusion(r, uses), comment=note)
        else:
            r.i -= 2
            r.fail("relation or permission")
    return d


def _allowed(r: _Reader) -> Allowed:
    type_, relation, wildcard, caveat, expiration = r.name("a type"), ELLIPSIS, False, None, False
    if r.maybe("#"):
        relation = ELLIPSIS if r.maybe(ELLIPSIS) else r.name()
    elif r.maybe(":"):
        r.take("*")
        wildcard = True
    if r.now == "with":
        r.i += 1
        while True:
            trait = r.name("a caveat or expiration")
            if trait == "expiration":
                expiration = True
            elif caveat is None:
                caveat = trait
            else:
                raise SchemaError("one caveat at most for a subject type")
            if r.now != "and":
                break
            r.i += 1
    return Allowed(type_, relation, wildcard, caveat, expiration)


def _flat(kind: str, parts: list):
    if len(parts) == 1:
        return parts[0]
    out: list = []
    for p in parts:
        out += p.parts if isinstance(p, SetOp) and p.kind == kind else [p]
    return SetOp(kind, tuple(out))


def _exclusion(r: _Reader, uses):
    left = _intersection(r, uses)
    while r.maybe("-"):
        left = SetOp("exclusion", (left, _intersection(r, uses)))
    return left


def _intersection(r: _Reader, uses):
    parts = [_union(r, uses)]
    while r.maybe("&"):
        parts.append(_union(r, uses))
    return _flat("intersection", parts)


def _union(r: _Reader, uses):
    parts = [_operand(r, uses)]
    while r.maybe("+"):
        parts.append(_operand(r, uses))
    return _flat("union", parts)


def _operand(r: _Reader, uses):
    if r.maybe("("):
        inner = _exclusion(r, uses)
        r.take(")")
        return inner
    name = r.name("a relation")
    if name == "nil":
        return Nil()
    if name == "self" and "self" in uses:
        return Self()
    if r.maybe("->"):
        target = r.name()
        if r.now == "->":
            raise SchemaError("arrows cannot be chained")
        return Arrow(name, target)
    if r.maybe("."):
        how = r.name("any or all")
        if how not in ("any", "all"):
            raise SchemaError(f"unknown function {how}")
        r.take("(")
        target = r.name()
        r.take(")")
        if r.now in ("->", "."):
            raise SchemaError("arrows cannot be chained")
        return Arrow(name, target, how == "all")
    return Ref(name)


def leaves(e) -> list:
    return [x for p in e.parts for x in leaves(p)] if isinstance(e, SetOp) else [e]


# Type rules -----------------------------------------------------------------------------------------------------------
def validate(schema: Schema) -> None:
    """Raises SchemaError at the first rule that is broken."""
    from ..functions import cel

    for name, c in schema.caveats.items():
        if not PATTERN_NAME.match(name):
            raise SchemaError(f"{name} is no caveat name")
        cel.compile_caveat(c)
    for d in schema.definitions.values():
        if not PATTERN_TYPE.match(d.name):
            raise SchemaError(f"{d.name} is no type name")
        for m in d.members.values():
            if not PATTERN_NAME.match(m.name):
                raise SchemaError(f"{m.name} is no relation name")
            where = f"{d.name}#{m.name}"
            if m.is_permission:
                _check_permission(schema, d, m, where)
            else:
                _check_relation(schema, m, where)


def _check_relation(schema: Schema, m: Member, where: str) -> None:
    seen = set()
    for a in m.allowed:
        if str(a) in seen:
            raise SchemaError(f"{where} allows {a} twice")
        seen.add(str(a))
        if a.type not in schema.definitions:
            raise SchemaError(f"{where}: no definition {a.type}")
        if a.relation != ELLIPSIS:
            if schema.member(a.type, a.relation) is None:
                raise SchemaError(f"{where}: no relation {a.type}#{a.relation}")
            if holds_wildcard(schema, a.type, a.relation, set()):
                raise SchemaError(f"{where}: {a.type}#{a.relation} holds a wildcard and cannot be a subject")
        if a.caveat and a.caveat not in schema.caveats:
            raise SchemaError(f"{where}: no caveat {a.caveat}")
        if a.expiration and "expiration" not in schema.uses:
            raise SchemaError(f"{where}: expiration needs 'use expiration'")


def holds_wildcard(schema: Schema, type_: str, name: str, seen: set) -> bool:
    """Whether a base relation allows a wildcard, itself or through its subject relations."""
    if (type_, name) in seen:
        return False
    seen.add((type_, name))
    m = schema.member(type_, name)
    return m is not None and not m.is_permission and any(a.wildcard or (a.relation != ELLIPSIS and holds_wildcard(schema, a.type, a.relation, seen)) for a in m.allowed)


def _check_permission(schema: Schema, d: Definition, m: Member, where: str) -> None:
    for x in leaves(m.expr):
        if isinstance(x, Ref):
            if x.name == m.name:
                raise SchemaError(f"{where} refers to itself")
            if x.name not in d.members:
                raise SchemaError(f"{where}: no relation {x.name}")
        elif isinstance(x, Arrow):
            via = d.members.get(x.relation)
            if via is None or via.is_permission:
                raise SchemaError(f"{where}: an arrow starts from a relation, {x.relation} is none")
            if any(a.wildcard for a in via.allowed):
                raise SchemaError(f"{where}: {x.relation} allows a wildcard and cannot start an arrow")
            if not any(schema.member(a.type, x.target) for a in via.allowed):
                raise SchemaError(f"{where}: nothing that {x.relation} leads to has {x.target}")
