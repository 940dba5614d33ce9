"""From permissions to operand plans.

Every relation or permission of a type becomes a Kleene expression over numbered leaves. Names of the same object are
inlined, so that only edges cost a join; a name that comes back to itself stays a node of its own. Each leaf keeps how
many levels it stands below its permission: every hop counts, inlined or not.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .schema import Arrow, Nil, Ref, Schema, Self, SetOp


@dataclass(frozen=True)
class Leaf:
    kind: str  # this, any, all, node, self; ident: the name itself, as a subject
    edge: str = ""  # relation whose edges are read, or the relation of the node
    target: str = ""  # relation asked of what an arrow reaches
    cost: int = 0


@dataclass
class Plan:
    """leaves by number, and the expression: ("leaf", i), ("nil",), or ("union" | "intersection" | "exclusion", parts)."""

    leaves: list[Leaf] = field(default_factory=list)
    expr: tuple = ("nil",)

    def leaf(self, leaf: Leaf) -> tuple:
        if leaf not in self.leaves:
            self.leaves.append(leaf)
        return ("leaf", self.leaves.index(leaf))


def compile_member(schema: Schema, type_: str, name: str) -> Plan:
    plan = Plan()

    def walk(e, path: tuple[str, ...], cost: int) -> tuple:
        if isinstance(e, SetOp):
            return (e.kind, tuple(walk(p, path, cost) for p in e.parts))
        if isinstance(e, Nil):
            return ("nil",)
        if isinstance(e, Self):
            return plan.leaf(Leaf("self", cost=cost))
        if isinstance(e, Arrow):
            return plan.leaf(Leaf("all" if e.every else "any", e.relation, e.target, cost + 1))
        return member(e.name, path, cost + 1)

    def member(n: str, path: tuple[str, ...], cost: int) -> tuple:
        m = schema.member(type_, n)
        if m is None:
            return ("nil",)
        if n in path:
            return plan.leaf(Leaf("node", n, cost=cost))
        inner = walk(m.expr, (*path, n), cost) if m.is_permission else plan.leaf(Leaf("this", n, cost=cost))
        # an inlined name still holds for the subject that is this very name of this object
        return ("union", (inner, plan.leaf(Leaf("ident", n, cost=cost)))) if path else inner

    plan.expr = member(name, (), 0)
    return plan


def compile_schema(schema: Schema) -> dict[tuple[str, str], Plan]:
    return {(d.name, n): compile_member(schema, d.name, n) for d in schema.definitions.values() for n in d.members}


def plan_rows(spark: SparkSession, plans: dict[tuple[str, str], Plan]) -> DataFrame:
    """One row a leaf; as large as the schema, so it may be broadcast."""
    rows = [(t, n, i, x.kind, x.edge, x.target, x.cost) for (t, n), p in plans.items() for i, x in enumerate(p.leaves)]
    return spark.createDataFrame(rows, "p_type string, p_relation string, leaf int, kind string, edge string, target string, cost int")


def monotone(plan: Plan) -> bool:
    """Whether it is a union of edges and any-arrows all through: then being reachable is being a member."""

    def ok(e) -> bool:
        return e[0] in ("leaf", "nil") or e[0] == "union" and all(map(ok, e[1]))

    return ok(plan.expr) and all(x.kind in ("this", "any", "node", "ident") for x in plan.leaves)
