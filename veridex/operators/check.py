"""Bulk checks: who may do what, for many items at once.

Sub-problems are rows ``(resource, relation, subject, context)`` with a number. Level by level the open sub-problems meet
the edges they ask for, by equi-joins: one with the subject in the key (so a userset of any width costs one probe), and one
on the resource for wildcards, usersets and arrows, where the relation has any. What they lead to and has not been asked
yet is the next level; the items themselves are the first. Then the levels are resolved from the last one up. Each
contribution to a sub-problem is a bit for its leaf and code, so that one aggregate of a few whole numbers holds all leaves
of a permission; from the bits of a leaf come its OR and its AND (see ``functions.kleene``), and from the leaves the
permission's expression. Names of types and relations travel as numbers. Recursive data resolves in further sweeps; what
stays open after them is a cycle, or deeper than ``MAX_DEPTH``, and is an error of the items that depend on it alone.

Unlike a sequential evaluator the order of a union's operands does not matter: an item is in error only if no operand
determines it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import caveats
from ..functions.cel import FALSE, OPEN, TRUE
from ..functions.kleene import UNKNOWN, k_and, verdict
from ..plans.compile import Plan, compile_schema
from ..plans.schema import ELLIPSIS, WILDCARD, Schema
from ..sources.tuples import live
from ..util import written

MAX_DEPTH = 50
SUBJECT = ("st", "sid", "srel", "ctx")
NODE = ("k", "rid", *SUBJECT)
#: Leaves in a word of contributions, four bits each, and names in a word of missing ones.
LEAVES, NAMES = 15, 62
#: By the bits of a leaf (FALSE 1, UNKNOWN 2, OPEN 4, TRUE 8): the OR and the AND of the codes that are there.
ANY = [m.bit_length() - 1 if m else FALSE for m in range(16)]
ALL = [FALSE if not m or m & 1 else OPEN if m & 4 else UNKNOWN if m & 2 else TRUE for m in range(16)]


def leads_to(plans: dict[tuple[str, str], Plan], schema: Schema, k: tuple[str, str]) -> list[tuple[str, str]]:
    """The kinds of sub-problems that one kind can lead to directly."""
    out = []
    for leaf in plans[k].leaves:
        if leaf.kind == "node":
            out.append((k[0], leaf.edge))
        elif leaf.kind in ("this", "any", "all"):
            for a in schema.member(k[0], leaf.edge).allowed:
                target = a.relation if leaf.kind == "this" else leaf.target
                if target != ELLIPSIS and (a.type, target) in plans:
                    out.append((a.type, target))
    return out


def reachable_plans(plans: dict[tuple[str, str], Plan], schema: Schema, start: set[tuple[str, str]]) -> dict[tuple[str, str], Plan]:
    """The plans that sub-problems of the given kinds can lead to."""
    found, todo = {}, [k for k in start if k in plans]
    while todo:
        k = todo.pop()
        if k not in found:
            found[k] = plans[k]
            todo += leads_to(plans, schema, k)
    return found


def _value(plan: Plan) -> str:
    """SQL for the code of a permission from the words of contributions ``w0``, ``w1``, ..."""

    def walk(e) -> str:
        if e[0] == "nil":
            return str(FALSE)
        if e[0] == "leaf":
            table = ALL if plan.leaves[e[1]].kind == "all" else ANY
            return f"element_at(array({', '.join(map(str, table))}), 1 + cast(shiftright(w{e[1] // LEAVES}, {4 * (e[1] % LEAVES)}) & 15 as int))"
        codes = [walk(p) for p in e[1]]
        if e[0] == "exclusion":
            codes[1:] = [f"element_at(array({TRUE}, {UNKNOWN}, {OPEN}, {FALSE}), 1 + {c})" for c in codes[1:]]
        if len(codes) == 1:
            return codes[0]
        if e[0] == "union":
            return f"greatest({', '.join(codes)})"
        swap = f"element_at(array({FALSE}, {OPEN}, {UNKNOWN}, {TRUE}), 1 + "
        return f"{swap}least({', '.join(f'{swap}{c})' for c in codes)}))"

    return walk(plan.expr)


def _number_of(names: list, *columns: Column) -> Column:
    """The place in ``names`` of a name, or of a pair of names; null where it is not among them."""
    if not names:
        return F.lit(None).cast("int")
    joined = [n if isinstance(n, str) else "\x00".join(n) for n in names]
    return F.create_map(*[F.lit(x) for i, n in enumerate(joined) for x in (n, i)])[F.concat_ws("\x00", *columns) if len(columns) > 1 else columns[0]]


class _Check:
    """One bulk check: the numbers of names, the tables of leaves, and the levels."""

    def __init__(self, edges: DataFrame, schema: Schema, kinds: set[tuple[str, str]], now: str | None):
        self.schema, self.spark = schema, edges.sparkSession
        all_plans = compile_schema(schema)
        self.plans = reachable_plans(all_plans, schema, kinds)
        self.types, self.kinds = sorted(schema.definitions), sorted(all_plans)
        self.words = range(max([1, *(1 + (len(p.leaves) - 1) // LEAVES for p in self.plans.values())]))
        self.names = sorted({p for c in schema.caveats.values() for p, _ in c.parameters})
        self.masks = [f"m{i}" for i in range((len(self.names) + NAMES - 1) // NAMES)]
        leaves = [(self.kinds.index(k), k[0], i, x) for k, p in self.plans.items() for i, x in enumerate(p.leaves)]
        self.used = sorted({(t, x.edge) for _, t, _, x in leaves if x.kind in ("this", "any", "all")})
        hop = lambda x: x.cost + (x.kind == "this")
        self.leaves = [(k, i, x.kind, hop(x), self.used.index((t, x.edge)) if x.kind in ("this", "any", "all") else -1, x.edge, x.target) for k, t, i, x in leaves]
        e = edges.where(live(now))
        if self.used:
            e = e.where(F.col("resource_type").isin(sorted({t for t, _ in self.used})) & F.col("resource_relation").isin(sorted({r for _, r in self.used})))
        e = e.withColumn("e_k", _number_of(self.used, F.col("resource_type"), F.col("resource_relation"))).where("e_k is not null")
        self.edges = e.select(
            "e_k", F.col("resource_id").alias("e_rid"), _number_of(self.types, F.col("subject_type")).alias("e_st"), F.col("subject_id").alias("e_sid"), F.col("subject_relation").alias("e_srel"), "caveat_name", "caveat_context",
        )
        own = sorted({x[4] for x in self.leaves if x[2] == "this"})
        shapes = self.edges.where(F.col("e_k").isin(own) & ((F.col("e_srel") != ELLIPSIS) | (F.col("e_sid") == WILDCARD))).select("e_k").distinct().collect() if own else []  # at most the schema's
        self.wide = {r[0] for r in shapes}

    def type_of(self, k: Column) -> Column:
        return F.element_at(F.array(*[F.lit(self.types.index(t)) for t, _ in self.kinds]), k + 1)

    def _table(self, rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, schema))

    def _meet(self, nodes: DataFrame, kinds: set[int]) -> DataFrame | None:
        """What the edges, the nodes' own names and the nodes themselves contribute: id, leaf, hop, child type, id and relation or null, the subject, the caveat."""
        leaves = [x for x in self.leaves if x[0] in kinds]
        none, got = F.lit(None).cast("string"), []
        payload, caveat = ["id", "leaf", "hop"], ["caveat_name", "caveat_context"]
        no_child, no_caveat = [F.lit(None).cast("int").alias("c_rt"), none.alias("c_rid"), none.alias("c_rel")], [none.alias(c) for c in caveat]
        own = [x for x in leaves if x[2] == "this"]
        if own:
            e = self.edges.where(F.col("e_k").isin(sorted({x[4] for x in own})))
            type_of_edge = F.element_at(F.array(*[F.lit(self.types.index(t)) for t, _ in self.used]), F.col("e_k") + 1)
            met = nodes.withColumn("rt", self.type_of(F.col("k"))).join(
                e.withColumn("e_rt", type_of_edge), (F.col("rt") == F.col("e_rt")) & (F.col("rid") == F.col("e_rid")) & (F.col("st") == F.col("e_st")) & (F.col("sid") == F.col("e_sid")) & (F.col("srel") == F.col("e_srel"))
            )
            at = self._table([(x[0], x[4], x[1], x[3]) for x in own], "x_k int, x_e int, leaf int, hop int")
            got.append(met.join(at, (F.col("k") == F.col("x_k")) & (F.col("e_k") == F.col("x_e"))).select(*payload, *no_child, *SUBJECT, *caveat))
        walking = [x for x in leaves if x[2] in ("any", "all") or x[2] == "this" and x[4] in self.wide]
        if walking:
            at = self._table([(x[0], x[4], x[1], x[3], x[2] == "this", x[6]) for x in walking], "x_k int, x_e int, leaf int, hop int, own boolean, target string")
            e = self.edges.where(F.col("e_k").isin(sorted({x[4] for x in walking})))
            plain = sorted({x[4] for x in walking} - {x[4] for x in walking if x[2] != "this"})
            e = e.where(~F.col("e_k").isin(plain) | (F.col("e_srel") != ELLIPSIS) | (F.col("e_sid") == WILDCARD)) if plain else e
            met = nodes.join(at, F.col("k") == F.col("x_k")).join(e, (F.col("x_e") == F.col("e_k")) & (F.col("rid") == F.col("e_rid")))
            everyone = F.col("own") & (F.col("e_sid") == WILDCARD) & (F.col("e_srel") == ELLIPSIS) & (F.col("srel") == ELLIPSIS) & (F.col("sid") != WILDCARD) & F.coalesce(F.col("e_st") == F.col("st"), F.lit(False))
            leads = F.when(F.col("own"), F.col("e_srel") != ELLIPSIS).otherwise(F.col("e_sid") != WILDCARD)
            met = met.where(everyone | leads)
            child = [F.when(leads, F.coalesce("e_st", F.lit(-1))).alias("c_rt"), F.when(leads, F.col("e_sid")).alias("c_rid"), F.when(leads, F.when(F.col("own"), F.col("e_srel")).otherwise(F.col("target"))).alias("c_rel")]
            got.append(met.select(*payload, *child, *SUBJECT, *caveat))
        inner = [x for x in leaves if x[2] == "node"]
        if inner:
            at = self._table([(x[0], x[1], x[3], x[5]) for x in inner], "x_k int, leaf int, hop int, edge string")
            got.append(nodes.join(at, F.col("k") == F.col("x_k")).select(*payload, self.type_of(F.col("k")).alias("c_rt"), F.col("rid").alias("c_rid"), F.col("edge").alias("c_rel"), *SUBJECT, *no_caveat))
        selves = [x for x in leaves if x[2] in ("self", "ident")]
        if selves:
            at = self._table([(x[0], x[1], x[3], ELLIPSIS if x[2] == "self" else x[5]) for x in selves], "x_k int, leaf int, hop int, edge string")
            itself = nodes.where((F.col("rid") == F.col("sid")) & (self.type_of(F.col("k")) == F.col("st")))
            got.append(itself.join(at, (F.col("k") == F.col("x_k")) & (F.col("srel") == F.col("edge"))).select(*payload, *no_child, *SUBJECT, *no_caveat))
        return reduce(DataFrame.unionByName, got) if got else None

    def ground(self, nodes: DataFrame, kinds: set[int]) -> tuple[DataFrame, set[int], bool]:
        """The contributions to some nodes (id, leaf, hop, code, err, missing names as bits, child and subject or null), the kinds of the children, and whether one failed."""
        got = self._meet(nodes, kinds)
        if got is None:
            got = nodes.limit(0).select("id", *[F.lit(None).cast("int").alias(c) for c in ("leaf", "hop", "c_rt")], *[F.lit(None).cast("string").alias(c) for c in ("c_rid", "c_rel", "caveat_name", "caveat_context")], *SUBJECT)
        if self.schema.caveats:
            got = written(got, "given")  # its rows are parted by how their caveats run
        got = caveats.attach(got.withColumnRenamed("ctx", "context"), self.schema).withColumnRenamed("context", "ctx")
        # a child that is the subject itself holds; one whose relation its type lacks does not
        child = F.col("c_rt").isNotNull()
        met = child & (F.col("c_rt") == F.col("st")) & (F.col("c_rid") == F.col("sid")) & (F.col("c_rel") == F.col("srel"))
        types = F.array(*[F.lit(t) for t in self.types])
        c_k = F.when(child & (F.col("c_rt") >= 0) & ~met, _number_of(self.kinds, F.element_at(types, F.greatest(F.col("c_rt"), F.lit(0)) + 1), F.col("c_rel")))
        got = got.withColumn("c_k", c_k).withColumn("c_k", F.when(F.col("c_k").isin([self.kinds.index(k) for k in self.plans]), F.col("c_k"))).withColumn("code", F.when(child & ~met & F.col("c_k").isNull(), F.lit(FALSE)).otherwise(F.col("code")))
        bits = [reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.array_contains("missing", n), F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, n in enumerate(self.names[i * NAMES : (i + 1) * NAMES])]) for i in range(len(self.masks))]
        of_child = [F.when(F.col("c_k").isNotNull(), F.col(c)).alias(c) for c in ("c_rid", *SUBJECT)]
        got = written(got.select("id", "leaf", "hop", "code", "err", *[b.alias(m) for b, m in zip(bits, self.masks)], "c_k", *of_child), "given")
        facts = got.agg(F.collect_set(F.when(F.col("code") != FALSE, F.col("c_k"))), F.count("err")).first()
        return got, set(facts[0]), bool(facts[1])

    def fold(self, given: DataFrame, values: DataFrame | None, failed: bool) -> DataFrame:
        """Per node: the words of contributions ``w``, missing names, err and height."""
        kept = ["id", "leaf", "code", *self.masks, "err", "height"]
        ends = given.where("c_k is null").withColumn("height", F.col("hop")).select(*kept)
        links = given.where("c_k is not null")
        if values is None:
            links = links.select(*links.columns, F.lit(None).cast("int").alias("v_code"), *[F.lit(None).cast("long").alias(f"v_{m}") for m in self.masks], F.lit(None).cast("string").alias("v_err"), F.lit(0).alias("v_height"))
        else:
            v = values.select(*[F.col(c).alias(f"v_{c}") for c in (*NODE, "code", *self.masks, "err", "height")])
            links = links.join(v, reduce(lambda a, b: a & b, [F.col(c) == F.col(f"v_{n}") for c, n in zip(("c_k", "c_rid", *SUBJECT), NODE)]), "left")
        height = F.col("hop") + F.coalesce("v_height", F.lit(0))
        child = F.when(height > MAX_DEPTH, F.lit(OPEN)).otherwise(F.coalesce("v_code", F.lit(OPEN)))
        links = links.select(
            "id", "leaf", k_and(F.col("code"), child).alias("code"), *[F.col(m).bitwiseOR(F.coalesce(f"v_{m}", F.lit(0).cast("long"))).alias(m) for m in self.masks],
            F.when(F.col("code") != FALSE, F.coalesce("err", "v_err")).alias("err"), height.alias("height"),
        )
        got = ends.unionByName(links)
        bit = F.expr(f"shiftleft(1L, 4 * (leaf % {LEAVES}) + code)")
        words = [F.bit_or(bit if len(self.words) == 1 else F.when(F.floor(F.col("leaf") / LEAVES) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in self.words]
        masks = [F.bit_or(F.when(F.col("code") == UNKNOWN, F.col(m)).otherwise(F.lit(0).cast("long"))).alias(m) for m in self.masks]
        # a text in the aggregate costs a sort of all rows
        err = [F.min(F.when(F.col("code") != FALSE, F.col("err"))).alias("err")] if failed else []
        out = got.groupBy("id").agg(*words, *masks, *err, F.max("height").alias("height"))
        return out if failed else out.withColumn("err", F.lit(None).cast("string"))

    def resolve(self, nodes: DataFrame, folded: DataFrame, kinds: set[int]) -> DataFrame:
        """The nodes with code, missing names, err and height."""
        got = nodes.join(folded, "id", "left").withColumns({f"w{w}": F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in self.words})
        found = [(k, _value(self.plans[self.kinds[k]])) for k in sorted(kinds)]
        code = F.expr(f"case {' '.join(f'when k = {k} then {c}' for k, c in found)} else {FALSE} end") if found else F.lit(FALSE)
        got = got.withColumn("code", code).drop(*[f"w{w}" for w in self.words])
        return got.withColumns(
            {m: F.when(F.col("code") == UNKNOWN, F.col(m)).otherwise(F.lit(0).cast("long")) for m in self.masks} | {"err": F.when(F.col("code") == OPEN, F.col("err")), "height": F.coalesce("height", F.lit(0))}
        )

    def run(self, nodes: DataFrame, kinds: set[int]) -> DataFrame:
        """``nodes`` (id and ``NODE``, and whatever else) with code, missing names, err and height."""
        levels: list[tuple[DataFrame, set[int]]] = [(nodes, kinds)]
        given: list[DataFrame] = []
        leads: list[set[int]] = []
        failed, again = False, False
        while True:
            got, to, bad = self.ground(*levels[-1])
            given.append(got)
            leads.append(to)
            failed |= bad
            if not to or len(levels) == MAX_DEPTH:
                again |= bool(to)
                break
            new = got.where(F.col("c_k").isNotNull() & (F.col("code") != FALSE)).select(F.col("c_k").alias("k"), F.col("c_rid").alias("rid"), *SUBJECT).distinct()
            known = [n for n, of in levels[1:] if of & to]  # the items are not among what others lead to
            if known:
                again = True
                new = new.join(reduce(DataFrame.unionByName, [n.select(*NODE) for n in known]), list(NODE), "left_anti")
            new = written(new.withColumn("id", F.monotonically_increasing_id() + F.lit(len(levels) << 57)), "nodes")
            if known and not new.limit(1).count():
                break
            levels.append((new, to))
        if len(levels) == 1:
            return self.resolve(nodes, self.fold(given[0], None, failed), kinds)
        values: list[tuple[DataFrame, set[int]]] = []
        for (n, of), g, to in list(zip(levels, given, leads))[:0:-1]:
            below = [v for v, kinds_ in values if kinds_ & to]
            values.append((written(self.resolve(n, self.fold(g, reduce(DataFrame.unionByName, below) if below else None, failed), of), "values"), of))
        done = reduce(DataFrame.unionByName, [v for v, _ in values])
        if again:  # what waits for a sub-problem of its own or an earlier level is resolved in rounds over all of it
            all_given, all_kinds, before = reduce(DataFrame.unionByName, given[1:]), set().union(*(of for _, of in levels[1:])), None
            for _ in range(MAX_DEPTH):
                waiting = done.where((F.col("code") == OPEN) & F.col("err").isNull()).select("id", *NODE)
                n = waiting.count()
                if not n or n == before:
                    break
                before = n
                more = self.resolve(waiting, self.fold(all_given.join(waiting.select("id"), "id", "left_semi"), done, failed), all_kinds)
                done = written(done.join(waiting.select("id"), "id", "left_anti").unionByName(more), "values")
        return self.resolve(nodes, self.fold(given[0], done, failed), kinds)


def bulk_check(edges: DataFrame, schema: Schema, items: DataFrame, now: str | None = None) -> DataFrame:
    """item_id, verdict (member, not_member, caveated), missing (sorted names) and error, a row for each item.

    ``items``: item_id, resource_type, resource_id, permission, subject_type, subject_id, subject_relation, context.
    """
    types, kinds = sorted(schema.definitions), sorted(compile_schema(schema))
    if "context" not in items.columns:
        items = items.withColumn("context", F.lit(None).cast("string"))
    srel = F.coalesce("subject_relation", F.lit(ELLIPSIS))
    k, st = _number_of(kinds, F.col("resource_type"), F.col("permission")), _number_of(types, F.col("subject_type"))
    bad = F.when(k.isNull(), "unknown_relation").when(st.isNull(), "unknown_subject_type").when(F.col("subject_id") == WILDCARD, "wildcard_subject")
    same = (F.col("resource_type") == F.col("subject_type")) & (F.col("resource_id") == F.col("subject_id")) & (F.col("permission") == srel)
    asked = items.select(
        F.monotonically_increasing_id().alias("id"), "item_id", bad.alias("bad"), same.alias("same"), k.alias("k"), F.col("resource_id").alias("rid"), st.alias("st"), F.col("subject_id").alias("sid"),
        srel.alias("srel"), F.coalesce("context", F.lit("")).alias("ctx"),
    )
    asked = written(asked, "asked")
    found = {r[0] for r in asked.where("bad is null").select("k").distinct().collect()}  # at most the schema's
    check = _Check(edges, schema, {kinds[i] for i in found}, now)
    values = check.run(asked.where("bad is null").select("id", *NODE), found).select("id", "code", *check.masks, "err")
    got = asked.select("id", "item_id", "bad", "same").join(values, "id", "left")
    code = F.when(F.col("bad").isNotNull(), F.lit(OPEN)).when(F.col("same"), F.lit(TRUE)).otherwise(F.col("code"))
    names = F.array_compact(F.array(*[F.when(F.col(check.masks[i // NAMES]).bitwiseAND(F.lit(1 << i % NAMES)) != 0, F.lit(n)) for i, n in enumerate(check.names)])) if check.names else F.array().cast("array<string>")
    got = got.withColumn("code", code)
    return got.select(
        "item_id", verdict(F.col("code")).alias("verdict"), F.when(F.col("code") == UNKNOWN, F.array_join(names, ",")).otherwise(F.lit("")).alias("missing"),
        F.when(F.col("code") == OPEN, F.coalesce("bad", "err", F.lit("max_depth"))).alias("error"),
    )
