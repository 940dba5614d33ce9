"""Checks, lookups and expansion against a plain recursive evaluator on small worlds."""

import json
import random

import pytest

from veridex.functions import cel
from veridex.operators import check, expand, lookup
from veridex.plans.schema import ELLIPSIS, Arrow, Nil, Ref, Self, SetOp, parse
from veridex.sources.tuples import SCHEMA

TEXT = """
use self
caveat small(num int) { num < 5 }
caveat named(who string) { who == 'x' }
definition user {}
definition group {
  relation direct: user | user:* with small
  relation member: user | group#all with named | group#member
  permission all = member + direct
}
definition folder {
  relation parent: folder
  relation viewer: user | group#member | user:*
  relation banned: user | group#all
  permission view = (viewer + parent->view) - banned
}
definition document {
  relation folder: folder | folder with small
  relation owner: user with named
  relation viewer: user | user:* | group#all
  permission view = owner + viewer & folder->view
  permission every = folder.all(view) - nil
  permission mine = self + owner
}
"""
F, U, O, T = cel.FALSE, cel.UNKNOWN_CODE, cel.OPEN, cel.TRUE  # noqa: E741


def k_and(a, b):
    return F if F in (a, b) else O if O in (a, b) else U if U in (a, b) else T


class Brute:
    def __init__(self, schema, edges):
        self.schema, self.edges = schema, edges

    def tuple_code(self, e, context):
        return T if e[6] is None else cel.evaluate(cel.compile_caveat(self.schema.caveats[e[6]]), e[7], context)[0]

    def check(self, t, i, r, subject, context, depth=50):
        if depth <= 0:
            return O
        if (t, i, r) == subject:
            return T
        m = self.schema.member(t, r)
        if m is None:
            return F
        if m.is_permission:
            return self.expr(m.expr, t, i, subject, context, depth)
        best = F
        for e in self.edges:
            if e[:3] != (t, i, r):
                continue
            code = self.tuple_code(e, context)
            if e[3:6] == subject or (e[4] == "*" and e[3] == subject[0] and subject[2] == ELLIPSIS):
                best = max(best, code)
            elif e[5] != ELLIPSIS and code:
                best = max(best, k_and(code, self.check(e[3], e[4], e[5], subject, context, depth - 1)))
        return best

    def expr(self, x, t, i, subject, context, depth):
        if isinstance(x, Nil):
            return F
        if isinstance(x, Self):
            return T if subject == (t, i, ELLIPSIS) else F
        if isinstance(x, Ref):
            return self.check(t, i, x.name, subject, context, depth - 1)
        if isinstance(x, Arrow):
            got = [k_and(self.tuple_code(e, context), self.check(e[3], e[4], x.target, subject, context, depth - 1)) for e in self.edges if e[:3] == (t, i, x.relation) and e[4] != "*"]
            if not x.every:
                return max(got, default=F)
            code = T if got else F
            for g in got:
                code = k_and(code, g)
            return code
        assert isinstance(x, SetOp)
        parts = [self.expr(p, t, i, subject, context, depth) for p in x.parts]
        if x.kind == "union":
            return max(parts)
        if x.kind == "exclusion":
            parts[1] = {T: F, F: T}.get(parts[1], parts[1])
        code = parts[0]
        for p in parts[1:]:
            code = k_and(code, p)
        return code


def world(seed):
    rnd = random.Random(seed)
    users, groups, folders, docs = [f"u{i}" for i in range(5)], [f"g{i}" for i in range(4)], [f"f{i}" for i in range(4)], [f"d{i}" for i in range(4)]
    small = lambda: ("small", json.dumps({"num": rnd.randrange(10)}) if rnd.random() < 0.5 else None)
    named = lambda: ("named", json.dumps({"who": rnd.choice("xy")}) if rnd.random() < 0.5 else None)
    plain = (None, None)
    out = set()
    for i, g in enumerate(groups):
        out |= {("group", g, "member", "user", u, ELLIPSIS, *plain) for u in rnd.sample(users, 1)}
        for h in groups[i + 1 :]:
            if rnd.random() < 0.4:
                out.add(("group", g, "member", "group", h, "member", *plain))
            elif rnd.random() < 0.4:
                out.add(("group", g, "member", "group", h, "all", *named()))
        if rnd.random() < 0.3:
            out.add(("group", g, "direct", "user", "*", ELLIPSIS, *small()))
    for i, f in enumerate(folders):
        for p in folders[i + 1 :]:
            if rnd.random() < 0.4:
                out.add(("folder", f, "parent", "folder", p, ELLIPSIS, *plain))
        out.add(("folder", f, "viewer", *rnd.choice([("user", rnd.choice(users), ELLIPSIS), ("user", "*", ELLIPSIS), ("group", rnd.choice(groups), "member")]), *plain))
        if rnd.random() < 0.5:
            out.add(("folder", f, "banned", *rnd.choice([("user", rnd.choice(users), ELLIPSIS), ("group", rnd.choice(groups), "all")]), *plain))
    for d in docs:
        for f in rnd.sample(folders, 2):
            out.add(("document", d, "folder", "folder", f, ELLIPSIS, *rnd.choice([plain, small()])))
        out.add(("document", d, "owner", "user", rnd.choice(users), ELLIPSIS, *named()))
        out.add(("document", d, "viewer", *rnd.choice([("user", "*", ELLIPSIS), ("group", rnd.choice(groups), "all"), ("user", rnd.choice(users), ELLIPSIS)]), *plain))
    return sorted(out, key=str), users, groups, folders, docs


def frame(spark, edges):
    return spark.createDataFrame([(*e, None) for e in edges], SCHEMA)


NAMES = {F: "not_member", U: "caveated", T: "member", O: None}


@pytest.mark.parametrize("seed", [1, 2])
def test_bulk_check_agrees_with_brute_force(spark, seed):
    schema = parse(TEXT)
    edges, users, groups, folders, docs = world(seed)
    brute = Brute(schema, edges)
    items = []
    for t, ids, r in (("document", docs, "view"), ("document", docs, "every"), ("document", docs, "mine"), ("folder", folders, "view"), ("group", groups, "all")):
        for i in ids:
            for s in [("user", u, ELLIPSIS) for u in users] + [("user", "fresh", ELLIPSIS), ("group", "g3", "member"), ("document", "d0", ELLIPSIS)]:
                for c in (None, '{"num": 3, "who": "x"}', '{"num": 7}'):
                    items.append((len(items), t, i, r, *s, c))
    df = spark.createDataFrame(items, "item_id int, resource_type string, resource_id string, permission string, subject_type string, subject_id string, subject_relation string, context string")
    got = {r["item_id"]: r for r in check.bulk_check(frame(spark, edges), schema, df).collect()}
    assert len(got) == len(items)
    for n, t, i, r, st, sid, srel, c in items:
        want = brute.check(t, i, r, (st, sid, srel), c)
        assert got[n]["verdict"] == NAMES[want], (t, i, r, st, sid, srel, c)
        assert bool(got[n]["missing"]) == (want == U)


def test_cycles_and_depth_are_errors_only_where_they_decide(spark, monkeypatch):
    monkeypatch.setattr(check, "MAX_DEPTH", 4)
    schema = parse("definition user {} definition group { relation member: user | group#member }")
    loop = [("group", "aaa", "member", "group", "bbb", "member", None, None), ("group", "bbb", "member", "group", "aaa", "member", None, None), ("group", "bbb", "member", "user", "in", ELLIPSIS, None, None)]
    chain = [("group", f"c{i}", "member", "group", f"c{i + 1}", "member", None, None) for i in range(6)] + [("group", "c6", "member", "user", "deep", ELLIPSIS, None, None)]
    items = spark.createDataFrame(
        [("hit", "aaa", "in"), ("miss", "aaa", "out"), ("near", "c3", "deep"), ("far", "c0", "deep")], "item_id string, resource_id string, subject_id string"
    ).selectExpr("*", "'group' resource_type", "'member' permission", "'user' subject_type", "'...' subject_relation")
    got = {r["item_id"]: (r["verdict"], r["error"]) for r in check.bulk_check(frame(spark, loop + chain), schema, items).collect()}
    assert got == {"hit": ("member", None), "miss": (None, "max_depth"), "near": ("member", None), "far": (None, "max_depth")}


def test_lookups_agree_with_checks(spark):
    schema = parse(TEXT)
    edges, users, groups, folders, docs = world(3)
    brute, e = Brute(schema, edges), frame(spark, edges)
    subjects = spark.createDataFrame([("user", u, ELLIPSIS) for u in [*users, "fresh"]], "subject_type string, subject_id string, subject_relation string")
    for t, ids, r in (("document", docs, "view"), ("folder", folders, "view")):
        got = {(x["subject_id"], x["resource_id"]): x["verdict"] for x in lookup.lookup_resources(e, schema, subjects, t, r).collect()}
        want = {(u, i): NAMES[c] for u in [*users, "fresh"] for i in ids if (c := brute.check(t, i, r, ("user", u, ELLIPSIS), None)) in (U, T)}
        assert got == want
    resources = spark.createDataFrame([("folder", f) for f in folders], "resource_type string, resource_id string")
    got = lookup.lookup_subjects(e, schema, resources, "view", "user").collect()
    wild = {r["resource_id"]: r for r in got if r["is_wildcard"]}
    for f in folders:
        assert (f in wild) == (brute.check("folder", f, "view", ("user", "fresh", ELLIPSIS), None) in (U, T))
        listed = {r["subject_id"]: r["verdict"] for r in got if r["resource_id"] == f and not r["is_wildcard"]}
        for u in users:
            code = brute.check("folder", f, "view", ("user", u, ELLIPSIS), None)
            if u in listed:
                assert listed[u] == NAMES[code]
            elif f in wild:
                assert (code == F) == (u in wild[f]["excluded"].split(","))
            else:
                assert code == F


def test_expand_lists_leaves(spark):
    schema = parse(TEXT)
    edges = [("folder", "f0", "viewer", "user", "u1", ELLIPSIS, None, None), ("folder", "f0", "parent", "folder", "f1", ELLIPSIS, None, None), ("folder", "f1", "viewer", "user", "*", ELLIPSIS, None, None), ("folder", "f1", "parent", "folder", "f0", ELLIPSIS, None, None)]
    resources = spark.createDataFrame([("folder", "f0")], "resource_type string, resource_id string")
    got = {(r["kind"], r["object"], r["subjects"]) for r in expand.expand(frame(spark, edges), schema, resources, "view").collect()}
    assert ("exclusion", "folder:f0#view", "") in got and ("leaf", "folder:f0#viewer", "user:u1") in got and ("leaf", "folder:f1#viewer", "user:*") in got
    assert ("leaf", "folder:f0#view", "") in got  # the cycle ends in an empty leaf


def test_empty_items(spark):
    schema = parse(TEXT)
    none = spark.createDataFrame([], "item_id string, resource_type string, resource_id string, permission string, subject_type string, subject_id string, subject_relation string")
    assert check.bulk_check(frame(spark, []), schema, none).collect() == []


def test_wildcard_survives_a_ban_of_any_legal_name(spark):
    schema = parse("definition user {} definition doc { relation viewer: user | user:* relation banned: user permission view = viewer - banned }")
    rows = [("doc", "one", "viewer", "user", "*", ELLIPSIS, None, None, None)] + [("doc", "one", "banned", "user", u, ELLIPSIS, None, None, None) for u in ("any/other|name", "fresh", "x=y")]
    got = lookup.lookup_subjects(spark.createDataFrame(rows, SCHEMA), schema, spark.createDataFrame([("doc", "one")], "resource_type string, resource_id string"), "view", "user").collect()
    assert [(r["subject_id"], r["is_wildcard"], r["excluded"]) for r in got] == [("*", True, "any/other|name,fresh,x=y")]


SETS = """
definition user {}
definition group { relation member: user | user:* | group#member permission all = member }
definition folder {
  relation viewer: user | user:* | group#all
  relation banned: user | group#member
  permission view = viewer - banned
}
definition document {
  relation folder: folder
  relation owner: user
  relation viewer: user | user:* | group#member
  relation muted: user | user:*
  permission open = folder->view + viewer
  permission view = (open & viewer) + (folder->view - muted) + owner
  permission quiet = (viewer - muted) - folder->view
}
"""


@pytest.mark.parametrize("seed", [1, 2])
def test_subject_sets_agree_with_brute_force(spark, seed):
    rnd, schema = random.Random(seed), parse(SETS)
    users, groups, folders, docs = [[f"{c}{i}" for i in range(n)] for c, n in (("u", 7), ("g", 6), ("f", 6), ("d", 8))]
    someone = lambda *more: rnd.choice([("user", rnd.choice(users), ELLIPSIS), ("user", rnd.choice(users), ELLIPSIS), *more])
    everyone = ("user", "*", ELLIPSIS)
    rows = {("group", g, "member", *someone(*[("group", x, "member") for x in groups[i + 1 :]], *([everyone] if g == "g5" else []))) for i, g in enumerate(groups) for _ in range(3)}
    for f in folders:
        rows |= {("folder", f, "viewer", *someone(everyone, ("group", rnd.choice(groups), "all"))) for _ in range(3)}
        rows |= {("folder", f, "banned", *someone(("group", rnd.choice(groups), "member"))) for _ in range(2)}
    for d in docs:
        rows |= {("document", d, "folder", "folder", f, ELLIPSIS) for f in rnd.sample(folders, 2)} | {("document", d, "owner", *someone())}
        rows |= {("document", d, "viewer", *someone(everyone, ("group", rnd.choice(groups), "member"))) for _ in range(2)} | {("document", d, "muted", *someone(everyone)) for _ in range(2)}
    edges = [(*r, None, None) for r in sorted(rows)]
    brute, e = Brute(schema, edges), frame(spark, edges)
    for t, ids, permission in (("document", docs, "view"), ("document", docs, "quiet"), ("folder", folders, "view"), ("group", groups, "all")):
        resources = spark.createDataFrame([(t, i) for i in ids] * 2, "resource_type string, resource_id string")
        got = lookup.lookup_subjects(e, schema, resources, permission, "user").collect()
        assert len(got) == len({(r["resource_id"], r["subject_id"]) for r in got})
        for i in ids:
            holds = {u for u in [*users, "fresh"] if brute.check(t, i, permission, ("user", u, ELLIPSIS), None) == T}
            named = {r["subject_id"] for r in got if r["resource_id"] == i and not r["is_wildcard"]}
            wild = [set(filter(None, r["excluded"].split(","))) for r in got if r["resource_id"] == i and r["is_wildcard"]]
            assert bool(wild) == ("fresh" in holds) and named <= holds
            assert holds == (named | set(users) - wild[0] | {"fresh"} if wild else named)
            assert not wild or wild[0].isdisjoint(holds)


def test_subject_sets_of_nested_groups_with_a_cycle_and_of_nothing(spark):
    schema = parse(SETS)
    edges = [("group", "g0", "member", "group", "g1", "member"), ("group", "g1", "member", "group", "g0", "member"), ("group", "g1", "member", "user", "ann", ELLIPSIS), ("group", "g2", "member", "group", "g0", "member")]
    resources = spark.createDataFrame([("group", "g0"), ("group", "g2"), ("group", "none")], "resource_type string, resource_id string")
    got = lookup.lookup_subjects(frame(spark, [(*r, None, None) for r in edges]), schema, resources, "all", "user").collect()
    assert sorted((r["resource_id"], r["subject_id"]) for r in got) == [("g0", "ann"), ("g2", "ann")]
    assert lookup.lookup_subjects(frame(spark, []), schema, resources, "all", "user").count() == 0
    assert lookup.lookup_subjects(frame(spark, []), schema, resources.limit(0), "all", "user").count() == 0
