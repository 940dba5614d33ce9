import json

import pytest
from pyspark.sql import functions as F

from veridex.functions import caveats, cel
from veridex.plans.schema import Caveat, Schema, parse


def caveat(params, text):
    return cel.compile_caveat(Caveat("probe", tuple(params.items()), text))


CASES = [
    ({"m": "map<any>"}, "m.foo == 42 && m.bar < 56", {"m": {"foo": 42, "bar": 1}}, cel.TRUE),
    ({"xs": "list<int>"}, "xs.all(i, i >= 42)", {"xs": [42, 43]}, cel.TRUE),
    ({"xs": "list<int>"}, "xs.all(i, i >= 42)", {"xs": [1]}, cel.FALSE),
    ({"ip": "ipaddress", "net": "string"}, "ip.in_cidr(net)", {"ip": "::1", "net": "::/64"}, cel.TRUE),
    ({"ip": "ipaddress"}, "ip.in_cidr('10.0.0.0/8')", {"ip": "::1"}, cel.FALSE),
    ({"ip": "ipaddress"}, "ip.in_cidr('10.1.2.3')", {"ip": "10.1.2.3"}, cel.TRUE),
    ({"now": "timestamp", "end": "timestamp"}, "now < end", {"now": "2020-01-01T00:00:00Z", "end": "2021-01-01T00:00:00+01:00"}, cel.TRUE),
    ({"self": "string", "admins": "list<string>"}, "self in admins", {"self": "a", "admins": ["b"]}, cel.FALSE),
    ({"a": "int"}, "a == 5", {"a": "5"}, cel.TRUE),
    ({"a": "int"}, "a == 5", {"a": 5.0}, cel.TRUE),
    ({"a": "int"}, "a == 5", {"a": True}, cel.OPEN),
    ({"a": "uint"}, "a == 5", {"a": -1}, cel.OPEN),
    ({"a": "bool"}, "a", {"a": "true"}, cel.OPEN),
    ({"a": "int", "b": "int"}, "a == 1 || b == 1", {"a": 1}, cel.TRUE),
    ({"a": "int", "b": "int"}, "a == 1 && b == 1", {"a": 2}, cel.FALSE),
    ({"a": "int", "b": "int"}, "b == 1 && a == 1", {"a": 1}, cel.UNKNOWN_CODE),
    ({"a": "int"}, "a / 0 == 1 || a == 3", {"a": 3}, cel.TRUE),
    ({"a": "int"}, "a / 0 == 1", {"a": 3}, cel.OPEN),
    ({"a": "int"}, "-7 / 2 == -3 && -7 % 2 == -1 && a > 0", {"a": 3}, cel.TRUE),
    ({"a": "int"}, "a + 1 > 0", {"a": 2**63 - 1}, cel.OPEN),
    ({"a": "int"}, "1 + 9223372036854775807 > a", {"a": 0}, cel.OPEN),
    ({"a": "int"}, "-a - 2 < 0", {"a": 2**63 - 1}, cel.OPEN),
    ({"a": "uint"}, "a > 5", {"a": 2**64 - 1}, cel.TRUE),
    ({"a": "int"}, "[0, 1].exists(x, a / x > 0) && ![0, 1].all(x, 1 / x > 5)", {"a": 1}, cel.TRUE),
    ({"a": "int"}, "[0].exists(x, a / x > 0)", {"a": 1}, cel.OPEN),
    ({"a": "int"}, "a == 5", {"a": "5.0"}, cel.OPEN),
    ({"a": "int"}, "a == 5", {"a": None}, cel.UNKNOWN_CODE),
    ({"m": "map<any>"}, "has(m.a)", {"m": {"a": None}}, cel.FALSE),
    ({"d": "duration"}, "d > duration('90m') && d.getHours() == 2", {"d": "2h"}, cel.TRUE),
    ({"t": "timestamp"}, "t.getMonth('+02:00') == 0 && t.getDayOfYear() == 364", {"t": "2023-12-31T23:00:00Z"}, cel.TRUE),
    ({"m": "map<any>", "n": "map<any>"}, "m.isSubtreeOf(n)", {"m": {"a": {"b": 1}}, "n": {"a": {"b": 1.0, "c": 2}}}, cel.TRUE),
    ({"m": "map<any>"}, "has(m.a) && !has(m.b)", {"m": {"a": 1}}, cel.TRUE),
    ({"s": "string"}, r"s.matches('^a.c$') && s.size() == 3 && 'bc' == s.size() > 0 ? true : s == 'abc'", {"s": "abc"}, None),
    ({"s": "string"}, "s.matches('^a.c$') && [1, 2].map(x, x * 2) == [2, 4] && [1, 2].exists_one(x, x > 1)", {"s": "abc"}, cel.TRUE),
]


@pytest.mark.parametrize("params,text,context,code", CASES)
def test_evaluate(params, text, context, code):
    if code is None:
        with pytest.raises(cel.CaveatError):
            caveat(params, text)
        return
    assert cel.evaluate(caveat(params, text), None, json.dumps(context))[0] == code


def test_stored_context_wins_and_missing_is_textual():
    c = caveat({"max": "double", "amount": "double"}, "amount <= max")
    assert cel.evaluate(c, '{"max": 1}', '{"max": 9, "amount": 5}')[0] == cel.FALSE
    assert cel.evaluate(c, None, None) == (cel.UNKNOWN_CODE, ["amount", "max"], None)


def test_jvm_and_python_agree(spark):
    s = parse("caveat fast(aaa double, bbb int) { aaa <= 3.0 && !(bbb == 2) || bbb > 10 } caveat slow(ccc string) { ccc == 'x' }")
    contexts = [None, "{}", '{"aaa": 1}', '{"bbb": 2}', '{"aaa": 1, "bbb": 1}', '{"aaa": "2", "bbb": "11"}', '{"aaa": 9, "bbb": 3}', '{"aaa": "x", "bbb": 1}', '{"ccc": "x"}', '{"ccc": 1}']
    rows = [(i, n, a, b) for i, (n, a, b) in enumerate((n, a, b) for n in ("fast", "slow", None, "ghost") for a in contexts[:4] for b in contexts)]
    df = spark.createDataFrame(rows, "i int, caveat_name string, caveat_context string, context string")
    got = {r["i"]: (r["code"], sorted(r["missing"]), r["err"] is not None) for r in caveats.attach(df, s).collect()}
    assert len(got) == len(rows)
    for i, n, a, b in rows:
        if n is None:
            want = (cel.TRUE, [], False)
        elif n == "ghost":
            want = (cel.OPEN, [], True)
        else:
            code, missing, err = cel.evaluate(cel.compile_caveat(s.caveats[n]), a, b)
            want = (code, missing, err is not None)
        assert got[i] == want, (n, a, b)


def test_stored_nulls_take_names_away():
    c = caveat({"a": "int"}, "a == 1")
    assert cel.evaluate(c, '{"a": null}', '{"a": 1}') == (cel.UNKNOWN_CODE, ["a"], None)
    assert cel.evaluate(c, '{"a": 1}', '{"a": null}')[0] == cel.TRUE and cel.evaluate(c, '{"a": 1}', '{"a": "x"}')[0] == cel.OPEN


FAST = (
    "iii > 3 ? sss == 'x' : bbb",
    "sss in ['x', 'yy', sss + 'z'] && !bbb",
    "iii + 1 > 0 || bbb",
    "iii * 4 / 3 % 5 == 1 && -iii < 7",
    "iii / (iii - 5) > 0 || sss.startsWith('x')",
    "sss.contains('y') || sss.endsWith('x') && size(sss) == 1",
    "ddd * 2.0 - 1.0 >= double(iii) || int(sss) == 12",
    "string(iii) + 'x' == '5x' || ddd == 1.5",
    "iii % (iii - 5) == 0 && sss != 'q'",
)


def test_wider_expressions_agree_in_both_evaluators(spark):
    types = {"iii": "int", "sss": "string", "bbb": "bool", "ddd": "double"}
    caveats_ = {f"c{i}": Caveat(f"c{i}", tuple((p, t) for p, t in types.items() if p in x), x) for i, x in enumerate(FAST)}
    schema = Schema(caveats=caveats_)
    assert all(cel.to_columns(cel.compile_caveat(c), "_", F.lit(False)) is not None for c in caveats_.values())
    values = {
        "iii": ["5", "5.0", "5e0", "5.5", '"5"', '"5.0"', '" 7 "', "9223372036854775807", "-9223372036854775808", "9223372036854775808", "null", "true", None],
        "sss": ['"x"', '"yy"', '"12"', "3", "null", None], "bbb": ["true", "false", '"true"', None], "ddd": ["1", "1.5", '"2e0"', '"x"', None],
    }
    contexts = [None, "", "{}", "{bad", "[]"]
    for i in range(26):
        parts = [f'"{k}": {v[(i * (7 + n) + n) % len(v)]}' for n, (k, v) in enumerate(values.items()) if v[(i * (7 + n) + n) % len(v)] is not None]
        contexts.append("{" + ", ".join(parts) + "}")
    contexts += [f'{{"iii": {v}, "sss": "x", "bbb": true, "ddd": 1}}' for v in values["iii"] if v]
    rows = [(i, n, a, b) for i, (n, a, b) in enumerate((n, a, b) for n in caveats_ for a in (None, '{"iii": null}', '{"sss": "q", "zzz": 1}', "{bad") for b in contexts)]
    df = spark.createDataFrame(rows, "i int, caveat_name string, caveat_context string, context string")
    got = {r["i"]: (r["code"], sorted(r["missing"]), r["err"] is not None) for r in caveats.attach(df, schema).collect()}
    for i, n, a, b in rows:
        code, missing, err = cel.evaluate(cel.compile_caveat(caveats_[n]), a, b)
        assert got[i] == (code, missing, err is not None), (FAST[int(n[1:])], a, b)


def test_no_caveats_in_schema(spark):
    df = spark.createDataFrame([(None,), ("x",)], "caveat_name string").withColumn("caveat_context", F.lit(None).cast("string")).withColumn("context", F.lit(""))
    assert sorted(r["code"] for r in caveats.attach(df, Schema()).collect()) == [cel.OPEN, cel.TRUE]
