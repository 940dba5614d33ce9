import pytest

from veridex.plans import analysis
from veridex.plans.compile import compile_member, monotone
from veridex.plans.schema import Arrow, Ref, SchemaError, SetOp, parse, validate
from veridex.world import CAVEAT_TEXT, SCHEMA_TEXT

HEAD = "definition user {}\n"


def perm(text):
    return parse(HEAD + "definition document { relation aaa: user relation bbb: user relation ccc: user relation ddd: document permission view = " + text + " }").member("document", "view").expr


def test_precedence():
    a, b, c = Ref("aaa"), Ref("bbb"), Ref("ccc")
    assert perm("aaa & bbb + ccc") == SetOp("intersection", (a, SetOp("union", (b, c))))
    assert perm("aaa - bbb & ccc") == SetOp("exclusion", (a, SetOp("intersection", (b, c))))
    assert perm("aaa - bbb - ccc") == SetOp("exclusion", (SetOp("exclusion", (a, b)), c))
    assert perm("aaa + (bbb + ccc)") == SetOp("union", (a, b, c))
    assert perm("ddd.all(view) + ddd->view") == SetOp("union", (Arrow("ddd", "view", True), Arrow("ddd", "view")))


@pytest.mark.parametrize("text", [
    "definition document { permission view = view }",
    "definition document { permission view = nothing }",
    "definition document { relation aaa: nobody }",
    "definition document { relation aaa: user#nothing }",
    "definition document { relation aaa: user | user }",
    "definition document { relation aaa: user with nothing }",
    "definition document { relation aaa: user with expiration }",
    "definition document { relation aaa: user:* permission view = aaa->view }",
    "definition document { relation aaa: user permission bbb = aaa permission view = bbb->view }",
    "definition group { relation member: user:* } definition document { relation aaa: group#member }",
    "caveat unused(aaa int, bbb int) { aaa == 1 }",
    "caveat wrong(aaa int) { aaa + 1 }",
    "caveat mixed(aaa int) { aaa == 'x' }",
    "caveat odd(aaa list) { aaa == [1] }",
    "definition ab { relation aaa: user }",
])
def test_type_rules(text):
    with pytest.raises((SchemaError, ValueError)):
        validate(parse(HEAD + text))


@pytest.mark.parametrize("text", ["definition x", "definition x { relation }", "definition document { permission view = a->b->c }", "definition document { relation aaa: user with a and b }", "what", HEAD + HEAD])
def test_syntax_errors(text):
    with pytest.raises(SchemaError):
        parse(text)


def test_worlds_are_valid_and_hash_ignores_order_and_comments():
    for text in (SCHEMA_TEXT, CAVEAT_TEXT):
        validate(parse(text))
    a = parse(HEAD + "// note\ndefinition document { relation aaa: user relation bbb: user }")
    b = parse("definition document { relation bbb: user relation aaa: user }" + HEAD)
    assert analysis.schema_hash(a) == analysis.schema_hash(b)
    assert analysis.schema_hash(a) != analysis.schema_hash(parse(HEAD))
    assert a.definitions["document"].comment == "// note"


def test_plans():
    s = parse(SCHEMA_TEXT)
    plan = compile_member(s, "order", "view")
    assert [x.kind for x in plan.leaves if x.kind != "ident"] == ["this", "this", "any", "this"]
    assert not monotone(plan) and monotone(compile_member(s, "nation", "view"))
    assert ("nation", "view") in analysis.flattened(s) and ("order", "view") not in analysis.flattened(s)
    assert ("order", "edit") in analysis.computable_permissions(s, "user")


def test_terminators_and_typed_permissions():
    got = parse("definition user {}; definition org { relation member: user; permission view: user | org#member = member; };")
    assert got == parse("definition user {} definition org { relation member: user permission view = member }")
