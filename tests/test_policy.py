import hashlib

import pytest
from pyspark.sql import functions as F

from veil.functions import fakes
from veil.errors import PolicyError
from veil.functions.strategies import hashed, masked, partial_email, truncated
from veil.plans.nested import apply_nested, get_nested, matches, rewrite_json_text, set_nested
from veil.plans.policy import Policy, merge, validate


def people(spark):
    return spark.createDataFrame([("Ann", "ann@x.org", None), ("Ann", "bob@x.org", ""), ("Cy", "", "7")], "name string, email string, note string")


def test_mask_values(column):
    assert column(["1234567890"], lambda c: masked(c, "#", 2)) == ["########90"]
    assert column(["abcd", "é漢😀xy", "abcdef"], lambda c: masked(c, preserve_last=4)) == ["****", "*漢😀xy", "**cdef"]
    assert column(["abcd"], lambda c: masked(c, preserve_last=0)) == ["****"]
    with pytest.raises(ValueError):
        masked(F.col("v"), preserve_last=-1)


@pytest.mark.parametrize("name", ["sha256", "sha512", "sha384", "sha224", "md5", "sha1", "sha3_256", "blake2b"])
def test_hash_is_hashlib(column, name):
    got = column(["x", "é", None], lambda c: hashed(c, name, "s"))
    assert got == [hashlib.new(name, f"s:{v}".encode()).hexdigest() for v in "xé"] + [None]


def test_unknown_hash():
    with pytest.raises(ValueError):
        hashed(F.lit("x"), "sha9000")


def test_partial_email_and_truncate(column):
    assert column(["john.doe@x.org", "ab@x.org", "plain", "a@b@c.d"], partial_email) == ["j******e@x.org", "**@x.org", "**ain", "a*b@c.d"]
    assert column(["short", "much too long"], lambda c: truncated(c, 8)) == ["short", "much ..."]


def test_blank_values_stay(spark):
    config = {c: {"strategy": s} for c, s in (("name", "hash"), ("email", "mask"), ("note", "remove"))}
    got = Policy.of(config).apply(people(spark)).collect()
    assert got[2]["email"] == "" and got[0]["note"] is None and got[1]["note"] == "" and got[2]["note"] is None
    assert len(got[0]["name"]) == 64 and got[0]["name"] == got[1]["name"]


def test_replace_is_consistent_and_seeded(spark):
    config = {"name": {"strategy": "replace", "type": "name"}}
    a, b, c = (Policy.of(config, seed=s).apply(people(spark).repartition(n)).orderBy("email").collect() for s, n in ((1, 1), (1, 3), (2, 1)))
    assert a == b and a != c
    assert len({r["name"] for r in a}) == 2 and "Ann" not in {r["name"] for r in a}


def test_shared_domain_links_fields(spark):
    df = spark.createDataFrame([("Ann", "Ann")], "a string, b string")
    rule = {"strategy": "replace", "type": "full_name"}
    one, two = (Policy.of({"a": rule, "b": rule}, domain=d).apply(df).first() for d in ("people", "field"))
    assert one["a"] == one["b"] and two["a"] != two["b"]


def test_inconsistent_replacements_differ(spark):
    df = spark.range(20).select(F.lit("same").alias("v"))
    policy = Policy.of({"v": {"strategy": "replace", "type": "uuid"}}).configure(preserve_relationships=False)
    assert policy.apply(df).distinct().count() == 20


def test_unknown_strategy_and_field(spark):
    df = people(spark)
    assert Policy.of({"name": {"strategy": "shred"}, "none": {"strategy": "hash"}}).apply(df).collect() == df.collect()
    with pytest.raises(PolicyError):
        Policy.of({"name": {"strategy": "shred"}}, strict=True)
    assert len(validate({"a": 1, "b": {}, "c": {"strategy": "x"}, "d": {"strategy": "mask"}})) == 3
    assert validate([]) == ["policy must be a dictionary"]


def test_merge():
    assert merge({"a": {"x": 1, "y": 2}, "b": 1}, {"a": {"y": 3}, "c": 4}) == {"a": {"x": 1, "y": 3}, "b": 1, "c": 4}


def test_one_projection(spark):
    plan = Policy.of({c: {"strategy": "hash"} for c in ("name", "email", "note")}).apply(people(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 1 and "Exchange" not in plan


def test_nested_paths(spark):
    df = spark.createDataFrame([((("Ann", [("a@x.org", 1), (None, 2)]), ["t", "u"]),)], "doc struct<user: struct<name: string, mails: array<struct<mail: string, n: int>>>, tags: array<string>>")
    got = apply_nested(df, {"doc.user.mails[].mail": {"strategy": "hash"}, "doc.tags.*": {"strategy": "mask", "preserve_last": 0}, "doc.user.name": {"strategy": "remove"}}).first()["doc"]
    assert got["user"]["name"] is None and got["tags"] == ["*", "*"]
    assert [m["n"] for m in got["user"]["mails"]] == [1, 2] and got["user"]["mails"][1]["mail"] is None
    assert got["user"]["mails"][0]["mail"] == hashlib.sha256(b"a@x.org").hexdigest()


def test_path_modes():
    assert matches("users.*.name", "users.*.name") and not matches("users.*.address.name", "users.*.name")
    assert matches("users.*.address.name", "users.*.name", "fnmatch") and not matches("name", "*.name", "fnmatch")


def test_get_and_set_nested(spark):
    df = spark.createDataFrame([((1,),)], "a struct<b: int>")
    out = set_nested(set_nested(df, "a.c.d", F.lit("x")), "n.m", F.lit(2))
    assert out.select(get_nested("a.c.d"), get_nested("a.b"), get_nested("n.m")).first()[:] == ("x", 1, 2)


def test_json_texts_of_any_shape(column):
    texts = ['{"users": [{"name": "Ann"}, {"name": null, "x": 1}], "n": 1.5}', '{"users": {"a": {"name": 7}}}', "no json", None]
    got = column(texts, lambda c: rewrite_json_text(c, {"users.*.name": {"strategy": "mask", "preserve_last": 1}}))
    assert got == ['{"users": [{"name": "**n"}, {"name": null, "x": 1}], "n": 1.5}', '{"users": {"a": {"name": "*"}}}', "no json", None]
    made = column(['{"a": "Ann"}'], lambda c: rewrite_json_text(c, {"a": {"strategy": "replace"}}))[0]
    assert made.startswith('{"a": "anon_')


def test_replacements_differ_from_the_value(column):
    for kind, pool in (("city", fakes.CITIES), ("last_name", fakes.LAST), ("first_name", fakes.FIRST), ("job_title", fakes.JOBS), ("country", fakes.COUNTRIES), ("tld", fakes.TLDS)):
        assert all(a != b for a, b in zip(pool, column(list(pool), lambda c, k=kind: fakes.fake(k, 0, k, c)), strict=True))
    names = [f"{a} {b}" for a in fakes.FIRST for b in fakes.LAST]
    assert all(a != b for a, b in zip(names, column(names, lambda c: fakes.fake("name", 0, "name", c)), strict=True))
