"""Column functions on small frames."""

import fnmatch
import hashlib
import json
import random
import re
from datetime import datetime, timezone

import pytest

from meetledger.functions import hashing, times
from meetledger.functions import json_fields as J
from meetledger.functions.globs import glob_match
from meetledger.operators import classify
from meetledger.sources.messages import payload_or_empty
from meetledger.operators.routing import DEFAULT_RULES, Rule, destination, destinations, effective_queues, route_by_table
from pyspark.sql import functions as F


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


NAMES = ["", "a", "abc", "a.c", "axc", "jitsi", "jitsi-eu", "Jitsi", "a+c", "a(c", "[x]", "x]", "a\nb", "b", "-", "!", "^", "a*c", "a[c", "é", "[]", "[!]", "[]x", "x[]"]
PATTERNS = ["*", "a*", "a?c", "[ab]*", "[!a]*", "a.c", "a+c", "a(c", "jitsi*", "[[]x]", "[]]", "*]", "a\n*", "[a-c]", "[!a-c]", "[-a]", "a[[]c", "a[c", "[^a]", "**c", "?", "[z-a]", "[]", "[!]", "[]*", "[!]*", "[!]a]", "x[]"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_globs_match_like_shell_patterns(spark, pattern):
    got = column(spark, NAMES, lambda c: F.lit(True) if glob_match(c, pattern) is None else glob_match(c, pattern))
    assert got == [fnmatch.fnmatchcase(n, pattern) for n in NAMES]


TIMES = [
    "2026-03-08T06:00:00Z",
    "2026-03-08T06:00:00+03:00",
    "2026-03-08T06:00:00.5-01:30",
    "2026-03-08 06:00:00.123456789",
    "2026-03-08T06:00",
    "2026-03-08T06:00Z",
    "2026-03-08T06",
    "2026-03-08",
    "20260308",
    "20260308T060000",
    "20260308T0600Z",
    "2026-03-08T06:00:00+0300",
    "2026-03-08T06:00:00+03",
    "2026-03-08T06:00:00,25Z",
    "2026-13-08",
    "2026-02-30",
    "2026",
    "2026-3-8",
    "soon",
    "",
    " 2026-03-08",
    "2026-03-08T06:00:00Z extra",
]


def test_iso_times_read_like_python(spark):
    def python(value):
        try:
            parsed = datetime.fromisoformat(value)
        except ValueError:
            return None
        parsed = parsed if parsed.tzinfo else parsed.replace(tzinfo=timezone.utc)
        return parsed.astimezone(timezone.utc).replace(tzinfo=None)

    assert column(spark, TIMES, times.iso_timestamp) == [python(t) for t in TIMES]


def test_typed_reads(spark):
    docs = ['{"a": "x"}', '{"a": 5}', '{"a": true}', '{"a": null}', '{"a": ""}', '{"a": {"b": 1}}', '{"a": ["x"]}', "[1]", "{", "{}", '{"a": 0}', '{"a": 0.0}', '{"a": []}']
    doc = lambda c: J.parse(c)
    assert column(spark, docs, lambda c: J.text(doc(c), "$.a")) == ["x", None, None, None, "", *[None] * 8]
    assert column(spark, docs, lambda c: J.is_object(doc(c), "$.a")) == [i == 5 for i in range(13)]
    assert column(spark, docs, lambda c: J.is_array(doc(c), "$.a")) == [i in (6, 12) for i in range(13)]
    assert column(spark, docs, lambda c: J.is_present(doc(c), "$.a")) == [i in (0, 1, 2, 4, 5, 6, 10, 11, 12) for i in range(13)]
    assert column(spark, docs, lambda c: J.is_truthy(doc(c), "$.a")) == [i in (0, 1, 2, 5, 6) for i in range(13)]
    assert column(spark, ['{"a": "x", "a": "y"}'], lambda c: J.text(doc(c), "$.a")) == ["y"]


def test_payload_hash_forms(spark):
    bodies = ['{ "b" : [1,  2], "a": "x \\" y  z" }', '{"b":[1,2],"a":"x \\" y  z"}', "not json"]
    compact = ['{"b":[1,2],"a":"x \\" y  z"}'] * 2 + ["notjson"]
    canonical = ['{"a":"x \\" y  z","b":[1,2]}'] * 2 + ["not json"]
    md5 = lambda texts: [hashlib.md5(t.encode()).hexdigest() for t in texts]
    assert column(spark, bodies, lambda c: hashing.payload_hash(c)) == md5(bodies)
    assert column(spark, bodies, lambda c: hashing.payload_hash(c, "compact")) == md5(compact)
    assert column(spark, bodies, lambda c: hashing.payload_hash(c, "canonical")) == md5(canonical)
    # a long text literal is no problem for the pattern
    long = json.dumps({"t": 'é" ' * 50_000})
    assert column(spark, [long], hashing.compact_json) == [json.dumps({"t": 'é" ' * 50_000}, separators=(",", ":"))]


def test_live_json_is_what_reading_and_writing_gives(spark):
    rng = random.Random(11)
    chars = ["a", " ", "/", '"', "\\", "\n", "\t", "\x01", "é", "漢", "😀", "u0041", "1.50", "{", ":"]
    reals = [0.0, 1.5, -2.25, 1e-4, 1.25e-5, 123456.75, 1e7, 12345678.5, 9007199254740992.0, 1e16, 2.5e-300, -1e22]

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind == 0:
            return "".join(rng.choice(chars) for _ in range(rng.randrange(9)))
        if kind < 4:
            return rng.choice([None, True, False, 0, -7, 2**70, *reals])
        if kind == 4:
            return rng.choice([[], {}])
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {f"{rng.choice(chars)}{i}": value(depth - 1) for i in range(rng.randrange(4))}

    def exponents(text):
        # the service writes exponents without leading zeros
        return re.sub(r"e([+-])0+(?=[1-9])", r"e\1", text)

    def coded(text):
        # every character of a literal as a coded unit, / and all
        units = lambda s: "".join(f"\\u{s.encode('utf-16-be')[i]:02X}{s.encode('utf-16-be')[i + 1]:02x}" for i in range(0, len(s.encode("utf-16-be")), 2))
        return '"' + units(text) + '"'

    docs = [value(3) for _ in range(400)]
    expected = [exponents(json.dumps(d, separators=(",", ":")).replace("/", "\\/")) for d in docs]
    assert column(spark, [json.dumps(d) for d in docs], hashing.live_json) == expected
    assert column(spark, [json.dumps(d, indent=2, ensure_ascii=False) for d in docs], hashing.live_json) == expected
    texts = ["".join(rng.choice(chars) for _ in range(12)) for _ in range(50)]
    assert column(spark, [coded(t) for t in texts], hashing.live_json) == [json.dumps(t).replace("/", "\\/") for t in texts]
    assert column(spark, ["1.50", "15e-1", "1E2", "-0", "1e400", "", None, "not json"], hashing.live_json) == [
        "1.5", "1.5", "100.0", "0", "1e400", "", None, "notjson",
    ]
    long = json.dumps({"t": 'é" /' * 30_000})
    assert column(spark, [long], hashing.live_json) == [json.dumps({"t": 'é" /' * 30_000}, separators=(",", ":")).replace("/", "\\/")]


def test_empty_bodies_however_written(spark):
    empty = ["", " ", None, "null", "[ ]", "{\n}", " {} ", "0.0", "-0", "0e5", "false", '""']
    full = ["[0]", '{"a":0}', "true", "1", '" "', "0.01", "x"]
    assert column(spark, empty, payload_or_empty) == ["{}"] * len(empty)
    assert column(spark, full, payload_or_empty) == full


def test_idempotency_key_ignores_blanks_and_key_order(spark):
    keys = column(spark, ['{"a":1,"b":2}', '{ "b": 2, "a": 1 }', '{"a":1,"b":3}'], lambda c: hashing.idempotency_key(F.lit("t"), F.lit("b"), c))
    assert keys[0] == keys[1] != keys[2]
    assert keys[0] == hashlib.sha256(b't:b:{"a":1,"b":2}').hexdigest()


def test_user_id_codec(spark):
    names = ["a@x.org", "someone.with.a.long.name@example.org", "é", ""]
    sealed = column(spark, names, lambda c: hashing.encode_user_id(c, "s"))
    assert all("=" not in s and "+" not in s and "/" not in s for s in sealed)
    assert column(spark, sealed, lambda c: hashing.decode_user_id(c, "s")) == names
    assert column(spark, sealed, lambda c: hashing.decode_user_id(c, None)) == sealed
    odd = ["plain", "a@x.org", "%%%", "QUJD", "", None]
    assert column(spark, odd, lambda c: hashing.decode_user_id(c, "s")) == odd


def test_actions(spark):
    cases = [
        # queue, source, type, payload type -> action
        ("events.chat", "x", "a.v1.b.create", "typing", "typing"),
        ("events.chat", "x", "a.v1.b.create", "", "b"),
        ("events.jitsi", "jitsi", "jitsi.events.v1.joined.create", "typing", "joined"),
        ("events.jitsi", "jitsi", "jitsi.events.v1.create", None, "jitsi.events.v1.create"),
        ("other", "getstream", "getstream.events.v1.message.new.create", "message.new", "message.new"),
        ("other", "getstream", "getstream.events.v1.message.new.create", None, "message.new"),
        ("other", "booking", "booking.events.v1.a.v1.b.create", None, "a.v1.b"),
        ("other", "booking", "a.v1.x.create.create", None, "x.create"),
        ("other", "booking", "a.v1.create", None, "create"),
        ("other", "booking", "booking.created", None, "booking.created"),
        (None, "booking", "booking.v1.created", None, "booking.v1.created"),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, q string, s string, t string, p string, expected string")
    rows = df.select("i", "expected", classify.action(F.col("q"), F.col("s"), F.col("t"), F.col("p")).alias("got")).orderBy("i").collect()
    assert [r["got"] for r in rows] == [r["expected"] for r in rows]


def test_first_rule_wins(spark):
    rules = [Rule("one", "a*", "x"), Rule("two", "*", "x*"), Rule("three", "a", "*")]
    df = spark.createDataFrame([("ab", "x"), ("b", "xy"), ("a", "z"), ("b", "z")], "source string, event_type string")
    assert [r[0] for r in df.select(destination(F.col("source"), F.col("event_type"), rules, "none")).collect()] == ["one", "two", "three", "none"]
    table = spark.createDataFrame([(2, "two", "*", "x*"), (1, "one", "a*", "x"), (3, "three", "a", "*")], "rule_no int, destination string, source_pattern string, type_pattern string")
    routed = route_by_table(df.unionByName(spark.createDataFrame([(None, "x"), ("b", "z")], df.schema)), table, "none")
    assert sorted(r["routing_key"] for r in routed.collect()) == ["none", "none", "none", "one", "three", "two"]
    assert routed.columns == ["source", "event_type", "routing_key"]
    assert {r[0] for r in destinations(spark, rules, "none").collect()} == {"one", "two", "three", "none"}
    assert effective_queues(rules, "none") == ["none", "one", "three", "two"]
    assert effective_queues(rules, "none", ["only"]) == ["only"]
    assert len(effective_queues(DEFAULT_RULES)) == 10
