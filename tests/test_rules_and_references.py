"""Rules found through their fragments, and references checked in one pass, against the plain ways."""

import random

from pyspark.sql import functions as F

from meetledger.functions.globs import literal_runs
from meetledger.operators import integrity
from meetledger.operators.integrity import Reference
from meetledger.operators.routing import Rule, route, route_by_table


def test_literal_runs():
    assert literal_runs("booking.*.v1?x") == ["booking.", ".v1", "x"]
    assert literal_runs("[ab]cd[!e]*") == ["cd"] and literal_runs("*") == [] and literal_runs("a[") == ["a["]


def test_rule_table_as_by_the_rule_list(spark):
    rng = random.Random(5)
    parts = ["*", "?", "[ab]", "[!c]*", "a", "b.", "ab.c", "booking", ".v1.", "x"]
    rules = [Rule(f"q{i}", "".join(rng.choices(parts, k=rng.randint(1, 3))), "".join(rng.choices(parts, k=rng.randint(1, 5)))) for i in range(60)]
    names = ["".join(rng.choices(["a", "b", "c", "b.", "ab.c", "booking", ".v1.", "x"], k=rng.randint(0, 6))) for _ in range(400)]
    events = spark.createDataFrame([(rng.choice(names), rng.choice(names)) for _ in range(900)], "source string, event_type string")
    table = spark.createDataFrame([(i, r.destination, r.source_pattern, r.type_pattern) for i, r in enumerate(rules)], "rule_no long, destination string, source_pattern string, type_pattern string")
    got = route_by_table(events, table, "rest").groupBy("source", "event_type", "routing_key").count().collect()
    expected = route(events, rules, "rest").groupBy("source", "event_type", "routing_key").count().collect()
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    assert len({r["routing_key"] for r in got}) > 5


def test_only_rules_without_a_fragment_meet_every_pair(spark):
    events = spark.createDataFrame([("s", "booking.created")], "source string, event_type string")
    table = spark.createDataFrame([(1, "q", "*", "*created"), (2, "r", "*", "*")], "rule_no long, destination string, source_pattern string, type_pattern string")
    plan = route_by_table(events, table)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    crossing = [line for line in joins if "regexp_like" in line.lower() or "rlike" in line.lower()]
    assert len([j for j in joins if "fragment" in j]) >= 1 and all("Inner" in j for j in crossing)
    by_fragment = next(j for j in joins if "fragment" in j)
    assert "fragment#" in by_fragment and "=" in by_fragment


def test_one_pass_as_by_single_references(spark):
    rng = random.Random(9)
    pick = lambda n: rng.choice([None, *range(n)])
    tables = {
        "a": spark.createDataFrame([(i, pick(40), pick(9)) for i in range(30)], "id int, b_id int, c_id int"),
        "b": spark.createDataFrame([(pick(25), pick(60)) for _ in range(50)], "id int, a_id int"),
        "c": spark.createDataFrame([(str(i),) for i in range(5)] * 2, "id string"),
    }
    references = [Reference("a", "b_id", "b", "id"), Reference("a", "c_id", "c", "id"), Reference("b", "a_id", "a", "id"), Reference("b", "id", "b", "a_id"), Reference("a", "id", "none", "id")]
    got = integrity.orphan_report(tables, references)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    expected = set()
    for r in references[:-1]:
        typed = tables[r.parent].select(F.col(r.parent_column).cast("int").alias(r.parent_column))
        for row in integrity.orphans(tables[r.child], r.column, typed, r.parent_column).collect():
            expected.add((r.child, r.column, r.parent, str(row["missing"]), row["rows"]))
    assert {(r["child"], r["column"], r["parent"], r["missing"], r["rows"]) for r in got.collect()} == expected and expected
