"""What the mail and booking queries store on their way, how much one task reads, and odd participants."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meetledger import session
from meetledger.operators import extract
from meetledger.plans.normalize import normalize
from table_queries import adapters
from table_queries import queries as Q

AT = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    orders = [(n, n % 3, "OFP"[n % 3], f"{n % 5 + 1}-X", AT) for n in range(30)]
    items = [(n, n % 3, n % 4, n % 3, "R", "O", AT) for n in range(30) for _ in range(2)]
    spark.createDataFrame(
        orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate timestamp"
    ).coalesce(1).write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(
        items, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    ).coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_only_the_facts_that_are_read_are_stored(spark, small):
    rows = Q.QUERIES["email_status_events"](spark, small)
    assert rows.count() == 60
    assert set(spark.read.parquet(*rows.inputFiles()).columns) == set(Q.STATUSES)


def test_the_payload_of_a_log_does_not_move(spark, small):
    plan = adapters.mail_log(spark, small)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert not any("payload_json" in line or "event_id" in line for line in moved)
    assert "mail_log" not in plan  # built where it is read, not stored first


def test_a_task_reads_little_but_a_smaller_setting_stays(spark):
    old = {key: spark.conf.get(key) for key in session.TASK_CONF}
    try:
        for before, after in (("128MB", session.TASK_BYTES), ("1g", session.TASK_BYTES), ("8m", 8 << 20), ("4096", 4096)):
            for key in session.TASK_CONF:
                spark.conf.set(key, before)
            session.prepare(spark)
            assert {session._bytes(spark.conf.get(key)) for key in session.TASK_CONF} == {after}
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)


def test_odd_participants(spark):
    texts = [
        '{"normalized":{"participants":[{"email":"a","role":1},{"email":""},{"email":2},"x",null,[1],{"role":"client"},{"email":"b","role":null,"time_zone":"UTC"}]}}',
        '{"normalized":{"participants":{"email":"a"}}}',
        '{"normalized":[]}',
    ]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = rows.select("n", extract.participants(F.try_parse_json("t")).alias("p")).orderBy("n").collect()
    assert [[tuple(p) for p in r.p] for r in got] == [[("a", None, None), ("b", None, "UTC")], [], []]


def test_normalized_people_keep_their_order(spark):
    columns = "event_id string, event_type string, source string, payload_json string"
    texts = ['{"user":{"email":"o"},"client":{"email":"c"}}', '{"client":{"email":"c"}}', '{"user":{"email":7}}']
    rows = normalize(spark.createDataFrame([(str(n), "x", "booking", t) for n, t in enumerate(texts)], columns))
    got = rows.select("event_id", extract.participants(F.try_parse_json("payload_json")).alias("p")).orderBy("event_id").collect()
    assert [[(p.email, p.role) for p in r.p] for r in got] == [[("o", "organizer"), ("c", "client")], [("c", "client")], []]
