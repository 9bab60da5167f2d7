"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads. The logs that the adapters
derive from the tables are written first and timed on their own; each query is then run
once, in full, into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meetledger.session import create_session  # noqa: E402
from table_queries import adapters  # noqa: E402
from table_queries.queries import QUERIES  # noqa: E402

HEADLINE = [
    "decode_messages",
    "route_counts",
    "dedup_both",
    "dedup_incremental",
    "participants_upsert",
    "bookings_upsert",
    "organizer_history",
    "meeting_links",
    "email_notifications",
    "email_status_history",
    "telegram_notifications",
    "chat_read_state",
    "event_chat",
    "video_events",
    "timeline_topk",
    "orphans",
    "event_metrics",
    "pipeline_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = create_session(
        "meetledger-bench",
        master=f"local[{cpus}]",
        conf={
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    start = time.time()
    adapters.event_log(spark, sf_dir)
    adapters.event_headers(spark, sf_dir)
    adapters.order_log(spark, sf_dir)
    adapters.order_log(spark, sf_dir, late=True)
    adapters.mail_log(spark, sf_dir)
    adapters.conversation_log(spark, sf_dir)
    prepare = round(time.time() - start, 3)

    for name in HEADLINE if len(sys.argv) < 2 else sys.argv[1:]:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "prepare_logs_sec": prepare,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
