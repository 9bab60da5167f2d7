"""Routing: the first rule whose source and type globs both match names the queue.

A rule list is turned into one conditional expression at plan time, so routing is a
narrow projection whatever the size of the log.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meetledger import schemas as S
from meetledger.functions.globs import glob_match, glob_regex, literal_runs


@dataclass(frozen=True)
class Rule:
    destination: str
    source_pattern: str = "*"
    type_pattern: str = "*"


# fixed values: the default rules, in order of precedence
DEFAULT_RULES = [
    Rule("events.booking.lifecycle", "*", S.BOOKING_CREATED),
    Rule("events.booking.lifecycle", "*", "booking.rescheduled"),
    Rule("events.booking.lifecycle", "*", S.BOOKING_REASSIGNED),
    Rule("events.booking.lifecycle", "*", S.BOOKING_CANCELLED),
    Rule("events.booking.lifecycle", "*", S.BOOKING_REMINDER_SENT),
    Rule("events.booking.reminder", "*", "booking.reminder_sent"),
    Rule("events.chat.lifecycle", "*", "chat.created"),
    Rule("events.chat.lifecycle", "*", "chat.deleted"),
    Rule("events.chat.activity", "*", "chat.message_sent"),
    Rule("events.meeting.lifecycle", "*", S.MEETING_URL_CREATED),
    Rule("events.meeting.lifecycle", "*", S.MEETING_URL_DELETED),
    Rule("events.notification.delivery", "*", S.EMAIL_SENT),
    Rule("events.notification.delivery", "*", S.TELEGRAM_SENT),
    Rule("events.jitsi", "jitsi*", "*"),
    Rule("events.mail", "unisender-go", S.MAIL_STATUS),
    Rule("events.chat", "getstream", "getstream.*"),
]

def rule_predicate(rule: Rule, source: Column, event_type: Column) -> Column:
    tests = [glob_match(source, rule.source_pattern), glob_match(event_type, rule.type_pattern)]
    return reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True))


def destination(source: Column, event_type: Column, rules: Sequence[Rule] = DEFAULT_RULES, default: str = S.QUEUE_DEFAULT) -> Column:
    if not rules:
        return F.lit(default)
    chain = F
    for rule in rules:
        chain = chain.when(rule_predicate(rule, source, event_type), F.lit(rule.destination))
    return chain.otherwise(F.lit(default))


def route(events: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, default: str = S.QUEUE_DEFAULT, column: str = "routing_key") -> DataFrame:
    return events.withColumn(column, destination(F.col("source"), F.col("event_type"), rules, default))


GRAM = 3  # characters of the fragment that a pattern rule is filed under


def _grams(side: str) -> Column:
    """All fragments of a name, marked with its side."""
    starts = F.sequence(F.lit(1), F.length(side) - GRAM + 1)
    cut = F.transform(starts, lambda i: F.concat(F.lit(f"{side}:"), F.substring(F.col(side), i, F.lit(GRAM))))
    return F.when(F.length(side) >= GRAM, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _compile_rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Patterns as regular expressions, and the fragment of each rule that has one.

    Of the longest plain stretch the end is taken, as names of one family begin alike.
    """
    for batch in batches:
        for side in ("source", "type"):
            batch[f"{side}_regex"] = batch[f"{side}_pattern"].map(glob_regex)
        fragments = []
        for rule in batch.itertuples(index=False):
            runs = [(len(r), side, r[-GRAM:]) for side, pattern in (("event_type", rule.type_pattern), ("source", rule.source_pattern)) for r in literal_runs(pattern)]
            length, side, fragment = max(runs, default=(0, "", ""))
            fragments.append(f"{side}:{fragment}" if length >= GRAM else None)
        yield batch.assign(fragment=fragments)


def route_by_table(events: DataFrame, rules: DataFrame, default: str = S.QUEUE_DEFAULT, column: str = "routing_key") -> DataFrame:
    """Route by rules kept as a table (rule_no, destination, source_pattern, type_pattern), however many.

    Only the distinct (source, type) pairs of the log meet the rules: those with plain type
    names by the name, the others through a fragment of their plain characters, which a
    name must hold to match. Only rules without such a fragment (``*``, ``a?c``) are tried
    on every pair. The first rule of a pair is then joined back to the events.
    """
    schema = "rule_no long, destination string, source_pattern string, type_pattern string"
    read = rules.select(F.col("rule_no").cast("long"), "destination", "source_pattern", "type_pattern")
    compiled = read.mapInPandas(_compile_rules, f"{schema}, source_regex string, type_regex string, fragment string")
    plain = ~F.col("type_pattern").rlike(r"[*?\[]")
    pairs = events.select("source", "event_type").where(F.col("source").isNotNull() & F.col("event_type").isNotNull()).distinct()
    source_fits, type_fits = F.regexp_like("source", F.col("source_regex")), F.regexp_like("event_type", F.col("type_regex"))
    by_name = pairs.join(compiled.where(plain), F.col("event_type") == F.col("type_pattern")).where(source_fits)
    filed = compiled.where(~plain & F.col("fragment").isNotNull())
    spread = pairs.select("source", "event_type", F.explode(F.concat(_grams("event_type"), _grams("source"))).alias("fragment"))
    by_fragment = spread.join(filed, "fragment").where(source_fits & type_fits)
    by_pattern = pairs.join(compiled.where(~plain & F.col("fragment").isNull()), source_fits & type_fits)
    parts = [p.select("source", "event_type", "rule_no", "destination") for p in (by_name, by_fragment, by_pattern)]
    first = reduce(DataFrame.union, parts).groupBy("source", "event_type").agg(F.min(F.struct("rule_no", "destination")).alias("_rule"))
    routed = events.join(first, ["source", "event_type"], "left").withColumn(column, F.coalesce("_rule.destination", F.lit(default)))
    return routed.select(*[c for c in events.columns if c != column], column)


def destinations(spark: SparkSession, rules: Sequence[Rule] = DEFAULT_RULES, default: str = S.QUEUE_DEFAULT) -> DataFrame:
    """Every queue that the rules can name, and the default."""
    names = [(r.destination,) for r in rules]
    return spark.createDataFrame([*names, (default,)], "destination string").distinct()


def effective_queues(rules: Sequence[Rule] = DEFAULT_RULES, default: str = S.QUEUE_DEFAULT, explicit: Sequence[str] = ()) -> list[str]:
    """The queues to read: the explicit list, else every destination."""
    return sorted(set(explicit) or {default, *(r.destination for r in rules)})
