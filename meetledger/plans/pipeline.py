"""The whole ingest as one batch plan: messages in, clean tables out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetledger.operators import classify, dedup, entities, extract, projections
from meetledger.plans.registry import Context, Registry
from meetledger.session import materialize
from meetledger.sources.messages import decode_messages, rejected_messages, valid_envelopes


@dataclass
class Result:
    tables: dict[str, DataFrame]
    rejects: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


Keep = Callable[[DataFrame, str], DataFrame]


def as_is(frame: DataFrame, name: str) -> DataFrame:
    return frame


def entity_tables(facts: DataFrame, keep: Keep = as_is) -> dict[str, DataFrame]:
    """``keep`` stores a frame that is read several times, or passes it through."""
    participants = keep(entities.participants(facts), "participants")
    bookings = keep(entities.bookings(facts), "bookings")
    history = entities.organizer_history(keep(entities.organizer_candidates(facts, bookings), "candidates"))
    return {"participants": participants, "bookings": bookings, "organizer_history": history}


def projection_tables(facts: DataFrame, participants: DataFrame, keep: Keep = as_is) -> dict[str, DataFrame]:
    chat = keep(projections.chat_events(facts, participants), "chat")
    reads = keep(projections.chat_reads(facts, participants), "reads")
    return {
        "meeting_links": projections.meeting_links(facts),
        "email_notifications": projections.email_notifications(facts, participants),
        "telegram_notifications": projections.telegram_notifications(facts, participants),
        "email_status_history": projections.email_status_history(facts),
        "chat_events": projections.apply_reads(chat, reads),
        "video_events": projections.video_events(facts),
    }


def build_tables(log: DataFrame, facts: DataFrame, registry: Registry | None = None, persist: bool = True) -> dict[str, DataFrame]:
    """Entities and projections from a deduplicated log and its facts."""
    keep = materialize if persist else as_is
    tables = entity_tables(facts, keep)
    tables.update(projection_tables(facts, tables["participants"], keep))
    if registry:
        tables.update(registry.run(Context(log, facts, tables["participants"], tables["bookings"])))
    return tables


def run(
    envelopes: DataFrame,
    secret: str | None = None,
    registry: Registry | None = None,
    legacy_scope: str = "all",
    persist: bool = True,
    classifier: extract.Classifier = classify.action,
    decoder: Callable[[Column], Column] | None = None,
) -> Result:
    """All tables of a set of envelopes.

    With ``persist`` whatever several tables read (the log, the facts, participants and
    the like) is written once to the shared folder; the payload is parsed once.
    """
    keep = materialize if persist else as_is
    log, conflicts = dedup.accept(envelopes, legacy_scope, keep)
    facts = keep(extract.extract_facts(log, secret, classifier, decoder), "facts")
    tables = {"events": log, **build_tables(log, facts, registry, persist)}
    rejects = {"event_id_conflicts": conflicts, "projections": extract.projection_rejects(facts)}
    return Result(tables, rejects)


def run_messages(messages: DataFrame, hash_mode: str = "live", unwrap_original: bool = False, **options) -> Result:
    """The same from raw messages; unreadable ones end up among the rejects."""
    decoded = decode_messages(messages, hash_mode, unwrap_original)
    result = run(valid_envelopes(decoded), **options)
    result.rejects["messages"] = rejected_messages(decoded)
    return result


def replay(log: DataFrame, since: Column | str, until: Column | str, **options) -> Result:
    """Rebuild from the part of a stored log that was received in [since, until)."""
    start = F.lit(since).cast("timestamp") if isinstance(since, str) else since
    end = F.lit(until).cast("timestamp") if isinstance(until, str) else until
    return run(log.filter((F.col("received_at") >= start) & (F.col("received_at") < end)), **options)
