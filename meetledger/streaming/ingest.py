"""Continuous ingest: every micro-batch adds to a table store.

A batch is decoded once, its claims (keys, contents, ids) meet the stored ones, the rows that
share one are deduplicated, and the rest is appended as it is. The claims of a small batch, and
the participants a batch names, are looked up in buckets, so a small batch does not read the history. Beside the
log each batch appends its *partial folds*: what the batch alone says about
participants, bookings, mails and so on. Reading merges the partials with the aggregate
that made them, so a batch never rewrites a table, and the result is the same for any
cut of the log into batches that keeps arrival order. Late data is always accepted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meetledger.operators import classify, dedup, entities, extract, projections
from meetledger.operators.folds import Fold
from meetledger.plans.registry import Context, Registry
from meetledger.session import Scratch, as_stream, materialize, prepare
from meetledger.sources.key_index import TABLE as CLAIMS
from meetledger.sources.key_index import KeyIndex
from meetledger.sources.messages import decode_messages, rejected_messages, valid_envelopes
from meetledger.sources.tables import Commit, TableStore

FOLDS: dict[str, Callable[[], Fold]] = {
    "participants": entities.participant_fold,
    "bookings": entities.booking_fold,
    "meeting_links": projections.meeting_fold,
    "email_notifications": projections.email_fold,
    "email_status_history": projections.status_fold,
    "telegram_notifications": projections.telegram_fold,
}


class StreamIngest:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        secret: str | None = None,
        hash_mode: str = "live",
        compact_every: int | None = None,
        classifier: extract.Classifier = classify.action,
        decoder: Callable[[Column], Column] | None = None,
        registry: Registry | None = None,
    ) -> None:
        """The folded projections of ``registry`` are kept beside the built-in tables."""
        self.registry = registry or Registry()
        self.classifier, self.decoder = classifier, decoder
        self.spark = prepare(spark)
        self.store = TableStore(spark, root)
        self.index = KeyIndex(self.store, log="events")
        self.secret = secret
        self.hash_mode = hash_mode
        self.compact_every = compact_every

    # --- running ---

    def start(self, messages: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Run on a message stream, e.g. with ``availableNow=True`` or ``processingTime="1 minute"``."""
        writer = messages.writeStream.foreachBatch(self._on_batch).option("checkpointLocation", checkpoint)
        with as_stream(self.spark):
            return writer.trigger(**(trigger or {"availableNow": True})).start()

    def _on_batch(self, messages: DataFrame, batch: int) -> None:
        session = messages.sparkSession
        prepare(session)
        # the id of the query outlives restarts from its checkpoint
        source = session.sparkContext.getLocalProperty("sql.streaming.queryId")
        self.ingest(messages, source, batch)

    def ingest(self, messages: DataFrame, source: str | None = None, batch: int | None = None) -> int | None:
        """One batch of messages; returns the commit, or None for a batch that was stored before."""
        commit = self.store.begin(source, batch)
        if commit is None:
            return None
        with as_stream(self.spark, messages.sparkSession):
            return self._store(commit, messages)

    def _store(self, commit: Commit, messages: DataFrame) -> int:
        with Scratch(self.spark) as scratch:
            decoded = decode_messages(messages, self.hash_mode)
            # read once for all that follows; the body beside its payload is kept for messages that are rejected
            decoded = scratch.keep(decoded.withColumn("body", F.when(F.col("reject_reason").isNotNull(), F.col("body"))), "decoded")
            commit.append("rejected_messages", rejected_messages(decoded))
            log = self._append_log(commit, valid_envelopes(decoded), scratch.keep)
        facts = commit.append("facts", extract.extract_facts(log, self.secret, self.classifier, self.decoder))
        self._append_tables(commit, facts)
        for name, partial in self.registry.partials(log).items():
            commit.append(name, partial)
        number = commit.publish()
        if self.compact_every and number % self.compact_every == self.compact_every - 1:
            self.compact()
        return number

    def _append_log(self, commit: Commit, envelopes: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        # most rows share no claim with another: these stay where they are, and the rules judge the rest
        contested = keep(self.index.contested(envelopes), "contested")
        verdicts = keep(dedup.judge(contested, "all", keep), "verdicts")
        log, conflicts = dedup.settle(envelopes, verdicts, keep)
        commit.append("event_id_conflicts", conflicts)
        log = commit.append("events", log)
        # a row that was rejected claims nothing
        self.index.add(commit, log)
        return log

    def _append_tables(self, commit: Commit, facts: DataFrame) -> None:
        partial = entities.participant_fold().partial(entities.participant_rows(facts))
        partial = commit.append("participants", partial, bucket_by=["email"])
        people = self._people(facts, partial)
        commit.append("bookings", entities.booking_fold().partial(facts))
        commit.append("meeting_links", projections.meeting_fold().partial(projections.meeting_rows(facts)))
        commit.append("email_notifications", projections.email_fold().partial(projections.email_rows(facts, people)))
        commit.append("email_status_history", projections.status_fold().partial(projections.status_rows(facts)))
        commit.append("telegram_notifications", projections.telegram_fold().partial(projections.telegram_rows(facts, people)))
        commit.append("chat_events", projections.chat_events(facts, people))
        commit.append("chat_reads", projections.chat_reads(facts, people))
        commit.append("video_events", projections.video_events(facts))

    def _people(self, facts: DataFrame, partial: DataFrame) -> DataFrame:
        """Participants whose e-mail occurs in this batch, with all that is stored on them."""
        fold = entities.participant_fold()
        wanted = facts.select(F.explode(F.array("recipient_email", "acting_email")).alias("email")).filter(F.col("email").isNotNull())
        stored = self.store.lookup("participants", wanted)
        return fold.result(partial if stored is None else fold.merge(stored.unionByName(partial)))

    # --- reading ---

    def table(self, name: str) -> DataFrame:
        """A table as of the last commit; user projections by the name they are registered under."""
        custom = next((p for p in self.registry.folded.values() if p.name == name), None)
        stored = self.store.read(custom.stored_name if custom else name)
        if custom or name in FOLDS:
            fold = custom.fold if custom else FOLDS[name]()
            return fold.result(fold.merge(stored))
        if name == "chat_events":
            return projections.apply_reads(stored, self.store.read("chat_reads"))
        if name == "organizer_history":
            candidates = entities.organizer_candidates(self.store.read("facts"), self.table("bookings"))
            return entities.organizer_history(materialize(candidates, "candidates"))
        if name == "projection_rejects":
            return extract.projection_rejects(self.store.read("facts"))
        return stored

    def tables(self, registry: Registry | None = None) -> dict[str, DataFrame]:
        names = ["events", *FOLDS, "organizer_history", "chat_events", "video_events"]
        tables = {name: self.table(name) for name in names}
        for projection in self.registry.folded.values():
            tables[projection.name] = self.table(projection.name)
        if registry:
            context = Context(tables["events"], self.table("facts"), tables["participants"], tables["bookings"])
            tables.update(registry.run(context))
        return tables

    # --- upkeep ---

    def compact(self) -> int:
        """Merge the partials of every fold, and the files of each bucket, into one; results stay the same."""
        commit = self.store.begin()
        folds = {name: make() for name, make in FOLDS.items()} | {name: p.fold for name, p in self.registry.folded.items()}
        for name, fold in folds.items():
            stored = self.store.read(name)
            if stored is not None:
                commit.replace(name, fold.merge(stored))
        stored = self.store.read(CLAIMS)
        if stored is not None:
            commit.replace(CLAIMS, stored)
        return commit.publish()
