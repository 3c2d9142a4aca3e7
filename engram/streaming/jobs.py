"""Streams: conversations compiled turn by turn, forgetting, relationship and faction state, decay passes, new documents, windows.

Each function takes a streaming DataFrame and gives one, or a writer to start; state lives in Spark's state store and
progress in the checkpoint location, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from engram.functions import lexicons as L


def new_documents(docs: DataFrame, time: str, late: str = "1 day", key: str = "title") -> DataFrame:
    """Documents whose key wasn't seen within the watermark."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, time: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "2 hours", by: Sequence[str] = ("event_type",)) -> DataFrame:
    """Rows a window and key: tumbling, or sliding if slide is given; rows later than the watermark are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours", by: str = "user_id") -> DataFrame:
    """Rows a session of a key: its start, end and number of events."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def relationship(messages: DataFrame, positive: Sequence[str] = L.POSITIVE_WORDS, negative: Sequence[str] = L.NEGATIVE_WORDS) -> DataFrame:
    """Intimacy of each conversation after each batch: conv_id, intimacy, stage, trend.

    A key's move is summed by SQL before the state, so the state function sees one number for each batch of a key's rows.
    """
    from engram.functions.text import any_of

    c, step = F.col("content"), F.when(F.col("role") == "user", 0.02).otherwise(0.01)
    move = F.when(any_of(c, positive), step).otherwise(0.0) - F.when(any_of(c, negative), step).otherwise(0.0)
    moves = messages.select("conv_id", move.alias("move"))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = state.get[0] if state.exists else 0.0
        new = min(1.0, max(0.0, old + sum(float(b["move"].sum()) for b in batches)))
        new = round(new, 9)
        state.update((new,))
        stage = "stranger" if new < 0.2 else "acquaintance" if new < 0.5 else "companion" if new < 0.8 else "partner"
        trend = "rising" if new > old else "declining" if new < old else "stable"
        yield pd.DataFrame({"conv_id": [key[0]], "intimacy": [new], "stage": [stage], "trend": [trend]})

    return moves.groupBy("conv_id").applyInPandasWithState(fold, "conv_id long, intimacy double, stage string, trend string", "intimacy double", "update", GroupStateTimeout.NoTimeout)


def factions(events: DataFrame, surrender: Sequence[str], betray: Sequence[str] = (), unknown: str = "未知") -> DataFrame:
    """Moves between factions as events arrive: doc_id, pos, name, old, new, kind. events has doc_id, pos, verb, subject,
    object, and faction (of the object, where the source knows it). The current faction of every name is the state of its
    document; a surrender to one of another faction moves a name, a betrayal is told with the faction it is in."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(*state.get)) if state.exists else {}
        out = []
        rows = pd.concat(list(batches)).sort_values(["pos", "verb"])
        for r in rows.itertuples(index=False):
            if r.faction is not None:
                now.setdefault(r.object, r.faction)
            old, new = now.get(r.subject, unknown), now.get(r.object, unknown)
            if r.verb in surrender and new not in (old, unknown):
                now[r.subject] = new
                out.append((key[0], r.pos, r.subject, old, new, "surrender"))
            elif r.verb in betray:
                out.append((key[0], r.pos, r.subject, old, old, "betrayal"))
        state.update((list(now), list(now.values())))
        yield pd.DataFrame(out, columns=["doc_id", "pos", "name", "old", "new", "kind"])

    schema = "doc_id long, pos int, name string, old string, new string, kind string"
    return events.groupBy("doc_id").applyInPandasWithState(fold, schema, "names array<string>, factions array<string>", "append", GroupStateTimeout.NoTimeout)


@contextmanager
def timers_and_lists(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which forget() and changed_turns() need; the session's own setting
    is put back afterwards."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


class Forget(StatefulProcessor):
    """One memory: its time of expiry as state, and a timer at that time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        nothing = pd.DataFrame({"tenant_id": [], "id": [], "expired_ms": []}).astype({"tenant_id": str, "id": "int64", "expired_ms": "int64"})
        if not key[2]:  # only moves the time
            yield nothing
            return
        new = None
        for b in rows:
            for at, ms in zip(b["at_ms"], b["expires_ms"]):
                new = max(new or (at, -1), (at, -1 if pd.isna(ms) else int(ms)))  # the last word counts, the longest life of equals
        if self.expiry.exists():
            self.handle.deleteTimer(self.expiry.get()[0])
        if new[1] < 0:
            self.expiry.clear()
        else:
            self.expiry.update((new[1],))
            self.handle.registerTimer(new[1])
        yield nothing

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms = expiredTimerInfo.getExpiryTimeInMs()
        self.expiry.clear()
        yield pd.DataFrame({"tenant_id": [key[0]], "id": [key[1]], "expired_ms": [ms]})

    def close(self) -> None:
        pass


def forget(memories: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Memories that expire, each emitted once, when the stream's time passes its expiry: tenant_id, id, expired_at.

    memories is a stream of tenant_id, id, at (when the row was said) and expires_at (null: never). Time is the watermark of
    `at`: the largest one so far, less `late`. A later row of a memory replaces its expiry, so a memory that was refreshed
    lives on; of rows in one batch the last by `at` counts. A row of an expiry that has passed is emitted in the next batch.
    Rows without tenant or id only move the time, which lets a clock be unioned in. An expired memory leaves the state, one
    that never expires has none; a restarted query goes on from its checkpoint and emits nothing twice.

    Start it inside timers_and_lists(spark), in append mode.
    """
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = memories.select(F.col("tenant_id").cast("string").alias("tenant_id"), F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"), ms("expires_at").alias("expires_ms"))
    # no filter, which would be moved to before the watermark, and no null keys, for which pandas would make ids floats
    real = F.col("tenant_id").isNotNull() & F.col("id").isNotNull()
    rows = rows.withWatermark("at", late).withColumn("real", real).withColumns({"tenant_id": F.coalesce("tenant_id", F.lit("")), "id": F.coalesce("id", F.lit(0)), "at_ms": ms("at")})
    out = rows.groupBy("tenant_id", "id", "real").transformWithStateInPandas(Forget(), "tenant_id string, id long, expired_ms long", "append", "EventTime")
    return out.select("tenant_id", "id", F.timestamp_millis("expired_ms").alias("expired_at"))


class Turns(StatefulProcessor):
    """One conversation: its turns, by number."""

    COLUMNS = ("conv_id", "turn", "role", "content", "user_message")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "turn long", "role string, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = set()
        for b in rows:
            for turn, role, content in zip(b["turn"].tolist(), b["role"].tolist(), b["content"].tolist()):
                self.turns.updateValue((turn,), (role, content))
                new.add(turn)
        out, said, since = [], None, None  # since: the user turn that said it
        for turn in sorted(k[0] for k in self.turns.keys()):
            role, content = self.turns.getValue((turn,))
            if turn in new or since in new:
                out.append((key[0], turn, role, content, said))
            if role == "user":
                said, since = content, turn
            elif turn in new:
                since = turn  # it may have been a user turn before
        yield pd.DataFrame(out, columns=list(self.COLUMNS))

    def close(self) -> None:
        pass


def changed_turns(messages: DataFrame) -> DataFrame:
    """Turns whose facts can have changed with a batch: conv_id, turn, role, content, user_message (the nearest earlier one).

    messages is a stream of conv_id, turn, role, content, in any order. The turns of a conversation are its state. A new
    turn comes out with what stands before it, and if it is a user's, so do the assistant turns up to the next user turn,
    which restate it now. A turn that is sent again replaces the old one. Start it inside timers_and_lists(spark), in update
    mode.
    """
    rows = messages.where("conv_id is not null and turn is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "content")
    return rows.groupBy("conv_id").transformWithStateInPandas(Turns(), "conv_id long, turn long, role string, content string, user_message string", "update", "None")


def compile_turns(messages: DataFrame, compiled: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, every: str | None = None):
    """A writer that compiles conversations as their turns arrive. compiled(turns) gives rows with conv_id and turn from turns
    of changed_turns(), as cognition.channels does. Each batch overwrites a folder of its own number, so one that is run
    again after a failure leaves the same files. compiled_turns() reads them."""

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/turns/batch={batch_id}")
        turns = spark.read.schema(batch.schema).parquet(f"{out}/turns/batch={batch_id}")
        facts = compiled(turns)
        facts = facts.groupBy("conv_id", "turn").agg(F.collect_list(F.struct(*facts.columns)).alias("facts"))
        turns.select("conv_id", "turn").join(facts, ["conv_id", "turn"], "left").write.mode("overwrite").parquet(f"{out}/facts/batch={batch_id}")

    return each_batch(changed_turns(messages), work, checkpoint, every, "update")


def compiled_turns(spark: SparkSession, out: str) -> DataFrame:
    """The facts that compile_turns() has written, those of a turn's last batch."""
    rows = spark.read.parquet(f"{out}/facts")
    last = rows.groupBy("conv_id", "turn").agg(F.max_by("facts", "batch").alias("facts"))
    return last.where("facts is not null").select(F.inline("facts"))


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append"):
    """A writer that hands every batch to work(df, batch_id): for distilling, compiling or ageing facts as they come."""
    w = stream.writeStream.outputMode(mode).foreachBatch(work).option("checkpointLocation", checkpoint)
    return w.trigger(processingTime=every) if every else w.trigger(availableNow=True)


def decay_passes(facts: DataFrame, ticks: DataFrame, out: str, checkpoint: str, strategy: str = "hybrid", every: str | None = None):
    """A writer that assesses all facts at each tick (column now, seconds) and writes the result in a folder of its batch."""
    from engram.operators.persona import decayed

    def work(batch: DataFrame, batch_id: int) -> None:
        now = batch.agg(F.max("now")).first()[0]
        if now is not None:
            decayed(facts, int(now), strategy).write.mode("overwrite").parquet(f"{out}/pass={batch_id}")

    return each_batch(ticks, work, checkpoint, every)
