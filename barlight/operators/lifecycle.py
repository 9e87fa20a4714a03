"""Notes' lifecycle: reinforcement, access, duplicate writes, collection."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.operators import summary, transitions
from barlight.operators.folds import folded

# How much an event moves a note's quality.
DELTAS = {"task_success": 0.1, "task_failure": -0.15, "user_confirm": 0.2, "user_reject": -0.3, "passive_decay": -0.05}


DELTAS_ALL = [round(x * scale) for x in DELTAS.values() for scale in (1000, 700)]  # in thousandths, of users and of the system


def delta(event: Column, source: Column) -> Column:
    """In thousandths; null for unknown events; events of the system count 0.7."""
    d = F.lit(None).cast("long")
    for name, x in DELTAS.items():
        d = F.when(event == name, F.when(source == "system", round(700 * x)).otherwise(round(1000 * x))).otherwise(d)
    return d.cast("long")


def micros(df: DataFrame, name: str = "ts") -> Column:
    """A time column in microseconds; whole numbers are taken to be such."""
    return F.unix_micros(F.col(name).cast("timestamp")) if df.schema[name].dataType.simpleString().startswith("timestamp") else F.col(name).cast("long")


def reinforced(events: DataFrame, start: float = 0.5, cap: float = 0.5, session_us: int | None = None) -> DataFrame:
    """events: note, event, source, ts, event_id. Quality after all events in order, what moved it in the session, and how many were applied.

    A note's session ends when no known event has come for longer than session_us (None: never); the sum then starts again from 0.

    An event that would take the session's sum beyond the cap is skipped; quality stays within 0 and 1 and is rounded to
    hundredths each time (half to even; in thousandths, so that no binary remainder decides). Repeated rows are events of their own.

    Events are dealt out by ranges of (note, time), so a note with many events is many tasks: the span that begins it starts from the known state, the
    others find out where each of the finitely many states leads (operators.transitions). Of each span one row is left, and a note's are followed in order.
    """
    first, most = (round(1000 * start), 0, 0), round(1000 * cap)
    if first[0] % 10:
        raise ValueError("quality starts at a whole hundredth")
    step = transitions.step_of(DELTAS_ALL)

    def later(a: int | None, b: int | None) -> bool:
        return session_us is not None and a is not None and b is not None and b - a > session_us

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, head, at = None, 0, None, None

        def done() -> pa.RecordBatch:
            known = isinstance(now, transitions.Known)
            table = np.array([now.state], np.int64) if known else now.table()
            ends = [head.column("ts"), pa.array([at], pa.int64())]
            return pa.RecordBatch.from_arrays([head.column("note"), head.column("span"), *ends, pa.array([known]), pa.array([rows], pa.int64()), pa.array([table.tobytes()], pa.binary())], ["note", "span", "begun", "ended", "known", "n", "to"])

        for _, new, part in transitions.runs(batches, ["note"]):
            if new:
                if head is not None:
                    yield done()
                # Only the first note of a range can have begun in an earlier one.
                begins = head is not None or part.column("span")[0].as_py() == 0
                now, rows, head, at = transitions.Known(first, most) if begins else transitions.Every(most, step), 0, part.slice(0, 1), None
            times = part.column("ts").to_pylist()
            fresh = [later(a, b) for a, b in zip([at, *times], times)]
            now.apply(part.column("d").to_numpy(), np.array(fresh))
            rows, at = rows + part.num_rows, times[-1]
        if head is not None:
            yield done()

    def followed(group: Iterator[dict]) -> Iterator[dict]:
        state, k, at, every = first, 0, None, transitions.Every(most, step)
        for row in group:
            if later(at, row["begun"]):
                state = state[0], 0, state[2]
            at = row["ended"]
            table = np.frombuffer(row["to"], np.int64).reshape(-1, 3)
            q, s, n = table[0 if row["known"] else every.place(state)].tolist()
            state, k, note = (q, s, n + state[2]), k + row["n"], row["note"]
        yield {"note": note, "quality": state[0] / 1000, "session_delta": state[1] / 1000, "n_applied": state[2], "n_events": k}

    known = events.withColumn("d", delta(F.col("event"), F.col("source"))).where("d is not null").select("note", micros(events).alias("ts"), "event_id", "d")
    kind = events.schema["note"].dataType.simpleString()
    dealt = known.repartitionByRange("note", "ts", "event_id", "d").sortWithinPartitions("note", "ts", "event_id", "d").withColumn("span", F.spark_partition_id())
    left = dealt.select("note", "span", "ts", "d").mapInArrow(spans, f"note {kind}, span int, begun long, ended long, known boolean, n long, to binary")
    return folded(left, ["note"], ["span"], followed, f"note {kind}, quality double, session_delta double, n_applied long, n_events long")


def accepted_writes(writes: DataFrame, window_us: int, windows: int = 64) -> DataFrame:
    """writes: hash, ts (microseconds). Accepted times: a write closer than the window to the last accepted one is a duplicate.

    n_writes counts all of a hash; a write without time is never accepted.

    Spans of `windows` windows are the tasks. Each finds by doubled successors which start leads to which end, a step function of few steps, since
    chains that meet stay together. A hash's functions, one row a span, are followed in order; then each span gives out its own accepted times.
    """
    if window_us <= 0:
        raise ValueError("the window has to be longer than nothing")
    kind = writes.schema["hash"].dataType.simpleString()
    times = writes.where("ts is not null").select("hash", F.col("ts").cast("long").alias("ts")).distinct().withColumn("span", F.expr(f"ts div {windows * window_us} - if(ts % {windows * window_us} < 0, 1, 0)"))
    sizes = writes.groupBy("hash").agg(F.count("*").alias("n_writes"))

    def each(batches: Iterator[pa.RecordBatch], rule) -> Iterator[pa.RecordBatch]:
        head, parts = None, []
        for _, new, part in transitions.runs(batches, ["hash", "span"]):
            if new and head is not None:
                yield rule(head, np.concatenate(parts))
                parts = []
            head = part.slice(0, 1) if new else head
            parts.append(part.column("ts").to_numpy())
        if head is not None:
            yield rule(head, np.concatenate(parts))

    def function(head: pa.RecordBatch, ts: np.ndarray) -> pa.RecordBatch:
        upto, then = transitions.release(ts, window_us)
        return pa.RecordBatch.from_arrays([head.column("hash"), head.column("span"), pa.array([upto], pa.list_(pa.int64())), pa.array([then], pa.list_(pa.int64()))], ["hash", "span", "upto", "then"])

    def followed(group: Iterator[dict]) -> Iterator[dict]:
        free_at = -(1 << 62)
        for row in group:
            yield {"hash": row["hash"], "span": row["span"], "free_at": free_at, "n_writes": row["n_writes"]}
            i = bisect_left(row["upto"], free_at)
            free_at = row["then"][i] if i < len(row["upto"]) else free_at

    def accepted(head: pa.RecordBatch, ts: np.ndarray) -> pa.RecordBatch:
        kept = transitions.accepted_from(ts, window_us, head.column("free_at")[0].as_py())
        same = lambda c: head.column(c).take(pa.array(np.zeros(len(kept), np.int64)))
        return pa.RecordBatch.from_arrays([same("hash"), same("n_writes"), pa.array(kept)], ["hash", "n_writes", "accepted_at"])

    dealt = times.repartition("hash", "span").sortWithinPartitions("hash", "span", "ts")
    functions = dealt.mapInArrow(lambda b: each(b, function), f"hash {kind}, span long, upto array<long>, then array<long>")
    counted = functions.join(sizes.withColumnRenamed("hash", "_h"), F.col("hash").eqNullSafe(F.col("_h"))).drop("_h")
    starts = folded(counted, ["hash"], ["span"], followed, f"hash {kind}, span long, free_at long, n_writes long").select(F.col("hash").alias("_h"), F.col("span").alias("_s"), "free_at", "n_writes")
    begun = times.join(starts, F.col("hash").eqNullSafe(F.col("_h")) & (F.col("span") == F.col("_s"))).select("hash", "span", "ts", "free_at", "n_writes")
    return begun.repartition("hash", "span").sortWithinPartitions("hash", "span", "ts").mapInArrow(lambda b: each(b, accepted), f"hash {kind}, n_writes long, accepted_at long")


def access(events: DataFrame) -> DataFrame:
    return events.groupBy("note").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_access"))


def collection(age_days: Column, importance: Column, delete: bool = False) -> Column:
    """archive, delete (only if enabled) or null."""
    gone = F.when((importance < 0.05) & F.lit(delete), "delete").when(importance < 0.15, "archive")
    return F.when(age_days >= 7, gone)


def maintained(notes: DataFrame, delete: bool = False, key: str = "doc_id") -> DataFrame:
    """key, action, level, text, original: one maintenance pass over notes.

    notes: key (no two share it; rows without one go), text, level (raw, daily or digest), age_days, idle_days (since the last access), importance, keywords
    (text, may be empty). Collection comes first: archived notes keep their text, deleted ones lose it. What stays is compressed when it is due: to its
    summary, or to the terms of it (a text without terms stays as it is), and original is the text before. Other notes have no action.
    """
    action = F.coalesce(collection(F.col("age_days"), F.col("importance"), delete), F.when(summary.due(F.col("level"), F.col("idle_days")).isNotNull(), "compress"))
    given = notes.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), "text", "level", F.coalesce("keywords", F.lit("")).alias("keywords"), action.alias("action"), summary.due(F.col("level"), F.col("idle_days")).alias("to"))
    pressed = given.where("action = 'compress'")
    daily = summary.summarised(pressed.where("to = 'daily'"), F.col("keywords")).withColumnRenamed("summary", "_made").drop("n_sentences", "kept")
    terms = summary.digested(pressed.where("to = 'digest'")).withColumnRenamed("digest", "_made")
    context = F.when((F.col("to") == "digest") & (F.col("keywords") != ""), F.concat(F.lit("Context: "), "keywords", F.lit("\n"))).otherwise("")
    done = daily.unionByName(terms).withColumn("_new", F.coalesce(F.concat(context, "_made"), "text"))
    rest = given.where("not action <=> 'compress'")
    return done.select(F.col("_k").alias(key), "action", F.col("to").alias("level"), F.col("_new").alias("text"), F.col("text").alias("original")).unionByName(
        rest.select(F.col("_k").alias(key), "action", "level", F.when(~F.col("action").eqNullSafe(F.lit("delete")), F.col("text")).alias("text"), F.lit(None).cast("string").alias("original")))
