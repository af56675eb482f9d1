"""Structured Streaming forms of the batch operators.

The batch operators' column expressions and fold steps are reused, so a stream gives what the batch
operator gives over the same rows.

* S1 is stateless. S2 and S3 are event-time windows; S2's tick total is a second aggregation over
  the first. A zone-less ``TIMESTAMP_NTZ`` event time is read as UTC.
* S4 and S5 hold rows in state, as a block a bucket of keys, until the watermark has passed them and
  fold them in time order then, whatever the order they came in. An event-time timeout removes a key's
  state as soon as no later row can need it. They use ``applyInPandasWithState``, which hands rows over
  by columns; ``transformWithStateInPandas`` takes every row through a Python tuple of its own.
* S6 puts neighbouring chunks together where they are read and keeps the open streams' bytes and what
  came too early the same way, a bucket at once. A last mark ends a stream, or a timeout once it has been
  silent for ``idle``. Segments meet the vault in a stream-static join inside ``foreachBatch``.

Rows later than the watermark are dropped, as everywhere in Structured Streaming. State is kept in
RocksDB, not in the executors' heap: start these queries in ``stateful_session(spark)``, S4 and S5 with
``rows_at_once=ROWS_AT_ONCE``, as a key's held rows are sent to Python again with every Arrow batch of its new ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanshield import patterns as P
from spanshield.operators import folds as FO
from spanshield.operators import rewrite as R
from spanshield.operators.stream_restore import SEGMENT_SCHEMA, Segmenter, chunks_of, restore_segments, runs_of

ROWS_AT_ONCE = 250_000   # for ordered folds: Spark sends a state's bytes again with every so many (small) rows of its key
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession, partitions: int | None = None, rows_at_once: int | None = None) -> SparkSession:
    """A session on the same Spark application whose streams keep their state in RocksDB;
    ``partitions`` is the number of state partitions, fixed for a query's life, ``rows_at_once`` how many
    rows go to Python together."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    if rows_at_once:
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_at_once))
    if partitions:
        own.conf.set("spark.sql.shuffle.partitions", str(partitions))
    return own


# --- S1 ------------------------------------------------------------------------------------------
def stream_protect(messages: DataFrame, text_col: str = "body") -> DataFrame:
    """Detections + tokenized text per message; stateless (append mode)."""
    return R.tokenize(messages, text_col, "user_id", "host")


# --- S2 ------------------------------------------------------------------------------------------
def stream_audit(events: DataFrame, tick: str = "5 seconds", watermark: str = "10 seconds") -> DataFrame:
    """Audit counts per event-time tick and (type, resource, user or anon) with the tick's total;
    append mode emits a tick once the watermark passes its end.

    The total is a second windowed aggregation, over the first one's rows; the join back is by tick."""
    counts = (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
              .groupBy(F.window("ts", tick).alias("w"), "violation_type", "resource",
                       F.coalesce(F.col("user_id"), F.lit(P.ANON_USER)).alias("user"))
              .agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy(F.window(F.window_time("w"), tick).alias("tw")).agg(F.sum("n").alias("tick_total"))
    return counts.join(totals, F.col("w") == F.col("tw")).select(
        F.col("w.start").alias("tick_start"), "violation_type", "resource", "user", "n", "tick_total")


# --- S3 ------------------------------------------------------------------------------------------
def stream_usage(log: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """S3: usage per (user, UTC day) as an event-time window; update mode shows running totals."""
    return (log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
            .groupBy("user_id", F.window("ts", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("req"), F.sum("tok_in").cast("long").alias("tok_in"),
                 F.sum("tok_out").cast("long").alias("tok_out"), F.sum("bytes_in").cast("long").alias("bytes_in"),
                 F.sum("bytes_out").cast("long").alias("bytes_out"))
            .select("user_id", F.to_date(F.col("w.start")).alias("day"), "req", "tok_in", "tok_out", "bytes_in",
                    "bytes_out"))


# --- S4, S5: folds in event time -----------------------------------------------------------------
BUCKETS = 1024  # state keys of an ordered fold, fixed for a query's life
ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.BooleanType(): pa.bool_(),
         T.DateType(): pa.date32(), T.TimestampType(): pa.timestamp("us", "UTC")}

def _arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([(f.name, ARROW[f.dataType]) for f in schema])


SLICE = 65_536   # rows that are Python values at once, and rows of a block that are packed at once


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        some, n = [], 0
        for batch in table.to_batches(max_chunksize=SLICE):   # small ones are joined, so that blocks don't fall to pieces
            some.append(batch)
            n += batch.num_rows
            if n >= SLICE:
                writer.write_table(pa.Table.from_batches(some).combine_chunks())
                some, n = [], 0
        if some:
            writer.write_table(pa.Table.from_batches(some).combine_chunks())
    return sink.getvalue().to_pybytes()


def _blocks(block: bytes | None, schema: pa.Schema) -> Iterator[pa.Table]:
    """The rows of a block as they were packed, SLICE at once."""
    for batch in pa.ipc.open_stream(block) if block else ():
        yield pa.Table.from_batches([batch], schema)


def _unpacked(block: bytes | None, schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *_blocks(block, schema)])


def _made(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else schema.empty_table()


def _listed(column: pa.ChunkedArray) -> list:
    """A column as Python values. By way of numpy, but for numbers with nulls, which would become floats there."""
    if column.null_count and pa.types.is_integer(column.type):
        return column.to_pylist()
    return column.to_numpy().tolist()


HELD = "held binary, states binary, ends long"


def ordered_fold(row_schema: T.StructType, key_schema: T.StructType, state_schema: T.StructType, out_schema: T.StructType,
                 key_of: Callable, step: Callable, ends: Callable) -> Callable:
    """Holds rows until the watermark has passed them, then folds those of each key in order.

    The state's key is a bucket of many keys: a call of the function, which costs the same whatever it
    carries, is made once a bucket and micro-batch, not once a key. Rows are (at, id, ...) with
    ``at`` in microseconds, ``key_of(row)`` is a row's key (a tuple of ``key_schema``).
    ``step(state, row)`` gives the key's next state (a tuple of the state schema, or None for none) and
    an output row or None; its instants are microseconds and its dates days, turned into times a column
    at once. ``ends(state)`` says from which instant on the state makes no difference any more (None: never)."""
    rows, out = _arrow_schema(row_schema), _arrow_schema(out_schema)
    kept = pa.schema([*[f.with_name(f"key_{f.name}") for f in _arrow_schema(key_schema)], *_arrow_schema(state_schema)])
    n_key = len(key_schema)

    def fold(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, live, ended = state.get if state.exists else (None, None, None)
        passed = state.getCurrentWatermarkMs() * 1000
        parts = {True: [rows.empty_table()], False: [rows.empty_table()]}   # the rows that the watermark has passed, the others

        def take(table):
            due = pc.less_equal(table["at"], passed)
            for now, chosen in ((True, due), (False, pc.invert(due))):
                some = table.filter(chosen)
                if some.num_rows:
                    parts[now].append(some)

        for batch in _blocks(block, rows):
            take(batch)
        del block
        for pdf in batches:
            if len(pdf):
                take(pa.Table.from_arrays([pa.array(pdf[f.name], from_pandas=True).cast(f.type) for f in rows], schema=rows))
            del pdf
        ready, rest = (pa.concat_tables(parts.pop(now)) for now in (True, False))
        emitted = []
        if ready.num_rows or (ended is not None and ended <= passed):
            states = {row[:n_key]: row[n_key:] for row in zip(*map(_listed, _unpacked(live, kept).columns))}
            ready = ready.combine_chunks()
            order = pc.sort_indices(ready, [("at", "ascending"), (rows.names[1], "ascending")])
            for lo in range(0, ready.num_rows, SLICE):   # not all rows are Python values at once
                for row in zip(*map(_listed, ready.take(order.slice(lo, SLICE)).columns)):
                    k = key_of(row)
                    now, made = step(states.get(k), row)
                    if now is None:
                        states.pop(k, None)
                    else:
                        states[k] = now
                    if made is not None:
                        emitted.append(made)
            del ready, order
            pa.default_memory_pool().release_unused()
            until = {k: ends(s) for k, s in states.items()}
            still = [(*k, *s) for k, s in states.items() if until[k] is None or until[k] > passed]
            live = _packed(_made(still, kept)) if still else None
            ended = min((e for e in until.values() if e is not None and e > passed), default=None)
        if rest.num_rows or live:
            state.update((_packed(rest) if rest.num_rows else None, live, ended))
            later = [e for e in (pc.min(rest["at"]).as_py(), ended) if e is not None]
            if later:   # due once the watermark has passed this instant, as the rows are
                state.setTimeoutTimestamp(max(1, -(-min(later) // 1000) - 1))
        elif state.exists:
            state.remove()
        del rest
        pa.default_memory_pool().release_unused()   # buckets follow each other in one worker
        if emitted:
            yield _made(emitted, out).to_pandas(integer_object_nulls=True, date_as_object=True)

    return fold


def _ordered(df: DataFrame, keys: str, rows: str, state: str, out: str, key_of: Callable, step: Callable, ends: Callable,
             watermark: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` has ``ts``, the columns of ``keys`` and of ``rows`` (schemas) but for ``at``, which is made here.
    A row without a time is never passed by a watermark: it is not held."""
    kept, key = T.StructType.fromDDL(rows), T.StructType.fromDDL(keys)
    timed = (df.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("at", F.unix_micros("ts"))
             .where(F.col("at").isNotNull()).withWatermark("ts", watermark))
    bucket = F.pmod(F.xxhash64(*key.fieldNames()), F.lit(buckets)).cast("int").alias("bucket")
    fold = ordered_fold(kept, key, T.StructType.fromDDL(state), T.StructType.fromDDL(out), key_of, step, ends)
    return timed.select("ts", bucket, *kept.fieldNames()).groupBy("bucket").applyInPandasWithState(
        fold, out, HELD, "append", GroupStateTimeout.EventTimeTimeout)


DAY_US = 86_400 * 1_000_000
NO_LIMIT = 2**63 - 1
_LIMITS = ("quota_req_day", "quota_tok_in", "quota_tok_out", "quota_bytes_in", "quota_bytes_out")


def stream_admission(log: DataFrame, users: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Quota admission (G8) per (user, UTC day); the running usage is gone once the day is over.

    A null amount counts 0, a null limit is the largest number. ``users`` is static and joined before the state."""
    amounts = ("tok_in", "tok_out", "bytes_in", "bytes_out")
    d = FO.admission_input(log.withColumn("ts", F.col("ts").cast("timestamp")), users)
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in amounts}
                      | {c: F.coalesce(F.col(c), F.lit(NO_LIMIT).cast("long")) for c in _LIMITS})
    rows = "at long, req_id long, user_id string, " + ", ".join(f"{c} long" for c in (*amounts, *_LIMITS))

    def step(state, row):
        at, req_id, user_id, *numbers = row
        used, delta, limits = (state or (0,) * 5 + (0,))[:5], (1, *numbers[:4]), numbers[4:]
        day = at // DAY_US
        ok = all(a + b <= most for a, b, most in zip(used, delta, limits))
        if ok:
            used = tuple(int(a + b) for a, b in zip(used, delta))
        return (*used, day), (req_id, user_id, day, ok)

    return _ordered(d, "user_id string, day long", rows, "req long, tok_in long, tok_out long, bytes_in long, bytes_out long, day_no long",
                    FO.ADMISSION_SCHEMA, lambda row: (row[2], row[0] // DAY_US), step, lambda state: (state[5] + 1) * DAY_US, watermark)


def stream_lockout(attempts: DataFrame, key_col: str = "username", max_fails: int = FO.USER_MAX_FAILS,
                   lock_seconds: int = FO.USER_LOCK_S, watermark: str = "1 hour") -> DataFrame:
    """Consecutive-failure lockout per key (I7). A success leaves no state, a lock goes when it
    ends; a count of failures stays, for failures never age out."""
    d = attempts.select("attempt_id", "ts", "ok", F.col(key_col).alias("key"))
    lock = lock_seconds * 1_000_000

    def step(state, row):
        at, attempt_id, key, ok = row
        fails, until = state or (0, None)
        if until is not None and at < until:
            return (fails, until), (attempt_id, key, "refused", until)
        if ok:
            return None, (attempt_id, key, "ok", None)
        if fails + 1 >= max_fails:
            return (0, at + lock), (attempt_id, key, "locked", at + lock)
        return (fails + 1, None), (attempt_id, key, "fail", None)

    return _ordered(d, "key string", "at long, attempt_id long, key string, ok boolean", "fails int, until long",
                    FO.LOCKOUT_SCHEMA, lambda row: (row[2],), step, lambda state: state[1] if state[0] == 0 else None, watermark)


def stream_throttle(events: DataFrame, key_col: str, id_col: str = "event_id",
                    window_s: int = FO.THROTTLE_WINDOW_S, watermark: str = "1 hour") -> DataFrame:
    """At most one event per key per window from the last emitted one (I8); the last emitted time
    goes once the window is over."""
    d = events.select(F.col(id_col).cast("long").alias("event_id"), "ts", F.col(key_col).alias("key"))
    window = window_s * 1_000_000

    def step(state, row):
        at, event_id, key = row
        if state is None or at - state[0] >= window:
            return (at,), (event_id, key, at)
        return state, None

    return _ordered(d, "key string", "at long, event_id long, key string", "last long", FO.THROTTLE_SCHEMA, lambda row: (row[2],), step,
                    lambda state: state[0] + window, watermark)


# --- S6 ------------------------------------------------------------------------------------------
NEVER = -2**63   # no time, no mark
RUNS = "stream_id long, seq long, last long, chunk binary, sizes binary, fin long, at long"
OPEN = pa.schema([("stream_id", pa.int64()), ("no_id", pa.bool_()), ("pending", pa.binary()), ("carry", pa.string()),
                  *((c, pa.int64()) for c in ("received", "seg", "next", "last", "due"))])
EARLY = pa.schema([("stream_id", pa.int64()), ("no_id", pa.bool_()), ("seq", pa.int64()), ("last", pa.int64()), ("chunk", pa.binary()), ("sizes", pa.binary())])


def _timed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that lie side by side in a stream put together where they are read, with the number of the
    last one marked and the latest time of each run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        seq, ids = batch.column("seq").to_numpy(), batch.column("stream_id").fill_null(0).to_numpy()
        if not ((ids[1:] > ids[:-1]) | (ids[1:] == ids[:-1]) & (seq[1:] >= seq[:-1])).all():
            by = np.lexsort((seq, ids))   # streams that came mixed
            batch, seq = batch.take(pa.array(by)), seq[by]
        runs, first = runs_of(batch)
        fin = np.where(batch.column("fin").to_numpy(zero_copy_only=False), seq, NEVER)
        at = batch.column("at").fill_null(NEVER).to_numpy()
        yield pa.RecordBatch.from_arrays([*runs.columns, *(pa.array(np.maximum.reduceat(x, first)) for x in (fin, at))],
                                         names=[*runs.schema.names, "fin", "at"])


def _following(runs: list, at: int, every: bool) -> tuple[bytes, int, list]:
    """The bytes of the chunks that follow each other from number ``at`` on (all, with ``every``), the number
    after them and the runs (seq, last, chunk, sizes) beyond. Of chunks with one number the latest counts."""
    order = sorted(runs, key=lambda r: r[0])
    if order and (order[0][0] < at or any(b[0] <= a[1] for a, b in zip(order, order[1:]))):
        one = {s: c for seq, _, chunk, sizes in runs for s, c in chunks_of((seq, chunk, sizes))}
        order = [(s, s, one[s], np.int32(len(one[s])).tobytes()) for s in sorted(one) if s >= at]
    n = len(order)
    if not every:
        want = [at, *(r[1] + 1 for r in order)]
        n = next((i for i, r in enumerate(order) if r[0] != want[i]), n)
    return b"".join([r[2] for r in order[:n]]), order[n - 1][1] + 1 if n else at, order[n:]


def segment_fold(idle_ms: int) -> Callable:
    """Keeps the open streams of a bucket: a byte buffer each, and the runs that came too early. Chunks are
    taken in ``seq`` order. The last mark ends a stream once all before it are there; a stream silent for
    ``idle_ms`` ends with what has come. Streams without news stay packed."""

    def fold(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, live, _ = state.get if state.exists else (None, None, None)
        passed, out = state.getCurrentWatermarkMs(), []
        new: dict[tuple, list] = {}
        for pdf in batches:
            for sid, no_id, *run in zip(*(pdf[c].tolist() for c in ("stream_id", "no_id", "seq", "last", "chunk", "sizes", "fin", "at"))):
                new.setdefault((sid, no_id), []).append(run)
        still, early = _unpacked(live, OPEN), _unpacked(block, EARLY)
        news = pc.or_(pc.is_in(still["stream_id"], pa.array([sid for sid, _ in new], pa.int64())), pc.less_equal(pc.fill_null(still["due"], passed + 1), passed))
        met = still.filter(news)
        held = {row[:2]: row[2:] for row in zip(*(c.to_pylist() for c in met.columns))}
        waits = pc.is_in(early["stream_id"], met["stream_id"].combine_chunks())
        waiting: dict[tuple, list] = {}
        for sid, no_id, *run in zip(*(c.to_pylist() for c in early.filter(waits).columns)):
            waiting.setdefault((sid, no_id), []).append(run)
        kept, rest = [], []
        for key in {**held, **new}:
            pending, carry, received, seg, at, last, due = held.get(key, (b"", "", 0, 0, 0, None, None))
            came, sid = new.get(key, []), None if key[1] else key[0]
            runs = [*waiting.get(key, []), *(r[:4] for r in came)]
            marked, time = max((r[4] for r in came), default=NEVER), max((r[5] for r in came), default=NEVER)
            last = marked if last is None and marked != NEVER else last
            due = max(time // 1000 + idle_ms, due or 0) if time != NEVER else due
            segmenter = Segmenter(pending, carry, received)
            for silent in (False, True):
                if silent and (due is None or due > passed):
                    kept.append((*key, *segmenter.state(), seg, at, last, due))
                    rest += [(*key, *r) for r in runs]
                    break
                data, after, runs = _following(runs, at, silent)
                if after != at:
                    text, at = segmenter.feed(data), after
                    if text:
                        out.append((sid, seg, text, False))
                        seg += 1
                if silent or (last is not None and at > last):
                    out.append((sid, seg, segmenter.finish(), True))
                    break
        still, early = pa.concat_tables([still.filter(pc.invert(news)), _made(kept, OPEN)]), pa.concat_tables([early.filter(pc.invert(waits)), _made(rest, EARLY)])
        if still.num_rows:
            due = pc.min(still["due"]).as_py()
            state.update((_packed(early) if early.num_rows else None, _packed(still), due))
            if due is not None:   # passed once the watermark is there
                state.setTimeoutTimestamp(max(1, due - 1))
        elif state.exists:
            state.remove()
        if out:
            columns = dict(zip(("stream_id", "seg", "text", "ends"), zip(*out)))
            yield pd.DataFrame(columns | {"stream_id": pd.Series(columns["stream_id"], dtype=object)})

    return fold


def stream_segments(chunks: DataFrame, idle: int = 30, watermark: str = "10 seconds", buckets: int = BUCKETS) -> DataFrame:
    """S6, stateful half: per stream, decode across chunk edges and emit token-safe segments,
    ``(stream_id, seg, text, ends)``; the last one of a stream has ``ends`` set.

    ``chunks``: ``stream_id, seq, chunk BINARY, fin BOOLEAN, ts``. ``fin`` marks the last chunk; a stream
    without one ends ``idle`` seconds of event time after its latest chunk. Either flushes what was held
    back and drops the state. A chunk that comes after that starts the stream anew. Chunks read side by side
    are one row from there on, with the time of the latest: only a row all of whose chunks are late is dropped."""
    timed = chunks.select(F.col("stream_id").cast("long").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "chunk",
                          F.coalesce("fin", F.lit(False)).alias("fin"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("seq IS NOT NULL")
    runs = timed.mapInArrow(_timed_runs, RUNS).withColumn(
        "ts", F.when(F.col("at") != NEVER, F.timestamp_micros("at"))).withWatermark("ts", watermark)
    return runs.select("ts", F.pmod(F.xxhash64("stream_id"), F.lit(buckets)).cast("int").alias("bucket"),
                       F.coalesce("stream_id", F.lit(0)).cast("long").alias("stream_id"), F.col("stream_id").isNull().alias("no_id"),
                       "seq", "last", "chunk", "sizes", "fin", "at").groupBy("bucket").applyInPandasWithState(
        segment_fold(idle * 1000), f"{SEGMENT_SCHEMA}, ends boolean", HELD, "append", GroupStateTimeout.EventTimeTimeout)


def kept_batch(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """``write`` on a micro-batch that is kept while it runs: a plan that reads the batch twice would
    run the stateful stage twice."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        batch.persist()
        try:
            write(batch, epoch_id)
        finally:
            batch.unpersist()
    return run


def restore_batch_writer(sessions: DataFrame, vault: DataFrame, sink: Callable[[DataFrame, int], None]):
    """S6, stateless half: a ``foreachBatch`` function restoring each micro-batch of segments with
    the batch D5 (static join with the vault) and handing the result to ``sink``."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        sink(restore_segments(batch, sessions, vault, split=True), epoch_id)
    return kept_batch(write)
