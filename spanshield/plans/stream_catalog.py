"""Checked streaming queries.

The batch tables are written in slices of time, rows up to ``JITTER`` seconds out of order, and read
back as a stream of several micro-batches; a query runs until its input is used up and its sink
table is the result. A row is in the result once the watermark has passed it, so each oracle is the
batch oracle over what lies before the newest event less the watermark's delay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanshield.operators import access as AC
from spanshield.operators import stream_restore as SR
from spanshield.operators import vault as V
from spanshield.plans import catalog as C
from spanshield.plans import derived
from spanshield.session import ensure_checkpoint_dir
from spanshield.streaming import streams as S

SLICES = 3
STATE_PARTITIONS = 8


def folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def moved(id_col: Column, jitter_s: float, ts_col: str = "ts") -> Column:
    """The instant by which a row is dealt to its micro-batch, in microseconds."""
    return F.unix_micros(F.col(ts_col).cast("timestamp")) + (F.pmod(F.xxhash64(id_col), F.lit(2001)) - 1000) * int(jitter_s * 1000)


def sliced(own: SparkSession, name: str, cuts: list[int], between: Callable, **options: str) -> DataFrame:
    """``between(low, high)``, the rows from one cut to the next, as a stream with a micro-batch each."""
    path, schema = folder(own, name), None
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        part = between(low, high)
        schema = part.schema
        part.write.mode("append").options(**options).parquet(path)
    files = len(own.read.schema(schema).parquet(path).inputFiles())
    return own.readStream.schema(schema).option("maxFilesPerTrigger", max(1, -(-files // SLICES))).parquet(path)


def dealt(at: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """The rows whose instant ``_at`` lies after ``low``, up to ``high``."""
    part = at if low is None else at.where(F.col("_at") > low)
    return (part if high is None else part.where(F.col("_at") <= high)).drop("_at")


def as_stream(own: SparkSession, table: DataFrame, name: str, id_col: Column, jitter_s: float, ts_col: str = "ts") -> DataFrame:
    """The rows of ``table`` as a stream of SLICES micro-batches in order of time, but for ``jitter_s``."""
    at = table.withColumn("_at", moved(id_col, jitter_s, ts_col))
    cuts = at.agg(F.percentile_approx("_at", [i / SLICES for i in range(1, SLICES)], 10_000)).first()[0] or []
    return sliced(own, name, cuts, lambda low, high: dealt(at, low, high))


def ran(spark: SparkSession, stream: DataFrame, name: str, each: Callable | None = None) -> DataFrame:
    """The sink table of ``stream`` once its input is used up, append mode."""
    out = folder(spark, f"{name}-out")
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", folder(spark, f"{name}-state")).trigger(availableNow=True)
    if each is None:
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    writer.foreachBatch(S.kept_batch(lambda batch, epoch: each(batch, epoch).write.mode("overwrite").parquet(f"{out}/batch={epoch}", compression="zstd"))).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


@C.register("s1_stream_protect", f"SELECT id AS msg_id, tokenized FROM {C.TOKENIZED_SQL}")
def s1_stream_protect(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.stateful_session(spark, STATE_PARTITIONS)
    src = as_stream(own, derived.messages(spark, sf_dir), "s1", F.col("msg_id"), 60)
    return ran(spark, S.stream_protect(src).select("msg_id", "tokenized"), "s1")


@C.register("s2_stream_audit", f"""WITH e AS {C.EVENTS_SQL}
  SELECT * FROM (SELECT tick_start, violation_type, resource, "user", n, sum(n) OVER (PARTITION BY tick_start) AS tick_total
    FROM (SELECT time_bucket(INTERVAL 5 SECOND, ts) AS tick_start, violation_type, resource, coalesce(user_id, 'anon') AS "user",
                 count(*) AS n FROM e GROUP BY ALL))
  WHERE tick_start + INTERVAL 5 SECOND <= (SELECT max(ts) FROM e) - INTERVAL 300 SECOND""")
def s2_stream_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.stateful_session(spark, STATE_PARTITIONS)
    events = written(C.violation_events(spark, sf_dir), "s2-events")
    src = as_stream(own, events, "s2", F.struct("msg_id", "ord"), 120)
    return ran(spark, S.stream_audit(src, watermark="300 seconds"), "s2")


@C.register("s3_stream_usage", f"""WITH l AS {derived.request_log_sql()}
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS req, CAST(sum(tok_in) AS BIGINT) AS tok_in, CAST(sum(tok_out) AS BIGINT) AS tok_out,
         CAST(sum(bytes_in) AS BIGINT) AS bytes_in, CAST(sum(bytes_out) AS BIGINT) AS bytes_out
  FROM l GROUP BY user_id, CAST(ts AS DATE) HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) FROM l) - INTERVAL 2 HOUR""")
def s3_stream_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.stateful_session(spark, STATE_PARTITIONS)
    src = as_stream(own, derived.request_log(spark, sf_dir), "s3", F.col("req_id"), 3000)
    return ran(spark, S.stream_usage(src, watermark="2 hours"), "s3")


def _passed(sql: str, table: str, id_col: str, out_id: str | None = None, delay: str = "2 HOUR") -> str:
    """The rows of a batch oracle whose event the watermark has passed."""
    return f"""SELECT o.* FROM ({sql}) o JOIN {table} t ON t.{id_col} = o.{out_id or id_col}
  WHERE t.ts <= (SELECT max(ts) FROM {table}) - INTERVAL {delay}"""


@C.register("s4_stream_admission", _passed(C.REGISTRY["g8_quota_admission"][1], derived.request_log_sql(), "req_id"))
def s4_stream_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.stateful_session(spark, STATE_PARTITIONS, S.ROWS_AT_ONCE)
    src = as_stream(own, derived.request_log(spark, sf_dir), "s4", F.col("req_id"), 3000)
    users = own.read.schema((u := written(derived.users(spark, sf_dir), "s4-users")).schema).parquet(*u.inputFiles())
    return ran(spark, S.stream_admission(src, users, watermark="2 hours"), "s4")


@C.register("s5_stream_lockout", _passed(C.REGISTRY["i7_lockout_user"][1], derived.login_attempts_sql(), "attempt_id"))
def s5_stream_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.stateful_session(spark, STATE_PARTITIONS, S.ROWS_AT_ONCE)
    src = as_stream(own, derived.login_attempts(spark, sf_dir), "s5", F.col("attempt_id"), 3000)
    return ran(spark, S.stream_lockout(src, watermark="2 hours"), "s5")


@C.register("s5_stream_throttle", _passed(C.REGISTRY["i8_throttle_wide"][1], derived.request_log_sql(), "req_id", "event_id"))
def s5_stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = S.stateful_session(spark, STATE_PARTITIONS, S.ROWS_AT_ONCE)
    events = derived.request_log(spark, sf_dir).select("req_id", "ts", AC.bare_host(F.col("host")).alias("key"))
    src = as_stream(own, events, "s5t", F.col("req_id"), 3000)
    return ran(spark, S.stream_throttle(src, "key", id_col="req_id", window_s=6 * 3600, watermark="2 hours"), "s5t")


def reply_chunks(replies: DataFrame) -> DataFrame:
    """Replies (msg_id, body, ts) in chunks a millisecond apart; of those whose id 4 divides none is
    marked as the last."""
    chunks = SR.split_into_chunks(replies.withColumn("_last", SR.chunk_count() - 1), keep=("ts", "_last"))
    return chunks.select(
        "stream_id", "seq", "chunk", ((F.col("seq") == F.col("_last")) & (F.pmod("stream_id", F.lit(4)) != 0)).alias("fin"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.col("seq") * 1000).alias("ts"))


BINS = 10_000
SMALL_ROWS = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}   # numbers as differences


def chunks_as_stream(own: SparkSession, replies: DataFrame, jitter_s: float) -> DataFrame:
    """The chunks of replies (msg_id, body, ts, n_chunks) as a stream of SLICES micro-batches in order of time,
    but for ``jitter_s``. A slice's chunks are made of the replies that reach into it, as it is written; the
    cuts are where the replies' chunks, counted at the middle of each, come to equal shares."""
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    mid = replies.select((begin + F.col("n_chunks") * 500).alias("mid"), "n_chunks").where("mid IS NOT NULL")
    lo, hi, total = mid.agg(F.min("mid"), F.max("mid"), F.sum("n_chunks")).first()
    cuts: list[int] = []
    if total:
        width = max(1, -(-(hi - lo + 1) // BINS))
        seen = 0
        for i, n in sorted(mid.groupBy(F.expr(f"(mid - {lo}) div {width}").alias("i")).agg(F.sum("n_chunks")).collect()):   # BINS rows at most
            seen += n
            cuts += [lo + (i + 1) * width] * (min(SLICES - 1, seen * SLICES // total) - len(cuts))
    slack = int(jitter_s * 1_000_000)

    def between(low, high):
        own_replies = replies if high is None else replies.where(begin - slack <= high)
        own_replies = own_replies if low is None else own_replies.where(begin + F.col("n_chunks") * 1000 + slack > low)
        return dealt(reply_chunks(own_replies).withColumn("_at", moved(F.struct("stream_id", "seq"), jitter_s)), low, high)

    return sliced(own, "s6", cuts, between, **SMALL_ROWS)


_REPLY_TIMES = f"""(SELECT r.msg_id, r.body, coalesce(m.ts, TIMESTAMP '2024-01-01 00:00:00') AS ts
  FROM {C.REPLIES_SQL} r LEFT JOIN {C.MSG_SQL} m ON m.msg_id = r.msg_id)"""


@C.register("s6_stream_detokenize", f"""WITH t AS (SELECT msg_id, ts + to_milliseconds(CAST(greatest(ceil(strlen(body) / (abs(msg_id) % 13 + 1)), 1) - 1 AS BIGINT)) AS last
    FROM {_REPLY_TIMES})
  SELECT o.msg_id, o.restored FROM ({C._detok_sql(True)}) o JOIN t ON t.msg_id = o.msg_id
  WHERE t.msg_id % 4 <> 0 OR t.last + INTERVAL 30 SECOND <= (SELECT max(last) FROM t) - INTERVAL 10 SECOND""")
def s6_stream_detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked replies restored as they come; those without a last mark end when they fall silent. The
    result has the replies that ended."""
    own = S.stateful_session(spark, STATE_PARTITIONS)
    tokenized = written(C.tokenized_messages(spark, sf_dir).select("msg_id", "session_key", "ts", "tokenized", "detections"), "s6-tokenized")
    sent = tokenized.select("msg_id", "session_key", F.col("tokenized").alias("body"), "ts").unionByName(
        C.fixture_df(spark, "token_replies").withColumn("ts", F.lit("2024-01-01 00:00:00").cast(tokenized.schema["ts"].dataType)))
    static = {"vault": V.build_vault(V.token_entries(tokenized)), "sessions": sent.select(F.col("msg_id").alias("stream_id"), "session_key")}
    static = {k: own.read.schema(v.schema).parquet(*written(v, f"s6-{k}").inputFiles()) for k, v in static.items()}
    src = chunks_as_stream(own, sent.withColumn("n_chunks", SR.chunk_count()), 4)
    restored = ran(spark, S.stream_segments(src), "s6", lambda b, _: SR.restore_segments(b, static["sessions"], static["vault"], split=True))
    ended = restored.where("ends").select("stream_id")
    return SR.joined(restored.join(ended, "stream_id", "left_semi")).select(F.col("stream_id").alias("msg_id"), "restored")
