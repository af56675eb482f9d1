"""Streams over files equal the batch operators over the same rows (S1-S6), plus D7 chunking."""
import datetime
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanshield.operators import audit as AU
from spanshield.operators import folds as FO
from spanshield.operators import rewrite as R
from spanshield.operators import vault as V
from spanshield.plans import catalog as C
from spanshield.plans import derived
from spanshield.plans import stream_catalog as SC
from spanshield.plans.checks import compare, duck
from spanshield.streaming import streams as S


@pytest.fixture(scope="module")
def own(spark):
    return S.stateful_session(spark, 4)


def batches(own, frames, name):
    """A stream with one micro-batch a frame."""
    path = SC.folder(own, name)
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(path)
    return own.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def shuffled(spark, rows, schema, parts, seed=1):
    """``rows`` dealt over micro-batches at random: order across them is lost."""
    random.Random(seed).shuffle(rows)
    return [spark.createDataFrame(rows[i::parts], schema) for i in range(parts)]


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


SC_DIR = os.environ.get("SPANSHIELD_TEST_SF", "/root/testdata/sf0.001")
instant = datetime.datetime.fromisoformat
END = "2031-01-01 00:00:00"  # a row of a later time moves the watermark past all others


def test_s2_total_and_late_rows(spark, own):
    schema = "ts timestamp, violation_type string, resource string, user_id string"
    at = "2024-01-01 00:00:{:02d}"
    first = [(at.format(i % 20), "SECRET", "h", f"u{i % 3}" if i % 5 else None) for i in range(60)]
    late = [(at.format(1), "LATE", "h", "u0")]
    frames = [spark.createDataFrame([(instant(t), *r) for t, *r in rows], schema)
              for rows in (first[:40], [*first[40:], (at.format(50), "NEW", "h", "u1")], [(at.format(51), "NEW", "h", "u2")], late,
                           [(END, "END", "h", "u1")])]
    got = SC.ran(spark, S.stream_audit(batches(own, frames, "late"), watermark="20 seconds"), "late")
    kept = frames[0].unionByName(frames[1]).unionByName(frames[2])
    want = AU.audit_batches(kept)
    cols = ["tick_start", "violation_type", "resource", "user", "n", "tick_total"]
    # the late row met a watermark of 00:00:30 and is gone; END's own tick stays open
    assert rows_of(got, cols) == rows_of(want, cols)


def test_s4_over_shuffled_batches_and_state_ends(spark, own):
    log = derived.request_log(spark, SC_DIR).where("ts < '2024-01-06'")
    users = derived.users(spark, SC_DIR)
    rows = [tuple(r) for r in log.collect()]
    frames = shuffled(spark, rows, log.schema, 3)
    end = spark.createDataFrame([(-1, "nobody", instant(END), *rows[0][3:])], log.schema)
    src = batches(own, [*frames, end], "s4")
    out = S.stream_admission(src, own.createDataFrame(users.collect(), users.schema), watermark="10 days")
    got = SC.ran(spark, out, "s4t").where("req_id >= 0")
    want = FO.quota_admission(log, users)
    assert rows_of(got, ["req_id", "admitted"]) == rows_of(want, ["req_id", "admitted"])
    flags = {r[1] for r in rows_of(want, ["req_id", "admitted"])}
    assert flags == {True, False}


def state_rows(own, df, name):
    """Run ``df`` and count the rows that its state store holds in the end."""
    q = (df.writeStream.outputMode("append").format("parquet").option("path", SC.folder(own, name + "-o"))
         .option("checkpointLocation", SC.folder(own, name + "-c")).trigger(availableNow=True).start())
    q.awaitTermination()
    return [p["stateOperators"][0]["customMetrics"].get("rocksdbNumInternalKeys", 0) or p["stateOperators"][0]["numRowsTotal"]
            for p in (x if isinstance(x, dict) else json.loads(x.json) for x in q.recentProgress)]


def test_s4_state_is_gone_after_the_day(own, spark):
    log = derived.request_log(spark, SC_DIR).where("ts < '2024-01-03'")
    end = log.limit(1).withColumn("ts", F.lit(END).cast(log.schema["ts"].dataType))
    users = derived.users(spark, SC_DIR)
    src = batches(own, [log, end, end.withColumn("ts", F.col("ts") + F.expr("interval 3 days"))], "s4e")
    out = S.stream_admission(src, own.createDataFrame(users.collect(), users.schema), watermark="1 hour")
    held = state_rows(own, out, "s4e")
    assert max(held) > 20 and held[-1] <= 4, held


def test_s4_state_calls_go_by_bucket_not_by_user(own, spark):
    log = derived.request_log(spark, SC_DIR).where("ts < '2024-01-03'").limit(8000 // 10)
    log = log.crossJoin(spark.range(10 * S.BUCKETS // log.count() + 1).toDF("k")).withColumn(
        "user_id", F.concat(F.lit("w"), F.row_number().over(Window.orderBy("req_id", "k")).cast("string"))).drop("k")
    end = log.limit(1).withColumn("ts", F.lit(END).cast(log.schema["ts"].dataType))
    users = own.createDataFrame([("nobody", *[None] * 5)], "id string, " + ", ".join(f"{c} long" for c in S._LIMITS))
    out = S.stream_admission(batches(own, [log, end], "s4b"), users, watermark="1 hour")
    assert log.count() >= 10 * S.BUCKETS
    assert max(state_rows(own, out, "s4b")) <= 6 * S.BUCKETS   # one entry a row and two a timer of each user before


def test_s5_over_shuffled_batches(spark, own):
    att = derived.login_attempts(spark, SC_DIR).withColumn("ok", F.col("attempt_id") % 5 == 0)
    rows = [tuple(r) for r in att.collect()]
    end = spark.createDataFrame([(-1, instant(END), "nobody", "10.0.0.0", True)], att.schema)
    frames = [*shuffled(spark, rows, att.schema, 3), end]
    got = SC.ran(spark, S.stream_lockout(batches(own, frames, "s5"), watermark="60 days"), "s5").where("attempt_id >= 0")
    want = FO.lockout(att)
    cols = ["attempt_id", "outcome", "locked_until"]
    assert rows_of(got, cols) == rows_of(want, cols)
    assert {r.outcome for r in want.select("outcome").distinct().collect()} >= {"ok", "fail", "locked"}
    events = att.select(F.col("attempt_id").alias("event_id"), "ts", F.col("ip").alias("key"))
    rows = [tuple(r) for r in events.collect()]
    frames = [*shuffled(spark, rows, events.schema, 3, seed=2), spark.createDataFrame([(-1, instant(END), "nobody")], events.schema)]
    got = SC.ran(spark, S.stream_throttle(batches(own, frames, "s5t"), "key", window_s=7200, watermark="60 days"), "s5t").where("event_id >= 0")
    assert rows_of(got, ["event_id"]) == rows_of(FO.throttle(events, "key", 7200), ["event_id"])


def test_s6_early_chunks_silent_streams_and_nulls(spark, own):
    texts = {1: "plain text", 2: "мир [KEY_00000000000000aa] end", 3: "silent [KEY_0000000000", 4: ""}
    rows, last = [], {}
    for sid, text in texts.items():
        data = text.encode()
        parts = [data[i:i + 3] for i in range(0, len(data), 3)] or [None]
        last[sid] = len(parts) - 1
        rows += [(sid, seq, bytearray(p) if p is not None else None, sid != 3 and seq == len(parts) - 1, instant(f"2024-01-01 00:00:{seq:02d}"))
                 for seq, p in enumerate(parts)]
    schema = "stream_id long, seq long, chunk binary, fin boolean, ts timestamp"
    frames = [*shuffled(spark, rows, schema, 3), spark.createDataFrame([(9, 0, bytearray(b"x"), True, instant(END))], schema),
              spark.createDataFrame([(10, 0, bytearray(b"y"), None, instant(END))], schema)]
    got = SC.ran(spark, S.stream_segments(batches(own, frames, "s6"), watermark="1 minute"), "s6").collect()
    text = {}
    for r in sorted(got, key=lambda r: (r.stream_id, r.seg)):
        text[r.stream_id] = text.get(r.stream_id, "") + r.text
    assert text == {**texts, 9: "x"}
    assert sorted(r.stream_id for r in got if r.ends) == [1, 2, 3, 4, 9]


def test_s6_chunks_of_a_batch_make_one_segment(spark, own):
    rows = [(1, i, bytearray(b"x"), i == 1999, instant("2024-01-01 00:00:00")) for i in range(2000)]
    frame = spark.createDataFrame(rows, "stream_id long, seq long, chunk binary, fin boolean, ts timestamp")
    got = SC.ran(spark, S.stream_segments(batches(own, [frame], "s6o")), "s6o").orderBy("seg").collect()
    assert "".join(r.text for r in got) == "x" * 2000 and len(got) == 2  # the text, and what was held back for the end


@pytest.mark.parametrize("name", sorted(n for n in C.REGISTRY if n.startswith(("s1_", "s2_", "s3_", "s4_", "s5_", "s6_"))))
def test_registered_streams(spark, sf_dir, name):
    result = compare(C.REGISTRY[name][0](spark, sf_dir), duck(sf_dir), C.REGISTRY[name][1])
    assert result["ok"] and result["rows_spark"] > 0, result


def test_roundtrip(spark, sf_dir):
    """detokenize(tokenize(x)) == x for every message without a token collision."""
    t = R.tokenize(derived.messages(spark, sf_dir), "body")
    vault = V.build_vault(V.token_entries(t))
    rep = t.select("msg_id", "session_key", F.col("tokenized").alias("body"))
    back = V.detokenize(rep, vault).select("msg_id", "restored")
    orig = derived.messages(spark, sf_dir).select("msg_id", F.col("body").alias("orig"))
    bad = back.join(orig, "msg_id").where(F.col("restored") != F.col("orig")).count()
    assert bad == 0


def test_s5_holds_a_bucket_in_one_row_and_its_locks_end_at_an_instant(spark):
    att = derived.login_attempts(spark, SC_DIR).withColumn("ok", F.col("attempt_id") % 5 == 0).withColumn("ts", F.col("ts").cast("timestamp"))
    end = att.limit(1).withColumns({"attempt_id": F.lit(-1).cast("long"), "ts": F.lit(END).cast("timestamp")})
    east = S.stateful_session(spark, 4)
    east.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    out = S.stream_lockout(batches(east, [att, end], "s5z"), watermark="1 hour")
    path, progress = SC.folder(east, "s5z-o"), []
    q = (out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", SC.folder(east, "s5z-c"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    progress = [x if isinstance(x, dict) else json.loads(x.json) for x in q.recentProgress]
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= S.BUCKETS   # a row a bucket, no timers beside it
    cols = ["attempt_id", "outcome", F.unix_micros("locked_until").alias("until")]
    got, want = spark.read.parquet(path).where("attempt_id >= 0").select(*cols), FO.lockout(att).select(*cols)
    assert rows_of(got, ["attempt_id", "outcome", "until"]) == rows_of(want, ["attempt_id", "outcome", "until"])


def test_s6_mixed_repeated_and_early_chunks_by_bucket(spark, own):
    """2,000 streams whose chunks come mixed, early and twice; a third of them without a last mark."""
    rng, rows, want = random.Random(7), [], {}
    for sid in [None, *range(2000)]:
        data = f"мир [KEY_00000000000000aa] {sid} ".encode() * rng.randint(1, 3)
        cuts = sorted(rng.sample(range(1, len(data)), 5))
        parts = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])]
        want[sid] = data.decode()
        rows += [(sid, i, bytearray(p), (sid or 0) % 3 != 0 and i == 5, instant(f"2024-01-01 00:00:0{i}")) for i, p in enumerate(parts)]
    schema = "stream_id long, seq long, chunk binary, fin boolean, ts timestamp"
    again = [r for r in rows if (r[0] or 0) % 3 == 0 and r[1] % 2][:500]   # streams that are still open
    frames = [*shuffled(spark, rows, schema, 3), spark.createDataFrame(again, schema), spark.createDataFrame([(-1, 0, bytearray(b"x"), True, instant(END))], schema)]
    path = SC.folder(own, "s6m-o")
    q = (S.stream_segments(batches(own, frames, "s6m"), watermark="1 minute").writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", SC.folder(own, "s6m-c")).trigger(availableNow=True).start())
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in (x if isinstance(x, dict) else json.loads(x.json) for x in q.recentProgress)]
    assert 0 < max(held) <= S.BUCKETS and held[-1] == 0, held   # a row a bucket; nothing is left of streams that ended
    text, ends = {}, []
    for r in spark.read.parquet(path).orderBy("seg").collect():
        text[r.stream_id] = text.get(r.stream_id, "") + r.text
        ends += [r.stream_id] * r.ends
    assert text == want | {-1: "x"} and sorted(ends, key=repr) == sorted(text, key=repr)


def test_s6_neighbouring_chunks_of_mixed_streams_are_one_row(spark):
    rows = [(s, i, bytearray(bytes([65 + s]) * 3), i == 99, 1000 * i) for i in range(100) for s in (1, 2)]
    batch = spark.createDataFrame(rows, "stream_id long, seq long, chunk binary, fin boolean, at long").toArrow().combine_chunks().to_batches()[0]
    runs = [r for b in S._timed_runs([batch]) for r in b.to_pylist()]
    assert [(r["stream_id"], r["seq"], r["last"], r["chunk"], r["fin"], r["at"]) for r in runs] == [
        (s, 0, 99, bytes([65 + s]) * 300, 99, 99_000) for s in (1, 2)]


def test_s6_slices_hold_all_chunks(spark, own):
    replies = derived.messages(spark, SC_DIR).select("msg_id", "body", "ts").withColumn("n_chunks", SC.SR.chunk_count())
    src = SC.chunks_as_stream(own, replies, 4)
    cols = ["stream_id", "seq", "chunk", "fin", "ts"]
    counts = []

    def each(batch, epoch):
        counts.append(batch.count())
        return batch

    got, want = SC.ran(own, src, "s6c", each).select(*cols), SC.reply_chunks(replies.drop("n_chunks")).select(*cols)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert len(counts) == SC.SLICES and min(counts) > 0
    step = (F.col("ts") + F.make_dt_interval(secs=F.col("seq") / F.lit(1000.0))).alias("at")
    assert want.select("stream_id", "seq", "ts").exceptAll(replies.select(F.col("msg_id").alias("stream_id"), "ts", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("seq"))
                                                           .select("stream_id", "seq", step)).count() == 0


class HeldState:
    """What a fold needs of GroupState."""
    exists, get, passed = False, None, 0

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def getCurrentWatermarkMs(self):
        return self.passed

    def setTimeoutTimestamp(self, ms):
        pass


def test_a_key_with_many_rows_is_held_small_and_folded_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 1000)
    folds, real = [], S.ordered_fold
    monkeypatch.setattr(S, "ordered_fold", lambda *a: folds.append(real(*a)) or folds[-1])
    sample = spark.createDataFrame([(1, instant("2024-01-01 00:00:00"), "host")], "event_id long, ts timestamp, key string")
    S.stream_throttle(sample, "key", window_s=50)
    rng, rows = random.Random(3), []
    state, got, times = HeldState(), [], set()

    def into(n, low, high):
        new = [(rng.randrange(low, high), len(rows) + i, "host") for i in range(n)]
        rows.extend(new)
        return [pd.DataFrame(new[i:i + 700], columns=["at", "event_id", "key"]) for i in range(0, n, 700)]

    # three micro-batches of a key, then the watermark beyond all; rows wait for it in small blocks
    for k, batch in enumerate([into(20_000, 0, 10**10), into(20_000, 10**10, 2 * 10**10), into(5, 2 * 10**10, 3 * 10**10), []]):
        state.passed = 10**7 * k
        for pdf in folds[0]((1,), iter(batch), state):
            got += pdf["event_id"].tolist()
        if k < 2:
            assert len(state.get[0]) < 12 * 20_000   # at and id have 16 bytes a row, the key 8 more
            sizes = [b.num_rows for b in S._blocks(state.get[0], S._arrow_schema(T.StructType.fromDDL("at long, event_id long, key string")))]
            assert sum(sizes) == 20_000 and 1000 <= max(sizes) < 2000 and len(sizes) <= 20
    last, want = None, []
    for at, event_id, _ in sorted(rows):
        if last is None or at - last >= 50_000_000:
            want.append(event_id)
            last = at
    assert got == want and len(want) > 300


def test_a_state_travels_once_with_many_rows_of_its_key(spark):
    """Spark sends a key's state again with each Arrow batch of its rows."""
    own = S.stateful_session(spark, 4, S.ROWS_AT_ONCE)
    rows = spark.range(30_000).select(F.lit(1).alias("k"), "id")

    def count(key, pdfs, state):
        yield pd.DataFrame({"n": [sum(1 for _ in pdfs)]})

    out = batches(own, [rows], "once").groupBy("k").applyInPandasWithState(count, "n long", "x long", "append", S.GroupStateTimeout.NoTimeout)
    assert [r.n for r in SC.ran(spark, out, "once").collect()] == [1]
