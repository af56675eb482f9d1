"""Ordered per-key folds (G8, I7, I8): state machines that a window sum cannot express.

What a fold needs Python for is kept small, and no key is one task's work where the rule allows a cut:

* G8 admits whole (user, day) groups by plain sums, finds the first rejection of the others by prefix
  sums over blocks of time, rejects in SQL what can never fit after it, and folds only the rest.
* I8 cuts a key's time into blocks; each block is solved for every event its chain may begin with, a
  short walk over the blocks picks the true beginnings, and each block then gives out its chain.
* I7 is sequential while counters may lock. Attempts of users and addresses that never collect enough
  failures to be locked need no state; the others are folded by key, or, where user and address locks
  act together, by connected component of the (user, address) graph.

Folds hash-partition by key, sort within partitions and walk the rows in one ``mapInPandas`` pass that
carries the state across Arrow batches: a long key streams through its task in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanshield.operators.components import connected_components

# Lockout thresholds (failures before a lock, lock length in seconds) and the
# warning throttle window.
USER_MAX_FAILS, USER_LOCK_S = 5, 30
IP_MAX_FAILS, IP_LOCK_S = 20, 300
THROTTLE_WINDOW_S = 60


ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "date": pa.date32(), "timestamp": pa.timestamp("us", "UTC")}


def _ordered(df: DataFrame, keys: list[str], order: list[str], num_partitions: int | None) -> DataFrame:
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys).sortWithinPartitions(*keys, *order)


def _fold(df: DataFrame, keys: list[str], order: list[str], schema: str,
          make_step: Callable[[], tuple[Callable, Callable]], num_partitions: int | None = None) -> DataFrame:
    """Run ``step(state, row) -> (state, out_row or None)`` over each key's rows in order; a row is a
    dict, nulls are None."""
    out_cols, kinds = zip(*(c.split() for c in schema.split(",")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, init = make_step()
        cur_key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                k = [row[c] for c in keys]
                if k != cur_key:
                    cur_key, state = k, init()
                state, emitted = step(state, row)
                if emitted is not None:
                    out.append(emitted)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, ARROW[k]) for c, k in zip(zip(*out), kinds)], names=out_cols)

    return _ordered(df, keys, order, num_partitions).mapInArrow(run, schema)


# --- G8 ------------------------------------------------------------------------------------------
ADMISSION_SCHEMA = "req_id long, user_id string, day date, admitted boolean"
_AMOUNTS = ["req", "tok_in", "tok_out", "bytes_in", "bytes_out"]
_LIMITS = ["quota_req_day", "quota_tok_in", "quota_tok_out", "quota_bytes_in", "quota_bytes_out"]


def admission_input(log: DataFrame, users: DataFrame) -> DataFrame:
    """The log with its UTC day and its user's limits."""
    q = users.select(F.col("id").alias("user_id"), *_LIMITS)
    return log.withColumn("day", F.to_date("ts")).join(q, "user_id", "left") \
        .select("user_id", "day", "ts", "req_id", *_AMOUNTS[1:], *_LIMITS)


def _fits(amount: Callable[[str], object], room: Callable[[str], object]):
    """Every amount is within its limit; a null limit limits nothing."""
    cond = F.lit(True)
    for a, limit in zip(_AMOUNTS, _LIMITS):
        cond = cond & (F.col(limit).isNull() | (amount(a) <= room(limit)))
    return cond


def admission_parts(log: DataFrame, users: DataFrame, block: str = "hour") -> tuple[DataFrame, DataFrame]:
    """G8 without its fold: (decided rows, rows that the fold has to decide).

    A group whose sums fit is admitted as a whole. In the others all rows before the first one that
    does not fit are admitted: prefix sums inside blocks of time plus the sums of the blocks before.
    After it usage never falls, so what does not fit beside the usage reached there never will. The
    rest, with that usage as the fold's start (``used_*``), is left to the fold. A negative amount
    breaks this order; such a group goes to the fold as a whole."""
    zero = F.lit(0).cast("long")
    d = admission_input(log, users).withColumn("req", F.lit(1).cast("long"))
    d = d.withColumns({a: F.coalesce(F.col(a), zero) for a in _AMOUNTS}).withColumn("block", F.date_trunc(block, "ts"))
    group = ["user_id", "day"]
    negative = F.max(F.least(*[F.col(a) for a in _AMOUNTS]) < 0)
    blocks = d.groupBy(*group, "block", *_LIMITS).agg(negative.alias("negative"), *[F.sum(a).alias(f"sum_{a}") for a in _AMOUNTS])
    earlier = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    blocks = blocks.withColumns({f"start_{a}": F.coalesce(F.sum(f"sum_{a}").over(earlier), zero) for a in _AMOUNTS}
                                | {f"all_{a}": F.sum(f"sum_{a}").over(whole) for a in _AMOUNTS} | {"negative": F.max("negative").over(whole)})
    # of a block: all of it fits (all), some of it may (some), the first rejection lies before it (none)
    blocks = blocks.withColumn("kind", F.when(F.col("negative"), "fold").when(_fits(lambda a: F.col(f"all_{a}"), F.col), "all")
                               .when(_fits(lambda a: F.col(f"start_{a}") + F.col(f"sum_{a}"), F.col), "all").otherwise("some"))
    some = F.when(F.col("kind") == "some", F.col("block"))
    blocks = blocks.withColumn("first", F.min(some).over(whole)).withColumn(
        "kind", F.when((F.col("kind") == "some") & (F.col("block") > F.col("first")), "none").otherwise(F.col("kind")))
    facts = blocks.select(*[F.col(c).alias(f"b_{c}") for c in [*group, "block"]], "kind", *[f"start_{a}" for a in _AMOUNTS], "first")
    d = d.join(facts, F.col("user_id").eqNullSafe(F.col("b_user_id")) & F.col("day").eqNullSafe(F.col("b_day"))
               & F.col("block").eqNullSafe(F.col("b_block"))).drop("b_user_id", "b_day", "b_block")

    # prefix sums inside the one block of a group where the first rejection is
    upto = Window.partitionBy(*group, "block").orderBy("ts", "req_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = d.where(F.col("kind") == "some").withColumns({f"upto_{a}": F.col(f"start_{a}") + F.sum(a).over(upto) for a in _AMOUNTS})
    inside = inside.withColumn("over", ~_fits(lambda a: F.col(f"upto_{a}"), F.col))
    inside = inside.withColumn("over", F.max("over").over(upto))
    reached = inside.groupBy(*group).agg(*[
        F.max(F.when(F.col("over"), F.col(f"start_{a}")).otherwise(F.col(f"upto_{a}"))).alias(f"used_{a}") for a in _AMOUNTS])
    reached = reached.select(F.col("user_id").alias("r_user"), F.col("day").alias("r_day"), *[f"used_{a}" for a in _AMOUNTS])

    plain = ["req_id", "user_id", "day"]
    decided = d.where(F.col("kind") == "all").select(*plain, F.lit(True).alias("admitted"))
    decided = decided.unionByName(inside.where(~F.col("over")).select(*plain, F.lit(True).alias("admitted")))
    after = inside.where("over").select(*d.columns).unionByName(d.where(F.col("kind") == "none"))
    after = after.join(reached, F.col("user_id").eqNullSafe(F.col("r_user")) & F.col("day").eqNullSafe(F.col("r_day"))).drop("r_user", "r_day")
    may = _fits(lambda a: F.col(a) + F.col(f"used_{a}"), F.col)
    decided = decided.unionByName(after.where(~may).select(*plain, F.lit(False).alias("admitted")))
    rest = after.where(may).unionByName(d.where(F.col("kind") == "fold").withColumns({f"used_{a}": zero for a in _AMOUNTS}))
    return decided, rest.select("user_id", "day", "ts", "req_id", *_AMOUNTS, *_LIMITS, *[f"used_{a}" for a in _AMOUNTS])


def quota_admission(log: DataFrame, users: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Replay each (user, UTC day) in time order; a request is recorded only if usage + delta
    stays within every limit (null = unlimited); rejected requests add nothing. Null amounts count 0."""
    decided, rest = admission_parts(log, users)
    return decided.unionByName(_fold(rest, ["user_id", "day"], ["ts", "req_id"], ADMISSION_SCHEMA, admission_step, num_partitions))


def admission_step():
    """State: usage so far in the (user, day) group, one integer per quota, from ``used_*`` on."""
    def step(cur, r):
        cur = cur or [r[f"used_{a}"] for a in _AMOUNTS]
        after = [c + r[a] for c, a in zip(cur, _AMOUNTS)]
        ok = all(r[limit] is None or v <= r[limit] for v, limit in zip(after, _LIMITS))
        return (after if ok else cur), (r["req_id"], r["user_id"], r["day"], ok)
    return step, lambda: None


# --- I7 ------------------------------------------------------------------------------------------
LOCKOUT_SCHEMA = "attempt_id long, key string, outcome string, locked_until timestamp"


def lockout(attempts: DataFrame, key_col: str = "username", max_fails: int = USER_MAX_FAILS,
            lock_seconds: int = USER_LOCK_S, num_partitions: int | None = None) -> DataFrame:
    """Consecutive-failure lock per key. Attempts while locked are ``refused`` and not
    counted; a success clears the counter; reaching ``max_fails`` locks for ``lock_seconds`` and
    resets the counter; failures never age out. One kind of key alone; ``lockout_both`` has both."""
    d = attempts.select("attempt_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("ok", F.lit(False)).alias("ok"),
                        F.col(key_col).alias("key"))
    # a key with fewer failures in all than the limit is never locked: no fold
    live = d.where(~F.col("ok")).groupBy("key").count().where(F.col("count") >= max_fails).select(F.col("key").alias("l_key"), F.lit(True).alias("live"))
    d = d.join(live, F.col("key").eqNullSafe(F.col("l_key")), "left").drop("l_key")
    plain = d.where(F.col("live").isNull()).select("attempt_id", "key", F.when(F.col("ok"), "ok").otherwise("fail").alias("outcome"),
                                                   F.lit(None).cast("timestamp").alias("locked_until"))
    return plain.unionByName(_fold(d.where("live").drop("live"), ["key"], ["ts", "attempt_id"], LOCKOUT_SCHEMA,
                                   lockout_step(max_fails, lock_seconds), num_partitions))


def lockout_step(max_fails: int = USER_MAX_FAILS, lock_seconds: int = USER_LOCK_S):
    """State: (consecutive failures, locked-until or None)."""
    lock = pd.Timedelta(seconds=lock_seconds).to_pytimedelta()

    def make():
        def step(state, r):
            fails, until = state
            if until is not None and r["ts"] < until:
                return (fails, until), (r["attempt_id"], r["key"], "refused", until)
            if r["ok"]:
                return (0, None), (r["attempt_id"], r["key"], "ok", None)
            fails += 1
            if fails >= max_fails:
                until = r["ts"] + lock
                return (0, until), (r["attempt_id"], r["key"], "locked", until)
            return (fails, None), (r["attempt_id"], r["key"], "fail", None)
        return step, lambda: (0, None)
    return make


BOTH_SCHEMA = "attempt_id long, username string, ip string, outcome string"


def lockout_both(attempts: DataFrame, user_fails: int = USER_MAX_FAILS, user_lock_s: int = USER_LOCK_S,
                 ip_fails: int = IP_MAX_FAILS, ip_lock_s: int = IP_LOCK_S, num_partitions: int | None = None) -> DataFrame:
    """I7 with both rules at once: an attempt is ``refused`` while its user or its address is locked and
    changes nothing then; a success clears the counters and locks of both; a failure counts for both
    and locks either that reaches its limit (``locked_user``, ``locked_ip``, ``locked_both``, else ``fail``).

    Counters of one user and of many addresses meet, so the fold's key is the connected component of
    the (user, address) graph. A user or address with fewer failures in all than its limit can never
    be locked: it carries no state and joins nothing, and attempts of two such are decided without a
    fold. Null users and addresses are names like any other."""
    d = attempts.select("attempt_id", F.col("ts").cast("timestamp").alias("ts"), F.coalesce("ok", F.lit(False)).alias("ok"), "username", "ip")
    fails = F.sum((~F.col("ok")).cast("long"))
    users = d.groupBy("username").agg(fails.alias("n")).where(F.col("n") >= user_fails).select(F.col("username").alias("u_name"), F.lit(True).alias("u_live"))
    ips = d.groupBy("ip").agg(fails.alias("n")).where(F.col("n") >= ip_fails).select(F.col("ip").alias("i_name"), F.lit(True).alias("i_live"))
    d = (d.join(users, F.col("username").eqNullSafe(F.col("u_name")), "left").join(ips, F.col("ip").eqNullSafe(F.col("i_name")), "left")
         .withColumn("u", F.when(F.col("u_live"), F.concat(F.lit("u"), F.coalesce("username", F.lit("\0")))))
         .withColumn("i", F.when(F.col("i_live"), F.concat(F.lit("i"), F.coalesce("ip", F.lit("\0")))))
         .select("attempt_id", "ts", "ok", "username", "ip", "u", "i"))
    plain = d.where(F.col("u").isNull() & F.col("i").isNull()).select(
        "attempt_id", "username", "ip", F.when(F.col("ok"), "ok").otherwise("fail").alias("outcome"))
    live = d.where(F.col("u").isNotNull() | F.col("i").isNotNull())
    parts = connected_components(live.where(F.col("u").isNotNull() & F.col("i").isNotNull()).select("u", "i"), "u", "i")
    node = F.coalesce("u", "i")
    # instants as microseconds: a time with a zone is dear to turn into a Python object
    live = live.join(parts, node == F.col("node"), "left").withColumn("part", F.coalesce("component", node)).withColumn(
        "at", F.unix_micros("ts")).drop("node", "component", "ts")
    locks = {"u": (user_fails, user_lock_s * 1_000_000), "i": (ip_fails, ip_lock_s * 1_000_000)}

    def make():
        def step(state, r):
            out = (r["attempt_id"], r["username"], r["ip"])
            nodes = [n for n in (r["u"], r["i"]) if n is not None]
            if any(state.get(n, (0, None))[1] is not None and r["at"] < state[n][1] for n in nodes):
                return state, (*out, "refused")
            if r["ok"]:
                for n in nodes:
                    state.pop(n, None)
                return state, (*out, "ok")
            locked = []
            for n in nodes:
                most, lock = locks[n[0]]
                count = state.get(n, (0, None))[0] + 1
                state[n] = (0, r["at"] + lock) if count >= most else (count, None)
                locked += [n[0]] * (count >= most)
            return state, (*out, {"": "fail", "u": "locked_user", "i": "locked_ip", "ui": "locked_both"}["".join(locked)])
        return step, dict

    return plain.unionByName(_fold(live, ["part"], ["at", "attempt_id"], BOTH_SCHEMA, make, num_partitions))


# --- I8 ------------------------------------------------------------------------------------------
THROTTLE_SCHEMA = "event_id long, key string, ts timestamp"
BLOCK_WINDOWS = 1024


def _chain(at: np.ndarray, window: int) -> np.ndarray:
    """For each sorted instant the place of the first one a window or more later; ``len(at)`` for none."""
    return np.searchsorted(at, at + window, "left")


def throttle(events: DataFrame, key_col: str, window_s: int = THROTTLE_WINDOW_S, id_col: str = "event_id",
             num_partitions: int | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """I8: emit at most once per key per window, measured from the last *emitted* event; of events at
    the same instant the one with the smallest id.

    The emitted events are a chain: each leads to the first event a window or more later. Time is cut
    into blocks of ``block_windows`` windows. Any event that lies in a block's first window, or is the
    first after it, may be where the chain enters; pointer doubling gives for each of these the last
    event of its chain in the block. One walk over a key's blocks, a row each, then picks the entries,
    and the blocks give out their chains. A key's events are spread over as many tasks as it has blocks."""
    window = window_s * 1_000_000
    length = window * block_windows
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = events.select(F.col(id_col).cast("long").alias("event_id"), "ts", F.col(key_col).cast("string").alias("key"), at.alias("at"))
    own = own.groupBy("key", "at").agg(F.min_by("ts", "event_id").alias("ts"), F.min("event_id").alias("event_id"))
    own = own.withColumn("block", F.floor(F.col("at") / length).cast("long"))

    def entries(key, table):
        t = np.sort(table.column("at").to_numpy())
        begin = key[1].as_py() * length
        n = min(len(t), int(np.searchsorted(t, begin + window, "left")) + 1)
        jump = _chain(t, window)
        last = np.where(jump < len(t), jump, np.arange(len(t)))
        while (last[last] != last).any():  # twice as far each time, until every chain is at its end
            last = last[last]
        return pa.table({"key": pa.array([key[0].as_py()], pa.string()), "block": [key[1].as_py()], "enter": pa.array([t[:n].tolist()], pa.list_(pa.int64())),
                         "last": pa.array([t[last[:n]].tolist()], pa.list_(pa.int64()))})

    solved = own.groupBy("key", "block").applyInArrow(entries, "key string, block long, enter array<long>, last array<long>")

    def make():
        def step(state, r):
            place = 0 if state is None else int(np.searchsorted(r["enter"], state + window, "left"))
            if place == len(r["enter"]):
                return state, None
            return r["last"][place], (r["key"], r["block"], r["enter"][place])
        return step, lambda: None

    picked = _fold(solved, ["key"], ["block"], "key string, block long, enter long", make, num_partitions)

    def emit(key, left, right):
        if not right.num_rows or not left.num_rows:
            return left.slice(0, 0).select(["event_id", "key", "ts"])
        left = left.sort_by("at")
        t = left.column("at").to_numpy()
        jump, place, chosen = _chain(t, window), int(np.searchsorted(t, right.column("enter")[0].as_py())), []
        while place < len(t):
            chosen.append(place)
            place = int(jump[place])
        return left.take(pa.array(chosen, pa.int64())).select(["event_id", "key", "ts"])

    out = f"event_id long, key string, ts {events.schema['ts'].dataType.simpleString()}"
    return own.groupBy("key", "block").cogroup(picked.toDF("key", "block", "enter").groupBy("key", "block")).applyInArrow(emit, out)
