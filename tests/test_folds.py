"""Ordered folds against plain loops, on one hot key too, and what is left to Python."""
import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanshield.operators import folds as FO
from spanshield.operators.components import connected_components
from spanshield.plans import derived

T0 = dt.datetime(2024, 3, 1)
LOG = "req_id long, user_id string, ts timestamp, tok_in long, tok_out long, bytes_in long, bytes_out long"
USERS = "id string, quota_req_day long, quota_tok_in long, quota_tok_out long, quota_bytes_in long, quota_bytes_out long"


def admitted_by_loop(log, users):
    limits, used, out = {u[0]: u[1:] for u in users}, {}, {}
    for r in sorted(log, key=lambda r: (r[2], r[0])):
        key = (r[1], r[2].date())
        cur = used.setdefault(key, [0] * 5)
        new = [c + (v or 0) for c, v in zip(cur, (1, *r[3:]))]
        out[r[0]] = all(m is None or v <= m for v, m in zip(new, limits.get(r[1], (None,) * 5)))
        if out[r[0]]:
            used[key] = new
    return out


def test_quota_admission_against_a_loop(spark):
    rng = random.Random(3)
    users = [("hot", 900, 2000, None, None, 9000), ("calm", None, None, None, None, None), ("tight", 3, 50, 10, 100, 10), ("none", 0, None, None, None, None)]
    log = [(i, rng.choice(["hot", "hot", "calm", "tight", "none", "unknown"]), T0 + dt.timedelta(seconds=rng.randrange(2 * 86_400)),
            rng.choice([0, 1, 2, 30, None]), rng.randrange(5), rng.randrange(9), rng.randrange(40)) for i in range(3000)]
    log += [(9000 + i, "hot", T0 + dt.timedelta(hours=5), 1, 1, 1, 1) for i in range(30)]           # ties in time
    log += [(9100 + i, "back", T0 + dt.timedelta(hours=i), [5, -3, 4, -9, 20, 1][i], 0, 0, 0) for i in range(6)]  # a negative amount
    users.append(("back", None, 6, None, None, None))
    table, people = spark.createDataFrame(log, LOG), spark.createDataFrame(users, USERS)
    got = {r.req_id: r.admitted for r in FO.quota_admission(table, people).collect()}
    assert got == admitted_by_loop(log, users)
    assert FO.quota_admission(spark.createDataFrame([], LOG), people).count() == 0


def test_few_rows_are_left_to_the_fold(spark, sf_dir):
    log, users = derived.request_log(spark, sf_dir), derived.users(spark, sf_dir)
    roomy = users.withColumns({c: users[c] * 25 for c in FO._LIMITS})
    decided, rest = FO.admission_parts(log, roomy)
    n, left = decided.count(), rest.count()
    assert n + left == log.count() and left < 0.05 * n, (n, left)
    flags = Counter(r.admitted for r in FO.quota_admission(log, roomy).collect())
    assert flags[False] > 0 and flags[True] > flags[False]


def throttled_by_loop(events, window):
    out, last = [], {}
    for e, key, ts in sorted(events, key=lambda r: (r[2], r[0])):
        if key not in last or (ts - last[key]).total_seconds() >= window:
            last[key] = ts
            out.append(e)
    return sorted(out)


@pytest.mark.parametrize("block_windows", [1, 2, 7, 1024])
def test_throttle_against_a_loop(spark, block_windows):
    rng = random.Random(block_windows)
    events = [(i, rng.choice(["hot", "hot", "hot", "b", None]), T0 + dt.timedelta(milliseconds=rng.randrange(400_000))) for i in range(2000)]
    events += [(5000 + i, "gaps", T0 + dt.timedelta(seconds=60 * i * i)) for i in range(20)]
    events += [(6000 + i, "b", T0 + dt.timedelta(seconds=10 * i)) for i in range(40)] + [(7000 - i, "tie", T0) for i in range(5)]
    table = spark.createDataFrame(events, "id long, k string, ts timestamp")
    out = FO.throttle(table, "k", 10, id_col="id", block_windows=block_windows)
    assert sorted(r.event_id for r in out.collect()) == throttled_by_loop(events, 10)


def test_one_key_is_throttled_by_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table is one task otherwise
    events = [(i, "only", T0 + dt.timedelta(seconds=i)) for i in range(4000)]
    out = FO.throttle(spark.createDataFrame(events, "id long, k string, ts timestamp"), "k", 10, id_col="id", block_windows=16)
    spread = out.select(F.spark_partition_id().alias("p")).distinct().count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert spread > 1 and out.count() == 400


def locked_by_loop(attempts, user_fails, user_lock, ip_fails, ip_lock):
    fails, until, out = Counter(), {}, {}
    for a, ts, ok, user, ip in sorted(attempts, key=lambda r: (r[1], r[0])):
        u, i = ("u", user), ("i", ip)
        if any(k in until and ts < until[k] for k in (u, i)):
            out[a] = "refused"
            continue
        if ok:
            for k in (u, i):
                fails.pop(k, None)
                until.pop(k, None)
            out[a] = "ok"
            continue
        hit = []
        for k, most, lock in ((u, user_fails, user_lock), (i, ip_fails, ip_lock)):
            until.pop(k, None)
            fails[k] += 1
            if fails[k] >= most:
                until[k], fails[k] = ts + dt.timedelta(seconds=lock), 0
                hit.append(k[0])
        out[a] = {"": "fail", "u": "locked_user", "i": "locked_ip", "ui": "locked_both"}["".join(hit)]
    return out


def test_lockout_of_user_and_address(spark):
    rng = random.Random(11)
    attempts = [(i, T0 + dt.timedelta(seconds=rng.randrange(3000)), rng.random() < 0.15, rng.choice(["a", "b", "c", "d", None]), rng.choice(["x", "y", "z", None]))
                for i in range(900)]
    attempts += [(1000 + i, T0 + dt.timedelta(seconds=i), i % 4 == 0, f"calm{i}", f"far{i % 9}") for i in range(100)]
    attempts += [(2000 + i, T0 + dt.timedelta(seconds=i), False, f"spray{i}", "bot") for i in range(50)]
    table = spark.createDataFrame(attempts, "attempt_id long, ts timestamp, ok boolean, username string, ip string")
    got = {r.attempt_id: r.outcome for r in FO.lockout_both(table, 5, 30, 20, 300).collect()}
    want = locked_by_loop(attempts, 5, 30, 20, 300)
    assert got == want and set(want.values()) >= {"ok", "fail", "refused", "locked_user", "locked_ip"}
    assert FO.lockout_both(table.limit(0)).count() == 0


def test_a_success_clears_both_counters(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i), i in (4, 9), "u", "h") for i in range(15)]
    table = spark.createDataFrame(rows, "attempt_id long, ts timestamp, ok boolean, username string, ip string")
    got = {r.attempt_id: r.outcome for r in FO.lockout_both(table, user_fails=5, ip_fails=5).collect()}
    assert got == {i: "ok" if i in (4, 9) else "locked_both" if i == 14 else "fail" for i in range(15)}


def test_components(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(170)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)] + [("hub", f"s{i}") for i in range(200)] + [("own", "own"), ("a", None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if b is not None:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "x string, y string"), "x", "y").collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "x string, y string"), "x", "y").count() == 0
