"""The reference's example cases for access, quotas, lockout, verdicts and targets."""
import datetime as dt

from pyspark.sql import functions as F

from spanshield.operators import access as AC
from spanshield.operators import folds as FO
from spanshield.operators import usage as US
from spanshield.operators import verdict as VE


def test_key_match(spark):
    cases = [("/api/users", "/api/users", True), ("/api/users", "/api/metrics", False),
             ("/api/users/*", "/api/users/123", True), ("/api/users/*", "/api/users", True),
             ("/api/users/*", "/api/usersX", False), ("*", "/anything", True)]
    df = spark.createDataFrame(cases, "pattern string, path string, want boolean")
    got = df.select(AC.key_match(F.col("pattern"), F.col("path")).alias("m"), "want").collect()
    assert all(r.m == r.want for r in got)


def test_enforce_policies(spark):
    users = spark.createDataFrame([("u1", "admin"), ("u2", "user"), ("u4", "user")], "id string, role string")
    reqs = [(1, "u1", "/api/users", "GET", True), (2, "u1", "/api/users/123/quota", "PUT", True),
            (3, "u1", "/api/metrics/system", "GET", True), (4, "u2", "/api/quota/self", "GET", True),
            (5, "u2", "/api/metrics/self", "GET", True), (6, "u2", "/api/users", "GET", False),
            (7, "u2", "/api/users/123/disable", "POST", False), (8, "u2", "/api/metrics/system", "GET", False),
            (9, "nobody", "/api/users", "GET", False), (10, "nobody", "/api/quota/self", "GET", True),
            (11, "u4", "/api/quota/self", "POST", False)]
    r = spark.createDataFrame(reqs, "req_id long, user_id string, path string, method string, want boolean")
    out = AC.enforce_policies(r, users, AC.load_policies(spark)).collect()
    assert len(out) == len(reqs)
    assert all(x.allowed == x.want for x in out), [(x.req_id, x.allowed) for x in out if x.allowed != x.want]


def test_quota_limits(spark):
    users = spark.createDataFrame([("a", "alice", 10), ("b", "bob", 10), ("c", "carl", None)],
                                  "id string, username string, quota_req_day long") \
        .withColumn("quota_tok_in", F.lit(None).cast("long")).withColumn("quota_tok_out", F.lit(None).cast("long")) \
        .withColumn("quota_bytes_in", F.lit(None).cast("long")).withColumn("quota_bytes_out", F.lit(None).cast("long"))
    day = dt.date(2024, 1, 1)
    usage = spark.createDataFrame([("a", day, 5, 0, 0, 0, 0), ("b", day, 10, 0, 0, 0, 0), ("c", day, 1000, 0, 0, 0, 0)],
                                  "user_id string, day date, req long, tok_in long, tok_out long, bytes_in long, bytes_out long")
    got = {r.id: r.quota_status for r in US.check_quota(users, usage).collect()}
    assert got == {"a": "ok", "b": "req_day", "c": "ok"}


def test_admission_quota_one_per_day(spark):
    users = spark.createDataFrame([("u", 1)], "id string, quota_req_day long") \
        .withColumn("quota_tok_in", F.lit(None).cast("long")).withColumn("quota_tok_out", F.lit(None).cast("long")) \
        .withColumn("quota_bytes_in", F.lit(None).cast("long")).withColumn("quota_bytes_out", F.lit(None).cast("long"))
    t = dt.datetime(2024, 1, 1, 10)
    log = spark.createDataFrame([(1, "u", t, 1, 1, 1, 1), (2, "u", t + dt.timedelta(minutes=1), 1, 1, 1, 1),
                                 (3, "u", t + dt.timedelta(days=1), 1, 1, 1, 1)],
                                "req_id long, user_id string, ts timestamp, tok_in long, tok_out long, bytes_in long, bytes_out long")
    got = {r.req_id: r.admitted for r in FO.quota_admission(log, users).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_lockout_after_five_failures(spark):
    t = dt.datetime(2024, 1, 1, 10)
    rows = [(i, t + dt.timedelta(seconds=i), "e2euser", "10.0.0.1", False) for i in range(1, 6)]
    rows += [(6, t + dt.timedelta(seconds=7), "e2euser", "10.0.0.1", True),     # inside the 30 s lock
             (7, t + dt.timedelta(seconds=60), "e2euser", "10.0.0.1", True)]    # after it
    att = spark.createDataFrame(rows, "attempt_id long, ts timestamp, username string, ip string, ok boolean")
    got = {r.attempt_id: r.outcome for r in FO.lockout(att).collect()}
    assert [got[i] for i in range(1, 8)] == ["fail", "fail", "fail", "fail", "locked", "refused", "ok"]


def test_throttle_window(spark):
    t = dt.datetime(2024, 1, 1, 10)
    ev = spark.createDataFrame([(1, t, "k"), (2, t + dt.timedelta(seconds=30), "k"), (3, t + dt.timedelta(seconds=60), "k"),
                                (4, t + dt.timedelta(seconds=100), "k"), (5, t + dt.timedelta(seconds=5), "other")],
                               "event_id long, ts timestamp, key string")
    assert sorted(r.event_id for r in FO.throttle(ev, "key").collect()) == [1, 3, 5]


def test_parse_verdicts(spark):
    resp = spark.createDataFrame([("a", "1,0,1"), ("b", "1, 0, 1"), ("c", "0\n1\n0"), ("d", "I think item 1 is real"),
                                  ("e", "[1, 0]")], "prompt_hash string, raw string")
    got = {}
    for r in VE.parse_verdicts(resp).collect():
        got.setdefault(r.prompt_hash, {})[r.item] = r.keep
    assert got["a"] == {1: True, 2: False, 3: True}
    assert got["b"] == {1: True, 2: False, 3: True}
    assert got["c"] == {1: False, 2: True, 3: False}
    assert "d" not in got
    assert got["e"] == {1: True, 2: False}


def test_targets_known_and_unknown(spark):
    log = spark.createDataFrame([(1, "api.openai.com:443"), (2, "unknown.example.com"), (3, "httpbin.org")],
                                "req_id long, host string")
    got = {r.req_id: (r.target, r.target_port, r.target_tls, r.inspected)
           for r in AC.resolve_target(log, AC.load_targets(spark)).collect()}
    assert got == {1: ("api.openai.com", 443, True, True), 2: ("unknown.example.com", 443, True, False),
                   3: ("httpbin.org", 80, False, True)}


def test_loopback(spark):
    log = spark.createDataFrame([(1, "localhost:8080"), (2, "127.0.0.1"), (3, "0.0.0.0:1"), (4, "LOCALHOST"),
                                 (5, "api.openai.com")], "req_id long, host string")
    assert [r.req_id for r in AC.drop_loopback(log).collect()] == [5]
