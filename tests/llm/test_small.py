"""Edge cases and brute-force comparisons of the operators on small inputs."""
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanshield.llm import ann, chat, exact_dedup, lm, mixing, packing, simhash, suffix_dedup, toxicity, url_filter
from spanshield.llm.shared import word_count

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, spans string, fingerprint string, bin_id string"


def words(rng, n, vocab=200):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def rows_of(texts, sources=None, ids=None):
    """Rows with extra columns whose names clash with what operators add."""
    return [(i if ids is None else ids[i], t, "en", (sources[i] if sources else f"src{i % 3}"), len(t or ""), 7, 0.5, "x", "y", "z")
            for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, copies, repeated rows, clashing column names."""
    rng = random.Random(3)
    base = [words(rng, rng.randrange(3, 120)) for _ in range(40)]
    texts = base + [None, "", " \t\n", words(rng, 30_000), base[0], base[0] + " ", base[1] + "\x0bend", "ÀÉ ñ ß 漢字 " * 50]
    rows = rows_of(texts, sources=[None if i % 7 == 0 else f"s{i % 4}" for i in range(len(texts))])
    rows += [rows[2], (None, "no id here at all", None, None, None, None, None, None, None, None), rows[40]]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- mixing

def test_mixing_meets_targets(docs):
    got = mixing.mix(docs, word_count(F.col("text")), rows_per_range=5).toPandas()
    assert len(got) == docs.count()
    sizes = got.groupby("source", dropna=False)["size"].sum()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == sizes).all()
    assert (by["taken"] == np.floor(by["target"])).all()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"] >= 0).all()
    assert abs(by["target"].sum() - 1.5 * got["size"].sum()) < 1e-6
    again = mixing.mix(docs, word_count(F.col("text")), rows_per_range=1000).toPandas()
    key = ["doc_id", "size", "taken"]
    assert Counter(map(tuple, got[key].fillna(-1).values.tolist())) == Counter(map(tuple, again[key].fillna(-1).values.tolist()))


def test_mixing_targets_by_hand(spark):
    totals = spark.createDataFrame([(0, "a", 10, 1), (0, "b", 1000, 1), (1, "", 100, 1)], "s_null int, s string, source_size long, n long")
    got = {r["s"]: r["target"] for r in mixing.source_targets(totals).collect()}
    # 1665 words by 3:1:2 puts a over 20 and the null source over 200; the rest goes to b
    assert got["a"] == 20 and got[""] == 200 and abs(got["b"] - 1445) < 1e-9


def test_mixing_emits_rows(docs):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    mixed = mixing.mix(plain, word_count(F.col("text")))
    out = mixing.emit_mix(plain)
    assert out.columns == plain.columns
    want = mixed.agg(F.sum("taken")).first()[0]
    assert out.agg(F.sum(word_count(F.col("text")))).first()[0] == want


CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, taken string, target int, row string, cut int, " \
        "part string, copies int, id string, score string, fingerprint long, component_id long, root string, others int, _own string, kind int"


def clashing(spark, n=60):
    """Documents with extra columns named as the operators name their own; their values tell the row."""
    rng = random.Random(12)
    rows = [(i, words(rng, 30 + i % 7), "en", f"s{i % 3}", i, 100 + i, f"t{i}", i, f"r{i}", i, f"p{i}", i, f"i{i}", f"x{i}", i, 7000 + i, f"q{i}", i, f"o{i}", i)
            for i in range(n)]
    return spark.createDataFrame(rows, CLASH), {r[0]: r for r in rows}


def check_clash(out, rows):
    got = out.collect()
    assert out.columns == [c.split()[0] for c in CLASH.split(", ")] and got
    for r in got:
        assert tuple(r)[5:] == rows[r["doc_id"]][5:]
    return got


def test_extra_columns_come_through_the_mix(spark):
    docs, rows = clashing(spark)
    check_clash(mixing.emit_mix(docs), rows)


@pytest.mark.parametrize("one_id", [None, 7])
def test_mixing_cuts_a_range_that_one_id_fills(spark, monkeypatch, one_id):
    seen, write = [], mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name: seen.append(write(df, name)) or seen[-1] if name == "mix-hot" else write(df, name))
    rows = [(one_id, "a", f"text {i}", i % 9, {"k": i}) for i in range(400)] + [(1000 + i, "b", "x", 5, None) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, w int, extra map<string,int>")
    mixed = mixing.mix(df, F.col("w"), rows_per_range=4)
    got = mixed.collect()
    assert Counter((r["doc_id"], r["text"], r["extra"] and r["extra"]["k"]) for r in got) == Counter((r[0], r[2], r[4] and r[4]["k"]) for r in rows)
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in own)
        assert sum(0 < r["taken"] % r["size"] for r in own if r["size"]) <= 1
    again = mixing.mix(df.repartition(3, "text"), F.col("w"), rows_per_range=4).collect()
    key = lambda r: (r["source"], r["text"], r["doc_id"] or 0, r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    hot = {r["s"]: r["slices"] for r in seen[0].collect()}
    assert hot == {"a": 100}  # the one id's rows in 100 slices; unique ids are not cut


def test_mixing_empty(empty):
    assert mixing.mix(empty, word_count(F.col("text"))).count() == 0


# ---- url filter

URLS = [(1, "https://a.example.net/en/x"), (2, "http://A.EXAMPLE.NET/de/"), (3, None), (4, ""), (5, "no scheme"), (6, "x://org/fr/1?q#f"),
        (7, "x://example.com"), (8, "x://www.example.com/de/a"), (9, "x://badexample.com/de/"), (10, "x://net"), (11, "x://net?/"), (12, "x://b.net/#"),
        (1, "https://a.example.net/en/x"), (13, "x://" + "a." * 3000 + "net/" + "p" * 5000)]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1])
        path = m[2]
    fit = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path) + (max(fit)[2:] if fit else (None, "allow"))


@pytest.mark.parametrize("literal_bytes", [1 << 20, 64])
def test_url_filter(spark, literal_bytes):
    rng = random.Random(5)
    rules = RULES + [(f"h{i}.org", rng.choice(["/", "/a", "/a/b"]), rng.choice(["block", "allow"])) for i in range(400)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = URLS + [(100 + i, f"https://w{rng.randrange(3)}.h{rng.randrange(900)}.org{rng.choice(['', '/', '/a', '/a/b/c', '/q'])}") for i in range(1500)]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = url_filter.judge_urls(pages, url_filter.rules_table(spark, rules), literal_bytes=literal_bytes).collect()
    assert Counter(map(tuple, got)) == Counter((i, *judge(u, rules)) for i, u in urls)


def test_url_cascade_has_levels_and_is_exact(spark):
    universe = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = spark.range(0, 20000, 7).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = url_filter.build_cascade(universe, listed)
    assert len(cascade.levels) > 2
    got = universe.where(cascade.contains(F.col("key"))).select("key").collect()
    assert {r["key"] for r in got} == {f"k{i}" for i in range(0, 20000, 7)}


def test_url_filter_holds_long_lists(spark, monkeypatch):
    """300,000 listed keys in filters past the literal bound, met by shard."""
    urls = spark.range(40_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id") % 20_000, F.lit(".example/p")).alias("url"))
    rules = spark.range(300_000).select(F.concat(F.lit("h"), F.col("id") * 2, F.lit(".example")).alias("host"), F.lit("/").alias("path"),
                                        F.when(F.col("id") % 10 == 0, "allow").otherwise("block").alias("verdict"))
    started = time.time()
    got = url_filter.judge_urls(urls, rules, literal_bytes=1 << 16).collect()
    assert time.time() - started < 60 and len(got) == 40_000
    for r in got:
        n = r["page_id"] % 20_000
        assert (r["rule"], r["verdict"]) == ((f"h{n}.example/", "allow" if n % 20 == 0 else "block") if n % 2 == 0 else (None, "allow"))


def test_url_filter_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(pages, url_filter.rules_table(spark, RULES)).count() == 0
    some = spark.createDataFrame(URLS, "page_id long, url string")
    none = url_filter.judge_urls(some, url_filter.rules_table(spark, [("x.y", "/", "block")]).where("false")).collect()
    assert {r["verdict"] for r in none} == {"allow"}


# ---- suffix dedup

def brute_spans(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                cover[i:i + length] = True
        runs = int((np.diff(np.r_[0, cover.astype(int)]) == 1).sum())
        out.append((len(t), int(cover.sum()), runs, hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest()))
    return out


def test_suffix_array_is_exact():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.randint(1, rng.choice([1, 2, 4])) for _ in range(rng.randrange(20))] + [0]
        assert suffix_dedup.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def check_suffix(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bytes string")
    got = suffix_dedup.remove_repeats(df, **kw).collect()
    want = brute_spans([(t or "").encode() for t in texts], kw.get("length", 400))
    have = {r["doc_id"]: (r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got}
    assert [have[i] for i in range(len(texts))] == want


def test_suffix_dedup_against_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    passages = [words(rng, rng.randrange(40, 200), 5000) for _ in range(6)]
    texts = [None, "", "a" * 3000, "ab" * 900, "x" * 399, "é漢" * 400]
    for _ in range(60):
        t = words(rng, rng.randrange(5, 150), 5000)
        for p in rng.sample(passages, rng.randrange(3)):
            cut = rng.randrange(len(p) // 2)
            t += " " + p[cut:] + " " + words(rng, 20, 5000)
        if rng.random() < 0.2:  # an edited copy
            at = rng.randrange(len(t))
            t = texts[-1][:400] + t[:at] + "#" + t[at + 1:] + t
        texts.append(t)
    texts += [texts[10], texts[10]]
    check_suffix(spark, texts)
    check_suffix(spark, texts, length=100, gram=40)
    monkeypatch.setattr(suffix_dedup, "GROUP_LIMIT", 1)   # every group counts its windows
    check_suffix(spark, texts, length=100, gram=40)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 2)      # what comes three times goes the way of hot anchors
    monkeypatch.setattr(suffix_dedup, "HOT_KEYS", 1 << 30)
    check_suffix(spark, texts, length=100, gram=40)


def test_suffix_dedup_hot_anchor_is_not_dealt_out(spark, monkeypatch):
    """An anchor with many distinct surroundings stays where its rows are, wherever rows meet by anchor alone."""
    rng = random.Random(11)
    shared = words(rng, 20, 300)[:90]
    texts = [words(rng, 10, 300) + " " + shared + " " + words(rng, 10, 300) for _ in range(12)]
    texts.append(texts[0])
    met = []
    apart = suffix_dedup._join_apart

    def spied(rows, facts, keys, hot):
        met.append((keys, facts.where(hot).count()))
        return apart(rows, facts, keys, hot)

    monkeypatch.setattr(suffix_dedup, "_join_apart", spied)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(suffix_dedup, "HOT_KEYS", 1 << 30)
    check_suffix(spark, texts, length=100, gram=40)
    by_anchor = [n for keys, n in met if keys == ["gram"]]
    assert len(by_anchor) == 2 and min(by_anchor) > 0


def test_suffix_dedup_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(2)
    long = words(rng, 1500, 4000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    check_suffix(spark, [long, words(rng, 30) + long[3000:4500], "tail"])


def test_suffix_dedup_repeated_rows_and_empty(spark, empty):
    row = ("w " * 300,)
    df = spark.createDataFrame([row, row, (None,)], "text string").withColumn("doc_id", F.lit(None).cast("long"))
    got = suffix_dedup.remove_repeats(df).collect()
    assert sorted(len(r["kept"]) for r in got) == [0, 0, 0]
    assert suffix_dedup.remove_repeats(empty).count() == 0


# ---- exact dedup

def test_exact_dedup_against_brute_force(spark, docs):
    got = exact_dedup.exact_dedup(docs, exact_dedup.fresh_index(spark, 4)).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        t = r["text"] or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), r["doc_id"] is None, r["doc_id"]))
    want = Counter()
    for t, members in groups.items():
        for m in members:
            want[(m[2], min(members)[2], len(members), m == min(members), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == want


def test_exact_dedup_index_persists(spark, docs):
    index = exact_dedup.fresh_index(spark, 4)
    first = exact_dedup.kept_documents(docs, index)
    n = docs.select(exact_dedup.text_digest(F.col("text"))).distinct().count()
    assert first.columns == docs.columns and first.count() == n
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert again.rows().count() == n
    rerun = exact_dedup.exact_dedup(docs, again)
    assert rerun.where("kept").count() == 0 and again.rows().count() == n
    more = docs.limit(1).withColumn("text", F.lit("something new"))
    assert exact_dedup.exact_dedup(more, again).where("kept").count() == 1
    plan = again.new_rows(docs.select(F.col("text").alias("text_sha256")))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_exact_dedup_empty(spark, empty):
    assert exact_dedup.exact_dedup(empty, exact_dedup.fresh_index(spark)).count() == 0


# ---- packing

def check_bins(got, capacity):
    bins = defaultdict(list)
    for r in got:
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    for members in bins.values():
        assert sum(r["tokens"] for r in members) <= capacity
        ends = sorted((r["bin_offset"], r["bin_offset"] + r["tokens"]) for r in members)
        assert all(a[1] == b[0] for a, b in zip(ends, ends[1:])) and ends[0][0] == 0
    return bins


def test_packing(docs):
    rows = docs.withColumn("cluster", exact_dedup.text_digest(F.col("text")))
    got = packing.pack(rows, word_count(F.col("text")), cluster=F.col("cluster"), capacity=64, shard_pieces=16).collect()
    bins = check_bins(got, 64)
    known = {(r["doc_id"], r["size"]): r for r in rows.withColumn("size", word_count(F.col("text"))).collect()}
    by_id = {i: r for (i, _), r in known.items()}
    for members in bins.values():
        sources = [by_id[r["doc_id"]]["source"] for r in members]
        clusters = [by_id[r["doc_id"]]["cluster"] for r in members]
        assert len(set(sources)) == len(sources) and len(set(clusters)) == len(clusters)
    want = docs.agg(F.sum(word_count(F.col("text")))).first()[0]
    assert sum(r["tokens"] for r in got if r["bin_id"] is not None) == want
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in docs.collect()}


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(4)
    sizes = sorted((rng.randrange(1, 50) for _ in range(300)), reverse=True)
    sources = [1 << rng.randrange(6) for _ in sizes]
    clusters = [rng.choice([0, 1 << rng.randrange(20)]) for _ in sizes]
    bins = []
    want = []
    for size, s, c in zip(sizes, sources, clusters):
        fits = [(left, b) for b, (left, hs, hc) in enumerate(bins) if left >= size and not hs & s and not hc & c]
        if fits:
            left, b = min(fits)
            _, hs, hc = bins[b]
        else:
            left, b, hs, hc = 100, len(bins), 0, 0
            bins.append(None)
        want.append((b, 100 - left))
        bins[b] = (left - size, hs | s, hc | c)
    assert packing.best_fit(sizes, sources, clusters, 100) == want


def test_packing_empty(empty):
    assert packing.pack(empty, word_count(F.col("text"))).count() == 0


# ---- nearest neighbours

def test_ann(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    rows = [(i, v.tolist(), "e") for i, v in enumerate(x)]
    rows += [(1000 + i, x[10].tolist(), "copy") for i in range(30)] + [rows[5]]
    rows += [(2000, None, ""), (2100, [0.0] * 24, ""), (2200, [1.0] * 23 + [float("nan")], ""), (2300, [1.0] * 23 + [None], ""),
             (2400, [], ""), (2500, [1.0] * 7, ""), (2600, [float("inf")] * 24, ""), (None, x[3].tolist(), "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = ann.search(df, F.col("vec_id") % 100 == 0).toPandas()
    ids = np.r_[np.arange(900), 1000 + np.arange(30)]
    vecs = np.vstack([x, np.repeat(x[10:11], 30, axis=0)]).astype(np.float64)
    hit = total = 0
    for q in [i for i in ids if i % 100 == 0]:
        far = np.sqrt(((vecs - vecs[ids == q][0]) ** 2).sum(axis=1))
        want = [int(i) for _, i in sorted(zip(far, ids)) if i != q][:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11))
        assert np.allclose(own["score"], [far[ids == v][0] for v in own["vec_id"]])
        hit += len(set(want) & set(own["vec_id"]))
        total += 10
    assert set(got.query_id) == {int(i) for i in ids if i % 100 == 0} and hit / total >= 0.9


def test_ann_scan_in_packs_and_blocks_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "SCAN_QUERIES", 7)
    monkeypatch.setattr(ann, "SCAN_POINTS", 90)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 5)).round(1)
    coded = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "point long, vec array<double>, code long")
    asked = coded.where("point % 20 = 0").select("point", "vec")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = ann._scan(coded, asked, 30, 600, 4, 5).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert not got.duplicated(["asker", "other"]).any()
    for q in range(0, 600, 20):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted(zip(far, range(600)))[:4]
        own = got[got.asker == q].sort_values(["far", "other"])[:4]
        assert list(zip(own["far"], own["other"])) == want
    assert ann._scan(coded, asked.limit(0), 0, 600, 4, 5).count() == 0


def test_ann_few_vectors_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], round(r["score"], 6)) for r in got] == [(1, 2, 0.0), (2, 1, round(math.sqrt(2), 6))]
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def test_ann_probes_reach_every_code_in_the_radius():
    rng = random.Random(2)
    for radius in (0, 3, 7, 8, 13, 25, 64):
        radii = ann.substring_radii(radius)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
            assert any((diff >> (8 * j) & 255).bit_count() <= radii[j] for j in range(8))


def test_ann_learns_from_all_of_a_table_ordered_by_cluster(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(3, 0.02, (1200, 16)), rng.normal(0, 1, (1200, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    learn = ann.learn
    monkeypatch.setattr(ann, "learn", lambda sample, k, *a: seen.append(sample) or learn(sample, k, *a))
    got = ann.search(df, F.col("vec_id") % 50 == 0, sample=1000).toPandas()
    dense = (seen[0][:ann.SAMPLE_QUERIES].mean(axis=1) > 1.5).mean()
    assert 0.35 < dense < 0.65
    hit = total = 0
    for q in range(0, 2400, 50):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        hit += len(set(np.argsort(far)[:10].tolist()) & set(got[got.query_id == q]["vec_id"]))
        total += 10
    assert hit / total >= 0.95


# ---- simhash

def brute_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def brute_components(ids, fps, max_bits):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash_against_brute_force(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.collect()
    fps = [brute_simhash(r["text"]) for r in rows]
    comp = brute_components([r["doc_id"] for r in rows], fps, 3)
    assert Counter(map(tuple, got)) == Counter((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, comp))


@pytest.mark.parametrize("small,block", [(32, 8192), (1, 8192), (1, 16)])
def test_simhash_links_lose_no_component(spark, monkeypatch, small, block):
    monkeypatch.setattr(simhash, "SMALL_CELL", small)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(8)
    fps = {0}
    for _ in range(12):  # chains and clouds
        at = rng.getrandbits(64)
        for _ in range(25):
            fps.add(at)
            at ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
    fps = sorted(fps)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fingerprint long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    want = brute_components(list(range(len(fps))), fps, 3)
    got = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_simhash_embedding_bounds_distance(spark):
    rng = random.Random(6)
    pairs = [(simhash._signed(rng.getrandbits(64)), simhash._signed(rng.getrandbits(64))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", F.bit_count(simhash.embedding(F.col("a")).bitwiseXOR(simhash.embedding(F.col("b")))).alias("d")).collect()
    for a, b, d in got:
        count = lambda v, i: (v >> (2 * i) & 3).bit_count()
        assert d == sum(abs(count(a, i) - count(b, i)) for i in range(32)) <= ((a ^ b) & (2**64 - 1)).bit_count()


def test_simhash_rows_and_empty(spark, docs, empty):
    out = simhash.near_duplicates(docs, keep_rows=True)
    assert out.columns == ["row", "component_id", "root"] and out.count() == docs.count()
    assert Counter(map(tuple, out.select("row.*").collect())) == Counter(map(tuple, docs.collect()))
    assert simhash.near_duplicates(empty).count() == 0
    named, rows = clashing(spark)
    check_clash(simhash.near_duplicates(named, keep_rows=True).select("row.*"), rows)


def test_simhash_says_when_components_are_not_done(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(64)], "u long, v long")
    with pytest.raises(RuntimeError):
        simhash.components(path, max_rounds=1)


# ---- chat

def turns_of(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\</s>", "\\\\[INST]\\", "<<SYS>>\n x \n<</SYS>>\n", " </s>\n<s> ", "", None, "ends \\", "[/INST", "<s", "<s> a </s>", "ñ漢 <s>"]
    rng = random.Random(7)
    rows = []
    for conv in range(40):
        n = rng.choice([1, 2, 9, 120])
        for t in range(n):
            role = "system" if t == 0 and conv % 2 else rng.choice(["user", "assistant", "assistant", "tool", None, "a <s> b", "system"])
            rows.append((conv, t // 2 if conv % 5 == 0 else t, role, rng.choice(hostile) if rng.random() < .4 else words(rng, rng.choice([1, 20, 60]))))
    rows += [(99, 0, "user", words(rng, 5000)), (99, 1, "assistant", words(rng, 9000)), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (7, 0, "user", "x"), (7, 0, "user", "x")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("clash"))


def test_chat_round_trip(spark):
    rows, df = turns_of(spark)
    windows = chat.format_windows(df, budget=128, history=40)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t, r or "", x or ""))
    total = defaultdict(int)
    for w in windows.collect():
        total[w["conv_id"]] += len(w["text"])
        assert w["tokens"] <= 128 or w["turns"] == 1
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        said = "".join(t[2] for t in turns if t[1] == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r["formatted_chars"] == total[c]


def test_chat_windows_keep_system_and_history(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, i, ["user", "assistant"][i % 2 == 0], f"t{i} " + "w " * 20) for i in range(1, 20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_windows(df, budget=100, history=30).orderBy("window").collect()
    assert len(out) > 3
    for w in out[1:]:
        turns = chat.parse(w["text"])
        assert turns[0] == ("system", "be brief") and w["repeated"] == 2
        targets = [w["text"][s["start"]:s["end"]] for s in w["loss"]]
        assert targets == [t for r, t in turns[w["repeated"]:] if r == "assistant"]


def test_chat_system_turn_after_a_greeting(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "system", "be brief")] + [(1, i, ["user", "assistant"][i % 2], f"t{i} " + "w " * 20) for i in range(2, 20)]
    rows.append((1, 20, "system", "be long"))
    rows += [(1, i, ["user", "assistant"][i % 2], f"t{i} " + "w " * 20) for i in range(21, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_windows(df, budget=100, history=30).orderBy("window").collect()
    seen, system = 0, None
    for w in out:
        turns = chat.parse(w["text"])
        repeated, fresh = turns[:w["repeated"]], turns[w["repeated"]:]
        assert [t for t in repeated if t[0] == "system"] == ([("system", system)] if system else [])
        assert fresh == [(r[2], r[3]) for r in rows[seen:seen + len(fresh)]] and w["tokens"] <= 100
        seen += len(fresh)
        system = next((t for r, t in reversed(fresh) if r == "system"), system)
    assert seen == len(rows) and system == "be long"


def test_chat_escape_is_reversible_and_closed():
    rng = random.Random(3)
    parts = [*chat.CONTROL, "\\", "<", ">", "/", "[", "]", "s", " ", "\n", "x", "SYS", "INST"]
    for _ in range(5000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(t)) == t
        assert chat.parse(chat.render("user", t)[0] + chat.render(t, t)[0]) == [("user", t), (t if t not in chat.MARKS else t, t)]


def test_chat_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_windows(df)).count() == 0


# ---- language model

def test_lm(spark, docs, empty):
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))
    got = lm.score(docs, train).toPandas()
    rows = docs.collect()
    assert len(got) == len(rows) and np.isfinite(got["score"]).all() and (got["score"] < 0).all()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    c = Counter()
    for r in rows:
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            c.update(split(r["text"]) + [None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        tokens = split(r["text"]) + [None]
        base = sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens)
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
        if r["doc_id"] is not None:
            want[(r["doc_id"], held, len(tokens), sum(c[t] > 0 for t in tokens), n, round(base, 5))] += 1
    have = Counter((int(r.doc_id), bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got.dropna().itertuples())
    assert have == want
    assert lm.score(empty, F.lit(True)).count() == 0


def test_lm_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in lm.initial_weights(12, np.ones(5)).items()}
    x = rng.integers(0, 12, (3, lm.CONTEXT))
    same = rng.random((3, lm.STRIDE, lm.CONTEXT)) < 0.8
    for i in range(lm.STRIDE):
        same[:, i, lm.STRIDE + i] = True
    target = rng.integers(-1, 5, (3, lm.STRIDE))

    def loss():
        logits = lm._forward(w, lm._tables(w), x, same)[0]
        p = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
        i, j = np.nonzero(target >= 0)
        return -p[i, j, target[i, j]].mean()

    g = lm.gradients(w, x, same, target)
    for name in w:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w[name].shape)
            old = w[name][at]
            w[name][at] = old + 1e-5
            up = loss()
            w[name][at] = old - 1e-5
            down = loss()
            w[name][at] = old
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4, name


def test_lm_gradients_do_not_depend_on_the_parts_of_a_batch():
    rng = np.random.default_rng(1)
    w = lm.initial_weights(12, np.ones(5))
    x, target = rng.integers(0, 12, (11, lm.CONTEXT)), rng.integers(0, 5, (11, lm.CONTEXT))
    target[3:9, 20:] = -1   # parts with and without fill
    whole = lm.gradients(w, x, None, target, 0, part=11)
    for part in (1, 3, 4):
        g = lm.gradients(w, x, None, target, 0, part=part)
        assert all(np.allclose(g[k], whole[k], atol=1e-6) for k in w) and {v.dtype for v in g.values()} == {np.dtype(np.float32)}


def test_lm_steps_as_written_out():
    """A training step is Adam's, whatever earlier steps left in the buffers it keeps."""
    rng = np.random.default_rng(4)
    w = lm.initial_weights(12, np.ones(5))
    want, m, v, state = {k: a.astype(np.float64) for k, a in w.items()}, {}, {}, {}
    for t, n in enumerate((40, 7, 40), 1):   # whole and part batches, one or several parts
        x, target = rng.integers(0, 12, (n, lm.CONTEXT)), rng.integers(-1, 5, (n, lm.CONTEXT))
        for k, g in lm.gradients(want, x, None, target, 0).items():
            m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * g, 0.99 * v.get(k, 0) + 0.01 * g * g
            want[k] = want[k] - 0.01 * m[k] / (1 - 0.9 ** t) / (np.sqrt(v[k] / (1 - 0.99 ** t)) + 1e-8)
        lm.train_batch(w, state, x, target, 0.01)
    assert state["room"]["s"].shape == (lm.PART, lm.CONTEXT, lm.CONTEXT)
    assert all(np.allclose(w[k], want[k], atol=1e-3) and w[k].dtype == np.float32 for k in want)


def test_lm_gradients_where_logits_are_cut():
    rng = np.random.default_rng(6)
    w = lm.initial_weights(12, np.ones(5))
    w["bias"][:2] = 80, -80   # as if they were 30 and -30 beside the rest of the logits
    x, target = rng.integers(0, 12, (3, lm.CONTEXT)), rng.integers(0, 5, (3, lm.CONTEXT))
    cut = {**w, "bias": np.array([30, -30, *w["bias"][2:]], np.float32), "wo": w["wo"] * np.array([0, 0, 1, 1, 1], np.float32)}
    for k, g in lm.gradients(w, x, None, target, 0).items():
        assert np.isfinite(g).all()
    assert np.allclose(lm.gradients(w, x, None, target, 0)["bias"], lm.gradients(cut, x, None, target, 0)["bias"], atol=1e-6)


def test_lm_company_runs_over_no_byte():
    rng = np.random.default_rng(8)
    rank = rng.integers(0, 100, (600, lm.CONTEXT))
    rank[rng.random(rank.shape) < 0.5] = 3   # thousands of times
    seen, want = np.ones((90, 64), np.int64), np.ones((90, 64), np.int64)
    lm.add_company(seen, rank)
    for row in rank:
        for i in row[row < 90]:
            want[i, np.unique(row[row < 64])] += 1
    assert (seen == want).all() and want.max() > 5000
    lm.add_company(seen, np.full((2, lm.CONTEXT), 99))
    assert (seen == want).all()


@pytest.mark.parametrize("bits", [16, 32])
def test_lm_windows_are_written_as_bytes(spark, monkeypatch, bits):
    """Two bytes a subword where the vocabulary has room in them, four otherwise; the same windows."""
    texts = ["the cat sat on the mat " * 9, "", None, "one more word"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = []
    write = lm.materialize
    monkeypatch.setattr(lm, "materialize", lambda df, name: kept.append((name, write(df, name))) or kept[-1][1])
    if bits == 32:
        wide = lm.Subwords.__init__
        monkeypatch.setattr(lm.Subwords, "__init__", lambda self, ranks: (wide(self, ranks), setattr(self, "end", 70_000))[0])
        monkeypatch.setattr(lm.Subwords, "opens_word", lambda self, i: i % 2 == 0)
    lm.score(rows, F.lit(True), rounds=1).collect()
    assert [name for name, _ in kept] == ["lm-words", "lm-windows"]   # words are written once, with all they count
    said = {bytes(r.word): r.c for r in kept[0][1].where("first").collect()}
    assert said == Counter(w for t in texts for w in [*lm.words_of((t or "").encode()), lm.END_WORD])
    table = dict(kept)["lm-windows"]
    assert dict(table.dtypes)["codes"] == "binary"
    codes = [np.frombuffer(r.codes, f"uint{bits}").astype(int) - 2 for r in table.collect()]
    assert all(len(c) == lm.CONTEXT + 1 for c in codes)
    subwords = lm.Subwords(open(lm.TOKENIZER, "rb").read())   # its end is 70,000, too, where bits are 32
    want = []
    for t in texts:
        ids = subwords.spell([*lm.words_of((t or "").encode()), lm.END_WORD])[0]
        want += [w.tolist() for w in lm.windows_of(ids, np.array([len(ids)]))[0]]
    assert sorted(c.tolist() for c in codes) == sorted(want)


def test_lm_windows_are_causal_and_score_each_token_once():
    rng = np.random.default_rng(4)
    size, n_classes = 40, 6
    cls = rng.integers(0, n_classes, size)
    cls[:n_classes] = np.arange(n_classes)
    model = lm.Model(cls, np.zeros((n_classes + 1, size), np.float32), np.ones(n_classes), np.arange(size), lm.initial_weights(size + 1, np.ones(n_classes)))
    ids = rng.integers(0, size, 200)
    starts = np.zeros(200, bool)
    starts[[0, 90]] = True
    whole = model.log_probs(ids, starts)[0]
    for at in (5, 60, 89, 90, 150):  # nothing after a place changes what comes before it
        other = ids.copy()
        other[at:] = rng.integers(0, size, 200 - at)
        assert np.allclose(model.log_probs(other, starts)[0][:at], whole[:at], atol=1e-5)
    assert np.allclose(model.log_probs(ids[90:], starts[90:])[0][:10], whole[90:100], atol=0.2)
    parts = model.log_probs(ids, starts, batch=3)[0]
    assert np.allclose(parts, whole, atol=1e-5)


def test_lm_windows_hold_every_subword_once():
    rng = np.random.default_rng(6)
    lens = np.array([1, 31, 32, 33, 64, 500, 1])
    ids = rng.integers(0, 90, lens.sum())
    out, text, nth = lm.windows_of(ids, lens)
    for t, want in enumerate(np.split(ids, np.cumsum(lens)[:-1])):
        own = out[text == t][np.argsort(nth[text == t])]
        targets = own[:, 1:].reshape(-1)
        assert targets[targets >= 0].tolist() == want.tolist()
        assert own[:, 0].tolist() == [-1, *want[lm.CONTEXT - 1::lm.CONTEXT][:len(own) - 1].tolist()]


def test_lm_counts_cover_whole_texts(spark, monkeypatch):
    """Pairs of (class, next subword) and the company come from all of a long text, not one window."""
    rng = random.Random(12)
    texts = [words(rng, 3000, 50), words(rng, 5, 50), "", words(rng, 700, 20) + " " + "y" * 400 + " w1", "w1 \u6f22\u5b57"]
    counts = Counter(w for t in texts for w in [*lm.words_of(t.encode()), lm.END_WORD])
    rows = spark.createDataFrame([(i, t.encode(), True) for i, t in enumerate(texts)] + [(9, b"not read", False)], "doc_id long, text binary, train boolean")
    totals = spark.createDataFrame([(bytearray(w), n) for w, n in counts.items()], "word binary, c long")
    ranks = spark.sparkContext.broadcast(open(lm.TOKENIZER, "rb").read())
    company = []
    classes = lm._classes
    monkeypatch.setattr(lm, "_classes", lambda counts, rank, opens, met, n: company.append((rank, met)) or classes(counts, rank, opens, met, n))
    model = lm._fit(rows, totals, ranks, lm.CLASSES, 1)
    subwords = lm.Subwords(ranks.value)
    size, n_classes = subwords.end + 1, len(model.inside) - 1
    table, seen = np.zeros((n_classes + 1, size)), np.ones(size)
    rank, met = company[0]
    want = np.zeros_like(met)
    for t in texts:
        ids = subwords.spell([*lm.words_of(t.encode()), lm.END_WORD])[0]
        np.add.at(table, (np.r_[n_classes, model.classes[ids[:-1]]], ids), 1)
        np.add.at(seen, ids, 1)
        for lo in range(0, len(ids), lm.CONTEXT):
            r = rank[ids[lo:lo + lm.CONTEXT]]
            for i in r[r < lm.COMMON]:
                want[i, np.unique(r[r < lm.COMPANY])] += 1
    assert (met == want).all()
    share = seen / np.bincount(model.classes, weights=seen)[model.classes]
    own = np.vstack([np.bincount(model.classes, weights=row, minlength=n_classes)[model.classes] for row in table])
    assert np.allclose(model.inside, np.log10((table + lm.BACKOFF * share) / (own + lm.BACKOFF)), atol=1e-4)


# ---- toxicity

def test_toxicity_held_out(spark):
    rng = random.Random(11)
    bad = ["horrid", "vermin", "loathsome", "imbecile", "filthy"]
    rows, labels = [], []
    for i in range(600):
        w = words(rng, rng.randrange(20, 200), 3000).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), 1.0))
        labels.append((i, int(toxic)))
    rows += [(700, None, 1.0), (701, "", 1.0), (702, "x" * 200_000, 1.0), (None, "y", 1.0), rows[0]]
    labels += [(None, 1), (3, None), (9999, 1), labels[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    model = toxicity.fit_on(docs, known, train)
    got = toxicity.toxicity(docs, model).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    held = got[[d == d and d < 600 and zlib.crc32(str(int(d)).encode()) % 3 == 1 for d in got["doc_id"]]]
    said, true = held["score"] >= toxicity.THRESHOLD, held["doc_id"] % 4 == 0
    assert (said == true).mean() > 0.95
    assert toxicity.toxicity(docs.where("false"), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    model = toxicity.fit_on(docs, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.toxicity(docs, model, keep_text=True).first()["score"] == 0.0


def test_toxicity_reads_sampled_rows_whole(spark):
    """Insults that only come after 6,000 characters and 400 words are learned and calibrated."""
    rng = random.Random(21)
    bad = ["horrid", "vermin", "loathsome", "imbecile", "filthy"]
    rows = []
    for i in range(160):
        w = words(rng, 2000, 3000).split()
        if i % 4 == 0:
            for _ in range(5):
                w.insert(rng.randrange(1700, len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, toxicity.fit_on(docs, known, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)).toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]]
    assert ((held["score"] >= toxicity.THRESHOLD) == (held["doc_id"] % 4 == 0)).mean() > 0.95


def test_toxicity_chunks_cover_the_text():
    text = [b"w%d" % i for i in range(1003)] + [b"x" * 5000]
    assert b"".join(toxicity._chunks(text)).split() == b"".join(b" " + b" ".join(text[i:i + 40]) + b" " for i in range(0, 1004, 40)).split()


def test_toxicity_learns_toxic_text_and_short_words(spark):
    """The dictionary holds toxic phrases of everyday words, and a four-letter word can score alone."""
    rng = random.Random(31)
    phrase = "w5 w9 w5 w7 w9 w9 w7 w5"
    rows = []
    for i in range(400):
        w = words(rng, rng.randrange(60, 200), 300).split()
        if i % 4 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), phrase)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit_on(docs, known, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    assert phrase.encode() in model.toxic + b" " + model.marks
    got = toxicity.toxicity(docs, model).toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]]
    assert ((held["score"] >= toxicity.THRESHOLD) == (held["doc_id"] % 4 == 0)).mean() > 0.9


def test_toxicity_short_words_can_score_alone():
    rng = random.Random(32)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    ordinary = toxicity._dictionary(toxicity.ORDINARY_BYTES, [say(40).encode() for _ in range(2000)])
    pair = toxicity.Model(b"", b" scum vile lout ", ordinary).compressors()
    found = [toxicity.window_distances(f"{say(12)} {rng.choice(['scum', 'vile'])} {say(12)}".encode(), *pair)[:, 1].max() > 0 for _ in range(200)]
    assert np.mean(found) > 0.3
