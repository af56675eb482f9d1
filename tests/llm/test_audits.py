"""Divergence audit, fingerprints and centroid clustering against brute force, and their edge cases."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from spanshield.llm import centroids, divergence, prints

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, vocab=120):
    return " ".join(f"w{chr(97 + rng.randrange(vocab) % 26)}{chr(97 + rng.randrange(vocab) // 26)}" for _ in range(n))


# ---- divergence audit

def brute_audit(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = Counter()
    for lang in {r[0] for r in rows}:
        own = [(s, Counter(t.translate(LOWER) for t in TERM.findall(text))) for la, s, text in rows if la == lang]
        docs = Counter(t for _, c in own for t in c)
        kept = [t for t, n in docs.items() if n >= min_docs]
        by = {s: Counter() for s, _ in own}
        for s, c in own:
            by[s].update({t: c[t] for t in kept})
        whole = sum(by.values(), Counter())

        def p(counts):
            below = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // below for t in kept}
        share, q = {s: p(c) for s, c in by.items()}, p(whole)
        for s in by:
            pairs = [(o, sum(abs(share[s][t] - share[o][t]) for t in kept)) for o in by if o != s]
            terms = [(t, share[s][t] - q[t]) for t in kept if by[s][t] and share[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                for i, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    found[lang, s, part, item, value, i + 1] += 1
    return found


@pytest.mark.parametrize("segment", [65_536, 4])
def test_audit_against_brute_force(spark, segment):
    rng = random.Random(5)
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "", None]), words(rng, rng.randrange(0, 60))) for _ in range(90)]
    rows += [("en", "a", "ÀÉ ñ Ñ 漢字 x1y2_Z " * 40), ("de", "lonely", None), ("de", "other", "seldom"), ("de", None, ""), ("one", "s", "word " * 9), rows[3], rows[3]]
    rows += [("en", f"s{i}", "zeta Alpha alpha") for i in range(12)]
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "lang string, source string, text string, item string, value int, term string")
    got = Counter(map(tuple, divergence.audit(table, min_docs=6, top_terms=7, segment=segment).collect()))
    assert got == brute_audit(rows, 6, 7)


def test_audit_of_an_empty_table_and_of_no_kept_term(spark):
    empty = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(empty).count() == 0
    few = spark.createDataFrame([("en", "a", "x"), ("en", "b", None)], empty.schema)
    assert sorted(map(tuple, divergence.audit(few).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_audit_hands_counts_on_when_full(spark, monkeypatch):
    rows = [("en", "ab"[i % 2], f"common t{chr(97 + i % 26)}q") for i in range(60)]
    table = spark.createDataFrame(rows, "lang string, source string, text string")
    want = brute_audit(rows, 2, 50)
    monkeypatch.setattr(divergence, "FLUSH", 3)
    assert Counter(map(tuple, divergence.audit(table, min_docs=2).collect())) == want


def test_gallop_and_shares():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (1, 1000), (40, 1000), (300, 300)):
        a, b = (np.sort(rng.choice(2000, size, replace=False)) for size in (n, m))
        at = divergence.gallop(a, b)
        assert [int(x) for x in at] == [int(np.flatnonzero(b == v)[0]) if v in b else -1 for v in a]
    big = np.array([0, 7, 10**13, 3 * 10**14])
    for total, kept in ((4 * 10**14, 10**6), (int(big.sum()), 4)):
        assert divergence.shares(big, total, kept).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 5 * kept) for c in big]


# ---- fingerprints

def spliced_texts(rows):
    """(id, text, edited text, next text) by the contract; ids descending, null ids last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    return [(i, t or "", (t or "")[:len(t or "") - len(t or "") // 3] + (rows[(k + 1) % len(rows)][1] or "")[:len(t or "") // 3],
             rows[(k + 1) % len(rows)][1] or "") for k, (i, t) in enumerate(rows)]


def print_of(text):
    return prints.fingerprint(prints.PrefixHashes(prints.code_points(text)))


def common(a, b):
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("per_bucket", [1, 7, 1000])
def test_fingerprints_against_brute_force(spark, per_bucket):
    rng = random.Random(8)
    texts = [words(rng, rng.randrange(0, 200)) for _ in range(40)] + ["", None, "a", "ab", "abc", "x" * 5000, "ÀÉ漢😀" * 60, words(rng, 20_000)]
    rows = [(rng.randrange(-10**15, 10**15), t) for t in texts] + [(None, "the one row without an id"), (2**60, "big"), (2**60 + 1, "bigger")]
    rows.append((-2**62, rows[0][1]))  # a copy of a text
    table = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, fingerprint string, near_next double")
    got = {r["doc_id"]: r for r in prints.compare_with_next(table, rows_per_bucket=per_bucket).collect()}
    assert len(got) == len(rows)
    for doc_id, text, edited, following in spliced_texts(rows):
        r = got[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == print_of(text).text() and r["edited_fingerprint"] == print_of(edited).text()
        parsed = [prints.Print.parse(print_of(t).text()) for t in (text, edited, following)]
        assert r["near_edited"] == prints.likeness(parsed[0], parsed[1]) and r["near_next"] == prints.likeness(parsed[0], parsed[2])
        assert r["common_edited"] == common(text, edited)


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(1, "first"), (1, "second"), (1, "second")] + [(None, f"row {i}") for i in range(30)] + [(5, None)]
    schema = "doc_id long, text string"
    got = prints.compare_with_next(spark.createDataFrame(rows, schema), rows_per_bucket=2).collect()
    assert Counter((r["doc_id"], r["n_chars"]) for r in got) == Counter((i, len(t or "")) for i, t in rows)
    assert prints.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    [alone] = prints.compare_with_next(spark.createDataFrame([(3, "abcdef")], schema)).collect()
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0


def test_prefix_hashes_decide_span_equality(monkeypatch):
    text = "abracadabra abracadabra " * 9
    for piece in (64, 1 << 18):
        monkeypatch.setattr(prints, "PIECE", piece)
        monkeypatch.setattr(prints, "_powers", [])
        x = prints.PrefixHashes(prints.code_points(text))
        rng = random.Random(2)
        for _ in range(300):
            i, j = rng.randrange(len(text)), rng.randrange(len(text))
            n = rng.randrange(0, len(text) - max(i, j) + 1)
            assert (x.span(i, i + n) == x.span(j, j + n)) == (text[i:i + n] == text[j:j + n])
            assert prints.common_extension(x, i, x, j) == common(text[i:], text[j:])
        for k in (2, 8, 32):
            assert x.windows(k).tolist() == [x.span(i, i + k) for i in range(len(text) - k + 1)]


def test_likeness_follows_the_shared_windows():
    rng = random.Random(4)
    letters = [chr(97 + rng.randrange(26)) for _ in range(12_000)]
    for n in (60, 400, 6000):
        a = "".join(letters[:n])
        for part in (0.0, 0.3, 0.6, 0.9):
            b = a[:int(n * part)] + "".join(letters[6000:6000 + n - int(n * part)])
            assert abs(prints.likeness(print_of(a), print_of(b)) - part) < 0.17
    assert prints.likeness(print_of(""), print_of("")) == 1.0 and prints.likeness(print_of(""), print_of("a")) == 0.0


# ---- centroid clustering

def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in kept[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cents)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for n in range(len(cents)):
            own = [v for (_, v), (_, m) in zip(kept, at) if m == n]
            if own:
                cents[n] = [sum(x) // len(own) for x in zip(*own)]
    at, inertia = assign(), Counter()
    for d, n in at:
        inertia[n] += d
    return Counter((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, at))


def vectors(rng, n):
    centres = rng.normal(size=(6, 64))
    return [(i, [float(x) for x in (centres[i % 6] + rng.normal(size=64) * 0.7).astype(np.float32)]) for i in range(n)]


def test_clustering_against_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = vectors(rng, 150)
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)] + [(300 + i, [0.0] * 64) for i in range(20)]
    rows += [(400, None), (401, [1.0] * 63), (402, [1.0] * 65), (403, [None] + [1.0] * 63), (404, [float("nan")] + [1.0] * 63),
             (405, [float("inf")] + [1.0] * 63), (406, []), (407, [-300_000.5] * 64), (408, [900_000.0] * 64), rows[5], rows[5]]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, distance int, v string")
    got = Counter(map(tuple, centroids.cluster(table).collect()))
    assert got == brute_clusters(rows)


def test_clustering_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    rows = vectors(np.random.default_rng(1), 5)
    assert Counter(map(tuple, centroids.cluster(spark.createDataFrame(rows, schema)).collect())) == brute_clusters(rows)
    for none in ([], [(1, None), (2, [1.0])]):
        out = centroids.cluster(spark.createDataFrame(none, schema))
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_progressive_search_is_exact_and_leaves_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-200, 200, (16, 64))
    x = centres[rng.integers(0, 16, 500)] + rng.integers(-40, 40, (500, 64))
    x[:40] = 0
    centres[9] = centres[4]  # a tie: the smaller number wins
    at, distance, read = centroids.nearest(x, centres)
    full = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (at == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all() and not (at == 9).any()
    assert read < 0.5 * 500 * 16 * 64
    h = centroids.transform(np.eye(64, dtype=np.int64))
    assert (h @ h.T == 64 * np.eye(64)).all()
    changes = (h[1:] != h[:-1]).sum(axis=0)
    assert (np.diff(changes) >= 0).all() and changes[0] == 0 and changes[-1] == 63
