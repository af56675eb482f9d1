"""The registered queries: SQL oracles, and the pipeline's stages against what they promise."""
import hashlib
import random
import re
from collections import Counter
from fractions import Fraction

import pytest

import corpus_pipeline
from spanshield.llm import packing
from spanshield.llm.queries import ORACLES, QUERIES
from spanshield.plans.checks import compare, duck

from .test_small import brute_components, brute_simhash, check_bins


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    result = compare(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLES[name])
    assert result["ok"], result


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    sizes, at = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf_dir).persist()
        assert out.columns == docs.columns
        sizes.append(out.count())
        at = out
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2]
    kept = at.select("doc_id").distinct()
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir)
    assert packed.select("doc_id").distinct().count() == kept.count()


def test_pipeline_takes_odd_tables(spark, sf_dir):
    schema = ("doc_id long, text string, lang string, source string, n_chars long, score string, size int, component_id string, fingerprint string, "
              "_own int, part string, copies int, cut int, taken int, row string, others string")
    more = ("s", 100, "c", "f", 7, "p", 8, 9, 60, "r", "o")
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", "en", "b", 5),
            (3, "some words here", "en", "b", 5), (4, "x " * 50_000, "en", "b", 5)]
    for table in (spark.createDataFrame([r + more for r in rows], schema), spark.createDataFrame([], schema)):
        at = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, sf_dir)
            assert at.columns == table.columns
            assert all(tuple(r)[5:] == more for r in at.collect())
        corpus_pipeline.STAGES[-1][1](spark, at, sf_dir).count()


def test_near_stage_keeps_one_row_of_every_component(spark, sf_dir):
    """Unlike texts whose ids are null or the same are components of their own."""
    say = lambda k, n=60: " ".join(f"{k}{(i * i * 7 + i) % 97}" for i in range(n))
    rows = [(None, say("a"), "s"), (None, say("b"), "s"), (None, say("b"), "t"), (5, say("c"), "s"), (5, say("d"), "s"), (6, say("d"), "s"), (7, say("c"), "t"),
            (None, say("d"), "s"), (8, say("e"), "s"), (8, say("e"), "s"), (8, say("e"), "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = corpus_pipeline.near(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"] or 0, r["text"][0]) for r in out.collect()))
    assert got == [(0, "a"), (0, "b"), (5, "c"), (5, "d"), (8, "e")]


def brute_mix(rows, weights=(3, 1, 2)):
    """Rows (id, text, source) of the mix by its contract: targets by resharing until none is above,
    then each source's documents in order of md5("mix:id"), cut at the budget."""
    size = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, own in rows if own == s) for s in sources}
    weight = {s: Fraction(weights[i % 3]) for i, s in enumerate(sources)}
    target, left, open_ = {}, Fraction(3 * sum(total.values()), 2), set(sources)
    while open_:
        by = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if by[s] > 2 * total[s]]
        for s in over or list(open_):
            target[s] = Fraction(2 * total[s]) if over else by[s]
            left -= target[s]
            open_.discard(s)
    out = []
    for s in sources:
        budget = int(target[s])
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] or 0, size(r[1])))
        while budget and total[s]:
            for r in own:
                n = size(r[1])
                if 0 < n <= budget:
                    out.append(r)
                    budget -= n
                elif n:
                    words = re.findall("[^\\x20\\x09-\\x0D]+", r[1])[:budget]
                    out += [(r[0], " ".join(words), s)] if words else []
                    budget = 0
    return out


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    """Stages 2 to 5 on a fixture, each on its own input, row by row."""
    rng = random.Random(21)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 160))) for _ in range(30)]
    texts = base + [base[0], base[1] + "  ", base[2].replace(" ", "\n"), base[3] + " tail", "", None, " \t", "one", *[base[4] + f" x{i}" for i in range(5)]]
    rows = [(i, t, [None, "a", "b", "c", "d"][i % 5]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 100 + r[0]) for r in rows], "doc_id long, text string, source string, size int")
    strip = lambda t: re.sub("[\\x20\\x09-\\x0D]", "", t or "")

    groups = {}
    for r in rows:
        groups.setdefault(strip(r[1]), []).append(r)
    want = sorted(min(g, key=lambda r: (-len(r[1] or ""), r[0])) for g in groups.values())
    got = sorted(tuple(r) for r in corpus_pipeline.exact(spark, docs, sf_dir).collect())
    assert [r[:3] for r in got] == want and all(r[3] == 100 + r[0] for r in got)

    docs = spark.createDataFrame(got, docs.schema)
    prints = [brute_simhash(r[1]) for r in got]
    roots = brute_components([r[0] for r in got], prints, 3)
    want = sorted(r for r, root in zip(got, roots) if r[0] == root)
    got = sorted(tuple(r) for r in corpus_pipeline.near(spark, docs, sf_dir).collect())
    assert got == want and len(got) < len(roots)

    docs = spark.createDataFrame(got, docs.schema)
    mixed = [tuple(r) for r in corpus_pipeline.mix(spark, docs, sf_dir).collect()]
    assert Counter(r[:3] for r in mixed) == Counter(brute_mix([r[:3] for r in got])) and all(r[3] == 100 + r[0] for r in mixed)

    packed = corpus_pipeline.pack(spark, spark.createDataFrame(mixed, docs.schema), sf_dir).collect()
    words, pieces = Counter(), Counter()
    for r in mixed:
        words[r[0]] += len((r[1] or "").split())
    for r in packed:
        pieces[r["doc_id"]] += r["tokens"]
    assert +pieces == +words
    source_of = {r[0]: r[2] for r in mixed}
    for members in check_bins(packed, packing.CAPACITY).values():
        ids = [r["doc_id"] for r in members]
        assert len(set(ids)) == len(ids) and len({source_of[i] for i in ids}) == len(ids)
