"""Removal of passages that repeat anywhere in the corpus, by suffix arrays.

Byte strings of ``length`` (400) that start at two places are found in three steps.

1. Anchors. Every 400-byte window names one place inside it, the least of its 160-byte hashes. Equal
   windows name the same place, so equal windows meet under their anchor's hash, and an anchor with
   the windows that name it is one short row. Anchors that occur once are done; where all copies of
   an anchor agree in every byte their windows reach, all those windows repeat.
2. What is left are anchors whose copies agree in part (edges of passages, edited copies). Distinct
   surroundings are brought together by anchor, written as words of 32 bytes to the right and,
   reversed, to the left, and one suffix array over a block of them is built by linear grouping:
   groups of suffixes that share a Lyndon prefix are processed in descending order, each group
   moves the suffixes that its previous-smaller pointers name, and one pass along the pointers
   then emits the order within the groups. No renaming, no recursion.
3. Neighbours in that order give the bytes any two surroundings share; a window at offset ``o``
   repeats if another copy shares ``o`` bytes to the left and ``length - o`` to the right.

A task holds one block of anchors. An anchor with more than ``GROUP_LIMIT`` distinct surroundings
goes another exact way: its windows are counted by digest, with partial aggregation.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

LENGTH = 400
GRAM = 160
WORD = 32
BLOCK = 2048
GROUP_LIMIT = 32768
HOT_KEYS = 1000     # a key with more than one in so many of all rows is joined by broadcast
HOT_ROWS = 1000     # and with more rows than this
CHUNK = 1 << 20
_INDEX_BITS = np.uint64((1 << 22) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE2 = 0xD1342543DE82EF95 | 1


# ---- suffix order by linear grouping -------------------------------------------------------

def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in ascending order; the last symbol must be smaller
    than all others."""
    n = len(symbols)
    first: dict[int, list[int]] = {}
    for i, c in enumerate(symbols):
        first.setdefault(c, []).append(i)
    members, below, above = [], [], []   # groups and, by number, their neighbours in the order
    group = [0] * n
    for g, c in enumerate(sorted(first)):
        members.append(first[c])
        below.append(g - 1)
        above.append(g + 1)
        for i in first[c]:
            group[i] = g
    done = [False] * len(members)
    smaller = [-1] * n
    order = []
    now = len(members) - 1
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        members[now] = own
        if own:
            own.sort()
            order.append(now)
            named: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and (group[j] == now or done[group[j]]):
                    j = smaller[j]
                smaller[i] = j
                if j >= 0:
                    named[j] = named.get(j, 0) + 1
            by_times: dict[int, list[int]] = {}
            for j, times in named.items():
                by_times.setdefault(times, []).append(j)
            for times in sorted(by_times, reverse=True):
                fresh: dict[int, int] = {}
                for j in by_times[times]:
                    g = group[j]
                    new = fresh.get(g)
                    if new is None:  # right above the old group, under what went there with more times
                        new = fresh[g] = len(members)
                        members.append([])
                        done.append(False)
                        below.append(g)
                        above.append(above[g])
                        below[above[g]] = new
                        above[g] = new
                    members[new].append(j)
                    group[j] = new
        done[now] = True
        now = below[now]

    start, total = [0] * len(members), 0
    for g in reversed(order):
        start[g] = total
        total += len(members[g])
    out = [0] * n
    placed = [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    start[group[n - 1]] += 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            placed[j] = True
            j = smaller[j]
    return out


# ---- anchors ---------------------------------------------------------------------------------

def power_tables(n: int = 2 * CHUNK) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For both hash bases their powers and inverse powers modulo 2**64; a task makes them once."""
    out = {}
    for base in (_BASE, _BASE2):
        inverse = pow(base, -1, 1 << 64)
        out[base] = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)]),
                     np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)]))
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _sums(data: np.ndarray, table) -> np.ndarray:
    return np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * table[0][:len(data)], dtype=np.uint64)]


def _digests(sums: np.ndarray, table, start, end) -> np.ndarray:
    return _mix((sums[end] - sums[start]) * table[1][start])


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of every ``w`` neighbours."""
    n = len(v)
    pad = np.concatenate([v, np.full(-n % w, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(pad, axis=1).reshape(-1)
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - w + 1], ahead[w - 1:n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables, length: int = LENGTH, gram: int = GRAM):
    """Anchors of the texts at ``starts``..``ends`` of ``data`` (bytes): arrays text, pos, lo, hi, gram
    digest, surroundings digest. The windows of an anchor start at pos - hi .. pos - lo."""
    base = int(starts[0])
    buf = data[base:int(ends[-1])]
    empty = np.empty(0, np.int64)
    if len(buf) < length:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    w = length - gram + 1
    one, two = tables[_BASE], tables[_BASE2]
    sums = _sums(buf, one)
    n = len(buf) - gram + 1
    grams = _digests(sums, one, slice(0, n), slice(gram, gram + n))
    least = _sliding_least((grams & ~_INDEX_BITS) | np.arange(n, dtype=np.uint64), w)
    where = (least & _INDEX_BITS).astype(np.int64)
    n_windows = np.maximum(ends - starts - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), n_windows)
    p = np.arange(len(text)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + np.repeat(starts - base, n_windows)
    if not len(p):
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    x = where[p]
    cut = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[cut[1:], len(x)] - 1
    text, x, lo, hi = text[cut], x[cut], x[cut] - p[last], x[cut] - p[cut]
    around = _digests(_sums(buf, two), two, x - hi, x - lo + length)
    around = _mix(around ^ ((lo << 20) | hi).astype(np.uint64) * np.uint64(_BASE))
    return text, x - (starts - base)[text], lo, hi, grams[x], around


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def _pieces(offsets: np.ndarray, length: int):
    """(first text, starts, ends, start of the first piece in its text) of about CHUNK bytes each. A
    longer text comes in pieces that overlap by length - 1 bytes, so each window is in one piece."""
    i, n = 0, len(offsets) - 1
    while i < n:
        if offsets[i + 1] - offsets[i] > CHUNK:
            for s in range(int(offsets[i]), int(offsets[i + 1]) - length + 1, CHUNK):
                e = min(s + CHUNK + length - 1, int(offsets[i + 1]))
                yield i, np.array([s]), np.array([e]), s - int(offsets[i])
            i += 1
            continue
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= CHUNK:
            j += 1
        yield i, offsets[i:j], offsets[i + 1:j + 1], 0
        i = j


def _anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    schema = "doc_id long, tk long, pos int, lo int, hi int, gram long, around long"

    def run(batches):
        tables = power_tables()
        for b in batches:
            data, offsets = _binary(b.column("bytes"))
            ids, keys = b.column("doc_id"), b.column("tk")
            for first, starts, ends, shift in _pieces(offsets, length):
                text, pos, lo, hi, g, a = anchors(data, starts, ends, tables, length, gram)
                if len(text):
                    at = pa.array(text + first)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(at), keys.take(at), pa.array((pos + shift).astype(np.int32)), pa.array(lo.astype(np.int32)),
                         pa.array(hi.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(a.view(np.int64))],
                        names=["doc_id", "tk", "pos", "lo", "hi", "gram", "around"])

    return docs.select("doc_id", "tk", "bytes").mapInArrow(run, schema)


# ---- surroundings that agree in part --------------------------------------------------------

def _ranked_words(rows: np.ndarray) -> np.ndarray:
    """Words of WORD bytes of the rows (a multiple of WORD bytes each), numbered from 1 in byte order."""
    words = np.ascontiguousarray(rows).view(">u8").reshape(-1, WORD // 8)
    order = np.lexsort(words.T[::-1])
    new = np.r_[True, (words[order][1:] != words[order][:-1]).any(axis=1)]
    rank = np.empty(len(words), np.int64)
    rank[order] = np.cumsum(new)
    return rank.reshape(len(rows), -1)


def _shared(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in ``order``; 0 for the first."""
    a = rows[order]
    differ = a[1:] != a[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.r_[0, n]


def repeated_offsets(right: np.ndarray, left: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int):
    """For surroundings of anchors - bytes to the right and, reversed, to the left, padded to whole
    words - the least and greatest window offset that another row shares (-1, -1: none)."""
    n = len(lo)
    ranks = np.hstack([_ranked_words(np.vstack([right.reshape(-1, WORD), left.reshape(-1, WORD)])).reshape(-1)])
    r, l = ranks[:right.size // WORD].reshape(n, -1), ranks[right.size // WORD:].reshape(n, -1)
    # every surrounding is two strings of symbols with a mark (1) between; 0 ends the whole
    mark = np.ones((n, 1), np.int64)
    text = np.hstack([r + 1, mark, l + 1, mark])
    symbols = text.reshape(-1).tolist() + [0]
    sa = np.array(suffix_array(symbols))
    width = text.shape[1]
    by_right = sa[sa % width == 0] // width
    by_right = by_right[by_right < n]
    by_left = sa[sa % width == r.shape[1] + 1] // width
    share_r, share_l = _shared(right, by_right), _shared(left, by_left)
    least, most = np.full(n, -1), np.full(n, -1)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(lo.min()), int(hi.max()) + 1):
        class_r[by_right] = np.cumsum(share_r < length - o)
        class_l[by_left] = np.cumsum(share_l < o)
        here = np.flatnonzero((lo <= o) & (o <= hi))
        if len(here) < 2:
            continue
        key = class_r[here] * (n + 1) + class_l[here]
        order = np.argsort(key, kind="stable")
        k = key[order]
        equal = k[1:] == k[:-1]
        hit = here[order[np.r_[equal, False] | np.r_[False, equal]]]
        most[hit] = o
        least[hit[least[hit] < 0]] = o
    return least, most


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def _match(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(gram, around, least, most) of surroundings that occur once and share windows with others."""
    schema = "gram long, around long, least int, most int"
    wide_r = -(-length // WORD) * WORD
    wide_l = -(-(length - gram + 1) // WORD) * WORD

    def block(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates(["gram", "around"])
        left = [bytes(s[:h])[::-1] for s, h in zip(b["bytes"], b["hi"])]
        right = [bytes(s[h:]) for s, h in zip(b["bytes"], b["hi"])]
        least, most = repeated_offsets(_padded(right, wide_r), _padded(left, wide_l),
                                       b["lo"].to_numpy(), b["hi"].to_numpy(), length)
        hit = (most >= 0) & (b["n"].to_numpy() == 1)
        return pd.DataFrame({"gram": b["gram"].to_numpy()[hit], "around": b["around"].to_numpy()[hit],
                             "least": least[hit], "most": most[hit]})

    def run(batches):
        held = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) < BLOCK:
                continue
            rows_ = pd.concat(held) if len(held) > 1 else held[0]
            g = rows_["gram"].to_numpy()
            edges = np.flatnonzero(g[1:] != g[:-1]) + 1   # the last anchor may go on in the next batch
            at = 0
            for e in edges:
                if e - at >= BLOCK or e == edges[-1]:
                    yield block(rows_.iloc[at:e])
                    at = e
            held = [rows_.iloc[at:]]
        if held and sum(map(len, held)):
            yield block(pd.concat(held))

    return rows.repartition("gram").sortWithinPartitions("gram", "around").mapInPandas(run, schema)


def _count_windows(rows: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many distinct surroundings: windows counted by digest."""

    def windows(batches):
        for b in batches:
            out = {"gram": [], "around": [], "n": [], "at": [], "window": []}
            for g, a, n, lo, hi, s in zip(b["gram"], b["around"], b["n"], b["lo"], b["hi"], b["bytes"]):
                for o in range(lo, hi + 1):
                    out["gram"].append(g)
                    out["around"].append(a)
                    out["n"].append(n)
                    out["at"].append(o)
                    out["window"].append(hashlib.blake2b(bytes(s[hi - o:hi - o + length]), digest_size=16).digest())
            yield pd.DataFrame(out)

    seen = rows.dropDuplicates(["gram", "around"]).mapInPandas(windows, "gram long, around long, n long, at int, window binary")
    seen = materialize(seen, "suffix-windows")
    twice = seen.groupBy("window").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("window")
    return (seen.where("n = 1").join(twice, "window").groupBy("gram", "around")
            .agg(F.min("at").alias("least"), F.max("at").alias("most")))


# ---- the operator ----------------------------------------------------------------------------

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    octets = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(octets).alias("tk"), octets.alias("bytes"))


def _join_apart(rows: DataFrame, facts: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """``rows`` joined to ``facts`` (a key once). Keys that ``hot`` marks hold more than one in HOT_KEYS of
    all rows, so there are at most HOT_KEYS of them: they are broadcast, and their rows stay where they
    are; only the others are shuffled."""
    few = F.broadcast(facts.where(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti").join(facts.where(~hot), keys)
    return rows.join(few, keys).unionByName(rest)


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, tk, spans) for the rows (doc_id, tk, bytes) of ``docs`` that hold repeated strings;
    spans are start * 2**31 + end, unmerged."""
    found = materialize(_anchor_rows(docs, length, gram), "suffix-anchors")
    often = max(HOT_ROWS, found.count() // HOT_KEYS)
    repeated = found.groupBy("gram").agg(F.count(F.lit(1)).alias("times"), (F.min("around") == F.max("around")).alias("agree"))
    repeated = materialize(repeated.where("times > 1"), "suffix-grams")
    found = materialize(_join_apart(found, repeated, ["gram"], F.col("times") > often).drop("times"), "suffix-repeated")
    alike = found.where("agree")
    mixed = found.where("not agree")

    kinds = mixed.groupBy("gram", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("tk", "doc_id", "pos", "lo", "hi")).alias("one"))
    kinds = materialize(kinds, "suffix-kinds")
    open_ = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least_n")).where("least_n = 1").select("gram", "kinds")
    open_ = materialize(open_, "suffix-open")
    wanted = _join_apart(kinds, open_, ["gram"], F.col("kinds") > often).groupBy("one.doc_id", "one.tk").agg(
        F.collect_list(F.struct("gram", "around", "n", "kinds", "one.pos", "one.lo", "one.hi")).alias("wanted"))

    def cut(batches):
        for b in batches:
            data, offsets = _binary(b.column("bytes"))
            lists = b.column("wanted")
            flat = lists.flatten()
            text = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
            pos, lo, hi = (flat.field(c).to_numpy() for c in ("pos", "lo", "hi"))
            start, end = offsets[text] + pos - hi, offsets[text] + pos - lo + length
            for i in range(0, len(flat), 8192):
                part = flat.slice(i, 8192)
                own = [data[s:e].tobytes() for s, e in zip(start[i:i + 8192], end[i:i + 8192])]
                yield pa.RecordBatch.from_arrays([*[part.field(c) for c in ("gram", "around", "n", "kinds", "lo", "hi")], pa.array(own, pa.binary())],
                                                 names=["gram", "around", "n", "kinds", "lo", "hi", "bytes"])

    around = wanted.withColumnRenamed("doc_id", "w_id").withColumnRenamed("tk", "w_tk").join(
        docs, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tk") == F.col("w_tk"))).select("bytes", "wanted")
    around = materialize(around.mapInArrow(cut, "gram long, around long, n long, kinds long, lo int, hi int, bytes binary"), "suffix-around")
    partly = _match(around.where(F.col("kinds") <= GROUP_LIMIT), length, gram)
    crowded = around.where(F.col("kinds") > GROUP_LIMIT)
    if not crowded.isEmpty():
        partly = partly.unionByName(_count_windows(crowded, length))
    partly = materialize(partly, "suffix-partly")

    whole = kinds.where("n > 1").select("gram", "around", "n", F.lit(None).cast("int").alias("least"), F.lit(None).cast("int").alias("most"))
    facts = whole.unionByName(partly.withColumn("n", F.lit(1).cast("long")))
    decided = _join_apart(mixed, facts, ["gram", "around"], F.col("n") > often).drop("n")
    start = F.col("pos") - F.coalesce("most", "hi")
    end = F.col("pos") - F.coalesce("least", "lo") + length
    spans = alike.select("doc_id", "tk", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + length).alias("end"))
    spans = spans.unionByName(decided.select("doc_id", "tk", start.alias("start"), end.alias("end")))
    return spans.groupBy("doc_id", "tk").agg(F.collect_set(F.col("start").cast("long") * (1 << 31) + F.col("end")).alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs, byte offsets), kept (the bytes left) per row.

    A byte goes if a string of ``length`` bytes covers it that starts anywhere else too, in the same
    text or another; strings are judged on the input. All copies go, the first as well. Null text is
    the empty text; texts shorter than ``length`` stay as they are. Repeated rows are texts of their
    own, so they repeat each other. Ids may be null or repeat. An empty table gives no rows.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, length=length, gram=gram).withColumnRenamed("doc_id", "s_id").withColumnRenamed("tk", "s_tk")
    met = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tk") == F.col("s_tk")), "left")
    met = met.select("doc_id", "bytes", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))

    def remove(batches):
        for b in batches:
            data, offsets = _binary(b.column("bytes"))
            kept, runs = [], []
            for i, found in enumerate(b.column("spans")):
                own = data[offsets[i]:offsets[i + 1]]
                found = np.sort(np.asarray(found.values.to_numpy() if len(found) else [], np.int64))
                if len(found):
                    s, e = found >> 31, np.maximum.accumulate(found & ((1 << 31) - 1))
                    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]])
                    s, e = s[new], e[np.r_[new[1:], len(e)] - 1]
                    keep = np.ones(len(own), bool)
                    for x, y in zip(s, e):
                        keep[x:y] = False
                    own = own[keep]
                    runs.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e)])
                else:
                    runs.append([])
                kept.append(own.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return met.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
