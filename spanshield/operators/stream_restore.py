"""Restore tokens in chunked (SSE) replies.

Two steps, so that only byte buffering is stateful:

1. ``segment_chunks``: per stream, in ``seq`` order, decode UTF-8 across chunk edges and cut the
   text into segments that no token can straddle. The tail that could still belong to a token
   is held back until more bytes arrive or the stream ends. There is no limit on a reply's size
   unless one is asked for (``max_bytes``); a reply over it always ends with ``[truncated]``.
2. the segments go through the batch restore (D5), segment by segment; their concatenation is
   exactly D5 applied to the whole reply.

Batch form: chunks that lie side by side are put together where they are read, then hash-partition
by stream, sort by seq, one pass (no stream is collected whole). So what is moved, sorted and restored
grows with the text, not with the number of chunks. The streaming form
(``streaming.streams.stream_segments``) keeps the same buffer in per-stream state.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanshield import patterns as P
from spanshield.functions.spans import let
from spanshield.operators.vault import detokenize, has_token

# The reference's size limit of a reply, as an option, and its mark.
REFERENCE_STREAM_BYTES = 50 * 1024 * 1024
TRUNCATED = "[truncated]"
# No written token form without inner white space is longer than this.
HOLD_CHARS = 64

SEGMENT_SCHEMA = "stream_id long, seg long, text string"
_TOKEN_RE = re.compile(P.python_regex(P.TOKEN_ANY_RE))
# a bracketed form that the end of the text leaves open; its inner white space may be of any length
_OPEN_RE = re.compile(P.python_regex(f"\\[{P.WS}*(?:[A-Z]{{1,3}}(?:_[a-f0-9]{{0,{P.TOKEN_HEX_LEN}}})?{P.WS}*)?") + r"\Z")


class Segmenter:
    """Byte buffer of one stream; ``feed`` returns the text that is safe to emit."""

    def __init__(self, pending: bytes = b"", carry: str = "", received: int = 0, max_bytes: int | None = None):
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")
        self.decoder.setstate((pending, 0))
        self.carry = carry
        self.received = received
        self.max_bytes = max_bytes

    def feed(self, chunk: bytes) -> str:
        if self.max_bytes is not None:
            room = max(0, self.max_bytes - self.received)
            self.received += len(chunk)
            chunk = chunk[:room]
        else:
            self.received += len(chunk)
        text = self.carry + self.decoder.decode(chunk, final=False)
        cut = max(0, len(text) - HOLD_CHARS)
        last = text.rfind("[")   # the only form that can be longer than what is held back anyway
        if 0 <= last < cut and _OPEN_RE.match(text, last):
            cut = last
        if cut > 0 and "_" in text:   # every form has "_"
            for m in _TOKEN_RE.finditer(text):
                if m.end() <= cut:
                    continue
                if m.start() < cut:
                    cut = m.start()
                break
        self.carry = text[cut:]
        return text[:cut]

    def finish(self) -> str:
        text = self.carry + self.decoder.decode(b"", final=True)
        self.carry = ""
        if self.max_bytes is not None and self.received > self.max_bytes:
            text += TRUNCATED
        return text

    def state(self) -> tuple[bytes, str, int]:
        return self.decoder.getstate()[0], self.carry, self.received


RUN_BYTES = 16 * 1024  # about so many bytes of neighbouring chunks are put together
_RUN_SCHEMA = "stream_id long, seq long, last long, chunk binary, sizes binary"


def runs_of(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """Chunks of one stream whose ``seq`` follow each other as one row: their bytes end to end, with the
    size of each. Also the place of each row's first chunk in the batch, which has a row at least."""
    n = batch.num_rows
    sid, seq = batch.column("stream_id"), batch.column("seq").to_numpy(zero_copy_only=False)
    ids, no_id = sid.fill_null(0).to_numpy(zero_copy_only=False), sid.is_null().to_numpy(zero_copy_only=False)
    chunk = batch.column("chunk").cast(pa.binary())
    chunk = chunk.fill_null(b"") if chunk.null_count else chunk
    _, offsets, data = chunk.buffers()
    ends = np.frombuffer(offsets, np.int32)[chunk.offset:chunk.offset + n + 1]
    begins = np.ones(n, bool)
    begins[1:] = ((ids[1:] != ids[:-1]) | (no_id[1:] != no_id[:-1]) | (seq[1:] != seq[:-1] + 1)
                  | (ends[1:-1] // RUN_BYTES != ends[:-2] // RUN_BYTES))
    first = np.flatnonzero(begins)
    after = np.append(first[1:], n)
    cuts = np.append(ends[first], ends[-1:]).astype(np.int32)
    sizes = np.diff(ends).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [sid.take(pa.array(first)), pa.array(seq[first]), pa.array(seq[after - 1]),
         pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts), data]),
         pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((np.append(first, n) * 4).astype(np.int32)), pa.py_buffer(sizes)])],
        names=["stream_id", "seq", "last", "chunk", "sizes"]), first


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield runs_of(batch)[0]


def chunks_of(run: tuple) -> list[tuple[int, bytes]]:
    """The chunks of a run (seq, chunk, sizes), each with its number."""
    seq, chunk, sizes = run
    ends = np.cumsum(np.frombuffer(sizes, np.int32)).tolist()
    return [(seq + i, chunk[begin:end]) for i, (begin, end) in enumerate(zip([0, *ends], ends))]


def _in_order(runs: list) -> bytes:
    """The bytes of runs (seq, chunk, sizes) that share numbers, chunk by chunk in order of ``seq``."""
    if len(runs) == 1:
        return runs[0][1]
    return b"".join(c for _, c in sorted((p for run in runs for p in chunks_of(run)), key=lambda p: p[0]))


def segment_chunks(chunks: DataFrame, num_partitions: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """``(stream_id, seq, chunk BINARY)`` -> ``(stream_id, seg, text)`` safe segments."""
    spark = chunks.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = chunks.select(F.col("stream_id").cast("long"), F.col("seq").cast("long"), "chunk").mapInArrow(_runs, _RUN_SCHEMA) \
        .repartition(n, "stream_id").sortWithinPartitions("stream_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, seg, segmenter, held, upto = None, 0, None, [], None
        for batch in batches:
            out = []

            def take():
                nonlocal seg, held
                if held:
                    text = segmenter.feed(_in_order(held))
                    if text:
                        out.append((cur, seg, text))
                        seg += 1
                held = []

            for sid, seq, last, chunk, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                if segmenter is None or sid != cur:
                    if segmenter is not None:
                        take()
                        out.append((cur, seg, segmenter.finish()))
                    cur, seg, segmenter, upto = sid, 0, Segmenter(max_bytes=max_bytes), last
                elif seq > upto:   # no later run can hold a chunk from before this one
                    take()
                held.append((seq, chunk, sizes))
                upto = max(upto, last)
            yield _segments(out)
        if segmenter is not None:
            out = []
            take_last = segmenter.feed(_in_order(held)) if held else ""
            if take_last:
                out.append((cur, seg, take_last))
                seg += 1
            yield _segments([*out, (cur, seg, segmenter.finish())])

    return ordered.mapInArrow(run, SEGMENT_SCHEMA)


def _segments(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                                      names=["stream_id", "seg", "text"])


def restore_segments(segments: DataFrame, sessions: DataFrame, vault: DataFrame, unknown=P.REDACTED, split: bool = False) -> DataFrame:
    """Batch restore (D5) of each segment; ``sessions``: ``(stream_id, session_key)``. Other columns of
    the segments pass through. ``split``: segments without a token pass by without an exchange; for
    segments that can be read twice."""
    more = [c for c in segments.columns if c not in ("stream_id", "seg", "text")]
    asked = segments.where(has_token(F.col("text"))) if split else segments
    replies = asked.join(sessions, "stream_id", "left") \
        .select(F.struct("stream_id", "seg").alias("_sid"), "stream_id", "seg", *more,
                "session_key", F.col("text").alias("body"))
    restored = detokenize(replies, vault, id_col="_sid", unknown=unknown, split=False).select("stream_id", "seg", *more, "restored")
    plain = segments.where(~has_token(F.col("text"))).select("stream_id", "seg", *more, F.col("text").alias("restored"))
    return restored.unionByName(plain) if split else restored


def joined(segments: DataFrame) -> DataFrame:
    """The restored segments of each stream put together in order."""
    return segments.groupBy("stream_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "restored"))), lambda x: x["restored"]), "")
        .alias("restored"))


def detokenize_stream(chunks: DataFrame, sessions: DataFrame, vault: DataFrame) -> DataFrame:
    """D7 batch form: restored text per stream (segments restored, then joined in order)."""
    return joined(restore_segments(segment_chunks(chunks), sessions, vault))


def chunk_size(id_col: str = "msg_id") -> Column:
    return (F.abs(F.col(id_col)) % 13 + 1).cast("int")


def chunk_count(id_col: str = "msg_id", body_col: str = "body") -> Column:
    """Into how many chunks ``split_into_chunks`` cuts a reply."""
    return F.greatest(F.ceil(F.octet_length(body_col) / chunk_size(id_col)), F.lit(1)).cast("int")


def split_into_chunks(replies: DataFrame, id_col: str = "msg_id", body_col: str = "body", keep=()) -> DataFrame:
    """Cut each reply's UTF-8 bytes into chunks of 1..13 bytes (varying by stream), so chunk edges
    fall inside multi-byte characters and tokens. Columns in ``keep`` go with each chunk.

    The bytes are made once a reply, not once a chunk."""
    size = chunk_size(id_col)
    parts = let(F.encode(F.col(body_col), "UTF-8"), lambda data: F.transform(
        F.sequence(F.lit(0), chunk_count(id_col, body_col) - 1), lambda i: F.substring(data, i * size + 1, size)))
    return replies.select(F.col(id_col).alias("stream_id"), *keep, F.posexplode_outer(parts).alias("seq", "chunk"))
