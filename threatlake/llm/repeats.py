"""Removal of long repeated byte strings, by bounded expansion of intervals on a Burrows-Wheeler transform.

A byte goes if it lies in a string of LENGTH bytes that starts more than once in the corpus. A *window* is such a
string.

1. *Segments.* The anchor of a window is the leftmost of its GRAM-byte strings with the smallest hash. It depends on the window
   alone, so equal windows have equal anchors at equal places. The windows of one anchor are consecutive; together they
   are a segment, about 600 bytes for 200 windows. Segments whose anchor occurs once hold no repeated window; where all segments
   of an anchor are equal, all windows are repeated. Equal segments are counted, not collected.
2. *Intervals.* Distinct segments of the other anchors are dealt to buckets by anchor. A bucket sorts the suffixes of its
   segments to the depth of LENGTH and forms the Burrows-Wheeler transform. Starting from the interval of the empty
   string, intervals are extended backwards by each symbol, breadth first: round l finds exactly the places between
   neighbouring suffixes whose common prefix has l bytes. After LENGTH rounds the places that are not found lie between suffixes
   that share a window; no longer common prefix is ever computed.
3. *Crowded anchors.* An anchor with more than CROWD distinct segments (a passage in very many surroundings) doesn't go
   to one bucket: its windows are counted one by one, by anchor, place and hash, which spreads and pre-aggregates.
4. *Removal.* The repeated windows give byte spans of each document; they are merged and cut out.

Matches never cross documents, since segments don't.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; equal rows are occurrences of their own, so
a repeated row of LENGTH bytes or more is removed whole; other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from threatlake.llm.common import U64, expand, mixed, part_count, prefix_hash, scratch, span_hash, stored, text_blocks, text_of

LENGTH = 400
GRAM = 32
CROWD = 2000
BUCKET_BYTES = 1 << 20
KEY = ["doc_id", "text_hash"]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# --- 1: segments ----------------------------------------------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive numbers: of the rest of a block and the start of the next."""
    n = len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of the texts of a block: text, start in the text, number of windows, hash of the anchor, hash of the
    segment, place of the anchor in the segment."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return dict(text=none, start=none, windows=none, anchor=none.view(np.uint64), segment=none.view(np.uint64))
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = span_hash(prefix, at, at + gram)
    keys = (hashes >> U64(32) << U64(32)) | at.astype(np.uint64)
    anchors = (sliding_min(keys, length - gram + 1) & U64(0xFFFFFFFF)).astype(np.int64)
    room = np.diff(offsets) - length + 1  # windows of each text
    some = np.flatnonzero(room > 0)
    window = expand(offsets[some], room[some])
    text = np.repeat(some, room[some])
    own = anchors[window]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])) if len(own) else none
    windows = np.diff(np.append(first, len(window)))
    begin, text = window[first], text[first]
    return dict(
        text=text, start=begin - offsets[text], windows=windows, anchor=hashes[own[first]],
        segment=span_hash(prefix, begin, begin + windows + length - 1),
    )


SEGMENTS = "doc_id long, text_hash long, start int, windows int, anchor long, segment long"


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, data, offsets in text_blocks(batch.column("text")):
            found = segments(data, offsets, length)
            row = pa.array(found["text"] + first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(row), batch.column("text_hash").take(row), pa.array(found["start"].astype(np.int32)),
                    pa.array(found["windows"].astype(np.int32)), _signed(found["anchor"]), _signed(found["segment"]),
                ],
                ["doc_id", "text_hash", "start", "windows", "anchor", "segment"],
            )


# --- 2: intervals -----------------------------------------------------------------------------------------------------


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes in the order of their first ``depth`` symbols at least, by doubling."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, text.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for j in range(7):  # seven symbols of nine bits to begin with
        key = key << 9 | padded[j : j + n]
    done = 7
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate([[0], (ranked[1:] != ranked[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if done >= depth or rank[order[-1]] == n - 1:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - done)] = rank[done:] + 1
        key = rank * (n + 1) + after
        done *= 2


def long_prefixes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place before a sorted suffix (and after the last), whether its neighbours share ``length`` symbols or
    more. Symbol 0 ends a string and is never crossed."""
    n = len(text)
    transform = text[order - 1]  # the symbol before each suffix, cyclic
    front = np.argsort(transform, kind="stable")
    forward = np.empty(n, np.int64)
    forward[front] = np.arange(n)
    same = transform[front][1:] == transform[front][:-1]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[front[1:][same]] = front[:-1][same]
    after[front[:-1][same]] = front[1:][same]

    open_ = np.ones(n + 1, bool)
    open_[0] = open_[n] = False
    first_symbol = text[order]
    low = np.flatnonzero(np.concatenate([[True], first_symbol[1:] != first_symbol[:-1]]))
    high = np.append(low[1:], n) - 1
    open_[high + 1] = False
    for _ in range(1, length):
        if not len(low):
            break
        size = high - low + 1
        inside = expand(low, size)
        left, right = np.repeat(low, size), np.repeat(high, size)
        going = transform[inside] != 0
        # a symbol's first and last place in an interval give the ends of the extended interval
        new_low = np.sort(forward[inside[going & (before[inside] < left)]])
        new_high = np.sort(forward[inside[going & (after[inside] > right)]])
        unseen = open_[new_high + 1]
        low, high = new_low[unseen], new_high[unseen]
        open_[high + 1] = False
    return open_


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each byte string, which of its windows start more than once in all of them."""
    sizes = np.array([len(p) + 1 for p in pieces], np.int64)
    text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes)
    text[ends - 1] = 0
    order = sorted_suffixes(text, length)
    long = long_prefixes(text, order, length)
    mark = np.zeros(len(text), bool)
    mark[order] = long[:-1] | long[1:]
    return [mark[e - s : e - length] for s, e in zip(sizes.tolist(), ends.tolist())]


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


RANGES = "anchor long, segment long, windows int, first int, last int"


def _bucket(length: int):
    """(anchor, segment, windows, first, last): runs of repeated windows of the distinct segments of a bucket."""

    def ranges(found: pa.Table) -> pa.Table:
        rows, first, last = [], [], []
        for i, mark in enumerate(repeated_windows(found.column("bytes").to_pylist(), length)):
            a, b = _runs(mark)
            rows += [i] * len(a)
            first += a.tolist()
            last += (b - 1).tolist()
        take = found.select(["anchor", "segment", "windows"]).take(pa.array(rows, pa.int64()))
        return take.append_column("first", pa.array(first, pa.int32())).append_column("last", pa.array(last, pa.int32()))

    return ranges


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    names = ["anchor", "segment", "windows", "crowded", "bytes"]
    for batch in batches:
        texts, wanted = batch.column("text"), batch.column("wanted")
        rows: list[dict] = []
        for i in range(batch.num_rows):
            data = texts[i].as_py().encode()
            for w in wanted[i].as_py():
                rows.append(w | {"bytes": data[w["start"] : w["start"] + w["windows"] + length - 1]})
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)


# --- 3: crowded anchors -----------------------------------------------------------------------------------------------


def _windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of a segment: two hashes of its bytes."""
    for batch in batches:
        column = batch.column("bytes").to_pylist()
        for at in range(0, len(column), 512):
            some = column[at : at + 512]
            sizes = np.array([len(b) for b in some], np.int64)
            data = np.frombuffer(b"".join(some), np.uint8)
            counts = sizes - length + 1
            begin = expand(np.cumsum(sizes) - sizes, counts)
            prefix = prefix_hash(data)
            whole = span_hash(prefix, begin, begin + length)
            parts = mixed(span_hash(prefix, begin, begin + length // 2) ^ U64(0x9E3779B97F4A7C15)) + span_hash(prefix, begin + length // 2, begin + length)
            row = pa.array(np.repeat(np.arange(len(some)) + at, counts))
            place = expand(np.zeros(len(some), np.int64), counts)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in ("anchor", "segment", "windows")), pa.array(place.astype(np.int32)), _signed(whole), _signed(parts)],
                ["anchor", "segment", "windows", "first", "h1", "h2"],
            )


# --- 4: removal -------------------------------------------------------------------------------------------------------


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column("text"), batch.column("spans")
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i in range(batch.num_rows):
            data, kept, at, removed, runs = texts[i].as_py().encode(), hashlib.sha256(), 0, 0, 0
            last = -1
            for s in sorted((s["a"], s["b"]) for s in spans[i].as_py() or ()):
                if s[0] > last:
                    kept.update(data[at : s[0]])
                    runs += 1
                    at = s[0]
                if s[1] > at:
                    removed += s[1] - at
                    at = s[1]
                last = max(last, s[1])
            kept.update(data[at:])
            for column, value in zip(out, (len(data), removed, runs, kept.hexdigest())):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def _id():
    """Ids as keys of joins: a null id is a value of its own."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, text_hash, a, b``: spans of bytes of repeated windows, overlapping ones included. A null id shows as the least number."""
    spark = docs.sparkSession
    texts = docs.select(_id(), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = stored(texts.select(*KEY, "text").mapInArrow(partial(_segments, length=length), SEGMENTS), "segments")
    kind = F.struct("segment", "windows")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("_n"), F.min(kind).alias("_low"), F.max(kind).alias("_high"))
    anchors = stored(anchors.where("_n > 1").select("anchor", (F.col("_low") != F.col("_high")).alias("several")), "anchors")
    hits = stored(found.join(anchors, "anchor"), "hits")

    where = F.struct("doc_id", "text_hash", "start")
    distinct = hits.where("several").groupBy("anchor", "segment", "windows").agg(F.count("*").alias("copies"), F.min(where).alias("at"))
    distinct = stored(distinct, "distinct")
    crowds = stored(distinct.groupBy("anchor").agg((F.count("*") > CROWD).alias("crowded")), "crowds")
    wanted = distinct.join(crowds, "anchor").groupBy("at.doc_id", "at.text_hash").agg(
        F.collect_list(F.struct("anchor", "segment", "windows", "crowded", F.col("at.start").alias("start"))).alias("wanted")
    )
    pieces = texts.join(wanted, KEY).select("text", "wanted").mapInArrow(
        partial(_cut, length=length), "anchor long, segment long, windows int, crowded boolean, bytes binary"
    )
    pieces = stored(pieces, "pieces")

    total = pieces.where("not crowded").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(part_count(spark), -(-total // BUCKET_BYTES))
    spread = pieces.where("not crowded").dropDuplicates(["anchor", "segment", "windows"])
    spread = spread.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    ranges = spread.groupBy("bucket").applyInArrow(_bucket(length), RANGES)
    single = pieces.where("crowded").dropDuplicates(["anchor", "segment", "windows"]).mapInArrow(
        partial(_windows, length=length), "anchor long, segment long, windows int, first int, h1 long, h2 long"
    )
    single = stored(single, "windows")
    often = stored(single.groupBy("anchor", "h1", "h2").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n"), "often")
    single = single.join(often, ["anchor", "h1", "h2"]).select("anchor", "segment", "windows", "first", F.col("first").alias("last"))
    copied = distinct.where("copies > 1").select("anchor", "segment", "windows", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    ranges = stored(ranges.unionByName(single).unionByName(copied), "ranges")

    whole = hits.where("not several").select(*KEY, "start", F.lit(0).alias("first"), (F.col("windows") - 1).alias("last"))
    parts = hits.where("several").join(ranges, ["anchor", "segment", "windows"]).select(*KEY, "start", "first", "last")
    return whole.unionByName(parts).select(
        *KEY, (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + length).alias("b")
    )


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row of ``docs``."""
    with scratch(docs.sparkSession):
        spans = repeated_spans(docs, length).groupBy(*KEY).agg(F.collect_set(F.struct("a", "b")).alias("spans"))
        spans = stored(spans, "spans", lasting=True)
    rows = docs.select(F.col("doc_id").alias("_given"), _id(), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    rows = rows.join(spans, KEY, "left").select(F.col("_given").alias("doc_id"), "text", "spans")
    return rows.mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
