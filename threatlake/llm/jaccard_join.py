"""Similarity join of documents on their sets of word n-grams, by vertical partitioning.

N-grams have one global order: rare ones by a 64-bit value, then those that a large part of the documents share. The
order is cut into fragments. A document's set falls into one segment for each fragment, and the overlap of two sets is the
sum of the overlaps of their segments, each counted in its fragment alone.

1. *Sets.* One pass gives the size and a 64-bit digest of every set, and, chunk by chunk, the frequent n-grams. Documents
   with equal sets form a class, named by the digest; all that follows compares classes ("documents" below), and only at the end
   a component is named by its smallest id. Classes of rows that repeat an id are linked from the start.
2. *Leading fragments.* Two sets with the asked similarity share an n-gram among the first quarter of either. Each
   document sends a little more than that to the fragments (``LEAD`` of it), and the place where its leading n-grams end. Of two
   sets the one that ends first shares none of its leading n-grams but those it meets the other at; the one that ends later may
   share more, with the rest of the other. So only a document that ends first is judged by what it meets there. The chunk sends
   an n-gram once, however many of its documents hold it, so a group of copies doesn't gather in a fragment.
3. *Candidates.* Documents that meet at an n-gram are compared with its hub, one of them; the components this gives
   are labels. N-grams held under one label and documents whose other n-grams can't make a similar pair under another
   label leave. After some turns with other hubs, the pairs under different labels that still meet follow. No pair
   inside a component is needed, so a group of near copies costs its size and not its square. N-grams that the same documents
   hold, as those of a shared passage, are one with a weight: documents meet once at a passage, however long it is.
4. *Partial overlaps.* Whole sets of the candidates are cut into segments; each fragment counts the overlap of every
   pair there, and the counts are summed per pair and compared, in integers, with the bound.

Defined cases: a null or blank text has no n-grams and is linked with nothing; a text with fewer words than an n-gram
has one, its whole sequence; rows that repeat a ``doc_id`` count as one linked document; a null ``doc_id`` is returned with a null
component; other columns of the input are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from threatlake.llm.common import (
    LOWER, PLACE, U64, discard, expand, mixed, part_count, prefix_hash, scratch, span_hash, stored, text_blocks, text_of, word_spans,
)
from threatlake.llm.components import components

#: Part of each set that goes to the leading fragments; more than 1 minus the similarity.
LEAD = 0.35
#: An n-gram is frequent if the chunks where this part of the sets, and at least FREQUENT_LEAST of them, hold it have so many holders
#: that they are this part of all documents.
FREQUENT, FREQUENT_LEAST = 0.002, 8
CHUNK_GRAMS = 2_000_000
#: Turns of comparing with hubs; fragments of the partial overlaps; partners of a document that go to one cell.
HUB_TURNS, FRAGMENTS, PARTNERS = 2, 8, 2000
#: Leading n-grams that a leading fragment, and pairs that a group of partial overlaps, has on average at most; their numbers follow.
FRAGMENT_GRAMS, GROUP_PAIRS = 4_000_000, 100_000
#: N-grams that are looked up at a time; some arrays of their length are in memory.
OVERLAP_GRAMS = 500_000


def gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit n-gram values of each text."""
    data = LOWER[data]
    starts, ends, firsts = word_spans(data, offsets)
    words = span_hash(prefix_hash(data), starts, ends, data)
    counts = np.diff(firsts)
    with np.errstate(over="ignore"):
        full = np.maximum(counts - n + 1, 0)
        at = expand(firsts[:-1], full)
        value = np.full(len(at), PLACE[32], np.uint64)
        for k in range(n):
            value += words[at + k] * PLACE[k]
        value = mixed(value)
        cuts = np.concatenate([[0], np.cumsum(full)])
        out = [value[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        for m in range(1, n):
            few = np.flatnonzero(counts == m)
            short = np.full(len(few), PLACE[32 + m], np.uint64)
            for k in range(m):
                short += words[firsts[few] + k] * PLACE[k]
            for i, v in zip(few.tolist(), mixed(short)):
                out[i] = np.array([v], np.uint64)
    for i, s in enumerate(out):
        if len(s) > 1:
            s = np.sort(s)
            out[i] = s[np.concatenate([[True], s[1:] != s[:-1]])]
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _class_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s, digest_size=8).digest(), "little", signed=True)


# --- 1: sets ----------------------------------------------------------------------------------------------------


def _describe(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """A row (doc_id, size, doc = class) for each document, and a row (gram, size = holders) for each n-gram that is
    frequent in its chunk."""
    names = ["doc_id", "size", "doc", "gram"]
    held: dict[int, np.ndarray] = {}  # each distinct set once
    total = 0

    def frequent() -> pa.RecordBatch:
        grams = np.sort(np.concatenate(list(held.values())))
        edge = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        count = np.diff(np.append(edge, len(grams)))
        keep = count >= max(FREQUENT_LEAST, FREQUENT * len(held))
        k = int(keep.sum())
        return pa.RecordBatch.from_arrays(
            [pa.nulls(k, pa.int64()), pa.array(count[keep].astype(np.int64)), pa.nulls(k, pa.int64()), _signed(grams[edge][keep])], names
        )

    for batch in batches:
        for first, data, offsets in text_blocks(batch.column("text")):
            sets = gram_sets(data, offsets, n)
            classes = [_class_of(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(classes, pa.int64()),
                    pa.nulls(len(sets), pa.int64()),
                ],
                names,
            )
            for c, s in zip(classes, sets):
                if len(s) and c not in held:
                    held[c] = s
                    total += len(s)
            if total >= CHUNK_GRAMS:
                yield frequent()
                held, total = {}, 0
    if held:
        yield frequent()


def frequent_grams(described: DataFrame) -> np.ndarray:
    """Values of the n-grams that are frequent in the corpus. A document counts for no more n-grams than its set has, so there
    are at most 1 / FREQUENT times the mean size of the sets, whatever the number of chunks."""
    docs = described.where("gram IS NULL AND size > 0").count()
    found = described.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("size").alias("holders"))
    found = found.where(F.col("holders") >= max(FREQUENT_LEAST, FREQUENT * docs))
    return np.sort(np.array([r[0] for r in found.select("gram").toLocalIterator()], np.int64).view(np.uint64))


# --- 2: leading fragments -----------------------------------------------------------------------------------------


def _leading(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int, int]:
    """The first n-grams of a set in the global order, the place of the last of them there, less its two lowest bits, and how many of
    them are frequent."""
    least = -(-num * len(s) // den)
    take = min(len(s), max(len(s) - least + 1, int(np.ceil(LEAD * len(s)))))
    rare = len(s)
    if len(frequent):
        spot = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        common = frequent[spot] == s
        if common.any():
            rare = len(s) - int(common.sum())
            s = np.concatenate([s[~common], s[common]])
    return s[:take], (int(s[take - 1]) >> 2) - (0 if take > rare else 1 << 62), max(0, take - rare)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the same weight together: sorted or close numbers then compress well in the shuffle."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(kind).ravel()


def _packed(s: np.ndarray) -> bytes:
    """A sorted set by its differences: their highest bytes are mostly zero."""
    return _planes(np.diff(s, prepend=U64(0)))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(raw, np.uint64), dtype=np.uint64)


def _fragment_of(grams: np.ndarray, fragments: int) -> np.ndarray:
    return ((grams >> U64(32)) * U64(fragments) >> U64(32)).astype(np.int64)


def _send(batches: Iterator[pa.RecordBatch], n: int, frequent, fragments: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (fragment, meets, grams, docs): what a chunk sends to each fragment. ``meets`` 0: each n-gram once, to
    find other chunks' documents; 2: the same, for n-grams whose holders here are known already; 1: those holders; 3: the
    places where the leading n-grams of the documents end; 5: the numbers of frequent ones among them, where there are any."""
    frequent = frequent.value
    grams, docs, ends, tails, total, turn = [], [], [], [], 0, 0

    def chunk() -> Iterator[pa.RecordBatch]:
        nonlocal turn
        _, one = np.unique(np.array(docs), return_index=True)  # of equal sets only the first
        g = np.concatenate([grams[i] for i in one])
        d = np.repeat(np.array([docs[i] for i in one], np.int64), [len(grams[i]) for i in one])
        order = np.argsort(g, kind="stable")
        g, d = g[order], d[order]
        head = np.concatenate([[True], g[1:] != g[:-1]])
        count = np.diff(np.append(np.flatnonzero(head), len(g)))
        several = np.repeat(count > 1, count)
        out = []
        places = np.array([ends[i] for i in one], np.int64).view(np.uint64), np.array([docs[i] for i in one], np.int64)
        tail = np.array([tails[i] for i in one], np.uint64)
        some = [(meets, g[rows], d[rows]) for meets, rows in ((0, head & ~several), (2, head & several), (1, several))]
        for meets, gs, ds in (*some, (3, *places), (5, tail[tail > 0], places[1][tail > 0])):
            if meets % 2:
                for at in range(0, len(gs), 1 << 16):
                    turn += 1
                    out.append((turn * 7919 % fragments, meets, gs[at : at + (1 << 16)], ds[at : at + (1 << 16)]))
                continue
            f = _fragment_of(gs, fragments)
            cuts = np.searchsorted(f, np.arange(fragments + 1))
            out += [(i, meets, gs[a:b], ds[a:b]) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        for at in range(0, len(out), 256):
            some = out[at : at + 256]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in some], pa.int32()), pa.array([x[1] for x in some], pa.int32()),
                    pa.array([_planes(x[2]) for x in some], pa.binary()), pa.array([_planes(x[3]) for x in some], pa.binary()),
                ],
                ["fragment", "meets", "grams", "docs"],
            )

    for batch in batches:
        for _, data, offsets in text_blocks(batch.column("text")):
            for s in gram_sets(data, offsets, n):
                if len(s):
                    lead, end, tail = _leading(s, frequent, num, den)
                    grams.append(np.sort(lead))
                    ends.append(end)
                    tails.append(tail)
                    docs.append(_class_of(s))
                    total += len(lead)
            if total >= CHUNK_GRAMS // 2:  # a chunk is sorted with its documents, twice the memory
                yield from chunk()
                grams, docs, ends, tails, total = [], [], [], [], 0
    if grams:
        yield from chunk()


def _meet(found: pa.Table) -> pa.Table:
    """(gram, doc) of the n-grams of a fragment that more than one document holds; and, marked, the places of the documents' ends (1) and
    their numbers of frequent leading n-grams (2)."""
    g, d, known = [], [], []
    for row in found.to_pylist():
        g.append(_unplanes(row["grams"], np.uint64))
        d.append(_unplanes(row["docs"], np.int64))
        known.append(np.full(len(d[-1]), row["meets"], np.int8))
    g, d, known = np.concatenate(g), np.concatenate(d), np.concatenate(known)
    direct = known % 2 == 1
    sg, sd, sk = g[~direct], d[~direct], known[~direct]
    order = np.argsort(sg, kind="stable")
    sg, sd, sk = sg[order], sd[order], sk[order]
    edge = np.flatnonzero(np.concatenate([[True], sg[1:] != sg[:-1]])) if len(sg) else np.zeros(0, np.int64)
    count = np.diff(np.append(edge, len(sg)))
    met = np.repeat(count > 1, count) & (sk == 0)
    ends = np.concatenate([known[direct] // 2, np.zeros(int(met.sum()), np.int8)])
    return pa.table(
        [_signed(np.concatenate([g[direct], sg[met]])), pa.array(np.concatenate([d[direct], sd[met]])), pa.array(ends)], ["gram", "doc", "ends"]
    )


# --- 3: candidates --------------------------------------------------------------------------------------------------


def _lead(size: Column, num: int, den: int) -> Column:
    """Number of leading n-grams of a set, as ``_leading`` takes them."""
    return F.least(size, F.greatest(size - F.ceil(size * num / den) + 1, F.ceil(size * LEAD)))


def merged(met: DataFrame) -> DataFrame:
    """``met(gram, doc, ...)`` with ``weight``: of the n-grams that the same documents hold only the smallest stays, and counts for all of them. Those
    of a single document leave. Sets of holders are told apart by their number and 128 bits."""
    one = F.first("weight") if "weight" in met.columns else F.lit(1)
    holders = met.groupBy("gram").agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("doc")).alias("_x"), F.bit_xor(F.xxhash64("doc", F.lit("holder"))).alias("_y"),
        one.cast("long").alias("_w"),
    )
    kept = holders.where("_n > 1").groupBy("_n", "_x", "_y").agg(F.min("gram").alias("gram"), F.sum("_w").alias("weight"))
    return met.drop("weight").join(kept.select("gram", "weight"), "gram")


def open_rows(met: DataFrame, num: int, den: int) -> DataFrame:
    """Of ``met(gram, doc, weight, size, end, label)`` the rows that may lead to a similar pair under different labels, with ``_own``, the
    leading n-grams of the document that no such pair can share if the document ends first in it.

    Two sets share ``num / (num + den)`` of their summed sizes at least; the one that ends first no more than it has besides
    its own, the other no more than its size. A row stays if its document can be the first to end and the smallest holder of the gram is small
    enough, or if some holder that can be the first does not end behind it."""
    size, end = F.col("size"), F.col("end")
    if "_own" not in met.columns:
        met = met.withColumn("_own", F.lit(0).cast("long"))
    first = F.when(den * (size - F.col("_own")) >= num * size, end)
    grams = met.groupBy("gram").agg(
        F.min("label").alias("_low"), F.max("label").alias("_high"), F.min("size").alias("_least"), F.min(first).alias("_first")
    )
    grams = stored(grams.where("_low < _high AND _first IS NOT NULL").select("gram", "_least", "_first"), "open")
    least = F.greatest("_least", F.ceil(size * num / den))
    enough = lambda most: (num + den) * most >= num * (size + least)
    met = met.join(grams, "gram").where(enough(size - F.col("_own")) | (enough(size) & (F.col("_first") <= end)))
    met = stored(met.drop("_own", "_least", "_first"), "met")  # one table and one shuffle of it at a time
    discard(grams)
    own = met.groupBy("doc", "size").agg(F.sum("weight").alias("_met")).select("doc", (_lead(size, num, den) - F.col("_met")).alias("_own"))
    out = stored(met.join(own, "doc"), "met")
    discard(met)
    return out


def _fits(num: int, den: int):
    """What the sizes of two sets, less what the one that ends first has of its own, allow to be similar."""
    ours, theirs = F.col("size") - F.col("_own"), F.col("_size") - F.col("_less")
    first = F.when(F.col("end") < F.col("_end"), ours).when(F.col("end") > F.col("_end"), theirs).otherwise(F.greatest(ours, theirs))
    return (num + den) * F.least(first, "size", "_size") >= num * (F.col("size") + F.col("_size"))


def hub_pairs(met: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Pairs of each document with the hub of each of its n-grams, where their labels differ. First the hub is the document
    with the least of its own, the likely original of a group of near copies; in later turns it is drawn by hash."""
    rank = F.struct(F.col("_own") / F.col("size"), "doc") if turn == 0 else F.struct(F.xxhash64("doc", F.lit(turn)), "doc")
    hubs = met.groupBy("gram").agg(F.min_by(F.struct("doc", "size", "end", "label", "_own"), rank).alias("_hub"))
    names = {"doc": "b", "size": "_size", "end": "_end", "label": "_label", "_own": "_less"}
    hubs = stored(hubs.select("gram", *[F.col(f"_hub.{k}").alias(v) for k, v in names.items()]), "hubs")
    pairs = met.join(hubs, "gram").where((F.col("label") != F.col("_label")) & _fits(num, den))
    out = stored(pairs.select(F.col("doc").alias("a"), "b").distinct(), "hub-pairs")
    discard(hubs)
    return out


def probes(met: DataFrame, num: int, den: int) -> DataFrame:
    """``met`` with ``_probe``, whether a document looks for others at the n-gram, and ``_skip``, the leading n-grams where it does not.

    A set that ends first shares at least ``need`` of its leading n-grams with a similar one. So it meets that at one of any but
    ``need - 1`` of them, and those with the most holders are left out."""
    need = _lead(F.col("size"), num, den) - F.col("size") + F.ceil(F.col("size") * num / den)
    met = met.join(met.groupBy("gram").agg(F.count("*").alias("_n")), "gram")
    heavy = Window.partitionBy("doc").orderBy(F.desc(F.col("_n") / F.col("weight")), "gram").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_sum", F.sum("weight").over(heavy)).withColumn("_probe", F.col("_sum") >= need)
    skipped = F.coalesce(F.max(F.when(~F.col("_probe"), F.col("_sum"))).over(Window.partitionBy("doc")), F.lit(0))
    return met.withColumn("_skip", skipped).drop("_n", "_sum")


def rest_pairs(met: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b`` of the pairs under different labels that may be similar by their overlap in the leading fragments. The one whose
    leading n-grams end first in the global order shares none of them with the other but those where they meet and those it skips. If it
    ends among the frequent n-grams, all rare ones of the other are before, so that shares none of its own either."""
    size, other = F.col("size"), F.col("_size")
    met = stored(probes(met, num, den), "probes")
    theirs = other - F.when(F.col("end") >= 0, F.greatest(F.col("_less") - F.col("_tail"), F.lit(0))).otherwise(0)
    names = {"doc": "b", "size": "_size", "end": "_end", "label": "_label", "_own": "_less", "tail": "_tail"}
    found = met.where("_probe").join(met.select("gram", *[F.col(k).alias(v) for k, v in names.items()]), "gram")
    least = lambda most: (num + den) * F.least(most, "size", theirs) >= num * (size + other)
    found = found.where((F.col("label") != F.col("_label")) & (F.col("end") <= F.col("_end")) & least(size - F.col("_own")))
    shared = found.groupBy("doc", "b", "size", "_size", "_skip").agg(F.sum("weight").alias("_c"))
    most = F.col("_c") + F.col("_skip") + size - _lead(size, num, den)
    likely = shared.where((num + den) * most >= num * (size + other))
    return likely.select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).distinct()


# --- 4: partial overlaps --------------------------------------------------------------------------------------------


def _whole(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(doc, grams): whole sets of the rows whose class is among those that ``wanted`` names."""
    for batch in batches:
        wanted = batch.column("wanted").to_pylist()
        for first, data, offsets in text_blocks(batch.column("text")):
            sets = [(_class_of(s), s) for s in gram_sets(data, offsets, n)]
            sets = [(c, _packed(s)) for i, (c, s) in enumerate(sets) if c in wanted[first + i]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in sets], pa.int64()), pa.array([x[1] for x in sets], pa.binary())], ["doc", "grams"])


def _segments(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Rows (cell, doc, others, grams): a document's segment in each fragment, for each group of pairs it takes part in,
    with the partners it is to be compared with there."""
    for batch in batches:
        cols: tuple[list, list, list, list] = ([], [], [], [])
        for row in batch.to_pylist():
            s = _unpacked(row["grams"])
            cuts = np.searchsorted(_fragment_of(s, FRAGMENTS), np.arange(FRAGMENTS + 1))
            for part in row["parts"]:
                others = np.array(part["others"], np.int64).tobytes()
                for f in np.flatnonzero(np.diff(cuts)).tolist():
                    cols[0].append(f * groups + part["pairs"])
                    cols[1].append(row["doc"])
                    cols[2].append(others)
                    cols[3].append(_packed(s[cuts[f] : cuts[f + 1]]))
            if len(cols[0]) > 5000:
                yield _cells(cols)
                cols = ([], [], [], [])
        if cols[0]:
            yield _cells(cols)


def _cells(cols) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["cell", "doc", "others", "grams"])


def _overlaps(found: pa.Table) -> pa.Table:
    """(a, b, shared) of the pairs of a cell."""
    docs = found.column("doc").to_numpy()
    segments = [_unpacked(x) for x in found.column("grams").to_pylist()]
    others = [np.frombuffer(x, np.int64) for x in found.column("others").to_pylist()]
    size = np.array([len(s) for s in segments], np.int64)
    start = np.cumsum(size) - size
    grams = np.concatenate(segments)
    with np.errstate(over="ignore"):
        own = np.sort(mixed(grams + mixed(np.repeat(docs.view(np.uint64), size))))
        pairs = np.array([len(o) for o in others], np.int64)
        left, b = np.repeat(np.arange(len(docs)), pairs), np.concatenate(others)
        shared = np.zeros(len(b), np.int64)
        step = max(1, int(OVERLAP_GRAMS // max(1, size.max())))
        for at in range(0, len(b), step):  # a bounded number of n-grams at a time
            of, to = left[at : at + step], b[at : at + step]
            which = np.repeat(np.arange(len(of)), size[of])
            seek = mixed(grams[expand(start[of], size[of])] + mixed(to.view(np.uint64))[which])
            spot = np.minimum(np.searchsorted(own, seek), len(own) - 1)
            shared[at : at + step] = np.bincount(which, own[spot] == seek, len(of)).astype(np.int64)
    some = shared > 0
    return pa.table([pa.array(docs[left[some]]), pa.array(b[some]), pa.array(shared[some])], ["a", "b", "shared"])


def linked(pairs: DataFrame, sets: DataFrame, sizes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` whose Jaccard similarity is at least ``num / den``.

    Pairs are grouped by ``b``, a ``b`` with many partners into several groups; a cell is a group in one of the
    fragments. Each document goes to the cells of its pairs, and the overlaps of a pair's cells are summed."""
    groups = max(part_count(pairs.sparkSession), -(-pairs.count() // GROUP_PAIRS))
    load = stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / PARTNERS).alias("_split")), "load")
    pairs = pairs.join(load, "b")
    pairs = pairs.withColumn("pairs", F.pmod(F.xxhash64("b", F.pmod(F.xxhash64("a"), "_split")), F.lit(groups)).cast("int"))
    sides = pairs.select(F.col("a").alias("doc"), "pairs", F.col("b").alias("_other")).union(
        pairs.select("b", "pairs", F.lit(None).cast("long"))
    )
    parts = sides.groupBy("doc", "pairs").agg(F.collect_set("_other").alias("others"))
    parts = parts.groupBy("doc").agg(F.collect_list(F.struct("pairs", "others")).alias("parts"))
    cells = sets.join(parts, "doc").mapInArrow(partial(_segments, groups=groups), "cell int, doc long, others binary, grams binary")
    counts = cells.groupBy("cell").applyInArrow(_overlaps, "a long, b long, shared long")
    total = counts.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    total = total.join(sizes.select(F.col("doc").alias("a"), F.col("size").alias("_a")), "a")
    total = total.join(sizes.select(F.col("doc").alias("b"), F.col("size").alias("_b")), "b")
    return total.where(den * F.col("shared") >= num * (F.col("_a") + F.col("_b") - F.col("shared"))).select("a", "b")


# --- the join -------------------------------------------------------------------------------------------------------


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 3, den: int = 4) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``: documents link when the Jaccard similarity of
    their n-gram sets is at least ``num / den``."""
    with scratch(docs.sparkSession):
        return _components(docs, n, num, den)


def _components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    described = stored(texts.mapInArrow(partial(_describe, n=n), "doc_id long, size long, doc long, gram long"), "sets", lasting=True)
    rows = described.where("gram IS NULL").select("doc_id", "size", "doc")
    known = rows.where("doc_id IS NOT NULL AND size > 0")
    classes = stored(known.groupBy("doc").agg(F.min("doc_id").alias("first"), F.max("size").alias("size")), "classes")
    sizes = classes.select("doc", "size")
    several = known.groupBy("doc_id").agg(F.count("*").alias("_rows"), F.min("doc").alias("a"), F.max("doc").alias("_last"))
    several = stored(several.where("_rows > 1").drop("_rows"), "several")
    same = known.join(several.where("a < _last"), "doc_id").where("a <> doc").select("a", F.col("doc").alias("b")).distinct()
    same = stored(same, "same")

    frequent = spark.sparkContext.broadcast(frequent_grams(described))
    total = classes.agg(F.sum("size")).first()[0] or 0
    fragments = max(part_count(spark), int(LEAD * total) // FRAGMENT_GRAMS + 1)
    sent = texts.where("doc_id IS NOT NULL").mapInArrow(
        partial(_send, n=n, frequent=frequent, fragments=fragments, num=num, den=den),
        "fragment int, meets int, grams binary, docs binary",
    )
    found = stored(sent.groupBy("fragment").applyInArrow(_meet, "gram long, doc long, ends byte"), "meet")
    marked = lambda k: F.max(F.when(F.col("ends") == k, F.col("gram")))
    ends = found.where("ends > 0").groupBy("doc").agg(marked(1).alias("end"), F.coalesce(marked(2), F.lit(0)).alias("tail")).join(sizes, "doc")
    held = stored(found.where("ends = 0").select("gram", "doc").distinct(), "held")
    met = merged(held).join(ends, "doc").withColumn("label", F.col("doc"))
    tested = labels = None
    if not same.isEmpty():
        labels = components(same)
        met = _labelled(met, labels)
    met = stored(met, "met")
    discard(found, held)
    for _ in range(3):  # documents that left may have freed n-grams
        met = _opened(met, met, num, den)
    wanted = met.select("doc").distinct().join(classes, "doc").groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("doc").alias("wanted"))
    wanted = stored(wanted, "wanted")
    whole = lambda ids: texts.join(ids, "doc_id").mapInArrow(partial(_whole, n=n), "doc long, grams binary")
    if several.isEmpty():
        sets = whole(wanted)
    else:  # one row of each class
        again = several.select("doc_id")
        sets = whole(wanted.join(again, "doc_id", "left_anti")).union(whole(wanted.join(again, "doc_id", "left_semi")).dropDuplicates(["doc"]))
    sets = stored(sets, "grams")

    for turn in range(HUB_TURNS + 1):
        pairs = hub_pairs(met, turn, num, den) if turn < HUB_TURNS else rest_pairs(met, num, den)
        if tested is not None:
            either = tested.union(tested.select("b", "a"))
            pairs = pairs.join(either, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = stored(linked(pairs, sets, sizes, num, den), "links")
        tested = pairs if tested is None else tested.union(pairs)
        labels = components(found, labels)
        if turn < HUB_TURNS:
            met = _opened(met, _labelled(met, labels), num, den)
            if met.isEmpty():
                break

    if labels is None:
        named = classes.select("doc", F.col("first").alias("_component"))
    else:
        joined = stored(labels.withColumnRenamed("node", "doc").join(classes.select("doc", "first"), "doc"), "joined")
        names = stored(joined.groupBy("component").agg(F.min("first").alias("_name")), "names")
        label = joined.join(names, "component").select("doc", "_name")
        named = classes.join(label, "doc", "left").select("doc", F.coalesce("_name", "first").alias("_component"))
    named = stored(named.withColumnRenamed("doc", "_class"), "named", lasting=True)
    key = F.when(F.col("doc_id").isNotNull() & (F.col("size") > 0), F.col("doc"))
    out = rows.join(named, key == F.col("_class"), "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id"))


def _opened(old: DataFrame, met: DataFrame, num: int, den: int) -> DataFrame:
    """The open rows of ``met``, which reads the stored table ``old``; that is deleted."""
    out = open_rows(met, num, den)
    discard(old)
    return out


def _labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    label = labels.select(F.col("node").alias("doc"), F.col("component").alias("_label"))
    return met.join(label, "doc", "left").withColumn("label", F.coalesce("_label", "doc")).drop("_label")
