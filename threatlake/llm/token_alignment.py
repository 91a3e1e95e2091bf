"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked ids.

Both tokenizers cut the bytes of a space and the text. In each batch of documents two ``merge_asof`` joins, keyed by document,
find for every token start the other side's covering token: their union is all overlaps. Where an overlapping pair ends at the same
byte, a group ends; all tokens of the two sides inside one group are linked. The rest is counting:

1. *Chunks.* A task aligns its documents and collects each document's distinct linked id pairs, with their occurrences. Every
   CHUNK_PAIRS of them are a chunk, stored with the distinct pairs of all its documents and how many documents hold each.
2. *Counts.* Spark adds the chunks' numbers up per pair, which gives each pair's count, and per first id the highest count. A pair that all
   documents share is one row for each chunk, so no key is hotter than the number of chunks.
3. *Answers.* Each chunk is joined with the counts of its own pairs, and its documents are summed there.

Documents are cut into blocks of about a megabyte; a longer text is a block of its own. Links inside a group are counted from its A
tokens a bounded number at a time, so a long group costs time and not memory.

Defined cases: a null or empty text, and one whose tokens don't spell it (a character that a tokenizer rewrites or drops, U+2581), have
no tokens, zeros and an empty hash; special strings inside a text are plain text; ties for the highest count are all best; rows that repeat a
``doc_id`` are documents of their own; a null ``doc_id`` stays; other columns are ignored; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threatlake.llm.common import expand, scratch, stored, text_blocks
from threatlake.llm.token_files import PieceEncoder

#: Distinct pairs of documents, summed over the documents, that make a chunk; links counted at a time.
CHUNK_PAIRS, LINKS = 4_000_000, 1_000_000


class Spelling:
    """What the tokens of a vocabulary spell, as bytes."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[expand(self.start[ids], self.length[ids])]


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in own}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)})
    return out


class ByteLevel:
    """Ids of a byte-level tokenizer; special strings are plain text."""

    def __init__(self, path: str) -> None:
        self.pieces = PieceEncoder(path, 0)
        library = self.pieces.library
        library.encode_special_tokens = True
        value = byte_characters()
        vocabulary = library.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
        self.spelling = Spelling(tokens)

    def encode(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self.pieces.encode(data, offsets)
        ids = np.delete(ids, np.cumsum(counts) - 1)  # the end id of each text
        return ids, counts - 1


class PieceModel:
    """Ids of a sentence-piece tokenizer, which puts a space before the text by itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        tokens = []
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            tokens.append(bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace("▁", " ").encode())
        self.spelling = Spelling(tokens)

    def encode(self, texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.library.encode(texts.to_pylist(), num_threads=1)
        counts = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PieceModel(path) if path.endswith(".model") else ByteLevel(path)


def _spelled(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, counts: np.ndarray, spelling: Spelling) -> np.ndarray:
    """Which texts their tokens spell byte by byte."""
    total = np.concatenate([[0], np.cumsum(spelling.length[ids])])
    edges = np.concatenate([[0], np.cumsum(counts)])
    good = np.diff(total[edges]) == np.diff(offsets)
    some = ids[np.repeat(good, counts)]
    sizes = np.diff(offsets)[good]
    differ = spelling.spell(some) != data[expand(offsets[:-1][good], sizes)]
    wrong = np.searchsorted(np.cumsum(sizes), np.flatnonzero(differ), "right")
    good[np.flatnonzero(good)[np.unique(wrong)]] = False
    return good


def overlaps(doc_a: np.ndarray, start_a: np.ndarray, doc_b: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): places of all overlapping tokens. Starts ascend over all documents, and each document is covered by both sides."""
    a = pd.DataFrame({"doc": doc_a, "at": start_a, "a": np.arange(len(start_a))})
    b = pd.DataFrame({"doc": doc_b, "at": start_b, "b": np.arange(len(start_b))})
    one = pd.merge_asof(a, b, on="at", by="doc")
    two = pd.merge_asof(b, a, on="at", by="doc")
    two = two[start_a[two["a"].to_numpy()] != start_b[two["b"].to_numpy()]]  # equal starts are in both directions
    return np.concatenate([one["a"], two["a"]]).astype(np.int64), np.concatenate([one["b"], two["b"]]).astype(np.int64)


@lru_cache(maxsize=2)
def _written(ids: int) -> Spelling:
    """Decimal ids, each with room for the sign that follows it."""
    return Spelling([f"{i},".encode() for i in range(ids)])


def written_groups(a_ids, b_ids, a_group, b_group, offsets) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` of each document. ``offsets`` are the documents' first groups, and one more."""
    ids = np.concatenate([a_ids, b_ids])
    group = np.concatenate([a_group, b_group])
    side = np.concatenate([np.zeros(len(a_ids), np.int8), np.ones(len(b_ids), np.int8)])
    order = np.lexsort((side, group))
    ids, group, side = ids[order], group[order], side[order]
    table = _written(int(ids.max(initial=0)) + 1 | 0xFFFF)
    out = table.spell(ids)
    ends = np.cumsum(table.length[ids])
    last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)
    out[ends[last & (side == 0)] - 1] = ord("|")
    out[ends[last & (side == 1)] - 1] = ord(";")
    edges = np.concatenate([[0], ends])[np.searchsorted(group, offsets)]
    raw = out.tobytes()
    return [hashlib.sha256(raw[x : y - 1]).hexdigest() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _pairs(doc, a_ids, b_ids, a_group, n_b, width):
    """Distinct (document, id pair) of all links and how often each occurs; ``n_b``: B tokens of each group, which follow each other."""
    b_first = np.cumsum(n_b) - n_b
    links = n_b[a_group]
    cuts = np.searchsorted(np.cumsum(links), np.arange(LINKS, int(links.sum()) + LINKS, LINKS), "left") + 1
    keys, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    for cut in cuts.tolist():
        cut = min(cut, len(a_ids))
        if cut > at:
            some = slice(at, cut)
            base = doc[some] * width * width + a_ids[some].astype(np.int64) * width
            key = np.repeat(base, links[some]) + b_ids[expand(b_first[a_group[some]], links[some])]
            key, n = np.unique(key, return_counts=True)
            keys.append(key)
            times.append(n)
        at = max(at, cut)
    key, n = np.concatenate(keys), np.concatenate(times)
    if len(keys) > 2:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key, n = key[head], np.add.reduceat(n, head)
    return key, n


ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ROW = [f.split()[0] for f in ROWS.split(", ")]
#: Ids of either side are below this; a pair is one number.
WIDTH = 1 << 17


def _planes(x: np.ndarray) -> bytes:
    """Bytes of the same weight together: small numbers then compress well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def align_block(texts: pa.Array, data: np.ndarray, offsets: np.ndarray, a_path: str, b_path: str):
    """Of each text ``(n_a, n_b, n_groups, n_links)`` and the hash, and (text, pair, times) of all linked pairs. ``data`` holds a space and the text."""
    n = len(texts)
    left, right = tokenizer(a_path), tokenizer(b_path)
    (a_ids, a_counts), (b_ids, b_counts) = left.encode(texts, data, offsets), right.encode(texts, data, offsets)
    good = np.diff(offsets) > 1
    good &= _spelled(data, offsets, a_ids, a_counts, left.spelling) & _spelled(data, offsets, b_ids, b_counts, right.spelling)
    numbers, hashes = np.zeros((4, n), np.int64), [""] * n
    if not good.any():
        return numbers, hashes, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    a_ids, b_ids = a_ids[np.repeat(good, a_counts)], b_ids[np.repeat(good, b_counts)]
    where = np.flatnonzero(good)
    doc_a, doc_b = np.repeat(where, a_counts[good]), np.repeat(where, b_counts[good])
    a_end, b_end = np.cumsum(left.spelling.length[a_ids]), np.cumsum(right.spelling.length[b_ids])
    a, b = overlaps(doc_a, a_end - left.spelling.length[a_ids], doc_b, b_end - right.spelling.length[b_ids])
    last = np.sort(a_end[a[a_end[a] == b_end[b]]])  # ends of the groups
    a_group, b_group = np.searchsorted(last, a_end), np.searchsorted(last, b_end)
    n_a, n_b = np.bincount(a_group, minlength=len(last)), np.bincount(b_group, minlength=len(last))
    group_doc = np.zeros(len(last), np.int64)
    group_doc[a_group] = doc_a
    numbers[0, good], numbers[1, good] = a_counts[good], b_counts[good]
    numbers[2] = np.bincount(group_doc, minlength=n)
    links = np.concatenate([[0], np.cumsum(n_a * n_b)])
    first = np.concatenate([np.searchsorted(group_doc, where), [len(last)]])
    numbers[3, good] = np.diff(links[first])
    for i, h in zip(where.tolist(), written_groups(a_ids, b_ids, a_group, b_group, first)):
        hashes[i] = h
    key, times = _pairs(doc_a, a_ids, b_ids, a_group, n_b, WIDTH)
    doc, pair = np.divmod(key, WIDTH * WIDTH)
    return numbers, hashes, doc, pair, times


STORED = f"{ROWS}, chunk long, places binary, times binary, pairs binary, docs binary"


def _align(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[pa.RecordBatch]:
    """A row for each document, with the places of its pairs among those of its chunk, and a row for each chunk with its pairs."""
    names = [f.split()[0] for f in STORED.split(", ")]
    number = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0

    def chunk() -> Iterator[pa.RecordBatch]:
        nonlocal number
        number += 1
        sizes = [len(p) for p, _ in held]
        pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        docs = np.bincount(place, minlength=len(pairs))
        cuts = np.cumsum([0, *sizes]).tolist()
        packed = [_planes(np.diff(place[x:y], prepend=0)) for x, y in zip(cuts[:-1], cuts[1:])]
        for at in range(0, len(rows), 4096):
            some = slice(at, at + 4096)
            k = len(rows[some])
            columns = [pa.array(list(c), pa.string() if i == 5 else pa.int64()) for i, c in enumerate(zip(*rows[some]))]
            more = [
                pa.array(np.full(k, number)), pa.array(packed[some], pa.binary()),
                pa.array([_planes(t) for _, t in held[some]], pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns + more, names)
        empty = [pa.nulls(1, pa.string() if i == 5 else pa.int64()) for i in range(6)]
        more = [pa.array([number]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
        blobs = [pa.array([pairs.astype("<i8").tobytes()], pa.binary()), pa.array([_planes(docs)], pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, *more, *blobs], names)

    for batch in batches:
        for first, data, offsets in text_blocks(batch.column("spaced")):
            n = len(offsets) - 1
            texts = batch.column("text").slice(first, n)
            numbers, hashes, doc, pair, times = align_block(texts, data, offsets, a_path, b_path)
            edges = np.searchsorted(doc, np.arange(n + 1)).tolist()
            ids = batch.column("doc_id").slice(first, n).to_pylist()
            for i, (doc_id, four, h) in enumerate(zip(ids, numbers.T.tolist(), hashes)):
                rows.append((doc_id, *four, h))
                held.append((pair[edges[i] : edges[i + 1]], times[edges[i] : edges[i + 1]]))
            total += len(pair)
            if total >= CHUNK_PAIRS:
                yield from chunk()
                rows, held, total = [], [], 0
    if rows:
        yield from chunk()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, pair, docs) of the stored chunks."""
    for batch in batches:
        for chunk, pairs, docs in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "docs"))):
            pairs, docs = np.frombuffer(pairs, "<i8"), _unplanes(docs).astype(np.int64)
            for at in range(0, len(pairs), 1 << 16):
                some = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pairs[some]), chunk)), pa.array(pairs[some]), pa.array(docs[some])], ["chunk", "pair", "docs"]
                )


def _answer(key, rows: pa.Table, known: pa.Table) -> pa.Table:
    """Sums of the documents of a chunk, from the counts of its pairs."""
    order = np.argsort(known.column("pair").to_numpy())
    count, best = known.column("n").to_numpy()[order], known.column("best").to_numpy()[order]
    n_best, count_sum = [], []
    for places, times in zip(rows.column("places").to_pylist(), rows.column("times").to_pylist()):
        at, times = np.cumsum(_unplanes(places), dtype=np.int64), _unplanes(times).astype(np.int64)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * count[at]).sum()))
    sums = [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())]
    return pa.table([*(rows.column(c) for c in _ROW), *sums], [*_ROW, "n_best", "count_sum"])


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row of ``docs``."""
    with scratch(docs.sparkSession):
        return _alignment(docs, a_path, b_path)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many documents each pair is linked, and whether no other pair of its A id is in more."""
    counts = chunks.groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {WIDTH}")), "counts")
    top = counts.groupBy("a").agg(F.max("n").alias("_top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("_top")).alias("best"))


def _alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.concat(F.lit(" "), text).alias("spaced"))
    found = stored(texts.mapInArrow(partial(_align, a_path=a_path, b_path=b_path), STORED), "aligned", lasting=True)
    chunks = found.where("pairs IS NOT NULL").select("chunk", "pairs", "docs").mapInArrow(_unpacked, "chunk long, pair long, docs long")
    known = chunks.drop("docs").join(stored(pair_counts(chunks), "pairs", lasting=True), "pair").select("chunk", "pair", "n", "best")
    rows = found.where("pairs IS NULL").drop("pairs", "docs")
    out = rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_answer, f"{ROWS}, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
