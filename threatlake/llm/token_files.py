"""Token ids of whole documents in ORC files.

The files are in ascending order of ``doc_id``. Ids are an integer list, which ORC stores with its run-length
integer encoding; every stripe carries a row index (minimum and maximum per row group) and a Bloom filter on
``doc_id``, so a reader that looks for a document opens few stripes, and a reader of all of them splits the files by
stripe. Each row also carries the part it was written in and its place there, from which the position of a document in the whole token
stream follows without one global sort or running sum.

Defined cases: a null text counts as empty and yields the end id alone; rows that repeat a ``doc_id`` all stay, in
the order of their texts; a null ``doc_id`` sorts first; other columns of the input are ignored; no documents give no
rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from threatlake.llm.common import expand, prefix_hash, shared_path, span_hash, text_blocks, text_of

CACHED_PIECES = 1_500_000
LONG_PIECE = 256
#: Stripe size and rows per index entry: small enough to prune by document, large enough to read in sequence.
ORC_OPTIONS = {
    "compression": "zstd", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000",
    "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
}


class PieceEncoder:
    """Ids of texts, with every distinct piece of text encoded once.

    A byte-level tokenizer of this kind never joins characters across a single space between two other characters:
    the space opens the next unit. Texts are cut before such spaces, and only there; each distinct piece goes to the
    library, and its ids are looked up from then on by a 64-bit hash. Pieces of more than ``LONG_PIECE`` bytes go to
    the library each time.
    """

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if any(" " in t.content for t in self.library.get_added_tokens_decoder().values()):
            raise ValueError("a tokenizer whose special strings hold spaces can't be applied piece by piece")
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        for token, i in vocabulary.items():  # the vocabulary writes each byte as one character
            self.token_bytes[i] = len(token.encode()) if token in special else len(token)
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.slots = np.zeros(2 * CACHED_PIECES + (1 << 20), np.uint64)
        self.place = np.zeros(2 * CACHED_PIECES + (1 << 20), np.int32)
        self.start = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each hash, or the free slot at which its search ends; whether it was found."""
        spot = (hashes % np.uint64(len(self.slots))).astype(np.int64)
        there = self.slots[spot]
        open_ = np.flatnonzero((there != hashes) & (there != 0))
        while len(open_):
            spot[open_] = (spot[open_] + 1) % len(self.slots)
            there = self.slots[spot[open_]]
            open_ = open_[(there != hashes[open_]) & (there != 0)]
        return spot, self.slots[spot] == hashes

    def _keep(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        while len(hashes):
            spot, _ = self._find(hashes)
            _, one = np.unique(spot, return_index=True)
            self.slots[spot[one]], self.place[spot[one]] = hashes[one], numbers[one]
            rest = np.ones(len(hashes), bool)
            rest[one] = False
            hashes, numbers = hashes[rest], numbers[rest]

    def _library_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of the pieces. Pieces that open with a cut space follow each other in one text,
        and the byte lengths of the tokens tell them apart again."""
        raw, counts = data.tobytes(), np.zeros(len(starts), np.int64)
        joined = (data[starts] == 0x20) & _closed(data, ends - 1)
        order = np.concatenate([np.flatnonzero(joined), np.flatnonzero(~joined)])
        spans = [raw[a:b] for a, b in zip(starts[order].tolist(), ends[order].tolist())]
        n, step = int(joined.sum()), 4096
        texts = [b"".join(spans[i : min(i + step, n)]).decode() for i in range(0, n, step)] + [x.decode() for x in spans[n:]]
        found = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter((i for one in found for i in one), np.int32)
        ends_of_tokens = np.cumsum(self.token_bytes[ids])
        ends_of_pieces = np.cumsum((ends - starts)[order])
        last = np.searchsorted(ends_of_tokens, ends_of_pieces)
        if len(last) and not np.array_equal(ends_of_tokens[last], ends_of_pieces):
            raise ValueError("the tokenizer joins characters across pieces")
        sizes = np.diff(last, prepend=-1)
        firsts = last + 1 - sizes
        counts[order], at = sizes, np.zeros(len(starts), np.int64)
        at[order] = firsts
        return ids[expand(at, counts)], counts

    def _add(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Append pieces; returns their numbers."""
        at = len(self.start)
        self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)])
        self.count = np.concatenate([self.count, counts.astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids])
        return np.arange(at, at + len(counts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each followed by the end id; number of ids of each text)."""
        if len(self.start) > CACHED_PIECES:
            self._forget()
        starts, ends = _pieces(data, offsets)
        which = np.zeros(len(starts), np.int64)
        long = ends - starts > LONG_PIECE
        short = np.flatnonzero(~long)
        hashes = span_hash(prefix_hash(data), starts[short], ends[short])
        hashes[hashes == 0] = 1
        spot, there = self._find(hashes)
        if not there.all():
            distinct, first = np.unique(hashes[~there], return_index=True)
            at = short[~there][first]
            self._keep(distinct, self._add(*self._library_ids(data, starts[at], ends[at])))
            spot, there = self._find(hashes)
        which[short] = self.place[spot]
        start, count, ids = self.start, self.count, self.ids
        if long.any():
            more, counts = self._library_ids(data, starts[long], ends[long])
            which[long] = len(start) + np.arange(len(counts))
            start = np.concatenate([start, len(ids) + np.cumsum(counts) - counts])
            count, ids = np.concatenate([count, counts]), np.concatenate([ids, more])
        # the end id follows the last piece of each text
        edges = np.searchsorted(starts, offsets)
        which = np.insert(which, edges[1:], len(start))
        start, count, ids = np.append(start, len(ids)), np.append(count, 1), np.append(ids, np.int32(self.end_id))
        counts = count[which].astype(np.int64)
        edges = edges + np.arange(len(edges))
        return ids[expand(start[which], counts)], np.add.reduceat(counts, edges[:-1])


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans between the spaces at which a text can be cut. A neighbour of the space that is, or may end or begin,
    any kind of white space forbids the cut."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    after = data[at + 1]
    fine = (after > 0x20) & ~_WIDE[after] & _closed(data, at - 1)
    cut = np.zeros(len(data) + 1, bool)
    cut[at[fine]] = cut[offsets[:-1]] = True
    starts = np.flatnonzero(cut[:-1])
    return starts, np.append(starts[1:], len(data))


def _closed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at these bytes is certainly no white space."""
    last, second, third = data[at], data[np.maximum(at - 1, 0)], data[np.maximum(at - 2, 0)]
    wide = (second == 0xC2) & ((last == 0x85) | (last == 0xA0)) | (_WIDE[third] & (third != 0xC2))
    return (last > 0x20) & ~wide


#: First bytes of the UTF-8 forms of white space beyond ASCII.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> PieceEncoder:
    return PieceEncoder(path, end_id)


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId(), 0
    coder = encoder(path, end_id)
    for batch in batches:
        for first, data, offsets in text_blocks(batch.column("text")):
            n = len(offsets) - 1
            ids, counts = coder.encode(data, offsets)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, n), pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(row, row + n)), pa.ListArray.from_arrays(ends, pa.array(ids)),
                ],
                ["doc_id", "part", "row", "ids"],
            )
            row += n


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Encode the whole ``text`` of every row and write ``(doc_id, part, row, ids)`` as ORC below ``path``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    coded = ordered.mapInArrow(
        partial(_encode, path=tokenizer_path, end_id=end_id), "doc_id long, part int, row long, ids array<int>"
    )
    coded.write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of token files; filters on ``doc_id`` reach the row index and the Bloom filters."""
    return spark.read.schema("doc_id long, part int, row long, ids array<int>").orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        ends = ids.offsets.to_numpy()
        flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("part"), batch.column("row"),
                pa.array(np.diff(ends).astype(np.int64)),
                pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64()),
            ],
            ["doc_id", "part", "row", "n_tokens", "ids_crc32"],
        )


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files. ``start`` adds the totals of the
    earlier parts to a running sum inside the part."""
    rows = read_token_files(spark, path).mapInArrow(_digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(parts, F.col("part") == F.col("_part")).select(
        "doc_id", (F.col("_base") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    spark = docs.sparkSession
    path = shared_path(spark, "token-files")
    write_token_files(docs, path, tokenizer_path, end_id)
    return token_file_digest(spark, path)
