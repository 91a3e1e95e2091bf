import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tests.llm.helpers import documents, empty, prose
from threatlake.llm import token_counts, token_files
from threatlake.llm.common import text_blocks

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "plain words", "two  spaces and a\ttab \n new line", "special <|endoftext|> inside", "é ü ñ 漢字 　 wide space",
    "it's  don't, they'LL", prose(1, 4000), "a" * 3000 + " b", "plain words", "   leading and trailing   ",
]


def test_counts_equal_the_library_and_are_cached(spark, tmp_path):
    import sentencepiece

    docs = documents(spark, [(i, t) for i, t in enumerate(TEXTS)] + [(0, None)])
    cache = str(tmp_path / "cache")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, cache, PIECES, limit=100).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 100)
    assert token_counts.count_tokens(docs, cache, PIECES).count() == len(TEXTS) + 1
    entries = spark.read.parquet(cache)
    assert entries.count() == entries.select("digest").distinct().count() == len({t or "" for t in TEXTS})
    # another tokenizer has entries of its own
    more = token_counts.count_tokens(docs.where("doc_id = 3"), cache, BYTES).first()
    assert more.n_tokens == 2 and spark.read.parquet(cache).count() == entries.count() + 1


def test_counts_of_no_documents(spark, tmp_path):
    assert token_counts.count_tokens(empty(spark), str(tmp_path / "c"), PIECES).count() == 0


@pytest.mark.parametrize("long_piece", [token_files.LONG_PIECE, 4])
def test_pieces_give_the_ids_of_whole_texts(monkeypatch, long_piece):
    monkeypatch.setattr(token_files, "LONG_PIECE", long_piece)
    coder = token_files.PieceEncoder(BYTES, 0)
    texts = [t or "" for t in TEXTS] * 2
    parts = [coder.encode(data, offsets) for _, data, offsets in text_blocks(pa.array(texts), 5000)]
    want = [e.ids + [0] for e in coder.library.encode_batch(texts, add_special_tokens=False)]
    assert np.concatenate([p[0] for p in parts]).tolist() == [i for w in want for i in w]
    assert np.concatenate([p[1] for p in parts]).tolist() == [len(w) for w in want]


def test_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    rows = [(7 * i % 31, t) for i, t in enumerate(TEXTS)] + [(5, "twice"), (5, "twice")]
    path = str(tmp_path / "files")
    token_files.write_token_files(documents(spark, rows), path, BYTES)
    want, start = [], 0
    for doc_id, text in sorted(((d, t or "") for d, t in rows)):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_files.token_file_digest(spark, path).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    one = token_files.read_token_files(spark, path).where("doc_id = 21")
    assert one.first().ids == library.encode(dict(rows)[21] or "", add_special_tokens=False).ids + [0]
    assert "EqualTo(doc_id,21)" in one._jdf.queryExecution().executedPlan().toString()
    assert all(f.endswith(".orc") for f in os.listdir(path) if f.startswith("part-"))


def test_files_of_no_documents(spark, tmp_path):
    token_files.write_token_files(empty(spark), str(tmp_path / "f"), BYTES)
    assert token_files.token_file_digest(spark, str(tmp_path / "f")).count() == 0
