import hashlib
import random

import public_tokenizers
import pytest

from tests.llm.helpers import documents, empty, prose
from threatlake.llm import token_alignment as alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "plain words", "plain words again", "two  spaces and a\ttab \n new line", "special <|endoftext|> and <s> </s> inside", "é ü ñ 漢字 　 wide",
    "▁ a low line ▁", "it's  don't, they'LL", "a" * 700 + " b", "12345678901234567890", "🙂🙃 \u0000 nul", "   leading and trailing   ", "é ﬁ ½ Å",
    "plain words", "\r\n\r\n", "١٢٣ हिन्दी ไทย",
]


def brute(texts):
    """One token at a time, straight from the libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    left = Tokenizer.from_file(A)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=B)
    of_char = alignment.byte_characters()
    rows, holders = [], {}
    for text in texts:
        spaced = (" " + (text or "")).encode()
        a = left.encode(spaced.decode(), add_special_tokens=False)
        a_parts = [(i, bytes(of_char[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
        b_parts = []
        for i in right.encode(text or ""):
            piece = right.id_to_piece(i)
            b_parts.append((i, bytes([int(piece[3:5], 16)]) if right.is_byte(i) else piece.replace("▁", " ").encode()))
        if not text or b"".join(p for _, p in a_parts) != spaced or b"".join(p for _, p in b_parts) != spaced:
            rows.append(([], 0, 0))
            continue
        groups, x, y = [([], [])], 0, 0
        while a_parts:
            if x <= y:
                i, p = a_parts.pop(0)
                groups[-1][0].append(i)
                x += len(p)
            while y < x:
                i, p = b_parts.pop(0)
                groups[-1][1].append(i)
                y += len(p)
            if x == y and a_parts:
                groups.append(([], []))
        rows.append((groups, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups)))
        for pair in {(i, j) for g in groups for i in g[0] for j in g[1]}:
            holders[pair] = holders.get(pair, 0) + 1
    top = {}
    for (i, _), n in holders.items():
        top[i] = max(top.get(i, 0), n)
    out = []
    for groups, n_a, n_b in rows:
        links = [(i, j) for g in groups for i in g[0] for j in g[1]]
        written = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((n_a, n_b, len(groups), len(links), sum(holders[p] == top[p[0]] for p in links), sum(holders[p] for p in links), digest))
    return out


@pytest.mark.parametrize("links,pairs", [(1_000_000, 4_000_000), (3, 20)])
def test_equals_brute_force(spark, monkeypatch, links, pairs):
    monkeypatch.setattr(alignment, "LINKS", links)
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", pairs)
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choice("ab é漢\n▁.1") for _ in range(r.randint(1, 60))) for _ in range(40)] + [prose(1, 3000)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "plain words"), (None, "no id")]
    got = alignment.align(documents(spark, rows), A, B).collect()
    want = brute([t for _, t in rows])
    assert sorted(((r[0] if r[0] is not None else -1), *r[1:]) for r in got) == sorted(((i if i is not None else -1), *w) for (i, _), w in zip(rows, want))


def test_chunks_are_counted_inside_the_tasks(monkeypatch):
    """Monkeypatched sizes don't reach the workers of a session; this drives the task's function itself."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "LINKS", 3)
    monkeypatch.setattr(alignment, "CHUNK_PAIRS", 20)
    monkeypatch.setattr(alignment.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 2})()))
    texts = [t or "" for t in TEXTS]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([" " + t for t in texts])], ["doc_id", "text", "spaced"])
    pieces = [batch.slice(0, 7), batch.slice(7)]
    found = [r for b in alignment._align(iter(pieces), A, B) for r in b.to_pylist()]
    assert len({r["chunk"] for r in found}) > 1 and {r["chunk"] >> 32 for r in found} == {2}
    total = {}
    for b in alignment._unpacked(iter([pa.RecordBatch.from_pylist([r for r in found if r["pairs"] is not None])])):
        for r in b.to_pylist():
            total[r["pair"]] = total.get(r["pair"], 0) + r["docs"]
    top = {}
    for p, n in total.items():
        top[p // alignment.WIDTH] = max(top.get(p // alignment.WIDTH, 0), n)
    sums = {}
    for chunk in {r["chunk"] for r in found}:
        rows = pa.Table.from_pylist([r for r in found if r["chunk"] == chunk and r["pairs"] is None])
        pairs = [p for b in alignment._unpacked(iter([pa.RecordBatch.from_pylist([r for r in found if r["chunk"] == chunk and r["pairs"] is not None])])) for p in b.column("pair").to_pylist()]
        random.Random(1).shuffle(pairs)
        known = pa.table({"pair": pairs, "n": [total[p] for p in pairs], "best": [total[p] == top[p // alignment.WIDTH] for p in pairs]})
        for r in alignment._answer((chunk,), rows, known).to_pylist():
            sums[r["doc_id"]] = tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
    assert [sums[i] for i in range(len(texts))] == brute(texts)


def test_overlaps_are_the_union_of_both_directions():
    import numpy as np

    doc = np.array([0, 0, 1]), np.array([0, 0, 0, 1, 1])
    a, b = alignment.overlaps(doc[0], np.array([0, 4, 6]), doc[1], np.array([0, 1, 5, 6, 7]))
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 0), (0, 1), (1, 1), (1, 2), (2, 3), (2, 4)]


def test_no_documents(spark):
    assert alignment.align(empty(spark), A, B).count() == 0
