import hashlib
import random
from collections import Counter

import pytest

from tests.llm.helpers import documents, empty, prose
from threatlake.llm import repeats


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [3, 8])
def test_intervals_find_all_repeated_windows(length):
    r = random.Random(length)
    for _ in range(60):
        pieces = [bytes(r.choice(b"ab" if r.random() < 0.5 else b"abcdefgh") for _ in range(r.randint(length, 30))) for _ in range(r.randint(1, 8))]
        pieces += [p[: r.randint(length, len(p))] for p in pieces if r.random() < 0.3]
        count = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        got = repeats.repeated_windows(pieces, length)
        assert [g.tolist() for g in got] == [[count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in pieces]


def corpus():
    passage, other = prose(1, 90), prose(2, 80)
    near = prose(3, 200).split()
    rows = [(i, f"{prose(100 + i, 30)} {passage} {prose(200 + i, 30)}") for i in range(12)]
    rows += [(20 + i, " ".join(near[: 40 + i] + [f"x{i}"] + near[41 + i :])) for i in range(6)]
    rows += [(30, other), (31, other), (32, other + " and " + other), (33, passage[:399]), (34, passage[5:405]), (35, None), (36, "")]
    rows += [(37, "De " * 400), (38, "la " * 134), (39, "é" * 300), (40, "x" + "é" * 200), (41, prose(9, 3000)), (41, prose(9, 3000)), (None, other)]
    return rows


@pytest.mark.parametrize("crowd", [repeats.CROWD, 3])
def test_equals_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    rows = [r for r in corpus() if r[0] is not None]
    got = sorted(tuple(r) for r in repeats.remove_repeats(documents(spark, rows)).collect())
    assert got == brute(rows, 400)


def test_null_ids_and_no_documents(spark):
    rows = [(None, prose(4, 100)), (1, prose(4, 100)), (None, None)]
    got = {(r[0], r[1], r[2]) for r in repeats.remove_repeats(documents(spark, rows)).collect()}
    n = len(prose(4, 100))
    assert got == {(None, n, n), (1, n, n), (None, 0, 0)}
    assert repeats.remove_repeats(empty(spark)).count() == 0
