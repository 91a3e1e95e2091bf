import random
import zlib

from tests.llm.helpers import documents, empty, prose
from threatlake.llm import subword_quality

LABELS = "doc_id long, quality int, toxic int, text string, score double"


def junk(seed):
    r = random.Random(seed)
    w = prose(seed, 20).split()
    return " ".join(x + r.choice(["***", "###"]) for x in w) if seed % 2 else " ".join(x for x in w for _ in range(6))


def test_held_out_accuracy_and_columns(spark):
    rows = [(i, junk(i) if i % 3 == 0 else prose(i, 60)) for i in range(600)]
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, prose(1, 20000)), (5, prose(5, 60)), (None, prose(3, 9))]
    labels = [(i, int(i % 3 > 0), 0, "x", 0.0) for i in range(600)]
    labels += [(700, 1, 0, "", 0.0), (None, 1, 0, "", 0.0), (1002, None, 0, "", 0.0), (6, 0, 0, "", 0.0), (6, 1, 0, "", 0.0)]
    docs, table = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    got = subword_quality.classify(docs, table).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 600 and r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert len(held) > 80 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    assert len({r.score for r in got if r.doc_id in (1000, 1001, 1002)}) == 1
    kept = subword_quality.accepted(docs, table)
    assert kept.columns == docs.columns
    want = sorted(str(r.doc_id) for r in got if r.predicted)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_no_labels_and_no_documents(spark):
    none = spark.createDataFrame([], LABELS)
    assert [r.score for r in subword_quality.classify(documents(spark, [(1, "a"), (2, None)]), none).collect()] == [0.5, 0.5]
    assert subword_quality.classify(empty(spark), none).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = documents(spark, [(i, junk(i) if i % 3 == 0 else prose(i, 40)) for i in range(200)])
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    label = lambda turn: spark.createDataFrame([(i, int(i % 3 > 0) ^ (turn and held(i)), 0, "", 0.0) for i in range(200)], LABELS)
    scores = [{r.doc_id: r.score for r in subword_quality.classify(docs, label(t)).collect()} for t in (False, True)]
    assert scores[0] == scores[1]
