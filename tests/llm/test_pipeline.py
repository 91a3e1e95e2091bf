import corpus_pipeline
from tests.llm import test_decontaminate, test_jaccard, test_quality
from tests.llm.helpers import prose
from threatlake.llm import token_files


def test_stages_against_brute_force(spark, tmp_path):
    items = [(1, prose(700, 30)), (2, prose(701, 40))]
    rows = [(i, test_quality.junk(i) if i % 3 == 0 else prose(i, 60)) for i in range(240)]
    rows += [(300 + i, prose(1000 + i // 4, 50)) for i in range(40)] + [(400, f"{prose(3, 20)} {items[0][1]} {prose(4, 20)}"), (401, None)]
    sf = str(tmp_path)
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        path = f"{sf}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    good = [(d, t) for d, t in rows if d >= 240 or d % 3]
    assert [x for x in seen["quality"] if x[1]] == sorted(x for x in good if x[1])
    groups = {d: c for d, _, c in test_jaccard.brute(seen["quality"])}
    assert seen["near_duplicates"] == [x for x in seen["quality"] if groups[x[0]] == x[0]]
    assert seen["decontamination"] == [x for x in seen["near_duplicates"] if not test_decontaminate.brute(x[1], items)]
    assert {d for d, _ in seen["mixing"]} <= {d for d, _ in seen["decontamination"]} and len(seen["mixing"]) > 100

    final = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in final) == [d for d, _ in seen["mixing"]]
    import public_tokenizers

    coder = token_files.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"), 0)
    lengths = [len(coder.library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in seen["mixing"]]
    assert sorted(r.n_tokens for r in final) == sorted(lengths)
    assert max(r.start + r.n_tokens for r in final) == sum(lengths)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _row long, _copies string, kept long, _copy int, size long"


def test_rows_that_repeat_an_id_are_judged_each(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (2, a), (3, prose(3, 60)), (None, b), (None, prose(4, 60)), (5, None), (6, ""), (3, prose(3, 60))]
    docs = spark.createDataFrame([(d, t, "en", "s", 0, 7, "x", 8, 9, 10) for d, t in rows], SCHEMA).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    texts = [t for _, t in got if t]
    assert sorted(texts) == sorted({t for _, t in rows if t}) and (2, a) in got  # the smallest id that no other row has
    assert {d for d, t in got if not t} == {5, 6}


def test_mixing_counts_copies_by_row(spark):
    rows = [(None, prose(i, 20 + i), f"s{i % 2}") for i in range(40)] + [(7, prose(100 + i, 30), "s0") for i in range(10)]
    docs = spark.createDataFrame([(d, t, "en", s, 0, 7, "x", 8, 9, 10) for d, t, s in rows], SCHEMA).repartition(3)
    mixed = corpus_pipeline.mixing(spark, docs, "")
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[r.text] = counts.get(r.text, 0) + 1
    words = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("s0", "s1")}
    total = sum(words.values())
    taken = {s: sum(counts.get(t, 0) * len(t.split()) for _, t, x in rows if x == s) for s in words}
    assert abs(taken["s0"] - total * 5 / 7) < 60 and abs(taken["s1"] - total * 2 / 7) < 60
    assert max(counts.values()) <= 3


def test_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0
    assert corpus_pipeline.mixing(spark, none, "").count() == 0
    assert corpus_pipeline.token_output(spark, none, "").count() == 0
    spark.createDataFrame([(1, "some text of an item that is long enough")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.decontamination(spark, none, str(tmp_path)).count() == 0
