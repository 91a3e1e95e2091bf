import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, prose
from threatlake.llm import jaccard_join
from threatlake.llm.components import components


def sets(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    s = [(d, sets(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            both = len(x & y)
            if both and 100 * both >= 75 * len(x | y):
                a_, b_ = root(a), root(b)
                up[max(a_, b_)] = min(a_, b_)
    return sorted(((-1 if d is None else d), len(sets(t)), -1 if d is None else root(d)) for d, t in rows)


def corpus():
    r = random.Random(8)
    origin, common = prose(900, 120).split(), prose(901, 14)
    rows = [(i, prose(i, 40) + " " + common) for i in range(30)]
    for i in range(60):  # near copies of one text, some near each other and not to the first
        w = list(origin)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((100 + i, " ".join(w)))
    chain = prose(902, 100).split()
    for i in range(8):
        rows.append((200 + i, " ".join([f"c{i}{j}" for j in range(2 * i)] + chain[2 * i :])))
    rows += [(300, common), (301, common.upper()), (302, common + " x"), (303, "a b c"), (304, "A  b\nc"), (305, "a b"), (306, None), (307, ""), (308, " ")]
    rows += [(310, prose(903, 9000)), (311, prose(903, 9000) + " end"), (5, prose(5, 40) + " " + common), (None, common), (312, "É a b c d e"), (313, "é a b c d e")]
    return rows


@pytest.mark.parametrize("chunk", [jaccard_join.CHUNK_GRAMS, 300])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_GRAMS", chunk)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 5)
    rows = corpus()
    got = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == brute(rows)


def test_a_text_and_the_same_with_a_third_more_words(spark):
    rows = []
    for i in range(300):
        text, more = prose(5000 + i, 104), prose(9000 + i, 20 + i % 14)
        rows += [(2 * i, text), (2 * i + 1, f"{text} {more}" if i % 2 else f"{more} {text}")]
    got = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_a_repeated_row_links_no_half_overlapping_neighbours(spark):
    rows = []
    for i in range(40):  # half of each neighbour is in the text whose row is repeated
        w = prose(20000 + i, 120).split()
        rows += [(1000 * i + 5, " ".join(w))] * 3
        rows += [(1000 * i + k, " ".join(w[:70] + prose(30000 + 10 * i + k, 45 + k).split())) for k in (1, 2, 7, 9)]
        rows += [(1000 * i + 10 + k, " ".join(w[:62] + prose(40000 + i, 60).split()[: 52 + k])) for k in range(4)]
        rows += [(1000 * i + 3, prose(50000 + i, 60)), (1000 * i + 3, prose(60000 + i, 60)), (1000 * i + 4, prose(60000 + i, 60) + " end")]
    got = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_frequent_grams_are_bounded_over_all_chunks(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "10L AS size", "id AS doc", "CAST(NULL AS LONG) AS gram")
    row = ["CAST(NULL AS LONG) AS doc_id", "10L AS size", "CAST(NULL AS LONG) AS doc"]
    near = spark.range(5000).selectExpr(*row, "id AS gram")  # each in the copies of one chunk
    wide = spark.range(6).selectExpr(*row, "-1L AS gram")
    assert jaccard_join.frequent_grams(docs.union(near).union(wide)).tolist() == [2**64 - 1]


def test_no_documents_and_nothing_alike(spark):
    assert jaccard_join.jaccard_components(empty(spark)).count() == 0
    got = jaccard_join.jaccard_components(documents(spark, [(1, "a b"), (2, None)])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 0, 2)]


def test_components_join_earlier_ones(spark):
    path = [(i + 1, i) for i in range(40)]
    edges = lambda e: spark.createDataFrame(e, "a long, b long")
    labels = components(edges(path[:15] + [(90, 91)]))
    labels = components(edges(path[15:] + [(95, 91), (3, 3)]), labels)
    assert {r.node: r.component for r in labels.collect()} == {i: 0 for i in range(41)} | {90: 90, 91: 90, 95: 90}


def test_long_words_that_a_polynomial_confuses(spark):
    """Words in Thue-Morse order and their complements have one polynomial sum modulo 2**64, whatever the base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} p q r s"), (2, f"{other} p q r s"), (3, f"{word} p q r s")]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_grams_of_the_same_holders_are_one_with_a_weight(spark):
    """A passage of 200 n-grams in 30 texts is 30 rows, not 6000; another document at one of them keeps that apart."""
    met = spark.range(200).crossJoin(spark.range(30).withColumnRenamed("id", "doc")).withColumnRenamed("id", "gram")
    more = spark.createDataFrame([(7, 90), (500, 91)], "gram long, doc long")
    once = jaccard_join.merged(met.union(more))
    got = sorted((r.gram, r.weight, r.n) for r in once.groupBy("gram", "weight").agg(F.count("*").alias("n")).collect())
    assert got == [(0, 199, 30), (7, 1, 31)]
    assert once.count() == 61 and jaccard_join.merged(once).agg(F.sum("weight")).first()[0] == 199 * 30 + 31


def test_documents_skip_the_grams_with_most_holders(spark):
    """A set of 100 n-grams has 35 leading ones and shares 10 of them at least: 9 that all hold are no place to look for others."""
    rows = [(g, d) for d in range(50) for g in range(9)] + [(100 + d // 2, d) for d in range(50)]
    met = spark.createDataFrame(rows, "gram long, doc long").selectExpr("*", "1L weight", "100L size", "1L end", "doc label")
    got = {(r.gram, r.doc): (r._probe, r._skip) for r in jaccard_join.probes(met, 3, 4).collect()}
    assert got == {(g, d): (g >= 100, 9) for g, d in rows}


def test_families_that_share_a_frequent_passage_without_being_similar(spark):
    r, rows = random.Random(5), []
    passage, other = prose(70000, 120).split(), prose(70001, 90).split()
    for i in range(90):  # about as much of their own as the bound allows, in sets of all lengths
        base = (passage, other, passage + other)[i % 3]
        w = base + prose(71000 + i // 2, 80).split()[: r.randint(0, len(base) // 3)]
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(documents(spark, rows)).collect()
    assert sorted(map(tuple, got)) == brute(rows)
