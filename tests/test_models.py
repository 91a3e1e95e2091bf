"""Trained models against their tables of weights and nodes."""

import random

from pyspark.sql import functions as F

from threatlake import fixed_values_phishing as P
from threatlake.operators import ml


def labelled(spark, n=400):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        bad = i % 3 == 0
        text = [r.choice(words) for _ in range(30)] + ([r.choice(["verify", "password", "Suspended"])] if bad else [r.choice(["meeting", "lunch"])])
        r.shuffle(text)
        rows.append((i, " ".join(text), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_text_model_equals_its_term_weights(spark):
    data = labelled(spark).cache()
    model = ml.fit_text_model(data.where("doc_id % 5 <> 0"))
    held = data.where("doc_id % 5 = 0")
    assert ml.ranking(model, held) > 0.95
    report = {r["class"]: r for r in ml.text_report(model, held, threshold=0.5).collect()}
    assert report[0.0].support + report[1.0].support == 80 and report[1.0].recall > 0.8
    texts = held.select("doc_id", "text").union(spark.createDataFrame([(1000, None), (1001, ""), (1002, "unseen words only")], "doc_id long, text string"))
    whole = {r.doc_id: r.probability for r in model.probability(texts).collect()}
    terms = {r.doc_id: r.probability for r in model.probability_by_terms(texts, "doc_id").collect()}
    assert whole.keys() == terms.keys() and all(abs(whole[k] - terms[k]) < 1e-9 for k in whole)
    assert model.term_weights(spark).count() <= 1 << 16


def test_url_model_equals_its_nodes(spark):
    r = random.Random(5)
    rows = [tuple(float(r.randint(0, 9)) for _ in P.FEATURE_ORDER) for _ in range(400)]
    data = spark.createDataFrame([(*x, int(x[0] + x[3] > 9)) for x in rows], ", ".join(f"{c} double" for c in P.FEATURE_ORDER) + ", label int")
    model, report = ml.fit_url_model(data, trees=12)
    found = {x["class"]: x for x in report.collect()}
    assert set(found) == {0.0, 1.0} and found[1.0].precision > 0.8
    both = model.transform(ml.score_url(model, ml.feature_vector(data)).select("features", "probability", "prediction").withColumnsRenamed({"probability": "p", "prediction": "q"}))
    assert both.where("prediction <> q").count() == 0
    from pyspark.ml.functions import vector_to_array

    assert both.where(F.abs(vector_to_array("probability")[1] - F.col("p")) > 1e-9).count() == 0
