"""Style of messages."""

import random

from pyspark.sql import functions as F

from threatlake.operators import text as T


def test_letters_and_marks_are_counted_without_a_string_for_each(spark):
    r = random.Random(6)
    texts = ["".join(r.choice("aABCDZz! 1\u00c9\U0001f642\n") for _ in range(r.randint(0, 120))) for _ in range(400)] + ["", "!!", "!!!", "A" * 30, "A" * 29]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = rows.select("t", F.transform(T.style_signals(F.col("t")), lambda s: s["id"]).alias("ids"))
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    for x in out.collect():
        letters = sum(c.isascii() and c.isalpha() for c in x.t)
        want = ["shouting"] if letters >= 30 and sum("A" <= c <= "Z" for c in x.t) / letters > 0.6 else []
        assert x.ids == want + (["exclamation-spam"] if x.t.count("!") >= 3 else [])
