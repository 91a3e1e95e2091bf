"""Addresses in long and awkward texts."""

import random
import re
import time

from threatlake import fixed_values_phishing as P
from threatlake.operators import emails as M


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    return sorted((r.k, r.address.lower(), r.occurrences) for r in M.extract_emails(rows, "k", "t").collect())


def test_plain_addresses_equal_the_stated_pattern(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("aB.@@ \n,;:<\t\u00a0\u00e9\u6f22\U0001f642'x") for _ in range(r.randint(1, 60))).replace("<", "[") for _ in range(1500)]
    texts += ["@", "a@", "@a", "a@@", "@@a", "@a@b", "a@b@c@", "a@b\u200bc", "x,a@b,c@d", "a@b MAILTO:q@r", "mailto:a@b"]
    want = {}
    for k, t in enumerate(texts):
        linked = re.findall(r"(?i)mailto:([^?\s\"'<>]*)", t)
        rest = re.sub(P.EMAIL_MAILTO, " ", t.replace("\u200b", ""), flags=re.I)
        for a in [x for m in linked for x in re.split("[,;]", m) if x.strip()] + re.findall(P.EMAIL_PLAIN, rest):
            a = re.sub(r"^[.,:;]+|[.,:;!?]+\Z", "", a).lower()
            if a:
                want[k, a] = want.get((k, a), 0) + 1
    assert found(spark, texts) == sorted((k, a, n) for (k, a), n in want.items())


def test_long_words_take_linear_time(spark):
    began = time.time()
    assert found(spark, ["x" * 200_000, "y" * 200_000 + " a@b.co", "z," * 100_000]) == [(1, "a@b.co", 1)]
    assert time.time() - began < 30
