import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, prose
from threatlake.llm import personal_data as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = {}
    for kind, pattern in PLAIN.items():
        out[kind] = []
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out[kind].append(f"{kind}:{m.start()}:{m.end()}")
    joined = ",".join(x for k in PLAIN for x in out[k])
    return (*(len(out[k]) for k in PLAIN), hashlib.sha256(joined.encode()).hexdigest(), joined, 0)


def card(r, digits=16):
    d = "".join(r.choice("0123456789") for _ in range(digits - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def personal(r):
    phone = f"+{r.randint(1, 99)} ({r.randint(200, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}"
    return [f"{prose(r.random(), 1)}.{r.randint(1, 99)}@{prose(r.random(), 1)}.com", ".".join(str(r.randint(0, 255)) for _ in range(4)), card(r), phone]


AWKWARD = [
    None, "", " ", "a@b.c", "a@b", "x@y.z_d@e.f+g@h.i.", "@a.b a@.b a@b..c", "1.2.3.4.5.6.7.8 1.2.3 256.1.1.1 001.002.003.0255 0000000000000000000000001.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 4111111111111112", "4111  111111111111", "+1 (663) 555-6869. +12345678901234567 +1 2 +49.30/1234567 (+44) 20 7946 0958",
    "++49 30 123456 +49 30 12 34 56 - ", "漢🙂 é mail é@x.de 🙂a@b.co🙂 ١٢٣ 10.0.0.1🙂", "1" * 40, "+" * 50 + "1" * 12, "a@b.c" * 30, "1.2.3.4\n" * 40, "12 34 56 " * 60,
    "%a+b-c@d-e.f-g", "4111111111111111 4111111111111111", "+1-----2", "dot 1dot2dot3dot4 1 dot 2 dot 3 dot 4",
]


def test_base_spans_equal_the_plain_rules(spark):
    r = random.Random(3)
    texts = AWKWARD + ["".join(r.choice("0123456789.. -+()@ab\né🙂") for _ in range(r.randint(1, 120))) for _ in range(400)]
    texts += ["".join(r.choice("0123456789. -+@a") for _ in range(5000)) for _ in range(3)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "a@b.c"), (None, "a@b.c")]
    got = P.personal_data(documents(spark, rows), P.SpanModel()).collect()
    want = [(d if d is not None else -1, *brute(t)) for d, t in rows]
    assert sorted((x[0] if x[0] is not None else -1, *x[1:]) for x in got) == sorted(want)


def test_long_runs_take_linear_time(spark):
    n = 200_000
    texts = ["1" * n, "a" * n, "1." * n, "a@" * n, "1 " * n, "+1(" * n, "a.b@c." * n, "1dot" * n, " at a" * n, "4111111111111111 " * 3000]
    began = time.time()
    got = {x.doc_id: x for x in P.personal_data(documents(spark, list(enumerate(texts))), P.SpanModel()).collect()}
    assert time.time() - began < 90
    assert got[9].n_card == 0 and got[2].n_ip == n // 4


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(8)
    rows = []
    for i in range(500):
        words = prose(i, 60).split()
        for x in personal(r):
            words.insert(r.randint(0, len(words)), x)
        for _ in range(4):
            words.insert(r.randint(0, len(words)), r.choice([str(r.randint(1, 10**6)), f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}"]))
        rows.append((i, " ".join(words)))
    return P.fit(documents(spark, rows))


def test_trees_add_what_is_written_otherwise(spark, model):
    assert all(0.5 <= t < 1 for t in model.thresholds.values())
    r = random.Random(9)
    rows, ways = [], 0
    for i in range(60):
        mail, ip, number, phone = personal(r)
        words = prose(1000 + i, 40).split()
        name, host = mail.split("@")
        other = [f"{name} [at] {host}", ip.replace(".", "[.]"), ".".join(number[j : j + 4] for j in range(0, 16, 4)), phone[1:]]
        for j, x in enumerate(other):
            words.insert(10 * j, x)
        rows.append((i, " ".join(words)))
        ways += len(other)
    found = P.personal_data(documents(spark, rows), model).collect()
    assert sum(x.n_added for x in found) >= 0.85 * ways
    assert sum(x.n_email + x.n_ip + x.n_card + x.n_phone for x in found) == 0
    texts = dict(rows)
    for x in found:
        for s in x.spans.split(","):
            kind, a, b = s.split(":")
            assert (a, b) != ("", "") and texts[x.doc_id][int(a) : int(b)].strip() == texts[x.doc_id][int(a) : int(b)]


def test_clean_texts_are_left_alone(spark, model):
    r = random.Random(10)
    texts = [prose(5000 + i, 50) + f" {r.randint(1, 10**6)} on {r.randint(1, 28)}.{r.randint(1, 12)}.2024 look at that, room 12 14 16" for i in range(100)]
    assert P.personal_data(documents(spark, list(enumerate(texts))), model).where("spans <> ''").count() == 0


def test_base_spans_stay_and_text_is_redacted(spark, model):
    r = random.Random(11)
    mail, ip, number, phone = personal(r)
    text = f"é🙂 write to {mail} or {ip}, pay by {number} and call {phone} now, or other.name (at) host (dot) org"
    rows = [(1, text), (2, None), (3, ""), (1, text)]
    got = P.personal_data(documents(spark, rows), model).collect()
    assert sorted(x.doc_id for x in got) == [1, 1, 2, 3]
    for x in got:
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) == brute(text if x.doc_id == 1 else "")[:5]
    clean = {x.doc_id: x.text for x in P.redact(documents(spark, rows), model).collect()}
    assert clean[1].startswith("é🙂 write to [email] or [ip], pay by [card] and call [phone] now, or ") and clean[2] is None and clean[3] == ""
    assert "host (dot) org" not in clean[1]


def test_no_documents_and_nothing_to_learn(spark):
    assert P.personal_data(empty(spark)).count() == 0
    got = P.personal_data(documents(spark, [(1, "plain words"), (2, "a@b.c")])).collect()
    assert sorted((x.doc_id, x.n_email) for x in got) == [(1, 0), (2, 1)]


def test_plan_has_no_python(spark, model):
    plan = P.personal_data(documents(spark, [(1, "a@b.c")]), model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Join" not in plan


def test_running_totals(spark):
    xs = [random.Random(1).randint(0, 9) for _ in range(1000)]
    got = spark.createDataFrame([(xs,), ([],)], "xs array<int>").select(P.running(F.col("xs"), 7)).collect()
    total, want = 0, []
    for x in xs:
        total += x
        want.append(total)
    assert sorted((list(x[0]) for x in got), key=len) == [[], want]


def test_thresholds_count_every_candidate(spark):
    r = random.Random(12)
    scored = [(r.randint(0, 2), r.choice([0.4, 0.5, 0.7, 0.7001, 0.70011, 0.9, 0.95]), float(r.random() < 0.995), float(r.randint(1, 9))) for _ in range(3000)]
    scored += [(3, 0.9, 0.0, 5.0), (3, 0.8, 1.0, 4.0)]
    want = {}
    for kind in range(4):
        for p in {x[1] for x in scored if x[0] == kind and x[1] >= 0.5}:
            over = [x for x in scored if x[0] == kind and x[1] >= p]
            if sum(x[2] * x[3] for x in over) / sum(x[3] for x in over) >= P.PRECISION:
                want[kind] = min(p, want.get(kind, 2.0))
    got = P.thresholds(spark.createDataFrame(scored, "kind int, p double, label double, n double")).collect()
    assert {x.kind: x.least for x in got} == want and 3 not in want


def test_all_texts_are_learnt_from(spark):
    """One text in 3,000 tells what a rewritten address looks like; a sample of texts may miss it. Copies count once."""
    rows = [(i, f"{prose(i, 3)} {i % 7} 12 34 56 {i}") for i in range(6000)]
    texts = documents(spark, rows + [(6000, "write to a.b@c.de now"), (6001, "or x.y@z.org today")])
    learnt = P._rows(texts.select("text")).groupBy("label").agg(F.sum("n").alias("n")).collect()
    n = {x.label: x.n for x in learnt}
    again = P._rows(texts.union(texts).select("text")).groupBy("label").agg(F.sum("n").alias("n")).collect()
    assert {x.label: x.n for x in again} == n
    assert n[1.0] == 12 and n[0.0] >= 6000
