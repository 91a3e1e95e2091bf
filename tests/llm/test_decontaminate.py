from collections import Counter

import pytest

from tests.llm.helpers import documents, empty, prose
from threatlake.llm import decontaminate


def brute(text, items):
    words = (text or "").lower().split()
    held = []
    for item_id, t in items:
        item = (t or "").lower().split()
        if item_id is None or not item:
            continue
        k, m = min(5, len(item)), min(len(item), len(words))
        grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        b = grams(item)
        for at in range(len(words) - m + 1):
            a = grams(words[at : at + m])
            both = sum((a & b).values())
            if both and 4 * both >= 3 * (sum(a.values()) + sum(b.values()) - both):
                held.append(item_id)
                break
    return held


def cases():
    items = [(i, prose(500 + i, 14 + 7 * i)) for i in range(6)]
    items += [(10, prose(503, 35) + " tail of another"), (11, "three little words"), (12, None), (13, " "), (14, "one"), (None, prose(1, 20))]
    item = items[3][1].split()
    changed = item[:17] + ["other"] + item[18:]
    rows = [(i, prose(i, 60)) for i in range(10)]
    rows += [
        (20, f"{prose(50, 30)} {items[2][1].upper()}\n{prose(51, 30)}"), (21, " ".join(changed)), (22, " ".join(item[:31])), (23, " ".join(item[:20])),
        (24, "  ".join(prose(52, 9).split() + item[4:] + prose(53, 9).split())), (25, items[0][1] + " " + items[1][1]), (26, " ".join(item[::2])),
        (27, "say three little words now"), (28, None), (29, ""), (30, "one"), (31, "One two"), (32, items[4][1] * 1 + " " + prose(54, 9000)),
        (33, items[5][1]), (33, items[5][1]), (33, "another text"), (None, items[5][1]), (35, " ".join(changed[:9] + ["x"] + changed[9:])),
    ]
    return rows, items


def table(spark, items):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, words string, n int")


@pytest.mark.parametrize("broadcast_rows", [decontaminate.BROADCAST_ROWS, 0])
def test_equals_brute_force(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast_rows)
    rows, items = cases()
    docs = documents(spark, rows)
    got = decontaminate.contaminated(docs, table(spark, items)).collect()
    want = [(d, brute(t, items)) for d, t in rows]
    line = lambda d, held: (str(d), ",".join(map(str, sorted(held))), len(held), bool(held), min(held, default=None))
    assert sorted(map(str, ((str(r.doc_id), r.item_ids, r.n_items, r.contaminated, r.first_item) for r in got))) == sorted(str(line(*w)) for w in want)
    kept = decontaminate.clean(docs, table(spark, items))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, held in want if not held)


def test_missing_words_filled_up_with_one_word(spark):
    items = [(i, prose(8000 + i, 59)) for i in range(60)]
    fill = ["|", "-", "x", "end"]
    rows = [(i, " ".join([prose(9000 + i, 20), *t.split()[:52], *[fill[i % 4]] * 12])) for i, t in items]
    got = decontaminate.contaminated(documents(spark, rows), table(spark, items)).collect()
    assert {(r.doc_id, r.item_ids) for r in got} == {(i, str(i)) for i, _ in items}
    assert all(brute(t, items[i : i + 1]) == [i] for i, t in rows)


def test_no_documents_and_no_items(spark):
    rows, items = cases()
    assert decontaminate.contaminated(empty(spark), table(spark, items)).count() == 0
    none = table(spark, [(1, None)])
    assert decontaminate.contaminated(documents(spark, rows), none).where("contaminated").count() == 0
    assert decontaminate.clean(documents(spark, rows), none).count() == len(rows)


def test_a_template_of_all_items_brings_nothing_together(spark, monkeypatch):
    """Forty items begin with one prompt, as do two hundred documents; only those that hold the rest of an item meet it."""
    prompt = prose(7000, 30)
    items = [(i, f"{prompt} {prose(7100 + i, 25)}") for i in range(40)]
    rows = [(i, f"{prompt} {prose(7500 + i, 60)}") for i in range(200)] + [(1000 + i, f"{prose(i, 20)} {t} {prose(i, 9)}") for i, t in items[:5]]
    seen = []
    keep = decontaminate.stored

    def counted(df, name, *more, **named):
        out = keep(df, name, *more, **named)
        if name == "hits":
            seen.append(out.select("k1", "item_id").distinct().count())
        return out

    monkeypatch.setattr(decontaminate, "stored", counted)
    got = decontaminate.contaminated(documents(spark, rows), table(spark, items)).where("contaminated").collect()
    assert {(r.doc_id, r.item_ids) for r in got} == {(1000 + i, str(i)) for i, _ in items[:5]}
    assert sum(seen) <= 10  # of 8,200 pairs
