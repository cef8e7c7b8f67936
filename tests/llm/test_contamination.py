import random

import pytest

from pagestrata.llm import contamination as C
from pagestrata.llm.words import words

DOCS, ITEMS = "doc_id long, text string, id long, at int", "item_id long, text string, shingle string"


def brute(docs, items, window=12):
    out = set()
    for d, t, *_ in docs:
        w = words(t)
        for i, x, *_ in items:
            v = words(x)
            n = min(window, len(v))
            if d is not None and i is not None and n and any(w[k : k + n] == v[j : j + n] for k in range(len(w) - n + 1) for j in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def data(seed=6):
    rng = random.Random(seed)
    voc = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(voc) for _ in range(rng.choice([1, 2, 3, 5, 9, 11, 12, 13, 20, 30]))), "x") for k in range(40)]
    docs = []
    for k in range(120):
        text = [rng.choice(voc) for _ in range(rng.randint(0, 60))]
        if k % 3 == 0:
            v = words(rng.choice(items)[1])
            lo = rng.randint(0, max(0, len(v) - 11))
            at = rng.randint(0, len(text))
            text[at:at] = v[lo : lo + rng.choice([9, 11, 12, 15])]
        docs.append((k, rng.choice([", ", "\n", " "]).join(text), 1, 1))
    return docs, items


@pytest.mark.parametrize("shipped", [2_000_000, 0])
def test_against_brute_force(spark, shipped):
    docs, items = data()
    got = C.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), most_shipped=shipped)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items)


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, None, 1, 1), (2, "", 1, 1), (3, item.upper().replace(" ", ",\n"), 1, 1), (3, item, 1, 1), (None, item, 1, 1), (4, "x " * 40_000 + item, 1, 1), (5, item[:-20], 1, 1)]
    items = [(7, item, "x"), (7, item, "x"), (8, None, "x"), (9, "", "x"), (10, "??", "x"), (None, item, "x")]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert sorted(map(tuple, C.leaks(d, i).collect())) == [(3, 7), (4, 7)]
    assert C.leaks(d.limit(0), i).count() == 0 and C.leaks(d, i.limit(0)).count() == 0
    assert {(r.doc_id, r.n_items) for r in C.affected(d, i).collect()} == {(3, 1), (4, 1)}
