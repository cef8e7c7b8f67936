import random
from collections import Counter

import pytest

from pagestrata.llm import near_duplicates as N
from pagestrata.llm.words import words

SCHEMA = "id string, text string, doc long, n int"  # doc and n clash with names used inside


def brute(rows, least=25, similarity=0.7):
    bags = {i: Counter(words(t)) for i, t, *_ in rows if t and len(words(t)) >= least}
    ids = sorted(bags)
    out = set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = sum((bags[a] & bags[b]).values())
            if common >= similarity * (sum(bags[a].values()) + sum(bags[b].values()) - common):
                out.add((a, b))
    return out


def found(df, **how):
    return {(r.id_a, r.id_b) for r in N.similar_pairs(df, "id", "text", **how).collect()}


def corpus(seed=1, base=60, edits=4):
    rng, rows = random.Random(seed), []
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    for k in range(base):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(25, 90))]
        rows.append((f"b{k}", " ".join(text), 1, 1))
        for e in range(rng.randint(0, edits)):
            copy = text[:]
            for _ in range(rng.randint(1, max(1, len(copy) // 12))):
                at = rng.randrange(len(copy))
                rng.choice([lambda: copy.__setitem__(at, rng.choice(vocabulary)), lambda: copy.insert(at, rng.choice(vocabulary)), lambda: copy.pop(at)])()
            rng.shuffle(copy)
            rows.append((f"b{k}e{e}", " ".join(copy), 1, 1))
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_hot_shards_are_cut_and_nothing_is_lost(spark):
    rng = random.Random(3)
    head = [f"word{k}" for k in range(60)]
    rows = [(f"h{k:04}", " ".join(head[:50] + [f"tail{k}x{j}" for j in range(rng.randint(1, 2))]), 1, 1) for k in range(400)] + corpus(5, 20)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df, shard_rows=40) == brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    text = " ".join(f"a{k}" for k in range(30))
    rows = [("x", None, None, None), ("y", "", 1, 1), (None, text, 1, 1), ("short", "few words only", 1, 1), ("l1", long, 1, 1), ("l2", long + " end", 1, 1), ("t1", text, 1, 1), ("t1", text, 1, 1), ("t2", text.upper() + "!", 1, 1)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {("l1", "l2"), ("t1", "t2")}
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_classes_of_chains(spark):
    pairs = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(40)] + [("z1", "z2")], "id_a string, id_b string")
    got = {r.id: (r.class_id, r.links) for r in N.groups(pairs).collect()}
    assert got["n040"] == ("n000", 1) and got["n020"] == ("n000", 2) and got["z2"] == ("z1", 1) and len(got) == 43


@pytest.mark.parametrize("text,n", [("Ça va? 3x", 3), ("温和 ab", 3), (None, 0), ("_-_", 0)])
def test_words(text, n):
    assert len(words(text)) == n


def test_units_are_joined_by_what_they_share(spark):
    block = "array<struct<ordinal: bigint, evidence_blob_id: string>>"
    rows = [
        ("u1", "r1", "f1", [(1, "b9"), (0, "b1")]), ("u2", "r2", "f2", [(0, "b2"), (1, "b9")]), ("u3", "r3", "f2", []), ("u4", None, None, None), ("u5", "r5", "f5", [(0, "b5")]), ("u6", "r5", "f6", [(0, "b5")]), ("u7", "r7", "f7", [(0, "b1"), (1, "b8")]), ("u7", "r7", "f7", []),
    ]
    units = spark.createDataFrame(rows, f"id string, raw_fingerprint string, stable_content_fingerprint string, evidence_blocks {block}")
    long = " ".join(f"word{k}" for k in range(30))
    blobs = spark.createDataFrame([("b1", long), ("b2", long + " edited"), ("b9", " ".join(f"more{k}" for k in range(20))), ("b8", " ".join(f"else{k}" for k in range(60))), ("b5", "short"), ("b1", long)], "id string, text string")
    got = {}
    for r in N.unit_groups(units, blobs).collect():
        got.setdefault(r.class_id, set()).add(r.unit_observation_id)
    # u7 shares its first block with u1, but says something else on the whole
    assert sorted(map(sorted, got.values())) == [["u1", "u2", "u3"], ["u5", "u6"]]


def test_copies_are_one_in_the_search(spark):
    text = " ".join(f"a{k}" for k in range(30))
    rows = [(f"c{k:03}", " ".join(reversed(text.split())) if k % 2 else text, 1, 1) for k in range(200)] + [("e1", text + " edited", 1, 1), ("e2", text + " edited too", 1, 1), ("z", " ".join(f"z{k}" for k in range(30)), 1, 1), ("s", "short", 1, 1), ("s2", "short", 1, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: (r.class_id, r.links) for r in N.near_groups(df, "id", "text").collect()}
    assert got == {f"c{k:03}": ("c000", 201) for k in range(200)} | {"e1": ("c000", 201), "e2": ("c000", 201)}
    assert N.near_groups(df.limit(0), "id", "text").count() == 0


def test_no_pair_is_lost_between_070_and_080(spark):
    rng, rows, function = random.Random(7), [], ["the", "of", "and", "to", "in", "for"]
    for k in range(150):
        n = rng.randint(40, 80)
        text = [rng.choice(function) if rng.random() < 0.5 else f"longword{rng.randrange(3000)}" for _ in range(n)]
        long = [i for i, w in enumerate(text) if len(w) > 4]
        copy = text[:]
        for j, i in enumerate(rng.sample(long, min(len(long), int(n * rng.uniform(0.11, 0.175))))):  # only long words are replaced
            copy[i] = f"replaced{k}x{j}"
        rows += [(f"r{k:03}", " ".join(text), 1, 1), (f"r{k:03}c", " ".join(copy), 1, 1)]
    want = brute(rows)
    assert len(want) > 120 and found(spark.createDataFrame(rows, SCHEMA)) == want


def test_hot_shards_with_more_edits(spark):
    rng = random.Random(3)
    head = [f"word{k}" for k in range(60)]
    rows = [(f"h{k:04}", " ".join(head[:50] + [f"tail{k}x{j}" for j in range(rng.randint(1, 12))]), 1, 1) for k in range(400)] + corpus(5, 20)
    assert found(spark.createDataFrame(rows, SCHEMA), shard_rows=40) == brute(rows)
