import random

from pagestrata.llm import packing as K

SCHEMA = "doc_id long, source string, text string, plan_id int, shard int"


def packed(spark, rows, caps=(64, 256), **how):
    plans = spark.createDataFrame([(k, c, "x") for k, c in enumerate(caps)], "plan_id int, capacity_tokens long, text string")
    return K.pack(spark.createDataFrame(rows, SCHEMA), plans, **how).collect()


def documents(n=400, seed=4):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["hot", "hot", "a", "b", None]), "word " * rng.randint(1, 90) + f"n{k}", 0, 0) for k in range(n)]
    return rows + [(n + k, "hot", "a copied text of some words", 0, 0) for k in range(30)]


def test_containers(spark):
    rows = documents()
    size, text = {}, {r[0]: r[2] for r in rows}
    enc = K.encoder(K.VOCABULARY, open(K.VOCABULARY, 'rb').read())
    for plan, cap in enumerate((64, 256)):
        got = [r for r in packed(spark, rows, shard_items=150) if r.plan_id == plan]
        fill, members = {}, {}
        for r in got:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
            members.setdefault(r.container_id, []).append(r)
            size[r.doc_id, plan] = size.get((r.doc_id, plan), 0) + r.n_tokens
        assert max(fill.values()) <= cap
        assert {d for d, p in size if p == plan} == set(text)
        for d, t in text.items():
            assert size[d, plan] == len(enc.encode_ordinary(t))
        for m in members.values():  # copies never share a container
            whole = [text[r.doc_id] for r in m if r.piece is None]
            assert len(whole) == len(set(whole))
        assert all((r.piece is None) == (size[r.doc_id, plan] <= cap) for r in got)


def test_little_space_is_left(spark):
    rows = [r for r in documents(1500) if r[0] < 1500]
    got = packed(spark, rows, caps=(256,))
    assert sum(r.n_tokens for r in got) / (256 * len({r.container_id for r in got})) > 0.98


def test_odd_rows(spark):
    rows = [(1, None, None, 0, 0), (2, "s", "", 0, 0), (3, "s", "one", 0, 0), (3, "s", "one", 0, 0), (None, "s", "x", 0, 0), (4, None, "long " * 60_000, 0, 0)]
    got = packed(spark, rows, caps=(64,))
    assert {r.doc_id for r in got} == {3, 4} and sum(r.doc_id == 3 for r in got) == 1
    assert sorted(r.piece for r in got if r.doc_id == 4) == list(range(1, 1 + sum(r.doc_id == 4 for r in got)))
    assert packed(spark, []) == [] and packed(spark, rows, caps=(None, 0)) == []


def test_best_fit_takes_the_tightest():
    assert K.best_fit([7, 6, 3], [0, 0, 0], [0, 0, 0], 10, 0) == [0, 1, 0]
    assert K.best_fit([5, 5, 5], [0, 0, 0], [1, 1, 1], 10, 0) == [0, 1, 2]  # copies apart
    assert K.best_fit([6, 6, 4], [1, 2, 1], [0, 0, 0], 10, 1) == [0, 1, 1]  # another source where it costs little


def test_a_text_of_a_third_of_all_rows(spark):
    rng = random.Random(9)
    rows = [(k, "hot", "word " * rng.randint(10, 100) + f"n{k}", 0, 0) for k in range(600)] + [(600 + k, "hot", "copied " * 30, 0, 0) for k in range(300)]
    got = packed(spark, rows, caps=(128,))
    n, total = len({r.container_id for r in got}), sum(r.n_tokens for r in got)
    assert n <= 1.1 * max(300, total / 128)
    where = [r.container_id for r in got if r.doc_id >= 600]
    assert len(where) == len(set(where)) == 300


def test_plans_beyond_one_read_and_hard_sources(spark):
    rows = [(k, f"s{k % 40}", "word " * (10 + k % 30) + f"n{k}", 0, 0) for k in range(300)]
    one = sorted(map(tuple, packed(spark, rows, caps=(64, 128, 256))))
    assert sorted(map(tuple, packed(spark, rows, caps=(64, 128, 256), at_once=1))) == one
    plans = spark.createDataFrame([(1, 512)], "plan_id int, capacity_tokens long")
    df = spark.createDataFrame(rows, SCHEMA)
    soft, hard = (K.repeated_sources(K.pack(df, plans, hard=h), df).first() for h in (False, True))
    assert hard.n_repeated == 0 and hard.n_containers >= soft.n_containers
    assert K.best_fit([5, 4], [1, 1], [0, 0], 10, 0, True) == [0, 1] and K.best_fit([5, 4], [1, 1], [0, 0], 10, 0) == [0, 0]
