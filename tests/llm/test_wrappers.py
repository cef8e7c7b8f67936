import random

from pagestrata.functions.html import blocks
from pagestrata.llm import wrappers as W

MENU = '<div><ul><li><a href="/1">Home</a></li><li><a href="/2">Help</a></li><li><a href="/3">Shop</a></li></ul></div>'
FOOT = "<section><p>All rights reserved. The views on Site are those of the writers.</p></section>"
WORDS = "ferry harbour kiln lantern mosaic nest orchard pipeline quilt ribbon saddle tunnel umbrella valley wagon yard".split()


def name(k):
    rng = random.Random(k)
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(9))


def sentence(k):
    return f"The {WORDS[k % 16]} of {name(k)} keeps a {WORDS[k * 5 % 16]} for the {name(k + 4001)} since spring."


def page(k):
    teasers = "<div><h4>More from Site</h4>" + "".join(f'<h4><a href="/p/{k}{j}">{sentence(900 + k * 3 + j)}</a></h4><p>{sentence(500 + k * 3 + j)}</p>' for j in range(3)) + "</div>"
    piece = f"<main><p>By the desk of Site, {k} May 2020</p><h1>Title {name(7000 + k)} here</h1><p>{sentence(k)}<p>{sentence(100 + k)}<ul><li>{sentence(200 + k)}<li><a href='/w/{k}'>{sentence(300 + k)}</a></ul><!-- <p>no</p> --></main>"
    return MENU + (teasers if k % 2 else "") + piece + FOOT


def rows(n=20):
    return [("projector_pages", str(k), f"https://site.example/a/{k}", page(k), 1) for k in range(n)]


SCHEMA = "record_table string, record_id string, url string, html string, lang int"


def test_piece_is_found(spark):
    got = {}
    for r in W.main_content(spark.createDataFrame(rows(), SCHEMA)).collect():
        got.setdefault(r.record_id, set()).add(r.block_no)
    for k in range(20):
        want = {b.no for b in blocks(page(k))[0] if any(str(x) in b.text for x in (sentence(k), sentence(100 + k), sentence(200 + k), sentence(300 + k))) or b.text.startswith("Title")}
        assert got[str(k)] == want


def test_odd_rows(spark):
    data = rows() + [rows()[0], ("x", None, "u", page(1), 1), ("x", "n", None, None, 1), ("x", "e", "", "", 1), ("x", "t", "::", "no tags at all", 1), ("x", "long", "https://o.example/", "<p>" + sentence(3) * 5000 + "</p>", 1)]
    got = [(r.record_table, r.record_id, r.block_no) for r in W.main_content(spark.createDataFrame(data, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and ("x", "long", 1) in got and not [g for g in got if g[1] in (None, "n", "e", "t")]
    assert W.main_content(spark.createDataFrame([], SCHEMA)).count() == 0


def test_block_numbers_skip_comments_and_scripts():
    got, _ = blocks("<script>'<p>'</script><P>a<!-- <p> --><b>b</b><DIV><li>c<li>d</DIV><td>e</td>")
    assert [(b.no, b.tag, b.text) for b in got] == [(1, "p", "ab"), (3, "li", "c"), (4, "li", "d"), (5, "td", "e")]


def test_folding_resolves_mismatches():
    w = W.Wrapper()
    node = lambda key, units=0, linked=0: (key, 1, units, units, units, linked)
    for tokens in ([node(1), node(2), node(4, 3, 3)], [node(1), node(3, 2, 0), node(4, 5, 4)], [node(1), node(3, 4, 0), node(2), node(4, 2, 1)]):
        w.fold(1, tokens)
    assert [n[0] for n in w.nodes] == [1, 3, 2, 4] and w.pages == 3
    kind = {n[0]: W.kind_of(w.pages, *n[1:]) for n in w.nodes}
    assert kind == {1: W.FIXED, 2: W.OPTIONAL, 3: W.OPTIONAL, 4: W.REPEATED}
    w.fold(1, [node(4), node(1)])  # one of the two has moved and gets a place of its own
    assert len(w.nodes) == 5 and sum(n[1] for n in w.nodes if n[0] == 1) == 4
    for _ in range(50):
        w.fold(1, [node(k) for k in random.sample([1, 2, 3, 4], 4)])
    assert all(len(p) <= W.PLACES for p in w.places.values())


def test_shards_and_joined_templates_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame(rows(40), SCHEMA)
    want = sorted(map(tuple, W.main_content(df).collect()))
    assert sorted(map(tuple, W.main_content(df, most=0).collect())) == want
    monkeypatch.setattr(W, "SHARD", 3)
    monkeypatch.setattr(W, "FAN", 2)
    assert sorted(map(tuple, W.main_content(df).collect())) == want


def test_expressions(spark):
    got = W.expressions(W.inferred(W.outlined(spark.createDataFrame(rows(40), SCHEMA)))).collect()
    assert [(r.host, r.n_pages, r.n_repeated) for r in got] == [("site.example", 40, 1)] and "(t (link s?)+)?" in got[0].expression
