import random
import unicodedata
from collections import Counter
from urllib.parse import urlsplit

from pagestrata.llm import site_lines as L

SCHEMA = "evidence_block_id string, text string, url string, key int, site string"


def brute(rows, share=0.05, least=5):
    seen = {}
    for i, t, u, *_ in rows:
        host = (urlsplit(u).hostname or "").removeprefix("www.") if u else ""
        if i and t is not None and host:
            seen[i] = (host, t)
    total, df, lines = Counter(h for h, _ in seen.values()), Counter(), []
    for i, (h, t) in seen.items():
        keys = set()
        for n, line in enumerate(t.split("\n"), 1):
            k = "".join(c for c in unicodedata.normalize("NFC", line).lower() if c.isalpha())
            if k:
                lines.append((i, n, h, k))
                keys.add(k)
        df.update((h, k) for k in keys)
    return {(i, n) for i, n, h, k in lines if df[h, k] >= least and df[h, k] >= share * total[h]}


def rows(n=300, seed=2):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        host = rng.choice(["a.example", "A.example:443", "www.a.example", "b.test"])
        lines = [f"Unique line {rng.random()} number {rng.choice('abcdef') * rng.randint(1, 5)}{k}" + "qwertz"[k % 6] * (k % 23) for _ in range(3)]
        if rng.random() < 0.4:
            lines.insert(rng.randint(0, 3), f"Share this page {rng.randint(1, 99)}!")
        if rng.random() < 0.06:
            lines.append("rare   NOTICE")
        out.append((f"e{k}", "\n".join(lines), f"https://{host}/u/{k}", 1, "x"))
    return out


def test_against_counting(spark):
    data = rows()
    got = {(r.id, r.line_no) for r in L.repeated_lines(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == brute(data) and got


def test_odd_rows(spark):
    data = [(f"e{k}", "Same line\n\n12 34\nÜber uns", "https://h.example/1", 1, "x") for k in range(6)]
    data += [data[0], ("n", None, "https://h.example", 1, "x"), ("u", "Same line", None, 1, "x"), ("v", "Same line", "no url", 1, "x"), (None, "Same line", "https://h.example", 1, "x"), ("long", "word\n" * 30_000, "https://h.example", 1, "x")]
    df = spark.createDataFrame(data, SCHEMA)
    assert {(r.id, r.line_no) for r in L.repeated_lines(df).collect()} == {(f"e{k}", n) for k in range(6) for n in (1, 4)}
    clean = {r.id: (r.text, r.n_removed) for r in L.cleaned(df).collect()}
    assert clean["e3"] == ("\n12 34", 2) and clean["u"] == ("Same line", 0) and clean["n"] == (None, 0)
    assert L.repeated_lines(df.limit(0)).count() == 0


def test_variants_of_a_line_form_one_cluster(spark):
    data = [(f"e{k}", f"Written by Anna{chr(97 + k)} Smith for the desk of this journal\nunique {'xyz' * k}", "https://h.example/1", 1, "x") for k in range(12)]
    df = spark.createDataFrame(data, SCHEMA)
    assert {r.id for r in L.repeated_lines(df, exact=False).where("line_no = 1").collect()} == {f"e{k}" for k in range(12)}
    assert L.repeated_lines(df).count() == 0


def test_a_document_counts_once_in_a_cluster(spark):
    verse = "we carry the long blue lantern over the quiet hill and sing about the {} until the morning"
    data = [("e0", "\n".join(verse.format(w) for w in ("ox", "cat", "dog", "hen", "fox", "owl")), "https://h.example/0", 1, "x")]
    data += [(f"e{k}", f"{'abcdefghijkl'[k] * 9} stands alone", f"https://h.example/{k}", 1, "x") for k in range(1, 12)]
    df = spark.createDataFrame(data, SCHEMA)
    assert L.repeated_lines(df, exact=False).count() == 0
    assert {r.n_removed for r in L.cleaned(df).collect()} == {0}


def test_variants_are_joined_across_buckets(spark):
    words = "carry lantern quiet morning garden winter silver harbour letter window candle village bridge forest market".split()
    data = []
    for k in range(12):  # a chain: each line differs from the next by one word
        line = [w if j >= k else w[::-1] for j, w in enumerate(words)]
        data.append((f"e{k}", "we " + " ".join(line), f"https://h.example/{k}", 1, "x"))
    data += [(f"f{k}", "other text " + "qwxz"[k % 4] * (k + 2), f"https://h.example/f{k}", 1, "x") for k in range(4)]
    df = spark.createDataFrame(data, SCHEMA)
    assert {r.id for r in L.repeated_lines(df, exact=False).where("id like 'e%'").collect()} == {f"e{k}" for k in range(12)}


def test_what_is_masked():
    assert L.masked("Written by Anna Smith on 12 March 2020") == L.masked("Written by Bob A. Jones on 3 May 2021") == "writtenbyon"
    assert L.masked("Der Bericht über die Lage in der Stadt") == "derberichtüberdielageinderstadt"
    assert L.masked("关于 我们的新产品介绍") == "关于我们的新产品介绍" != L.masked("关于 昨天的天气情况")
    assert L.masked("Anna Smith") == "annasmith" and L.masked("12 – 34") == ""


def test_other_lines_stay(spark):
    texts = ["Der {} liegt ruhig neben dem {} und wartet auf den Abend", "关于{}的新消息和{}的旧消息"]
    words = "Hafen Garten Brunnen Turm Wagen Spiegel Kasten Laden Ofen Teppich Schrank Balkon".split()
    data = [(f"e{k}", texts[k % 2].format(words[k] if k % 2 == 0 else "甲乙丙丁戊己庚辛壬癸子丑"[k] * 5, words[-k - 1] if k % 2 == 0 else "寅卯辰巳午未申酉戌亥天地"[k] * 5), "https://h.example/1", 1, "x") for k in range(12)]
    assert L.repeated_lines(spark.createDataFrame(data, SCHEMA), exact=False).count() == 0


def test_leaders_over_blocks():
    masks = ["thesamelineofthisjournal" + c for c in "abcdefgh"] + ["quiteanothertextstandshere" + c for c in "xy"]
    sketch = next(L._sketches(iter([L.pa.RecordBatch.from_arrays([L.pa.array(range(10)), L.pa.array(masks)], names=["node", "mask"])])))
    cols = [L.np.ones(10, L.np.int64)] + [c.to_numpy() for c in sketch.columns]
    whole = L.Leaders()(cols)
    parts, blocks = [], L.Leaders()
    for lo in range(0, 10, 3):
        parts.append(blocks([c[lo : lo + 3] for c in cols]))
    for links in (whole, [L.np.concatenate(x) for x in zip(*parts, strict=True)]):
        assert sorted(zip(*(x.tolist() for x in links), strict=True)) == [(k, 0) for k in range(1, 8)] + [(9, 8)]
    pairs = L.pa.RecordBatch.from_arrays([L.pa.array([1, 2]), L.pa.array([8, 9]), L.pa.array([masks[0], masks[0]]), L.pa.array([masks[1], masks[8]])], names=list("abcd"))
    assert [r["id_a"] for r in next(L._alike(iter([pairs]))).to_pylist()] == [1]


def test_shared_buckets_over_batches():
    rows = [(1, 1), (2, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 2), (4, 3), (5, 9)]
    for size in (1, 2, 3, 9):
        batches = [L.pa.RecordBatch.from_arrays([L.pa.array(x, L.pa.int64()) for x in zip(*rows[lo : lo + size], strict=True)], names=["bucket", "node"]) for lo in range(0, 9, size)]
        got = [tuple(r.values()) for b in L._shared(iter(batches)) for r in b.to_pylist()]
        assert got == [(3, 1), (3, 2), (4, 1), (4, 2), (4, 3)], (size, got)
