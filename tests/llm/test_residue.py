import pytest

from pagestrata.llm import residue as R


@pytest.mark.parametrize(
    "text",
    [
        "Hello {{first_name}}, thank you for reading {{title}}.", "Dear [caption], your note on [topic] was saved as [plan].", "Price: NaN per None, offered by undefined.", "Lorem ipsum dolor sit amet consectetur elit.",
        "TODO: write the intro…", "404 Not Found. The page /a/b does not exist or was moved.", "Bitte aktivieren Sie JavaScript, um example.test anzuzeigen.", "Zugriff auf /x verweigert.", "系统维护中，本页 很快恢复。",
        "Your session on /a has expired. Sign in again to go on.", "test test test", "Loading page … if nothing happens, allow scripts.",
    ],
)
def test_residue(text):
    assert R.is_residue([R.judged(s) for s in R.sentences(text)])


@pytest.mark.parametrize(
    "text",
    [
        "The old server answered \"404 Not Found\" for years, and the garden kept a list of such pages. Between Ada and Bell the local outpost keeps letters in one harbour.",
        "A template writes {{title}} where the reader name should stand; the renderer fills it in later. What the rural quilt merges is less elastic than the festival.",
        "489 likes", "In Nor the kiln is open, yet every ferry there stores some hinge.", "",
    ],
)
def test_real_passages(text):
    assert not R.is_residue([R.judged(s) for s in R.sentences(text)])


def test_texts_and_odd_rows(spark):
    long = "The ferry waits near the harbour and nobody minds. " * 5000
    rows = [("a", "Access denied.", "k"), ("a", "Access denied.", "k"), ("b", None, "k"), ("c", "", "k"), (None, "Access denied.", "k"), ("d", long + "Access denied.", "k"), ("e", long, "k")]
    df = spark.createDataFrame(rows, "id string, text string, kinds string")
    assert [r.record_id for r in R.residue_texts(df, "id", "text").collect()] == ["a"]
    assert R.residue_texts(df.limit(0), "id", "text").count() == 0


def test_pages_lose_their_furniture_first(spark):
    menu = "<nav><ul>" + "".join(f'<li><a href="/{k}">{w}</a></li>' for k, w in enumerate(("Home", "Help", "Shop", "Topics"))) + "</ul></nav>"
    foot = "<footer><p>All rights reserved. The views on site are those of the writers.</p></footer>"
    real = lambda k: f"<main><h1>The piece number {k}</h1><p>Near stop {k} a humble insect guides the nest that nobody had listed before {'xyzabc'[k % 6]}{k}.</p></main>"
    rows = [("dom_snapshots", str(k), f"https://site.example/{k}", menu + real(k) + foot, 1) for k in range(12)]
    rows += [("dom_snapshots", "r1", "https://site.example/r1", menu + "<h1>Access denied. You do not have permission to view this page.</h1>" + foot, 1), ("dom_snapshots", "n", None, None, 1), ("dom_snapshots", "e", "", "", 1)]
    df = spark.createDataFrame(rows, "record_table string, record_id string, url string, html string, mark int")
    assert [r.record_id for r in R.residue_pages(df).collect()] == ["r1"]
    assert R.residue_pages(df.limit(0)).count() == 0


def exactly(sentence):
    return -1 if R.kind_of(sentence) else len(R.words(R._NAMED.sub(" ", sentence)))


@pytest.mark.parametrize("sentence", ["测试测试测试测试", "in this new part lorem-free dolor amet magna massa nisl nulla nunc odio orci ornare", "503 Service", "404 Seite", "abc-1" + "f" * 90, " ".join(f"x{k}" for k in range(15))])
def test_the_scan_changes_no_verdict(sentence):
    assert R.judged(sentence) == exactly(sentence)


def test_the_scan_agrees_on_all_texts():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/evidence_blobs.parquet", columns=["text"])["text"].to_pylist()
    seen = {s for t in texts if t for s in R.sentences(t)}
    assert seen and not [s for s in seen if R.judged(s) != exactly(s)]


# messages of other sites than those of the data
@pytest.mark.parametrize(
    "text",
    [
        "Oops! That page can't be found.", "Página no encontrada", "Service Unavailable", "Please turn JavaScript on and reload the page", "We are down for maintenance", "Cette page n'existe pas", "页面不存在", "The requested URL was not found on this server.",
        "Die Verbindung zum Server ist fehlgeschlagen.", "Votre session a expiré, reconnectez-vous.", "Este sitio necesita JavaScript para funcionar", "无法访问此网站", "You don't have permission to access this resource.", "Diese Seite wurde nicht gefunden", "502 Bad Gateway nginx", "Hello [[name]]",
    ],
)
def test_messages_not_in_the_data(text):
    assert R.is_residue([R.judged(s) for s in R.sentences(text)])


@pytest.mark.parametrize("text", ["The warning: do not climb", "A description of the garden without a plan", "The service in the harbour was warm and quiet, and we stayed for a second cup of tea.", "Access to the beach is by a path.", "The page turned yellow.", "这个网站的内容很丰富"])
def test_everyday_lines_are_no_messages(text):
    assert not R.is_residue([R.judged(s) for s in R.sentences(text)])


def test_a_notice_on_every_page_is_boilerplate(spark):
    notice = "<p>Please enable JavaScript to view this site.</p>"
    real = lambda k: f"<main><h1>The piece of {chr(97 + k) * 5}</h1><p>Near {chr(98 + k) * 7} a humble insect guides the nest that nobody had listed before {chr(99 + k) * 6}.</p>{notice}</main>"
    rows = [("dom_snapshots", str(k), f"https://site.example/{k}", real(k), 1) for k in range(12)]
    rows += [("dom_snapshots", "only", "https://site.example/r1", f"<main>{notice}</main>", 1), ("dom_snapshots", "other", "https://else.example/r1", f"<main>{notice}</main>", 1)]
    df = spark.createDataFrame(rows, "record_table string, record_id string, url string, html string, mark int")
    assert [r.record_id for r in R.residue_pages(df).collect()] == ["other"]
