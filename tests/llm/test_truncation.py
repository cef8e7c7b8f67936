from pagestrata.llm import truncation as U

SCHEMA = "doc_id long, source string, text string, chars int, g string"
S = ["The harbour keeps a lantern beside the quiet mill.", "Nobody expected that the ribbon measures the valley.", "When the kiln opens, readers wait near the yard.", "Older drafts say the ferry crosses the inlet twice."]


def cut(spark, rows):
    return {r.doc_id for r in U.cut_documents(spark.createDataFrame(rows, SCHEMA)).collect()}


def base():
    return [(k, "s", f"The quiet mill of Nor{k}\n\n" + " ".join(S[(k + j) % 4] for j in range(4)), 0, "") for k in range(30)]


def test_kinds_of_ends(spark):
    text = " ".join(S)
    whole = [text + " We will see…", text + "\n\n- The valley\n- The quiet mill", text + "\n```\nopen x\n```", text + "\n\n-- Desk", text + "\nhttps://a.example/more/1", text + " (So it stays.)", text + " 🙂", "The quiet mill of Norburg"]
    broken = [text + " The harbour keeps a", text + " The harbour kee", text + " When the kiln opens, readers wa…", text + " Older drafts say the […]", text + " Older drafts say the fer...", text + " Nobody expect&am", text + " Nobody expect�", "Nobody expected that the"]
    rows = base() + [(100 + k, "s", t, 0, "") for k, t in enumerate(whole)] + [(200 + k, "s", t, 0, "") for k, t in enumerate(broken)] + [(300 + k, "s", S[k % 4] + f" Again {k}. We will see…", 0, "") for k in range(6)]
    assert cut(spark, rows) == {200 + k for k in range(len(broken))}


def test_odd_rows_and_rates(spark):
    rows = base() + [(50, None, None, 0, ""), (51, "s", "", 0, ""), (52, "s", "  \n", 0, ""), (53, None, S[0] + " The harbour kee", 0, ""), (54, "t", S[0] + " The harbour kee", 0, ""), (55, "t", (" ".join(S) + " ") * 3000, 0, "")]
    assert cut(spark, rows) == {53, 54}
    rates = {r.source: (r.n_documents, r.n_cut) for r in U.cut_rates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert rates == {"s": (30, 0), None: (1, 1), "t": (2, 1)}
    assert cut(spark, []) == set()
