from collections import Counter

import pytest

from pagestrata.llm import personal as P

NAMES = ["Ada", "Colin", "Rose", "Hope", "Jürgen", "Mark"]
TEXTS = [
    ("Applicant Colin Narfil, identity no. 977-06-0642, 32 Jorla Rd, Pelzen.", "id_number name address"),
    ("I met Rose Keston and Dr. Ada B. Torrin at the jetty last spring.", "name name"),
    ("Send the scans to mara+notes@brima.example, with rose [at] ost [dot] test in copy.", "email email"),
    ("Contact: hope1970 at narne dot invalid. My number is 202-555-0179, ask for Hope Calnor.", "email phone name"),
    ("Rückruf bitte unter (030) 23125 479. Jürgen Mirlan wohnt Britimstraße 78, 00307 Calfi.", "phone name address"),
    ("El documento 83.923.512-P quedó a la vista. Cartas a Calle Pelbla, 56, 00109 Morlo.", "id_number address"),
    ("证件号码 999999199307243293 仍显示在表格里。寄件地址：蘅榆市苕衡路360号。", "id_number address"),
    ("Hope returns every spring; so does the rose garden. Grace periods end after 30 days.", ""),
    ("Install lantern@2.14.0 before the reader. The handle @quiet posted 1200 notes.", ""),
    ("Order 202-7734-1190-02 left the yard at 10:15. Part no. 900 551 234 fits both lamps.", ""),
    ("Street lamps on the long road were replaced in 2019. See ISBN 978-0-00-123456-2.", ""),
]


def found(spark, rows, schema="record_table string, record_id string, text string, markup boolean, kind int"):
    names = spark.createDataFrame([(n, "x") for n in NAMES], "given_name string, kind string")
    return P.mentions(spark.createDataFrame(rows, schema), names).collect()


def test_types_and_numbers(spark):
    rows = [("t", f"{k:03}-{j}", text, False, 0) for k, (text, _) in enumerate(TEXTS) for j in range(12)]
    got = Counter()
    for r in found(spark, rows):
        got[r.record_id, r.pii_type] = max(got[r.record_id, r.pii_type], r.mention_no)
    for k, (_, kinds) in enumerate(TEXTS):
        for t in P.TYPES:
            assert got[f"{k:03}-0", t] == kinds.split().count(t), (k, t)


def test_markup_and_placeholders(spark):
    page = '<p title="a@b.example">Contact: <b>ro</b>se&#64;ost.example or call 202&nbsp;555&nbsp;0137.</p><p>I met <i>Rose</i> Keston<!-- x --> at noon.</p>'
    rows = [("p", "1", page, True, 0), ("p", "2", "plain", True, 0), ("p", "3", None, True, 0)] + [("t", f"{k}", t, False, 0) for k, (t, _) in enumerate(TEXTS)]
    names = spark.createDataFrame([(n,) for n in NAMES], "given_name string")
    df = spark.createDataFrame(rows, "record_table string, record_id string, text string, markup boolean, kind int")
    out = {(r.record_table, r.record_id): r.text for r in P.redacted(df, names).collect()}
    assert out["p", "1"] == '<p title="a@b.example">Contact: <b>[EMAIL]</b> or call [PHONE].</p><p>I met <i>[NAME]</i><!-- x --> at noon.</p>'
    assert out["p", "2"] == "plain" and out["p", "3"] is None and len(out) == len(rows)
    assert out["t", "1"] == "I met [NAME] and Dr. [NAME] at the jetty last spring."


def test_odd_rows(spark):
    rows = [("t", "1", TEXTS[0][0], False, 0)] * 3 + [("t", None, "x@y.example", False, 0), (None, "2", "", False, 0), ("t", "3", "word " * 50_000 + "x@y.example", False, 0)]
    got = found(spark, rows)
    assert {(r.record_id, r.pii_type, r.mention_no) for r in got} == {("1", "id_number", 1), ("1", "name", 1), ("1", "address", 1), ("3", "email", 1)} and len(got) == 4
    assert found(spark, []) == []


def test_reliabilities_follow_agreement():
    counts = {(1, 1, 0): 90, (1, 0, 1): 80, (0, 0, -1): 70, (0, -1, -1): 60, (1, 0, -1): 3}
    p = P.estimate(counts)
    assert p[1, 1, 0] > 0.95 and p[1, 0, 1] > 0.95 and p[0, -1, -1] < 0.05 and P.estimate({}) == {}


@pytest.mark.parametrize("spans,kept", [([(4, 0, 9, 0.9), (3, 2, 20, 0.8)], [(3, 2, 20)]), ([(1, 0, 9, 0.6), (2, 0, 9, 0.9)], [(2, 0, 9)]), ([(1, 0, 9, 0.4)], [])])
def test_overlaps(spans, kept):
    assert P.settled(spans) == kept


def test_postcodes_belong_to_addresses():
    spans = [(k, t[a:b]) for t in ("She lives at 12 Rosewood Close, Norwich NR1 4AB.", "Post: 4 Mill Lane, York, YO1 7HH, please.", "Post: 4 Mill Lane, Troy, NY 12180-1234.") for k, a, b, _, _ in P.candidates(t, frozenset()) if k == 3]
    assert spans == [(3, "12 Rosewood Close, Norwich NR1 4AB"), (3, "4 Mill Lane, York, YO1 7HH"), (3, "4 Mill Lane, Troy, NY 12180-1234")]


def test_names_that_no_list_knows_are_proposed():
    got = [(t[a:b], votes[-1]) for t in ("Write to Zoltan Kovacs at the office.", "We saw Dr. Piroska Nagy there.", "In March the Old Bridge was closed.", "I met Rose Keston there.") for k, a, b, votes, _ in P.candidates(t, frozenset({"rose"})) if k == 4]
    assert got == [("Zoltan Kovacs", -1), ("Piroska Nagy", -1), ("Rose Keston", 1)]


def test_a_gazetteer_of_any_size(spark):
    rows = [("t", f"{k:03}-{j}", text, False, 0) for k, (text, _) in enumerate(TEXTS) for j in range(4)] + [("p", "1", "<p>I met <i>Rose</i> Keston</p>", True, 0)]
    df = spark.createDataFrame(rows, "record_table string, record_id string, text string, markup boolean, own int")
    names = spark.createDataFrame([(n,) for n in NAMES], "given_name string")
    assert sorted(map(tuple, P.mentions(df, names, most_names=0).collect())) == sorted(map(tuple, P.mentions(df, names).collect()))
