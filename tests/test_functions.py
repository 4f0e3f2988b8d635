"""Column expressions on hand-written values."""

import datetime
import json

from pyspark.sql import functions as F

from corpuskit.functions import columns, dates, requests, rulings, text
from corpuskit.sources.payloads import bad_items, explode_items


def values(spark, column, rows, schema="c string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_nullish_counts_whitespace_as_text(spark):
    assert values(spark, text.is_nullish(F.col("c")), [None, "", " ", "x"]) == [True, True, False, False]


def test_all_nullish(spark):
    df = spark.createDataFrame([(None, ""), ("x", None)], "a string, b string")
    assert [r[0] for r in df.select(text.all_nullish([F.col("a"), F.col("b")])).collect()] == [True, False]


def test_text_length(spark):
    assert values(spark, text.text_length(F.col("c")), [None, "né"]) == [None, 2]
    assert values(spark, text.text_length(F.col("c"), 0), [None, "né"]) == [0, 2]


def test_length_bucket(spark):
    lengths = [None, 0, 1000, 1001, 10_000, 100_000, 100_001]
    labels = ["<=1k", "<=1k", "1k-10k", "1k-10k", "10k-100k", ">100k"]
    assert values(spark, text.length_bucket(F.col("c")), lengths, "c int") == ["null", *labels]
    assert values(spark, text.length_bucket(F.col("c"), strict=True), lengths, "c int") == [">100k", *labels]


def test_control_chars(spark):
    given = ["a\x07", "\x7f", "\x00", "tab\t nl\n cr\r", "c1 \x85", None]
    assert values(spark, text.has_control_chars(F.col("c")), given) == [True, True, True, False, False, None]


def test_snippet(spark):
    given = ["one\ntwo", "x" * 201, "x" * 200, "\nsecond"]
    assert values(spark, text.snippet(F.col("c")), given) == ["one", "x" * 200 + "…", "x" * 200, ""]


def test_slug(spark):
    assert values(spark, text.slug(F.col("c")), [" a--b! ", "???", "", "Tariff 3"]) == ["a_b", "blank", "blank", "Tariff_3"]


def test_normalise_list(spark):
    assert values(spark, text.normalise_list(F.col("c")), ["ny,\thq\u00a0,,", ""]) == [["NY", "HQ"], []]


def test_email(spark):
    given = ["a.b-c_d@x.example.org", "a+b@x.org", "a@x.museum", "a@x.org\n", "@x.org", ""]
    assert values(spark, text.is_valid_email(F.col("c")), given) == [True, False, False, False, False, False]


def test_restore_breaks(spark):
    df = spark.createDataFrame(
        [("a b c", "1\n2"), ("a b c", "1"), ("a b", "1\n2\n3\n4"), ("ab", "1\n2"), ("a  b", "1\n2")], "t string, o string")
    got = [r[0] for r in df.select(text.restore_breaks(F.col("t"), F.col("o"))).collect()]
    assert got == [t.replace(" ", "\n", o.count("\n")) for t, o in df.collect()]


def test_dates(spark):
    got = values(spark, dates.parse_date_or_null(F.col("c")), ["2020-02-03", "2020-02-03 04:05:06", "2020-02-31", "x", None])
    assert got == [datetime.datetime(2020, 2, 3), datetime.datetime(2020, 2, 3, 4, 5, 6), None, None, None]


def test_snapshot_date(spark):
    given = ["opinions-2025-09-04.csv.bz2", "opinions-latest.csv", "my-opinions-2025-09-04.csv"]
    assert values(spark, dates.snapshot_date(F.col("c")), given) == ["2025-09-04", *given[1:]]


def test_gib(spark):
    assert values(spark, dates.gib(F.col("c")), [0, 1 << 30, 1610612736], "c long") == ["0.0", "1.0", "1.5"]


def test_status_classes(spark):
    given = [200, 403, 429, 500, 599, 404, 301, None]
    assert values(spark, requests.classify_status(F.col("c")), given, "c int") == [
        "ok", "blocked", "blocked", "server_err", "server_err", "fail", "fail", "error"]
    assert values(spark, requests.is_throttled(F.col("c")), given, "c int") == [False, True, True] + [False] * 5
    assert values(spark, requests.is_final(F.col("c")), given, "c int") == [True] + [False] * 4 + [True, False, False]


def test_masking_leaves_no_secret(spark):
    given = ["http://u:s3cret@h:1", "socks5://u:s3cret@h:1", "u:s3cret@h", "http://h:80", "https://u:p:w@h", "http://u:p@ss@h:80",
             "http://:p@h", "me@mail:p@h/x@y", "h:80", "http://h/a:b@c"]
    assert values(spark, requests.mask_credentials(F.col("c")), given) == [
        "http://u:****@h:1", "socks5://u:****@h:1", "u:****@h", "http://h:80", "https://u:****@h", "http://u:****@h:80",
        "http://:****@h", "me@mail:****@h/x@y", "h:80", "http://h/a:b@c"]


def test_endpoint_notations(spark):
    given = ["h:80", "\th:80:u:p \r", "u:p@h:80", "socks5://h:1", "h:1:2", "h"]
    assert values(spark, requests.normalise_endpoint(F.col("c")), given) == [
        "http://h:80", "http://u:p@h:80", "http://u:p@h:80", "socks5://h:1", None, None]


def items_of(spark, payloads):
    column = rulings.payload_items(rulings.parse_payload(F.col("c")))
    return [r and [dict(i) for i in r] for r in values(spark, column, [json.dumps(p) for p in payloads])]


def test_payload_items(spark):
    a, b = {"number": "N1"}, {"number": "N2"}
    got = items_of(spark, [
        {"results": [b], "rulings": [a]},
        {"rulings": "none", "results": [b]},
        {"zeta": [1, 2], "hits": [a, b], "alpha": [b]},
        {"zeta": [], "alpha": [b]},
        {"note": "[{}]", "hits": [a]},
        {"rulings": [], "results": [b]},
        {"total": 3},
        [a],
    ])
    assert got == [[a], [b], [a, b], [], [a], [], None, None]


def test_bad_json_has_no_items(spark):
    assert values(spark, rulings.payload_items(rulings.parse_payload(F.col("c"))), ["{bad", "", None]) == [None] * 3


def test_items_keep_their_order_and_texts(spark):
    """Keys keep their order; white space and trailing zeros of numbers are lost to every JSON function there is."""
    page = '{"rulings": [{"n": 1.50, "t": {"z": 1, "a": [2 , 3]}, "s": "x"}, 7, null, {"n": 2}]}'
    (items,) = values(spark, rulings.payload_items(rulings.parse_payload(F.col("c"))), [page])
    assert [dict(i) for i in items] == [{"n": "1.5", "t": '{"z":1,"a":[2,3]}', "s": "x"}, {"n": "2"}]


def test_what_is_no_item_is_reported(spark):
    pages = ['{"rulings": [{"n": 1}, 7, "x"]}', '{"total": 1}', "{cut off", "", '[{"n": 1}]', '{"results": []}']
    df = spark.createDataFrame(list(enumerate(pages)), "page int, payload string")
    assert [(r.page, r.idx) for r in explode_items(df).collect()] == [(0, 0)]
    got = sorted(((r.page, r.idx, r.raw) for r in bad_items(df).collect()), key=repr)
    assert got == sorted([(0, 1, "7"), (0, 2, "x"), *[(i, None, pages[i]) for i in (1, 2, 3, 4)]], key=repr)


def test_payload_totals(spark):
    given = [
        {"totalPages": 4, "totalResults": 301}, {"totalPages": 0, "total_pages": 2}, {"total": "250"},
        {"totalResults": 0, "total": 0, "totalHits": 101}, {"totalHits": 0}, {}, {"totalResults": "many"},
    ]
    column = rulings.payload_totals(rulings.parse_payload(F.col("c")), 100)
    got = [tuple(r) for r in values(spark, column, [json.dumps(p) for p in given])]
    assert got == [(4, 301), (2, None), (3, 250), (2, 101), (0, 0), (None, None), (None, None)]


def test_doc_key(spark):
    given = [
        {"number": "N300001", "rulingDate": "May 2, 2003"},
        {"number": "", "docNumber": "X7", "date": "", "issueDate": "1/2/1999"},
        {"title": "Ruling H350250 of 2001", "heading": "N111111"},
        {"heading": "about N352679", "publicationDate": "2011-1-1 2012"},
        {"title": "N3526790", "date": "12003"},
    ]
    got = [tuple(r) for r in values(spark, rulings.doc_key(F.col("c")), given, "c map<string,string>")]
    assert got == [("N300001", 2003), ("X7", 1999), ("H350250", None), ("N352679", 2011), (None, None)]


def test_doc_location(spark):
    df = spark.createDataFrame([("Ny", 2003, "N1")], "c string, y int, n string")
    key = [F.col("c"), F.col("y"), F.col("n")]
    row = df.select(rulings.doc_url("http://x/get", *key), rulings.doc_path(*key)).first()
    assert tuple(row) == ("http://x/get/ny/2003/N1.pdf", "NY/2003/N1.pdf")


def test_column_choices(spark):
    df = spark.createDataFrame([("1", "t", "h")], "id string, html string, type string")
    assert columns.missing_columns(df, ["type", "", "sha1", "id", "author_str"]) == ["sha1", "author_str"]
    assert columns.present_of(df) == ["id", "type"]
    assert columns.first_present(df) == "html"
    assert columns.first_present(df.select("id")) is None
