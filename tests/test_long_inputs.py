"""No input ends the job or takes quadratic time."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import money
from tallyloom.operators import accounting, validate
from tallyloom.sources import intake, markdown

MB = 1_000_000


def column(spark, make, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(make(F.col("v"))).collect()]


def test_long_addresses(spark):
    began = time.perf_counter()
    texts = ["a" + ".a" * MB + "@x.org", "a@" + "x." * MB, "a@" + "x." * MB + "org", '"' + "\\\"" * MB + '"@x.org', "a." * MB, "@" * MB, " " * MB + "a@b.co"]
    assert column(spark, validate.email_ok, texts) == [False] * 7
    df = spark.createDataFrame([(t, "n", "V1") for t in texts], "email string, username string, postal string")
    assert [r[0] for r in df.select(validate.form_complete(df, "membership")).collect()] == [False] * 6 + [True]
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("text, ok", [('"a b"@x.org', True), ('"a\\"b"@x.org', True), ('a."b".c@x.org', True), ('"a@x.org', False), ("a@1.2.3.4", False), ("a@[1.2.3.4]", True), ("a@[256.2.3.4]", False), ("a@[IPv6:::1]", True), ("a@[IPv6:1:2:3:4:5:6:7:8]", True), ("a@[IPv6:1:2]", False), ("a@[IPv6:1:2:3:4:5:6:7:8:9]", False), ('"' + "x" * 64 + '"@x.org', True), ('"' + "x" * 65 + '"@x.org', False), ("a@b.1c", False), ("a@" + "b." * 125 + "co", True), ("a@" + "b." * 127 + "co", False)])
def test_addresses(spark, text, ok):
    assert column(spark, validate.email_ok, [text]) == [ok]


def test_long_markdown(spark):
    began = time.perf_counter()
    texts = ["- a\n" + "  - Type: x\n" * 100_000, "- a\n  - Type: x\n" * 100_000, "TITLE:\nx" + " " * MB + "y", "TITLE:\n" + "\n" * MB, "TITLE:\n" + "x\n" * MB, "## Related Nodes\n- x" + " " * MB + "y\n" + "- \n" * 100_000, "- " * MB, ""]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    assert markdown.file_index(files).groupBy("name", "type").count().collect() == [("a", "x", 100_001)]
    titles = [r.title for r in markdown.asset_records(files).orderBy("path").collect()]
    assert titles[2] == "x" + " " * MB + "y" and titles[3] == "" and len(titles[4]) == 2 * MB - 1 and titles[5:] == [""] * 3
    assert [r.dst for r in markdown.node_edges(files, F.col("path")).collect()][0] == "x-y"
    assert markdown.glossary(files).count() == 0
    assert time.perf_counter() - began < 30


def test_index_entries_end_where_their_fields_end(spark):
    text = "- a.png\n  - Type: image.\n  - Tags: x, y.\nnot a field\n  - Type: none\n\n- alone\n\n- b\n  - Suggested path: `1/b`\n"
    files = spark.createDataFrame([(text,), (None,)], "text string")
    assert [(r.name, r.type, r.tags, r.suggested_path) for r in markdown.file_index(files).collect()] == [("a.png", "image", ["x", "y"], ""), ("b", "", [""], "1/b")]


def test_large_amounts(spark):
    """Beyond int, beyond decimal(18,2), beyond every date, no number at all."""
    amounts = [3e9, 1e17, 1e300, 1.7e308, 2_932_895.0, 2_932_897.0, float("nan"), float("inf"), -1e300, None]
    df = spark.createDataFrame([(a, dt.date(1970, 1, 1)) for a in amounts], "a double, day date")
    rows = accounting.with_allocation(df, "a").select("*", money.days_covered(F.col("a")).alias("n"), money.next_payment(F.col("day"), F.col("a")).alias("next"), money.amount_text(F.col("a")).alias("text"), money.cents(F.col("a")).alias("c")).collect()
    assert [r.n for r in rows] == [3_000_000_000, 10**17, None, None, 2_932_895, 2_932_897, 0, 0, 0, 0]
    one = dt.date(1970, 1, 2)
    assert [r.next for r in rows] == [None] * 4 + [dt.date(9999, 12, 30), None] + [one] * 4
    assert [r.text for r in rows] == ["3000000000", "100000000000000000", "1e+300", "1.7e+308", "2932895", "2932897", None, "Infinity", "-1e+300", None]
    assert [r.rejected for r in rows] == [False, True, True, True, False, False, True, True, True, False]
    assert [r.programme is None for r in rows] == [False, True, True, True, False, False, True, True, True, True]
    total = accounting.totals(df.withColumn("k", F.lit(1)), "k", "a").first()
    assert (float(total.money_in), total.n, total.n_rejected) == (3e9 + 2_932_895 + 2_932_897, 10, 6)
    assert [c for c in column(spark, money.cents, [1e14 + 0.125, 9.007e13], "double")] == [(1e14 + 0.125) * 100 / 100, 9.007e13]


@pytest.mark.parametrize("text, value", [("5d", None), ("5f", None), ("0x10", 16), ("0b11", 3), ("0o17", 15), ("\u00a012\ufeff", 12), ("1e3", 1000), (".5", 0.5), ("5.", 5), ("+7", 7), ("Infinity", float("inf")), ("inf", None), ("NaN", None), ("1_0", None), ("0x", None), ("-0x1", None), ("\u0663", None), ("1" * 400, float("inf")), ("0xFFFFFFFFFFFFFFFFF", float(0xFFFFFFFFFFFFFFFFF))])
def test_numbers_of_the_browser(spark, text, value):
    (got,) = column(spark, money.parse_amount, [text])
    assert got == value if value is not None else got != got
    assert column(spark, lambda c: money.choose_amount(money.parse_amount(c), F.lit(30)), [text]) == [30.0 if value is None else value]


BODIES = [
    ('{"title":"a"} x', None), ('\t{"title":"a"}\r\n', "a"), ('{"title":"a","title":"b"}', "b"), ("{'title':'a'}", None), ('{"title":NaN}', None), ('{"title":"a"},{"b":1}', None), ('{"title":"a"}],[2', None),
    ('\x0c{"title":"a"}', None), ('{"title":"a",}', None), ('{"title":5}', "5"), ('{"title":1.50}', "1.5"), ('{"title":1e3}', "1000"), ('{"title":true}', "1"), ('{"title":false}', ""), ('{"title":[1]}', "Array"),
    ('{"title":"{}"}', "{}"), ('"{}"', None), ('{"a":{"b":1,"b":2},"title":"q"}', "q"), ('{"title":"\\ud83d\\ude00"}', "\U0001f600"), ("", None), (None, None),
]


def test_bodies(spark):
    rows = intake.parse_submissions(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BODIES)], "i int, raw string"), "raw").orderBy("i").collect()
    assert [(r.title, r.corrupt is None) for r in rows] == [(t, t is not None) for _, t in BODIES]
    assert all(r.corrupt == (r.raw or "") for r in rows if r.corrupt is not None)


def test_long_bodies(spark):
    began = time.perf_counter()
    bodies = ["[" * MB, "{" * MB, '{"title":"' + "x" * MB + '"}', " " * MB + "{}" + "\n" * MB, '{"title":"a"}' + " " * MB + "x", "[" + "1," * MB + "1]"]
    rows = intake.parse_submissions(spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, raw string"), "raw").orderBy("i").collect()
    assert [r.corrupt is None for r in rows] == [False, False, True, True, False, True] and len(rows[2].title) == MB
    assert time.perf_counter() - began < 20


ADDRESSES = [
    ("https://a.b", "https://a.b/?amount=7.5"), ("https://u:P@H.org:443/p", "https://u:P@h.org/p?amount=7.5"), ("http://h:443", "http://h:443/?amount=7.5"), ("mailto:x@y", "mailto:x@y?amount=7.5"), ("/x", None), ("", None), (None, None),
    ("https://h/x?amount=1&amount=2&b", "https://h/x?amount=7.5&b="), ("https://h/x?%61mount=1", "https://h/x?amount=7.5"), ("https://h/x?q=a%2Fb+c~*", "https://h/x?q=a%2Fb+c%7E*&amount=7.5"), ("https://h/x?#a#b?c", "https://h/x?amount=7.5#a#b?c"),
]


def test_payment_addresses(spark):
    assert column(spark, lambda c: money.payment_url(c, F.lit(7.5)), [a for a, _ in ADDRESSES]) == [b for _, b in ADDRESSES]
