"""Markup, addresses and given names on small tables."""

from pyspark.sql import functions as F

from quillgraph.functions.given import given_channels, given_fit
from quillgraph.functions.markup import emails_in_html, without_markup
from quillgraph.functions.wraps import unwrapped
from quillgraph.operators.readings import confirmed_readings


def test_markup(spark):
    cases = {
        None: None,
        "": "",
        "a < b": "a < b",
        "x<sup> 2 </sup> y": "x 2 y",
        "<mml:math><mml:mtext>ab</mml:mtext> <mml:mtext> </mml:mtext><mml:mtext>initio</mml:mtext></mml:math> run": "ab initio run",
        "<mml:math> <b> p q </b></mml:math>": "pq",
        "&lt;i&gt;E. coli&lt;/i&gt; [ 1 ]": "E. coli [1]",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.c for r in rows.select("t", without_markup(F.col("t")).alias("c")).collect()} == cases


def test_emails_in_html(spark):
    rows = spark.createDataFrame([(0, None), (1, "no address"), (2, "A.B{AT}x{dot}org, a.b&#064;x.org; <a href='MAILTO:c+d@y.org'>"), (3, "")], "i int, t string")
    found = {r.i: r.e for r in rows.select("i", emails_in_html(F.col("t")).alias("e")).collect()}
    assert found == {0: [], 1: [], 2: ["a.b@x.org", "c+d@y.org"], 3: []}


def test_given_names(spark):
    cases = [("ievgenii", "evgenii", True), ("ekaterina", "katerina", True), ("ivan", "petr", False), ("", "petr", True), (None, "petr", True), ("i", "ivan", True), ("ab", "ba", False)]
    rows = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", given_fit(F.col("a"), F.col("b")).alias("got")).collect())
    names = spark.createDataFrame([("ieva",), ("al",), ("",), (None,)], "n string")
    assert [r.c for r in names.select(given_channels(F.col("n")).alias("c")).collect()] == [["gram:ev", "gram:ie", "gram:va", "initial:e", "initial:i"], ["initial:a"], [""], [""]]


def test_unwrapped(spark):
    start = "https://github.com/a"
    cases = {
        None: None,
        "": [],
        start: [],
        f"{start}/b-\nc_\nd": [f"{start}/bc_", f"{start}/b-c_", f"{start}/bc_d", f"{start}/b-c_d"],
        f"{start}/b\nc": [],
        f"{start}/" + "-\n".join("bcdefg"): [f"{start}/" + "".join(x + "-" * (k >> (4 - i) & 1) for i, x in enumerate("bcdef")) + "g" for k in range(32)],
        f"{start}/" + "-\n".join("bcdefgh"): None,
        f"{start}/" + "-\n".join("b" * 100_000): None,
        f"{start}/" + "_\n".join("b" * 9): [f"{start}/" + "b_" * k for k in range(1, 9)] + [f"{start}/" + "b_" * 8 + "b"],
        f"{start}/" + "_\n".join("b" * 33): None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.u for r in rows.select("t", unwrapped(F.col("t")).alias("u")).collect()} == cases


def test_confirmed_readings(spark):
    site = "https://github.com/"
    rows = [(1, 1, f"{site}o/a-\nb"), (1, 2, f"{site}O/A-B."), (2, 3, f"{site}o/a-\nb"), (None, 4, f"{site}o/c-\nd"), (None, 5, f"{site}o/cd"), (1, 6, None), (1, 2, f"{site}O/A-B.")]
    found = confirmed_readings(spark.createDataFrame(rows, "doc int, mention int, raw string")).collect()
    expected = {(1, 1, f"{site}o/a-b", True), (1, 2, f"{site}O/A-B", True), (None, 5, f"{site}o/cd", True)}
    expected |= {(2, 3, f"{site}o/{x}", False) for x in ("ab", "a-b")} | {(None, 4, f"{site}o/{x}", False) for x in ("cd", "c-d")}
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)
    assert confirmed_readings(spark.createDataFrame([], "doc int, mention int, raw string")).count() == 0
