"""Citations of addresses in made texts."""

from pyspark.sql import functions as F

from quillgraph.functions.citations import citations, cited_addresses, labels_of

A, B, C = (f"https://github.com/o/{x}" for x in "abc")


def met(*pages):
    return [(page, label, url[-1]) for page, label, url, _ in cited_addresses(list(pages))]


def test_labels():
    assert labels_of("3, 5–7; 1") == [1, 3, 5, 6, 7] and labels_of("9-2") == [] and labels_of("1-99") == [] and labels_of("2-") == [] and labels_of("12345-12346") == []


def test_lists_and_ranges():
    assert met(f"We use [2] and [1, 3-4].\nReferences\n[1] x {A}\n[2] y {B}, {C}\n[4] z") == [(1, 1, "a"), (1, 2, "b"), (1, 2, "c")]
    assert met(f"See [1].\n5. Список литературы\n1. x\n{A}") == [(1, 1, "a")]
    assert met(f"See [7].\nReferences\n2020. a year {A}\n7) x {B}") == [(1, 7, "b")]  # a bare number without neighbour or citation is no entry
    assert met(f"None.\nReferences\n[1] {A}") == [] and met(f"See [1] {A}") == [] and met("") == [] and cited_addresses([]) == []


def test_lists_over_pages_and_their_end():
    assert met("See [1] and [3].", f"Bibliography:\n[1] {A}\n[2]", f"{B}\n[3] {C}\nAppendix A: more\n[3] see [1]") == [(1, 1, "a"), (1, 3, "c"), (3, 1, "a"), (3, 3, "c")]


def test_a_list_that_begins_anew_counts_on_its_page():
    assert met(f"One [1].\n[1] note {C}", f"Two [1].\nReferences\n[1] {A}") == [(1, 1, "c"), (2, 1, "a")]
    assert met(f"[1] note {C}", f"Two [1].\nReferences\n[1] {A}") == [(1, 1, "a"), (2, 1, "a")]  # not cited before: no note


def test_citations_of_columns(spark):
    rows = spark.createDataFrame([(1, [f"See [1]\nReferences\n[1] {A}", None]), (2, None), (3, [])], "i int, p array<string>")
    found = {r["i"]: [tuple(c) for c in r["c"]] for r in rows.select("i", citations(F.col("p")).alias("c")).collect()}
    assert found == {1: [(1, 1, A, 4)], 2: [], 3: []}
