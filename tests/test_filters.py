"""Slots that hold no person, accounts of tools, and surnames that differ by a letter."""

import re
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillgraph.functions.name_forms import name_forms
from quillgraph.functions.people import no_person_slot, personal_account
from quillgraph.plans import QUERIES
from quillgraph.plans.resolution_queries import people_named

DATA = "/root/testdata/sf0.001"


def test_slots_and_accounts(spark):
    slots = ["Russian Society of X", "ATLAS Collaboration", "a@b.c", "see www.x.y", "Ann Grouper", "Team Lee", "", None]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(slots)], "k int, s string")
    assert [r.x for r in rows.orderBy("k").select(no_person_slot(F.col("s")).alias("x")).collect()] == [True] * 4 + [False] * 4
    accounts = [("ann", None), ("ann", "User"), ("ann", "Organization"), ("x[bot]", "User"), ("Dependabot-2", None), ("web-flow", None), ("web-flows", None), ("", None), (None, "User")]
    rows = spark.createDataFrame([(k, *a) for k, a in enumerate(accounts)], "k int, login string, kind string")
    assert [r.x for r in rows.orderBy("k").select(personal_account(F.col("login"), F.col("kind")).alias("x")).collect()] == [True, True, False, False, False, False, True, False, False]


def test_fuzzy_surnames_equal_all_pairs(spark):
    bearers = {}
    for r in people_named(spark, DATA).collect():
        for f in name_forms(r.name):
            bearers.setdefault(f.surname, set()).add(r.per)

    def cut(s):
        s = re.sub(r"(.)\1", r"\1", s)
        return {s} if len(s) < 5 else {s, *(s[:k] + s[k + 1 :] for k in range(len(s)))}  # short words meet as they are

    want = {(a, b, len(bearers[a]), len(bearers[b])) for a in bearers for b in bearers if a < b and cut(a) & cut(b) and SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert {tuple(r) for r in QUERIES["j15_fuzzy_surnames"](spark, DATA).collect()} == want and want
