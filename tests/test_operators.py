"""Cases of single operators that the driver's tables don't have."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import keys, names, text
from quillgraph.operators import blocking, edges, folds, groups, history, votes
from quillgraph.operators.components import connected_components
from quillgraph.operators.skew import join_counted
from quillgraph.streaming import events


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(c.alias("x")).first().x


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    e = {"chain": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 300)], "random": [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(200)], "none": []}[shape]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert found == {x: find(x) for x in list(parent)}


def test_join_counted_keeps_every_row_of_hot_and_cold_keys(spark):
    left = spark.range(5000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m")).where("k % 2 = 0")
    got = sorted(map(tuple, join_counted(left, right, ["k"], "n").select("k", "id", "m").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "id", "m").collect())) and len(got) == 4000


def test_alias_closure(spark):
    a = spark.createDataFrame([(k + 1, k) for k in range(1, 40)], "old long, new long")
    assert {r.new for r in groups.alias_closure(a).collect()} == {1}
    with pytest.raises(ValueError, match="cycle"):
        groups.alias_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "old long, new long"))
    with pytest.raises(ValueError, match="competing"):
        groups.alias_closure(spark.createDataFrame([(1, 2), (1, 3)], "old long, new long"))


def test_split_conflicts(spark):
    rows = [("g", 1, "a", None), ("g", 2, "a", "s"), ("g", 3, "b", None), ("g", 4, None, "t"), ("h", 9, None, None)]
    out = {r.e: r.part for r in groups.split_conflicts(spark.createDataFrame(rows, "g string, e long, orcid string, staff string"), "g", "e", ["orcid", "staff"]).collect()}
    assert out == {1: 1, 2: 1, 3: 3, 4: 4, 9: 9}


def test_nearest_root_leaves_ties_open(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (5, 6)], "a long, b long")
    roots = spark.createDataFrame([(1,), (5,)], "node long")
    assert {(r.node, r.root, r.dist) for r in groups.nearest_root(e, roots).collect()} == {(1, 1, 0), (5, 5, 0), (2, 1, 1), (4, 5, 1), (6, 5, 1)}


def test_coauthors_of_a_long_list_need_an_insider(spark):
    long_list = [("p", k) for k in range(8)] + [("q", 0), ("q", 1)]
    a = spark.createDataFrame(long_list, "pid string, per long")
    found = {(r.a, r.b): r.w for r in edges.coauthor_weights(a, spark.createDataFrame([(3,)], "per long"), 5).collect()}
    assert found == {(min(3, k), max(3, k)): 1 for k in range(8) if k != 3} | {(0, 1): 1}


def test_groups_beyond_the_cap_make_no_pair(spark):
    m = spark.createDataFrame([("big", k) for k in range(61)] + [("ok", k) for k in range(60)] + [("one", 7)], "g string, m long")
    assert edges.member_pairs(m, "g", "m", 60).groupBy("g").count().collect()[0].asDict() == {"g": "ok", "count": 60 * 59 // 2}


def test_votes(spark):
    rows = spark.createDataFrame([("x", 2), ("x", 1), ("y", None), ("z", 5), ("z", 5), ("z", 1)], "k string, v int")
    assert dict(map(tuple, votes.majority(rows, "k", "v").collect())) == {"x": 1, "z": 5}
    ranked = {r.v: r.r for r in votes.scaled_rank(spark.createDataFrame([(3,), (1,), (3,), (2,), (None,)], "v int"), "v", "r").collect()}
    assert ranked == {1: 0.333, 2: 0.667, 3: 1.0, None: None}


def test_fold(spark):
    rows = spark.createDataFrame([("k", 2, "", ["b", "a"], None), ("k", 1, None, ["a"], False), ("k", 3, "t", None, True), ("l", 1, None, None, None)], "k string, r int, title string, xs array<string>, f boolean")
    out = {x.k: x for x in folds.fold(rows, "k", [F.col("r")], ["title"], ["xs"], ["f"]).collect()}
    assert (out["k"].title, out["k"].xs, out["k"].f) == ("t", ["a", "b"], True) and (out["l"].title, out["l"].xs, out["l"].f) == (None, [], False)
    inv = folds.inventory(spark.createDataFrame([("a", ["2", "1"], 1), ("a", None, 3), ("b", ["1"], 2), ("b", ["1", "0"], 1)], "k string, ids array<string>, at int"), "k", "ids", "at")
    assert {r.k: (r.ids, r.at) for r in inv.collect()} == {"a": (None, 3), "b": (["0", "1"], 2)}


def test_upsert(spark):
    now = spark.createDataFrame([(1, "a", 1), (2, "b", 4), (3, None, 1)], "id long, v string, _version int")
    state, old = history.upsert(now, spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id long, v string"), "id")
    assert {tuple(r) for r in state.collect()} == {(1, "a", 1), (2, "c", 5), (3, None, 1), (4, "d", 1)}
    assert [tuple(r) for r in old.collect()] == [(2, "b", 4)]


def test_collapse(spark):
    rows = [(1, 2, 1, None, ["x"], "s"), (1, 2, 2, True, None, "s"), (1, 3, 1, False, [], "t"), (1, 3, 2, False, ["z", "y"], "u")]
    e = spark.createDataFrame(rows, "a long, b long, at int, corr boolean, ror array<string>, src string")
    out = {r.b: r for r in edges.collapse(e, ["a", "b"], F.col("at"), ["at"], ["corr"], ["ror"], ["src"]).collect()}
    assert tuple(out[2])[2:] == (2, True, ["x"], "s") and tuple(out[3])[2:] == (2, False, ["y", "z"], None)


def test_keys(spark):
    assert one(spark, keys.repository_url(F.lit(" HTTP://www.GitHub.com/A/B.git/ "))) == "https://github.com/a/b"
    assert one(spark, keys.repository_id(F.lit("https://github.com/A/b/tree/x"))) is None
    assert one(spark, keys.orcid(F.lit("https://evil.org/0000-0001-0002-0003"))) is None
    assert one(spark, keys.ror(F.lit("https://ror.org/04Txgxn49"))) == "04txgxn49"
    assert one(spark, keys.arxiv(F.lit("see arXiv:2101.01234v2"))) == "2101.01234"
    assert one(spark, keys.pair_id(F.lit("b"), F.lit("a"))) == "a:b"


def test_text(spark):
    assert one(spark, text.emails(F.lit("A@x.org, b@y.io; a@X.org"))) == ["a@x.org", "b@y.io"]
    assert one(spark, text.best_email(F.array(F.lit("bb@y.io"), F.lit("c@y.io")), "x.org")) == "c@y.io"
    assert one(spark, text.citation_numbers(F.lit("1, 3-5, 9-99, x"))) == [1, 3, 4, 5]
    assert one(spark, text.grant_id(F.lit("grant No. 20–11"))) == "20-11"
    assert one(spark, text.deletion_keys(F.lit("Ivannov"))) == ["ivanov", "vanov", "ianov", "ivnov", "ivaov", "ivanv", "ivano"]
    assert one(spark, text.mixed_script(F.lit("Иvan Петров"))) is True and one(spark, text.initials_only(F.lit("И.И. Иванов"))) is True
    assert one(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0.0


def test_names():
    assert names.fold("Ёлкин-Щукин, É.") == "elkin shchukin e"
    assert names.unmix("Ивaнов") == "Иванов" and names.unmix("\u0421mith") == "Cmith"
    assert names.aligned("ivan petrov", "petrov ivan") == 1.0 and names.aligned("", "x") == 0.0
    assert names.similarity("abcd", "bcde") == 0.75


def test_blocking(spark):
    rows = spark.createDataFrame([(1, "a", ["x", "y"]), (2, "a", ["y"]), (3, "b", ["x", "y"])], "id long, k string, ts array<string>")
    found = {(r.a, r.b): r.channels for r in blocking.channel_pairs(rows, "id", {"key": (F.col("k"), 9), "token": (F.col("ts"), 2)}).collect()}
    assert found == {(1, 2): ["key"], (1, 3): ["token"]}
    assert {(r.a, r.b): r.n for r in blocking.rare_pairs(rows.withColumn("o", F.lit(1)), "o", "id", F.col("ts")).collect()} == {(1, 3): 2}


def test_lockout_window_starts_at_a_runs_first_failure(spark, tmp_path):
    t = [0, 10, 20, 25, 30, 130, 131, 132]  # locked at 20 until 120; a new run locks at 132
    spark.createDataFrame([(1, x) for x in t] + [(2, 0), (2, 901), (2, 902)], "u long, s long").select("u", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "log.parquet"))
    out = events.drain(events.lockouts(events.read_log(spark, str(tmp_path / "log.parquet")), "u", "ts", 3, 900, 100))
    assert sorted((r.u, int(r.locked_at.timestamp()), int(r.until.timestamp())) for r in out.collect()) == [(1, 20, 120), (1, 132, 232)]


def test_late_and_contradicting_values(spark, tmp_path):
    rows = [(1, 5, 1.0), (1, 3, 9.0), (2, 4, 1.0), (2, 4, 2.0), (3, 4, 1.0), (3, 4, 2.0), (3, 6, 7.0)]
    spark.createDataFrame(rows, "u long, s long, v double").select("u", F.timestamp_seconds("s").alias("ts"), "v").coalesce(1).write.parquet(str(tmp_path / "log.parquet"))
    out = events.drain(events.latest_values(events.read_log(spark, str(tmp_path / "log.parquet")), "u", "ts", "v"), "update")
    assert sorted((r.u, r.value, r.disputed) for r in out.collect()) == [(1, 1.0, False), (2, None, True), (3, 7.0, False)]


def test_groups_without_a_cap_make_every_pair(spark):
    n = edges.PART + 20
    m = spark.createDataFrame([("big", k) for k in range(n)] + [("ok", 1), ("ok", 2), ("one", 7)], "g string, m long")
    found = edges.member_pairs(m, "g", "m", None)
    assert {r.g: (r["count"], r.k) for r in found.groupBy("g", "k").count().collect()} == {"big": (n * (n - 1) // 2, n), "ok": (1, 2)}
    assert found.columns == ["g", "a", "k", "b"] and found.distinct().count() == n * (n - 1) // 2 + 1


def test_c13_pairs_every_version_of_a_common_title(spark):
    from quillgraph.plans.composites import c13_version_edges

    p = spark.range(50).select(F.col("id").alias("pid"), F.lit("v").alias("venue"), F.lit("t").alias("title"), F.lit("F").alias("type"), F.current_date().alias("date"))
    assert c13_version_edges({"publications": p}).count() == 50 * 49 // 2


def test_nearest_root_walks_until_nothing_is_left(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20)], "a long, b long")
    found = {r.node: r.dist for r in groups.nearest_root(e, spark.createDataFrame([(0,)], "node long")).collect()}
    assert found == {k: k for k in range(21)}


def test_split_conflicts_of_a_large_group(spark):
    rows = spark.range(30_001).selectExpr("cast(null as string) AS g", "id AS e", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS orcid", "CASE WHEN id < 3 THEN cast(id as string) END AS staff")
    found = groups.split_conflicts(rows, "g", "e", ["orcid", "staff"]).groupBy("g", "part").count().collect()
    # those without an orcid go to 'a' (of equal counts the smaller value); of that part two have a staff id, 0 and 2
    assert {(r["g"], r["part"], r["count"]) for r in found} == {(None, 0, 20_000), (None, 1, 10_000), (None, 2, 1)}
