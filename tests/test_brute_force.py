"""Queries without SQL against a loop over the same rows."""

from collections import Counter, defaultdict

from quillgraph import plans

DATA = "/root/testdata/sf0.001"


def test_lockouts(spark):
    failures = defaultdict(list)
    for r in spark.read.parquet(f"{DATA}/events.parquet").where("event_type = 'error'").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) AS t").collect():
        failures[r.user_id].append(r.t)
    expected = set()
    for user, times in failures.items():
        first, count, until = None, 0, 0
        for t in sorted(times):
            if t < until:
                continue
            if first is None or t - first > 172_800 * 10**6:
                first, count = t, 0
            count += 1
            if count == 3:
                until, first = t + 86_400 * 10**6, None
                expected.add((user, t, until))
    found = plans.QUERIES["t07_lockouts"](spark, DATA).selectExpr("user_id", "unix_micros(locked_at) AS a", "unix_micros(until) AS b").collect()
    assert {tuple(r) for r in found} == expected and len(found) == len(expected)


def test_colleague_edges(spark):
    of = {r.s_suppkey: r.s_nationkey for r in spark.read.parquet(f"{DATA}/supplier.parquet").collect()}
    sizes, degree = Counter(of.values()), Counter()
    found = [tuple(r) for r in plans.QUERIES["g14_colleague_edges"](spark, DATA).collect()]
    assert len(set(found)) == len(found) and all(a < b and of[a] == of[b] for a, b in found)
    for a, b in found:
        degree[a] += 1
        degree[b] += 1
    # a ring of n: everyone meets the three before and the three after it, or all others
    assert all(degree[p] == min(6, sizes[d] - 1) for p, d in of.items())
