"""Unit names, closest titles and constrained components against loops."""

import random
import re
from difflib import get_close_matches

import pytest

from quillgraph.functions.units import NameFinder, parts_near, plain
from quillgraph.operators.closest import closest_titles, placed_titles
from quillgraph.operators.constrained import constrained_components
from quillgraph.operators.unit_names import affiliated_units, units_named


def plain_find(names, text):
    text, hits = plain(text), {}
    for n in {plain(n) for n in names} - {""}:
        tail = r"(?![^\W\d_])" if " " not in n or len(n.split()[-1]) <= 2 else ""
        raw = [m.start() for m in re.finditer(f"(?={re.escape(n)})", text)]
        hits[n] = (raw, [m.start() for m in re.finditer(rf"(?<![^\W\d_])(?={re.escape(n)}{tail})", text)])
    standing = [n for n in hits if hits[n][1]]
    covers = lambda n, at: any(o != n and len(o) > len(n) and s <= at and at + len(n) <= s + len(o) for o in standing for s in hits[o][0])
    return sorted(n for n in standing if any(not covers(n, at) for at in hits[n][1]))


def test_names_in_a_text():
    finder = NameFinder(["School of Physics", "Physics", "School", "ИИ", "Institute AI", "FBIT", "Energy-Efficient Systems"])
    assert finder.find("2School of physics and Energy Efficient systems") == ["energy efficient systems", "school of physics"]
    assert finder.find("School of Physics; Physics") == ["physics", "school of physics"]
    assert finder.find("MorFBITs, Preschool, Институт ИИТ") == [] and finder.find(None) == [] and NameFinder([]).find("x") == []
    assert finder.find("ИИ, FBIT") == ["fbit", "ии"]


@pytest.mark.parametrize("size", [4_000_000, 12])
def test_units_named_equals_a_loop(spark, size):
    rnd = random.Random(4)
    words = ["a", "ab", "b", "ba", "école", "x1"]
    text = lambda n: "".join(w + rnd.choice([" ", " ", "-", ""]) for w in rnd.choices(words, k=n))
    names = [(k, text(rnd.randint(1, 3))) for k in range(12)] + [(99, None), (98, ""), (3, "a b")]
    texts = [(k % 50, text(rnd.randint(0, 12))) for k in range(80)] + [(1, None), (None, "a b"), (2, "")]
    found = units_named(spark.createDataFrame(texts, "doc bigint, t string"), "doc", "t", spark.createDataFrame(names, "u int, n string"), "u", "n", size)
    want = {(d, u, n) for d, t in texts for n in plain_find([raw for _, raw in names if raw], t) for u, raw in names if raw and plain(raw) == n}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(set(rows)) and want


def test_parts_that_borrow_the_mark():
    units, mark = NameFinder(["Institute of Optics", "Department of Physics"]), re.compile(r"\balma\b", re.IGNORECASE)
    near = lambda t: parts_near(t, mark, units)
    assert near("Department of Physics, ALMA University, Saint Petersburg") == ["department of physics", "alma university"]
    assert "department of physics" not in near("Department of Physics, Other University, x, ALMA")
    assert "faculty of x" in near("Faculty of X, Laboratory of Light, ALMA")  # across a sub-unit
    assert "faculty of x" not in near("Faculty of X, Somewhere, ALMA")
    assert "department of physics" in near("Department of Physics; ALMA") and near(None) == []
    assert "department of physics" not in near("Department of Physics, Some Place; Rome, Italy; ALMA")


def test_affiliated_units(spark):
    people = [(1, ["Department of Physics, ALMA University"]), (2, ["Department of Physics, Other University"]), (3, ["School of Optics", None]), (4, None), (5, ["Department of Physics, University of Rome", "Lab, ALMA"])]
    units = [(10, ["School of Optics", "Optics"], None), (11, ["Physics Department"], ["Department of Physics"]), (12, ["Optics"], [])]
    found = affiliated_units(spark.createDataFrame(people, "per int, affs array<string>"), "per", "affs", spark.createDataFrame(units, "u int, names array<string>, near array<string>"), "u", "names", "near", r"\balma\b")
    assert {tuple(r) for r in found.collect()} == {(1, 11), (3, 10)}


def test_closest_titles_equal_all_pairs(spark):
    rnd = random.Random(9)
    titles = ["".join(rnd.choices("abcde ", k=rnd.randint(1, 60))).strip() for _ in range(150)]
    near = []
    for t in titles:
        s = list(t)
        for _ in range(rnd.randint(0, max(len(s) // 7, 1))):
            k = rnd.randrange(len(s) + 1)
            s[k : k + rnd.randint(0, 1)] = rnd.choice(["", "z", "a"])
        near.append("".join(s))
    titles = [t for t in [*titles, *titles[:5], "x" * 250, "ab" * 130] if t] + [None, ""]
    queries = list(enumerate([*near, *titles[:10], "x" * 240, "ab" * 120 + "c", "", None]))
    found = closest_titles(spark.createDataFrame(queries, "k int, q string"), "k", "q", spark.createDataFrame([(t,) for t in titles], "t string"), "t")
    want = {}
    for k, q in queries:
        close = get_close_matches(q, sorted({t for t in titles if t}), n=1, cutoff=0.9) if q else []
        if q and (q in titles or close):
            want[k] = q if q in titles else close[0]
    assert {r["k"]: r["title"] for r in found.collect()} == want
    assert len(want) > 100 and any(want[k] != q for k, q in queries if k in want)


def test_placed_titles(spark):
    works = spark.createDataFrame([(1, "one long title of a work"), (2, "twice"), (3, "twice"), (4, None)], "w int, t string")
    queries = spark.createDataFrame([(1, "one long title of a work"), (2, "one long title of a wor"), (3, "twice"), (4, "none"), (5, None)], "k int, q string")
    assert {(r[0], r[1], r[2]) for r in placed_titles(queries, "k", "q", works, "w", "t").collect()} == {(1, "exact", 1), (2, "fuzzy", 1), (3, "ambiguous", None), (4, "absent", None), (5, "absent", None)}


def plain_constrained(automatic, same, different):
    of = {}

    def top(x):
        while of.setdefault(x, x) != x:
            x = of[x]
        return x

    def unite(a, b):
        x, y = sorted((top(a), top(b)))
        of[y] = x

    for a, b in automatic:
        unite(a, b)
    verdict = {}
    for rank, a, b in sorted(same):
        x, y = top(a), top(b)
        verdict[rank] = not any({top(p), top(q)} <= {x, y} for p, q in different)
        if verdict[rank]:
            unite(a, b)
    groups = {}
    for x in of:
        groups.setdefault(top(x), set()).add(x)
    return {x: t for t, g in groups.items() if len(g) > 1 for x in g}, verdict


@pytest.mark.parametrize(("local", "n"), [(10_000, 60), (3, 12)])
def test_constrained_components_equal_a_loop(spark, local, n):
    rnd = random.Random(n)
    pair = lambda: tuple(rnd.sample(range(n), 2))
    automatic, different = [pair() for _ in range(n // 5)], [pair() for _ in range(n // 2)]
    same = [(k, *p) for k, p in enumerate({tuple(sorted(pair())) for _ in range(2 * n // 3)})]
    rnd.shuffle(same)
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))
    nodes, verdicts = constrained_components(frame(automatic, "ab"), frame(same, ["rank", "a", "b"]), frame(different, "ab"), local)
    want, judged = plain_constrained(automatic, same, different)
    assert {r["rank"]: r["accepted"] for r in verdicts.collect()} == judged and set(judged.values()) == {True, False}
    assert {r["node"]: r["component"] for r in nodes.collect()} == want


def test_a_refusal_changes_a_later_choice(spark):
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names))
    same, different = [(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 1, 4)], [(1, 3)]
    nodes, verdicts = constrained_components(frame([], "ab"), frame(same, ["rank", "a", "b"]), frame(different, "ab"))
    assert [r["accepted"] for r in verdicts.orderBy("rank").collect()] == [True, False, True, False]
    assert {tuple(r) for r in nodes.collect()} == {(1, 1), (2, 1), (3, 3), (4, 3)}
