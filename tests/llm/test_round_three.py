"""Operators 11 to 13 against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from quillgraph.llm import decontamination, periodic_runs, prefix_trie

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- 11 ---------------------------------------------------------------------------------------------------------------


def plain_contaminated(docs, items, window=10):
    phrases = defaultdict(set)
    for item, text in items:
        words = WORD.findall(lowered(text))
        length = min(window, len(words))
        for k in range(len(words) - length + 1 if words else 0):
            phrases[tuple(words[k : k + length])].add(item)
    out = []
    for key, text in docs:
        words, hit, met = WORD.findall(lowered(text)), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(words) - n + 1):
                if (p := tuple(words[k : k + n])) in phrases:
                    hit |= set(range(k, k + n))
                    met |= {str(i) for i in phrases[p] if i is not None}
        out.append((key, len(words), hit, sorted(met)))
    return out


def contaminated_rows(df, key="doc_id"):
    rows = [(r[key], r["n_words"], {k for s in r["spans"] for k in range(s["start"], s["end"])}, list(r["items"])) for r in df.collect()]
    for r in df.collect():
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    return rows


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sorted(r[2])))


@pytest.mark.parametrize("block", [4_000_000, 40])
def test_contaminated_equals_a_loop(spark, block):
    rnd = random.Random(3)
    vocabulary = ["A", "b", "ß", "c1", "dé", "E"]
    text = lambda n: rnd.choice(["", "  ", "-"]).join([""]) + rnd.choice([" ", "\n", ". "]).join(rnd.choices(vocabulary, k=n))
    docs = [(k % 23 or None, text(rnd.randint(0, 60))) for k in range(60)] + [(5, None), (6, ""), (7, "a b"), (7, "a b"), (8, "... !"), (9, " ".join(["a"] * 500))]
    items = [(k, text(n)) for k, n in enumerate([0, 1, 3, 5, 5, 7, 9])] + [(None, "ß ß"), (3, "E e"), (99, None), (5, "c1 dé b")]
    d = spark.createDataFrame([(k, t, "x", 0) for k, t in docs], "doc_id bigint, text string, spans string, row int")
    b = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id bigint, text string, items string")
    want = by_key(plain_contaminated(docs, items, 4))
    for size in (4_000_000, 50):  # whole shards, and texts cut into pieces
        assert by_key(contaminated_rows(decontamination.contaminated(d, b, window=4, size=size, block=block))) == want


def test_contaminated_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert contaminated_rows(decontamination.contaminated(d, b)) == [(1, 3, set(), [])]
    assert contaminated_rows(decontamination.contaminated(d.limit(0), b)) == []


def test_a_text_of_several_megabytes_is_searched_whole(spark):
    text = "x y z w v u " * 400_000 + "Deep in THE very-last part there lies one test phrase of many words"
    d = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "deep in the very last part there lies one test phrase of many")], "item_id bigint, text string")
    r = decontamination.contaminated(d, b, size=500_000).collect()[0]
    assert (r["n_words"], r["items"]) == (2_400_000 + 14, ["7"])
    assert [(s["start"], s["end"]) for s in r["spans"]] == [(2_400_000, 2_400_013)]


def test_op11_on_whole_texts(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {k: (n, len(hit), len(met), sha(",".join(met)), bool(hit)) for k, n, hit, met in plain_contaminated(docs, items)}
    got = {r["doc_id"]: tuple(r)[1:] for r in decontamination.op11_decontamination(spark, SF).collect()}
    assert got == want and any(x[4] for x in want.values())


# --- 12 ---------------------------------------------------------------------------------------------------------------


def plain_trie(sequences):
    """{(depth, conv): (parent, n, children, leaves, saved, digest)} of {conv: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    for p, m in members.items():
        ends = sorted(c for c in m if len(sequences[c]) == len(p))
        out[len(p), min(m)] = (min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(",".join(map(str, ends))))
    return out


def plain_sequences(rows):
    """{conv: [(role, text)]}; no equal turn numbers of one conversation."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in out.items()}


def plain_rebuilt(sequences):
    out = {}
    for c, own in sequences.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = sequences.get(c - c % 5, [])[:h] + own[h:]
    return out


def nodes(df):
    rows = df.collect()
    found = {(r["depth"], r["conv_id"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(found) == len(rows)
    return found


CONVS = "conv_id bigint, turn bigint, role string, text string, depth int, c int"


def made_conversations():
    rnd = random.Random(8)
    rows = []
    for c in range(120):
        n = 0 if c % 40 == 3 else rnd.randint(1, 6)
        copy = c % 3 == 0
        for k in range(5 if copy else n):
            role, text = ("u", f"t{k}") if copy else (rnd.choice(["u", None, ""]), rnd.choice(["t0", "t1", "ü", "", None]))
            rows.append((c, None if k == 0 and c % 7 == 0 else k * 700, role, text, 0, 0))
    rows += [(500, k, "u", "t0", 0, 0) for k in range(90)] + [(501, k, "u", "t0", 0, 0) for k in range(90)] + [(None, 1, "u", "lost", 0, 0)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("local", [4, 60, 100_000])
def test_trie_equals_a_loop(spark, local):
    rows = made_conversations()
    want = plain_trie(plain_sequences([r[:4] for r in rows]))
    assert nodes(prefix_trie.conversation_trie(spark.createDataFrame(rows, CONVS), local=local)) == want


@pytest.mark.parametrize("rows", [[], [(4, 1, "u", "a")], [(4, 1, "u", "a"), (4, 2, None, None)], [(1, 0, "u", "x"), (2, 0, "u", "x")], [(None, 1, "a", "b")]])
@pytest.mark.parametrize("local", [1, 1000])
def test_small_tries(spark, rows, local):
    want = plain_trie(plain_sequences(rows)) if [r for r in rows if r[0] is not None] else {}
    assert nodes(prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), local=local)) == want


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(1, 0, "u", "x"), (1, 0, "u", "x"), (2, 0, "u", "x")]
    got = nodes(prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))
    assert got == plain_trie({1: [("u", "x"), ("u", "x")], 2: [("u", "x")]})


@pytest.mark.parametrize("local", [64, prefix_trie.LOCAL])
def test_rebuilt_conversations_of_the_table(spark, local):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = plain_trie(plain_rebuilt(plain_sequences([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])))
    assert nodes(prefix_trie.conversation_trie(table, edit=prefix_trie.rebuilt, local=local)) == want
    if local == prefix_trie.LOCAL:
        assert nodes(prefix_trie.op12_prefix_trie(spark, SF)) == want


def test_rebuilt_without_a_base_may_be_turnless(spark):
    rows = [(c, k, "u", f"{c}-{k}") for c in (1, 2, 3, 4, 6, 10, 11) for k in range(2)]
    want = plain_trie(plain_rebuilt(plain_sequences(rows)))
    got = nodes(prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), edit=prefix_trie.rebuilt))
    assert got == want


# --- 13 ---------------------------------------------------------------------------------------------------------------


def plain_runs(words, least=12):
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q) and j > i:
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, p) for (s, length), p in out.items())


def plain_op13(key, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (key, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("least", [2, 5, 12, 40])
def test_word_runs_equal_a_loop(least):
    rnd = random.Random(least)
    for _ in range(400):
        letters, words = rnd.choice([1, 2, 3, 5, 50]), []
        while len(words) < rnd.randint(0, 200):
            if rnd.random() < 0.5:
                words += [rnd.randrange(letters) for _ in range(rnd.randint(1, 20))]
            else:
                unit = [rnd.randrange(letters) for _ in range(rnd.randint(1, 25))]
                words += (unit * 6)[: rnd.randint(len(unit), 5 * len(unit))]
        assert periodic_runs.word_runs(words, least, rnd.choice([7, 1 << 18])) == plain_runs(words, least)


def test_long_periodic_texts():
    assert periodic_runs.word_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic_runs.word_runs([*range(100_000)] * 2) == [(0, 200_000, 100_000)]
    assert periodic_runs.word_runs(["a", "b", "b"] * 50_000 + ["c"]) == [(0, 150_000, 3)]


def test_op13_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(map(tuple, periodic_runs.op13_periodic_runs(spark, SF).collect()))
    assert got == sorted(plain_op13(k, t) for k, t in docs)


def test_op13_edge_cases(spark):
    rows = [(None, "a b " * 20), (1, None), (2, ""), (3, " \x0b\n"), (4, "x " * 30), (4, "x " * 30), (5, "a b c " * 4 + "é f " * 13), (6, "w")]
    d = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id bigint, text string, n_words int, runs int")
    want = [(k, len((t or "").encode().split()), plain_runs((t or "").encode().split())) for k, t in rows]
    got = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]]) for r in periodic_runs.periodic_runs(d).collect()]
    assert got == want
    assert periodic_runs.periodic_runs(d.limit(0)).collect() == []
