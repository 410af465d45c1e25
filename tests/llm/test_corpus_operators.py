"""Each corpus operator against brute force: NULLs, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import block_naming, bpe, language_id, license_scan, minhash, packing, simhash, suffix_array, unit_dedup, url_filter

#: Columns whose names the operators use inside.
CLASHING = "row long, t string, k long, b string, h long, d long, fp long, rep long, name string, level int, s string, x string, key string"
random.seed(5)
WORDS = [f"w{k}" for k in range(400)] + ["É", "straße", "日本"]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


BASE = [prose(random.randint(60, 200)) for _ in range(8)]


def texts():
    out = [None, "", " ", "a", "A", "a" * 450, "a" * 450, "ab" * 300, "1 2 3", "!!!", prose(3000), "x" * 70_000]
    for _ in range(40):
        t = random.choice(BASE)
        out.append(t if random.random() < 0.4 else t[: len(t) // 2] + prose(20) + "\n" + random.choice(BASE)[30:])
    return out + [BASE[0].upper(), BASE[1] + "\n" + BASE[1]]


ROWS = [(k, t, "en" if k % 2 else None, *[0] * 3, "q", 1, 2, 3, 4, "n", 5, "s", "x", "y") for k, t in enumerate(texts())]
ROWS = [(r[0], r[1], r[2], 1, "t", 2, "b", 3, 4, 5, 6, "n", 7, "s", "x", "y") for r in ROWS]
ROWS += [ROWS[20], (None, BASE[0], None, *ROWS[0][3:]), (5, "another text of key five", None, *ROWS[0][3:])]
SCHEMA = f"doc_id long, text string, lang string, {CLASHING}"


@pytest.fixture
def docs(stored):
    return stored(ROWS, SCHEMA)


@pytest.fixture
def empty(stored):
    return stored([], SCHEMA, "empty")


def pairs(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def simhash_by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", ascii_lower(text))
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_simhash(docs, empty):
    fps = [simhash_by_hand(r[1]) for r in ROWS]
    found = simhash.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.fingerprint) for r in found) == Counter((r[0], f"{f:016x}") for r, f in zip(ROWS, fps, strict=True))
    label = list(range(len(fps)))
    for _ in label:
        label = [min(label[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4) for i in range(len(fps))]
    least = {x: min((ROWS[i][0] for i in range(len(fps)) if label[i] == x and ROWS[i][0] is not None), default=None) for x in label}
    assert Counter((r.doc_id, r.component_id) for r in found) == Counter((r[0], least[x]) for r, x in zip(ROWS, label, strict=True))
    assert simhash.near_duplicates(empty).count() == 0


def test_vantage_trees_lose_no_link(spark):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    x = np.unique(np.concatenate([rng.integers(0, 1 << 63, 1500, dtype=np.uint64)] + [np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, (3, 40)).astype(np.uint64), axis=0) ^ c for c in centres]))
    df = spark.createDataFrame([(int(f.view(np.int64)), k) for k, f in enumerate(x)], "fp long, rep long")
    label = np.arange(len(x))
    for a, b in sorted(simhash.near_links(df, leaf=40).collect()):
        simhash._union(label, np.array([a]), np.array([b]))
    exact = np.arange(len(x))
    simhash._union(exact, *np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4))
    assert (label == exact).all() and len(set(label)) < len(x)


def test_fold_of_equal_bands_uses_the_whole_fingerprint():
    low = np.arange(1 << 12, dtype=np.uint64) << np.uint64(43)  # one value in the first two bands
    tree = simhash.Tree(low, *simhash.BANDS[0], leaf=64)
    rows, leaf, home = tree.route(low)
    assert len(set(leaf)) > 10 and home.sum() == len(low)


def test_unit_dedup(docs, empty):
    ranked = sorted(range(len(ROWS)), key=lambda i: (ROWS[i][0] is not None, ROWS[i][0] or 0))
    seen, expected = set(), []
    for i in ranked:
        t, gone = ROWS[i][1] or "", set()
        for s, n, d in sorted(unit_dedup.units(t)):
            if d in seen:
                gone |= set(range(s, s + n))
            seen.add(d)
        left = "".join(c for k, c in enumerate(t) if k not in gone)
        expected.append((ROWS[i][0], len(t), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    found = unit_dedup.drop_repeated_units(docs, with_text=True)
    unsure = {5, 20}  # keys that repeat
    got = [x for x in pairs(found, "doc_id", "n_chars", "n_removed", "kept_sha256", "kept").elements() if x[0] not in unsure]
    assert Counter(got) == Counter(x for x in expected if x[0] not in unsure)
    assert found.count() == len(ROWS) and any(x[2] for x in got) and unit_dedup.drop_repeated_units(empty).count() == 0


def test_unit_dedup_names_the_rows_that_keep(stored):
    line, other = " ".join("abcdefgh"), " ".join("ijklmnop")
    rows = [(3, f"{line}\nshort"), (1, line.upper()), (2, f"x {other}.\n{line}"), (4, f"{other}.  {line}!"), (5, None)]
    found = {r.doc_id: (r.spans, r.repeats_of) for r in unit_dedup.drop_repeated_units(stored(rows, "doc_id long, text string")).collect()}
    assert found == {1: ("", []), 2: ("19-34", [1]), 3: ("0-15", [1]), 4: ("", []), 5: ("", [])}
    assert unit_dedup.drop_repeated_units(stored([(1, line), (1, line)], "doc_id long, text string", "twice")).where("n_removed > 0").count() == 1


def test_exact_dedup_at_any_block_size(docs, empty):
    groups = {}
    for r in ROWS:
        groups.setdefault(ascii_lower(r[1]), []).append(r[0])
    keep = {t: max((k for k in g if k is not None), default=None) for t, g in groups.items()}
    expected = Counter((r[0], keep[t], len(groups[t]), r[0] == keep[t], hashlib.sha256(t.encode()).hexdigest()) for r in ROWS for t in [ascii_lower(r[1])])
    for block in (64, 16384):
        assert pairs(block_naming.exact_duplicates(docs, block=block), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == expected
    assert block_naming.exact_duplicates(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    expected = Counter()
    for r in ROWS:
        ids = np.array([*own.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        edges = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for n, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
            expected[(r[0], n, s, e - s, zlib.crc32(ids[s:e].tobytes()))] += 1
    found = packing.packed(docs, path)
    assert pairs(found, "doc_id", "piece", "start", "length", "ids_crc32") == expected
    bins = {}
    for r in found.collect():
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.15 * sum(x[3] * n for x, n in expected.items()) / 1024 + 1
    assert packing.packed(empty, path).count() == 0


def test_minimum_bin_slack_fills_bins():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 1024) for _ in range(3000))
    plan = packing.minimum_bin_slack(dict(counts))
    used = Counter()
    for times, b in plan:
        assert sum(k * n for k, n in b.items()) <= 1024
        for k, n in b.items():
            used[k] += times * n
    assert used == counts
    assert sum(t for t, _ in plan) <= sum(k * n for k, n in counts.items()) / 1024 * 1.01 + 1
    assert sum(k * n for k, n in packing.fullest(10, {7: 1, 5: 1, 3: 1}).items()) == 10 and packing.fullest(2, {7: 1}) == {}


def test_license_scan(stored, empty):
    notice = "Licensed under the Apache License, Version 2.0."
    rows = [(1, "x\n" + notice + "\ny", 0), (2, "CC-BY cc by CC BY", 1), (3, None, 2), (4, "", 3), (5, "all rights\nreserved general public license", 4), (5, "Released under MIT License", 5), (None, "ALL RIGHTS RESERVED", 6), (7, "licensed\nunder\nthe\napache\nlicense\nversion\n2\n0", 7), (8, "é all rights reserved " * 9, 8)]
    by = {(r.doc_id, r.n_words): r for r in license_scan.scan(stored(rows, "doc_id long, text string, row long")).collect()}
    assert by[(1, 10)].labels == "apache-2.0" and by[(1, 10)].score == 1.0 and by[(1, 10)].first_word is None
    assert (by[(2, 6)].n_base, by[(2, 6)].first_word, by[(2, 6)].last_word, by[(2, 6)].labels) == (3, 0, 4, "cc-by")
    assert by[(3, 0)].labels == "" and by[(4, 0)].score == 0.0
    assert by[(5, 6)].base_labels == "gpl,reserved" and by[(5, 4)].labels == "mit" and by[(5, 4)].score == pytest.approx(0.8)
    assert by[(None, 3)].n_base == 1 and by[(7, 8)].labels == "" and (by[(8, 36)].n_base, by[(8, 36)].last_word) == (9, 33)
    assert license_scan.scan(empty).count() == 0


def test_set_join_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES for w in license_scan.template_words(t)})
    blocks = [(k, 0, sorted(set(rng.choice(license_scan.TEMPLATES)[1].lower().replace(",", "").split()[: rng.randint(1, 20)]) & set(vocabulary) | set(rng.sample(vocabulary, 2)))) for k in range(400)]
    frequency = Counter(w for b in blocks for w in b[2])
    found = license_scan.contained(spark.createDataFrame(blocks, "row long, block int, words array<string>"), frequency, license_scan.TEMPLATES, 0.8)
    expected = Counter()
    for k, _, words in blocks:
        for t, (_, notice, telling) in enumerate(license_scan.TEMPLATES):
            own = license_scan.template_words(notice)
            if len(set(own) & set(words)) >= license_scan.need(own, 0.8) and set(telling.split()) <= set(words):
                expected[(k, t, round(len(set(own) & set(words)) / len(own), 9))] += 1
    assert Counter((r[0], r[1], round(r[2], 9)) for r in found.collect()) == expected and expected


def test_minhash(docs, empty):
    rows = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for each in (2000, 7):
        found = sorted(minhash.edited_likeness(docs, rows_each=each).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
        assert len(found) == len(rows)
        by = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in found)
        expected = Counter()
        for i, r in enumerate(rows):
            t, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
            edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
            expected[(r[0], len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
        assert by == expected
        assert all(0 <= x <= 1 for r in found for x in (r.near_edited, r.near_next))
    assert minhash.edited_likeness(empty).count() == 0


def test_minhash_bands_find_every_class(docs, empty):
    sets = [set(minhash.shingles(r[1] or "").tolist()) for r in ROWS]

    def near(a, b):
        return a == b or len(a & b) >= 0.8 * len(a | b)

    label = list(range(len(ROWS)))
    for _ in label:
        label = [min(label[j] for j in range(len(ROWS)) if near(sets[i], sets[j])) for i in range(len(ROWS))]
    least = {x: min((ROWS[i][0] for i in range(len(ROWS)) if label[i] == x and ROWS[i][0] is not None), default=None) for x in label}
    assert pairs(minhash.near_duplicates(docs), "doc_id", "class_id") == Counter((r[0], least[x]) for r, x in zip(ROWS, label, strict=True))
    assert minhash.near_duplicates(empty).count() == 0


def test_minhash_near_copies_of_one_text(spark):
    base = [f"v{k}" for k in range(300)]
    rows = [(k, " ".join(base[:k] + ["other"] + base[k + 1 :])) for k in range(0, 300, 5)] + [(1000 + k, prose(60)) for k in range(5)]
    found = dict(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert {found[k] for k in range(0, 300, 5)} == {0} and all(found[1000 + k] == 1000 + k for k in range(5))


def test_minhash_estimates_jaccard():
    words = [f"v{k}" for k in range(2000)]
    a, b = " ".join(words[:1000]), " ".join(words[100:1100])
    sets = [{" ".join(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a.split(), b.split())]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(minhash.likeness(minhash.signature(a), minhash.signature(b)) - exact) < 0.12
    assert (minhash.signature("A b") == minhash.signature("a  B\n")).all() and minhash.likeness(minhash.signature(""), minhash.signature("x")) < 0.1


def test_cascade_is_exact(spark):
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 5000, 3).select(F.concat(F.lit("k"), "id").alias("key")).union(spark.sql("SELECT 'elsewhere'"))
    levels = url_filter.cascade(universe, listed)
    wrong = universe.where(url_filter.member(levels, F.col("key")) != (F.substring("key", 2, 9).cast("int") % 3 == 0))
    assert wrong.isEmpty() and len(levels) > 1 and levels[-1].bits < levels[0].bits


def test_first_level_follows_the_corpus(spark):
    assert url_filter.bits_a_key(6, 10) == 8 and url_filter.bits_a_key(6, 6 << 30) == 48
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    levels = url_filter.cascade(universe, spark.sql("SELECT explode(array('k5', 'k7', 'z')) AS key"))
    assert universe.where(url_filter.member(levels, F.col("key"))).count() == 2 and levels[0].bits <= 128


def test_a_list_beyond_a_level_is_as_exact(stored, monkeypatch):
    urls = [None, "", "http://" + "a" * 100_000 + ".example.com/x", "http://m.free-bets.example.net/a", "http://spam-farm.example.org?x", "http://ok.example.org"]
    pages = stored([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    few = [tuple(r) for r in url_filter.judge(pages, url_filter.LISTED, url_filter.RULES).orderBy("page_id").collect()]
    monkeypatch.setattr(url_filter, "MOST_BITS", 32)
    assert [tuple(r) for r in url_filter.judge(pages, url_filter.LISTED, url_filter.RULES).orderBy("page_id").collect()] == few
    assert [r[4] for r in few] == ["allow"] * 3 + ["block", "block", "allow"]
    assert url_filter.judge(stored([], "page_id long, url string", "none"), [], url_filter.RULES).count() == 0
    rows = pages.sparkSession.sql("SELECT explode(array('free-bets.example.net', 'spam-farm.example.org')) AS key")
    assert [r.verdict for r in url_filter.judge(pages, rows, url_filter.RULES).orderBy("page_id").collect()] == [r[4] for r in few]


def test_url_filter(stored):
    urls = [None, "", "no scheme", "http://a.Example.COM/en/7x?q", "http://example.com/en/6", "https://x.org/es/#f", "ftp://notcom/en/", "http://m.free-bets.example.net/a", "http://example.net/de/8/1", "http://com", "http://spam-farm.example.org?x", "a://b://c"]
    rows = [(k, u, "h", "v") for k, u in enumerate(urls)] + [(None, urls[3], "h", "v")]
    found = {r.page_id: tuple(r)[1:] for r in url_filter.judge(stored(rows, "page_id long, url string, host string, verdict string"), url_filter.LISTED, url_filter.RULES).collect()}
    assert found[0] == ("", "", None, "allow") == found[1] == found[2]
    assert found[3] == ("a.example.com", "/en/7x", "example.com/en/7", "allow") == found[None]
    assert found[4] == ("example.com", "/en/6", "com/en/", "block") and found[5] == ("x.org", "/es/", "org/es/", "block")
    assert found[6] == ("notcom", "/en/", None, "allow") and found[7] == ("m.free-bets.example.net", "/a", None, "block")
    assert found[8][2:] == ("example.net/de/8", "allow") and found[9] == ("com", "", None, "allow") and found[10][3] == "block"
    assert found[11] == ("b:", "//c", None, "allow")


def repeats_by_hand(rows, window=400):
    windows = Counter(t[p : p + window] for t in rows for p in range(len(t) - window + 1))
    out = []
    for t in rows:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - window + 1):
            if windows[t[p : p + window]] > 1:
                gone[p : p + window] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), len(suffix_array.intervals(gone)), hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("most", "window"), [(5_000, 400), (1, 400), (2, 60)])
def test_suffix_array_dedup(stored, empty, most, window, monkeypatch):
    monkeypatch.setattr(suffix_array, "MOST_STRINGS", most)
    rows = [r for r in ROWS if len(r[1] or "") < 20_000]
    for _ in range(40):  # edits within shared passages
        t = random.choice(BASE) + random.choice(BASE)
        at = random.randint(0, len(t) - 1)
        rows.append((1000 + len(rows), prose(9) + t[:at] + "Q" + t[at + 1 :], None, *ROWS[0][3:]))
    found = suffix_array.remove_repeats(stored(rows, SCHEMA), carry=("lang",), window=window)
    expected = repeats_by_hand([(r[1] or "").encode() for r in rows], window)
    assert pairs(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter((r[0], *x) for r, x in zip(rows, expected, strict=True))
    assert sum(x[1] for x in expected) > 10_000 and suffix_array.remove_repeats(empty, window=window).count() == 0


def words_by_hand(rows, window):
    """The texts without the words of repeated runs."""
    spans = [[m.span() for m in re.finditer(r"\S+", t)] for t in rows]
    words = [[t[s:e] for s, e in x] for t, x in zip(rows, spans, strict=True)]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for t, x, w in zip(rows, spans, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(x[i][0], x[i + window - 1][1]))
        out.append("".join(c for k, c in enumerate(t) if k not in gone))
    return out


@pytest.mark.parametrize("most", [5_000, 1])
def test_suffix_array_dedup_of_words(stored, empty, most, monkeypatch):
    monkeypatch.setattr(suffix_array, "MOST_STRINGS", most)
    rng = random.Random(11)
    vocabulary = [w for w in WORDS if w != "日本"]
    passages = [[rng.choice(vocabulary) for _ in range(51)] for _ in range(4)]
    texts = [None, "", "  ", "one", " ".join(vocabulary[:50])]
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 70))]
        at = rng.randint(0, len(words))
        part = passages[k % 4][rng.randint(0, 3) :] if k % 3 else []
        texts.append(rng.choice([" ", "  ", "\n"]).join([*words[:at], *part, *words[at:]]))
    rows = [(k, t) for k, t in enumerate(texts)]
    found = {r.doc_id: r.kept for r in suffix_array.remove_repeats(stored(rows, "doc_id long, text string"), with_text=True, window=50, words=True).collect()}
    expected = words_by_hand([t or "" for t in texts], 50)
    assert [found[k] for k in range(len(texts))] == expected and sum(len(t or "") - len(e) for t, e in zip(texts, expected, strict=True)) > 3_000
    assert suffix_array.remove_repeats(empty, window=50, words=True).count() == 0


def test_a_passage_of_51_short_words_goes(stored):
    passage = " ".join(["ab cde fghi jklm"] * 12 + ["end of it"])
    rows = [(k, f"start{k} {passage} stop{k}") for k in range(2)]
    assert len(passage) < 285 and len(passage.split()) == 51
    found = {r.doc_id: r.kept for r in suffix_array.remove_repeats(stored(rows, "doc_id long, text string"), with_text=True, window=50, words=True).collect()}
    assert found == {0: "start0  stop0", 1: "start1  stop1"}


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(400):
        t = [rng.randint(0, rng.choice([1, 2, 9])) for _ in range(rng.randint(0, 60))]
        assert suffix_array.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:])


def test_kept_text_drops_cut_characters(stored):
    shared = "é" * 300
    rows = [(1, "à" + shared), (2, "á" + shared)]  # the last byte of the first letters differs
    kept = {r.doc_id: r.kept for r in suffix_array.remove_repeats(stored(rows, "doc_id long, text string"), with_text=True).collect()}
    assert kept == {1: "à", 2: "á"}


def test_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc = bpe.encoding(path)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = Counter()
    for r in ROWS:
        ids = enc.encode_ordinary(r[1] or "")
        expected[(r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode()))] += 1
        assert bpe.encode(r[1], enc, 30).tolist() == ids
    assert pairs(bpe.roundtrip(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    back = bpe.decode_ids(bpe.encode_texts(docs.select("doc_id", "text", "row"), path), path)
    assert Counter(bytes(r["bytes"]) for r in back.collect()) == Counter((r[1] or "").encode() for r in ROWS)
    assert bpe.roundtrip(empty, path).count() == 0


def test_language_id_learns_only_from_what_it_may(spark, stored):
    rng = random.Random(4)
    words = {"xx": ["sha", "thor", "ing", "wh"], "yy": ["ción", "que", "ñ", "osa"], "zz": ["sch", "keit", "ung", "ß"]}
    rows = []
    for k in range(600):
        lang = rng.choice(list(words))
        out = zlib.crc32(str(k).encode()) % 3 == 1
        rows.append((k, " ".join(rng.choice(words[lang]) for _ in range(30)), rng.choice(list(words)) if out else lang, lang))
    rows += [(None, "sha thor", "yy", "xx"), (9001, None, "xx", None), (9002, "12 34 !!", "xx", None), (9003, "", None, None), (3, rows[3][1], rows[3][2], rows[3][3])]
    found = language_id.identify(stored(rows, "doc_id long, text string, lang string, source string")).collect()
    truth = {r[0]: r[3] for r in rows}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and truth[r.doc_id]]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert {r.doc_id: (r.lang_pred, r.score) for r in found if r.doc_id in (9001, 9002, 9003)} == {k: ("und", 0.0) for k in (9001, 9002, 9003)}


def test_language_id_without_labels(stored, empty):
    found = language_id.identify(stored([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert [(r.lang_pred, r.score) for r in found] == [("und", 0.0)] and language_id.identify(empty).count() == 0


def test_unit_dedup_has_no_floor_for_lines_and_counts_characters_in_sentences(stored):
    line, sentence = "and so it is", "日本語の文章は空白を含まないので長さを数える。"
    rows = [(1, f"{line}\n\nx. {sentence}"), (2, f"AND  so it is\n\n{sentence}y。"), (3, f"Some words. Here we go again. {sentence}\n{line}"), (4, "Other words. Here we go again. ok."), (5, "no. no.")]
    found = {r.doc_id: r.kept for r in unit_dedup.drop_repeated_units(stored(rows, "doc_id long, text string"), with_text=True).collect()}
    assert found[1] == rows[0][1] and found[2] == "\n\ny。" and found[3] == "Some words. Here we go again.\n"
    assert found[4] == "Other words. ok." and found[5] == "no. no."


def test_packing_gives_added_tokens_their_own_id(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|><|endoftext|> y <|endoftext", "plain"]
    found = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, with_ids=True)
    assert {r.doc_id: r.ids for r in found.collect()} == {k: [*own.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, "\t " * 1_000_000])
def test_long_runs_of_white_space(run):
    from tokenizers import Tokenizer

    enc = bpe.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for text in (run + "a b", run, "x" + run + "\x1c.", "q" * 70_000 + run[:70_000] + "\n\nb" + run + "1"):
        assert enc.decode(bpe.encode(text, enc).tolist()) == text
    # the rule that long runs follow, on runs that the library can still match
    short = run[:70_000]
    for text in (short + "a b" * 9, "x" + short, "y" + short + "\x1c.", short + "\n7"):
        assert bpe.encode(text, enc).tolist() == enc.encode_ordinary(text)
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.encode_with_added("x" + short + "a<|endoftext|>" + short, bpe.encoding(path), bpe.added_tokens(path)).tolist()
    assert found == Tokenizer.from_file(path).encode("x" + short + "a<|endoftext|>" + short, add_special_tokens=False).ids
