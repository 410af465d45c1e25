"""Candidates of near-dedup: by SimHash as well, and not by the square where parity sketches tell texts apart."""

import random

import numpy as np

import corpus_pipeline as pipeline
from quillgraph.llm import minhash, simhash


def edited(rng, base, changed):
    copy = list(base)
    for at in rng.sample(range(len(base)), changed):
        copy[at] = f"x{rng.randrange(10**9)}"
    return " ".join(copy)


def test_parity_never_shows_more_than_differs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 50, 3000, 60000):
        x = np.unique(rng.integers(0, 1 << 32, n, np.uint64))
        y = np.unique(np.concatenate((x[: len(x) * 4 // 5], rng.integers(0, 1 << 32, n // 5, np.uint64))))
        shown = int(np.bitwise_count((minhash._parity(x) ^ minhash._parity(y)).view(np.uint64)).sum())
        assert shown <= len(np.setxor1d(x, y)) and (n != 50 or shown > 12)


def test_texts_about_as_alike_as_a_copy_are_not_paired_up(spark, stored, monkeypatch):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [edited(rng, base, 1) for _ in range(30)] + [edited(rng, base, 5) for _ in range(60)]
    seen, real = [], minhash._apart
    monkeypatch.setattr(minhash, "_apart", lambda *a: seen.append(minhash.checkpoint(real(*a))) or seen[0])
    found = dict(map(tuple, minhash.near_duplicates(stored([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()))
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    label = list(range(len(texts)))
    for _ in label:
        label = [min(label[j] for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)) for x in sets]
    assert found == dict(enumerate(label))
    assert seen[0].count() <= len(texts)


def test_fingerprint_pairs_span_what_fingerprints_link(spark, stored):
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base), " ".join(base).upper(), edited(rng, base, 1), "other words", None, "", "a b c d e f"]
    docs = stored([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    label = {k: k for k in range(len(texts))}
    pairs = [tuple(r) for r in simhash.near_pairs(docs).collect()]
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert label == {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}


def test_candidates_by_fingerprint_are_taken_and_compared(spark, stored, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    other = [f"v{k}" for k in range(50)]
    texts = [" ".join(base), edited(rng, base, 2), " ".join(other), " ".join(other[:25])]
    docs = stored([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    taken, real = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda docs: taken.append(1) or real(docs).union(spark.createDataFrame([(2, 3)], "a long, b long")))
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 3] and taken
    # texts without a common band are linked if they are given as candidates and are alike, and only then
    given = spark.createDataFrame([(0, 1), (2, 3), (1, 77)], "a long, b long")
    found = dict(map(tuple, minhash.near_duplicates(docs, similarity=0.4, also=given).collect()))
    assert found == {0: 0, 1: 0, 2: 2, 3: 2}
