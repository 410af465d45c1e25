"""The pipeline's stages on small tables, each against brute force on its own input."""

import random
import re

import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from quillgraph.llm import packing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k}" for k in range(90))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture
def rows():
    texts = [LONG, LONG.upper(), LONG + " tail", "other words here", "Other words here", "more and more words", None, "123", ""]
    return [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]


def test_language_stage_keeps_clean_documents(spark, stored, rows):
    out = pipeline.known_language(spark, stored(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2, 3, 4, 5] and out.columns == pipeline.COLUMNS
    unlabelled = [(k, t, None, s, n) for k, t, _, s, n in rows]
    assert sorted(r.doc_id for r in pipeline.known_language(spark, stored(unlabelled, SCHEMA, "u"), "").collect()) == [0, 1, 2, 3, 4, 5]


def test_exact_stage(spark, stored, rows):
    rows = [*rows, rows[5], (None, "only null", "en", "s", 9), (None, "only null", "en", "s", 9)]
    out = pipeline.exact_dedup(spark, stored(rows, SCHEMA), "").collect()
    best = {}
    for k, t, *_ in rows:
        best[lower(t)] = max(best.get(lower(t), -1), -1 if k is None else k)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out) == sorted(best.values())


def test_near_stage(spark, stored, rows):
    out = {r.doc_id for r in pipeline.near_dedup(spark, stored(rows, SCHEMA), "").collect()}
    fps = {k: simhash.fingerprint(t) for k, t, *_ in rows}
    group = {k: {j for j in fps if (fps[k] ^ fps[j]).bit_count() <= 4} for k in fps}
    for k in group:
        for j in set(group[k]):
            group[k] |= group[j]
    assert out == {min(g) for g in group.values()}


def test_repeat_stage(spark, stored, rows):
    out = {r.doc_id: r for r in pipeline.without_repeats(spark, stored([*rows, (50, "head " + LONG, "en", "s", 5 + len(LONG))], SCHEMA), "").collect()}
    assert 0 not in out and out[50].text == "head " and out[50].n_chars == 5 and out[3].text == "other words here"
    assert out[8].text == "" and out[6].text is None and out[2].text.endswith(" tail")


def test_run_gives_the_packed_pieces(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(found.columns)
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in pipeline.STAGES[:-1]:
        path = str(tmp_path / stage.__name__)
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
    expected = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(map(tuple, expected.select(columns).collect()))


def test_empty_corpus(spark, stored):
    docs = stored([], SCHEMA)
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, "")
        assert docs.count() == 0
        docs = stored([], SCHEMA, f"e{k}")


def test_near_stage_finds_every_near_copy_and_no_other(spark, stored):
    rng = random.Random(3)
    texts = []
    for changed in (1, 2, 3, 4, 5, 6, 8) * 4:
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(200), changed):
            copy[at] = "changed"
        texts += [" ".join(base), " ".join(copy)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for t in texts]
    label = list(range(len(texts)))
    for _ in label:
        label = [min(label[j] for j, y in enumerate(sets) if len(x & y) >= 0.8 * len(x | y)) for x in sets]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    out = {r.doc_id for r in pipeline.near_dedup(spark, stored(rows, SCHEMA), "").collect()}
    assert out == set(label) and len(texts) // 2 < len(out) < len(texts)
