"""MinHash fingerprints: universal hash permutations over word shingles, in numpy."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import map_texts, table, where_marked
from quillgraph.operators.components import checkpoint, connected_components
from quillgraph.operators.skew import join_counted, join_dealt

WORDS, PERMUTATIONS, SEED = 5, 128, 1
_RANDOM = np.random.Generator(np.random.PCG64(SEED))
#: Multiply-shift: (a x + b) mod 2^64, upper half, is a universal family for 32-bit x.
_A = _RANDOM.integers(0, 1 << 64, PERMUTATIONS, np.uint64) | np.uint64(1)
_B = _RANDOM.integers(0, 1 << 64, PERMUTATIONS, np.uint64)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """32-bit hashes, as uint64, of the runs of ``words`` words (A-Z lowered, split at ASCII white space).

    Fewer words make one shingle, none make none.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(zlib.crc32, parts), np.uint64, len(parts))
    words = min(words, len(parts))
    mixed = np.full(len(parts) - words + 1, words, np.uint64)
    for k in range(words):
        mixed = (mixed + each[k : k + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed >> np.uint64(32)


def signature(text: str | None, words: int = WORDS) -> np.ndarray:
    """The least 16-bit prefix under each permutation, as big-endian uint16; all ones for a text without words."""
    x = shingles(text or "", words)
    least = np.full(PERMUTATIONS, np.uint64((1 << 64) - 1))
    for k in range(0, len(x), 512):
        np.minimum(least, (_A[:, None] * x[None, k : k + 512] + _B[:, None]).min(axis=1), out=least)
    return ((least >> np.uint64(32)) & np.uint64(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of permutations with equal minima: an estimate of the shingle sets' Jaccard similarity."""
    return float((a == b).mean())


def _with_next(docs: DataFrame, key: str, text: str, rows_each: int) -> DataFrame:
    """``(k, t, b, lends)``: a partition for each range b of keys, sorted by falling key, NULL keys last.

    The rows of each range's largest key are sent to the range above as well, where they come last and lend
    their text; the first range's go to the last. The driver sees range bounds and those keys only.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.coalesce(text, F.lit("")).alias("t"))
    n = rows.count()
    parts = min(10_000, max(1, n // rows_each))
    points = rows.select(F.percentile_approx("k", [i / parts for i in range(1, parts)], 50 * parts)).first()[0] if parts > 1 else []
    cuts = np.array(sorted(set(points or [])), np.int64)

    def place(k: pa.Array) -> np.ndarray:
        known = k.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return len(cuts) - np.searchsorted(cuts, known)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(place(b.column("k")))], ["k", "b"])

    tops = {r["b"]: r["m"] for r in rows.select("k").mapInArrow(ranges, "k bigint, b bigint").groupBy("b").agg(F.max("k").alias("m")).collect()}
    filled = sorted(tops)
    above = {x: filled[i - 1] for i, x in enumerate(filled)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, at = b.column("k"), place(b.column("k"))
            lent = [i for i, (x, y) in enumerate(zip(k.to_pylist(), at.tolist(), strict=True)) if tops[y] == x]
            row = pa.array(np.concatenate((np.arange(len(at)), np.array(lent, np.int64))))
            to = np.concatenate((at, np.array([above[y] for y in at[lent].tolist()], np.int64)))
            lends = pa.array(np.arange(len(to)) >= len(at))
            yield pa.RecordBatch.from_arrays([k.take(row), b.column("t").take(row), pa.array(to), lends], ["k", "t", "b", "lends"])

    dealt = rows.mapInArrow(deal, "k bigint, t string, b bigint, lends boolean")
    return dealt.repartitionById(len(cuts) + 1, F.col("b").cast("int")).sortWithinPartitions("lends", F.col("k").desc_nulls_last(), "t")


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, rows_each: int = 2000) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last floor(n_chars / 2) code points give way to the first as many of the next text
    by falling key (of the first one after the last). Returns key, n_chars, edited_sha256,
    fingerprint, edited_fingerprint (hex of 128 minima of 16 bits), near_edited, near_next. NULL
    counts as empty; texts without a word are like each other and nothing else. Keys are integers;
    rows with NULL keys come last and repeated keys follow one another by text. A single row is its own next.
    rows_each: rows of a key range to aim at. Other columns of docs are not read.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for k, t, lends in zip(b.column("k").to_pylist(), b.column("t").to_pylist(), b.column("lends").to_pylist(), strict=True):
                s = signature(t, words) if last or not lends else None
                if last:
                    own, was, sig = last
                    half = len(was) // 2
                    edited = was[: len(was) - half] + t[:half]
                    other = signature(edited, words)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((own, len(was), digest, sig.tobytes().hex(), other.tobytes().hex(), likeness(sig, other), likeness(sig, s)))
                last = None if lends else (k, t, s)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "k bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _with_next(docs, key, text, rows_each).select("k", "t", "lends").mapInArrow(compare, schema).withColumnRenamed("k", key)


#: Bands of so many minima: of texts at 0.8 similarity, 1 in 20,000 pairs shares none.
BANDS, BAND = 25, 5
SIMILARITY = 0.8
#: Members of a bucket that meet the whole bucket in one group.
PART = 2000


def _name(shingle_set: np.ndarray) -> bytes:
    return hashlib.sha256(shingle_set.tobytes()).digest()[:16]


#: Texts at 0.8 similarity differ in 24 of the 128 sketch parts, give or take 4.4; in over FAR, once in a million.
FAR = 46


def _sketch(signature: np.ndarray) -> np.ndarray:
    """The four low bits of each minimum, in eight longs."""
    bits = np.unpackbits(signature.astype(np.uint8)[:, None], axis=1)[:, 4:]
    return np.frombuffer(np.packbits(bits.ravel()).tobytes(), np.int64)


def _unlike(a: str, b: str) -> Column:
    """How many parts of four bits of two sketches differ."""
    total = F.lit(0)
    for k in range(8):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for n in (1, 2):  # a part's bits to its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


#: Bits of a parity sketch.
ODD = 4096


def _parity(shingle_set: np.ndarray) -> np.ndarray:
    """For each of ODD places, whether an odd number of shingles falls there, in longs: no more bits of two sets differ than shingles do."""
    bits = np.bincount((shingle_set % ODD).astype(np.int64), minlength=ODD) & 1
    return np.frombuffer(np.packbits(bits.astype(np.uint8)).tobytes(), np.int64)


def _apart(placed: DataFrame, scored: DataFrame, sets: DataFrame, bands: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of a bucket that are in two classes, were not compared with its lead and can have the similarity.

    The lead is a vantage point: Jaccard distance is a metric, so two members whose distances from it differ by more than a
    link's are no link; nor are two whose sketches are far apart, or whose parity sketches show more differing shingles than a link may have
    (a bound that always holds). And what two members share is at most what either of them shares with any others at all. A pair
    comes from the first band that both have. Members outside the lead's class are dealt out in parts of PART, each of which
    meets the whole bucket.
    """
    member = placed.join(classes, placed["rep"] == classes["node"], "left").select("h", "i", "lead", "rep", "size", F.coalesce("component", "rep").alias("class"))
    of_lead = F.max(F.when(F.col("rep") == F.col("lead"), F.col("class"))).alias("main")
    mixed = member.groupBy("h").agg(of_lead, F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("rows")).where("low < high").select("h", "main", "rows")
    member = checkpoint(join_counted(member, mixed, ["h"], "rows").where("lead <> rep"))
    reps = checkpoint(member.select("rep").distinct())
    shingle = sets.join(reps, "rep").select("rep", F.explode("x").alias("s"))
    own = shingle.groupBy("s").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("own"))
    about = reps.join(bands, "rep").join(sets.select("rep", "odd"), "rep").join(own, "rep", "left")
    about = checkpoint(about.select("rep", "bands", "sketch", "odd", F.coalesce("own", F.lit(0)).alias("own")))
    member = member.withColumns({"a": F.least("lead", "rep"), "b": F.greatest("lead", "rep")}).join(scored.select("a", "b", "far"), ["a", "b"], "left").drop("a", "b", "lead")
    member = member.join(about, "rep").withColumn("most", F.col("size") - F.col("own")).where(F.col("most") >= similarity * F.col("size"))
    member = checkpoint(member.select("h", "i", "main", "class", "rep", "size", "most", "far", "bands", "sketch", "odd"))
    outside = member.where("class <> main").groupBy("h").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("n"))
    each = ("rep", "size", "class", "most", "far", "bands", "sketch", "odd")
    a = join_counted(member.where("class <> main"), outside, ["h"], "n").select("h", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), *[F.col(c).alias(f"{c}_a") for c in each])
    met = join_counted(member, member.groupBy("h").agg(F.count("*").alias("n")).join(outside.select("h", "parts"), "h"), ["h"], "n")
    b = met.select("h", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "main", "i", *[F.col(c).alias(f"{c}_b") for c in each])
    once = (F.col("class_a") != F.col("class_b")) & ((F.col("class_b") == F.col("main")) | (F.col("rep_a") < F.col("rep_b")))
    fits = F.least("size_a", "size_b") >= similarity * F.greatest("size_a", "size_b")
    able = F.least("most_a", "most_b") >= similarity / (1 + similarity) * (F.col("size_a") + F.col("size_b")) - 1e-6
    near = F.coalesce(F.abs(F.col("far_a") - F.col("far_b")) <= 1 - similarity + 1e-9, F.lit(True))
    near = near & (_unlike("sketch_a", "sketch_b") <= FAR)
    differ = F.aggregate(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    near = near & (differ <= (1 - similarity) / (1 + similarity) * (F.col("size_a") + F.col("size_b")) + 1e-6)
    before = F.lit(False)
    for k in range(BANDS - 1):
        before = before | ((F.col("i") > k) & (F.get("bands_a", F.lit(k)) == F.get("bands_b", F.lit(k))))
    return a.join(b, ["h", "part"]).where(once & fits & able & near & ~before).select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS, also: DataFrame | None = None) -> DataFrame:
    """``(key, class_id)``: the smallest key that links reach; texts of that Jaccard similarity of shingles or more link.

    Texts with equal shingle sets are one representative. Representatives that share a signature band are
    candidates: each against its bucket's lead first, the member whose bands' buckets are the largest (the text that
    most others were copied from has most of its bands in common with them), and then each two of a
    bucket that no chain of links has joined yet, so a large group of near copies is not paired up in full and still loses no link. A
    link counts if the sets of 32-bit shingle hashes have that similarity. NULL counts as empty; texts without a
    word are one class. Rows with a NULL key take their representative's class (NULL if it has no key). Empty input, empty result.
    docs is read several times. also: more candidates, as pairs of keys; a key that rows of several texts share stands for one of them.
    """

    def describe(texts: list) -> tuple:
        sets = [np.unique(shingles(t or "", words)) for t in texts]
        bands, sketches = [], []
        for t in texts:
            least = signature(t, words)
            sketches.append(_sketch(least))
            parts = (hashlib.blake2b(least[k * BAND : (k + 1) * BAND].tobytes(), digest_size=8, person=bytes([k])).digest() for k in range(BANDS))
            bands.append(np.frombuffer(b"".join(parts), np.int64))
        return None, [[_name(x) for x in sets], [len(x) for x in sets], bands, sketches]

    def contents(texts: list) -> tuple:
        sets = [np.unique(shingles(t or "", words)) for t in texts]
        return None, [[_name(x) for x in sets], [x.astype(np.uint32).view(np.int32) for x in sets], [_parity(x) for x in sets]]

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    found = checkpoint(map_texts(rows, "t", "name binary, size int, bands array<bigint>, sketch array<bigint>", describe))
    # partially aggregated, so that the copies of one text need not meet
    reps = checkpoint(found.groupBy("name").agg(F.min("key").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("n")))
    one = reps.where("rep IS NOT NULL")
    placed = one.select("rep", "size", F.posexplode("bands").alias("i", "h"))
    full = placed.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h", "c", F.col("c").alias("n"))
    placed = checkpoint(join_counted(placed, full, ["h"], "n"))
    placed = placed.join(placed.groupBy("rep").agg(F.sum("c").alias("weight")), "rep")
    lead = F.max_by(F.struct(F.col("rep").alias("lead"), F.col("size").alias("lead_size")), F.struct("weight", F.xxhash64("rep"), "rep"))
    leads = placed.groupBy("h").agg(lead.alias("v"), F.count("*").alias("n")).select("h", "v.*", "n")
    placed = checkpoint(join_counted(placed.select("rep", "size", "i", "h"), leads, ["h"], "n"))
    met, ends = None, placed.select("rep")
    if also is not None:
        also = checkpoint(also.toDF("a", "b"))
        ends = found.join(also.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi").select("key", "name")
        of = checkpoint(join_counted(ends, one.select("name", "rep", "n"), ["name"], "n").groupBy("key").agg(F.min("rep").alias("rep")))
        met = join_dealt(also, of.toDF("a", "x"), ["a"], ["b"])
        met = join_dealt(met, of.toDF("b", "y"), ["b"], ["a"], counted=also).where("x <> y")
        met = checkpoint(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        ends = placed.select("rep").union(met.select(F.explode(F.array("a", "b"))))
    named = ends.distinct().join(one.select("rep", "name"), "rep")
    wanted = checkpoint(where_marked(rows.withColumn("row", F.col("key")), named.select(F.col("rep").alias("row"))))
    sets = map_texts(wanted.select("key", "t"), "t", "name binary, x array<int>, odd array<bigint>", contents)
    sets = checkpoint(sets.join(named, (sets["key"] == named["rep"]) & (sets["name"] == named["name"])).select("rep", sets["name"], "x", "odd").dropDuplicates(["rep", "name"]).select("rep", "x", "odd"))

    def score(pairs: DataFrame) -> DataFrame:
        pairs = checkpoint(pairs.distinct())
        left = join_dealt(pairs, sets.select(F.col("rep").alias("a"), F.col("x").alias("xa")), ["a"], ["b"])
        sides = join_dealt(left, sets.select(F.col("rep").alias("b"), F.col("x").alias("xb")), ["b"], ["a"], counted=pairs)
        shared = F.size(F.array_intersect("xa", "xb"))
        sides = sides.select("a", "b", shared.alias("shared"), (F.size("xa") + F.size("xb") - shared).alias("all"))
        return checkpoint(sides.select("a", "b", (1 - F.col("shared") / F.col("all")).alias("far"), (F.col("shared") >= similarity * F.col("all")).alias("linked")))

    fits = F.least("size", "lead_size") >= similarity * F.greatest("size", "lead_size")
    first = placed.where((F.col("lead") != F.col("rep")) & fits).select(F.least("lead", "rep").alias("a"), F.greatest("lead", "rep").alias("b"))
    scored = score(first if met is None else first.union(met))
    led = scored.where("linked").select("a", "b")
    more = score(_apart(placed, scored, sets, one.select("rep", "bands", "sketch"), connected_components(led, "a", "b"), similarity))
    classes = connected_components(led.union(more.where("linked").select("a", "b")), "a", "b")
    named = reps.join(classes, reps["rep"] == classes["node"], "left").select("name", F.coalesce("component", "rep").alias("class_id"), "n")
    return join_counted(found.select("key", "name"), named, ["name"], "n").select(F.col("key").alias(key), "class_id")


def op7_minhash_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
