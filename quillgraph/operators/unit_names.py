"""Units that texts name, found without pairing names with texts."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quillgraph.functions.units import NameFinder, outermost, parts_near, plain
from quillgraph.operators.checkpoints import checkpoint

#: Bytes of names in one automaton, which is broadcast; a larger catalog takes more passes over the texts.
CATALOG_BYTES = 4_000_000


def _mapped(rows: DataFrame, text: str, field: str, each: Callable[[str | None], object]) -> DataFrame:
    """rows with ``field`` in place of text, computed value by value in Arrow batches."""
    kept = [c for c in rows.columns if c != text]
    schema = StructType([rows.schema[c] for c in kept] + _parse_datatype_string(field).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):  # so that long texts are no Python objects all at once
                part = batch.slice(k, 256)
                made = pa.array([each(t.as_py()) for t in part.column(text)], arrow[-1].type)
                yield pa.RecordBatch.from_arrays([*(part.column(c).cast(f.type) for c, f in zip(kept, arrow, strict=False)), made], schema=arrow)

    return rows.mapInArrow(run, schema)


def units_named(texts: DataFrame, key: str, text: str, names: DataFrame, unit: str, name: str, size: int = CATALOG_BYTES) -> DataFrame:
    """``(key, unit, name)``: for each row of texts the units whose names it holds; names in plain form (see functions.units.plain).

    A name counts where it stands as words, and only outside every occurrence of a longer name that stands in the text too. A name of
    several units finds them all. NULL or empty texts and names find nothing; repeated rows count once a key; other columns are not
    read. Every text is read once for each ``size`` bytes of names, whatever their number.
    """
    catalog = checkpoint(names.select(F.col(unit).alias("unit"), F.col(name).alias("raw")).where("raw IS NOT NULL").distinct())
    catalog = checkpoint(_mapped(catalog, "raw", "name string", plain).where("name <> ''").distinct())
    distinct = catalog.select("name").distinct()
    parts = -(-(distinct.agg(F.sum(F.octet_length("name"))).first()[0] or 0) // size) or 1
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("t"))
    if parts == 1:
        found = _finders(rows, distinct, "found array<string>", lambda finder, t: finder.find(t))
    else:  # all parts' occurrences of a text meet before names inside longer ones go
        rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
        distinct = checkpoint(distinct.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts))))
        met = None
        for k in range(parts):
            one = _finders(rows, distinct.where(F.col("part") == k).select("name"), "s array<struct<a:int,b:int,name:string,good:boolean>>", lambda finder, t: [(a, b, finder.names[n], good) for a, b, n, good in finder.spans(plain(t))])
            met = one if met is None else met.union(one)
        met = met.groupBy("row", "key").agg(F.flatten(F.collect_list("s")).alias("s"))
        found = _mapped(met, "s", "found array<string>", lambda s: sorted(outermost([tuple(x.values()) for x in s])))
    hits = found.select("key", F.explode("found").alias("name")).distinct()
    return hits.join(catalog, "name").select(F.col("key").alias(key), F.col("unit").alias(unit), F.col("name").alias(name)).distinct()


def _finders(rows: DataFrame, names: DataFrame, field: str, each: Callable) -> DataFrame:
    finder = rows.sparkSession.sparkContext.broadcast(NameFinder([r[0] for r in names.collect()]))
    return _mapped(rows, "t", field, lambda t: each(finder.value, t))


def affiliated_units(people: DataFrame, key: str, affiliations: str, units: DataFrame, unit: str, names: str, context: str, marker: str) -> DataFrame:
    """``(key, unit)``: the units that a person's affiliations (an array of texts) name.

    Names (arrays, in column ``names`` of units) count anywhere; those in ``context``, which foreign units bear as well, only in parts
    of an affiliation that may borrow the organisation's mark (a regular expression; see functions.units.parts_near). Names inside
    longer names that were found in the same text do not count. The catalog of units is one organisation's: CATALOG_BYTES at most, else
    ValueError. NULL arrays and texts name nothing.
    """
    if (units.agg(F.sum(F.octet_length(F.array_join(F.concat(F.coalesce(names, F.array()), F.coalesce(context, F.array())), " ")))).first()[0] or 0) > CATALOG_BYTES:
        raise ValueError("a catalog of units beyond CATALOG_BYTES; use units_named, which takes passes")
    kinds: dict[str, dict[str, set]] = {"plain": defaultdict(set), "near": defaultdict(set)}
    for u, plain_names, near_names in units.select(unit, names, context).collect():
        near = {plain(n) for n in near_names or [] if n} - {""}
        for n in near:
            kinds["near"][n].add(u)
        for n in {plain(n) for n in plain_names or [] if n} - {""} - near:
            kinds["plain"][n].add(u)
    everywhere, nearby = NameFinder(list(kinds["plain"])), NameFinder(list(kinds["near"]))
    both, mark = NameFinder([*kinds["plain"], *kinds["near"]]), re.compile(marker, re.IGNORECASE)
    shared = people.sparkSession.sparkContext.broadcast((kinds, everywhere, nearby, both, mark))

    def each(texts: list | None) -> list:
        kinds, everywhere, nearby, both, mark = shared.value
        given = [t for t in texts or [] if t]
        whole = plain(" ".join(given))
        parts = [p for t in given for p in parts_near(t, mark, both)] if nearby.names else []
        seen = {everywhere.names[k] for _, _, k, good in everywhere.spans(whole) if good}
        seen |= {nearby.names[k] for p in parts for _, _, k, good in nearby.spans(p) if good}
        out: set = set()
        for kind, texts_of in (("plain", [whole]), ("near", parts)):
            for t in texts_of:
                for n in outermost([(a, b, both.names[k], good) for a, b, k, good in both.spans(t)], seen):
                    out |= kinds[kind].get(n, set())
        return sorted(out)

    found = _mapped(people.select(F.col(key).alias("key"), F.col(affiliations).alias("t")), "t", f"unit array<{units.schema[unit].dataType.simpleString()}>", each)
    return found.select(F.col("key").alias(key), F.explode("unit").alias(unit)).distinct()
