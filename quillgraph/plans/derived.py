"""Richer records over the graph's tables: names, identifiers, links. One definition serves Spark and the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.plans import registry
from quillgraph.sources.graph import SQL, tables


def pick(key: str, values: list[str | None]) -> str:
    """One of the values by an integer, as SQL."""
    quoted = ["NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values]
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(quoted)) + " END"


#: name: (table, {column: expression}).
DERIVED = {
    "people": ("persons", {
        "per": "per", "did": "CASE WHEN per % 13 <> 0 THEN did END", "internal": "internal",
        "surname": pick("per", ["Иванов", "Петрова", "Ли", "", None, "Cмирнов", "Кузнецо́в", "Sidorov"]),
        "first": pick("per", ["Анна", "Пётр", "И.", "", None]),
        "second": pick("per", ["Ивановна", "", None, "Петрович"]),
        "latin": pick("per", ["Ivanov", "Petrova", "L", "Li", "Oz", None, "Smirnova"]),
        "given": pick("per", ["Anna", "Pyotr", "I.", "A", None]),
        "orcid": "CASE WHEN per % 3 = 0 THEN '0000-0001-' || CAST(per % 40 AS VARCHAR(9)) END",
        "key": "CASE WHEN per % 2 = 0 THEN 'orcid_' ELSE 'name_' END || CAST(per % 60 AS VARCHAR(9))",
        "login": "CASE WHEN per % 4 = 1 THEN 'user' || CAST(per AS VARCHAR(9)) END",
        "email": pick("per", ["ivanov@example.org", "noreply@example.org", None, "a.petrova@example.org", "12+x@users.noreply.example.com"]),
    }),
    "works": ("publications", {
        "pid": "pid", "title": "title", "type": "type", "year": "year", "cents": "cents", "venue": "venue",
        "abstract": "CASE WHEN pid % 10 = 0 THEN NULL WHEN pid % 10 = 1 THEN '' ELSE title END",
        "doi": "CASE WHEN pid % 4 = 0 THEN '10.1000/' || CAST(pid % 700 AS VARCHAR(9)) END",
        "has_code": "pid % 3 = 0",
    }),
    "wrote": ("authorship", {"pid": "pid", "per": "per", "position": "position", "affiliation": "CASE (pid + per) % 6 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'x' END"}),
    "code": ("repositories", {
        "rid": "rid", "stars": "stars", "owner": "CASE WHEN rid % 8 <> 0 THEN owner END",
        "url": "CASE rid % 9 WHEN 0 THEN 'ftp://host/' || CAST(rid AS VARCHAR(9)) WHEN 1 THEN 'https://GitHub.com/o/R' || CAST(rid - rid % 2 AS VARCHAR(9)) WHEN 2 THEN 'https://github.com/o/r' || CAST(rid - rid % 2 AS VARCHAR(9)) || '/' ELSE 'https://github.com/o/r' || CAST(rid AS VARCHAR(9)) END",
    }),
    "links": ("repo_pubs", {
        "pid": "pid", "rid": "rid", "url": "'https://github.com/o/r' || CAST(rid AS VARCHAR(9))",
        "relevant": "CASE (pid + rid) % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END",
    }),
    "units": ("departments", {"did": "did", "dname": "dname", "native": pick("did", ["Кафедра", "", None]), "variants": "CASE WHEN did % 4 <> 0 THEN dname END"}),
}
DERIVED_SQL = SQL + "".join(f", {name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {of})\n" for name, (of, columns) in DERIVED.items())


def derived(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    base = tables(spark, sf_dir)
    return base | {name: base[of].select(*[F.expr(e).alias(c) for c, e in columns.items()]) for name, (of, columns) in DERIVED.items()}


def derived_query(sql: str | None = None):
    """Register a function of the graph's and the derived tables; sql follows their definition."""

    def put(f: Callable[[dict[str, DataFrame]], DataFrame]):
        registry.QUERIES[f.__name__] = lambda spark, sf_dir: f(derived(spark, sf_dir))
        if sql:
            registry.ORACLE[f.__name__] = DERIVED_SQL + sql
        return f

    return put
