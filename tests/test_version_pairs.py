"""Buckets of pairs of records: one case for each rule and for what looks like it."""

import datetime

import pytest

from quillgraph.functions.version_titles import fold_title, title_facts
from quillgraph.operators import version_pairs

SCHEMA = "id long, title string, type string, doi string, venue string, venue_type string, date date, year int, abstract string, authors array<string>"
BASE = "Adaptive observers for uncertain nonlinear systems"


def rec(title, type="article", doi=None, venue=None, on=None, year=None, abstract=None, authors=("x", "y"), venue_type=None):  # noqa: A002
    return title, type, doi, venue, venue_type, datetime.date.fromisoformat(on) if on else None, year, abstract, list(authors) if authors is not None else None


# name: (first record, second record, bucket, which is the notice or cover)
CASES = {
    "notice": (rec(BASE), rec(f"Author Correction: {BASE}"), "ERRATUM", 1),
    "publisher": (rec(f"Publisher's Note: “{BASE}”"), rec(BASE), "ERRATUM", 0),
    "suffix": (rec(BASE), rec(f"{BASE} (Erratum)"), "ERRATUM", 1),
    "for with a colon": (rec(BASE), rec(f"Correction for: {BASE}"), "ERRATUM", 1),
    "notice of retraction": (rec(BASE), rec(f"Notice of retraction: {BASE}"), "ERRATUM", 1),
    "retracted": (rec(f"Retracted: {BASE}"), rec(BASE), "ERRATUM", 0),
    "type alone": (rec(BASE), rec(BASE, type="erratum"), "ERRATUM", 1),
    "close wording": (rec(f"Erratum to: {BASE} with delay", type="erratum"), rec("Adaptive observers for nonlinear uncertain systems with delays"), "ERRATUM", 0),
    "about a third": (rec("Erratum: Optical properties of quasicrystals in strong fields"), rec(BASE), None, None),
    "short subject": (rec("Correction to: Introduction", type="erratum"), rec("Introduction to deep learning for spectroscopy"), None, None),
    "word bounds": (rec("Erratum: Graph networks traffic prediction"), rec("Hypergraph networks traffic prediction for urban mobility under sparse sensor coverage"), None, None),
    "correction of": (rec("Correction of chromatic aberration in wide imaging lenses", on="2020-01-01"), rec("Correction of chromatic aberrations in wide imaging lenses", on="2020-06-01"), "STRONG_FUZZY", None),
    "correction-based": (rec("Correction-based approach to robust estimation in grids", on="2020-01-01"), rec("Correction-based approach to robust estimation for grid", on="2020-06-01"), "STRONG_FUZZY", None),
    "cover": (rec(BASE), rec(f"Front Cover: {BASE}"), "COVER", 1),
    "cover art": (rec(f"Cover Art: {BASE}"), rec(BASE), "COVER", 0),
    "cover image": (rec(f"Front cover image: {BASE}"), rec(BASE), "COVER", 0),
    "issue": (rec(BASE), rec(f"{BASE} (Adv. Mater. 13/2022)"), "COVER", 1),
    "paratext": (rec(BASE), rec(BASE, type="paratext"), "COVER", 1),
    "rubric": (rec(BASE, venue="Small"), rec(f"Control Theory: {BASE}", venue="small"), "COVER", 1),
    "rubric elsewhere": (rec(BASE, venue="Small"), rec(f"Control Theory: {BASE}", venue="Large", on="2020-01-01"), "MEDIUM_FUZZY", None),
    "parts": (rec(f"{BASE}. Part I"), rec(f"{BASE}. Part II"), "SERIES_NOT_VERSION", None),
    "part two": (rec(f"{BASE}. Part One"), rec(f"{BASE}. Part Two"), "SERIES_NOT_VERSION", None),
    "one volume": (rec("Symmetry in Chemistry"), rec("Symmetry in Chemistry: Volume 2"), "SERIES_NOT_VERSION", None),
    "bare": (rec("Cliques in hats game. I"), rec("Cliques in hats game. II"), "SERIES_NOT_VERSION", None),
    "hash": (rec("Lecture notes #2 on optimal control"), rec("Lecture notes #3 on optimal control"), "SERIES_NOT_VERSION", None),
    "sections": (rec("Disturbance observers in use. I. Methods"), rec("Disturbance observers in use. II. Applications"), "SERIES_NOT_VERSION", None),
    "section and part": (rec("Transfer processes in liquid media of the beer industry. 2. Flow"), rec("Transport processes in liquid media of beer industry. Part 3. Heat"), "SERIES_NOT_VERSION", None),
    "other series": (rec("Prospects for the compressor industry. Part 2. Science"), rec("Human colour perception: a review of concepts. Part 1"), None, None),
    "number once": (rec("Spread model for the pandemic of COVID-19", doi="10.1101/2020.1", on="2020-04-01"), rec("Spread model for the pandemic of COVID", doi="10.1/b", on="2021-01-01"), "PREPRINT_PUBLISHED", None),
    "deposit": (rec(BASE), rec(f"Additional file 1 of {BASE}"), "SUPPLEMENT_OR_REVIEW", None),
    "deposit of another": (rec("Genetic algorithm for inferring history"), rec("Data from: Giraffe genome supports four species"), None, None),
    "same title": (rec(BASE, doi="10.1/a"), rec(BASE + ".", doi="10.1/b"), "MISSED_BY_NORM", None),
    "look-alike letter": (rec(BASE.replace("observers", "оbservers"), doi="10.1/a"), rec(BASE, doi="10.1/b"), "MISSED_BY_NORM", None),
    "releases": (rec(BASE, doi="10.1/a", type="software"), rec(BASE, doi="10.1/b", type="software"), None, None),
    "sibling": (rec(BASE, doi="10.7/e.8"), rec(BASE + ": revision", doi="10.7/e.8.2"), "DOI_SIBLING", None),
    "component": (rec(BASE, doi="10.7/e.8"), rec("Input distributions used in the simulation", doi="10.7/e.8.v1", type="dataset"), "SUPPLEMENT_OR_REVIEW", None),
    "preprint": (rec(BASE + " and delays", venue="arXiv", type="preprint", on="2020-01-01"), rec(BASE + " with delay", on="2021-01-01"), "PREPRINT_PUBLISHED", None),
    "not osf": (rec(BASE + " and delays", venue="Journal of Biosfera", on="2020-01-01"), rec(BASE + " with time delays", on="2020-09-01"), "STRONG_FUZZY", None),
    "translation": (rec(BASE + " and delays", venue="Письма"), rec(BASE + " with delay", venue="Letters"), "RU_EN_TRANSLATION", None),
    "medium": (rec("Method of joint clustering in network correlation spaces", on="2020-06-24"), rec("Method for joint clustering in graph correlation spaces", on="2021-12-01"), "MEDIUM_FUZZY", None),
    "too far apart": (rec("Method of joint clustering in network correlation spaces", year=2010), rec("Method for joint clustering in graph correlation spaces", year=2021), None, None),
    "unrelated": (rec("Optical properties of icosahedral quasicrystals"), rec("A survey of learning for protein structure"), None, None),
    "front matter": (rec("List of Contributors", doi="10.1/a"), rec("List of Contributors", doi="10.1/b"), None, None),
    "nulls": (rec(None, type=None, authors=None), rec(BASE, type=None, authors=None), None, None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(2 * k + s, *case[s]) for k, case in enumerate(CASES.values()) for s in (0, 1)]
    records = version_pairs.read_records(spark.createDataFrame(rows, SCHEMA))
    pairs = spark.createDataFrame([(2 * k, 2 * k + 1) for k in range(len(CASES))], "a long, b long")
    return version_pairs.classified(pairs, records).persist()


def test_every_case_has_its_bucket(found):
    got = {r.a // 2: (r.bucket, None if r.first is None else r.first % 2) for r in found.collect()}
    wrong = {name: got.get(k, (None, None)) for k, (name, case) in enumerate(CASES.items()) if got.get(k, (None, None)) != case[2:]}
    assert not wrong


def test_routes_of_doubtful_pairs(spark, found):
    row = found.where("bucket = 'MEDIUM_FUZZY'")
    a, b = row.first()[:2]
    from pyspark.sql import functions as F

    def route(verdict, **changed):
        v = spark.createDataFrame([(a, b, verdict)], "a long, b long, same_work boolean")
        return version_pairs.routed(row.withColumns({k: F.lit(x) for k, x in changed.items()}), v).first().route

    extended = F.array(F.lit("conference"), F.lit("journal"))
    assert route(False, split=True) == route(False, abstract_sim=0.5) == "MEDIUM_FUZZY_STRONG"
    assert (route(None), route(True), route(False)) == ("MEDIUM_FUZZY", "MEDIUM_FUZZY_LLM_SAME", "MEDIUM_FUZZY_RELATED")
    assert version_pairs.routed(row.withColumn("kinds", extended), spark.createDataFrame([(a, b, False)], "a long, b long, same_work boolean")).first().route == "MEDIUM_FUZZY_CONF_JOURNAL"
    other = version_pairs.routed(found.where("bucket = 'COVER'"), spark.createDataFrame([], "a long, b long, same_work boolean"))
    assert {r.route for r in other.collect()} == {"COVER"}


def test_folding_and_facts():
    assert fold_title("The Structure of α-Helices: Über ²H") == "structure helices uber 2h"
    assert fold_title(None) == "" and title_facts(None, None)["generic"]
    assert title_facts("Correction for motion artifacts", "article")["notice"] is None
    assert title_facts("x: y", None)["ruled"] is None and title_facts("xy: z w", None)["ruled"] == "z w"
