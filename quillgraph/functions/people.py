"""What a name, label or profile says: column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quillgraph.functions.names import unmix
from quillgraph.functions.text import EMAIL

# Fixed values.
NOT_A_PERSON = r"(?i)\b(collaboration|consortium|group|team|university|institute|laboratory|committee)\b"
SCRAPED = r"(?i)^(cookies|sign in|access (denied|options)|javascript is)"
PROFILES = {"scholar": "scholar.google.", "github": "github.com/", "scopus": "scopus.com/", "researcher_id": "webofscience.com/"}


@F.pandas_udf(StringType())
def unmixed(c: pd.Series) -> pd.Series:
    """Each word in the one alphabet most of its letters are of."""
    return c.map(unmix, na_action="ignore")


def not_a_person(name: Column) -> Column:
    return F.coalesce(name.rlike(NOT_A_PERSON), F.lit(False))


def several_people(name: Column) -> Column:
    """Whether a name joins full names of several people: each part of two words or more."""
    parts = F.transform(F.split(name, r"\s*(?:;|&|\band\b)\s*"), lambda p: F.trim(p))
    return F.coalesce((F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(r"^\S+\s+\S")), F.lit(False))


def profile_kind(url: Column) -> Column:
    out = F.lit("homepage")
    for kind, part in reversed(PROFILES.items()):
        out = F.when(F.contains(F.lower(url), F.lit(part)), kind).otherwise(out)
    return F.when(url.isNotNull(), out)


def label(surname: Column, given: Column, public: Column) -> Column:
    """Surname and initial, or the initial letters alone where a person may not be shown."""
    initial = F.concat(F.upper(F.substring(given, 1, 1)), F.lit("."))
    return F.when(public, F.concat_ws(" ", surname, F.when(given != "", initial))).otherwise(F.concat_ws(" ", F.concat(F.substring(surname, 1, 1), F.lit(".")), F.when(given != "", initial)))


def public_abstract(c: Column) -> Column:
    """An abstract without addresses; NULL where it is a scraped page."""
    return F.when(~F.coalesce(c.rlike(SCRAPED), F.lit(False)), F.trim(F.regexp_replace(c, EMAIL, "")))


def group_name(c: Column) -> Column:
    """A group's name from its title: lower case letters, digits and single dashes; NULL if none is left or it is over 40 long."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when((name != "") & (F.length(name) <= 40), name)


# Words that name a group or an event, and addresses; accounts of tools.
NO_PERSON_SLOT = r"(?i)\b(?:association|conference|proceedings|workshop|committee|consortium|collaborat\w*|society)\b|\S+@\S+|\bhttps?://|\bwww\."
TOOL_LOGIN = r"(?i)\[bot\]$|^dependabot|^github-actions|^renovate|^web-flow$"


def no_person_slot(name: Column) -> Column:
    """Whether an author slot holds a group, an event or an address; false for NULL."""
    return F.coalesce(name.rlike(NO_PERSON_SLOT), F.lit(False))


def personal_account(login: Column, kind: Column) -> Column:
    """Whether an account is a person's: it has a login that is no tool's, and its kind is not known or user. False for NULL logins."""
    own = (login != "") & ~login.rlike(TOOL_LOGIN)
    return F.coalesce(own & (F.lower(F.coalesce(kind, F.lit("user"))) == "user"), F.lit(False))
