"""Addresses that a page's line ends cut: what they can have been."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A repository's address, and signs that end a sentence and no address.
REPOSITORY = r"^(?i)https?://github\.com/[^/\s]+/[^/\s]+$"
END = "[.,;:!?)\\]}>\"'-]+$"
#: More readings than these tell nothing.
MOST = 32


def unwrapped(raw: Column) -> Column:
    """Distinct repository addresses that raw can stand for, in order; NULL if raw is NULL or has over MOST readings.

    raw may have any length and any number of breaks. A dash at a line's end is a hyphen of the address or of the break; after an underscore at a line's end
    the address ends or goes on. Readings that end early come first.
    """
    marked = F.regexp_replace(F.regexp_replace(raw, r"-\n[ \t]*", "\n-"), r"(?<=_)\n[ \t]*", "\n_")
    pieces = F.split(marked, r"\n(?=[-_])")
    none = F.array().cast("array<string>")
    start = F.struct(F.array(F.element_at(pieces, 1)).alias("open"), none.alias("ended"))

    def further(so_far: Column, piece: Column) -> Column:
        dash, rest = F.startswith(piece, F.lit("-")), F.substring(piece, F.lit(2), F.length(piece))
        both = F.flatten(F.transform(so_far["open"], lambda p: F.array(F.concat(p, rest), F.concat(p, F.lit("-"), rest))))
        on = F.transform(so_far["open"], lambda p: F.concat(p, rest))
        more = F.struct(F.when(dash, both).otherwise(on).alias("open"), F.when(dash, so_far["ended"]).otherwise(F.concat(so_far["ended"], so_far["open"])).alias("ended"))
        return F.when(F.size(so_far["open"]) + F.size(so_far["ended"]) > MOST, so_far).otherwise(more)

    # each break adds a reading or more, so pieces beyond MOST + 1 change nothing
    read = F.aggregate(F.slice(pieces, 2, MOST), start, further)
    readings = F.concat(read["ended"], read["open"])
    found = F.transform(readings, lambda u: F.regexp_replace(u, END, ""))
    valid = F.array_distinct(F.filter(found, lambda u: u.rlike(REPOSITORY)))
    return F.when((F.size(readings) <= MOST) & (F.size(pieces) <= MOST), valid)
