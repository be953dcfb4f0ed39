"""Normal forms of keys, labels and hashes, as Catalyst expressions and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label domains of the data model.
DOCUMENT_TYPES = (
    "national_id",
    "passport",
    "residence_permit",
    "driving_license",
    "other",
    "none",
)
DOCUMENT_SIDES = ("front", "back", "n/a", "unknown")
UNKNOWN_COUNTRY = "unknown"

BLANKS = " \t\n\r "


def strip(c: Column) -> Column:
    """Without surrounding blanks, tabs and line ends."""
    return F.btrim(c, F.lit(BLANKS))


def key_text(c: Column) -> Column:
    """A key that is the same whatever its letter case and surrounding blanks."""
    return F.lower(strip(c))


def document_type(c: Column) -> Column:
    """Taxonomy spelling of a document type; NULL for labels outside the taxonomy."""
    spelt = F.regexp_replace(key_text(c), "[- ]", "_")
    return F.when(spelt.isin(*DOCUMENT_TYPES), spelt)


def issuing_country(c: Column) -> Column:
    """Two capital letters or `unknown`; NULL for anything else."""
    spelt = F.upper(strip(c))
    return F.when(spelt == "UNKNOWN", F.lit(UNKNOWN_COUNTRY)).when(
        spelt.rlike("^[A-Z]{2}$"), spelt
    )


def hash_text(c: Column) -> Column:
    """A hash without letter case, surrounding blanks and a notation in front."""
    bare = strip(F.regexp_replace(key_text(c), "^(sha256:|0x)", ""))
    return F.when(bare != "", bare)


def fingerprint(c: Column, digits: int = 64) -> Column:
    """A hex fingerprint of fixed length, leading zeros restored; NULL if it is none."""
    bare = hash_text(c)
    return F.when(
        bare.rlike(f"^[0-9a-f]{{1,{digits}}}$"), F.lpad(bare, digits, "0")
    )


def sql_strip(c: str) -> str:
    return f"trim({c}, chr(32)||chr(9)||chr(10)||chr(13)||chr(160))"


def sql_key(c: str) -> str:
    return f"lower({sql_strip(c)})"


def sql_document_type(c: str) -> str:
    spelt = f"regexp_replace({sql_key(c)}, '[- ]', '_', 'g')"
    return f"CASE WHEN {spelt} IN {DOCUMENT_TYPES} THEN {spelt} END"


def sql_country(c: str) -> str:
    spelt = f"upper({sql_strip(c)})"
    return (
        f"CASE WHEN {spelt} = 'UNKNOWN' THEN 'unknown' "
        f"WHEN regexp_full_match({spelt}, '[A-Z]{{2}}') THEN {spelt} END"
    )


def sql_hash(c: str) -> str:
    return f"nullif({sql_strip(f"regexp_replace({sql_key(c)}, '^(sha256:|0x)', '')")}, '')"


def sql_fingerprint(c: str, digits: int = 64) -> str:
    bare = sql_hash(c)
    return (
        f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{1,{digits}}}') "
        f"THEN lpad({bare}, {digits}, '0') END"
    )
