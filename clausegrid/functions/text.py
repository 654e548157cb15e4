"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's \s has it; (?U) adds the Unicode spaces to Java's.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def normalised(text: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def stripped(text: Column) -> Column:
    """No white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def has_text(text: Column) -> Column:
    """Whether a character isn't white space."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def without_spaces_folded(text: Column) -> Column:
    """A title's identity: no white space, case folded."""
    return F.replace(F.lower(F.regexp_replace(text, SPACES, "")), F.lit("ß"), F.lit("ss"))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def unicode_pattern(pattern: str) -> str:
    return "(?U)" + pattern


def ordered_text(idx: str, text: str) -> Column:
    """The texts of a group by ascending ``idx``, joined by line feeds."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(idx, text))), lambda x: x[text]), "\n")


def sha_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by the unit separator; parts must not be null."""
    return F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256)


def last_path_extension(name: Column) -> Column:
    """The lower-case extension with its dot, empty if there is none (a leading dot is none)."""
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^/.][^/]*?(\.[^./\s]+)$", 1))


def occurrences(text: Column, part: Column) -> Column:
    """How often ``part`` (not empty) stands in ``text``, overlaps counted."""
    at = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))
    return F.size(F.filter(at, lambda i: F.substr(text, i, F.length(part)) == part))
