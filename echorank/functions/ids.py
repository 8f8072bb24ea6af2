"""Item identifiers: normalisation, writer-side ids, class labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Characters an id must not contain, and the media suffixes that
# keep their dot in a written id.
ID_NOISE = ";., "
BRACKETS = "[]"
MEDIA_SUFFIXES = ("mp3", "aiff", "aif", "au", "m4a", "wav", "flac", "ogg")

_SUFFIX_PATTERN = "|".join(MEDIA_SUFFIXES)


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_id(path, strip_brackets: bool = False) -> Column:
    """The join key of an item: its path without ``; . , space`` (and ``[ ]``)."""
    noise = ID_NOISE + (BRACKETS if strip_brackets else "")
    return F.translate(as_column(path), noise, "")


def normalize_id_text(path: str, strip_brackets: bool = False) -> str:
    """``normalize_id`` for a query argument held on the driver."""
    noise = ID_NOISE + (BRACKETS if strip_brackets else "")
    return path.translate(str.maketrans("", "", noise))


def file_id(path, compat: bool = False) -> Column:
    """The id a feature writer puts in front of a line.

    Dots, semicolons and commas go, the media suffix gets its dot back. With
    ``compat`` the dot is inserted before every occurrence of a suffix, also
    inside words, as feature files in circulation have it.
    """
    bare = F.translate(as_column(path), ".;,", "")
    if not compat:
        return F.regexp_replace(bare, f"({_SUFFIX_PATTERN})$", ".$1")
    return reduce(lambda text, suffix: F.replace(text, F.lit(suffix), F.lit("." + suffix)), MEDIA_SUFFIXES, bare)


def repair_delimiter(line) -> Column:
    """Leave ``;`` only behind the media suffix that ends the id."""
    commas = F.translate(as_column(line), "; ", ",")
    return F.regexp_replace(commas, rf"\.({_SUFFIX_PATTERN}),", r".$1;")


def class_label(path, by: str = "directory") -> Column:
    """Class of an item: its parent directory, or the text before the first dot."""
    path = as_column(path)
    if by == "directory":
        return F.trim(F.try_element_at(F.split(F.translate(path, "\\", "/"), "/"), F.lit(-2)))
    if by == "prefix":
        return F.substring_index(path, ".", 1)
    raise ValueError(f"unknown class rule: {by}")
