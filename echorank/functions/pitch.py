"""Notes and keys: encoding and transposition."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .ids import as_column

# Pitch classes counted from A, and the flats that name them too.
PITCHES = ("A", "A#", "B", "C", "C#", "D", "D#", "E", "F", "F#", "G", "G#")
FLATS = {"Ab": "G#", "Gb": "F#", "Eb": "D#", "Db": "C#", "Bb": "A#"}


def encode_pitches(text) -> Column:
    """``[10, 11, 0]`` → ``[KLA]``: one letter A..L per pitch, brackets stay."""
    two_digit = F.replace(F.replace(as_column(text), F.lit("10"), F.lit("K")), F.lit("11"), F.lit("L"))
    return F.translate(two_digit, "0123456789, ", "ABCDEFGHIJ")


def encode_pitch_array(notes) -> Column:
    """The letters of an ``ARRAY<INT>`` of pitches."""
    return F.array_join(F.transform(as_column(notes), lambda n: F.char(n + 65)), "")


def key_index(key) -> Column:
    """0 for A … 11 for G#; an unknown key is an error."""
    key = as_column(key)
    steps = {name: i for i, name in enumerate(PITCHES)}
    steps |= {flat: steps[sharp] for flat, sharp in FLATS.items()}
    table = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("unknown key: "), F.coalesce(key, F.lit("NULL")))).cast("int")
    return F.coalesce(F.try_element_at(table, key), unknown)


def transpose_notes(key, notes) -> Column:
    """Shift pitches so that ``key`` becomes A."""
    index = key_index(key)
    return F.transform(as_column(notes), lambda n: F.pmod(n - index, F.lit(12)))


def transpose_chroma(key, chroma) -> Column:
    """Rotate the 12 rows of a row-major chroma matrix so that ``key`` becomes A."""
    chroma = as_column(chroma)
    cut = key_index(key) * (F.size(chroma) / 12).cast("int")
    return F.concat(F.slice(chroma, cut + 1, F.size(chroma) - cut), F.slice(chroma, F.lit(1), cut))
