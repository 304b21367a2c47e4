"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The basic block of Han characters; other scripts are given as another character class.
HAN = r"[一-鿿]"


def has_script(text: Column, script: str = HAN) -> Column:
    """Whether a text holds a character of the script; false for null."""
    return F.coalesce(text.rlike(script), F.lit(False))


def strip(text: Column) -> Column:
    """White space of any kind off both ends (plain trim takes blanks only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def truncated(text: Column, most: int, keep: int | None = None) -> Column:
    """At most ``most`` characters, a longer text cut to ``keep`` (else ``most``) and an ellipsis."""
    return F.when(F.char_length(text) > most, F.concat(F.left(text, F.lit(most if keep is None else keep)), F.lit("..."))).otherwise(text)


def cell_id(number: Column) -> Column:
    return F.format_string("Cell_%03d", number)


def cell_number(name: Column) -> Column:
    """The number at the end of a cell's name, by which names are ordered."""
    return F.element_at(F.split(name, "_"), -1).cast("int")


def rgb(color: Column) -> dict[str, Column]:
    """A packed colour as three shares of 255."""
    part = lambda n: F.shiftright(color, n).bitwiseAND(255) / F.lit(255.0)
    return {"r": part(16), "g": part(8), "b": part(0)}


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))
