"""Expressions that make results readable as text: levels of surprise, heat maps, bars, fixed-width cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from taleloom.functions import text as T

#: Shades from nothing to full, and upper bounds of the levels of surprise in bits.
SHADES = " ░▒▓█"
LEVELS = (1.0, 2.5, 4.0, 6.0, 9.0)
#: Terminal colours of the levels.
COLOURS = (34, 40, 190, 220, 208, 196)


def surprise_level(bits: Column) -> Column:
    """0 for what was foreseen up to 5 for what was not; a null stays null."""
    return reduce(lambda level, bound: level + (bits >= bound).cast("int"), LEVELS, F.lit(0))


def painted(token: Column, bits: Column, colour: bool = True) -> Column:
    """A token with its blanks made visible, in the colour of its level if that is wanted."""
    shown = T.visible(token)
    if not colour:
        return shown
    code = F.element_at(F.array(*map(F.lit, COLOURS)), surprise_level(bits) + 1)
    return F.concat(F.lit("\033[38;5;"), code.cast("string"), F.lit("m"), shown, F.lit("\033[0m"))


def shades(weights: Column) -> Column:
    """A row of a heat map: one shade for each weight between 0 and 1."""
    place = lambda w: F.least(F.greatest(F.floor(w * len(SHADES)), F.lit(0)), F.lit(len(SHADES) - 1)).cast("int")
    return F.array_join(F.transform(weights, lambda w: F.substring(F.lit(SHADES), place(w) + 1, F.lit(1))), "")


def cell(value: Column, width: int, right: bool = True) -> Column:
    """A value cut or filled up to a width."""
    return (F.lpad if right else F.rpad)(F.coalesce(value.cast("string"), F.lit("-")), width, " ")
