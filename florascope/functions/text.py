"""Text expressions shared by the cleaning operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spaces, tabs and no-break spaces.
BLANK = "[ \t\u00a0]"


def trim_blanks(c: Column) -> Column:
    """Drops outer blanks (spaces, tabs, no-break spaces); null stays null."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def collapse_blanks(c: Column) -> Column:
    """Makes each run of blanks one space and drops outer ones; null stays null."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def collapse_whitespace(c: Column) -> Column:
    """Makes each run of white space (line ends too) one space and drops outer ones."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def clean_name(c: Column) -> Column:
    """Lower case, runs of blanks made one space, outer blanks dropped; empty becomes null."""
    x = collapse_blanks(F.lower(c))
    return F.when(x != "", x)
