"""Column expressions over texts that stay in the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are; lower() does the same, faster, where there are no others."""
    only_ascii = F.length(text) == F.octet_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def strip_blanks(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def words(text: Column) -> Column:
    """The runs of characters other than blanks."""
    bare = strip_blanks(text)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK_RUN))


def lines(text: Column) -> Column:
    return F.split(text, "\n")
