"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as white space at the ends of a text.
SPACE = r"[\s   -     　﻿]"


def stripped(value: Column) -> Column:
    """Text without white space at either end; NULL when nothing is left."""
    text = F.regexp_replace(value, f"^{SPACE}++|{SPACE}++$", "")
    return F.when(text != "", text)


def first_text(*values: Column) -> Column:
    """First value that has text in it."""
    return F.coalesce(*[stripped(v) for v in values])


def slug(value: Column, limit: int = 80) -> Column:
    """Lower-case ASCII words joined by hyphens, for file names."""
    plain = F.translate(
        F.lower(value),
        "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ",
        "aaaaaaceeeeiiiinooooouuuuyy",
    )
    joined = F.regexp_replace(plain, r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(joined, r"^-+|-+$", ""), 1, limit)
