"""Publishing: records, templates, what players may see, and what a bundle holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The host's limit on files and the deepest zoom published.
MAX_FILES, MAX_ZOOM = 20000, 7
#: From which zoom each river tier is loaded.
TIER_MIN_ZOOM = {"big": 0, "med": 6, "small": 8}


def records(df: DataFrame, *cols: str) -> DataFrame:
    """One JSON object for each row, nulls included."""
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value"))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Placeholders replaced as fixed strings, in the order given."""
    for name, value in values.items():
        template = F.replace(template, F.lit(name), value)
    return template


def visible(df: DataFrame, hidden: str = "hidden") -> DataFrame:
    """Rows that players may see: those not marked hidden."""
    return df.filter(~F.coalesce(hidden, F.lit(False)))


def strip_hidden(features: Column) -> Column:
    """The same for an array of structs with a field ``hidden``."""
    return F.filter(features, lambda f: ~F.coalesce(f["hidden"], F.lit(False)))


def assets(html: Column) -> Column:
    """Paths that a page refers to by href or src, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit('(?:href|src)="([^"]*)"'), 1))


def relative_paths(html: Column, root: str, to: str) -> Column:
    return F.replace(html, F.lit(root), F.lit(to))


def without_blocks(html: Column, tag: str) -> Column:
    """The page without the elements named."""
    return F.regexp_replace(html, f"(?s)<{tag}\\b.*?</{tag}>", "")
