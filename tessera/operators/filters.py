"""Metadata filters, applied before scoring so that a search returns its full k."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import FILTER_KEYS


class InvalidFilter(ValueError):
    """A filter names keys that do not exist."""


def build_filter(filters: dict[str, Any] | None) -> Column | None:
    """A condition over columns tenant, ticker, section, fiscal_year, document_id, tags, is_narrative and filing_date.

    Lists mean any of their values (an empty list: none), None means no condition, False
    is a value, `item` is another name of section, tags match if any is shared, and rows
    without a date fall out of a date range.
    """
    filters = filters or {}
    if unknown := sorted(set(filters) - set(FILTER_KEYS)):
        raise InvalidFilter(f"unknown filter keys: {unknown}")
    found = []
    for key, value in filters.items():
        name = "section" if key == "item" else key
        if value is None:
            continue
        if key == "tags":
            if value:
                found.append(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in value])))
        elif key == "date_after":
            found.append(F.col("filing_date") >= F.lit(value).cast("timestamp")) if value else None
        elif key == "date_before":
            found.append(F.col("filing_date") <= F.lit(value).cast("timestamp")) if value else None
        elif isinstance(value, list):
            found.append(F.col(name).isin(*value) if value else F.lit(False))
        else:
            found.append(F.col(name) == F.lit(value))
    out = None
    for f in found:
        out = f if out is None else out & f
    return out


def validate_request(query: str, top_k: int = 5, ef_search: int | None = None) -> None:
    """Bounds of a search request."""
    if not 1 <= len(query) <= 4000:
        raise ValueError("query must have 1 to 4000 characters")
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be from 1 to 50")
    if ef_search is not None and not 4 <= ef_search <= 4096:
        raise ValueError("ef_search must be from 4 to 4096")
