"""Category label parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import pyregex as rx

# Fixed values (must equal the reference): separators in priority order and the
# category tokens that are dropped.
SEPARATORS = ["/", ",", ";", "|"]
DROPPED = ["", "n/a", "null", "none", "n", "a"]
DEFAULT_CATEGORY = "general"


def parse_categories(label: Column) -> Column:
    """split on the first separator present (only that one), strip, drop
    null-like tokens; nothing left -> ["general"]."""
    parts = F.array(rx.strip(label))
    for sep in reversed(SEPARATORS):
        parts = F.when(F.instr(label, sep) > 0, F.split(label, "\\" + sep, -1)).otherwise(parts)
    kept = F.filter(F.transform(parts, rx.strip),
                    lambda c: (c != "") & ~F.lower(c).isin(*DROPPED))
    return (F.when(F.coalesce(label, F.lit("")) == "", F.array(F.lit(DEFAULT_CATEGORY)))
            .when(F.size(kept) == 0, F.array(F.lit(DEFAULT_CATEGORY)))
            .otherwise(kept))


def primary_category(categories: Column) -> Column:
    """F4"""
    return F.element_at(categories, 1)


def categories_parsed(categories: Column) -> Column:
    """F5"""
    return F.array_join(categories, ", ")
