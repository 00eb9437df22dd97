"""Constant arrays built in one call.

``F.array(*[F.lit(x) ...])`` costs one py4j round trip per element; a model
with thousands of leaf values or a pivot matrix would spend seconds just
building the expression. A JSON string literal parsed by ``from_json`` is one
call, and Catalyst's constant folding evaluates it once on the driver, so the
physical plan holds a single array literal.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def const_array(values, elem_type: str = "double") -> Column:
    """Literal ``ARRAY<elem_type>`` (nested lists allowed, e.g. ``array<double>`` elements)."""
    return F.from_json(F.lit(json.dumps(list(values))), f"array<{elem_type}>")
