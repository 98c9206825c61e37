"""Tile selection."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column


def matching(name: Column, patterns: list[str]) -> Column:
    """Any pattern: a name, or the part before + as a beginning. No patterns match all."""
    if not patterns:
        return name.isNotNull()
    return reduce(or_, [name.startswith(p.partition("+")[0]) if "+" in p else name == p for p in patterns])
