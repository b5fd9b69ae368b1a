"""Connected components of a link table, stored as the tables of this package are."""

from __future__ import annotations

from pyspark.sql import DataFrame

from evalloop.llm.common import cut_lineage
from evalloop.operators import components as shared


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``label``: see :func:`evalloop.operators.components.components`."""
    return shared.components(links, a, b, cut_lineage)
