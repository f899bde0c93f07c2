"""Parameter labels from the fixed table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema as S


def parameter_label(parameter: Column, units: Column, with_unit: bool = True) -> Column:
    """Label of a parameter; NULL when the table has none for it (or not in that unit)."""
    out = F
    for name, unit, label, bare in S.PARAMETER_LABELS:
        hit = parameter == name
        if unit is not None:
            hit = hit & (units == unit)
        out = out.when(hit, F.lit(label if with_unit else bare))
    return out.otherwise(F.lit(None).cast("string"))


def label_of(parameter: str) -> str | None:
    """The label of a plain argument."""
    return next((label for name, _, label, _ in S.PARAMETER_LABELS if name == parameter), None)


def location_name(location: Column) -> Column:
    out = F
    for code, name in S.LOCATIONS:
        out = out.when(location == code, F.lit(name))
    return out.otherwise(location)
