"""Two-sided 95 % Student-t bounds as plain column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema as S

EPS = 2.220446049250313e-16


def tail_coefficients(z: float = S.Z_975) -> tuple[float, ...]:
    """Coefficients of 1/df … 1/df**5 in the normal expansion of the t quantile."""
    return (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
        (27 * z**11 + 339 * z**9 + 930 * z**7 - 1782 * z**5 - 765 * z**3 + 17955 * z) / 368640,
    )


def t_quantile(df: str) -> Column:
    """The 0.975 quantile for an integer column: tabulated to 30, expanded beyond."""
    table = ", ".join(f"{v}D" for v in S.T_975)
    tail = "0D"
    for c in reversed(tail_coefficients()):
        tail = f"({tail} + {c!r}D) / {df}"
    return F.expr(
        f"CASE WHEN {df} BETWEEN 1 AND {len(S.T_975)} THEN get(array({table}), CAST({df} - 1 AS INT))"
        f" WHEN {df} > {len(S.T_975)} THEN {S.Z_975!r}D + {tail} END"
    )


def t_bounds(n: str, mean: str, variance: str) -> tuple[Column, Column]:
    """Lower and upper bound of the mean; NULL below two values or when they barely differ.

    The arguments name columns; ``variance`` is the sample variance. The values
    count as constant when the standard error is under ten machine epsilons of
    the mean.
    """
    se = F.expr(f"sqrt({variance} / {n})")
    usable = F.expr(f"{n} > 1") & (se > 0) & (se >= F.expr(f"{10 * EPS!r}D * abs({mean})"))
    half = t_quantile(f"({n} - 1)") * se
    return F.when(usable, F.col(mean) - half), F.when(usable, F.col(mean) + half)
