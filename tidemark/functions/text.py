"""Keys, capitalisation and display text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_names(names: Sequence[str]) -> list[str]:
    """Snake-case column names; repeats get ``_2``, ``_3`` … and a bare number gets an ``x``."""
    seen: dict[str, int] = {}
    out = []
    for raw in names:
        s = raw.replace("%", " percent ").replace("#", " number ").replace("µ", "m").replace("μ", "m")
        s = re.sub(r"([a-z])([A-Z])", r"\1_\2", s)
        s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
        s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower() or "x"
        if s[0].isdigit():
            s = "x" + s
        seen[s] = seen.get(s, 0) + 1
        out.append(s if seen[s] == 1 else f"{s}_{seen[s]}")
    return out


def build_key(*parts: Column) -> Column:
    """Join parts with underscores; a missing part is written ``NA``."""
    return F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("NA")) for p in parts])


def key_head(k: Column) -> Column:
    """Text before the last underscore, or the whole key if there is none."""
    return F.regexp_replace(k, "^(.*)_.*$", "$1")


def key_tail(k: Column) -> Column:
    """Text after the last underscore, or the whole key if there is none."""
    return F.regexp_replace(k, "^.*_(.*)$", "$1")


def split_key(key: str) -> tuple[str, str]:
    """``key_head`` and ``key_tail`` of a plain argument such as ``tp_surf``."""
    head, sep, tail = key.rpartition("_")
    return (head, tail) if sep else (key, key)


def name_part(c: Column, i: int) -> Column:
    """The i-th (0-based) underscore-separated part of a name, NULL if missing."""
    return F.get(F.split(c, "_"), F.lit(i))


def capitalise(c: Column) -> Column:
    """First letter of each space-separated word upper, the rest lower; then the three position
    words also behind brackets, slashes and hyphens."""
    s = F.initcap(F.lower(c))
    for w in ("lower", "upper", "middle"):
        s = F.regexp_replace(s, w, w.capitalize())
    return s


def station_count_text(n: Column) -> Column:
    return (
        F.when(n == 1, F.concat(n.cast("string"), F.lit(" station")))
        .when(n > 1, F.concat(n.cast("string"), F.lit(" stations")))
        .otherwise(F.lit("no stations"))
    )


def unit_of_label(label: Column) -> Column:
    """The text in a label's closing brackets; a label without any is returned whole."""
    return F.regexp_replace(label, r"^.*\((.*)\)$", "$1")


def title(name: Column, id_: Column) -> Column:
    return F.concat(name, F.lit(" ("), id_, F.lit(")"))


def plain_number(val: Column, digits: int = 2) -> Column:
    """A number with at most that many decimals, no trailing zeros and no exponent."""
    shown = F.regexp_replace(F.format_string(f"%.{digits}f", F.round(val, digits)), r"\.?0+$", "")
    return F.when(val.isNotNull(), shown)


def hover_region(name: Column, id_: Column, val: Column, stations: Column) -> Column:
    """Hover text of a region: ``NAME (ID), Value: 1.23, 4 stations``."""
    return F.concat(title(name, id_), F.lit(", Value: "), plain_number(val), F.lit(", "), stations)


def hover_station(waterbody: Column, station: Column, val: Column) -> Column:
    return F.concat(waterbody, F.lit(" "), station, F.lit(", Value: "), plain_number(val))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def year_range_text(first: Column, last: Column) -> Column:
    return F.concat_ws(" to ", F.year(first).cast("string"), F.year(last).cast("string"))
