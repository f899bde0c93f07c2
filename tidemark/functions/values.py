"""Missing values, numbers out of text, units and rounding."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schema as S

def null_tokens(c: Column) -> Column:
    """The sheets' three spellings of missing become NULL."""
    return F.when(~F.trim(c).isin(*S.NULL_TOKENS), c)


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes NULL.

    A cast alone would also accept type suffixes (``1d``), hexadecimal floats
    and the words NaN and Infinity. They are told by their last letter or an
    ``x``, which costs far less per cell than matching a pattern.
    """
    text = F.trim(c)
    word = F.right(text, F.lit(1)).isin(*"dDfFnNyY") | F.contains(text, F.lit("x")) | F.contains(text, F.lit("X"))
    return F.when(~word, text.try_cast("double"))


def present(c: Column) -> Column:
    """True when a measured value exists: neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def scrub(c: Column) -> Column:
    """Strip the lab sheet's junk words."""
    return F.regexp_replace(c, S.LAB_JUNK, "")


def replace_in_order(c: Column, fixes: Sequence[tuple[str, str]]) -> Column:
    """Apply pattern replacements one after another; patterns that are plain text run as plain
    replacements, which are cheaper than regular expressions."""

    def fix(acc: Column, pair: tuple[str, str]) -> Column:
        pattern, new = pair
        plain = re.sub(r"\\([^\w])", r"\1", pattern)
        if re.escape(plain) == pattern or re.fullmatch(r"[\w ]+", pattern):
            return F.replace(acc, F.lit(plain), F.lit(new))
        return F.regexp_replace(acc, pattern, new)

    return reduce(fix, fixes, c)


def recode(c: Column, mapping: Mapping[str, str]) -> Column:
    """Exchange listed values, keep all others."""
    out = reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])), mapping.items(), F)
    return out.otherwise(c)


def note_depth(depth: Column, note: Column) -> Column:
    """The measured depth, else the number a note gives in brackets."""
    return F.coalesce(depth, to_number(F.regexp_replace(note, S.DEPTH_NOTE_JUNK, "")))


def on_bottom(note: Column) -> Column:
    """Whether a note says the disc reached weeds or the bottom; never NULL."""
    return F.coalesce(note.rlike(S.ON_BOTTOM), F.lit(False))


def on_bottom_note(flag: Column) -> Column:
    return F.when(flag, F.lit(S.ON_BOTTOM_NOTE))


def thousandth(c: Column) -> Column:
    """µg/L to mg/L."""
    return c / F.lit(1000.0)


def conductivity(ms: Column, us: Column) -> Column:
    """Conductivity in mS/cm, from µS/cm where only that was recorded."""
    return F.coalesce(ms, us / F.lit(1000.0))


def celsius(f: Column) -> Column:
    return (f - F.lit(32.0)) * F.lit(5.0) / F.lit(9.0)


def clamp_zero(c: Column) -> Column:
    """No value below zero; NULL stays NULL (``greatest`` would skip it)."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
