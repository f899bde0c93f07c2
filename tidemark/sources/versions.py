"""All tables of a build as one version.

``folder/versions/N`` holds the tables of build N and ``folder/_current/N`` says
that they are whole. The mark is written last and appears whole or not at all, so
readers see all tables of one build or all of the one before, and a build that
fails leaves the one before in force. A reader that has taken a version goes on
with it while later ones are built; the newest ones are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from tidemark.sources import folders

R = TypeVar("R")


def _whole(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in folders.names(spark, f"{folder}/_current") if n.isdigit())


def current(spark: SparkSession, folder: str) -> str:
    """Where the newest whole version lies; pass it to ``load_tables`` to stay with it."""
    found = _whole(spark, folder)
    if not found:
        raise FileNotFoundError(f"{folder}: no whole version")
    return f"{folder}/versions/{found[-1]}"


def publish(spark: SparkSession, folder: str, write: Callable[[str], R], keep: int = 2) -> R:
    """Let ``write`` fill the folder of a new version, then make it the current one; all but the newest ``keep`` are removed.

    The number is one above any that was ever begun, so what a failed build left
    behind is never taken for another's. One build at a time.
    """
    begun = [int(n) for n in folders.names(spark, f"{folder}/versions") if n.isdigit()]
    number = max([0, *begun, *_whole(spark, folder)]) + 1
    out = write(f"{folder}/versions/{number}")
    folders.write_whole(spark, f"{folder}/_current/{number}", "")
    kept = set(_whole(spark, folder)[-keep:])
    for old in {*begun, *_whole(spark, folder)} - kept:
        folders.remove(spark, f"{folder}/_current/{old}")
        folders.remove(spark, f"{folder}/versions/{old}")
    return out
