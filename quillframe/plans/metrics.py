"""Counters that ride along with a plan, and levelled logging."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("quillframe")


def observed(df: DataFrame, name: str, counters: dict[str, Column] | None = None) -> tuple[DataFrame, Observation]:
    """df with counters gathered by whatever action runs it; read them with ``observation.get`` afterwards."""
    observation = Observation(name)
    return df.observe(observation, *[c.alias(n) for n, c in ({"rows": F.count(F.lit(1))} | (counters or {})).items()]), observation


def report(observation: Observation, level: int = logging.INFO) -> None:
    for name, value in observation.get.items():
        log.log(level, "%s %s", f"{name}:".ljust(24, "."), value)
