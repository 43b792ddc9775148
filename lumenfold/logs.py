"""Logging of a run, and counters that Spark observes while a stage runs."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation

NOISY = ("py4j", "pyspark", "urllib3")


def configure(level: str = "INFO") -> None:
    """Plain log lines at ``level``; chatty libraries only warn."""
    logging.basicConfig(level=level.upper(), format="%(asctime)s %(levelname)s %(name)s: %(message)s", force=True)
    for name in NOISY:
        logging.getLogger(name).setLevel(logging.WARNING)


def progress(logger: logging.Logger, action: str, index: int, total: int, every: int = 20) -> bool:
    """Logs each ``every``-th step and the last one; says whether it did."""
    due = total > 0 and (index == total or index % every == 0)
    if due:
        logger.info("%s: %d of %d", action, index, total)
    return due


def observed(df: DataFrame, counters: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with counters that are filled while it is written, without a job of their own."""
    watch = Observation()
    return df.observe(watch, *[c.alias(n) for n, c in counters.items()]), watch
