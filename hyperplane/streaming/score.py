"""A stream of rows (id, x) scored against a fixed model: stateless, so any trigger and output mode that appends will do."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.kernels import Kernel
from ..operators.gram import scores


def score_stream(stream: DataFrame, support: DataFrame, kernel: Kernel, rho: float = 0.0) -> DataFrame:
    """(id, score, pred) of a streaming DataFrame; the support rows (id, x, y, alpha) must fit a broadcast."""
    return scores(stream, support, kernel, rho)
