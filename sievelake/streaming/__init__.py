"""Audits of sources as they arrive: the same narrow plan on a stream, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..contract import Contract
from ..operators import rules
from ..operators.parse import parse


def findings(sources: DataFrame, contract: Contract | None = None) -> DataFrame:
    """Findings of a streaming (or batch) table of sources; append mode needs no watermark."""
    return rules.findings(rules.audited(parse(sources), contract or Contract()))
