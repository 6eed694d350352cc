"""Report labels: statuses, markers, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIRMED_RATE_PERCENT = 66.7


def loss_status(loss_percent: Column, verification_failed: Column) -> Column:
    """An unverified zero is its own status and is never shown as OK."""
    return (
        F.when(verification_failed, "UNVERIFIED").when(loss_percent == 0, "OK")
        .otherwise("DATA LOSS")
    )


def significance_marker(p: Column) -> Column:
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")
    )


def lead_verdict(rate_percent: Column) -> Column:
    return (
        F.when(rate_percent >= CONFIRMED_RATE_PERCENT, "Confirmed")
        .when(rate_percent > 0, "Partial").otherwise("Not confirmed")
    )


def end_to_end_verdict(primary_loss: Column, other_loss: Column) -> Column:
    """PASS only if the primary side lost nothing and the other side could be measured."""
    return F.when((primary_loss == 0) & other_loss.isNotNull(), "PASS").otherwise("FAIL")


def empty_to_unknown(value: Column) -> Column:
    return F.when(value == "", "unknown").otherwise(value)
