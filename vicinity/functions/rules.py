"""Predicates on quantised vectors, the decision, and the formulas of a load test's score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K = 5


def _at(v: Column, i: int) -> Column:
    return F.get(v, F.lit(i))


# Thresholds in quantised space; they mean what they say under the standard constants.
LEGIT_MOST = {0: 500, 2: 500, 1: 2500, 8: 2500, 7: 500}
LEGIT_RISKS = (1500, 2000, 2500, 3000)
FRAUD_LEAST = {0: 5000, 1: 4167, 8: 3000, 7: 1500}
FRAUD_RISKS = (7500, 8000, 8500)


def obviously_legit(v: Column) -> Column:
    out = _at(v, 12).isin(*LEGIT_RISKS) & (_at(v, 11) == 0)
    for i, most in LEGIT_MOST.items():
        out = out & (_at(v, i) <= most)
    return out


def obviously_fraud(v: Column) -> Column:
    out = _at(v, 12).isin(*FRAUD_RISKS) & (_at(v, 11) == 10000)
    for i, least in FRAUD_LEAST.items():
        out = out & (_at(v, i) >= least)
    return out


def borderline(v: Column) -> Column:
    return ~obviously_legit(v) & ~obviously_fraud(v)


def edge_case(v: Column) -> Column:
    """An unknown merchant of a risky category."""
    return (_at(v, 11) == 10000) & (_at(v, 12) >= 7500)


def fraud_score(count: Column) -> Column:
    return count / F.lit(5.0)


def approved(count: Column) -> Column:
    return count < 3


def response(count: Column) -> Column:
    """The response body."""
    return F.to_json(F.struct(approved(count).alias("approved"), fraud_score(count).alias("fraud_score")))


def weighted_errors(fp: Column, fn: Column, err: Column) -> Column:
    return fp + 3 * fn + 5 * err


def p99_score(p99_ms: Column) -> Column:
    return (
        F.when(p99_ms <= 0, F.lit(0.0))
        .when(p99_ms > 2000, F.lit(-3000.0))
        .otherwise(F.lit(1000.0) * F.log10(F.lit(1000.0) / F.greatest(p99_ms, F.lit(1.0))))
    )


def detection_score(errors: Column, failures: Column, n: Column) -> Column:
    rate = errors.cast("double") / n
    return F.when(failures / n > 0.15, F.lit(-3000.0)).otherwise(
        F.lit(1000.0) * F.log10(F.lit(1.0) / F.greatest(rate, F.lit(0.001))) - F.lit(300.0) * F.log10(F.lit(1.0) + errors)
    )
