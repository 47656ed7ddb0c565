"""Rates, logits and pair weights, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Rates are clipped to [EPS, 1 - EPS] before a logit.
EPS = 1e-6


def rate(clicks: Column, impressions: Column, keep_null: bool = False) -> Column:
    """clicks / impressions; division by zero gives 0, or null on request."""
    value = F.try_divide(clicks.cast("double"), impressions.cast("double"))
    return value if keep_null else F.coalesce(value, F.lit(0.0))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return F.ln(p / (1 - p))


def jeffreys(clicks: Column, impressions: Column) -> Column:
    """The posterior mean of a rate under a Beta(1/2, 1/2) prior."""
    return (clicks + 0.5) / (impressions + 1.0)


def weight_diff(ctr_a: Column, ctr_b: Column) -> Column:
    return F.abs(ctr_a - ctr_b)


def weight_logit(ctr_a: Column, ctr_b: Column) -> Column:
    return F.abs(logit(ctr_a) - logit(ctr_b))


def weight_beta(clicks_a: Column, impressions_a: Column, clicks_b: Column, impressions_b: Column) -> Column:
    gap = logit(jeffreys(clicks_a, impressions_a)) - logit(jeffreys(clicks_b, impressions_b))
    return F.abs(gap) * sqrt_least_impressions(impressions_a, impressions_b)


def sqrt_least_impressions(impressions_a: Column, impressions_b: Column) -> Column:
    return F.sqrt(F.least(impressions_a, impressions_b).cast("double"))


def signed_target(ctr_a: Column, ctr_b: Column) -> Column:
    """The logit gap. Zero-click arms make it as large as the clip allows; smoothed_target does not have that."""
    return logit(ctr_a) - logit(ctr_b)


def smoothed_target(clicks_a: Column, impressions_a: Column, clicks_b: Column, impressions_b: Column) -> Column:
    return logit(jeffreys(clicks_a, impressions_a)) - logit(jeffreys(clicks_b, impressions_b))
