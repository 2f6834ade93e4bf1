"""Numbers, times, maps and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fraction_or(value: Column, default: float) -> Column:
    """A number in [0, 1]; anything else is the default."""
    x = F.expr("1.0") * value.try_cast("double")
    return F.when((x >= 0) & (x <= 1), x).otherwise(default)


def clamp(value: Column, low: float, high: float, default: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("double"), F.lit(default))))


def embedding_cost(tokens: Column, model: Column, prices: dict[str, str]) -> Column:
    """tokens / 1000 by the model's price for a thousand; six decimals, half up; unknown models cost nothing."""
    price = F.lit(0).cast("decimal(18,9)")
    for name, p in prices.items():
        price = F.when(model == name, F.lit(p).cast("decimal(18,9)")).otherwise(price)
    return F.round(tokens.cast("decimal(18,0)") * price / F.lit(1000).cast("decimal(5,0)"), 6).cast("decimal(18,6)")


def retry_seconds(attempt: Column, base: int = 60) -> Column:
    return base * F.pow(F.lit(2.0), attempt - 1)


def breaker_seconds(failures: Column, base: float, most: float) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), failures - 1))


def tolerant_timestamp(text: Column) -> Column:
    """ISO 8601 with or without zone, or seconds since 1970; null for other texts."""
    epoch = F.timestamp_seconds(F.when(text.rlike(r"^\d{9,11}(\.\d+)?$"), text).cast("double"))
    return F.coalesce(epoch, F.try_to_timestamp(text))


def freshness_days(domain: Column) -> Column:
    """Days after which a result counts as stale, by mode; none for others."""
    return F.when(domain == "standard", 365).when(domain == "software_docs_strict", 1095)


def freshness_penalty(age_days: Column) -> Column:
    """Two points a month beyond 1,095 days, 25 at most."""
    return F.least(F.lit(25.0), F.greatest(F.lit(0.0), 2.0 * (age_days - 1095) / 30.0))


def next_run(last: Column, frequency: Column) -> Column:
    days = F.when(frequency == "daily", 1).when(frequency == "weekly", 7).otherwise(0)
    return F.when(frequency.isin("daily", "weekly"), F.timestamp_add("DAY", days, last)).otherwise(F.timestamp_add("HOUR", F.lit(1), last))


def merge_maps(old: Column, new: Column, removed: list[str] | None = None) -> Column:
    """The new map over the old one, without nulls and removed keys."""
    new_ = F.map_filter(new, lambda _, v: v.isNotNull())
    kept = F.map_filter(old, lambda k, v: v.isNotNull() & ~F.map_contains_key(new_, k))
    out = F.map_concat(kept, new_)
    return F.map_filter(out, lambda k, _: ~k.isin(removed)) if removed else out


def normalised_weights(weights: Column) -> Column:
    """Without negatives, summing to 1; null if nothing is left."""
    kept = F.map_filter(weights, lambda _, v: v > 0)
    total = F.aggregate(F.map_values(kept), F.lit(0.0), lambda s, v: s + v)
    return F.when(total > 0, F.transform_values(kept, lambda _, v: v / total))


def embedded_json(text: Column) -> Column:
    """The outermost object of a model's answer, fences or not; null if it doesn't parse."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull(), body)
