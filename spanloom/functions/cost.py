"""What a model call costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanloom.config import REGION_PREFIXES, RateCard


def base_model(model: Column) -> Column:
    """Model id without its region prefix (one prefix at most)."""

    options = "|".join(p.replace(".", r"\.") for p in REGION_PREFIXES)
    return F.regexp_replace(model, f"^(?:{options})", "")


def call_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    return F.round(tokens_in / F.lit(1000.0) * rate_in + tokens_out / F.lit(1000.0) * rate_out, 8)


def estimate_tokens(text: Column) -> Column:
    """About four characters to a token, at least one."""

    size = F.coalesce(F.length(text), F.lit(0))
    return F.greatest(F.lit(1), F.floor(size / 4)).cast("long")


def price_calls(
    calls: DataFrame,
    card: RateCard = RateCard(),
    model: str = "model",
    tokens_in: str = "tokens_in",
    tokens_out: str = "tokens_out",
    into: str = "cost_usd",
) -> DataFrame:
    """Add the cost of each row's model call.

    The rate card is driver-side configuration (a handful of models), so its
    size does not follow the data and broadcasting it is always safe.
    """

    spark = calls.sparkSession
    rows = [(name, float(i), float(o)) for name, (i, o) in card.rates.items()]
    rates = spark.createDataFrame(rows, "_model string, _rate_in double, _rate_out double")
    priced = calls.withColumn("_base", base_model(F.col(model))).join(
        F.broadcast(rates), F.col("_base") == F.col("_model"), "left"
    )
    cost = call_cost(
        F.coalesce(F.col(tokens_in), F.lit(0)),
        F.coalesce(F.col(tokens_out), F.lit(0)),
        F.coalesce("_rate_in", F.lit(card.default[0])),
        F.coalesce("_rate_out", F.lit(card.default[1])),
    )
    return priced.withColumn(into, cost).drop("_base", "_model", "_rate_in", "_rate_out")
