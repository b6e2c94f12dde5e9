"""Price resolution and cost (O3.4, O3.5).

The embedded lookup has at most 88 rows by construction and is broadcast.  A
user price table is joined as the planner chooses by its size.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.schema import MONEY, PRICE, TOKENS_DEC
from meterline.sources.prices import DEFAULT_PRICES, PRICE_COLS, embedded_price_lookup


def _price_frames(spark, prices: DataFrame | None):
    emb = embedded_price_lookup(spark).select(
        F.col("lookup_model").alias("_e_model"),
        *[F.col(c).alias(f"_e_{c}") for c in PRICE_COLS])
    user = None
    if prices is not None:
        # one row per model id: of a repeated id the lowest prices, compared in
        # column order, wherever its rows were read
        user = (prices.groupBy("model").agg(F.min(F.struct(*PRICE_COLS)).alias("_p"))
                .select(F.col("model").alias("_u_model"), *[F.col(f"_p.{c}").alias(f"_u_{c}") for c in PRICE_COLS]))
    return F.broadcast(emb), user


def with_prices(df: DataFrame, prices: DataFrame | None = None, model_col: str = "model") -> DataFrame:
    """Attach the four per-token prices and their source to every row."""
    emb, user = _price_frames(df.sparkSession, prices)
    out = df.join(emb, F.col(model_col) == F.col("_e_model"), "left")
    if user is not None:
        out = out.join(user, F.col(model_col) == F.col("_u_model"), "left")
    exprs = {}
    for c, d in zip(PRICE_COLS, DEFAULT_PRICES):
        opts = ([F.col(f"_u_{c}")] if user is not None else []) + [F.col(f"_e_{c}"),
                                                                   F.lit(Decimal(d)).cast(PRICE)]
        exprs[c] = F.coalesce(*opts).cast(PRICE)
    src = F.when(F.col("_e_model").isNotNull(), F.lit("embedded")).otherwise(F.lit("default"))
    if user is not None:
        src = F.when(F.col("_u_model").isNotNull(), F.lit("table")).otherwise(src)
    exprs["price_source"] = src
    out = out.withColumns(exprs)
    drop = [c for c in out.columns if c.startswith("_e_") or c.startswith("_u_")]
    return out.drop(*drop)


def resolve_prices(df: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Distinct models of ``df`` with their resolved prices (O3.4)."""
    models = df.select("model").distinct()
    return with_prices(models, prices)


def with_cost(df: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Cost columns (O3.5).

    Only rows whose logged cost is 0 are priced: api = in*p_in + out*p_out,
    cache costs only when the cache token count is present.  A row with a
    logged cost keeps it and its split columns stay 0.  Money is exact
    DECIMAL(38,12).
    """
    priced = with_prices(df, prices)

    def tok(c):
        return F.coalesce(F.col(c), F.lit(0)).cast(TOKENS_DEC)

    api = tok("input_tokens") * F.col("input_cost_per_token") + tok("output_tokens") * F.col(
        "output_cost_per_token")
    cc = F.when(F.col("cache_create_tokens").isNotNull(),
                tok("cache_create_tokens") * F.col("cache_creation_input_token_cost")).otherwise(F.lit(0))
    cr = F.when(F.col("cache_read_tokens").isNotNull(),
                tok("cache_read_tokens") * F.col("cache_read_input_token_cost")).otherwise(F.lit(0))
    logged = F.coalesce(F.col("logged_cost"), F.lit(0)).cast(MONEY)
    compute = logged == 0
    zero = F.lit(0).cast(MONEY)
    out = priced.withColumns({
        "api_cost": F.when(compute, api.cast(MONEY)).otherwise(zero),
        "cache_create_cost": F.when(compute, cc.cast(MONEY)).otherwise(zero),
        "cache_read_cost": F.when(compute, cr.cast(MONEY)).otherwise(zero),
    })
    out = out.withColumn("cost", F.when(
        compute, (F.col("api_cost") + F.col("cache_create_cost") + F.col("cache_read_cost")).cast(MONEY)
    ).otherwise(logged))
    return out.drop(*PRICE_COLS, "price_source")
