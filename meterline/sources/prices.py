"""Price tables (O1.14, O3.4).

Two sources, in precedence order: a user price table (exact model id match)
and the embedded table (model id with name variants), then default prices.

The embedded lookup is inverted once on the driver from the fixed table below
into at most ``len(EMBEDDED_PRICES) * len(VARIANTS)`` rows
``(model, rank, prices)``: the size is bounded by constants, so it is safe to
broadcast and the fact table is never shuffled for pricing.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterline.schema import PRICE, PRICE_TABLE

# ---- fixed values: embedded prices per token (input, output, cache create,
# cache read).  The claude-3-opus cache-create price is kept as given although
# it is 1,000 times its siblings' scale.
EMBEDDED_PRICES = [
    ("claude-3-5-sonnet-20241022", "0.000003", "0.000015", "0.00000375", "0.0000003"),
    ("claude-3-5-sonnet-20240620", "0.000003", "0.000015", "0.00000375", "0.0000003"),
    ("claude-sonnet-4-5-20250929", "0.000003", "0.000015", "0.00000375", "0.0000003"),
    ("claude-3-sonnet-20240229", "0.000003", "0.000015", "0.00000375", "0.0000003"),
    ("claude-3-haiku-20240307", "0.00000025", "0.00000125", "0.0000003", "0.00000003"),
    ("claude-haiku-4-5-20251001", "0.000001", "0.000005", "0.00000125", "0.0000001"),
    ("claude-3-opus-20240229", "0.000015", "0.000075", "0.01875", "0.0000015"),
    ("gpt-4o", "0.000005", "0.000015", "0.0000125", "0.0000005"),
    ("gpt-4o-mini", "0.00000015", "0.0000006", "0.000000375", "0.000000015"),
    ("gpt-4", "0.00003", "0.00006", "0.000075", "0.000003"),
    ("gpt-3.5-turbo", "0.0000005", "0.0000015", "0.00000125", "0.00000005"),
]
# Name variants tried against the embedded table, in order: (prefix, suffix).
VARIANTS = [
    ("", ""),
    ("claude-3-5-", ""),
    ("claude-3-", ""),
    ("claude-", ""),
    ("", "-20241022"),
    ("", "-20240620"),
    ("", "-20240229"),
    ("", "-20240307"),
]
# Prices of a model found nowhere.
DEFAULT_PRICES = ("0.000001", "0.000002", "0.0000025", "0.0000001")
# ---------------------------------------------------------------------------

PRICE_COLS = ["input_cost_per_token", "output_cost_per_token",
              "cache_creation_input_token_cost", "cache_read_input_token_cost"]

LOOKUP_SCHEMA = T.StructType([
    T.StructField("lookup_model", T.StringType()),
    T.StructField("variant_rank", T.IntegerType()),
    T.StructField("embedded_model", T.StringType()),
] + [T.StructField(c, PRICE) for c in PRICE_COLS])


def embedded_lookup_rows() -> list[tuple]:
    """Every model id whose variant list hits the embedded table, with the
    first hit.  A model m hits entry E at rank r when prefix_r + m + suffix_r
    equals E."""
    best: dict[str, tuple] = {}
    for rank, (pre, suf) in enumerate(VARIANTS):
        for name, *prices in EMBEDDED_PRICES:
            if not (name.startswith(pre) and name.endswith(suf)) or len(name) < len(pre) + len(suf):
                continue
            model = name[len(pre):len(name) - len(suf)]
            if model not in best or best[model][1] > rank:
                best[model] = (model, rank, name, *[Decimal(p) for p in prices])
    return sorted(best.values())


def _values(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small constant table as a JVM-side local relation (no Python worker)."""
    def lit(v, t):
        if v is None:
            return f"CAST(NULL AS {t.simpleString()})"
        if isinstance(t, T.StringType):
            return "'" + str(v).replace("'", "''") + "'"
        return f"CAST({v} AS {t.simpleString()})"
    body = ", ".join("(" + ", ".join(lit(v, f.dataType) for v, f in zip(r, schema.fields)) + ")" for r in rows)
    names = ", ".join(f.name for f in schema.fields)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({names})")


def embedded_price_lookup(spark: SparkSession) -> DataFrame:
    """Bounded (<= 88 rows) lookup ``lookup_model -> prices``."""
    return _values(spark, embedded_lookup_rows(), LOOKUP_SCHEMA)


def load_prices(spark: SparkSession, path: str, fmt: str = "map-json") -> DataFrame:
    """A user price table with the PRICE_TABLE schema.

    ``map-json``: one JSON object keyed by model id whose values carry the
    four per-token prices (the public model-price file layout); read whole,
    which is fine because a price file is a few MB.  ``json`` / ``parquet`` /
    ``csv``: one row per model with the PRICE_TABLE columns.
    """
    if fmt == "map-json":
        value_type = T.MapType(T.StringType(), T.StructType(
            [T.StructField(c, T.DoubleType()) for c in PRICE_COLS]))
        raw = spark.read.text(path, wholetext=True)
        parsed = raw.select(F.explode(F.from_json("value", value_type)).alias("model", "p"))
        # a field missing from an entry decodes as 0, like an absent JSON number
        return parsed.select("model", *[F.coalesce(F.col(f"p.{c}"), F.lit(0.0)).cast(PRICE).alias(c)
                                        for c in PRICE_COLS])
    if fmt == "csv":
        df = spark.read.csv(path, header=True, schema=PRICE_TABLE)
    else:
        df = spark.read.format(fmt).load(path)
    return df.select("model", *[F.col(c).cast(PRICE).alias(c) for c in PRICE_COLS])
