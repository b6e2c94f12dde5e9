from meterline.sources.events_view import usage_view, usage_name_rows, load_table
from meterline.sources.prices import (embedded_price_lookup, load_prices, EMBEDDED_PRICES,
                                      DEFAULT_PRICES)

__all__ = ["usage_view", "usage_name_rows", "load_table", "embedded_price_lookup",
           "load_prices", "EMBEDDED_PRICES", "DEFAULT_PRICES"]
