"""Sources: price tables, price-index tables, document folders."""

from tallyspark.sources.prices import (
    PRICE_SCHEMA, CPI_SCHEMA, check_range, price_scan, read_price_csv, read_cpi_csv, empty_prices,
    with_fallback, lineitem_prices, part_brands, events_prices, orders_cpi, to_naive,
)
from tallyspark.sources.text import read_text_dir, append_corpus, CORPUS_SCHEMA

__all__ = [
    "PRICE_SCHEMA", "CPI_SCHEMA", "check_range", "price_scan", "read_price_csv", "read_cpi_csv", "empty_prices",
    "with_fallback", "lineitem_prices", "part_brands", "events_prices", "orders_cpi", "to_naive",
    "read_text_dir", "append_corpus", "CORPUS_SCHEMA",
]
