"""Small builders shared by the tests."""

import math
from datetime import datetime, timedelta

START = datetime(2024, 1, 1)


def candles(spark, offsets, symbol="S", price=lambda i: 100.0 + i % 7):
    """Candles at the given hour offsets."""
    rows = []
    for i, h in enumerate(offsets):
        p = price(i)
        rows.append((symbol, START + timedelta(hours=h), p, p + 2, p - 1, p + 1))
    return spark.createDataFrame(rows, "symbol string, open_time timestamp_ntz, open double, high double, low double, close double")


def normal(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    return str(value)


def sorted_rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)
