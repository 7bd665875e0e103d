"""Windows over the days of stocks, of arrays that hold a stock's days: sums over each row's window in Spark's own order.

Spark's sliding frames add up each row's window in its interpreter of aggregates, which takes nearly all of the time of
a table of many days. Here a window's rows are added up for all rows of a batch of stocks at once, oldest first and with
the same updates, so results are those of ``features.daily`` over ``derived.prices`` to the last bit. As a row holds its
stock, what follows finds rows where their stock's lines went.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import CONFIG, Config

#: The days after an event at which it is measured; a date before all others, for a date that is missing.
AHEAD = (1, 3, 5)
NEVER = -(2**31)


def windows(days: str, values, rows_of, cfg: Config = CONFIG) -> Column:
    """``days`` (structs of l_suppkey, date, u and ``values``; events are those without a supplier) as structs of price
    rows: date, price, the nearest event to come, and the windows of ``cfg``. ``rows_of``: of how many rows a supplier's price is the mean."""
    doubles = [*values, "daily_ret", *[f"drift_{n}d" for n in cfg.drift], *[f"vol_{n}d" for n in cfg.vol], *[f"mom_{n}d" for n in cfg.momentum], *[f"_next{k}" for k in AHEAD]]
    kind = "array<struct<date: date, price: double, earnings_date: date, " + ", ".join(f"{c}: double" for c in doubles) + ">>"

    def of_stocks(lists: pa.Array) -> pa.Array:
        return _of_stocks(lists, values, rows_of, cfg)

    return F.arrow_udf(of_stocks, kind)(days)


def _numbers(x: pa.Array, empty=0) -> tuple[np.ndarray, np.ndarray]:
    return x.fill_null(empty).to_numpy(zero_copy_only=False), x.is_valid().to_numpy(zero_copy_only=False)


def _of_stocks(lists: pa.Array, values, rows_of, cfg: Config) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    supplier, date, u, *eps = lists.flatten().flatten()
    stock = np.repeat(np.arange(len(sizes)), sizes)
    (supplier, is_line), (day, _) = _numbers(supplier.cast(pa.int64())), _numbers(date.cast(pa.int32()), NEVER)
    u, known = _numbers(u, 0.0)

    # events after the lines of their day, so that the nearest one to come is the next one in this order
    order = np.lexsort((supplier, ~is_line, day, stock))
    stock, supplier, is_line, day, u, known = (x[order] for x in (stock, supplier, is_line, day, u, known))
    at = np.where(is_line, len(order), np.arange(len(order)))
    event = np.minimum.accumulate(at[::-1])[::-1][is_line]
    stock_of, day_of, first = np.append(stock, -1), np.append(day, NEVER), np.append(order, 0)
    lines = np.bincount(stock[is_line], minlength=len(sizes))
    stock, supplier, day, u, known = (x[is_line] for x in (stock, supplier, day, u, known))
    coming = stock_of[event] == stock
    row = pa.array(first[event], mask=~coming)

    price, priced = _prices(stock, supplier, day, u, known, rows_of)
    nth = _nth(stock)
    before, had = _shifted(price, 1), _shifted(priced, 1) & (nth >= 1)
    moved = priced & had & (before != 0)
    r = np.where(moved, np.divide(price, before, where=moved, out=np.zeros_like(price)) - 1, 0.0)
    at = np.arange(len(r))
    # returns without a gap just before a row; the first row of a stock has none, so they end at its bounds
    run = np.where(nth >= 1, _shifted(at - np.maximum.accumulate(np.where(moved, -1, at)), 1), 0)

    columns = [_dates(day, day != NEVER), pa.array(price, mask=~priced), _dates(day_of[event], coming & (day_of[event] != NEVER))]
    columns += [x.take(row) for x in eps]
    columns += [pa.array(r, mask=~moved)]
    columns += [pa.array(_sum(r, n) / n, mask=run < n) for n in cfg.drift]
    columns += [pa.array(_spread(r, n), mask=run < max(n, 2)) for n in cfg.vol]
    columns += [pa.array(_sum(r, n), mask=run < n) for n in cfg.momentum]
    for k in AHEAD:
        same = _shifted(stock, -k, -1) == stock
        columns.append(pa.array(_shifted(price, -k), mask=~(same & _shifted(priced, -k))))
    names = ["date", "price", "earnings_date", *values, "daily_ret", *[f"drift_{n}d" for n in cfg.drift], *[f"vol_{n}d" for n in cfg.vol], *[f"mom_{n}d" for n in cfg.momentum], *[f"_next{k}" for k in AHEAD]]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lines)]), pa.int32()), pa.StructArray.from_arrays(columns, names))


def _dates(day: np.ndarray, known: np.ndarray) -> pa.Array:
    return pa.array(day.astype(np.int32), mask=~known).cast(pa.date32())


def _nth(key: np.ndarray) -> np.ndarray:
    """The place of each row among the adjoining ones of its key, from 0."""
    at = np.arange(len(key))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return at - np.maximum.accumulate(np.where(fresh, at, 0))


def _shifted(x: np.ndarray, k: int, empty=0) -> np.ndarray:
    """``x`` of ``k`` rows before each row, or after it if ``k`` is negative."""
    out = np.full_like(x, empty)
    if k > 0:
        out[k:] = x[:-k]
    else:
        out[:k] = x[-k:]
    return out


def _prices(stock, supplier, day, u, known, rows_of) -> tuple[np.ndarray, np.ndarray]:
    """Trailing means of each supplier's days; a stock has one supplier, unless keys are so long that names collide."""
    order = np.lexsort((day, supplier, stock))
    pair = np.cumsum(np.append(0, (np.diff(stock[order]) != 0) | (np.diff(supplier[order]) != 0))[: len(order)])
    n, nth, u, known = rows_of(supplier[order]), _nth(pair), np.where(known, u, 0.0)[order], known[order]
    total, count = np.zeros(len(u)), np.zeros(len(u), np.int64)
    for k in range(int(n.max(initial=1)) - 1, -1, -1):
        m = max(0, len(u) - k)
        ok = known[:m] & (nth[k:] >= k) & (k < n[k:])
        total[k:] += np.where(ok, u[:m], 0.0)
        count[k:] += ok
    price, priced = np.zeros(len(u)), np.zeros(len(u), bool)
    price[order], priced[order] = np.divide(total, count, where=count > 0, out=np.zeros(len(u))), count > 0
    return price, priced


def _sum(r: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(r))
    for k in range(n, 0, -1):
        out[k:] += r[:-k]
    return out


def _spread(r: np.ndarray, n: int) -> np.ndarray:
    """Sample standard deviation, by the updates that Spark's has."""
    mean, m2 = np.zeros(len(r)), np.zeros(len(r))
    for k in range(n, 0, -1):
        delta = r[:-k] - mean[k:]
        part = delta / (n - k + 1)
        mean[k:] += part
        np.subtract(delta, part, out=part)
        part *= delta
        m2[k:] += part
    return np.sqrt(m2 / max(1, n - 1))
