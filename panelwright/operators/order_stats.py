"""Order statistics of trailing windows: one ordered pass over each instrument with a sorted window, log n comparisons a row."""
from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Trailing:
    """The last `rows` rows of a column, today's included, or those before today's (`past`)."""

    column: str
    rows: int
    past: bool = False
    quantiles: Sequence[float] = ()


class SortedWindow:
    """The values of a window in order. Missing values take a place in the window and none among the values."""

    def __init__(self, spec: Trailing):
        self.spec = spec
        self.clear()

    def clear(self):
        self.order: list[float] = []
        self.rows: deque = deque()

    def _push(self, v):
        self.rows.append(v)
        if v is not None:
            insort(self.order, v)
        if len(self.rows) > self.spec.rows:
            old = self.rows.popleft()
            if old is not None:
                del self.order[bisect_left(self.order, old)]

    def step(self, v) -> tuple:
        """(below, same, size, *quantiles) for the next row of value v."""
        if not self.spec.past:
            self._push(v)
        order, size = self.order, len(self.order)
        lo = hi = None
        if v is not None:
            lo = bisect_left(order, v)
            hi = bisect_right(order, v, lo)
        out = [lo, None if v is None else hi - lo, size]
        for q in self.spec.quantiles:
            at = q * (size - 1)
            k = int(at)
            out.append(None if not size else order[k] if k + 1 >= size else order[k] + (order[k + 1] - order[k]) * (at - k))
        if self.spec.past:
            self._push(v)
        return tuple(out)


def _pass(stats: dict[str, Trailing], key: str):
    def run(batches):
        windows = {n: SortedWindow(s) for n, s in stats.items()}
        last = start = object()
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            made = []
            values = {}
            for s in stats.values():
                x = batch.column(batch.schema.get_field_index(s.column)).cast(pa.float64())
                values[s.column] = pc.if_else(pc.is_nan(x), pa.scalar(None, pa.float64()), x).to_pylist()
            first = last
            for name, w in windows.items():
                now, rows = first, []
                for k, v in zip(keys, values[w.spec.column]):
                    if now is start or k != now:
                        w.clear()
                        now = k
                    rows.append(w.step(v))
                cols = list(zip(*rows)) if rows else [()] * (3 + len(w.spec.quantiles))
                made += [pa.array(c, pa.int32()) for c in cols[:3]] + [pa.array(c, pa.float64()) for c in cols[3:]]
                last = now
            names = [f for n, s in stats.items() for f in _names(n, s)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *names])

    return run


def _names(name: str, s: Trailing) -> list[str]:
    return [f"{name}_below", f"{name}_same", f"{name}_size", *(f"{name}_q{k}" for k in range(len(s.quantiles)))]


def with_trailing(df: DataFrame, stats: dict[str, Trailing], key: str = "inst", time: str = "session") -> DataFrame:
    """df with, for each name: how many values of the window lie below today's and equal it (NULL where today's is missing),
    how many there are, and the quantiles, interpolated linearly (name_q0, ...; NULL without values). NaN counts as missing.

    Rows stream through in the order of (key, time); a task holds the windows of one key, never its history."""
    kinds = [f"{f} {'double' if '_q' in f[len(n) :] else 'int'}" for n, s in stats.items() for f in _names(n, s)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *kinds])
    return df.repartition(key).sortWithinPartitions(key, time).mapInArrow(_pass(stats, key), schema)


def share_below(name: str, least: int = 1) -> Column:
    """Mid-rank share of a window's values below today's, with `least` values there; ties count by half."""
    return F.when(F.col(f"{name}_size") >= least, (F.col(f"{name}_below") + F.col(f"{name}_same") / 2) / F.col(f"{name}_size"))


def with_history_percentile(df: DataFrame, columns: dict[str, str], n: int, least: int, past: bool = False) -> DataFrame:
    """df with, for each name -> column, the share of the last n rows below today's."""
    x = with_trailing(df, {f"_{k}": Trailing(c, n, past) for k, c in columns.items()})
    return x.withColumns({k: share_below(f"_{k}", least) for k in columns}).select(*df.columns, *columns)
