"""Factors that users write: a function over one instrument's ordered history, whose accessors look back only and note when
what they read was available."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Earlier than any time: nothing was read.
_NEVER = np.iinfo(np.int64).min


def _shift(x: np.ndarray, k: int, fill) -> np.ndarray:
    out = np.full_like(x, fill)
    if k < len(x):
        out[k:] = x[: len(x) - k] if k else x
    return out


class History:
    """One instrument's rows in the order of time. Each accessor gives one value a row (NaN: missing) and widens `touched`,
    the latest availability of all rows that it read for that row."""

    def __init__(self, fields: dict[str, np.ndarray], available: np.ndarray, lookback: int):
        self._fields, self._available, self._lookback = fields, available, lookback
        self.touched = np.full(len(available), _NEVER)

    def __len__(self) -> int:
        return len(self._available)

    def _field(self, name: str) -> np.ndarray:
        if name not in self._fields:
            raise ValueError(f"field {name} was not declared")
        return self._fields[name]

    def _rows(self, n: int, least: int) -> int:
        if not isinstance(n, int) or isinstance(n, bool) or not least <= n <= self._lookback:
            raise ValueError(f"a factor looks back over {least} to {self._lookback} rows, not {n}")
        return n

    def now(self, field: str) -> np.ndarray:
        return self.lag(field, 0)

    def lag(self, field: str, n: int) -> np.ndarray:
        """The value n rows ago."""
        x = _shift(self._field(field), self._rows(n, 0), np.nan)
        self.touched = np.maximum(self.touched, _shift(self._available, n, _NEVER))
        return x

    def window(self, field: str, n: int) -> np.ndarray:
        """(rows, n): the last n values, today's last; NaN before the first row."""
        x = self._field(field)
        latest, have = self._available, 1
        self._rows(n, 1)
        while have < n:  # the latest availability of n rows, by doubling
            step = min(have, n - have)
            latest, have = np.maximum(latest, _shift(latest, step, _NEVER)), have + step
        self.touched = np.maximum(self.touched, latest)
        return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)

    def mean(self, field: str, n: int) -> np.ndarray:
        """Mean of n rows that all have a value."""
        return self.window(field, n).mean(axis=1) if len(self) else np.zeros(0)

    def sum(self, field: str, n: int) -> np.ndarray:
        return self.window(field, n).sum(axis=1) if len(self) else np.zeros(0)

    def std(self, field: str, n: int) -> np.ndarray:
        """Population deviation of n rows that all have a value."""
        return self.window(field, n).std(axis=1) if len(self) else np.zeros(0)


def safe_div(a, b) -> np.ndarray:
    """NaN for a zero divisor or a result that is not finite."""
    with np.errstate(all="ignore"):
        out = np.asarray(a, float) / np.asarray(b, float)
    return np.where(np.isfinite(out), out, np.nan)


@dataclass(frozen=True)
class Factor:
    """A named function History -> one value a row, the fields that it may read and how far back."""

    name: str
    fields: Sequence[str]
    lookback: int
    function: Callable[[History], np.ndarray]

    def __call__(self, df: DataFrame, key: str = "inst", time: str = "session", available: str = "available_at") -> DataFrame:
        """(key, time, value, available_at): the factor on every row of df, and when all that it read was available.

        Values that are missing or not finite are NULL; available_at is NULL where nothing was read. Rows of one time keep
        an order by all they hold. One task holds an instrument's declared fields; instruments spread over tasks."""
        kind = {c: df.schema[c].dataType.simpleString() for c in (key, time)}
        rows = df.select(F.col(key).alias("key"), F.col(time).alias("time"), F.unix_micros(F.col(available).cast("timestamp")).alias("_at"), *(F.col(c).cast("double").alias(f"f_{c}") for c in self.fields))
        out = rows.groupBy("key").applyInArrow(_run(self), f"key {kind[key]}, time {kind[time]}, value double, at long")
        return out.select(F.col("key").alias(key), F.col("time").alias(time), "value", F.timestamp_micros("at").alias("available_at"))


def _run(factor: Factor):
    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("time", "_at", *(f"f_{c}" for c in factor.fields))])
        fields = {c: table.column(f"f_{c}").to_numpy().astype(float) for c in factor.fields}
        at = table.column("_at").fill_null(_NEVER).to_numpy()
        history = History(fields, at, factor.lookback)
        value = np.asarray(factor.function(history), float)
        if value.shape != (table.num_rows,):
            raise ValueError(f"factor {factor.name} gave {value.shape} values for {table.num_rows} rows")
        read = history.touched
        return pa.table({"key": table.column("key"), "time": table.column("time"), "value": pa.array(value, mask=~np.isfinite(value)), "at": pa.array(read, mask=read == _NEVER)})

    return one


REGISTERED: dict[str, Factor] = {}


def factor(fields: Sequence[str], lookback: int) -> Callable[[Callable], Factor]:
    """Register a function under its name. A second one of that name is refused."""

    def add(function: Callable) -> Factor:
        name = function.__name__
        if name in REGISTERED:
            raise ValueError(f"factor {name} is registered already")
        REGISTERED[name] = Factor(name, tuple(fields), lookback, function)
        return REGISTERED[name]

    return add
