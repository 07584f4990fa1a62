"""Registration of queries over the test panel with their SQL, and what the SQL texts share."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.fixture import bars, oracle

QUERIES: dict = {}
ORACLES: dict = {}
#: Date columns of each query where they differ from `session` alone.
DATED: dict = {}
_W = "over (partition by inst order by session)"
_N = "over (partition by inst order by session rows between {0} preceding and current row)"
MOM = f"mom as (select *, case when lag(close, 5) {_W} <> 0 then close / lag(close, 5) {_W} - 1 end mom from bars)"
FWD = f"fwd as (select *, case when lead(open, 1) {_W} <> 0 then lead(close, 6) {_W} / lead(open, 1) {_W} - 1 end fwd from mom)"
RET = f"ret as (select *, case when lag(close, 1) {_W} <> 0 then close / lag(close, 1) {_W} - 1 end ret from bars)"


def r(c, digits: int = 6):
    """Rounded by plain arithmetic that both engines do alike (their own round() differs on ties)."""
    return F.floor((F.col(c) if isinstance(c, str) else c) * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)


def _sql_r(sql: str) -> str:
    """The SQL with each `round(x, n) + 0.0` written as r() computes it."""
    while (at := sql.find("round(")) >= 0:
        depth, i = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        x, n = sql[at + 6 : i - 1].rsplit(",", 1)
        sql = f"{sql[:at]}(floor(({x}) * 1e{int(n)} + 0.5::double) / 1e{int(n)}){sql[i:].removeprefix(' + 0.0')}"
    return sql


def panel(name: str, sql: str, dates: tuple = ("session",)):
    """Register f(bars) as a query with the given SQL over bars; `dates` are its date columns."""

    def add(f):
        DATED[name] = dates
        QUERIES[name] = lambda spark, sf_dir: f(bars(spark, sf_dir))
        ORACLES[name] = oracle(sql) if sql.lstrip().startswith("select") else oracle("").rstrip() + ",\n" + sql
        return f

    return add
