"""Named queries over a folder of tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import HALF, rnd

FLAGSHIP = "c17_factor_scan"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Adds a query under its function's name, with SQL if it has some."""

    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = with_plain_rounding(sql)
        return f

    return put


def with_plain_rounding(sql: str) -> str:
    """Writes each round(x, n) as rnd() does it: engines round ties in different ways, but agree on this."""
    while (at := sql.find("round(")) >= 0:
        depth, i, comma = 1, at + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            comma = i if sql[i] == "," and depth == 1 else comma
            i += 1
        n = 10.0 ** int(sql[comma + 1 : i - 1])
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * {n!r} + {1 - HALF!r}::DOUBLE) / {n!r}){sql[i:]}"
    return sql


def rounded(frame: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded to digits, so that sums in any order agree."""
    return frame.select(*[rnd(F.nanvl(F.col(c), F.lit(None).cast("double")), own.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def _load() -> None:
    from . import company, factors, fundamentals, inference, learned, ledgers, operations, outcomes, panel, reports, scores, structure, technical, trade_plans  # noqa: F401  they register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
