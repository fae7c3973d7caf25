"""Registration of queries and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from counterlift.catalog.sql_views import with_views
from counterlift.sources.retail_views import Retail

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Rounding for the comparison only: the small offset moves exact decimal ties
# away from the rounding boundary, where two engines would differ by one step.
_MONEY = (1e-6, 4)
_RATIO = (1e-9, 6)


def _rounded(df: DataFrame, money: list[str], ratio: list[str]) -> DataFrame:
    cols = {}
    for names, (nudge, digits) in ((money, _MONEY), (ratio, _RATIO)):
        for n in names:
            cols[n] = F.round(F.col(n).cast("double") + F.lit(nudge), digits)
    for f in df.schema.fields:
        if f.dataType.typeName() in ("integer", "short", "byte") and f.name not in cols:
            cols[f.name] = F.col(f.name).cast("long")
    return df.withColumns(cols) if cols else df


def _rounded_sql(sql: str, money: list[str], ratio: list[str]) -> str:
    parts = []
    for names, (nudge, digits) in ((money, _MONEY), (ratio, _RATIO)):
        for n in names:
            parts.append(f"round(CAST({n} AS DOUBLE) + {nudge:.10f}, {digits}) AS {n}")
    if not parts:
        return sql
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql.strip()}) checked"


def query(name: str, sql: str | None = None, money: str = "", ratio: str = "", result: str | None = None):
    """Register a function of the retail view; ``money``/``ratio`` list float columns.

    ``result`` names the stage that is the query's own result, which is not staged.
    """

    def deco(fn: Callable[[Retail], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        m, q = money.split(), ratio.split()

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _rounded(fn(Retail(spark, folder, result)), m, q)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(_rounded_sql(sql, m, q))
        return fn

    return deco
