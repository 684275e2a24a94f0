"""Queries by name, with their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framesift.views import duck, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def six(c: Column) -> Column:
    """To six digits as DuckDB does: of the product with a million, half away from zero. `round` of a double goes by its shortest text, which differs at halves."""
    return F.round(c.cast("double") * F.lit(1e6)) / F.lit(1e6)


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, doubles to six digits, arrays of text as text: types that both engines agree on."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = six(c) + F.lit(0.0)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, ",") if isinstance(f.dataType.elementType, T.StringType) else F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def add(name: str, views: str, build: Callable[..., DataFrame], sql: str | None = None, by: str | None = None) -> None:
    """views: names that build gets as DataFrames and that the SQL may use. by: as `load` takes it."""
    names = views.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(build(*[load(spark, sf_dir, v, by) for v in names]))

    QUERIES[name] = run
    if sql:
        from framesift.views import VIEWS

        used = [v for v in names if v in VIEWS]
        ORACLES[name] = duck(sql, *used) if used else sql.strip()
