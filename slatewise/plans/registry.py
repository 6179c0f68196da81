"""Registry of runnable queries, each with its output columns and its SQL check.

Column specs are ``name:kind`` with kinds ``i`` bigint, ``d`` double rounded to seven places,
``s`` string and ``b`` boolean.  The same spec closes the Spark plan and the SQL text, so
names and types agree.  In SQL text ``=>`` separates helper CTEs from the final select.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatewise.session import configure, size_shuffles
from slatewise.sources.adapters import Tables, duckdb_ctes

DIGITS = 7
NUDGE = 3e-10  # moves exact decimal ties off the rounding edge, the same way in both engines


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: tuple[tuple[str, str], ...]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        tables = Tables(configure(spark), folder)
        size_shuffles(spark, tables.size())
        return close(self.build(tables), self.columns)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        helpers, _, body = self.sql.rpartition("=>")
        latest = [LATEST] if "last_predictions" in self.sql else []
        ctes = duckdb_ctes(" ".join([self.sql, *latest])) + latest + ([helpers.strip()] if helpers.strip() else []) + [f"answer as ({body.strip()})"]
        out = ", ".join(_duck_column(f'"{name}"', kind) for name, kind in self.columns)
        return f"with recursive {', '.join(ctes)} select {out} from answer"


#: The last revision of every game's prediction, for SQL texts that name it.
LATEST = "last_predictions as (select * from ledger where event_type = 'prediction' qualify row_number() over (partition by game_pk order by revision desc) = 1)"

REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        spec = tuple(tuple(part.split(":")) for part in columns.split())
        REGISTRY[name] = Query(name, build, spec, sql)
        return build

    return register


def close(df: DataFrame, columns: tuple[tuple[str, str], ...]) -> DataFrame:
    casts = {"i": "bigint", "s": "string", "b": "boolean"}
    return df.select(
        *[
            (F.round(F.col(n).cast("double") + F.lit(NUDGE), DIGITS) + F.lit(0.0)).alias(n) if k == "d" else F.col(n).cast(casts[k]).alias(n)
            for n, k in columns
        ]
    )


def _duck_column(name: str, kind: str) -> str:
    if kind == "d":
        return f"round(cast({name} as double) + {NUDGE}, {DIGITS}) + 0.0 as {name}"
    kinds = {"i": "bigint", "s": "varchar", "b": "boolean"}
    return f"cast({name} as {kinds[kind]}) as {name}"
