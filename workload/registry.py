"""Registry of queries: a Spark function per key and, where SQL can say it, the same in SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from workload.views import load, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """``t("events")``: a test table or derived view of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views=(), ctes: str = ""):
    """Register a function of :class:`Tables`. ``sql`` may use ``views`` and the extra ``ctes``."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(Tables(spark, sf_dir))
        if sql is not None:
            if views:
                head = with_views(*views) + (",\n" + ctes if ctes else "")
            else:
                head = "WITH " + ctes if ctes else ""
            ORACLES[name] = f"{head}\n{sql}".strip()
        return function

    return register


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_case(expression: str, mapping: dict) -> str:
    """Fixed lookup as a SQL CASE, NULL for unknown keys."""
    arms = " ".join(f"WHEN {literal(str(k))} THEN {literal(str(v))}" for k, v in mapping.items())
    return f"CASE {expression} {arms} END"
