"""Named queries and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import configure, named, read, register, spread_not_in

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, each with the SQL of an independent engine where SQL can say the same."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A query in Spark SQL over the registered tables; the oracle is the same text unless given."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            register(configure(spark), sf_dir, named(text))
            return spark.sql(spread_not_in(text))

        run.__name__ = name
        self.queries[name] = run
        self.oracles[name] = text if oracle is None else oracle

    def frame(self, oracle: str | None = None) -> Callable[[Callable], Callable]:
        """Decorator for f(t, spark) where t(name) reads a table; registers f under its name."""

        def add(f: Callable) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                configure(spark)
                return f(lambda name: read(spark, sf_dir, name), spark)

            run.__name__ = f.__name__
            self.queries[f.__name__] = run
            if oracle is not None:
                self.oracles[f.__name__] = oracle
            return f

        return add
