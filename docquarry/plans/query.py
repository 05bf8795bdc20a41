"""Named queries: a Spark plan over a folder of tables, and its DuckDB counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Plan = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Catalog:
    plans: dict[str, Plan] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def plan(self, name: str, oracle: str | None = None) -> Callable[[Plan], Plan]:
        """Registers a function of (spark, sf_dir)."""

        def add(f: Plan) -> Plan:
            self.plans[name] = f
            if oracle:
                self.oracles[name] = oracle
            return f

        return add

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """Registers SQL in which @name is a table; Spark reads it straight from its Parquet path, DuckDB from its view.

        Without an oracle of its own the text is portable and serves both.
        """
        self.plans[name] = lambda spark, sf_dir: spark.sql(re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", text))
        self.oracles[name] = re.sub(r"@(\w+)", r"\1", oracle or text)


def widened(plan: Plan, columns: tuple[str, ...]) -> Plan:
    """plan with some integer columns as bigint, as other engines count and measure."""
    return lambda spark, sf_dir: plan(spark, sf_dir).withColumns({c: F.col(c).cast("long") for c in columns})


def narrowed(oracle: str) -> str:
    """An oracle whose count_if gives bigint, not a wider type."""
    out, at = "", 0
    while (i := oracle.find("count_if(", at)) >= 0:
        depth, j = 0, i + len("count_if")
        while True:
            depth += {"(": 1, ")": -1}.get(oracle[j], 0)
            j += 1
            if not depth:
                break
        tail = re.match(r" OVER \([^)]*\)", oracle[j:])
        j += tail.end() if tail else 0
        out += oracle[at:i] + f"CAST({oracle[i:j]} AS BIGINT)"
        at = j
    return out + oracle[at:]
