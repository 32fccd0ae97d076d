"""Operators by name: what the entry module offers, with the DuckDB SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_NAME = re.compile(r"[a-z][a-z0-9_]*\Z")


@dataclass(frozen=True)
class Operator:
    """A registered query. ``write`` marks those that return a changed state instead of reading one."""

    name: str
    build: Query
    oracle: str | None = None
    write: bool = False


class Registry(dict[str, Operator]):
    """Refuses bad and repeated names, and operators that don't say what they do."""

    def query(self, oracle: str | None = None, *, write: bool = False) -> Callable[[Query], Query]:
        def add(build: Query) -> Query:
            name = build.__name__
            if not _NAME.match(name):
                raise ValueError(f"{name}: not a name in lower case")
            if name in self:
                raise ValueError(f"{name}: registered twice")
            if not (build.__doc__ or "").strip():
                raise ValueError(f"{name}: has no docstring")
            self[name] = Operator(name, build, oracle, write)
            return build

        return add

    def reads(self) -> list[str]:
        """Names of the operators that change no state."""
        return [k for k, v in self.items() if not v.write]


REGISTRY = Registry()
query = REGISTRY.query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
