"""Tasks: files that each hold a list of them, as one row a task."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.records import _struct

_S, _B = T.StringType(), T.BooleanType()
_LIST = T.ArrayType(_S)
#: Arguments stay JSON text.
ACTION = _struct(tool=_S, args=_S)
VALUE = _struct(label=_S, kind=_S, value=_S)
SCENARIO = _struct(persona=_S, reason=_S, known=_S, unknown=_S, rules=_S, script=_LIST)
TASK = _struct(
    id=_S, type=_S, purpose=_S, now=_S, customer_id=_S, user=SCENARIO, gold_actions=T.ArrayType(ACTION), gold_verified=_B, forbidden_actions=T.ArrayType(ACTION),
    required_values=T.ArrayType(VALUE), injection=_S,
)


@F.pandas_udf(_S)
def _as_json(texts: pd.Series) -> pd.Series:
    """A JSON list as it is; YAML, where its reader is installed, as JSON with dates as text."""

    def one(text: str) -> str:
        text = text.removeprefix("\ufeff")
        try:
            found = json.loads(text)
        except ValueError:
            try:
                import yaml
            except ImportError as missing:
                raise ValueError("tasks that aren't JSON need the yaml package") from missing
            found = yaml.safe_load(text)
        return json.dumps(found, ensure_ascii=False, default=lambda x: x.isoformat())

    return texts.map(one)


def tasks(spark: SparkSession, path: str) -> DataFrame:
    """(file, *TASK): one row for each task of the files; what a task leaves out is null, or empty where it is a list."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), _as_json("value").alias("text"))
    found = files.select("file", F.explode(F.from_json("text", T.ArrayType(TASK))).alias("t")).select("file", "t.*")
    lists = {c: F.coalesce(c, F.array().cast(TASK[c].dataType)) for c in ("gold_actions", "forbidden_actions", "required_values")}
    return found.withColumns(lists | {"gold_verified": F.coalesce("gold_verified", F.lit(True))})
