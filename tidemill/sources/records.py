"""Episode records: nested JSON lines with a declared schema, and the sinks of runs and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.text import without_ending


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_LIST, _FOUND = T.ArrayType(_S), T.MapType(_S, _B)
TOOL_CALL = _struct(agent_call=_L, name=_S, raw_arguments=_S, args=_S, ok=_B, error_code=_S, policy_blocked=_B, violations=_LIST, content=_S, write=_B, ms=_D)
LLM_CALL = _struct(
    who=_S, index=_L, seed=_L, text=_S, tool_calls=_LIST, format_error=_S, dropped_text=_S, dropped_calls=_L, finish_reason=_S, prompt_tokens=_L, completion_tokens=_L,
    wall_ms=_D, load_ms=_D, prompt_eval_ms=_D, eval_ms=_D,
)
MESSAGE = _struct(role=_S, content=_S, tool_name=_S, delivered=_B, harness=_B)
VERDICT = _struct(
    success=_B, judged=_B, db_match=_B, values=_FOUND, unexpected_writes=_L, missing_writes=_L, policy_violations=_LIST, policy_blocks=_LIST, blocked_forbidden_attempts=_L, auth_blocks=_L
)
UTTERANCE = _struct(said=_S, spoken=_S, heard=_S, text=_S, cached=_B, seconds=_D)
#: Free-form parts (arguments) stay JSON text; fields that older records lack are null and filled by readers.
EPISODE = _struct(
    run_id=_S, task_id=_S, task_sha256=_S, trial=_L, status=_S, termination=_S, verdict=VERDICT, error=_S, messages=T.ArrayType(MESSAGE), user_messages=T.ArrayType(MESSAGE),
    tool_calls=T.ArrayType(TOOL_CALL), llm_calls=T.ArrayType(LLM_CALL), seed_hash=_S, final_hash=_S, gold_hash=_S, wall_seconds=_D, voice=T.ArrayType(UTTERANCE),
)
#: What is read of a run's manifest; the rest of it stays in ``text``.
MANIFEST = _struct(run_id=_S, tasks_file=_S, task_sha256=T.MapType(_S, _S), config=T.MapType(_S, _S), agent_provider=T.MapType(_S, _S), user_provider=T.MapType(_S, _S))
JUDGED = ("agent_stop", "customer_stop", "out_of_scope", "max_user_turns")


def _folder() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -2)


def episodes(spark: SparkSession, path: str) -> DataFrame:
    """Records of one or more runs, one JSON object a line; blank lines are skipped, a run without a name has its folder's."""
    read = spark.read.schema(EPISODE).json(path)
    return read.withColumn("run_id", F.coalesce("run_id", _folder()))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifests (or summaries), one file each: the fields of MANIFEST, the whole as ``text``, and the folder as ``run_id``."""
    read = spark.read.text(path, wholetext=True).select(_folder().alias("folder"), F.col("value").alias("text"))
    found = read.select("folder", "text", F.from_json("text", MANIFEST).alias("m"))
    return found.select(F.coalesce("m.run_id", "folder").alias("run_id"), *(F.col(f"m.{c}") for c in MANIFEST.names if c != "run_id"), "text")


def is_test_run(tasks_file: Column, task_sha256: Column) -> Column:
    """Whether a manifest is of held-back tasks, by the name of their file or of any task; nothing may be made of those."""
    stem = F.regexp_replace(F.regexp_extract(F.coalesce(tasks_file, F.lit("")), r"([^/\\\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    named = F.exists(F.map_keys(F.coalesce(task_sha256, F.create_map().cast("map<string,string>"))), lambda k: k.startswith("test-"))
    return stem.contains("test") | named


def judged(records: DataFrame) -> DataFrame:
    """Records without infrastructure errors."""
    return records.filter(F.col("status") != "infra_error")


def with_success(records: DataFrame) -> DataFrame:
    """Records with ``success`` recomputed from what the verdict found, not taken from it."""
    from tidemill.operators.reliability import success

    v = F.col("verdict")
    return records.withColumn("success", success(v, F.col("termination").isin(*JUDGED), v["db_match"], v["values"]))


def missed_values(records: DataFrame) -> DataFrame:
    """(run_id, task_id, trial, missed): records that fail for unsaid values only, with the labels of these."""
    left = F.map_keys(F.map_filter("verdict.values", lambda k, v: ~v))
    only = F.col("verdict.db_match") & F.col("termination").isin(*JUDGED) & (F.size(left) > 0)
    return judged(records).filter(only).select("run_id", "task_id", "trial", F.array_sort(left).alias("missed"))


def utterances(records: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(run_id, task_id, trial, *utterance): voice records of episodes, with those of a flat table brought to one shape."""
    flat = records.select("run_id", "task_id", "trial", F.inline("voice"))
    return flat if others is None else flat.unionByName(others.select(*flat.columns))


def identified(records: DataFrame, tools: tuple[str, ...] = ("find_customer", "verify_caller")) -> DataFrame:
    """(task_id, share): share of a task's episodes, infrastructure errors aside, with a successful identity call."""
    found = F.exists("tool_calls", lambda t: t["ok"] & t["name"].isin(*tools))
    return judged(records).groupBy("task_id").agg(F.avg(F.coalesce(found, F.lit(False)).cast("int")).alias("share"))


def fired(records: DataFrame, axis: dict[str, Column] | None = None) -> DataFrame:
    """Records with ``fired``: the names of the axes whose predicate holds."""
    axis = axis or {
        "retry": F.exists("tool_calls", lambda t: ~t["ok"]),
        "long": F.size("llm_calls") > 30,
        "shipment": F.exists("tool_calls", lambda t: t["ok"] & (t["name"] == "track_shipment")),
    }
    return records.withColumn("fired", F.array_compact(F.array(*(F.when(p, name) for name, p in axis.items()))))


def after_held_claims(records: DataFrame) -> DataFrame:
    """(run_id, task_id, trial, index, next): what the agent's next call does after each whose claim was held back; position is ``index``,
    never the place in the array, which lists calls by role. Of several tool calls of one agent call the last counts."""
    from pyspark.sql.window import Window

    key = ["run_id", "task_id", "trial"]
    calls = records.select(*key, F.inline("llm_calls")).filter("who = 'agent'").select(*key, "index", F.col("format_error").eqNullSafe("unbacked_claim").alias("held"))
    tools = records.select(*key, F.posexplode("tool_calls").alias("pos", "t")).groupBy(*key, F.col("t.agent_call").alias("index")).agg(F.max_by("t.name", "pos").alias("tool"))
    nxt = F.lead(F.coalesce("tool", F.lit("reply"))).over(Window.partitionBy(*key).orderBy("index"))
    return calls.join(tools, [*key, "index"], "left").withColumn("next", F.coalesce(nxt, F.lit("end"))).filter("held").drop("tool", "held")


def simulated(records: DataFrame, prompts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Utterances (conv, at, index, text) of the simulated customers of episodes, and the texts (conv, at, text) that they could
    draw on, as ``operators.invented`` takes them: a text comes before an utterance if its ``at`` is smaller.

    The k-th utterance, by the index of its call, knows the first k + 1 messages that the agent sent to the customer, and the
    tool results that came before it arrived. ``prompts`` (task_id, text) hold from the start. Marks of an end are no
    part of an utterance, and notes of the harness don't count as arrivals."""
    from pyspark.sql.window import Window

    own = judged(records).withColumn("conv", F.concat_ws("/", "run_id", "task_id", F.col("trial").cast("string")))
    calls = F.array_sort(F.transform(F.filter("llm_calls", lambda c: c["who"] == "user"), lambda c: F.struct(c["index"].alias("index"), c["text"].alias("text"))))
    said = own.select("conv", F.posexplode(calls).alias("k", "c")).select("conv", (2 * F.col("k") + 1).alias("at"), "c.index", without_ending(F.coalesce("c.text", F.lit(""))).alias("text"))
    heard = own.select("conv", F.posexplode(F.filter("user_messages", lambda m: m["role"] == "user")).alias("k", "m")).select("conv", (2 * F.col("k")).cast("long").alias("at"), "m.content")
    arrivals = F.count(F.when((F.col("m.role") == "user") & ~F.coalesce("m.harness", F.lit(False)), 1)).over(Window.partitionBy("conv").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
    each = own.select("conv", F.posexplode("messages").alias("i", "m")).withColumn("arrived", arrivals)
    results = each.filter(F.col("m.role") == "tool").select("conv", (2 * F.col("arrived")).alias("at"), "m.content")
    texts = heard.union(results)
    if prompts is not None:
        texts = texts.union(own.join(prompts, "task_id").select("conv", F.lit(-1).cast("long").alias("at"), "text"))
    return said, texts.toDF("conv", "at", "text")


def append(records: DataFrame, path: str) -> None:
    """Adds records to a run as JSON lines; never changes what is there."""
    records.write.mode("append").json(path)


def copy_once(df: DataFrame, path: str) -> bool:
    """Writes a table where there is none yet; False, and nothing written, where there is."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return False
    df.write.mode("errorifexists").parquet(path)
    return True
