"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: The JSON schema keywords that validate() knows.
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value: object) -> str:
    """JSON with sorted keys, no white space, and non-ASCII characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def validate(value: object, schema: dict, at: str = "$") -> list[str]:
    """Where value breaks schema: type, enum, required, properties, additionalProperties, items, minLength, maxLength, minimum and maximum."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"integer": number and float(value).is_integer() if number else False, "number": number}.get(kind, isinstance(value, _TYPES.get(kind, object)))
    if kind and not fits:
        return [f"{at}: not {kind}"]
    bad = []
    if "enum" in schema and value not in schema["enum"]:
        bad.append(f"{at}: not in enum")
    if isinstance(value, str):
        bad += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if number:
        bad += [f"{at}: too small"] * (value < schema.get("minimum", value)) + [f"{at}: too large"] * (value > schema.get("maximum", value))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        bad += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        bad += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known and schema.get("additionalProperties") is False]
        for k in sorted(value):
            if k in known:
                bad += validate(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            bad += validate(x, schema["items"], f"{at}[{i}]")
    return bad


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls with result (string) and status: "ok", "no result" or "ambiguous" (several results, or several calls of the identifier).

    calls: conv_id, call_id, name, arguments, after (the call_id that must come first, or null).  results: conv_id, call_id, result.
    Both sides are counted by (conv_id, call_id) before they are joined, so a repeated identifier can't multiply rows: the
    least result of several is kept.  Null identifiers link to nothing.
    """
    key = ["conv_id", "call_id"]
    told = results.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min("result").alias("result"), F.count(F.lit(1)).alias("__told"))
    times = calls.groupBy(*key).agg(F.count(F.lit(1)).alias("__times"))
    joined = calls.join(times, key, "left").join(told, key, "left")
    several = (F.coalesce("__told", F.lit(0)) > 1) | (F.coalesce("__times", F.lit(0)) > 1)
    status = F.when(several, "ambiguous").when(F.col("__told").isNull(), "no result").otherwise("ok")
    return joined.withColumn("status", status).drop("__told", "__times")


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): 0 for calls that wait for none, else one more than the call waited for; null in a cycle.

    Pointers double with each round, so a chain of n calls takes log n rounds, and no conversation is gathered in a task.
    A call that waits for an unknown one waits for none.
    """
    nodes = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("after").alias("after"))
    heads = nodes.select("conv_id", F.col("call_id").alias("after"), F.lit(1).alias("known"))
    now = nodes.join(heads, ["conv_id", "after"], "left").select("conv_id", "call_id", F.when(F.col("known") == 1, F.col("after")).alias("up"))
    now = cut(now.withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")))
    most = now.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        step = now.join(above, ["conv_id", "up"], "left")
        now = cut(step.select("conv_id", "call_id", F.when(F.col("up").isNotNull(), F.col("next")).alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
        if now.where("up is not null").isEmpty():
            break
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def serialise(linked: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """linked with valid (boolean), errors (array of strings) and json, the canonical record of the call and its result.

    arguments are JSON text; text that isn't JSON, and a name without a schema, make a call invalid, with the text kept as a string.
    """
    new = [T.StructField("valid", T.BooleanType()), T.StructField("errors", T.ArrayType(T.StringType())), T.StructField("json", T.StringType())]
    schema = T.StructType([*linked.drop("valid", "errors", "json").schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            valid, errors, out = [], [], []
            for i in range(batch.num_rows):
                name, text = cols["name"][i], cols["arguments"][i]
                try:
                    value = json.loads(text, parse_constant=_refuse) if text is not None else None
                    bad = validate(value, schemas[name]) if name in schemas else ["$: no schema"]
                except ValueError:
                    value, bad = text, ["$: not JSON"]
                record = {"arguments": value, "depth": cols["depth"][i], "id": cols["call_id"][i], "name": name, "result": cols["result"][i], "status": cols["status"][i]}
                valid.append(not bad), errors.append(bad), out.append(canonical(record))
            new = [pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "valid", "errors", "json"])

    return linked.drop("valid", "errors", "json").mapInArrow(run, schema)


def _refuse(name: str) -> None:
    raise ValueError(name)


def format_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls linked with results, with depth (their place in topological order), validated and serialised.

    Order rows of a conversation by (depth, call_id) to write them: every call stands after the call it waits for; calls in a
    cycle have a null depth.  Rows with null identifiers stay, without result and depth.  Other columns of calls are kept.

    Defined cases: null arguments are invalid and an empty result is a result; very long texts are written whole; several results of a call tie to
    the least; repeated calls are rows each; columns of calls called result, status, depth, valid, errors or json are replaced; empty tables give
    an empty table.
    """
    linked = link(calls.drop("result", "status", "depth"), results)
    deep = depths(calls)
    return serialise(linked.join(deep, ["conv_id", "call_id"], "left"), schemas)


TURN_SCHEMA = {
    "type": "object",
    "required": ["prompt", "turn"],
    "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "system": {"type": "string"}},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations: each user turn calls "reply", the next turn of the assistant is its result.

    A call waits for the user turn two turns before, if there is one, and takes the conversation's system text along.
    """
    turns = turns.where("conv_id is not null and turn is not null")
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).getField("text").alias("system"))
    asked = turns.where("role = 'user'").join(system, "conv_id", "left")
    arguments: Column = F.to_json(F.struct(F.col("text").alias("prompt"), "system", "turn"))
    calls = asked.select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"), name(F.col("turn") - 2).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.coalesce("text", F.lit("")).alias("result"))
    return calls, results


def format_conversations(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """A row for each user turn as a call, as `format_calls` gives them.

    Defined cases: turns whose conv_id or turn is null take no part; a user turn whose text is null or empty is an invalid call, an assistant's
    null text an empty result; very long texts are written whole; several system turns tie to the first; repeated
    user turns are calls each; other columns of turns are not used; an empty table gives an empty table.
    """
    return format_calls(*conversation_calls(turns.select("conv_id", "turn", "role", "text")), {"reply": TURN_SCHEMA})
