"""Linking of tool calls and their results, argument validation, canonical JSON.

Calls and results are rows; an equi-join on (conversation, identifier) links them. Calls refer to other
calls by `{"$ref": identifier}` anywhere in their arguments; a call's level is one more than the highest
level it refers to, found by joining the references level by level, and the order of a conversation is by
level, then turn, then place in the turn. Positions are numbered by range partitions that may part a
conversation, with the counts of earlier partitions carried on, so that one long conversation is not
gathered in a task.

Arguments are checked against a JSON schema for the call's name (type, required, properties,
additionalProperties, enum, const, items, lengths, bounds, pattern). Canonical JSON has sorted keys, no
blanks, and plain UTF-8. A result is a row of its own behind its call, so that no identifier's results are
gathered, however many there are.

Defined results, as `status`: linked; no_result (a call without a result); result (behind its call, with the
call's name and level); no_call (a result without a call); duplicate_call (the identifier was called before in
the conversation; the first call by turn and place gets the results, and repeated rows of it are first alike);
missing_ref (a reference to no call of the conversation); cycle (it waits for itself). Arguments that are no
JSON text of finite numbers and whole characters, or nested deeper than the JSON library reads and writes,
give valid = false and the error `arguments: not JSON`, and a content of that kind is null; a call without a
known schema has valid = null. Null texts are empty; null identifiers and calls of null conversations never
link, and other identifiers than strings link by their canonical JSON text. Further columns are not read; empty
tables give an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, shared_path

CALL_BLOCK = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
RESULT_BLOCK = re.compile(r"<tool_response>(.*?)</tool_response>", re.S)
#: Conversations and turns travel as text: pandas turns whole numbers beside nulls into floats.
CALL_SCHEMA = "conv_id string, turn string, place int, call_id string, name string, arguments string"
RESULT_SCHEMA = "conv_id string, turn string, place int, call_id string, content string"
TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}

#: Schemas of the two calls that conversation turns are read as.
TURN_SCHEMAS = {
    "set_context": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False},
    "reply": {
        "type": "object", "required": ["prompt", "turn"],
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "context": {"type": "object", "required": ["$ref"]}},
        "additionalProperties": False,
    },
}


def canonical(value: object) -> str:
    """Canonical JSON text."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def _of_type(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, TYPES[kind]) if kind in TYPES else True


def _own_violations(value: object, schema: dict) -> list[str]:
    """What breaks a schema in a value itself, its parts aside."""
    out: list[str] = []
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append("not the constant")
    if "enum" in schema and canonical(value) not in [canonical(x) for x in schema["enum"]]:
        out.append("not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append("too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append("too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append("pattern")
    elif _of_type(value, "number"):
        if value < schema.get("minimum", value):
            out.append("below minimum")
        if value > schema.get("maximum", value):
            out.append("above maximum")
    elif isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append("too few")
        if len(value) > schema.get("maxItems", len(value)):
            out.append("too many")
    return out


def _path(at: tuple) -> str:
    """The path of (path ahead, step)."""
    steps = []
    while at:
        at, step = at
        steps.append(step)
    return "".join(reversed(steps))


def violations(value: object, schema: dict, at: str = "arguments") -> list[str]:
    """What in a value breaks its schema, as `path: reason`, in the order of the value. A `$ref` object
    stands for the result of another call and satisfies any type. Depth costs no recursion."""
    out: list[str] = []
    todo: list[tuple] = [(value, schema, ((), at))]
    while todo:
        value, schema, here = todo.pop()
        if schema is None:  # a finding that waited for its turn
            out.append(f"{_path(here)}: {value}")
            continue
        if isinstance(value, dict) and set(value) == {"$ref"} and schema.get("required") != ["$ref"]:
            continue
        kinds = schema.get("type")
        if kinds is not None and not any(_of_type(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            out.append(f"{_path(here)}: not {kinds if isinstance(kinds, str) else '|'.join(kinds)}")
            continue
        out += [f"{_path(here)}: {x}" for x in _own_violations(value, schema)]
        parts: list[tuple] = []
        if isinstance(value, list) and schema.get("items"):
            parts = [(x, schema["items"], (here, f"[{k}]")) for k, x in enumerate(value)]
        elif isinstance(value, dict):
            known = schema.get("properties", {})
            out += [f"{_path(here)}.{k}: missing" for k in schema.get("required", []) if k not in value]
            for k in sorted(value):
                if k in known:
                    parts.append((value[k], known[k], (here, f".{k}")))
                elif schema.get("additionalProperties", True) is False:
                    parts.append(("unknown", None, (here, f".{k}")))
        todo.extend(reversed(parts))
    return out


def identifier(value: object) -> str | None:
    """An identifier as text: a string as it is, another value but null by its canonical JSON."""
    return value if value is None or isinstance(value, str) else canonical(value)


def references(value: object) -> list[str]:
    """The identifiers that a value refers to, sorted, once each."""
    found, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if set(x) == {"$ref"} and (own := identifier(x["$ref"])) is not None:
                found.add(own)
            todo.extend(x.values())
        elif isinstance(x, list):
            todo.extend(x)
    return sorted(found)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError("not finite")
    return value


def _json(text: str | None) -> tuple[object, str | None]:
    """(value, canonical text) of a JSON text; the text is None for one that has no canonical form in UTF-8."""
    try:
        value = json.loads(text, parse_constant=_finite, parse_float=_finite)
        plain = canonical(value)
        plain.encode()
        return value, plain
    except (TypeError, ValueError, RecursionError, MemoryError):  # UnicodeEncodeError is a ValueError
        return None, None


def _blocks(text: str, pattern: re.Pattern) -> Iterator[tuple[int, dict]]:
    """(place, object) of a text's blocks; a block that is no JSON object is empty."""
    for place, block in enumerate(pattern.findall(text)):
        found, plain = _json(block)
        yield place, found if plain is not None and isinstance(found, dict) else {}


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with conversation and turn as numbers again."""
    return rows.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))


def _spoken(conversations: DataFrame, role: str, mark: str) -> DataFrame:
    """(conv_id, turn, text), all as text, of a role's turns with a mark."""
    found = conversations.where((F.col("role") == role) & F.contains("text", F.lit(mark)))
    return found.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("string").alias("turn"), "text")


def parse_calls(conversations: DataFrame) -> DataFrame:
    """Calls written as <tool_call>{"id", "name", "arguments"}</tool_call> blocks in assistant turns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, turn, text in zip(batch["conv_id"], batch["turn"], batch["text"]):
                for place, found in _blocks(text, CALL_BLOCK):
                    name = found.get("name")
                    rows.append((conv, turn, place, identifier(found.get("id")), name if isinstance(name, str) else None, canonical(found["arguments"]) if "arguments" in found else None))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "place", "call_id", "name", "arguments"])

    return _keyed(_spoken(conversations, "assistant", "<tool_call>").mapInPandas(run, CALL_SCHEMA))


def parse_results(conversations: DataFrame) -> DataFrame:
    """Results written as <tool_response>{"id", "content"}</tool_response> blocks in tool turns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for conv, turn, text in zip(batch["conv_id"], batch["turn"], batch["text"]):
                for place, found in _blocks(text, RESULT_BLOCK):
                    rows.append((conv, turn, place, identifier(found.get("id")), canonical(found.get("content"))))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "place", "call_id", "content"])

    return _keyed(_spoken(conversations, "tool", "<tool_response>").mapInPandas(run, RESULT_SCHEMA))


def _identifier(turn: Column) -> Column:
    return F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations: a system turn calls set_context, a user turn calls reply and
    refers to the system turn 0 where there is one, and an assistant turn is the result of the turn before."""
    text = F.coalesce("text", F.lit(""))
    systems = conversations.where("role = 'system' and turn = 0").select("conv_id", F.lit(True).alias("led")).distinct()
    asked = conversations.where("role in ('system', 'user')").join(systems, "conv_id", "left")
    context = F.when((F.col("role") == "user") & F.col("led") & (F.col("turn") > 0), F.struct(_identifier(F.lit(0)).alias("$ref")))
    reply = F.to_json(F.struct(context.alias("context"), text.alias("prompt"), F.col("turn").alias("turn")))
    calls = asked.select(
        "conv_id", "turn", F.lit(0).alias("place"), _identifier(F.col("turn")).alias("call_id"), F.when(F.col("role") == "system", "set_context").otherwise("reply").alias("name"),
        F.when(F.col("role") == "system", F.to_json(F.struct(text.alias("text")))).otherwise(reply).alias("arguments"),
    )
    answered = conversations.where("role = 'assistant'")
    results = answered.select("conv_id", "turn", F.lit(0).alias("place"), _identifier(F.col("turn") - 1).alias("call_id"), F.to_json(F.struct(text.alias("text"))).alias("content"))
    return calls, results


def _checked(calls: DataFrame, schemas: dict) -> DataFrame:
    """calls with canonical arguments, their references, and what they break."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, text in zip(batch["name"], batch["arguments"]):
                value, plain = _json(text)
                if plain is None:
                    rows.append((None, [], False, "arguments: not JSON"))
                    continue
                wrong = violations(value, schemas[name]) if name in schemas else None
                rows.append((plain, references(value), None if wrong is None else not wrong, "; ".join(wrong or [])))
            found = pd.DataFrame(rows, columns=["canonical", "refs", "valid", "errors"], index=batch.index)
            yield pd.concat([batch.drop(columns=["arguments"]), found], axis=1)

    schema = "conv_id string, turn string, place int, call_id string, name string, canonical string, refs array<string>, valid boolean, errors string"
    keys = [F.col(c).cast("string").alias(c) for c in ("conv_id", "turn")]
    return _keyed(calls.select(*keys, F.coalesce("place", F.lit(0)).alias("place"), "call_id", "name", "arguments").mapInPandas(run, schema))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, missing) of calls (conv_id, call_id, refs) with unique identifiers; a null
    level means that it waits for itself. One round of joins for each level of references; the rounds append to
    one table, so that the plan of a round does not grow with their number."""
    spark, keys = calls.sparkSession, ["conv_id", "call_id"]
    edges = materialize(calls.select(*keys, F.explode("refs").alias("ref")), "references")
    known = calls.select("conv_id", F.col("call_id").alias("ref")).join(edges.select("conv_id", "ref").distinct(), ["conv_id", "ref"])
    real = materialize(edges.join(known, ["conv_id", "ref"]), "references")
    lost = edges.join(known, ["conv_id", "ref"], "left_anti").select(*keys).distinct().withColumn("missing", F.lit(True))
    waiting = materialize(real.select(*keys).distinct(), "waiting")
    path = shared_path(spark, "levels")
    first = real.select("conv_id", F.col("ref").alias("call_id")).distinct().join(waiting, keys, "left_anti").withColumn("level", F.lit(0))
    first.write.parquet(path)
    while not waiting.isEmpty():
        settled = spark.read.schema(first.schema).parquet(path)
        links = real.join(waiting, keys).join(settled.withColumnRenamed("call_id", "ref"), ["conv_id", "ref"], "left")
        ready = links.groupBy(*keys).agg(F.max("level").alias("high"), F.count_if(F.col("level").isNull()).alias("open")).where("open = 0")
        ready = materialize(ready.select(*keys, (F.col("high") + 1).alias("level")), "ready")
        if ready.isEmpty():
            break
        ready.write.mode("append").parquet(path)
        after = materialize(waiting.join(ready, keys, "left_anti"), "waiting")
        release(waiting, ready)
        waiting = after
    settled = spark.read.schema(first.schema).parquet(path)
    stuck = waiting.withColumn("stuck", F.lit(True))
    out = calls.select(*keys).join(settled, keys, "left").join(stuck, keys, "left").join(lost, keys, "left")
    return out.select(*keys, F.when(F.col("stuck").isNull(), F.coalesce("level", F.lit(0))).alias("level"), F.coalesce("missing", F.lit(False)).alias("missing"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `position`, from 0 in each conversation by `order` (which must settle every tie)."""
    placed = rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id())
    placed = materialize(placed, "placed")
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = counts.select("conv_id", "part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    ranked = placed.withColumn("inside", inside)
    joined = ranked.join(carried.withColumnRenamed("conv_id", "_conv"), (F.col("conv_id").eqNullSafe(F.col("_conv"))) & (ranked["part"] == carried["part"]))
    return joined.select(*rows.columns, (F.col("before") + F.col("inside") - 1).alias("position"))


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row a call and one a result:
    (conv_id, position, call_id, name, turn, status, level, valid, errors, n_results, message)."""
    keys = ["conv_id", "call_id"]
    named = F.col("call_id").isNotNull() & F.col("conv_id").isNotNull()
    checked = _checked(calls, schemas)
    ident = F.sha2(F.concat_ws("\0", F.coalesce("canonical", F.lit("")), F.coalesce("name", F.lit(""))), 256)
    checked = materialize(checked.withColumn("tie", ident), "calls")
    # The first call of an identifier; aggregates, so that a repeated identifier is not gathered.
    here = F.struct("turn", "place", "tie")
    firsts = checked.where(named).groupBy(*keys).agg(F.min(here).alias("least"))
    marked = checked.join(firsts, keys, "left").withColumn("first", F.coalesce(F.col("least") == here, F.lit(True)))
    marked = materialize(marked.drop("least"), "calls")
    owners = marked.where(F.col("first") & named).select(*keys, "name", "turn", "place", "tie", "refs").dropDuplicates(keys)
    owners = materialize(owners, "owners")
    level = materialize(levels(owners.select(*keys, "refs")), "call-levels")
    said = results.select(*keys, "turn", F.coalesce("place", F.lit(0)).alias("place"), "content")
    counts = said.where(named).groupBy(*keys).agg(F.count("*").alias("n"))
    joined = marked.join(level, keys, "left").join(counts, keys, "left")
    n = F.when(F.col("first"), F.coalesce("n", F.lit(0))).otherwise(0)
    status = F.when(~F.col("first"), "duplicate_call").when(F.col("missing"), "missing_ref").when(named & F.col("level").isNull(), "cycle").when(n > 0, "linked").otherwise("no_result")
    called = joined.select(
        *keys, "name", "turn", status.alias("status"), "level", "valid", "errors", n.cast("long").alias("n_results"), "canonical", F.lit(None).cast("string").alias("content"),
        F.lit(0).alias("kind"), F.col("turn").alias("call_turn"), "place", "tie",
    )
    # A result stands behind its call, which lends it its place in the order; one without a call stands for itself.
    asked = owners.join(level, keys).select(*keys, "name", "level", F.col("turn").alias("call_turn"), F.col("place").alias("call_place"), F.col("tie").alias("call_tie"), F.lit(True).alias("met"))
    told = said.join(asked, keys, "left")
    own = F.sha2(F.coalesce("content", F.lit("")), 256)
    heard = told.select(
        *keys, "name", "turn", F.when(F.col("met"), "result").otherwise("no_call").alias("status"), "level", F.lit(None).cast("boolean").alias("valid"), F.lit("").alias("errors"),
        F.when(F.col("met"), 0).otherwise(1).cast("long").alias("n_results"), F.lit(None).cast("string").alias("canonical"), "content", F.when(F.col("met"), 1).otherwise(0).alias("kind"),
        F.when(F.col("met"), F.col("call_turn")).otherwise(F.col("turn")).alias("call_turn"), F.when(F.col("met"), F.col("call_place")).otherwise(F.col("place")).alias("place"),
        F.when(F.col("met"), F.col("call_tie")).otherwise(own).alias("tie"), F.col("place").alias("own_place"), own.alias("own_tie"),
    )
    rows = called.withColumn("own_place", F.lit(0)).withColumn("own_tie", F.lit("")).unionByName(heard)
    # Calls that wait for themselves, and their results, come last.
    stuck = F.col("level").isNull() & ((F.col("status") == "cycle") | (F.col("status") == "result"))
    order = ["last", "level", "call_turn", "place", "call_id", "tie", "kind", "turn", "own_place", "own_tie", "status"]
    rows = numbered(rows.withColumn("last", stuck), order)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for call_id, name, text, content, status in zip(batch["call_id"], batch["name"], batch["canonical"], batch["content"], batch["status"]):
                # Keys in order around texts that are canonical already.
                fields = ['"arguments":' + text] if isinstance(text, str) else []
                if status in ("result", "no_call"):
                    fields.append('"content":' + (_json(content)[1] or "null"))
                fields.append('"id":' + canonical(call_id if isinstance(call_id, str) else None))
                if isinstance(name, str):
                    fields.append('"name":' + canonical(name))
                out.append("{" + ",".join(fields) + "}")
            yield batch.drop(columns=["canonical", "content"]).assign(message=out, level=batch["level"].astype("Int32"), valid=batch["valid"].astype("boolean"))

    texts = [F.col(c).cast("string").alias(c) for c in ("conv_id", "turn")]
    columns = ["position", "call_id", "name", "status", "level", "valid", "errors", "n_results", "canonical", "content"]
    schema = "conv_id string, turn string, position long, call_id string, name string, status string, level int, valid boolean, errors string, n_results long, message string"
    written = _keyed(rows.select(*texts, *columns).mapInPandas(write, schema))
    return written.select("conv_id", "position", "call_id", "name", "turn", "status", "level", "valid", "errors", "n_results", "message")


def link_conversations(conversations: DataFrame, schemas: dict | None = None) -> DataFrame:
    """The linked calls of a conversations table: its tool blocks, and its turns read as calls."""
    plain = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    calls, results = turns_as_calls(plain)
    calls = calls.unionByName(parse_calls(plain))
    results = results.unionByName(parse_results(plain))
    return link(calls, results, {**TURN_SCHEMAS, **(schemas or {})})
