"""Chat formatting: tool calls linked to their results.

Calls and results are hash-joined by conversation and call identifier; the calls of a conversation are put in
topological order of what they depend on (those that could come next in the order of turn, then identifier);
arguments are validated against the tool's JSON schema; each linked call is serialised as canonical JSON (keys
sorted by code point, no blanks, integral numbers without fraction, text unescaped where JSON allows it).

calls: conv_id, turn, call_id, name, arguments (JSON), needs (array of call_ids); results: conv_id, turn,
call_id, content; tools: name, schema (JSON schema: type, properties, required, additionalProperties, items, enum,
minimum, maximum, minLength, maxLength).

Result of ``linked``: one row for each call: conv_id, call_id, name, position (1 and on in its conversation),
answered, valid, problem (the first found), json.

Defined cases: a call without result is not answered, its result is null in the JSON; a result without call is
left out; of several results of a call the first by turn, then content, counts; of repeated calls of one
identifier the first by turn, name and arguments counts, the others get the problem "repeated id" and no
position; a call that needs an unknown call has the problem "needs unknown call", one on or behind a circle
"circular" and no position; null or broken arguments are invalid and serialised as null; a tool without schema is
"unknown tool"; calls with a null conv_id or call_id are kept, never linked and without position (those without
conv_id are rows of their own and meet in no group). NaN and infinite numbers are not JSON; values nested deeper than
DEPTH are "nested too deeply" and serialised as null; half surrogates stay escaped; a schema that isn't JSON, or not a
schema, is the problem "schema: not usable"; a schema that is true allows, one that is false refuses, everything.
"""

from __future__ import annotations

import heapq
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import arrow_map, staged, table

#: Levels of nested arguments that are read.
DEPTH = 256
SCHEMA = "conv_id long, call_id string, name string, position int, answered boolean, valid boolean, problem string, json string"


def _text(value) -> str:
    """A scalar as JSON; what UTF-8 can't carry stays escaped."""
    return _HALF.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False, allow_nan=False))


_HALF = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """Canonical JSON of a parsed value; ValueError for a number that isn't finite."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_text(str(k))}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return _text(value)


def depth_of(value) -> int:
    """Levels of arrays and objects, at most one beyond DEPTH."""
    level, depth = [value], 0
    while level and depth <= DEPTH:
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        depth += 1
    return depth


def _refuse(word: str):
    raise ValueError(word)


def _number(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _refuse(text)


def parsed(text: str | None) -> tuple[object, str | None]:
    """(value, problem) of a JSON text; the value is None where there is a problem."""
    if text is None:
        return None, None
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_number)
    except RecursionError:
        return None, "nested too deeply"
    except ValueError:
        return None, "not JSON"
    return (None, "nested too deeply") if depth_of(value) > DEPTH else (value, None)


_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return kind in _KINDS and isinstance(value, _KINDS[kind])


def usable(schema) -> bool:
    """The keywords that are read have values of the kinds that JSON schema gives them, at all levels."""
    todo = [schema]
    while todo:
        s = todo.pop()
        if isinstance(s, bool):
            continue
        if not isinstance(s, dict):
            return False
        kinds, fields, more = s.get("type", []), s.get("properties", {}), s.get("additionalProperties", True)
        names = s.get("required", [])
        if not (isinstance(kinds, str) or isinstance(kinds, list) and all(isinstance(k, str) for k in kinds)):
            return False
        if not isinstance(fields, dict) or not isinstance(names, list) or not all(isinstance(n, str) for n in names):
            return False
        if not isinstance(s.get("enum", []), list) or not all(_is(s[k], "number") for k in ("minimum", "maximum", "minLength", "maxLength") if k in s):
            return False
        todo += [*fields.values(), more, *([s["items"]] if "items" in s else [])]
    return True


def problem_of(value, schema, at: str = "arguments") -> str | None:
    """The first thing that a usable schema doesn't allow."""
    if isinstance(schema, bool):
        return None if schema else f"{at}: not allowed"
    kinds = schema.get("type")
    if kinds is not None and not any(_is(value, k) for k in (kinds if isinstance(kinds, list) else [kinds])):
        return f"{at}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"
    if "enum" in schema and not any(canonical(value) == canonical(x) for x in schema["enum"]):
        return f"{at}: not among the allowed values"
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        for name in sorted(schema.get("required", [])):
            if name not in value:
                return f"{at}: {name} is missing"
        for name in sorted(value):
            more = schema.get("additionalProperties", True)
            if name in fields or isinstance(more, dict) or more is True:
                if found := problem_of(value[name], fields.get(name, more), f"{at}.{name}"):
                    return found
            else:
                return f"{at}: {name} is not known"
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            if found := problem_of(x, schema["items"], f"{at}[{k}]"):
                return found
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            return f"{at}: too short"
        if len(value) > schema.get("maxLength", math.inf):
            return f"{at}: too long"
    if _is(value, "number"):
        if value < schema.get("minimum", -math.inf):
            return f"{at}: too small"
        if value > schema.get("maximum", math.inf):
            return f"{at}: too large"
    return None


def positions(calls: list[tuple[str, tuple, list[str]]]) -> dict[str, int]:
    """Place of each call (id, rank, needs) in topological order, by rank among those that could come next; those on
    or behind a circle are left out."""
    known = {c for c, _, _ in calls}
    rank = {c: r for c, r, _ in calls}
    waits = {c: {n for n in needs if n in known} for c, _, needs in calls}
    behind: dict[str, list[str]] = {}
    for c, ns in waits.items():
        for n in ns:
            behind.setdefault(n, []).append(c)
    ready = [(rank[c], c) for c, ns in waits.items() if not ns]
    heapq.heapify(ready)
    out: dict[str, int] = {}
    while ready:
        _, c = heapq.heappop(ready)
        out[c] = len(out) + 1
        for d in behind.get(c, ()):
            waits[d].discard(c)
            if not waits[d]:
                heapq.heappush(ready, (rank[d], d))
    return out


def _checked(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each linked call by itself: whether its arguments are valid, the first problem, the JSON."""
    schemas: dict[str | None, object] = {None: None}
    valid, problem, out = [], [], []
    for text, schema, call, name, content in zip(*(batch.column(c).to_pylist() for c in ("arguments", "schema", "call_id", "name", "content"))):
        value, found = parsed(text)
        found = found and f"arguments: {found}"
        if schema not in schemas:
            got, broken = parsed(schema)
            schemas[schema] = got if not broken and usable(got) else "broken"
        if schema is None:
            found = found or "unknown tool"
        elif schemas[schema] == "broken":
            found = found or "schema: not usable"
        elif not found:
            found = problem_of(value, schemas[schema])
        valid.append(found is None)
        problem.append(found and _HALF.sub("?", found))
        out.append(canonical({"arguments": value, "id": call, "name": name, "result": content}))
    keep = [c for c in batch.schema.names if c not in ("arguments", "schema", "content")]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(valid), pa.array(problem, pa.string()), pa.array(out, pa.string())], [*keep, "valid", "problem", "json"])


def _order(t: pa.Table) -> pa.Table:
    """Positions of the first calls of one conversation."""
    ids = t.column("call_id").to_pylist()
    place = positions([(c, (r, c), n or []) for c, r, n in zip(ids, t.column("rank").to_pylist(), t.column("needs").to_pylist())])
    return t.select(["conv_id", "call_id"]).append_column("position", pa.array([place.get(c) for c in ids], pa.int32()))


def ordered(first: DataFrame) -> DataFrame:
    """(conv_id, call_id, position, unknown) of the first calls (conv_id, call_id, rank, needs) of each identifier.

    Where all that a conversation's calls need comes before them by (rank, call_id), this is their topological order, and the
    rows are numbered by a window, which sorts and spills. Only the other conversations, of which identifiers and
    needs alone are taken, are ordered by a heap."""
    need = first.select("conv_id", "call_id", "rank", F.explode(F.array_distinct("needs")).alias("need"))
    there = first.select("conv_id", F.col("call_id").alias("need"), F.col("rank").alias("need_rank"))
    edges = need.join(there, ["conv_id", "need"], "left")
    late = (F.col("need_rank") > F.col("rank")) | ((F.col("need_rank") == F.col("rank")) & (F.col("need") >= F.col("call_id")))
    facts = edges.groupBy("conv_id", "call_id").agg(F.bool_or(F.col("need_rank").isNull()).alias("unknown"), F.bool_or(F.coalesce(late, F.lit(False))).alias("late"))
    odd = facts.filter("late").select("conv_id").distinct()
    inner = first.select("conv_id", "call_id", "rank", "needs")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("rank", "call_id"))
    easy = inner.join(odd, "conv_id", "left_anti").select("conv_id", "call_id", place.alias("position"))
    hard = inner.join(odd, "conv_id", "left_semi").groupBy("conv_id").applyInArrow(_order, "conv_id long, call_id string, position int")
    return easy.unionByName(hard).join(facts.select("conv_id", "call_id", "unknown"), ["conv_id", "call_id"], "left")


def linked(calls: DataFrame, results: DataFrame, tools: DataFrame) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("call_id"), text("name"), text("arguments"), F.col("needs").cast("array<string>").alias("needs"))
    answers = (
        results.filter("conv_id is not null and call_id is not null")
        .groupBy(F.col("conv_id").cast("long").alias("conv_id"), text("call_id"))
        .agg(F.min(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"), F.col("content").cast("string").alias("content"))).alias("r"))
        .select("conv_id", "call_id", F.col("r.content").alias("content"), F.lit(True).alias("answered"))
    )
    known = tools.groupBy(text("name")).agg(F.min(F.col("schema").cast("string")).alias("schema"))
    # of the calls of one identifier the first by turn, name and arguments is the linked one
    rank = F.coalesce("turn", F.lit((1 << 63) - 1))
    order = [rank.alias("rank"), F.coalesce("name", F.lit("")).alias("n"), F.coalesce("arguments", F.lit("")).alias("a")]
    rows = calls.withColumn("key", F.xxhash64("turn", "name", "arguments", "needs"))
    first = rows.filter("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct(*order, F.xxhash64("needs").alias("h"), "key", "needs")).alias("f"), F.count("*").alias("same"))
    first = staged(first.select("conv_id", "call_id", "f.rank", "f.key", "f.needs", "same"), "calls")
    facts = first.select("conv_id", "call_id", "key", "same").join(ordered(first), ["conv_id", "call_id"])
    # equal rows of one identifier: one of them is the first
    twin = F.when(F.col("same") > 1, F.row_number().over(Window.partitionBy("conv_id", "call_id", "own").orderBy("key"))).otherwise(1)
    met = rows.withColumnRenamed("key", "own").join(facts, ["conv_id", "call_id"])
    many = met.filter("same > 1").withColumn("linked", (F.col("own") == F.col("key")) & (twin == 1))
    met = met.filter("same = 1").withColumn("linked", F.lit(True)).unionByName(many)
    none = rows.filter("conv_id is null or call_id is null").select("conv_id", "call_id", "turn", "name", "arguments", "needs", F.lit(False).alias("linked"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("boolean").alias("unknown"))
    met = met.select(*none.columns).unionByName(none)
    whole = met.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "left").join(known, "name", "left")
    answered = F.coalesce(F.col("linked") & F.col("answered"), F.lit(False))
    whole = whole.select("conv_id", "call_id", "name", "position", "linked", "unknown", answered.alias("answered"), "arguments", F.when(answered, F.col("content")).alias("content"), "schema")
    types = "conv_id long, call_id string, name string, position int, linked boolean, unknown boolean, answered boolean, valid boolean, problem string, json string"
    done = arrow_map(whole, _checked, types)
    place = (
        F.when(F.col("conv_id").isNull() | F.col("call_id").isNull(), "no id").when(~F.col("linked"), "repeated id")
        .when(F.coalesce("unknown", F.lit(False)), "needs unknown call").when(F.col("position").isNull(), "circular")
    )
    return done.select("conv_id", "call_id", "name", F.when(F.col("linked"), F.col("position")).alias("position"), "answered", "valid", F.coalesce("problem", place).alias("problem"), "json")


#: The tool of op1_tool_calls: prompts of 2,000 characters and more, and of 60 words and more, aren't valid.
_PROMPT, _WORDS = {"minLength": 1, "maxLength": 1999, "type": "string"}, {"minimum": 1, "maximum": 59, "type": "integer"}
ASK = json.dumps({"additionalProperties": False, "required": ["prompt", "words"], "type": "object", "properties": {"prompt": _PROMPT, "words": _WORDS}})


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn of ``conversations`` as a call of the tool "ask", which needs the call of the user turn two
    before; the next turn, if it is the assistant's, is its result."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    key = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    user = rows.filter("role = 'user'")
    words = F.size(F.split("text", " "))
    before = user.select("conv_id", (F.col("turn") + 2).alias("turn"), F.lit(True).alias("later")).distinct()
    calls = user.join(before, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", key(F.col("turn")).alias("call_id"), F.lit("ask").alias("name"),
        F.to_json(F.struct(words.alias("words"), F.col("text").alias("prompt"))).alias("arguments"),
        F.when(F.col("later"), F.array(key(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )
    results = rows.filter("role = 'assistant'").select("conv_id", "turn", key(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return linked(calls, results, spark.createDataFrame([("ask", ASK)], "name string, schema string"))


SQL = {
    "op1_tool_calls": """
with u as (select conv_id, turn, text, len(string_split(text, ' ')) as words from conversations where role = 'user'),
r as (select conv_id, turn - 1 as turn, min(text) as content from conversations where role = 'assistant' group by 1, 2),
c as (select u.*, r.content, r.turn is not null as answered,
        'c' || u.conv_id || '-' || u.turn as call_id,
        row_number() over (partition by u.conv_id order by u.turn) as position
      from u left join r on u.conv_id = r.conv_id and u.turn = r.turn)
select conv_id, call_id, 'ask' as name, cast(position as integer) as position, answered,
  problem is null as valid, problem,
  '{"arguments":{"prompt":' || cast(to_json(text) as varchar) || ',"words":' || words || '},"id":"' || call_id || '","name":"ask","result":'
    || coalesce(cast(to_json(content) as varchar), 'null') || '}' as json
from (select *, case when length(text) < 1 then 'arguments.prompt: too short' when length(text) > 1999 then 'arguments.prompt: too long'
                when words > 59 then 'arguments.words: too large' end as problem from c)
"""
}
QUERIES = {"op1_tool_calls": op1_tool_calls}
