"""Chat formatting (operator 5): tool calls linked to results by identifier, ordered, validated, as canonical JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikiloom.llm.common import bounded, stage

#: Schemas that arguments are held against where none are given: JSON Schema's types, by tool.
DEFAULT_SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}},
}

_TYPES = {
    "object": lambda x: isinstance(x, dict),
    "array": lambda x: isinstance(x, list),
    "string": lambda x: isinstance(x, str),
    "boolean": lambda x: isinstance(x, bool),
    "null": lambda x: x is None,
    "integer": lambda x: (isinstance(x, int) and not isinstance(x, bool)) or (isinstance(x, float) and x.is_integer()),
    "number": lambda x: isinstance(x, int | float) and not isinstance(x, bool),
}


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; ValueError for what has none: non-finite numbers, halves of surrogate pairs."""
    try:
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except RecursionError:
        text = _written(value)
    text.encode()
    return text


def _written(value) -> str:
    """What json.dumps() gives in canonical(), however deep."""
    out, open_ = [], [(iter([value]), "")]
    while open_:
        items, end = open_[-1]
        x = next(items, open_)
        if x is open_:
            open_.pop()
            out.append(end)
            continue
        if end and out[-1] not in ("{", "["):
            out.append(",")
        if end == "}":
            out.append(f"{json.dumps(x[0], ensure_ascii=False)}:")
            x = x[1]
        if isinstance(x, dict | list) and x:
            out.append("{" if isinstance(x, dict) else "[")
            open_.append((iter(sorted(x.items(), key=lambda e: e[0])), "}") if isinstance(x, dict) else (iter(x), "]"))
        else:
            out.append(json.dumps(x, ensure_ascii=False, allow_nan=False))
    return "".join(out)


def loads(text: str):
    """json.loads(), however deep the value."""
    try:
        return json.loads(text)
    except RecursionError:
        return _read(text)


def _read(text: str):
    scan, blank = json.JSONDecoder().scan_once, re.compile(r"[ \t\n\r]*")
    at = lambda i: blank.match(text, i).end()
    char = lambda i: text[i : i + 1]
    i, open_, top = at(0), [], []

    def key(i: int) -> tuple[str, int]:
        if char(i) != '"':
            raise ValueError("no key")
        name, i = scan(text, i)
        if char(i := at(i)) != ":":
            raise ValueError("no colon")
        return name, at(i + 1)

    holder, name = top, None
    while True:
        c = char(i)
        if c in ("{", "["):
            new, end = ({}, "}") if c == "{" else ([], "]")
            i = at(i + 1)
            if char(i) != end:
                open_.append((holder, name))
                holder, name = new, None
                if end == "}":
                    name, i = key(i)
                continue
            value, i = new, i + 1
        else:
            try:
                value, i = scan(text, i)
            except StopIteration as e:
                raise ValueError("no value") from e
        while True:  # the value is whole: put it in, and close what ends here
            if isinstance(holder, dict):
                holder[name] = value
            else:
                holder.append(value)
            i = at(i)
            if not open_:
                if i < len(text):
                    raise ValueError("more behind the value")
                return top[0]
            c, end = char(i), "}" if isinstance(holder, dict) else "]"
            i = at(i + 1)
            if c == ",":
                if end == "}":
                    name, i = key(i)
                break
            if c != end:
                raise ValueError("not closed")
            value, (holder, name) = holder, open_.pop()


def read_json(text: str):
    """The value of a JSON text; ValueError where it isn't JSON or can't be written again."""
    value = loads(text)
    canonical(value)
    return value


def problems(value, schema: dict, at: str = "$") -> Iterator[str]:
    """What is wrong with value: type, enum, required, properties, additionalProperties, items, minimum and maximum."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(k in _TYPES and _TYPES[k](value) for k in kinds):
        yield f"{at}: not {'/'.join(kinds)}"
        return
    if "enum" in schema and not any(value == x and isinstance(value, bool) == isinstance(x, bool) for x in schema["enum"]):
        yield f"{at}: not in enum"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in sorted(set(schema.get("required", [])) - set(value)):
            yield f"{at}.{name}: missing"
        for name in sorted(value):
            if name in known:
                yield from problems(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties") is False:
                yield f"{at}.{name}: unknown"
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, x in enumerate(value):
            yield from problems(x, schema["items"], f"{at}[{i}]")
    if _TYPES["number"](value):
        if value < schema.get("minimum", value):
            yield f"{at}: under minimum"
        if value > schema.get("maximum", value):
            yield f"{at}: over maximum"


def _needs(value) -> Iterator[str]:
    """Identifiers that arguments refer to, as {"$ref": "<call id>"} at any depth."""
    open_ = [value]
    while open_:
        x = open_.pop()
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                yield x["$ref"]
            open_ += x.values()
        elif isinstance(x, list):
            open_ += x


def read_message(role: str | None, text: str | None, schemas: dict) -> tuple[str, list[dict], str | None]:
    """Content, calls and the identifier of the call that a result answers.

    Structured messages are JSON objects: {"content", "tool_calls": [{"id", "name", "arguments"}]} from the assistant and
    {"tool_call_id", "content"} from a tool. Calls may also be {"id", "type", "function": {"name", "arguments"}}; what else
    a call says is kept as "extra". Any other text, JSON or not, is plain content: also what holds half a surrogate pair. Arguments written as a string stay a string where the same holds for them.
    """
    text = text or ""
    if not text.lstrip().startswith("{"):
        return text, [], None
    try:
        said = read_json(text)
    except ValueError:
        return text, [], None
    if not isinstance(said, dict):
        return text, [], None
    content = said.get("content") if isinstance(said.get("content"), str) else ("" if said.get("content") is None else canonical(said["content"]))
    if role == "tool" and isinstance(said.get("tool_call_id"), str):
        return content, [], said["tool_call_id"]
    if not isinstance(said.get("tool_calls"), list):
        return text, [], None
    calls = []
    for k, call in enumerate(said["tool_calls"]):
        more = {} if isinstance(call, dict) else {"call": call}
        call = dict(call) if isinstance(call, dict) else {}
        nested = call.pop("function") if isinstance(call.get("function"), dict) else {}
        inner = {x: nested[x] for x in nested if x not in ("name", "arguments") or x in call}
        call = {x: nested[x] for x in ("name", "arguments") if x in nested} | call
        args = call.get("arguments", {})
        more |= {x: call[x] for x in call if x != "arguments" and not (x in ("id", "name") and isinstance(call[x], str)) and (x, call[x]) != ("type", "function")}
        more |= {"function": inner} if inner else {}
        if isinstance(args, str):  # JSON in JSON, as some APIs write it
            try:
                args = read_json(args)
            except ValueError:
                pass
        name = call.get("name") if isinstance(call.get("name"), str) else ""
        wrong = list(problems(args, schemas[name])) if name in schemas else [f"unknown tool: {name}"]
        calls.append({"place": k, "id": call.get("id") if isinstance(call.get("id"), str) else None, "name": name, "arguments": canonical(args), "needs": sorted(set(_needs(args))), "error": "; ".join(wrong), "extra": canonical(more) if more else None})
    return content, calls, None


def messages(turns: DataFrame, schemas: dict, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, turn, mark (hash of role and text), role, content, calls, answers: one row per distinct row of turns."""
    call = pa.struct([("place", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("needs", pa.list_(pa.string())), ("error", pa.string()), ("extra", pa.string())])
    kinds = [turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 4):
            got = [read_message(r, t, schemas) for r, t in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            made = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(call)), pa.array([g[2] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *made], ["conv", "turn", "mark", "role", "content", "calls", "answers"])

    bare = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(F.isnull(role_col), role_col, F.isnull(text_col), text_col).alias("mark"), F.col(role_col).cast("string").alias("role"), F.col(text_col).alias("t"))
    return bare.mapInArrow(run, f"conv {kinds[0]}, turn {kinds[1]}, mark long, role string, content string, calls array<struct<place:int,id:string,name:string,arguments:string,needs:array<string>,error:string,extra:string>>, answers string")


def _levels(waits: DataFrame, roots: DataFrame) -> DataFrame:
    """conv, id, level of the calls in waits (conv, id, need) that are not in or behind a cycle; roots have theirs.

    Calls that need a single one are led past others of that kind, twice as far each round, so long chains take few
    rounds; what is not through after as many rounds as any chain could take runs in a cycle. Calls that need several
    take a round a level, until a round adds none; only the calls still open are carried.
    """
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("end") == F.col("i"))
    n = waits.groupBy("conv", "id").agg(F.count("*").alias("n"), F.min("need").alias("end"))
    led = stage(n.filter("n = 1").select("conv", "id", "end", F.lit(1).cast("long").alias("far")), "led")
    for _ in range(led.count().bit_length() + 1):
        on = led.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("end").alias("e"), F.col("far").alias("f"))
        step = stage(led.join(on, same, "left").select("conv", "id", F.coalesce("e", "end").alias("end"), (F.col("far") + F.coalesce("f", F.lit(0))).alias("far"), F.col("e").isNotNull().alias("moved")), "led")
        led = step.drop("moved")
        if not step.filter("moved").head(1):
            break
    several = waits.join(n.filter("n > 1").select(F.col("conv").alias("c"), F.col("id").alias("i")), F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")), "left_semi").withColumnRenamed("need", "end")
    on = led.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("end").alias("e"), F.col("far").alias("f"))
    nothing = F.lit(None).cast("int")
    rest = stage(several.join(on, same, "left").select("conv", "id", F.coalesce("e", "end").alias("end"), F.coalesce("f", F.lit(0)).alias("far"), nothing.alias("level")), "open")
    new, parts = roots, [roots]
    while rest.head(1):
        met = new.select(F.col("conv").alias("c"), F.col("id").alias("i"), F.col("level").alias("l"))
        told = stage(rest.join(met, same, "left").select("conv", "id", "end", "far", F.coalesce("level", (F.col("l") + F.col("far")).cast("int")).alias("level")), "open")
        new = stage(told.groupBy("conv", "id").agg(F.count("*").alias("n"), F.count("level").alias("k"), (F.max("level") + 1).alias("level")).filter("n = k").select("conv", "id", "level"), "ready")
        if not new.head(1):
            break
        parts.append(new)
        if len(parts) > 32:
            parts = [stage(reduce(DataFrame.unionByName, parts), "level")]
        rest = told.join(new.select(F.col("conv").alias("c"), F.col("id").alias("i")), F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")), "left_anti")
    known = stage(reduce(DataFrame.unionByName, parts), "level")
    by_end = known.select(F.col("conv").alias("c"), F.col("id").alias("i"), "level")
    single = led.join(by_end, same).select("conv", "id", (F.col("level") + F.col("far")).cast("int").alias("level"))
    return stage(known.join(roots.select(F.col("conv").alias("c"), F.col("id").alias("i")), F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")), "left_anti").unionByName(single), "level")


def linked_calls(read: DataFrame) -> DataFrame:
    """conv, turn, mark, place, id, name, arguments, error, extra, result, level for each call of read (of messages()).

    A call's result is that of the earliest message of a tool that names its identifier; where an identifier is used
    twice in a conversation, the earliest call has it and the others are errors. level: 0 for calls that need no other,
    else one more than the greatest of those needed; null for calls in or behind a cycle; needs that no call of the
    conversation has are errors.
    """
    each = read.select("conv", "turn", "mark", F.explode("calls").alias("c")).select("conv", "turn", "mark", "c.*")
    order = F.struct("turn", "mark", "place")
    first = each.filter("id is not null").groupBy("conv", "id").agg(F.min(order).alias("first"))
    told = each.join(first, each["id"].eqNullSafe(first["id"]) & each["conv"].eqNullSafe(first["conv"]), "left").select(each["*"], "first")
    wrong = F.when(F.col("id").isNull(), F.lit("no id")).when(F.col("first") != order, F.lit("repeated id"))
    told = stage(told.withColumn("own", F.coalesce(F.col("first") == order, F.lit(False))).withColumn("error", F.concat_ws("; ", F.when(F.col("error") != "", F.col("error")), wrong)).drop("first"), "calls")

    answers = read.filter("role = 'tool' and answers is not null").groupBy(F.col("conv").alias("c"), F.col("answers").alias("a")).agg(F.min(F.struct("turn", "content")).alias("r"))
    result = told.join(answers, F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("a")) & F.col("own"), "left").withColumn("result", F.col("r.content")).drop("c", "a", "r")

    # the calls that need others
    owned = told.filter("own")
    needing = owned.filter("size(needs) > 0").select("conv", "id", F.explode("needs").alias("need"))
    have = owned.select(F.col("conv").alias("c"), F.col("id").alias("i"))
    known = needing.join(have, F.col("conv").eqNullSafe(F.col("c")) & (F.col("need") == F.col("i")), "left_semi")
    missing = needing.join(have, F.col("conv").eqNullSafe(F.col("c")) & (F.col("need") == F.col("i")), "left_anti").groupBy("conv", "id").agg(F.array_sort(F.collect_set("need")).alias("lost"))
    waits = stage(known, "waits")
    later = waits.select("conv", "id").distinct()
    level = stage(owned.select("conv", "id").join(later.select(F.col("conv").alias("c"), F.col("id").alias("i")), F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")), "left_anti").withColumn("level", F.lit(0)), "level")
    if waits.head(1):
        level = level.unionByName(_levels(waits, level))
    sides = (level.select(F.col("conv").alias("c"), F.col("id").alias("i"), "level"), missing.select(F.col("conv").alias("c"), F.col("id").alias("i"), "lost"))
    for side in sides:
        result = result.join(side, F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("i")) & F.col("own"), "left").drop("c", "i")
    late = F.when(F.col("lost").isNotNull(), F.concat(F.lit("needs unknown: "), F.array_join("lost", ","))).when(F.col("level").isNull() & F.col("own"), F.lit("cycle"))
    return result.withColumn("error", F.concat_ws("; ", F.when(F.col("error") != "", F.col("error")), late)).drop("lost", "own", "needs")


def chat_messages(turns: DataFrame, schemas: dict | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per distinct turn: conversation, turn, role, n_calls, n_linked, n_invalid, orphan, json.

    json is the message in canonical form: {"content", "role"}, with "tool_calls" (arguments, error, id, level, name,
    result, and extra where a call says more, in the order of level, identifier and place) where there are calls, and "tool_call_id" for results. Levels
    give the order in which calls of a conversation can run. orphan: a result that answers no call. Nothing is held by
    conversation, so one that has a third of all turns is spread like any other; order by (conversation, turn) to write
    it out. Null roles and texts are empty strings; rows that are equal count once; null conversations and turns are
    kept; an empty table gives no rows; other columns are ignored.
    """
    schemas = DEFAULT_SCHEMAS if schemas is None else schemas
    read = stage(messages(turns, schemas, conv_col, turn_col, role_col, text_col).dropDuplicates(["conv", "turn", "mark"]), "messages")
    calls = linked_calls(read)
    text = F.to_json(F.struct("arguments", "error", "extra", "id", "level", "name", "place", "result"), {"ignoreNullFields": "false"})
    rank = F.struct(F.col("level").isNull().alias("late"), "level", F.coalesce("id", F.lit("")).alias("id"), "place", text.alias("text"))
    by_turn = calls.groupBy("conv", "turn", "mark").agg(F.sort_array(F.collect_list(rank)).alias("tools"), F.count("result").alias("n_linked"), F.sum((F.col("error") != "").cast("long")).alias("n_invalid"))
    by_turn = by_turn.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("mark").alias("m"), F.col("tools.text").alias("tools"), "n_linked", "n_invalid")
    asked = calls.filter("id is not null").select(F.col("conv").alias("c2"), F.col("id").alias("i2")).distinct()

    out = read.withColumn("n_calls", F.size("calls").cast("long")).drop("calls")
    out = out.join(by_turn, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("mark") == F.col("m")), "left")
    out = out.join(asked, F.col("conv").eqNullSafe(F.col("c2")) & (F.col("answers") == F.col("i2")), "left")
    orphan = F.col("answers").isNotNull() & F.col("i2").isNull()
    zero = F.lit(0).cast("long")
    out = out.select("conv", "turn", "role", "content", "answers", "n_calls", F.coalesce("n_linked", zero).alias("n_linked"), F.coalesce("n_invalid", zero).alias("n_invalid"), orphan.alias("orphan"), "tools")
    kinds = {c: t for c, t in out.dtypes}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 3):
            said = []
            for role, content, answers, n, tools in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5, 9)), strict=True):
                made: dict = {"role": role or "", "content": content}
                if n:
                    made["tool_calls"] = []
                    for x in map(json.loads, tools):
                        x["arguments"] = loads(x["arguments"])
                        del x["place"]
                        extra = x.pop("extra")
                        if extra is not None:
                            x["extra"] = loads(extra)
                        made["tool_calls"].append(x)
                if answers is not None:
                    made["tool_call_id"] = answers
                said.append(canonical(made))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 5, 6, 7, 8)), pa.array(said, pa.string())], ["conv", "turn", "role", "n_calls", "n_linked", "n_invalid", "orphan", "json"])

    made = out.mapInArrow(write, f"conv {kinds['conv']}, turn {kinds['turn']}, role string, n_calls long, n_linked long, n_invalid long, orphan boolean, json string")
    return made.withColumnRenamed("conv", conv_col).withColumnRenamed("turn", turn_col)
