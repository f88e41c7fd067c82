"""Message payloads: text leaves out, rewritten leaves back in; field scopes; tool gates."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from json.decoder import scanstring

from pyspark.sql import Column, DataFrame, functions as F, types as T

from veilframe.functions.text import wildcard_to_regex

BLOCK = "struct<type: string, text: string, content: string>"
CALL = "struct<id: string, function: struct<name: string, arguments: string>>"
MESSAGE = f"struct<role: string, content: string, parts: array<struct<text: string>>, text: string, tool_calls: array<{CALL}>>"
PAYLOAD_SCHEMA = (
    f"messages array<{MESSAGE}>, contents array<{MESSAGE}>, input array<{MESSAGE}>, system string, instructions string, "
    "system_instruction struct<parts: array<struct<text: string>>>")

# Tools whose output is scanned, and tools whose input is restored with the fields concerned.
READ_TOOLS = ["Read", "Bash", "Grep", "Glob", "WebFetch", "WebSearch"]
WRITE_TOOLS = {"Write": ["content"], "Edit": ["new_string", "old_string"], "Bash": ["command"], "NotebookEdit": ["new_source"]}


def walk_strings(blocks: Column, fields: Column, fn: Callable[[Column], Column]) -> tuple[Column, Column]:
    """Apply a text function to the ``text`` of each block and to each value of a flat field map."""
    walked = F.transform(blocks, lambda b: b.withField("text", F.when(b["text"].isNotNull(), fn(b["text"]))))
    return walked, F.transform_values(fields, lambda _, v: fn(v))


def walk_strings_scoped(blocks: Column, fields: Column, fn: Callable[[Column], Column], scan: Column, never: Column) -> tuple[Column, Column]:
    """As ``walk_strings`` for fields inside the scope; a null ``scan`` means every field."""
    def allowed(name: Column) -> Column:
        return ~F.array_contains(F.coalesce(never, F.array().cast("array<string>")), name) & (scan.isNull() | F.array_contains(scan, name))

    walked = F.transform(blocks, lambda b: b.withField("text", F.when(allowed(F.lit("text")), fn(b["text"])).otherwise(b["text"])))
    return walked, F.transform_values(fields, lambda k, v: F.when(allowed(k), fn(v)).otherwise(v))


def resolve_scope(calls: DataFrame, scope_rules: DataFrame, default: list[str] | None = None, never: list[str] | None = None) -> DataFrame:
    """Scope of each tool call: the first rule (tool_pattern, priority, scan_fields) whose wildcard fits its tool.

    Patterns meet the distinct tool names, not the calls, so the join that is not an equality stays small.
    Adds mode ('selected' or 'all'), scan_fields and never_fields.
    """
    tools = calls.select("tool").distinct()
    rules = scope_rules.select("priority", "scan_fields", wildcard_to_regex(F.col("tool_pattern")).alias("__re"))
    scoped = tools.join(rules, F.expr("tool rlike __re")).groupBy("tool").agg(F.min_by("scan_fields", "priority").alias("scan_fields"))
    fallback = F.array(*[F.lit(f) for f in default]) if default else F.lit(None).cast("array<string>")
    out = calls.join(scoped, "tool", "left").withColumn("scan_fields", F.coalesce("scan_fields", fallback))
    nothing = F.array(*[F.lit(f) for f in never or []]).cast("array<string>")
    return out.withColumn("mode", F.when(F.col("scan_fields").isNull(), "all").otherwise("selected")).withColumn("never_fields", nothing)


def _is_blocks(text: Column) -> Column:
    """Whether a text is, as a whole, a JSON array of objects; one that only begins like it is plain text."""
    return F.ltrim(text).startswith("[") & F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("ARRAY<OBJECT"), F.lit(False))


def explode_messages(payloads: DataFrame, id_col: str = "msg_id", col: str = "payload") -> DataFrame:
    """JSON payloads to text leaves: (id, path, pos, role, text).

    Knows string and block content, tool results, parts, system text, instructions and tool-call
    arguments.  ``path`` names the place for ``reassemble_messages``.
    """
    p = payloads.select(id_col, F.from_json(col, PAYLOAD_SCHEMA).alias("p"))
    nothing = F.array().cast("array<struct<path:string,pos:int,role:string,text:string>>")

    def leaf(path: Column | str, pos: Column, role: Column, text: Column) -> Column:
        path = F.lit(path) if isinstance(path, str) else path
        return F.struct(path.alias("path"), pos.cast("int").alias("pos"), role.alias("role"), text.alias("text"))

    def message(kind: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            at = F.concat(F.lit(f"{kind}["), i.cast("string"), F.lit("]"))
            blocks = F.when(_is_blocks(m["content"]), F.from_json(m["content"], f"array<{BLOCK}>"))
            plain = F.when(blocks.isNull() & m["content"].isNotNull(), F.array(leaf(F.concat(at, F.lit(".content")), i, m["role"], m["content"])))

            def block(b: Column, j: Column, name: str) -> Column:
                return leaf(F.concat(at, F.lit(".content["), j.cast("string"), F.lit(f"].{name}")), i, m["role"], b[name])

            def part(b: Column, j: Column) -> Column:
                return leaf(F.concat(at, F.lit(".parts["), j.cast("string"), F.lit("].text")), i, m["role"], b["text"])

            def call(c: Column, j: Column) -> Column:
                return leaf(F.concat(at, F.lit(".tool_calls["), j.cast("string"), F.lit("].arguments")), i, m["role"], c["function"]["arguments"])

            return F.concat(
                F.coalesce(plain, nothing),
                F.coalesce(F.transform(blocks, lambda b, j: block(b, j, "text")), nothing),
                F.coalesce(F.transform(blocks, lambda b, j: block(b, j, "content")), nothing),
                F.coalesce(F.transform(m["parts"], part), nothing),
                F.array(leaf(F.concat(at, F.lit(".text")), i, m["role"], m["text"])),
                F.coalesce(F.transform(m["tool_calls"], call), nothing))

        return F.coalesce(F.flatten(F.transform(F.col(f"p.{kind}"), one)), nothing)

    system_blocks = F.when(_is_blocks(F.col("p.system")), F.from_json("p.system", f"array<{BLOCK}>"))
    top = F.concat(
        F.array(leaf("system", F.lit(-1), F.lit("system"), F.when(system_blocks.isNull(), F.col("p.system"))),
                leaf("instructions", F.lit(-1), F.lit("system"), F.col("p.instructions"))),
        F.coalesce(F.transform(system_blocks, lambda b, j: leaf(F.concat(F.lit("system["), j.cast("string"), F.lit("].text")), F.lit(-1), F.lit("system"), b["text"])), nothing),
        F.coalesce(F.transform(F.col("p.system_instruction.parts"), lambda b, j: leaf(F.concat(F.lit("system_instruction["), j.cast("string"), F.lit("].text")), F.lit(-1), F.lit("system"), b["text"])), nothing))
    leaves = F.concat(top, message("messages"), message("contents"), message("input"))
    return p.select(id_col, F.inline_outer(leaves)).filter("text is not null")


def reassemble_messages(leaves: DataFrame, id_col: str = "msg_id", payloads: DataFrame | None = None, col: str = "payload") -> DataFrame:
    """Rewritten leaves back to one JSON payload per id.

    With ``payloads`` (id, payload) each leaf goes back to its place in the payload it came from: only strings that
    changed are written anew, everything else, known or not, stays byte for byte, and so do payloads without leaves.
    Ids are unique. Without it the plain contents of messages make a new payload, in message order.
    """
    if payloads is None:
        rows = leaves.filter(F.col("path").rlike(r"^messages\[\d+\]\.content$"))
        m = F.array_sort(F.collect_list(F.struct("pos", "role", F.col("text").alias("content"))))
        return rows.groupBy(id_col).agg(m.alias("m")).select(id_col, F.to_json(F.struct(
            F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))).alias("payload"))
    edits = leaves.filter("text is not null").groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("__edits"))
    return payloads.join(edits, id_col, "left").withColumn(col, F.when(F.col("__edits").isNull(), F.col(col)).otherwise(edit_strings(F.col(col), F.col("__edits")))).drop("__edits")


def string_places(text: str):
    """(path, start, end, value) of every string value of a JSON text, in order; an error where it is broken.

    Paths are those of ``explode_messages``.
    """
    blank, scalar = re.compile(r"[ \t\r\n]*"), re.compile(r"[-+.0-9A-Za-z]+")
    skip = lambda i: blank.match(text, i).end()
    stack: list[list] = []  # [path of the container, next index or None for an object]
    i, path = skip(0), ""
    while True:
        c = text[i:i + 1]
        if c in ("{", "["):
            stack.append([path, None if c == "{" else 0])
            i = skip(i + 1)
            if text[i:i + 1] == ("}" if c == "{" else "]"):
                stack.pop()
                i += 1
            else:
                path, i = _enter(text, i, stack[-1], skip)
                continue
        elif c == '"':
            value, end = scanstring(text, i + 1, False)
            yield path.replace(".function.arguments", ".arguments").replace("system_instruction.parts[", "system_instruction["), i, end, value
            i = end
        else:
            i = scalar.match(text, i).end()
        while stack:  # after a value: the next member, or the ends of containers
            i = skip(i)
            if text[i] == ",":
                path, i = _enter(text, skip(i + 1), stack[-1], skip)
                break
            if text[i] != ("}" if stack[-1][1] is None else "]"):
                raise ValueError("broken JSON")
            stack.pop()
            i += 1
        else:
            return


def _enter(text: str, i: int, container: list, skip) -> tuple[str, int]:
    """Path and start of the next member of a container."""
    at, index = container
    if index is not None:
        container[1] += 1
        return f"{at}[{index}]", i
    key, end = scanstring(text, i + 1, False)
    return f"{at}.{key}" if at else key, skip(skip(end) + 1)


@F.udf(T.StringType(), useArrow=False)
def edit_strings(text: str | None, changes: dict | None) -> str | None:
    """JSON text with the string values at the given paths replaced; a broken text stays as it is.

    Rows come a hundred at a time: a payload and its changes are each as large as the message, and batches of
    thousands would hold them all twice.
    """
    if text is None or not changes:
        return text
    out, done = [], 0
    try:
        for path, start, end, value in string_places(text):
            new = changes.get(path, value)
            if new != value:
                out += [text[done:start], json.dumps(new, ensure_ascii=False)]
                done = end
    except (ValueError, AttributeError, IndexError):
        return text
    return "".join([*out, text[done:]])


def walk_deep(df: DataFrame, json_col: str, fn: Callable[[Column], Column], out: str = "json_out") -> DataFrame:
    """A text function on every string value of a JSON text, at any depth.

    Works on the serialised form: quoted runs are cut out; those that a colon follows are keys and stay, the
    others are unescaped, changed and escaped again.  Numbers and structure stay as they are.
    """
    token = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?'
    values = F.regexp_extract_all(json_col, F.lit(token), F.lit(0))
    between = F.split(json_col, token, -1)

    def changed(v: Column) -> Column:
        plain = F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
        boxed = F.to_json(F.struct(fn(plain).alias("v")))
        return F.when(v.endswith(":") | (fn(plain) == plain), v).otherwise(F.substring(boxed, F.lit(6), F.length(boxed) - 6))

    woven = F.zip_with(between, values, lambda b, v: F.concat(b, F.coalesce(changed(v), v, F.lit(""))))
    return df.withColumn(out, F.array_join(woven, ""))


def scan_gate(calls: DataFrame, read_tools: list[str] | None = None, write_tools: dict[str, list[str]] | None = None) -> DataFrame:
    """Which calls have their output scanned and which input fields are restored: adds scan_output, restore_fields."""
    reads = READ_TOOLS if read_tools is None else read_tools
    writes = WRITE_TOOLS if write_tools is None else write_tools
    fields = F.lit(None).cast("array<string>")
    for tool, names in writes.items():
        fields = F.when(F.col("tool") == tool, F.array(*[F.lit(n) for n in names])).otherwise(fields)
    return calls.withColumn("scan_output", F.col("tool").isin(*reads)).withColumn("restore_fields", fields)
