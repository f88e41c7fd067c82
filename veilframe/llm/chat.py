"""Chat formatting: the fingerprint of a record's nested field paths selects a declarative mapping to canonical turns.

Layouts are recognised by a hash of their sorted field paths, so records of many sources are dealt with by one
look-up and no branch per source. Two entries: ``turns_of_records`` for JSON texts of mixed layouts (fingerprint
per row) and ``turns_of_frame`` for typed columns (fingerprint of the schema).

Template: ``### role`` line, escaped text, ``</turn>`` line. Inside texts ``\\`` becomes ``\\\\``, ``#`` becomes
``\\#`` and ``</`` becomes ``<\\/``; so no control string can occur inside a text and dropping one backslash of each
pair restores it. Roles are percent-encoded.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F, types as T

TURN = "struct<role:string,text:string>"
OPEN, CLOSE = "### ", "</turn>\n"


def _fp(paths: list[str]) -> str:
    return hashlib.sha256("|".join(sorted(paths)).encode()).hexdigest()


def _paths(turns: tuple[tuple[str, str], ...]) -> list[str]:
    """Field paths that a mapping reads."""
    out = []
    for role, path in turns:
        if role == "*":
            array, r, t = path.split(":")
            out += [f"{array}[].{r}", f"{array}[].{t}"]
        else:
            out += path.split("+")
    return out


def _rule(*turns: tuple[str, str]) -> tuple[str, dict]:
    return _fp(_paths(turns)), {"turns": turns}


#: Layouts by fingerprint. ``turns``: (role, path) in order, or ("*", array path) with the names of role and text fields.
MAPPINGS: dict[str, dict] = dict([
    _rule(("*", "messages:role:content")),
    _rule(("*", "conversations:from:value")),
    _rule(("*", "turns:role:text")),
    _rule(("system", "system"), ("*", "messages:role:content")),
    _rule(("system", "system"), ("*", "conversations:from:value")),
    _rule(("user", "prompt"), ("assistant", "response")),
    _rule(("user", "prompt"), ("assistant", "completion")),
    _rule(("user", "question"), ("assistant", "answer")),
    _rule(("user", "context+question"), ("assistant", "answer")),
    _rule(("user", "query"), ("assistant", "response")),
    _rule(("user", "input"), ("assistant", "output")),
    _rule(("user", "instruction"), ("assistant", "output")),
    _rule(("user", "instruction"), ("assistant", "response")),
    _rule(("user", "instruction+input"), ("assistant", "output")),
    _rule(("user", "instruction+context"), ("assistant", "response")),
    _rule(("system", "system"), ("user", "prompt"), ("assistant", "response")),
])
#: Field paths that some mapping reads; others (ids, sources, weights, scores) are no part of a fingerprint.
KNOWN = sorted({p for layout in MAPPINGS.values() for p in _paths(layout["turns"])})
#: Other names of roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def schema_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def _role(role: Column) -> Column:
    out = F.lower(F.coalesce(role, F.lit("")))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(names[out], role, F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_role(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _picked(role: str, text: str):
    return lambda x: _turn(x[role], x[text])


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws("\n", *[F.when(p != "", p) for p in parts])


def turns_of_frame(df: DataFrame, columns: list[str], out: str = "turns") -> DataFrame:
    """Adds canonical turns from typed columns; the schema's fingerprint selects the mapping.

    Raises ``ValueError`` for an unknown layout: it is known before any row is read. Fields of a message that no
    mapping reads do not matter. Null texts are empty, a null array has no turns.
    """
    paths = schema_paths(df.select(*columns).schema)
    layout = MAPPINGS.get(_fp([p for p in paths if "[]" not in p or p in KNOWN]))
    if layout is None:
        raise ValueError(f"no mapping for {paths}")
    turns = []
    for role, path in layout["turns"]:
        if role == "*":
            array, r, t = path.split(":")
            turns.append(F.coalesce(F.transform(array, _picked(r, t)), F.array().cast(f"array<{TURN}>")))
        else:
            turns.append(F.array(_turn(F.lit(role), _joined([F.col(p) for p in path.split("+")]) if "+" in path else F.col(path))))
    return df.withColumn(out, F.concat(*turns))


def _is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def _variant_text(value: Column) -> Column:
    """Text of a JSON value: a string as it is; of a list its strings and ``text`` fields, other blocks as JSON, by lines."""
    def block(x: Column) -> Column:
        return F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string"))

    blocks = F.transform(F.try_variant_get(value, "$", "array<variant>"), block)
    return F.when(_is_array(value), F.array_join(blocks, "\n")).otherwise(F.try_variant_get(value, "$", "string"))


def _message(role: str, text: str):
    return lambda x: _turn(F.try_variant_get(x, f"$.{role}", "string"), _variant_text(F.try_variant_get(x, f"$.{text}", "variant")))


def _has(doc: Column, path: str) -> Column:
    """Whether a record has a field path: for a list, whether it is empty or one of its elements has the field."""
    if "[]" not in path:
        return F.try_variant_get(doc, f"$.{path}", "variant").isNotNull()
    array, field = path.split("[].")
    items = F.try_variant_get(doc, f"$.{array}", "array<variant>")
    here = F.exists(items, lambda x: F.try_variant_get(x, f"$.{field}", "variant").isNotNull())
    return F.coalesce((F.size(items) == 0) | here, F.lit(False))


def turns_of_records(df: DataFrame, payload: str, out: str = "turns", fingerprint: str = "layout") -> DataFrame:
    """Adds canonical turns and the layout fingerprint from JSON records of mixed layouts.

    The fingerprint is the hash of those field paths of the record that some mapping reads (``KNOWN``), so ids, weights
    and other fields beside them change nothing. An empty list has no turns. A message without its text field has an
    empty text; a text that is a list of blocks becomes their texts by lines. A null or malformed record, or one of an
    unknown layout, has null turns; its fingerprint is the hash of its whole type, so that it can be counted and mapped.
    """
    df = df.withColumn("__doc", F.try_parse_json(payload))
    doc = F.col("__doc")
    df = df.withColumn("__paths", F.array_join(F.array_compact(F.array(*[F.when(_has(doc, p), p) for p in KNOWN])), "|"))
    known, whole = F.sha2("__paths", 256), F.sha2(F.schema_of_variant(doc), 256)
    df = df.withColumn(fingerprint, F.when(known.isin(*MAPPINGS), known).otherwise(whole))
    result = F.lit(None).cast(f"array<{TURN}>")
    for fp, layout in MAPPINGS.items():
        turns = []
        for role, path in layout["turns"]:
            if role == "*":
                array, r, t = path.split(":")
                items = F.try_variant_get(doc, f"$.{array}", "array<variant>")
                turns.append(F.transform(items, _message(r, t)))
                continue
            parts = [_variant_text(F.try_variant_get(doc, f"$.{p}", "variant")) for p in path.split("+")]
            turns.append(F.array(_turn(F.lit(role), _joined(parts) if len(parts) > 1 else parts[0])))
        result = F.when(F.col(fingerprint) == fp, F.concat(*turns)).otherwise(result)
    return df.withColumn(out, result).drop("__doc", "__paths")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, turns: str = "turns", out: str = "formatted", mask: str = "loss_spans") -> DataFrame:
    """Adds the formatted text and the loss mask: (start, length) in code points of each assistant text in it.

    Null turns give a null text and mask, no turns an empty text.
    """
    marked = F.transform(turns, lambda t: F.struct(F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    df = df.withColumn("__m", marked)
    sizes = F.transform("__m", lambda t: (F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
    starts = F.aggregate("__sizes", start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts")), lambda s: s["starts"])
    spans = F.zip_with("__m", "__starts", lambda t, at: F.when(t["loss"], F.struct((at + F.length(t["head"])).alias("start"), F.length(t["body"]).cast("long").alias("length"))))
    text = F.array_join(F.transform("__m", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return (df.withColumn("__sizes", sizes).withColumn("__starts", starts).withColumn(out, text)
            .withColumn(mask, F.filter(spans, lambda s: s.isNotNull())).drop("__m", "__sizes", "__starts"))


def parse_turns(text: Column) -> Column:
    """Canonical turns back from a formatted text."""
    parts = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")
    head = lambda p: F.substring_index(p, "\n", 1)
    return F.transform(parts, lambda p: F.struct(F.url_decode(F.substr(head(p), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(p, F.length(head(p)) + 2)).alias("text")))


def masked_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn to one row per conversation with a ``messages`` array in turn order (ties: by role, then text)."""
    one = F.struct(F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    whole = df.groupBy(F.col(conv).alias(conv)).agg(F.array_sort(F.collect_list(one)).alias("m"))
    return whole.select(conv, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
