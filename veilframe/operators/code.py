"""Source code: string literals and comments are scanned on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.functions.sql import sql_text
from veilframe.operators.detect import ENTITY_COLUMNS, claim_spans, detect_regex, expand_matches, tasks_by_text
from veilframe.operators.rules import BUILTIN, Rule

# Literals and comments, in the order in which they claim text.
SPAN_PATTERNS = [
    r'"""[\s\S]*?"""',
    r"'''[\s\S]*?'''",
    r'"[^"\\]*+(?:\\.[^"\\]*+)*+"',
    r"'[^'\\]*+(?:\\.[^'\\]*+)*+'",
    r"`[^`\\]*+(?:\\.[^`\\]*+)*+`",
    r"//[^\n]*",
    r"#[^\n]*",
    r"/\*[\s\S]*?\*/",
]
# Spans that only hold code.
CODE_NOISE = (r"""^[\s"'`#/*]*(?:import |from |require\(|use |include |package |module |class |def |func |fn |"""
              r"return |const |let |var |type |interface )[^@]*$")
# Signs of source code.
CODE_INDICATORS = [
    "def ", "class ", "function ", "import ", "from ", "require(",
    "const ", "let ", "var ", "func ", "fn ", "pub ", "private ",
    "return ", "if (", "for (", "while (", "package ", "module ",
    "#!/", "# -*- coding", "use strict", "pragma ",
    "SELECT ", "INSERT ", "CREATE TABLE",
]


def code_score(text: str = "text") -> str:
    signs = [f"cast(contains({text}, {sql_text(s)}) as int)" for s in CODE_INDICATORS]
    signs.append(f"cast({text} rlike {sql_text(r'(?m)[{};][ \t\r\n\x0b\f]*$')} as int)")
    signs.append(f"cast({text} rlike {sql_text(r'(?m)^\s*(def|class|func|fn)\s+\w+')} as int)")
    return "(" + " + ".join(signs) + ")"


def looks_like_code(text: str = "text") -> str:
    """At least three lines and two signs of code; the lambda computes the text once for all tests."""
    return f"exists(array({text}), t -> length(t) - length(replace(t, '\\n', '')) >= 2 and {code_score('t')} >= 2)"


def code_spans(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """Literals and comments of texts that look like code: (tenant, doc_id, value, start, end)."""
    code = docs.filter(F.expr(looks_like_code()))
    hits = ", ".join(f"case when text rlike {sql_text(p)} then {i} end" for i, p in enumerate(SPAN_PATTERNS))
    scanned = code.select("tenant", "doc_id", "text", F.explode_outer(F.expr(f"array_compact(array({hits}))")).alias("prio")).filter("prio is not null")
    spans = claim_spans(expand_matches(scanned, SPAN_PATTERNS, [0] * len(SPAN_PATTERNS), tasks=tasks))
    return spans.filter(~F.expr(f"value rlike {sql_text(CODE_NOISE)}")).select("tenant", "doc_id", "value", "start", "end")


def detect_in_code(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Rules inside each literal and comment, moved back to the text; confidence x 0.9, one entity per span."""
    tasks = tasks_by_text(docs)
    spans = code_spans(docs, tasks)
    inner = spans.select("tenant", F.struct("doc_id", "start").alias("doc_id"), F.col("value").alias("text"))
    found = detect_regex(inner, BUILTIN if rules is None else rules, tasks=tasks)
    moved = found.select(
        "tenant", F.col("doc_id.doc_id").alias("doc_id"), "value", (F.col("start") + F.col("doc_id.start")).alias("start"),
        (F.col("end") + F.col("doc_id.start")).alias("end"), "category", (F.col("confidence") * 0.9).alias("confidence"),
        F.concat(F.lit("code:"), "detector").alias("detector"))
    first = F.min(F.struct("detector", *[c for c in ENTITY_COLUMNS if c not in ("doc_id", "start", "end", "detector")]))
    return moved.groupBy("doc_id", "start", "end").agg(first.alias("f")).select("doc_id", "start", "end", "f.*").select(*ENTITY_COLUMNS)
