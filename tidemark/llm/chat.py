"""Chat formatting by schema fingerprint.

A record is a JSON text of any layout, or a struct. Layouts are declared: those of a layout's nested field paths that
a record has hash to a fingerprint, and where it equals the layout's own, its mapping to canonical turns (role,
text) applies; fields that no layout names don't matter. A struct has the paths of its schema as far as the structs and
arrays around a field are there; where its schema holds several layouts, a null field is absent, except for the last of
these layouts, which takes nulls for empty texts. Turns are written with a template that marks each turn and escapes control strings inside texts, so the text
read back from the output equals the input.

Defined results: null text and null role are empty strings; a record whose fingerprint is unknown,
whose fields are not of the layout's kinds, or that is not JSON, gets null turns (reported by ``layout`` null, never dropped) and one turn of empty role and
text as rows; so does a JSON text with a string of over 20,000,000 characters, which Spark's parser refuses, while
structs are not parsed and have no such limit; an empty table gives an empty result; turns with equal numbers are ordered by role and text. A digest of a whole conversation
needs its text in one row, so one conversation must fit in one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tidemark.llm.common import table, unused

TURNS = "array<struct<role:string,text:string>>"
#: Template: <|turn|>role newline text <|end|> newline.
OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Every control string of the common chat templates starts with < or [; & starts an escape.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


class Layout(NamedTuple):
    """A declared mapping. ``paths`` are the nested field paths that a record must have (others are ignored), with
    [] for the elements of an array; ``turns`` is SQL over {field} for texts and {field[]} for arrays. A {system}
    text that is there becomes a turn of its own in front."""

    name: str
    paths: tuple[str, ...]
    turns: str

    @property
    def fingerprint_text(self) -> str:
        return "\n".join(self.paths)


def _pair(user: str, assistant: str) -> str:
    return f"array(named_struct('role','user','text',{user}),named_struct('role','assistant','text',{assistant}))"


def _list(field: str, role: str, text: str) -> tuple[tuple[str, ...], str]:
    turns = f"transform({{{field}[{role},{text}]}}, m -> named_struct('role',coalesce(m.{role},''),'text',coalesce(m.{text},'')))"
    return (f"{field}[].{role}", f"{field}[].{text}"), turns


#: In order of precedence: a record gets the first layout whose paths it has.
LAYOUTS = (
    Layout("messages", *_list("messages", "role", "content")),
    Layout("conversations", *_list("conversations", "from", "value")),
    Layout("instruction_input", ("instruction", "input", "output"), _pair("concat_ws('\\n\\n',{instruction},nullif({input},''))", "{output}")),
    Layout("instruction", ("instruction", "output"), _pair("{instruction}", "{output}")),
    Layout("chosen", ("prompt", "chosen", "rejected"), _pair("{prompt}", "{chosen}")),
    Layout("prompt", ("prompt", "completion"), _pair("{prompt}", "{completion}")),
    Layout("turn", ("role", "text"), "array(named_struct('role',{role},'text',{text}))"),
)
FIELD = re.compile(r"\{(\w+)(?:\[(\w+),(\w+)\])?\}")


def _mapped(layout: Layout, text: Callable[[str], str], items: Callable[[str, str, str], str], system: str) -> str:
    """The layout's SQL with its fields read by ``text`` and ``items``; ``system`` may be null."""
    body = FIELD.sub(lambda m: items(*m.groups()) if m[2] else f"coalesce({text(m[1])},'')", layout.turns)
    return f"CAST(concat(if({system} IS NULL, array(), array(named_struct('role','system','text',{system}))), {body}) AS {TURNS})"


def _present(record: str, path: str) -> str:
    """SQL: the variant ``record`` has ``path``. An array without elements has the paths of any."""
    field, nested, leaf = path.partition("[].")
    if not nested:
        return f"try_variant_get({record},'$.{path}','variant') IS NOT NULL"
    items = f"try_variant_get({record},'$.{field}','array<variant>')"
    return f"({items} IS NOT NULL AND (size({items}) = 0 OR exists({items}, m -> try_variant_get(m,'$.{leaf}','variant') IS NOT NULL)))"


def _held(record: str, path: str, null_is_empty: bool) -> str:
    """SQL: the struct ``record``, whose schema has ``path``, has it too."""
    field, nested, _ = path.partition("[].")
    return f"{record} IS NOT NULL" if null_is_empty and not nested else f"{record}.{field} IS NOT NULL"


def fingerprint(paths: tuple[str, ...], present: Callable[[str], str]) -> Column:
    """Hash of those of ``paths`` for which ``present`` gives true SQL."""
    return F.xxhash64(F.concat_ws("\n", *(F.when(F.expr(present(p)), F.lit(p)) for p in paths)))


def _leaf_paths(kind: DataType, at: str = "") -> list[str]:
    if isinstance(kind, ArrayType):
        return _leaf_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, StructType):
        return [p for f in kind for p in _leaf_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return [at]


def canonical_turns(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Add ``layout`` and ``turns`` to each record; input columns of these names are replaced."""
    df = df.select(*(c for c in df.columns if c == record or c.lower() not in ("layout", "turns")))
    kind = df.schema[record].dataType
    r = unused([*df.columns, "layout", "turns"], "parsed")
    if isinstance(kind, StructType):
        # structs are not parsed: their columns are read as they are
        paths, parsed = _leaf_paths(kind), df.withColumn(r, F.col(record))
        layouts = tuple(x for x in layouts if set(x.paths) <= set(paths))
        text = lambda f: f"CAST({r}.{f} AS STRING)"
        items = lambda f, role, said: f"transform({r}.{f}, m -> named_struct('{role}',CAST(m.{role} AS STRING),'{said}',CAST(m.{said} AS STRING)))"
        system = text("system") if "system" in paths else "CAST(NULL AS STRING)"
        present = lambda x: lambda p: _held(r, p, x is layouts[-1])
    else:
        parsed = df.withColumn(r, F.try_parse_json(record))
        text = lambda f: f"try_variant_get({r},'$.{f}','string')"
        items = lambda f, role, said: f"try_variant_get({r},'$.{f}','array<struct<{role}:string,{said}:string>>')"
        system = text("system")
        present = lambda x: lambda p: _present(r, p)
    chosen, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in reversed(layouts):
        # the fingerprint of a layout is a constant that the optimizer folds
        fits = fingerprint(x.paths, present(x)) == F.xxhash64(F.lit(x.fingerprint_text))
        made = F.expr(_mapped(x, text, items, system))
        chosen = F.when(fits & made.isNotNull(), F.lit(x.name)).when(fits, F.lit(None)).otherwise(chosen)
        turns = F.when(fits, made).otherwise(turns)
    return parsed.withColumns({"layout": chosen, "turns": turns}).drop(r)


def turn_rows(mapped: DataFrame, *keys: str) -> DataFrame:
    """One row per turn, with its position in the record; a record without turns is one turn of empty role and text."""
    rows = mapped.select(*keys, F.posexplode_outer("turns").alias("position", "said"))
    return rows.select(*keys, F.coalesce("position", F.lit(0)).alias("position"), *(F.coalesce(f"said.{c}", F.lit("")).alias(c) for c in ("role", "text")))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def format_turns(rows: DataFrame, conversation: str, order: list[str], trained_role: str = "assistant") -> DataFrame:
    """One row per conversation from one row per turn (role, text): ``formatted``, and ``loss`` with the
    [start, end) code points of the text under the loss mask, per turn; null where a turn is not trained on.
    """
    plain = rows.select(conversation, *order, F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    head, body = F.concat(F.lit(OPEN), _role(F.col("_role")), F.lit("\n")), escape(F.col("_text"))
    # plain texts decide between turns of equal order; only the lengths of what is written are summed
    by = W.partitionBy(conversation).orderBy(*order, "_role", "_text").rowsBetween(W.unboundedPreceding, -1)
    sized = plain.withColumn("_size", F.length(head) + F.length(body) + len(CLOSE))
    begun = sized.withColumn("_at", F.coalesce(F.sum("_size").over(by), F.lit(0)))
    at = F.col("_at") + F.length(head)
    loss = F.when(F.col("_role") == trained_role, F.struct(at.alias("start"), (at + F.length(body)).alias("end")))
    placed = begun.select(conversation, F.struct("_at", F.concat(head, body, F.lit(CLOSE)).alias("piece"), loss.alias("loss")).alias("t"))
    whole = placed.groupBy(conversation).agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return whole.select(conversation, F.array_join("ts.piece", "").alias("formatted"), F.col("ts.loss").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns``, read from ``formatted`` alone, and ``loss_text``, read from ``formatted`` and ``loss``."""
    # each piece ends with the close mark, which no escaped text can hold
    pieces = F.split(F.col("formatted"), F.lit(r"(?<=<\|end\|>\n)"))
    pieces = F.filter(pieces, lambda p: p != "")
    parsed = F.transform("_pieces", lambda p: F.struct(
        unescape(F.replace(F.regexp_extract(p, r"^<\|turn\|>([^\n]*)\n", 1), F.lit("&#10;"), F.lit("\n"))).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)^<\|turn\|>[^\n]*\n(.*)<\|end\|>\n$", 1)).alias("text")))
    # the mask is relative to the conversation; a piece's own start is its text's start less its head
    under = F.transform(F.arrays_zip(F.col("_pieces").alias("p"), F.col("loss").alias("l")), lambda z: F.when(z["l"].isNotNull(), F.substring(z["p"], F.instr(z["p"], F.lit("\n")) + 1, (z["l"]["end"] - z["l"]["start"]).cast("int"))))
    return formatted.withColumn("_pieces", pieces).withColumn("turns", parsed).withColumn("loss_text", unescape(F.array_join(under, ""))).drop("_pieces")


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's rows, each a record of one turn, and conversation -1, one record with a list of messages."""
    said = "</s>[INST] ok [/INST]"
    list_of = "array<struct<role:string,content:string>>"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("role", "text", F.lit(None).cast(list_of).alias("messages")).alias("record"))
    own = spark.sql(f"""SELECT -1L AS conv_id, 0L AS turn, named_struct('role', CAST(NULL AS STRING), 'text', CAST(NULL AS STRING),
        'messages', array(named_struct('role', 'user', 'content', '{said}'), named_struct('role', 'assistant', 'content', '{said}'))) AS record""")
    return rows.unionByName(own)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by conversation before the layouts are told apart: all that follows stays in place
    records = conversation_records(spark, sf_dir).repartition("conv_id")
    turns = turn_rows(canonical_turns(records, "record"), "conv_id", "turn")
    back = read_back(format_turns(turns, "conv_id", ["turn", "position"]))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op9_chat": op9_chat}

_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
ORACLES = {
    "op9_chat": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), whole AS (
  SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
         sum(length({_ESC.format("role")}) + length({_ESC.format("text")}) + {len(OPEN) + 1 + len(CLOSE)}) AS f
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n AS n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM whole
"""
}
