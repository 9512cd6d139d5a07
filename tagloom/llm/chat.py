"""Chat formatting: fingerprints of nested field paths choose the mapping from a record's layout to canonical turns. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


@dataclass(frozen=True)
class Mapping:
    """How records with the required paths, and any of the optional ones, become turns.

    each: (array path, role field, text field), or parts: (role, text path) in order; a part whose path isn't there
    gives no turn. roles renames roles.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
MAPPINGS = (
    Mapping("rows", ("turns",), ("turns[].role", "turns[].text"), each=("turns", "role", "text")),
    Mapping("messages", ("messages",), ("messages[].role", "messages[].content"), each=("messages", "role", "content"), roles=_NAMES),
    Mapping("from-value", ("conversations",), ("conversations[].from", "conversations[].value", "system"), each=("conversations", "from", "value"), parts=(("system", "system"),), roles=_NAMES),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt-response", ("prompt", "response"), ("system",), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt-completion", ("prompt", "completion"), ("system",), parts=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Mapping("question-answer", ("question", "answer"), ("context", "system"), parts=(("system", "system"), ("user", "context"), ("user", "question"), ("assistant", "answer"))),
)
TURNS = "array<struct<role:string,text:string>>"
#: Escapes, as (raw, escaped): the first starts all others, so it is put in first and taken out last.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), (">", "\\2"))


def _there(name: str):
    return lambda x: x[name].isNotNull()


def _paths(schema: StructType, known: set[str]) -> list[tuple[str, Column]]:
    """The paths of schema that mappings know, each with the test that a record has a value there."""
    out = []
    for f in schema.fields:
        if f.name in known:
            out.append((f.name, F.col(f.name).isNotNull()))
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            for g in f.dataType.elementType.fields:
                if (path := f"{f.name}[].{g.name}") in known:
                    out.append((path, F.coalesce(F.exists(F.col(f.name), _there(g.name)), F.lit(False))))
        elif isinstance(f.dataType, StructType):
            for g in f.dataType.fields:
                if (path := f"{f.name}.{g.name}") in known:
                    out.append((path, F.col(f"{f.name}.{g.name}").isNotNull()))
    return sorted(out, key=lambda x: x[0])


def _mark(paths) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def fingerprint(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """A hash of the sorted paths, among those mappings know, at which a record has values."""
    known = {p for m in mappings for p in (*m.required, *m.optional)}
    there = [F.when(test, F.lit(path)) for path, test in _paths(records.schema, known)]
    return F.xxhash64(F.concat_ws("\n", *there)) if there else F.xxhash64(F.lit(""))


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def _turns(m: Mapping, fields: dict[str, object]) -> Column | None:
    """The turns of a mapping, or None where the records' schema lacks its required fields."""
    if any(p.split("[]")[0].split(".")[0] not in fields for p in m.required):
        return None
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    out = []
    for role, path in m.parts:
        if path in fields:
            out.append(F.when(F.col(path).isNotNull(), F.array(F.struct(F.lit(role).alias("role"), blank(F.col(path)).alias("text")))).otherwise(F.array().cast(TURNS)))
    if m.each:
        array, role, text = m.each
        own = fields[array].dataType.elementType
        if not isinstance(own, StructType):
            return None

        def turn(x: Column) -> Column:
            name = blank(x[role]) if role in own.names else F.lit("")
            for old, new in m.roles.items():
                name = F.when(name == old, F.lit(new)).otherwise(name)
            return F.struct(name.alias("role"), (blank(x[text]) if text in own.names else F.lit("")).alias("text"))

        out.append(F.transform(F.filter(F.col(array), lambda x: x.isNotNull()), turn))
    return F.concat(*[c.cast(TURNS) for c in out])


def format_chats(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """All columns of records, and layout, turns_out, formatted and mask, which replace columns of these names.

    formatted is '<turn ROLE>', a line break, the text and '</turn>' with a line break for each turn. In roles and
    texts each backslash, < and > becomes a backslash and a digit, so no text can hold a control string, and
    read_back() gets the same turns. mask has for each turn the characters (code points) before its text, of its text
    and after it, and whether the text is to be learned, which holds for the roles in trained.

    Records whose fingerprint no mapping has get a null layout and no turns. Null texts and roles are empty; a null
    element of a list is no turn. Records that repeat are formatted alike, each by itself.
    """
    records = records.drop("layout", "turns_out", "formatted", "mask", "__mark")
    fields = {f.name: f for f in records.schema.fields}
    mark, layout, turns = fingerprint(records, mappings), F.lit(None).cast("string"), F.array().cast(TURNS)
    for m in mappings:
        if (own := _turns(m, fields)) is not None:
            variants = [(*m.required, *some) for k in range(len(m.optional) + 1) for some in combinations(m.optional, k)]
            here = F.col("__mark").isin(*[_mark(v) for v in variants])
            layout, turns = F.when(here, F.lit(m.name)).otherwise(layout), F.when(here, own).otherwise(turns)
    out = records.withColumn("__mark", mark).withColumn("layout", layout).withColumn("turns_out", turns).drop("__mark")
    lead = lambda t: F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">\n"))
    out = out.withColumn("formatted", F.array_join(F.transform("turns_out", lambda t: F.concat(lead(t), escape(t["text"]), F.lit("</turn>\n"))), ""))
    mask = F.transform("turns_out", lambda t: F.struct(F.length(lead(t)).alias("lead"), F.length(escape(t["text"])).alias("body"), F.lit(8).alias("tail"), t["role"].isin(*trained).alias("on")))
    return out.withColumn("mask", mask)


def chunks(formatted: Column) -> Column:
    """The formatted turns, without what ends them."""
    parts = F.split(formatted, "</turn>\n")
    return F.slice(parts, 1, F.size(parts) - 1)


def read_back(formatted: Column) -> Column:
    """The turns that format_chats() wrote."""

    def turn(c: Column) -> Column:
        head = F.substring_index(c, ">\n", 1)
        return F.struct(unescape(F.substr(head, F.lit(7))).alias("role"), unescape(F.substr(c, F.length(head) + 3)).alias("text"))

    return F.transform(chunks(formatted), turn)


def learned(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, cut out of the formatted turns by the mask's lengths."""
    both = F.zip_with(chunks(formatted), mask, lambda c, m: F.when(m["on"], unescape(F.substr(c, m["lead"] + 1, m["body"]))).otherwise(F.lit("")))
    return F.array_join(both, "")


def conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns) of conversations kept as a row per turn, by turn; equal turns by role and text. A null id is a conversation."""
    own = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    return rows.groupBy(id_col).agg(F.sort_array(F.collect_list(own)).alias("turns"))
