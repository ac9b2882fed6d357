"""Chat formatting by schema fingerprints, with DataFrame functions only.

The nested field paths that a record fills are hashed; the hash selects a declared mapping to canonical turns
(role, text). Turns become one template text in which control strings inside a text are escaped reversibly, with the
spans under the loss mask.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = "struct<role:string,text:string>"


@dataclass(frozen=True)
class Layout:
    """Paths a record must fill, paths it may fill, and the turns as a SQL expression over its columns."""

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    turns: str

    def shapes(self):
        some = chain.from_iterable(combinations(self.optional, k) for k in range(len(self.optional) + 1))
        return [tuple(sorted((*self.required, *more))) for more in some]


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', '{role}', 'text', {text})"


_SYSTEM = f"IF(system IS NULL, array(), array({_turn('system', 'system')}))"
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), (),
           "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("speakers", ("conversations[].from", "conversations[].value"), (),
           "transform(conversations, m -> named_struct('role', CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' "
           "ELSE m.from END, 'text', m.value))"),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           f"concat({_SYSTEM}, array({_turn('user', "concat_ws(chr(10), instruction, input)")}, "
           f"{_turn('assistant', 'output')}))"),
    Layout("prompt", ("prompt", "response"), ("system",),
           f"concat({_SYSTEM}, array({_turn('user', 'prompt')}, {_turn('assistant', 'response')}))"),
)


def _paths(kind: T.DataType, path: str, column: Column):
    """(path, presence) of every leaf below a column; an array's leaves are filled when it has an element."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from _paths(f.dataType, f"{path}.{f.name}", column[f.name])
    elif isinstance(kind, T.ArrayType):
        filled = F.coalesce(F.size(column) > 0, F.lit(False))
        inner = kind.elementType
        names = [f"{path}[].{f.name}" for f in inner.fields] if isinstance(inner, T.StructType) else [f"{path}[]"]
        for name in names:
            yield name, filled
    else:
        yield path, column.isNotNull()


def fingerprint(records: DataFrame, layouts=LAYOUTS) -> Column:
    """A hash of the sorted field paths that a record fills, among the columns that layouts speak of."""
    roots = {p.split("[")[0].split(".")[0] for x in layouts for p in (*x.required, *x.optional)}
    found = [x for f in records.schema.fields if f.name in roots for x in _paths(f.dataType, f.name, F.col(f"`{f.name}`"))]
    present = F.array_compact(F.array(*[F.when(there, F.lit(p)) for p, there in sorted(found, key=lambda x: x[0])])) if found else F.array()
    return F.xxhash64(F.array_join(present.cast("array<string>"), "\n"))


def shape_hash(paths) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def canonical(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """``records`` with ``layout`` and ``turns`` array<struct<role,text>>.

    A record whose fingerprint no layout declares has both null. Null roles and texts inside turns are empty. Columns
    named layout or turns are replaced; columns no layout speaks of are ignored.
    """
    own = {f.name for f in records.schema.fields}
    mark = fingerprint(records, layouts)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for x in layouts:
        shapes = [s for s in x.shapes() if {p.split("[")[0].split(".")[0] for p in s} <= own]
        if not shapes:
            continue
        sql = x.turns
        hit = mark.isin(*[shape_hash(s) for s in shapes])
        missing = [p for p in x.optional if p not in own]
        expr = _without(sql, missing)
        name = F.when(hit, F.lit(x.name)).otherwise(name)
        turns = F.when(hit, F.expr(f"transform({expr}, t -> named_struct('role', coalesce(t.role, ''), 'text', coalesce(t.text, '')))")
                       .cast(f"array<{TURN}>")).otherwise(turns)
    return records.withColumns({"layout": name, "turns": turns})


def _without(sql: str, missing) -> str:
    """The expression with absent optional columns read as null."""
    for column in missing:
        sql = re.sub(rf"(?<!['\w]){column}(?!['\w])", "CAST(NULL AS STRING)", sql)
    return sql


def escape(text: Column) -> Column:
    """No ``<|`` is left: each ``<``, backslashes, ``|`` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _plain_role(role: Column) -> Column:
    # A doubled backslash is set aside while \n turns into a line end.
    return F.regexp_replace(F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", r"\\")


def _starts(sizes: str) -> Column:
    """The sum of all sizes before each element of an array column.

    An array is copied whenever it gets an element, so the sums are built in pieces of about the root of its length.
    """
    n = F.size(sizes)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n))).cast("int")
    parts = F.transform(F.when(n > 0, F.sequence(F.lit(1), n, width)).otherwise(F.array().cast("array<int>")), lambda k: F.slice(sizes, k, width))
    long, longs = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")

    def inside(part, at):
        return F.aggregate(part, F.struct(at.alias("at"), longs.alias("all")),
                           lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.array_append(acc["all"], acc["at"]).alias("all")))

    def add(acc, part):
        total = F.aggregate(part, long, lambda t, x: t + x)
        return F.struct((acc["at"] + total).alias("at"), F.array_append(acc["parts"], inside(part, acc["at"])["all"]).alias("parts"))

    start = F.struct(long.alias("at"), F.array().cast("array<array<bigint>>").alias("parts"))
    return F.flatten(F.aggregate(parts, start, add)["parts"])


def format_chat(records: DataFrame, layouts=LAYOUTS, loss_role: str = "assistant") -> DataFrame:
    """``records`` with layout, turns, ``formatted`` and ``loss`` (for each turn its span in ``formatted``, null outside the mask).

    Spans count code points, end exclusive, and cover the escaped text of ``loss_role`` turns. Records of an unknown
    layout have formatted and loss null; a record without turns is formatted as the empty text.
    """
    lines = F.transform("turns", lambda t: F.struct(F.concat(F.lit(START), _role(t["role"]), F.lit("\n")).alias("head"),
                                                    escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")))
    step = canonical(records, layouts).withColumn("_lines", lines)
    step = step.withColumn("_size", F.transform("_lines", lambda x: F.char_length(x["head"]) + F.char_length(x["text"]) + len(END)))
    zipped = F.arrays_zip(F.col("_lines").alias("line"), _starts("_size").alias("at"))
    spans = F.transform(zipped, lambda z: F.when(z["line"]["loss"], F.struct(
        (z["at"] + F.char_length(z["line"]["head"])).alias("start"),
        (z["at"] + F.char_length(z["line"]["head"]) + F.char_length(z["line"]["text"])).alias("end"))))
    formatted = F.array_join(F.transform("_lines", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "")
    return step.withColumns({"formatted": formatted, "loss": spans}).drop("_lines", "_size")


def read_chat(formatted: DataFrame) -> DataFrame:
    """Reads ``formatted`` and ``loss`` back: read_turns and loss_text, unescaped; null where formatted is null."""
    pieces = F.filter(F.split(F.col("formatted"), r"<\|im_end\|>\n"), lambda p: p != "")
    step = formatted.withColumn("_pieces", pieces)

    def turn(p):
        head = F.substring_index(p, "\n", 1)
        return F.struct(_plain_role(F.substr(head, F.lit(len(START) + 1))).alias("role"),
                        unescape(F.substr(p, F.char_length(head) + 2)).alias("text"))

    step = step.withColumn("_size", F.transform("_pieces", lambda p: F.char_length(p) + len(END)))
    zipped = F.arrays_zip(F.col("_pieces").alias("piece"), F.col("loss").alias("span"), _starts("_size").alias("at"))
    texts = F.transform(F.filter(zipped, lambda z: z["span"].isNotNull()), lambda z: unescape(F.substr(
        z["piece"], (z["span"]["start"] - z["at"] + 1).cast("int"), (z["span"]["end"] - z["span"]["start"]).cast("int"))))
    return step.withColumns({"read_turns": F.transform("_pieces", turn), "loss_text": F.array_join(texts, "")}).drop("_pieces", "_size")


def layout_counts(formatted: DataFrame) -> DataFrame:
    """layout, records, turns: how many records each layout took; those that no layout, or more than one, claims are under null."""
    return formatted.groupBy("layout").agg(F.count("*").alias("records"), F.coalesce(F.sum(F.size("turns")), F.lit(0)).alias("turns"))
