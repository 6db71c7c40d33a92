"""Chat formatting: layouts are recognised by a hash of their nested field paths.

Every layout is a declarative mapping. The known field paths of a row (or of a table's schema) are sorted
and hashed; the hash selects the mapping, which turns the row into canonical turns (role, text). Canonical
turns are written in one template, with a loss mask over assistant texts, and can be read back.

Lists of messages and fields get the canonical roles' names; rows of turns keep theirs.

Defined results: null role or text counts as empty; turns are put in order of (turn, role, text), so ties
and repeated rows have one order; rows with null conversation id form one conversation; an empty table
gives no rows; columns outside the layout are ignored; a JSON row of no known layout has null turns.
All of it is DataFrame functions; a conversation is one row, because its digest needs all its turns.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: A zero-width space after "<" takes a mark's string apart; one more is added to those already there.
GUARD = "\u200b"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and where its turns are: one list of messages, one field for each turn, or one row for each turn."""

    name: str
    paths: tuple[str, ...]
    items: tuple[str, str, str] | None = None  # list, role field, text field
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()  # role, fields joined by an empty line
    rows: tuple[str, str, str, str] | None = None  # conversation, turn, role, text


# The known layouts.
LAYOUTS = (
    Layout("messages", ("messages", "messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Layout("instruction_input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("system_instruction", ("instruction", "output", "system"), fields=(("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question_answer", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Layout("utterance_rows", ("dialog_id", "position", "speaker", "utterance"), rows=("dialog_id", "position", "speaker", "utterance")),
)
# Other names for the canonical roles.
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN_PATHS = tuple(sorted({p for layout in LAYOUTS for p in layout.paths}))
LISTS = tuple(sorted({layout.items[0] for layout in LAYOUTS if layout.items}))


def fingerprint(paths) -> str:
    """Hash of the known ones among some field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN_PATHS))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; [] stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        dot = f"{prefix}." if prefix else ""
        return [p for f in kind.fields for p in [dot + f.name, *schema_paths(f.dataType, dot + f.name)]]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return []


def prefixed(prefix: str):
    return lambda key: F.concat(F.lit(prefix), key)


def json_fingerprint(json: Column) -> Column:
    """`fingerprint` of the field paths of a JSON object, list elements seen through their first one."""
    empty = F.array().cast("array<string>")
    keys = [F.coalesce(F.json_object_keys(json), empty)]
    for name in LISTS:
        inner = F.coalesce(F.json_object_keys(F.get_json_object(json, f"$.{name}[0]")), empty)
        keys.append(F.transform(inner, prefixed(f"{name}[].")))
    known = F.array_intersect(F.concat(*keys), F.array(*map(F.lit, KNOWN_PATHS)))
    return F.sha2(F.array_join(F.sort_array(known), "\n"), 256)


def canonical_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, role), role, F.lit(""))


def renamed(role: str, text: str):
    """A list item's canonical turn."""
    return lambda x: F.struct(canonical_role(x[role]).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))


def turns_from_json(df: DataFrame, json: str = "json") -> DataFrame:
    """Adds `layout` and `turns` to rows that hold one conversation each as a JSON object of any known layout."""
    choices_name, choices_turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    text = F.col(json)
    for key, layout in BY_FINGERPRINT.items():
        if layout.items:
            name, role, content = layout.items
            items = F.from_json(text, f"`{name}` array<struct<`{role}`:string,`{content}`:string>>")[name]
            turns = F.transform(items, renamed(role, content))
        elif layout.fields:
            parts = [
                F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[F.get_json_object(text, f"$.{f}") for f in fields]), lambda x: x.isNotNull() & (x != "")), "\n\n").alias("text"))
                for role, fields in layout.fields
            ]
            turns = F.array(*parts)
        else:
            continue
        here = F.col("_fingerprint") == key
        choices_name = F.when(here, layout.name).otherwise(choices_name)
        choices_turns = F.when(here, turns).otherwise(choices_turns)
    return df.withColumn("_fingerprint", json_fingerprint(text)).withColumns({"layout": choices_name, "turns": choices_turns.cast(TURNS)}).drop("_fingerprint")


def turns_from_rows(rows: DataFrame) -> DataFrame:
    """conv_id and turns of a table that has one row for each turn, by the mapping that its schema's fingerprint selects. Roles stay as they are."""
    layout = BY_FINGERPRINT.get(fingerprint(schema_paths(rows.schema)))
    if layout is None or layout.rows is None:
        raise ValueError(f"no layout of turn rows has these fields: {rows.columns}")
    conv, turn, role, text = layout.rows
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    ordered = F.sort_array(F.collect_list(one))
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def escaped(text: Column) -> Column:
    """Keeps "<|" out of a text, reversibly."""
    return F.regexp_replace(text, f"<({GUARD}*)\\|", f"<{GUARD}$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"<{GUARD}({GUARD}*)\\|", "<$1|")


def escaped_role(role: Column) -> Column:
    """Also keeps the role in one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: Column) -> Column:
    lines = F.regexp_replace(unescaped(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(lines, F.lit("\\\\"), F.lit("\\"))


def format_turns(df: DataFrame) -> DataFrame:
    """Adds `segments`: pieces (text, loss) whose texts joined are the formatted conversation; loss marks assistant texts."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    one = lambda t: F.array(
        piece(F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")), F.lit(False)),
        piece(escaped(t["text"]), t["role"] == "assistant"),
        piece(F.lit(f"{END}\n"), F.lit(False)),
    )
    return df.withColumn("segments", F.flatten(F.transform("turns", one)))


def formatted(segments: Column) -> Column:
    """The formatted conversation as one text."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column) -> Column:
    """The turns of a formatted conversation."""
    parts = F.filter(F.split(text, r"<\|im_start\|>"), lambda p: p != "")
    pattern = r"(?s)\A([^\n]*)\n(.*)<\|im_end\|>\n\z"
    return F.transform(
        parts,
        lambda p: F.struct(unescaped_role(F.regexp_extract(p, pattern, 1)).alias("role"), unescaped(F.regexp_extract(p, pattern, 2)).alias("text")),
    )


def loss_text(turns: Column) -> Column:
    """All text under the loss mask of the turns that `read_turns` gives: that of assistants, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
