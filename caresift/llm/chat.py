"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record of any layout becomes a variant.  The hash of its nested field paths (types left out) selects a declarative
mapping, which turns it into canonical turns of role and text.  The template marks every turn and escapes its own
control strings inside texts, so that the turns and the loss mask can be read back from the formatted string.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template; a fixed format.
USER, USER_END = "[INST]", "[/INST]"
SYSTEM, SYSTEM_END = "<<SYS>>", "<</SYS>>"
START, END = "<s>", "</s>"
ROLE, ROLE_END = "[ROLE]", "[/ROLE]"
CONTROLS = (USER, USER_END, SYSTEM, SYSTEM_END, START, END, ROLE, ROLE_END)

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """One layout: its field paths, and either where its list of turns is or which fields make which turn.

    ``paths`` is the variant schema without types of fields; ``items`` names the list, its role and its text field;
    ``fields`` are (role, text fields): non-empty texts of a turn are joined by a blank line.  In a ``row`` layout a
    record is one turn, and ``role_field`` names its role.
    """

    name: str
    paths: str
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    role_field: str | None = None
    roles: dict[str, str] = field(default_factory=dict)


MAPPINGS = (
    Mapping("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", items=("messages", "role", "content")),
    Mapping("from_value", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", items=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Mapping("prompt_response", "OBJECT<prompt, response>", fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("prompt_completion", "OBJECT<completion, prompt>", fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("instruction", "OBJECT<input, instruction, output>", fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction_output", "OBJECT<instruction, output>", fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("system_prompt_response", "OBJECT<prompt, response, system>", fields=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("turn_row", "OBJECT<role, text>", role_field="role", fields=(("", ("text",)),)),
)


def field_paths(record: Column) -> Column:
    """The nested field paths of a variant, as its schema without the types of fields."""
    return F.regexp_replace(F.schema_of_variant(record), r": [A-Z_]+(\([0-9, ]+\))?(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _text(record: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(record, f"$.{name}", "string"), F.lit(""))


def _turns(record: Column, mapping: Mapping) -> Column:
    def named(role: Column) -> Column:
        role = F.coalesce(role, F.lit(""))
        return reduce(lambda c, k: F.when(role == k, mapping.roles[k]).otherwise(c), mapping.roles, role)

    if mapping.items:
        path, role, text = mapping.items
        items = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(items, lambda t: F.struct(named(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
    turns = []
    for role, names in mapping.fields:
        texts = [_text(record, n) for n in names]
        joined = texts[0] if len(texts) == 1 else F.array_join(F.filter(F.array(*texts), lambda t: t != ""), "\n\n")
        who = named(_text(record, mapping.role_field)) if mapping.role_field else F.lit(role)
        turns.append(F.struct(who.alias("role"), joined.alias("text")))
    return F.array(*turns)


def with_canonical_turns(records: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """All columns plus ``layout`` (the mapping's name) and ``turns`` (array of role and text).

    ``record`` is a JSON string, a struct or a variant.  Null fields count as present and empty.  Records that are null,
    no valid JSON, or of a layout without a mapping have a null layout and null turns.
    """
    kind = records.schema[record].dataType.typeName()
    value = {"string": F.try_parse_json, "variant": lambda c: c}.get(kind, F.to_variant_object)(F.col(record))
    marked = records.withColumn("_variant", value).withColumn("_mark", fingerprint(F.col("_variant")))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in reversed(mappings):
        fits = F.col("_mark") == F.xxhash64(F.lit(m.paths))
        layout, turns = F.when(fits, m.name).otherwise(layout), F.when(fits, _turns(F.col("_variant"), m).cast(TURNS)).otherwise(turns)
    return marked.withColumns({"layout": layout, "turns": turns}).drop("_variant", "_mark")


def escaped(text: Column) -> Column:
    """Backslashes are doubled, then one is put behind the first character of every control string."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:])), CONTROLS, F.replace(text, F.lit("\\"), F.lit("\\\\")))


def unescaped(text: Column) -> Column:
    return F.replace(reduce(lambda c, s: F.replace(c, F.lit(s[0] + "\\" + s[1:]), F.lit(s)), CONTROLS, text), F.lit("\\\\"), F.lit("\\"))


def formatted(turns: Column) -> Column:
    """The string of all turns; nothing stands between them."""
    def one(turn: Column) -> Column:
        role, text = turn["role"], escaped(turn["text"])
        return (
            F.when(role == "user", F.concat(F.lit(USER), text, F.lit(USER_END)))
            .when(role == "assistant", F.concat(F.lit(START), text, F.lit(END)))
            .when(role == "system", F.concat(F.lit(SYSTEM), text, F.lit(SYSTEM_END)))
            .otherwise(F.concat(F.lit(ROLE), escaped(role), F.lit(ROLE_END), text, F.lit(END)))
        )

    return F.array_join(F.transform(turns, one), "")


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "[]/\\" else c for c in text)


_OPEN = f"({_quoted(USER)}|{_quoted(START)}|{_quoted(SYSTEM)}|{_quoted(ROLE)}.*?{_quoted(ROLE_END)})"
_CLOSE = f"({_quoted(USER_END)}|{_quoted(END)}|{_quoted(SYSTEM_END)})"


def read_turns(text: Column) -> Column:
    """The turns of a formatted string: role, text, and whether the text is under the loss mask (an assistant's)."""
    whole = f"(?s){_OPEN}(.*?){_CLOSE}"

    def one(part: Column) -> Column:
        mark, body = F.regexp_extract(part, whole, 1), F.regexp_extract(part, whole, 2)
        other = F.substring(mark, len(ROLE) + 1, F.length(mark) - len(ROLE) - len(ROLE_END))
        role = F.when(mark == USER, "user").when(mark == START, "assistant").when(mark == SYSTEM, "system").otherwise(unescaped(other))
        return F.struct(role.alias("role"), unescaped(body).alias("text"), (mark == START).alias("loss"))

    return F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(0)), one)


def conversations_from_rows(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns`` from a table with a row per turn, ordered by turn (nulls first), then role and text.

    Each row goes through its fingerprint like any record.  Repeated rows are repeated turns; rows with a null
    conversation form one conversation.  A conversation is one row of the result and so bounds what a task holds.
    """
    records = rows.select(F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.struct(F.col(role).alias("role"), F.col(text).alias("text")).alias("record"))
    ready = with_canonical_turns(records, "record")
    collected = F.sort_array(F.collect_list(F.struct("turn", F.col("turns")[0]["role"].alias("role"), F.col("turns")[0]["text"].alias("text"))))
    return ready.groupBy("conv_id").agg(collected.alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_conversations(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """All columns plus ``formatted``."""
    return conversations.withColumn("formatted", formatted(F.col(turns)))
