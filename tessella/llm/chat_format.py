"""Chat formatting by schema fingerprints.

Conversations come in many layouts: message lists with different field names,
prompt and response pairs, instructions with an input, rows by turn. A layout is
recognised by its *fingerprint*, a hash of its sorted nested field paths, and the
fingerprint selects a declarative mapping to canonical turns (role, text). Elements
of message lists have fingerprints of their own, down to the parts of a text. Two
forms are offered: ``canonical`` reads a DataFrame's own schema, ``canonical_json``
fingerprints every row's JSON, and every element of its lists, so that layouts may
be mixed in one column and in one list.

Turns are then written by a template that marks them. Control strings inside
texts and roles are escaped reversibly: a backslash goes after the first sign of
each, and one more wherever that position already holds some. So an escaped text
never holds a control string, and ``read_back`` recovers the exact turns and the
exact text under the loss mask (the assistant's texts), which is given as spans of
the formatted text.

All of it is DataFrame functions. Rows by turn are gathered by one shuffle on the
conversation id; a conversation is the unit of the result and is held as one
value, however many conversations are alike.

Edge cases: null text and null role count as empty; an empty conversation (no
turns) formats to an empty text; equal turn numbers are ordered by role, then
text; repeated rows are repeated turns; a null conversation id is a conversation
of its own; an empty message list gives no turns; unknown layouts and elements give
null turns and are kept; very long texts are formatted whole; extra columns and
fields are ignored (by turn) or carried through; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: control strings of common chat templates
CONTROL = ("<|turn|>", "<|body|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
TURN, BODY, END = CONTROL[:3]

_REST = "|".join(sorted({"".join(f"\\{c}" if not c.isalnum() else c for c in s[1:]) for s in CONTROL}, key=len, reverse=True))
_ESCAPE = rf"([<\[])(?=\\*(?:{_REST}))"
_UNESCAPE = rf"([<\[])\\(?=\\*(?:{_REST}))"
#: The same for engines without lookahead: the rest is consumed and put back.
ESCAPE_CONSUMING = rf"([<\[])(\\*(?:{_REST}))"

TURNS = "array<struct<role:string,text:string>>"


def escape(text: Column) -> Column:
    """Text without any control string; ``unescape`` is its exact inverse."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1")


# ---------------------------------------------------------------- layouts


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; list elements add ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(names: Sequence[str]) -> str:
    """Hash of a set of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(names)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Message:
    """How one kind of list element becomes a turn; ``part`` names the text field of
    a text that comes as a list of parts."""

    fields: tuple[str, ...]
    role: str
    text: str
    part: str | None = None


@dataclass(frozen=True)
class Layout:
    """How one layout becomes turns: a list of messages, or one field per turn."""

    name: str
    fields: tuple[str, ...]
    #: list column, whose elements have fingerprints of their own
    messages: str | None = None
    #: (role, field or fields joined by a blank line); before the messages if there is a list
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    #: conversation id, turn number, role and text columns of rows by turn
    rows: tuple[str, str, str, str] | None = None


MESSAGES: tuple[Message, ...] = (
    Message(("role", "content"), "role", "content"),
    Message(("role", "content[].text"), "role", "content", "text"),
    Message(("role", "text"), "role", "text"),
    Message(("from", "value"), "from", "value"),
)
LISTS = ("messages", "turns", "conversations")
_SYSTEM = (("system", ("system",)),)

LAYOUTS: tuple[Layout, ...] = (
    Layout("rows_by_turn", ("conv_id", "turn", "role", "text"), rows=("conv_id", "turn", "role", "text")),
    *(Layout(name, (f"{name}[]",), messages=name) for name in LISTS),
    *(Layout(f"system_{name}", ("system", f"{name}[]"), messages=name, turns=_SYSTEM) for name in LISTS),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", ("prompt", "completion"), turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("system_prompt_response", ("system", "prompt", "response"), turns=(*_SYSTEM, ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction_output", ("instruction", "output"), turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction_input_output", ("instruction", "input", "output"), turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question_answer", ("question", "answer"), turns=(("user", ("question",)), ("assistant", ("answer",)))),
)

#: Paths that any mapping reads; others (names, ids, scores) are not part of a fingerprint.
KNOWN = frozenset(f for x in LAYOUTS for f in x.fields)
KNOWN_BELOW = frozenset(f for x in MESSAGES for f in x.fields)

#: Names that other layouts use for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    r = F.coalesce(role.cast("string"), F.lit(""))
    return F.coalesce(F.try_element_at(names, r), r)


def _turn(message: Message, m: Column) -> Column:
    text = m[message.text]
    if message.part:
        text = F.array_join(F.transform(text, lambda p: F.coalesce(p[message.part].cast("string"), F.lit(""))), "")
    return F.struct(_role(m[message.role]).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns(layout: Layout, field) -> Column:
    """The turns of single fields; ``field`` gives a column for a top-level name."""
    out = []
    for role, names in layout.turns:
        parts = [F.when(F.length(field(n).cast("string")) > 0, field(n).cast("string")) for n in names]
        out.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *parts).alias("text")))
    # a leading system turn without text is no turn
    return F.filter(F.array(*out), lambda t: (t["role"] != "system") | (F.length(t["text"]) > 0)) if out else F.array().cast(TURNS)


def canonical(df: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Add ``turns``, read by the mapping that the DataFrame's schema selects.

    Fields that no mapping knows, and columns in ``ignore``, are not part of the
    fingerprint. Rows by turn become ``conv_id, turns``, a row for each conversation.
    """
    found = paths(T.StructType([f for f in df.schema.fields if f.name not in ignore]))
    tops = {f"{p.split('[].')[0]}[]" if "[]." in p else p for p in found} & KNOWN
    layout = {fingerprint(x.fields): x for x in LAYOUTS}.get(fingerprint(tops))
    if layout and layout.rows:
        return gather(df, **dict(zip(("conv_id", "turn", "role", "text"), layout.rows, strict=True)))
    turns = _turns(layout, F.col) if layout else None
    if layout and layout.messages:
        below = {p.split("[].", 1)[1] for p in found if p.startswith(f"{layout.messages}[].")} & KNOWN_BELOW
        message = {fingerprint(x.fields): x for x in MESSAGES}.get(fingerprint(below))
        own = F.coalesce(F.col(layout.messages), F.array())
        turns = F.concat(turns, F.transform(own, lambda m: _turn(message, m))) if message else None
    return df.withColumn("turns", F.lit(None).cast(TURNS) if turns is None else turns.cast(TURNS))


def canonical_json(df: DataFrame, column: str) -> DataFrame:
    """Add ``layout`` and ``turns`` to rows with a JSON object each, of any layout.

    A row's fingerprint covers its top-level paths; every element of a message list
    has its own, over all levels below it, so one list may mix kinds. A row with an
    element of no known kind gets null turns: no text is lost silently.
    """
    flat = sorted({n for x in LAYOUTS for _, names in x.turns for n in names})
    schema = ",".join([*(f"`{k}` array<string>" for k in LISTS), *(f"`{n}` string" for n in flat)])
    singles = sorted({f for x in MESSAGES for f in x.fields if "[]" not in f})
    lists = sorted({(x.text, x.part) for x in MESSAGES if x.part})
    element = ",".join(f"`{n}` string" for n in singles)
    listed = ",".join(f"`{n}` array<struct<`{p}`:string>>" for n, p in lists)
    none = F.array().cast("array<string>")
    j, top = F.col(column), F.col("__tessella_json")

    def print_(names: Column) -> Column:
        return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(names)), "\n"), 256), 1, 16)

    def read(e: Column) -> Column:
        """An element's paths and values."""
        parts = F.from_json(e, listed)
        keys = F.filter(F.coalesce(F.json_object_keys(e), none), lambda k: k.isin([*singles, *(n for n, _ in lists)]))
        def path(k: Column) -> Column:
            out = k
            for n, p in lists:
                out = F.when((k == n) & parts[n].isNotNull(), F.lit(f"{n}[].{p}")).otherwise(out)
            return out

        named = F.transform(keys, path)
        return F.struct(print_(named).alias("kind"), F.from_json(e, element).alias("one"), parts.alias("many"))

    def turn(e: Column) -> Column:
        out = F.lit(None).cast("struct<role:string,text:string>")
        for x in MESSAGES:
            value = _turn(x, F.struct(e["one"][x.role].alias(x.role), e["many" if x.part else "one"][x.text].alias(x.text)))
            out = F.when(e["kind"] == fingerprint(x.fields), value).otherwise(out)
        return out

    keys = F.coalesce(F.json_object_keys(j), none)
    out = df.withColumn("__tessella_json", F.from_json(j, schema))
    tops = F.transform(keys, lambda k: F.when(k.isin(list(LISTS)), F.concat(k, F.lit("[]"))).otherwise(k))
    out = out.withColumn("__tessella_print", print_(F.filter(tops, lambda k: k.isin(sorted(KNOWN)))))
    held = F.coalesce(*[top[x] for x in LISTS], none)
    out = out.withColumn("__tessella_turns", F.transform(F.transform(held, read), turn))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in (x for x in LAYOUTS if not x.rows):
        same = F.col("__tessella_print") == fingerprint(x.fields)
        own = _turns(x, lambda n: top[n]).cast(TURNS)
        if x.messages:
            listed_ = F.col("__tessella_turns")
            own = F.when(top[x.messages].isNotNull() & ~F.exists(listed_, lambda t: t.isNull()), F.concat(own, listed_.cast(TURNS)))
        layout = F.when(same, F.lit(x.name)).otherwise(layout)
        turns = F.when(same, own).otherwise(turns)
    return out.withColumns({"layout": layout, "turns": turns}).drop("__tessella_print", "__tessella_json", "__tessella_turns")


def gather(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turns`` from rows by turn."""
    item = F.struct(
        F.col(turn).alias("n"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    lists = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(item)).alias("messages"))
    return lists.select("conv_id", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("turns"))


# ---------------------------------------------------------------- template


def format_turns(df: DataFrame, *, turns: str = "turns", loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Add ``formatted`` and ``loss_spans``.

    ``loss_spans`` has start and end (code points of ``formatted``) of each body
    under the loss; heads and marks never are.
    """
    parts = "__tessella_parts"
    out = df.withColumn(
        parts,
        F.transform(turns, lambda t: F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY)).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(list(loss_roles)).alias("loss"))),
    )
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    kind = "array<struct<start:bigint,end:bigint>>"
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("spans"))

    def step(s: Column, p: Column) -> Column:
        first = s["at"] + F.length(p["head"])
        last = first + F.length(p["body"])
        span = F.when(p["loss"], F.array(F.struct(first.alias("start"), last.alias("end")))).otherwise(F.array().cast(kind))
        return F.struct((last + len(END)).alias("at"), F.concat(s["spans"], span).alias("spans"))

    spans = F.aggregate(parts, start, step, lambda s: s["spans"])
    return out.withColumns({"formatted": F.coalesce(text, F.lit("")), "loss_spans": F.coalesce(spans, F.array().cast(kind))}).drop(parts)


def read_back(df: DataFrame, *, formatted: str = "formatted", loss_spans: str = "loss_spans") -> DataFrame:
    """Add ``read_turns`` and ``loss_text``, taken from the formatted text alone
    (and, for the loss, the spans in it)."""
    pieces = F.filter(F.split(F.col(formatted), F.lit(END.replace("|", r"\|"))), lambda p: p != "")

    def turn(p: Column) -> Column:
        parts = F.split(p, BODY.replace("|", r"\|"), 2)
        return F.struct(unescape(F.substr(F.get(parts, F.lit(0)), F.lit(len(TURN) + 1))).alias("role"), unescape(F.get(parts, F.lit(1))).alias("text"))

    under = F.transform(F.col(loss_spans), lambda s: unescape(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return df.withColumns({"read_turns": F.transform(pieces, turn), "loss_text": F.array_join(under, "")})


def digest(turns: Column) -> Column:
    """SHA-256 of role, newline, text, newline per turn."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
