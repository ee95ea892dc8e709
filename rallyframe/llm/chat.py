"""Chat formatting: heterogeneous records become canonical turns, then a masked template.

Everything here is DataFrame and SQL functions. A record's layout is recognised by its schema
fingerprint: the SHA-256 of the sorted nested field paths that hold a value in that row. The
fingerprint selects one declarative ``Layout``; rows of any mix of layouts may share a frame.
"""

import hashlib
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """How one record layout maps to turns.

    ``paths`` must hold a value and ``optional`` may. Either ``messages`` names a list with a
    role and a text field (``roles`` renames roles), or ``fields`` lists (role, path) pairs;
    pairs whose path is absent from a record give no turn.
    """

    name: str
    paths: tuple
    optional: tuple = ()
    messages: tuple | None = None
    roles: tuple = ()
    fields: tuple = ()

    def fingerprints(self):
        for n in range(len(self.optional) + 1):
            for extra in combinations(self.optional, n):
                yield fingerprint(self.paths + extra)


LAYOUTS = (
    Layout("messages", ("messages",), ("messages[].role", "messages[].content"), ("messages", "role", "content")),
    Layout(
        "shares", ("conversations",), ("conversations[].from", "conversations[].value"),
        ("conversations", "from", "value"), (("human", "user"), ("gpt", "assistant")),
    ),
    Layout(
        "instruction", ("instruction", "output"), ("input", "system"),
        fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Layout(
        "prompt", ("prompt", "response"), ("system",),
        fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
    Layout(
        "nested_prompt", ("prompt", "prompt.text", "completion", "completion.text"),
        fields=(("user", "prompt.text"), ("assistant", "completion.text")),
    ),
)


def fingerprint(paths):
    """Fingerprint of a set of nested field paths (``a.b`` for structs, ``a[].b`` for lists)."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _holds(name):
    return lambda x: x[name].isNotNull()


def _paths(kind, value, path):
    """(path, column: it holds a value) for every field below ``value``."""
    found = []
    for field in kind.fields:
        inner, name = value[field.name], f"{path}{field.name}"
        found.append((name, inner.isNotNull()))
        if isinstance(field.dataType, T.StructType):
            found += _paths(field.dataType, inner, name + ".")
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            for leaf in field.dataType.elementType.fields:
                found.append((f"{name}[].{leaf.name}", F.coalesce(F.exists(inner, _holds(leaf.name)), F.lit(False))))
    return found


def with_fingerprint(records, ignore=(), name="fingerprint"):
    """Add the fingerprint of each row over all columns but ``ignore``."""
    kind = T.StructType([f for f in records.schema.fields if f.name not in ignore])
    whole = F.struct(*[F.col(f"`{f.name}`") for f in kind.fields])
    found = sorted(_paths(kind, whole, ""))
    listed = F.array_join(F.array(*[F.when(held, F.lit(path)) for path, held in found]), "\n")
    return records.withColumn(name, F.sha2(listed, 256))


def _has(kind, path):
    for step in path.split("."):
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return False
        kind = kind[step].dataType
    return True


def _turns(layout, schema):
    """The turns of one layout as a column, or None where the frame has no such field."""
    if layout.messages:
        path, role, text = layout.messages
        if not _has(schema, path):
            return None
        element = schema[path].dataType.elementType

        def turn(x):
            said = x[role] if role in element.names else F.lit(None)
            for old, new in layout.roles:
                said = F.when(said == old, F.lit(new)).otherwise(said)
            body = x[text] if text in element.names else F.lit(None)
            return F.struct(
                F.coalesce(said.cast("string"), F.lit("")).alias("role"),
                F.coalesce(body.cast("string"), F.lit("")).alias("text"),
            )

        return F.transform(F.col(path), turn)
    held = [(role, F.col(path)) for role, path in layout.fields if _has(schema, path)]
    if not held:
        return None
    each = [
        F.when(value.isNotNull(), F.struct(F.lit(role).alias("role"), value.cast("string").alias("text")))
        for role, value in held
    ]
    return F.filter(F.array(*each), lambda t: t.isNotNull())


def canonical_turns(records, ignore=(), layouts=LAYOUTS):
    """Add ``fingerprint``, ``layout`` and ``turns`` (role and text in order).

    Rows whose fingerprint no layout knows keep null turns and their fingerprint. Null roles
    and texts inside a known layout are empty; an empty list of messages gives no turns.
    Columns in ``ignore`` (ids and the like) take no part in the fingerprint; columns called
    ``fingerprint``, ``layout`` or ``turns`` are replaced.
    """
    marked = with_fingerprint(records, ignore)
    turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for layout in layouts:
        column = _turns(layout, records.schema)
        if column is not None:
            chosen = F.col("fingerprint").isin(list(layout.fingerprints()))
            turns = F.when(chosen, column.cast(TURNS)).otherwise(turns)
            name = F.when(chosen, F.lit(layout.name)).otherwise(name)
    return marked.withColumns({"layout": name, "turns": turns})


def escape(text):
    """Make control strings inside a text plain: one backslash more after ``<`` before ``\\*|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text):
    """Undo ``escape`` exactly."""
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role):
    """Escape a role, which must also stay on one line."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role):
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(chats, turns="turns", learn=("assistant",)):
    """Add ``formatted`` and ``loss_spans``: (start, length) in code points of what is learnt.

    Spans cover the escaped text of each turn of a role in ``learn``, without its marks. Null
    turns format to an empty string without spans.
    """
    said = F.transform(
        F.coalesce(F.col(turns), F.array().cast(TURNS)),
        lambda t: F.struct(
            F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            t["role"].isin(list(learn)).alias("learnt"),
        ),
    )
    closing = len(END) + 1
    empty = F.expr("named_struct('at', 0L, 'spans', cast(array() AS array<struct<start:bigint,length:bigint>>))")

    def step(state, t):
        start = state["at"] + F.length(t["head"])
        size = F.length(t["body"]).cast("bigint")
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct(
            (start + size + closing).alias("at"),
            F.when(t["learnt"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return (
        chats.withColumn("__said", said)
        .withColumn(
            "formatted",
            F.array_join(F.transform("__said", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), ""),
        )
        .withColumn("loss_spans", F.aggregate("__said", empty, step)["spans"])
        .drop("__said")
    )


def parse(formatted):
    """The turns of a formatted chat as a column, unescaped."""
    pieces = F.split(formatted, r"<\|im_start\|>")

    def turn(piece):
        head = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(head) + 2, F.length(piece) - F.length(head) - 2 - len(END))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def learnt_text(formatted, spans):
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))),
        "",
    )


def conversation_records(rows, key="conv_id", turn="turn", role="role", text="text"):
    """Turn rows as records of the ``messages`` layout, one per key.

    Turns follow ``turn``, then role and text (nulls first); repeated rows are repeated turns;
    a null key is a conversation of its own. A record is one training example, so its turns
    meet in one row.
    """
    said = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))
    return (
        rows.groupBy(F.col(key).alias(key))
        .agg(F.array_sort(F.collect_list(said)).alias("__said"))
        .select(
            key,
            F.transform(
                "__said",
                lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")),
            ).alias("messages"),
        )
    )
