"""Chat formatting: any known layout of conversations to turns, turns to one marked text.

The layout of a record is its fingerprint, a hash of its nested field paths.  A mapping
for that fingerprint says declaratively where roles and texts lie.  Canonical turns are
written in a template whose marks cannot occur in texts, as the signs that marks are made
of are escaped there; so the formatted rows give the turns back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearset.llm.common import ready


def field_paths(kind: T.DataType, path: str = "") -> list[str]:
    """Paths of all leaves; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{path}.{f.name}".lstrip("."))]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{path}[]")
    return [path]


def fingerprint(paths: list[str]) -> str:
    """Hash of field paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """Where the turns of a layout lie.

    ``fields`` are the paths that make the layout.  Either ``turns`` names an array with
    a ``role`` and a ``text`` field and ``roles`` renames its roles, or ``columns`` lists
    (role, column) in the order of the turns, or ``order`` marks one turn per row.
    """

    fields: tuple[str, ...]
    turns: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    roles: tuple[tuple[str, str], ...] = ()
    columns: tuple[tuple[str, str], ...] = ()


_SHARE_ROLES = (("human", "user"), ("gpt", "assistant"))
MAPPINGS = {
    fingerprint(list(m.fields)): m
    for m in (
        Mapping(("turn", "role", "text"), order="turn", role="role", text="text"),
        Mapping(("messages[].role", "messages[].content"), "messages", "role", "content"),
        Mapping(("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=_SHARE_ROLES),
        Mapping(("prompt", "response"), columns=(("user", "prompt"), ("assistant", "response"))),
        Mapping(("prompt", "completion"), columns=(("user", "prompt"), ("assistant", "completion"))),
        Mapping(("instruction", "output"), columns=(("user", "instruction"), ("assistant", "output"))),
        Mapping(
            ("instruction", "input", "output"),
            columns=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
        ),
        Mapping(
            ("system", "prompt", "response"),
            columns=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
        ),
    )
}


def _renamed(role: Column, roles: tuple[tuple[str, str], ...]) -> Column:
    for old, new in roles:
        role = F.when(role == old, F.lit(new)).otherwise(role)
    return role


def canonical_turns(
    records: DataFrame, id_col: str = "conv_id", mappings: dict[str, Mapping] | None = None
) -> DataFrame:
    """(conv_id, turn, role, text), a row per turn, from records of a known layout.

    The mapping is chosen by the fingerprint of all columns but ``id_col``; an unknown
    layout raises ValueError with its paths.  Null texts and roles are empty; in layouts
    of one record a conversation, turns that are null as a whole are left out, and so
    are empty ``input`` and ``system`` columns.  An empty table gives no rows.
    """
    mappings = MAPPINGS if mappings is None else mappings
    rest = T.StructType([f for f in records.schema if f.name != id_col])
    paths = field_paths(rest)
    m = mappings.get(fingerprint(paths))
    if m is None:
        raise ValueError(f"no mapping for the layout {sorted(paths)}")
    conv_id = F.col(id_col).cast("bigint").alias("conv_id")
    if m.order:
        turn, role, text = F.col(m.order).cast("bigint"), F.col(m.role), F.col(m.text)
        rows = records.select(conv_id, turn.alias("turn"), role.alias("role"), text.alias("text"))
    elif m.turns:
        each = records.select(conv_id, F.posexplode(m.turns).alias("turn", "x")).where("x IS NOT NULL")
        rows = each.select(
            "conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("x")[m.role].alias("role"), F.col("x")[m.text].alias("text")
        )
    else:
        listed = F.array(*[F.struct(F.lit(r).alias("role"), F.col(c).alias("text"), F.lit(c).alias("c")) for r, c in m.columns])
        each = records.select(conv_id, F.posexplode(listed).alias("turn", "x"))
        optional = F.col("x.c").isin("input", "system")
        each = each.where(~(optional & (F.coalesce("x.text", F.lit("")) == "")))
        rows = each.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "x.role", "x.text")
    role = _renamed(F.coalesce("role", F.lit("")), m.roles)
    return rows.select("conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))


#: Fixed values of the template: what opens and closes a turn, and how signs are escaped.
OPEN, BETWEEN, CLOSE = "### ", ":\n", "</turn>\n"
ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_UNESCAPE = {v: k for k, v in ESCAPES.items()}
_ESCAPED = re.compile("|".join(re.escape(v) for v in _UNESCAPE))
_PARTS = re.compile(re.escape(OPEN) + "([^:]*)" + re.escape(BETWEEN) + "([^<]*)" + re.escape(CLOSE))


def _escape(text: Column, signs: str) -> Column:
    for sign in signs:  # the backslash first
        text = F.replace(text, F.lit(sign), F.lit(ESCAPES[sign]))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _UNESCAPE[m[0]], text)


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, loss_start, loss_end), a row per turn.

    The formatted text of a conversation is that of its turns in order; the places are
    code points within the turn, and only texts of role assistant lie under the loss.
    Turns of one number stand in the order of their formatted texts.
    """
    role, text = _escape(F.col("role"), "\\#<:"), _escape(F.col("text"), "\\#<")
    head = F.concat(F.lit(OPEN), role, F.lit(BETWEEN))
    made = turns.select("conv_id", "turn", "role", head.alias("head"), text.alias("body"))
    start = F.length("head")
    learned = F.col("role") == "assistant"
    return made.select(
        "conv_id",
        "turn",
        F.concat("head", "body", F.lit(CLOSE)).alias("formatted"),
        F.when(learned, start).alias("loss_start"),
        F.when(learned, start + F.length("body")).alias("loss_end"),
    )


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn."""
    m = _PARTS.fullmatch(formatted)
    if m is None:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from formatted turns.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).  Turns
    stream through a task in order and only digests are held, so a conversation of any
    length takes the memory of one turn.  A null conv_id is one conversation.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_id, state = None, None

        def row() -> tuple:
            n, turns, chars, loss, total = state
            return (open_id, n, turns.hexdigest(), chars, loss.hexdigest(), total)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

        for batch in batches:
            done = []
            spans = zip(batch["loss_start"], batch["loss_end"])
            for conv_id, text, (start, end) in zip(batch["conv_id"], batch["formatted"], spans):
                conv_id = None if pd.isna(conv_id) else int(conv_id)
                if state is None or conv_id != open_id:
                    if state is not None:
                        done.append(row())
                    open_id, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, said = parse_turn(text)
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if not pd.isna(start):
                    learned = unescape(text[int(start) : int(end)])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if done:
                yield frame(done)
        if state is not None:
            yield frame([row()])

    ready(formatted.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "formatted"]
    placed = formatted.repartition("conv_id").sortWithinPartitions(*order)
    schema = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint"
    )
    return placed.select("conv_id", "formatted", "loss_start", "loss_end").mapInPandas(run, schema)
