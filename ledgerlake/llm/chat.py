"""Chat formatting: layouts are told apart by a fingerprint of their field paths, then mapped.

**Fingerprint.** A record is a JSON object. Its nested field paths (``messages[].role``) are sorted
and hashed; the hash selects a declarative mapping from a table made once from the known layouts with
all their optional fields left in or out. Nothing is guessed from values.

**Turns.** A mapping says where turns come from: one turn for each row, one for each element of a list,
or one for each of some fields. Records go through tasks on their own; no record needs another.

**Template.** A turn is ``<|start|>role<|text|>text<|end|>``. In roles and texts ``\\`` becomes ``\\\\`` and
``<|`` becomes ``<\\|``, so no control string can occur inside a text and reading back is exact. The loss
mask covers the texts of assistants, as (start, end) in code points of the formatted turn.

Defined results: null roles and texts are empty; turns go by conversation, turn number (nulls first),
then place in the record, role, text, so repeated turn numbers have an order too; a list that is empty
or null gives no turn; a record with an unknown fingerprint or that is no JSON object goes to ``rejected``.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
# Names that layouts use for the same role.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a kind of record keeps its turns.

    ``fields`` are (path, role) pairs, each a turn of its own; ``items`` names a list whose elements have
    a role and a text field; ``row`` are the role and text fields of a record that is a single turn.
    ``conversation`` and ``turn`` name the fields that place a turn. Fields in ``optional`` may be absent.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    row: tuple[str, str] | None = None
    conversation: str = "id"
    turn: str | None = None
    optional: frozenset[str] = frozenset()

    def paths(self) -> set[str]:
        found = {self.conversation, *(path for path, _ in self.fields), *(self.row or ())}
        if self.turn:
            found.add(self.turn)
        if self.items:
            found |= {f"{self.items[0]}[].{field}" for field in self.items[1:]}
        return found


LAYOUTS: tuple[Layout, ...] = (
    Layout("row", row=("role", "text"), conversation="conv_id", turn="turn"),
    Layout("messages", fields=(("system", "system"),), items=("messages", "role", "content"), optional=frozenset({"system"})),
    Layout("shared", fields=(("system", "system"),), items=("conversations", "from", "value"), optional=frozenset({"system"})),
    Layout("prompt", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=frozenset({"system"})),
    Layout("completion", fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("question", fields=(("question", "user"), ("answer", "assistant"))),
    Layout("instruction", fields=(("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=frozenset({"input"})),
    Layout("chosen", fields=(("prompt", "user"), ("chosen", "assistant"), ("rejected", ""))),
    Layout("nested", items=("data.turns", "speaker.role", "body.text"), conversation="data.id"),
)


def field_paths(value: object, path: str = "") -> set[str]:
    """Paths of all fields below a JSON value; lists add ``[]`` and the paths of all their elements."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{path}.{k}" if path else k) for k, v in value.items())) if value else set()
    if isinstance(value, list):
        return set().union(*(field_paths(v, f"{path}[]") for v in value)) if value else {f"{path}[]"}
    return {path}


def fingerprint(paths: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


def mapping_table(layouts: Sequence[Layout] = LAYOUTS) -> dict[str, Layout]:
    """Fingerprint -> layout, for each choice of optional fields and for empty and null lists."""
    table: dict[str, Layout] = {}
    for layout in layouts:
        optional = sorted(layout.optional)
        for present in itertools.product((True, False), repeat=len(optional)):
            paths = layout.paths() - {f for f, there in zip(optional, present, strict=True) if not there}
            shapes = [paths]
            if layout.items:
                plain = {p for p in paths if not p.startswith(f"{layout.items[0]}[]")}
                shapes += [plain | {layout.items[0]}, plain | {f"{layout.items[0]}[]"}]
            for shape in shapes:
                if table.setdefault(fingerprint(shape), layout) != layout:
                    raise ValueError(f"{layout.name} looks like {table[fingerprint(shape)].name}")
    return table


def _get(record: object, path: str) -> object:
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def _said(value: object) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _turns(record: dict, layout: Layout) -> Iterator[tuple[str, str]]:
    if layout.row:
        yield _said(_get(record, layout.row[0])), _said(_get(record, layout.row[1]))
    for path, role in layout.fields:
        if role and (path not in layout.optional or _get(record, path) is not None):
            yield role, _said(_get(record, path))
    if layout.items:
        for item in _get(record, layout.items[0]) or ():
            yield _said(_get(item, layout.items[1])), _said(_get(item, layout.items[2]))


TURN_SCHEMA = "layout string, conversation string, turn long, place int, role string, text string"


def canonical_turns(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """One row for each turn of each JSON record; a record nobody knows gives one with a null layout."""
    mappings = mapping_table(layouts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for line in batch.iloc[:, 0]:
                try:
                    value = json.loads(line) if line else None
                except ValueError:
                    value = None
                layout = mappings.get(fingerprint(field_paths(value))) if isinstance(value, dict) else None
                if layout is None:
                    rows.append((None, None, None, None, None, line))
                    continue
                key = _get(value, layout.conversation)
                number = _get(value, layout.turn) if layout.turn else None
                for place, (role, text) in enumerate(_turns(value, layout)):
                    rows.append((layout.name, None if key is None else _said(key), number, place, ROLES.get(role, role), text))
            frame = pd.DataFrame(rows, columns=["layout", "conversation", "turn", "place", "role", "text"])
            yield frame.astype({"turn": "Int64", "place": "Int32"})

    return records.select(record).mapInPandas(run, TURN_SCHEMA)


def rejected(turns: DataFrame) -> DataFrame:
    return turns.where(F.col("layout").isNull()).select(F.col("text").alias("record"))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def format_turns(turns: DataFrame) -> DataFrame:
    """Known turns with ``formatted`` and the loss mask (``loss_start``, ``loss_end``; null if none).

    Row by row: however long a conversation is, its turns are formatted where they are. A conversation's
    text is its turns' formatted texts one after another.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    begin = F.length(role) + len(START) + len(TEXT)
    learnt = F.col("role") == "assistant"
    return turns.where(F.col("layout").isNotNull()).select(
        "conversation",
        "turn",
        "place",
        F.concat(F.lit(START), role, F.lit(TEXT), text, F.lit(END)).alias("formatted"),
        F.when(learnt, begin).alias("loss_start"),
        F.when(learnt, begin + F.length(text)).alias("loss_end"),
    )


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return "\\".join(part.replace("\\", "") for part in text.split("\\\\"))


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (formatted.startswith(START) and formatted.endswith(END)):
        raise ValueError("not a formatted turn")
    role, _, text = formatted[len(START) : -len(END)].partition(TEXT)
    return unescape(role), unescape(text)


DIGEST_SCHEMA = "conversation string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """Each conversation's digests, read back from its formatted turns.

    A digest over a conversation has to see its turns one after another. Rows are sorted by the engine,
    which spills, and read as a stream: a task holds one batch and the digests' states, however many
    turns a conversation has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started, key, turns, loss, n, loss_chars, chars = False, None, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for batch in batches:
            done = []
            for conversation, piece, start, end in zip(
                batch["conversation"], batch["formatted"], batch["loss_start"], batch["loss_end"], strict=True
            ):
                conversation = None if pd.isna(conversation) else conversation
                if not started or conversation != key:
                    if started:
                        done.append((key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    started, key, turns, loss, n, loss_chars, chars = True, conversation, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                role, text = read_turn(piece)
                turns.update(f"{role}\n{text}\n".encode())
                n, chars = n + 1, chars + len(piece)
                if not pd.isna(start):
                    masked = unescape(piece[int(start) : int(end)])
                    loss.update(masked.encode())
                    loss_chars += len(masked)
            if done:
                yield pd.DataFrame(done)
        if started:
            yield pd.DataFrame([(key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)])

    order = ["conversation", "turn", "place", "formatted"]
    return (
        formatted.repartition("conversation")
        .sortWithinPartitions(*order)
        .select("conversation", "formatted", "loss_start", "loss_end")
        .mapInPandas(lambda batches: (x.set_axis(NAMES, axis=1) for x in run(batches)), DIGEST_SCHEMA)
    )


NAMES = ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def as_records(rows: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Rows of a table as JSON records, nulls included."""
    names = columns.items() if isinstance(columns, Mapping) else [(c, c) for c in columns]
    fields = [rows[source].alias(name) for name, source in names]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))
