"""Conversation structure repair: the cheapest edits that make a conversation's roles well formed.

Role initials have to read ``(s?(ua)+)?``. Keeping a turn costs 0, giving it the role user or assistant 3,
deleting it 4, inserting an empty turn 3; a truncated turn that stays adds 3; blank and duplicate turns have
to go. Edits are named by their initials in order, the *audit*; of equally cheap ones the least text counts.

**Signature.** Each turn becomes one letter: its role's initial, in capitals if truncated, ``x`` if blank or a
duplicate. What can be repaired and how depends on the signature alone, and few signatures are distinct.

**Suffix-shared automaton.** Distinct signatures are dealt out and sorted by their letters from the end, so all
with a common suffix are neighbours, and the part of the automaton that goes on to be shared is a stack: a new
signature keeps the nodes of the suffix that it shares with the one before it, and adds its own. Each node, one
for each distinct suffix, is worked out once for all conversations: for each of the four grammar states the
cost to the end and the first edit of the best audit, whose rest is the best audit of the state that follows. As
each edit leads to one state only, the least first edit among the cheapest is that of the least audit.

The audits go back to the conversations by a join, and each conversation's turns pass once more, in order, to
be edited. Turns are sorted by the engine, which spills, and read as a stream: a task holds one batch, one
signature (a byte a turn) and its audit, however long a conversation is.

Defined results: null roles and texts are one space; turns go by number (nulls first), then role, then text;
a conversation with a null id is one of its own; one without turns has no faults, no edits and no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Grammar states: nothing yet, after s, after u, after a. By the next role's initial, where a state leads.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
AFTER = {state: STEPS[state, role[0]] for state, role in WANTED.items()}
# A node: for each state the cost to the end, the first edit ('' at the end), and the state that follows it.
Node = tuple[tuple[int, str, int], ...]


def _with_inserts(rest: list[list[tuple[int, str, int]]]) -> Node:
    """The best choice for each state: of what it can do with the turn, or inserting first."""
    cost = [min((c for c, _, _ in options), default=1 << 60) for options in rest]
    for _ in range(len(cost)):
        cost = [min(own, INSERT + cost[AFTER[state]]) for state, own in enumerate(cost)]
    node = []
    for state, options in enumerate(rest):
        options = [*options, (INSERT + cost[AFTER[state]], "I", AFTER[state])]
        node.append(min((o for o in options if o[0] == cost[state]), key=lambda o: o[1]))
    return tuple(node)


END: Node = _with_inserts([[(0, "", state)] if state in (START, ASSISTANT) else [] for state in range(4)])


def node_before(letter: str, after: Node) -> Node:
    """The node of a suffix that is one turn longer."""
    rest = []
    for state in range(4):
        options = [(DELETE + after[state][0], "D", state)]
        if letter != "x":
            more = TRUNCATED if letter.isupper() else 0
            to = STEPS.get((state, letter.lower()))
            if to is not None:
                options.append((more + after[to][0], "K", to))
            options.append((RELABEL + more + after[AFTER[state]][0], "R", AFTER[state]))
        rest.append(options)
    return _with_inserts(rest)


class SuffixAutomaton:
    """Best audits of signatures that come sorted from their ends."""

    def __init__(self):
        self.letters: str = ""  # from the end
        self.nodes: list[Node] = [END]
        self.made = 0

    def audit(self, signature: str) -> tuple[int, str]:
        letters = signature[::-1]
        shared, most = 0, min(len(letters), len(self.letters))
        while shared < most and letters[shared] == self.letters[shared]:
            shared += 1
        del self.nodes[shared + 1 :]
        for letter in letters[shared:]:
            self.nodes.append(node_before(letter, self.nodes[-1]))
        self.made += len(letters) - shared
        self.letters = letters
        state, at, edits = START, len(letters), []
        while True:
            _, edit, to = self.nodes[at][state]
            if not edit:
                return self.nodes[-1][START][0], "".join(edits)
            edits.append(edit)
            state, at = to, at if edit == "I" else at - 1


def audits(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton()
        for batch in batches:
            own = batch.column(0).to_pylist()
            found = [automaton.audit(s) for s in own]
            columns = [batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["signature", "cost", "audit"])

    distinct = signatures.select("signature").distinct().withColumn("from_end", F.reverse("signature"))
    dealt = distinct.repartitionByRange("from_end").sortWithinPartitions("from_end")
    return dealt.select("signature").mapInArrow(run, "signature string, cost long, audit string")


def _turns(rows: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text")
    )


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("kind"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal")


class _Assessment:
    """What is kept of one conversation while its turns pass."""

    def __init__(self):
        self.letters, self.before, self.counts = [], None, dict.fromkeys(FIGURES[1:], 0)
        self.first = self.last = None
        self.numbers = 0

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.numbers = turn if self.first is None else self.first, turn, self.numbers + 1
        if self.before is not None and self.before + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.before = initial
        if fault:
            self.counts[fault] += 1
        letter = initial if initial and initial in "sua" else "o"
        self.letters.append("x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)

    def figures(self) -> list:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.numbers
        return ["".join(self.letters), gaps, *self.counts.values()]


def assess(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, signature, gaps, blank, duplicate, truncated, illegal), stored; ``ids`` may add empty conversations."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "signature", *FIGURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, done, arrow = None, None, [], None

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [arrow, pa.string(), *[pa.int64()] * len(FIGURES)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            arrow = batch.schema.types[0]
            for conversation, turn, initial, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own is None or conversation != key:
                    if own is not None:
                        done.append([key, *own.figures()])
                    key, own = conversation, _Assessment()
                if fault is not None:
                    own.add(turn, initial, fault)
            if done:
                yield out()
                done = []
        if own is not None:
            done.append([key, *own.figures()])
            yield out()

    turns = _turns(rows).withColumn("kind", F.lit(1))
    if ids is not None:
        empty = ids.select("conv_id").distinct().select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))], F.lit(0).alias("kind"))
        turns = turns.unionByName(empty)
    seen = F.row_number().over(Window.partitionBy("conv_id", "kind", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    end = F.rtrim("text", F.lit(SPACE))
    fault = (
        F.when(F.col("kind") == 0, None)
        .when(end == "", "blank")
        .when(F.col("seen") > 1, "duplicate")
        .when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    sorted_ = turns.repartition("conv_id").withColumn("seen", seen).sortWithinPartitions(*_order(), "seen")
    faults = sorted_.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    figures = ", ".join(f"{c} long" for c in FIGURES)
    return store(faults.mapInArrow(run, f"conv_id {kind}, signature string, {figures}"))


def plan(assessed: DataFrame) -> DataFrame:
    """The assessed conversations with ``cost`` and ``audit``."""
    return assessed.join(audits(assessed), "signature")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of turns in order, each conversation's plan in front: ('plan', row), then ('turn', edit, role, text) of what stays."""
    edits, at, state = "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            yield "turn", "I", WANTED[state], ""
            at, state = at + 1, AFTER[state]

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[1] == 0:
                yield from inserted()
                yield "plan", row
                edits, at, state = row[4], 0, START
                continue
            yield from inserted()
            edit, role = edits[at], row[2]
            if edit == "R":
                role = WANTED[state]
            if edit != "D":
                yield "turn", edit, role, row[3]
                state = STEPS[state, role[0]]
            at += 1
    yield from inserted()


EDITED = "edit string, place long, role string, text string"
_PORTION = 4096


def _turn_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, place, rows, arrow = None, 0, [], None

    def out() -> pa.RecordBatch:
        types = [arrow, pa.string(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "edit", "place", "role", "text"])

    def noted() -> Iterator[pa.RecordBatch]:
        nonlocal arrow
        for batch in batches:
            arrow = batch.schema.types[0]
            yield batch

    for event in _edited(noted()):
        if event[0] == "plan":
            key, place = event[1][0], 0
            continue
        rows.append((key, event[1], place, event[2], event[3]))
        place += 1
        if len(rows) >= _PORTION:
            yield out()
            rows = []
    if rows:
        yield out()


def _digest_rows(batches: Iterator[pa.RecordBatch], figures: int) -> Iterator[pa.RecordBatch]:
    head, digest, turns, done, arrow = None, hashlib.sha256(), 0, [], None

    def out() -> pa.RecordBatch:
        types = [arrow, *[pa.int64()] * figures, pa.string(), pa.int64(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])

    def noted() -> Iterator[pa.RecordBatch]:
        nonlocal arrow
        for batch in batches:
            arrow = batch.schema.types[0]
            yield batch

    for event in _edited(noted()):
        if event[0] == "plan":
            if head is not None:
                done.append((head[0], *head[5:], head[4], turns, digest.hexdigest()))
                if len(done) >= _PORTION:
                    yield out()
                    done = []
            head, digest, turns = event[1], hashlib.sha256(), 0
            continue
        digest.update(f"{chr(10) if turns else ''}{event[2]}:{event[3]}".encode())
        turns += 1
    if head is not None:
        done.append((head[0], *head[5:], head[4], turns, digest.hexdigest()))
        yield out()


def _in_order(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its turns in order, as columns conv_id, kind, role, text, audit and figures."""
    columns = [*FIGURES, "cost"]
    none = [F.lit(None).cast("long").alias(c) for c in columns]
    turns = _turns(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast("string").alias("audit"), *none)
    heads = plans.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit", *columns
    )
    dealt = heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(*_order())
    return dealt.select("conv_id", "kind", "role", "text", "audit", *columns)


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns (conv_id, edit, place, role, text) of all conversations after their edits."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _in_order(rows, plans).mapInArrow(_turn_rows, f"conv_id {kind}, {EDITED}")


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's figures, cost and audit, and of its repaired turns their number and digest."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    columns = [*FIGURES, "cost"]
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in columns)}, audit string, n_turns long, repaired_sha256 string"
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch], made=partial(_digest_rows, figures=len(columns))) -> Iterator[pa.RecordBatch]:
        for batch in made(batches):
            yield batch.rename_columns(names)

    return _in_order(rows, plans).mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults: by a checksum of conversation and turn, a fifth is lost, emptied, cut, repeated or mislabelled."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20
    changed = F.when(fate == 1, "").when(fate == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    copies = F.when(fate == 0, F.array()).when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(fate == 4, "user").otherwise(text("role")).alias("role")
    return rows.select("conv_id", "turn", role, changed.alias("text"), F.explode(copies).alias("copy")).drop("copy")
