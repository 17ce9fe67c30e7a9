"""BPE as a deterministic automaton: compiled from merges, run over pre-split words.

**Compilation.** The automaton reads tokens. It starts with one state that every byte leads back to.
A merge (a, b) -> c applies the merge gadget: the state that ``a`` leads to is split off, the new
state lacks the arc ``b``, and wherever an ``a`` arc starts a ``c`` arc is added, which ends where
that ``b`` arc ended. After all merges, exactly one path spells any given string, and its arcs are
the tokens that merging would give. If no path has ``a`` followed by ``b`` at that time, the merge
can never fire and ``c`` stays without arcs.

All arcs of one token end in one state, so a state is named by a token; its missing arcs are the
splits of that token, of its right part before the token was born, of that one's right part, and so
on. An arc (token born from its left part) is missing where its left part was missing at its birth.
Two short walks over the table of splits therefore decide any transition; rows of the transition
table are filled on first use, and emptied when it grows long. The vocabulary is broadcast and each worker compiles it once, in about a
second for 50,000 merges; its size does not depend on the data.

**Encoding** follows arcs from the start of a word, longest labels first. Only one path leads to any
place in a word, so each place is entered and given up once at most and time is linear in the word's
length, also for words of 100,000 bytes. **Decoding** emits the arcs' labels.

Defined results: null text is encoded as the empty text (no ids); the strings of special tokens in a
text become their ids, as the tokenizers library does; unknown ids in decoding are an error.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed value: how byte-level vocabularies of this family split a text before merging.
WORD_PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Words whose ids a task remembers as recently met; beyond it, these replace those remembered from before.
REMEMBERED_WORDS = 110_000
REMEMBERED_ARCS = 300_000
PORTION = 500  # rows whose texts and ids a task holds at once
LATER = 1 << 60
PARTS = ("vocab", "merges", "special")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Automaton:
    """Tables made by one merge gadget after another."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]], special: dict[str, int]):
        symbols = byte_symbols()
        self.special = special
        self._table: dict[int, bool] = {}
        self._words: dict[str, bytes] = {}
        self._words_before: dict[str, bytes] = {}
        self.labels = {i: bytes(symbols[c] for c in token) for token, i in vocab.items() if token not in special}
        self.labels |= {i: token.encode() for token, i in special.items()}
        self.parts: dict[int, tuple[int, int]] = {}  # token -> the two tokens it was merged from
        self.born: dict[int, int] = {}  # token -> the merge that made it
        self.splits: dict[tuple[int, int], int] = {}  # (a, b) -> the merge that took arc b from a's state
        arcs = {vocab[c] for c in symbols if c in vocab}
        for time, (left, right) in enumerate(merges):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if c in arcs:
                raise ValueError(f"two merges make token {c}")
            if a in arcs and b in arcs and self.follows(a, b):
                self.splits[a, b] = time
                self.parts[c], self.born[c] = (a, b), time
                arcs.add(c)
        ids = {self.labels[t]: t for t in arcs}
        self.size = {t: len(label) for label, t in ids.items()}
        # What tokens begin with -> twice the longest token that it begins with (-2: none), odd if longer ones begin with it
        self.pieces: dict[bytes, int] = {}
        longer = {label[:n] for label in ids for n in range(1, len(label))}
        for piece in sorted(longer.union(ids), key=len):
            found = ids.get(piece, self.pieces.get(piece[:-1], -2) >> 1)
            self.pieces[piece] = 2 * found + (piece in longer)
        self.shorter = {}  # token -> the longest token that it begins with
        for label, token in ids.items():
            cut = next((label[:n] for n in range(len(label) - 1, 0, -1) if label[:n] in ids), None)
            if cut is not None:
                self.shorter[token] = ids[cut]

    def follows(self, last: int, token: int) -> bool:
        """Whether the state that ``last`` leads to has an arc ``token``."""
        splits, parts, born = self.splits, self.parts, self.born
        until = LATER  # splits of `last` before this time count
        while True:
            part, made = token, LATER  # an arc is gone if it or what it was made from was gone then
            while True:
                at = splits.get((last, part))
                if at is not None and at < until and at <= made:
                    return False
                if part not in parts:
                    break
                part, made = parts[part][0], born[part]
            if last not in parts:
                return True
            last, until = parts[last][1], born[last]

    @cached_property
    def _special(self) -> regex.Pattern | None:
        names = sorted(self.special, key=len, reverse=True)
        return regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def _fill(self, last: int, token: int) -> bool:
        table = self._table
        if len(table) > REMEMBERED_ARCS:
            table.clear()
        known = table[last << 32 | token] = self.follows(last, token)
        return known

    def _longest(self, word: bytes, start: int) -> int | None:
        """The longest token that the word has at a place."""
        piece, end = self.pieces.get, start + 3  # most words have three bytes that some token begins with
        found = piece(word[start:end])
        while found is None and end > start + 1:
            end -= 1
            found = piece(word[start:end])
        while found is not None and found & 1 and end < len(word):
            end += 1
            more = piece(word[start:end])
            if more is None:
                break
            found = more
        return None if found is None or found < 0 else found >> 1

    def word(self, word: bytes) -> list[int]:
        """The ids on the only path that spells the word.

        Longest arcs are tried first. Only one path leads to any place in the word, so a place from which
        no arc goes on is closed for good, and no place is left twice by the same arc.
        """
        path: list[int] = []
        closed: set[int] = set()
        at, size, shorter, arc = 0, self.size, self.shorter, self._table.get
        token = self._longest(word, 0)
        while at < len(word):
            while token is not None:
                if at + size[token] not in closed:
                    known = not path or arc(path[-1] << 32 | token)
                    if self._fill(path[-1], token) if known is None else known:
                        break
                token = shorter.get(token)
            if token is not None:
                path.append(token)
                at += size[token]
                token = self._longest(word, at)
            elif path:
                closed.add(at)
                last = path.pop()
                at -= size[last]
                token = shorter.get(last)
            else:
                raise ValueError("a byte has no token")
        return path

    def _plain(self, text: str, out: list[bytes], words: Callable[[str], list[str]]) -> None:
        known, before = self._words, self._words_before
        for word in words(text):
            ids = known.get(word)
            if ids is None:
                if len(known) > REMEMBERED_WORDS:
                    self._words, self._words_before = known, before = {}, known
                ids = before.get(word) or array("I", self.word(word.encode())).tobytes()
                if len(word) < 100:
                    known[word] = ids
            out.append(ids)

    def encode(self, text: str, words: Callable[[str], list[str]]) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        if self._special is None:
            self._plain(text, out, words)
        else:
            for i, part in enumerate(self._special.split(text)):
                if i % 2:
                    out.append(array("I", [self.special[part]]).tobytes())
                elif part:
                    self._plain(part, out, words)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, array("I", ids))).decode("utf-8", "replace")


def read_vocabulary(path: str) -> dict:
    """Vocabulary, merges and special tokens of a file in the tokenizers library's JSON format."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    return {"vocab": spec["model"]["vocab"], "merges": merges, "special": special}


def compile_tokenizer(path: str) -> Automaton:
    return Automaton(**read_vocabulary(path))


def encode(docs: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """For each row its keys, ``ids`` (little-endian unsigned 32-bit), ``n_tokens`` and ``decoded``.

    One pass without a shuffle. Rows go through in portions; a portion's texts and ids are all that a
    task holds beside the tables.
    """
    if clash := {"ids", "n_tokens", "decoded"} & set(keys):
        raise ValueError(f"keys named like results: {sorted(clash)}")
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker compiles the vocabulary once and keeps the automaton alone, with what it remembers, for its next tasks.
        tables = vocabulary.value
        if "machine" not in tables:
            machine = Automaton(*(tables[k] for k in PARTS))
            tables.clear()
            tables["machine"] = machine
        machine = tables["machine"]
        words = regex.compile(WORD_PATTERN).findall
        for batch in batches:
            for first in range(0, batch.num_rows, PORTION):
                rows = batch.slice(first, PORTION)
                *kept, texts = rows.columns
                ids = [machine.encode(t.as_py() or "", words) for t in texts]
                made = [
                    pa.array(ids, pa.binary()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([machine.decode(x) for x in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*rows.schema.names[:-1], "ids", "n_tokens", "decoded"])

    chosen = docs.select(*keys, docs[text].alias("_text"))
    result = T.StructType(
        [
            *[chosen.schema[k] for k in keys],
            T.StructField("ids", T.BinaryType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("decoded", T.StringType()),
        ]
    )
    return chosen.mapInArrow(run, result)
