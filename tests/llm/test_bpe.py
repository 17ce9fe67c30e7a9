import inspect
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from tokenizers import Tokenizer

from ledgerlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def automaton():
    return bpe.compile_tokenizer(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_and_texts_equal_the_library(automaton, library):
    rng, words = random.Random(2), regex.compile(bpe.WORD_PATTERN).findall
    texts = ["".join(rng.choice("aabbeth  inos'\n<|>é1") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["", "a" * 5000, "aAbB" * 2000, "x<|endoftext|> y <|endoftext|><|endoftext", "\U0001f600 ſ İ\r\n\t  "]
    for text in texts:
        wanted = library.encode(text, add_special_tokens=False).ids
        ids = automaton.encode(text, words)
        assert np.frombuffer(ids, "<u4").tolist() == wanted
        assert automaton.decode(ids) == library.decode(wanted, skip_special_tokens=False)


def test_gadgets_on_a_small_vocabulary():
    vocab = {t: i for i, t in enumerate(["a", "b", "c", "aa", "ab", "aab"])}
    small = bpe.Automaton(vocab, [("a", "a"), ("a", "b"), ("aa", "b")], {})
    names = {i: t for t, i in vocab.items()}
    spell = lambda w: [names[t] for t in small.word(w.encode())]
    assert spell("aaa") == ["aa", "a"]
    assert spell("aab") == ["aab"]
    assert spell("aaab") == ["aa", "ab"]
    assert spell("cab") == ["c", "ab"]


def test_awkward_rows_come_back(awkward, awkward_rows, nothing):
    got = {r["doc_id"]: r for r in bpe.encode(awkward, PATH).collect()}
    assert {i: got[i]["decoded"] for i, _ in awkward_rows} == {i: t or "" for i, t in awkward_rows}
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got.values())
    assert bpe.encode(nothing, PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(awkward.withColumnRenamed("id", "ids"), PATH, ["ids"])


def test_rows_go_through_in_portions(frame, monkeypatch):
    """However many rows a batch has, few texts are held at once; keys and order stay together."""
    rows = [(k, f"text {k}") for k in range(1_200)]
    caught = []
    docs = frame(rows).coalesce(1)
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run) or self)
    bpe.encode(docs, PATH)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "_text"])
    out = list(caught[0](iter([batch])))
    assert max(b.num_rows for b in out) <= 500 and sum(b.num_rows for b in out) == 1_200
    assert [(i, t) for b in out for i, t in zip(b.column("doc_id").to_pylist(), b.column("decoded").to_pylist(), strict=True)] == rows


def test_a_worker_keeps_the_automaton_without_the_vocabulary(frame, monkeypatch):
    caught = []
    docs = frame([(1, "text")])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: caught.append(run) or self)
    bpe.encode(docs, PATH)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["text"])], ["doc_id", "_text"])
    for _ in range(2):
        (out,) = caught[0](iter([batch]))
        assert out.column("decoded").to_pylist() == ["text"]
    assert set(inspect.getclosurevars(caught[0]).nonlocals["vocabulary"].value) == {"machine"}


def test_words_in_use_stay_known_while_others_are_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_WORDS", 20)
    small = bpe.Automaton({"a": 0, "b": 1, "aa": 2}, [("a", "a")], {})
    made, real = [], small.word
    monkeypatch.setattr(small, "word", lambda word: made.append(word) or real(word))
    rare = [f"{k:b}".replace("0", "a").replace("1", "b") for k in range(256, 456)]
    for word in rare:
        ids = small.encode(f"{word} ab", str.split)
        assert small.decode(ids) == word + "ab"
        assert len(small._words) + len(small._words_before) <= 2 * (20 + 1)
    assert made.count(b"ab") == 1 and len(made) == 1 + len(rare)


def test_arcs_are_worked_out_again_after_the_table_was_emptied(automaton, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_ARCS", 5)
    for text in ("eresheonwhtish laenaique", "itatonon thndonenblehe", "eresheonwhtish x"):
        for word in regex.compile(bpe.WORD_PATTERN).findall(text):
            assert automaton.word(word.encode()) == library.encode(word, add_special_tokens=False).ids
