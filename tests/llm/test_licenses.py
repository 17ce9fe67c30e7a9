import re

from ledgerlake.llm import licenses as L

from .conftest import prose

WORD = re.compile(L.LICENSE_WORD)
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def base(text):
    words, at = WORD.findall((text or "").translate(LOW)), []
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    places = [i for i, _ in at]
    return (len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))


def scanned(df):
    return {r["doc_id"]: r for r in L.scan(df).collect()}


def test_base_places_and_spans(frame, awkward_rows):
    mit = L.TEMPLATES["mit"]
    cut = " ".join(mit.split()[:12] + mit.split()[14:])  # two words dropped: the next diagonal
    texts = [
        f"{prose(1, 50)}\nAll Rights Reserved. CC-BY cc by {prose(2, 30)}",
        f"{prose(3, 20)} {mit} {prose(4, 20)}",
        f"{prose(3, 20)} {cut} {prose(4, 20)}",
        "general public general public license",
        "Permission is hereby granted " + prose(6, 50),
    ]
    rows = awkward_rows + list(enumerate(texts, 100))
    got = scanned(frame(rows))
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert {i: tuple(r[n] for n in names) for i, r in got.items()} == {i: base(t) for i, t in rows}
    assert got[101]["labels"] == "mit" and got[101]["score"] == 1.0
    assert got[102]["labels"] == "mit" and 0.8 < got[102]["score"] < 1.0
    assert got[104]["labels"] == "" and got[104]["score"] == 0.0
    assert got[100]["base_labels"] == "cc-by,reserved"


def test_spans_are_placed_once_however_often_rows_repeat(frame, nothing):
    text = f"{prose(3, 20)} {L.TEMPLATES['isc']} end"
    spans = L.find_spans(frame([(1, text), (1, text), (2, "x " + text)])).collect()
    assert sorted((r["_id"], r["label"], r["first"]) for r in spans) == [(1, "isc", 20), (2, "isc", 21)]
    assert L.scan(frame([(1, text), (1, text)])).count() == 2
    assert L.scan(nothing).count() == 0


def test_notices_that_stand_there_many_times_keep_their_labels(frame):
    rows = [(n, f"{prose(n, 9)} copyright {'all rights reserved ' * n}") for n in range(1, 11)]
    rows += [(100 + n, f"{prose(n, 9)} {'all rights reserved. ' * n}") for n in range(1, 11)]
    rows += [(200 + n, f"{(L.TEMPLATES['mit-notice'] + ' and ') * n} {prose(n, 9)}") for n in range(1, 11)]
    rows += [(300 + n, (L.TEMPLATES["isc"] + " ") * n) for n in range(1, 5)]
    got = {i: (r["labels"], r["score"]) for i, r in scanned(frame(rows)).items()}
    for n in range(1, 11):
        assert got[n] == ("reserved,reserved-notice", 1.0)
        assert got[100 + n] == ("reserved,reserved-notice", 0.75)
        assert got[200 + n] == ("mit-notice", 1.0)
    assert {got[300 + n] for n in range(1, 5)} == {("isc", 1.0)}
    spans = L.find_spans(frame([(1, "all rights reserved " * 6)])).where("label = 'reserved-notice'").collect()
    assert sorted((r["first"], r["end"]) for r in spans) == [(3 * i, 3 * i + 3) for i in range(6)]


def test_null_ids(frame):
    rows = L.scan(frame([(None, L.TEMPLATES["isc"]), (None, None), (None, "cc by")])).collect()
    assert sorted((r["labels"], r["n_base"]) for r in rows) == [("", 0), ("cc-by", 1), ("isc", 0)]
