import random
import re

from ledgerlake.llm import pii

from .conftest import prose

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    text = text or ""
    found = [("email", m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.span()))
    found += [("phone", m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return [(kind, a, b) for kind, (a, b) in found]


def test_base_spans_of_tricky_texts(frame, awkward_rows):
    rng = random.Random(3)
    texts = [
        "a@b.com_x@c.de é 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 4111 1111 1111 1111 +1 (386) 555-2485.",
        "a@b..c x@y.z. @@a@b.c.d-e", "1." * 2000 + "1", "a" * 20_000 + "@", "+1" + " " * 3000 + "2",
    ]
    texts += ["".join(rng.choice("ab@.1234 +-()é_%") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["".join(rng.choice("0123456789 -.") for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = awkward_rows + list(enumerate(texts, 100))
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] for r in pii.find(frame(rows)).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_contexts_of_seeds_find_unseen_identifiers(frame):
    rows = [(i, f"{prose(i, 12)} please ring +1 (386) 555-{2000 + i} today") for i in range(12)]
    rows += [(50, f"please ring 555-0199-77 today {prose(50, 5)}"), (51, "some other 555-0199-77 here"), (52, "please ring 7 today")]
    found = {r["doc_id"]: r["extra"] for r in pii.find(frame(rows)).collect()}
    assert [(s["kind"], rows[12][1][s["start"] : s["end"]]) for s in found[50]] == [("id", "555-0199-77")]
    assert not found[51] and not found[52] and not any(found[i] for i in range(12))


def test_redaction_keeps_columns_and_rows(frame, awkward, nothing):
    docs = frame([(1, "mail é a@b.com, ip 1.2.3.4 and +1 (386) 555-2485"), (2, None), (3, "plain")])
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "mail é <EMAIL>, ip <IP> and <PHONE>", 2: None, 3: "plain"}
    assert pii.redact(awkward).columns == awkward.columns
    assert pii.redact(nothing).count() == 0 and pii.find(nothing).count() == 0
