import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def plain_best(signature):
    """Cheapest and least audit, by trying edits in the order of (cost, audit); grammar checked on the whole text."""
    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(signature) and GRAMMAR.fullmatch(roles):
            return cost, audit
        if not any(GRAMMAR.fullmatch(roles + more) for more in ("", "a", "ua")):
            continue
        for role in "ua":
            heapq.heappush(heap, (cost + 3, audit + "I", at, roles + role))
        if at < len(signature):
            letter = signature[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, roles))
            if letter != "x":
                more = 3 if letter.isupper() else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, roles + letter.lower()))
                for role in "ua":
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, roles + role))
    raise AssertionError


def test_audits_equal_trying_all_edits():
    rng = random.Random(1)
    short = ["".join(s) for n in range(4) for s in itertools.product("suaoUAx", repeat=n)]
    longer = ["".join(rng.choice("suaoSUAOx" + "ua" * 4) for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    automaton = repair.SuffixAutomaton()
    for signature in sorted(set(short + longer), key=lambda s: s[::-1]):
        assert automaton.audit(signature) == plain_best(signature), signature


def test_nodes_are_made_once_for_each_distinct_suffix():
    signatures = ["ua", "uaua", "suaua", "xuaua", "uaux", "aux", ""]
    automaton = repair.SuffixAutomaton()
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        automaton.audit(signature)
    assert automaton.made == len({s[i:] for s in signatures for i in range(len(s))})


def plain_result(rows, ids):
    """{conversation: (gaps, blank, duplicate, truncated, illegal, signature)} and the turns in order."""
    turns = defaultdict(list)
    for conversation, turn, role, text in rows:
        turns[conversation].append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    found = {}
    for conversation in set(ids):
        own, seen, letters = sorted(turns[conversation]), set(), ""
        count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            letter = role[0] if role and role[0] in "sua" else "o"
            letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        numbers = {n for known, n, _, _ in own if known}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        found[conversation] = (gaps, *count.values(), illegal, letters, [(r, t) for _, _, r, t in own])
    return found


def plain_edited(turns, audit):
    """The turns after the edits of an audit; roles that edits give follow from what is in front."""
    out, at = [], 0
    wanted = lambda: "assistant" if out and out[-1][0][0] == "u" else "user"
    for edit in audit:
        if edit == "I":
            out.append((wanted(), ""))
            continue
        if edit == "K":
            out.append(turns[at])
        elif edit == "R":
            out.append((wanted(), turns[at][1]))
        at += 1
    return out


def check(spark_rows, rows, ids):
    plans = repair.plan(repair.assess(spark_rows, ids=ids))
    got = {r["conv_id"]: r for r in repair.digests(spark_rows, plans).collect()}
    expected = plain_result(rows, [r["conv_id"] for r in ids.collect()])
    assert set(got) == set(expected)
    edited = defaultdict(dict)
    for r in repair.repaired(spark_rows, plans).collect():
        edited[r["conv_id"]][r["place"]] = (r["role"], r["text"])
    for conversation, (gaps, blank, duplicate, truncated, illegal, letters, turns) in expected.items():
        row = got[conversation]
        assert tuple(row[c] for c in repair.FIGURES) == (gaps, blank, duplicate, truncated, illegal), conversation
        if len(letters) < 12:
            assert (row["cost"], row["audit"]) == plain_best(letters)
        said = plain_edited(turns, row["audit"])
        assert GRAMMAR.fullmatch("".join(role[0] for role, _ in said))
        assert row["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        assert [edited[conversation][k] for k in sorted(edited[conversation])] == said and row["n_turns"] == len(said)
    return got


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["Yes.", "No!", "Why?  ", "cut off", " \t\n", "", None, "É…", "Yes. \n", "done.\x1f"]
    out = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in range(150) for _ in range(rng.randrange(1, 9))]
    out += [(None, t, "user", "a.") for t in (1, 2, 2, None)] + [(900, 3, "user", "same.")] * 5 + [(901, None, None, None)] * 2
    return out + [(902, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000) if t % 7]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_faults_edits_and_digests(spark, rows):
    clash = {c: F.lit(1) for c in ("kind", "seen", "fault", "audit", "cost", "initial", "signature", "place")}
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns(clash)
    ids = df.select("conv_id").union(spark.createDataFrame([(77_777,)], "conv_id long"))
    got = check(df, rows, ids)
    empty = got[77_777]
    assert empty["audit"] == "" and empty["cost"] == 0 and empty["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[902]["gaps"] == 3000 - 1 - sum(1 for t in range(1, 3000) if t % 7)


def test_damage(spark, rows):
    def fate(conversation, turn):
        return zlib.crc32(f"{' ' if conversation is None else conversation}:{' ' if turn is None else turn}".encode()) % 20

    expected = []
    for conversation, turn, role, text in rows:
        kind, role, text = fate(conversation, turn), " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        expected += [(conversation, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    key = lambda r: tuple((x is not None, x or 0) if i < 2 else x for i, x in enumerate(r))
    assert sorted((tuple(r) for r in repair.damaged(df).collect()), key=key) == sorted(expected, key=key)
    check(repair.damaged(df), expected, df.select("conv_id"))


def test_text_ids_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", 1, "assistant", "Yes")], "conv_id string, turn int, role string, text string")
    check(df, [tuple(r) for r in df.collect()], df.select("conv_id"))
    none = df.where("false")
    plans = repair.plan(repair.assess(none))
    assert repair.digests(none, plans).count() == 0 and repair.repaired(none, plans).count() == 0
