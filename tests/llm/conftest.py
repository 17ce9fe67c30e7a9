import random

import pytest

CLASHING = ("id", "h", "row", "node", "component", "_hit", "_at", "block", "found", "base")
WORDS = "the of and to in a is that it for was with river stone cloud maple under seven quiet lantern harbor".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Ids and texts: null, empty, blank, tiny, accented, repeated, near copies, one very long word, a very long text."""
    near = prose(1, 300).split()
    near[7] = "changed"
    long_text = "\n".join(prose(k, 40) for k in range(400))
    texts = [
        None, "", " \t\n", "one", "two words", prose(1, 300), prose(1, 300), " ".join(near), prose(2, 120),
        "Élan vital à l'été " * 30, "x" * 60_000, long_text, long_text, "a\n" * 500, "9" * 3_000,
        "İstanbul K ſ \U0001f600 " + prose(3, 20),
    ]
    return list(enumerate(texts))


@pytest.fixture
def frame(spark):
    """Documents with columns named like the operators' own, in a few partitions."""

    def make(rows, lang="en"):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        data = [(i, t, lang, "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(data, schema).repartition(3)
        from pyspark.sql import functions as F

        return df.withColumns({c: F.lit(f"extra {c}") for c in CLASHING})

    return make


@pytest.fixture
def awkward(frame, awkward_rows):
    return frame(awkward_rows)


@pytest.fixture
def nothing(frame, awkward_rows):
    return frame(awkward_rows[:1]).where("false")
