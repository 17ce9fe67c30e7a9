"""Personal data: plain patterns as seeds, and contexts learned from them.

**Seeds.** E-mail addresses, IP addresses, card and phone numbers, found by patterns whose matches are then
checked (parts up to 255, Luhn, digit counts); and, as further seeds, keys that only machines write.

**Bootstrapping.** A *mention* is a run of words with a digit or an at sign; its *pattern* is the two words before
it. Patterns and the mentions' texts (*instances*) make a graph, counted once for the whole corpus. In each round
a pattern is as good as the share of its instances that are known, if enough are; an instance is as good as its
patterns make it together. After the rounds, the patterns that are good and well supported mark the mentions that
no seed found. What they find is of kind ``id``.

All of it is DataFrame expressions. The graph holds mentions, not words, and is aggregated before it is shuffled;
a pattern or instance with very many edges is only ever summed or joined to one row.

Positions come from splitting a text at the matches: the pieces' lengths add up to them. Patterns are written so
that no match is tried from inside a run of the same characters, which keeps them linear on words of any length.

Defined results: null text is empty and has no spans; rows with the same id and different texts are told apart by
a hash of the text; equal rows get equal results; an empty table has no patterns and gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import among, let, packed, store

KINDS = ("email", "ip", "card", "phone")
# The seeds' patterns, with the same matches as their plain forms.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that a text without a match of the kind mostly fails.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# Runs of words with a digit or an at sign in each.
MENTION = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: [^\s0-9@]*+[0-9@]\S*+)*+"
# Keys of well-known shape.
MACHINE_KEY = r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,})$"
TRIMMED = r"^[\"'(\[{<]+|[\"')\]}>.,;:!?]+$"


@dataclass(frozen=True)
class Bootstrap:
    """Rounds, and what a pattern needs: distinct known instances, and their share among all of its instances."""

    rounds: int = 3
    support: int = 3
    share: float = 0.5
    final_support: int = 5
    final_share: float = 0.9
    least_digits: int = 4


def matches(text: Column, pattern: str) -> Column:
    """(start, end, match) of each match, in code points, end exclusive."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pieces: Column, hits: Column) -> Column:
        return F.aggregate(
            hits,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("found")),
            lambda a, hit: let(
                a["at"] + F.length(F.get(pieces, F.size(a["found"]))),
                lambda start: F.struct(
                    (start + F.length(hit)).alias("at"),
                    F.concat(
                        a["found"],
                        F.array(F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("match"))),
                    ).alias("found"),
                ),
            ),
            lambda a: a["found"],
        )

    return let(hits, lambda h: F.when(F.size(h) > 0, placed(F.split(text, pattern, -1), h)).otherwise(placed(F.array().cast("array<string>"), h)))


def _luhn(match: Column) -> Column:
    def total(digits: Column) -> Column:
        size = F.length(digits)
        each = F.transform(
            F.sequence(F.lit(1), size),
            lambda i: let(
                F.substring(digits, size - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
                lambda d: F.when(d > 9, d - 9).otherwise(d),
            ),
        )
        return F.aggregate(each, F.lit(0), lambda a, d: a + d)

    return let(
        F.regexp_replace(match, r"[\x20-]", ""),
        lambda digits: F.when(F.length(digits).between(13, 19), total(digits) % 10 == 0).otherwise(F.lit(False)),
    )


def _holds(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return _luhn(match)
    if kind == "phone":
        return F.length(F.regexp_replace(match, r"[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """(kind, start, end) of all seeds, by kind, then start."""
    found = []
    for kind in KINDS:
        spans = F.transform(
            F.filter(matches(text, PATTERNS[kind]), lambda m: _holds(kind, m["match"])),
            lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")),
        )
        none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
        found.append(F.when(text.rlike(HINTS[kind]), spans).otherwise(none))
    return F.concat(*found)


def mentions(texts: DataFrame) -> DataFrame:
    """Every mention: id, h, start, end, instance, pattern, seed (a base span touches it), key (a machine's)."""
    text = F.col("text")
    row = texts.where(text.rlike(r"[0-9@]")).select(
        "id", "h", text, base_spans(text).alias("base"), matches(text, MENTION).alias("found")
    )
    one = row.select("id", "h", "text", "base", F.explode("found").alias("m"))
    instance = F.regexp_replace(F.col("m.match"), TRIMMED, "")
    lead = F.length(F.regexp_extract("m.match", r"^[\"'(\[{<]*", 0))
    before = F.substring(text, F.greatest(F.col("m.start") - 200, F.lit(0)) + 1, F.least(F.col("m.start"), F.lit(200)))
    words = F.regexp_extract(F.lower(before), r"(?:(?:^|\s)(\S+)\s+)?(\S+)\s+$", 0)
    touched = F.exists("base", lambda s: (s["start"] < F.col("m.end")) & (s["end"] > F.col("m.start")))
    return one.select(
        "id",
        "h",
        (F.col("m.start") + lead).alias("start"),
        (F.col("m.start") + lead + F.length(instance)).alias("end"),
        instance.alias("instance"),
        F.trim(F.regexp_replace(F.regexp_replace(words, r"[0-9]", "0"), r"\s+", " ")).alias("pattern"),
        touched.alias("seed"),
        instance.rlike(MACHINE_KEY).alias("key"),
    ).where("instance != ''")


def score_patterns(found: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """(pattern, known, share) after all rounds, from the graph of patterns and instances."""
    edges = store(
        found.where("pattern != ''").groupBy("pattern", "instance").agg(F.max(F.col("seed") | F.col("key")).alias("known"))
    )
    seeds = edges.groupBy("instance").agg(F.max(F.col("known").cast("double")).alias("seed"))
    scores = seeds.withColumnRenamed("seed", "score")

    def rated(scores: DataFrame) -> DataFrame:
        each = edges.select("pattern", "instance").join(scores, "instance")
        return each.groupBy("pattern").agg(F.sum("score").alias("known"), F.avg("score").alias("share"))

    for _ in range(settings.rounds):
        good = rated(scores).where((F.col("known") >= settings.support) & (F.col("share") >= settings.share))
        doubt = F.sum(F.log(F.greatest(F.lit(1.0) - F.col("share"), F.lit(1e-6))))
        voted = edges.select("pattern", "instance").join(good, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("vote"))
        scores = store(
            seeds.join(voted, "instance", "left").select(
                "instance", F.greatest("seed", F.coalesce("vote", F.lit(0.0))).alias("score")
            )
        )
    return rated(scores)


def discovered(found: DataFrame, settings: Bootstrap = Bootstrap()) -> DataFrame:
    """Spans (id, h, start, end) that seeds did not find: machine keys, and mentions after good patterns."""
    good = score_patterns(found, settings).where(
        (F.col("known") >= settings.final_support) & (F.col("share") >= settings.final_share)
    )
    digits = F.length(F.regexp_replace("instance", r"[^0-9]", ""))
    shaped = (digits >= settings.least_digits) | F.col("instance").contains("@")
    fresh = found.where(~F.col("seed"))
    after = fresh.where(~F.col("key") & shaped).join(good.select("pattern"), "pattern", "left_semi")
    columns = ["id", "h", "start", "end"]
    return fresh.where("key").select(*columns).unionByName(after.select(*columns))


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    content = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(content).alias("h"), content.alias("text"))


def _extra(texts: DataFrame, settings: Bootstrap) -> DataFrame:
    """For each row with any, its discovered spans, in order."""
    spans = discovered(store(mentions(texts)), settings)
    span = F.struct(F.lit("id").alias("kind"), "start", "end")
    return spans.groupBy(F.col("id").alias("_i"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_set(span)).alias("extra"))


def _with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    joined = rows.join(extra, F.col("id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h")), "left")
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return joined.withColumn("extra", F.coalesce("extra", none)).drop("_i", "_h")


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", settings: Bootstrap = Bootstrap()) -> DataFrame:
    """For each row: ``id``, ``base`` and ``extra`` spans as arrays of (kind, start, end)."""
    texts = _texts(docs, id, text)
    rows = texts.select("id", "h", base_spans(F.col("text")).alias("base"))
    return _with_extra(rows, _extra(texts, settings)).select(F.col("id").alias(id), "base", "extra")


def span_list(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _masked(text: Column, spans: Column) -> Column:
    """The text with a mark for each span; a span that begins inside an earlier one is covered by it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("end"), s["kind"])))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        ordered,
        state,
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(
                (-s["end"]).alias("at"),
                F.concat(
                    a["out"],
                    F.substring(text, a["at"] + 1, s["start"] - a["at"]),
                    F.lit("<"),
                    F.upper(s["kind"]),
                    F.lit(">"),
                ).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], -s["end"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", settings: Bootstrap = Bootstrap()) -> DataFrame:
    """The documents with all spans replaced by their kind; other columns stay as they are."""
    extra = store(_extra(_texts(docs, id, text), settings)).toDF("id", "h", "extra")
    content = F.coalesce(docs[text], F.lit(""))
    rows = among(packed(docs, id=docs[id].cast("long"), h=F.xxhash64(content)), extra, ["id", "h"])
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    plain = rows.where("NOT _hit").select("row", none.alias("extra"))
    hit = rows.where("_hit")
    found = extra.toDF("_i", "_h", "extra")
    more = hit.join(found, hit["id"].eqNullSafe(F.col("_i")) & (hit["h"] == F.col("_h")), "left")
    both = plain.unionByName(more.select("row", F.coalesce("extra", none).alias("extra")))
    own = F.col("row").getField(text)
    spans = F.concat(base_spans(F.coalesce(own, F.lit(""))), F.col("extra"))
    masked = let(spans, lambda s: F.when(F.size(s) > 0, _masked(own, s)).otherwise(own))
    return both.select(*[(masked if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
