"""Owner addbacks: token search, rule lists, rule tables."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import replace
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bind, flag, keys, named, on_or_after, strip, text
from ..session import broadcast_if_small, cut
from ..sources.rules import (
    DEFAULT_TOLERANCE,
    PAYROLL_RULE_NAME,
    PAYROLL_START,
    RULE_SCHEMA,
    AddbackRule,
    as_rules,
    rules_table,
)

# Words that mark a transaction as an owner addback.
BASE_TOKENS = ("xnp", "ng", "nathan", "owner", "personal")

# Rules of a list that are written out as code; a longer list is looked up as a table, with the same results.
COMPILED = 30

RuleLike = AddbackRule | Mapping
_SEARCHED = ("account", "name", "memo")


def detect_addbacks(
    df: DataFrame,
    custom_tokens: Iterable[str] | None = None,
    rules: Iterable[RuleLike] | None = None,
    *,
    payroll_start: dt.date = PAYROLL_START,
) -> DataFrame:
    """Flag rows whose name or memo holds one of the tokens as a whole word, then apply the rules.

    A token is looked up by its longest word: the words of a row that begin like one of these are cut out
    and looked up in a hashed table, however many tokens there are. Tokens found there are compared as a
    whole if they have more than that word. Reasons go by the order of the tokens. Tokens without a plain word
    are searched as patterns.
    """
    tokens = [t for t in (*BASE_TOKENS, *(t.lower() for t in custom_tokens or ())) if t]
    haystack = F.col("_haystack")
    keyed = [(i, t, _key_word(t)) for i, t in enumerate(tokens)]
    wanted = sorted({word for _, _, word in keyed if word})
    begin = _classes([w[: min(map(len, wanted))][:PIECE] for w in wanted])
    cut_out = F.array_distinct(F.regexp_extract_all(haystack, F.lit(rf"(?U)\b{begin}\w*"), F.lit(0)))

    def entry(place: int, token: str, word: str | None) -> Column:
        whole = F.lit(None if word == token else _whole_word(token)).cast("string")
        return F.struct(F.lit(place).alias("place"), F.lit(token).alias("token"), F.lit(word).cast("string").alias("word"), whole.alias("whole"))

    buckets: list[list[Column]] = [[] for _ in wanted]
    for place, token, word in keyed:
        if word:
            buckets[crc32(word.encode()) % len(wanted)].append(entry(place, token, word))
    none = F.array().cast("array<struct<place: int, token: string, word: string, whole: string>>")
    table = F.array(*[F.array(*b) if b else none for b in buckets])

    def said(word: Column) -> Column:
        bucket = F.get(table, (F.crc32(word) % len(wanted)).cast("int"))
        return F.filter(bucket, lambda t: (t["word"] == word) & (t["whole"].isNull() | F.rlike(haystack, t["whole"])))

    found = F.flatten(F.transform(cut_out, said))
    for place, token, word in keyed:
        if word is None:
            found = F.concat(found, F.when(haystack.rlike(_whole_word(token)), F.array(entry(place, token, word))).otherwise(none))
    names = F.transform(F.array_sort(F.col("_tokens")), lambda t: F.concat(F.lit("token="), t["token"]))
    out = (
        df.withColumn(
            "_haystack", F.lower(F.concat(text(df, "name"), F.lit("\n"), text(df, "memo")))
        )
        .withColumn("_tokens", found)
        .withColumn("sde_addback_flag", F.size("_tokens") > 0)
        .withColumn("sde_addback_reason", F.when(F.col("sde_addback_flag"), F.array_join(names, ", ")).otherwise(""))
        .drop("_haystack", "_tokens")
    )
    out = out.select(*_kept(df))
    return apply_addback_rules(out, rules, payroll_start=payroll_start)


def _key_word(token: str) -> str | None:
    """The token's longest word, if it is plain; it stands in a text as a whole word wherever the token does."""
    return max(re.findall(r"\w+", token), key=len, default=None) if token.isascii() else None


def _whole_word(token: str) -> str:
    return rf"(?U)\b{re.escape(token)}\b"


def apply_addback_rules(
    df: DataFrame,
    rules: Iterable[RuleLike] | None = None,
    *,
    payroll_start: dt.date = PAYROLL_START,
    regex: bool = False,
) -> DataFrame:
    """Flag rows by a list of rules, given as rule objects or JSON objects.

    A short list is compiled into one projection, which is the fastest by far for a few rules; a long one is
    looked up as a table, with the same results. Needles are literal text unless ``regex`` is set; a malformed
    pattern or rule is an error, and so is a dated rule where ``date`` is missing or text.
    """
    parsed = as_rules(rules)
    if not parsed:
        return df
    starts = [start for r in parsed if (start := _start(r, payroll_start)) is not None]
    for start in starts[:1]:
        on_or_after(df, "date", start)  # dated rules need a date column, however many rules there are
    if len(parsed) > COMPILED and not regex:
        dated = [replace(r, start_date=_start(r, payroll_start)) for r in parsed]
        return apply_rule_table(df, rules_table(df.sparkSession, dated))
    hits = [(rule.name, _matches(df, rule, payroll_start, regex)) for rule in parsed]
    named = {f"_rule{i}": hit for i, (_, hit) in enumerate(hits)}
    reasons = [
        F.when(F.col(column), F.lit(f"rule={name}")) for column, (name, _) in zip(named, hits)
    ]
    flagged = flag(df, "sde_addback_flag")
    for column in named:
        flagged = flagged | F.col(column)
    return (
        df.withColumns(named)
        .withColumns(
            {
                "sde_addback_flag": flagged,
                "sde_addback_reason": F.concat_ws(", ", _earlier_reason(df), *reasons),
            }
        )
        .drop(*named)
    )


apply_rules_to_df = apply_addback_rules


def _earlier_reason(df: DataFrame) -> Column:
    return F.nullif(text(df, "sde_addback_reason"), F.lit(""))


def _magnitude(df: DataFrame) -> Column:
    if "amount" not in df.columns:
        return F.lit(0.0)
    return F.abs(F.coalesce(F.col("amount").try_cast("double"), F.lit(0.0)))


def _start(rule: AddbackRule, payroll_start: dt.date) -> dt.date | None:
    return rule.start_date or (payroll_start if rule.name == PAYROLL_RULE_NAME else None)


def _matches(df: DataFrame, rule: AddbackRule, payroll_start: dt.date, regex: bool) -> Column:
    hit = F.lit(True)
    for column in _SEARCHED:
        lowered = F.lower(text(df, column))
        for needle in getattr(rule, f"{column}_contains") or ():
            wanted = needle.strip().lower()
            if regex:
                re.compile(wanted)
                hit = hit & lowered.rlike("(?U)" + wanted)
            else:
                hit = hit & lowered.contains(wanted)
    start = _start(rule, payroll_start)
    if start is not None:
        hit = hit & on_or_after(df, "date", start)
    if rule.amount is not None:
        tolerance = DEFAULT_TOLERANCE if rule.amount_tolerance is None else rule.amount_tolerance
        hit = hit & (F.abs(_magnitude(df) - F.lit(abs(rule.amount))) <= F.lit(tolerance))
    return F.coalesce(hit, F.lit(False))


def apply_rule_table(
    df: DataFrame, rules: DataFrame, by: str | Sequence[str] = (), order: str = "pos"
) -> DataFrame:
    """Flag rows by a table of rules, each applying to the rows of its own ``by`` keys.

    A row only meets rules that can hold. Rules with an amount are found by amount tiles, of a width that
    goes with the rule's tolerance: a row looks up one tile for each width in use. Rules without one are
    found by the piece of up to four characters, of all their needles, that the fewest rules share; a row
    looks up the pieces of its texts. Only what is found is tested in full. Rows are neither multiplied nor
    regrouped, so a key or an amount that holds most of them costs nothing extra.

    Of a table of more than ``HELD`` rules nothing is gathered: pieces are longer, the pieces of the distinct
    texts are joined to those of the rules, and rows to what was found for their texts.
    """
    by = keys(by)
    if "name" not in rules.columns:
        raise ValueError("a rule table needs a 'name' column")
    ready, rows = _prepared(rules, by, order)
    kinds = ready.select("_width", "_column").distinct().collect()  # a few: widths are whole powers of two
    widths = sorted({r["_width"] for r in kinds if r["_width"] is not None})
    used = [c for c in _SEARCHED if any(r["_column"] == c for r in kinds)]
    always = any(r["_width"] is None and r["_column"] is None for r in kinds)

    size = _magnitude(df)
    joined, found = df, []
    for k, width in enumerate(widths):
        wide = F.lit(2.0**width)
        amount, off = F.col("_rule.amount"), F.col("_rule.amount_tolerance")
        slack = (F.abs(amount) + off) * F.lit(1e-12) + F.lit(1e-12)  # the difference below is rounded, too
        first, last = F.floor((amount - off - slack) / wide), F.floor((amount + off + slack) / wide)
        tiles = ready.where((F.col("_width") == width) & (F.col("_rule.amount_tolerance") >= 0))
        tiles = tiles.select(*by, F.explode(F.sequence(first, F.greatest(first, last))).alias("_tile"), "_rule")
        tiles = tiles.groupBy(*by, "_tile").agg(F.collect_list("_rule").alias(f"_tile{k}"))
        joined = joined.withColumn("_tile", F.floor(size / wide))
        joined = joined.join(broadcast_if_small(tiles, 3 * rows), [*by, "_tile"], "left").drop("_tile")
        found.append(F.col(f"_tile{k}"))
    if rows > HELD:
        for c in used:
            texts = df.select(*by, F.lower(text(df, c)).alias("_text"))
            joined = joined.withColumn("_text", F.lower(text(df, c)))
            joined = joined.join(_of_texts(texts, ready, by, c), [*by, "_text"], "left").drop("_text")
            found.append(F.col(f"_said_{c}"))
        if always:
            rest = ready.where("_width IS NULL AND _column IS NULL").groupBy(*by).agg(F.collect_list("_rule").alias("_always"))
            joined = joined.join(broadcast_if_small(rest, rows), by, "left") if by else joined.crossJoin(rest)
            found.append(F.col("_always"))
    elif used or always:
        seen = ready.where("_piece IS NOT NULL").select("_column", "_piece").distinct().collect()  # at most HELD
        pieces = {c: sorted({r["_piece"] for r in seen if r["_column"] == c}) for c in _SEARCHED}
        index = _hashed(ready.where("_width IS NULL"), by)
        both = F.struct("_buckets", "_always")
        if by:
            joined = joined.join(broadcast_if_small(index, rows), by, "left")
            table = F.when(F.col("_buckets").isNotNull(), both)
        else:
            # A constant, folded once: as a column every row would carry a copy of all rules.
            (said,) = index.select(F.to_json(both)).collect() or [[None]]
            table = F.from_json(F.lit(said[0]), index.select(both.alias("_table")).schema["_table"].dataType)

        def from_texts(table: Column) -> Column:
            own = [_of_pieces(F.lower(text(df, c)), c, pieces[c], table["_buckets"]) for c in used]
            return F.concat(table["_always"], *own)

        found.append(bind(table, from_texts))

    row = F.struct(
        *[F.lower(text(df, c)).alias(c) for c in _SEARCHED],
        size.alias("size"),
        (F.col("date") if "date" in df.columns else F.lit(None).cast("date")).alias("date"),
    )

    def holds(row: Column, rule: Column) -> Column:
        """Cheap tests first: the others are only made where those hold."""
        hit = rule["amount"].isNull() | (F.abs(row["size"] - rule["amount"]) <= rule["amount_tolerance"])
        hit = hit & (rule["start_date"].isNull() | (row["date"] >= rule["start_date"]))
        for column in _SEARCHED:
            wanted = rule[f"{column}_contains"]
            hit = hit & (wanted.isNull() | F.forall(wanted, row[column].contains))
        return F.coalesce(hit, F.lit(False))

    empty = F.array().cast(ready.select(F.array("_rule").alias("_rules")).schema["_rules"].dataType)
    candidates = F.concat(*[F.coalesce(part, empty) for part in found]) if found else empty
    hits = F.when(
        F.size(F.col("_found")) > 0,
        F.array_sort(bind(row, lambda row: F.filter(F.col("_found"), lambda rule: holds(row, rule)))),
    )
    named_hits = F.transform(F.col("_hits"), lambda r: F.concat(F.lit("rule="), r["name"]))
    return (
        joined.withColumn("_found", candidates)
        .withColumn("_hits", F.coalesce(hits, empty))
        .withColumns(
            {
                "sde_addback_flag": flag(df, "sde_addback_flag") | (F.size("_hits") > 0),
                "sde_addback_reason": F.concat_ws(
                    ", ", _earlier_reason(df), F.nullif(F.array_join(named_hits, ", "), F.lit(""))
                ),
            }
        )
        .select(*_kept(df))
    )


PIECE = 4  # characters of a needle that rules are looked up by
LONG_PIECE = 8  # the same for a table of more than HELD rules
HELD = 1_000  # rules that the plan or a row may hold
CLASS = 1_000  # characters that a place in a pattern may list

def _classes(texts: Sequence[str]) -> str:
    """A pattern of one class of characters for each place in texts of one length."""
    return _classes_of(sorted(set(place)) for place in zip(*texts))


def _classes_of(places: Iterable[Iterable[str]]) -> str:
    return "".join("[" + "".join(f"\\x{{{ord(c):x}}}" for c in place) + "]" for place in places)


def _pieces(lowered: Column, wanted: Sequence[str]) -> Column:
    """Runs of characters of the text, as long as wanted pieces and of the same characters at each place."""
    runs = []
    for length in sorted({len(p) for p in wanted}):
        pattern = _classes([p for p in wanted if len(p) == length])
        runs.append(F.regexp_extract_all(lowered, F.lit(f"(?=({pattern}))"), F.lit(1)))
    return F.concat(*runs)


def _of_texts(texts: DataFrame, rules: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """For each distinct text of the column the rules that it holds a piece and all of that column's needles of.

    Neither rules nor their pieces are gathered, only the characters that pieces have at each place.
    """
    own = rules.where(F.col("_column") == column).select(*by, "_piece", "_rule")
    letters = F.transform(F.sequence(F.lit(1), F.length("_piece")), lambda i: F.substring("_piece", i, F.lit(1)))
    spelled = own.select(F.length("_piece").alias("_length"), F.posexplode(letters).alias("_place", "_letter"))
    listed = spelled.groupBy("_length", "_place").agg(F.collect_set("_letter").alias("_letters"))
    listed = listed.withColumn("_letters", F.when(F.size("_letters") <= CLASS, F.array_sort("_letters")))
    patterns: dict[int, str] = {}
    for length, _, some in sorted(listed.collect(), key=lambda r: (r["_length"], r["_place"])):
        patterns[length] = patterns.get(length, "") + (r"[\s\S]" if some is None else _classes_of([some]))
    runs = [F.regexp_extract_all("_text", F.lit(f"(?=({p}))"), F.lit(1)) for p in patterns.values()]
    each = texts.distinct().select(*by, "_text", F.explode(F.array_distinct(F.concat(*runs))).alias("_piece"))
    fit = F.forall(f"_rule.{column}_contains", lambda needle: F.contains("_text", needle))
    return each.join(own, [*by, "_piece"]).where(fit).groupBy(*by, "_text").agg(F.collect_list("_rule").alias(f"_said_{column}"))


def _hashed(rules: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each key a hash table of its pieces, and the rules without a piece.

    ``_buckets`` has as many places as there are pieces; in each are the pieces whose checksum leads there.
    """
    held = rules.where("_piece IS NOT NULL").groupBy(*by, "_column", "_piece").agg(F.collect_list("_rule").alias("_rules"))
    sizes = rules.groupBy(*by).agg(
        F.countDistinct("_column", "_piece").alias("_size"),
        F.collect_list(F.when(F.col("_piece").isNull(), F.col("_rule"))).alias("_always"),
    )
    places = sizes.select(*by, F.explode(F.sequence(F.lit(0), F.greatest("_size", F.lit(1)) - 1)).alias("_place"))
    held = held.join(sizes.select(*by, "_size"), by) if by else held.crossJoin(sizes.select("_size"))
    held = held.select(*by, (F.crc32("_piece") % F.col("_size")).alias("_place"), F.struct("_column", "_piece", "_rules").alias("_entry"))
    buckets = places.join(held, [*by, "_place"], "left").groupBy(*by, "_place").agg(F.collect_list("_entry").alias("_entries"))
    ordered = F.array_sort(F.collect_list(F.struct("_place", "_entries")))
    table = buckets.groupBy(*by).agg(F.transform(ordered, lambda b: b["_entries"]).alias("_buckets"))
    always = sizes.select(*by, "_always")
    return table.join(always, by) if by else table.crossJoin(always)


def _of_pieces(lowered: Column, column: str, wanted: Sequence[str], buckets: Column) -> Column:
    """The rules that are looked up by a piece that the text holds."""
    own = F.array_distinct(F.filter(_pieces(lowered, wanted), lambda piece: piece.isin(wanted)))

    def rules(piece: Column) -> Column:
        bucket = F.get(buckets, (F.crc32(piece) % F.size(buckets)).cast("int"))
        fit = F.filter(bucket, lambda e: (e["_column"] == column) & (e["_piece"] == piece))
        return F.flatten(F.transform(fit, lambda e: e["_rules"]))

    return F.flatten(F.filter(F.transform(own, rules), lambda found: found.isNotNull()))


def _prepared(rules: DataFrame, by: Sequence[str], order: str) -> tuple[DataFrame, int]:
    """Rules as records, stored, with what they are looked up by: a tile width, or else a column and a piece;
    and how many they are.

    Everything about a rule that does not depend on the row is settled here, once per rule.
    """
    absent = [f for f in RULE_SCHEMA.fields if f.name not in rules.columns]
    full = rules.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else rules
    ready = {
        **{f"{c}_contains": F.transform(f"{c}_contains", _needle) for c in _SEARCHED},
        "amount": F.abs("amount"),
        "amount_tolerance": F.coalesce(F.col("amount_tolerance"), F.lit(DEFAULT_TOLERANCE)),
    }
    record = F.struct(
        F.col(order).alias("pos"),
        *[ready.get(f.name, F.col(f.name)).alias(f.name) for f in RULE_SCHEMA.fields],
    )
    rule = cut(full.select(*by, record.alias("_rule")))
    rows = rule.count()
    piece = LONG_PIECE if rows > HELD else PIECE
    width = F.greatest(F.ceil(F.log2(2 * F.col("_rule.amount_tolerance"))).cast("int"), F.lit(-6))
    runs = lambda c: F.flatten(
        F.transform(
            F.filter(F.coalesce(f"_rule.{c}_contains", F.array().cast("array<string>")), lambda n: F.length(n) > 0),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(n) - piece + 1, F.lit(1))),
                lambda i: F.struct(F.lit(c).alias("_column"), F.substring(n, i, F.lit(piece)).alias("_piece")),
            ),
        )
    )
    places = F.when(F.col("_rule.amount").isNull(), F.concat(*[runs(c) for c in _SEARCHED]))
    rule = cut(rule.withColumns({"_width": F.when(F.col("_rule.amount").isNotNull(), width), "_places": places}))
    rule = rule.withColumn("_id", F.monotonically_increasing_id())
    each = rule.select("_id", F.explode(F.array_distinct("_places")).alias("_place")).select("_id", "_place.*")
    shared = each.groupBy("_column", "_piece").agg(F.count(F.lit(1)).alias("_rules"))
    rarest = F.min(F.struct("_rules", -F.length("_piece"), "_column", "_piece")).alias("_best")
    chosen = each.join(shared, ["_column", "_piece"]).groupBy("_id").agg(rarest)
    ready = rule.join(chosen, "_id", "left").select(
        *by, "_rule", "_width", F.col("_best._column").alias("_column"), F.col("_best._piece").alias("_piece")
    )
    return cut(ready), rows


def _needle(text: Column) -> Column:
    return strip(F.lower(text))


def _kept(df: DataFrame) -> list[Column]:
    added = [c for c in ("sde_addback_flag", "sde_addback_reason") if c not in df.columns]
    return [named(c) for c in (*df.columns, *added)]
