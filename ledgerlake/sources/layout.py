"""Reading delimited exports whose header, width and encoding are only known from the file.

The header is looked for in a bounded peek at the top of each file: on the driver for a few files,
in one job for many. Everything else - parsing, width check, decoding - runs in the executors.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import BROADCAST_ROWS, broadcast_if_small, cut

HEADER_SEARCH_ROWS = 30
PEEK_LINES = 200
_PEEK_THREADS = 16
_FEW_FILES = 256

# Cell texts that count as missing.
NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Windows-1252 characters for the bytes that ISO-8859-1 reads as control codes.
_CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
_CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

FILE, BLOCK, LINE = "_file", "_block", "_line"
# The text of a record with too many cells, where such records are kept.
WIDE = "_wide"


@dataclass(frozen=True)
class Layout:
    """Header cells of a file, and how the rows down to the header are got rid of."""

    header: tuple[str, ...]
    header_on_top: bool
    skip_rows: int = 0


def snake(name: str | None) -> str:
    return str(name if name is not None else "").strip().lower().replace(" ", "_")


def usable_names(names: Sequence[str | None]) -> list[tuple[int, str]]:
    """Position and clean name of each column worth keeping: named, and first of its name."""
    kept: dict[str, int] = {}
    for position, raw in enumerate(names):
        name = snake(raw)
        if name and name != "nan" and not name.startswith("unnamed"):
            kept.setdefault(name, position)
    return [(position, name) for name, position in kept.items()]


def select_positions(df: DataFrame, picks: Iterable[tuple[int, str]]) -> DataFrame:
    """Pick columns by position, so that duplicate or oddly spelled names are no obstacle."""
    anonymous = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return anonymous.select(*[F.col(f"_c{i}").alias(name) for i, name in picks])


def snake_columns(df: DataFrame) -> DataFrame:
    """Snake-case names; the first column of each name is kept."""
    first: dict[str, int] = {}
    for position, name in enumerate(df.columns):
        first.setdefault(snake(name), position)
    return select_positions(df, [(position, name) for name, position in first.items() if name])


def normalize_ledger_columns(df: DataFrame) -> DataFrame:
    """Snake-case names; drop unnamed columns and repeats of a name."""
    return select_positions(df, usable_names(df.columns))


def first_present(names: Sequence[str], candidates: Iterable[str]) -> str | None:
    return next((c for c in candidates if c in names), None)


def _finder(header_words: Sequence[str]) -> Callable:
    """The function that reads a layout off the top lines. Self-contained, as it also runs in tasks."""
    wanted, most_rows = set(header_words), HEADER_SEARCH_ROWS

    def find(lines, whole):
        """Header cells, whether they are on top, and rows to remove by their place in the file.

        No header cells if the lines, not being the whole file, are too few to tell.
        """
        import csv
        import io

        csv.field_size_limit(2**31 - 1)
        raw = b"\n".join(lines)
        content = None
        for encoding in ("utf-8-sig", "cp1252", "latin-1"):
            try:
                content = raw.decode(encoding)
                break
            except UnicodeDecodeError:
                continue
        parsed = csv.reader(io.StringIO(content))
        rows = [row for row in parsed if len(row) > 1 or any(c.strip() for c in row)][:most_rows]
        hits = (i for i, row in enumerate(rows) if wanted and wanted <= {c.strip().lower() for c in row})
        at = next(hits, None)
        if at is None:
            if not whole and len(rows) < (most_rows if wanted else 2):
                return None, False, 0
            at = 0
        if not rows:
            return [], True, 0
        # Rows above the header normally have no date and fall to the date filter later. Only a row
        # that shows something in the date column has to be removed by its place in the file.
        dated = [i for i, cell in enumerate(rows[at]) if "date" in cell.lower()]
        risky = any(i < len(row) and row[i].strip() for row in rows[:at] for i in dated)
        return rows[at], at == 0, at + 1 if risky else 0

    return find


def discover_layout(
    spark: SparkSession, path: str, header_words: Sequence[str] = (), lines: int = PEEK_LINES
) -> Layout:
    """Find the first row that holds all ``header_words`` as whole cells; else the top row.

    Looks at a number of lines, and at more where cells with line breaks fill those up.
    """
    while True:
        top = spark.read.text(path).select(F.col("value").cast("binary")).limit(lines)
        seen = [bytes(row.value) for row in top.collect()]
        header, on_top, skip = _finder(header_words)(seen, len(seen) < lines)
        if header is not None:
            return Layout(tuple(header), on_top, skip)
        lines *= 8


def discover_layouts(
    spark: SparkSession, files: Sequence[str], header_words: Sequence[str] = ()
) -> dict[Layout, list[str]]:
    """The files of each layout. A few are peeked at one by one, many by one distributed job."""
    if len(files) <= _FEW_FILES:
        with ThreadPoolExecutor(_PEEK_THREADS) as pool:
            found = list(pool.map(lambda f: (f, discover_layout(spark, f, header_words)), files))
    else:
        found = _discover_in_tasks(spark, files, header_words)
    groups: dict[Layout, list[str]] = {}
    for file, layout in sorted(found, key=lambda f: f[0]):
        groups.setdefault(layout, []).append(file)
    return groups


def _discover_in_tasks(
    spark: SparkSession, files: Sequence[str], header_words: Sequence[str]
) -> list[tuple[str, Layout]]:
    """One row per file comes back to the driver, as in the file listing it already keeps."""
    find, most_lines = _finder(header_words), PEEK_LINES

    def run(batches):
        import pandas as pd

        tops: dict = {}
        for batch in batches:
            for (file, whole), values in batch.groupby(["file", "whole"], sort=False)["value"]:
                lines, _ = tops.setdefault(file, ([], whole))
                lines.extend(values.iloc[: most_lines - len(lines)])
        # Few lines are all there are only if the split holds the whole file.
        rows = [(file, *find(lines, whole and len(lines) < most_lines)) for file, (lines, whole) in tops.items()]
        yield pd.DataFrame(rows, columns=["file", "header", "on_top", "skip"])

    first_splits = (
        spark.read.text(list(files))
        .where(F.col("_metadata.file_block_start") == 0)
        .select(
            F.col("value").cast("binary").alias("value"),
            F.col("_metadata.file_path").alias("file"),
            (F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")).alias("whole"),
        )
    )
    schema = "file string, header array<string>, on_top boolean, skip int"
    found = []
    for row in first_splits.mapInPandas(run, schema).collect():
        path = _as_path(row.file)
        if row.header is None:
            layout = discover_layout(spark, path, header_words, PEEK_LINES * 8)
        else:
            layout = Layout(tuple(row.header), row.on_top, row.skip)
        found.append((path, layout))
    return found


def _as_path(uri: str) -> str:
    """A listed file's address as a path that can be read: unescaped, and not taken for a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _text_cell(column: Column) -> Column:
    """Repair the byte-wise read: UTF-8 where the bytes are valid UTF-8, else Windows-1252."""
    utf8 = F.try_validate_utf8(F.encode(column, "ISO-8859-1").cast("string"))
    decoded = F.when(F.length(column) == F.octet_length(column), column).otherwise(
        F.coalesce(utf8, F.translate(column, _CP1252_BYTES, _CP1252_CHARS))
    )
    return F.when(~decoded.isin(*NULL_MARKERS), decoded)


def _cells(record: Column) -> Column:
    """Number of cells in a raw record, commas inside quotes not counted.

    A doubled quote ends one quoted stretch and starts the next, which leaves nothing between them.
    """
    unquoted = F.regexp_replace(record, r'"[^"]*"', "")
    return F.length(unquoted) - F.length(F.translate(unquoted, ",", "")) + 1


def _read_group(
    spark: SparkSession,
    files: list[str],
    layout: Layout,
    names: list[tuple[int, str]],
    multiline: bool,
    wide: str,
) -> DataFrame:
    width = len(layout.header)
    fields = [T.StructField(f"_c{i}", T.StringType()) for i in range(width)]
    raw = (
        spark.read.schema(T.StructType([*fields, T.StructField("_misfit", T.StringType())]))
        .option("columnNameOfCorruptRecord", "_misfit")
        .option("mode", "PERMISSIVE")
        .option("header", layout.header_on_top)
        .option("encoding", "ISO-8859-1")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .csv(files)
        .select(
            "*",
            F.col("_metadata.file_path").alias(FILE),
            F.col("_metadata.file_block_start").alias(BLOCK),
            F.monotonically_increasing_id().alias(LINE),
        )
    )
    if layout.skip_rows:
        # One row per file, and never more files than may be broadcast: the rows keep their order.
        top = raw.where(F.col(BLOCK) == 0).groupBy(FILE).agg(F.min(LINE).alias("_top"))
        raw = raw.join(F.broadcast(top), FILE).where(
            (F.col(BLOCK) != 0) | (F.col(LINE) >= F.col("_top") + layout.skip_rows)
        )
    # A record with more cells than the header has columns cannot be trusted; shorter ones are padded.
    fits = F.col("_misfit").isNull() | (_cells(F.col("_misfit")) <= width)
    extra = []
    if wide == "mark":
        extra = [F.when(~fits, F.col("_misfit")).alias(WIDE)]
        fits = F.lit(True)
    elif wide == "error":
        fault = F.concat(F.lit(f"expected {width} cells: "), F.col("_misfit"))
        fits = F.when(fits, F.lit(True)).otherwise(F.raise_error(fault).cast("boolean"))
    # Always true: Spark turns down queries that look at nothing but the misfit column.
    named = F.octet_length(F.concat_ws("", F.col("_c0"))) >= 0
    return raw.where(fits & named).select(
        *[_text_cell(F.col(f"_c{i}")).alias(name) for i, name in names], *extra, FILE, BLOCK, LINE
    )


def read_exports(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    header_words: Sequence[str] = (),
    multiline: bool = True,
    same_layout: bool = False,
    wide: str = "error",
) -> DataFrame:
    """All-text rows of delimited exports under their clean header names, plus file position.

    ``multiline``    cells may hold line breaks. Each file is then read by one task; turn it off
                     for very large files without such cells, which makes them splittable.
    ``same_layout``  all files share the layout of the first one: only that one is peeked at.
    ``wide``         records with more cells than the header are an ``error``, are left out (``drop``), or
                     are kept with their text in a column of its own (``mark``).
    """
    if wide not in ("error", "drop", "mark"):
        raise ValueError(f"wide is {wide!r}")
    listed = spark.read.text(paths if isinstance(paths, str) else list(paths)).inputFiles()
    files = sorted(_as_path(uri) for uri in listed)
    if not files:
        raise FileNotFoundError(f"no files under {paths!r}")
    odd = [f for f in files if not f.lower().endswith(".csv")]
    if odd:
        raise ValueError(f"Unsupported file type: {odd[0]}")

    if same_layout:
        groups = {discover_layout(spark, files[0], header_words): files}
    else:
        groups = discover_layouts(spark, files, header_words)

    parts = []
    for layout, members in groups.items():
        names = usable_names(layout.header)
        for start in range(0, len(members) if names else 0, BROADCAST_ROWS):
            batch = members[start : start + BROADCAST_ROWS]
            parts.append(_read_group(spark, batch, layout, names, multiline, wide))
    if not parts:
        raise ValueError(f"no readable header under {paths!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def with_file_order(df: DataFrame, name: str = "_pos", each_file: bool = False) -> DataFrame:
    """Dense 0..n-1 number in file order, over the rows that are left; for ``each_file`` from 0 on again.

    Each input split is one run of rows whose line numbers rise. A first pass, made when this is
    called, counts the rows of every split (one row per split, not per record); the second adds a
    row's place within its split to the rows before that split. The data is never sorted.
    """
    local = df.withColumn("_seq", F.monotonically_increasing_id())
    chunk = [FILE, BLOCK]
    sizes = local.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_from"))
    line = Window.partitionBy(FILE).orderBy(BLOCK) if each_file else Window.orderBy(*chunk)
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        sizes.select(*chunk, "_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        local.join(broadcast_if_small(offsets, offsets.count()), chunk)
        .withColumn(name, F.col("_before") + F.col("_seq") - F.col("_from"))
        .drop("_seq", "_before", "_from")
    )


def with_place(df: DataFrame, name: str) -> DataFrame:
    """Each row's file and place among the file's rows as text.

    It depends on the file alone: not on the files read with it, nor on how many cores or splits read it.
    """
    placed = with_file_order(df, "_nth", each_file=True)
    return placed.withColumn(name, F.concat_ws("#", F.col(FILE), F.col("_nth").cast("string"))).drop("_nth")
