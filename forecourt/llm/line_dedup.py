"""Repeated passages, with Spark functions only.

``drop_repeated_chunks`` finds them by content-defined chunks of lines and keeps what lies beside
the chunks; ``drop_repeated_passages`` removes every repeated run of units (sentences, lines).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.llm.common import free_name, written


def _hash(column: F.Column) -> F.Column:
    return F.md5(column.cast("binary"))


def chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """The chunks of every row's lines: the row's columns and ``start`` (0-based), ``n``, ``chunk``.

    A rolling hash over the hashes of each line and the one before it is taken at every
    line; a chunk ends where that hash is smaller than at the line before and not larger
    than at the next. So a boundary depends on four lines only, and text put in before a
    passage shifts nothing behind it; no two boundaries are adjacent, and chunks have two
    lines or more, unless the whole text is one line. Rows with a null text have no chunk.
    """
    at = free_name(docs, "lines")
    lines = docs.where(F.col(text).isNotNull()).withColumn(
        at, F.split(F.col(text), "\n", -1))
    hashed, rolled, ends = (free_name(docs, name) for name in ("hashed", "rolled", "ends"))
    lines = lines.withColumn(hashed, F.transform(at, _hash))
    # rolled[i] belongs to the lines i and i + 1 (0-based).
    lines = lines.withColumn(
        rolled, F.zip_with(
            F.slice(hashed, 1, F.greatest(F.size(hashed) - 1, F.lit(0))),
            F.slice(hashed, 2, F.greatest(F.size(hashed) - 1, F.lit(0))),
            lambda a, b: _hash(F.concat(a, b))))
    # A chunk may end after line i (2 <= i + 1 <= lines - 2); i is 0-based.
    n = F.size(at)
    inner = F.filter(
        F.sequence(F.lit(1), F.greatest(n - 3, F.lit(1))),
        lambda i: (i <= n - 3)
        & ((i == 1) | (F.get(rolled, i - 1) < F.get(rolled, i - 2)))
        & (F.get(rolled, i - 1) <= F.get(rolled, i)))
    lines = lines.withColumn(ends, F.concat(inner, F.array(n - 1)))
    starts = F.concat(F.array(F.lit(0)), F.transform(
        F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))), lambda i: i + 1))
    spans = F.zip_with(starts, F.col(ends), lambda a, b: F.struct(
        a.alias("start"), (b - a + 1).alias("n"),
        F.array_join(F.slice(F.col(at), a + 1, b - a + 1), "\n").alias("chunk")))
    kept = [c for c in docs.columns if c != text]
    return lines.select(*[F.col(f"`{c}`") for c in kept], F.inline(spans))


def drop_repeated_chunks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without the multi-line chunks that occur before.

    Of equal chunks of two lines or more, the first one (smallest key, nulls last, then
    position) stays; the lines of the others go. Three columns follow: ``lines`` (before),
    ``lines_removed`` and ``chunks_removed`` (with underscores in front where ``docs`` has
    such columns). Where all lines go, the text is null. Texts that are null stay null
    (0 lines), empty ones are one empty line. Rows that repeat both key and text are one
    document: they keep the same lines.

    Chunks are counted by hash first, which moves a few bytes per chunk. Only chunks whose
    hash repeats are moved as text, compared byte by byte by grouping them under
    (hash, text), counted before they are moved, and marked by a join that Spark splits at
    hot keys.
    """
    row = free_name(docs, "row_hash")
    ident = F.xxhash64(F.col(key), F.col(text))
    slim = docs.select(F.col(key).alias("id"), ident.alias("row"), F.col(text).alias("text"))
    pieces = chunks(slim).where("n > 1").withColumn("h", F.xxhash64("chunk"))
    many = pieces.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    suspects = written(pieces.join(many, "h", "left_semi"), "chunks")
    place = F.struct(F.col("id").isNull().alias("z"), "id", "start", "row")
    first = suspects.groupBy("h", "chunk").agg(
        F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    again = suspects.join(first, ["h", "chunk"]).where(
        (F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start")))
    gone = again.select("id", "row", "start", "n").distinct().groupBy("id", "row").agg(
        F.collect_list(F.struct("start", "n")).alias("gone"))
    lines, removed, count = (free_name(docs, c) for c in (
        "lines", "lines_removed", "chunks_removed"))
    its_id, its_row, its = (free_name(docs, c) for c in ("gone_id", "gone_row", "gone"))
    marked = docs.withColumn(row, ident).join(
        gone.withColumnsRenamed({"id": its_id, "row": its_row, "gone": its}),
        (F.col(row) == F.col(its_row)) & F.col(key).eqNullSafe(F.col(its_id)), "left")
    all_lines = F.split(F.col(text), "\n", -1)
    spans = F.col(its)
    out = F.flatten(F.transform(
        spans, lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))
    left = F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), out),
        lambda i: F.get(all_lines, i)), "\n")
    n_gone = F.coalesce(F.aggregate(
        spans, F.lit(0), lambda total, s: total + s["n"]), F.lit(0))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(all_lines))
    new_text = F.when(spans.isNull(), F.col(text)).when(n_gone < F.size(all_lines), left)
    columns = [new_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(
        *columns, n_lines.alias(lines), n_gone.alias(removed),
        F.when(spans.isNull(), 0).otherwise(F.size(spans)).alias(count))


# A unit ends after a sentence, or after a line whose next line is not blank.
_UNIT_END = (r"(?<=[.!?][\"'\u201d\u2019)\u00bb\]]?[^\S\n]{1,4})(?=\S)"
             r"|(?<=[\u3002\uff01\uff1f])(?=[^\s\u3002\uff01\uff1f])"
             r"|(?<=\n)(?=[^\S\n]*\S)")
_BLANK = " \t\n\x0b\f\r"
_HALF = 1 << 31


def units(text: F.Column) -> F.Column:
    """The units of a text: its sentences within lines, with the blanks that follow them.

    Joined, they are the text. Only the first unit may be without a word.
    """
    return F.split(text, _UNIT_END, -1)


def _bound(value: F.Column, use: Callable[[F.Column], F.Column]) -> F.Column:
    """``use(value)``, with the value computed once per row wherever Spark puts the expression.

    A column that is used inside a lambda may be written out there when a filter or projection
    above moves down, and is then computed for every element. The variable of a lambda is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hashed_units(docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` but the text, ``prints`` (a 128-bit hash of each unit) and ``counts`` (its words).

    Blanks at the end of a unit do not count. Rows with a null text have no row.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text]

    def printed(unit: F.Column) -> F.Column:
        bare = F.rtrim(unit, F.lit(_BLANK))
        return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(30_011), bare).alias("b"),
                        F.regexp_count(unit, F.lit(r"\S+")).alias("words"))

    found = docs.where(F.col(text).isNotNull()).select(
        *kept, _bound(units(F.col(text)), lambda u: F.transform(u, printed)).alias("found"))
    return found.select(
        *kept, F.transform("found", lambda u: F.struct(u["a"], u["b"])).alias("prints"),
        F.transform("found", lambda u: u["words"]).alias("counts"))


def passages(printed: DataFrame, words: int) -> DataFrame:
    """The shortest runs of more than ``words`` words of ``hashed_units``: ``id``, ``row``, ``run``, ``prints``.

    For each unit, the shortest such run that starts with it, and the shortest one that ends
    with it. If a run of units of more than ``words`` words repeats, each of its units is in
    one of these runs that lies within it, and that run repeats, too. ``run`` holds the first
    and the last unit, ``prints`` the hashes of the units between.
    """
    # The unit of each word.
    of = F.flatten(F.transform("counts", lambda n, i: F.array_repeat(i, n)))

    def found(its: F.Column) -> F.Column:
        ahead = F.transform(its, lambda u, p: F.when(
            F.coalesce(F.get(its, p - 1) != u, F.lit(True)),
            u.cast("long") * _HALF + F.get(its, p + words)))
        behind = F.transform(its, lambda u, p: F.when(
            F.coalesce(F.get(its, p + 1) != u, F.lit(True)),
            F.get(its, p - words).cast("long") * _HALF + u))
        return F.array_distinct(F.array_compact(F.concat(ahead, behind)))

    runs = printed.select("id", "row", "prints", F.explode(_bound(of, found)).alias("run"))
    return runs.select("id", "row", "run", _held("run").alias("prints"))


def _held(run: str) -> F.Column:
    """The hashes of a run's units, out of ``prints``."""
    first, last = _ends(run)
    return F.slice("prints", first + 1, last - first + 1)


def _ends(run) -> tuple[F.Column, F.Column]:
    run = F.col(run) if isinstance(run, str) else run
    return (run / _HALF).cast("int"), (run % _HALF).cast("int")


def drop_repeated_passages(
    docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 50,
) -> DataFrame:
    """The rows of ``docs`` without the passages of more than ``words`` words that occur before.

    A passage is a run of units (see ``units``), of one or many lines; blanks at the ends of units
    do not tell passages apart. A unit goes if it is in
    such a run that also stands earlier: in a row with a smaller key (nulls last), or earlier in
    the same text. So the first copy of every unit stays. What is left of a line keeps its
    line break. Two columns follow: ``units`` (before) and ``units_removed``. Where nothing but blanks
    is left, the text is null. Texts that are null stay null (0 units). Rows that repeat both
    key and text are one document.

    Texts are read once for the hashes of their units (128 bits), which are written; runs are
    slices of these, counted by one hash of them first, and those that repeat are compared unit
    by unit, hash by hash; bytes are not. Texts are moved only in the last join, which puts
    the removed units beside them.
    """
    row = free_name(docs, "row_hash")
    ident = F.xxhash64(F.col(key), F.col(text))
    slim = docs.select(F.col(key).alias("id"), ident.alias("row"), F.col(text).alias("text"))
    printed = written(hashed_units(slim, "text"), "units")
    runs = passages(printed, words).select("id", "row", "run", F.xxhash64("prints").alias("h"))
    many = written(
        runs.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h"), "many")
    # Only runs whose hash repeats get their units' hashes back.
    repeated = runs.join(many, "h", "left_semi").groupBy("id", "row").agg(
        F.collect_list("run").alias("runs")).withColumnsRenamed({"id": "its_id", "row": "its_row"})
    suspects = printed.select("id", "row", "prints").join(
        repeated, (F.col("row") == F.col("its_row")) & F.col("id").eqNullSafe(F.col("its_id")))
    suspects = suspects.select("id", "row", "prints", F.explode("runs").alias("run"))
    suspects = written(suspects.select("id", "row", "run", _held("run").alias("prints")).select(
        "*", F.xxhash64("prints").alias("h")), "runs")
    place = F.struct(F.col("id").isNull().alias("z"), "id", "run", "row")
    # Written, so that Spark can split the join below at hot keys.
    first = written(suspects.groupBy("h", "prints").agg(
        F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1"), "first")
    again = suspects.join(first, ["h", "prints"]).where(
        (F.col("row") != F.col("first.row")) | (F.col("run") != F.col("first.run")))
    gone = again.groupBy("id", "row").agg(F.collect_set("run").alias("gone"))
    before, removed = free_name(docs, "units"), free_name(docs, "units_removed")
    its_id, its_row, its = (free_name(docs, c) for c in ("gone_id", "gone_row", "gone"))
    out = F.array_distinct(F.flatten(F.transform("gone", lambda r: F.sequence(*_ends(r)))))
    gone = gone.select(F.col("id").alias(its_id), F.col("row").alias(its_row), out.alias(its))
    marked = docs.withColumn(row, ident).join(
        gone, (F.col(row) == F.col(its_row)) & F.col(key).eqNullSafe(F.col(its_id)), "left")

    def rest(parts: F.Column, stay: F.Column) -> F.Column:
        # Where a line break goes with the units behind this one, it comes back.
        joined = F.array_join(F.transform(stay, lambda i, k: F.when(
            (F.get(stay, k + 1) > i + 1) & ~F.get(parts, i).endswith("\n")
            & F.exists(F.slice(parts, i + 2, F.get(stay, k + 1) - i - 1),
                       lambda u: u.endswith("\n")),
            F.concat(F.get(parts, i), F.lit("\n"))).otherwise(F.get(parts, i))), "")
        left = F.rtrim(joined, F.lit(_BLANK))
        return _bound(left, lambda t: F.when(t != "", t))

    left = _bound(units(F.col(text)), lambda parts: _bound(
        F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(its)),
        lambda stay: rest(parts, stay)))
    new_text = F.when(F.col(its).isNull(), F.col(text)).otherwise(left)
    columns = [new_text.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(
        *columns, F.when(F.col(text).isNull(), 0).otherwise(
            F.size(units(F.col(text)))).alias(before),
        F.when(F.col(its).isNull(), 0).otherwise(F.size(F.col(its))).alias(removed))
