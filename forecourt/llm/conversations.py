"""Repair of conversations: faults, and the cheapest edits to a legal order of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from forecourt.llm.common import map_batches, written

# Edits, in the order of their letters; 0 stands for no letter.
_LETTERS = " DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
_BITS = 3
# Where a repaired conversation can be: at its start, after system, user, assistant.
_START, _S, _U, _A = range(4)
#: The role that may be put in at a place, as the place it leads to.
_NEXT = {_START: _U, _S: _U, _U: _A, _A: _U}
#: Where a conversation may end.
_LEGAL_ENDS = (_START, _A)
#: Where a row that is kept leads to, by the initial of its role.
_KEPT = {"s": {_START: _S}, "u": {_START: _U, _S: _U, _A: _U}, "a": {_U: _A}}
_COSTS = {_K: 0, _R: 2, _D: 3, _I: 2}
_ROLES = {_U: "user", _A: "assistant"}


def _prepended(weight: int, letter: int, cost: int, low: int) -> int:
    """The weight of a path with one more edit before it.

    The digits above bit ``low`` are the cost, those below the letters, first letter on top and
    zeros behind the last. So the smaller of two weights is the cheaper path, or of equally cheap
    ones that whose letters come first, a text that ends coming before one that goes on.
    """
    letters = weight & ((1 << low) - 1)
    return (((weight >> low) + cost) << low) | (letter << (low - _BITS)) | (letters >> _BITS)


def paths(codes: str, ends: tuple[int, ...] = (_START, _S, _U, _A)) -> dict[tuple[int, int], int]:
    """The weight of the cheapest edits of some rows from each place to each of ``ends``.

    ``codes`` has a letter for each row: ``s``, ``u``, ``a`` (its role) or ``x`` (another one),
    in capitals if it is truncated, ``d`` if it must go. The rows are a graph without circles
    that is walked from behind: between two rows at most two are put in.
    """
    low = _BITS * (3 * len(codes) + 2)
    found = {}
    for end in ends:
        best: dict[int, int] = {end: 0}

        def put_in() -> None:
            for _ in range(2):
                for place, then in _NEXT.items():
                    if then in best:
                        weight = _prepended(best[then], _I, _COSTS[_I], low)
                        if place not in best or weight < best[place]:
                            best[place] = weight

        put_in()
        for code in reversed(codes):
            after, best = best, {}
            kind, late = code.lower(), int(code.isupper())
            for place in _NEXT:
                ways = []
                if place in after:
                    ways.append(_prepended(after[place], _D, _COSTS[_D], low))
                if kind != "d":
                    then = _KEPT.get(kind, {}).get(place)
                    if then in after:
                        ways.append(_prepended(after[then], _K, _COSTS[_K] + late, low))
                    if _NEXT[place] in after:
                        ways.append(_prepended(after[_NEXT[place]], _R, _COSTS[_R] + late, low))
                if ways:
                    best[place] = min(ways)
            put_in()
        found.update({(place, end): weight for place, weight in best.items()})
    return found


def letters_of(weight: int, rows: int) -> tuple[int, str]:
    """The cost and the letters of a weight of ``rows`` rows."""
    slots = 3 * rows + 2
    low = _BITS * slots
    digits = weight & ((1 << low) - 1)
    octal = format(digits, f"0{slots}o")  # three bits, one letter
    return weight >> low, octal.rstrip("0").translate(_DIGITS)


_DIGITS = str.maketrans({str(i): _LETTERS[i] for i in range(1, len(_LETTERS))})
_NUMBERS = str.maketrans({_LETTERS[i]: str(i) for i in range(1, len(_LETTERS))})


def weight_of(cost: int, letters: str, rows: int) -> int:
    slots = 3 * rows + 2
    return (cost << (_BITS * slots)) | int(letters.translate(_NUMBERS).ljust(slots, "0"), 8)


def joined(first: dict, rows: int, second: dict, more: int) -> dict[tuple[int, int], int]:
    """The paths over some rows and those behind them, from the paths over each."""
    spelt = {k: letters_of(w, rows) for k, w in first.items()}
    after = {k: letters_of(w, more) for k, w in second.items()}
    found: dict[tuple[int, int], int] = {}
    for (start, middle), (cost, letters) in spelt.items():
        for (place, end), (cost2, letters2) in after.items():
            if place == middle:
                weight = weight_of(cost + cost2, letters + letters2, rows + more)
                if (start, end) not in found or weight < found[start, end]:
                    found[start, end] = weight
    return found


def damaged(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, turn, role, text`` after damage; what happens depends on id and turn only.

    By crc32 of ``conv_id:turn`` (nulls: one blank) modulo 20, 0 drops a row, 1 empties its text, 2
    takes ``.!?`` out of it, 3 repeats it, 4 makes its role ``user``. Null roles and texts are one
    blank.
    """
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                     F.coalesce(F.col("turn").cast("string"), blank))
    lot = F.crc32(F.encode(named, "UTF-8")) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), lot.alias("lot"))
    rows = rows.where("lot <> 0").select(
        "conv_id", "turn",
        F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("lot") == 1, "").when(
            F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(
            F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


_SPACES = " \t\n\x0b\x0c\r"


def _coded(kind: pa.DataType):
    """Add each row's letter and fault; rows come in the order of their conversation."""
    schema = pa.schema([
        ("conv_id", kind), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
        ("fault", pa.string()), ("code", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        previous = None
        for batch in batches:
            ids, turns, roles, texts, blanks, cuts, agains = (
                batch.column(i).to_pylist() for i in range(7))
            faults, codes = [], []
            for i, row in enumerate(zip(ids, turns, roles, texts)):
                role = roles[i][:1]
                code = role if role in _KEPT else "x"
                if blanks[i]:
                    fault, code = "blank", "d"
                elif agains[i] or row == previous:
                    fault, code = "duplicate", "d"
                elif cuts[i]:
                    fault, code = "truncated", code.upper()
                else:
                    fault = None
                previous = row
                faults.append(fault)
                codes.append(code)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(faults, pa.string()),
                 pa.array(codes, pa.string())], schema=schema)

    return run


def ordered_rows(rows: DataFrame, rows_per_range: int = 50_000) -> DataFrame:
    """The rows in the order of conversation and turn, with ``at`` (that order), ``fault``, ``code``.

    Turns are in order, nulls first; rows with equal turns in that of role and text. ``at`` grows
    with the order. ``fault`` is blank (no word), duplicate (role and text were there before),
    truncated (the last letter that is not blank is none of ``.!?``) or null, ``code`` the
    row's letter for ``paths``.

    The rows are sorted in ranges, so a conversation of any length is spread over tasks.
    """
    bare = F.rtrim(F.col("text"), F.lit(_SPACES))
    rows = rows.withColumns({
        "blank": bare == "", "cut": ~F.substring(bare, -1, 1).isin(".", "!", "?"),
        "print": F.md5(F.col("text").cast("binary"))})
    # The first turn of each role and text that a conversation has more than once.
    many = rows.groupBy("conv_id", "role", "print").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("z"), "turn")).alias("first"),
        F.count("*").alias("times")).where("times > 1").select(
        F.col("conv_id").alias("its_id"), F.col("role").alias("its_role"),
        F.col("print").alias("its_print"), "first")
    told = rows.join(
        many, F.col("conv_id").eqNullSafe(F.col("its_id")) & (F.col("role") == F.col("its_role"))
        & (F.col("print") == F.col("its_print")), "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    told = told.select("conv_id", "turn", "role", "text", "blank", "cut", again.alias("again"))
    ranges = max(1, -(-rows.count() // rows_per_range))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    in_order = told.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType
    coded = map_batches(
        in_order, _coded(to_arrow_type(kind)), f"conv_id {kind.simpleString()}, turn long, "
        "role string, text string, fault string, code string")
    return written(coded.withColumn("at", F.monotonically_increasing_id()), "turns")


def _solved(kind: pa.DataType):
    schema = pa.schema([("conv_id", kind), ("cost", pa.int64()), ("audit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = []
            for codes in batch.column(1).to_pylist():
                found = paths(codes, _LEGAL_ENDS)
                answers.append(letters_of(
                    min(found[_START, end] for end in _LEGAL_ENDS if (_START, end) in found),
                    len(codes)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a[0] for a in answers], pa.int64()),
                 pa.array([a[1] for a in answers], pa.string())], schema=schema)

    return run


_PATHS = "array<struct<start: int, end: int, cost: bigint, letters: string>>"


def _stretches(kind: pa.DataType):
    """The paths of each stretch of a long conversation, or of those of several in a row.

    A column of letters is solved; a column of lists of paths, in order, is joined.
    """
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()),
                        ("letters", pa.string())])
    schema = pa.schema([("conv_id", kind), ("place", pa.int64()), ("rows", pa.int64()),
                        ("paths", pa.list_(struct))])

    def listed(found: dict, rows: int) -> list[dict]:
        return [dict(zip(("start", "end", "cost", "letters"), (*k, *letters_of(w, rows))))
                for k, w in found.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, answers = [], []
            for value in batch.column(2).to_pylist():
                if isinstance(value, str):
                    counts.append(len(value))
                    answers.append(listed(paths(value), len(value)))
                    continue
                found, rows = None, 0
                for part in value:
                    more = part["rows"]
                    next_paths = {(p["start"], p["end"]): weight_of(p["cost"], p["letters"], more)
                                  for p in part["paths"]}
                    found = next_paths if found is None else joined(found, rows, next_paths, more)
                    rows += more
                counts.append(rows)
                answers.append(listed(found, rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                 pa.array(answers, pa.list_(struct))], schema=schema)

    return run


def cheapest_edits(rows: DataFrame, stretch_bits: int = 12, at_once: int = 16) -> DataFrame:
    """``conv_id, cost, audit`` of the cheapest edits of every conversation of ``ordered_rows``.

    Conversations are solved in stretches of up to 2 ** ``stretch_bits`` rows. Of a long one, the
    cheapest paths between any two places are found for each stretch by itself, and those of
    ``at_once`` neighbours are joined, again and again until one is left: the paths over two
    stretches are minima of the same numbers, so the result is that of one long search.
    """
    kind = rows.schema["conv_id"].dataType
    arrow, name = to_arrow_type(kind), kind.simpleString()
    stretches = rows.select(
        "conv_id", F.shiftright("at", stretch_bits).alias("stretch"), "at", "code").groupBy(
        "conv_id", "stretch").agg(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("at", "code"))), lambda r: r["code"]),
            "").alias("codes"))
    order = Window.partitionBy("conv_id").orderBy("stretch")
    stretches = written(stretches.select(
        "conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), "codes",
        F.count("*").over(Window.partitionBy("conv_id")).alias("stretches")), "stretches")
    short = map_batches(
        stretches.where("stretches = 1").select("conv_id", "codes"), _solved(arrow),
        f"conv_id {name}, cost long, audit string")
    most = stretches.agg(F.max("stretches")).first()[0] or 0
    if most <= 1:
        return short
    schema = f"conv_id {name}, place long, rows long, paths {_PATHS}"
    found = written(map_batches(
        stretches.where("stretches > 1").select("conv_id", "place", "codes"), _stretches(arrow),
        schema), "paths")
    while most > 1:
        together = found.groupBy("conv_id", F.call_function(
            "div", F.col("place"), F.lit(at_once)).alias("place")).agg(F.transform(
                F.array_sort(F.collect_list(F.struct("place", "rows", "paths"))),
                lambda r: F.struct(r["rows"].alias("rows"), r["paths"].alias("paths"))
            ).alias("parts"))
        found = written(map_batches(together, _stretches(arrow), schema), "paths")
        most = -(-most // at_once)
    legal = F.filter("paths", lambda p: (p["start"] == _START) & p["end"].isin(*_LEGAL_ENDS))
    best = F.array_min(F.transform(legal, lambda p: F.struct(
        p["cost"].alias("cost"), p["letters"].alias("audit"))))
    return short.union(found.select("conv_id", best.alias("best")).select("conv_id", "best.*"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each conversation's repaired rows, from its audit (which comes first) and its rows in order.

    ``("new", conv_id, cost, audit)``, then ``("row", turn, initial, fault)`` of every row before
    repair and ``("kept", role, text, letter)`` of every row after it.
    """
    audit, at, place = "", 0, _START

    def put_in():
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            place = _NEXT[place]
            at += 1
            yield "kept", _ROLES[place], "", "I"

    begun = False
    for batch in batches:
        for conv_id, number, cost, edits, turn, role, text, fault in zip(
                *(column.to_pylist() for column in batch.columns)):
            if number < 0:
                if begun:
                    yield from put_in()
                begun, audit, at, place = True, edits, 0, _START
                yield "new", conv_id, cost, edits
                continue
            yield "row", turn, role[:1], fault
            yield from put_in()
            letter = audit[at]
            at += 1
            if letter == "D":
                continue
            if letter == "R":
                place = _NEXT[place]
                role = _ROLES[place]
            else:
                place = _KEPT[role[:1]][place]
            yield "kept", role, text, letter
    if begun:
        yield from put_in()


def _side_by_side(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Every conversation's audit, and behind it its rows, as one sorted stream in a partition.

    Spark sorts, and spills; a task holds one batch of rows and one audit.
    """
    heads = edits.select(
        "conv_id", F.lit(-1).cast("long").alias("at"), "cost", "audit",
        *[F.lit(None).cast(kind).alias(c) for c, kind in (
            ("turn", "long"), ("role", "string"), ("text", "string"), ("fault", "string"))])
    tails = rows.select(
        "conv_id", "at", F.lit(None).cast("long").alias("cost"),
        F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "fault")
    return heads.union(tails).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows of repaired conversations: ``conv_id, place`` (from 0), ``role, text, edit``."""
    kind = rows.schema["conv_id"].dataType
    schema = pa.schema([
        ("conv_id", to_arrow_type(kind)), ("place", pa.int64()), ("role", pa.string()),
        ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, conv_id, place = [], None, 0
        for event in _walk(batches):
            if event[0] == "new":
                conv_id, place = event[1], 0
            elif event[0] == "kept":
                out.append((conv_id, place, *event[1:]))
                place += 1
                if len(out) == 4096:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return map_batches(
        _side_by_side(rows, edits), run, f"conv_id {kind.simpleString()}, place long, "
        "role string, text string, edit string")


_LEGAL_PAIRS = ("su", "ua", "au")
_FAULTS = ("blank", "duplicate", "truncated")


def _reports(kind: pa.DataType):
    schema = pa.schema([
        ("conv_id", kind), ("gaps", pa.int64()), *((f, pa.int64()) for f in _FAULTS),
        ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
        ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        one: dict | None = None

        def finish():
            gaps = one["last"] - one["first"] + 1 - one["turns"] if one["turns"] else 0
            done.append((one["conv_id"], gaps, *(one[f] for f in _FAULTS), one["illegal"],
                         one["cost"], one["audit"], one["hash"].hexdigest()))

        for event in _walk(batches):
            if event[0] == "new":
                if one:
                    finish()
                one = dict(
                    zip(("conv_id", "cost", "audit"), event[1:]), first=None, last=None, turns=0,
                    illegal=0, before=None, hash=hashlib.sha256(), empty=True,
                    **dict.fromkeys(_FAULTS, 0))
            elif event[0] == "row":
                _, turn, initial, fault = event
                if turn is not None and turn != one["last"]:
                    one["first"] = turn if one["turns"] == 0 else one["first"]
                    one["last"] = turn
                    one["turns"] += 1
                if fault:
                    one[fault] += 1
                before, one["before"] = one["before"], initial
                one["illegal"] += before is not None and before + initial not in _LEGAL_PAIRS
            else:
                _, role, text, _ = event
                line = f"{role}:{text}" if one["empty"] else f"\n{role}:{text}"
                one["hash"].update(line.encode("utf-8"))
                one["empty"] = False
            if len(done) == 4096:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if one:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return run


def reports(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per conversation of ``ordered_rows``: its faults, and what its repair comes to.

    ``gaps`` (turns missing between the first and the last), counts of ``blank, duplicate,
    truncated`` rows and of ``illegal`` neighbours, ``cost``, ``audit``, and ``repaired_sha256`` of the
    repaired rows as ``role:text`` lines.
    """
    kind = rows.schema["conv_id"].dataType
    return map_batches(
        _side_by_side(rows, edits), _reports(to_arrow_type(kind)),
        f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, cost long, audit string, repaired_sha256 string")


def repair_report(
    turns: DataFrame, damage: bool = True, rows_per_range: int = 50_000, stretch_bits: int = 12,
) -> DataFrame:
    """What repairing the conversations of ``turns`` (``conv_id, turn, role, text``) comes to.

    One row per ``conv_id`` (null is one, too), with the columns of ``reports``. ``damage`` first
    damages the rows (see ``damaged``). A conversation without rows has zeros, an empty audit and
    the hash of nothing. A repaired conversation's roles begin like ``(s?(ua)+)?``; a
    row may be kept (free), be given role user or assistant (2), or deleted (3; blank and duplicate
    rows must go), empty user or assistant rows may be put in anywhere (2), and truncated rows
    that stay cost 1. Of the cheapest edits, the ones whose letters K, R, D, I come first count.

    Null roles and texts are one blank. Null turns come first and are no gaps. Rows with equal
    turns are in the order of role and text; equal rows are duplicates of the first.
    Other columns are not read. An empty table has no rows.
    """
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    plain = turns.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})
    rows = ordered_rows(damaged(turns) if damage else plain, rows_per_range)
    edits = written(cheapest_edits(rows, stretch_bits), "edits")
    found = reports(rows, edits).withColumnRenamed("conv_id", "its_id")
    everyone = turns.select("conv_id").distinct()
    whole = everyone.join(found, F.col("conv_id").eqNullSafe(F.col("its_id")), "left")
    numbers = ("gaps", *_FAULTS, "illegal", "cost")
    return whole.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias(
            "repaired_sha256"))
