"""Conversation repair against a search over plain pairs of cost and letters."""

import functools
import hashlib
import random
import re
import zlib

import pytest

from forecourt.llm.conversations import (
    cheapest_edits,
    damaged,
    letters_of,
    ordered_rows,
    paths,
    repair_report,
    repaired_turns,
)

_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(kinds):
    """(cost, letters) of the cheapest edits; ``kinds`` are (initial, must go, truncated)."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.cache
    def best(i, state, put_in):
        ways = []
        if i == len(kinds) and state in ("", "a"):
            ways.append((0, ""))

        def way(cost, letter, rest):
            if rest:
                ways.append((cost + rest[0], letter + rest[1]))

        if put_in < 4:
            for role in "ua":
                if (state, role) in moves:
                    way(2, "I", best(i, moves[state, role], put_in + 1))
        if i < len(kinds):
            initial, must_go, cut = kinds[i]
            way(3, "D", best(i + 1, state, 0))
            if not must_go:
                if (state, initial) in moves:
                    way(cut, "K", best(i + 1, moves[state, initial], 0))
                for role in "ua":
                    if (state, role) in moves:
                        way(2 + cut, "R", best(i + 1, moves[state, role], 0))
        return min(ways) if ways else None

    return best(0, "", 0)


def report(rows):
    """The whole report by plain Python: rows are (conv_id, turn, role, text)."""
    found = {}
    for conv_id in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv_id):
            name = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
            lot = zlib.crc32(name.encode()) % 20
            role, text = (" " if v is None else v for v in (role, text))
            if lot == 1:
                text = ""
            if lot == 2:
                text = re.sub("[.!?]", "", text)
            if lot == 4:
                role = "user"
            own += [(turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in own:
            letters = _SPACE.findall(text)
            fault = ("blank" if not letters else "duplicate" if (role, text) in seen
                     else "truncated" if letters[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append((role[:1], fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = {r[0] for r in own if r[0] is not None}
        cost, audit = cheapest(tuple(kinds))
        lines, state, i = [], "", 0
        for letter in audit:
            if letter == "I":
                state = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state[:1]]
                lines.append(state + ":")
                continue
            _, role, text = own[i]
            i += 1
            if letter == "R":
                role = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state[:1]]
            if letter != "D":
                state = role
                lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))
        found[conv_id] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


def _found(frame):
    return {r.conv_id: tuple(r)[1:] for r in frame.collect()}


def _drawn(seed, conversations, longest):
    draw = random.Random(seed)
    rows = []
    for conv_id in range(conversations):
        turn = draw.choice([0, 0, 3])
        for _ in range(draw.randint(0, longest)):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = draw.choice(
                ["Yes.", "No", "Well?", "", " \n", None, "So!  ", "a", "b.", "c d. e", "é", "?"])
            rows.append((conv_id if conv_id else None, draw.choice([turn, turn, turn, None]), role, text))
            turn += draw.choice([0, 1, 1, 1, 2])
    return rows


@pytest.mark.parametrize("codes", ["", "u", "a", "ua", "sua", "d", "xdx", "UA", "aus", "suaaXuud"])
def test_paths(codes):
    found = paths(codes, (0, 3))
    best = min(w for (start, _), w in found.items() if start == 0)
    kinds = tuple((c.lower(), c == "d", int(c.isupper())) for c in codes)
    assert letters_of(best, len(codes)) == cheapest(kinds)


def test_all_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    assert _found(repair_report(turns)) == report(rows)


@pytest.mark.parametrize("stretch_bits, rows_per_range", [(12, 50_000), (2, 40), (0, 7)])
def test_drawn_conversations(spark, stretch_bits, rows_per_range):
    """Nulls, ties, repeats, and long conversations cut into short stretches and ranges."""
    rows = _drawn(5, 60, 12) + _drawn(6, 2, 90)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = _found(repair_report(
        turns.repartition(6), stretch_bits=stretch_bits, rows_per_range=rows_per_range))
    assert got == report(rows)


def test_repaired_turns_are_the_report(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = ordered_rows(damaged(turns))
    kept = {}
    for r in repaired_turns(rows, cheapest_edits(rows)).collect():
        kept.setdefault(r.conv_id, []).append(r)
    for conv_id, (*_, digest) in _found(repair_report(turns)).items():
        own = sorted(kept.get(conv_id, []), key=lambda r: r.place)
        text = "\n".join(f"{r.role}:{r.text}" for r in own)
        assert hashlib.sha256(text.encode()).hexdigest() == digest
        assert [r.place for r in own] == list(range(len(own)))


def test_odd_tables(spark):
    schema = "audit string, conv_id long, turn int, role string, text string, at int, cost int"
    turns = spark.createDataFrame([("x", 1, 2, "user", "Hi.", 5, 6)], schema)
    assert _found(repair_report(turns)) == report([(1, 2, "user", "Hi.")])
    assert repair_report(turns.where("false")).collect() == []
    long = "word " * 200_000
    rows = [(9, 1, "user", long), (9, 2, "assistant", long + "."), (9, 2, "assistant", long + ".")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert _found(repair_report(turns)) == report(rows)
    clean = [(4, 1, "user", "A."), (4, 2, "assistant", "B.")]
    turns = spark.createDataFrame(clean, "conv_id long, turn long, role string, text string")
    assert _found(repair_report(turns, damage=False))[4][:6] == (0, 0, 0, 0, 0, 0)
