"""Repeated passages of one to five lines, against plain Python."""

import random
import re

from forecourt.llm.line_dedup import drop_repeated_passages

_draw = random.Random(8)


def _sentence(n):
    return " ".join(f"w{_draw.randrange(10**9)}" for _ in range(n)) + "."


def _plain(texts, words=50):
    """``texts`` (in order of their keys) without repeated runs of units, every run of any length."""
    ends = re.compile(r"(?<=\n)(?=[^\S\n]*\S)|(?<=[.!?] )(?=\S)", re.A)
    seen, out = set(), []
    for text in texts:
        cuts = [0, *(m.start() for m in ends.finditer(text)), len(text)]
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        gone = set()
        for b in range(len(parts)):
            own = []
            for a in range(b, -1, -1):
                if len("".join(parts[a:b + 1]).split()) > words:
                    run = "".join(parts[a:b + 1]).rstrip()
                    if run in seen:
                        gone |= set(range(a, b + 1))
                    own.append(run)
            seen.update(own)
        lines, at = [], 0
        for line in text.split("\n"):
            mine = []
            size = len(line) + 1
            while size > 0 and at < len(parts):
                size -= len(parts[at])
                mine.append(at)
                at += 1
            if not mine or any(i not in gone for i in mine):
                lines.append("".join(parts[i] for i in mine if i not in gone).rstrip())
        left = "\n".join(lines).rstrip()
        out.append((len(gone), (left or None) if gone else text))
    return out


def test_passages_of_one_to_five_lines(spark):
    passages = [[_sentence(60 // n + 1) for _ in range(n)] for n in (1, 2, 3, 4, 5) for _ in range(6)]
    texts = []
    for lines in passages:
        for _ in range(2):
            around = [[_sentence(_draw.randrange(3, 15)) for _ in range(_draw.randrange(4))]
                      for _ in range(2)]
            texts.append("\n".join(around[0] + lines + around[1]))
    # Within one long line; at the end and the start of lines; within one text.
    inner = " ".join(_sentence(20) for _ in range(3))
    texts += [f"{_sentence(9)} {inner} {_sentence(9)}", f"{_sentence(9)}\n{inner}\n{_sentence(9)}",
              f"{_sentence(9)} {inner}\n{_sentence(9)}", f"{inner} {_sentence(9)}\n\n{inner}",
              _sentence(70), "short twice", "short twice", "\n" * 40, ""]
    rows = drop_repeated_passages(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    got = {r.doc_id: (r.units_removed, r.text) for r in rows}
    squeeze = lambda t: t and re.sub(r" +(?=\n|$)", "", t)
    for i, (n, text) in enumerate(_plain(texts)):
        assert (got[i][0], squeeze(got[i][1])) == (n, squeeze(text)), i
    for k, lines in enumerate(passages):
        assert got[2 * k][0] == 0 and got[2 * k + 1][0] == len(lines)
    assert got[61][0] == got[62][0] == 3


def test_passages_of_odd_rows(odd, none):
    frame = drop_repeated_passages(odd)
    rows = frame.collect()
    assert len(rows) == odd.count() and rows[0]["n"] == "own n"
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[6][0].units_removed == 0 and by[7][0].text == "before\nafter"
    assert [r.text for r in by[8]] == [None, None]
    assert by[2][0].text is None and by[3][0].text == "" and by[11][0].units == 1
    assert drop_repeated_passages(none).collect() == []
