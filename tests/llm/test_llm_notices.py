"""License notices in long lines, and several in one block."""

import random

import pytest

from forecourt.llm.license_scan import TEMPLATES, license_notices, notices

RULES = (TEMPLATES, 3, 4, 0.2, 0.3)


def _prose(draw, size):
    return " ".join("".join(draw.choices("etaoinshrdlu", k=draw.randrange(2, 9)))
                    for _ in range(size // 6))


@pytest.mark.parametrize("size", [2_000, 15_000, 60_000, 1_000_000])
def test_notices_in_the_middle_of_long_lines(size):
    draw = random.Random(size)
    for name, wording in TEMPLATES if size < 1_000_000 else TEMPLATES[:6]:
        line = f"{_prose(draw, size // 2)} {wording} {_prose(draw, size // 2)}"
        found = notices(line, *RULES)
        assert [won[0] for won, _, _ in found] == [name]
        assert line[found[0][1]:found[0][2]] in wording


def test_all_notices_of_a_block(spark):
    mixed = " and ".join(text for _, text in TEMPLATES)
    assert [won[0] for won, _, _ in notices(mixed, *RULES)] == [name for name, _ in TEMPLATES]
    docs = spark.createDataFrame(
        [(1, "Licensed under CC BY 4.0.\nor\nReleased under the MIT License."),
         (2, TEMPLATES[1][1]), (3, "word " * 600 + TEMPLATES[3][1] + " word" * 600)],
        "doc_id long, text string")
    rows = license_notices(docs).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == [
        (1, "CC-BY-4.0"), (1, "MIT"), (2, "Apache-2.0"), (3, "MIT")]
    assert next(r for r in rows if r.doc_id == 3).block == TEMPLATES[3][1].rstrip(".")
