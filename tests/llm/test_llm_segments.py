"""Runs of windows and removed bytes do not depend on where segments of a batch end."""

import random

import numpy as np
import pytest

from forecourt.llm.suffix_dedup import Runs, repeated_bytes


def _texts():
    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passages = [word(draw.randrange(100, 260)) for _ in range(8)]
    return [word(draw.randrange(300)) + (draw.choice(passages) if i % 3 else "") + word(
        draw.randrange(200)) for i in range(60)]


@pytest.mark.parametrize("segment", [150, 333, 700])
def test_runs_do_not_depend_on_segments(segment):
    texts = [t.encode() for t in _texts()]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole, cut = Runs(data, offsets, 100, 32), Runs(data, offsets, 100, 32, segment)
    for name in ("at", "count", "anchor", "around", "doc", "start"):
        assert getattr(whole, name).tolist() == getattr(cut, name).tolist(), name


@pytest.mark.parametrize("broadcast_bytes", [64 << 20, 0])
def test_repeats_at_segment_borders(spark, broadcast_bytes):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    rows = repeated_bytes(docs, broadcast_bytes=broadcast_bytes, segment=300).collect()
    seen, expected = set(), {}
    for i, text in enumerate(texts):
        gone = [False] * len(text)
        for a in range(len(text) - 99):
            if text[a:a + 100] in seen:
                gone[a:a + 100] = [True] * 100
            seen.add(text[a:a + 100])
        expected[i] = "".join(c for c, x in zip(text, gone) if not x).encode()
    assert {r.doc_id: bytes(r.kept) for r in rows} == expected
