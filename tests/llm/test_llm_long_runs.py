"""Packing of texts with very long runs of one class: the same ids as the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from forecourt.llm.packing import _LONG, encoder, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
MB = 1_000_000
SPECIAL = "<|endoftext|>"


@pytest.fixture(scope="module")
def slow():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("letter, frame", [
    ("\n", "{}"), (" ", "a b{}c d"), ("\t", "{}  ."), ("　", "5{}"), (" \n", "one {} two{} three"),
    ("x", "a {} b"), (".", "{} b"), ("7", "a{}")])
def test_runs_of_one_megabyte(slow, letter, frame):
    text = frame.replace("{}", letter * (MB // len(letter) // frame.count("{}")))
    assert encoder(PATH)(text) == slow(text)


@pytest.mark.parametrize("letter", ["\n", " "])
def test_runs_of_ten_megabytes(slow, letter):
    text = "begin" + letter * (10 * MB) + "end"
    assert encoder(PATH)(text) == slow(text)


@pytest.mark.parametrize("size", [_LONG - 1, _LONG, _LONG + 1])
def test_marks_beside_long_runs(slow, size):
    blanks = " " * size
    for text in (f"{blanks}{SPECIAL}{blanks}", f"x{blanks}{SPECIAL}y", f"{SPECIAL}{blanks}y\x1c{blanks}"):
        assert encoder(PATH)(text) == slow(text)


def test_blanks_of_three_megabytes_in_spark(spark, slow):
    texts = [" " * (3 * MB), "short", "\n" * (3 * MB) + "end", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in pack(docs, PATH).collect():
        found.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i, text in enumerate(texts):
        ids = np.array([*slow(text or ""), 1], dtype="<u4")
        assert zlib.crc32(b"".join(p for _, p in sorted(found[i]))) == zlib.crc32(ids.tobytes())
