"""Collocations against brute force, with few and with many rounds of growth."""

import random
import re
from collections import Counter

import pytest

from forecourt.llm import collocations as c
from forecourt.llm.collocations import collocations

_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """Every phrase counted, scored and compared, with Python's whole numbers."""
    counts, totals = {}, Counter()
    for lang, text in rows:
        of = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_SMALL)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    of[tuple(words[i:i + k])] += 1
    found = []
    for lang, of in counts.items():
        known = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in known.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i:i + k]] = max(most[p[i:i + k]], a)
        rows_of = []
        for p, a in known.items():
            score, k = min((2_000_000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
            if 100 * most[p] < 80 * a:
                rows_of.append((-score, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows_of)[:top], 1):  # noqa: E741
            found.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert _rows(collocations(docs, least=5)) == brute(rows, 5, 2000)


@pytest.mark.parametrize("seed, top, first_look", [(1, 3, 1), (2, 20, 1), (3, 7, 2)])
def test_growth_in_rounds(spark, seed, top, first_look):
    """Skewed words and planted passages: the first looks do not settle the list."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    passages = [[f"p{j}x{i}" for i in range(draw.randint(3, 9))] for j in range(25)]
    rows = []
    for i in range(400):
        text = []
        for _ in range(draw.randint(1, 12)):
            if draw.random() < 0.4:
                text += draw.choice(passages)
            else:
                text += draw.choices(words, weights, k=draw.randint(1, 9))
            if draw.random() < 0.5:
                text[-1] += draw.choice([".", ", ", "\n", "!?", " \t", "\r\n"])
        rows.append((draw.choice(["a", "b", None]), " ".join(text)))
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = _rows(collocations(docs, least=3, top=top, first_look=first_look, limit=500))
    assert got == brute(rows, 3, top)


def test_odd_rows(odd, none):
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert _rows(collocations(odd, least=2, limit=1000)) == brute(rows, 2, 2000)
    assert collocations(none).collect() == []


def test_counts_beyond_doubles(spark):
    """A hot pair: its score is exact, and case and pieces are told apart."""
    rows = [("x", "Big dog. BIG dog, big\tdog; big\ndog dog")] * 1000 + [("x", "Äpfel äpfel")] * 40
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert _rows(collocations(docs)) == brute(rows, 30, 2000)


def test_inner_parts_no_prefix_search_has_met_are_looked_up(spark):
    texts = spark.createDataFrame(
        [("x", b"a b c d")] * 5 + [("x", b"b c d e")] * 3 + [("x", b"c d b")], "lang string, text binary")
    words = c.word_counts(texts, 1 << 20, 0)
    hashes = {r.word: r.hash for r in words.collect()}
    of = lambda text: [hashes[w] for w in text.split()]
    frequent = words.select("lang", "hash").selectExpr("lang", "array(hash) AS phrase")
    numbers = c.spelt(texts, c.sketch(frequent), 1 << 20, 0)
    known = spark.createDataFrame([("x", of("a b c"), 5)], c._COUNTS)
    grown = spark.createDataFrame([("x", of("a b c d"), 5)], "lang string, phrase array<long>, a long")
    tables = {3: known}
    c._look_up(numbers, grown, 4, tables)
    assert {(tuple(r.phrase), r.n) for r in tables[3].collect()} == {
        (tuple(of("a b c")), 5), (tuple(of("b c d")), 8)}
