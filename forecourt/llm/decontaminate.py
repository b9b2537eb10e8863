"""Benchmark items in documents, found by greedy string tiling."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from forecourt.llm.common import map_batches
from forecourt.llm.words import MARKS, run_hashes, word_hashes, words_of_many

_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: letters and digits, lower-cased."""
    return word_hashes((text or "").lower().encode("utf-8"), MARKS)


def _open_runs(marked: bytearray, length: int) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(marked):
        if marked[start]:
            start += 1
            continue
        end = marked.find(1, start)
        end = len(marked) if end < 0 else end
        if end - start >= length:
            yield start, end
        start = end


def _rolling(items: list[int], marked: bytearray, length: int) -> Iterator[tuple[int, int]]:
    """Place and Karp-Rabin hash of every unmarked run of ``length`` tokens."""
    lead = pow(_BASE, length - 1, _PRIME)
    for start, end in _open_runs(marked, length):
        value = 0
        for i in range(start, start + length):
            value = (value * _BASE + items[i]) % _PRIME
        yield start, value
        for i in range(start + length, end):
            value = ((value - items[i - length] * lead) * _BASE + items[i]) % _PRIME
            yield i - length + 1, value


def tiles(item: list[int], doc: list[int], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in document, length), longest first.

    Matches do not overlap, in the item or in the document. With a search length that
    starts long and is halved, matches of that length are found by comparing running
    Karp-Rabin hashes, extended token by token, and marked longest first; a match longer
    than twice the search length sets the search length to its own.
    """
    marked_item, marked_doc = bytearray(len(item)), bytearray(len(doc))
    found = []
    length = max(shortest, min(20, len(item)))
    while True:
        places = defaultdict(list)
        for at, value in _rolling(doc, marked_doc, length):
            places[value].append(at)
        matches, longest = [], 0
        for at, value in _rolling(item, marked_item, length):
            for other in places.get(value, ()):
                n = 0
                while (at + n < len(item) and other + n < len(doc)
                       and item[at + n] == doc[other + n]
                       and not marked_item[at + n] and not marked_doc[other + n]):
                    n += 1
                if n >= length:
                    matches.append((n, at, other))
                    longest = max(longest, n)
        if longest > 2 * length:
            length = longest
            continue
        for n, at, other in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            # What an earlier tile has taken shortens a match; what is left may still do.
            while n >= length and (marked_item[at + n - 1] or marked_doc[other + n - 1]):
                n -= 1
            if n < length or any(marked_item[at:at + n]) or any(marked_doc[other:other + n]):
                continue
            marked_item[at:at + n] = marked_doc[other:other + n] = b"\x01" * n
            found.append((at, other, n))
        if length <= shortest:
            return found
        length = max(shortest, length // 2)


class _Block:
    """Some benchmark items, with the places of their seeds."""

    def __init__(self, items: list[tuple], shortest: int):
        self.items = items
        self.shortest = shortest
        self.by_length = {}
        for n in {min(shortest, len(t)) for _, t in items}:
            seeds = defaultdict(list)
            for i, (_, t) in enumerate(items):
                if min(shortest, len(t)) == n:
                    for value in set(run_hashes(np.array(t, dtype=np.uint64), n).tolist()):
                        seeds[value].append(i)
            known = np.array(sorted(seeds), dtype=np.uint64)
            bits = np.zeros(1 << 20, dtype=bool)
            bits[known & np.uint64((1 << 20) - 1)] = True
            self.by_length[n] = (seeds, known, bits)

    def sharing(self, words: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """Pairs of a document and an item with a common seed; ``ends`` parts the documents."""
        hit = set()
        for n, (seeds, known, bits) in self.by_length.items():
            values = run_hashes(words, n)
            at = np.flatnonzero(bits[values & np.uint64((1 << 20) - 1)])
            at = at[np.isin(values[at], known)]
            doc = np.searchsorted(ends, at, side="right") - 1
            whole = at + n <= ends[doc + 1]
            for d, value in zip(doc[whole].tolist(), values[at[whole]].tolist()):
                hit.update((d, i) for i in seeds[value])
        return sorted(hit)


def _blocks(benchmark: DataFrame, text: str, item: str, words_per_block: int):
    """The items with words, in blocks that hold about ``words_per_block`` words each."""
    held, size = [], 0
    for row in benchmark.select(item, text).toLocalIterator():
        words = tokens(row[1]).tolist()
        if words:
            held.append((row[0], words))
            size += len(words)
        if size >= words_per_block:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
    item_text: str = "text", item: str = "item_id", shortest: int = 5, coverage: float = 0.6,
    words_per_block: int = 1_000_000,
) -> DataFrame:
    """The pairs of a document and a benchmark item of which it holds a good part.

    Columns: the document's key, the item's, ``item_tokens``, ``covered`` (tokens of the item
    in tiles), ``coverage`` and ``tiles`` (place in the item, in the document, length). A tile
    is a run of ``shortest`` equal words or more (of the whole item, if that is shorter),
    wherever it stands, so passages in another order count; a pair is reported when tiles
    cover the share ``coverage`` of the item. Texts that are null or have no word match
    nothing. Null, tied and repeated keys are reported as they are; other columns are not read.

    Whole texts are read, once per block of the benchmark. A block of about a million words
    goes to every task; larger benchmarks take more blocks, not more memory. Tiling runs only
    for pairs that share a seed: a run of ``shortest`` words.
    """
    schema = pa.schema([
        ("key", to_arrow_type(docs.schema[key].dataType)),
        ("item", to_arrow_type(benchmark.schema[item].dataType)),
        ("item_tokens", pa.int64()), ("covered", pa.int64()), ("coverage", pa.float64()),
        ("tiles", pa.list_(pa.struct([
            ("item_at", pa.int64()), ("doc_at", pa.int64()), ("length", pa.int64())])))])
    kinds = (docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString())
    ddl = (f"key {kinds[0]}, item {kinds[1]}, item_tokens long, covered long, coverage double,"
           " tiles array<struct<item_at: long, doc_at: long, length: long>>")
    spark = docs.sparkSession
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = None
    for held in _blocks(benchmark, item_text, item, words_per_block):
        shipped = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            block = _Block(shipped.value, shortest)
            for batch in batches:
                rows = []
                first = 0
                for words, ends in words_of_many(
                        ((t.as_py() or "").lower().encode("utf-8") for t in batch.column(1)), MARKS):
                    for d, i in block.sharing(words, ends):
                        item_name, item_words = block.items[i]
                        got = tiles(item_words, words[ends[d]:ends[d + 1]].tolist(),
                                    min(shortest, len(item_words)))
                        covered = sum(n for _, _, n in got)
                        if covered >= coverage * len(item_words):
                            rows.append((
                                batch.column(0)[first + d].as_py(), item_name, len(item_words),
                                covered, covered / len(item_words),
                                [{"item_at": a, "doc_at": b, "length": n} for a, b, n in got]))
                    first += len(ends) - 1
                columns = list(zip(*rows)) or [[] for _ in schema]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        part = map_batches(texts, run, ddl)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], ddl)
    return found.withColumnsRenamed({"key": key, "item": item} if key != item else {"key": key})


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text",
                    key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null key are kept unless found."""
    hits = contaminated(docs, benchmark, text, key, **options).select(
        F.col(key).alias("hit")).distinct()
    return docs.join(hits, docs[key].eqNullSafe(hits["hit"]), "left_anti")
