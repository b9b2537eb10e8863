"""Packing token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from forecourt.llm.common import map_batches


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items by window, with near-equal sums: multiway largest differencing.

    Each item starts as a partial partition: itself in one window, the others empty. The two
    partial partitions whose sums differ most are merged with their imbalances opposed, the
    largest window of one with the smallest of the other, until one is left.
    """
    heap = [(-size, i, [0] * (windows - 1) + [size], [None] * (windows - 1) + [i])
            for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for serial in range(len(sizes), 2 * len(sizes) - 1):
        _, _, sums, members = heapq.heappop(heap)
        _, _, other_sums, other_members = heapq.heappop(heap)
        sums = [a + b for a, b in zip(sums, reversed(other_sums))]
        # Members are kept as nested pairs and unfolded once at the end.
        members = [b if a is None else a if b is None else (a, b)
                   for a, b in zip(members, reversed(other_members))]
        order = sorted(range(windows), key=sums.__getitem__)
        least = sums[order[0]]
        sums = [sums[i] - least for i in order]
        heapq.heappush(heap, (-sums[-1], serial, sums, [members[i] for i in order]))
    found = []
    for tree in heap[0][3] if heap else []:
        items, stack = [], [tree]
        while stack:
            top = stack.pop()
            if isinstance(top, tuple):
                stack.extend(top)
            elif top is not None:
                items.append(top)
        found.append(sorted(items))
    return found


def windows_for(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few near-equal windows as hold the items; no item may exceed the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, windows)
        if all(sum(sizes[i] for i in items) <= capacity for items in found):
            return found
        windows += 1


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids under the tokenizer in ``path``, without special ids added.

    For a plain byte-level BPE (no normalizer, GPT-2's split pattern, merges in the order of
    ids), the ranks are read from the file and applied by tiktoken, which gives the same ids
    several times faster; any other file is used through ``tokenizers`` itself.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]] \
        if model.get("type") == "BPE" else []
    vocab = model.get("vocab", {})
    letters = _byte_letters()
    added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    plain = (
        model.get("type") == "BPE" and not spec.get("normalizer")
        and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
        and split.get("use_regex", True) and not model.get("dropout")
        and not model.get("ignore_merges") and not model.get("end_of_word_suffix")
        and [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges)))
        and all(vocab.get(letter, 256) < 256 for letter in letters)
        and all(not (t["single_word"] or t["lstrip"] or t["rstrip"])
                for t in spec.get("added_tokens", []))
    )
    if not plain:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    back = {letter: byte for letter, byte in letters.items()}
    ranks = {bytes(back[c] for c in token): rank for token, rank in vocab.items()
             if token not in added}
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)

    # The pattern's look-ahead needs a stack as deep as a run of blanks is long. In a very long
    # one, the pattern always ends before the last blank that something follows, so what is before
    # that is encoded by itself, without the look-ahead.
    blanks = tiktoken.Encoding(
        "blanks", pat_str=r"\s+", mergeable_ranks=ranks, special_tokens=added)
    marks = re.compile("(%s)" % "|".join(
        re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

    def in_parts(text: str) -> list[int]:
        ids, at = [], 0
        for run in _LONG_BLANKS.finditer(text):
            start, end = run.span()
            if end < len(text):
                end -= 1
            ids += fast.encode_ordinary(text[at:start])
            ids += blanks.encode_ordinary(text[start:end])
            at = end
        return ids + fast.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        if len(text) >= _LONG and _LONG_BLANKS.search(text):
            ids = []
            for part in marks.split(text) if marks else [text]:
                ids += [added[part]] if part in added else in_parts(part)
            return ids
        if any(token in text for token in added):
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    return encode


#: From this length on, runs of blanks (what Unicode calls white space) are taken out first.
_LONG = 50_000
_LONG_BLANKS = re.compile(
    "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _LONG)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id",
    window: int = 2048, end_id: int = 1, piece: int = 512, windows_per_group: int = 32,
    slack: int = 32,
) -> DataFrame:
    """Every document's tokens in windows of at most ``window`` ids, one row per piece.

    Columns: the key, ``start`` (ids of the document before the piece), ``length``, ``ids``
    (binary, little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and ``offset``
    (place in the sequence, gapless from 0). A document is its ids and then ``end_id``; a
    null text counts as empty, so it is ``end_id`` alone. Nulls, ties and repeats of the key
    do no harm: each row is a document of its own. Other columns are not read.

    Whole windows are cut off the front of long documents. What remains is gathered until it
    nearly fills ``windows_per_group`` windows (``slack`` ids short on average; the last
    document is cut there), is cut into pieces of at most ``piece`` ids, and dealt out by
    differencing; if a window exceeds its size, the group gets one more. All happens in the
    task that reads the documents, which holds one group and one document at a time; nothing
    is shuffled, and a task that is run again replaces its output as a whole. Sequence ids
    hold the partition in their upper bits. Each task's last group may be short.
    """
    kind = to_arrow_type(docs.schema[key].dataType)
    schema = pa.schema([
        ("key", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    target = windows_per_group * (window - slack)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 33
        group: list[tuple] = []  # (key, first id, ids, tokens of the document)
        held = 0
        out: list[list] = [[] for _ in schema]

        def emit(name, start, ids, total, sequence, offset):
            for column, value in zip(
                    out, (name, start, len(ids), ids.tobytes(), total, sequence, offset)):
                column.append(value)

        def flush():
            nonlocal group, held, serial
            parts = [(name, start + i, ids[i:i + piece], total) for name, start, ids, total in group
                     for i in range(0, len(ids), piece)]
            for members in windows_for([len(p[2]) for p in parts], window):
                offset = 0
                for i in members:
                    name, start, ids, total = parts[i]
                    emit(name, start, ids, total, serial, offset)
                    offset += len(ids)
                serial += bool(members)
            group, held = [], 0

        for batch in batches:
            for name, words in zip(batch.column(0), batch.column(1)):
                name, words = name.as_py(), words.as_py()
                ids = array("I", encode(words or ""))
                ids.append(end_id)
                total, at = len(ids), 0
                while total - at >= window:
                    emit(name, at, ids[at:at + window], total, serial, 0)
                    serial += 1
                    at += window
                while at < total:
                    taken = ids[at:at + target - held]
                    group.append((name, at, taken, total))
                    held += len(taken)
                    at += len(taken)
                    if held >= target:
                        flush()
                if len(out[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in schema]
        if group:
            flush()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    spark_kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = map_batches(
        texts, run, f"key {spark_kind}, start long, length long, ids binary, doc_tokens long,"
        " sequence_id long, offset long")
    return rows.withColumnRenamed("key", key)
