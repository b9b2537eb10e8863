"""Near-duplicates by SuperMinHash signatures, banding, verification and union-find."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from forecourt.llm.common import components, forget, map_batches, written
from forecourt.llm.words import mixed, shingle_sets

_STEP = np.uint64(0xD1342543DE82EF95)
_LOW = np.uint64(32)
_FRACTION = 48
#: Sets so small that the permutations of their elements are kept: elements times values.
_DENSE = 200_000
#: Elements of small sets that are held, and of those that are worked on together.
_HELD, _TOGETHER = 1 << 17, 1 << 11


def signature(elements: np.ndarray, size: int) -> np.ndarray:
    """The SuperMinHash of a set of 64-bit hashes: ``size`` values, as whole numbers.

    Each element draws a random permutation of the places and, in step j, offers j plus a
    random fraction to the place that the permutation has at j; every place keeps its
    minimum. Ranks of one element are thus correlated, no two alike, which lowers the
    variance against independent draws. The steps of all elements run together, and end as
    soon as no place can still fall, after one or two steps for a long text. A value holds
    j in its upper bits and the fraction in the lower 48.
    """
    n = len(elements)
    least = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not n:
        return least
    rows = np.arange(n)
    # Few elements need many steps: keep their permutations. Many elements need few steps:
    # keep the swaps made so far only.
    dense = np.tile(np.arange(size, dtype=np.int32), (n, 1)) if n * size <= _DENSE else None
    swapped: list[tuple[np.ndarray, np.ndarray]] = []

    def at(place: np.ndarray) -> np.ndarray:
        found = place.copy()
        for position, value in swapped:
            hit = position == place
            found[hit] = value[hit]
        return found

    for j in range(size):
        drawn = mixed(elements + np.array([2 * j + 1], dtype=np.uint64) * _STEP)
        # The place from the lower half, the fraction from another mix.
        k = j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(size - j) >> _LOW).astype(np.int64)
        fraction = mixed(drawn ^ _STEP) >> np.uint64(64 - _FRACTION)
        if dense is not None:
            chosen = dense[rows, k]
            dense[rows, k] = dense[:, j]
        else:
            chosen, own = at(k), at(np.full(n, j))
            swapped.append((k, own))
        np.minimum.at(least, chosen, fraction | (np.uint64(j) << np.uint64(_FRACTION)))
        if least.max() >> np.uint64(_FRACTION) <= j:
            break
    return least


def _signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """The ``signature`` of each of some small sets, a row each: all take their steps together.

    A set that is done before the others falls no further, so that sets of about the same size,
    which end about the same step, cost little more than their own steps.
    """
    counts = [len(s) for s in sets]
    elements = np.concatenate(sets)
    own = np.repeat(np.arange(len(sets)) * size, counts)
    least = np.full(len(sets) * size, np.iinfo(np.uint64).max, dtype=np.uint64)
    kind = np.int16 if size <= np.iinfo(np.int16).max else np.int32
    # The permutations of all elements, one behind the other.
    dense = np.tile(np.arange(size, dtype=kind), len(elements))
    first = np.arange(len(elements)) * size
    for j in range(size):
        drawn = mixed(elements + np.array([2 * j + 1], dtype=np.uint64) * _STEP)
        k = first + j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(size - j) >> _LOW).astype(np.int64)
        fraction = mixed(drawn ^ _STEP) >> np.uint64(64 - _FRACTION)
        chosen = dense[k]
        dense[k] = dense[first + j]
        np.minimum.at(least, own + chosen, fraction | (np.uint64(j) << np.uint64(_FRACTION)))
        if least.max() >> np.uint64(_FRACTION) <= j:
            break
    return least.reshape(len(sets), size)


def signatures(sets: Iterable[np.ndarray], size: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """The signatures of many sets that are not empty, in any order: their places, and a row for each."""
    held: list[tuple[int, np.ndarray]] = []
    total = 0

    def done() -> Iterator[tuple[list[int], np.ndarray]]:
        held.sort(key=lambda one: len(one[1]))
        start = elements = 0
        for end, (_, own) in enumerate(held):
            if elements and elements + len(own) > _TOGETHER:
                yield [i for i, _ in held[start:end]], _signatures([s for _, s in held[start:end]], size)
                start, elements = end, 0
            elements += len(own)
        if held:
            yield [i for i, _ in held[start:]], _signatures([s for _, s in held[start:]], size)

    for i, own in enumerate(sets):
        if not len(own):
            continue
        if len(own) * size > _DENSE:
            yield [i], signature(own, size)[None]
            continue
        held.append((i, own))
        total += len(own)
        if total >= _HELD:
            yield from done()
            held, total = [], 0
    yield from done()


def band_keys(values: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values, of one signature or of each row of many; keys of
    different bands differ."""
    bands = values.reshape(*values.shape[:-1], -1, rows)
    total = np.arange(1, bands.shape[-2] + 1, dtype=np.uint64) * _STEP
    for i in range(rows):
        total = mixed(total ^ bands[..., i]) + _STEP
    return total.view(np.int64)


def _set_hash(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def _signed(docs: DataFrame, text: str, key: str, bands: int, rows: int, words: int) -> DataFrame:
    """Per row: the key, its number of shingles, the hash of their set, and the band keys."""
    schema = pa.schema([
        ("key", to_arrow_type(docs.schema[key].dataType)), ("n", pa.int64()), ("s", pa.int64()),
        ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes, keys = [], [], [[]] * len(batch)

            def noted() -> Iterator[np.ndarray]:
                for shingles in shingle_sets((v.as_py() for v in batch.column(1)), words):
                    sizes.append(len(shingles))
                    hashes.append(_set_hash(shingles))
                    yield shingles

            for places, values in signatures(noted(), bands * rows):
                for place, own in zip(places, band_keys(values, rows)):
                    keys[place] = own
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.int64()),
                 pa.array(keys, schema[3].type)], schema=schema)

    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return map_batches(
        texts, run, f"key {kind}, n long, s long, bands array<long>")


def _shingles(docs: DataFrame, words: int) -> DataFrame:
    """The set hash and the sorted set (binary, 8 bytes each) of each text."""
    schema = pa.schema([("s", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shingles in shingle_sets((v.as_py() for v in batch.column(0)), words):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_hash(shingles)], pa.int64()),
                     pa.array([shingles.tobytes()], pa.binary())], schema=schema)

    return map_batches(docs.select("text"), run, "s long, items binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets overlap by ``percent`` of their union or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column(2), batch.column(3)):
                x = np.frombuffer(one.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(two.as_buffer(), dtype=np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                spot = np.searchsorted(y, x)
                common = int(np.count_nonzero(y[np.minimum(spot, len(y) - 1)] == x))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], schema=schema).filter(pa.array(keep))

    joined = pairs.join(sets.withColumnsRenamed({"s": "a", "items": "x"}), "a").join(
        sets.withColumnsRenamed({"s": "b", "items": "y"}), "b")
    return map_batches(
        joined.select("a", "b", "x", "y"), run, "a long, b long").distinct()


#: Sizes of sets fall into classes, each ten percent wide.
_WIDTH = math.log(1.1)


def _needed(n: np.ndarray | int, other: int, percent: int):
    """How many shingles sets of these sizes must share."""
    return np.ceil(percent / (100 + percent) * (n + other) - 1e-6)


_ENTRIES = pa.schema([(name, pa.int64()) for name in (
    "t", "low", "high", "s", "n", "c", "g", "i", "after", "mask")])


def _prefixes(percent: int):
    """Of each set (s, n, c, its shared shingles in order): an entry per class and shingle of its prefix."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, n, c, ts in zip(*batch.columns):
                s, n, c = s.as_py(), n.as_py(), c.as_py()
                shared = ts.values.to_numpy(zero_copy_only=False)
                bits = np.left_shift(np.int64(1), shared & 63)
                before = np.concatenate(([0], np.bitwise_or.accumulate(bits)[:-1])).astype(np.int64)
                g = math.floor(math.log(n) / _WIDTH)
                parts = []
                smallest, largest = -(-n * percent // 100), n * 100 // percent
                for h in range(math.floor(math.log(smallest) / _WIDTH) - 1,
                               math.floor(math.log(largest) / _WIDTH) + 2):
                    least = max(smallest, math.floor(math.exp(h * _WIDTH)) - 1)
                    room = max(0, len(shared) - int(_needed(n, least, percent)) + 1)
                    i = np.arange(min(room, len(shared)))
                    fill = [np.full(len(i), v) for v in (min(g, h), max(g, h), s, n, c, g)]
                    parts.append([shared[i], *fill, i, len(shared) - 1 - i, before[i]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)],
                    schema=_ENTRIES)

    return run


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of nodes ``s, n, c`` with different ``c`` that may overlap by ``percent``.

    With every set in the order of how many nodes have a shingle, rarest first, two sets that
    share k or more have one of their first n - k + 1 shingles in common; k follows from both
    sizes, so the prefixes are cut for each class of partner's sizes. Shingles of one node
    only come first and pair with nothing; they are counted, not kept. A pair is made at a
    shingle only if those behind it in both sets, and those before it, suffice; where a mask
    of 64 bits tells that nothing before it is shared, those behind it alone must.
    """
    schema = pa.schema([("s", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("t", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, n, c, items in zip(*batch.columns):
                shingles = np.frombuffer(items.as_buffer(), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(shingles), v.as_py())) for v in (s, n, c)]
                    + [pa.array(shingles)], schema=schema)

    shingles = written(map_batches(
        nodes.join(sets.dropDuplicates(["s"]), "s").select("s", "n", "c", "items"), run,
        "s long, n long, c long, t long"), "shingles")
    often = shingles.groupBy("t").agg(F.count("*").alias("f")).where("f > 1")
    ranked = shingles.join(often, "t").groupBy("s", "n", "c").agg(
        F.sort_array(F.collect_list(F.struct("f", "t"))).alias("ts"))
    prefix = written(map_batches(
        ranked.select("s", "n", "c", F.col("ts.t").alias("ts")), _prefixes(percent),
        ", ".join(f"{name} long" for name in _ENTRIES.names)), "prefixes")
    forget(shingles)
    across = prefix.groupBy("t", "low", "high").agg(
        F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").drop("x", "y")
    kept = prefix.join(across, ["t", "low", "high"], "left_semi")

    def side(name: str) -> DataFrame:
        return kept.select("t", "low", "high", *[
            F.col(x).alias(name + x) for x in ("s", "n", "c", "g", "i", "after", "mask")])

    # Entries of one class meet entries of the other; a class of its own meets itself.
    classes = (F.col("ag") + F.col("bg")) == (F.col("low") + F.col("high"))
    before = F.when(F.expr("amask & bmask") == 0, 0).otherwise(F.least("ai", "bi"))
    needed = F.ceil(percent / (100 + percent) * (F.col("an") + F.col("bn")) - 1e-6)
    return side("a").join(side("b"), ["t", "low", "high"]).where(
        (F.col("as") < F.col("bs")) & (F.col("ac") != F.col("bc")) & classes
        & (before + 1 + F.least("aafter", "bafter") >= needed)).select(
        F.col("as").alias("a"), F.col("bs").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = 75,
    words: int = 5, bands: int = 64, rows: int = 6,
) -> DataFrame:
    """Every row's key with ``n_shingles``, ``component_id`` and ``kept``.

    Two texts are linked if the sets of their ``words``-word shingles (A to Z lower-cased, cut
    at blanks and \\x09-\\x0D; a shorter text is one shingle) overlap by ``percent`` of their
    union; a component is what links reach, its id the smallest key in it. Texts without a
    word, null or empty, are linked with nothing. Rows with a null key take part, but name a
    component only if it has no other key (then null); ``kept`` is whether the row's key is
    that of its component, nulls included. Repeated rows are documents of their own.

    Texts with the same set are one node from the start, so copies are never paired. Nodes
    that agree in all ``rows`` values of a band share a bucket (at 75 % overlap and the
    defaults, a pair shares none with a chance of 4 in a million). In a bucket, each
    member is compared on the full sets with the one that meets the most others over all
    buckets, usually the text that the others are copies of; this joins a group of near
    copies in as many comparisons as it has members. Members of buckets that then still
    hold different components go on to a prefix join: of each set, only the rarest quarter of
    shingles can witness a link, so texts that share no more than a common passage are not
    paired. No partner or candidate is left out.
    """
    signed = written(_signed(docs, text, key, bands, rows, words), "signatures")
    nodes = signed.where("n > 0").groupBy("s").agg(
        F.first("n").alias("n"), F.first("bands").alias("bands"))
    slots = nodes.select("s", "n", F.explode("bands").alias("bucket"))
    sizes = slots.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    met = written(slots.join(sizes, "bucket"), "buckets")
    # The text the others are copies of meets the most others; it leads its buckets.
    weight = met.groupBy("s").agg(F.sum("members").alias("weight"))
    ranked = met.drop("members").join(weight, "s")
    heads = ranked.groupBy("bucket").agg(F.max(F.struct("weight", "s", "n")).alias("head"))
    shared = written(ranked.join(heads, "bucket").select(
        "bucket", "s", "n", F.col("head.s").alias("h"), F.col("head.n").alias("hn")), "shared")

    def fits(a: str, b: str) -> F.Column:
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    stars = written(shared.where("s <> h").where(fits("n", "hn")).select(
        F.least("h", "s").alias("a"), F.greatest("h", "s").alias("b")).distinct(), "stars")
    # The texts of nodes that share a bucket, one per node.
    wanted = shared.select("s").distinct()
    one = signed.select("s", "key").join(wanted, "s", "left_semi").groupBy("s").agg(
        F.min("key").alias("key"))
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    its = one.select(F.col("key").alias("its")).distinct()
    chosen = named.join(its, F.col("key").eqNullSafe(F.col("its")), "left_semi")
    sets = written(_shingles(chosen, words).join(wanted, "s", "left_semi"), "sets")
    links = written(_confirmed(stars, sets, percent), "links")
    known = written(components(links), "components")
    placed = shared.join(known.withColumnRenamed("node", "s"), "s", "left").select(
        "bucket", "s", "n", F.coalesce("component", "s").alias("c"))
    open_ = placed.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where(
        "x <> y").select("bucket")
    rest = written(placed.join(open_, "bucket", "left_semi").select("s", "n", "c").distinct(), "open")
    across = _prefix_pairs(rest, sets, percent).join(stars, ["a", "b"], "left_anti")
    more = _confirmed(across, sets, percent)
    known = components(links.union(more))
    ends = signed.select("key", "n", "s").join(
        known.withColumnRenamed("node", "s"), "s", "left").withColumn(
        "c", F.when(F.col("n") > 0, F.coalesce("component", "s")))
    # A text with a link, or with copies, takes the smallest key of its component.
    lowest = ends.where("n > 0").groupBy("c").agg(F.min("key").alias("lowest"))
    full = ends.where("n > 0").join(lowest, "c").select("key", "n", "lowest").union(
        ends.where("n = 0").select("key", "n", F.col("key").alias("lowest")))
    return full.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.col("lowest").alias("component_id"), F.col("key").eqNullSafe(F.col("lowest")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest key; rows without words stay."""
    kept = near_duplicates(docs, text, key).where("kept").select(
        F.col(key).alias("kept_key")).distinct()
    return docs.join(kept, docs[key].eqNullSafe(kept["kept_key"]), "left_semi")
