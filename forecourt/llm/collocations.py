"""Phrase collocations by best-first branch-and-bound growth of prefixes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecourt.llm.common import map_batches, written
from forecourt.llm.words import mixed

# A to Z become small, everything that parts pieces a line feed.
_TABLE = bytearray(range(256))
for _c in range(65, 91):
    _TABLE[_c] += 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 10
_TABLE = bytes(_TABLE)
#: Stands between pieces; no word has a capital A any more.
_GAP = b"A"

#: A sketch has a bit for each of so many hashes: 8 MB, whatever the number of phrases.
SKETCH_BITS = 26
_BLOCK = 15
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Portions of about 2 MB of text that a Python worker gets at a time.
_PORTIONS = 2

#: 2 * 1,000,000: scores are millionths of twice a phrase's count over those of its parts.
SCALE = 2_000_000


class _Numbers(dict):
    """Words numbered in the order in which they are asked for."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def _step(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a phrase and one more word."""
    return mixed(left * _ODD + right)


def sketch(phrases: DataFrame) -> bytes:
    """A set of phrases (arrays of word hashes) as bits at their hashes: it may hold more than those.

    Its size is fixed, so it can be sent to all tasks. With very many phrases it gets full,
    rules out less, and costs time, not results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            words = flat.reshape(batch.num_rows, -1).T
            found = reduce(_step, list(words)) >> np.uint64(64 - SKETCH_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["bit"])

    bits = map_batches(phrases.select("phrase"), run, "bit long")
    blocks = bits.groupBy(F.shiftright("bit", _BLOCK).alias("block")).agg(
        F.bitmap_construct_agg(F.col("bit") % (1 << _BLOCK)).alias("bits"))
    whole = bytearray(1 << (SKETCH_BITS - 3))
    size = 1 << (_BLOCK - 3)
    for row in blocks.toLocalIterator():  # at most 2,048 blocks of 4 KB
        whole[row.block * size:row.block * size + len(row.bits)] = row.bits
    return bytes(whole)


def _within(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


#: So many bytes are cut into words at a time: the words of a portion are not all held as objects.
_PIECE = 1 << 18


def _pieces(texts: Iterable[bytes], size: int = _PIECE) -> Iterator[bytes]:
    """The texts with gaps between them, in pieces of about ``size`` bytes, cut at gaps."""
    held, so_far = [], 0
    for text in texts:
        text = text.translate(_TABLE)
        while len(text) > size:
            cut = text.find(b"\n", size)
            if cut < 0:
                break
            yield text[:cut]
            text = text[cut:]
        held.append(text)
        so_far += len(text)
        if so_far >= size:
            yield b"\n".join(held)
            held, so_far = [], 0
    if held:
        yield b"\n".join(held)


def _portions(
    batches: Iterator[pa.RecordBatch], limit: int, seed: int,
) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """Portions of the texts of each language: their words, the words' hashes, and all as numbers.

    The first word stands for gaps; numbers are places in the list of words.
    """
    for batch in batches:
        by_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(batch.column(0).to_pylist()):
            by_lang.setdefault(lang, []).append(i)
        texts = batch.column(1)
        for lang, rows in by_lang.items():
            own = xxhash.xxh3_64_intdigest(lang, seed)
            numbers, parts, size = _Numbers({_GAP: 0}), [], 0

            def portion():
                names = list(numbers)
                hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, own) for w in names),
                                     dtype=np.uint64, count=len(names))
                return lang, names, hashes, np.concatenate(parts)

            for piece in _pieces(texts[i].as_py() for i in rows):
                words = piece.replace(b"\n", b" A ").split()
                parts.append(np.fromiter(
                    map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                parts.append(np.zeros(1, dtype=np.int32))
                size += len(piece)
                if size >= limit:
                    yield portion()
                    numbers, parts, size = _Numbers({_GAP: 0}), [], 0
            if parts:
                yield portion()


def word_counts(texts: DataFrame, limit: int, seed: int) -> DataFrame:
    """``lang, word, hash, n`` of all words."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("hash", pa.int64()),
                        ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, names, hashes, ids in _portions(batches, limit, seed):
            found = np.bincount(ids, minlength=len(names))[1:]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()),
                 pa.array([name.decode("utf-8") for name in names[1:]], pa.string()),
                 pa.array(hashes[1:].view(np.int64)), pa.array(found.astype(np.int64))],
                schema=schema)

    return map_batches(texts, run, "lang string, word string, hash long, n long").groupBy(
        "lang", "word", "hash").agg(F.sum("n").alias("n"))


def spelt(texts: DataFrame, frequent: bytes, limit: int, seed: int) -> DataFrame:
    """The texts in portions as numbers: ``lang, hashes, ids``, words not in ``frequent`` being gaps.

    Written once, so that texts are not cut into words for each length of phrase. ``hashes`` are
    those of the portion's words (64 bits each, the first for gaps), ``ids`` places in them (32
    bits each).
    """
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, dtype=np.uint8)
        for lang, _, hashes, ids in _portions(batches, limit, seed):
            good = _within(known, hashes)
            good[0] = False
            number = np.zeros(len(hashes), dtype=np.int32)
            number[good] = np.arange(1, good.sum() + 1, dtype=np.int32)
            ids = number[ids]
            # One gap is as good as many.
            ids = ids[(ids > 0) | np.append(True, ids[:-1] > 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([hashes[np.append(0, np.flatnonzero(good))].tobytes()]),
                 pa.array([ids.tobytes()])], ["lang", "hashes", "ids"])

    return map_batches(texts, run, "lang string, hashes binary, ids binary")


def phrase_counts(numbers: DataFrame, size: int, sets: list[bytes] = ()) -> DataFrame:
    """``phrase, n``: how often phrases of ``size`` words occur in ``spelt`` texts, exactly.

    A phrase is the array of its words' hashes, which are those of one language. ``sets`` are two sketches of phrases one word
    shorter: the first words must be in the first one, or the last words in the second. A sketch
    may let other phrases through, which are then counted, too, never counted wrong.
    """
    shared = [numbers.sparkSession.sparkContext.broadcast(s) for s in sets]
    columns = [f"w{i}" for i in range(size)]
    schema = pa.schema([*((c, pa.int64()) for c in columns), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, tails = (np.frombuffer(s.value, dtype=np.uint8) for s in shared) if shared else (
            None, None)
        for batch in batches:
            for held, own_ids in zip(*batch.columns):
                hashes = np.frombuffer(held.as_buffer(), dtype=np.uint64)
                ids = np.frombuffer(own_ids.as_buffer(), dtype=np.int32).astype(np.int64)
                count = len(ids) - size + 1
                if count <= 0:
                    continue
                good = ids > 0
                at = np.flatnonzero(
                    reduce(np.logical_and, [good[i:i + count] for i in range(size)]))
                if heads is not None and len(at):
                    def hashed(first: int) -> np.ndarray:
                        return reduce(
                            _step, [hashes[ids[at + first + i]] for i in range(size - 1)])
                    at = at[_within(heads, hashed(0)) | _within(tails, hashed(1))]
                if not len(at):
                    continue
                # Number the distinct phrases, one more word at a time.
                own, firsts = ids[at], None
                for i in range(1, size):
                    pairs = own * len(hashes) + ids[at + i]
                    _, firsts, own = np.unique(pairs, return_index=True, return_inverse=True)
                places = at[firsts]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(hashes[ids[places + i]].view(np.int64)) for i in range(size)),
                     pa.array(np.bincount(own).astype(np.int64))], schema=schema)

    counted = map_batches(
        numbers.select("hashes", "ids"), run, ", ".join(f"{c} long" for c in columns) + ", n long")
    return counted.groupBy(*columns).agg(F.sum("n").alias("n")).select(
        F.array(*columns).alias("phrase"), "n")


_COUNTS = "lang string, phrase array<long>, n long"


def _part(first: int, size: int) -> F.Column:
    return F.slice("phrase", first + 1, size)


def _score(l: F.Column, r: F.Column) -> F.Column:  # noqa: E741
    """floor(2,000,000 a / (l + r)); the product is a decimal, as it may pass 64 bits."""
    product = F.lit(SCALE).cast("decimal(7,0)") * F.col("a").cast("decimal(20,0)")
    return F.call_function(
        "div", product, l.cast("decimal(20,0)") + r.cast("decimal(20,0)")).cast("long")


def _with_counts(phrases: DataFrame, parts: dict[str, tuple[int, int]], tables: dict[int, DataFrame]):
    """Phrases with the counts of some of their parts (first word, words) beside them."""
    for name, (first, size) in parts.items():
        other = tables[size].select(
            F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias(name))
        phrases = phrases.join(
            other, (F.col("lang") == F.col("_lang")) & (_part(first, size) == F.col("_phrase")),
            "left").drop("_lang", "_phrase")
    return phrases


def scored(counts: DataFrame, size: int, tables: dict[int, DataFrame]) -> DataFrame:
    """Counted phrases (``lang, phrase, a``) with ``l, r, score`` of their lowest cut, and ``bound``.

    ``bound`` is what no phrase that begins with this one can pass: a longer one occurs at most
    as often, its first words are the same, and its other part occurs as often as itself at least.
    """
    parts = {}
    for k in range(1, size):
        parts[f"l{k}"] = (0, k)
        parts[f"r{k}"] = (k, size - k)
    found = _with_counts(counts, parts, tables)
    cuts = F.array_min(F.array(*[
        F.struct(_score(F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"),
                 F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]))
    found = found.withColumn("cut", cuts)
    bound = F.least(F.lit(SCALE // 2).cast("long"), *[
        _score(F.col(f"l{k}"), F.col("a")) for k in range(1, size)])
    return found.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", bound.alias("bound"))


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, top: int = 2000,
    longest: int = 4, covered: int = 80, first_look: int = 4, limit: int = 2 << 20,
) -> DataFrame:
    """The best phrases of 2 to ``longest`` words of each language.

    Columns: ``lang`` (null: ``und``), ``rank`` from 1, ``phrase`` (words joined by blanks), ``a``
    (its count), ``l`` and ``r`` (those of its parts at its lowest-scoring cut), ``n`` (words of
    the language) and ``score``, floor(2,000,000 a / (l + r)). Texts are lower-cased in A to Z, cut
    into pieces at ``.,;:!?`` and line breaks, and those into words at blanks and tabs. Phrases
    occur ``least`` times at least. A phrase inside a longer one that occurs ``covered`` percent as
    often goes. Ties are in the order of count, then of the phrase's bytes.
    Null and empty texts and texts without words add nothing; rows without a text count all the
    same, repeated rows count as often as they stand there. Other columns are not read. An empty
    table has no phrase.

    Growth is best first. All pairs of frequent words are counted. Their scores set each language
    a level; prefixes whose bound reaches it grow by one word, those below wait. If ``top``
    phrases that survive reach the level, no waiting prefix can give one that belongs in the
    list, as their bounds are below it, ties included. Otherwise that language's level
    falls (to four times as many phrases, at last to 0) and the next prefixes grow.

    Phrases are arrays of 64-bit hashes of words; that no two words share one is checked (or
    another seed taken), so equal arrays are equal phrases. The texts are cut into words twice, to
    count words and to be written as numbers; longer phrases are counted from those.
    Whatever holds phrases is a table. Tasks that count get sketches of sets of phrases, of
    fixed size, which only spare them counting; the sets are then applied exactly by joins. Only
    a one-word extension has to be looked at to see whether a longer phrase covers one: whatever
    covers a phrase lies in such an extension, which occurs at least as often.
    """
    spark = docs.sparkSession
    texts = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
        F.col(text).cast("binary").alias("text"))
    for seed in range(8):
        words = written(word_counts(texts, limit, seed), "words")
        shared = words.groupBy("hash").agg(F.count("*").alias("words")).where("words > 1")
        if shared.isEmpty():
            break
    else:
        raise RuntimeError("no seed gives all words hashes of their own")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= least)
    tables = {1: written(
        frequent.select("lang", F.array("hash").alias("phrase"), "n"), "frequent")}
    numbers = written(spelt(texts, sketch(tables[1]), limit, seed), "spelt")
    langs = tables[1].select("lang", F.element_at("phrase", 1).alias("_first"))

    def often(counts: DataFrame) -> DataFrame:
        """Frequent phrases with their language, which their first word tells."""
        counts = counts.where(F.col("n") >= least).withColumn("_first", F.element_at("phrase", 1))
        return counts.join(langs, "_first").select("lang", "phrase", "n")

    # The sketch may have let words through that are not frequent, but not pairs: of these there
    # are fewer still.
    tables[2] = written(often(phrase_counts(numbers, 2)), "pairs", _PORTIONS)

    def as_counts(df: DataFrame) -> DataFrame:
        return df.select("lang", "phrase", F.col("n").alias("a"))

    pairs = written(scored(as_counts(tables[2]), 2, tables), "scored")
    seen = {2: pairs}
    for size in range(3, longest + 1):
        tables[size] = spark.createDataFrame([], _COUNTS)
        seen[size] = spark.createDataFrame([], pairs.schema)
    # Languages not settled yet, with the level that prefixes must reach now, and the last one.
    settled = None
    state = totals.select(
        "lang", F.lit(SCALE).cast("long").alias("last"))
    look = first_look
    while True:
        known = reduce(DataFrame.union, seen.values())
        reach = Window.partitionBy("lang").orderBy(F.desc("score"))
        ranked = known.select("lang", "score").withColumn(
            "place", F.row_number().over(reach)).where(F.col("place") <= look * top)
        levels = ranked.groupBy("lang").agg(
            F.when(F.max("place") == look * top, F.min("score")).alias("level"))
        state = written(state.join(levels, "lang", "left").select(
            "lang", "last", F.least(F.coalesce("level", F.lit(0)), F.col("last") - 1).cast(
                "long").alias("level")), "levels")
        for size in range(3, longest + 1):
            at = seen[size - 1].join(state, "lang")
            fresh = at.where("bound >= level AND bound < last")
            newly_scored = at.where("score >= level AND score < last")
            sets = [sketch(fresh), sketch(newly_scored)]
            more = often(phrase_counts(numbers, size, sets))
            # What the sketches let through by chance is taken out.
            heads = fresh.select("lang", F.col("phrase").alias("_head"))
            tails = newly_scored.select("lang", F.col("phrase").alias("_tail"))
            more = more.withColumns({"_head": _part(0, size - 1), "_tail": _part(1, size - 1)})
            more = more.join(heads.withColumn("grown", F.lit(True)), ["lang", "_head"], "left")
            more = more.join(tails.withColumn("met", F.lit(True)), ["lang", "_tail"], "left")
            more = more.where("grown OR met").select(
                "lang", "phrase", "n", F.coalesce("grown", F.lit(False)).alias("grown"))
            more = written(more, "grown", _PORTIONS)
            tables[size] = written(
                tables[size].select("lang", "phrase", "n").union(more.select("lang", "phrase", "n"))
                .distinct(), "counted")
            grown = more.where("grown").select("lang", "phrase", F.col("n").alias("a"))
            if size > 3:
                _look_up(numbers, grown, size, tables)
            seen[size] = written(
                seen[size].union(scored(grown, size, tables)), "scored")
        best = _named(survivors(seen, tables, state, longest, covered), frequent)
        place = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        best = written(best.withColumn("rank", F.row_number().over(place).cast("long")).where(
            F.col("rank") <= top), "best")
        counted = state.join(best.groupBy("lang").agg(F.count("*").alias("found")), "lang", "left")
        ready = counted.where((F.col("level") <= 0) | (F.col("found") >= top)).select("lang")
        done = best.join(ready, "lang", "left_semi")
        settled = done if settled is None else settled.union(done)
        state = state.join(ready, "lang", "left_anti").select(
            "lang", F.col("level").alias("last"))
        if state.isEmpty():
            break
        look *= 4
    return settled.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def _look_up(numbers: DataFrame, grown: DataFrame, size: int, tables: dict) -> None:
    """Count the inner parts of grown phrases that no prefix search has met (their last words)."""
    for part in range(size - 1, 2, -1):
        wanted = grown.select("lang", _part(size - part, part).alias("phrase")).distinct()
        missing = written(wanted.join(tables[part], ["lang", "phrase"], "left_anti"), "missing")
        if missing.isEmpty():
            continue
        heads = missing.select("lang", _part(0, part - 1).alias("phrase")).distinct()
        nothing = bytes(1 << (SKETCH_BITS - 3))
        more = phrase_counts(numbers, part, [sketch(heads), nothing]).join(missing, "phrase")
        tables[part] = written(
            tables[part].union(more.select("lang", "phrase", "n")), "counted", _PORTIONS)


def _named(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """Phrases with their words instead of the words' hashes."""
    rows = phrases.select("*", F.posexplode("phrase").alias("place", "hash"))
    rows = rows.join(frequent.select("hash", "word"), "hash")
    return rows.groupBy("lang", "phrase", "a", "l", "r", "score").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias(
        "name")).drop("phrase").withColumnRenamed("name", "phrase")


def survivors(seen, tables, state, longest: int, covered: int) -> DataFrame:
    """Scored phrases that reach their language's level and that no longer one covers."""
    left = []
    for size in range(2, longest + 1):
        reached = seen[size].join(state.select("lang", "level"), "lang").where("score >= level")
        if size < longest:
            longer = tables[size + 1]
            inner = longer.select("lang", F.col("n").alias("longer"), F.explode(F.array(
                _part(0, size), _part(1, size))).alias("phrase"))
            most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
            reached = reached.join(most, ["lang", "phrase"], "left").where(
                F.col("longer").isNull()
                | (F.col("longer").cast("decimal(20,0)") * 100
                   < F.col("a").cast("decimal(20,0)") * covered))
        left.append(reached.select("lang", "phrase", "a", "l", "r", "score"))
    return reduce(DataFrame.union, left)
