"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from forecourt.llm.decontaminate import clean_documents, contaminated
from forecourt.llm.exact_dedup import exact_duplicates
from forecourt.llm.license_scan import license_notices
from forecourt.llm.line_dedup import drop_repeated_chunks
from forecourt.llm.packing import pack
from forecourt.llm.quality import classify, drop_low_quality
from forecourt.llm.sharding import shuffle_into_shards
from forecourt.llm.suffix_dedup import repeated_bytes
from forecourt.llm.super_minhash import drop_near_duplicates, near_duplicates
from forecourt.llm.warc_zip import round_trip

TOKENIZER = "byte_bpe_50k.json"


def _path():
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def test_shards(odd, none):
    rows = shuffle_into_shards(odd, 5, rows_per_partition=4).collect()
    assert len(rows) == odd.count()
    assert rows[0]["shard"] == "own shard"
    sizes = Counter(r["_shard"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["_slot"] for r in rows if r["_shard"] == shard) == list(range(n))
    again = shuffle_into_shards(odd.repartition(7), 5, rows_per_partition=4).collect()
    place = lambda rs: sorted((str(r.doc_id), str(r.text), r["_shard"], r["_slot"]) for r in rs)
    assert place(rows) == place(again)
    assert shuffle_into_shards(none, 5).collect() == []


def test_exact(odd, none):
    rows = exact_duplicates(odd, capacity=2).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.text_sha256): r for r in rows}
    alpha = hashlib.sha256(b"Alphabetagammadeltaepsilonzeta").hexdigest()
    assert {k[0] for k in by if k[1] == alpha} == {1, 5, -3}
    # All have 35 points but the one with two blanks, which has 36.
    assert {by[k].keep_id for k in by if k[1] == alpha} == {-3}
    empty = hashlib.sha256(b"").hexdigest()
    assert by[(2, empty)].group_size == 5 and by[(2, empty)].keep_id == 14
    assert by[(None, empty)].kept is False
    assert sum(r.kept for r in rows if r.doc_id == 8) == 0 and by[(6, by_passage(rows))].kept
    assert exact_duplicates(none).collect() == []


def by_passage(rows):
    return next(r.text_sha256 for r in rows if r.doc_id == 6)


def test_lines(odd, none):
    frame = drop_repeated_chunks(odd)
    rows = frame.collect()
    assert len(rows) == odd.count() and rows[0]["lines"] == "own lines"
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[6][0]["_lines_removed"] == 0
    assert by[7][0]["_lines_removed"] >= 6 and by[7][0].text.startswith("before")
    assert [r.text for r in by[8]] == [None, None]
    assert by[2][0].text is None and by[3][0].text == "" and by[9][0]["_lines"] == 1
    assert drop_repeated_chunks(none).collect() == []


def test_near(odd, none):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert {r.component_id for r in by[1]} == {-3}
    assert {r.n_shingles for r in by[2] + by[3] + by[4]} == {0}
    assert {r.component_id for r in by[2] + by[3] + by[4]} == {2, 3, 4}
    assert by[10][0].component_id == 9 and by[8][0].component_id == 6
    assert by[17][0].kept and not by[18][0].kept
    assert {r.kept for r in by[None]} == {True}
    left = drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in rows if r.kept}
    assert near_duplicates(none).collect() == []


def test_near_without_keys(spark):
    long, other = (" ".join(f"{x}{i * i % 7919}" for i in range(300)) for x in "ab")
    docs = spark.createDataFrame(
        [(4, long), (None, long + " more"), (None, other), (None, other + " more"), (9, "far off")],
        "doc_id long, text string")
    rows = near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter(
        {(4, 4, True): 1, (None, 4, False): 1, (None, None, True): 2, (9, 9, True): 1})


def test_near_pairs_left_in_open_buckets(spark):
    """A chain and a common passage: every link is found, whichever member leads a bucket."""
    import random

    draw = random.Random(4)
    passage = [f"p{i}" for i in range(70)]
    texts = []
    for i in range(40):
        own = [f"o{i}x{j}" for j in range(draw.choice([12, 20, 25, 60]))]
        texts.append(passage + own)
    base = [f"c{i}" for i in range(120)]
    for step in range(30):
        texts.append(base[step * 3:step * 3 + 60])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)],
                                 "doc_id long, text string")
    sets = [{tuple(t[k:k + 5]) for k in range(len(t) - 4)} for t in texts]
    lowest = list(range(len(texts)))

    def root(x):
        while lowest[x] != x:
            x = lowest[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                lowest[y] = x
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == {
        i: root(i) for i in range(len(texts))}


def test_quality(spark, odd, none):
    labels = spark.createDataFrame(
        [(i, int(i > 8), 0) for i in range(1, 20)] + [(None, 1, 0), (5, None, 0), (99, 1, 1), (6, 7, 0)],
        "doc_id long, quality int, toxic int")
    rows = classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in classify(odd, labels.where("false")).collect()} == {0.5}
    kept = drop_low_quality(odd, labels)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r.predicted for r in rows)
    assert classify(none, labels).collect() == [] and drop_low_quality(none, labels).collect() == []


def test_suffixes(odd, none):
    rows = repeated_bytes(odd).collect()
    assert len(rows) == odd.count()
    texts = sorted(
        ((r.doc_id is None, r.doc_id or 0, i, (r.text or "").encode(), r.doc_id)
         for i, r in enumerate(odd.collect())), key=lambda t: t[:3])
    seen, expected = {}, Counter()
    for absent, number, _, data, key in texts:
        gone = 0
        mask = bytearray(len(data))
        for i in range(len(data) - 99):
            window = hashlib.blake2b(data[i:i + 100], digest_size=12).digest()
            first = seen.setdefault(window, (absent, number, i))
            if first < (absent, number, i):
                mask[i:i + 100] = b"\1" * 100
        gone = sum(mask)
        expected[(key, len(data), gone)] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed) for r in rows) == expected
    hot = repeated_bytes(odd, hot=2, broadcast_bytes=0).collect()
    assert Counter((r.doc_id, r.n_removed, bytes(r.kept)) for r in hot) == Counter(
        (r.doc_id, r.n_removed, bytes(r.kept)) for r in rows)
    assert repeated_bytes(none).collect() == []


def test_packing(odd, none):
    rows = pack(odd, _path()).collect()
    assert sum(r.start == 0 for r in rows) == odd.count()
    assert {(r.length, bytes(r.ids)) for r in rows if r.doc_id == 2} == {(1, b"\1\0\0\0")}
    special = next(r for r in rows if r.doc_id == 19)
    assert bytes(special.ids[:4]) == (50256).to_bytes(4, "little")
    assert pack(none, _path()).collect() == []


def test_contamination(spark, odd, none):
    words = [f"word{i}" for i in range(40)]
    bench = spark.createDataFrame(
        [(1, " ".join(words)), (2, None), (3, ""), (4, "tiny item"), (4, "tiny item"), (None, "x y z")],
        "item_id long, text string")
    mixed = " ".join(words[20:] + ["filler"] * 30 + words[:20])
    own = odd.limit(0).select("doc_id", "text", "kept").union(spark.createDataFrame(
        [(1, mixed, "k"), (2, " ".join(words[:20]), "k"), (3, "a TINY, item here", "k"),
         (None, "x y z", "k"), (4, None, "k"), (4, "", "k")], "doc_id long, text string, kept string"))
    rows = contaminated(own, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (3, 4), (None, None)}
    assert next(r for r in rows if r.doc_id == 1).coverage == 1.0
    small = contaminated(own, bench, words_per_block=1).collect()
    assert Counter(map(str, small)) == Counter(map(str, rows))
    assert sorted(r.doc_id for r in clean_documents(own, bench).collect()) == [2, 4, 4]
    assert contaminated(none, bench).collect() == []
    assert contaminated(own, bench.where("false")).collect() == []
    assert clean_documents(odd, bench).columns == odd.columns


def test_licenses(odd, none):
    assert [(r.doc_id, r.license) for r in license_notices(odd).collect()] == [(16, "Apache-2.0")]
    assert license_notices(none).collect() == []


def test_archives(spark):
    pages = spark.createDataFrame(
        [(1, "http://a", b"same"), (2, None, b"same"), (2, "http://b", b"same"), (3, "http://c\r\nX: y", b""),
         (4, "http://d", None), (None, "http://e", b"same"), (5, "http://f", b"\x00\r\n\r\n" * 300_000)],
        "page_id long, url string, payload binary")
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes)
           for r in round_trip(pages.withColumn("sha", F.lit("own"))).collect()}
    assert got == {(1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0),
                   (4, "response", None, 0), (None, "response", None, 4),
                   (5, "response", None, 1_500_000)}
    kinds = {r.page_id: r.record_type for r in round_trip(pages, min_bytes=5).collect()}
    assert set(kinds.values()) == {"response"}
    assert round_trip(pages.where("false")).collect() == []
