"""The parts of the operators: sorting, signatures, matrices, tiles, archives."""

import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forecourt.llm.common import components
from forecourt.llm.decontaminate import tiles
from forecourt.llm.exact_dedup import directory
from forecourt.llm.license_scan import TEMPLATES, judge
from forecourt.llm.packing import differencing, encoder, windows_for
from forecourt.llm.sharding import communication_matrix, hypergeometric
from forecourt.llm.suffix_dedup import equal_windows, suffix_order
from forecourt.llm.super_minhash import band_keys, signature, signatures
from forecourt.llm.warc_zip import members
from forecourt.llm.words import shingle_set


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.sampled_from([3, 4, 9, 10, 100]))
def test_suffix_order(symbols, depth):
    order = suffix_order(np.array(symbols, dtype=np.int64), depth)
    assert sorted(order.tolist()) == list(range(len(symbols)))
    cut = [tuple(symbols[i:i + depth]) for i in order]
    assert cut == sorted(cut)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=12, max_size=300).map(lambda b: bytes(97 + x % 2 for x in b)))
def test_equal_windows(data):
    begins = np.arange(len(data) - 11)
    classes = equal_windows(np.frombuffer(data, dtype=np.uint8), begins, 12)
    names = {}
    for i, c in zip(begins.tolist(), classes.tolist()):
        names.setdefault(c, set()).add(data[i:i + 12])
    assert all(len(found) == 1 for found in names.values())
    assert len(set().union(*names.values())) == len(names)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 8))
def test_differencing_deals_every_item_once(sizes, windows):
    found = differencing(sizes, windows)
    assert sorted(i for items in found for i in items) == list(range(len(sizes)))


def test_windows_rise_with_the_need():
    found = windows_for([60] * 5, 100)
    assert len(found) == 5 and all(len(items) == 1 for items in found)
    sums = [sum(items) for items in windows_for(list(range(1, 100)), 1000)]
    assert len(sums) >= 5


@settings(max_examples=100, deadline=None)
@given(st.text())
def test_encoder_gives_the_tokenizers_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    slow = _slow.setdefault(path, Tokenizer.from_file(path)) if path not in _slow else _slow[path]
    assert encoder(path)(text) == slow.encode(text, add_special_tokens=False).ids


_slow: dict = {}


def test_other_tokenizers_go_through_the_library():
    import public_tokenizers

    assert encoder(public_tokenizers.path("word_bpe_49k.json"))("Some words") != []


@pytest.mark.parametrize("good, bad, drawn", [(5, 7, 4), (1, 0, 1), (0, 3, 2), (30, 30, 60)])
def test_hypergeometric_has_its_law(good, bad, drawn):
    from math import comb

    rng = np.random.default_rng(5)
    found = np.bincount([hypergeometric(rng, good, bad, drawn) for _ in range(4000)],
                        minlength=drawn + 1)
    for k, n in enumerate(found):
        p = comb(good, k) * comb(bad, drawn - k) / comb(good + bad, drawn) if drawn >= k else 0
        assert abs(n / 4000 - p) < 0.04


def test_hypergeometric_of_very_large_counts():
    rng = np.random.default_rng(1)
    drawn = [hypergeometric(rng, 2 * 10**9, 30 * 10**9, 100_000) for _ in range(200)]
    assert abs(np.mean(drawn) - 6250) < 30 and 60 < np.std(drawn) < 95


def test_matrix_margins():
    matrix = communication_matrix([10, 0, 7, 15], [8, 8, 8, 8], seed=2)
    assert matrix.sum(axis=1).tolist() == [10, 0, 7, 15]
    assert matrix.sum(axis=0).tolist() == [8, 8, 8, 8] and (matrix >= 0).all()


@pytest.mark.parametrize("n", [1, 5, 300, 2000])
def test_signatures_estimate_the_overlap(n):
    rng = np.random.default_rng(n)
    both = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
    close = [np.mean(signature(both[:2 * n] ^ np.uint64(i), 256)
                     == signature(both[n:] ^ np.uint64(i), 256)) for i in range(20)]
    assert abs(np.mean(close) - 1 / 3) < 0.05


def test_signature_is_a_plain_super_minhash():
    """The vectorised signature against one element after the other."""
    rng = np.random.default_rng(9)
    elements = rng.integers(0, 2**63, 700, dtype=np.uint64)
    alone = [signature(elements[i:i + 1], 64) for i in range(700)]
    assert (signature(elements, 64) == np.min(alone, axis=0)).all()
    assert sorted((alone[0] >> np.uint64(48)).tolist()) == list(range(64))


def test_shingles():
    assert len(shingle_set(None)) == len(shingle_set(" \t\n")) == 0
    assert (shingle_set("A b C d E") == shingle_set("a  B\tc D e")).all()
    assert len(shingle_set("a b c d e f")) == 2 and len(shingle_set("a b")) == 1
    assert shingle_set("É a b c d")[0] != shingle_set("é a b c d")[0]
    joined = shingle_set("word " * 500_000 + "end")
    assert len(joined) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=40))
def test_tiles_are_equal_and_apart(item, doc):
    found = tiles(item, doc, 3)
    used_item, used_doc = set(), set()
    for a, b, n in found:
        assert n >= 3 and item[a:a + n] == doc[b:b + n]
        assert not used_item & set(range(a, a + n)) and not used_doc & set(range(b, b + n))
        used_item |= set(range(a, a + n))
        used_doc |= set(range(b, b + n))
    # Nothing of the shortest length is left unmarked on both sides.
    for a in range(len(item) - 2):
        for b in range(len(doc) - 2):
            if item[a:a + 3] == doc[b:b + 3]:
                assert used_item & {a, a + 1, a + 2} or used_doc & {b, b + 1, b + 2}


def test_license_wording():
    def name(block):
        won = judge(block, TEMPLATES, 3, 4, 0.2, 0.3)
        return won and won[0]

    for spdx, wording in TEMPLATES:
        assert name(wording) == spdx
    assert name(TEMPLATES[1][1].upper().replace(" ", "\n * ")) == "Apache-2.0"
    assert name("This work is licensed under the GNU General Public License, version 2.") is None
    assert name("A license to fish in this lake is sold at the shop.") is None


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("wide", [False, True])
def test_zip_members(monkeypatch, wide):
    if wide:  # as if every count, size and place overflowed
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 1)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 0)
    out = _File()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("a.txt", b"first")
        archive.writestr("indexes/ü.cdx", b"second member")
        archive.comment = b"a comment PK\x05\x06 with a mark"
    found = members(out)
    assert [m.name for m in found] == ["a.txt", "indexes/ü.cdx"]
    for m, data in zip(found, (b"first", b"second member")):
        assert out.getvalue()[m.start:m.start + m.size] == data and m.method == 0
    with pytest.raises(ValueError):
        members(_File(b"not an archive"))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (300, -5)]
    links += [(1000, 1000 + i) for i in range(1, 200)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(5)
    found = {r.node: r.component for r in components(frame).collect()}
    assert {found[i] for i in range(41)} == {0}
    assert found[95] == found[100] == 90 and found[300] == found[-5] == -5 and 1100 in found
    assert found[1150] == 1000 and components(frame.where("false")).collect() == []


def test_directory_splits_overfull_buckets(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    rows, depth = directory(keys, 100)
    found = rows.collect()
    assert len(found) == len({r.slot for r in found}) <= 2**depth
    slots = keys.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("slot")).count()
    loads = slots.join(rows, "slot").groupBy("bucket", "local_depth").agg(F.sum("count").alias("n"))
    assert max(r.n for r in loads.collect()) <= 100


def test_written_tables_hand_python_few_rows_at_a_time(spark):
    import pyarrow as pa

    from forecourt.llm.common import map_batches, written

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    rows = spark.range(0, 5000, 1, 1)
    found = [r.n for r in written(map_batches(rows, sizes, "n long"), "sizes", 300).collect()]
    assert sum(found) == 5000 and max(found) <= 300
    assert spark.conf.get(name) == before


def test_cut_texts_leave_in_portions():
    """A batch of long texts is not held as a whole a second time."""
    import pyarrow as pa

    from forecourt.llm.suffix_dedup import _TOGETHER, _cut

    text = "x" * (_TOGETHER // 2)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(6)), pa.array([text] * 6), pa.array([None] * 6, pa.binary())],
        ["key", "text", "spans"])
    out = list(_cut(pa.int64())(iter([batch])))
    assert len(out) > 1 and sum(b.num_rows for b in out) == 6
    assert [k for b in out for k in b.column(0).to_pylist()] == list(range(6))


def test_signatures_of_many_sets_are_those_of_each():
    """Op7: small sets take their steps together, in groups of about one size; large ones alone."""
    rng = np.random.default_rng(7)
    sizes = [0, 1, 1, 2, 5, 700, 0, 40, 520, 521, 300, *rng.integers(1, 200, 40).tolist()]
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in sizes]
    found = {}
    for places, values in signatures(iter(sets), 384):
        assert len(places) == 1 or sum(sizes[i] for i in places) <= 2048
        found.update(zip(places, zip(values, band_keys(values, 6))))
    assert sorted(found) == [i for i, n in enumerate(sizes) if n]
    for i, (values, keys) in found.items():
        alone = signature(sets[i], 384)
        assert (values == alone).all() and (keys == band_keys(alone, 6)).all()
