"""Registered queries against their SQL or against brute force, on the smallest tables."""

import zlib
from collections import Counter

import pytest

from checks.compare import _rows, tables
from forecourt.llm.queries import LLM_ORACLES, LLM_QUERIES


@pytest.fixture(scope="module")
def connection(sf_dir):
    return tables(sf_dir)


@pytest.fixture(scope="module")
def texts(connection):
    return dict(connection.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", list(LLM_ORACLES))
def test_query_matches_its_sql(spark, connection, sf_dir, name):
    got = LLM_QUERIES[name](spark, sf_dir)
    expected = connection.sql(LLM_ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert _rows(got.columns, got.collect()) == _rows(expected.columns, expected.fetchall())


def test_sharding(spark, sf_dir, texts):
    rows = LLM_QUERIES["op2_sharding"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by = Counter(r.shard for r in rows)
    assert set(by) == set(range(16)) and max(by.values()) - min(by.values()) <= 1
    for shard, n in by.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (
            len(data) + 1, zlib.crc32(data), "rows", None)


def test_packing_loses_no_id(spark, sf_dir, texts):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = LLM_QUERIES["op3_packing"](spark, sf_dir).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(texts)
    for doc_id, own in pieces.items():
        ids = np.array([*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start:at].tobytes())
        assert at == len(ids)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert 1 - total / (2048 * len(windows)) < 0.03


def test_quality_on_held_out_labels(spark, connection):
    """Learnt from two thirds of the labels of sf0.01, judged on the rest."""
    sf_dir = "/root/testdata/sf0.01"
    rows = LLM_QUERIES["op4_quality"](spark, sf_dir).collect()
    labels = dict(tables(sf_dir).sql("SELECT doc_id, quality FROM labels").fetchall())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_suffix_dedup_is_brute_force(spark, sf_dir, texts):
    import hashlib

    got = {r.doc_id: r for r in LLM_QUERIES["op5_suffix_dedup"](spark, sf_dir).collect()}
    seen = set()
    for doc_id in sorted(texts):
        data = texts[doc_id].encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            window = data[i:i + 100]
            if window in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(window)
        runs = sum(1 for i, x in enumerate(gone) if x and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, x in zip(data, gone) if not x)
        r = got[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(data), sum(gone), runs)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_benchmark_items_are_found(spark, sf_dir, connection, texts):
    import re

    rows = LLM_QUERIES["op9_decontamination"](spark, sf_dir).collect()
    items = {i: re.findall(r"\w+", t.lower())
             for i, t in connection.sql("SELECT item_id, text FROM benchmark").fetchall()}
    whole = {(d, i) for d, t in texts.items() for i, item in items.items()
             if f" {' '.join(item)} " in f" {' '.join(re.findall(r'\w+', t.lower()))} "}
    assert whole and whole <= {(r.doc_id, r.item_id) for r in rows}
    assert all(r.coverage >= 0.6 and sum(t.length for t in r.tiles) == r.covered for r in rows)


def test_license_notices_are_found(spark, sf_dir, texts):
    rows = LLM_QUERIES["op1_license_scan"](spark, sf_dir).collect()
    known = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0",
             "Released under the MIT License.": "MIT",
             "This work is licensed under the GNU General Public License, version 3.":
             "GPL-3.0-only", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    expected = {(d, known[line]) for d, t in texts.items() for line in t.split("\n") if line in known}
    assert expected == {(r.doc_id, r.license) for r in rows}


def test_pipeline(spark, sf_dir, texts):
    import corpus_pipeline

    assert len(corpus_pipeline.STAGES) == 5
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    left = {r.doc_id for r in rows}
    assert left < set(texts) and len(left) > 0.6 * len(texts)
