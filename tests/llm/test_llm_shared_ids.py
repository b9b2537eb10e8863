"""Sharding rows that share an id: they do not stay neighbours."""

from forecourt.llm.queries import LLM_QUERIES


def test_rows_of_one_id_are_shuffled(spark, tmp_path):
    rows = [(7 if i % 3 == 0 else i, f"text {i}", "en", "src0", 1) for i in range(960)]
    spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
            str(tmp_path / "documents.parquet"))
    shards = {}
    for r in LLM_QUERIES["op2_sharding"](spark, str(tmp_path)).collect():
        shards.setdefault(r.shard, []).append((r.slot, r.doc_id == 7))
    assert sorted(map(len, shards.values())) == [60] * 16
    for own in shards.values():
        shared = [slot for slot, is_shared in sorted(own) if is_shared]
        # About a third of each shard, and apart.
        assert 5 <= len(shared) <= 40 and shared[-1] - shared[0] >= len(shared)
