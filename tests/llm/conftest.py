import pytest

CLASHING = ("shard", "slot", "part", "order", "range", "place", "cuts", "offset", "lines", "h", "n",
            "s", "row", "row_hash", "spans", "spots", "kept", "keep_id", "score", "x", "key",
            "component_id", "bucket", "text_sha256", "lines_removed", "hit", "gone_id")


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and clashing columns."""
    passage = "\n".join(f"line {i} of a passage that many hold, word for word" for i in range(12))
    long = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    rows = [
        (1, "Alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "),
        (5, "Alpha beta gamma delta epsilon zeta"), (5, "another text under a known id"),
        (None, "a text without an id, of some length, to be kept"), (None, None),
        (6, passage), (7, "before\n" + passage + "\nafter"), (8, passage), (8, passage),
        (9, long), (10, long + " tail"), (11, "x" * 300_000), (12, "x" * 300_000),
        (13, "ab" * 500), (14, "\n" * 50), (15, "Ünïcödé ßtraße 你好 мир \U0001f600 ende"),
        (16, "Licensed under the Apache License, Version 2.0."), (17, "one"), (18, "one"),
        (19, "<|endoftext|> is text here"), (-3, "Alpha  beta\tgamma delta epsilon zeta"),
    ]
    frame = spark.createDataFrame(
        [(*row, "en", "src0", None) for row in rows],
        "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    return frame.withColumns({name: F.lit(f"own {name}") for name in CLASHING})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
