"""One query per operator over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.llm.collocations import collocations
from forecourt.llm.common import table
from forecourt.llm.conversations import repair_report
from forecourt.llm.decontaminate import contaminated
from forecourt.llm.exact_dedup import exact_duplicates
from forecourt.llm.license_scan import license_notices
from forecourt.llm.line_dedup import drop_repeated_chunks, drop_repeated_passages
from forecourt.llm.mixing import mixed_documents
from forecourt.llm.packing import pack
from forecourt.llm.quality import classify
from forecourt.llm.sharding import shuffle_into_shards
from forecourt.llm.suffix_dedup import repeated_bytes
from forecourt.llm.super_minhash import near_duplicates
from forecourt.llm.warc_zip import round_trip


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices in all documents."""
    return license_notices(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt into 16 shards of equal row counts."""
    docs = table(spark, sf_dir, "documents")
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return shuffle_into_shards(docs, 16).select(
        "doc_id", (F.length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens in windows of 2048."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score, learnt from two thirds of the labels."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 100 bytes that occur before."""
    return repeated_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written into ZIP-packaged WARC archives and read back."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.encode("html", "UTF-8").alias("payload"))
    return round_trip(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its group of near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a good part of a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the repeated passages of several lines."""
    docs = table(spark, sf_dir, "documents")
    return drop_repeated_chunks(docs).select(
        "doc_id", "lines", "lines_removed", "chunks_removed", "text")


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the units of passages of over 50 words that occur before."""
    docs = table(spark, sf_dir, "documents")
    return drop_repeated_passages(docs).select("doc_id", "units", "units_removed", "text")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the row that stays of those equal to it."""
    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of the sources, weighed 5, 2, 1 in turn, takes of each document."""
    return mixed_documents(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two to four words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and the cheapest way to repair it."""
    return repair_report(table(spark, sf_dir, "conversations"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (
    PARTITION BY coalesce(html, '')) AS last FROM pages),
b AS (SELECT *, list_reduce(list_transform(string_split(sha1(html), ''), lambda c:
    format('{:04b}', strpos('0123456789abcdef', c) - 1)), lambda x, y: x || y) AS bits FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(1, 6), lambda k:
      (substr(bits, 5 * i + k, 1) = '1')::INT * (1 << (5 - k)::INT)))::INT, 1)),
    lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM b
"""

OP7_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM t WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y
    ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * c >= 75 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM t UNION
    SELECT r.doc_id, e.b FROM reach r JOIN ends e ON e.a = r.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM low LEFT JOIN n USING (doc_id)
"""

OP8_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
r AS (SELECT *, len(lines) AS n, list_transform(range(1, len(lines)), lambda i:
        md5(md5(lines[i]) || md5(lines[i + 1]))) AS roll FROM l),
e AS (SELECT *, list_concat(list_filter(range(1, n - 2), lambda i:
        (i = 1 OR roll[i] < roll[i - 1]) AND roll[i] <= roll[i + 1]), [n - 1]) AS ends FROM r),
s AS (SELECT *, list_concat([0], list_transform(ends[:len(ends) - 1], lambda i: i + 1)) AS starts
      FROM e),
p AS (SELECT doc_id, lines, unnest(starts) AS a, unnest(ends) AS b FROM s),
c AS (SELECT doc_id, a, b, array_to_string(lines[a + 1:b + 1], chr(10)) AS chunk
      FROM p WHERE b > a),
g AS (SELECT doc_id, a, b, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, a) AS k FROM c),
d AS (SELECT doc_id, list(a) AS starts, list(b) AS ends, sum(b - a + 1) AS gone, count(*) AS times
      FROM g WHERE k > 1 GROUP BY doc_id)
SELECT l.doc_id, coalesce(len(lines), 0)::INT AS lines, coalesce(gone, 0)::INT AS lines_removed,
  coalesce(times, 0)::INT AS chunks_removed,
  CASE WHEN d.doc_id IS NULL THEN text WHEN gone < len(lines) THEN array_to_string(
    list_transform(list_filter(range(0, len(lines)), lambda i: NOT list_bool_or(
      list_transform(range(1, len(starts) + 1), lambda k: i BETWEEN starts[k] AND ends[k]))),
      lambda i: lines[i + 1]), chr(10)) END AS text
FROM l LEFT JOIN d USING (doc_id)
"""

OP10_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
k AS (SELECT doc_id, bare, count(*) OVER (PARTITION BY bare) AS group_size,
  first_value(doc_id) OVER (PARTITION BY bare ORDER BY points DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM k
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(list_filter(
    regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')), 0)::BIGINT AS size,
  md5('0:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM s),
a AS (SELECT *, 2 * source_size AS cap, 3 * sum(source_size) OVER () AS budget2,
  coalesce(sum(2 * source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS before,
  sum(weight) OVER (r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM w WINDOW r AS (ORDER BY 2 * source_size / weight, source NULLS LAST)),
f AS (SELECT *, 2 * cap * after <= (budget2 - 2 * before) * weight AS is_full FROM a),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE
    ((budget2 - 2 * sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) * weight)::DOUBLE
    / (2 * sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ())::DOUBLE END AS target FROM f),
q AS (SELECT d.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY d.source
    ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN target > 0
    THEN (pass * source_size + before + size)::DOUBLE / target ELSE 0 END AS finish
  FROM q, (VALUES (0), (1)) p(pass)),
m AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, h, pass
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
b AS (SELECT *, greatest(0, least(size, (SELECT sum(size) FROM d) * 3 // 2 - start)) AS got FROM m)
SELECT doc_id, any_value(size) AS size, any_value(source_size)::BIGINT AS source_size,
  any_value(target) AS target, sum(got)::BIGINT AS taken FROM b GROUP BY h, source, doc_id
"""

OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2),
    lambda i: array_to_string(w[i:i + k - 1], ' '))) AS p FROM w, range(1, 5) ks(k)),
f AS (SELECT lang, k, p, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT f.lang, p, n, f.k AS size, string_split(p, ' ') AS w FROM f WHERE f.k > 1),
parts AS (SELECT lang, p, n, ks.k, array_to_string(w[:ks.k], ' ') AS lp,
    array_to_string(w[ks.k + 1:], ' ') AS rp FROM c, range(1, 4) ks(k) WHERE ks.k < size),
cuts AS (SELECT s.lang, s.p, s.n AS a, s.k, x.n AS l, y.n AS r,
    2000000 * s.n::HUGEINT // (x.n + y.n) AS score
  FROM parts s JOIN f x ON x.lang = s.lang AND x.p = s.lp JOIN f y ON y.lang = s.lang AND y.p = s.rp),
best AS (SELECT lang, p, any_value(a) AS a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r,
    min(score) AS score FROM cuts GROUP BY lang, p),
most AS (SELECT lang, p, max(n) AS n FROM (
    SELECT lang, n, array_to_string(w[i:i + k - 1], ' ') AS p
    FROM c, range(2, 4) ks(k), range(1, 4) s(i) WHERE k < size AND i + k - 1 <= size)
  GROUP BY lang, p),
stay AS (SELECT b.* FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.p = b.p
  WHERE m.n IS NULL OR 100 * m.n < 80 * b.a),
ranked AS (SELECT *, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, encode(p)) AS rank FROM stay)
SELECT lang, rank, p AS phrase, a, l, r, t.n, score::BIGINT AS score
FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""

LLM_QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_warc": op6_warc,
    "op7_near_dedup": op7_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op8_passage_dedup": op8_passage_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_mixing": op11_mixing,
    "op12_collocations": op12_collocations,
    "op13_conversations": op13_conversations,
}

LLM_ORACLES = {
    "op6_warc": OP6_SQL,
    "op7_near_dedup": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_mixing": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
