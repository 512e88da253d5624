"""Queries of the corpus operators over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from textwarden.llm import (
    archive, bpe, lexical, licences, line_dedup, line_quality, mixing, neighbours, packing, partenum, rotation,
    toxicity, whitening)
from textwarden.llm.common import shared_folder
from textwarden.sources.tables import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    REGISTRY[function.__name__] = function
    return function


@query
def op3_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to a content-addressed archive and read back."""
    folder = shared_folder(spark, "archive")
    archive.write_archive(table(spark, sf, "pages"), folder)
    return archive.read_records(spark, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op3_warc_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
             max(page_id) OVER (PARTITION BY body) AS last_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to
FROM m
"""


@query
def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the lines that an earlier document holds."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL["op8_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.doc_id, k.line, k.pos, r.first_id IS NOT NULL AND k.doc_id <> r.first_id AS lost
      FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """A file of the installed public vocabularies."""
    import public_tokenizers

    return f"file://{public_tokenizers.path(name)}"


@query
def op10_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every whole text encoded and decoded again."""
    source = bpe.read_text(spark, vocabulary_path())
    return bpe.digests(table(spark, sf, "documents").select("doc_id", "text"), source, keep=["doc_id"])


@query
def op9_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    """All documents mixed to the weights of their sources."""
    documents = table(spark, sf, "documents").select("doc_id", "source", "text")
    plan = mixing.plan_mix(documents).withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       (F.col("copies") * F.col("size")).alias("taken"))


@query
def op1_line_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document measured, and judged by the lines that its source repeats."""
    return line_quality.judge_lines(table(spark, sf, "documents").select("doc_id", "source", "text")).drop("source")


SQL["op1_line_quality"] = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
g AS (SELECT doc_id, i, CASE WHEN i + 7 <= len(w) THEN array_to_string(list_slice(w, i, i + 7), ' ') END AS gram FROM p),
r AS (SELECT doc_id, i, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again FROM g),
c AS (SELECT doc_id, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS hit
      FROM r),
rep AS (SELECT doc_id, sum(hit) AS n_repeat_words FROM c GROUP BY doc_id),
l AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
k AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw FROM l),
n AS (SELECT doc_id, source, t, line, len(lw) AS words,
             translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM k WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM n GROUP BY doc_id),
tot AS (SELECT source, count(DISTINCT t) AS documents FROM d GROUP BY source),
f AS (SELECT n.source, n.key FROM n JOIN tot ON n.source IS NOT DISTINCT FROM tot.source
      GROUP BY n.source, n.key, tot.documents
      HAVING count(DISTINCT n.t) >= 20 AND count(DISTINCT n.t) * 100 > tot.documents * 2),
x AS (SELECT n.doc_id, sum(n.words) AS removed_words FROM n JOIN f
      ON n.source IS NOT DISTINCT FROM f.source AND n.key = f.key GROUP BY n.doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
      FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND removed_words * 100 <= n_words * 50 AS kept FROM b
"""


def held_out(id_col: str = "doc_id"):
    """Every fifth document by the checksum of its id is held out of training."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def toxicity_model(spark: SparkSession, sf: str, documents: DataFrame) -> toxicity.Model:
    labels = table(spark, sf, "labels").select("doc_id", "toxic").filter(~held_out())
    return toxicity.fit(documents.select("doc_id", "text"), labels)


@query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Every document scored for toxic passages by a model of the rows that are not held out."""
    documents = table(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, toxicity_model(spark, sf, documents))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted",
                         F.size("passages").alias("n_passages"))


@query
def op7_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its set size and the component of its links."""
    found = partenum.similar(table(spark, sf, "documents").select("doc_id", "text"), words=3, similarity=Fraction(9, 10))
    return found.withColumnRenamed("id", "doc_id")


@query
def op5_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every licence notice that a document holds."""
    return licences.scan(table(spark, sf, "documents").select("doc_id", "text"))


def _license_sql() -> str:
    notices = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in n)) for n in licences.NOTICES)
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    return rf"""
WITH n(license, body) AS (VALUES {notices}),
nw AS (SELECT license, {words.format('body')} AS w FROM n),
t AS (SELECT DISTINCT license, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
      FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM nw)),
c AS (SELECT license, count(*) AS n_shingles, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS class FROM t GROUP BY license),
dw AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, i - 1 AS pos, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
v AS (SELECT s.* FROM s WHERE gram IN (SELECT gram FROM t)),
win AS (SELECT DISTINCT v.doc_id, k.class, CAST(floor(v.pos / k.class) AS BIGINT) - o.o AS win
        FROM v, (SELECT DISTINCT class FROM c) k, (VALUES (0), (1)) o(o)),
f AS (SELECT win.doc_id, win.class, win.win, min(v.pos) AS first_word FROM win JOIN v ON v.doc_id = win.doc_id
      AND CAST(floor(v.pos / win.class) AS BIGINT) IN (win.win, win.win + 1) GROUP BY ALL),
m AS (SELECT win.doc_id, win.win, c.license, c.n_shingles, c.class, count(DISTINCT v.gram) AS n_shared
      FROM win JOIN v ON v.doc_id = win.doc_id AND CAST(floor(v.pos / win.class) AS BIGINT) IN (win.win, win.win + 1)
      JOIN t ON t.gram = v.gram JOIN c ON c.license = t.license AND c.class = win.class GROUP BY ALL)
SELECT m.doc_id, license, max(n_shared) AS n_shared, max(n_shingles) AS n_shingles, min(first_word) AS first_word
FROM m JOIN f USING (doc_id, class, win) WHERE n_shared >= n_shingles * 0.8 GROUP BY m.doc_id, license
"""


SQL["op5_license_scan"] = _license_sql()


@query
def op6_perspective_rotation(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation rendered from the side of each participant."""
    seen = rotation.rotate(table(spark, sf, "conversations"))
    spans = F.expr("array_join(transform(spans, s -> concat(s.first, '-', s.last)), ',')")
    return seen.withColumn("spans", spans)


SQL["op6_perspective_rotation"] = r"""
WITH c AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\|') AS role,
                  replace(coalesce(text, ''), '<|', '<\|') || '<|im_end|>' AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM c WHERE role <> 'system'),
s AS (SELECT c.conv_id, perspective, turn, CAST(floor(turn / 64) AS BIGINT) AS block, role = perspective AS own,
             CASE WHEN role = 'system' THEN '<|im_start|>system' || chr(10)
                  WHEN role = perspective THEN '<|im_start|>assistant' || chr(10)
                  ELSE '<|im_start|>user name=' || role || chr(10) END AS head, body FROM c JOIN p USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, block ORDER BY turn) AS upto FROM s)
SELECT conv_id, perspective, block, CAST(0 AS BIGINT) AS sub, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || body || chr(10), '' ORDER BY turn) AS text,
       coalesce(string_agg((upto - length(body) - 1) || '-' || (upto - 1), ',' ORDER BY turn) FILTER (own), '') AS spans
FROM o GROUP BY conv_id, perspective, block
"""


@query
def op4_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth row, found by greedy search of the neighbour graph."""
    return neighbours.search(table(spark, sf, "embeddings"), every=20, top=20)


@query
def op13_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's tokens in sequences of at most 4096."""
    source = bpe.read_text(spark, vocabulary_path("word_bpe_49k.json"))
    cut = packing.pieces(table(spark, sf, "documents").select("doc_id", "text"), source)
    return packing.place(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector on the first four whitened components."""
    return whitening.whiten(table(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    shards = lexical.index(table(spark, sf, "documents").select("doc_id", "text"))
    return lexical.search(table(spark, sf, "benchmark"), shards)


def _lexical_sql() -> str:
    found = (r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {found} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({found}) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT item_id, row, doc_id, CAST(sum(times * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM c WHERE score > 0 QUALIFY rank <= 20
"""


SQL["op12_lexical_search"] = _lexical_sql()
