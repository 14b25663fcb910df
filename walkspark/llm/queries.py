"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkspark.llm import oracles
from walkspark.llm.common import table
from walkspark.llm.quality import CLOSING, DOUBLED, MARKS, SEPARATORS, STOCK, STOCK_WORDS


def op1_pruned_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.quality import clean_lines

    made = clean_lines(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_hamming_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.neardup import near_duplicates

    made = near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=85)
    return made.select("doc_id", "n_shingles", "component_id", "kept", "set_id")


def op4_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.sharding import shard_documents

    made = shard_documents(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op5_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.licenses import scan, train

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = scan(documents, train(spark, documents))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",")
    return made.select("doc_id", "n_paragraphs", F.size("licences").alias("n_licences"), families.alias("families"), F.array_max(F.transform("licences", lambda x: x["probability"])).alias("probability"))


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op7_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.bpe import decode, encode

    made = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.pii import find_pii, joined

    made = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return made.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.katz import score

    return score(table(spark, sf_dir, "documents"))


def op10_fused_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.langid import identify

    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op11_pivot_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.jaccard import jaccard_join

    made = jaccard_join(table(spark, sf_dir, "documents"), words=5, threshold=80)
    return made.select("doc_id", "n_shingles", "component_id")


def op12_weighted_codebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.codebooks import compress

    return compress(table(spark, sf_dir, "embeddings"))


def op13_transducer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from walkspark.llm.conversations import repair

    return repair(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_pruned_graph_ann, op2_line_quality, op3_hamming_neardup, op4_ring_shards, op5_licence_classifier, op6_pfair_mix, op7_rank_queue_bpe, op8_contextual_pii, op9_katz_backoff, op10_fused_language, op11_pivot_jaccard, op12_weighted_codebooks, op13_transducer_repair)}

#: DuckDB SQL, where it can express a query's whole result. The others are tested against brute
#: force: hash rings, deadline schedules, graphs and merge queues aren't SQL.
_WORD = r"[^\x20\x09-\x0D]"
_COUNT = lambda pattern, text="x": f"len(regexp_extract_all({text}, '{pattern}'))"
ORACLES: dict[str, str] = {
    "op2_line_quality": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{_WORD}+') AS ws FROM d),
ws AS (SELECT rid, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars FROM w),
v AS (SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM (SELECT rid, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w) WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM v WHERE c IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) AS s(o) WHERE n >= 2 GROUP BY rid),
l AS (SELECT rid, x FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}')),
ls AS (SELECT rid, count(*) AS n, count(DISTINCT x) AS nd, sum(length(x)) AS whole FROM l GROUP BY rid),
f AS (SELECT rid, x, n, length(x) AS size, {_COUNT(_WORD + "+")} AS k, {_COUNT(MARKS)} AS marks, {_COUNT(SEPARATORS)} AS bars,
{_COUNT(DOUBLED.replace("(?=", "(?:").replace(chr(92) + "s", "[ " + chr(92) + "t" + chr(92) + "x0B" + chr(92) + "f" + chr(92) + "r]"))} AS doubled, right(rtrim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 1) IN ({", ".join("'" + c.replace("'", "''") + "'" for c in CLOSING)}) AS closed,
length(x) - length(regexp_replace(lower(x), '{"|".join(STOCK)}', '', 'g')) AS phrases FROM (SELECT DISTINCT l.rid, x, n FROM l JOIN ls ON ls.rid = l.rid)),
k AS (SELECT rid, sum(size) AS kept FROM f WHERE NOT (marks * 10 > size OR doubled * 5 > k OR (bars >= 2 AND bars * 4 >= k) OR (NOT closed AND n > 1 AND k < 4) OR (phrases > 0 AND (k <= {STOCK_WORDS} OR 5 * phrases > size))) GROUP BY rid),
m AS (SELECT doc_id, n_words, word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ls.n - nd, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(1 - coalesce(kept, 0) / whole, 1) AS lost
FROM d JOIN ws ON ws.rid = d.rid LEFT JOIN r ON r.rid = d.rid LEFT JOIN ls ON ls.rid = d.rid LEFT JOIN k ON k.rid = d.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 AS kept FROM m""",
    "op11_pivot_jaccard": oracles.jaccard(),
    "op12_weighted_codebooks": oracles.codebooks(),
    "op13_transducer_repair": oracles.conversations(),
}
