"""One query for each corpus operator, over its whole table, with production
parameters; the digest columns are derived from the operators' real outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelforge.llm import (bpe, collocations, langid, lm, neardup, packing, pages, quality, repeats, search, sharding, simhash,
                            toxicity)
from labelforge.llm.common import crc_mod_is, documents

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_json(name: str = TOKENIZER) -> str:
    """The content of a public tokenizer file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op1_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode_decode(documents(spark, sf_dir), tokenizer_json())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(documents(spark, sf_dir), 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def op3_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge(documents(spark, sf_dir), labels(spark, sf_dir).where("quality = 1"), pairs=True)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", "score")


def op4_compression_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held = crc_mod_is(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs.where(~held), labels(spark, sf_dir).select("doc_id", "toxic").where(~held))
    return toxicity.score(docs, model).select(
        "doc_id", held.alias("held_out"), F.col("_score").alias("score"),
        F.when(F.col("_score") >= toxicity.TOXIC, 1).otherwise(0).alias("predicted"))


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held = crc_mod_is(F.col("doc_id"), 3, 1)
    model = langid.fit(docs.where(~held))
    return langid.identify(docs, model).withColumn("held_out", held)


def op6_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir), lm.held_out())


def op7_interval_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats.remove_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op8_configuration_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_json())


def op9_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def op10_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_rollup_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir)).drop("cut")


def op12_automaton_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return search.search(documents(spark, sf_dir), items)


def op13_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"))


QUERIES = {f.__name__: f for f in (op1_bpe_chunk_reuse, op2_histogram_sort, op3_ngram_ratio, op4_compression_distance,
                                   op5_cross_parsing, op6_suffix_tree, op7_interval_tree, op8_configuration_program,
                                   op9_small_world, op10_simhash_pigeonhole, op11_rollup_collocations, op12_automaton_search,
                                   op13_site_templates)}
#: DuckDB SQL, where SQL can express the operator.
ORACLE: dict[str, str] = {
    "op11_rollup_collocations": r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (
    SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 30),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, c.j, l.f AS l, r.f AS r,
         CAST((2000000 :: HUGEINT * c.f) // (l.f :: HUGEINT + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.j + 1:c.k], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
around AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS longer FROM (
    SELECT lang, w, f, s, unnest(range(1, k - s + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS s) WHERE k > s)
  GROUP BY 1, 2)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT low.lang, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank, low.phrase, a, l, r, n, score
  FROM low JOIN total ON total.lang = low.lang LEFT JOIN around ON around.lang = low.lang AND around.phrase = low.phrase
  WHERE longer IS NULL OR 100 :: HUGEINT * longer < 80 :: HUGEINT * a)
WHERE rank <= 2000
""",
    "op12_automaton_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
nl AS (SELECT count(*) FILTER (len(t) > 0) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM d),
tf AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY d, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 :: DOUBLE * big_n + 2) / (2.0 :: DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, nl GROUP BY term, big_n),
m AS (SELECT d, doc_id, 100 - 90 + ((90 * len(t) * big_n) // big_l) AS m FROM d, nl WHERE len(t) > 0),
s AS (
  SELECT item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM tf JOIN q USING (term) JOIN w USING (term) JOIN m USING (d) GROUP BY item_id, d, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s WHERE score > 0)
WHERE rank <= 10
"""}
