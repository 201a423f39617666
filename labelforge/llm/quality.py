"""Quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are counted: one of all trusted target
documents, one of the raw corpus. A document's score is the mean over its
n-grams of log(target / raw); every document is judged by the same threshold.
The n-grams are those of characters that end a word, which meet again where whole
invented or rare words don't, and with ``pairs`` the pairs of neighbouring word
ends, which tell the order of words and a word that stands after itself. The
queries count both; alone, the word ends tell neither.

Only DataFrame functions run here. The counts are sums over the whole corpus,
added up before the shuffle, to at most ``buckets`` rows; the weights travel as
one array of ``buckets`` numbers, which is the size bound of the broadcast. The
ids of trusted documents have no bound, so the texts move once, to meet them by id.

Defined results: a null or empty text has no words, all counts are zero and it
fails the base rules; if no document is trusted, or the table is empty, all
weights are zero, so the base rules alone decide; repeated rows are counted and
returned as often as they stand; extra columns are ignored, or kept by
``keep_good``, where columns of the working names (_q_...) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelforge.llm.common import SPACE, saved, sorted_join

#: Hash buckets of the n-grams.
BUCKETS = 1 << 14
#: Characters of an n-gram.
TAIL = 3
#: Added to each bucket's count, as a share of the mean count of a bucket.
SMOOTHING = 0.01
#: Least mean log-ratio of a document that is kept.
THRESHOLD = -0.25

WINDOW = 8  # fixed value: words of a repeated window
LEAST_WORDS = 20  # fixed value: fewer words fail the base rules
REPEATS = 30  # fixed value: percent of repeated words above which they fail
SYMBOLS = "#*$%&|<>"  # fixed value


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def gram(word: Column, buckets: int) -> Column:
    """Bucket of a word's n-gram, its last ``TAIL`` characters."""
    return F.pmod(F.xxhash64(F.substring(word, -TAIL, TAIL)), F.lit(buckets))


def pair(tail: Column, after: Column, buckets: int) -> Column:
    """Bucket of two neighbouring words' n-grams; null without a second word."""
    return F.when(after.isNotNull(), F.pmod(F.xxhash64(tail, after), F.lit(buckets)))


def with_next(items: Column, name: str) -> Column:
    """Each of ``items`` as ``name`` beside the one after it, ``after``."""
    return F.arrays_zip(items.alias(name), F.slice(items, F.lit(2), F.size(items)).alias("after"))


def weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, pairs: bool = False) -> DataFrame:
    """One row ``_q_weights``: for each bucket the log-ratio of the target
    (``docs`` whose doc_id is among ``trusted``, all of them) to the raw corpus."""
    # a table of its own, so that Spark splits a skewed join
    ids = saved(trusted.select("doc_id").where("doc_id is not null").distinct(), "quality-trusted").withColumn("_q_target", F.lit(1))
    marked = sorted_join(docs.select("doc_id", "text"), ids, "doc_id", "left")
    if pairs:
        each = marked.select(words(F.coalesce("text", F.lit(""))).alias("_q_words"), "_q_target")
        each = each.select(F.inline(with_next(F.col("_q_words"), "word")), "_q_target")
        after = F.when(F.col("after").isNotNull(), gram(F.col("after"), buckets))
        each = each.select(gram(F.col("word"), buckets).alias("a"), after.alias("b"), "_q_target")
        both = F.array("a", pair(F.col("a"), F.col("b"), buckets))
        grams = each.select(F.explode(both).alias("at"), "_q_target").where("at is not null")
    else:
        each = marked.select(F.explode(words(F.coalesce("text", F.lit("")))).alias("word"), "_q_target")
        grams = each.select(gram(F.col("word"), buckets).alias("at"), "_q_target")
    counts = (grams.groupBy("at")
              .agg(F.count(F.lit(1)).alias("raw"), F.count("_q_target").alias("target")))
    counts = saved(counts, "quality-counts")
    raws, targets = (n or 0 for n in counts.agg(F.sum("raw"), F.sum("target")).first())
    every = (docs.sparkSession.range(buckets).withColumnRenamed("id", "at").join(counts, "at", "left")
             .select("at", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))

    def share(n: str, total: int) -> Column:
        add = SMOOTHING * max(total, 1) / buckets
        return (F.col(n) + add) / (total + add * buckets)

    ratio = F.log(share("target", targets) / share("raw", raws)) if targets else F.lit(0.0)
    # the table has one row, under the key 0 that every document gets
    return every.select("at", ratio.alias("w")).groupBy(F.least("at", F.lit(0)).alias("_q_key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "w"))), lambda x: x["w"]).alias("_q_weights"))


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS,
          pairs: bool = False) -> DataFrame:
    """The rows of ``docs`` with the base counts, base_failed, score and kept."""
    table = saved(weights(docs, trusted, buckets, pairs), "quality-weights")
    text = F.coalesce("text", F.lit(""))
    d = docs.withColumn("_q_words", words(text)).withColumn("n_words", F.size("_q_words").cast("long"))
    d = d.withColumn("_q_key", F.least("n_words", F.lit(0).cast("long"))).join(F.broadcast(table), "_q_key")
    if pairs:
        d = d.withColumn("_q_tails", F.transform("_q_words", lambda w: gram(w, buckets).cast("int")))
        total = F.aggregate(with_next(F.col("_q_tails"), "tail"), F.lit(0.0), lambda a, x: (
            a + F.get("_q_weights", x["tail"])
            + F.coalesce(F.get("_q_weights", pair(x["tail"].cast("long"), x["after"].cast("long"), buckets).cast("int")), F.lit(0.0))))
        n_grams = 2 * F.size("_q_words") - 1
    else:
        total = F.aggregate("_q_words", F.lit(0.0), lambda a, w: a + F.get("_q_weights", gram(w, buckets).cast("int")))
        n_grams = F.size("_q_words")
    d = d.withColumns({
        "score": F.when(F.col("n_words") > 0, total / n_grams).otherwise(0.0),
        "word_chars": F.length(F.array_join("_q_words", "")).cast("long"),
        "_q_hashes": F.transform("_q_words", lambda w: F.xxhash64(w))}).drop("_q_words", "_q_weights", "_q_key", "_q_tails")

    d = d.withColumn("_q_windows", F.when(F.size("_q_hashes") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("_q_hashes") - WINDOW),
        lambda i: F.xxhash64(*[F.get("_q_hashes", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<long>")))
    # only texts that hold some window twice are sorted by window
    again = F.size(F.array_distinct("_q_windows")) < F.size("_q_windows")
    d = d.withColumn("_q_sorted", F.when(again, F.array_sort(F.transform(
        "_q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
            F.array().cast("array<struct<h:long,i:int>>"))).drop("_q_hashes", "_q_windows")
    twice = F.filter("_q_sorted", lambda x, i: (
        ((i > 0) & (F.get("_q_sorted", i - 1)["h"] == x["h"])) | F.coalesce(F.get("_q_sorted", i + 1)["h"] == x["h"], F.lit(False))))
    d = d.withColumn("_q_at", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("_q_sorted")
    covered = F.aggregate("_q_at", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
                          lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("_q_lines", lines)
    d = d.withColumns({
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": covered["n"].cast("long")})
    d = d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATS * F.col("n_words")))
    return (d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
            .drop("_q_at", "_q_lines"))


def keep_good(docs: DataFrame, trusted: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    given = docs.select(*[F.col(f"`{c}`").alias(f"_given_{i}") for i, c in enumerate(docs.columns)],
                        F.col("doc_id"), F.col("text"))
    # the verdict stays a column of its own: pushed down, the filter would repeat
    # every step that leads to it, for each element of the arrays
    out = judge(given, trusted, **params).withColumn("kept", F.col("kept") & (F.monotonically_increasing_id() >= 0)).where("kept")
    return out.select(*[F.col(f"_given_{i}").alias(c) for i, c in enumerate(docs.columns)])
