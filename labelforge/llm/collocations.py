"""Phrase collocations by top-order marginalisation.

Each word of a piece starts one window: its lead columns w1..w4, padded with
nulls where the piece ends. Only these longest windows are counted; Spark's
ROLLUP over (lang, w1, w2, w3, w4) sums them to the counts of every shorter
prefix, so the phrases of 1, 2 and 3 words, and each language's number of words,
need no rows of their own.

Most windows are rare, and a phrase below the bar can't be a candidate nor a
part of one. A first pass therefore counts phrases of 2 to 4 words in a
table of hashed counters, which moves no words; a phrase whose counter stays below the bar is surely
rarer than the bar, and a window ends before the word that makes its prefix one.
Counters only err upwards, so no count at or over the bar changes, whatever the
number of counters.

Results for odd rows: a null text has no words, a null lang is ``und``, repeated
rows count each time, other columns are not read, an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from labelforge.llm.common import bounded_batches, saved, sorted_join

#: Characters that end a piece, and those between words.
ENDS = "[.,;:!?\n\x0b\x0c\r]"
GAPS = "[ \t]+"
#: Words of the longest phrase; lowest count of a candidate.
ORDER = 4
LEAST = 30
#: Phrases listed for a language.
TOP = 2000
#: A phrase goes if a longer candidate around it has this share (%) of its count.
INSIDE = 80
#: Counters of phrases: about one for TEXT_A_COUNTER bytes of text, within these
#: powers of two. A worker holds them as bytes, the broadcast as bits (16 MB).
FEWEST_BITS, MOST_BITS, TEXT_A_COUNTER = 16, 27, 16
#: Counters in a row of the table that joins them.
CELL = 1 << 15


class Words:
    """The words of a batch of (lang, text), with what their windows need."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        pieces = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")), ENDS)
        row_of_piece = pc.list_parent_indices(pieces).to_numpy()
        words = pc.split_pattern_regex(pc.list_flatten(pieces), GAPS)
        piece = pc.list_parent_indices(words).to_numpy()
        flat = pc.list_flatten(words)
        some = pc.not_equal(flat, "")
        piece = piece[some.to_numpy(zero_copy_only=False)]
        coded = flat.filter(some).dictionary_encode()
        self.words, self.code = coded.dictionary, coded.indices.to_numpy()
        langs = langs.cast(pa.string()).fill_null("und").dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy()[row_of_piece[piece]]
        #: Does the next word stand in the same piece?
        self.goes_on = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)

    def prefixes(self, bits: int):
        """For 2, 3 and 4 words from each word on: do they stand in its piece, and
        their counter (of no use where they don't)."""
        import xxhash

        h = lambda a: np.array([xxhash.xxh3_64_intdigest(x) for x in a.to_pylist()], np.uint64)
        word = h(self.words)[self.code]
        inside, mixed = np.ones(len(word), bool), word + h(self.langs)[self.lang]
        with np.errstate(over="ignore"):
            for k in range(1, ORDER):
                inside = inside & np.append(self.goes_on[k - 1:], np.zeros(min(k - 1, len(word)), bool))
                mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.roll(word, -k)
                last = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                yield inside, (last >> np.uint64(64 - bits)).astype(np.uint32)


def _counters(docs: DataFrame, bits: int, least: int) -> np.ndarray:
    """Bits of the counters that reach ``least``, packed. Counts stop at
    ``least`` in each task: a sum of such counts reaches it just when the full
    sum does."""
    def count(batches):
        import zstandard

        held = np.zeros(1 << bits, np.uint8)
        for b in batches:
            for inside, counter in Words(b.column(0), b.column(1)).prefixes(bits):
                at, n = np.unique(counter[inside], return_counts=True)
                held[at] = np.minimum(held[at] + n, least)
        z, cells = zstandard.ZstdCompressor(level=1), held.reshape(-1, min(CELL, 1 << bits))
        for k, cell in enumerate(cells):
            if cell.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([z.compress(cell.tobytes())], pa.binary())], ["cell", "held"])

    def add(batches):
        import zstandard

        z, sums = zstandard.ZstdDecompressor(), {}
        for b in batches:
            for k, held in zip(b.column(0).to_pylist(), b.column(1)):
                one = np.frombuffer(z.decompress(held.as_py()), np.uint8)
                sums[k] = np.minimum(sums.get(k, 0) + one.astype(np.uint16), least).astype(np.uint8)
        for k, cell in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([np.packbits(cell >= least).tobytes()], pa.binary())], ["cell", "held"])

    schema = "cell int, held binary"
    rows = docs.mapInArrow(count, schema).repartition("cell").mapInArrow(add, schema).collect()  # bits: 16 MB at most
    width = min(CELL, 1 << bits) // 8
    packed = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        packed[r["cell"] * width:(r["cell"] + 1) * width] = np.frombuffer(r["held"], np.uint8)
    return packed


def windows(docs: DataFrame, least: int = LEAST, bits: int | None = None) -> DataFrame:
    """(lang, w1..w4, n): the padded longest windows, one row for each distinct
    window of a batch."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("lang", "text")
    if bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = min(MOST_BITS, max(FEWEST_BITS, (size // TEXT_A_COUNTER).bit_length()))
    often = spark.sparkContext.broadcast(_counters(docs, bits, min(least, 255)))

    def make(batches):
        seen = often.value
        for b in batches:
            w = Words(b.column(0), b.column(1))
            if not len(w.code):
                continue
            cols, alive = [w.lang, w.code], np.ones(len(w.code), bool)
            for k, (inside, counter) in enumerate(w.prefixes(bits), 1):
                enough = (seen[counter >> 3] >> (7 - (counter & 7)).astype(np.uint8)) & 1
                alive = alive & inside & enough.astype(bool)
                cols.append(np.where(alive, np.roll(w.code, -k), -1))
            # windows of one word are most: counted apart from the others
            one = cols[2] < 0
            single, n1 = np.unique(w.lang[one].astype(np.int64) * len(w.words) + w.code[one], return_counts=True)
            many, n2 = np.unique(np.stack([c[~one] for c in cols], axis=1), axis=0, return_counts=True)
            lang = np.concatenate([single // len(w.words), many[:, 0]])
            got = [np.concatenate([single % len(w.words), many[:, 1]])]
            got += [np.concatenate([np.full(len(single), -1), many[:, k]]) for k in range(2, ORDER + 1)]
            take = lambda c: pc.take(w.words, pa.array(c, pa.int64(), mask=c < 0)).cast(pa.string())
            yield pa.record_batch([pc.take(w.langs, pa.array(lang)), *(take(c) for c in got),
                                   pa.array(np.concatenate([n1, n2]), pa.int64())], ["lang", *WINDOW, "n"])

    return docs.mapInArrow(make, f"lang string, {', '.join(f'{c} string' for c in WINDOW)}, n long")


WINDOW = [f"w{k + 1}" for k in range(ORDER)]


def phrase_counts(docs: DataFrame, least: int = LEAST, bits: int | None = None) -> DataFrame:
    """(lang, k, phrase, f): each language's phrases of 1 to 4 words with at
    least ``least`` occurrences, and with k = 0 its number of words."""
    counted = windows(docs, least, bits).groupBy("lang", *WINDOW).agg(F.sum("n").alias("n"))
    level = F.lit(ORDER) - F.length(F.replace(F.bin(F.grouping_id()), F.lit("0"), F.lit("")))
    summed = counted.rollup("lang", *WINDOW).agg(F.sum("n").alias("f"), level.cast("int").alias("k"))
    words = F.array(*WINDOW)
    # not the grand total, nor prefixes that end in padding
    whole = (F.col("k") >= 0) & F.when(F.col("k") > 0, F.element_at(words, F.greatest("k", F.lit(1))).isNotNull()).otherwise(True)
    return summed.where(whole & ((F.col("f") >= least) | (F.col("k") == 0))).select(
        "lang", "k", F.concat_ws(" ", *WINDOW).alias("phrase"), "f")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut): each language's first
    ``top`` candidates by score, count and phrase; ``cut`` is the number of words
    before the cut that gives the score."""
    f = saved(phrase_counts(docs, least, bits), "phrases")
    total = f.where("k = 0").select("lang", F.col("f").alias("n"))
    known = f.where("k > 0").select("lang", "phrase", "f")
    found = f.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.expr("array_join(slice(words, 1, cut), ' ')").alias("first"),
        F.expr("array_join(slice(words, cut + 1, k - cut), ' ')").alias("rest"))
    cuts = sorted_join(cuts, known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = sorted_join(cuts, known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("low")).select(
        "lang", "phrase", "a", "low.*")

    # the phrases of two words or more inside a longer candidate
    longer = found.where("k > 2").select("lang", "a", "k", "words", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    part = "transform(sequence(1, k - size + 1), i -> array_join(slice(words, i, size), ' '))"
    around = longer.select("lang", "a", F.explode(F.expr(part)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = F.expr(f"longer is null or cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * {INSIDE}")
    kept = sorted_join(scored, around, ["lang", "phrase"], "left").where(free)

    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return sorted_join(ranked, total, "lang").select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score", "cut")
