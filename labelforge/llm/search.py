"""Ranked lexical search by a scan with an Aho-Corasick automaton.

The terms of all items form one automaton. Each term stands in it between two
spaces, and texts are scanned with every character that is in no term turned
into a space, so only whole terms match. A first scan counts the documents of
each term; a second one takes the counts within a document straight from its
text, adds them up for the items that the automaton's outputs name, and keeps
the best documents of its task. No index of the documents is built or moved.

What travels by broadcast is bounded: items are dealt into slices of at most
``SLICE_BYTES`` of terms, one automaton and two scans each. An item that is
larger than a slice by itself is spread over slices of its own; its documents'
parts of a score are summed before they are ranked.

Results for odd rows: a null text has no term, an item without terms no result,
an item in several rows has the terms of all of them, each row of the documents
is a document (a repeated one is listed again), a null doc_id comes after the
others, an empty table gives no rows, other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from labelforge.llm.common import bounded_batches

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of terms in one automaton, at most (a state for each, some 100 MB).
SLICE_BYTES = 1 << 20
TOP = 10

#: Bytes of UTF-8 as the scan sees them: A-Z lower-cased, others of no term a space.
_SEEN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""
    found = F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).select(
        "item_id", F.translate("term", UPPER, LOWER).alias("term")).distinct()


def automaton(terms: list[str]):
    """Of the terms, each between two spaces, with its place in the list; over
    the bytes of UTF-8, as characters of one byte."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        a.add_word(f" {t.encode().decode('latin-1')} ", k)
    a.make_automaton()
    return a


def _scan(a, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """The text's number of terms, the listed ones among them, and their counts."""
    seen = (text or "").encode().translate(_SEEN)
    n = len(seen.split())
    if not n or not len(a):
        return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, tf = np.unique(np.fromiter((k for _, k in a.iter(f" {seen.decode('latin-1')} ")), np.int64), return_counts=True)
    return n, at, tf


def _count(docs: DataFrame, terms: list[str]) -> tuple[int, int, np.ndarray]:
    """N, L and the number of documents of each term."""
    def run(batches):
        a, df = automaton(terms), np.zeros(len(terms) + 2, np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                n, at, _ = _scan(a, text)
                df[at] += 1
                df[-2] += n > 0
                df[-1] += n
        some = np.flatnonzero(df)
        yield pa.record_batch([pa.array(some), pa.array(df[some])], ["at", "n"])

    got = np.zeros(len(terms) + 2, np.int64)
    for r in docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        got[r["at"]] = r["n"]
    return int(got[-2]), int(got[-1]), got[:-2]


def _best(which, score, doc, none, row, top: int):
    """The ``top`` first rows of each item: by score, then doc (nulls last)."""
    o = np.lexsort((doc, none, -score, which))
    i = which[o]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
    place = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    o = o[place < top]
    return [x[o] for x in (which, score, doc, none, row)]


def _schema(item) -> StructType:
    return StructType([StructField("item_id", item), StructField("doc_id", LongType()), StructField("score", LongType()),
                       StructField("row", BinaryType())])


def _scores(docs: DataFrame, rows: list, top: int | None, item) -> DataFrame:
    """(item_id, doc_id, score, row) for the slice's (item_id, term) rows: the
    ``top`` best documents of each task, or where ``top`` is None all with a
    score, and a hash of the text as ``row``."""
    terms, ids = sorted({r["term"] for r in rows}), list({r["item_id"]: None for r in rows})
    place, nth = {t: k for k, t in enumerate(terms)}, {i: k for k, i in enumerate(ids)}
    of_term = [[] for _ in terms]
    for r in rows:
        of_term[place[r["term"]]].append(nth[r["item_id"]])
    n_docs, n_terms, df = _count(docs, terms)
    w = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    start = np.cumsum([0, *(len(x) for x in of_term)])
    sent = docs.sparkSession.sparkContext.broadcast((terms, w, start, np.array([i for x in of_term for i in x], np.int64), ids))
    schema, kind = _schema(item), to_arrow_type(item)

    def run(batches):
        import xxhash

        terms, w, start, listed, ids = sent.value
        a = automaton(terms)
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, "S16")]

        def rows_of(which, score, doc, none, row):
            return pa.record_batch([pa.array([ids[k] for k in which], kind), pa.array(doc, pa.int64(), mask=none), pa.array(score),
                                    pa.array(row.tolist(), pa.binary())], schema.names)

        for b in batches:
            parts = []
            for text, doc in zip(b.column(1).to_pylist(), b.column(0).to_pylist()):
                n, at, tf = _scan(a, text)
                if not len(at):
                    continue
                m = 10 + 90 * n * n_docs // n_terms
                worth = w[at] * (1000000000 * tf // (1000 * tf + 8 * m))
                many = start[at + 1] - start[at]
                ends = np.cumsum(many)
                to = listed[np.arange(ends[-1]) + np.repeat(start[at] - ends + many, many)]
                score = np.zeros(len(ids), np.int64)
                np.add.at(score, to, np.repeat(worth, many))
                hit = np.flatnonzero(score > 0)
                row = b"" if top else xxhash.xxh128_digest(text.encode())
                parts.append((hit, score[hit], np.full(len(hit), doc or 0), np.full(len(hit), doc is None), np.full(len(hit), row, "S16")))
            if not parts:
                continue
            got = [np.concatenate(x) for x in zip(*parts)]
            if top is None:
                yield rows_of(*got)
            else:
                held = _best(*(np.concatenate(x) for x in zip(held, got)), top)
        if top is not None:
            yield rows_of(*held)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item."""
    bounded_batches(docs.sparkSession)
    terms = item_terms(items)
    sizes = terms.groupBy(F.col("item_id").alias("id")).agg(F.sum(F.octet_length("term") + 16).alias("bytes"))
    half = slice_bytes // 2  # slices by hash are of half the bound on average
    large = F.col("bytes") > half // 4
    small_bytes, large_bytes = sizes.agg(F.sum(F.when(~large, F.col("bytes"))), F.sum(F.when(large, F.col("bytes")))).first()

    def sliced(which, total, *key):
        of = terms.join(sizes.where(which), F.col("item_id").eqNullSafe(F.col("id")), "left_semi")
        n = ceil((total or 0) / half)
        for k in range(n):
            rows = of.where(F.pmod(F.xxhash64(*key), F.lit(n)) == k).collect()
            if rows:
                yield rows

    item = items.schema["item_id"].dataType
    found = [_scores(docs, rows, top, item) for rows in sliced(~large, small_bytes, "item_id")]
    parts = [_scores(docs, rows, None, item).withColumn("part", F.lit(k))
             for k, rows in enumerate(sliced(large, large_bytes, "item_id", "term"))]
    if parts:  # a repeated row has the same parts as the first, so many times
        one = reduce(DataFrame.unionAll, parts).groupBy("item_id", "doc_id", "row", "part").agg(
            F.max("score").alias("score"), F.count(F.lit(1)).alias("times"))
        found.append(one.groupBy("item_id", "doc_id", "row").agg(F.sum("score").alias("score"), F.max("times").alias("times")).select(
            "item_id", "doc_id", "score", "row", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col"))
    if not found:
        found = [docs.sparkSession.createDataFrame([], _schema(item))]
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(
        "item_id", "rank", "doc_id", "score")
