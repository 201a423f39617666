"""Toxicity by compression distance.

A zstandard dictionary is trained on ordinary text and one on toxic text. A
document's windows of words are compressed with either; a window that gets
shorter with the toxic dictionary holds toxic text. The share of such windows,
by how many bytes they gain, and the largest gain go through a logistic curve
calibrated on labelled documents.

Labels say that a document is toxic, not where. The toxic dictionary is
therefore trained on the spans of toxic documents that set them apart: runs of
5-byte strings that stand in many toxic and next to no ordinary documents. Both
dictionaries end in the same ordinary content, so that ordinary words cost the
same with either.

Fitted on a bounded sample of labelled rows (``SAMPLE``: at most so many toxic
and ordinary documents, by hash of the doc_id); every document is scored whole.

Defined results: a null text counts as empty; a text without words has no
windows and gets the curve's value for none; without labelled documents of both
kinds all scores are 0; null labels teach nothing; repeated rows are rows of
their own; extra columns are ignored, or kept by ``keep_clean``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from labelforge.llm.common import bounded_batches, saved, with_python_column

#: Toxic and ordinary documents that are learned from, at most.
SAMPLE = (3000, 9000)
#: Words of a window.
WINDOW = 16
#: Bytes of the ordinary and the toxic dictionary, at most.
ORDINARY_BYTES = 98304
TOXIC_BYTES = 4096
#: Bytes of the strings that spans are made of.
GRAM = 5
#: A string sets toxic documents apart from this share of them on, and this
#: log of how much rarer it is in ordinary ones.
SHARE, LOG_ODDS = 0.01, 5.0
#: Windows of an ordinary document that its dictionary is trained on, at most.
ORDINARY_WINDOWS = 8
LEVEL = 9
#: Score from which a document counts as toxic (fixed value).
TOXIC = 0.7
GAINS = (1, 2, 3, 4)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(0, len(words), size)]


def grams(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words in one line, and the string that starts at each byte as a
    number; 0 where it would span two words."""
    line = b" " + b" ".join(words) + b" "
    x = np.frombuffer(line, np.uint8).astype(np.int64)
    n = max(0, len(x) - GRAM + 1)
    code = np.zeros(n, np.int64)
    for k in range(GRAM):
        code = code << 8 | x[k:n + k]
    for k in range(1, GRAM - 1):
        code[x[k:n + k] == 32] = 0
    return line, code


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    curve: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def gains(self):
        """A function from words to the bytes each window gains."""
        import zstandard as zs

        def compressor(content: bytes):
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            p = zs.ZstdCompressionParameters.from_level(
                LEVEL, min_match=GRAM, window_log=18, hash_log=17, chain_log=17, write_content_size=0,
                write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS)
            d.precompute_compress(compression_params=p)
            return zs.ZstdCompressor(dict_data=d, compression_params=p).compress

        plain, toxic = compressor(self.ordinary), compressor(self.toxic + self.ordinary)
        return lambda words: [len(plain(w)) - len(toxic(w)) for w in windows(words)]


def features(gains: list[int]) -> list[float]:
    n = len(gains)
    return [float(max(gains, default=0)), *(20 * min(0.5, sum(g >= q for g in gains) / (n + 2)) for q in GAINS),
            math.log(n + 1)]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic) of the labelled documents that are learned from."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic").distinct()
    ids = None
    for toxic, most in zip((1, 0), SAMPLE):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        ids = part if ids is None else ids.unionAll(part)
    return saved(docs.select("doc_id", "text").join(F.broadcast(saved(ids, "toxic-ids")), "doc_id"), "toxic-sample")


def _gram_counts(batches):
    codes, counts = np.empty(0, np.int64), np.empty((0, 2), np.int64)
    for b in batches:
        parts: list[list[np.ndarray]] = [[], []]
        for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
            parts[toxic].append(np.unique(grams(words_of(text.as_py()))[1]))
        new = [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]
        every, at = np.unique(np.concatenate([codes, *new]), return_inverse=True)
        total = np.zeros((len(every), 2), np.int64)
        np.add.at(total, at[:len(codes)], counts)
        for k in (0, 1):
            total[:, k] += np.bincount(at[len(codes) + (len(new[0]) if k else 0):][:len(new[k])], minlength=len(every))
        codes, counts = every, total
    keep = codes != 0
    yield pa.record_batch([pa.array(codes[keep]), pa.array(counts[keep, 0]), pa.array(counts[keep, 1])],
                          ["gram", "ordinary", "toxic"])


def spans(words: list[bytes], chosen: np.ndarray) -> list[bytes]:
    line, code = grams(words)
    hit = np.isin(code, chosen)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [line[a:z + GRAM - 1] for a, z in edge.reshape(-1, 2).tolist()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of (doc_id, text) and labels (doc_id, toxic)."""
    import zstandard as zs

    spark = docs.sparkSession
    bounded_batches(spark)
    sample = _sample(docs, labels)
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model()
    share = F.log((F.col("toxic") + 0.1) / (n[1] + 1)) - F.log((F.col("ordinary") + 0.1) / (n[0] + 1))
    chosen = (sample.select("text", "toxic").mapInArrow(_gram_counts, "gram long, ordinary long, toxic long")
              .groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
              .where((F.col("toxic") >= max(4, SHARE * n[1])) & (share > LOG_ODDS))
              .orderBy(F.desc("toxic"), "gram").limit(1 << 14).collect())
    codes = spark.sparkContext.broadcast(np.array(sorted(r["gram"] for r in chosen), np.int64))

    def toxic_spans(batches):
        for b in batches:
            found = [s for t in b.column("text") for s in spans(words_of(t.as_py()), codes.value)]
            yield pa.record_batch([pa.array(found, pa.binary())], ["span"])

    counted = (sample.where("toxic = 1").select("text").mapInArrow(toxic_spans, "span binary")
               .groupBy("span").count().where("count > 2").orderBy(F.desc("count"), "span").limit(TOXIC_BYTES // GRAM).collect())
    parts: list[bytes] = []
    for r in counted:
        s = bytes(r["span"])
        if sum(map(len, parts)) + len(s) <= TOXIC_BYTES and not any(s in p for p in parts):
            parts.append(s)

    def ordinary_windows(batches):
        for b in batches:
            some = []
            for t in b.column("text"):
                some += spread(windows(words_of(t.as_py())), ORDINARY_WINDOWS)
            yield pa.record_batch([pa.array(some, pa.binary())], ["part"])

    plain = [bytes(r["part"]) for r in sample.where("toxic = 0").select("text")
             .mapInArrow(ordinary_windows, "part binary").orderBy(F.xxhash64("part")).collect()]
    try:
        ordinary = zs.train_dictionary(ORDINARY_BYTES, plain, k=48, d=6).as_bytes()
    except zs.ZstdError:  # too little text to train on: the text itself
        ordinary = b"".join(plain)[-ORDINARY_BYTES:]
    model = Model(ordinary, b"".join(reversed(parts)))

    shared = spark.sparkContext.broadcast(model)

    def measured(batches):
        gains = shared.value.gains()
        for b in batches:
            f = [features(gains(words_of(t.as_py()))) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array(f, pa.list_(pa.float64()))],
                                  ["doc_id", "toxic", "f"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(measured, f"doc_id {kind}, toxic int, f array<double>").orderBy("doc_id", "toxic").collect()
    model.curve = logistic(np.array([r["f"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return model


def spread(items: list, n: int) -> list:
    """At most ``n`` of ``items``, evenly spread from the first to the last."""
    return items if len(items) <= n else [items[k * (len(items) - 1) // (n - 1)] for k in range(n)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients and the constant (last), by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def value(curve: np.ndarray, f: list[float]) -> float:
    x = float(np.dot(curve[:-1], f) + curve[-1])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``_score``, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run():
        m = shared.value
        if not len(m.curve):
            return lambda texts: [0.0] * len(texts)
        gains = m.gains()
        return lambda texts: [value(m.curve, features(gains(words_of(t)))) for t in texts]

    return with_python_column(docs, "_score", DoubleType(), run)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below ``TOXIC``, with their columns."""
    return score(docs, fit(docs, labels)).where(F.col("_score") < TOXIC).select(*docs.columns)
