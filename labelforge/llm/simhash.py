"""SimHash near-duplicates by the generalised pigeonhole principle.

Each text has a 64-bit fingerprint: bit i is the majority of bit i over the
hashes of its word shingles. Fingerprints link at ``most`` or fewer differing
bits. The 64 bits are grouped into partitions of correlated bits; partition i
gets a threshold t_i, with sum(t_i) = most - m + 1, so that two linked
fingerprints differ in at most t_i bits of some partition i. Number of
partitions and thresholds come from a dynamic program on estimated candidate
counts. A fingerprint is indexed by its value in each partition, probes the
values within t_i, and what it meets is verified on all 64 bits.

A bucket of many fingerprints (a large group of near copies) is not compared in
pairs: the fingerprints that meet there emit the codes within most / 2 bits of
themselves (and the rest of most on the other side). Two of them share a code
if and only if they differ in at most ``most`` bits, so linking each to the
smallest fingerprint of each code gives the same components, with rows linear
in the fingerprints.

Defined results: a null text counts as empty; a text without words has
fingerprint zero, which is linked like any other; a text of fewer words than a
shingle has its whole sequence as its shingle; repeated rows and null doc_ids
are rows of their own (a null doc_id is no component's name unless the whole
component has none); extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from labelforge.llm.common import connected_components, saved, sorted_join, with_python_column

SHINGLE_WORDS = 4
MOST_BITS = 4
#: A bucket of more fingerprints than this is linked by shared codes.
PAIRWISE = 64
#: Cost of a candidate in the dynamic program, in probes.
CANDIDATE_COST = 1.0

SEED = 42  # fixed value: seed of the shingles' XXH64


def fingerprint(text: bytes, words_in: int = SHINGLE_WORDS) -> int:
    import xxhash

    words = text.lower().split()  # bytes: A-Z only; splits at space and 9 to 13
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_in, n)
    spans = list(zip(starts[:n - k + 1].tolist(), ends[k - 1:].tolist()))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(spans), 16384):
        part = spans[at:at + 16384]
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), np.uint64, len(part))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16).astype(np.int64)
    return int(np.packbits(counts * 2 > len(spans), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, words_in: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` with ``_fp``, the fingerprint's bits as a long."""
    def run():
        def make(texts: list[str | None]) -> np.ndarray:
            return np.array([fingerprint((t or "").encode(), words_in) for t in texts], np.uint64).view(np.int64)
        return make

    return with_python_column(docs, "_fp", LongType(), run)


def bits_of(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlations(fps: DataFrame) -> np.ndarray:
    """|correlation| of each two bits over all fingerprints: counts of 65 x 65
    bit pairs, added up on the executors."""
    def run(batches):
        total = np.zeros((65, 65), np.int64)
        for b in batches:
            x = bits_of(b.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
            total += (x.T @ x).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(65 * 65)), pa.array(total.ravel())], ["at", "n"])

    got = (fps.select("_fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect())
    c = np.zeros(65 * 65)
    for r in got:
        c[r["at"]] = r["n"]
    c = c.reshape(65, 65)
    n, p = max(c[64, 64], 1.0), c[64, :64] / max(c[64, 64], 1.0)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs((c[:64, :64] / n - np.outer(p, p)) / np.outer(sd, sd))


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near equal width; each starts with the free bit of the
    strongest correlations and takes the bits most correlated with it so far."""
    free, out = set(range(64)), []
    for i in range(parts):
        width = 64 // parts + (i < 64 % parts)
        order = sorted(free)
        first = max(order, key=lambda b: (corr[b, order].sum(), -b))
        group = [first]
        free.discard(first)
        while len(group) < width:
            nxt = max(sorted(free), key=lambda b: (corr[b, group].sum(), -b))
            group.append(nxt)
            free.discard(nxt)
        out.append(sorted(group))
    return out


def ball(width: int, radius: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``radius`` bits set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)], np.uint64)


def allocate(widths: list[int], same: list[float], n: int, most: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with sum most - m + 1, each at least -1 (not
    probed). ``same``: pairs of equal value in each partition; further pairs
    come closer as under independent bits."""
    m = len(widths)

    def cost(i: int, t: int) -> float:
        if t < 0:
            return 0.0
        probes = sum(comb(widths[i], r) for r in range(t + 1))
        return n * probes + CANDIDATE_COST * (same[i] + n * n / 2 * (probes - 1) / 2.0 ** widths[i])

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, min(most, widths[i]) + 1):
                new = (c + cost(i, t), [*ts, t])
                if s + t not in nxt or new[0] < nxt[s + t][0]:
                    nxt[s + t] = new
        best = nxt
    return best[most - m + 1]


def part_value(x: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(x), np.uint64)
    for j, b in enumerate(bits):
        out |= ((x >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def _keys(groups: list[list[int]], thresholds: list[int], probe: bool):
    """Rows (key, _fp): the values of each probed partition, or those within
    its threshold. The partition's number stands in the key's high bits."""
    masks = [ball(len(g), t if probe else 0) if t >= 0 else None for g, t in zip(groups, thresholds)]

    def run(batches):
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 2048):
                x = every[at:at + 2048]
                for i, (g, mask) in enumerate(zip(groups, masks)):
                    if mask is None:
                        continue
                    keys = (part_value(x, g)[:, None] ^ mask[None, :]) | np.uint64(i << 58)
                    yield pa.record_batch([pa.array(keys.ravel().view(np.int64)),
                                           pa.array(np.repeat(x, len(mask)).view(np.int64))], ["key", "_fp"])
    return run


def _codes(radius: int):
    mask = ball(64, radius)

    def run(batches):
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), 256):
                x = every[at:at + 256]
                yield pa.record_batch([pa.array((x[:, None] ^ mask[None, :]).ravel().view(np.int64)),
                                       pa.array(np.repeat(x, len(mask)).view(np.int64))], ["code", "_fp"])
    return run


def plan_partitions(fps: DataFrame, most: int) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds, of least estimated cost."""
    n = fps.count()
    corr = correlations(fps)
    best = None
    for m in range(2, most + 2):
        groups = group_bits(corr, m)
        counted = (fps.mapInArrow(_keys(groups, [0] * m, False), "key long, _fp long")
                   .groupBy("key").agg(F.count(F.lit(1)).alias("n"))
                   .groupBy(F.shiftrightunsigned("key", 58).alias("part"))
                   .agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2).alias("pairs")).collect())
        pairs = {r["part"]: r["pairs"] for r in counted}
        cost, thresholds = allocate([len(g) for g in groups], [pairs.get(i, 0.0) for i in range(m)], n, most)
        if best is None or cost < best[0]:
            best = (cost, groups, thresholds)
    return best[1], best[2]


def links(fps: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (_fp) whose components are
    those of all pairs within ``most`` bits; every edge is such a pair or joins
    two fingerprints that share a code."""
    groups, thresholds = plan_partitions(fps, most)
    index = fps.mapInArrow(_keys(groups, thresholds, False), "key long, _fp long")
    probes = fps.mapInArrow(_keys(groups, thresholds, True), "key long, _fp long")
    sizes = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    small = (sorted_join(index, sizes.where(F.col("n") <= PAIRWISE), "key").groupBy("key")
             .agg(F.collect_list("_fp").alias("members")))
    buckets = sorted_join(sizes, small, "key", "left")  # members are null in a large bucket
    met = saved(sorted_join(probes, buckets, "key")
                .withColumn("near", F.expr(f"filter(members, v -> v > _fp and bit_count(v ^ _fp) <= {int(most)})"))
                .where("near is null or size(near) > 0").select("_fp", "near"), "simhash-met")
    pairs = met.select(F.col("_fp").alias("a"), F.explode("near").alias("b"))

    crowd = met.where("near is null").select("_fp").distinct()
    lower = most // 2
    meets = crowd.mapInArrow(_codes(lower), "code long, _fp long")
    if most % 2 == 0:
        low = meets.groupBy("code").agg(F.min("_fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = sorted_join(meets, low, "code").where("_fp <> b").select(F.col("_fp").alias("a"), "b")
    else:  # codes of one side reach a bit further
        wide = crowd.mapInArrow(_codes(lower + 1), "code long, _fp long")
        low = wide.groupBy("code").agg(F.min("_fp").alias("b"))
        shared = (sorted_join(meets, wide.withColumnRenamed("_fp", "b"), "code").where("_fp < b")
                  .select(F.col("_fp").alias("a"), "b"))
    return pairs.union(shared).distinct()


def components(fingerprints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """(_fp, component_id) for the distinct fingerprints of (doc_id, _fp): the
    smallest doc_id reachable over links."""
    nodes = saved(fingerprints.groupBy("_fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    found = connected_components(links(nodes.select("_fp"), most), "simhash-components")
    of = saved(sorted_join(nodes, found.withColumnRenamed("node", "_fp"), "_fp", "left").select(
        "_fp", "first", F.coalesce("component", "_fp").alias("component")), "simhash-members")
    # tables of their own on both sides of the joins: Spark splits a large
    # component's, or a fingerprint's, rows only where no aggregate stands beside them
    least = saved(of.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-names")
    return saved(sorted_join(of, least, "component").select("_fp", "component_id"), "simhash-named")


def near_duplicates(docs: DataFrame, words_in: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``."""
    fps = saved(with_fingerprint(docs.select("doc_id", "text"), words_in).select("doc_id", "_fp"), "simhash")
    of = components(fps, most)
    return sorted_join(fps, of, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words_in: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """The row of the smallest doc_id of each component, with all columns."""
    row = {"__keep_none": F.col("doc_id").isNull(), "__keep_id": F.coalesce("doc_id", F.lit(0)),
           "__keep_text": F.xxhash64("text", F.col("text").isNull())}  # the text tells rows of one doc_id apart
    fps = with_fingerprint(docs.select("doc_id", "text"), words_in).withColumns(row).select("doc_id", *row, "_fp")
    fps = saved(fps, "simhash")
    named = sorted_join(fps, components(fps.select("doc_id", "_fp"), most), "_fp")
    one = named.groupBy("component_id").agg(F.min(F.struct("__keep_none", "__keep_id", "_fp", "__keep_text")).alias("k"))
    return sorted_join(docs.withColumns(row), one.select(*[f"k.{c}" for c in row]), list(row), "left_semi").dropDuplicates(
        list(row)).select(*docs.columns)
