"""Language-model scoring by a probabilistic suffix tree.

The tree's symbols are the bytes of a text's words, one space between words and
one end symbol. Contexts of up to ``DEPTH`` symbols are counted over all
training texts; every context stays whose next-symbol counts diverge from those of its
suffix by more than their number of symbols explains (a likelihood-ratio test
with the Bayesian information criterion as its bar), and with it its suffixes. A
state's distribution is smoothed with that of its suffix. A symbol is scored by
the longest suffix before it that is a state.

The tree is a table of strings, a context and its next symbol in one number, as
large as the texts make it; no process holds it. Blocks of texts (``blocks.py``)
write their distinct strings of ``DEPTH`` + 1 symbols once, in order, as
differences. Summed over all blocks these are the deepest level; level by level
its rows are joined with those of the suffix, which leaves a probability for
each string, and the buckets answer the blocks with those they asked for.

Beside it stands a unigram base model over words (and one end per text) with
exact counts, looked up through the same blocks and buckets.

Defined results: a null text counts as empty and has one token, its end;
without training texts all counts are zero and the tree is uniform; repeated
rows are rows of their own and train as often as they stand; a null doc_id
belongs to the training part; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelforge.llm import blocks
from labelforge.llm.common import crc_mod_is, saved, sorted_join

#: Longest context, in symbols: 7 at most, as a context and its next symbol share a long.
DEPTH = 5
#: Share of the criterion's penalty that a context's gain must exceed.
BAR = 1.0
#: Bytes of text in a block: the larger, the fewer strings are asked for twice.
BLOCK_BYTES = 12 << 20
END = 10  # the end symbol and the padding before a text: no word holds it


def symbols(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def _slices(texts, depth: int):
    """(symbols, places, whose) of some texts at a time: the places of ``symbols``
    that are scored, each with ``depth`` symbols before it, and the texts' numbers."""
    def joined(parts, owners):
        flat = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts])
        scored = np.ones(len(flat), bool)
        for k in range(depth):
            scored[np.cumsum(sizes) - sizes + k] = False
        return flat, np.flatnonzero(scored), np.repeat(owners, sizes - depth)

    pad, parts, owners, size = b"\n" * depth, [], [], 0
    for i, t in enumerate(texts):
        s = symbols(t)
        for x in range(0, len(s), 1 << 20):  # a long text in slices, each with its context
            parts.append((pad if x == 0 else s[x - depth:x]) + s[x:x + (1 << 20)])
            owners.append(i)
            size += len(parts[-1])
            if size > 2 << 20:
                yield joined(parts, owners)
                parts, owners, size = [], [], 0
    if parts:
        yield joined(parts, owners)


def _codes(flat: np.ndarray, depth: int) -> np.ndarray:
    """The strings of ``depth`` + 1 symbols that end at each place from ``depth`` on, as numbers."""
    code = np.zeros(len(flat) - depth, np.uint64)
    for k in range(depth + 1):
        code <<= np.uint64(8)
        code |= flat[k:len(flat) - depth + k]
    return code


def _runs(code: np.ndarray) -> np.ndarray:
    """Where the runs of equal numbers in ``code``, which is in order, start."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(code)), bool), code[1:] != code[:-1]]))


def _distinct(texts: list[bytes], depth: int, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct strings, in order, and their numbers in its texts marked ``train``."""
    codes, counts = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for flat, at, whose in _slices(texts, depth):
        code, learn = _codes(flat, depth)[at - depth], train[whose]
        for part, counted in ((code[learn], 1), (code[~learn], 0)):
            part.sort()
            starts = _runs(part)
            codes.append(part[starts])
            counts.append(np.diff(starts, append=len(part)).astype(np.uint64) * np.uint64(counted))
    every, n = np.concatenate(codes), np.concatenate(counts)
    del codes, counts
    order = np.argsort(every, kind="stable")  # merges the slices, each in order
    every, n = every[order], n[order]
    starts = _runs(every)
    return every[starts], np.add.reduceat(n, starts) if len(n) else n


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of strings; those that differ in their last two symbols alone share one, so that a
    bucket's strings lie close together."""
    mixed = (code >> np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
    return blocks.bucket_of(mixed ^ (mixed << np.uint64(29)), buckets).astype(np.uint16)


def _pack(x: np.ndarray) -> bytes:
    """An array by the bytes of its numbers, the same byte of all beside each other: the high ones
    are mostly zero, which the shuffle's compression takes out."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpack(x: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _steps(code: np.ndarray) -> bytes:
    return _pack(np.diff(code, prepend=np.uint64(0)))


def _sums(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x, np.uint64), dtype=np.uint64)


def _leaf(batches):
    """Rows (code, n) of a block's part of a bucket."""
    for b in batches:
        for grams, seen in zip(b.column("grams"), b.column("seen")):
            code, n = _sums(grams.as_py()).view(np.int64), _unpack(seen.as_py(), np.int64)
            for x in range(0, len(code), 1 << 16):
                yield pa.record_batch([pa.array(code[x:x + (1 << 16)]), pa.array(n[x:x + (1 << 16)])], ["code", "n"])


def _mask(symbols: int):
    return F.lit((1 << 8 * symbols) - 1).cast("long")


def probabilities(leaf: DataFrame, depth: int = DEPTH, bar: float = BAR) -> DataFrame:
    """(code, p) for every row (code, n) of ``leaf``, the strings of ``depth`` + 1 symbols
    with their numbers in training texts: the probability of the last symbol after the others."""
    context = F.shiftrightunsigned("code", 8).alias("ctx")
    same = Window.partitionBy("ctx")  # at most 256 rows
    rows = leaf.select("code", "n")
    levels: list[DataFrame] = []
    for k in range(depth, -1, -1):
        if k < depth:
            rows = (levels[0].select(F.col("code").bitwiseAND(_mask(k + 1)).alias("code"), "n")
                    .groupBy("code").agg(F.sum("n").alias("n")))
        levels.insert(0, saved(rows.select("code", "n", context).select(
            "code", "n", F.sum("n").over(same).alias("total"),
            F.sum((F.col("n") > 0).cast("int")).over(same).cast("int").alias("kinds")), f"pst-level-{k}"))
    stay = None  # contexts that pass, and suffixes of those that do
    states = []
    for k in range(depth, 0, -1):
        above = levels[k - 1].where("n > 0").select(F.col("code").alias("up"), (F.col("n") / F.col("total")).alias("q"))
        gains = (sorted_join(levels[k].where("n > 0").withColumn("up", F.col("code").bitwiseAND(_mask(k))), above, "up")
                 .groupBy(context, "total", "kinds")
                 .agg(F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q"))).alias("gain")))
        passed = gains.where(F.col("gain") > F.lit(bar / 2) * F.col("kinds") * F.log(F.col("total") + 1)).select("ctx")
        stay = saved(passed if stay is None else
                     passed.union(stay.select(F.col("ctx").bitwiseAND(_mask(k)).alias("ctx"))).distinct(), f"pst-states-{k}")
        states.insert(0, stay)
    p = None
    for k, level in enumerate(levels):
        if k == 0:
            level = level.withColumns({"above": F.lit(1 / 256), "state": F.col("kinds") > 0})
        else:
            level = sorted_join(sorted_join(level.withColumn("up", F.col("code").bitwiseAND(_mask(k))), p, "up").withColumn(
                "ctx", F.shiftrightunsigned("code", 8)), states[k - 1].withColumn("state", F.lit(True)), "ctx", "left")
        own = (F.col("n") + F.col("kinds") * F.col("above")) / (F.col("total") + F.col("kinds"))
        level = level.withColumn("p", F.when(F.col("state"), own).otherwise(F.col("above")))
        p = level.select(F.col("code").alias("up"), F.col("p").alias("above"))
    return level.select("code", "p")


def _by_bucket(buckets: int):
    """Rows (bucket, code, logp) of the strings (code, p)."""
    def run(batches):
        for b in batches:
            code = b.column("code")
            yield pa.record_batch([pa.array(_bucket(code.to_numpy().view(np.uint64), buckets).astype(np.int32)), code,
                                   pa.array(np.log10(b.column("p").to_numpy()).astype(np.float32))], ["bucket", "code", "logp"])
    return run


def _ask(buckets: int, depth: int):
    """A block's distinct words, by hash, and its distinct strings, each with
    their counts in its training texts: one row for each bucket."""
    def run(table: pa.Table) -> pa.Table:
        import xxhash

        texts = blocks.texts(table)
        trains = ~table.column("held_out").to_numpy()
        train, other = Counter(), set()
        for t, learn in zip(texts, trains.tolist()):
            (train if learn else other).update(t.lower().split())
        words = [*train, *(other - train.keys())]
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        n = np.zeros(len(words), np.uint64)
        n[:len(train)] = list(train.values())
        h, first = np.unique(h, return_index=True)
        n = n[first]
        g, seen = _distinct(texts, depth, trains)
        b = _bucket(g, buckets)
        order = np.argsort(b, kind="stable")
        g, seen, b = g[order], seen[order], b[order]
        edges = np.searchsorted(b, np.arange(buckets + 1, dtype=np.int64)).tolist()
        word = {i: (x, y) for i, x, y in (blocks.by_bucket(h, buckets) if len(h) else [])}
        rows = [i for i in range(buckets) if i in word or edges[i] < edges[i + 1]]
        words, grams = [word.get(i, (0, 0)) for i in rows], [(edges[i], edges[i + 1]) for i in rows]
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(rows), pa.int32()),
                         "bucket": pa.array(rows, pa.int32()),
                         "hashes": pa.array([h[x:y].tobytes() for x, y in words], pa.binary()),
                         "counts": pa.array([_pack(n[x:y]) for x, y in words], pa.binary()),
                         "grams": pa.array([_steps(g[x:y]) for x, y in grams], pa.binary()),
                         "seen": pa.array([_pack(seen[x:y]) for x, y in grams], pa.binary())})
    return run


def _answer(table: pa.Table, known: pa.Table) -> pa.Table:
    """Counts over all blocks and the strings' log10 probabilities, in the order
    each block asked; the bucket's own sums stand on its first row."""
    hashes = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("hashes")]
    counts = [_unpack(x.as_py(), np.uint64) for x in table.column("counts")]
    every, at = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(every)).astype(np.uint64)
    found = np.split(total[at], np.cumsum([len(h) for h in hashes])[:-1])
    rest = [0] * (len(hashes) - 1)
    code = known.column("code").to_numpy().view(np.uint64)
    order = np.argsort(code)
    code, logp = code[order], known.column("logp").to_numpy()[order]
    steps = [_pack(logp[np.searchsorted(code, _sums(x.as_py()))]) for x in table.column("grams")]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                     "counts": pa.array([_pack(f) for f in found], pa.binary()),
                     "steps": pa.array(steps, pa.binary()),
                     "distinct": pa.array([int((total > 0).sum()), *rest], pa.int64()),
                     "tokens": pa.array([int(total.sum()), *rest], pa.int64())})


def _read(buckets: int, depth: int):
    """What a block's answers say of its texts, without what needs the totals of all blocks: tokens
    and known ones, log10 of the counts plus one over the words, the strings' log10 probabilities.
    The sums of the buckets whose first row came here stand on the block's first text."""
    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        import xxhash

        text = blocks.texts(table)
        rows = sorted(zip(*(answer.column(c).to_pylist() for c in ("bucket", "counts", "steps"))))
        distinct = set()
        for t in text:
            distinct.update(t.lower().split())
        distinct = list(distinct)
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
        _, at = np.unique(h, return_inverse=True)
        per = dict(zip(distinct, np.concatenate([_unpack(r[1], np.uint64) for r in rows])[at].tolist()))
        sizes, known, base = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64), np.zeros(len(text))
        for i, t in enumerate(text):
            ws = t.lower().split()
            c = np.fromiter(map(per.__getitem__, ws), np.float64, len(ws))
            sizes[i], known[i], base[i] = len(ws), np.count_nonzero(c), np.log10(c + 1).sum()
        del distinct, per
        codes, places = [np.empty(0, np.uint64)], []
        for flat, at, whose in _slices(text, depth):
            where, found = pd.factorize(_codes(flat, depth)[at - depth])
            codes.append(found)
            ends = np.append(np.flatnonzero(np.diff(whose)) + 1, len(whose))
            places.append((where.astype(np.uint32), whose[ends - 1], np.diff(ends, prepend=0), len(found)))
        grams, at = np.unique(np.concatenate(codes), return_inverse=True)
        del codes
        logp = np.empty(len(grams), np.float32)
        logp[np.argsort(_bucket(grams, buckets), kind="stable")] = np.concatenate([_unpack(r[2], np.float32) for r in rows])
        of_slices = logp[at].astype(float)
        del grams, at, logp
        total, done = np.zeros(len(text)), 0
        for where, whose, sizes_there, n_found in places:
            total += np.bincount(np.repeat(whose, sizes_there), of_slices[done:done + n_found][where], len(text))
            done += n_found
        rest = [0] * (len(text) - 1)
        return pa.table({"doc_id": table.column("doc_id"), "held_out": table.column("held_out"),
                         "words": pa.array(sizes, pa.int64()), "known": pa.array(known),
                         "base": pa.array(base), "score": pa.array(total),
                         "distinct": pa.array([sum(answer.column("distinct").to_pylist()), *rest], pa.int64()),
                         "tokens": pa.array([sum(answer.column("tokens").to_pylist()), *rest], pa.int64())})
    return run


def score(docs: DataFrame, held_out, depth: int = DEPTH, bar: float = BAR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    for every row of ``docs``; ``held_out`` is the column of rows not learned."""
    if not 1 <= depth <= 7:
        raise ValueError("depth must be from 1 to 7")
    d = docs.select("doc_id", "text").withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    block, n_blocks = blocks.blocked(d, "held_out", block_bytes=block_bytes)
    buckets = min(blocks.MOST_BUCKETS, n_blocks)
    asked = saved(block.groupBy("block").applyInArrow(
        _ask(buckets, depth), "block int, bucket int, hashes binary, counts binary, grams binary, seen binary"), "lm-asked")
    leaf = asked.select("grams", "seen").mapInArrow(_leaf, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    steps = probabilities(leaf, depth, bar).mapInArrow(_by_bucket(buckets), "bucket int, code long, logp float")
    answers = asked.select("block", "bucket", "hashes", "counts", "grams").groupBy("bucket").cogroup(
        steps.groupBy("bucket")).applyInArrow(
        _answer, "block int, bucket int, counts binary, steps binary, distinct long, tokens long")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = saved(block.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _read(buckets, depth), f"doc_id {kind}, held_out boolean, words long, known long, base double, score double,"
                               " distinct long, tokens long"), "lm-rows")
    known, tokens, training = (x or 0 for x in rows.agg(
        F.sum("distinct"), F.sum("tokens"), F.sum((~F.col("held_out")).cast("long"))).first())
    known, tokens = known + (training > 0), tokens + training  # the end of each text
    n = F.col("words") + 1
    return rows.select("doc_id", "held_out", n.alias("n_tokens"), (F.col("known") + int(training > 0)).alias("n_known"),
                       F.lit(tokens).cast("long").alias("train_tokens"),
                       (F.col("base") + log10(training + 1) - n * log10(tokens + known + 1)).alias("base_score"), "score")


def held_out(mod: int = 7, rest: int = 2):
    return crc_mod_is(F.col("doc_id"), mod, rest)
