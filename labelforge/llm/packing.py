"""Packing of token pieces into sequences by a configuration linear program.

A document's ids and one end id are one piece; only longer documents are cut
into whole sequences, their first piece being the shorter one. Pieces count by
length only, so the program has a row for each length and a column for each
configuration (lengths that share a sequence). It is solved by multiplicative
weights: each step prices the lengths by how far they are from being covered,
a knapsack dynamic program finds the configuration of highest price, and its
use grows. The solution is rounded down, and what is left is placed by best
fit, longest first. All this takes the histogram
alone, whatever the corpus; pieces get their places by their rank among those
of their length.

Defined results: a null text counts as empty and is a piece of the end id
alone; repeated rows and null doc_ids are pieces of their own; an empty table
gives no rows; ties (pieces of one length) are ranked by hash; extra columns
are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelforge.llm.bpe import encoder
from labelforge.llm.common import bounded_batches, saved, sorted_join

CAPACITY = 1024
END_ID = 2
#: Share of a length whose cover divides its weight by e, and most steps.
STEP = 1.0
STEPS = 800
#: Power of a length in its price: above 1, long pieces come first.
EXPONENT = 1.1
#: Pieces of one length that one task ranks, about.
CELL_ROWS = 100_000

def _cut(spec, capacity: int, end_id: int):
    def run(batches):
        ids_of = encoder(spec.value)
        for b in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.append(ids_of((text.as_py() or "").encode()), end_id).astype("<u4")
                first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                starts = [0, *range(first, len(ids), capacity)]
                for k, (x, y) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    for r, v in zip(rows, (doc, k, x, y - x, zlib.crc32(ids[x:y].tobytes()))):
                        r.append(v)
            yield pa.record_batch([pa.array(rows[0], b.column("doc_id").type), pa.array(rows[1], pa.int32()),
                                   *(pa.array(r, pa.int64()) for r in rows[2:])],
                                  ["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def best_configuration(price: np.ndarray, capacity: int) -> dict[int, int]:
    """Lengths (1 to ``capacity``) of highest total price that fit, any number
    of each, by unbounded knapsack; price[0] is unused."""
    lengths = np.flatnonzero(price > 0)
    value = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    cost = price[lengths]
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, room, "right"))
        value[room] = value[room - 1]
        if n:
            got = value[room - lengths[:n]] + cost[:n]
            k = int(got.argmax())
            if got[k] > value[room]:
                value[room], last[room] = got[k], lengths[k]
    out: dict[int, int] = {}
    room = capacity
    while room:
        if last[room]:
            out[int(last[room])] = out.get(int(last[room]), 0) + 1
            room -= int(last[room])
        else:
            room -= 1
    return out


def solve(count: np.ndarray, capacity: int, steps: int = STEPS) -> list[tuple[dict[int, int], float]]:
    """Configurations without a gap and their (fractional) use, that cover each
    length at most once. The weight of a length falls by a constant factor with
    each share of it that is covered; a step uses up to half of what is left of
    its scarcest length. What no full sequence can cover stays open."""
    cover = np.zeros(capacity + 1)
    cover[count == 0] = 1.0
    use: dict[tuple, float] = {}
    lengths = np.arange(capacity + 1)
    for _ in range(steps):
        price = np.where(cover < 1 - 1e-9, lengths ** EXPONENT * np.exp(-cover / STEP), 0.0)
        got = best_configuration(price, capacity)
        if not got:
            break
        left = {n: (1 - cover[n]) * count[n] / k for n, k in got.items()}
        least = min(left.values())
        if sum(n * k for n, k in got.items()) < capacity or least < 1:
            scarce = min(left, key=left.get)
            cover[scarce] = 1.0  # left to the rounding
            continue
        grow = max(1.0, least / 2)
        for n, k in got.items():
            cover[n] += grow * k / count[n]
        key = tuple(sorted(got.items(), reverse=True))
        use[key] = use.get(key, 0.0) + grow
    return [(dict(k), x) for k, x in use.items()]


def best_fit(count: np.ndarray, capacity: int) -> dict[tuple, int]:
    """Configurations of best fit, longest pieces first: each piece goes to the
    fullest sequence with room for it. Sequences alike are handled at once."""
    room: list[dict[tuple, int]] = [{} for _ in range(capacity + 1)]

    def put(held: tuple, n: int, k: int, left: int, times: int):
        held = (*held[:-1], (n, held[-1][1] + k)) if held and held[-1][0] == n else (*held, (n, k))
        room[left][held] = room[left].get(held, 0) + times

    for n in range(capacity, 0, -1):
        todo, free = int(count[n]), n
        while todo and free <= capacity:
            if not room[free]:
                free += 1
                continue
            held, times = room[free].popitem()
            if times > todo:
                room[free][held] = times - todo
                times = todo
            put(held, n, 1, free - n, times)
            todo -= times
            if free - n >= n:
                free -= n
        if todo:  # no sequence has room: as many as fit to a new one
            fit = capacity // n
            if todo // fit:
                put((), n, fit, capacity - fit * n, todo // fit)
            if todo % fit:
                put((), n, todo % fit, capacity - todo % fit * n, 1)
    out: dict[tuple, int] = {}
    for r in room:
        for held, times in r.items():
            out[held] = out.get(held, 0) + times
    return out


def configurations(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Configurations and how many sequences have each; they hold exactly
    ``count`` pieces of each length."""
    left, out = count.astype(np.int64).copy(), {}
    for c, x in solve(left, capacity):
        times = min([int(x + 1e-9), *(int(left[n]) // k for n, k in c.items())])
        if times:
            out[tuple(c.items())] = times
            for n, k in c.items():
                left[n] -= k * times
    for c, times in best_fit(left, capacity).items():
        out[c] = out.get(c, 0) + times
    return [(dict(k), n) for k, n in out.items()]


def places(configs: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence, pieces of this length in each
    sequence, offset): pieces of one length take places in order of rank."""
    rows, rank, sequence = [], {}, 0
    for c, times in configs:
        offset = 0
        for n, k in c.items():
            rows.append((n, rank.get(n, 0), sequence, k, offset))
            rank[n] = rank.get(n, 0) + k * times
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(shared):
    def run(batches):
        table = shared.value
        keys = table[:, 0] * (1 << 48) + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "_rank"))
            row = table[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1]
            at = rank - row[:, 1]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                   pa.array(row[:, 2] + at // row[:, 3]), pa.array(row[:, 4] + at % row[:, 3] * length)],
                                  ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for
    each piece of each row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = saved(docs.select("doc_id", "text").mapInArrow(
        _cut(context.broadcast(tokenizer_json), capacity, end_id), columns), "pieces")
    count = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    table = context.broadcast(places(configurations(count, capacity)))

    cells = 64 * (1 + int(count.sum()) // (64 * CELL_ROWS))
    ranked = pieces.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(cells)).cast("int"))
    before = ranked.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(
        F.sum("_n").over(Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (sorted_join(ranked.withColumn("_own", own), before, ["length", "_cell"])
              .withColumn("_rank", (F.col("_before") + F.col("_own")).cast("long")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        _place(table), columns + ", sequence_id long, offset long")
