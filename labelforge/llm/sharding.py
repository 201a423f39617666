"""Sharding by histogram sort.

Rows are ordered by a 128-bit key: a hash of the text, then a hash of the
doc_id. Splitters between shards are found by counting: each round counts the
exact bytes and rows below candidate keys, summed on the partitions before the
shuffle, and refines the probes around each boundary until the splitter is
within tolerance of its share of the bytes. The rows are then exchanged once.

The first half of the key orders whole groups of equal texts; a group is split
(by the second half) only where a boundary falls into it and its edge would
miss the tolerance. Repeated rows (equal text and doc_id) have one key; where they
hold more than a part of the tolerance they are numbered, written once with
their numbers, and dealt by those instead. Slots are counted from finer cells of the same order, so
no task numbers a whole shard.

Defined results: a null text has size 1 and crc32 0 and is a group of its own;
repeated rows are separate rows; an empty table gives no rows; extra columns
travel with their row, a column named like one of the results is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from labelforge.llm.common import saved, sorted_join

#: Bits of a half of the key that one round tells apart (buckets of a round).
ROUND_BITS = 10
#: A splitter may miss its place by this part of a shard's share.
TOLERANCE = 0.005
#: Rows that one task numbers, about.
CELL_ROWS = 250_000
#: Groups of copies of over 1 / MOST_GROUPS of all rows get cells of their own.
MOST_GROUPS = 1000

TOP = 1 << 64


@dataclass
class Probe:
    """An interval [low, high) of keys that holds a boundary, with the bytes
    below it. Keys are (text hash, doc hash) as one 128-bit integer."""
    target: int
    low: int
    high: int
    below: int
    best: int
    best_gap: int


def with_key(df: DataFrame) -> DataFrame:
    """Adds size, text_crc32 and the halves of the key, both signed 64 bits."""
    text = F.coalesce("text", F.lit(""))
    return df.withColumns({
        "size": (F.octet_length(text) + 1).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "_hi": F.xxhash64("text", F.col("text").isNull()),
        "_lo": F.xxhash64(F.col("doc_id").cast("string"), F.lit("doc")),
    })


def _signed(x: int) -> int:
    return x - (TOP >> 1)


def _below(key: int):
    """Is a row's key below ``key``?"""
    hi, lo = divmod(key, TOP)
    if hi >= TOP:
        return F.lit(True)
    h, low = F.lit(_signed(hi)).cast("long"), F.lit(_signed(lo)).cast("long")
    return (F.col("_hi") < h) | ((F.col("_hi") == h) & (F.col("_lo") < low))


def find_splitters(keys: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """``shards - 1`` keys that cut the bytes of ``keys`` (_hi, _lo, size) into
    near equal shares. Each round reads the narrow keys once and brings at most
    (shards - 1) x 2^ROUND_BITS counts to the driver."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    allowed = max(1, int(tolerance * total / shards))
    probes = [Probe(total * (i + 1) // shards, 0, TOP * TOP, 0, 0, total + 1) for i in range(shards - 1)]
    open_ = list(range(shards - 1)) if total else []
    while open_:
        spans = sorted({(probes[i].low, probes[i].high) for i in open_})
        cells = F.lit(None).cast("struct<span:int,cell:long>")
        for s, (low, high) in reversed(list(enumerate(spans))):
            # the key's bits below the span's fixed ones; a span is a power of two
            bits = (high - low).bit_length() - 1
            half, shift = ("_hi", bits - 64) if bits > 64 else ("_lo", bits)
            offset = F.col(half).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # unsigned order
            take = min(ROUND_BITS, shift)
            cell = F.shiftrightunsigned(offset, shift - take).bitwiseAND(F.lit((1 << take) - 1).cast("long"))
            inside = (~_below(low) if low else F.lit(True)) & _below(high)
            cells = F.when(inside, F.struct(F.lit(s).alias("span"), cell.alias("cell"))).otherwise(cells)
        counts = (keys.select(cells.alias("c"), "size").where("c is not null")
                  .groupBy("c.span", "c.cell").agg(F.sum("size").alias("bytes")).collect())
        table: dict[int, list] = {}
        for r in counts:
            table.setdefault(r["span"], []).append((r["cell"], r["bytes"]))
        still = []
        for i in open_:
            p = probes[i]
            s = spans.index((p.low, p.high))
            bits = (p.high - p.low).bit_length() - 1
            take = min(ROUND_BITS, bits - 64 if bits > 64 else bits)
            width = 1 << (bits - take)
            below, low, high, under = p.below, p.low, p.high, p.below
            for cell, n in sorted(table.get(s, [])):
                if abs(below - p.target) < p.best_gap:
                    p.best, p.best_gap = p.low + cell * width, abs(below - p.target)
                if below <= p.target < below + n:
                    low, high, under = p.low + cell * width, p.low + (cell + 1) * width, below
                below += n
            if abs(below - p.target) < p.best_gap:
                p.best, p.best_gap = p.high, abs(below - p.target)
            p.low, p.high, p.below = low, high, under
            if p.best_gap > allowed and width > 1 and (low, high) != (0, TOP * TOP):
                still.append(i)
        open_ = still
    out = []
    for p in probes:
        out.append(max(p.best, out[-1]) if out else p.best)
    return out


def _numbered_repeats(keyed: DataFrame, shards: int, tolerance: float) -> DataFrame:
    """``keyed`` with keys of their own for repeated rows that are too many, or too
    large, to lie in one place. Such keys are at most 4 x shards / tolerance and
    MOST_GROUPS, so they are broadcast; their rows are written once, as a number given
    again by a task that runs again could differ."""
    per = saved(keyed.groupBy("_hi", "_lo").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes")).where("_n > 1"), "repeated-keys")
    rows, size = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    hot = per.where((F.col("_bytes") > tolerance * size / shards / 4) | (F.col("_n") > max(1000, rows // MOST_GROUPS))).select("_hi", "_lo")
    if not hot.head(1):
        return keyed
    own = keyed.join(F.broadcast(hot), ["_hi", "_lo"], "left_semi").withColumn("_no", F.monotonically_increasing_id())
    own = saved(own, "repeated-rows").withColumn("_lo", F.xxhash64("_lo", "_no")).drop("_no")
    return keyed.join(F.broadcast(hot), ["_hi", "_lo"], "left_anti").unionByName(own)


def shard(docs: DataFrame, shards: int = 16, cell_rows: int = CELL_ROWS, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with size, text_crc32, shard and slot (gapless from 0 within a
    shard, by cells of the key's order)."""
    keyed = with_key(docs.drop("size", "text_crc32", "shard", "slot", "_hi", "_lo", "_cell"))
    keyed = _numbered_repeats(keyed, shards, tolerance)
    keys = saved(keyed.select("_hi", "_lo", "size"), "shard-keys")
    number = F.lit(0)
    for s in find_splitters(keys, shards, tolerance):
        number = number + (~_below(s)).cast("int")

    # Cells that one task numbers: equal parts of the first half of the key. A
    # group of over a thousandth of the rows (at most a thousand such groups,
    # so they are broadcast) has cells of its own, parts of the second half.
    rows = keys.count()
    fine = 8
    while fine * shards * cell_rows < rows:
        fine *= 2
    large = max(1, min(cell_rows, rows // MOST_GROUPS))
    groups = (keys.groupBy("_hi").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(large, rows // MOST_GROUPS))
              .select("_hi", F.ceil(F.col("_n") / large).alias("_parts")))
    unsigned = [F.col(c).bitwiseXOR(F.lit(-(1 << 63)).cast("long")) for c in ("_hi", "_lo")]
    part = F.floor(F.shiftrightunsigned(unsigned[1], 32) * F.col("_parts") / F.lit(float(1 << 32)))
    cell = F.struct(F.shiftrightunsigned(unsigned[0], 64 - (fine * shards).bit_length()).alias("a"),
                    F.when(F.col("_parts").isNotNull(), F.col("_hi")).alias("b"), part.cast("long").alias("c"))
    placed = keyed.withColumn("shard", number).join(F.broadcast(groups), "_hi", "left").withColumn("_cell", cell)

    sizes = (keys.withColumn("shard", number).join(F.broadcast(groups), "_hi", "left").withColumn("_cell", cell)
             .groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n")))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
        Window.partitionBy("shard").orderBy("_cell.a", "_cell.b", "_cell.c")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("shard", "_cell").orderBy("_hi", "_lo", "doc_id")) - 1
    return (sorted_join(placed.withColumn("_place", place), before, ["shard", "_cell"])
            .withColumn("slot", (F.col("_before") + F.col("_place")).cast("long"))
            .drop("_hi", "_lo", "_cell", "_place", "_before", "_parts"))
