"""Removal of long repeats by common-prefix interval trees of suffix arrays.

Every byte is removed that lies in a repeat of ``LEAST`` bytes or more which
also starts in a document with a smaller doc_id. The corpus' suffixes are dealt
out by anchors: of each window of ``LEAST`` bytes, the 16 bytes of smallest
hash. Equal windows have equal anchors, so no repeat is lost:

1. blocks of documents ask buckets which of their anchors stand in another
   document (``blocks.py``);
2. they send the distinct surroundings of the shared anchors (the windows that
   have this anchor, 50 to 84 bytes), each with its smallest document;
3. a bucket drops what has one surrounding only, builds an enhanced suffix
   array of the suffixes of the others, scans it with a stack for its
   common-prefix intervals, and takes the intervals whose occurrences differ to
   the left: the maximal repeats, with all their occurrences;
4. blocks get, for each surrounding, the windows that a smaller document has.

A surrounding that stands in a third of all documents is one entry of each
block, and no group of copies is spelled out. An anchor with very many different
surroundings (a short stock phrase) would be one large group: blocks tell
buckets how many they have, and above ``CROWD`` the windows of such an
anchor are dealt out one by one, each by a hash of its own.

Defined results: a null text counts as empty; texts shorter than ``LEAST``
bytes keep all; a document doesn't lose bytes to itself, so repeated rows (one
doc_id twice) don't take from each other; a null doc_id counts as larger than
all others; matches are found in the input, whatever else is removed; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from labelforge.llm import blocks

LEAST = 50  # bytes of a repeat; at most 64 windows may share an anchor
GRAM = 16  # bytes of an anchor
SLICE = (1 << 20) - 128  # windows looked at together
LAST = np.iinfo(np.int64).max
#: Different surroundings of an anchor that one task takes, about (2.6 KB each).
CROWD = 100_000

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]  # odd mixing constants


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def _words(buf: bytes | memoryview, n: int, at: int = 0) -> np.ndarray:
    """The 8 bytes from each of ``n`` places on, as numbers."""
    return np.ndarray((n,), "<u8", buf, at, (1,))


class Runs:
    """Runs of windows of the texts that have the same anchor: first and last
    window, the anchor's hash, and the number of the text."""

    def __init__(self, texts: list[bytes]):
        self.buf = b"".join(texts)
        self.ends = np.cumsum([len(t) for t in texts])
        n = len(self.buf) - LEAST + 1
        first, last, hashes = [], [], []
        if n > 0:
            inside = np.zeros(n + 1, np.int32)  # windows within one text
            starts = self.ends - [len(t) for t in texts]
            full = self.ends - starts >= LEAST
            np.add.at(inside, starts[full], 1)
            np.add.at(inside, (self.ends[full] - LEAST + 1), -1)
            inside = np.cumsum(inside[:-1]) > 0
            view = memoryview(self.buf)
            span = LEAST - GRAM + 1
            for s, e in self._slices(starts, n):
                count = e - s
                grams = count + span - 1
                h = _mix(_words(view, grams, s) * _C[0] + _mix(_words(view, grams, s + 8)))
                key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(grams, dtype=np.uint64)
                step = 1
                while 2 * step <= span:
                    key = np.minimum(key[:-step], key[step:])
                    step *= 2
                if step < span:
                    key = np.minimum(key[:len(key) - (span - step)], key[span - step:])
                anchor = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
                ok = inside[s:s + count]
                new = ok.copy()
                new[1:] &= ~ok[:-1] | (anchor[1:] != anchor[:-1])
                at = np.flatnonzero(new)
                stop = ok.copy()
                stop[:-1] &= ~ok[1:] | new[1:]
                first.append(at + s)
                last.append(np.flatnonzero(stop) + s)
                hashes.append(_mix(h[anchor[at]] ^ _C[0]))  # smallest hashes are small: spread them out
        self.first = np.concatenate(first) if first else np.empty(0, np.int64)
        self.last = np.concatenate(last) if last else np.empty(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.text = np.searchsorted(self.ends, self.first, "right")

    def _slices(self, starts: np.ndarray, n: int):
        """Ranges of windows to look at together: some whole texts, or a part of
        a long text cut at fixed places, so that a text's runs don't depend on
        the texts around it."""
        at = 0
        for start, end in zip(starts.tolist(), self.ends.tolist()):
            if end - at > SLICE and start > at:
                yield at, min(start, n)
                at = start
            while end - at > SLICE:  # only a long text gets here
                yield at, min(at + SLICE, n)
                at += SLICE
            if at >= n:
                return
        if at < n:
            yield at, n


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([LAST if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)


def _anchors(runs: Runs, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct anchors, which stand in documents of different doc_id, and a byte
    on the surroundings of each: the power of two of their number, and four bits
    that tell one set of them from another."""
    if not len(runs.hash):
        return runs.hash, np.empty(0, bool), np.empty(0, np.uint8)
    words = _words(memoryview(runs.buf), len(runs.buf) - 7)
    look = _mix(words[runs.first] * _C[0] + _mix(words[runs.last + (LEAST - 8)] + (runs.last - runs.first).astype(np.uint64)))
    order = np.lexsort((look, runs.hash))
    h, d, look = runs.hash[order], ids[runs.text[order]], look[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    at = np.flatnonzero(new)
    other = new | np.concatenate([[True], look[1:] != look[:-1]])
    n = np.add.reduceat(other.astype(np.int64), at)
    marks = _mix(np.add.reduceat(np.where(other, look, np.uint64(0)), at)) >> np.uint64(60)
    powers = np.minimum(np.frexp(n.astype(np.float64))[1] - 1, 15)
    return h[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at), (powers * 16 + marks.astype(np.int64)).astype(np.uint8)


def _table(block: int, buckets: list[int], shared: list[bytes], data: list[bytes]) -> pa.Table:
    n = len(buckets)
    return pa.table({"block": pa.array([block] * n, pa.int32()), "bucket": pa.array(buckets, pa.int32()),
                     "shared": pa.array(shared, pa.binary()), "data": pa.array(data, pa.binary())})


#: What blocks and buckets send: the bits of shared anchors, and the rest.
ROWS = "block int, bucket int, shared binary, data binary"


def _ask_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        h, several, crowd = _anchors(Runs(blocks.texts(table)), _ids(table))
        rows = blocks.by_bucket(h, buckets)
        return _table(table.column("block")[0].as_py(), [b for b, _, _ in rows], [b""] * len(rows),
                      [h[x:y].tobytes() + crowd[x:y].tobytes() + np.packbits(several[x:y]).tobytes() for _, x, y in rows])
    return run


def _entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(data) * 8 // 73  # 8 bytes, one byte and one bit each
    return (np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint8, n, 8 * n),
            np.unpackbits(np.frombuffer(data, np.uint8, -1, 9 * n), count=n).astype(bool))


def _answer_anchors(crowd: int):
    def run(table: pa.Table) -> pa.Table:
        """Two bits for each anchor: does it stand in another document, and has
        it over ``crowd`` surroundings? Blocks with equal marks may have the
        same ones; eight marks or more say that they don't."""
        asked = [_entries(x.as_py()) for x in table.column("data")]
        every, at, n = np.unique(np.concatenate([h for h, _, _ in asked]), return_inverse=True, return_counts=True)
        told = np.concatenate([c for _, c, _ in asked])
        many = np.left_shift(1, (told >> 4).astype(np.int64))
        marks = np.bincount(np.unique(at * 16 + (told & 15)) // 16, minlength=len(every))
        most = np.zeros(len(every), np.int64)
        np.maximum.at(most, at, many)
        total = np.bincount(at, many, len(every))
        packed = np.where(marks >= 8, total, most * marks) > crowd
        shared = n > 1
        shared[at[np.concatenate([s for _, _, s in asked])]] = True
        cuts = np.cumsum([len(h) for h, _, _ in asked])[:-1]
        found = [np.packbits(np.concatenate(x)).tobytes() for x in zip(np.split(shared[at], cuts), np.split(packed[at], cuts))]
        return _table(0, table.column("bucket").to_pylist(), found, [b""] * len(found)).set_column(0, "block", table.column("block"))
    return run


class Shared:
    """A block's runs whose anchor is shared (of crowded anchors, each window as a
    run of its own), and their distinct surroundings by bucket, each with the
    smallest document of the block that has it."""

    def __init__(self, table: pa.Table, answer: pa.Table, buckets: int):
        self.runs, self.ids = Runs(blocks.texts(table)), _ids(table)
        runs = self.runs
        h, _, _ = _anchors(runs, self.ids)
        self.said = dict(zip(answer.column("bucket").to_pylist(), answer.column("shared").to_pylist()))
        shared, crowded = np.zeros(len(h), bool), np.zeros(len(h), bool)
        for b, x, y in blocks.by_bucket(h, buckets):
            if self.said.get(b):  # else none of them is shared
                bits = np.unpackbits(np.frombuffer(self.said[b], np.uint8), count=2 * (y - x)).astype(bool)
                shared[x:y], crowded[x:y] = bits[:y - x], bits[y - x:]
        of = np.searchsorted(h, runs.hash)
        at = np.flatnonzero(shared[of]) if len(h) else np.empty(0, np.int64)
        apart = crowded[of[at]] if len(h) else np.empty(0, bool)
        many = np.where(apart, runs.last[at] - runs.first[at] + 1, 1)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        apart = np.repeat(apart, many)
        at = np.repeat(at, many)
        self.first = runs.first[at] + nth
        self.last = np.where(apart, self.first, runs.last[at])
        self.text = runs.text[at]
        self.hash = runs.hash[at]
        self.hash[apart] = _window_hash(runs.buf, self.first[apart])
        self.doc = self.ids[self.text].tolist()
        self.keys = list(zip(self.hash.tolist(), (runs.buf[x:y] for x, y in zip(self.first.tolist(), (self.last + LEAST).tolist()))))
        self.least: dict[tuple[int, bytes], int] = {}
        for k, d in zip(self.keys, self.doc):
            if d < self.least.get(k, LAST + 1):
                self.least[k] = d
        self.order = sorted(self.least)
        self.hashes = np.array([k[0] for k in self.order], np.uint64)
        self.parts = blocks.by_bucket(self.hashes, buckets) if self.order else []


def _window_hash(buf: bytes, first: np.ndarray) -> np.ndarray:
    h = np.zeros(len(first), np.uint64)
    if len(first):
        words = _words(memoryview(buf), len(buf) - 7)
        for k in [*range(0, LEAST - 8, 8), LEAST - 8]:
            h = _mix(h * _C[0] + words[first + k])
    return h


def _ask_repeats(buckets: int):
    """The shared surroundings, a row for each bucket; the first answer's bits
    travel along, so that the last step needs no other table."""
    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        import zstandard

        s, z = Shared(table, answer, buckets), zstandard.ZstdCompressor(level=1)
        data = {b: b"" for b, bits in s.said.items() if any(bits)}
        for b, x, y in s.parts:
            keys = s.order[x:y]
            data[b] = (np.array([y - x], np.int64).tobytes() + s.hashes[x:y].tobytes()
                       + np.array([s.least[k] for k in keys], np.int64).tobytes()
                       + np.array([len(k[1]) for k in keys], np.uint8).tobytes()
                       + z.compress(b"".join(k[1] for k in keys)))
        return _table(table.column("block")[0].as_py(), list(data), [s.said.get(b, b"") for b in data], list(data.values()))
    return run


def intervals(lcp: list[int], least: int):
    """(length, first, last) of the common-prefix intervals of at least
    ``least`` bytes, by a stack scan; lcp[i] is that of suffixes i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        now, low = lcp[i] if i < len(lcp) else 0, i - 1
        if now < least:
            now = 0
        while stack and stack[-1][0] > now:
            size, low = stack.pop()
            yield size, low, i - 1
        if now and (not stack or stack[-1][0] < now):
            stack.append((now, low))


def maximal_repeats(strings: list[bytes], least: int = LEAST):
    """(length, numbers of the strings, offsets) of each maximal repeat of at
    least ``least`` bytes, with all its occurrences. What stands before a
    string's first byte counts as different from all else."""
    n = np.array([len(s) for s in strings], np.int64)
    windows = np.maximum(n - least + 1, 0)
    total = int(windows.sum())
    if total < 2:
        return
    buf = b"".join(strings) + bytes(int(n.max()) + 8)
    whose = np.repeat(np.arange(len(strings)), windows)
    offset = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    place = (np.cumsum(n) - n)[whose] + offset
    # suffixes whose first bytes stand nowhere else can't start a repeat
    words = _words(buf, len(buf) - 7)
    h = np.zeros(total, np.uint64)
    for k in [*range(0, least - 8, 8), least - 8]:
        h = _mix(h * _C[0] + words[place + k])
    _, at, count = np.unique(h, return_inverse=True, return_counts=True)
    keep = count[at] > 1
    whose, offset, place = whose[keep], offset[keep], place[keep]
    if not len(whose):
        return
    rest = n[whose] - offset
    wide = int(rest.max())
    flat = np.frombuffer(buf, np.uint8)
    rows = np.zeros((len(place), wide), np.uint8)
    for k in range(wide):
        more = np.flatnonzero(rest > k)
        rows[more, k] = flat[place[more] + k]
    order = np.argsort(rows.view(f"S{wide}").ravel(), kind="stable")
    rows, whose, offset, place, rest = rows[order], whose[order], offset[order], place[order], rest[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), wide)
    lcp = np.concatenate([[0], np.minimum(common, np.minimum(rest[1:], rest[:-1]))])
    before = np.where(offset > 0, flat[place - 1], -1 - np.arange(len(place)))
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    for size, low, high in intervals(lcp.tolist(), least):
        if changes[high] > changes[low]:  # occurrences differ to the left
            yield size, whose[low:high + 1], offset[low:high + 1]


def _answer_repeats(table: pa.Table) -> pa.Table:
    """For each entry a mask of the windows that smaller documents have."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    asked, least = [], {}
    for x in table.column("data"):
        data = x.as_py()
        if not data:  # only bits that travel along
            asked.append(([], []))
            continue
        n = int(np.frombuffer(data, np.int64, 1)[0])
        h = np.frombuffer(data, np.uint64, n, 8).tolist()
        doc = np.frombuffer(data, np.int64, n, 8 + 8 * n).tolist()
        size = np.cumsum(np.frombuffer(data, np.uint8, n, 8 + 16 * n), dtype=np.int64).tolist()
        text = z.decompress(data[8 + 17 * n:])
        keys = list(zip(h, (text[a:b] for a, b in zip([0, *size], size))))
        asked.append((keys, doc))
        for k, d in zip(keys, doc):
            if d < least.get(k, LAST + 1):
                least[k] = d
    number: dict[int, int] = {}
    for h, _ in least:
        number[h] = number.get(h, 0) + 1
    several = sorted(k for k in least if number[k[0]] > 1)
    docs = np.array([least[k] for k in several], np.int64)
    masks = np.zeros(len(several), np.uint64)
    for size, whose, offset in maximal_repeats([k[1] for k in several]):
        later = docs[whose] > docs[whose].min()
        if later.any():
            bits = np.uint64((1 << (size - LEAST + 1)) - 1)
            np.bitwise_or.at(masks, whose[later], bits << offset[later].astype(np.uint64))
    mask = dict(zip(several, masks.tolist()))
    out = []
    for keys, doc in asked:
        m = [(1 << 64) - 1 if d > least[k] else mask.get(k, 0) for k, d in zip(keys, doc)]
        out.append(np.array(m, np.uint64).tobytes())
    return table.set_column(3, "data", pa.array(out, pa.binary()))


def _remove(buckets: int, as_text: bool):
    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        s = Shared(table, answer, buckets)
        said = dict(zip(answer.column("bucket").to_pylist(), answer.column("data").to_pylist()))
        mask: dict[tuple[int, bytes], int] = {}
        for b, x, y in s.parts:
            mask.update(zip(s.order[x:y], np.frombuffer(said[b], np.uint64).tolist()))
        first, last = s.first, s.last
        m = np.array([mask[k] if d == s.least[k] else (1 << 64) - 1 for k, d in zip(s.keys, s.doc)], np.uint64)
        cover = np.zeros(len(s.runs.buf) + LEAST + 1, np.int32)
        for k in range(int((last - first).max(initial=-1)) + 1):
            at = first[(first + k <= last) & ((m >> np.uint64(k)) & np.uint64(1) > 0)] + k
            np.add.at(cover, at, 1)
            np.add.at(cover, at + LEAST, -1)
        gone = np.cumsum(cover)[:len(s.runs.buf)] > 0
        flat = np.frombuffer(s.runs.buf, np.uint8)
        kept, spans = [], []
        start = 0
        for end in s.runs.ends.tolist():
            g = gone[start:end]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], g.view(np.int8), [0]])))
            kept.append(flat[start:end][~g].tobytes())
            spans.append([{"start": a, "length": b - a} for a, b in edge.reshape(-1, 2).tolist()])
            start = end
        return pa.table({"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff([0, *s.runs.ends]), pa.int64()),
                         "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                         "kept": (pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text
                                  else pa.array(kept, pa.binary())),
                         **{c: table.column(c) for c in table.column_names if c not in ("block", "doc_id", "packed")}})
    return run


SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType())]))


def keep_first(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with the repeats taken out of ``text`` and ``n_chars`` (if there)
    its new length; code points that lost a byte go, a null text stays null."""
    named = {c: f"_given_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    given = docs.select("doc_id", "text", F.col("text").isNull().alias("_none"),
                        *[F.col(f"`{c}`").alias(n) for c, n in named.items()])
    got = remove_repeats(given, "_none", *named.values(), as_text=True, **params)
    text = F.when(~F.col("_none"), F.col("kept"))
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text)}
    return got.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col(named[c])).alias(c) for c in docs.columns])


def remove_repeats(docs: DataFrame, *extra: str, as_text: bool = False,
                   block_bytes: int = blocks.BLOCK_BYTES, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, extra...) for every row of ``docs``: the
    spans of bytes removed, and the bytes that stay (``as_text``: their text,
    without code points that lost a byte)."""
    block, n = blocks.blocked(docs, *extra, block_bytes=block_bytes)
    buckets = min(blocks.MOST_BUCKETS, n)
    of_block = block.groupBy("block")
    # one plan: the exchange of the blocks is made once and read three times
    anchors = of_block.applyInArrow(_ask_anchors(buckets), ROWS).groupBy("bucket").applyInArrow(_answer_anchors(crowd), ROWS)
    repeats = (of_block.cogroup(anchors.groupBy("block")).applyInArrow(_ask_repeats(buckets), ROWS)
               .groupBy("bucket").applyInArrow(_answer_repeats, ROWS))
    schema = StructType([docs.schema["doc_id"], StructField("n_bytes", LongType()), StructField("spans", SPANS),
                         StructField("kept", StringType() if as_text else BinaryType()), *(docs.schema[c] for c in extra)])
    return of_block.cogroup(repeats.groupBy("block")).applyInArrow(_remove(buckets, as_text), schema)
