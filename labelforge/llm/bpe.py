"""BPE encoding and decoding by content-defined chunk reuse.

Texts are cut where a rolling hash over 32 bytes hits a mask, so equal passages
are cut alike wherever they stand. Chunks found in more than one place are
encoded once, at the place that owns them; their ids are joined to every text
that holds them, the rest of a text is encoded where it lies, and each join is
repaired: the text between the nearest places where the tokenizer is sure to
start a new token is encoded again and takes the place of the ids there, and
the window widens until it agrees with the ids kept on both sides.

Defined results: a null text counts as empty; an empty text has no ids; every
row gives one row (repeated rows too, also with a null or repeated doc_id, as
texts are matched by content); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelforge.llm.common import bounded_batches, saved, sorted_join

#: Expected bytes between cuts (a power of two), and the least bytes of a chunk.
CHUNK_BITS = 10
MIN_CHUNK = 256
#: Most bytes handed to the tokenizer in one call.
CALL_BYTES = 1 << 20


def vocabulary_bytes(tokenizer_json: str) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary. Byte-level vocabularies
    write printable bytes as themselves and the others as code points from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    spec = json.loads(tokenizer_json)
    special = {t["id"]: t["content"] for t in spec["added_tokens"]}
    out: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items()
                             if i not in special}
    out |= {i: t.encode() for i, t in special.items()}
    return [out.get(i, b"") for i in range(max(out) + 1)]


#: fixed value: the splitting pattern of byte-level BPE vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(tokenizer_json: str):
    """The ids that a byte-level BPE file gives, from its vocabulary as merge
    ranks (ids of such vocabularies are in the merges' order). The fast library's
    splitting gives up on runs of some million blanks; such a part goes through
    the library that the file is made for."""
    import tiktoken

    special = {t["content"]: t["id"] for t in json.loads(tokenizer_json)["added_tokens"]}
    ranks = {b: i for i, b in enumerate(vocabulary_bytes(tokenizer_json)) if b and i not in special.values()}
    enc = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def of_part(part: str) -> np.ndarray:
        try:
            return enc.encode_to_numpy(part, allowed_special="all")
        except ValueError:
            return np.array(_plain(tokenizer_json).encode(part, add_special_tokens=False).ids, np.uint32)

    def ids(text: bytes) -> np.ndarray:
        parts = [of_part(p.decode()) for p in in_parts(text)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)
    return ids


@lru_cache(maxsize=1)
def _plain(tokenizer_json: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


class Codec:
    """Encodes texts of any length to numpy ids, and ids back to text."""

    def __init__(self, tokenizer_json: str):
        self.ids_of = encoder(tokenizer_json)
        table = vocabulary_bytes(tokenizer_json)
        self.narrow = "<u2" if len(table) <= 1 << 16 else "<u4"
        self.sizes = np.array([len(t) for t in table], np.int64)
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.at = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of whole texts; long ones are handed over in parts that end where
        tokens surely end."""
        return [self.ids_of(t) for t in texts]

    def decode(self, ids: np.ndarray) -> str:
        """The ids' bytes, gathered from the vocabulary's, as text."""
        parts = []
        for s in range(0, len(ids), CALL_BYTES // 4):
            some = ids[s:s + CALL_BYTES // 4]
            n = self.sizes[some]
            ends = np.cumsum(n)
            parts.append(self.flat[np.arange(ends[-1]) + np.repeat(self.at[some] - ends + n, n)].tobytes())
        return b"".join(parts).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(tokenizer_json: str) -> Codec:
    return Codec(tokenizer_json)


def safe_starts(b: np.ndarray) -> np.ndarray:
    """Positions of white space right after a visible ASCII character. No token
    spans one, and what stands before it doesn't change the tokens after it, as
    the splitting pattern has white space at the start of a piece only."""
    space = (b == 32) | ((b >= 9) & (b <= 13))
    return np.flatnonzero(space[1:] & (b[:-1] > 32) & (b[:-1] < 127)) + 1


def in_parts(t: bytes) -> list[bytes]:
    if len(t) <= CALL_BYTES:
        return [t] if t else []
    safe = safe_starts(np.frombuffer(t, np.uint8))
    cuts = [0]
    while len(t) - cuts[-1] > CALL_BYTES:
        k = int(np.searchsorted(safe, cuts[-1] + CALL_BYTES, "right")) - 1
        if k < 0 or safe[k] <= cuts[-1]:
            k = int(np.searchsorted(safe, cuts[-1], "right"))
            if k >= len(safe):
                break
        cuts.append(int(safe[k]))
    return [t[x:y] for x, y in zip(cuts, [*cuts[1:], len(t)])]


def _mixed(n: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _mixed(256)


def chunk_bounds(t: bytes, bits: int = CHUNK_BITS, least: int = MIN_CHUNK, block: int = 1 << 20) -> list[int]:
    """Ends of the content-defined chunks of ``t``; the last is ``len(t)``."""
    n, marks = len(t), []
    for at in range(0, n, block):
        lo = max(0, at - 31)
        b = np.frombuffer(t, np.uint8, min(n, at + block) - lo, lo)
        h = GEAR[b]
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k] << np.uint32(k)
        hit = np.flatnonzero((h >> np.uint32(32 - bits)) == 0)
        marks.append(hit[hit >= at - lo] + lo + 1)
    bounds, last = [], 0
    for m in np.concatenate(marks).tolist() if marks else []:
        while m < n and t[m] & 0xC0 == 0x80:  # to the next code point
            m += 1
        if m - last >= least and m < n:
            bounds.append(m)
            last = m
    return [*bounds, n] if n else []


def stitch(c: Codec, t: bytes, known: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Ids of ``t``, given those of some of its chunks (start, length, ids)."""
    if not known:
        return c.encode([t])[0]
    segs: list[tuple[int, int, np.ndarray | None]] = []
    at = 0
    for start, size, ids in sorted(known, key=lambda k: k[0]):
        if start > at:
            segs.append((at, start, None))
        segs.append((start, start + size, ids))
        at = start + size
    if at < len(t):
        segs.append((at, len(t), None))
    fresh = iter(c.encode([t[x:y] for x, y, ids in segs if ids is None]))
    segs = [(x, y, next(fresh) if ids is None else ids) for x, y, ids in segs]
    ids = np.concatenate([s[2] for s in segs])
    ends = np.cumsum(c.sizes[ids])  # the byte each id ends at
    safe = safe_starts(np.frombuffer(t, np.uint8))
    agreed = safe[np.isin(safe, ends, assume_unique=True)]  # the ids kept end there too
    windows: list[list[int]] = []
    for _, q, _ in segs[:-1]:
        k = int(np.searchsorted(agreed, q))
        if k < len(agreed) and agreed[k] == q:
            continue
        lo, hi = int(agreed[k - 1]) if k else 0, int(agreed[k]) if k < len(agreed) else len(t)
        if windows and windows[-1][1] >= lo:
            windows[-1][1] = max(hi, windows[-1][1])
        else:
            windows.append([lo, hi])
    again = c.encode([t[x:y] for x, y in windows])
    out, at = [], 0
    for (lo, hi), new in zip(windows, again):
        out += [ids[at:int(np.searchsorted(ends, lo, "right"))], new]
        at = int(np.searchsorted(ends, hi, "right"))
    return np.concatenate([*out, ids[at:]])


def _list(kind: pa.DataType, values: list) -> pa.Array:
    return pa.array(values, kind)


def _name(b: bytes) -> bytes:
    """A text's or chunk's name: 128 bits of its content."""
    return hashlib.blake2b(b, digest_size=16).digest()


def _packed(batches):
    """Texts by name and compressed, as they move to the ids they share."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for b in batches:
        texts = [(t.as_py() or "").encode() for t in b.column("text")]
        yield pa.record_batch([b.column("doc_id"), _list(pa.binary(), list(map(_name, texts))),
                               _list(pa.binary(), list(map(z.compress, texts)))], ["doc_id", "key", "packed"])


def _chunks(batches):
    for b in batches:
        rows: list[list] = [[], [], [], []]
        for text in b.column("text"):
            t = (text.as_py() or "").encode()
            key, at = _name(t), 0
            for end in chunk_bounds(t):
                for r, v in zip(rows, (key, at, end - at, _name(t[at:end]))):
                    r.append(v)
                at = end
        yield pa.record_batch([_list(k, r) for k, r in zip((pa.binary(), pa.int64(), pa.int64(), pa.binary()), rows)],
                              ["key", "start", "size", "chunk"])


def _encode_owned(spec):
    def run(batches):
        import zstandard

        c, z = codec(spec.value), zstandard.ZstdDecompressor()
        done: set[bytes] = set()  # a text that stands here again is encoded once
        for b in batches:
            names, ids = [], []
            for key, packed, owned in zip(b.column("key"), b.column("packed"), b.column("owned")):
                if not owned.is_valid or key.as_py() in done:
                    continue
                done.add(key.as_py())
                t, own = z.decompress(packed.as_py()), owned.as_py()
                got = c.encode([t[o["start"]:o["start"] + o["size"]] for o in own])
                names += [o["chunk"] for o in own]
                ids += [g.astype(c.narrow).tobytes() for g in got]
            yield pa.record_batch([_list(pa.binary(), names), _list(pa.binary(), ids)], ["chunk", "ids"])
    return run


def _encode_rest(spec, with_text: bool):
    names = ["doc_id", "n_tokens", "ids", "decoded"]

    def run(batches):
        import zstandard

        c, z = codec(spec.value), zstandard.ZstdDecompressor()
        for b in batches:
            at = 0
            doc, packed, known = b.column("doc_id"), b.column("packed"), b.column("known")
            while at < b.num_rows:
                end, size, parts = at, 0, []
                while end < b.num_rows and size < 2 * CALL_BYTES:
                    parts.append(z.decompress(packed[end].as_py()))
                    size += len(parts[-1])
                    end += 1
                had = [known[i].as_py() for i in range(at, end)]
                plain = iter(c.encode([p for p, k in zip(parts, had) if not k]))
                ids = [stitch(c, p, list({o["start"]: (o["start"], o["size"], np.frombuffer(o["ids"], c.narrow))
                                          for o in k}.values())) if k else next(plain)
                       for p, k in zip(parts, had)]
                yield pa.record_batch([
                    doc.slice(at, end - at), _list(pa.int64(), [len(i) for i in ids]),
                    _list(pa.binary(), [i.astype("<u4").tobytes() for i in ids]),
                    _list(pa.string(), [c.decode(i) if with_text else None for i in ids])], names)
                at = end
    return run


def encode_decode(docs: DataFrame, tokenizer_json: str, decode: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row of ``docs`` (doc_id, text):
    ids as little-endian unsigned 32-bit integers, and the text they decode to
    (null unless ``decode``). ``tokenizer_json`` is the content of a byte-level
    BPE file of the tokenizers library."""
    bounded_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", "text").mapInArrow(_packed, f"doc_id {doc_type}, key binary, packed binary")

    pieces = docs.select("text").mapInArrow(_chunks, "key binary, start long, size long, chunk binary")
    held = saved(pieces.groupBy("key", "start", "size", "chunk").agg(F.count(F.lit(1)).alias("n")), "bpe-chunks")
    shared = (held.groupBy("chunk").agg(F.sum("n").alias("n"), F.min(F.struct("key", "start", "size")).alias("at"))
              .where("n > 1"))
    owned = (shared.select("at.key", F.struct("at.start", "at.size", "chunk").alias("o"))
             .groupBy("key").agg(F.collect_list("o").alias("owned")))
    # both joins below are left joins on the same side, so that its exchange is
    # made once and read twice
    once = sorted_join(d, owned, "key", "left").mapInArrow(_encode_owned(spec), "chunk binary, ids binary")
    known = (sorted_join(held.select("key", "start", "size", "chunk"), once, "chunk")
             .groupBy("key").agg(F.collect_list(F.struct("start", "size", "ids")).alias("known")))
    return sorted_join(d, known, "key", "left").mapInArrow(
        _encode_rest(spec, decode), f"doc_id {doc_type}, n_tokens long, ids binary, decoded string")
