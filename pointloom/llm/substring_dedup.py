"""Substring dedup by relative Lempel-Ziv parsing against the blocks of earlier documents.

Texts are packed into compressed chunks of a few megabytes, one row each.

1. Blocks.  Every 13-word window picks its smallest 6-word seed (a minimiser);
   consecutive windows that pick the same one form a block.  Equal windows pick
   the same seed, so a block whose seed is nowhere else holds no repeat.
2. Index.  A chunk sends its distinct seeds to the tasks that own them and gets
   back which of them another document has.  The distinct windows of their
   blocks go to the tasks that own them, and come back with the first place
   (document, word) that has the same 13 words, if it is not in the chunk.
3. Parse.  Each document is factored from left to right: a factor copies from
   one source document for as long as the next window's first place is the next
   word there; where the source changes, every window across the boundary has
   been looked up by itself.  Factors never overlap; words between them are
   literals.

A key is sent once per chunk however many documents hold it, and a chunk sends
one row to each task, so a passage that fills the corpus is no hot key.  A chunk
computes its keys again rather than send along where they stand.  Seeds are
compared by 64-bit hashes, which can only ask for a window too many.
Windows are compared by 128 bits of BLAKE2b over their words.

Defined results: ``doc_id`` is an integer; a null, empty or wordless text has no
words and keeps the empty string; rows that repeat a doc_id never remove words
from each other, as only smaller ids count; a row without an id keeps its words
and removes none; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize
from .words import SPACED, U64, Chunk, covered, pieces, rolling, runs

WINDOW, SEED = 13, 6
#: Bytes of text in a chunk, and of all text for one owning task.
CHUNK, OWNED = 1 << 21, 1 << 26

Batches = Iterator[pa.RecordBatch]


def _packed(batches: Batches) -> Batches:
    """(chunk, size, ids, known, offsets, body): texts packed into chunks; ``known`` marks rows with an id."""
    task, k = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for first, data, offsets in pieces(batch.column(1), CHUNK):
            ids = batch.column(0).slice(first, len(offsets) - 1)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            rows = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), known, offsets.astype("<i8")]
            body = pa.array([pa.compress(data.tobytes(), codec="zstd", asbytes=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([task + k]), pa.array([len(data)]), *_binary(*rows), body], ["chunk", "size", "ids", "known", "offsets", "body"])
            k += 1


PACKED = "chunk long, size long, ids binary, known binary, offsets binary, body binary"


def _unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, Chunk]:
    """(ids, known, words) of row ``i`` of packed texts."""
    get = lambda name: batch.column(batch.schema.get_field_index(name))[i]
    ids, known, offsets = (np.frombuffer(get(name).as_buffer(), dtype=kind) for name, kind in (("ids", "<i8"), ("known", bool), ("offsets", "<i8")))
    body = pa.decompress(get("body").as_buffer(), decompressed_size=get("size").as_py(), codec="zstd", asbytes=True)
    return ids, known, Chunk(0, np.frombuffer(body, dtype=np.uint8), offsets, SPACED)


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([x.tobytes()], pa.binary()) for x in arrays]


def blocks(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, start, n) of each block: ``n`` windows from word ``start`` on."""
    none = np.zeros(0, dtype=np.int64)
    h = c.hashes()
    windows = len(h) - WINDOW + 1
    if windows < 1:
        return none.astype(U64), none, none
    seeds = rolling(h, SEED)
    row = c.row_of_word()
    low, at = seeds[:windows].copy(), np.arange(windows)
    for j in range(1, WINDOW - SEED + 1):
        less = np.flatnonzero(seeds[j : j + windows] < low)
        low[less] = seeds[less + j]
        at[less] = less + j
    start = np.flatnonzero(row[:windows] == row[WINDOW - 1 :])
    if not len(start):
        return none.astype(U64), none, none
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[start[1:]] != at[start[:-1]]) | (start[1:] != start[:-1] + 1)
    head = np.flatnonzero(new)
    return low[start[head]], start[head], np.diff(np.append(head, len(start)))


def _owners(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the keys of each owner start, in sorted keys."""
    owner = ((keys >> U64(32)) * U64(parts)) >> U64(32)
    return np.searchsorted(owner, np.arange(parts + 1).astype(U64))


class _Seeds:
    """The blocks of a chunk by seed, and its distinct seeds in order."""

    def __init__(self, c: Chunk, ids: np.ndarray, known: np.ndarray):
        seed, start, n = blocks(c)
        row = np.searchsorted(c.word_offsets, start, side="right") - 1
        own = np.flatnonzero(known[row])
        own = own[np.argsort(seed[own], kind="stable")]
        self.start, self.n, self.who = start[own], n[own], ids[row[own]]
        self.keys, self.first, self.counts = np.unique(seed[own], return_index=True, return_counts=True)

    def several(self) -> np.ndarray:
        """Which seeds two documents of the chunk have."""
        if not len(self.keys):
            return np.zeros(0, dtype=bool)
        return np.minimum.reduceat(self.who, self.first) < np.maximum.reduceat(self.who, self.first)

    def windows(self, shared: np.ndarray) -> np.ndarray:
        """Words where the windows of blocks with a shared seed start."""
        on = np.repeat(shared, self.counts)
        start, n = self.start[on], self.n[on]
        return np.sort(np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))


class _Windows:
    """Windows of a chunk that start at words ``at``, by content: distinct keys in order and the first place of each."""

    def __init__(self, c: Chunk, ids: np.ndarray, at: np.ndarray):
        text, starts, ends = c.joined()
        raw = text.tobytes()
        digests = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts[at].tolist(), ends[at + WINDOW - 1].tolist())]
        keys = np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)
        row = np.searchsorted(c.word_offsets, at, side="right") - 1
        who, place = ids[row], at - c.word_offsets[row]
        order, head = _firsts(keys, who, place)
        one = order[head]
        self.keys, self.ids, self.places = keys[one], who[one], place[one]
        self.at, self.key = at[order], np.cumsum(head) - 1


def _firsts(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): entries by key and then by (id, place), and which of them begin a key."""
    order = np.lexsort((places, ids, keys[:, 1], keys[:, 0]))
    by = keys[order]
    head = np.ones(len(by), dtype=bool)
    head[1:] = (by[1:] != by[:-1]).any(axis=1)
    return order, head


def _ask_seeds(parts: int):
    """Packed texts to (part, chunk, keys, several): the distinct seeds of a chunk."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, known, c = _unpacked(batch, i)
                seeds = _Seeds(c, ids, known)
                several, at = seeds.several(), _owners(seeds.keys, parts)
                for p in np.flatnonzero(np.diff(at)).tolist():
                    k = slice(at[p], at[p + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), batch.column(0).slice(i, 1), *_binary(seeds.keys[k], several[k])], ["part", "chunk", "keys", "several"])

    return run


def _answer_seeds(batches: Batches) -> Batches:
    """All requests of an owner to (part, chunk, shared): which seeds are in several documents, a bit each."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    keys = np.concatenate([np.frombuffer(r["keys"], dtype=U64) for r in rows])
    several = np.concatenate([np.frombuffer(r["several"], dtype=bool) for r in rows])
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    shared = counts > 1
    shared[inverse[several]] = True
    shared = shared[inverse]
    a = 0
    for r in rows:
        own = shared[a : a + len(r["keys"]) // 8]
        a += len(own)
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["chunk"]]), *_binary(np.packbits(own))], ["part", "chunk", "shared"])


def _answers(batch: pa.RecordBatch, i: int, name: str) -> list[dict]:
    """The answers of the owners to a chunk."""
    return batch.column(batch.schema.get_field_index(name))[i].as_py() or []


def _marked(answers: list[dict], name: str, keys: np.ndarray, parts: int) -> np.ndarray:
    """The bits of all answers, for all keys in order; False where an owner said nothing."""
    out, at = np.zeros(len(keys), dtype=bool), _owners(keys, parts)
    for r in answers:
        a, b = at[r["part"]], at[r["part"] + 1]
        out[a:b] = np.unpackbits(np.frombuffer(r[name], dtype=np.uint8), count=b - a)
    return out


def _windows(batch: pa.RecordBatch, i: int, parts: int) -> tuple[np.ndarray, np.ndarray, Chunk, _Windows]:
    """(ids, known, words, windows to look up) of row ``i`` of packed texts with answers ``blocks``."""
    ids, known, c = _unpacked(batch, i)
    seeds = _Seeds(c, ids, known)
    return ids, known, c, _Windows(c, ids, seeds.windows(_marked(_answers(batch, i, "blocks"), "shared", seeds.keys, parts)))


def _ask_windows(parts: int):
    """Packed texts with ``blocks`` to (part, chunk, keys, ids, places): distinct windows and the first place of each in the chunk."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                w = _windows(batch, i, parts)[3]
                at = _owners(w.keys[:, 0], parts)
                for p in np.flatnonzero(np.diff(at)).tolist():
                    k = slice(at[p], at[p + 1])
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), batch.column(0).slice(i, 1), *_binary(w.keys[k], w.ids[k].astype("<i8"), w.places[k].astype("<i4"))], ["part", "chunk", "keys", "ids", "places"])

    return run


def _answer_windows(batches: Batches) -> Batches:
    """All requests of an owner to (part, chunk, other, ids, places): which windows start elsewhere first (a bit each), and where."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    take = lambda name, kind: np.concatenate([np.frombuffer(r[name], dtype=kind) for r in rows])
    keys, ids, places = take("keys", "<u8").reshape(-1, 2), take("ids", "<i8"), take("places", "<i4")
    order, head = _firsts(keys, ids, places)
    source = np.empty_like(order)
    source[order] = order[head][np.cumsum(head) - 1]
    other = (ids[source] != ids) | (places[source] != places)
    a = 0
    for r in rows:
        own = np.arange(a, a + len(r["keys"]) // 16)
        a += len(own)
        src = source[own[other[own]]]
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]], pa.int32()), pa.array([r["chunk"]]), *_binary(np.packbits(other[own]), ids[src], places[src])], ["part", "chunk", "other", "ids", "places"])


FACTOR = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())])


def parse(c: Chunk, ids: np.ndarray, at: np.ndarray, source: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors of all documents of a chunk as (row, [start, end, source, source_start]), from the first places of windows.

    ``at`` are words of the chunk where a window starts that ``source`` has at ``place``.
    """
    row = np.searchsorted(c.word_offsets, at, side="right") - 1
    earlier = source < ids[row]
    order = np.argsort(at[earlier], kind="stable")
    at, source, place, row = (x[earlier][order].astype(np.int64) for x in (at, source, place, row))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]) | (source[1:] != source[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    start, end, row = at[first], at[last] + WINDOW, row[first]
    cut = start.copy()
    cut[1:] = np.where(row[1:] == row[:-1], np.maximum(start[1:], end[:-1]), start[1:])
    base = c.word_offsets[row]
    return row, np.stack([cut - base, end - base, source[first], place[first] + cut - start], axis=1)


def _parsed(parts: int):
    """Packed texts with ``blocks`` and ``firsts`` to (doc_id, n_words, factors, kept)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, known, c, w = _windows(batch, i, parts)
                answers = sorted(_answers(batch, i, "firsts"), key=lambda r: r["part"])
                other = _marked(answers, "other", w.keys[:, 0], parts)
                source, place = w.ids.copy(), w.places.copy()
                source[other] = np.frombuffer(b"".join(r["ids"] for r in answers), dtype="<i8")
                place[other] = np.frombuffer(b"".join(r["places"] for r in answers), dtype="<i4")
                yield _factored(ids, known, c, *parse(c, ids, w.at, source[w.key], place[w.key]))

    return run


def _factored(ids: np.ndarray, known: np.ndarray, c: Chunk, row: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    text, starts, ends = c.joined()
    raw, offsets = text.tobytes(), c.word_offsets
    bounds = np.searchsorted(row, np.arange(c.rows + 1))
    kept = []
    for r in range(c.rows):
        lo, hi, own = offsets[r], offsets[r + 1], found[bounds[r] : bounds[r + 1]]
        if not len(own):
            kept.append(raw[starts[lo] : ends[hi - 1]] if hi > lo else b"")
            continue
        a, z = runs(~covered(hi - lo, own[:, 0], own[:, 1]))
        kept.append(b" ".join(raw[x:y] for x, y in zip(starts[lo + a].tolist(), ends[lo + z - 1].tolist())))
    factors = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays([pa.array(x) for x in found.T.astype(np.int64)], fields=list(FACTOR)))
    kept = pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())
    return pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(c.counts.astype(np.int64)), factors, kept], ["doc_id", "n_words", "factors", "kept"])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, factors and kept (words left, joined by a space).

    A factor says that the words [start, end) are also those of document ``source`` from word ``source_start`` on.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError("doc_id must be an integer")
    spark = docs.sparkSession
    packed = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_packed, PACKED), "packed")
    size = packed.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // OWNED))
    answered = lambda df, name: df.groupBy("chunk").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "chunk"])).alias(name))
    asked = packed.mapInArrow(_ask_seeds(parts), "part int, chunk long, keys binary, several binary")
    shared = asked.repartitionById(parts, F.col("part")).mapInArrow(_answer_seeds, "part int, chunk long, shared binary")
    shared = materialize(answered(shared, "blocks"), "blocks")
    asked = packed.join(shared, "chunk").mapInArrow(_ask_windows(parts), "part int, chunk long, keys binary, ids binary, places binary")
    firsts = asked.repartitionById(parts, F.col("part")).mapInArrow(_answer_windows, "part int, chunk long, other binary, ids binary, places binary")
    firsts = materialize(answered(firsts, "firsts"), "firsts")
    out = packed.join(shared, "chunk", "left").join(firsts, "chunk", "left")
    out = out.mapInArrow(_parsed(parts), "doc_id long, n_words long, factors array<struct<start:long,end:long,source:long,source_start:long>>, kept string")
    return out.select(F.col("doc_id").cast(kind), "n_words", "factors", "kept")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("factors", F.lit(0).cast("long"), lambda n, f: n + f["end"] - f["start"])
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first_id FROM win) WHERE first_id < doc_id),
gone AS (SELECT DISTINCT doc_id, p FROM later, unnest(range(i, i + 13)) t(p)),
word AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
