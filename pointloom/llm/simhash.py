"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into partitions so that correlated bits share one, and
the distance budget is dealt to the partitions unequally: with thresholds t_i
that sum to (k - m + 1) over m partitions, two fingerprints within k bits agree
within t_i bits in at least one partition.  Dynamic programming picks the
thresholds (and m) with the smallest estimated cost, from collision counts of
all fingerprints.  A partition with threshold t is probed by masking every
choice of t of its bits and grouping on the rest.

A bucket that is still large is split again: its members agree on the probed
bits, so the pigeonhole principle holds for the remaining bits, and any two
members within k bits share one of k + 1 finer buckets.  A bucket on all but r
bits holds at most 2**r fingerprints, so splitting always ends; nothing is
capped.  Inside a bucket, links are compared vectorised and reduced to a
spanning forest, so pairs never become rows.

Shingles are hashed in Python, all of a chunk at once (numpy on byte buffers):
the engine's own xxhash64 is the same function, but shingles would have to be
rows, or arrays of strings, to reach it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import materialize
from .words import SPACED, U64, chunks

BITS, DISTANCE, SHINGLE, SEED = 64, 3, 3, 42
#: A bucket of more fingerprints than this is split.
BUCKET = 256
_PAIRS = 1 << 22


_P1, _P2, _P3, _P4, _P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Longer strings are hashed one by one.
_LONG = 256


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each byte string data[start:end], all strings at once."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), dtype="<u4", buffer=padded, strides=(1,))
    long = np.flatnonzero(ends - starts >= _LONG)
    at, end = starts.copy(), ends.copy()
    end[long] = at[long]
    length = (end - at).astype(U64)
    with np.errstate(over="ignore"):
        step = lambda lane, x: _rotated(lane + x * _P2, 31) * _P1
        h = np.full(len(at), U64(seed) + _P5, dtype=U64)
        wide = np.flatnonzero(length >= 32)
        if len(wide):
            s = U64(seed)
            lanes = [np.full(len(wide), x, dtype=U64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while len(on := np.flatnonzero(at[wide] + 32 <= end[wide])):
                here = at[wide[on]]
                for k in range(4):
                    lanes[k][on] = step(lanes[k][on], eight[here + 8 * k].astype(U64))
                at[wide[on]] += 32
            both = _rotated(lanes[0], 1) + _rotated(lanes[1], 7) + _rotated(lanes[2], 12) + _rotated(lanes[3], 18)
            for k in range(4):
                both = (both ^ step(U64(0), lanes[k])) * _P1 + _P4
            h[wide] = both
        h += length
        while len(on := np.flatnonzero(at + 8 <= end)):
            h[on] = _rotated(h[on] ^ step(U64(0), eight[at[on]].astype(U64)), 27) * _P1 + _P4
            at[on] += 8
        on = np.flatnonzero(at + 4 <= end)
        h[on] = _rotated(h[on] ^ (four[at[on]].astype(U64) * _P1), 23) * _P2 + _P3
        at[on] += 4
        while len(on := np.flatnonzero(at < end)):
            h[on] = _rotated(h[on] ^ (data[at[on]].astype(U64) * _P5), 11) * _P1
            at[on] += 1
        h = (h ^ (h >> U64(33))) * _P2
        h = (h ^ (h >> U64(29))) * _P3
        h ^= h >> U64(32)
    if len(long):
        raw = data.tobytes()
        h[long] = [xxhash.xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist())]
    return h


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of n[i] > 0 consecutive hashes: the bits set in more than half of them."""
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    # eight counters of eight bits in each word hold runs of up to 255
    parts = -(-n // 255)
    run = np.repeat(np.arange(len(n)), parts)
    inner = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = first[run] + 255 * inner
    counts = np.zeros((len(n), BITS), dtype=np.int64)
    whole = np.cumsum(parts) - parts
    for k in range(8):
        some = np.add.reduceat((h >> U64(k)) & U64(0x0101010101010101), cuts)
        counts[:, k::8] = np.add.reduceat(some.astype("<u8").view(np.uint8).reshape(-1, 8), whole, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(U64)


def _fingerprints(texts: pa.Array) -> np.ndarray:
    out = []
    for c in chunks(texts, SPACED, lower=True):
        counts = c.counts
        data, starts, ends = c.joined()
        n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
        row = np.repeat(np.arange(c.rows), n)
        first = np.repeat(c.word_offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        last = first + np.minimum(counts, SHINGLE)[row] - 1
        fp = np.zeros(c.rows, dtype=U64)
        full = np.flatnonzero(n)
        if len(full):
            fp[full] = majority(xxh64(data, starts[first], ends[last]), n[full])
        out.append(fp)
    return np.concatenate(out) if out else np.zeros(0, dtype=U64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long): the SimHash of each text; null and wordless texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_fingerprints(b.column(1)).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _together(fps: DataFrame) -> np.ndarray:
    """How often each two bits are both set, over all fingerprints (at most 64 x 64 rows reach the driver)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(">i8")
            x = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j].astype(np.int64))], ["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        out[r.i, r.j] = r.n
    return out


def group_bits(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of nearly equal width, filled greedily with the most correlated bits left."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, out = set(range(BITS)), []
    for k in range(m):
        width = (BITS * (k + 1)) // m - (BITS * k) // m
        own = [max(left, key=lambda b: (corr[b, sorted(left)].sum(), -b))]
        left.discard(own[0])
        while len(own) < width:
            b = max(left, key=lambda b: (corr[b, own].sum(), -b))
            own.append(b)
            left.discard(b)
        out.append(sorted(own))
    return out


def _mask(bits) -> int:
    """A set of bits as a signed 64-bit integer."""
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >= 1 << 63 else x


def allocate(widths: list[int], collisions: list[int], n: int, k: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 (-1: not probed) of sum k - m + 1 with the least estimated cost, by dynamic programming."""

    def cost(w: int, same: int, t: int) -> float:
        if t < 0:
            return 0.0
        ball = sum(math.comb(w, j) for j in range(1, t + 1))
        candidates = same * (1 + t) + n * n / 2 * ball / 2.0**w
        return 8.0 * n * math.comb(w, t) + candidates

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for w, same in zip(widths, collisions):
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (c, ts) in best.items():
            for t in range(-1, k + 1):
                if t <= w:
                    step[spent + t] = min(step.get(spent + t, (math.inf, [])), (c + cost(w, same, t), [*ts, t]))
        best = step
    return best[k - len(widths) + 1]


def plan_probes(fps: DataFrame, n: int, k: int) -> list[int]:
    """The masks to group on: at least one agrees between any two fingerprints within k bits."""
    together = _together(fps)
    options = {m: group_bits(together, n, m) for m in (2, 3, 4)}
    slots = [(m, i, _mask(bits)) for m, parts in options.items() for i, bits in enumerate(parts)]
    seen = fps.select(F.explode(F.array(*[F.struct(F.lit(s).alias("slot"), F.col("fp").bitwiseAND(F.lit(x)).alias("value")) for s, (_, _, x) in enumerate(slots)])).alias("p"))
    pairs = seen.groupBy("p.slot", "p.value").count().groupBy("slot").agg(F.sum(F.expr("cast(count as double) * (count - 1) / 2")).alias("same"))
    same = {slots[r.slot][:2]: r.same for r in pairs.collect()}
    _, ts, parts = min((*allocate([len(b) for b in parts], [same.get((m, i), 0) for i in range(m)], n, k), parts) for m, parts in options.items())
    return [_mask(set(bits) - set(off)) for bits, t in zip(parts, ts) if t >= 0 for off in itertools.combinations(bits, t)]


def _finer(mask: int, k: int) -> list[int]:
    """k + 1 masks that extend ``mask``: members of its bucket within k bits share one of them."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [_mask([b for b in range(BITS) if mask >> b & 1] + rest[i :: k + 1]) for i in range(k + 1)]


def _links(k: int):
    """Arrow function: buckets (arrays of fingerprints) to the spanning forest of their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.asarray(lists.value_lengths()).astype(np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
            ends, work = np.cumsum(sizes), np.cumsum(sizes * sizes)
            a = 0
            while a < len(sizes):
                b = max(a + 1, int(np.searchsorted(work, (work[a - 1] if a else 0) + _PAIRS, side="right")))
                lo = int(ends[a - 1]) if a else 0
                yield _forest(values[lo : ends[b - 1]], np.repeat(ends[a:b] - lo, sizes[a:b]), k)
                a = b

    return run


def _forest(v: np.ndarray, end: np.ndarray, k: int) -> pa.RecordBatch:
    at, left, right, d = np.arange(len(v)), [], [], 1
    while True:
        at = at[at + d < end[at]]
        if not len(at):
            break
        near = np.bitwise_count(v[at] ^ v[at + d]) <= k
        left.append(at[near])
        right.append(at[near] + d)
        d += 1
    label = np.arange(len(v))
    if left:
        x, y = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    far = np.flatnonzero(label != np.arange(len(v)))
    return pa.RecordBatch.from_arrays([pa.array(v[far].view(np.int64)), pa.array(v[label[far]].view(np.int64))], ["u", "v"])


def link_forest(fps: DataFrame, k: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that join exactly the fingerprints joined by chains of pairs within k bits."""
    n = fps.count()
    spark = fps.sparkSession
    out = spark.createDataFrame([], "u long, v long")
    if n < 2:
        return out
    masks = plan_probes(fps, n, k)
    rows = _keyed(fps, masks)
    while True:
        # tables of their own: a join with a hot bucket is then one that adaptive execution splits
        size = materialize(rows.groupBy("slot", "value").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        placed = materialize(rows.join(size, ["slot", "value"]), "placed")
        small = placed.filter(F.col("n") <= bucket).groupBy("slot", "value").agg(F.collect_list("fp").alias("fps")).select("fps")
        out = out.unionAll(small.mapInArrow(_links(k), "u long, v long"))
        hot = [r.slot for r in size.filter(F.col("n") > bucket).select("slot").distinct().collect()]
        if not hot:
            return out
        fine = {s: _finer(masks[s], k) for s in hot}
        big = placed.filter(F.col("n") > bucket).select("slot", "fp")
        masks = [x for s in hot for x in fine[s]]
        base = F.create_map(*[F.lit(x) for i, s in enumerate(hot) for x in (s, i * (k + 1))])
        table = F.array(*[F.lit(x) for x in masks])
        pick = F.transform(F.sequence(F.lit(0), F.lit(k)), lambda j: F.struct((base[F.col("slot")] + j).alias("slot"), F.col("fp").bitwiseAND(F.get(table, base[F.col("slot")] + j)).alias("value")))
        rows = materialize(big.select("fp", F.explode(pick).alias("p")).select("p.slot", "p.value", "fp").distinct(), "finer")


def _keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(s).alias("slot"), F.col("fp").bitwiseAND(F.lit(x)).alias("value")) for s, x in enumerate(masks)])
    return fps.select("fp", F.explode(keys).alias("p")).select("p.slot", "p.value", "fp")


def near_duplicates(docs: DataFrame, k: int = DISTANCE) -> DataFrame:
    """Per row of ``docs``: doc_id, fp and component_id, the smallest doc_id reachable by links.

    Fingerprints within ``k`` bits link.  Null and wordless texts have
    fingerprint 0 and link like any other; equal texts and repeated rows share
    one class; an empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(link_forest(classes.select("fp"), k)).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    member = materialize(rooted.join(least, "root").select("fp", "component_id"), "members")
    return marked.join(member, "fp").select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
