"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments, about a megabyte of text each.  A segment has
the terms of its documents and, for each term, the list of its postings (word
positions, ascending); it does not depend on the benchmark and can be kept.

Test windows are sent to the segments in blocks of a bounded number, so the size
of a broadcast does not follow the benchmark: a larger one takes more passes over
the index, never over the texts.  The frequency of a test term is the sum of its
list lengths over all segments.  For each window whose terms a segment has all
of, the list of its rarest term, less its offset, is intersected with the
offset-adjusted list of the next rarest one, and so on: what is left is where
the phrase stands.  Terms are compared by their letters (``words.exact_pairs``).

Proximity: with ``slack``, a window also matches near a place where at least all
but ``missing`` of its words stand within ``slack`` words of where the phrase
would have them, when it is laid there by one of its two rarest words.

Defined results: a null or wordless text has no words, no hits, no items; an
item without an id or without words is ignored; repeated items count once;
repeated documents are judged row by row; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import materialize
from .words import ALNUM, chunks, covered, runs, scramble

#: Windows in one broadcast block: 10 words of 16 bytes and the lookup tables, about 60 MB at most.
BLOCK_WINDOWS = 200_000
_CANDIDATES = 1 << 20
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays]


def _by_term(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): words by hash, then letters, then position, and where each term begins in that order."""
    h = scramble(a, b)
    order = np.argsort(h, kind="stable")
    for k in range(2):
        x, y, z = h[order], a[order], b[order]
        other = (y[1:] != y[:-1]) | (z[1:] != z[:-1])
        if k or not (other & (x[1:] == x[:-1])).any():
            break
        order = np.lexsort((b, a, h))  # two terms with one hash
    return order, np.flatnonzero(np.concatenate([[True], other])) if len(order) else order


def build_index(docs: DataFrame) -> DataFrame:
    """(segment, ids, starts, terms, counts, postings) of the rows (doc_id, text) of ``docs``.

    ``starts`` are the first words of the documents and the number of all words,
    ``terms`` 16 bytes each by hash, ``counts`` their list lengths, ``postings``
    the lists one after another.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for c in chunks(batch.column(1), ALNUM, lower=True):
                a, b = c.identities()
                order, first = _by_term(a, b)
                one = order[first]
                ids = pa.ListArray.from_arrays(pa.array([0, c.rows], pa.int32()), batch.column(0).slice(c.first, c.rows))
                body = _binary(c.word_offsets.astype("<i8"), np.stack([a[one], b[one]], axis=1), np.diff(np.append(first, len(order))).astype("<i4"), order.astype("<i4"))
                yield pa.RecordBatch.from_arrays([pa.array([segment]), ids, *body], ["segment", "ids", "starts", "terms", "counts", "postings"])
                segment += 1

    fields = [("segment", T.LongType()), ("ids", T.ArrayType(kind))] + [(c, T.BinaryType()) for c in ("starts", "terms", "counts", "postings")]
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField(*f) for f in fields]))


def _column(batch: pa.RecordBatch, i: int, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(batch.column(batch.schema.get_field_index(name))[i].as_buffer(), dtype=kind)


def test_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, win binary): the words of every window of ``n`` words, 16 bytes each; a shorter item is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, out = batch.column(0), [], []
            for c in chunks(batch.column(1), ALNUM, lower=True):
                pairs = np.stack(c.identities(), axis=1)
                for r in range(c.rows):
                    a, b = c.word_offsets[r], c.word_offsets[r + 1]
                    if b > a:
                        found = {pairs[i : min(i + n, b)].tobytes() for i in range(a, max(a + 1, b - n + 1))}
                        rows += [c.first + r] * len(found)
                        out += found
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows, pa.int64())), pa.array(out, pa.binary())], ["item_id", "win"])

    schema = T.StructType([T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("win", T.BinaryType())])
    return benchmark.select("item_id", "text").filter("item_id is not null").mapInArrow(cut, schema)


class _Windows:
    """Distinct test windows of one block, their items, and their terms as small integers."""

    def __init__(self, rows: list, n: int):
        by: dict[bytes, list] = {}
        for item, win in rows:
            by.setdefault(bytes(win), []).append(item)
        self.items = [sorted(set(v), key=str) for v in by.values()]
        self.lengths = np.array([len(w) // 16 for w in by], dtype=np.int64)
        pairs = np.frombuffer(b"".join(by), dtype="<u8").reshape(-1, 2)
        order, first = _by_term(pairs[:, 0], pairs[:, 1])
        self.vocabulary = pairs[order[first]]
        self.hashes = scramble(self.vocabulary[:, 0], self.vocabulary[:, 1])
        term = np.empty(len(pairs), dtype=np.int64)
        term[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        self.inside = np.arange(n) < self.lengths[:, None]
        self.terms = np.zeros((len(by), n), dtype=np.int64)
        self.terms[self.inside] = term

    def rank(self, frequency: np.ndarray) -> None:
        """Order each window's places from its rarest term on."""
        weight = np.where(self.inside, frequency[self.terms], np.iinfo(np.int64).max)
        order = np.argsort(weight, axis=1, kind="stable")
        # a short window repeats its rarest place
        self.order = np.where(self.inside, order, order[:, :1])

    def local(self, terms: np.ndarray) -> np.ndarray:
        """Place of each vocabulary term among a segment's terms, or -1."""
        out = np.full(len(self.vocabulary), -1, dtype=np.int64)
        if not len(terms):
            return out
        h = scramble(terms[:, 0], terms[:, 1])
        at = np.searchsorted(h, self.hashes)
        on = np.arange(len(at))
        while len(on := on[at[on] < len(h)]) and len(on := on[h[at[on]] == self.hashes[on]]):
            same = (terms[at[on]] == self.vocabulary[on]).all(axis=1)
            out[on[same]] = at[on[same]]
            on = on[~same]
            at[on] += 1  # another term with the same hash
        return out


class _Segment:
    """The posting lists of a segment, ready to be intersected with test windows."""

    def __init__(self, batch: pa.RecordBatch, i: int, w: _Windows):
        self.starts = _column(batch, i, "starts", "<i8")
        self.local = w.local(_column(batch, i, "terms", "<u8").reshape(-1, 2))
        self.counts = _column(batch, i, "counts", "<i4").astype(np.int64)
        self.postings = _column(batch, i, "postings", "<i4").astype(np.int64)
        self.offsets = np.cumsum(self.counts) - self.counts
        self.size = len(self.postings) + 1
        #: Sorted: one number for each posting of each term.
        self.keys = np.repeat(np.arange(len(self.counts)), self.counts) * self.size + self.postings

    def lists(self, win: np.ndarray, term: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, posting) of the whole list of one term for each window, a bounded number at a time."""
        n = self.counts[term]
        ends = np.cumsum(n)
        a = 0
        while a < len(win):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _CANDIDATES, side="right")))
            each = np.repeat(np.arange(a, b), n[a:b])
            inner = np.arange(len(each)) - np.repeat(ends[a:b] - n[a:b] - (ends[a - 1] if a else 0), n[a:b])
            yield win[each], self.postings[self.offsets[term[each]] + inner]
            a = b

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the list of each term has a posting from ``low`` to ``high``."""
        at = np.searchsorted(self.keys, term * self.size + low)
        out = (at < len(self.keys)) & (low <= high)
        out[out] = self.keys[at[out]] <= (term * self.size + high)[out]
        return out

    def phrases(self, w: _Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) wherever all words of a window stand in a document in their order."""
        term = self.local[w.terms]
        live = np.flatnonzero(((term >= 0) | ~w.inside).all(axis=1))
        found = []
        for win, place in self.lists(live, term[live, w.order[live, 0]]):
            start = place - w.order[win, 0]
            row = np.searchsorted(self.starts, place, side="right") - 1
            ok = (start >= self.starts[row]) & (start + w.lengths[win] <= self.starts[row + 1])
            win, start = win[ok], start[ok]
            for j in range(1, w.terms.shape[1]):
                if not len(win):
                    break
                o = w.order[win, j]
                ok = self.has(term[win, o], start + o, start + o)
                win, start = win[ok], start[ok]
            found.append((win, start))
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none)

    def near(self, w: _Windows, slack: int, missing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, document): proximity matches that are not phrases."""
        term = np.where(w.inside, self.local[w.terms], -1)
        enough = (term >= 0).sum(axis=1) >= w.lengths - missing
        found = []
        for anchor in range(min(2, w.terms.shape[1])):
            o = w.order[:, anchor]
            live = np.flatnonzero(enough & (term[np.arange(len(o)), o] >= 0))
            for win, place in self.lists(live, term[live, o[live]]):
                start = place - o[win]
                row = np.searchsorted(self.starts, place, side="right") - 1
                gone, moved = np.zeros(len(win), dtype=np.int64), np.zeros(len(win), dtype=bool)
                for j in range(w.terms.shape[1]):
                    t, inside = term[win, j], w.inside[win, j]
                    low, high = self.starts[row], self.starts[row + 1] - 1
                    here = start + j
                    close = (t >= 0) & self.has(np.maximum(t, 0), np.maximum(here - slack, low), np.minimum(here + slack, high))
                    moved |= inside & ~((t >= 0) & self.has(np.maximum(t, 0), np.maximum(here, low), np.minimum(here, high)))
                    gone += inside & ~close
                    ok = gone <= missing
                    win, start, row, gone, moved = (x[ok] for x in (win, start, row, gone, moved))
                found.append((win[moved], start[moved], row[moved]))
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none, none)

    def matches(self, w: _Windows, slack: int | None, missing: int) -> dict[int, tuple[list, list, list]]:
        """By document of the segment: matched items, [start, end) of each phrase, and (item, start, end) of proximity matches."""
        out: dict[int, tuple[list, list, list]] = {}
        win, start = self.phrases(w)
        row = np.searchsorted(self.starts, start, side="right") - 1
        for r in np.unique(row).tolist():
            own = row == r
            s = start[own] - self.starts[r]
            a, z = runs(covered(int(self.starts[r + 1] - self.starts[r]), s, s + w.lengths[win[own]]))
            out[r] = (sorted({x for k in np.unique(win[own]) for x in w.items[k]}, key=str), list(zip(a.tolist(), z.tolist())), [])
        if slack is not None:
            win, start, row = self.near(w, slack, missing)
            for r, k, s in {*zip(row.tolist(), win.tolist(), start.tolist())}:
                s -= int(self.starts[r])
                out.setdefault(r, ([], [], []))[2].extend((item, s, s + int(w.lengths[k])) for item in w.items[k])
        return out


def _frequencies(index: DataFrame, block) -> np.ndarray:
    """How often each term of the block occurs in all documents; at most one row per term reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = block.value
        total = np.zeros(len(w.vocabulary), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at = w.local(_column(batch, i, "terms", "<u8").reshape(-1, 2))
                total[at >= 0] += _column(batch, i, "counts", "<i4")[at[at >= 0]]
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["term", "n"])

    out = np.zeros(len(block.value.vocabulary), dtype=np.int64)
    for r in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def search(index: DataFrame, benchmark: DataFrame, n: int = 10, slack: int | None = None, missing: int = 1, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Matches of the benchmark's windows in the documents of an index.

    Returns per document: doc_id, n_words, n_hit (words inside any phrase match),
    items (array of matched item ids) and spans (array of [start, end) in words,
    merged where they touch); with ``slack`` also near (array of item, start and
    end of proximity matches).
    """
    spark = index.sparkSession
    wins = test_windows(benchmark, n)
    blocks = max(1, -(-wins.count() // block_windows))
    item = benchmark.schema["item_id"].dataType
    near = T.ArrayType(T.StructType([T.StructField("item_id", item), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    results = [("doc_id", index.schema["ids"].dataType.elementType), ("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(item)), ("spans", _SPANS), ("near", near)]
    found = [("segment", T.LongType()), ("row", T.IntegerType()), ("items", T.ArrayType(item)), ("spans", _SPANS), ("near", near)]
    typed = lambda fields: T.StructType([T.StructField(*f) for f in fields])
    kinds = to_arrow_type(T.ArrayType(item)), to_arrow_type(near)

    def lists(items: list, spans: list, nears: list) -> list[pa.Array]:
        return [pa.array(items, kinds[0]), pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], _ARROW_SPANS), pa.array([[{"item_id": x, "start": a, "end": z} for x, a, z in s] for s in nears], kinds[1])]

    def report(batch: pa.RecordBatch, i: int, matches: dict[int, tuple[list, list, list]]) -> pa.RecordBatch:
        words = np.diff(_column(batch, i, "starts", "<i8"))
        got = [matches.get(r, ([], [], [])) for r in range(len(words))]
        hit = [sum(z - a for a, z in s) for _, s, _ in got]
        ids = batch.column(batch.schema.get_field_index("ids"))[i].values
        return pa.RecordBatch.from_arrays([ids, pa.array(words), pa.array(hit, pa.int64()), *lists([sorted(x, key=str) for x, _, _ in got], [s for _, s, _ in got], [sorted(s, key=str) for _, _, s in got])], [f for f, _ in results])

    def at_once(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield report(batch, i, _Segment(batch, i, block.value).matches(block.value, slack, missing))

        return run

    def one_block(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    got = _Segment(batch, i, block.value).matches(block.value, slack, missing)
                    rows = [pa.array([batch.column(0)[i].as_py()] * len(got), pa.int64()), pa.array(list(got), pa.int32())]
                    yield pa.RecordBatch.from_arrays(rows + lists(*([x[k] for x in got.values()] for k in range(3))), [f for f, _ in found])

        return run

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = np.diff(_column(batch, i, "starts", "<i8"))
                all_of: dict[int, tuple[set, list, set]] = {}
                for x in batch.column(batch.schema.get_field_index("found"))[i].as_py() or []:
                    items, spans, nears = all_of.setdefault(x["row"], (set(), [], set()))
                    items.update(x["items"])
                    spans += [(s["start"], s["end"]) for s in x["spans"]]
                    nears.update((s["item_id"], s["start"], s["end"]) for s in x["near"])
                whole = {}
                for r, (items, spans, nears) in all_of.items():
                    s = np.array(spans, dtype=np.int64).reshape(-1, 2)
                    a, z = runs(covered(int(words[r]), s[:, 0], s[:, 1]))
                    whole[r] = (list(items), list(zip(a.tolist(), z.tolist())), list(nears))
                yield report(batch, i, whole)

    def sent(b: int):
        part = wins if blocks == 1 else wins.filter(F.pmod(F.xxhash64("item_id", "win"), F.lit(blocks)) == b)
        block = _Windows([(r.item_id, r.win) for r in part.toLocalIterator()], n)
        if len(block.vocabulary):
            block.rank(_frequencies(index, spark.sparkContext.broadcast(block)))
        else:
            block.order = block.terms
        return spark.sparkContext.broadcast(block)

    if blocks == 1:
        out = index.mapInArrow(at_once(sent(0)), typed(results))
    else:
        hits = [materialize(index.mapInArrow(one_block(sent(b)), typed(found)), "matches") for b in range(blocks)]
        every = hits[0]
        for more in hits[1:]:
            every = every.unionAll(more)
        met = every.groupBy("segment").agg(F.collect_list(F.struct("row", "items", "spans", "near")).alias("found"))
        out = index.select("segment", "ids", "starts").join(met, "segment", "left").mapInArrow(merged, typed(results))
    return out if slack is not None else out.drop("near")


def find_contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """:func:`search` of the benchmark in a new index of ``docs``."""
    return search(materialize(build_index(docs), "postings"), benchmark, **options)


def contamination_digest(found: DataFrame) -> DataFrame:
    """The per-document digest of :func:`find_contamination`."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contamination_digest(find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(len(w), 10) AS n FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0
), place AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM win) l, unnest(range(1, len(w) - n + 2)) t(i)
), hits AS (
  SELECT place.doc_id, place.i, place.n, win.item_id FROM place JOIN win ON place.g = win.g AND place.n = win.n
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) t(p) GROUP BY 1
), its AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
