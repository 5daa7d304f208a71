"""Toxicity scores from a factorization machine over hashed terms.

Terms are the words of the whole text (ASCII lower-cased) and their openings of
four and six bytes, each hashed; a feature says that a document has a term at
least once, twice or three times.  From a
bounded sample of labelled documents the terms that tell the classes apart
best are kept, by counts that Spark takes, and a factorization machine learns their linear weights and, by
latent vectors, their pairwise interactions (an insult together with a group
mention).  Scoring is one narrow pass that looks terms up in a small table.

Bounds: ``max_train`` labelled documents are sampled by a hash of their id;
``n_terms`` is the width of the model, which takes the same ``steps`` of training
whatever the number of rows; all are parameters.  Nothing else is sampled, and
every document is scored from all its words.

Defined results: a null, empty or wordless text gets the score of no term;
without labelled rows, or with labels of one class only, every score is that
class's share (0 without labels); a document labelled twice counts as toxic if
any label says so; repeated documents get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .words import ALNUM, U64, Chunk, chunks

MAX_TRAIN, N_TERMS, FACTORS, STEPS, BATCH = 12_000, 2048, 8, 1200, 256
_BUCKETS = U64((1 << 26) - 1)


def fold(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(n))


def sampled(key: Column, want: int, of: int) -> Column:
    """True for about ``want`` of ``of`` rows, by a 63-bit hash of their key; for all if there are no more."""
    return F.lit(True) if of <= want else F.shiftrightunsigned(F.xxhash64(key), 1) < F.lit((want << 63) // of)


def _terms(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every word and opening of a chunk; hashed to 2**26 buckets."""
    row = c.row_of_word()
    length = c.ends - c.starts
    four, six = length > 4, length > 6
    hashed = [c.hashes(), c.hashes(4)[four] * U64(5), c.hashes(6)[six] * U64(7)]
    return np.concatenate([row, row[four], row[six]]), (np.concatenate(hashed) & _BUCKETS).astype(np.int64)


def _features(row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): for each term of a row, term * 4 + level for the levels its count reaches."""
    pair, n = np.unique((row.astype(np.int64) << 26) | term, return_counts=True)
    row, term = pair >> 26, (pair & int(_BUCKETS)) << 2
    return np.concatenate([row, row[n > 1], row[n > 2]]), np.concatenate([term, term[n > 1] + 1, term[n > 2] + 2])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in chunks(batch.column(0), ALNUM, lower=True):
            row, feature = _features(*_terms(c))
            order = np.lexsort((feature, row))
            offsets = np.searchsorted(row[order], np.arange(c.rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, batch.column(1).slice(c.first, c.rows)], ["terms", "toxic"])


class FactorizationMachine:
    """Logistic factorization machine on 0/1 features, trained by Adam on mini-batches."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(terms >> 2) & 0xFFFF] = True

    def score(self, c: Chunk) -> np.ndarray:
        """Probability of label 1 for each row of a chunk."""
        row, term = _terms(c)
        near = self.maybe[term & 0xFFFF]
        row, feature = _features(row[near], term[near])
        at = np.searchsorted(self.terms, feature)
        at[at == len(self.terms)] = 0
        same = self.terms[at] == feature if len(self.terms) else np.zeros(0, dtype=bool)
        row, at = row[same], at[same]
        out = np.full(c.rows, self.bias)
        out += np.bincount(row, self.weights[at], c.rows)
        for v in self.factors.T:
            out += 0.5 * (np.bincount(row, v[at], c.rows) ** 2 - np.bincount(row, v[at] ** 2, c.rows))
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))

    @classmethod
    def fit(cls, terms: np.ndarray, row: np.ndarray, place: np.ndarray, y: np.ndarray, k: int = FACTORS, steps: int = STEPS, seed: int = 7) -> FactorizationMachine:
        """``terms``: features, sorted; (row, place): which rows have which of them; ``y``: labels."""
        share = p = float(y.mean()) if len(y) else 0.0
        if share in (0.0, 1.0):
            return cls(np.zeros(0, dtype=np.int64), 35.0 if share else -35.0, np.zeros(0), np.zeros((0, k)))
        n, best = len(y), terms
        x = np.zeros((n, len(best)), dtype=np.uint8)
        x[row, place] = 1
        rng = np.random.default_rng(seed)
        params = [np.array([np.log(p / (1 - p))]), np.zeros(len(best)), rng.normal(0, 0.02, (len(best), k))]
        first, second = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
        order = np.zeros(0, dtype=np.int64)
        for step in range(1, steps + 1):
            while len(order) < BATCH:
                order = np.concatenate([order, rng.permutation(n)])
            at, order = order[:BATCH], order[BATCH:]
            xb = x[at].astype(np.float64)
            bias, w, v = params
            xv = xb @ v
            z = bias + xb @ w + 0.5 * (xv**2 - xb @ v**2).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[at]) / len(at)
            gx = xb.T @ g
            grads = [np.array([g.sum()]), gx + 1e-4 * w, xb.T @ (g[:, None] * xv) - v * gx[:, None] + 1e-3 * v]
            for q, gr, m1, m2 in zip(params, grads, first, second):
                m1 += 0.1 * (gr - m1)
                m2 += 0.01 * (gr**2 - m2)
                q -= 0.02 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        return cls(best, float(params[0][0]), params[1], params[2])


def select_terms(lists: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """The features that tell the classes apart best by chi-square (at most n_terms reach the driver), sorted; and the rows."""
    n, positive = lists.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    p = positive / n if n else 0.0
    if p in (0.0, 1.0):
        return np.zeros(0, dtype=np.int64), n
    seen = lists.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").alias("k")).filter("n >= 3")
    gap = F.col("k") - F.col("n") * p
    chi = gap * gap / (F.col("n") * p * (1 - p) * (1 - F.col("n") / (n + 1)))
    return np.sort(np.array([r.term for r in seen.orderBy(chi.desc(), "term").limit(n_terms).collect()], dtype=np.int64)), n


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, max_train: int = MAX_TRAIN, n_terms: int = N_TERMS, **fit) -> FactorizationMachine:
    """Fit on at most about ``max_train`` labelled documents outside the held-out fold."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(fold(F.col("doc_id"), folds) != held_out)
    # at most about max_train rows: small enough to send to every executor
    picked = known.filter(sampled(F.col("doc_id"), max_train, known.count()))
    lists = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic").mapInArrow(_sparse, "terms array<int>, toxic int")
    lists = materialize(lists.hint("rebalance"), "terms")  # a few files, not one per task of the scan
    best, n = select_terms(lists, n_terms)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.flatnonzero(np.isin(best, np.asarray(v.values))).astype("<i4").tobytes() for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), batch.column(1)], ["places", "toxic"])

    # in an order that does not depend on tasks; a row is its features among n_terms
    rows = sorted((bytes(r.places), r.toxic) for r in lists.mapInArrow(keep, "places binary, toxic int").toLocalIterator())
    places = [np.frombuffer(b, dtype="<i4") for b, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(v) for v in places])
    return FactorizationMachine.fit(best, row, np.concatenate([np.zeros(0, dtype=np.int32), *places]), np.array([t for _, t in rows], dtype=np.float64), **fit)


def score(docs: DataFrame, model: FactorizationMachine, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns ``keep``, score and predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = list(dict.fromkeys(["doc_id", *keep]))
    source = names if "text" in names else [*names, "text"]
    at = source.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.score(c) for c in chunks(batch.column(at), ALNUM, lower=True)]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*source).mapInArrow(run, f"{fields}, score double, predicted int")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return score(docs, model).select("doc_id", held, "score", "predicted")
