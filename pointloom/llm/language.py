"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A trigram is bound by
multiplying its letters' vectors, permuted by their place; a document bundles
(adds) the vectors of its trigrams; a language's prototype bundles the unit
vectors of its documents.  A document gets the language whose prototype has the
largest cosine with it, and that cosine (0 at least) as its score.  A word's
edge counts as a letter, so short words have trigrams too.

Bound: prototypes are learned from at most about ``max_train`` documents,
picked by a hash of their id; every document is predicted from its whole text.

Defined results: ``und`` with score 0 for a null text, one without letters, or
if nothing could be learned; ties go to the smaller language name; repeated
documents get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .toxicity import fold, sampled

DIMENSIONS, MAX_TRAIN = 512, 20_000
_CHUNK = 1 << 20
_LIMIT = 0x110000
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """Code point of the lower-case letter of each code point, or 0."""
    if "letters" not in _tables:
        table = np.zeros(_LIMIT, dtype=np.int64)
        for i in range(_LIMIT):
            ch = chr(i)
            if ch.isalpha():
                low = ch.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _tables["letters"] = table
    return _tables["letters"]


def _letter_vectors(points: np.ndarray) -> np.ndarray:
    """A +1/-1 vector per code point, made from the code point alone."""
    words = points.astype(np.uint64)[:, None] * np.uint64(1 << 16) + np.arange(DIMENSIONS // 64, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
            words = (words ^ (words >> np.uint64(31))) * np.uint64(k)
        words ^= words >> np.uint64(29)
    return np.unpackbits(words.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def _trigram_vectors(codes: np.ndarray) -> np.ndarray:
    parts = [codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF]
    points, where = np.unique(np.concatenate(parts), return_inverse=True)
    vectors = _letter_vectors(points)
    a, b, c = where.reshape(3, -1)
    return np.roll(vectors, 2, axis=1)[a] * np.roll(vectors, 1, axis=1)[b] * vectors[c]


def profiles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, unit profile of each row) by chunks of bounded size; a row without letters has a zero profile."""
    texts = texts.fill_null("") if texts.null_count else texts
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, side="right")))
        part = texts.slice(at, to - at)
        points = np.frombuffer("".join(part.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        row = np.repeat(np.arange(to - at), sizes[at:to])
        letter = _letters()[points]
        left, right = np.zeros_like(letter), np.zeros_like(letter)
        if len(letter):
            same = row[1:] == row[:-1]
            left[1:] = np.where(same, letter[:-1], 0)
            right[:-1] = np.where(same, letter[1:], 0)
        mid = np.flatnonzero(letter)
        codes, where = np.unique((left[mid] << 42) | (letter[mid] << 21) | right[mid], return_inverse=True)
        out = np.zeros((to - at, DIMENSIONS), dtype=np.float32)
        for a in range(0, len(codes), 8192):  # a bounded number of trigram vectors at a time
            own = (where >= a) & (where < a + 8192)
            k = min(8192, len(codes) - a)
            vectors = _trigram_vectors(codes[a : a + k]).astype(np.float32)
            rows = row[mid[own]]
            for r0 in range(0, to - at, 512):
                pick = (rows >= r0) & (rows < r0 + 512)
                n = min(512, to - at - r0)
                counts = np.bincount((rows[pick] - r0) * k + where[own][pick] - a, minlength=n * k).reshape(n, k)
                out[r0 : r0 + n] += counts.astype(np.float32) @ vectors
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        yield at, out / np.where(norm > 0, norm, 1)
        at = to


def learn(docs: DataFrame, max_train: int = MAX_TRAIN, folds: int = 3, held_out: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from documents outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    picked = known.filter(sampled(F.col("doc_id"), max_train, known.count())).select("text", "lang")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for at, unit in profiles(batch.column(0)):
                own = langs[at : at + len(unit)]
                for lang in set(own.tolist()):
                    whole = np.rint(unit[own == lang] * (1 << 20)).astype(np.int64).sum(axis=0)
                    total[lang] = total.get(lang, 0) + whole
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(v)], ["lang", "dim", "v"])

    # one row per language and dimension reaches the driver
    rows = picked.mapInArrow(bundle, "lang string, dim long, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r.lang for r in rows})
    out = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        out[langs.index(r.lang), r.dim] = r.v
    norm = np.linalg.norm(out, axis=1)
    kept = np.flatnonzero(norm > 0)
    return [langs[i] for i in kept], (out[kept] / norm[kept, None]).astype(np.float32)


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast((np.array([*langs, "und"], dtype=object), prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, proto = model.value
        for batch in batches:
            for at, unit in profiles(batch.column(1)):
                best, score = np.full(len(unit), len(names) - 1), np.zeros(len(unit))
                if len(proto):
                    cosine = (unit @ proto.T).astype(np.float64)
                    known = np.abs(unit).any(axis=1)
                    best = np.where(known, cosine.argmax(axis=1), best)
                    score = np.where(known, np.clip(cosine.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(unit)), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out")
    return identify(docs, *learn(docs)).select("doc_id", held, "lang_pred", "score")
