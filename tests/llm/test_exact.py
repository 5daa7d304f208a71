"""Words are told apart exactly, also where sums of powers modulo 2**64 collide; hashes equal the library's."""

import random
import re

import numpy as np
import pyarrow as pa
import xxhash

from pointloom.llm.simhash import majority, xxh64
from pointloom.llm.substring_dedup import dedup_substrings
from pointloom.llm.words import SPACED, chunks, exact_pairs


def thue_morse(first: int, n: int = 1024) -> str:
    return "".join("ab"[(i.bit_count() + first) % 2] for i in range(n))


def random_strings(n=3000):
    rng = random.Random(1)
    data = np.frombuffer(bytes(rng.randrange(256) for _ in range(20_000)), dtype=np.uint8)
    starts = np.array([rng.randrange(15_000) for _ in range(n)])
    return data, starts, starts + np.array([rng.choice([rng.randrange(40), rng.randrange(700)]) for _ in range(n)])


def test_xxh64_equals_the_library():
    data, starts, ends = random_strings()
    raw = data.tobytes()
    assert xxh64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(starts, ends)]


def test_majority_of_long_runs():
    rng = np.random.default_rng(2)
    n = np.array([1, 2, 254, 255, 256, 511, 3000])
    h = rng.integers(0, 1 << 63, int(n.sum()), dtype=np.uint64) * np.uint64(2)
    at = 0
    for k, got in zip(n.tolist(), majority(h, n).tolist()):
        own = h[at : at + k].tolist()
        at += k
        assert got == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > k)


def test_identities():
    data, starts, ends = random_strings()
    raw, seen = data.tobytes(), {}
    for key, a, b in zip(zip(*(x.tolist() for x in exact_pairs(data, starts, ends))), starts.tolist(), ends.tolist()):
        assert seen.setdefault(key, raw[a:b]) == raw[a:b]
    assert len(seen) == len(set(seen.values()))
    (c,) = chunks(pa.array([f"{thue_morse(0)} {thue_morse(1)} a a\0 a"]), SPACED)
    assert len(set(c.hashes().tolist())) == 4


def test_substring_dedup_tells_colliding_words_apart(spark):
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{thue_morse(0)} {rest}"), (2, f"{thue_morse(1)} {rest}"), (3, f"x {thue_morse(1)} {rest}")]
    got = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(got[i].factors) for i in (1, 2, 3)] == [0, 0, 1]
    assert tuple(got[3].factors[0]) == (1, 14, 2, 0) and got[3].kept == "x"


def test_factors_copy_their_source(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = dedup_substrings(docs).collect()
    words = {r.doc_id: re.findall("[^\x20\x09-\x0d]+", r.text or "") for r in docs.collect()}
    factors = [(r.doc_id, f) for r in rows for f in r.factors]
    assert factors
    for i, f in factors:
        assert f.source < i and words[i][f.start : f.end] == words[f.source][f.source_start : f.source_start + f.end - f.start]
    for r in rows:
        assert all(a.end <= b.start for a, b in zip(r.factors, r.factors[1:]))


def test_substring_dedup_in_many_chunks(spark, monkeypatch):
    """A chunk a document, several owners: as with one chunk."""
    from pointloom.llm import substring_dedup

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    whole = sorted(map(str, dedup_substrings(docs).collect()))
    monkeypatch.setattr(substring_dedup, "OWNED", 1 << 16)
    assert sorted(map(str, dedup_substrings(docs.repartition(40)).collect())) == whole
