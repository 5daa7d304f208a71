"""Operators against plain versions on small made-up tables."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import language, toxicity
from pointloom.llm.chat import format_conversations, read_back
from pointloom.llm.decontaminate import build_index, find_contamination, search
from pointloom.llm.packing import pack
from pointloom.llm.pii import find_pii, mask
from pointloom.llm.words import ALNUM, chunks
from tests.llm.test_exact import thue_morse

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def texts(rng, n, size, words=40):
    return [" ".join(f"v{rng.randrange(words)}" for _ in range(rng.randrange(size))) for _ in range(n)]


def windows(items, n):
    out = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(t)
        for k in range(max(1, len(w) - n + 1)) if w else ():
            out[tuple(w[k : k + n])].add(i)
    return out


def test_phrases_and_proximity(spark):
    rng, n, slack = random.Random(3), 5, 2
    docs = list(enumerate(texts(rng, 40, 60)))
    items = list(enumerate(texts(rng, 6, 12)))
    for _, t in items[:4]:  # an inserted word, a changed word
        w = t.split()
        docs += [(len(docs), " ".join(["x", *w[:2], "inserted", *w[2:], "y"])), (len(docs) + 100, " ".join([*w[:2], "changed", *w[3:]]))]
    a, b = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((docs, "doc_id"), (items, "item_id")))
    index = build_index(a)
    got = {r.doc_id: r for r in search(index, b, n=n, slack=slack).collect()}
    again = {r.doc_id: r for r in search(index, b, n=n, slack=slack, block_windows=3).collect()}
    by = windows(items, n)
    count = collections.Counter(x for _, t in docs for x in WORD.findall(t))
    phrases = nears = 0
    for i, t in docs:
        w, hit, found, near = WORD.findall(t), set(), set(), set()
        place = collections.defaultdict(list)
        for k, x in enumerate(w):
            place[x].append(k)
        for win, ids in by.items():
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit.update(range(s, s + len(win)))
                    found |= ids
            for o in sorted(range(len(win)), key=lambda o: (count[win[o]], o))[:2]:
                for s in (k - o for k in place[win[o]]):
                    close = sum(any(abs(k - s - j) <= slack for k in place[x]) for j, x in enumerate(win))
                    exact = all(0 <= s + j < len(w) and w[s + j] == x for j, x in enumerate(win))
                    if close >= len(win) - 1 and not exact:
                        near |= {(x, s, s + len(win)) for x in ids}
        for r in (got[i], again[i]):
            assert (r.n_words, r.n_hit, set(r["items"])) == (len(w), len(hit), found)
            assert {tuple(x) for x in r.near} == near
        phrases += len(found)
        nears += len(near)
    assert phrases and nears


def test_phrases_tell_colliding_words_apart(spark):
    rest = " ".join(f"w{i}" for i in range(9))
    docs = spark.createDataFrame([(i, f"{thue_morse(i)} {rest}") for i in (0, 1)], "doc_id long, text string")
    items = spark.createDataFrame([(5, f"{thue_morse(0)} {rest}")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in find_contamination(docs, items).collect()} == {0: 10, 1: 0}


def test_factorization_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    (c,) = chunks(pa.array(["you dirty dirty trolls", "dirty", "", "nothing known here", "trolls you you you"]), ALNUM)
    row, feature = toxicity._features(*toxicity._terms(c))
    terms = np.unique(feature)[::2]
    w, v = rng.normal(size=len(terms)), rng.normal(size=(len(terms), 3))
    got = toxicity.FactorizationMachine(terms, 0.3, w, v).score(c)
    for r in range(c.rows):
        on = [k for k, t in enumerate(terms) if t in set(feature[row == r])]
        z = 0.3 + sum(w[k] for k in on) + sum(float(v[i] @ v[j]) for i, j in itertools.combinations(on, 2))
        assert got[r] == pytest.approx(1 / (1 + np.exp(-z)))


def test_factorization_machine_learns_a_pair():
    """Neither of two words is toxic, both together are: no linear weights can tell."""
    rng = random.Random(2)
    words = [f"v{k}" for k in range(20)]
    rows = [([x for x, on in (("insult", a), ("group", b)) if on] + rng.sample(words, 5), a and b) for a in (0, 1) for b in (0, 1) for _ in range(100)]
    (c,) = chunks(pa.array([" ".join(w) for w, _ in rows]), ALNUM)
    row, feature = toxicity._features(*toxicity._terms(c))
    terms, place = np.unique(feature, return_inverse=True)
    y = np.array([float(t) for _, t in rows])
    model = toxicity.FactorizationMachine.fit(terms, row, place, y)
    assert ((model.score(c) >= 0.5) == (y == 1)).all()


def test_language_profiles_are_bundles_of_bound_letters():
    text = "Ab cä"
    (_, got), = language.profiles(pa.array([text]))
    vector = lambda ch: language._letter_vectors(np.array([ord(ch) if ch != " " else 0]))[0].astype(int)
    total = np.zeros(language.DIMENSIONS)
    padded = " ab cä "
    for k in range(1, len(padded) - 1):
        if padded[k] != " ":
            total += np.roll(vector(padded[k - 1]), 2) * np.roll(vector(padded[k]), 1) * vector(padded[k + 1])
    assert got[0] == pytest.approx(total / np.linalg.norm(total), abs=1e-6)


def test_samples_of_very_large_tables(spark):
    rows = spark.range(1000)
    for want, of in ((1, 10**12), (12_000, 2 * 10**10), (500, 1000), (5, 3)):
        kept = rows.filter(toxicity.sampled(F.col("id"), want, of)).count()
        assert kept == 1000 if of <= want else kept <= 1000 * want / of + 100
        assert of <= want or (want << 63) // of > 0


def test_cues_come_from_seeds(spark):
    secret = [f"{k:016x}" for k in (0xA1B2C3D4E5F60718, 0xB1B2C3D4E5F60719, 0xC1B2C3D4E5F60710)]
    seeded = [f"x password={s} y" for s in secret]
    find = lambda rows: {r.doc_id: r.spans for r in find_pii(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert find(["password=hello1world"]) == {0: []}
    got = find([*seeded, "password=hello1world", "a password=correcthorse b", "size=large1 and size=small"])
    assert [[tuple(s) for s in got[k]] for k in (3, 4, 5)] == [[("id", 9, 20)], [("id", 11, 23)], []]


def test_long_texts_of_spans(spark):
    n = 40_000
    text = " ".join(f"a{k}@b.c" for k in range(n))
    (row,) = find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    want = [("email", m.start(), m.end()) for m in re.finditer(r"a\d+@b\.c", text)]
    assert [tuple(s) for s in row.spans] == want


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.cc x", 7, 8, 9, 10)], "doc_id long, text string, spans int, _id int, _hash int, _b int")
    out = mask(docs, find_pii(docs))
    assert out.columns == docs.columns and tuple(out.first()) == (1, "[EMAIL] x", 7, 8, 9, 10)
    names = ["n", "c", "salt", "rank", "row", "before", "_rank", "_n"]
    pieces = spark.createDataFrame([(1, 0, 0, 5, 1, *range(8)), (2, 0, 0, 5, 2, *range(8))], "doc_id long, piece int, start long, length long, ids_crc32 long, " + ", ".join(f"{x} int" for x in names))
    got = sorted(pack(pieces).collect())
    assert [tuple(r)[:13] for r in got] == sorted(tuple(r) for r in pieces.collect()) and {r.offset for r in got} == {0, 5}


def test_ties_of_turns_are_ordered_by_the_text_itself(spark):
    rows = spark.createDataFrame([(1, 0, "user", t) for t in ("<b", "A", "\\", "a")], "conv_id long, turn long, role string, text string")
    (r,) = format_conversations(rows).select(read_back(F.col("formatted")).alias("turns")).collect()
    assert [t.text for t in r.turns] == ["<b", "A", "\\", "a"]


def test_simhash_stage_with_repeated_ids(spark):
    x, y = "one two three four five six", "seven eight nine ten eleven twelve thirteen"
    rows = [(1, x), (5, x), (5, y), (5, y), (None, x), (None, None), (9, y)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.simhash(spark, docs, "").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in spark.createDataFrame([(1, x, "s"), (5, y, "s"), (None, x, "s"), (None, None, "s")], docs.schema).collect())


def test_whole_pipeline(spark):
    """run() against the stages' operators and, for packing, the tokenizer itself."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from pointloom.llm.queries import QUERIES
    from tests.llm.test_brute_force import D

    docs = spark.read.parquet(f"{D}/documents.parquet")
    toxic = {r.doc_id for r in QUERIES["op10_toxicity"](spark, D).collect() if r.predicted}
    left = docs.filter(~F.col("doc_id").isin(*toxic)) if toxic else docs
    for stage in (corpus_pipeline.simhash, corpus_pipeline.decontaminate, corpus_pipeline.pii):
        left = corpus_pipeline.materialize(stage(spark, left, D), "left")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in left.collect()}
    rows = corpus_pipeline.run(spark, D).collect()
    assert {r.doc_id for r in rows} == set(want)
    places = collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
        places[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *itertools.accumulate(n for _, n in sorted(p))][:-1] and sum(n for _, n in p) <= 2048
