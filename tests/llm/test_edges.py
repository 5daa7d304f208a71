"""Defined results on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm.components import components
from pointloom.llm.decontaminate import contamination_digest, find_contamination
from pointloom.llm.html_extract import extract, infer
from pointloom.llm.packing import pack_lengths
from pointloom.llm.queries import QUERIES
from pointloom.llm.simhash import allocate, group_bits, link_forest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, spans int, _hash string, items int, seed int, length int, label int"
TABLES = {
    "documents": DOCS,
    "labels": "doc_id long, quality int, toxic int, text string",
    "benchmark": "item_id long, text string, doc_id long, win int",
    "pages": "page_id long, url string, html string, main string, host int",
    "embeddings": "vec_id long, embedding array<float>, label int, cid long, vec int",
    "conversations": "conv_id long, turn long, role string, text string, turns int, body string",
}
LONG = " ".join(f"w{i}x 4111 1111 1111 1111" for i in range(3000))
PASSAGE = " ".join(f"phrase{i}" for i in range(14))


def filled():
    extra = (1.5, "fp", 3, "h", 4, 5, 6, 7)
    texts = {0: None, 1: "", 2: " \t\n", 3: "one", 4: f"a b {PASSAGE}", 5: f"c {PASSAGE} d", 6: PASSAGE, 7: LONG, 8: "x" * 200_000, 9: "a.b." * 20_000 + "@" * 50, 10: "é ü ß 中文 \U0001f600 a@b.c._x@y.zz 1.2.3.4.5.6.7.8 +1 (988) 555-2485", 11: "1 2  3-4 " + "9" * 30_000, 12: PASSAGE, 13: "---"}
    docs = [(i, t, None if i % 3 else "en", None, None if t is None else len(t), *extra) for i, t in texts.items()]
    docs += [docs[4], docs[12], (None, PASSAGE, None, None, None, *extra), (None, None, None, None, None, *([None] * 8))]
    return {
        "documents": docs,
        "labels": [(3, 0, None, None), (4, None, 1, "t"), (4, 1, 0, "t"), (5, 1, 0, None), (6, 1, 1, None), (None, 1, 1, None), (99, 0, 1, None)],
        "benchmark": [(1, PASSAGE, 0, 0), (1, PASSAGE, 0, 0), (2, "one", None, None), (3, None, 1, 1), (4, "", 1, 1), (None, "a b", 1, 1)],
        "pages": [(1, None, None, "m", 1), (2, "http://h/x", "", None, None), (3, "http://h/y", "<p>a<p>b" + "<div>" * 5000 + "z", "m", 1), (3, "http://h/y", "plain & simple &amp; <", "m", 1), (None, "::", "<article><h1>T</h1><script>x</article>", None, None)],
        "embeddings": [(1, [1.0, 0.0], 1, 1, 1), (2, [1.0, 0.0], 1, 1, 1), (2, [2.0, 0.01], 1, 1, 1), (3, None, 1, None, None), (4, [0.0, 0.0], 1, 1, 1), (5, [float("nan"), 1.0], 1, 1, 1), (6, [float("inf"), 1.0], 1, 1, 1), (7, [], 1, 1, 1), (8, [1.0], 1, 1, 1), (9, [None, 1.0], 1, 1, 1), (10, [0.0, 1.0], 1, 1, 1), (None, [1.0, 0.0], None, 1, 1)],
        "conversations": [(1, 0, "user", None, 1, "b"), (1, 1, None, "x", 1, "b"), (1, 1, "assistant", "<turn user>\n\\l\\", 1, "b"), (1, 1, "assistant", "<turn user>\n\\l\\", 1, "b"), (2, None, "assistant", "z", 1, "b"), (None, 0, "user", "q", None, None)],
    }


def write(spark, folder, rows):
    for name, schema in TABLES.items():
        spark.createDataFrame(rows.get(name, []), schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def edge_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("edge"), filled())


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).count() == (1 if name == "op1_chat" else 0)


def by(rows, key="doc_id"):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def test_op1_edges(spark, edge_dir):
    got = by(QUERIES["op1_chat"](spark, edge_dir).collect(), "conv_id")
    assert got[1][0].n_turns == 4 and got[1][0].loss_chars == 2 * len("<turn user>\n\\l\\") and not got[1][0].valid
    assert got[2][0].n_turns == 1 and got[None][0].n_turns == 1 and got[-7][0].valid


def test_op2_edges(spark, edge_dir):
    got = by(QUERIES["op2_decontaminate"](spark, edge_dir).collect())
    assert (got[0][0].n_words, got[0][0].n_items) == (0, 0)
    assert [r.n_hit for r in got[4]] == [14, 14] and [r.n_items for r in got[6]] == [1]
    assert got[3][0].n_hit == 1 and got[None][0].n_words in (0, 14)
    docs, items = (spark.read.parquet(f"{edge_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    many = contamination_digest(find_contamination(docs, items, block_windows=2))
    assert sorted(map(str, many.collect())) == sorted(str(r) for rs in got.values() for r in rs)


def test_op3_edges(spark, edge_dir):
    got = by(QUERIES["op3_html"](spark, edge_dir).collect(), "page_id")
    assert got[1][0].text == got[2][0].text == "" and got[None][0].text == "T"
    assert sorted(r.text for r in got[3]) == ["a b z", "plain & simple & <"]


def test_op4_edges(spark, edge_dir):
    got = by(QUERIES["op4_language"](spark, edge_dir).collect())
    assert {(r.lang_pred, r.score) for i in (0, 1, 2, 13) for r in got[i]} == {("und", 0.0)}
    assert len({(r.lang_pred, r.score) for r in got[4]}) == 1 and all(0 <= r.score <= 1 for rs in got.values() for r in rs)


def test_op5_edges(spark, edge_dir):
    got = by(QUERIES["op5_pii"](spark, edge_dir).collect())
    assert got[0][0].spans == got[1][0].spans == ""
    assert (got[7][0].n_card, got[9][0].n_email, got[11][0].n_card) == (3000, 0, 0)
    text = next(d[1] for d in filled()["documents"] if d[0] == 10)
    want = [("email", "a@b.c"), ("email", "._x@y.zz"), ("ip", "1.2.3.4"), ("ip", "5.6.7.8"), ("phone", "+1 (988) 555-2485")]
    assert [(k, text[int(a) : int(b)]) for k, a, b in (x.split(":") for x in got[10][0].spans.split(",")[:5])] == want


def test_op6_edges(spark, edge_dir):
    got = by(QUERIES["op6_substring_dedup"](spark, edge_dir).collect())
    assert (got[0][0].n_words, got[4][0].n_removed, got[4][1].n_removed) == (0, 0, 0)
    assert (got[5][0].n_removed, got[6][0].n_removed, got[12][0].n_removed) == (14, 14, 14)


def test_op7_edges(spark, edge_dir):
    got = by(QUERIES["op7_embeddings"](spark, edge_dir).collect(), "vec_id")
    assert (got[1][0].n_links, got[1][0].component_id, got[1][0].kept) == (3, 1, True)
    assert all((got[i][0].n_links, got[i][0].component_id, got[i][0].kept) == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10))
    assert got[None][0].component_id == 1


def test_op8_edges(spark, edge_dir):
    got = QUERIES["op8_pack"](spark, edge_dir).collect()
    assert [r.length for r in got if r.doc_id == 0] == [1]
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, o, n), (t, q, _) in itertools.pairwise(places):
        assert q == (o + n if s == t else 0)


def test_op9_edges(spark, edge_dir):
    got = by(QUERIES["op9_simhash"](spark, edge_dir).collect())
    assert {r.component_id for i in (0, 1, 2) for r in got[i]} == {0} and got[0][0].fingerprint == "0" * 16
    assert {r.component_id for r in got[12]} == {6} and {r.component_id for r in got[None]} == {0, 6}


def test_op10_edges(spark, edge_dir):
    got = by(QUERIES["op10_toxicity"](spark, edge_dir).collect())
    assert got[0][0].score == got[1][0].score == got[2][0].score
    assert len({r.score for r in got[4]}) == 1


@pytest.mark.parametrize("folder", ["edge_dir", "empty_dir"])
def test_pipeline_edges(spark, folder, request):
    d = request.getfixturevalue(folder)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, d), name)
        if name != "packing":
            assert out.schema == docs.schema
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
        docs = out
    if folder == "empty_dir":
        assert docs.count() == 0


def test_pipeline_stages_on_small_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    by_name = dict(corpus_pipeline.STAGES)
    left = {r.doc_id for r in by_name["simhash"](spark, docs, d).collect()}
    assert left == {r.doc_id for r in QUERIES["op9_simhash"](spark, d).collect() if r.doc_id == r.component_id}
    left = {r.doc_id for r in by_name["decontaminate"](spark, docs, d).collect()}
    assert left == {r.doc_id for r in QUERIES["op2_decontaminate"](spark, d).collect() if not r.contaminated}
    left = {r.doc_id for r in by_name["toxicity"](spark, docs, d).collect()}
    assert left == {r.doc_id for r in QUERIES["op10_toxicity"](spark, d).collect() if not r.predicted}
    masked = {r.doc_id: r for r in by_name["pii"](spark, docs, d).collect()}
    spans = {r.doc_id: r.spans for r in QUERIES["op5_pii"](spark, d).collect()}
    for r in docs.collect():
        want, at = "", 0
        for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans[r.doc_id].split(",") if x)):
            if a >= at:
                want += r.text[at:a] + f"[{kind.upper()}]"
            at = max(at, b)
        assert masked[r.doc_id].text == want + r.text[at:] and masked[r.doc_id].n_chars == len(masked[r.doc_id].text)


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_simhash_splits_dense_buckets(spark):
    rng = np.random.default_rng(1)
    one = np.uint64(1)
    flip = lambda n: one << rng.integers(0, 64, n, dtype=np.uint64)
    v = np.unique(np.concatenate([b ^ flip(60) ^ flip(60) for b in rng.integers(0, 1 << 63, 12, dtype=np.uint64)] + [rng.integers(0, 1 << 63, 200, dtype=np.uint64)]))
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 3
    label = np.arange(len(v))
    while not ((new := np.array([label[row].min() for row in near])) == label).all():
        label = new
    ids = v.view(np.int64)
    want = {}
    for k, i in enumerate(ids):
        want.setdefault(label[k], set()).add(int(i))
    root = {r.node: r.root for r in components(link_forest(spark.createDataFrame([(int(i),) for i in ids], "fp long"), 3, 8)).collect()}
    got = {}
    for i in ids:
        got.setdefault(root.get(int(i), int(i)), set()).add(int(i))
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_pigeonhole_thresholds():
    for m in (2, 3, 4):
        parts = group_bits(np.eye(64), 100, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        _, t = allocate([len(p) for p in parts], [10] * m, 1000, 3)
        assert sum(t) == 3 - m + 1


def test_pack_lengths_uses_every_piece_once():
    rng = np.random.default_rng(3)
    counts = {int(n): int(c) for n, c in zip(rng.integers(1, 2049, 300), rng.integers(1, 50, 300))}
    seen, bins = {}, 0
    for n, content in pack_lengths(counts):
        assert sum(k * x for x, k in content) <= 2048
        bins += n
        for x, k in content:
            seen[x] = seen.get(x, 0) + n * k
    assert seen == counts
    assert bins <= 1.15 * sum(n * c for n, c in counts.items()) / 2048 + 1


def test_wrapper_inference():
    pages = [f"<html><nav><a>x</a></nav><div class=body><h2>{t}</h2>" + f"<p>{t} text</p>" * n + "</div><div class=ad>buy</div></html>" for t, n in (("One", 3), ("Two", 5), ("Three", 2))]
    wrapper = infer(pages)
    assert "( <p> #slot </p> )+" in str(wrapper) and wrapper.nodes[wrapper.main[0]][0] == "div.body"
    assert extract(pages[0], wrapper) == "One" + " One text" * 3
    assert extract("<main>a<section id='comments'>c</section><form>f</form> b</main><aside>s</aside>", None) == "a b"
