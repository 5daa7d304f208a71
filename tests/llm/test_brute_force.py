"""Each query against a plain version over the smallest tables."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from pointloom.llm.queries import QUERIES

D = "/root/testdata/sf0.001"
SPACED, ALNUM = re.compile("[^\x20\x09-\x0d]+"), re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(spark.read.parquet(f"{D}/documents.parquet").collect(), key=lambda r: r.doc_id)


def rows(spark, name, key="doc_id"):
    return {r[key]: r for r in QUERIES[name](spark, D).collect()}


def components(linked):
    label = np.arange(len(linked))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            return label
        label = new


def test_op2(spark, docs):
    got, windows = rows(spark, "op2_decontaminate"), {}
    for r in spark.read.parquet(f"{D}/benchmark.parquet").collect():
        w = ALNUM.findall((r.text or "").translate(LOWER))
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(r.item_id)
    hits = 0
    for r in docs:
        w, hit, items = ALNUM.findall((r.text or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[k]
        assert tuple(got[r.doc_id])[1:] == (len(w), len(hit), len(items), sha(",".join(sorted(map(str, items)))), bool(hit))
        hits += bool(hit)
    assert hits


def test_op5(spark, docs):
    got = rows(spark, "op5_pii")

    def luhn(s):
        return sum(n if not i % 2 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(s)))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    for r in docs:
        counts, spans = [], []
        for k, (pattern, ok) in kinds.items():
            m = [x for x in re.finditer(pattern, r.text or "") if ok(x.group())]
            counts.append(len(m))
            spans += [f"{k}:{x.start()}:{x.end()}" for x in m]
        g = got[r.doc_id]
        assert (g.n_email, g.n_ip, g.n_card, g.n_phone, g.base_sha256) == (*counts, sha(",".join(spans)))
        assert g.spans.startswith(",".join(spans))


def test_op6(spark, docs):
    got, first = rows(spark, "op6_substring_dedup"), {}
    words = {r.doc_id: SPACED.findall(r.text or "") for r in docs}
    for i, w in words.items():
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    removed = 0
    for i, w in words.items():
        gone = {x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(k, k + 13)}
        assert tuple(got[i])[1:] == (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
        removed += len(gone)
    assert removed


def test_op7(spark):
    got = rows(spark, "op7_embeddings", "vec_id")
    r = spark.read.parquet(f"{D}/embeddings.parquet").collect()
    x = np.array([v.embedding for v in r], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.95
    ids = np.array([v.vec_id for v in r])
    label = components(linked)
    for k, i in enumerate(ids):
        least = ids[label == label[k]].min()
        assert tuple(got[i])[1:] == (linked[k].sum() - 1, least, i == least)


def test_op8(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["op8_pack"](spark, D).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    total = 0
    for d in docs:
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(pieces[d.doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == 2048)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
        total += at
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(sequences) <= -(-total // 2048) + 1


def test_op9(spark, docs):
    got = rows(spark, "op9_simhash")

    def fingerprint(text):
        w = SPACED.findall((text or "").translate(LOWER))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = np.array([fingerprint(r.text) for r in docs], dtype=np.uint64)
    label = components(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    for k, r in enumerate(docs):
        assert tuple(got[r.doc_id])[1:] == (format(int(fps[k]), "016x"), docs[label[k]].doc_id)


def test_op3(spark):
    import html

    got = rows(spark, "op3_html", "page_id")
    for r in spark.read.parquet(f"{D}/pages.parquet").collect():
        a = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:h1|p)>|<br>", "\n", a))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


def test_op4_op10_held_out(spark):
    d = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = QUERIES["op4_language"](spark, d).collect()
    assert len(got) == len(lang)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in QUERIES["op10_toxicity"](spark, d).collect() if r.doc_id in toxic]
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.9 * len(held)
    assert not any(r.predicted and not toxic[r.doc_id] for r in held)


def test_op1(spark):
    import duckdb

    from pointloom.llm.chat import OP1_SQL

    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{D}/conversations.parquet'")
    assert {tuple(r) for r in QUERIES["op1_chat"](spark, D).collect()} == set(con.sql(OP1_SQL).fetchall())
