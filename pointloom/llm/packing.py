"""Best-fit packing of documents into token sequences by large-item matching.

The packing is computed on the histogram of piece lengths, which has at most
``capacity`` rows whatever the input, and yields bin patterns with
multiplicities: pieces above a third of the capacity are matched greedily,
largest first with the largest partner that fits (two fit in a bin at most);
smaller pieces, in descending order, go to the tightest gap, and open new bins
only when no gap is left.  Pieces then find their place by their rank among
those of equal length; ranks come from salted counts, so a length that many
pieces share is spread over tasks.

Defined results: a null or empty text is one piece, the end token alone;
repeated rows are packed each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import materialize

CAPACITY, END = 2048, 0
#: Rows that one salted rank group has on average, at most.
RANK_ROWS = 50_000


class Encoder:
    """The ids that the tokenizer file gives, computed from the same vocabulary's ranks where that file is given.

    Texts that contain a special token's string go through the tokenizer itself.
    """

    def __init__(self, tokenizer: str, ranks: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> list[int]:
        text = text or ""
        if self.fast is None or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and the end token, cut to the capacity.

    Only documents longer than the capacity are cut; their first piece takes the remainder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path, fast, pat = tokenizer, ranks, pattern
        if path is None:
            path, fast, pat = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        encode = Encoder(path, fast, pat)
        for batch in batches:
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for r, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py()), END], dtype="<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append(r)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin patterns (bins, [(length, copies), ...]) for so many pieces of each length."""
    left = {n: c for n, c in counts.items() if c > 0}
    third = capacity / 3
    large = sorted((n for n in left if n > third), reverse=True)
    done: list[tuple[int, list[tuple[int, int]]]] = []
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(bins: int, content: list[tuple[int, int]]) -> None:
        gap = capacity - sum(n * k for n, k in content)
        if bins:
            (done if gap == 0 else gaps.setdefault(gap, [])).append((bins, content))

    for a in large:
        for b in large:
            if not left[a]:
                break
            if a + b > capacity or not left[b] or b > a:
                continue
            if a == b:
                put(left[a] // 2, [(a, 2)])
                left[a] %= 2
            else:
                m = min(left[a], left[b])
                put(m, [(a, 1), (b, 1)])
                left[a] -= m
                left[b] -= m
        put(left[a], [(a, 1)])
        left[a] = 0
    for s in sorted((n for n in left if n <= third), reverse=True):
        c = left[s]
        while c:
            gap = min((g for g in gaps if g >= s), default=None)
            if gap is None:
                k = capacity // s
                put(c // k, [(s, k)])
                put(1 if c % k else 0, [(s, c % k)])
                break
            bins, content = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
            k = gap // s
            full = min(bins, c // k)
            put(full, [*content, (s, k)])
            c -= full * k
            bins -= full
            if bins and c:
                put(1, [*content, (s, c)])
                c, bins = 0, bins - 1
            put(bins, content)
    return done + [x for xs in gaps.values() for x in xs]


def place_table(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies, offset), sorted; a few thousand at most."""
    rows, taken, base = [], {}, 0
    for bins, content in patterns:
        offset = 0
        for n, k in content:
            rows.append((n, taken.get(n, 0), base, k, offset))
            taken[n] = taken.get(n, 0) + bins * k
            offset += n * k
        base += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; extra columns of ``pieces`` are kept, whatever their names but these two."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = place_table(pack_lengths(counts, capacity))
    salts = max(16, -(-sum(counts.values()) // RANK_ROWS))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    salted = pieces.select(F.struct(*names).alias("row"), "length", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).alias("salt"))
    local = salted.withColumn("n", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row.doc_id", "row.piece", "row.ids_crc32")))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    ranked = local.join(sums.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before")), ["length", "salt"])
    ranked = ranked.select("row", "length", (F.col("before") + F.col("n") - 1).alias("rank"))
    places = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = places.value
        # rank and length in one key; ranks stay below 2**50
        keys = (t[:, 0] << 50) + t[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2))
            row = t[np.searchsorted(keys, (length << 50) + rank, side="right") - 1]
            inner = rank - row[:, 1]
            sequence = row[:, 2] + inner // row[:, 3]
            offset = row[:, 4] + inner % row[:, 3] * length
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    schema = T.StructType([ranked.schema["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(run, schema).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, **tokenizer) -> DataFrame:
    return pack(materialize(token_pieces(docs, capacity=capacity, **tokenizer), "pieces"), capacity)


def op8_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
