"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

1. Base kinds (e-mail, IP, card, phone) are found by their patterns.
2. Every identifier-like token (one with a digit, or any value behind ``key=``)
   that is no base span is a candidate; the words around candidates and around
   base spans, and a ``key=`` in front of them, are their cues (lexical patterns).
3. On the bipartite graph of cues and values, seeds (base values, and values of
   the formats in ``seed_formats``) have confidence 1.  A cue's confidence is the
   mean confidence of its distinct values, if enough are trusted; a value's
   confidence combines its cues' (1 - product of doubts).  Rounds go on until the
   cues and their confidences, which only grow, are as in the round before.  Seeds
   and the values of trusted cues are reported as kind ``id``.  No cue is given:
   every one is induced by seeds.

Mentions travel as arrays beside the document's id and a hash of its text; the
graph is reduced by (cue, value) before it is reduced by cue, so a cue or value
that fills a large part of the corpus costs one row per task.

Base patterns are written so that the regex engine never retries inside a run:
possessive quantifiers, and a look-behind (or the end of the match before) for
the start.  They match what the plain patterns match, in linear time.

Defined results: a null or empty text has no spans; repeated rows get equal
spans; an empty table gives an empty result; a null doc_id is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A token with a digit or with ``key=`` in front, from white space or a quote on; quotes and brackets end it.
TOKEN = r"(?<![^\s\"'<>()\[\]{},;])(?:[^\s\"'<>()\[\]{},;0-9]*+[0-9]|[A-Za-z_][A-Za-z_.-]*+=(?=[^\s\"'<>()\[\]{},;=]))[^\s\"'<>()\[\]{},;]*+"
#: Formats of values that are secrets wherever they stand: access keys, and digests or keys in hexadecimal.
SEED_FORMATS = (r"^AKIA[0-9A-Z]{16}$", r"^(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,64}$")
#: Entries that one sum covers; sums of sums cover as many sums.
_WIDTH = 32
#: Code points in a piece of text when spans are masked, and pieces looked up together.
_PIECE, _PIECES = 256, 64


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))

    def add(total: Column, i: Column) -> Column:
        n = F.substring(d, i, F.lit(1)).cast("int")
        twice = n * 2
        return total + F.when(i % 2 == 1, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int") <= 255, F.lit(False))
        return F.forall(F.split(x, r"\."), small)
    if kind == "card":
        return _luhn(x)
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _checked(kind: str) -> Column:
    return F.filter(kind, lambda x: _valid(kind, x["value"]))


def with_matches(df: DataFrame, name: str, pattern: str, trigger: Column, text: str = "text") -> DataFrame:
    """Add ``name``: array of (start, end, value, left, right) of the pattern's matches, in code points.

    Positions are prefix sums of the gaps that ``split`` leaves, from sums of
    growing width, so that each takes a bounded number of steps; left and right
    are the text of the gaps next to the match.
    """
    none = F.array().cast("array<string>")
    m, g, *levels = (f"_{name}_{x}" for x in ("m", "g", "s0", "s1", "s2", "s3"))
    df = df.withColumn(m, F.when(trigger, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(text, pattern, -1)))
    df = df.withColumn(levels[0], F.transform(m, lambda x, i: F.length(F.get(g, i)) + F.length(x)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)
    for low, high in zip(levels, levels[1:]):
        df = df.withColumn(high, F.when(F.size(low) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(low) - 1) / _WIDTH).cast("int")), lambda k: total(F.slice(low, k * _WIDTH + 1, F.lit(_WIDTH))))))

    def place(x: Column, i: Column) -> Column:
        before, at = F.length(F.get(g, i)), i
        for level in levels[:-1]:
            up = F.floor(at / _WIDTH).cast("int")
            before, at = before + total(F.slice(level, up * _WIDTH + 1, at % _WIDTH)), up
        before = before + total(F.slice(levels[-1], F.lit(1), at))
        left, right = F.substring(F.get(g, i), -60, 60), F.substring(F.get(g, i + 1), 1, 40)
        return F.struct(before.alias("start"), x.alias("value"), left.alias("left"), right.alias("right"))

    ends = lambda x: F.struct(x["start"], (x["start"] + F.length(x["value"])).alias("end"), x["value"], x["left"], x["right"])
    return df.withColumn(name, F.transform(F.transform(m, place), ends)).drop(m, g, *levels)


def _blanked(kind: str, text: str) -> Column:
    """The text with the valid matches of a base kind turned into spaces, as long as they were."""
    pattern = PATTERNS[kind]
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    blank = F.transform(F.concat(found, F.array(F.lit(""))), lambda x: F.when((x != "") & _valid(kind, x), F.repeat(F.lit(" "), F.length(x))).otherwise(x))
    return F.array_join(F.zip_with(gaps, blank, lambda a, b: F.concat(a, b)), "")


def _cues(x: Column) -> Column:
    """Lexical patterns around a match: two words before it, and the words on both sides."""
    left, right = F.lower(x["left"]), F.lower(x["right"])
    two = F.regexp_extract(left, r"(\S+\s+\S+[\s\"'(\[{<]*)$", 1)
    one = F.regexp_extract(left, r"(\S+[\s\"'(\[{<]*)$", 1)
    after = F.regexp_extract(right, r"^(\S*\s*\S+)", 1)
    norm = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[\s\"'(\[{<]+$", ""), r"\s+", " "))
    return F.filter(
        F.array(
            F.when(two != "", F.concat(F.lit("2<"), norm(two))),
            F.when((one != "") & (after != ""), F.concat(F.lit("1<"), norm(one), F.lit(" > "), norm(after))),
        ),
        lambda c: c.isNotNull(),
    )


def mentions(docs: DataFrame, seed_formats: tuple[str, ...] = SEED_FORMATS) -> DataFrame:
    """Per row: doc_id, text_hash, one array of (start, end) per base kind, and marks: seeds and candidates with cues."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digit = F.col("text").rlike("[0-9]")
    df = df.withColumn("_digit", digit)
    triggers = {"email": F.contains("text", F.lit("@")), "ip": F.col("_digit"), "card": F.col("_digit"), "phone": F.col("_digit") & F.contains("text", F.lit("+"))}
    for kind in KINDS:
        df = with_matches(df, kind, PATTERNS[kind], triggers[kind])
        df = df.withColumn(kind, _checked(kind))
    df = df.withColumn("_base", F.concat(*KINDS))
    # candidates come from the text without base spans, so they never overlap one
    df = df.withColumn("_keyed", F.col("_digit") | F.contains("text", F.lit("=")))
    df = df.withColumn("_free", F.when(F.col("_keyed"), F.col("text")).otherwise(""))
    for kind in KINDS:
        df = df.withColumn("_free", F.when(F.size(kind) > 0, _blanked(kind, "_free")).otherwise(F.col("_free")))
    df = with_matches(df, "token", TOKEN, F.col("_keyed"), "_free")
    # key=value: the key is a cue, the value the identifier; marks at the end belong to the sentence
    parts = r"^([A-Za-z_][A-Za-z_.-]*[=:](?=[^=:]))?(.*?)[^A-Za-z0-9]*$"
    split = lambda x: F.struct(F.regexp_extract(x["value"], parts, 1).alias("key"), F.regexp_extract(x["value"], parts, 2).alias("value"), x["start"], x["left"], x["right"])
    df = df.withColumn("token", F.filter(F.transform("token", split), lambda x: F.when(x["key"] != "", F.length(x["value"]) >= 4).otherwise((F.length(x["value"]) >= 6) & x["value"].rlike("[0-9]"))))
    seed = lambda v: F.lit(False) if not seed_formats else v.rlike("|".join(f"(?:{f})" for f in seed_formats))
    own = F.transform("_base", lambda x: F.struct(x["start"], x["end"], x["value"], F.lit(True).alias("base"), F.lit(True).alias("seed"), _cues(x).alias("cues")))

    def candidate(x: Column) -> Column:
        start = x["start"] + F.length(x["key"])
        cues = F.when(x["key"] != "", F.array(F.concat(F.lit("k<"), F.lower(x["key"])))).otherwise(_cues(x))
        return F.struct(start.alias("start"), (start + F.length(x["value"])).alias("end"), x["value"], F.lit(False).alias("base"), seed(x["value"]).alias("seed"), cues.alias("cues"))

    df = df.withColumn("_own", own).withColumn("_other", F.transform("token", candidate))
    short = lambda k: F.transform(k, lambda x: F.struct(x["start"], x["end"]))
    return df.select("doc_id", F.xxhash64("text").alias("text_hash"), *[short(k).alias(k) for k in KINDS], F.concat("_own", "_other").alias("marks"))


def trusted_cues(found: DataFrame, least: float = 0.5, support: int = 3) -> DataFrame:
    """(cue): cues whose distinct values are trusted on average by ``least``, at least ``support`` of them."""
    pairs = found.select(F.explode("marks").alias("m")).select("m.value", "m.seed", F.explode("m.cues").alias("cue"))
    edges = materialize(pairs.groupBy("cue", "value").agg(F.max("seed").alias("seed")), "cues")
    # a cue of a single value, or of too few, can never be trusted
    wide = materialize(edges.groupBy("cue").agg(F.count("*").alias("n")).filter(F.col("n") >= support).drop("n"), "wide")
    edges = materialize(edges.join(wide, "cue"), "graph")
    trust, before = edges.withColumn("trust", F.col("seed").cast("double")), None
    while True:
        # confidences are whole thousandths and doubts whole millionths, so that sums do not depend on order
        cues = trust.groupBy("cue").agg((F.sum(F.round(F.col("trust") * 1e6).cast("long")) / F.count("*") / 1e3).cast("int").alias("conf"), F.sum(F.when(F.col("trust") >= least, 1).otherwise(0)).alias("n"))
        cues = materialize(cues.filter((F.col("conf") >= least * 1000) & (F.col("n") >= support)).select("cue", "conf"), "trusted")
        mark = cues.agg(F.count("*"), F.sum("conf")).first()
        if mark == before or not mark[0]:
            return cues.select("cue")
        before = mark
        doubt = F.sum(F.round(F.log(F.greatest(1 - F.col("conf") / 1000, F.lit(1e-6))) * 1e6).cast("long"))
        value = materialize(edges.filter("not seed").join(cues, "cue").groupBy("value").agg((1 - F.exp(doubt / 1e6)).alias("by_cues")), "values")
        trust = materialize(edges.join(value, "value", "left").select("cue", "value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("by_cues", F.lit(0.0))).alias("trust")), "trust")


def find_pii(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, text_hash, base (array of kind, start, end) and spans (base and discovered ones)."""
    found = materialize(mentions(docs), "mentions")
    cues = trusted_cues(found, **options)
    free = found.select("doc_id", "text_hash", F.explode("marks").alias("m")).filter(~F.col("m.base"))
    free = free.select("doc_id", "text_hash", "m.start", "m.end", "m.seed", F.explode_outer("m.cues").alias("cue"))
    hits = free.filter("not seed").join(cues, "cue").unionByName(free.filter("seed"), allowMissingColumns=True)
    ids = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("ids"))
    kind_of = lambda kind, column: F.transform(column, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end")))
    base = F.concat(*[kind_of(k, k) for k in KINDS])
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "ids")
    joined = found.join(ids, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    more = F.coalesce(kind_of("id", F.col("ids")), F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))
    return joined.select("doc_id", "text_hash", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"), F.concat(base, more).alias("spans"))


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def mask(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with every span of ``found`` replaced by its kind in brackets; other columns stay."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    marks = found.filter(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash2"), "spans").dropDuplicates(["_id", "_hash2"])
    both = keyed.join(marks, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_hash2")), "left")
    both = both.withColumn("_s", F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"]))))
    both = both.withColumn("_b", F.when(F.col("_s").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))))
    touching = lambda spans, a, b: F.filter(spans, lambda x: (x["end"] > a) & (x["start"] < b))

    def piece(b: Column, at: Column, s: Column) -> Column:
        """A piece of text that starts at ``at``, with the spans ``s`` that touch it masked."""
        reach = lambda i: F.greatest(at, F.coalesce(F.array_max(F.transform(F.slice(s, F.lit(1), i), lambda y: y["end"])), at))
        cut = lambda a, z: F.substring(b, (a - at + 1).cast("int"), F.greatest(z - a, F.lit(0)).cast("int"))
        tag = lambda x, i: F.when((x["start"] >= at) & (x["start"] >= reach(i)), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise("")
        return F.concat(F.array_join(F.transform(s, lambda x, i: F.concat(cut(reach(i), x["start"]), tag(x, i))), ""), cut(reach(F.size(s)), at + F.length(b)))

    def stretch(k: Column) -> Column:
        wide = _PIECE * _PIECES
        own = lambda spans: F.array_join(
            F.transform(F.slice("_b", k * _PIECES + 1, F.lit(_PIECES)), lambda b, j: F.element_at(F.transform(F.array(touching(spans, k * wide + j * _PIECE, k * wide + (j + 1) * _PIECE)), lambda s: piece(b, k * wide + j * _PIECE, s)), 1)), ""
        )
        return F.element_at(F.transform(F.array(touching(F.col("_s"), k * wide, (k + 1) * wide)), own), 1)

    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("_b") - 1) / _PIECES).cast("int")), stretch), "")
    text = F.when(F.col("_s").isNull() | (F.size("_b") == 0), F.col("text")).otherwise(whole)
    return both.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
