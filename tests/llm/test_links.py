"""Links of embeddings where neighbour lists alone would lose them."""

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import embeddings
from pointloom.llm.embeddings import near_duplicate_vectors


def near(rng, base, n, noise):
    x = base + noise * rng.normal(size=(n, len(base)))
    return x / np.linalg.norm(x, axis=1)[:, None]


def two_groups(n=12, dim=64):
    """Two tight groups whose lists fill from their own group; every vector of one links with all of the other."""
    rng = np.random.default_rng(3)
    a, b = np.zeros(dim), np.zeros(dim)
    a[0], b[0], b[1] = 1, 0.961, np.sqrt(1 - 0.961**2)
    x = np.concatenate([near(rng, a, n, 0.002), near(rng, b, n, 0.002), rng.normal(size=(60, dim))])
    return x / np.linalg.norm(x, axis=1)[:, None]


def check(spark, x, **options):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in near_duplicate_vectors(rows, **options).collect()}
    linked = x @ x.T >= 0.95
    label = np.arange(len(x))
    while (new := np.array([label[row].min() for row in linked])).tolist() != label.tolist():
        label = new
    for i in range(len(x)):
        assert tuple(got[i])[1:] == (linked[i].sum() - 1, label[i], label[i] == i)


def test_links_between_saturated_groups(spark):
    x = two_groups()
    cos = x @ x.T
    assert cos[:12, :12].min() > cos[:12, 12:24].max() and cos[:12, 12:24].min() >= 0.95
    check(spark, x)


def test_exact_when_the_search_finds_nothing(spark, monkeypatch):
    rng = np.random.default_rng(4)
    group = near(rng, np.eye(32)[0], 30, 0.005)
    pairs = np.concatenate([near(rng, rng.normal(size=32) * 5, 2, 0.05) for _ in range(40)])
    x = np.concatenate([group, pairs])
    found = embeddings.neighbour_lists

    def lossy(vectors, *args):
        """All lists but those of the pairs: over links, the recall is near one."""
        return found(vectors, *args).join(rows, "u").join(rows.withColumnRenamed("u", "v"), "v").select("u", "v", "cos")

    rows = spark.createDataFrame([(v.tolist(),) for v in group], "vec array<double>").select(F.xxhash64(F.transform("vec", lambda e: e + 0)).alias("u"))
    monkeypatch.setattr(embeddings, "neighbour_lists", lossy)
    monkeypatch.setattr(embeddings, "MOST_TABLES", 16, raising=False)
    check(spark, x)
