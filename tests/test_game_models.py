"""Models of all games against a plain numpy version; ties, empty clusters, hot games, edge rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from playerlytics.operators import game_models as G
from playerlytics.operators import segment

COLUMNS = "userId string, gameId string, numLevelsCompleted long, numAdsWatched long, numPurchasesDone long, partOfDayNumber int, flagOrganic int"


def frame(spark, games):
    """{game: [vector, ...]} as feature rows."""
    rows = [(f"u{i}", g, *v) for g, vs in games.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, COLUMNS)


def brute_fit(vectors, k, max_iter=30):
    """(centres in scaled units, cost) of one game, straight from the definition."""
    weights = Counter(map(tuple, vectors))
    x = np.array(sorted(weights), float)
    w = np.array([weights[tuple(v)] for v in sorted(weights)], float)
    n = w.sum()
    var = ((w[:, None] * x * x).sum(0) - (w[:, None] * x).sum(0) ** 2 / n) / max(n - 1, 1)
    f = np.array([1 / np.sqrt(v) if n > 1 and v > 0 else 0.0 for v in var])

    def dist(c):
        return (((x - c) * f) ** 2).sum(1)

    chosen = [x[min(range(len(x)), key=lambda i: (-w[i], tuple(x[i])))]]
    while len(chosen) < k:
        near = np.min([dist(c) for c in chosen], axis=0)
        if near.max() <= 0:
            break
        chosen.append(x[min(range(len(x)), key=lambda i: (-near[i], tuple(x[i])))])
    centres = np.array(chosen)
    for _ in range(max_iter):
        ids = np.argmin([dist(c) for c in centres], axis=0)
        new = np.array([(w[ids == j, None] * x[ids == j]).sum(0) / w[ids == j].sum() if (ids == j).any() else c
                        for j, c in enumerate(centres)])
        moved = (((new - centres) * f) ** 2).sum(1).max()
        centres = new
        if moved <= 1e-8:
            break
    return centres * f, float((w * np.min([dist(c) for c in centres], axis=0)).sum())


def some_games(seed=0):
    rng = np.random.default_rng(seed)
    games = {g: [tuple(int(c) for c in rng.poisson((3, 2, 1, 1, 0.4))) for _ in range(n)] for g, n in (("A", 150), ("B", 40), ("C", 9))}
    return {**games, "one": [(1, 2, 3, 0, 1)] * 5, "row": [(1, 0, 0, 0, 0)], "two": [(0, 0, 0, 0, 0), (2, 0, 0, 0, 0)] * 3}


@pytest.mark.parametrize("way", ["driver", "tables", "parts"])
def test_fit_equals_plain_version(spark, monkeypatch, way):
    """Models on the driver or as tables, a game's vectors in one part or in many."""
    if way == "tables":
        monkeypatch.setattr(G, "SMALL_ROWS", 0)
    if way == "parts":
        monkeypatch.setattr(G, "PART_ROWS", 10)
    games = some_games()
    ks = (2, 3, 5) if way == "driver" else (3,)
    models, vectors = G.fit(frame(spark, games), ks)
    found = {}
    for r in G.centres(models).toLocalIterator():
        found.setdefault((r.gameId, r.k), {})[r.cluster] = r.center
    costs = {(r.gameId, r.kCluster): r.costTraining for r in G.costs(models, vectors).toLocalIterator()}
    for g, vs in games.items():
        for k in ks:
            centres, cost = brute_fit(vs, k)
            got = np.array([found[g, k][i] for i in range(len(centres))])
            assert len(found[g, k]) == len(centres) and np.allclose(got, centres, atol=1e-9), (g, k)
            assert costs[g, k] == pytest.approx(cost, abs=1e-9)


def test_labels_are_nearest_and_repeatable(spark):
    games = some_games(1)
    df = frame(spark, games)
    models, _ = G.fit(df, [3])
    first, again = (sorted(map(tuple, G.label(d, G.fit(d, [3])[0]).select("userId", "gameId", "cluster").toLocalIterator()))
                    for d in (df, df.repartition(7).orderBy(F.rand(3))))
    assert first == again and len(first) == df.count()
    for r in G.label(df, models).join(models.select("gameId", "centres", "factors"), "gameId").toLocalIterator():
        d = [sum(((x - c) * f) ** 2 for x, c, f in zip(r.featureVector, centre, r.factors)) for centre in r.centres]
        assert r.cluster == d.index(min(d))
        assert r.scaledFeatures == pytest.approx([x * f for x, f in zip(r.featureVector, r.factors)])


def test_costs_fall_with_k_and_jobs_do_not_grow_with_games(spark):
    def jobs(games):
        group = f"fit-{len(games)}"
        spark.sparkContext.setJobGroup(group, group)
        costs = {(r.gameId, r.kCluster): r.costTraining for r in G.elbow(frame(spark, games), 2, 6, max_iter=2).toLocalIterator()}
        for g in games:
            assert all(costs[g, k] >= costs[g, k + 1] - 1e-9 for k in range(2, 6))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    rng = np.random.default_rng(5)
    games = {f"g{i}": [tuple(int(c) for c in rng.poisson(2, 5)) for _ in range(60)] for i in range(8)}
    few = jobs({g: games[g] for g in ("g0", "g1")})
    many = jobs(games)
    spark.sparkContext.setJobGroup(None, None)
    assert many <= few + 3


def test_edge_rows(spark):
    assert G.elbow(frame(spark, {"A": [(1, 1, 1, 1, 1)]}).limit(0), 2, 3).count() == 0
    unnamed = frame(spark, {"A": [(1, 0, 0, 0, 0), (0, 2, 0, 0, 0)]}).withColumn("gameId", F.lit(None).cast("string"))
    models, _ = G.fit(unnamed, [2])
    assert models.count() == 0 and G.label(unnamed, models).count() == 0 and G.scaled_features(unnamed).count() == 0
    with pytest.raises(Exception):
        G.fit(frame(spark, {"A": [(1, 0, 0, 0, 0)]}).withColumn("flagOrganic", F.lit(None).cast("int")), [2])
    with pytest.raises(ValueError):
        G.elbow(unnamed, 1, 3)


def test_saved_models_label_alike(spark, tmp_path):
    df = frame(spark, some_games(2))
    models, _ = G.fit(df, [4])
    G.save_models(models, str(tmp_path / "m"))
    one, two = (sorted(map(tuple, G.label(df, m).select("userId", "gameId", "cluster").toLocalIterator()))
                for m in (models, G.load_models(spark, str(tmp_path / "m"))))
    assert one == two


@pytest.mark.parametrize("seed", range(4))
def test_eigen_equals_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(5, 5)) if seed else np.diag([3.0, 3.0, 1.0, 0.0, 0.0])
    a = a + a.T
    pairs = spark.createDataFrame([(a.ravel().tolist(),)], "m array<double>").select(G.eigen(F.col("m")).alias("e")).first().e
    values, vectors = np.array([p.value for p in pairs]), np.array([p.vector for p in pairs]).T
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(5), atol=1e-12)
    assert all(v[np.argmax(np.abs(v).round(8))] > 0 for v in vectors.T)


def test_projection_equals_numpy_and_mllib(spark):
    games = {g: v for g, v in some_games(3).items() if g in "ABC"}
    df = frame(spark, games).withColumn("cluster", F.lit(0))
    for g, vs in games.items():
        x = np.array(vs, float)
        std = x.std(0, ddof=1)
        x = x / np.where(std > 0, std, 1) * (std > 0)
        u = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
        want = x @ u
        rows = {r.userId: r.points for r in G.pca_points(df, keep=("userId",)).where(F.col("gameId") == g).toLocalIterator()}
        got = np.array([rows[f"u{i}"] for i in range(len(vs))])
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-9)
    one = df.where("gameId = 'A'")
    from pyspark.ml.feature import PCA
    scaled = segment.scaled(one)
    mllib = sorted(tuple(abs(round(c, 8)) for c in r.p.toArray()) for r in
                   PCA(k=2, inputCol="scaledFeatures", outputCol="p").fit(scaled).transform(scaled).select("p").toLocalIterator())
    ours = sorted(tuple(abs(round(c, 8)) for c in r.points) for r in G.pca_points(one).toLocalIterator())
    assert np.allclose(mllib, ours, atol=1e-7)
