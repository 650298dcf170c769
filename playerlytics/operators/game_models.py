"""Segmentation models of all games at once (M2-M6, M9): scaling, k-means, elbow and projection per game.

``gameId`` is a group key throughout, so the number of jobs depends on neither games nor rows. A game
is its distinct feature vectors with their weights (the features are small counters). k-means is
deterministic: it starts from the heaviest vector and goes on with the one farthest from those
chosen (ties: the smallest vector); then come Lloyd's iterations, each one aggregation over
(game, k, cluster) for all games and all k together, until each (game, k) has converged. Centres are kept in units
of the features: their sums are of whole numbers, so results do not depend on the order of rows.
Distances are those of the features scaled to unit standard deviation, without centring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bounded import SMALL_ROWS, bounded_rows, small_or_stored
from .segment import CLUSTER_COL, DEFAULT_ELBOW_K, DEFAULT_MAX_ITER, FEATURE_COL, FEATURES, SCALED_COL

GAME_COL = "gameId"
#: Iterations end when no centre of a game moves further than this (in scaled units).
TOLERANCE = 1e-4
#: Distinct vectors of a game that one task goes over in an iteration.
PART_ROWS = 50_000
_D = len(FEATURES)


def _vector() -> Column:
    """The features as an array of doubles; a null one is an error, as in the assembler of a single game."""
    def checked(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"null feature {c}"))).otherwise(F.col(c)).cast("double")
    return F.array(*[checked(c) for c in FEATURES])


def distance(x: str, centre: str, factors: str = "factors") -> str:
    """SQL of the squared distance of scaled vectors; the terms are added in the order of the features."""
    steps = [f"(get({x}, {i}) - get({centre}, {i})) * get({factors}, {i})" for i in range(_D)]
    return "(" + " + ".join(f"({s}) * ({s})" for s in steps) + ")"


def weighted_vectors(features: DataFrame) -> DataFrame:
    """gameId, x, w: the distinct feature vectors of every named game with their numbers of rows."""
    rows = features.where(F.col(GAME_COL).isNotNull()).select(GAME_COL, _vector().alias("x"))
    return rows.groupBy(GAME_COL, "x").agg(F.count("*").cast("double").alias("w"))


def moments(vectors: DataFrame) -> DataFrame:
    """gameId, n, s (sums of the features), p (sums of their products i <= j, row by row), vectors (distinct ones)."""
    sums = [F.sum(F.col("w") * F.get("x", F.lit(i))) for i in range(_D)]
    products = [F.sum(F.col("w") * F.get("x", F.lit(i)) * F.get("x", F.lit(j))) for i in range(_D) for j in range(i, _D)]
    return vectors.groupBy(GAME_COL).agg(F.sum("w").alias("n"), F.array(*sums).alias("s"), F.array(*products).alias("p"),
                                         F.count("*").alias("vectors"))


def _product(i: int, j: int) -> Column:
    i, j = min(i, j), max(i, j)
    return F.get("p", F.lit(i * _D - i * (i - 1) // 2 + j - i))


def covariance(i: int, j: int) -> Column:
    """Sample covariance of two features, of ``moments``; null for a single row."""
    s = [F.get("s", F.lit(k)) for k in (i, j)]
    return F.when(F.col("n") > 1, (_product(i, j) - s[0] * s[1] / F.col("n")) / (F.col("n") - 1))


def scale_factors() -> Column:
    """One over the standard deviation of each feature, of ``moments``; 0 for a constant feature."""
    return F.array(*[F.coalesce(F.when(covariance(i, i) > 0, 1 / F.sqrt(covariance(i, i))), F.lit(0.0)) for i in range(_D)])


def _beside(vectors: DataFrame, state: DataFrame) -> DataFrame:
    """Vectors with their game's row of ``state`` (which has the column ``parts``)."""
    return vectors.join(state.withColumn("part", F.expr("explode(sequence(0, parts - 1))")), [GAME_COL, "part"])


def farthest_first(vectors: DataFrame, games: DataFrame, k: int, small: bool) -> DataFrame:
    """gameId, parts, factors, chosen: up to ``k`` distinct vectors of each game, each farthest from those before it."""
    first = vectors.groupBy(GAME_COL).agg(F.expr("min(struct(-w AS o, x)).x").alias("x"))
    state = small_or_stored(games.join(first, GAME_COL).select(GAME_COL, "parts", "factors", F.array("x").alias("chosen")), "starts", small)
    far = F.expr(f"min(struct(-array_min(transform(chosen, c -> {distance('x', 'c')})) AS o, x))").alias("far")
    grown = F.expr("IF(far.o < 0, concat(chosen, array(far.x)), chosen)").alias("chosen")
    for _ in range(1, k):
        found = _beside(vectors, state).groupBy(GAME_COL, "parts", "factors", "chosen").agg(far)
        state = small_or_stored(found.select(GAME_COL, "parts", "factors", grown), "starts", small)
    return state


#: The nearest centre of a vector under each model of its game: k, d (squared distance), cluster.
_NEAREST = (
    "explode(transform(models, m -> struct(m.k AS k, array_min(transform(m.centres, (c, i) -> struct("
    + distance("x", "c") + " AS d, i AS cluster))) AS b))) AS m")


def assigned(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """A row per vector and k of its game's models: gameId, k, cluster, d (squared distance), x, w."""
    by_game = models.groupBy(GAME_COL, "parts", "factors").agg(F.expr("sort_array(collect_list(struct(k, centres)))").alias("models"))
    return (_beside(vectors, by_game).selectExpr(GAME_COL, "x", "w", _NEAREST)
            .selectExpr(GAME_COL, "m.k", "m.b.cluster", "m.b.d", "x", "w"))


def lloyd_step(vectors: DataFrame, models: DataFrame) -> DataFrame:
    """The models with each centre moved to the mean of its vectors (one without vectors stays), and whether they moved."""
    sums = [F.expr(f"sum(w * get(x, {i})) AS s{i}") for i in range(_D)]
    means = f"map_from_entries(collect_list(struct(cluster, array({', '.join(f's{i} / w' for i in range(_D))})))) AS means"
    moved = (assigned(vectors, models).groupBy(GAME_COL, "k", "cluster").agg(F.expr("sum(w) AS w"), *sums)
             .groupBy(GAME_COL, "k").agg(F.expr(means)))
    new = models.join(moved, [GAME_COL, "k"]).selectExpr(
        GAME_COL, "k", "parts", "factors", "centres", "transform(centres, (c, i) -> coalesce(try_element_at(means, i), c)) AS new")
    shift = f"array_max(zip_with(new, centres, (a, b) -> {distance('a', 'b')}))"
    return new.selectExpr(GAME_COL, "k", "parts", "factors", "new AS centres", f"{shift} <= {TOLERANCE ** 2!r}D AS done")


def fit(features: DataFrame, ks: Sequence[int], max_iter: int = DEFAULT_MAX_ITER) -> tuple[DataFrame, DataFrame]:
    """k-means of every named game for every k: the models and the weighted vectors that they were fitted on.

    Models: gameId, k, parts, factors, centres (in units of the features; fewer than k where a game has fewer
    distinct vectors), done (converged within ``max_iter``). No rows without named games. A null feature is an error.
    The models are held by the driver between iterations while they are few, else they are tables.
    """
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("need k of at least 1")
    vectors = small_or_stored(weighted_vectors(features), "vectors", False)
    games = small_or_stored(moments(vectors), "moments", False)
    size = bounded_rows(games.agg(F.count("*").alias("games"), F.coalesce(F.sum("vectors"), F.lit(0)).alias("vectors")), 1)[0]
    small = size.games * len(ks) <= SMALL_ROWS
    games = games.select(GAME_COL, F.ceil(F.col("vectors") / PART_ROWS).cast("int").alias("parts"), scale_factors().alias("factors"))
    games = small_or_stored(games, "games", small)
    vectors = vectors.join(games.select(GAME_COL, "parts"), GAME_COL).select(
        GAME_COL, "x", "w", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int").alias("part"))
    vectors = small_or_stored(vectors, "game-vectors", size.vectors <= SMALL_ROWS)
    if size.vectors <= SMALL_ROWS:
        vectors = vectors.coalesce(1)  # one task: the iterations need no shuffle
    models = farthest_first(vectors, games, ks[-1], small).select(
        GAME_COL, F.explode(F.array(*map(F.lit, ks))).alias("k"), "parts", "factors", "chosen").selectExpr(
        GAME_COL, "k", "parts", "factors", "slice(chosen, 1, k) AS centres", "false AS done")
    models = small_or_stored(models, "models", small)
    for _ in range(max_iter):
        open_models = models.where("NOT done")
        if open_models.isEmpty():
            break
        models = small_or_stored(lloyd_step(vectors, open_models).unionByName(models.where("done")), "models", small)
    return models, vectors


def centres(models: DataFrame) -> DataFrame:
    """gameId, k, cluster and its centre in scaled units (M5)."""
    scaled = "transform(centres, c -> zip_with(c, factors, (a, f) -> a * f))"
    return models.selectExpr(GAME_COL, "k", f"posexplode({scaled}) AS ({CLUSTER_COL}, center)")


def costs(models: DataFrame, vectors: DataFrame) -> DataFrame:
    """gameId, kCluster, costTraining: the sum of squared distances to the nearest centres (M6)."""
    return (assigned(vectors, models).groupBy(GAME_COL, F.col("k").alias("kCluster"))
            .agg(F.expr("sum(w * d)").alias("costTraining")))


def elbow(features: DataFrame, k_from: int = DEFAULT_ELBOW_K[0], k_to: int = DEFAULT_ELBOW_K[1],
          max_iter: int = DEFAULT_MAX_ITER) -> DataFrame:
    """Training cost of every game and k in [k_from, k_to]."""
    if k_from < 2 or k_to < k_from:
        raise ValueError("need 2 <= k_from <= k_to")
    return costs(*fit(features, range(k_from, k_to + 1), max_iter))


def scaled(features: DataFrame, models: DataFrame) -> DataFrame:
    """Rows of named games with featureVector and scaledFeatures as arrays; ``models`` has gameId and factors."""
    rows = features.join(models.select(GAME_COL, "factors"), GAME_COL).withColumn(FEATURE_COL, _vector())
    return (rows.withColumn(SCALED_COL, F.zip_with(FEATURE_COL, "factors", lambda x, f: x * f))
            .select(*features.columns, FEATURE_COL, SCALED_COL))


def scaled_features(features: DataFrame) -> DataFrame:
    """``scaled`` by each game's own standard deviations, without a model (M2)."""
    return scaled(features, moments(weighted_vectors(features)).select(GAME_COL, scale_factors().alias("factors")))


def label(features: DataFrame, models: DataFrame) -> DataFrame:
    """Rows of named games with featureVector, scaledFeatures and cluster (M4); ``models`` holds one k. The nearest
    centre wins, of those that tie the first."""
    known = models.select(F.col(GAME_COL), "factors", "centres")
    near = F.expr(f"array_min(transform(centres, (c, i) -> struct({distance(FEATURE_COL, 'c')} AS d, i AS id)))")
    rows = features.join(known, GAME_COL).withColumn(FEATURE_COL, _vector())
    return (rows.withColumn(SCALED_COL, F.zip_with(FEATURE_COL, "factors", lambda x, f: x * f)).withColumn(CLUSTER_COL, near["id"])
            .select(*features.columns, FEATURE_COL, SCALED_COL, CLUSTER_COL))


# --- projection (M9, M10) ------------------------------------------------------------------

#: Sweeps of Jacobi rotations: convergence is quadratic, five suffice for matrices of this size.
SWEEPS = 10


def _with(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def eigen(matrix: Column, d: int = _D) -> Column:
    """Eigenpairs of a symmetric matrix (array of d x d doubles, row by row), largest value first.

    An array of struct(value, vector), by Jacobi rotations folded over all pairs of rows. The entry of a vector
    that is largest in absolute value (the first, if several tie within 1e-9) is positive.
    """
    pairs = F.lit([[p, q] for _ in range(SWEEPS) for p in range(d) for q in range(p + 1, d)])
    cells = F.sequence(F.lit(0), F.lit(d * d - 1))

    def at(m: Column, i: Column, j: Column) -> Column:
        return F.get(m, i * d + j)

    def turned(m: Column, r: Column, left: bool) -> Column:
        """Columns p and q of m mixed (rows, with ``left``)."""
        def cell(n: Column) -> Column:
            i, j = F.floor(n / d).cast("int"), n % d
            own = i if left else j
            a, b = (at(m, r["p"], j), at(m, r["q"], j)) if left else (at(m, i, r["p"]), at(m, i, r["q"]))
            return (F.when(own == r["p"], r["c"] * a - r["s"] * b).when(own == r["q"], r["s"] * a + r["c"] * b)
                    .otherwise(F.get(m, n)))
        return F.transform(cells, cell)

    def rotation(state: Column, pair: Column) -> Column:
        p, q = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
        off = at(state["a"], p, q)
        half = F.try_divide(at(state["a"], q, q) - at(state["a"], p, p), 2 * off)
        tan = F.when(off == 0, F.lit(0.0)).otherwise(
            F.when(half < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) / (F.abs(half) + F.sqrt(half * half + 1)))
        cos = 1 / F.sqrt(tan * tan + 1)
        return F.struct(p.alias("p"), q.alias("q"), cos.alias("c"), (tan * cos).alias("s"))

    def step(state: Column, pair: Column) -> Column:
        return _with(rotation(state, pair), lambda r: F.struct(
            turned(turned(state["a"], r, False), r, True).alias("a"), turned(state["v"], r, False).alias("v")))

    unit = F.lit([float(i == j) for i in range(d) for j in range(d)])
    done = F.aggregate(pairs, F.struct(matrix.alias("a"), unit.alias("v")), step)

    def signed(v: Column) -> Column:
        top = F.array_max(F.transform(v, F.abs))
        lead = F.get(F.filter(v, lambda x: F.abs(x) >= top - 1e-9), F.lit(0))
        return F.transform(v, lambda x: F.when(lead < 0, -x).otherwise(x))

    def found(state: Column) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.struct(
            at(state["a"], j, j).alias("value"),
            signed(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: at(state["v"], i, j))).alias("vector")))
        return F.reverse(F.array_sort(rows))

    return _with(done, found)


def components(games: DataFrame, k: int = 2) -> DataFrame:
    """gameId, factors, components: the first ``k`` principal vectors of each game's scaled features, of ``moments``."""
    if not 1 <= k <= _D:
        raise ValueError(f"k must be between 1 and {_D}")
    cells = [F.coalesce(covariance(i, j) * F.get("factors", F.lit(i)) * F.get("factors", F.lit(j)), F.lit(0.0))
             for i in range(_D) for j in range(_D)]
    matrix = games.withColumn("factors", scale_factors()).select(GAME_COL, "factors", F.array(*cells).alias("m"))
    pairs = matrix.select(GAME_COL, "factors", eigen(F.col("m")).alias("e"))
    return pairs.select(GAME_COL, "factors", F.transform(F.slice("e", 1, k), lambda e: e["vector"]).alias("components"))


def pca_points(labelled: DataFrame, k: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """Each row's scaled features projected on its game's principal vectors: gameId, points, cluster.

    Also the columns of ``keep``. Takes rows with the features, gameId and cluster, labelled now or read from a stored cluster table.
    The projection is of the uncentred features.
    """
    found = components(moments(weighted_vectors(labelled)), k)
    rows = labelled.join(found, GAME_COL).withColumn("_s", F.zip_with(_vector(), "factors", lambda x, f: x * f))
    point = F.transform("components", lambda v: F.aggregate(F.zip_with(v, F.col("_s"), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x))
    return rows.select(GAME_COL, *keep, point.alias("points"), CLUSTER_COL)


def save_models(models: DataFrame, path: str) -> None:
    """The models as a small table (replaced as a whole)."""
    models.write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("gameId string, k int, parts int, factors array<double>, centres array<array<double>>, done boolean").parquet(path)
