"""Player segmentation with MLlib.

Pipeline: ``VectorAssembler`` of five features -> ``StandardScaler`` (unit standard
deviation, no centring) -> ``KMeans`` (k-means||, seed 1, 30 iterations). MLlib runs
each fit as distributed jobs over the partitions of the input; only the k centres
(k x 5 doubles) live on the driver. ``assign_to_centroids`` labels rows against given
centres with plain column expressions, for deterministic labels.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

# The five k-means features in assembly order, the output column names,
# the k-means seed and iteration count, and the default elbow range of k.
FEATURES = ("numLevelsCompleted", "numAdsWatched", "numPurchasesDone", "partOfDayNumber", "flagOrganic")
FEATURE_COL, SCALED_COL, CLUSTER_COL = "featureVector", "scaledFeatures", "cluster"
WEIGHT_COL = "weight"
DEFAULT_SEED, DEFAULT_MAX_ITER = 1, 30
DEFAULT_ELBOW_K = (3, 25)


def assembler(handle_invalid: str = "error") -> VectorAssembler:
    """Null features fail by default (``handle_invalid="skip"`` drops such rows)."""
    return VectorAssembler(inputCols=list(FEATURES), outputCol=FEATURE_COL, handleInvalid=handle_invalid)


def scaler() -> StandardScaler:
    return StandardScaler(inputCol=FEATURE_COL, outputCol=SCALED_COL, withStd=True, withMean=False)


def kmeans(k: int, max_iter: int = DEFAULT_MAX_ITER, seed: int = DEFAULT_SEED) -> KMeans:
    return KMeans(k=k, maxIter=max_iter, seed=seed, featuresCol=SCALED_COL, predictionCol=CLUSTER_COL,
                  weightCol=WEIGHT_COL)


def grouped(features: DataFrame) -> DataFrame:
    """One row per distinct feature vector with its number of rows: the same cost on far fewer rows."""
    return features.groupBy(*FEATURES).agg(F.count("*").cast("double").alias(WEIGHT_COL))


@contextmanager
def _prepared(features: DataFrame):
    """The scaler fitted on all rows, and the distinct vectors scaled and weighted; the input is read once."""
    rows = features.select(*FEATURES).persist(StorageLevel.MEMORY_AND_DISK)
    data = None
    try:
        assemble = assembler()
        scale = scaler().fit(assemble.transform(rows).select(FEATURE_COL))
        data = (scale.transform(assemble.transform(grouped(rows))).select(SCALED_COL, WEIGHT_COL)
                .persist(StorageLevel.MEMORY_AND_DISK))
        data.count()
        rows.unpersist()
        yield assemble, scale, data
    finally:
        rows.unpersist()
        if data is not None:
            data.unpersist()


def fit_segmentation(features: DataFrame, k: int, max_iter: int = DEFAULT_MAX_ITER,
                     seed: int = DEFAULT_SEED) -> PipelineModel:
    """Fit assembler + scaler + k-means (M1-M3); k-means runs on the distinct vectors, weighted."""
    with _prepared(features) as (assemble, scale, data):
        return PipelineModel([assemble, scale, kmeans(k, max_iter, seed).fit(data)])


def label(model: PipelineModel, features: DataFrame) -> DataFrame:
    """All input columns + featureVector, scaledFeatures, cluster (M4)."""
    return model.transform(features)


def kmeans_stage(model: PipelineModel) -> KMeansModel:
    return model.stages[-1]


def cluster_centers(model: PipelineModel) -> DataFrame:
    """k rows: cluster id and its centre in scaled space (M5)."""
    km = kmeans_stage(model)
    spark = SparkSession.active()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(km.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, center array<double>")


def scaled(features: DataFrame) -> DataFrame:
    """Features assembled and scaled once (what every k of the elbow shares)."""
    assembled = assembler().transform(features)
    return scaler().fit(assembled).transform(assembled)


def elbow_fits(features: DataFrame, k_from: int = DEFAULT_ELBOW_K[0], k_to: int = DEFAULT_ELBOW_K[1],
               max_iter: int = DEFAULT_MAX_ITER, seed: int = DEFAULT_SEED, parallelism: int = 4,
               check: bool = False) -> list[tuple]:
    """(k, training cost) for each k; with ``check`` also the cost recomputed from the model's centres.

    The scaler is fitted once on all rows; the fits share the scaled distinct vectors. Fits for
    different k are independent and seeded, so up to ``parallelism`` of them are submitted at a time
    (as ``CrossValidator`` does): their short iteration jobs share the executors.
    """
    if k_from < 2 or k_to < k_from:
        raise ValueError("need 2 <= k_from <= k_to")
    with _prepared(features) as (_, _, data):
        def fit(k: int) -> tuple:
            model = kmeans(k, max_iter, seed).fit(data)
            cost = float(model.summary.trainingCost)
            if not check:
                return k, cost
            nearest = F.array_min(center_distances([list(map(float, c)) for c in model.clusterCenters()]))
            again = (data.select(vector_to_array(F.col(SCALED_COL)).alias(SCALED_COL), WEIGHT_COL)
                     .agg(F.sum(nearest * F.col(WEIGHT_COL))).first()[0])
            return k, cost, again

        ks = list(range(k_from, k_to + 1))
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(ks)))) as pool:
            return list(pool.map(fit, ks))


def elbow(features: DataFrame, k_from: int = DEFAULT_ELBOW_K[0], k_to: int = DEFAULT_ELBOW_K[1],
          max_iter: int = DEFAULT_MAX_ITER, seed: int = DEFAULT_SEED, parallelism: int = 4) -> DataFrame:
    """(kCluster, costTraining) for each k in [k_from, k_to] (M6); see ``elbow_fits``."""
    schema = StructType([StructField("kCluster", IntegerType(), False),
                         StructField("costTraining", DoubleType(), False)])
    costs = elbow_fits(features, k_from, k_to, max_iter, seed, parallelism)
    return features.sparkSession.createDataFrame(costs, schema)


def center_distances(centers: Sequence[Sequence[float]], column: str = SCALED_COL) -> Column:
    """Squared distances of an array column to each centre, in order of the centres."""
    zero = F.lit(0.0)
    return F.array(*[F.aggregate(F.zip_with(F.col(column), F.lit([float(x) for x in c]), lambda a, b: (a - b) * (a - b)),
                                 zero, lambda s, x: s + x) for c in centers])


def label_check(labelled: DataFrame, centers: Sequence[Sequence[float]]) -> DataFrame:
    """Rows, rows whose label is not their nearest centre, and labels out of range, of rows with vectors as arrays."""
    rows = labelled.withColumn("_d", center_distances(centers))
    own = F.get("_d", F.col(CLUSTER_COL))
    return rows.agg(F.count("*").alias("numRows"), F.count_if(own > F.array_min("_d") + F.lit(1e-9)).alias("notNearest"),
                    F.count_if(~F.col(CLUSTER_COL).between(0, len(centers) - 1)).alias("badLabels"))


def pca_points(labelled: DataFrame, k: int = 2) -> DataFrame:
    """2-D projection of the scaled features with the cluster of each row.

    Takes freshly labelled rows or the stored cluster table, where vectors are arrays. The rows are
    read for the fit and again for the projection: pass a stored or persisted table.
    """
    if labelled.schema[SCALED_COL].dataType.typeName() == "array":
        labelled = labelled.withColumn(SCALED_COL, array_to_vector(F.col(SCALED_COL)))
    labelled = labelled.select(SCALED_COL, CLUSTER_COL)
    model = PCA(k=k, inputCol=SCALED_COL, outputCol="pcaFeatures").fit(labelled)
    return (model.transform(labelled)
            .select(vector_to_array(F.col("pcaFeatures")).alias("points"), F.col(CLUSTER_COL)))


def vectors_as_arrays(labelled: DataFrame) -> DataFrame:
    """Replace vector columns by ``array<double>`` (hashable, writable anywhere)."""
    out = labelled
    for c in (FEATURE_COL, SCALED_COL, "pcaFeatures"):
        if c in labelled.columns:
            out = out.withColumn(c, vector_to_array(F.col(c)))
    return out


def assign_to_centroids(features: DataFrame, centroids: Sequence[Sequence[float]],
                        columns: Sequence[str] = FEATURES) -> DataFrame:
    """Label each row with the nearest given centre (squared Euclidean distance over
    ``columns``); the lowest centre id wins ties (M11). Pure column expressions."""
    if not centroids:
        raise ValueError("need at least one centroid")
    dists = []
    for i, c in enumerate(centroids):
        if len(c) != len(columns):
            raise ValueError(f"centroid {i} has {len(c)} values, expected {len(columns)}")
        d = None
        for name, v in zip(columns, c):
            term = F.pow(F.col(name).cast("double") - F.lit(float(v)), 2)
            d = term if d is None else d + term
        dists.append(F.struct(d.alias("d"), F.lit(i).alias("id")))
    best = F.array_min(F.array(*dists)) if len(dists) > 1 else dists[0]
    return features.withColumn(CLUSTER_COL, best.getField("id"))
