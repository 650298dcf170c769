import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from playerlytics.operators import profile, segment


def _blobs(spark, per=30):
    rows = []
    for c, base in enumerate([(0, 0, 0, 0, 0), (10, 10, 0, 3, 1), (20, 0, 5, 1, 0)]):
        for i in range(per):
            j = i % 3
            rows.append((f"u{c}_{i}", "G", base[0] + j, base[1] + j, base[2], base[3], base[4], "morning"))
    return spark.createDataFrame(rows, "userId string, gameId string, numLevelsCompleted long, numAdsWatched long, "
                                       "numPurchasesDone long, partOfDayNumber int, flagOrganic int, partOfDay string")


def test_labels_and_nearest_centre(spark, tmp_path):
    df = _blobs(spark)
    model = segment.fit_segmentation(df, 3)
    lab = segment.label(model, df)
    rows = lab.select(vector_to_array("scaledFeatures").alias("x"), "cluster").collect()
    centres = [list(c) for c in segment.kmeans_stage(model).clusterCenters()]
    assert {r.cluster for r in rows} == {0, 1, 2}
    for r in rows:
        d = [sum((a - b) ** 2 for a, b in zip(r.x, c)) for c in centres]
        assert d[r.cluster] == pytest.approx(min(d))
    path = str(tmp_path / "model")
    from playerlytics.sources.sinks import load_model, save_model
    save_model(model, path)
    again = segment.label(load_model(path), df).select("userId", "cluster")
    assert sorted(again.collect()) == sorted(lab.select("userId", "cluster").collect())
    assert segment.cluster_centers(model).count() == 3


def test_elbow_cost_falls(spark):
    costs = [r.costTraining for r in segment.elbow(_blobs(spark), 2, 4).orderBy("kCluster").collect()]
    assert costs[0] > costs[1] >= 0 and len(costs) == 3


def test_null_feature_is_an_error(spark):
    df = _blobs(spark).withColumn("flagOrganic", F.lit(None).cast("int"))
    with pytest.raises(Exception):
        segment.fit_segmentation(df, 2)


def test_assign_fixed_ties_lowest_id(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0)], "numLevelsCompleted long, numAdsWatched long, "
                                                  "numPurchasesDone long, partOfDayNumber int, flagOrganic int")
    r = segment.assign_to_centroids(df, [(2, 0, 0, 0, 0), (0, 0, 0, 0, 0)]).first()
    assert r.cluster == 0                       # equidistant: lowest id
    r = segment.assign_to_centroids(df, [(5, 0, 0, 0, 0), (0, 0, 0, 0, 0)]).first()
    assert r.cluster == 1


def test_profiles_and_sample(spark):
    lab = segment.assign_to_centroids(_blobs(spark), [(0, 0, 0, 0, 0), (10, 10, 0, 3, 1), (20, 0, 5, 1, 0)])
    lab = lab.withColumn("date", F.lit("2024-01-01").cast("date"))
    users = {r.cluster: r.numberOfUsers for r in profile.users_per_cluster(lab).collect()}
    assert users == {0: 30, 1: 30, 2: 30}
    assert profile.cluster_sample(lab, 5).count() == 15
    organic = {(r.cluster, r.organic) for r in profile.organic_users(lab).collect()}
    assert (1, "organic") in organic and (0, "not organic") in organic
    s = profile.feature_summary(lab).where("cluster = 1").first()
    assert s.numLevelsCompleted_min == 10 and s.numLevelsCompleted_max == 12 and s.flagOrganic_mean == 1.0


def test_unknown_organic_flag_fails(spark):
    lab = spark.createDataFrame([("u", "G", 0, 7)], "userId string, gameId string, cluster int, flagOrganic int")
    with pytest.raises(Exception):
        profile.organic_users(lab).collect()


def test_pca(spark):
    df = _blobs(spark)
    lab = segment.label(segment.fit_segmentation(df, 3), df)
    pts = segment.pca_points(lab).collect()
    assert len(pts) == 90 and all(len(p.points) == 2 for p in pts)
