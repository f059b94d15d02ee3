from pyspark.ml.linalg import Vectors

from corpusloom.operators import classifier as ML


def test_rows_of_a_fit_are_dealt_by_their_values(spark):
    vectors = [(i, Vectors.sparse(64, list(range(16)), [1.0 / 16] * 16), 16) for i in range(200)]
    rows = spark.createDataFrame(vectors, ["id", "features", "n_values"]).coalesce(1)
    got = ML.dealt_rows(rows, 400)
    sizes = got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == 8 and sum(sizes) == 200 and max(sizes) <= 2 * 25
    assert got.columns == ["id", "features"]
    assert ML.dealt_rows(rows.limit(0), 400).rdd.getNumPartitions() == 1


def test_values_are_no_fewer_than_those_of_the_vector(spark):
    df = spark.createDataFrame([(0, "One two 3 two"), (1, ""), (2, None), (3, "a b c d e f g h i j k")], "id long, text string")
    for stage in ML._features("text", 8):
        df = stage.transform(df)
    got = df.select("features", ML._most_values(8)).collect()
    assert all(r.features.numNonzeros() <= r.n_values <= 8 for r in got)
