"""The PCA queries take every component of the vectors and learn from the split's train side."""

import os

import numpy as np
import pytest

from ashlar.operators import boundary, reduce
from ashlar.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_components_of_whole_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    train = boundary.stratified_split(df, "vec_id", "label").where("partition = 'train'")
    x = np.array([r["embedding"] for r in train.select("embedding").collect()], float)
    want = np.sort(np.linalg.eigvalsh(np.cov(((x - x.mean(0)) / x.std(0)).T)))[::-1]
    got = catalog.QUERIES["pca_variance"](spark, SF).orderBy("i").collect()
    assert len(got) == x.shape[1] == 64
    assert np.allclose([r["explained_variance"] for r in got], want, atol=1e-5)
    assert catalog.QUERIES["pca_loadings"](spark, SF).count() == 64 * 64


def test_covariance_skips_nulls_pair_by_pair(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, None, 1.0), (4.0, 3.0, 5.0), (3.0, 7.0, 2.0), (8.0, 1.0, 4.0)], "a double, b double, c double")
    c = reduce.fit(df, ["a", "b", "c"])
    got = (c.loadings.T * c.variances) @ c.loadings * np.outer(c.scales, c.scales)
    want = [[df.selectExpr(f"covar_samp({x}, {y})").first()[0] for y in "abc"] for x in "abc"]
    assert np.allclose(got, want)
