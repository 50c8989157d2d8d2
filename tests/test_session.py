import glob

import pytest

from quirelake import session as S


class _Master:
    def __init__(self, master):
        self.master = master

    def getConf(self):
        return {}


class _Cluster:
    def __init__(self, master):
        self.sparkContext = _Master(master)
        self.conf = {}


def test_no_machine_local_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,3000]", "k8s://host"):
        with pytest.raises(RuntimeError):
            S._shared_folder(_Cluster(master))
    assert S._shared_folder(_Cluster("local[4]"))


def test_durable_and_release(spark):
    df = S.durable(spark.range(10))
    path = S._tables[id(df)][1]
    assert df.count() == 10 and glob.glob(f"{path}/*.parquet")
    S.release(df)
    assert not glob.glob(path) and id(df) not in S._tables


def test_spread_keeps_the_rows(spark, sf):
    df = S.table(spark, sf, "chapters", "id")
    assert sorted(r.id for r in S.spread(df, "id").collect()) == sorted(r.id for r in df.collect())
