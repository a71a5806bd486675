"""The folder that scratch tables go to."""

import pytest

from waveloom.functions.session import shared_dir


class Session:
    """As much of a session as the function reads."""

    def __init__(self, master, **conf):
        self.settings = conf
        self.conf = self
        self.sparkContext = self
        self.master = master

    def get(self, key, default=None):
        return self.settings.get(key.replace(".", "_"), default)


def test_shared_folder():
    house = {"spark_sql_warehouse_dir": "file:/home/x/spark-warehouse/"}
    assert shared_dir(Session("local[8]", **house)) == "file:/home/x/spark-warehouse/_scratch"
    assert shared_dir(Session("yarn", spark_sql_warehouse_dir="hdfs://n/w")) == "hdfs://n/w/_scratch"
    assert shared_dir(Session("yarn", spark_checkpoint_dir="file:///nfs/ck", **house)) == "file:///nfs/ck"
    with pytest.raises(ValueError, match="share"):
        shared_dir(Session("spark://m:7077", **house))
