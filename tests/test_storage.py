import os
import shutil

import pytest

from lectern import storage


def test_once_and_release(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert storage.once(spark, "/data/", "numbers", build).count() == storage.once(spark, "/data", "numbers", build).count() == 3
    assert built == [1]
    path = storage.scratch(spark, "out")
    spark.range(2).write.parquet(path)
    assert storage.release(spark) >= 2 and not os.path.exists(path.removeprefix("file://"))
    storage.once(spark, "/data", "numbers", build)
    assert built == [1, 1]
    shutil.rmtree(storage.shared_folder(spark).removeprefix("file://") + f"/lectern-{spark.sparkContext.applicationId}")  # someone cleans up
    assert storage.once(spark, "/data", "numbers", build).count() == 3 and built == [1, 1, 1]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        storage.shared_folder(Session())
