"""Intermediate tables: where they go and when they go."""
import os
from types import SimpleNamespace

import pytest

from tessera import session


def fake(master, conf=None):
    made = []
    sc = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None,
                         getConf=lambda: SimpleNamespace(get=lambda k, d: conf or d), setCheckpointDir=made.append)
    return SimpleNamespace(sparkContext=sc)


def test_a_cluster_needs_a_shared_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.checkpoint_dir(fake(master))
        assert session.checkpoint_dir(fake(master, "/shared")) == "/shared"
    for master in ("local", "local[4]", "local[*]", "local[2,3]"):
        assert os.path.isdir(session.checkpoint_dir(fake(master)))


def test_tables_are_deleted(spark):
    with session.Tables() as t:
        kept = t.keep(spark.range(5), "some")
        folder = kept._tessera_path.removeprefix("file:")
        assert kept.count() == 5 and os.path.isdir(folder)
    assert not os.path.exists(folder)
    session.discard(spark.range(1))  # nothing to delete
