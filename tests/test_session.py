"""The shared working folder."""

from types import SimpleNamespace

import pytest

from revtide.session import shared_dir


def _session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=lambda path: None)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_session(master))
    assert shared_dir(_session(master, "hdfs:///shared")) == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[8]"])
def test_local_runs_may_use_a_temporary_folder(master):
    assert "revtide-" in shared_dir(_session(master))
