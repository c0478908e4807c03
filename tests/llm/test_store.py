"""The folder for intermediate tables."""

from types import SimpleNamespace

import pytest

from permuta.llm._store import shared_dir


def _session(master, **conf):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get("dir", d), set=lambda k, v: conf.update(dir=v)), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_session("spark://host:7077"))
    assert shared_dir(_session("spark://host:7077", dir="hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(_session("local[2]")).startswith("file://")
