"""The shared folder for intermediate tables."""

from types import SimpleNamespace

import pytest

from webgleaner.session import shared_folder, work_folder


def session(master, folder=None, application="app-1"):
    """A session with only what the folder depends on."""
    conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=application))


def test_named_folder_is_used():
    assert shared_folder(session("spark://host:7077", "hdfs://store/work/")) == "hdfs://store/work"


def test_local_session_without_a_folder_gets_one_and_keeps_it():
    first = shared_folder(session("local[8]"))
    assert shared_folder(session("local[8]")) == first
    assert shared_folder(session("local", application="app-2")) != first
    assert work_folder(session("local[*]"), "x").startswith(f"{first}/webgleaner/x-")


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "yarn", "spark://host:7077"])
def test_cluster_without_a_folder_is_an_error(master):
    with pytest.raises(RuntimeError):
        shared_folder(session(master))
