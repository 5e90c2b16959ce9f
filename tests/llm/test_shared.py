from types import SimpleNamespace

import pytest

from quaystone.llm.shared import scratch_path


def session(master: str, folder: str | None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master))


def test_scratch_folder_is_the_sessions():
    assert scratch_path(session("spark://a:7077", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert scratch_path(session("local[4]", "file:///shared"), "x").startswith("file:///shared/x-")


def test_only_one_process_may_do_without_a_shared_folder():
    assert scratch_path(session("local[*]", None), "x").startswith("file:///")
    for master in ("spark://a:7077", "local-cluster[3,2,1024]", "yarn"):
        with pytest.raises(ValueError):
            scratch_path(session(master, None), "x")
