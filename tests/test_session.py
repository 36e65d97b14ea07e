"""Where intermediate data may lie."""

from types import SimpleNamespace

import pytest

from cairn import session


def fake(master, shared=None):
    conf = SimpleNamespace(get=lambda *_: shared)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=conf)


def test_a_cluster_names_its_shared_folder():
    with pytest.raises(ValueError):
        session.shared_folder(fake("spark://host:7077"), "x")
    assert session.shared_folder(fake("spark://host:7077", "/shared/"), "x").startswith("/shared/x-")
    assert "cairn-files-" in session.shared_folder(fake("local[2]"), "x")
