"""Shared folder rules, with and without a setting from the cluster."""

from types import SimpleNamespace

import pytest

from matchloom import session


def fake(master, conf=None, app="app-1"):
    conf = conf or {}
    get = SimpleNamespace(get=lambda k, d=None: conf.get(k, d))
    return SimpleNamespace(conf=get, sparkContext=SimpleNamespace(getConf=lambda: get, master=master, applicationId=app))


def test_named_folder_wins():
    assert session.checkpoint_dir(fake("spark://x", {"spark.checkpoint.dir": "s3://b/c"})) == "s3://b/c"


def test_unset_is_an_error_on_a_cluster():
    for master in ("spark://x", "local-cluster[3,2,1000]", "yarn"):
        with pytest.raises(RuntimeError):
            session.checkpoint_dir(fake(master))


def test_unset_local_session_keeps_one_folder():
    assert session.checkpoint_dir(fake("local[8]", app="t1")) == session.checkpoint_dir(fake("local[8]", app="t1"))
