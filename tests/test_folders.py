"""Where steps leave what others read."""

import types

import pytest

from lattica import folders


def session(master, conf=None, context=None):
    made = {"dir": context}
    sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: made["dir"], setCheckpointDir=lambda d: made.update(dir=d))
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d=None: conf or d), sparkContext=sc)


def test_shared_folder():
    assert folders.shared(session("yarn", "hdfs:///c/")) == "hdfs:///c" and folders.shared(session("yarn", None, "hdfs:///d")) == "hdfs:///d"
    own = session("local[4]")
    assert folders.shared(own) == folders.shared(own)
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://x:7077"):
        with pytest.raises(RuntimeError):
            folders.shared(session(master))
