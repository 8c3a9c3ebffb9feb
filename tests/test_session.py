import pytest

from logloom import session


class _Conf:
    def __init__(self, root):
        self.root = root

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.root or default


class _Session:
    """Stands in for a session with a given master and checkpoint folder."""

    def __init__(self, master, root):
        self.conf = _Conf(root)
        self.sparkContext = type("Context", (), {"master": master})()


def test_scratch_follows_the_session_setting():
    shared = _Session("spark://head:7077", "hdfs://nn/shared/")
    one, two = session.scratch_path(shared, "x"), session.scratch_path(shared, "x")
    assert one.startswith("hdfs://nn/shared/logloom/x-") and one != two


def test_scratch_is_local_only_in_local_mode():
    assert session.scratch_path(_Session("local[2]", None), "x")
    with pytest.raises(RuntimeError):
        session.scratch_path(_Session("spark://head:7077", None), "x")
