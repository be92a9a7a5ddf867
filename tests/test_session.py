import pytest

from sojourn import schema, session
from sojourn.operators import distribute, filters


class Bare:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():
            return None


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Bare)
    session.use_local_folder(Bare)
    with pytest.raises(RuntimeError):
        session.new_folder(Bare)


def test_operators_ask_for_the_folder(spark, events, monkeypatch):
    def refuse(_):
        raise RuntimeError("set spark.checkpoint.dir")

    monkeypatch.setattr(session, "shared_dir", refuse)
    rows = events((1, 1.0, 5), (2, 2.0, 6))
    with pytest.raises(RuntimeError):
        distribute.range_lanes(rows, ["time"], 2, 1)
    with pytest.raises(RuntimeError):
        filters.frequency_filter(rows, schema.Thresholds())
