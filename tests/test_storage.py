"""Intermediate tables in the shared folder."""

import os
from types import SimpleNamespace

import pytest

from strandloom import storage


def test_materialize_and_release(spark):
    df = spark.range(5)
    out = storage.materialize(df, "t")
    assert sorted(r.id for r in out.collect()) == list(range(5))
    other = storage.materialize(df, "t")
    assert out.inputFiles()[0] != other.inputFiles()[0]
    folder = storage._folder(spark).removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(folder)
    storage.release(spark)
    assert not os.path.isdir(folder)


class Session:
    """A session that names no shared folder, with a master of its own."""

    def __init__(self, master, app="app-1"):
        self.conf = SimpleNamespace(get=lambda key, default: default)
        self.sparkContext = SimpleNamespace(master=master, applicationId=app)


def test_local_session_has_a_folder_of_its_own():
    first = storage.shared_dir(Session("local[2]"))
    assert os.path.isdir(first) and storage.shared_dir(Session("local[2]")) == first != storage.shared_dir(Session("local[2]", "app-2"))


def test_cluster_has_to_name_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session("spark://host:7077"))


def test_scratch_deletes_what_is_written_inside(spark):
    with storage.scratch(spark):
        with storage.scratch(spark):
            gone, kept = storage.materialize(spark.range(3), "a").inputFiles()[0], storage.materialize(spark.range(4), "b", outlives=True)
        assert kept.count() == 4 and not os.path.exists(gone.removeprefix("file://"))
        path = kept.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert storage.materialize(spark.range(2), "c", outlives=True).count() == 2
