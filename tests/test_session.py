"""The shared folder, and what is deleted in it."""

from pathlib import Path
from types import SimpleNamespace

import pytest

from codeloom import session


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False))))
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_folder(fake)


def test_release_deletes_what_was_cut(spark):
    session.release()
    df = session.cut(spark.range(3).toDF("x"))
    folder = session.scratch(spark)
    spark.range(2).write.parquet(folder)
    paths = [Path(p.removeprefix("file:")) for _, p in session._written]
    assert df.count() == 3 and len(paths) == 2 and all(p.exists() for p in paths)
    session.release()
    assert not any(p.exists() for p in paths) and not session._written
