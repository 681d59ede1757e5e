"""Snapshots: writers that break off at any step, writers that collide, readers that stay on theirs, and expiry."""

import pytest

from lexmill.operators import stages
from lexmill.sources import files, snapshots


class Broken(Exception):
    pass


def both(spark, folder, number=None):
    """What a reader sees: the version that each table holds."""
    found = snapshots.pinned(spark, folder, number)
    return {name: {r.version for r in found.read(spark, name).collect()} for name in found.tables}


def tables(spark, version):
    return {name: spark.range(3).selectExpr("id", f"{version} AS version") for name in ("postings", "terms", "vectors")}


def test_a_writer_that_breaks_off_at_any_step(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/index"
    assert snapshots.pinned(spark, folder).number == 0 and snapshots.state(spark, folder, ("terms",)).first().ready is False
    snapshots.commit(spark, folder, tables(spark, 1))
    # The data of the first, second or third table, the manifest, and right before it is renamed.
    for step in range(5):
        version, done = 2 + step, []
        with monkeypatch.context() as m:
            if step < 3:
                frames = tables(spark, version)
                frames[list(frames)[step]] = frames[list(frames)[step]].selectExpr("id", "raise_error('broken') AS version")
                with pytest.raises(Exception, match="broken"):
                    snapshots.commit(spark, folder, frames)
            else:
                publish = snapshots._publish

                def breaks(spark, folder, number, text):
                    if step == 4:
                        fs, path = snapshots._fs(spark, folder)
                        fs.create(path(f"{folder}/manifests/.draft"), True).close()
                    done.append(publish)
                    raise Broken

                m.setattr(snapshots, "_publish", breaks)
                with pytest.raises(Broken):
                    snapshots.commit(spark, folder, tables(spark, version))
        assert both(spark, folder) == {name: {1} for name in ("postings", "terms", "vectors")}
    second = snapshots.commit(spark, folder, tables(spark, 9))
    assert second.number == 2 and both(spark, folder) == {name: {9} for name in second.tables}
    # What the broken ones left goes, and nothing that is named.
    assert snapshots.expire(spark, folder, grace_s=3600) == []
    gone = snapshots.expire(spark, folder, grace_s=0)
    assert len(gone) >= 6 and both(spark, folder, 1)["terms"] == {1} and both(spark, folder)["terms"] == {9}


def test_writers_that_collide_and_readers_that_stay(spark, tmp_path):
    folder = f"file://{tmp_path}/index"
    base = snapshots.commit(spark, folder, tables(spark, 1))
    reader = snapshots.pinned(spark, folder)
    snapshots.commit(spark, folder, {"terms": spark.range(3).selectExpr("id", "2 AS version")}, base=base)
    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, folder, {"terms": spark.range(3).selectExpr("id", "3 AS version")}, base=base)
    assert both(spark, folder) == {"postings": {1}, "terms": {2}, "vectors": {1}}
    assert {r.version for r in reader.read(spark, "terms").collect()} == {1}
    for version in range(3, 7):
        snapshots.commit(spark, folder, tables(spark, version))
    snapshots.expire(spark, folder, keep=2, grace_s=0)
    assert both(spark, folder, 5) == {n: {5} for n in reader.tables} and both(spark, folder) == {n: {6} for n in reader.tables}
    with pytest.raises(FileNotFoundError):
        snapshots.pinned(spark, folder, 1)
    assert {(r.name, r.n_rows, r.ready) for r in snapshots.state(spark, folder, ("other",)).collect()} == {("postings", 3, True), ("terms", 3, True), ("vectors", 3, True), ("other", None, False)}


def test_index_and_vectors_in_one_snapshot(spark, tmp_path):
    folder = f"file://{tmp_path}/ix"
    chunks = spark.createDataFrame([("a", "B - Điều 1. x", "lương tối thiểu"), ("b", "B - Điều 2. y", "thuế")], "chunk_id string, breadcrumb string, content string")
    assert files.save_index(chunks, folder) == 2
    embedded = spark.createDataFrame([("a", "s", [1.0, 0.0]), ("b", "s", [0.0, 1.0]), ("c", "s", None)], "chunk_id string, source_document string, vec array<double>")
    stages.checkpoint_embeddings(embedded, f"{tmp_path}/phase")
    assert stages.refresh_snapshot(spark, f"{tmp_path}/phase", folder, 2) == 2
    with pytest.raises(Exception, match="another dimension"):
        stages.refresh_snapshot(spark, f"{tmp_path}/phase", folder, 3)
    found = snapshots.pinned(spark, folder)
    assert set(found.tables) == {"postings", "terms", "stats", "vectors"} and found.notes == {"dimension": 2, "index_version": files.INDEX_VERSION}
    postings, terms, stats = files.load_index(spark, folder)
    assert stats.first().n_docs == 2 and postings.count() > 0 and terms.count() > 0
    snapshots.commit(spark, folder, {}, {"index_version": 1})
    with pytest.raises(ValueError, match="index version"):
        files.load_index(spark, folder)
