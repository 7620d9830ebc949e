"""Commits of message runs: all or nothing, for readers, killed runs and runs at the same time."""

import glob

import pytest

from bookpulse import schemas
from bookpulse.sources import message_store


@pytest.fixture
def messages(spark):
    def build(brokers, text="m", rows=2):
        data = [(b, "n", f"c{i}", "cn", "UPSELL", "high", f"{text} {i}", "template", "x") for b in brokers for i in range(rows)]
        return spark.createDataFrame(data, schemas.MESSAGES)

    return build


def stored(spark, path):
    return sorted(((r.broker_id, r.message) for r in message_store.read(spark, path).collect()), key=str)


def test_brokers_are_replaced_and_others_stay(spark, messages, tmp_path):
    path = str(tmp_path / "m")
    assert stored(spark, path) == []
    message_store.upsert(messages(["B1", "B2", None]), path)
    message_store.upsert(messages(["B2", "B3"], "new", 1), path)
    want = [("B1", "m 0"), ("B1", "m 1"), ("B2", "new 0"), ("B3", "new 0"), (None, "m 0"), (None, "m 1")]
    assert stored(spark, path) == sorted(want, key=str)
    message_store.upsert(messages([]), path)  # an empty run
    assert stored(spark, path) == sorted(want, key=str) and message_store.versions(spark, path) == [1, 2]
    message_store.upsert(messages([None], "none", 1), path)
    assert (None, "none 0") in stored(spark, path) and (None, "m 0") not in stored(spark, path)


def test_folders_do_not_grow_with_brokers(spark, messages, tmp_path):
    path = str(tmp_path / "m")
    for k in range(6):
        message_store.upsert(messages([f"B{i}" for i in range(k * 50, 300)], f"run {k}"), path, buckets=8)
    assert len(stored(spark, path)) == 600
    assert len(message_store.versions(spark, path)) == message_store.KEPT
    assert len(glob.glob(f"{path}/run-*/bucket=*")) <= 8 * message_store.KEPT
    assert len(glob.glob(f"{path}/run-*")) <= message_store.KEPT


def test_a_reader_in_the_middle_sees_one_state(spark, messages, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    message_store.upsert(messages(["B1", "B2"], "old"), path)
    begun = message_store.read(spark, path)
    seen, commit = [], message_store._commit

    def watched(*args):
        seen.append(stored(spark, path))  # files of the run are written, its manifest is not
        commit(*args)
        seen.append(stored(spark, path))

    monkeypatch.setattr(message_store, "_commit", watched)
    message_store.upsert(messages(["B1", "B2"], "new"), path)
    assert {m for _, m in seen[0]} == {"old 0", "old 1"} and {m for _, m in seen[1]} == {"new 0", "new 1"}
    assert {r.message for r in begun.collect()} == {"old 0", "old 1"}  # its files are kept


def test_a_killed_run_changes_nothing(spark, messages, tmp_path, monkeypatch):
    path = str(tmp_path / "m")
    message_store.upsert(messages(["B1"], "old"), path)
    before = stored(spark, path)
    with monkeypatch.context() as m:
        m.setattr(message_store, "_commit", lambda *args: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            message_store.upsert(messages(["B1", "B2"], "new"), path)
    assert stored(spark, path) == before
    message_store.upsert(messages(["B2"], "later"), path)
    assert stored(spark, path) == [*before, ("B2", "later 0"), ("B2", "later 1")]


def test_two_runs_at_the_same_time(spark, messages, tmp_path, monkeypatch):
    """The one that comes second starts again on what the first has stored."""
    path = str(tmp_path / "m")
    message_store.upsert(messages(["B1", "B2"], "old", 1), path, buckets=1)
    commit, others = message_store._commit, [messages(["B1"], "other", 1)]

    def overtaken(*args):
        if others:
            monkeypatch.setattr(message_store, "_commit", commit)
            message_store.upsert(others.pop(), path, buckets=1)
            monkeypatch.setattr(message_store, "_commit", overtaken)
        commit(*args)

    monkeypatch.setattr(message_store, "_commit", overtaken)
    message_store.upsert(messages(["B2"], "own", 1), path, buckets=1)
    assert stored(spark, path) == [("B1", "other 0"), ("B2", "own 0")]
    with pytest.raises(message_store.Taken):
        commit(spark, path, 1, {})
