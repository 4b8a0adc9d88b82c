import os
import time

from pagequire.streaming.changes import Polls, changed_files


def put(path, text, age=10.0):
    path.write_text(text)
    at = time.time() - age
    os.utime(path, (at, at))


def run(spark, folder, checkpoint, out):
    """What one run over the folder tells: names and lengths."""
    seen = []

    def take(batch, number):
        seen.extend((os.path.basename(r.path), r.length) for r in batch.collect())

    query = changed_files(spark, str(folder), pattern=r".*\.png").writeStream.foreachBatch(take).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return sorted(seen)


def test_changes_are_told_once_over_restarts(spark, tmp_path):
    folder, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    (folder / "deep").mkdir(parents=True)
    put(folder / "a.png", "1")
    put(folder / "deep" / "b.PNG", "22")
    put(folder / "c.txt", "1")
    put(folder / "empty.png", "")
    put(folder / "young.png", "333", age=-60)
    assert run(spark, folder, checkpoint, None) == [("a.png", 1), ("b.PNG", 2)]
    assert run(spark, folder, checkpoint, None) == []
    put(folder / "a.png", "4444", age=5)  # overwritten
    put(folder / "young.png", "333")
    assert run(spark, folder, checkpoint, None) == [("a.png", 4), ("young.png", 3)]
    os.remove(folder / "a.png")
    put(folder / "d.png", "1")
    assert run(spark, folder, checkpoint, None) == [("d.png", 1)]


def test_offsets_are_digests_of_quiet_files(tmp_path):
    polls = Polls({"path": str(tmp_path / "none"), "quiet": "0.65"})
    empty = polls.latestOffset()
    polls.folder = str(tmp_path)
    assert polls.latestOffset() == empty
    put(tmp_path / "a", "1")
    first = polls.latestOffset()
    put(tmp_path / "b", "1", age=-60)
    assert first != empty and polls.latestOffset() == first
    put(tmp_path / "a", "1", age=3)
    assert polls.latestOffset() != first
    assert [f for p in polls.partitions({}, first) for f in polls.read(p)] == polls.listing()
