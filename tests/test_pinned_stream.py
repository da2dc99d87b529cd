"""A stream bound to a file: restarts, pages and changed files."""

import json

import pytest

from sparkweir.streaming import pinned


def run(spark, tmp_path, **options):
    query = pinned.stream(spark, str(tmp_path / "in.jsonl"), **options).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    return sorted((r.row, r.record) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_stream_of_a_file_goes_on_and_stops_when_the_file_changes(spark, tmp_path):
    lines = [json.dumps({"id": i, "t": "ä"}, ensure_ascii=False) for i in range(25)]
    (tmp_path / "in.jsonl").write_text("\n".join(lines[:10]) + "\n\n" + "\n".join(lines[10:]), encoding="utf-8")
    assert run(spark, tmp_path, page=4) == list(enumerate(lines))
    # Again, from the checkpoint: nothing new, nothing twice.
    assert run(spark, tmp_path, page=4) == list(enumerate(lines))
    (tmp_path / "in.jsonl").write_text("\n".join(lines + ["{}"]), encoding="utf-8")
    with pytest.raises(Exception, match="has changed since row 25"):
        run(spark, tmp_path, page=4)
    assert sorted(r.row for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(25))


def test_a_file_that_changes_between_planning_and_reading_is_not_read(tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text("a\nb\nc\n")
    reader = pinned._Pages(str(path), 100, 2)
    pages = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [(p.first, p.last) for p in pages] == [(0, 2), (2, 3)] and list(reader.read(pages[1])) == [(2, "c")]
    path.write_text("a\nb\nd\n")
    with pytest.raises(pinned.Changed):
        list(reader.read(pages[1]))


def test_files_over_the_limit_are_refused_and_empty_ones_have_no_rows(tmp_path):
    (tmp_path / "in.jsonl").write_text("\n \n")
    reader = pinned._Pages(str(tmp_path / "in.jsonl"), 2, 10)
    with pytest.raises(ValueError, match="3 bytes"):
        reader.latestOffset()
    reader.most = 100
    assert reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
