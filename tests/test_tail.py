"""Appended lines: each whole line once, whatever the parts, and across runs of one stream."""

import io
import random

import pytest

from tallyloom.sources import tail


@pytest.mark.parametrize("part, read, most", [(7, 3, 50), (1, 1, 50), (64, 1000, 5), (13, 5, 4)])
def test_parts_cover_every_line_once(monkeypatch, part, read, most):
    monkeypatch.setattr(tail, "PART_BYTES", part)
    monkeypatch.setattr(tail, "READ_BYTES", read)
    monkeypatch.setattr(tail, "MAX_LINE_BYTES", most)
    r = random.Random(part)
    for _ in range(60):
        lines = ["x" * r.choice([0, 1, 2, 3, 9, 30]) for _ in range(r.randint(0, 12))]
        data = "".join(f"{x}\n" for x in lines).encode()
        whole = data + b"unfinished" * r.randint(0, 1)
        stop = tail.last_line_end(io.BytesIO(whole), len(whole))
        assert stop == len(data)
        middle = r.choice([0, *(k + 1 for k, b in enumerate(data) if b == 10)])  # offsets lie at line ends
        reader = tail.TailReader("/")
        got = [x for a, b in (({}, {"f": middle}), ({"f": middle}, {"f": stop})) for p in reader.partitions(a, b) for x in tail.lines_of(io.BytesIO(whole), p)]
        at, want = 0, []
        for x in lines:
            if len(x) <= most:
                want.append((at, x.encode()))
            at += len(x) + 1
        assert got == want


def test_replaced_and_deleted_files():
    reader = tail.TailReader("/")
    parts = reader.partitions({"grown": 10, "shorter": 50, "gone": 5, "same": 7}, {"grown": 30, "shorter": 20, "same": 7, "new": 4})
    assert [(p.path, p.begin, p.stop) for p in parts] == [("grown", 10, 30), ("new", 0, 4), ("shorter", 0, 20)]


def test_growing_files_across_runs(spark, tmp_path, rows):
    """New files, appended lines and an unfinished line, in three runs on one checkpoint; a run without news adds nothing."""
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    root.mkdir()

    def run():
        query = tail.appended_lines(spark, str(root)).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination()
        return rows(spark.read.schema(tail.SCHEMA).parquet(out), "file_path", "line_no", "value")

    a, b = str(root / "a.log"), str(root / "sub" / "b.log")
    (root / "a.log").write_text("one\ntwo\nthr")
    assert run() == [(a, 0, "one"), (a, 4, "two")]
    with open(a, "a") as file:
        file.write("ee\nfo")
    (root / "sub").mkdir()
    (root / "sub" / "b.log").write_text("é\n\nlast\n")
    want = [(a, 0, "one"), (a, 4, "two"), (a, 8, "three"), (b, 0, "é"), (b, 3, ""), (b, 4, "last")]
    assert run() == want
    assert run() == want
    with open(a, "a") as file:
        file.write("ur\n")
    assert run() == sorted([*want, (a, 14, "four")], key=repr)
