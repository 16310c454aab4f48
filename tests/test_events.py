"""Event files as a source: cuts anywhere, restarts in mid-file."""

from __future__ import annotations

import random

import pytest

from inkfold.sources import events


def body(n: int, seed: int = 1) -> tuple[bytes, list[tuple]]:
    """The bytes of n events, and (data, event) of those that count."""
    rng, out, told = random.Random(seed), b"", []
    for i in range(n):
        end = rng.choice([b"\n", b"\r\n"])
        data = [f"{i}é{'x' * rng.randint(0, 30)}" for _ in range(rng.randint(1, 3))]
        kind = rng.choice([None, "delta"])
        lines = [b": note"] * rng.randint(0, 1) + ([f"event: {kind}".encode()] if kind else []) + [f"data:{rng.choice(['', ' '])}{d}".encode() for d in data]
        if i % 7 == 3:
            lines, data = [rng.choice([b"data: [DONE]", b": only a note", b"data:", b"id: 3"])], []
        out += end.join(lines) + end + end
        if data:
            told.append(("\n".join(data), kind))
    return out, told


@pytest.mark.parametrize("split", [1, 2, 3, 5, 17, 64, 1 << 20])
def test_pieces_of_any_size_give_each_event_once(tmp_path, split):
    raw, told = body(60)
    file = tmp_path / "a.sse"
    file.write_bytes(raw)
    for start in (0, raw.index(b"\n\n") + 2 if b"\n\n" in raw else 0):
        rows = [r for p in events._pieces({str(file): (start, len(raw))}, split) for r in events._read(str(tmp_path), p)]
        assert [(r[2], r[3]) for r in rows][-40:] == told[-40:] and len({r[1] for r in rows}) == len(rows)
    assert [(r[2], r[3]) for p in events._pieces({str(file): (0, len(raw))}, split) for r in events._read(str(tmp_path), p)] == told


def test_only_complete_events_count(tmp_path, monkeypatch):
    monkeypatch.setattr(events, "CHUNK", 4)
    raw, _ = body(12, 2)
    for cut in range(len(raw) + 1):
        (tmp_path / "a.sse").write_bytes(raw[:cut])
        system, _ = events._at(str(tmp_path))
        with system.open_input_file(str(tmp_path / "a.sse")) as source:
            last = [m.end() for m in events.END.finditer(raw[:cut])]
            assert events._complete(source, 0, cut) == (last[-1] if last else 0)


def test_a_stream_goes_on_in_mid_file_after_a_restart(spark, tmp_path):
    spark.dataSource.register(events.EventFiles)
    raw, told = body(50, 3)
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    (folder / "_hidden").write_bytes(raw)

    def run() -> list[tuple]:
        stream = spark.readStream.format("event_files").option("path", str(folder)).option("splitBytes", 100).load()
        stream.writeStream.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(out), format="parquet").awaitTermination()
        return [(r["data"], r["event"]) for r in spark.read.schema(events.SCHEMA).parquet(str(out)).orderBy("file", "position").collect()]

    for cut in (len(raw) // 3, len(raw) // 3 + 1, len(raw) // 2):  # in the middle of events
        (folder / "a.sse").write_bytes(raw[:cut])
        got = run()
        assert got == told[: len(got)] and len(got) >= len(told) * cut // len(raw) - 4
    (folder / "a.sse").write_bytes(raw)
    (folder / "b.sse").write_bytes(b"data: other\n\ndata: open")
    assert run() == told + [("other", None)]
    table = spark.read.format("event_files").option("path", str(folder)).load()
    assert table.count() == len(told) + 2
