"""The resume log: one run, several runs and repeated batches give the same states."""

import json
import random
from pathlib import Path

import pytest

from stillwater.streaming import resume


def write(folder: Path, name: str, records) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("key", "seq", "status"), r, strict=True))) + "\n" for r in records))


def brute(records):
    out = {}
    for key, seq, status in sorted((r for r in records if None not in r), key=lambda r: r[1]):
        before = out.get(key, (None, None, 0, 0, 0))
        done, was = status == "ok", before[1] == "ok"
        out[key] = (seq, status, before[2] + 1, before[3] + (before[1] is not None and done and not was), before[4] + (before[1] is not None and was and not done))
    return out


def states(spark, out):
    return {r["key"]: tuple(r)[1:6] for r in resume.current(spark, str(out)).collect()}


@pytest.mark.parametrize("files", [None, 1])
def test_restart_goes_on(spark, tmp_path, files):
    rng = random.Random(4)
    records = [(f"v{rng.randrange(9)}", k, rng.choice(["ok", "failed", "skipped"])) for k in range(120)]
    first, second = records[:70], records[70:]
    bad = [(None, 500, "ok"), ("v1", None, "ok"), ("v1", 501, None)]
    out, checkpoint, log = tmp_path / "out", tmp_path / "checkpoint", tmp_path / "log"
    run = lambda: resume.advance(spark, str(log), str(out), str(checkpoint), files)
    shuffled = first + bad
    rng.shuffle(shuffled)
    write(log, "a.json", shuffled)
    run()
    assert states(spark, out) == brute(first)
    batches = sorted(p.name for p in out.iterdir())
    run()  # nothing new: no batch, no change
    assert sorted(p.name for p in out.iterdir()) == batches and states(spark, out) == brute(first)
    write(log, "b.json", second)
    run()
    assert states(spark, out) == brute(records)
    # a record that comes too late changes nothing but the number of attempts
    write(log, "c.json", [("v0", -1, "failed")])
    run()
    row = resume.current(spark, str(out)).where("key = 'v0'").first()
    assert row["stale"] == 1 and row["attempts"] == brute(records)["v0"][2] + 1 and row["status"] == brute(records)["v0"][1]
    expected = spark.createDataFrame([(k,) for k in ("v0", "v1", "never")], "key string")
    todo = {r["key"]: r["status"] for r in resume.pending(expected, resume.current(spark, str(out))).collect()}
    assert todo == {"never": "missing"} | {k: brute(records)[k][1] for k in ("v0", "v1") if brute(records)[k][1] != "ok"}


def test_empty_log_has_no_states(spark, tmp_path):
    write(tmp_path / "log", "a.json", [])
    resume.advance(spark, str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert resume.current(spark, str(tmp_path / "out")).count() == 0


def test_a_call_makes_no_frames_of_its_records(monkeypatch):
    """A key's records were concatenated and sorted as frames, which took two milliseconds a key."""
    import pandas as pd

    class State:
        exists, get = True, (3, "ok", 2, 0, 0, 0)

        def update(self, values):
            self.values = values

    frames = [pd.DataFrame({"seq": [9, 2], "status": ["ok", "failed"]}), pd.DataFrame({"seq": [5, 9], "status": ["failed", "failed"]})]
    monkeypatch.setattr(pd, "concat", None)
    state = State()
    (out,) = resume._advance(("k",), iter(frames), state)
    # in the order of seq, then status: 2 is stale; 5 failed, 9 failed, 9 ok
    assert state.values == (9, "ok", 6, 1, 1, 1)
    assert out.to_dict("records") == [{"key": "k", "seq": 9, "status": "ok", "attempts": 6, "recovered": 1, "redone": 1, "stale": 1}]
