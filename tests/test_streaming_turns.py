"""Frames of one micro-batch take their turns without a search for each."""

from sensorframe.streaming import tracker
from sensorframe.streaming.tracker import TrackProcessor


class Counted(dict):
    """A dict that counts how many of its keys are looked at in passes over it."""

    seen = 0

    def __iter__(self):
        for key in super().__iter__():
            Counted.seen += 1
            yield key


def test_turns_are_found_in_one_pass(monkeypatch):
    monkeypatch.setattr(tracker, "ROWS_OUT", 100, raising=False)
    n, out, live, tables = 2_000, [], [], []
    frame = {"d": [["p", 0.5, None, None, None, None, None, 0, 0, 10, 10]], "event_ms": 5}
    ready = Counted({k: {**frame, "n": k, "t": k / 10} for k in reversed(range(n)) if k != 1_500})
    steps = TrackProcessor(0.3, 2, None, 40.0, None)._advance("r", ready, 0, 1, live, 0, out)
    while True:
        try:
            tables.append(next(steps))
            assert len(out) == 100
        except StopIteration as end:
            assert end.value == (1_500, 2)
            break
    assert len(ready) == 499 and Counted.seen <= n  # what lies behind the gap waits for the watermark
    assert sum(len(t) for t in tables) + len(out) == 1_500 and max(len(t) for t in tables) == 100
    assert [h for t in tables for h in t["hits"]] == list(range(1, len(tables) * 100 + 1))
