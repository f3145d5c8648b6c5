"""Runs of reports in the replay give what the one-at-a-time pass gives, and pay."""

import random

import numpy as np
import pytest

from corrob import fixed_values as V
from corrob.operators import replay
from corrob.operators.cluster import SCALE

HOUR = 3_600_000_000


def texts_of(seed, columns):
    rng, found = random.Random(seed), []
    for place in range(4):
        for k in range(6):
            words = {b: 1.0 for b in [place, 10 + place, *rng.sample(range(20, 40), 2)]}
            norm = sum(w * w for w in words.values()) ** 0.5
            vec = [{"bucket": b, "w": round(w / norm * SCALE)} for b, w in sorted(words.items())]
            found.append(replay.Text(vec, [f"p{place}"], [f"n{k % 2}"], "flood" if k == 5 else "quake", columns))
    found.append(replay.Text([], [], [], None, columns))
    return found


def replayed(monkeypatch, seed, n, runs, sequels):
    """What becomes of ``n`` reports, and how many were decided by themselves; ``sequels`` is how stories follow each other."""
    columns, rng, alone = {}, np.random.default_rng(seed), []
    texts = texts_of(seed, columns)
    events = replay.Events(columns, V.EVENT_WINDOW_HOURS * HOUR)
    hours = np.sort(rng.uniform(0, 900, n))
    codes = (6 * (hours // 40 % 4) + rng.integers(0, 6, n)).astype(np.int64) if sequels else rng.integers(0, len(texts), n)
    times = (hours * HOUR).astype(np.int64) - rng.integers(0, 30 * HOUR, n) * (rng.random(n) < 0.1)
    best = replay.Events.best
    with monkeypatch.context() as patch:
        patch.setattr(replay.Events, "best", lambda self, *a: alone.append(1) or best(self, *a))
        if not runs:
            patch.setattr(replay.Runs, "take", lambda self, codes, times: (np.zeros(0, np.int64), np.zeros(0)))
        chosen, scores, new = replay._attach(events, texts, [str(k) for k in range(len(texts))], codes, list(range(n)), list(range(n)), times)
    state = events.ids, events.squares, events.counts.tolist(), events.last.tolist(), events.norms.tolist(), events.sums.tolist()
    return (chosen.tolist(), scores.tolist(), new.tolist(), state), len(alone)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sequels", [True, False])
@pytest.mark.parametrize("kept", [1024, 5])
def test_runs_change_nothing(monkeypatch, seed, sequels, kept):
    monkeypatch.setattr(replay, "_KEPT", kept)
    monkeypatch.setattr(replay, "_MIXED", 4 if kept == 5 else 256)
    assert replayed(monkeypatch, seed, 1500, True, sequels)[0] == replayed(monkeypatch, seed, 1500, False, sequels)[0]


def test_sums_beyond_64_bits_stay_exact(monkeypatch):
    columns = {}
    text = replay.Text([{"bucket": 1, "w": SCALE}], [], [], None, columns)
    ends = []
    for runs in (True, False):
        with monkeypatch.context() as patch:
            if not runs:
                patch.setattr(replay.Runs, "take", lambda self, codes, times: (np.zeros(0, np.int64), np.zeros(0)))
            events = replay.Events(columns, HOUR)
            at = events.add(0, (0, 0), text.signals, 0)
            big = 20_000_000
            events.joined_run(at, np.array([big * SCALE]), (big * SCALE) ** 2, big, 0)
            ends.append((replay._attach(events, [text], ["s"], np.zeros(500, np.int64), list(range(500)), list(range(500)),
                                        np.zeros(500, np.int64))[1].tolist(), events.squares, events.norms[0]))
    assert ends[0] == ends[1] and ends[0][1][0] == ((big + 500) * SCALE) ** 2


def test_reports_that_follow_each_other_are_taken_in_runs(monkeypatch):
    assert replayed(monkeypatch, 1, 20_000, True, True)[1] < 4_000
