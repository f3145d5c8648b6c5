"""One-at-a-time attachment of reports to events, for a stretch of reports in order of arrival.

This is the small sequential core of :mod:`corrob.operators.cluster`: what one
task does with a bounded stretch of reports, given the events as they stood
when the stretch begins.  Vectors are whole numbers, so a centroid is an exact
sum whatever the order of its members, and every decision is a function of
exact values.

Reports of one signature mostly join the same event time after time.  A run of
reports is therefore assumed to go on like that, all its scores are worked out
at once from running sums (whole numbers again, so they are the very scores of
the one-at-a-time pass), and the run stands up to the first report for which
another event wins, ties or falls short; that one is decided by itself.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa

from corrob import fixed_values as V

#: Reports of one event beyond which products of 18-bit weights might leave 64 bits.
_MANY = 1 << 26
#: Reports of an assumed run, different signatures in it, and signatures whose products are kept.
_RUN, _MIXED, _KEPT = 4096, 256, 1024
_LOW = (1 << 31) - 1  # squares of centroids are held as two numbers of 31 and more bits


class Text:
    """What is known of all reports of one signature."""

    def __init__(self, vec, entities, numbers, event_type, columns: dict[int, int]):
        self.weights = np.array([e["w"] for e in vec], np.int64)
        self.columns = np.array([columns.setdefault(e["bucket"], len(columns)) for e in vec], np.int64)
        self.square = sum(int(w) ** 2 for w in self.weights)
        self.norm = math.sqrt(self.square)
        self.signals = (frozenset(entities), frozenset(numbers), event_type)


def _share(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


class Events:
    """The events of one neighbourhood, brought up to date report by report."""

    def __init__(self, columns: dict[int, int], window: int):
        self.columns, self.window = columns, window
        self.ids, self.started, self.signals, self.squares = [], [], [], []
        self.sums = np.zeros((16, max(1, len(columns))), np.int64)
        self.counts, self.last, self.norms = np.zeros(16, np.int64), np.zeros(16, np.int64), np.zeros(16)
        self.extra: dict[str, tuple[np.ndarray, int]] = {}

    def add(self, event_id, started, signals, last: int) -> int:
        at = len(self.ids)
        if at == len(self.counts):
            self.sums, self.counts, self.last, self.norms = (
                np.concatenate([a, np.zeros_like(a)]) for a in (self.sums, self.counts, self.last, self.norms))
        self.ids.append(event_id)
        self.started.append(started)
        self.signals.append(signals)
        self.squares.append(0)
        self.last[at] = last
        return at

    def _fixed(self, sig: str, text: Text) -> np.ndarray:
        """For every event so far: shares of the score that do not depend on centroids, and the factor on all of it."""
        table, filled = self.extra.get(sig, (np.zeros((0, 3)), 0))
        if filled < len(self.ids):
            if len(table) < len(self.ids):
                table = np.concatenate([table, np.zeros((len(self.counts) - len(table), 3))])
            for at in range(filled, len(self.ids)):
                entities, numbers, kind = self.signals[at]
                other = text.signals[2] is not None and kind is not None and text.signals[2] != kind
                table[at] = (V.WEIGHT_ENTITY * _share(text.signals[0], entities), V.WEIGHT_NUMBER * _share(text.signals[1], numbers),
                             V.TYPE_MISMATCH_PENALTY if other else 1.0)
            self.extra[sig] = table, len(self.ids)
        return table

    def best(self, sig: str, text: Text, when: int) -> tuple[int, float] | None:
        """The event to join and the score: the highest, then the nearest, then the earliest event."""
        near = np.flatnonzero(np.abs(self.last[:len(self.ids)] - when) <= self.window)
        if not len(near) or not len(text.columns):
            return None
        cos = self._dot(near[:, None], text, self.counts[near].max()) / (self.norms[near] * text.norm)
        entity, number, factor = self._fixed(sig, text)[near].T
        score = (V.WEIGHT_SEMANTIC * np.maximum(cos, 0.0) + entity + number) * factor
        top = score.max()
        if round(float(top), 9) < V.CLUSTER_THRESHOLD:
            return None
        first = np.flatnonzero(score > top - 2e-9)
        if len(first) > 1:  # ties are those of nine digits
            ranks = {k: (-round(float(score[k]), 9), -round(float(cos[k]), 9), self.started[near[k]]) for k in first.tolist()}
            chosen = min(ranks, key=ranks.get)
        else:
            chosen = int(first[0])
        return int(near[chosen]), float(score[chosen])

    def _dot(self, at, text: Text, most: int) -> np.ndarray:
        part = self.sums[at, text.columns]
        if most >= _MANY:
            part = part.astype(object)
        return (part @ text.weights).astype(float) if part.ndim > 1 else part @ text.weights

    def join(self, at: int, text: Text, when: int) -> None:
        self.squares[at] += 2 * int(self._dot(at, text, self.counts[at])) + text.square
        self.norms[at] = math.sqrt(self.squares[at]) or math.inf
        self.sums[at, text.columns] += text.weights
        self.counts[at] += 1
        self.last[at] = max(self.last[at], when)

    def joined_run(self, at: int, added: np.ndarray, grown: int, n: int, last: int) -> None:
        """As :meth:`join` for ``n`` reports at once: their summed vectors, and by how much the square grows."""
        self.squares[at] += grown
        self.norms[at] = math.sqrt(self.squares[at]) or math.inf
        self.sums[at] += added
        self.counts[at] += n
        self.last[at] = max(self.last[at], last)


class Runs:
    """Runs of reports whose signatures join the events they joined last."""

    def __init__(self, events: Events, texts: list[Text], sigs: list[str]):
        self.events, self.texts, self.sigs = events, texts, sigs
        self.assumed = np.full(len(texts), -1, np.int64)
        self.vectors = None
        if len(texts) <= _KEPT:
            self.vectors = self._dense(range(len(texts)))
            self.products = self._products(self.vectors)

    def _dense(self, which) -> np.ndarray:
        found = np.zeros((len(which), self.events.sums.shape[1]), np.int64)
        for row, k in enumerate(which):
            found[row, self.texts[k].columns] = self.texts[k].weights
        return found

    @staticmethod
    def _products(vectors: np.ndarray) -> np.ndarray:
        # weights have 18 bits and vectors unit length, so doubles hold the products exactly
        return (vectors.astype(float) @ vectors.T.astype(float)).astype(np.int64)

    def take(self, codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The events that the first of these reports join, and the scores; as many as the assumption holds for."""
        none = np.zeros(0, np.int64), np.zeros(0)
        unknown = np.flatnonzero(self.assumed[codes] < 0)
        if len(unknown):
            codes, times = codes[:unknown[0]], times[:unknown[0]]
        if not len(codes):
            return none
        kinds, first, inner = np.unique(codes, return_index=True, return_inverse=True)
        if len(kinds) > _MIXED:
            end = np.sort(first)[_MIXED]
            codes, times = codes[:end], times[:end]
            kinds, inner = np.unique(codes, return_inverse=True)
        events, window = self.events, self.events.window
        known, target = len(events.ids), self.assumed[kinds]
        may = (events.last[:known] >= times.min() - window) & (events.last[:known] <= times.max() + window)
        may[target] = True
        live = np.flatnonzero(may)
        if len(live) * len(kinds) * events.sums.shape[1] > 4000 * len(codes) or events.counts[live].max() + len(codes) >= _MANY >> 1:
            return none
        room = max(16, (1 << 21) // len(live))
        if len(codes) > room:
            return self.take(codes[:room], times[:room])
        order = np.argsort(target, kind="stable")  # signatures of one event side by side
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        kinds, target, inner = kinds[order], target[order], place[inner.reshape(-1)]
        joined, starts = np.unique(target, return_index=True)
        column = np.searchsorted(live, joined)
        vectors = self._dense(kinds) if self.vectors is None else self.vectors[kinds]
        products = self._products(vectors) if self.vectors is None else self.products[np.ix_(kinds, kinds)]
        rows, mine = np.arange(len(codes)), np.searchsorted(joined, target)[inner]

        # what each report finds: members so far by signature, hence its product with every centroid
        so_far = np.zeros((len(codes) + 1, len(kinds)), np.int64)
        so_far[rows + 1, inner] = 1
        so_far = np.cumsum(so_far, axis=0)
        dots = (vectors @ events.sums[live].T)[inner]
        dots[:, column] += np.add.reduceat(so_far[:-1] * products[inner], starts, axis=1)
        grown = 2 * dots[rows, column[mine]] + np.array([self.texts[k].square for k in kinds], np.int64)[inner]
        high, low = (np.zeros((len(codes) + 1, len(joined)), np.int64) for _ in range(2))
        high[rows + 1, mine], low[rows + 1, mine] = grown >> 31, grown & _LOW
        high, low = np.cumsum(high, axis=0), np.cumsum(low, axis=0)
        high += np.array([events.squares[at] >> 31 for at in joined], np.int64)
        low += np.array([events.squares[at] & _LOW for at in joined], np.int64)
        exact = (high + (low >> 31)).astype(float) * float(1 << 31) + (low & _LOW).astype(float)
        norms = np.broadcast_to(events.norms[live], dots.shape).copy()
        norms[:, column] = np.sqrt(exact[:-1])
        norms[norms == 0] = math.inf
        last = np.full((len(codes) + 1, len(joined)), np.iinfo(np.int64).min)
        last[0] = events.last[joined]
        last[rows + 1, mine] = times
        last = np.maximum.accumulate(last, axis=0)
        lasts = np.broadcast_to(events.last[live], dots.shape).copy()
        lasts[:, column] = last[:-1]

        cos = dots.astype(float) / (norms * np.array([self.texts[k].norm for k in kinds])[inner][:, None])
        fixed = np.stack([events._fixed(self.sigs[k], self.texts[k])[live] for k in kinds])[inner]
        score = (V.WEIGHT_SEMANTIC * np.maximum(cos, 0.0) + fixed[:, :, 0] + fixed[:, :, 1]) * fixed[:, :, 2]
        score[np.abs(lasts - times[:, None]) > window] = -1.0
        own = score[rows, column[mine]].copy()
        score[rows, column[mine]] = -1.0
        holds = (own >= V.CLUSTER_THRESHOLD + 1e-9) & (own > score.max(axis=1) + 3e-9)
        good = len(codes) if holds.all() else int(np.argmin(holds))
        counts = so_far[good]
        for j, at in enumerate(joined.tolist()):
            these = slice(starts[j], starts[j + 1] if j + 1 < len(joined) else len(kinds))
            n = int(counts[these].sum())
            if n:
                now = (int(high[good, j]) << 31) + int(low[good, j])
                events.joined_run(at, counts[these] @ vectors[these], now - events.squares[at], n, int(last[good, j]))
        return joined[mine[:good]], own[:good]


def _attach(events: Events, texts: list[Text], sigs: list[str], codes: np.ndarray, ids: list, retrieved: list,
            times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Take reports one after another: the place of the event of each, its score, and whether it started the event."""
    count, runs = len(codes), Runs(events, texts, sigs)
    chosen, scores, new = np.zeros(count, np.int64), np.ones(count), np.zeros(count, bool)
    at, length, pause, idle = 0, 64, 0, 1
    while at < count:
        if pause == 0 and runs.assumed[codes[at]] >= 0:
            found, score = runs.take(codes[at:at + length], times[at:at + length])
            chosen[at:at + len(found)], scores[at:at + len(found)] = found, score
            at += len(found)
            if len(found) >= 8:
                length, idle = min(_RUN, 2 * length if len(found) == length else max(64, 2 * len(found))), 1
            else:  # runs do not pay here: look again after a while
                length, pause, idle = 64, idle, min(1024, 2 * idle)
            if at == count:
                break
        pause = max(0, pause - 1)
        code, when = int(codes[at]), int(times[at])
        best = events.best(sigs[code], texts[code], when)
        if best is None:
            place = events.add(ids[at], (retrieved[at], ids[at]), texts[code].signals, when)
            new[at] = True
        else:
            place, scores[at] = best
        events.join(place, texts[code], when)
        chosen[at] = place
        if len(texts[code].columns):
            runs.assumed[code] = place
        at += 1
    return chosen, scores, new


def _start(rows: list[dict], columns: dict[int, int], window: int) -> Events:
    """Events from rows that may each hold a part of an event: what was known, and what earlier stretches added."""
    events, merged = Events(columns, window), {}
    for r in rows:
        merged.setdefault(r["event_id"], []).append(r)
    for event_id, parts in merged.items():
        total: dict[int, int] = {}
        for p in parts:
            for e in p["vec"]:
                total[e["bucket"]] = total.get(e["bucket"], 0) + e["w"]
        head = parts[0]
        at = events.add(event_id, (head["started_at"], event_id), (frozenset(head["entities"]), frozenset(head["numbers"]), head["event_type"]),
                        max(p["last"] for p in parts))
        for bucket, w in total.items():
            if bucket in columns:
                events.sums[at, columns[bucket]] = w
        events.squares[at] = sum(w * w for w in total.values())
        events.norms[at] = math.sqrt(events.squares[at]) or math.inf
        events.counts[at] = sum(p["n"] for p in parts)
    return events


def replayer(window: int, schema: pa.Schema):
    """The function of one task: (its reports, the texts and events they may meet) -> what became of them.

    A row with a report_id says which event it joined; one without says what
    the stretch added to an event.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known: dict[str, list[dict]] = {}
        described: dict[str, dict] = {}
        for r in right.to_pylist():
            if r["sig"] is None:
                known.setdefault(r["unit"], []).append(r)
            else:
                described[r["sig"]] = r
        left = left.sort_by([("unit", "ascending"), ("retrieved", "ascending"), ("report_id", "ascending")])
        task, unit_of = left.column("task")[0].as_py(), left.column("unit").to_pylist()
        ids, retrieved = left.column("report_id").to_pylist(), left.column("retrieved").to_pylist()
        occurred = left.column("occurred").to_numpy()
        coded = left.column("sig").combine_chunks().dictionary_encode()
        every, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        joined: dict[str, list] = {"event_id": [], "score": [], "is_new": []}
        added = []
        for unit, group in itertools.groupby(range(len(ids)), key=unit_of.__getitem__):
            low = next(group)
            high = low + 1 + sum(1 for _ in group)
            kinds, inner = np.unique(codes[low:high], return_inverse=True)
            sigs = [every[k] for k in kinds]
            columns: dict[int, int] = {}
            texts = [Text(*(described[s][k] for k in ("vec", "entities", "numbers", "event_type")), columns) for s in sigs]
            events = _start(known.get(unit, []), columns, window)
            before = len(events.ids)
            sums, counts = events.sums[:before].copy(), events.counts[:before].copy()
            chosen, scores, new = _attach(events, texts, sigs, inner.reshape(-1), ids[low:high], retrieved[low:high], occurred[low:high])
            joined["event_id"] += [events.ids[at] for at in chosen.tolist()]
            joined["score"] += scores.tolist()
            joined["is_new"] += new.tolist()
            bucket = {c: b for b, c in columns.items()}
            for at, event_id in enumerate(events.ids):
                more = events.counts[at] - (counts[at] if at < before else 0)
                if more:
                    delta = events.sums[at] - (sums[at] if at < before else 0)
                    entities, numbers, kind = events.signals[at]
                    added.append({"task": task, "unit": unit, "event_id": event_id, "is_new": at >= before, "started_at": events.started[at][0],
                                "vec": [{"bucket": bucket[c], "w": int(delta[c])} for c in np.flatnonzero(delta).tolist()],
                                "entities": sorted(entities), "numbers": sorted(numbers), "event_type": kind,
                                "last": int(events.last[at]), "n": int(more)})
        given = {"task": left.column("task"), "unit": left.column("unit"), "report_id": left.column("report_id"), **joined}
        reports = pa.table({f.name: given.get(f.name, pa.nulls(len(ids), f.type)) for f in schema}, schema=schema)
        return pa.concat_tables([reports, pa.Table.from_pylist(added, schema=schema)])

    return run
