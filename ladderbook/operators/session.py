"""The rules by which one symbol's messages turn into book updates; ids only, no levels.

The batch job runs a Session over each book's message headers, the streaming job over arriving
messages. What a message causes comes back as actions; whoever keeps levels follows them.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: most diffs that wait for a snapshot
BUFFER = 65_536
#: place of a depth5 row behind the diffs that it lets go
LAST = 1 << 30


class Diff(NamedTuple):
    epoch: int
    seq: int
    first_id: int
    final_id: int
    pu: int


class Action(NamedTuple):
    """What happened to a row (epoch, seq), in which segment and at which ordinal in it.

    action: seed (source: snapshot or depth5; seq: its place there), apply, stale, gap, buffered, drop,
    reset, overflow, check (a depth5 row beside the book before it), partial (a depth5 row to emit),
    trade, error. cause: the row that was being handled; place: order inside it; number: of the
    emitted book row, 0 if none.
    """

    action: str
    epoch: int
    seq: int
    source: str
    segment: int
    ordinal: int
    cause_epoch: int
    cause_seq: int
    place: int
    number: int


class Snapshots(deque):
    """Snapshots that wait, the first of which is the book's `at`-th. With `more`, others follow that aren't here;
    `missed` tells that one of those was asked for."""

    def __init__(self, waiting=(), at: int = 0, more: bool = False):
        super().__init__(waiting)
        self.at, self.more, self.missed = at, more, False

    def __bool__(self) -> bool:
        self.missed = self.missed or self.more and not len(self)
        return len(self) > 0

    def popleft(self):
        self.at += 1
        return super().popleft()


class Session:
    """State of one book: pending until a snapshot seeds it, buffering diffs while pending."""

    def __init__(self, usdm: bool, have_sidecar: bool, trades: bool = False, cap: int = BUFFER, seed_by_final_id: bool = False):
        self.usdm, self.have_sidecar, self.trades, self.cap, self.seed_by_final_id = usdm, have_sidecar, trades, cap, seed_by_final_id
        self.epoch: int | None = None
        self.pending, self.ready, self.started = True, False, False
        self.last = 0
        self.buffer: deque[Diff] = deque()
        self.snapshots: Snapshots = Snapshots()
        self.segment = self.ordinal = self.number = 0

    def state(self) -> list:
        """What the messages to come depend on, without counters: [epoch, pending, ready, started, last, snapshots used, waiting diffs]."""
        return [self.epoch, self.pending, self.ready, self.started, self.last, self.snapshots.at, [list(d) for d in self.buffer]]

    def enter(self, state: list, snapshots: list[tuple[int, int]], more: bool) -> None:
        """Go on from a state(); snapshots: the next ones, more: whether others follow these."""
        self.epoch, self.pending, self.ready, self.started, self.last, at, waiting = state
        self.buffer = deque(Diff(*d) for d in waiting)
        self.snapshots = Snapshots(snapshots, at, more)

    def add_snapshot(self, place: int, last_id: int) -> None:
        self.snapshots.append((place, last_id))

    def message(self, kind: str, valid: bool, epoch: int, seq: int, first_id: int, final_id: int, pu: int, last_id: int) -> Iterator[Action]:
        def act(name: str, e: int = epoch, s: int = seq, source: str = "", place: int = 0, number: int = 0) -> Action:
            return Action(name, e, s, source, self.segment, self.ordinal, epoch, seq, place, number)

        if self.epoch is not None and self.epoch != epoch:
            self.pending, self.ready, self.started, self.last = True, False, False, 0
            self.buffer.clear()
            yield act("reset")
        self.epoch = epoch
        if kind == "depth_diff":
            if not valid:
                yield act("error")
                return
            diff = Diff(epoch, seq, first_id, final_id, pu)
            if self.pending or not self.ready:
                outcome = "buffered"
            else:
                outcome = self._judge(diff)
            if outcome == "apply":
                yield act("apply", number=self._apply(diff))
                return
            if outcome == "stale":
                yield act("stale")
                return
            if outcome == "gap":
                self.pending = True
            yield act(outcome)
            if len(self.buffer) >= self.cap:
                self.buffer.clear()
                self.pending, self.ready, self.started, self.last = True, False, False, 0
                yield act("overflow")
            self.buffer.append(diff)
            if self.snapshots:
                place, snap_id = self.snapshots.popleft()
                yield from self._seed("snapshot", -1, place, snap_id, act)
        elif kind == "depth5":
            if not valid:
                yield act("error")
                return
            if self.ready:
                yield act("check")
            if not self.have_sidecar:
                yield from self._seed("depth5", epoch, seq, last_id or (final_id if self.seed_by_final_id else 0), act)
            self.number += 1
            yield act("partial", place=LAST, number=self.number)
        elif kind == "trade" and self.trades and self.ready and not self.pending:
            self.number += 1
            yield act("trade", number=self.number)

    def stretch(self, diff: np.ndarray, epoch: np.ndarray, seq: np.ndarray, first_id: np.ndarray, final_id: np.ndarray, pu: np.ndarray) -> tuple[int, dict]:
        """Valid diffs, and trades where diff is false, of the book's connection: how many of the first of them are
        taken (up to the first that message() has to see), and what happens to them (columns of actions; `action`
        lists names, `which` says whose each row is)."""
        if self.pending or not self.ready:
            if self.snapshots:
                return 0, {}
            waiting = np.flatnonzero(diff)
            room = self.cap - len(self.buffer)
            taken = len(diff) if len(waiting) <= room else int(waiting[room])
            rows = waiting[:room]
            self.buffer.extend(map(Diff, *(x[rows].tolist() for x in (epoch, seq, first_id, final_id, pu))))
            return taken, self._columns(["buffered"], np.zeros(len(rows), np.int64), epoch[rows], seq[rows], self.ordinal, 0)
        if self.usdm and not self.started:
            return 0, {}
        reached = np.maximum.accumulate(np.r_[self.last, np.where(diff, final_id, self.last)])[:-1]
        stale = diff & (final_id <= reached)
        gap = np.flatnonzero(diff & ~stale & (pu != reached if self.usdm else first_id > reached + 1))
        taken = int(gap[0]) if len(gap) else len(diff)
        applied = diff[:taken] & ~stale[:taken]
        emitted = applied | ~diff[:taken] if self.trades else applied
        ordinal, number = self.ordinal + np.cumsum(applied), self.number + np.cumsum(emitted)
        rows = np.flatnonzero(diff[:taken] | emitted)
        which = np.where(~diff[rows], 2, np.where(applied[rows], 0, 1))
        found = self._columns(["apply", "stale", "trade"], which, epoch[rows], seq[rows], ordinal[rows], np.where(emitted, number, 0)[rows])
        if applied.any():
            self.last, self.started = int(final_id[:taken][applied].max()), True
        if taken:
            self.ordinal, self.number = int(ordinal[-1]), int(number[-1])
        return taken, found

    def _columns(self, names: list[str], which: np.ndarray, epoch: np.ndarray, seq: np.ndarray, ordinal, number) -> dict:
        return {"action": names, "which": which, "epoch": epoch, "seq": seq, "segment": self.segment, "ordinal": ordinal, "cause_epoch": epoch, "cause_seq": seq, "number": number}

    def _judge(self, d: Diff) -> str:
        if d.final_id <= self.last:
            return "stale"
        if self.usdm:
            gap = d.pu != self.last if self.started else d.first_id > self.last
        else:
            gap = d.first_id > self.last + 1
        return "gap" if gap else "apply"

    def _apply(self, d: Diff) -> int:
        self.last, self.started = d.final_id, True
        self.ordinal += 1
        self.number += 1
        return self.number

    def _seed(self, source: str, epoch: int, seq: int, last_id: int, act) -> Iterator[Action]:
        self.segment, self.ordinal = self.segment + 1, 0
        self.last, self.ready, self.started, self.pending = last_id, True, False, False
        yield act("seed", epoch, seq, source)
        place = 0
        while self.buffer:
            d = self.buffer[0]
            outcome = "drop" if d.final_id <= last_id else self._judge(d)
            if outcome == "gap":
                self.pending = True
                return
            self.buffer.popleft()
            if outcome == "apply":
                place += 1
                yield act("apply", d.epoch, d.seq, "buffer", place, self._apply(d))
            else:
                yield act("drop", d.epoch, d.seq, "buffer")
