"""A plain reading of the rules that label days, one user at a time, to hold the relational one against."""

from __future__ import annotations

import statistics

import numpy as np
import pandas as pd

LUTEAL, OVULATION_WINDOW = 12, 5


def calendar_sums(t: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the seven days before each day, and of the day and the next, by calendar."""
    at = dict(zip(t.tolist(), x.tolist()))
    before = np.array([sum(at.get(d - k, 0) for k in range(1, 8)) for d in t.tolist()], float)
    two = np.array([at.get(d, 0) + at.get(d + 1, 0) for d in t.tolist()], float)
    return before, two


class _Cycles:
    """What is known of a user's cycles by the evening of a day."""

    def __init__(self, median: float):
        self.starts: list[int] = []
        self.pregnant: list[bool] = []  # of all starts ever entered; a start that is taken back leaves its mark here
        self.last, self.usual = -29, median
        self.positive: int | None = None  # first positive test of the pregnancy that goes on
        self.event, self.kind = 0, ""  # what may have ended it

    def enter(self, day: int, pregnant: bool) -> None:
        self.starts.append(day)
        self.pregnant.append(pregnant)

    def conceive(self, day: int, length: int) -> None:
        self.positive = day
        if length < min(23, self.usual - 6) and self.starts:  # conceived in the cycle before
            self.starts.pop()
            self.last = self.starts[-1] if self.starts else -29

    def first_event(self, day: int, kind: str, length: int) -> None:
        """Something that may end the pregnancy: it does if it comes late, else it waits for a second one."""
        self.event, self.kind = day, kind
        if day - self.positive >= 2 * self.usual or length >= 3 * self.usual:
            self.enter(day, True)
            self.last, self.positive, self.kind = day, None, ""

    def second_event(self, day: int, period: bool, other: bool, positive: bool) -> None:
        """A period ends the pregnancy now, and at the first event too if that lies a cycle back; another sign ends it at a first period."""
        if period:
            low, high = sorted((21, round(1.75 * self.usual)))
            apart = low <= day - self.event <= high
            if apart:
                self.enter(self.event, True)
            self.enter(day, not apart)
            self.last, self.positive = day, None
        if self.kind == "period" and other:
            self.enter(self.event, True)
            self.last, self.positive, self.kind = self.event, None, ""
        if positive:
            self.kind = ""

    def learn(self) -> None:
        """With five starts that end no pregnancy, the median of the last three gaps of them is usual."""
        places = [k for k, p in enumerate(self.pregnant) if not p]
        if len(places) > 4:
            days = [self.starts[k] if k < len(self.starts) else None for k in places[-4:]]
            gaps = [b - a for a, b in zip(days, days[1:]) if a is not None and b is not None]
            self.usual = float(statistics.median(gaps)) if gaps else self.usual


def cycle_starts(days: pd.DataFrame, median: float = 29.0) -> pd.DataFrame:
    """Day 1 of each cycle (t, in order), judged day by day.

    A period starts a cycle if it is new and the cycle is long enough for this user; so does a declared first day after
    a quiet week. From a positive test on, a first sign of an end (period, negative test, declared first day) ends the
    pregnancy if it comes two usual cycles after the test or three after the cycle's start; else it waits. The next
    period then ends it that day, and at the first sign too if that is 21 days to 1.75 usual cycles back; another sign
    ends it at the first one if that was a period; a positive test takes the first sign back. A period that ends a
    pregnancy as a second sign leaves the first one standing, so it is the first sign of the next pregnancy.
    """
    t, m = days["t"].to_numpy(int), days["menstruation"].fillna(0).to_numpy(float)
    first, test = days["first_day"].fillna(False).to_numpy(bool), days["preg_test"].fillna(0).to_numpy(int)
    before, two = calendar_sums(t, m)
    known = _Cycles(median)
    for k, day in enumerate(t.tolist()):
        length = day - known.last
        period = m[k] > 0 and two[k] > 1 and before[k] <= 1 and length >= min(0.6 * known.usual, 12)
        declared = first[k] and length >= 21 and before[k] <= 2
        if known.positive is None and test[k] == 1:
            known.conceive(day, length)
        elif known.positive is None and (period or declared):
            known.enter(day, False)
            known.last = day
        if known.positive is not None and not known.kind:
            kind = "first day" if first[k] else "negative test" if test[k] == -1 else "period" if period else ""
            if kind:
                known.first_event(day, kind, length)
        elif known.positive is not None and known.event != day:
            known.second_event(day, period, first[k] or test[k] == -1, test[k] == 1)
        known.learn()
    return pd.DataFrame({"t": sorted(set(known.starts))})


def period_end(days: pd.DataFrame, start: int) -> int:
    """Last day of the period that begins on ``start``: while bleeding goes on with gaps of two days at most; 5 days without records."""
    m = dict(zip(days["t"].tolist(), days["menstruation"].fillna(0).tolist()))
    if not any(m.get(start + k, 0) > 0 for k in range(5)):
        return start + 4
    last = start
    day = start
    while day - last <= 2:
        if m.get(day, 0) > 0.5:
            last = day
        day += 1
    return last


def pregnancies(days: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
    """Cycles with a positive test: start, test, end (the next cycle's start, or the last record), and how they ended.

    210 to 273 days make a birth and fewer a loss; after more the end is unknown and a birth is set at day 252.
    """
    tests, rows = days.loc[days["preg_test"].fillna(0) > 0, "t"].to_numpy(int), []
    at, last = starts["t"].to_numpy(int), int(days["t"].max())
    for k, begin in enumerate(at.tolist()):
        stop = int(at[k + 1]) if k + 1 < len(at) else last + 1
        inside = tests[(tests >= begin) & (tests < stop)]
        if not len(inside):
            continue
        length, open_ = stop - begin, k + 1 == len(at)
        kind = "ongoing" if open_ and length < 210 else "birth" if 210 <= length <= 273 else "loss" if length < 210 else "undefined"
        rows.append((begin, int(inside[0]), stop, length, kind))
    return pd.DataFrame(rows, columns=["start", "test", "end", "length", "kind"])


def label_user(days: pd.DataFrame) -> pd.DataFrame:
    """t and label (a state name of the cycle model) of each recorded day."""
    days = days.sort_values("t").drop_duplicates("t").reset_index(drop=True)
    starts = cycle_starts(days)
    known = pregnancies(days, starts).set_index("start") if len(starts) else pd.DataFrame()
    label = pd.Series("", index=days["t"].to_numpy(int))
    t = label.index.to_numpy()

    def put(low: int, high: int, name: str) -> None:
        label[(t >= low) & (t <= high)] = name

    at = starts["t"].to_numpy(int)
    for k, begin in enumerate(at.tolist()):
        stop = int(at[k + 1]) if k + 1 < len(at) else None
        bleeding_ends = period_end(days, begin)
        if begin in known.index:
            row = known.loc[begin]
            conception = begin + 14
            put(conception, conception + 2, "postO")
            put(conception - 1, conception - 1, "O")
            if row["kind"] == "loss":
                put(conception + 3, row["end"] - 1, "PL")
                put(row["end"], row["end"] + 4, "L")
            else:
                birth = begin + 252 if row["kind"] == "undefined" else row["end"] if row["kind"] == "birth" else None
                for n, name in enumerate(("PB1", "PB2", "PB3")):
                    stop_ = (birth or row["end"]) - 1
                    low = begin + 1 + 84 * n
                    put(max(low, conception + 3), min(begin + 84 * (n + 1) if n < 2 else stop_, stop_), name)
                if birth is not None:
                    put(birth, birth + 3, "B")
                    if row["kind"] == "undefined":
                        put(birth + 4, row["end"] - 1, "BF" if row["length"] > 322 else "PP")
            put(begin, bleeding_ends, "M")
            continue
        if k and (at[k - 1] in known.index) and known.loc[at[k - 1], "kind"] == "birth":
            put(begin + 4, (stop or int(t.max()) + 1) - 1, "BF" if stop is None or stop - begin > 56 else "PP")
        elif stop is not None:
            ovulation = stop - LUTEAL - 2
            put(bleeding_ends + 1, ovulation - OVULATION_WINDOW - 1, "lE")
            put(max(bleeding_ends + 1, ovulation - OVULATION_WINDOW), ovulation - 2, "hE")
            if ovulation > bleeding_ends + 1:
                put(ovulation - 1, ovulation - 1, "preO")
                put(ovulation, ovulation, "O")
                put(ovulation + 1, ovulation + 2, "postO")
                put(ovulation + 3, stop - 1, "Lut")
            else:
                put(bleeding_ends + 1, stop - 1, "Ano")
        put(begin, bleeding_ends, "M")
    return pd.DataFrame({"t": t, "label": label.to_numpy()})
