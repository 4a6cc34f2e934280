"""Press streams: multitap letters that settle by timer, and groups of presses that a pause ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from keyloom.functions.keypad import KEYS

BACK = "<"  # takes back the letter in hand, else the last one settled
TIMEOUT, IDLE = 1_200, 24 * 3_600_000  # ms: when a letter settles; when a text is left
LETTERS = "user_id long, started long, last long, digit string, n long, letter string, undone boolean"


class Multitap(StatefulProcessor):
    """One user. Presses wait in state until the watermark has passed them, so their order of arrival doesn't matter and a
    repeated one counts once. Then each cycles the letter in hand or settles it; what nothing follows is settled by a
    timer. A text that is left alone for idle ms is forgotten with its state."""

    def __init__(self, timeout: int = TIMEOUT, idle: int = IDLE):
        self.timeout, self.idle = timeout, max(idle, timeout)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, event_id long", "digit string")
        self.hand = handle.getValueState("hand", "digit string, n long, started long, last long")
        self.size = handle.getValueState("size", "size long, last long")
        self.text = handle.getMapState("text", "at long", "digit string, n long, started long, last long")

    def handleInputRows(self, key, rows, timerValues):
        least = None
        for r in rows:
            self.waiting.updateValue((r.ms, r.event_id), (r.digit,))
            least = r.ms if least is None or r.ms < least else least
        self.handle.registerTimer(least)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        ready, later = [], None
        for (ms, event_id), (digit,) in list(self.waiting.iterator()):
            if ms <= mark:
                ready.append((ms, event_id, digit))
                self.waiting.removeKey((ms, event_id))
            elif later is None or ms < later:
                later = ms
        hand = self.hand.get() if self.hand.exists() else None
        size, last = self.size.get() if self.size.exists() else (0, None)
        out = []

        def settle(letter):
            nonlocal size
            self.text.updateValue((size,), letter)
            size += 1
            out.append(self._row(key, letter, False))

        for ms, _, digit in sorted(ready):
            if last is not None and ms - last > self.idle:
                if hand is not None:
                    settle(hand)
                hand, size = None, 0
                self.text.clear()
            if digit == BACK:
                if hand is not None and ms - hand[3] > self.timeout:
                    settle(hand)
                    hand = None
                if hand is not None:
                    hand = None
                elif size:
                    size -= 1
                    out.append(self._row(key, self.text.getValue((size,)), True))
                    self.text.removeKey((size,))
            elif hand is not None and digit == hand[0] and ms - hand[3] <= self.timeout:
                hand = (digit, hand[1] + 1, hand[2], ms)
            elif digit in KEYS:
                if hand is not None:
                    settle(hand)
                hand = (digit, 1, ms, ms)
            last = ms
        if hand is not None and hand[3] + self.timeout <= mark:
            settle(hand)
            hand = None
        if last is not None and hand is None and later is None and last + self.idle <= mark:
            for state in (self.text, self.hand, self.size):
                state.clear()
            return iter(out)
        self.hand.update(hand) if hand is not None else self.hand.clear()
        if last is not None:
            self.size.update((size, last))
        due = [t for t in (later, hand and hand[3] + self.timeout, last and not hand and last + self.idle) if t]
        for t in due:
            if t > mark:
                self.handle.registerTimer(t)
        return iter(out)

    @staticmethod
    def _row(key, letter, undone) -> Row:
        digit, n, started, last = letter
        letters = KEYS[digit]
        return Row(user_id=key[0], started=started, last=last, digit=digit, n=n, letter=letters[(n - 1) % len(letters)], undone=undone)


def multitap(presses: DataFrame, timeout: int = TIMEOUT, idle: int = IDLE, late: str = "10 seconds") -> DataFrame:
    """presses(user_id, event_id, ts, ms, digit), digit a key or BACK: one row for each letter that settles, and one with
    undone for each settled letter that is taken back. Rows behind the watermark, the latest ts less `late`, are dropped."""
    t = presses.select("user_id", "event_id", "ts", "ms", "digit").withWatermark("ts", late)
    return t.groupBy("user_id").transformWithState(Multitap(timeout, idle), LETTERS, "append", "eventTime")


def debounced(presses: DataFrame, pause: int, late: str = "10 seconds") -> DataFrame:
    """presses(user_id, ts): groups of presses without a pause of `pause` ms or more, once the watermark has passed the pause
    behind them. A row behind the watermark is dropped; one that is late, but not that late, joins its group."""
    t = presses.select("user_id", "ts").withWatermark("ts", late)
    w = F.session_window("ts", f"{pause} milliseconds")
    t = t.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return t.select("user_id", F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "n")
