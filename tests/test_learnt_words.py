"""Learnt words with eviction: the store, its batch fold and its stream against a plain fold."""

import random
import time

from pyspark.sql import Row

from keyloom.operators import users
from keyloom.streaming import runs, words

EVENT = "user_id long, at long, word string, forget boolean"


def plain(events, capacity):
    """One user's events in order, the store scanned at each eviction."""
    store = {}
    for _, _, word, forget in sorted(events, key=lambda e: (e[1], bool(e[3]), e[2].lower())):
        word = word.lower()
        if forget:
            store.pop(word, None)
            continue
        store[word] = min(store.get(word, 0) + 1, 1000)
        if len(store) > capacity:
            least = min(store.values())
            del store[max(w for w, n in store.items() if n == least)]
    return store


def events(seed, n, users_=3, distinct=12):
    rng = random.Random(seed)
    names = [a + b for a in "abcz" for b in ("", "ó", "xy")][:distinct]
    return [(rng.randint(1, users_), k, rng.choice([str.upper, str, str, str])(rng.choice(names)), rng.random() < 0.1 or None) for k in range(n)]


def test_the_least_used_word_goes_and_of_equals_the_greatest():
    s = words.Store(3)
    for w in ["czesto"] * 4 + ["rzadziej"] * 2 + ["raz", "nowe"]:
        s.learn(w)
    assert s.held() == {"czesto": 4, "rzadziej": 2, "nowe": 1}
    s.learn("raz")  # again the greatest of those used once, so it is its own victim
    assert s.held() == {"czesto": 4, "rzadziej": 2, "nowe": 1} and s.size == 3
    assert s.forget("nowe") and not s.forget("nowe") and s.size == 2


def test_the_store_equals_a_plain_fold():
    for seed in range(30):
        rows = [(1, k, w.lower(), f) for _, k, w, f in events(seed, 300)]
        for capacity in (1, 2, 5, 50):
            s = words.Store(capacity)
            for _, _, w, f in rows:
                s.forget(w) if f else s.learn(w)
            assert s.held() == plain(rows, capacity)


def test_a_million_events_stay_small_and_fast():
    rng = random.Random(0)
    s, start = words.Store(4000), time.time()
    for _ in range(1_000_000):
        s.learn(f"w{int(rng.paretovariate(0.6)) % 50_000}")
    assert len(s.uses) == s.size == 4000 and s.entries < 6 * 4000 and time.time() - start < 60
    assert max(s.uses.values()) == words.MOST_USES and not s.touched


def test_batch_equals_a_plain_fold(spark):
    rows = events(1, 400) + [(9, k, "kot", False) for k in range(1200)] + [(9, 2000, "don't", False), (9, 2001, "", False), (9, 2002, None, False), (None, 1, "kot", False)]
    frame = spark.createDataFrame(rows, EVENT)
    for capacity in (4, 100):
        got = {}
        for r in words.folded(frame.where("user_id is not null"), capacity).collect():
            got.setdefault(r.user_id, {})[r.word] = r.uses
        assert got == {u: plain([e for e in rows if e[0] == u and e[2] and "'" not in e[2]], capacity) for u in (1, 2, 3, 9)}
    assert words.folded(frame.limit(0)).count() == 0
    # Within the capacity the aggregates of the batch layer say the same.
    store = {(r.user_id, r.word): r.uses for r in users.store(frame.where("user_id = 1").na.fill(False)).collect()}
    assert store == {(1, w): n for w, n in plain([e for e in rows if e[0] == 1], 100).items()}


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    rows = events(5, 300)
    folder, at = str(tmp_path / "in"), f"file://{tmp_path}/job"
    for part in (rows[:80], rows[80:81], rows[81:200], rows[200:]):
        rng = random.Random(len(part))
        part = rng.sample(part, len(part))  # out of order within a batch
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(folder)
        changes = runs.drained(words.streamed(runs.read(spark, folder), 5), at)
    got = {(r.user_id, r.word): r.uses for r in words.latest(changes).collect()}
    assert got == {(u, w): n for u in (1, 2, 3) for w, n in plain([e for e in rows if e[0] == u], 5).items()}
    # A batch emits a word once at most, and only words that it changed.
    assert changes.count() < 300 and changes.where("uses = 0").count() > 0


class Counted:
    """State that counts the calls to it."""

    def __init__(self):
        self.calls, self.held = 0, {}

    def _of(self, name):
        def call(*args):
            self.calls += 1
            if name in ("get", "getValue"):
                return self.held.get(args)
            if name in ("exists", "containsKey"):
                return args in self.held
            if name.startswith("update"):
                self.held[args[:-1]] = args[-1]

        return call

    def __getattr__(self, name):
        return self._of(name)


def test_a_batch_reads_and_writes_a_store_once():
    states = []
    made = lambda *_: states.append(Counted()) or states[-1]
    learner = words.Learner(100)
    learner.init(type("Handle", (), {"getMapState": made, "getValueState": made}))
    out = {}
    for batch in range(3):
        rows = [Row(user_id=1, at=[1000 * batch + k], word=[f"w{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}"], forget=[False]) for k in range(300)]
        before = sum(s.calls for s in states)
        for r in learner.handleInputRows((1,), iter(rows), None):
            out |= dict(zip(r.word, r.uses))
        assert sum(s.calls for s in states) - before <= 4
    assert len(out) == 100 and set(out.values()) == {9}


def test_rows_of_many_events_are_as_good_as_rows_of_one(spark, tmp_path):
    rows = [*events(8, 200), (1, 500, "don't", None), (1, 501, "", None), (2, 502, None, None)]
    spark.createDataFrame(rows, EVENT).createOrReplaceTempView("learnt_rows")
    folder = str(tmp_path / "turns")
    turns = spark.sql("select user_id, collect_list(struct(at, word, coalesce(forget, false) forget)) events from learnt_rows group by user_id, at div 7")
    turns.coalesce(1).write.parquet(folder)
    changes = runs.drained(words.learnt(runs.read(spark, folder), 5), f"file://{tmp_path}/job")
    got = {(r.user_id, r.word): r.uses for r in words.latest(changes).collect()}
    assert got == {(u, w): n for u in (1, 2, 3) for w, n in plain([e for e in rows[:200] if e[0] == u], 5).items()}
