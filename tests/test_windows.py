"""Windows against a plain evaluation of every frame."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from millrace import (
    Nulls,
    Relation,
    Window,
    const,
    count,
    dense_rank,
    desc,
    first,
    get,
    lag,
    last,
    lead,
    max,
    mean,
    moving,
    mutate,
    nth,
    over,
    rank,
    ranking,
    row_number,
    select,
    stepwise,
    sum,
    table,
)

from .test_verbs import ROWS

#: The rows and results of these tests.
T_ROWS = [
    dict(name=n, date=datetime.date(2018, 1, d), balance=b)
    for n, d, b in [("alice", 1, 2), ("alice", 4, 4), ("alice", 6, -3), ("alice", 7, -3), ("bob", 2, -1), ("bob", 3, -3), ("bob", 4, -3)]
]


def by_e(got, name):
    return [r[name] for r in sorted(got, key=lambda r: r["e"])]


def test_rows_frame():
    w = Window.rows(order_by=[get("e")], partition_by=[get("z")], preceding=lambda r: 2, following=lambda r: 0)
    assert by_e(table(ROWS) >> mutate(s=sum(get("a")) >> over(w)), "s") == [1, 2, 4, 8, 8, 4, 7]


def test_range_frame():
    w = Window.range(order_by=[get("e")], partition_by=[get("z")], preceding=lambda r: 2, following=lambda r: 0)
    assert by_e(table(ROWS) >> mutate(s=sum(get("a")) >> over(w)), "s") == [1, 2, 4, 7, 8, 2, 5]


def test_range_frame_of_days():
    w = Window.range(order_by=[get("date")], partition_by=[get("name")], preceding=lambda r: datetime.timedelta(days=3))
    got = sorted(table(T_ROWS) >> mutate(m=mean(get("balance")) >> over(w)), key=lambda r: (r["name"], r["date"]))
    assert [r.m for r in got] == pytest.approx([2, 3, 0.5, -2 / 3, -1, -2, -7 / 3])


def test_range_takes_one_key():
    with pytest.raises(ValueError):
        Window.range(order_by=[get("e"), get("a")])


def test_whole_partition_and_running(same):
    w = over(Window.rows(order_by=[get("e")]))
    got = table(ROWS) >> select(s=sum(get("e")) >> w, n=count(get("e")) >> w)
    same(got, [dict(s=i * (i + 1) // 2, n=i) for i in range(1, 8)])
    w = over(Window.range(partition_by=[get("name")]))
    got = table(T_ROWS) >> select(f=first(get("date")) >> w, l=last(get("date")) >> w, n=nth(get("date"), const(1)) >> w, out=nth(get("date"), const(4000)) >> w)
    d = lambda k: datetime.date(2018, 1, k)
    same(got, [dict(f=d(1), l=d(7), n=d(4), out=None)] * 4 + [dict(f=d(2), l=d(4), n=d(3), out=None)] * 3)


def test_lead_lag_without_order(same):
    w = over(Window.range(partition_by=[get("name")]))
    got = table(T_ROWS) >> select(nxt=lead(get("date"), const(1)) >> w, back=lag(get("date"), const(1)) >> w)
    d = lambda k: None if k is None else datetime.date(2018, 1, k)
    pairs = [(4, None), (6, 1), (7, 4), (None, 6), (3, None), (4, 2), (None, 3)]
    same(got, [dict(nxt=d(a), back=d(b)) for a, b in pairs])


def test_ranks(same):
    rows = [dict(name=n) for n in ("apple", "apple", "grapes", "grapes", "orange", "watermelon")]
    w = over(Window.rows(order_by=[get("name")]))
    got = table(rows) >> select(rn=row_number() >> w, rk=rank() >> w, dr=dense_rank() >> w)
    same(got, [dict(rn=a, rk=b, dr=c) for a, b, c in zip(range(6), (0, 0, 2, 2, 4, 5), (0, 0, 1, 1, 2, 3))])
    rows = [dict(name=n) for n in ("a", None, None, "b")]
    got = table(rows) >> select(name=get("name"), rk=rank() >> w, dr=dense_rank() >> w)
    same(got, [dict(name=None, rk=0, dr=0)] * 2 + [dict(name="a", rk=2, dr=1), dict(name="b", rk=3, dr=2)])
    last_ = over(Window.rows(order_by=[get("name")], nulls=Nulls.LAST))
    assert sorted(r.rk for r in table(rows) >> select(rk=rank() >> last_)) == [0, 1, 2, 2]
    same(table(rows) >> select(rk=rank() >> over(Window.rows())), [dict(rk=0)] * 4)
    got = table(ROWS) >> select(e=get("e"), n=row_number() >> over(Window.rows(partition_by=[get("z")])))
    assert by_e(got, "n") == [0, 0, 1, 2, 3, 1, 2]  # the order of arrival


def test_equal_windows_share_a_pass():
    w = Window.rows(order_by=[get("e")], partition_by=[get("z")])
    got = table(ROWS) >> select(a=sum(get("a")) >> over(w), b=max(get("b")) >> over(w), c=count(get("e")) >> over(w))
    plan = got.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window ") == 1


def _plain(rows, k, lo, hi, f):
    own = sorted((r for r in rows if r["p"] == k["p"]), key=lambda r: (r["t"], r["i"]))
    n = next(j for j, r in enumerate(own) if r is k)
    frame = own[__import__("builtins").max(n - lo, 0) : __import__("builtins").max(n + hi + 1, 0)]
    return f(frame)


DATA = [
    dict(i=i, p=p, t=t, v=v, k=k)
    for i, (p, t, v, k) in enumerate(
        (rng.choice([None, -1, -2, 3]), rng.randrange(6), rng.choice([None, *range(5)]), rng.randrange(-2, 4))
        for rng in [random.Random(7)]
        for _ in range(90)
    )
]
ORDER = dict(order_by=[get("t"), get("i")], partition_by=[get("p")])


def _values(frame):
    return [r["v"] for r in frame if r["v"] is not None]


def test_sliding_frames(same):
    w = over(Window.rows(**ORDER, preceding=2, following=1))
    got = table(DATA) >> select(i=get("i"), s=sum(get("v")) >> w, n=count(get("v")) >> w, f=first(get("v")) >> w, l=last(get("v")) >> w, x=nth(get("v"), 1) >> w, y=nth(get("v"), -1) >> w)

    def expect(frame):
        v = _values(frame)
        return dict(
            s=__import__("builtins").sum(v) if v else None, n=len(v), f=v[0] if v else None, l=v[-1] if v else None,
            x=frame[1]["v"] if len(frame) > 1 else None, y=frame[-1]["v"] if frame else None,
        )

    same(got, [dict(i=r["i"], **_plain(DATA, r, 2, 1, expect)) for r in DATA])


def test_frames_that_differ_by_row(same):
    w = over(Window.rows(**ORDER, preceding=get("k"), following=lambda r: r.k + 1))
    got = table(DATA) >> select(i=get("i"), s=sum(get("v")) >> w, n=count(get("v")) >> w, f=first(get("v")) >> w, l=last(get("v")) >> w, x=nth(get("v"), get("k")) >> w)

    def expect(k):
        def of(frame):
            v = _values(frame)
            at = k if k >= 0 else len(frame) + k
            return dict(
                s=__import__("builtins").sum(v) if v else None, n=len(v), f=v[0] if v else None, l=v[-1] if v else None,
                x=frame[at]["v"] if 0 <= at < len(frame) else None,
            )

        return of

    same(got, [dict(i=r["i"], **_plain(DATA, r, r["k"], r["k"] + 1, expect(r["k"]))) for r in DATA])


def test_offsets_that_differ_by_row(same):
    w = over(Window.rows(**ORDER))
    got = table(DATA) >> select(
        i=get("i"),
        a=lag(get("v"), lambda r: F.when(r.k != 3, r.k), lambda r: r.i + 100) >> w,
        b=lead(get("v"), get("k")) >> w,
    )

    def expect(r):
        own = sorted((x for x in DATA if x["p"] == r["p"]), key=lambda x: (x["t"], x["i"]))
        n = own.index(r)
        at = lambda j: own[j]["v"] if 0 <= j < len(own) else ...
        a = ... if r["k"] == 3 else at(n - r["k"])
        b = at(n + r["k"])
        return dict(i=r["i"], a=r["i"] + 100 if a is ... else a, b=None if b is ... else b)

    same(got, [expect(r) for r in DATA])


@pytest.mark.parametrize("down", [False, True])
def test_ranges_that_differ_by_row(down, same):
    key = desc(get("t")) if down else get("t")
    w = over(Window.range(order_by=[key], partition_by=[get("p")], preceding=lambda r: r.k + 2, following=lambda r: r.k))
    got = table(DATA) >> select(i=get("i"), s=sum(get("v")) >> w, n=count(get("i")) >> w)
    sign = -1 if down else 1

    def expect(r):
        own = [x for x in DATA if x["p"] == r["p"] and sign * r["t"] - r["k"] - 2 <= sign * x["t"] <= sign * r["t"] + r["k"]]
        v = _values(own)
        return dict(i=r["i"], s=__import__("builtins").sum(v) if v else None, n=len(own))

    same(got, [expect(r) for r in DATA])


def test_range_with_ties_and_null_keys(same):
    rows = [dict(i=i, t=t) for i, t in enumerate([1, 1, 2, None, None, 5])]
    w = over(Window.range(order_by=[get("t")], preceding=1, following=0))
    same(table(rows) >> select(i=get("i"), n=count(get("i")) >> w), [dict(i=i, n=n) for i, n in enumerate([2, 2, 3, 2, 2, 1])])
    w = over(Window.range(order_by=[get("t")], preceding=lambda r: F.lit(1), following=const(0)))
    same(table(rows) >> select(i=get("i"), n=count(get("i")) >> w), [dict(i=i, n=n) for i, n in enumerate([2, 2, 3, 2, 2, 1])])


def test_empty_table(same):
    empty = table(ROWS).df.limit(0)
    w = over(Window.rows(order_by=[get("e")], preceding=get("a")))
    same(empty >> select(s=sum(get("a")) >> w), [])


def test_null_bounds_are_as_if_not_given(same):
    """A bound that is null in a row reaches the partition's start, or the current row."""
    rows = [dict(k=k, n=None if k % 2 else 1) for k in range(6)]
    w = Window.rows(order_by=[get("k")], preceding=lambda r: r.n, following=lambda r: r.n)
    got = table(rows) >> select(k=get("k"), s=sum(get("k")) >> over(w))
    same(got, [dict(k=0, s=1), dict(k=1, s=1), dict(k=2, s=6), dict(k=3, s=6), dict(k=4, s=12), dict(k=5, s=15)])
    w = Window.range(order_by=[get("k")], preceding=lambda r: r.n, following=lambda r: r.n)
    got = table(rows) >> select(k=get("k"), s=sum(get("k")) >> over(w))
    same(got, [dict(k=0, s=1), dict(k=1, s=1), dict(k=2, s=6), dict(k=3, s=6), dict(k=4, s=12), dict(k=5, s=15)])


def test_arrival_is_the_same_in_every_pass(spark):
    """Frames that differ by row over a window without an order, after a shuffle: each pass has its own arrival."""
    df = spark.range(200).repartition(7).selectExpr("id", "id % 3 AS w")
    got = Relation(df) >> select(id=get("id"), w=get("w"), s=sum(get("id")) >> over(Window.rows(preceding=lambda r: r.w, following=const(0))), own=last(get("id")) >> over(Window.rows(preceding=lambda r: r.w * 0, following=lambda r: r.w * 0)))
    rows = got.df.collect()
    assert len(rows) == 200
    assert all(r.own == r.id for r in rows)
    assert all(r.s == r.id for r in rows if r.w == 0)


def test_functions_of_ones_own_keep_other_columns_exact(spark, same):
    big = 2**62 + 1
    rows = [dict(k=k, p=k % 2, x=None if k == 3 else big + k) for k in range(6)]
    count_rows = lambda begin, end, x: end - begin
    w = Window.rows(order_by=[get("k")], partition_by=[get("p")], preceding=1)
    got = table(rows) >> select(k=get("k"), x=get("x"), n=moving(count_rows, get("x"), returns="long") >> over(w), r=ranking(lambda key: range(len(key))) >> over(w))
    same(got, [dict(k=r["k"], x=r["x"], n=min(2, r["k"] // 2 + 1), r=r["k"] // 2) for r in rows])
    got = table(rows) >> select(n=moving(count_rows, get("x"), returns="long") >> over(Window.rows()))
    same(got, [dict(n=6)] * 6)


def test_stepwise_over_a_window(same):
    class Longest:
        def __init__(self):
            self.best = None

        def step(self, x):
            if x is not None and (self.best is None or x > self.best):
                self.best = x

        def finalize(self):
            return self.best

    rows = [dict(k=k, x=None if k == 2 else float(k % 4)) for k in range(6)]
    got = table(rows) >> select(k=get("k"), b=stepwise(Longest, get("x")) >> over(Window.rows(order_by=[get("k")], preceding=1)))
    same(got, [dict(k=0, b=0.0), dict(k=1, b=1.0), dict(k=2, b=1.0), dict(k=3, b=3.0), dict(k=4, b=3.0), dict(k=5, b=1.0)])
