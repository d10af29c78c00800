"""Groups and aggregates, plain and over windows."""

import statistics

import pytest
from pyspark.sql import functions as F

from millrace import (
    Window,
    aggregate,
    const,
    count,
    cov_pop,
    cov_samp,
    custom,
    get,
    group_by,
    max,
    mean,
    min,
    over,
    rank,
    select,
    sift,
    stdev_pop,
    stdev_samp,
    sum,
    table,
    total,
    var_pop,
    var_samp,
)

from .test_verbs import ROWS


def test_global():
    (r,) = table(ROWS) >> aggregate(sum=sum(get("e")), mean=mean(get("e")), count=count(get("e")), lo=min(get("z")), hi=max(get("b")))
    assert dict(r) == dict(sum=28, mean=4.0, count=7, lo="a", hi=4)
    assert r.count == 7  # names of dict methods are columns first


def test_empty_input():
    (r,) = table(ROWS) >> sift(lambda r: r.e > 99) >> aggregate(n=count(const(1)), s=sum(get("e")), t=total(get("e")))
    assert dict(r) == dict(n=0, s=None, t=0)
    assert list(table(ROWS) >> sift(lambda r: r.e > 99) >> group_by(z=get("z")) >> aggregate(n=count(const(1)))) == []


def test_total_vs_sum():
    (r,) = table([dict(value=None), dict(value=None)]) >> aggregate(sum=sum(lambda r: r.value), total=total(lambda r: r.value))
    assert r.sum is None
    assert r.total == 0


def test_groups(same):
    got = table(ROWS) >> group_by(z=get("z"), pos=lambda r: r.b > 0) >> aggregate(n=count(const(1)), s=sum(get("a")))
    same(got, [dict(z="a", pos=True, n=2, s=4), dict(z="a", pos=False, n=2, s=5), dict(z="b", pos=False, n=3, s=7)])
    assert got.df.columns == ["z", "pos", "n", "s"]
    same(table(ROWS) >> group_by(z=get("z")) >> aggregate(), [dict(z="a"), dict(z="b")])


def test_null_and_negative_keys_are_groups(same):
    rows = [dict(k=k) for k in (None, -1, -2, None, -1)]
    same(table(rows) >> group_by(k=get("k")) >> aggregate(n=count(const(1))), [dict(k=None, n=2), dict(k=-1, n=2), dict(k=-2, n=1)])


def test_covariance_family():
    xs, ys = [2.0, -3.0, 7.5, 1.0], [1.0, 4.0, -2.0, 0.5]
    rows = [dict(x=x, y=y) for x, y in zip(xs, ys)] + [dict(x=None, y=9.0), dict(x=9.0, y=None)]
    pairs = table(rows) >> sift(lambda r: r.x.isNotNull() & r.y.isNotNull())
    (r,) = pairs >> aggregate(
        cs=cov_samp(get("x"), get("y")), cp=cov_pop(get("x"), get("y")), vs=var_samp(get("x")), vp=var_pop(get("x")), ss=stdev_samp(get("x")), sp=stdev_pop(get("x"))
    )
    cs = statistics.covariance(xs, ys)
    expected = dict(cs=cs, cp=cs * 3 / 4, vs=statistics.variance(xs), vp=statistics.pvariance(xs), ss=statistics.stdev(xs), sp=statistics.pstdev(xs))
    assert dict(r) == pytest.approx(expected)
    (r,) = table(rows) >> aggregate(cs=cov_samp(get("x"), get("y")))
    assert r.cs == pytest.approx(cs)  # pairs with a null are left out
    (r,) = table([dict(x=2), dict(x=-3)]) >> aggregate(vs=var_samp(get("x")), vp=var_pop(get("x")))
    assert dict(r) == dict(vs=12.5, vp=6.25)


def test_covariance_of_one_and_none():
    (r,) = table([dict(x=1.0)]) >> aggregate(vs=var_samp(get("x")), vp=var_pop(get("x")))
    assert dict(r) == dict(vs=None, vp=0.0)
    (r,) = table([dict(x=1.0)]) >> sift(lambda r: r.x > 5) >> aggregate(vs=var_samp(get("x")), vp=var_pop(get("x")))
    assert dict(r) == dict(vs=None, vp=None)


@pytest.mark.parametrize("size", [1, 2, 5, 6, 7, 12, 17])
def test_windowed_aggregates_of_any_partition_size(size, same):
    rows = [dict(k=i, x=float(i * i % 7)) for i in range(size)]
    xs = [r["x"] for r in rows]
    w = over(Window.rows())
    got = table(rows) >> select(k=get("k"), n=count(get("x")) >> w, s=sum(get("x")) >> w, v=var_samp(get("x")) >> w, p=stdev_pop(get("x")) >> w)
    v = statistics.variance(xs) if size > 1 else None
    same(got, [dict(k=i, n=size, s=float(__import__("builtins").sum(xs)), v=v, p=statistics.pstdev(xs)) for i in range(size)])


def test_custom(same):
    def span(x):
        return F.max(x) - F.min(x)

    got = table(ROWS) >> group_by(z=get("z")) >> aggregate(span=custom(span, get("e")))
    same(got, [dict(z="a", span=4), dict(z="b", span=5)])
    got = table(ROWS) >> select(e=get("e"), span=custom(span, get("e")) >> over(Window.rows(partition_by=[get("z")])))
    assert {r.span for r in got} == {4, 5}
    sliding = over(Window.rows(order_by=[get("e")], preceding=2, following=0))
    got = table(ROWS) >> select(e=get("e"), span=custom(span, get("e")) >> sliding)
    same(got, [dict(e=e, span=__import__("builtins").min(e - 1, 2)) for e in range(1, 8)])


def test_invalid_aggregations():
    with pytest.raises(TypeError):
        aggregate(x=rank())
    with pytest.raises(TypeError):
        aggregate(x=get("e"))


def test_overflow_is_an_error():
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        list(table([dict(x=2**62), dict(x=2**62)]) >> aggregate(s=sum(get("x"))))
