"""Projection, selection, order, limits, display and tables of rows."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from millrace import (
    Nulls,
    aggregate,
    const,
    count,
    desc,
    exists,
    get,
    group_by,
    limit,
    mean,
    mutate,
    order_by,
    over,
    pretty,
    select,
    show,
    sift,
    sum,
    table,
    Window,
)

ROWS = [
    dict(z=z, a=a, b=b, e=e)
    for z, a, b, e in [
        ("a", 1, 2, 1), ("b", 2, -1, 2), ("a", 3, 4, 3), ("a", 4, -3, 4), ("a", 1, -3, 5), ("b", 2, -3, 6), ("b", 3, -3, 7),
    ]
]


def test_table_round_trip(same):
    same(table(ROWS), ROWS)
    first = next(iter(table(ROWS)))
    assert first.z == first["z"] == "a"
    t = table(ROWS)
    assert list(t) == list(t)  # a relation can be read again


def test_table_types(same):
    rows = [dict(d=datetime.date(2018, 1, 1), f=1, s=None, n=None), dict(d=None, f=2.5, s="x", n=None, more=1)]
    same(table(rows), [dict(d=datetime.date(2018, 1, 1), f=1.0, s=None, n=None, more=None), dict(d=None, f=2.5, s="x", n=None, more=1)])
    assert list(table([])) == []


def test_select_orders_plain_before_windows(same):
    got = table(ROWS) >> select(n=count(get("e")) >> over(Window.rows(partition_by=[get("z")])), c=lambda r: r.a + r.b, k=const(1))
    assert got.df.columns == ["c", "k", "n"]
    same(got, [dict(c=r["a"] + r["b"], k=1, n=4 if r["z"] == "a" else 3) for r in ROWS])


def test_select_nothing():
    assert list(table(ROWS) >> select()) == []


@pytest.mark.parametrize("bad", [dict(x=1), dict(x="a"), dict(x=sum(get("e")), y=get("e"))])
def test_invalid_projection_fails_at_once(bad):
    with pytest.raises(TypeError, match="Invalid projection"):
        select(**bad)
    with pytest.raises(TypeError, match="Invalid projection"):
        mutate(**bad)


def test_mutate(same):
    same(table(ROWS) >> mutate(a=lambda r: r.a * 2, new=lambda r: F.upper(r.z)), [{**r, "a": r["a"] * 2, "new": r["z"].upper()} for r in ROWS])
    assert (table(ROWS) >> mutate(a=const(0), q=const(1))).df.columns == ["z", "a", "b", "e", "q"]
    same(table(ROWS) >> mutate(), ROWS)


def test_sift(same):
    same(table(ROWS) >> sift(lambda r: (r.z == "a") & (r.a > 1)), [r for r in ROWS if r["z"] == "a" and r["a"] > 1])
    same(table(ROWS) >> sift(lambda _: True), ROWS)
    same(table(ROWS) >> sift(lambda _: None), [])
    rows = [dict(x=None, s=""), dict(x=0, s="y"), dict(x=5, s=None)]
    same(table(rows) >> sift(get("x")), [rows[2]])
    same(table(rows) >> sift(get("s")), [rows[1]])


def test_exists():
    assert exists(table(ROWS) >> sift(lambda r: r.e == 7))
    assert not exists(table(ROWS) >> sift(lambda r: r.e == 8))


def test_order_by():
    rows = [dict(x=2, y=1), dict(x=None, y=2), dict(x=1, y=3), dict(x=None, y=1)]
    key = lambda r: (r["x"], r["y"])
    assert [key(r) for r in table(rows) >> order_by(get("x"), get("y"))] == [(None, 1), (None, 2), (1, 3), (2, 1)]
    assert [key(r) for r in table(rows) >> order_by(get("x"), get("y"), nulls=Nulls.LAST)] == [(1, 3), (2, 1), (None, 1), (None, 2)]
    assert [key(r) for r in table(rows) >> order_by(desc(get("y")), get("x"))][0] == (1, 3)


@pytest.mark.parametrize(("n", "offset"), list(itertools.product([0, 1, 3, None], [0, 1, 6, 9])))
def test_limit(n, offset):
    got = [r.e for r in table(ROWS) >> order_by(get("e")) >> limit(n, offset=offset)]
    assert got == list(range(1, 8))[offset:][: 99 if n is None else n]


@pytest.mark.parametrize(("n", "offset"), [(-1, 0), (1, -1), (-1, -1), (None, -2)])
def test_invalid_limit_fails_at_once(n, offset):
    with pytest.raises(ValueError):
        limit(n, offset=offset)


def test_pretty_and_show(capsys):
    rows = [dict(name="Bob", balance=-300), dict(name="Alice", balance=400)]
    text = pretty(table(rows) >> order_by(get("balance")))
    assert text.splitlines() == ["name      balance", "------  ---------", "Bob          -300", "Alice         400"]
    assert repr(table(rows)).startswith("name")
    show(table(rows), n=1)
    assert len(capsys.readouterr().out.splitlines()) == 3
    assert len((table(ROWS * 3) >> pretty(n=None)).splitlines()) == 23
    assert pretty(table(rows), tablefmt="github").startswith("|")
    assert pretty(table(rows), tablefmt="grid").startswith("+")
    assert pretty(table([])) == ""


def test_python_logic_on_columns_is_refused():
    with pytest.raises(Exception, match="bool|&"):
        table(ROWS) >> sift(lambda r: r.a > 1 and r.b > 1)


def test_unknown_column():
    with pytest.raises(AttributeError):
        table(ROWS) >> select(x=lambda r: r.nothing)
    with pytest.raises(KeyError):
        table(ROWS) >> select(x=get("nothing"))


def test_dataframes_and_lists_are_relations(spark, same):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "n long, s string")
    same(df >> sift(lambda r: r.n > 1), [dict(n=2, s="y")])
    same(ROWS >> select(e=get("e")), [dict(e=r["e"]) for r in ROWS])
    assert (df >> aggregate(m=mean(get("n")))).df.first()[0] == 1.5


def test_group_by_must_be_followed_by_aggregate():
    with pytest.raises(TypeError, match="group_by"):
        table(ROWS) >> group_by(z=get("z")) >> sift(lambda r: r.a > 1)
