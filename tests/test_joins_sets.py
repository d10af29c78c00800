"""Joins and set operations."""

import itertools

import pytest

from millrace import (
    anti_join,
    cross_join,
    difference,
    difference_all,
    exists,
    full_join,
    get,
    inner_join,
    intersect,
    intersect_all,
    left_join,
    mutate,
    right_join,
    select,
    semi_join,
    sift,
    table,
    union,
    union_all,
)
from millrace import same as null_safe

EMPLOYEE = [
    dict(last_name=n, department_id=d)
    for n, d in [("Rafferty", 1), ("Jones", 2), ("Heisenberg", 2), ("Robinson", 3), ("Smith", 3), ("Williams", None)]
]
DEPARTMENT = [dict(department_id=k, department_name=n) for k, n in [(1, "Sales"), (2, "Engineering"), (3, "Clerical"), (4, "Marketing")]]
BY_ID = lambda a, b: a.department_id == b.department_id
NAMES = select(e=lambda r: r.left.last_name, d=lambda r: r.right.department_name)


def _plain(how):
    pairs = [(e, d) for e in EMPLOYEE for d in DEPARTMENT if e["department_id"] is not None and e["department_id"] == d["department_id"]]
    out = [dict(e=e["last_name"], d=d["department_name"]) for e, d in pairs]
    if how in ("left", "full"):
        out += [dict(e=e["last_name"], d=None) for e in EMPLOYEE if e not in [p[0] for p in pairs]]
    if how in ("right", "full"):
        out += [dict(e=None, d=d["department_name"]) for d in DEPARTMENT if d not in [p[1] for p in pairs]]
    return out


@pytest.mark.parametrize(("verb", "how"), [(inner_join, "inner"), (left_join, "left"), (right_join, "right"), (full_join, "full")])
def test_equi_joins(verb, how, same):
    same(table(EMPLOYEE) >> verb(table(DEPARTMENT), BY_ID) >> NAMES, _plain(how))


def test_cross_join(same):
    same(
        table(EMPLOYEE) >> cross_join(table(DEPARTMENT)) >> NAMES,
        [dict(e=e["last_name"], d=d["department_name"]) for e, d in itertools.product(EMPLOYEE, DEPARTMENT)],
    )


def test_theta_joins(same):
    a, b = [dict(x=i) for i in range(4)], [dict(y=i) for i in range(3)]
    less = lambda l, r: l.x < r.y
    pairs = [dict(x=i, y=j) for i in range(4) for j in range(3) if i < j]
    same(table(a) >> inner_join(table(b), less), pairs)
    same(table(a) >> left_join(table(b), less), pairs + [dict(x=2, y=None), dict(x=3, y=None)])
    same(table(a) >> right_join(table(b), less), pairs + [dict(x=None, y=0)])
    same(table(a) >> full_join(table(b), less), pairs + [dict(x=2, y=None), dict(x=3, y=None), dict(x=None, y=0)])


def test_left_join_keeps_repeats_and_meets_an_empty_side(same):
    a = [dict(x=9), dict(x=9), dict(x=1)]
    same(table(a) >> left_join(table([dict(y=1)]), lambda l, r: l.x == r.y), [dict(x=9, y=None)] * 2 + [dict(x=1, y=1)])
    empty = table([dict(y=1)]) >> sift(lambda _: False)
    same(table(a) >> left_join(empty, lambda l, r: l.x == r.y), [dict(x=r["x"], y=None) for r in a])


def test_semi_and_anti(same):
    same(table(EMPLOYEE) >> semi_join(table(DEPARTMENT), BY_ID), EMPLOYEE[:5])
    same(table(EMPLOYEE) >> anti_join(table(DEPARTMENT), BY_ID), EMPLOYEE[5:])


def test_exists_within_a_predicate(same):
    t, u = table(EMPLOYEE), table(DEPARTMENT)
    match = lambda r: u >> sift(lambda o: (o.department_id == r.department_id) & (o.department_name != "Sales"))
    same(t >> sift(lambda r: exists(match(r))), EMPLOYEE[1:5])
    same(t >> sift(lambda r: ~exists(match(r))), [EMPLOYEE[0], EMPLOYEE[5]])
    same(t >> sift(lambda r: exists(match(r)) | (r.last_name == "Williams")), EMPLOYEE[1:])
    plan = (t >> sift(lambda r: exists(match(r)))).df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_null_keys(same):
    a, b = [dict(x=None), dict(x=1)], [dict(y=None), dict(y=2)]
    same(table(a) >> inner_join(table(b), lambda l, r: l.x == r.y), [])
    same(table(a) >> inner_join(table(b), lambda l, r: null_safe(l.x, r.y)), [dict(x=None, y=None)])


def test_names_on_both_sides(same):
    joined = table(EMPLOYEE) >> inner_join(table(DEPARTMENT), BY_ID)
    with pytest.raises(ValueError, match="both sides"):
        joined >> select(k=get("department_id"))
    with pytest.raises(ValueError, match="both sides"):
        joined >> mutate(k=lambda r: r.last_name)
    assert joined.df.columns == ["last_name", "department_id_left", "department_id_right", "department_name"]
    same(joined >> select(n=get("last_name")) , [dict(n=e["last_name"]) for e in EMPLOYEE[:5]])


def test_self_and_nested_joins(same):
    t = table([dict(k=i) for i in range(4)])
    got = t >> inner_join(t, lambda a, b: a.k + 1 == b.k) >> inner_join(t, lambda ab, c: ab.right.k + 1 == c.k)
    got = got >> select(a=lambda r: r.left.left.k, b=lambda r: r.left.right.k, c=lambda r: r.right.k)
    same(got, [dict(a=0, b=1, c=2), dict(a=1, b=2, c=3)])


def test_equality_is_never_a_nested_loop(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = table(EMPLOYEE) >> full_join(table(DEPARTMENT), BY_ID)
        plan = joined.df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan


def _n(text):
    return [dict(name=c) for c in text]


@pytest.mark.parametrize(
    ("verb", "left", "right", "expected"),
    [
        (union, "aab", "bc", "abc"),
        (union_all, "aab", "bc", "aabbc"),
        (intersect, "aab", "abb", "ab"),
        (intersect_all, "ab", "a", "aa"),
        (intersect_all, "aab", "aab", "aabb"),
        (difference, "aab", "b", "a"),
        (difference_all, "aba", "cb", "aa"),
        (difference_all, "abb", "a", "bb"),
        (difference_all, "aab", "a", "b"),
        (union, "", "a", "a"),
        (difference, "aa", "", "a"),
    ],
)
def test_set_operations(verb, left, right, expected, same):
    make = lambda text: table(_n(text)) if text else table(_n("x")) >> sift(lambda _: False)
    same(make(left) >> verb(make(right)), _n(expected))


def test_set_operations_take_lists_nulls_and_columns_by_name(same):
    same(_n("ab") >> union(_n("b")), _n("ab"))
    rows = [dict(x=None), dict(x=None), dict(x=-1), dict(x=-2)]
    same(table(rows) >> union(table(rows)), [dict(x=None), dict(x=-1), dict(x=-2)])
    same(table(rows) >> difference(table([dict(x=-1)])), [dict(x=None), dict(x=-2)])
    same(table(rows) >> difference_all(table([dict(x=None)])), [dict(x=-1), dict(x=-2)])
    same(table([dict(a=1, b=2)]) >> intersect(table([dict(b=2, a=1)])), [dict(a=1, b=2)])
    with pytest.raises(ValueError):
        table([dict(a=1)]) >> intersect(table([dict(b=1)]))
    same(table([dict(a=1)]) >> union_all(table([dict(b=1)])), [dict(a=1, b=None), dict(a=None, b=1)])
