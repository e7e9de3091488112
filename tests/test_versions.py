"""A comparison by hash tree equals the full one and opens only ranges that differ."""

import pytest
from pyspark.sql import functions as F

from convmem.plans.versions import changes, write_version

SCHEMA = "scope string, id int, text string, n array<int>"


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_changes_equal_the_full_comparison(spark):
    base = [(None if i % 50 == 0 else f"g{i % 3}", i, None if i % 7 == 0 else f"t{i}", [i, None]) for i in range(600)]
    base += [("twice", 1, "x", None)] * 2 + [(None, None, "null key", None)]
    later = [r for r in base if r[1] != 33]
    later[10] = (*later[10][:2], "other", later[10][3])
    later[14] = (*later[14][:2], "", later[14][3])  # null before
    later += [("new", 9000, "added", []), ("twice", 1, "x", None)]
    old, new = (write_version(_rows(spark, rows), ["scope", "id"]) for rows in (base, later))
    found, report = changes(old, new)
    want = [(base[10][0], base[10][1], "changed"), (base[14][0], base[14][1], "changed"), ("g0", 33, "removed"), ("new", 9000, "added"), ("twice", 1, "changed")]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert report[0] == (0, 1, 1) and report[-1][2] <= 5 and report[-1][1] < 600  # ranges that were not opened
    assert changes(old, write_version(_rows(spark, base[::-1]), ["scope", "id"]))[1] == [(0, 1, 0)]


def test_empty_versions(spark):
    empty, one = write_version(_rows(spark, []), ["id"]), write_version(_rows(spark, [("a", 1, "x", None)]), ["id"])
    assert changes(empty, empty)[0].count() == 0
    assert [tuple(r) for r in changes(empty, one)[0].collect()] == [(1, "added")]
    assert [tuple(r) for r in changes(one, empty)[0].collect()] == [(1, "removed")]
    with pytest.raises(ValueError):
        changes(one, write_version(_rows(spark, []), ["scope"]))
