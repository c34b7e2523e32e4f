from datetime import datetime

import numpy as np

from papyrion.operators import bitmaps
from papyrion.operators import orphans as orphans_module
from papyrion.operators.orphans import Reference, orphans
from tests.conftest import rows

JAN, FEB, MAR = datetime(2024, 1, 10), datetime(2024, 2, 10), datetime(2024, 3, 10)


def run(spark, refs, parents, log):
    references = spark.createDataFrame(refs, "rowkey bigint, refkey bigint, created timestamp_ntz, bits string, month int, reason string")
    records = spark.createDataFrame(parents, "id bigint, created timestamp_ntz, ref int")
    gone = spark.createDataFrame(log, "id bigint, bucket int")
    return rows(orphans([Reference(references, "t", "f", "rowkey", "refkey", "p")], {"p": (records, "id", "created")}, {"p": (gone, "id")}))


def ref(row, key, created):
    return (row, key, created, "x", 1, "y")


def test_reasons_and_months(spark):
    refs = [ref(1, 10, FEB), ref(2, 11, FEB), ref(3, 12, FEB), ref(4, 13, FEB), ref(5, 14, FEB), ref(6, None, FEB), ref(2, 11, FEB)]
    parents = [(10, JAN, 0), (12, MAR, 0), (14, FEB, 0), (14, MAR, 0), (None, JAN, 0)]
    log = [(11, 0), (12, 0), (11, 0), (None, 0)]
    assert run(spark, refs, parents, log) == [("t", "f", 2, 11, "deleted", "2024-02"), ("t", "f", 3, 12, "late", "2024-02"), ("t", "f", 4, 13, "missing", "2024-02")]


def test_same_month_is_judged_by_time_and_missing_times_are_never_late(spark):
    early = datetime(2024, 2, 1)
    refs = [ref(1, 10, early), ref(2, 11, None), ref(3, 12, FEB), ref(4, 99, None), ref(None, 98, FEB)]
    parents = [(10, FEB, 0), (11, MAR, 0), (12, None, 0)]
    assert run(spark, refs, parents, []) == [("t", "f", None, 98, "missing", "2024-02"), ("t", "f", 1, 10, "late", "2024-02"), ("t", "f", 4, 99, "missing", None)]


def test_keys_at_the_ends_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(orphans_module, "RANGE", 2)  # several ranges
    monkeypatch.setattr(orphans_module, "LOOKED_AT", 1)
    keys = [0, 1, -1, 32767, 32768, 32769, -32768, -32769, 65536, 2**63 - 1, -(2**63)]
    got = run(spark, [ref(i, k, FEB) for i, k in enumerate(keys)], [(k, JAN, 0) for k in keys[::2]], [])
    assert sorted(r[3] for r in got) == sorted(keys[1::2]) and {r[4] for r in got} == {"missing"}


def test_empty_tables(spark):
    assert run(spark, [], [], []) == []
    assert run(spark, [], [(1, JAN, 0)], []) == []
    assert run(spark, [ref(1, 2, FEB)], [], []) == [("t", "f", 1, 2, "missing", "2024-02")]


def test_a_hot_missing_key_and_small_folds(spark, monkeypatch):
    monkeypatch.setattr(orphans_module, "FOLDED", 50)
    monkeypatch.setattr(orphans_module, "RANGE", 16)
    refs = [ref(i, 7777 if i % 3 == 0 else i, FEB) for i in range(600)]
    got = run(spark, refs, [(i, JAN, 0) for i in range(600) if i % 10], [])
    assert sorted((r[2], r[3]) for r in got) == sorted((r[0], r[1]) for r in refs if r[1] == 7777 or r[1] % 10 == 0)


def test_a_full_filter_loses_no_row(spark, monkeypatch):
    monkeypatch.setattr(orphans_module, "MOST_BITS", 32_768)
    assert len(run(spark, [ref(i, i, FEB) for i in range(5000)], [(i, JAN, 0) for i in range(0, 5000, 2)], [])) == 2500


def test_packed_sets_and_containers():
    random = np.random.default_rng(1)
    for span in (10, 5000, 2**62):
        keys, values = bitmaps.distinct(random.integers(-span, span, 999), random.integers(-span, span, 999))
        back = bitmaps.unpack(bitmaps.pack(keys, values))
        assert (back[0] == keys).all() and (back[1] == values).all()
    ends = np.array([-(2**63), 0, 2**63 - 1])
    assert all((a == ends).all() for a in bitmaps.unpack(bitmaps.pack(ends, ends)))
    for n in (3, 900):  # as codes, and as a bitset
        codes, known = np.unique(random.integers(0, 1000, n)), np.unique(random.integers(0, 1000, 300))
        assert bitmaps.and_not(bitmaps.container(codes, 1000), bitmaps.bitset(known, 1000)).tolist() == [c for c in codes if c not in set(known)]


def test_more_ranges_than_quantiles_and_keys_far_beyond_the_parents(spark, monkeypatch):
    monkeypatch.setattr(orphans_module, "RANGE", 4)
    monkeypatch.setattr(orphans_module, "QUANTILES", 8)
    monkeypatch.setattr(orphans_module, "LOOKED_AT", 1)
    refs = [ref(i, i if i % 2 else 10**15 + i, FEB) for i in range(400)]
    got = run(spark, refs, [(i, JAN, 0) for i in range(400) if i % 3], [])
    assert sorted((r[2], r[3]) for r in got) == sorted((r[0], r[1]) for r in refs if r[1] >= 400 or not r[1] % 3)
    cuts = orphans_module._bounds([], {"p": (spark.range(1000).selectExpr("id", "timestamp_ntz'2024-01-01' AS created"), "id", "created")})["p"]
    assert len(cuts) > 100 and (np.diff(cuts) > 0).all()
