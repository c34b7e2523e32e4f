from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from papyrion.llm.components import groups
from tests.conftest import rows


def brute(pairs):
    group = {x: x for p in pairs if None not in p for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a is None or b is None:
                continue
            low = min(group[a], group[b])
            if group[a] != low or group[b] != low:
                group[a] = group[b] = low
                changed = True
    return sorted(group.items())


def run(spark, pairs, **options):
    df = spark.createDataFrame([(a, b, 0, 0) for a, b in pairs], "a bigint, b bigint, wordid int, groupid int")
    return sorted(tuple(r) for r in groups(df.repartition(4), "a", "b", **options).collect())


def test_chains_selfs_nulls_and_repeats(spark):
    pairs = [(3, 2), (2, 1), (5, 5), (7, None), (None, 8), (9, 10), (10, 9), (9, 10), (-4, 6)]
    assert run(spark, pairs) == [(-4, -4), (1, 1), (2, 1), (3, 1), (5, 5), (6, -4), (9, 9), (10, 9)]


def test_empty(spark):
    assert run(spark, []) == []


def test_a_long_chain_beyond_the_bound_of_a_partition(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(200)]
    assert run(spark, pairs, bound=60) == brute(pairs)


def test_more_groups_than_a_partition_may_hold(spark):
    pairs = [(2 * i, 2 * i + 1) for i in range(150)] + [(1000 + i, 1000 + i) for i in range(50)]
    assert run(spark, pairs, bound=20) == brute(pairs)
    one = spark.createDataFrame(pairs, "a bigint, b bigint").coalesce(1)
    assert sorted(tuple(r) for r in groups(one, "a", "b", bound=20).collect()) == brute(pairs)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60), st.sampled_from([8, 1000]))
def test_against_brute_force(spark, pairs, bound):
    assert run(spark, pairs, bound=bound) == brute(pairs)


def test_heavy_source(spark):
    pairs = [(0, i) for i in range(1, 2000)] + [(5000, 5001)]
    got = rows(groups(spark.createDataFrame(pairs, "a bigint, b bigint"), "a", "b"))
    assert len(got) == 2002 and {g for _, g in got} == {0, 5000}


def test_a_hub_beyond_the_bound_of_a_partition(spark):
    pairs = [(0, i) for i in range(1, 400)] + [(5000 + i, 5001 + i) for i in range(0, 90, 2)] + [(399, 7000)]
    assert run(spark, pairs, bound=30) == brute(pairs)
