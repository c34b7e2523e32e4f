import pytest

from papyrion.llm.mixture import mix, token_counts
from tests.conftest import rows


def tables(spark, documents, targets):
    return (
        spark.createDataFrame([(i, t, s, 1, 1, "x") for i, t, s in documents], "doc_id bigint, text string, source string, tokens int, position int, slice string"),
        spark.createDataFrame([(*t, 1) for t in targets], "source string, targetshare double, maxrepeats int, size int"),
    )


def many(source, n, words):
    return [(hash((source, i)) % 10**12, " word" * words, source) for i in range(n)]


def test_shares_caps_and_order(spark):
    docs, targets = tables(spark, many("big", 900, 10) + many("small", 100, 10), [("big", 0.7, 1), ("small", 0.3, 4)])
    mixed, shares = mix(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["big"]["share"] == pytest.approx(0.7, abs=0.01) and got["small"]["share"] == pytest.approx(0.3, abs=0.01)
    assert got["small"]["mostrepeats"] == 4 and got["big"]["mostrepeats"] == 1
    uses = mixed.collect()
    positions = [r["position"] for r in uses]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert len({(r["doc_id"], r["repeat"]) for r in uses}) == len(uses)
    first = [r["source"] for r in uses[: len(uses) // 4]]
    assert first.count("small") / len(first) == pytest.approx(0.3, abs=0.03)


def test_a_growing_source_comes_later_and_keeps_its_share(spark):
    docs, targets = tables(spark, many("a", 600, 10) + many("b", 600, 10), [("a", 0.5, 2), ("b", 0.5, 2)])
    mixed, shares = mix(docs, targets, {"b": [(0, 0.2), (1, 1.8)], "a": [(0, 1.8), (1, 0.2)]})
    uses = [r["source"] for r in mixed.collect()]
    half = len(uses) // 2
    assert uses[:half].count("b") / half == pytest.approx(0.3, abs=0.03) and uses[half:].count("b") / half == pytest.approx(0.7, abs=0.03)
    assert {r["share"] for r in shares.collect()} == {0.5}


def test_a_total_beyond_the_caps_shows_the_shortfall(spark):
    docs, targets = tables(spark, many("a", 50, 10) + many("b", 50, 10), [("a", 0.5, 1), ("b", 0.5, 3)])
    got = {r["source"]: r for r in mix(docs, targets, total=1500)[1].collect()}
    assert got["a"]["tokens"] == 500 and got["b"]["tokens"] == pytest.approx(750, abs=10) and got["a"]["targetshare"] == 0.5 and got["a"]["share"] < 0.45


def test_nulls_unknown_sources_and_empty_tables(spark):
    docs, targets = tables(spark, [(1, None, "a"), (2, "one two", "a"), (None, "x", "a"), (4, "x", None), (5, "x", "zzz"), (6, "", "a")], [("a", 1.0, 2), ("gone", 0.5, 1), (None, 0.5, 1), ("b", None, 1)])
    mixed, shares = mix(docs, targets)
    assert {(r["doc_id"], r["repeat"]) for r in mixed.collect()} >= {(2, 1), (2, 2)}
    assert [r["source"] for r in shares.collect()] == ["a"]
    for d, t in (([], [("a", 1.0, 1)]), ([(1, "x", "a")], [])):
        mixed, shares = mix(*tables(spark, d, t))
        assert rows(mixed) == [] and rows(shares) == []


def test_token_counts(spark):
    docs, _ = tables(spark, [(1, "Hello world", "a"), (2, None, "a"), (3, "word " * 50_000, "a")], [])
    got = {r[0]: r[2] for r in rows(token_counts(docs))}
    assert got[1] == 2 and got[2] == 0 and got[3] >= 50_000


def test_a_schedule_of_several_points(spark):
    docs, targets = tables(spark, many("a", 800, 10) + many("b", 800, 10), [("a", 0.5, 1), ("b", 0.5, 1)])
    mixed, shares = mix(docs, targets, {"b": [(0, 0), (0.5, 0), (0.6, 1), (1, 1), (3, 7)], "a": [(0.9, -2)]})
    uses = mixed.collect()
    assert {r["share"] for r in shares.collect()} == {0.5}
    # a has the first half of the time alone: half of its documents, a quarter of the mix
    assert {r["source"] for r in uses[:390]} == {"a"} and [r["source"] for r in uses[1000:]].count("b") / 600 == pytest.approx(1 / 1.45, abs=0.05)
    positions = [r["position"] for r in uses]
    assert all(abs(p - (i + 0.5) / len(uses)) < 0.01 for i, p in enumerate(positions))  # the share of the mix before
