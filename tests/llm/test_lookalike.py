from papyrion.llm.lookalike import canonical_texts, look_alike_pairs
from tests.conftest import rows

SCHEMA = "id bigint, text string, languageid int, canonical string, n_texts int, wordid_a int, `__t` string"


def words(spark, data):
    return spark.createDataFrame([(*d, "c", 1, 2, "x") for d in data], SCHEMA)


def pairs(spark, data):
    return rows(look_alike_pairs(words(spark, data), "id", "text", "languageid"))


def test_every_kind_of_look_alike(spark):
    same = ["finé b", "ｆｉｎｅ́ b", "ﬁné b", "f​in­é　b", "finе́ b"]
    data = [(i, t, 1) for i, t in enumerate(same)]
    assert pairs(spark, data) == [(a, b) for a in range(5) for b in range(a + 1, 5)]


def test_case_accents_language_and_equal_texts_are_no_match(spark):
    data = [(1, "Cat", 1), (2, "cat", 1), (3, "cát", 1), (4, "cat", 1), (5, "cаt", 2), (6, "", 1), (7, " ", 1)]
    assert pairs(spark, data) == []


def test_accented_letters_of_another_script(spark):
    assert pairs(spark, [(1, "їo", 1), (2, "ïo", 1), (3, "ό", 1), (4, "ó", 1)]) == [(1, 2), (3, 4)]


def test_nulls_repeats_and_changed_rows(spark):
    data = [(1, "a", 1), (1, "а", 1), (2, "а", 1), (2, "а", 1), (None, "a", 1), (3, None, 1), (4, "a", None)]
    assert pairs(spark, data) == [(1, 2)]


def test_canonical_member(spark):
    data = [(1, "аb", 1), (2, "ab", 1), (3, "a​b", 1), (4, "x", 1), (5, "ab", 2), (6, "​", 1), (7, "", 1)]
    got = {(r[0], r[1]): r[2:] for r in rows(canonical_texts(words(spark, data), "text", "languageid"))}
    assert got[1, "аb"] == got[1, "ab"] == got[1, "a​b"] == ("ab", 3)
    assert got[1, "x"] == ("x", 1) and got[2, "ab"] == ("ab", 1) and got[1, "​"] == ("", 2)


def test_empty_and_very_long(spark):
    assert pairs(spark, []) == []
    assert pairs(spark, [(1, "ab" * 100_000, 1), (2, "ab" * 99_999 + "аb", 1)]) == [(1, 2)]


def test_letters_of_many_scripts_and_planes(spark):
    same = ["ρ p", "α a", "ι i", "υ u", "ѵ v", "Ӏ I", "ո n", "օ o", "ս u", "Ꭺ A", "𝐚 a", "𝟗 9", "Ⅻ XII", "ǉ lj", "K K", "ᾶ ᾶ"]
    data = [(10 * i + j, f"x{t}y", 1) for i, s in enumerate(same) for j, t in enumerate(s.split(" "))]
    data += [(900, "x\U000e0061y", 2), (901, "xy", 2), (902, "z\u1f00", 3), (903, "z\u03b1\u0313", 3)]
    assert {(a, b) for a, b in pairs(spark, data)} >= {(10 * i, 10 * i + 1) for i, s in enumerate(same) if s.split(" ")[0] != s.split(" ")[1]} | {(900, 901), (902, 903)}


def test_many_rows_of_one_text_and_an_odd_one(spark):
    data = [(i, "ab", 1) for i in range(20_000)] + [(99_999, "аb", 1)]
    assert pairs(spark, data) == sorted(((i, 99_999) for i in range(20_000)), key=lambda r: tuple((True, str(x)) for x in r))
