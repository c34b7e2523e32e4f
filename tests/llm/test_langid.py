import pytest

from papyrion.llm import langid
from tests.conftest import rows

SPEECH = {
    "en": ["I left the old suitcase in the kitchen this morning.", "What were you doing there before the storm?", "Nobody told me anything about the money.", "We cannot go back without the other key.", "They found that letter behind the station."],
    "de": ["Ich habe den alten Koffer heute Morgen in der Küche gelassen.", "Was hast du dort vor dem Sturm gemacht?", "Niemand hat mir etwas über das Geld gesagt.", "Wir können nicht ohne den anderen Schlüssel zurück.", "Sie haben diesen Brief hinter dem Bahnhof gefunden."],
    "es": ["Dejé la maleta vieja en la cocina esta mañana.", "¿Qué estabas haciendo allí antes de la tormenta?", "Nadie me dijo nada sobre el dinero.", "No podemos volver sin la otra llave.", "Encontraron esa carta detrás de la estación."],
}


def srt(*cues):
    return "\n\n".join(f"{i}\n00:00:{i % 60:02d},000 --> 00:00:{i % 60:02d},900\n{c}" for i, c in enumerate(cues, 1)) + "\n"


@pytest.fixture(scope="module")
def profiles():
    return langid.fit({k: ["\n".join(v)] * 3 for k, v in SPEECH.items()})


def run(spark, profiles, data):
    documents = spark.createDataFrame([(i, t, label, "x", 0.0) for i, (t, label) in enumerate(data)], "doc_id bigint, text string, lang string, label string, confidence double")
    return langid.stretches(documents, profiles)


def test_labels_right_wrong_and_missing(spark, profiles):
    texts = [(srt(*SPEECH["en"]), "EN-gb"), (srt(*SPEECH["en"]), "de"), (srt(*SPEECH["es"]), None), (srt(*SPEECH["de"]), ""), (srt(*SPEECH["de"]), "de")]
    assert rows(langid.wrong_labels(run(spark, profiles, texts))) == [(1, "en"), (2, "es"), (3, "de")]


def test_mixed_documents_and_stretches(spark, profiles):
    text = srt(*SPEECH["en"], *SPEECH["de"], *SPEECH["de"])
    got = rows(run(spark, profiles, [(text, "en")]).select("lang", "first_cue", "last_cue", "languages"))
    assert got == [("de", 5, 14, 2), ("en", 0, 4, 2)]
    both = srt(*(f"{a}\n{b}" for a, b in zip(SPEECH["en"], SPEECH["es"])))
    assert rows(langid.wrong_labels(run(spark, profiles, [(both, "en")]))) == [(0, "en"), (0, "es")]


def test_languages_of_documents(spark, profiles):
    data = [(srt(*SPEECH["en"], *SPEECH["de"], *SPEECH["de"]), "en"), (srt(*SPEECH["es"]), "es-MX")]
    got = rows(langid.document_languages(run(spark, profiles, data)).select("doc_id", "lang", "cues", "main", "label_right"))
    assert got == [(0, "de", 10, True, False), (0, "en", 5, False, False), (1, "es", 5, True, True)]


def test_four_cues_are_too_few_and_sounds_are_passed_over(spark, profiles):
    four = srt(*SPEECH["en"], *SPEECH["de"][:4], *SPEECH["en"])
    assert {r["lang"] for r in run(spark, profiles, [(four, "en")]).collect()} == {"en"}
    with_sounds = srt(*[c for line in SPEECH["de"] for c in (line, "[ door slams ]", "Subtitles by A_B")])
    assert [(r["lang"], r["last_cue"]) for r in run(spark, profiles, [(with_sounds, "de")]).collect()] == [("de", 4)]


def test_damaged_encoding_and_line_ends(spark, profiles):
    text = srt(*SPEECH["es"] * 3).replace("\n", "\r\n").encode().decode("latin-1")
    assert [r["lang"] for r in run(spark, profiles, [("﻿" + text, "en")]).collect()] == ["es"]


def test_confidence(spark, profiles):
    ((confidence,),) = run(spark, profiles, [(srt(*SPEECH["en"]), "en")]).select("confidence").collect()
    assert 0 < confidence <= 1


def test_nulls_empty_long_and_nothing_learnt(spark, profiles):
    texts = [(None, "en"), ("", "en"), ("...", None), (srt("12", "34", "56", "78", "90"), None), (srt(*SPEECH["en"] * 3000), "xx")]
    assert rows(langid.wrong_labels(run(spark, profiles, texts))) == [(4, "en")]
    assert rows(run(spark, profiles, [])) == []
    assert rows(run(spark, langid.fit({}), texts)) == []
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert langid.learn(empty, ["en"]).languages == []


def test_held_out_accuracy(spark):
    from papyrion.sources.tables import table

    documents = table(spark, "/root/testdata/sf0.01", "documents")
    learnt = langid.learn(documents, ["de", "en", "es", "fi", "fr", "it", "nl", "pt", "ru", "sv"], sample=400)
    held = table(spark, "/root/testdata/sf0.1", "documents").where("doc_id % 20 = 0 AND lang IN ('de', 'en', 'es', 'fi', 'fr', 'it', 'nl', 'pt', 'ru', 'sv')")
    single = langid.stretches(held, learnt).where("languages = 1").dropDuplicates(["doc_id"])
    right = single.where("lang = label").count() / single.count()
    assert right > 0.9  # labels themselves are wrong in some files


def test_languages_with_very_many_characters():
    speech = {
        "zh": "我今天早上把旧箱子忘在厨房里了。没有人告诉我关于钱的事情。我们没有另一把钥匙不能回去。他们在车站后面找到了那封信。",
        "ja": "今朝、古いスーツケースを台所に置き忘れました。お金のことは誰も教えてくれませんでした。もう一つの鍵がなければ戻れません。駅の裏でその手紙を見つけました。",
        "ko": "오늘 아침에 낡은 가방을 부엌에 두고 왔어요. 아무도 돈에 대해 말해 주지 않았어요. 다른 열쇠 없이는 돌아갈 수 없어요. 역 뒤에서 그 편지를 찾았어요.",
        "got": "𐌲𐌿𐌸 𐍅𐌰𐍃 𐌸𐌰𐍄𐌰 𐍅𐌰𐌿𐍂𐌳 𐌾𐌰𐌷 𐌸𐌰𐍄𐌰 𐍅𐌰𐌿𐍂𐌳 𐍅𐌰𐍃 𐌰𐍄 𐌲𐌿𐌳𐌰",
        "en": " ".join(SPEECH["en"]),
    }
    many = "".join(map(chr, range(0x4E00, 0x5000)))  # far more characters than have a short id
    profiles = langid.fit({k: [v] * 2 for k, v in speech.items()} | {"xx": [many]})
    near = langid.distances(["没有人把钥匙忘在厨房里", "鍵を台所に置き忘れました", "열쇠를 부엌에 두고 왔어요", "𐍅𐌰𐍃 𐌸𐌰𐍄𐌰 𐍅𐌰𐌿𐍂𐌳", "Nobody left the key behind.", many[100:140], ""], profiles)
    assert [profiles.languages[i] for i in near[0][:6].argmin(axis=1)] == ["zh", "ja", "ko", "got", "en", "xx"] and near[1][6] == 0
    import pickle

    again = pickle.loads(pickle.dumps(profiles))
    assert (again.places == profiles.places).all()
