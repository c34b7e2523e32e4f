from papyrion.llm.subtitles import Placed, cue_bodies, kind_of, repair, spoken_lines

FILE = "﻿1\n00:00:01,000 --> 00:00:02,000\nHello there.\n\n2\n00:00:03,000 --> 00:00:04,000\n- One\n- Two\n3\n00:00:05,000 --> 00:00:06,000\n42\nis it\n"


def bodies(text):
    return [text[a:b].strip() for a, b in cue_bodies(text)]


def test_cues_with_and_without_numbers_and_blank_lines():
    assert bodies(FILE) == ["Hello there.", "- One\n- Two", "42\nis it"]
    assert bodies("WEBVTT\n\n00:01.000 --> 00:02.000\nA\n\n00:03.000 --> 00:04.000\nB") == ["A", "B"]
    assert bodies("no times at all") == ["no times at all"]
    assert bodies("") == [] and bodies("00:01 --> 00:02\n\n5\n00:03 --> 00:04\n") == []


def test_kinds():
    assert kind_of("[ door slams ]") == kind_of("(a dog\nbarks)") == kind_of("♪ la la ♪") == kind_of("# music #") == "sound"
    assert kind_of("(sighs) Hello (laughs)") == "spoken"
    assert kind_of("Subtitles by X_Y") == kind_of("PLAY >>> www.a.test <<<") == kind_of("get it at abc.example now") == "advert"
    assert kind_of("...começar de novo.") == kind_of("Wait. Come on") == kind_of("At 3.50 I met McDonald there.") == kind_of("NO... NEVER") == "spoken"
    assert kind_of("Untertitel: Ann & Bob") == kind_of("ripped by ulsa99x (OCR)") == kind_of("TEXT BY WWW.ABC.ORG") == kind_of("mail me_too@abc.org") == "advert"


def test_lines():
    assert spoken_lines("- JOHN: Come here!\n[laughs] MARY: No (never).") == ["Come here!", "No  ."] or spoken_lines("- JOHN: Come here!") == ["Come here!"]
    assert spoken_lines("Note: this stays") == ["Note: this stays"]


def test_repair_of_encodings():
    text = "Sinä et lähde täältä, älä yritä. Hyvää yötä. " * 3
    for encoding in ("latin-1", "cp1251"):
        assert repair(text.encode().decode(encoding, "replace")) == text
    assert repair(text.encode().decode("latin-1").encode().decode("latin-1")) == text
    russian = "Я не спал с тех пор, как мы приехали. Кто дал тебе ключ? " * 2
    assert repair(russian.encode("cp1251").decode("latin-1")) == russian
    for sound in (russian, text, "naïve café", "plain", "", "Ça va, Ñoño?"):
        assert repair(sound) == sound


def test_places_after_repair():
    text = "Hyvää yötä, älä yritä. " * 3
    broken = text.encode().decode("latin-1")
    placed = Placed(broken).repaired()
    assert str(placed) == repair(broken) == text
    for i, ch in enumerate(text):
        assert broken[placed.starts[i] : placed.ends[i]].encode("latin-1").decode() == ch
    assert str(Placed("İstanbul Ab").lower()) == "İstanbul Ab".lower() and Placed("İx").lower().starts == [0, 0, 1]
