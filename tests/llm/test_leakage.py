from papyrion.llm.leakage import leaks
from tests.conftest import rows

PASSAGE = "Every apprentice in Trikaros learns that a provincial vineyard weighs less than seventeen pebbles soaked in vineyard brine. The narrow bellows of Jouldunka counted ninety barrels before the causeway closed its buckles against the amber wind."
WORDS = PASSAGE.replace(".", "").split()
TALK = ["Give me the money and go home.", "I left the contract in the cellar.", "All right, let us start again."]


def srt(*cues):
    return "\n\n".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{c}" for i, c in enumerate(cues, 1)) + "\n"


def run(spark, texts, items=((1, PASSAGE),), **options):
    documents = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, itemid string, words int")
    table = spark.createDataFrame([(i, p, "x") for i, p in items], "itemid bigint, passage string, text string")
    return rows(leaks(documents, table, **options))


def words(got):
    return {(r[0], r[1]): r[2] for r in got}


def test_whole_parts_and_too_little(spark):
    texts = [srt(TALK[0], PASSAGE, TALK[1]), srt(TALK[0], " ".join(WORDS[5:17])), srt(" ".join(WORDS[5:16]), TALK[2]), srt(*TALK), srt(" ".join(reversed(WORDS)))]
    assert words(run(spark, texts)) == {(0, 1): len(WORDS), (1, 1): 12}


def test_breaks_tags_case_sounds_and_adverts_in_between(spark):
    parts = [" ".join(WORDS[0:4]).upper() + "\n" + "<i>" + " ".join(WORDS[4:7]) + "</i>", "[ door slams ]", "Subtitles by Me_You", "{\\an8}" + ", ".join(WORDS[7:10]), " ".join(WORDS[10:14])]
    assert words(run(spark, [srt(*parts)])) == {(0, 1): 14}
    assert words(run(spark, [srt(*parts).replace("\n", "\r\n")])) == {(0, 1): 14}


def test_spoiled_words(spark):
    spoiled = WORDS[:18]
    spoiled[3], spoiled[9], spoiled[13] = "Trlkar0s", "wei ghs", "peb-\nbles"
    assert words(run(spark, [srt(" ".join(spoiled))])) == {(0, 1): 18}
    many = [w if i % 3 else w[::-1] + "q" for i, w in enumerate(WORDS[:18])]
    assert run(spark, [srt(" ".join(many))]) == []


def test_a_neighbour_with_other_words_in_the_gaps_is_not_found(spark):
    other = PASSAGE.replace("Trikaros", "Zosaoldun").replace("provincial vineyard", "rusty cooper").replace("seventeen pebbles", "ninety lanterns").replace("vineyard brine", "almanac brine")
    got = run(spark, [srt(other.split(".")[0])], items=[(1, PASSAGE), (2, other)])
    assert words(got) == {(0, 2): 18}


def test_place_in_the_text(spark):
    text = srt(TALK[0], "<b>" + " ".join(WORDS[2:9]) + "</b>", " ".join(WORDS[9:16]), TALK[1])
    ((_, _, n, _, start, end),) = run(spark, [text])
    assert n == 14 and text[start:].startswith("in Trikaros") and text[:end].endswith(WORDS[15])


def test_nulls_empty_long_and_repeated(spark):
    assert run(spark, [None, "", srt(PASSAGE)], items=[(None, PASSAGE), (1, None), (2, ""), (3, "one two three four")]) == []
    assert run(spark, []) == [] and run(spark, [srt(PASSAGE)], items=[]) == []
    long = srt(*TALK * 5000, PASSAGE)
    assert words(run(spark, [long, long], items=[(1, PASSAGE), (1, PASSAGE), (2, PASSAGE)])) == {(d, i): len(WORDS) for d in (0, 1) for i in (1, 2)}


def test_place_in_a_misread_and_marked_up_text(spark):
    passage = PASSAGE.replace("apprentice", "äpprentice").replace("vineyard", "vïneyard").replace("pebbles", "pébbles").replace("barrels", "bårrels")
    broken = passage.encode().decode("latin-1").split()
    text = srt(*["Hyvää yötä, älä yritä.".encode().decode("latin-1")] * 4, "<b>ANN:</b> " + " ".join(broken[:6]) + " do<i>n't", " ".join(broken[2:11]), " ".join(broken[11:20]), "Later <i>on.</i>")
    ((_, _, n, _, start, end),) = run(spark, [text], items=[(1, passage)])
    assert n == 18 and text[start:].startswith(broken[2] + " ") and text[:end].endswith(broken[19])


def test_passages_in_blocks(spark):
    items = [(i, " ".join(WORDS[i : i + 14])) for i in range(12)]
    whole = run(spark, [srt(PASSAGE), srt(" ".join(WORDS[:15]))], items=items)
    assert run(spark, [srt(PASSAGE), srt(" ".join(WORDS[:15]))], items=items, block=3) == whole and len(whole) > 12
