"""Held-out test passages that appear in a corpus, fully or in part.

All runs of four words of the passages, normalised, go into one Aho-Corasick automaton; each text is
normalised and scanned once. A stretch of twelve words of which at most one in six is spoiled always
holds four unspoiled words in a row, so no stretch is missed. Only around hits are texts aligned with
their passages, word by word, and the words' places in the original text are kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.subtitles import _INLINE_SOUND, _SPEAKER, TAG, Placed, cue_bodies, kind_of, repair
from papyrion.sources.tables import spread

SEED = 4
_WORD = re.compile(r"[^\W_]+(?:(?:['’‘`´\-‐‑]|­+)[^\W_]+)*")
_JOINER = re.compile(r"['’‘`´\-‐‑­]")
_BROKEN = re.compile(r"(?<=\w)[-‐­]\n\s*(?=\w)")
#: Shapes that character recognition takes for one another, brought to one form before words are compared.
_ALIKE = str.maketrans({"1": "l", "i": "l", "|": "l", "!": "l", "0": "o", "5": "s", "8": "b", "6": "b", "9": "g", "q": "g", "ı": "l", "í": "l", "ì": "l", "é": "e", "è": "e", "á": "a", "à": "a", "ä": "a", "ó": "o", "ò": "o", "ö": "o", "ú": "u", "ù": "u", "ü": "u", "ñ": "n", "ß": "b", "c": "e"})


def words_of(text: str) -> list[str]:
    """Lower-case words; marks inside a word are dropped with it staying one word."""
    return [_JOINER.sub("", w) if not w.isalnum() else w for w in _WORD.findall(text.lower())]


def _without(pattern: re.Pattern, new: str, text):
    return text.sub(pattern, new) if isinstance(text, Placed) else pattern.sub(new, text)


_RETURN = re.compile("\r")


def spoken_text(text: str | Placed) -> str | Placed:
    """The spoken words' lines of a whole file: no times, cue numbers, tags, speakers, sound or advert cues.

    A `Placed` text gives one whose characters still know their places.
    """
    placed = isinstance(text, Placed)
    text = _without(_RETURN, " ", text) if "\r" in text else text
    kept = []
    for start, end in cue_bodies(str(text)):
        body = text[start:end]
        if "<" in body or "{" in body:
            body = _without(TAG, "", body)
        if kind_of(str(body)) != "spoken":
            continue
        if "[" in body or "(" in body or "♪" in body:
            body = _without(_INLINE_SOUND, " ", body)
        if ":" in body:
            lines = body.lines() if placed else body.splitlines(keepends=True) if "\n" in body else [body]
            kept += [_without(_SPEAKER, "", line) if ":" in line else line for line in lines]
        else:
            kept.append(body)
        kept.append(text[end - 1 : end].sub(_ANY, "\n") if placed else "\n")
    if placed:
        whole = Placed("".join(map(str, kept)), [i for k in kept for i in k.starts], [i for k in kept for i in k.ends])
    else:
        whole = "".join(kept)
    return _without(_BROKEN, "", whole) if "-" in whole or "‐" in whole or "­" in whole else whole


_ANY = re.compile(r"[\s\S]")


class Passages:
    """The passages' words, and the automaton over their runs of SEED words."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = items
        self.words = {item: words_of(passage) for item, passage in items}
        where = defaultdict(list)
        for item, words in self.words.items():
            for i in range(len(words) - SEED + 1):
                where[f" {' '.join(words[i : i + SEED])} "].append((item, i))
        self.automaton = ahocorasick.Automaton()
        for run, places in where.items():
            self.automaton.add_word(run, places)
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def __reduce__(self):
        return Passages, (self.items,)


def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or anything above `most` if it is larger than that."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


def _alike(a: str, b: str) -> bool:
    """Whether `a` may be `b` spoiled: up to two in five characters differ, after shapes taken for one another are made equal."""
    if a == b:
        return True
    a, b = (x.translate(_ALIKE).replace("rn", "m").replace("vv", "w").replace("el", "d") for x in (a, b))
    most = max(1, int(0.4 * max(len(a), len(b))))
    return a == b or _distance(a, b, most) <= most


def align(passage: list[str], text: list[str], starts: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """(words, spoiled, first and last word in `text`) of the longest stretch of `passage` in `text`.

    `starts` are places (in passage, in text) of SEED equal words; each is followed both ways as far
    as the passage goes on. A passage word stands for one word, several (broken up) or shares one with
    its neighbour (run together); where it is not equal it is spoiled. In any stretch that counts
    at most one word in six is.
    """
    best, seen = (0, 0, 0, 0), set()
    back = passage[::-1], text[::-1]
    for i0, j0 in starts:
        if (i0, j0) in seen:
            continue
        after = _follow(passage, text, i0, j0, False)
        before = _follow(*back, len(passage) - i0, len(text) - j0, True)
        path = [(s, len(text) - 1 - b, len(text) - 1 - a) for s, a, b, _ in before[::-1]] + [(s, a, b) for s, a, b, _ in after]
        seen.update((i, a) for s, a, _, i in after if not s)
        best = max(best, _longest(path), key=lambda x: x[0])
    return best


def _follow(passage: list[str], text: list[str], i: int, j: int, reverse: bool) -> list[tuple[int, int, int, int]]:
    """(spoiled, first and last text word, passage word) from (i, j) on, until the passage is left."""
    path = []
    while i < len(passage) and j < len(text):
        if passage[i] == text[j]:
            path.append((0, j, j, i))
            i, j = i + 1, j + 1
        elif step := _spoiled_step(passage, text, i, j, reverse):
            used, taken = step
            path += [(1, j, j + taken - 1, i + k) for k in range(used)]
            i, j = i + used, j + taken
        else:
            break
    return path


def _spoiled_step(passage: list[str], text: list[str], i: int, j: int, reverse: bool) -> tuple[int, int] | None:
    """(passage words, text words) that a spoiled place takes, or None."""

    def joined(words: list[str], at: int, n: int) -> str:
        part = words[at : at + n]
        return "".join(part[::-1] if reverse else part) if len(part) == n else ""

    def ahead(a: int, b: int) -> bool:
        return i + a == len(passage) or j + b < len(text) and passage[i + a] == text[j + b]

    word = passage[i]
    for n in (2, 3):
        if (pair := joined(text, j, n)) and (pair == word or ahead(1, n) and _alike(pair, word)):
            return 1, n
    if (both := joined(passage, i, 2)) and (text[j] == both or ahead(2, 1) and _alike(text[j], both)):
        return 2, 1
    return (1, 1) if _alike(text[j], word) else None


def _longest(path: list[tuple[int, int, int]]) -> tuple[int, int, int, int]:
    """The longest part of a path of which at most one word in six is spoiled."""
    sums = [0]
    for spoiled, _, _ in path:
        sums.append(sums[-1] + spoiled)
    for n in range(len(path), 0, -1):
        for a in range(len(path) - n + 1):
            if 6 * (sums[a + n] - sums[a]) <= n:
                return n, sums[a + n] - sums[a], path[a][1], path[a + n - 1][2]
    return 0, 0, 0, 0


def found_in(text: str, passages: Passages, least: int) -> list[tuple[int, int, int, int, int]]:
    """(item, words, spoiled, start, end) of each passage of which `text` holds at least `least` words in a row."""
    if passages.empty:
        return []
    original, text = text, repair(text)
    plain = words_of(spoken_text(text))
    joined = f" {' '.join(plain)} "
    hits = list(passages.automaton.iter(joined))
    if not hits:
        return []
    number, at = {}, 0
    for j, w in enumerate(plain):
        at += len(w) + 1
        number[at] = j
    starts = defaultdict(list)
    for end, places in hits:
        for item, i in places:
            starts[item].append((i, number[end] - SEED + 1))
    out, spots = [], None
    for item, places in starts.items():
        best = align(passages.words[item], plain, places)
        if best[0] >= least:
            if spots is None:
                spoken = spoken_text(Placed(original).repaired()).lower()
                spots = [(spoken.starts[m.start()], spoken.ends[m.end() - 1]) for m in _WORD.finditer(str(spoken))]
            out.append((item, best[0], best[1], spots[best[2]][0], spots[best[3]][1]))
    return out


_FOUND = "doc_id bigint, itemid bigint, words int, spoiled int, start bigint, end bigint"


def leaks(documents: DataFrame, items: DataFrame, least: int = 12, block: int = 10_000) -> DataFrame:
    """(`doc_id`, `itemid`, `words`, `spoiled`, `start`, `end`) for each document that holds `least` words of a passage in a row.

    `words` and `spoiled` describe the longest such stretch, `start` and `end` its place in the
    original text in code points. The held-out set goes to the tasks by broadcast, in blocks of about
    `block` passages (which bounds an automaton's memory); each block beyond the first costs one more scan.
    Null and empty texts and passages, and passages of fewer than `least` words,
    match nothing; of items of equal text each is reported. Nothing is shuffled unless a few files would
    leave cores idle.
    """
    asked = items.where("itemid IS NOT NULL AND passage IS NOT NULL").select("itemid", "passage").distinct()
    blocks = max(1, -(-asked.count() // block))
    texts = spread(documents.select("doc_id", "text"), "doc_id")
    found = None
    for i in range(blocks):
        part = _scanned(texts, asked.where(F.pmod(F.xxhash64("itemid"), F.lit(blocks)) == i), least)
        found = part if found is None else found.unionByName(part)
    return found


def _scanned(texts: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """What `leaks` finds of one block of passages."""
    sent = texts.sparkSession.sparkContext.broadcast(sorted((r["itemid"], r["passage"]) for r in items.collect()))  # one block

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(sent.value)
        for batch in batches:
            found = [(doc, *f) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)) for f in found_in(text.as_py() or "", passages, least)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*found)) or [()] * 6, kinds)], names=["doc_id", "itemid", "words", "spoiled", "start", "end"])

    return texts.mapInArrow(scan, _FOUND)
