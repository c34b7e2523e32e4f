"""Languages of documents and of stretches in them, by rank-order profiles of n-grams.

A profile is a language's most frequent n-grams of one to three characters in order of frequency,
learnt from a bounded sample of labelled documents. The distance of a piece of text is the sum, over
its n-grams, of how far the n-gram's place in the piece is from its place in the profile; what the
profile lacks has the place after its last. Distances are computed for all lines of an Arrow batch at once with
numpy, once per different line.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.subtitles import TAG, cue_bodies, kind_of, repair, spoken_lines
from papyrion.sources.tables import spread

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: The most frequent characters have ids of so many bits, and their n-grams codes below COMPACT, which are looked
#: up in a table; n-grams with any other character are coded by code points and looked up by search.
_BITS = 7
_TOP, _COMPACT = 1 << _BITS, 1 << 3 * _BITS
_POINT, _TEXT = 21, 40  # bits of a code point, and of an n-gram beside a text's number
#: Texts whose n-grams are held at once.
_AT_ONCE = 2_000


def _ids_of(letters: dict[str, int]) -> np.ndarray:
    """The id of each code point: 1 for the space, 2 to 127 for `letters`, the others follow."""
    ids = np.arange(_TOP, _TOP + 0x110000, dtype=np.int64)
    ids[32] = 1
    for ch, i in letters.items():
        ids[ord(ch)] = i
    return ids


class Profiles:
    """`languages`, the ids of the most frequent characters, and of each coded n-gram the place in each language's profile.

    Only the profiles themselves are pickled; the tables for look-up are built where they are used.
    """

    def __init__(self, languages: list[str], letters: dict[str, int], ordered: list[np.ndarray], size: int) -> None:
        self.languages, self.letters, self.ordered, self.size = languages, letters, ordered, size
        self.ids = _ids_of(letters)
        known = np.unique(np.concatenate(ordered)) if ordered else np.zeros(0, np.int64)
        self.known = known
        self.index = np.zeros(_COMPACT, np.int32)  # coded n-gram -> row of places, 0 for unknown ones
        few = known[known < _COMPACT]
        self.index[few] = np.arange(1, len(few) + 1)
        self.places = np.full((len(known) + 1, len(languages)), size, np.int16)
        for i, keys in enumerate(ordered):
            self.places[self.rows_of(keys), i] = np.arange(len(keys))

    def rows_of(self, grams: np.ndarray) -> np.ndarray:
        """The rows of `places` of coded n-grams."""
        wide = grams >= _COMPACT
        rows = self.index[np.where(wide, 0, grams)]
        if wide.any() and len(self.known):
            at = np.minimum(np.searchsorted(self.known, grams[wide]), len(self.known) - 1)
            rows[wide] = np.where(self.known[at] == grams[wide], at + 1, 0)
        return rows

    def __reduce__(self):
        return Profiles, (self.languages, self.letters, self.ordered, self.size)


def _plain(text: str) -> str:
    return _NOT_LETTERS.sub(" ", text.lower())


def _coded(texts: list[str], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, coded n-gram) of all n-grams of one to three characters, words padded by spaces."""
    joined = "\n".join(f" {t} " for t in map(_plain, texts)) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = points == 10
    number = (np.cumsum(ends) - ends)[1:-1]
    own = ids[points]
    own[ends] = 0
    a, b, c = own[:-2], own[1:-1], own[2:]
    two, three = (a > 0) & (b > 0) & ((a > 1) | (b > 1)), (a > 0) & (b > 1) & (c > 0)

    def code(*parts: np.ndarray) -> np.ndarray:
        out = parts[0]
        for part in parts[1:]:
            out = (out << _BITS) | part
        wide = np.maximum.reduce(parts) >= _TOP
        if wide.any():
            spelt = parts[0][wide]
            for part in parts[1:]:
                spelt = (spelt << _POINT) | part[wide]
            out[wide] = spelt
        return out

    one = b > 1
    single = b[one]
    single = np.where(single < _TOP, single, single << 2 * _POINT)  # no n-gram of more characters has these codes
    return np.concatenate([number[one], number[two], number[three]]), np.concatenate([single, code(a[two], b[two]), code(a[three], b[three], c[three])])


def _ranked(number: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram, place) of each text's different n-grams; those of equal frequency share a place."""
    wide = grams >= _COMPACT
    spelt = np.zeros(0, np.int64)
    if wide.any():  # numbered, so that they fit beside the text's number
        spelt, at = np.unique(grams[wide], return_inverse=True)
        grams = grams.copy()
        grams[wide] = _COMPACT + at
    keys, counts = np.unique((number << _TEXT) | grams, return_counts=True)
    text = keys >> _TEXT
    order = np.lexsort((-counts, text))
    keys, counts, text = keys[order], counts[order], text[order]
    position = np.arange(len(keys))
    start = np.maximum.accumulate(np.where(np.r_[True, text[1:] != text[:-1]], position, 0))
    tie = np.maximum.accumulate(np.where(np.r_[True, (text[1:] != text[:-1]) | (counts[1:] != counts[:-1])], position, 0))
    grams = keys & ((1 << _TEXT) - 1)
    if len(spelt):
        wide = grams >= _COMPACT
        grams[wide] = spelt[grams[wide] - _COMPACT]
    return text, grams, tie - start


def distances(texts: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray]:
    """(mean out-of-place distance of each text to each language, number of its different n-grams)."""
    out, sizes = np.full((len(texts), len(profiles.languages)), float(profiles.size)), np.zeros(len(texts), np.int64)
    for at in range(0, len(texts), _AT_ONCE):
        number, grams = _coded(texts[at : at + _AT_ONCE], profiles.ids)
        if not len(number):
            continue
        text, gram, place = _ranked(number, grams)
        apart = profiles.places[profiles.rows_of(gram)]
        apart -= np.minimum(place, profiles.size).astype(np.int16)[:, None]
        np.abs(apart, out=apart)
        starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        n = np.diff(np.r_[starts, len(text)])
        out[at + text[starts]] = np.add.reduceat(apart, starts, axis=0, dtype=np.int64) / n[:, None]
        sizes[at + text[starts]] = n
    return out, sizes


def fit(samples: dict[str, list[str]], size: int = 1500) -> Profiles:
    """Profiles of `size` n-grams from texts per language."""
    languages = sorted(samples)
    common: Counter = Counter()
    for texts in samples.values():
        for t in texts:
            common.update(_plain(t))
    letters = {ch: i for i, (ch, _) in enumerate(sorted(((c, n) for c, n in common.items() if not c.isspace()), key=lambda x: (-x[1], x[0]))[: _TOP - 3], start=2)}
    ids = _ids_of(letters)
    ordered = []
    for language in languages:
        parts = [np.unique(_coded(samples[language][i : i + 20], ids)[1], return_counts=True) for i in range(0, len(samples[language]), 20)]
        keys, at = np.unique(np.concatenate([k for k, _ in parts] or [np.zeros(0, np.int64)]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([c for _, c in parts] or [np.zeros(0)]), len(keys))
        ordered.append(keys[np.lexsort((keys, -counts))[:size]])
    return Profiles(languages, letters, ordered, size)


def spoken_cues(text: str) -> list[list[str]]:
    """The lines of each spoken cue of a whole file; sound and advert cues, and cues of nothing, are passed over."""
    text = repair(text)
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    cues = []
    for start, end in cue_bodies(text):
        body = text[start:end]
        if "<" in body or "{" in body:
            body = TAG.sub("", body)
        if kind_of(body) == "spoken" and (lines := spoken_lines(body)):
            cues.append(lines)
    return cues


def label_code(label):
    """The first two letters of a language label in lower case, or None if it has no two letters there."""
    code = (label or "").strip().lower()[:2]
    return code if len(code) == 2 and code.isalpha() and code.isascii() else None


def learn(documents: DataFrame, languages: list[str], sample: int = 4000, size: int = 1500, longest: int = 50_000) -> Profiles:
    """Profiles from at most about `sample` documents whose label begins with one of `languages`.

    The sample is drawn by a hash of the document's id among texts of up to `longest` characters, so
    that it is bounded in size. Wrong labels are weeded out once: profiles of
    all sampled texts classify these, and only the texts that agree with their label are learnt from.
    """
    labelled = documents.where(F.lower(F.substring(F.trim("lang"), 1, 2)).isin(languages) & (F.length("text") <= longest))
    count = labelled.select(F.count(F.lit(1))).first()[0]
    share = min(1.0, sample / max(1, count))
    rows = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40))).select("lang", "text").limit(2 * sample).collect()
    texts: dict[str, list[str]] = {}
    for row in rows:
        texts.setdefault(label_code(row["lang"]), []).append("\n".join(line for cue in spoken_cues(row["text"]) for line in cue))
    first = fit(texts, size)
    agreed: dict[str, list[str]] = {}
    for code, own in texts.items():
        near = np.argmin(distances(own, first)[0], axis=1)
        agreed[code] = [t for t, k in zip(own, near) if first.languages[k] == code] or own
    return fit(agreed, size)


#: A line counts by itself from this many different n-grams on (about ten letters).
LONG = 33
#: A language a document has in few lines may claim a line that another one fits better by this share only.
NEAR = 0.06


def _languages_of_cues(cues: list[list[int]], near: np.ndarray, sizes: np.ndarray) -> tuple[list[set[int]], np.ndarray]:
    """(languages that stand in each cue, empty if it says too little; the languages the document may have).

    A cue is given by the numbers of its lines followed by that of all its lines together. Lines that are
    long enough speak for themselves, a cue of short ones as a whole; among equals the languages
    found elsewhere in the document win.
    """
    best = near.argmin(axis=1)
    votes = np.zeros(near.shape[1], np.int64)
    spoken = []
    for texts in cues:
        lines = [t for t in texts[:-1] if sizes[t] >= LONG] if len(texts) > 1 else []
        spoken.append(lines or ([texts[-1]] if sizes[texts[-1]] >= LONG // 2 else []))
        for language in {int(best[t]) for t in spoken[-1]}:
            votes[language] += 1
    likely = np.flatnonzero(votes >= min(3, votes.max(initial=0))) if votes.any() else np.zeros(0, np.int64)
    sets = []
    for texts in spoken:
        found = set()
        for t in texts:
            b = int(best[t])
            if len(likely) and votes[b] < 3:
                other = int(likely[near[t, likely].argmin()])
                if near[t, other] <= near[t, b] * (1 + NEAR):
                    b = other
                elif sizes[t] < 2 * LONG:
                    continue
            found.add(b)
        sets.append(found)
    return sets, likely


def _runs(sets: list[set[int]], language: int) -> list[tuple[int, int, int]]:
    """(first, last, n) of the stretches of cues that hold the language, with cues of too little text in between allowed."""
    out, first, last = [], -1, -1
    for i, found in enumerate(sets):
        if language in found:
            if first < 0:
                first = i
            last = i
        elif found:
            if first >= 0:
                out.append((first, last, last - first + 1))
            first = -1
    if first >= 0:
        out.append((first, last, last - first + 1))
    return out


_STRETCHES = "doc_id bigint, label string, lang string, first_cue int, last_cue int, confidence double, languages int"


def stretches_of(texts: list[str | None], profiles: Profiles, in_a_row: int) -> list[list[tuple[str, int, int, float]]]:
    """Per text its stretches: (language, number of the first and last spoken cue, confidence), in order of cue."""
    numbers: dict[str, int] = {}
    documents = []
    for text in texts:
        cues = []
        for lines in spoken_cues(text) if text else []:
            if len(lines) > 1:  # all lines together, where each may be too short
                lines = [*lines, " ".join(lines)]
            cues.append([numbers.setdefault(line, len(numbers)) for line in lines])
        documents.append(cues)
    if not profiles.languages:
        return [[] for _ in texts]
    near, sizes = distances(list(numbers), profiles)
    out = []
    for cues in documents:
        if not cues:
            out.append([])
            continue
        own = sorted({t for cue in cues for t in cue})
        local = {t: i for i, t in enumerate(own)}
        d, n = near[own], sizes[own]
        cues = [[local[t] for t in cue] for cue in cues]
        sets, likely = _languages_of_cues(cues, d, n)
        found = []
        for language in likely:
            for first, last, length in _runs(sets, language):
                if length >= in_a_row:
                    lines = [t for cue, held in zip(cues[first : last + 1], sets[first : last + 1]) if language in held for t in (cue[:-1] or cue) if d[t].argmin() == language] or [cues[first][-1]]
                    mean = d[lines].mean(axis=0)
                    other = np.delete(mean, language).min(initial=profiles.size)
                    found.append((profiles.languages[language], first, last, float(max(0.0, 1 - mean[language] / max(other, 1e-9)))))
        out.append(sorted(found, key=lambda x: (x[1], x[0])))
    return out


def stretches(documents: DataFrame, profiles: Profiles, in_a_row: int = 5) -> DataFrame:
    """One row per stretch of at least `in_a_row` spoken cues in a row that hold a line in a language.

    (`doc_id`, `label`, `lang`, `first_cue`, `last_cue`, `confidence`, `languages`): cues are counted from 0 among
    the spoken ones, `languages` is the document's number of languages, `confidence` is by how much
    the language's distance is below that of the next one (0 to 1). Lines of two languages in one cue
    belong to two stretches. Null and empty texts, and texts without such a stretch, give no row.
    A batch's memory follows its texts, and nothing is shuffled unless a few files would leave cores idle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                size, n = 0, 0
                while n < 2000 and at + n < batch.num_rows and size < 8_000_000:
                    size += len(batch.column(1)[at + n].as_buffer() or b"")
                    n += 1
                ids, texts, labels = (c.to_pylist() for c in batch.slice(at, n).columns)
                at += n
                rows = []
                for doc, label, found in zip(ids, labels, stretches_of(texts, profiles, in_a_row)):
                    many = len({f[0] for f in found})
                    rows += [(doc, label, *f, many) for f in found]
                columns = list(zip(*rows)) or [()] * 7
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "label", "lang", "first_cue", "last_cue", "confidence", "languages"])

    return spread(documents.select("doc_id", "text", "lang"), "doc_id").mapInArrow(scan, _STRETCHES)


def wrong_labels(found: DataFrame) -> DataFrame:
    """(`doc_id`, `lang`) for each language of the documents of `stretches` whose label is not right.

    It is right if the document has one language and the label's first two letters are its code.
    """
    right = (F.col("languages") == 1) & F.coalesce(F.lower(F.substring("label", 1, 2)) == F.col("lang"), F.lit(False))
    return found.where(~right).select("doc_id", "lang").distinct()


def document_languages(found: DataFrame) -> DataFrame:
    """(`doc_id`, `lang`, `cues`, `confidence`, `main`, `label_right`): one row per language of each document of `stretches`.

    `cues` is the number of spoken cues in its stretches, `confidence` their mean weighted by cues, `main`
    marks the language with most cues (the first by code among equals).
    """
    cues = F.col("last_cue") - F.col("first_cue") + 1
    label = F.coalesce((F.max("languages") == 1) & (F.lower(F.substring(F.max("label"), 1, 2)) == F.col("lang")), F.lit(False))
    each = found.groupBy("doc_id", "lang").agg(F.sum(cues).alias("cues"), (F.sum(cues * F.col("confidence")) / F.sum(cues)).alias("confidence"), label.alias("label_right"))
    first = Window.partitionBy("doc_id").orderBy(F.desc("cues"), "lang")  # a document has few languages
    return each.select("doc_id", "lang", "cues", "confidence", (F.row_number().over(first) == 1).alias("main"), "label_right")
