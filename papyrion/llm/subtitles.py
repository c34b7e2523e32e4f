"""Reading subtitle files: damaged encodings, cues, sounds and adverts.

Plain functions on one text, used inside Arrow batches. Every function takes the whole text.
"""

from __future__ import annotations

import re

TAG = re.compile(r"<[^<>\n]{1,80}>|\{\\?[^{}\n]{1,40}\}")
# Marks around sound descriptions, and what the marks become in a lost encoding.
SOUND_OPEN, SOUND_CLOSE = "[(♪♫#*�?", "])♪♫#*�?"
_INLINE_SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|♪[^♪]*♪|♫[^♫]*♫")
# What gives adverts and credits away, by form: an address (a dot inside a word before a run of letters of one
# case), or a signature at the end: a name joined by "_", with digits or a second capital inside, or two by "&".
_ADDRESS = re.compile(r"\.(?<=[^\W_]\.)(?:[a-z]{2,24}|[A-Z]{2,24})\b")
_SIGNED = re.compile(r"(?:[^\W_]_[^\W_]\w*|[^\W\d_]\d{2,}[^\W\d_]\w*|\b[A-Z][a-z]+[A-HJ-Z][a-z]+\w*|\b[A-Z][a-z]{2,}I[a-z]{2,}\w*|\b[^\W\d_a-zа-я]\w+ & [^\W\d_a-zа-я]\w+)(?: \(\w+\))?$")
_SPEAKER = re.compile(r"^[\s\xad]*(?:[-–—][\s\xad]*)?[^\W\d_a-zа-я][^\W_a-zа-яß-öø-ÿ]{1,24}(?: [^\W_a-zа-яß-öø-ÿ]{1,24})?:\s+(?=\S)")


def _bytes_of(encoding: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def _misread(encoding: str) -> tuple[dict[str, int], re.Pattern]:
    """UTF-8 read in `encoding`: the bytes of its characters, and what two- and three-byte characters look like."""
    by = _bytes_of(encoding)
    of = {b: re.escape(c) for c, b in by.items()}
    tail = "[" + "".join(of[b] for b in range(0x80, 0xC0)) + "]"
    return by, re.compile("[" + "".join(of[b] for b in range(0xC2, 0xE0)) + "]" + tail + "|[" + "".join(of[b] for b in range(0xE1, 0xF0)) + "]" + tail + "{2}")


_MISREAD = [_misread(e) for e in ("cp1252", "latin-1", "cp1251")]
_FIRST = re.compile("[ÂÃÄÅÐÑâãÎÏВГРСв]")
_HIGH, _LETTERS = re.compile("[À-ÿ]"), re.compile(r"[^\W\d_]")
_CYRILLIC = {c: bytes([b]).decode("cp1251", "replace") for c, b in _bytes_of("cp1252").items()}
_CYRILLIC_TABLE = str.maketrans(_CYRILLIC | {chr(b): bytes([b]).decode("cp1251", "replace") for b in range(0xA0, 0x100)})


def repair(text: str) -> str:
    """`text` with UTF-8 that was read in a one-byte encoding, once or twice, and Cyrillic read as Western put right.

    Only texts in which such sequences make up a good part of the characters beyond ASCII are touched.
    """
    if text.isascii():
        return text
    return _repaired(text, lambda pattern, by, text: pattern.sub(lambda m: _decoded(m, by), text), lambda table, text: text.translate(table))


def _decoded(match: re.Match, by: dict[str, int]) -> str:
    return bytes(by[c] for c in match.group()).decode("utf-8", "replace")


def _repaired(text, substitute, translate):
    """The repair of a str or a Placed, with the ways to change it."""
    plain = str(text)
    for _ in range(2):
        if not _FIRST.search(plain):
            break
        best = max(((sum(map(len, pattern.findall(plain))), i) for i, (_, pattern) in enumerate(_MISREAD)), key=lambda x: x[0])
        if best[0] < 4 or best[0] < 0.4 * sum(1 for ch in plain if ch > "\x7f"):
            break
        by, pattern = _MISREAD[best[1]]
        text = substitute(pattern, by, text)
        plain = str(text)
    high = len(_HIGH.findall(plain))
    if high > 20 and high > 0.6 * len(_LETTERS.findall(plain)):
        text = translate(_CYRILLIC_TABLE, text)
    return text


class Placed:
    """A text with the place in the original of each of its characters: [start, end)."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.text = text
        self.starts = list(range(len(text))) if starts is None else starts
        self.ends = list(range(1, len(text) + 1)) if ends is None else ends

    def __str__(self) -> str:
        return self.text

    def __contains__(self, part: str) -> bool:
        return part in self.text

    def __getitem__(self, part: slice) -> Placed:
        return Placed(self.text[part], self.starts[part], self.ends[part])

    def __add__(self, other: Placed) -> Placed:
        return Placed(self.text + other.text, self.starts + other.starts, self.ends + other.ends)

    def _rebuilt(self, pieces) -> Placed:
        """From (first, last, replacement or None) pieces; a replacement's characters have the place of all it replaces."""
        text, starts, ends = [], [], []
        for a, b, new in pieces:
            text.append(self.text[a:b] if new is None else new)
            starts += self.starts[a:b] if new is None else [self.starts[a]] * len(new)
            ends += self.ends[a:b] if new is None else [self.ends[b - 1]] * len(new)
        return Placed("".join(text), starts, ends)

    def sub(self, pattern: re.Pattern, new) -> Placed:
        pieces, at = [], 0
        for m in pattern.finditer(self.text):
            if m.end() > m.start():
                pieces += [(at, m.start(), None), (m.start(), m.end(), new(m) if callable(new) else new)]
                at = m.end()
        return self._rebuilt([*pieces, (at, len(self.text), None)])

    def lines(self) -> list[Placed]:
        """The lines with their ends."""
        out, at = [], 0
        for line in self.text.splitlines(keepends=True) if "\n" in self.text else [self.text]:
            out.append(self[at : at + len(line)])
            at += len(line)
        return out

    def lower(self) -> Placed:
        lowered = self.text.lower()
        if len(lowered) == len(self.text):
            return Placed(lowered, self.starts, self.ends)
        return self._rebuilt((i, i + 1, c.lower()) for i, c in enumerate(self.text))

    def repaired(self) -> Placed:
        """What `repair` makes of the text."""
        if self.text.isascii():
            return self
        return _repaired(self, lambda pattern, by, text: text.sub(pattern, lambda m: _decoded(m, by)), lambda table, text: Placed(text.text.translate(table), text.starts, text.ends))


def cue_bodies(text: str) -> list[tuple[int, int]]:
    """(start, end) of each cue's text lines, in order: what lies between lines of times, less the next cue's number.

    A text without a line of times is one cue; what stands before the first such line is a cue unless it
    is a number or a header.
    """
    times, at = [], text.find("-->")
    while at >= 0:
        start, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        end = len(text) if end < 0 else end
        times.append((start, end))
        at = text.find("-->", end)
    bodies = []
    for (_, start), (end, _) in zip([(0, 0), *times], [*times, (len(text), 0)]):
        body = text[start:end].rstrip()
        cut = body.rfind("\n") + 1
        if body[cut:].strip().lstrip("﻿").isdigit() and (end < len(text) or not times):
            body = body[:cut].rstrip()
        if start == 0 and times and (not body.strip().lstrip("﻿") or body.lstrip("﻿ \n").startswith("WEBVTT")):
            continue
        if body.strip():
            bodies.append((start, start + len(body)))
    return bodies


def kind_of(body: str) -> str:
    """`spoken`, `sound` or `advert` for a cue's lines without tags."""
    flat = " ".join(body.split()).lstrip("-–— ")
    if not flat:
        return "sound"
    last = flat[-1]
    if flat[0] in SOUND_OPEN and last in SOUND_CLOSE and len(flat) > 2 and not any(c in flat[1:-1] for c in ("])" if flat[0] in "[(" else flat[0])):
        if flat[0] != "?" or flat[1] == " ":
            return "sound"
    if _ADDRESS.search(flat) or (last.isalnum() or last == ")") and _SIGNED.search(flat):
        return "advert"
    return "spoken"


def spoken_lines(body: str) -> list[str]:
    """The lines of a cue without tags, inline sounds, speakers' names and dashes; lines of nothing are left out."""
    if "[" in body or "(" in body or "♪" in body:
        body = _INLINE_SOUND.sub(" ", body)
    lines = []
    for line in body.split("\n"):
        if ":" in line:
            line = _SPEAKER.sub("", line)
        line = line.strip()
        if line.startswith(("-", "–", "—")):
            line = line[1:].strip()
        if line:
            lines.append(line)
    return lines
