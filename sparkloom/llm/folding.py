"""Texts with disguises of words undone, and byte grams of their words, as numpy over whole Arrow batches."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shingles import ragged, text_bytes

#: Stands for one hidden letter (a star inside a word).
HIDDEN = 1
SPACE = 32
#: Bytes of a gram at least and at most; a gram fits into one 64-bit number.
SHORTEST, LONGEST = 4, 8
#: Digits and signs that stand for letters, and signs that part a word's letters.
_LOOKS_LIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_PARTING = ".-_'*"
#: Small letters of other scripts that look like ASCII letters.
_OTHER_SCRIPTS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
#: Stars in a row that hide letters, at most.
_STARS = 3
_BEYOND_ASCII = r"[^\x00-\x7F\p{L}\p{M}]+"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_AS_LETTER = np.zeros(256, dtype=np.uint8)
for _sign, _letter in _LOOKS_LIKE.items():
    _AS_LETTER[ord(_sign)] = ord(_letter)
_PARTS = np.zeros(256, dtype=bool)
_PARTS[[ord(c) for c in _PARTING]] = True


_LEADS = np.unique([c.encode()[0] for c in _OTHER_SCRIPTS]).astype(np.uint8)
_LOOK = np.zeros(1 << 16, dtype=np.uint8)
for _sign, _letter in _OTHER_SCRIPTS.items():
    _LOOK[int.from_bytes(_sign.encode(), "big")] = ord(_letter)


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def _signs_to_letters(data: np.ndarray) -> np.ndarray:
    """One or two signs before a letter, as the letters that they look like."""
    begins, ends = _runs(_AS_LETTER[data] > 0)
    short = (ends - begins <= 2) & (ends < len(data))
    begins, ends = begins[short], ends[short]
    begins, ends = begins[_LETTER[data[ends]]], ends[_LETTER[data[ends]]]
    out = data.copy()
    for place in (begins, ends - 1):
        out[place] = _AS_LETTER[data[place]]
    return out


def _one_script(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters of other scripts that look like ASCII letters, as these, in words that have ASCII letters too."""
    leads = np.flatnonzero(np.isin(data[:-1], _LEADS))
    pairs = data[leads].astype(np.int64) << 8 | data[leads + 1]
    leads = leads[_LOOK[pairs] > 0]
    if not len(leads):
        return data, starts
    begins, ends = _runs(_LETTER[data])
    word = np.searchsorted(begins, leads, side="right") - 1
    ascii_ = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    leads = leads[ascii_[ends[word]] > ascii_[begins[word]]]
    out, keep = data.copy(), np.ones(len(data), dtype=bool)
    out[leads] = _LOOK[data[leads].astype(np.int64) << 8 | data[leads + 1]]
    keep[leads + 1] = False
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def _hiding(data: np.ndarray) -> np.ndarray:
    """Places of stars that stand for letters: one to three in a row between two letters."""
    begins, ends = _runs(data == ord("*"))
    inside = (ends - begins <= _STARS) & (begins > 0) & (ends < len(data))
    begins, ends = begins[inside], ends[inside]
    inside = _LETTER[data[begins - 1]] & _LETTER[data[ends]]
    return ragged(begins[inside], (ends - begins)[inside])


def _parted(data: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Places of bytes that part one word's letters: a sign between two letters, or one byte each between three single letters or more.

    last: places of the texts' last bytes, which part nothing.
    """
    letter = _LETTER[data]
    signs = np.flatnonzero(_PARTS[data[1:-1]] & letter[:-2] & letter[2:]) + 1 if len(data) > 2 else np.empty(0, np.int64)
    begins, ends = _runs(letter)
    if len(begins) < 3:
        return signs
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    single = leads[ends] - leads[begins] == 1
    joins = single[:-1] & single[1:] & (begins[1:] - ends[:-1] == 1)
    joins[np.isin(ends[:-1], last)] = False
    first, behind = _runs(joins)
    long = behind - first >= 2
    inside = np.zeros(len(joins) + 1, dtype=np.int64)
    np.add.at(inside, first[long], 1)
    np.add.at(inside, behind[long], -1)
    return np.union1d(signs, ends[:-1][np.cumsum(inside)[:-1] > 0])


def folded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes in lower case with disguises undone, and where each text begins (one more entry for the end).

    Digits and signs that look like letters are these letters, signs and spaces
    between single letters are gone, stars inside a word are HIDDEN, repeats of
    an ASCII letter count once, and each other run is one space.  Wide, ligature
    and other compatible forms and look-alikes of other scripts are the plain
    letters; invisible format characters are gone.  A space comes
    before all texts and ends each; null counts as empty.
    """
    column = column.cast(pa.large_string()).fill_null("")
    if not pc.all(pc.string_is_ascii(column)).as_py():
        # Arrow's own normalization leaves letters and marks apart.
        plain = pa.array([unicodedata.normalize("NFKC", t) for t in column.to_pylist()], pa.large_string())
        column = pc.replace_substring_regex(plain, pattern=r"\p{Cf}+", replacement="")
    data, starts = text_bytes(pc.replace_substring_regex(pc.utf8_lower(column), pattern=_BEYOND_ASCII, replacement=" "))
    data, starts = _one_script(data, starts)
    data = _signs_to_letters(data)
    gone = np.zeros(len(data), dtype=bool)
    parting = _parted(data, starts[1:] - 1)
    stars = np.union1d(parting[data[parting] == ord("*")], _hiding(data)).astype(np.int64)
    gone[parting] = True
    gone[stars], data[stars] = False, HIDDEN
    place = np.concatenate([[0], np.cumsum(~gone)])
    data, starts = data[~gone], place[starts]
    data = np.where(_LETTER[data] | (data == HIDDEN), data, np.uint8(SPACE)).astype(np.uint8)
    keep = np.ones(len(data), dtype=bool)
    if len(data):
        keep[1:] = (data[1:] != data[:-1]) | (data[1:] >= 128) | (data[1:] == HIDDEN)
        # The space before all texts stands in for one that begins the first text.
        keep[0] = data[0] != SPACE
    place = np.concatenate([[0], np.cumsum(keep)])
    return np.concatenate([[np.uint8(SPACE)], data[keep]]).astype(np.uint8), place[starts] + 1


def n_words(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Words of each folded text."""
    ends = np.concatenate([[0], np.cumsum((data == SPACE) & np.concatenate([[False], data[:-1] != SPACE]))])
    return ends[starts[1:]] - ends[starts[:-1]]


def packed(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on, as one little-endian number."""
    rows = max(len(data) - n + 1, 0)
    out = np.zeros(rows, dtype=np.uint64)
    for j in range(n):
        out |= data[j : j + rows].astype(np.uint64) << np.uint64(8 * j)
    return out


def as_bytes(gram: int) -> bytes:
    return int(gram).to_bytes(8, "little").rstrip(b"\0")


def beginnings(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams that begin words (a space, then letters, then perhaps the space behind the word), and the place of each one's first letter."""
    space = data == SPACE
    begins = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sizes = ends[: len(begins)] - begins
    grams, places = [], []
    for n in range(SHORTEST, LONGEST + 1):
        at = begins[sizes + 1 >= n]
        code = np.zeros(len(at), dtype=np.uint64)
        for j in range(n):
            code |= data[at + j].astype(np.uint64) << np.uint64(8 * j)
        grams.append(code)
        places.append(at + 1)
    return np.concatenate(grams), np.concatenate(places)
