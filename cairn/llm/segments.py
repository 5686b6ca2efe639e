"""Cuts many texts at once, on their UTF-8 bytes, without a Python object for each word.

``pieces`` cuts where a GPT-2-like pre-tokenizer always cuts too, so that each distinct piece can be
encoded on its own. Its patterns never cross from a non-space character to white space; the last
space of a run belongs to the non-space character after it; a run of letters ends at a punctuation
mark, and one of punctuation at a letter unless an apostrophe (of a contraction) is there. Only ASCII
and Latin-1 letters are told from other characters; elsewhere nothing is cut, so pieces get longer.

``words`` gives the words ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased, as 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: White space but space, tab, line feed and carriage return.
OTHER_SPACES = "".join(map(chr, [11, 12, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_U = np.uint64

_LETTER, _MARK, _GAP, _SOLID = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER | _SOLID
_KIND[48:58] = _SOLID
_KIND[[b for b in range(33, 127) if not chr(b).isalnum()]] = _MARK | _SOLID
_KIND[39] = _SOLID  # an apostrophe may open a contraction
_KIND[[9, 10, 13, 32]] = _GAP
# lead bytes of characters that are never white space
_KIND[[*range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = _SOLID

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (and the last ends); null is empty."""
    text = text.cast(pa.string()).fill_null("") if text.null_count or not pa.types.is_string(text.type) else text
    _, offsets, data = text.buffers()
    if not len(text) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    at = np.frombuffer(offsets, np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pieces(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces (binary), the number of each piece in turn, and where each text's pieces begin."""
    data, at = raw(text)
    if not len(data):
        return pa.array([], pa.binary()), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    kind = _KIND[data]
    before, after = np.concatenate([[0], kind[:-1]]).astype(np.uint8), np.concatenate([kind[1:], [0]]).astype(np.uint8)
    # a Latin-1 letter counts as a letter at its second byte
    latin = np.flatnonzero(data[:-1] == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)] + 1
    ends_letter = before & _LETTER > 0
    ends_letter[latin[latin + 1 < len(data)] + 1] = True
    cut = (data == 32) & (after & _SOLID > 0)
    cut |= (kind & _MARK > 0) & ends_letter
    cut |= (kind & _LETTER > 0) & (before & _MARK > 0)
    first = at[:-1][np.diff(at) > 0]
    cut[first] = True
    begin = np.flatnonzero(cut)
    coded = _binary(data, np.append(begin, len(data))).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.searchsorted(begin, at)


def gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``which`` of flat one after another, and where each begins (and the last ends)."""
    n = size[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(ends[-1]) + np.repeat(begin[which] - ends[:-1], n)], ends


#: A random number for each byte at each of the first places of a word; the last one, for bytes between words, is 0.
_PLACES = 64
_RANDOM = np.append(mix(np.arange(_PLACES * 256, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019)), _U(0))


def words(text: pa.Array, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in turn, and where each text's begin; ``between`` marks the bytes that part words.

    A word's hash mixes the sum of a random number for each (place, byte) and the length.
    """
    data, at = raw(text)
    out, n, doc = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0
    while doc < len(at) - 1:
        # texts of some BLOCK bytes at a time, which stay in the processor's cache
        to = max(doc + 1, int(np.searchsorted(at, at[doc] + BLOCK, "right")) - 1)
        h, begin = _words(data[at[doc] : at[to]], at[doc : to + 1] - at[doc], between)
        out.append(h)
        n.append(np.diff(begin))
        doc = to
    return np.concatenate(out), np.cumsum(np.concatenate(n))


BLOCK = 1 << 18


def _words(data: np.ndarray, at: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = between[data]
    # a text's first byte opens a word, whatever ends the text before; its last one closes one
    opens, closes = ~space, ~space
    opens[1:] &= space[:-1]
    closes[:-1] &= space[1:]
    some = np.diff(at) > 0
    first, last = at[:-1][some], at[1:][some] - 1
    opens[first], closes[last] = ~space[first], ~space[last]
    begin = np.flatnonzero(opens)
    if not len(begin):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    size = np.flatnonzero(closes) - begin + 1
    place = np.arange(len(data), dtype=np.int32)
    place[begin[0] :] -= np.repeat(begin.astype(np.int32), np.diff(np.append(begin, len(data))))
    low = _LOWER[data]
    slot = np.minimum(place, _PLACES - 1)
    slot *= 256
    slot += low
    slot[space] = len(_RANDOM) - 1
    value = _RANDOM[slot]
    if size.max() > _PLACES:
        far = np.flatnonzero((place >= _PLACES) & ~space)
        value[far] = mix(place[far].astype(np.uint64) * _U(256) + low[far] + _U(0x8EBC6AF09C88C6E3))
    return mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * _U(0xD6E8FEB86659FD93)), np.searchsorted(begin, at)
