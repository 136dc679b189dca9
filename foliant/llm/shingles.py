"""Hashes of words and of word shingles, shared by operators on word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (the finaliser of a public hash)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order, by sorting (which is faster than a table of them)."""
    s = np.sort(values)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word that are hashed in arrays; the rest of a longer word is hashed by itself.
LONG_WORD = 256


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts (strings or bytes, no nulls), one text after the other, and the number of words of each.

    Words lie between the six ASCII white-space characters, with A-Z as a-z. Eight bytes of all words are taken up at a time.
    """
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    body = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inner = offsets[(offsets > 0) & (offsets < len(body))]
    word = ~SPACE[body]
    edge = np.concatenate([[True], ~word[:-1]])
    edge[inner] = True
    starts = np.flatnonzero(word & edge)
    edge = np.concatenate([~word[1:], [True]])
    edge[inner - 1] = True
    sizes = np.flatnonzero(word & edge) + 1 - starts
    padded = np.concatenate([body, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(body),), "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    hashes = mix(sizes.astype(np.uint64) * STEP)
    left = np.arange(len(starts))
    for at in range(0, LONG_WORD, 8):
        chunk = eight[starts[left] + at] & masks[np.minimum(sizes[left] - at, 8)]
        hashes[left] = mix(hashes[left] ^ chunk) * STEP
        left = left[sizes[left] > at + 8]
        if not len(left):
            break
    for i in left.tolist():
        hashes[i] = mix(hashes[i : i + 1] ^ np.uint64(xxhash.xxh3_64_intdigest(body[starts[i] + LONG_WORD : starts[i] + sizes[i]].tobytes())))[0]
    return mix(hashes), np.diff(np.searchsorted(starts, offsets))


def by_text(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text; a null has none."""
    hashes, sizes = word_hashes(pc.fill_null(texts, ""))
    ends = np.cumsum(sizes)
    for a, b in zip((ends - sizes).tolist(), ends.tolist()):
        yield hashes[a:b]


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the width-word shingles; fewer words count as one shingle, no words as none."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    if n < width:
        width = n
    out = hashes[: n - width + 1].copy()
    for k in range(1, width):
        out = out * STEP + hashes[k : n - width + 1 + k]
    return distinct(mix(out + np.uint64(width)))
