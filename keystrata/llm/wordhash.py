"""Hashes of words and word shingles for whole blocks of texts, in numpy."""

from __future__ import annotations

import numpy as np

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_U = np.uint64

#: Bytes that belong to a word: digits, lower-case letters, and all of UTF-8's longer characters.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True

#: Bytes of text that are hashed at once, about; one text at least.
RUN_BYTES = 256 << 10

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_PRIME, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` in order, and where each text's words end.

    A word's hash is a polynomial of its bytes, taken from running sums, so a block is
    hashed in a few passes whatever its words are. The passes hold some 40 bytes for each
    byte of text, so texts are taken by runs of about ``RUN_BYTES``.
    """
    hashes, ends, run, held, words = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [], 0, 0
    for i, t in enumerate(texts, 1):
        run.append((t or "").lower().encode())
        held += len(run[-1])
        if held >= RUN_BYTES or i == len(texts):
            h, e = _run_hashes(run)
            hashes.append(h)
            ends.append(e + words)
            run, held, words = [], 0, words + len(h)
    return np.concatenate(hashes), np.concatenate(ends)


def _run_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    inside = np.concatenate([[False], _IN_WORD[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edge[::2], edge[1::2]
    up, down = _power(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * up[: len(data)])])
    h = mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))
    return h, np.searchsorted(starts, ends, side="left")


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each text: (text number, shingle hash, count), sorted by the first two.

    A text of fewer words, but at least one, has its words together as its only shingle.
    """
    h, ends = word_hashes(texts)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    lengths = ends - starts
    owner = np.repeat(np.arange(len(texts)), lengths)
    at = np.arange(len(h))
    left = ends[owner] - at if len(h) else at
    full = left >= n
    first = (at == starts[owner]) & (lengths[owner] < n) if len(h) else full
    keep = np.flatnonzero(full | first)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    value = np.zeros(len(keep), np.uint64)
    for k in range(n):
        part = np.where(left[keep] > k, padded[keep + k], _U(k + 1))
        value = mix(value * _U(_PRIME) + part)
    who = owner[keep]
    order = np.lexsort((value, who))
    who, value = who[order], value[order]
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (value[1:] != value[:-1])]) if len(who) else np.empty(0, bool)
    places = np.flatnonzero(new)
    return who[places], value[places], np.diff(np.concatenate([places, [len(who)]])).astype(np.int64)
