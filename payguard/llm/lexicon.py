"""Lexicon and text features of the toxicity scorer; tasks import this without the training library."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from payguard.llm import words as W
from payguard.llm.textstats import Batch

#: Byte lengths of the word beginnings that may enter the lexicon, beside whole words.
BEGINNINGS = (4, 5, 6, 7, 8)
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "vous", "votre", "du", "dich", "dir", "dein", "ihr", "euch", "tú", "ti", "vos", "usted", "ustedes")
NEAR = 5
FEATURES = ("lexicon_density", "lexicon_weight", "lexicon_peak", "lexicon_hits", "lexicon_kinds", "second_person", "second_person_near", "capitals", "capital_words", "punctuation", "exclamation", "obfuscation", "digits", "words", "word_length")


def units(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of each word and of its beginnings; 0 where a word is too short."""
    out = [np.where(ends > starts, W.hashes(buffer, starts, ends), np.uint64(0))]
    for length in BEGINNINGS:
        cut = np.minimum(ends, starts + length)
        out.append(np.where(ends - starts >= length, W.mix(W.hashes(buffer, starts, cut) + np.uint64(length)), np.uint64(0)))
    return out


def _hash_words(words: tuple[str, ...]) -> np.ndarray:
    buffer = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = W.split(buffer, np.array([0, len(buffer)]))
    return np.sort(W.hashes(buffer, starts, ends))


def _found(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_values):
        return np.zeros(len(values), np.bool_), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values, at


def features(text: pa.Array, lexicon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The FEATURES of each text. lexicon: sorted hashes, weight: of each. Null and empty texts have zeros."""
    b = Batch(text)
    n = np.maximum(b.n, 1)
    best, which = np.zeros(len(b.starts)), np.full(len(b.starts), -1)
    buffer, starts, ends = b.plain()
    for k, unit in enumerate(units(buffer, starts, ends)):
        if k == 0:
            you = _found(_hash_words(SECOND_PERSON), unit)[0]
        hit, at = _found(lexicon, unit)
        better = hit & (np.where(hit, weight[at] if len(weight) else 0, 0) > best)
        best[better], which[better] = weight[at[better]] if len(weight) else 0, at[better]
    hits = which >= 0
    row = np.repeat(np.arange(len(b.n)), b.n)
    total = np.concatenate([[0], np.cumsum(you)])
    i = np.arange(len(row))
    near = hits & (total[np.minimum(i + NEAR + 1, b.rows[1:][row])] > total[np.maximum(i - NEAR, b.rows[:-1][row])]) if len(row) else hits
    peak = np.zeros(len(b.n))
    np.maximum.at(peak, row, best)
    kinds = np.bincount(np.unique(np.stack([row[hits], which[hits]]), axis=1)[0], minlength=len(b.n)) if hits.any() else np.zeros(len(b.n))
    upper, lower, digit, high = b.count(65, 90), b.count(97, 122), b.count(48, 57), b.count(128, 255)
    size = b.ends - b.starts
    mark = size - upper - lower - digit - high
    letters = upper + lower + high
    odd = b.within(np.isin(b.buffer, np.frombuffer(b"*$@#%&_~^", np.uint8)))
    inner = (letters > 0) & ((odd > 0) | (digit > 0))
    chars = np.maximum(b.per_row(size), 1)
    mass = b.per_row(hits)
    columns = [mass / n, b.per_row(best) / n, peak, np.log1p(mass), np.log1p(kinds), b.per_row(you) / n, b.per_row(near) / n, b.per_row(upper) / np.maximum(b.per_row(letters), 1), b.per_row((upper > 1) & (lower == 0)) / n, b.per_row(mark) / chars, b.per_row(b.count(33, 33)) / chars, b.per_row(inner) / n, b.per_row(digit) / chars, np.log1p(b.n), b.per_row(size) / n]
    return np.stack(columns, axis=1)
