"""Statistics of texts and lines, for all texts of a block at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ._text import WORD, Block, content, grams, mix

#: Symbols `[#*$%&|<>]`.
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;\"')")] = True
_SALT = np.uint64(0x9E3779B97F4A7C15)


def counter(marks: np.ndarray):
    """Counts of marks between places."""
    total = np.zeros(len(marks) + 1, np.int64)
    np.cumsum(marks, out=total[1:])
    return lambda a, b: total[b] - total[a]


def again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key stood before, and whether it stands twice or more."""
    later, many = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys):
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = k[1:] == k[:-1]
        later[order[1:]] = same
        many[order[1:]] |= same
        many[order[:-1]] |= same
    return later, many


@dataclass
class Stats:
    """Arrays by text, and lines (only lines with a word) with their text."""

    n_bytes: np.ndarray
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    features: np.ndarray  # by text
    line_text: np.ndarray
    line_words: np.ndarray
    line_features: np.ndarray


#: Features of a text; each is a share or a mean, so no length enters but its logarithm.
TEXT_FEATURES = ["upper", "symbols", "digits", "bangs", "pipes", "word_length", "repeat_words", "dup_lines", "adjacent_equal", "symbol_words", "log_words", "ended_words", "non_ascii"]
LINE_FEATURES = ["bias", "short", "medium", "no_end", "symbols", "upper", "pipes", "duplicate", "digits", "adjacent_equal", "bangs"]


def stats(block: Block) -> Stats:
    buf, offs = block.buf, block.offs
    n = len(block)
    starts, ends, first = block.words(WORD)
    words = np.diff(first)
    size = np.diff(offs)
    at = lambda marks: counter(marks)
    lead = (buf & 0xC0) != 0x80
    inside = WORD[buf]
    chars = at(lead & inside)
    symbol, upper, lower, digit = at(SYMBOL[buf]), at(_UPPER[buf]), at(_LOWER[buf]), at(_DIGIT[buf])
    bang, pipe, wide = at(buf == 33), at(buf == 124), at(buf >= 0xC0)
    a, b = offs[:-1], offs[1:]

    word_hash = content(buf, starts, ends)
    text_of_word = np.repeat(np.arange(n), words)
    repeat = np.zeros(len(starts) + 1, np.int64)
    adjacent = np.zeros(len(starts), bool)
    if len(starts) > 1:
        adjacent[1:] = (word_hash[1:] == word_hash[:-1]) & (text_of_word[1:] == text_of_word[:-1])
    if len(starts) > 2:
        three = grams(word_hash, 3)
        valid = np.flatnonzero(text_of_word[2:] == text_of_word[:-2])
        _, many = again(mix(three[valid] ^ (text_of_word[valid].astype(np.uint64) * _SALT)))
        hit = valid[many]
        mark = np.zeros(len(starts), bool)
        for k in range(3):
            mark[hit + k] = True
        np.cumsum(mark, out=repeat[1:])
    n_repeat = repeat[first[1:]] - repeat[first[:-1]]

    # lines: cut at every line feed and at ends of texts; only those with a word are kept
    breaks = np.flatnonzero(buf == 10)
    line_start = np.union1d(a[size > 0], breaks + 1)
    line_start = line_start[line_start < len(buf)]
    next_break = np.append(breaks, len(buf))[np.searchsorted(breaks, line_start)]
    line_text = np.searchsorted(offs, line_start, "right") - 1
    line_end = np.minimum(next_break, offs[line_text + 1])
    w0, w1 = np.searchsorted(starts, line_start), np.searchsorted(starts, line_end)
    some = w1 > w0
    line_start, line_end, line_text, w0, w1 = (x[some] for x in (line_start, line_end, line_text, w0, w1))
    key = mix(content(buf, line_start, line_end) ^ (line_text.astype(np.uint64) * _SALT))
    duplicate, _ = again(key)
    n_dup = np.bincount(line_text, weights=duplicate, minlength=n).astype(np.int64)

    one = lambda x: np.maximum(x, 1)
    adj = at(adjacent)
    symbol_word = at(SYMBOL[buf[ends - 1]] if len(starts) else np.zeros(0, bool))
    ended = at(_END[buf[ends - 1]] if len(starts) else np.zeros(0, bool))
    word_chars = chars(a, b)
    n_lines = np.bincount(line_text, minlength=n)
    features = np.stack(
        [upper(a, b) / one(upper(a, b) + lower(a, b)), symbol(a, b) / one(word_chars), digit(a, b) / one(word_chars), bang(a, b) / one(words), pipe(a, b) / one(words), word_chars / one(words), n_repeat / one(words), n_dup / one(n_lines), adj(first[:-1], first[1:]) / one(words), symbol_word(first[:-1], first[1:]) / one(words), np.log1p(words), ended(first[:-1], first[1:]) / one(words), wide(a, b) / one(word_chars)],
        axis=1,
    )
    lw = w1 - w0
    lc = one(chars(line_start, line_end))
    last = buf[ends[w1 - 1] - 1] if len(w1) else np.zeros(0, np.uint8)
    line_features = np.stack(
        [np.ones(len(lw)), lw < 4, (lw >= 4) & (lw < 10), ~_END[last], np.minimum(1, 5 * symbol(line_start, line_end) / lc), (upper(line_start, line_end) > lower(line_start, line_end)) & (lw > 1), np.minimum(1, pipe(line_start, line_end) / 4), duplicate, digit(line_start, line_end) / lc, np.minimum(1, 3 * adj(np.minimum(w0 + 1, w1), w1) / one(lw)), np.minimum(1, 3 * bang(line_start, line_end) / one(lw))],
        axis=1,
    ).astype(np.float64)
    return Stats(size, words, word_chars, symbol(a, b), n_dup, n_repeat, features, line_text, lw, line_features)
