"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans (operator 1).

The patterns give emails, IPv4 addresses, card numbers and phone numbers, leftmost and non-overlapping by kind;
matches that fail their check are dropped and not retried. The field segments every zone (neighbouring words
with a digit, an at sign, an equals sign or an underscore, and values after a name of secrets) and adds what
overlaps no pattern's span: numbers that a greedy match ran together and dropped, phone numbers without a plus
sign, national numbers, and secrets (access keys, passwords, tokens).

Only places near those signs are looked at one by one; they are found by array
operations on whole blocks. Patterns hold ASCII only, so a match lies within one run of its characters.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows
count each; an empty table gives an empty result; other columns are kept by ``redacted`` and ignored else.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _semicrf
from ._text import SPACE, WORD, Block, blocks

#: Kinds by patterns, then those that only the field knows.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "id")
_MORE = ("secret", "id", "added", "spans")


def _bytes(chars: bytes, *ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    for a, b in ranges:
        out[a : b + 1] = True
    return out


_DIGITS, _UPPER, _SMALL = (48, 57), (65, 90), (97, 122)
#: Pattern, the bytes that its matches consist of, a byte that every match has, and how many of it at least.
PATTERNS = {
    "email": (re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), _bytes(b"._%+-@", _DIGITS, _UPPER, _SMALL), _bytes(b"@"), 1),
    "ip": (re.compile(rb"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), _bytes(b".", _DIGITS), _bytes(b"."), 3),
    "card": (re.compile(rb"[0-9]([\x20-]?[0-9])+"), _bytes(b" -", _DIGITS), _bytes(b"", _DIGITS), 13),
    "phone": (re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]"), _bytes(b" ().-+", _DIGITS), _bytes(b"+"), 1),
}
_NUMBER = _bytes(b"", _DIGITS)
_NEAR = _bytes(b"@=_", _DIGITS)
_NAME = re.compile(rb"(?:password|passwd|pwd|secret|token|key|auth)\s*[=:]\s*[\"']?", re.I)


def _valid(kind: str, match: bytes) -> bool:
    if kind == "ip":
        return all(len(x.lstrip(b"0")) <= 3 and int(x.lstrip(b"0") or 0) <= 255 for x in match.split(b"."))
    if kind in ("card", "phone"):
        digits = bytes(c for c in match if 48 <= c <= 57)
        return 13 <= len(digits) <= 19 and _semicrf.luhn(digits) if kind == "card" else 9 <= len(digits) <= 15
    return True


def _runs(block: Block, table: np.ndarray, needed: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, start and end of the runs of table's bytes that have ``least`` of the needed places."""
    buf, offs = block.buf, block.offs
    at = np.flatnonzero(needed)
    if not len(at):
        return at, at, at
    outside = np.flatnonzero(~table[buf])
    i = np.searchsorted(outside, at)
    padded = np.concatenate([[-1], outside, [len(buf)]])
    text = np.searchsorted(offs, at, "right") - 1
    a, b = np.maximum(padded[i] + 1, offs[text]), np.minimum(padded[i + 1], offs[text + 1])
    a, first, n = np.unique(a, return_index=True, return_counts=True)
    keep = n >= least
    return text[first][keep], a[keep], b[first][keep]


def _digit_count(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = np.flatnonzero(_NUMBER[buf])
    return np.searchsorted(at, b) - np.searchsorted(at, a)


def base_spans(block: Block) -> list[tuple[int, str, int, int]]:
    """(text, kind, start, end) of the patterns, as bytes of the block, by kind and start."""
    out = []
    for kind, (pattern, table, needed, least) in PATTERNS.items():
        text, a, b = _runs(block, table, needed[block.buf], least)
        if kind != "email" and len(a):
            enough = _digit_count(block.buf, a, b) >= {"ip": 4, "card": 13, "phone": 9}[kind]
            text, a, b = text[enough], a[enough], b[enough]
        for t, x, y in zip(text.tolist(), a.tolist(), b.tolist(), strict=True):
            run = block.buf[x:y].tobytes()
            out += [(t, kind, x + m.start(), x + m.end()) for m in pattern.finditer(run) if _valid(kind, m[0])]
    return out


def zones(block: Block) -> list[tuple[int, int, int]]:
    """(text, start, end) of neighbouring words that may hold an entity, one white space apart."""
    near = _NEAR[block.buf]
    for m in _NAME.finditer(block.buf.tobytes()):  # the name's mark and the value after it
        near[m.start() : m.end()] |= WORD[block.buf[m.start() : m.end()]]
        near[m.end() : m.end() + 1] = WORD[block.buf[m.end() : m.end() + 1]]
    text, a, b = _runs(block, WORD, near, 1)
    if not len(a):
        return []
    joined = np.zeros(len(a), bool)
    joined[1:] = (text[1:] == text[:-1]) & (a[1:] == b[:-1] + 1) & SPACE[block.buf[np.minimum(b[:-1], len(block.buf) - 1)]]
    start = np.flatnonzero(~joined)
    end = np.append(start[1:], len(a)) - 1
    return list(zip(text[start].tolist(), a[start].tolist(), b[end].tolist(), strict=True))


def added_spans(block: Block, base: list[tuple[int, str, int, int]], weights: np.ndarray) -> list[tuple[int, str, int, int]]:
    """Entities of the field that overlap no span of the patterns."""
    edges = sorted((a, b) for _, _, a, b in base)
    starts = np.array([a for a, _ in edges])
    reach = np.maximum.accumulate([b for _, b in edges]) if edges else np.zeros(0, int)
    out = []
    for t, a, b in zones(block):
        low = max(int(block.offs[t]), a - 24)
        right = min(int(block.offs[t + 1]), b + 1)
        for kind, x, y in _semicrf.decode(block.buf[low:right].tobytes(), weights, a - low):
            x, y = x + low, y + low
            i = int(np.searchsorted(starts, y)) - 1
            if y <= b and not (i >= 0 and reach[i] > x):
                out.append((t, kind, x, y))
    return out


def found(batch: pa.RecordBatch, weights: np.ndarray) -> Iterator[tuple[int, list, list]]:
    """For each row: spans of the patterns and all spans as (kind, start, end) in code points, in order of KINDS and start."""
    for block, at, to in blocks(batch):
        base = base_spans(block)
        more = added_spans(block, base, weights)
        rows: dict[int, tuple[list, list]] = {}
        if base or more:
            points = block.points()
            for which, spans in ((0, base), (1, more)):
                for t, kind, a, b in spans:
                    p = int(points[block.offs[t]])
                    rows.setdefault(t, ([], []))[which].append((kind, int(points[a]) - p, int(points[b]) - p))
        for i in range(to - at):
            own, new = rows.get(i, ((), ()))
            own = list(own)
            yield at + i, own, sorted([*own, *new], key=lambda s: (KINDS.index(s[0]), s[1])) if new else own


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``doc_id``, counts of the patterns' spans, their digest, all spans as text, and counts of the field's own.

    n_secret, n_id: spans of kinds that have no pattern; n_added: all spans that the field adds; n_spans: all.
    """
    w = _semicrf.WEIGHTS if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = {k: [] for k in (*BASE, *_MORE)}, [], []
            for _, base, every in found(batch, w):
                for k in BASE:
                    counts[k].append(sum(s[0] == k for s in base))
                for k in ("secret", "id"):
                    counts[k].append(sum(s[0] == k for s in every))
                counts["added"].append(len(every) - len(base))
                counts["spans"].append(len(every))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(spans, pa.string()), *(pa.array(counts[k], pa.int64()) for k in _MORE)], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in _MORE)])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_id long, n_added long, n_spans long")


def redacted(docs: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; ``n_chars``, where there, follows the text."""
    w = _semicrf.WEIGHTS if weights is None else weights
    schema = docs.schema
    names = [f.name for f in schema]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            texts = batch.column(at).to_pylist()
            for i, _, every in found(alone, w):
                if every:
                    out, done = [], 0
                    for kind, a, b in sorted(every, key=lambda s: (s[1], -s[2])):
                        if a < done:  # kinds may overlap: the part beyond goes with the first
                            done = max(done, b)
                            continue
                        out += [texts[i][done:a], f"[{kind.upper()}]"]
                        done = b
                    texts[i] = "".join([*out, texts[i][done:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, schema)
    if names.count("n_chars") == 1:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(schema["n_chars"].dataType)))
    return out
