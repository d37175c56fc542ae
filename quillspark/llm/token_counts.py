"""Token counts of every prefix (operator 7).

A tokenizer of byte pairs cuts a text into pieces (words, digits, runs of signs) and merges within them. Prefix
dynamic programming gives the exact count of every prefix of a piece: the last token of a prefix is the one token
that ends there and stays apart from the last token of what is before it, so the count is one more than there.
Whether two tokens stay apart is found by the merge ranks and remembered. A piece that ends takes another last
token than one that goes on (``end_of_word_suffix``), so both are followed.

A text's prefix counts are its pieces' counts after the sums of the pieces before. ``prefix_table`` stores them;
truncation and budget questions are look-ups in it, and nothing is encoded again. A worker remembers pieces
(``TABLE`` of them, then it starts anew). Memory and time are linear in a text, white space or not.

Pieces of plain Latin text are cut here; a word with any other sign is cut by the library itself. A word that
composes under NFC (its prefixes may not be prefixes any more) is encoded prefix by prefix.

Defined results: a null text is empty; empty texts have 0 tokens; repeated rows count each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces, and pairs of tokens, that a worker remembers; longer pieces are not.
TABLE, PAIRS, LONG = 1 << 19, 1 << 20, 256
#: Tokens that a document may have.
LIMIT = 2048

# Letters, numbers and signs up to U+024F, where one code point is one in lower case and under NFC.
_LETTER, _NUMBER = "a-zA-ZªµºÀ-ÖØ-öø-įı-ȹȻ-Ƚȿ-ɏ", "0-9²³¹¼-¾"
_PLAIN = re.compile(rf"[\t-\r -~¡-¬®-¿×÷{_LETTER}]*")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_WORD = re.compile(r"[^\t-\r ]+")


def _byte_signs() -> list[str]:
    """The sign that stands for each byte in the vocabulary: itself where it is visible, else 256 and up in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + rest.index(b)) for b in range(256)]


_SIGNS = _byte_signs()


def _trie(tokens: list[tuple[str, int]]) -> dict:
    """Tokens from their last sign to the first; the number of a token is under the key None."""
    root: dict = {}
    for token, i in tokens:
        node = root
        for c in reversed(token):
            node = node.setdefault(c, {})
        node[None] = i
    return root


class Counter:
    """Exact token counts of pieces, of texts and of all their prefixes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        spec = json.loads(self.tokenizer.to_str())
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(pairs)}
        self.names = sorted(model["vocab"], key=model["vocab"].get)
        ended = [(t[: -len(self.suffix)], i) for i, t in enumerate(self.names) if self.suffix and t.endswith(self.suffix)]
        inner = [(t, i) for i, t in enumerate(self.names) if not (self.suffix and t.endswith(self.suffix))]
        self.inner, self.ended = _trie(inner), _trie(ended if self.suffix else inner)
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.apart: dict[int, bool] = {}
        self.total: dict[str, int] = {}
        self.prefixes: dict[str, bytes | array] = {}

    def _signs(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            own = token[: -len(self.suffix)]
            return [*own[:-1], own[-1:] + self.suffix]
        return list(token)

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether the tokens are still two if their signs are merged in the order of ranks."""
        left, right = self.names[a], self.names[b]
        parts = self._signs(left) + self._signs(right)
        while len(parts) > 2:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            first, second = parts[ranks.index(best)], parts[ranks.index(best) + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == first and parts[i + 1] == second:
                    out.append(first + second)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts == [left, right] and (left, right) not in self.rank

    def _follow(self, piece: str) -> bytes | array:
        """Counts of all prefixes of a piece (in code points) that the library does not cut."""
        raw = piece.encode()
        plain = piece.isascii() and piece.isprintable()  # each sign is its own byte's
        signs = piece if plain else "".join([_SIGNS[b] for b in raw])
        n = len(signs)
        last, count, ends = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        inner, ended, apart = self.inner, self.ended, self.apart
        for i in range(1, n + 1):
            for trie, going in ((inner, True), (ended, False)):
                node, h = trie, i
                while h:
                    h -= 1
                    node = node.get(signs[h])
                    if node is None:
                        raise ValueError(f"no token ends the prefix {signs[:i]!r}")
                    token = node.get(None)
                    if token is None:
                        continue
                    if h:
                        key = last[h] << 32 | token
                        fits = apart.get(key)
                        if fits is None:
                            if len(apart) >= PAIRS:
                                apart.clear()
                            fits = apart[key] = self._stay_apart(last[h], token)
                        if not fits:
                            continue
                    if going:
                        last[i], count[i] = token, count[h] + 1
                    else:
                        ends[i] = count[h] + 1
                    break
                else:
                    raise ValueError(f"no token ends the prefix {signs[:i]!r}")
        if not plain:
            cut = [0, *(i + 1 for i in range(n) if i + 1 == n or raw[i + 1] & 0xC0 != 0x80)]
            ends = [ends[i] for i in cut]
        return bytes(ends) if max(ends) < 256 else array("i", ends)

    def _piece(self, piece: str) -> bytes | array:
        own = self.prefixes.get(piece)
        if own is None:
            if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():  # before its last sign it is two pieces
                own = bytes([0, self._piece("'")[1], self._piece("'")[1] + self._piece(piece[1])[1], self._follow(piece)[3]])
            else:
                own = self._follow(piece)
            if len(self.total) >= TABLE:
                self.total.clear()
                self.prefixes.clear()
            self.prefixes[piece], self.total[piece] = own, own[-1]
        return own

    def _library(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> list[tuple[int, bytes | array]]:
        """(length, counts of its prefixes) of the parts of a word with signs beyond plain Latin, in order."""
        normal = self.tokenizer.normalizer.normalize_str
        low = [normal(c) for c in word]
        whole = normal(word)
        if "".join(low) != whole:
            own = array("i", [0, *(self._library(word[:k]) for k in range(1, len(word) + 1))])
            return [(len(word), own)]
        ends = np.cumsum([len(x) for x in low])  # in the normal form, by code point of the word
        counts = np.zeros(len(whole) + 1, np.int64)
        done = 0
        for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(whole):
            own = np.array(list(self._piece(whole[a:b])))
            counts[a + 1 : b + 1] = done + own[1:]
            done += int(own[-1])
            counts[b + 1 :] = done
        return [(len(word), array("i", [0, *counts[ends].tolist()]))]

    def parts(self, text: str) -> Iterator[tuple[int, int, bytes | array]]:
        """(start, end, counts of prefixes) of the parts of a text, in order; the counts of parts add up."""
        if _PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            for m in _PIECE.finditer(text.lower()):
                yield m.start(), m.end(), self._piece(m[0])
            return
        for m in _WORD.finditer(text):
            yield from self._mixed(m[0], m.start())

    def _mixed(self, word: str, at: int) -> Iterator[tuple[int, int, bytes | array]]:
        mark = self.special.search(word) if self.special else None
        if mark is None:
            if _PLAIN.fullmatch(word):
                for m in _PIECE.finditer(word.lower()):
                    yield at + m.start(), at + m.end(), self._piece(m[0])
                return
            for n, own in self._word(word):
                yield at, at + n, own
            return
        # up to its last sign a special token is ordinary text; then it is one token
        begun = [0] * mark.end()
        done = 0
        for a, b, own in self._mixed(word[: mark.end() - 1], 0):
            begun[a : b + 1] = [done + x for x in own]
            done += own[-1]
            begun[b:] = [done] * (mark.end() - b)
        yield at, at + mark.end(), array("i", [*begun, begun[mark.start()] + 1])
        yield from self._mixed(word[mark.end() :], at + mark.end()) if mark.end() < len(word) else ()

    def count(self, text: str) -> int:
        if _PLAIN.fullmatch(text) and not (self.special and self.special.search(text)):
            pieces = _PIECE.findall(text.lower())
            try:
                return sum(map(self.total.__getitem__, pieces))
            except KeyError:
                return sum([self._piece(p)[-1] for p in pieces])
        return sum(own[-1] for _, _, own in self.parts(text))

    def prefix_counts(self, text: str) -> np.ndarray:
        """The token count of text[:k] for every k from 0 to its length."""
        out = np.zeros(len(text) + 1, np.int32)
        done, at = 0, 0
        for a, b, own in self.parts(text):
            out[at : a + 1] = done
            out[a + 1 : b + 1] = np.frombuffer(own, np.uint8 if isinstance(own, bytes) else np.int32)[1:].astype(np.int32) + done
            done, at = done + own[-1], b
        out[at + 1 :] = done
        return out

    def longest(self, text: str, limit: int) -> int:
        """Length of the longest prefix with at most ``limit`` tokens; parts beyond it are not looked at."""
        done = 0
        for a, _, own in self.parts(text):
            if done + own[-1] > limit:
                return a + max(k for k, n in enumerate(own) if done + n <= limit)
            done += own[-1]
        return len(text)

    def tidy(self) -> None:
        """Forgets long pieces."""
        for p in [p for p in self.total if len(p) > LONG]:
            del self.total[p], self.prefixes[p]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def prefix_table(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, counts array<int>`` for each row of docs: the token count of every prefix, by code points from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                rows = [count.prefix_counts(t or "") for t in batch.column(1).to_pylist()]
                count.tidy()
                offs = np.cumsum([0, *map(len, rows)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(rows)))], ["doc_id", "counts"])

    return _texts(docs).mapInArrow(run, "doc_id long, counts array<int>")


def tokens_before(counts: Column, place: Column | int) -> Column:
    """Tokens of the prefix of that many code points, from a stored row; of the whole text where it is shorter."""
    at = F.lit(place) if isinstance(place, int) else place
    return F.element_at(counts, F.least(at + 1, F.size(counts)).cast("int"))


def fitting(counts: Column, limit: Column | int) -> Column:
    """Code points of the longest prefix with at most ``limit`` tokens, from a stored row."""
    most = F.lit(limit) if isinstance(limit, int) else limit
    return F.aggregate(counts, F.struct(F.lit(-1).alias("i"), F.lit(0).alias("k")), lambda s, c: F.struct((s["i"] + 1).alias("i"), F.when(c <= most, s["i"] + 1).otherwise(s["k"]).alias("k")))["k"]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, fitting_chars`` for each row of docs.

    vocabulary: path of a tokenizers file, present on every machine. fitting_chars: code points of the longest
    prefix that has no more than ``limit`` tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                n = [count.count(t) for t in texts]
                fit = [len(t) if total <= limit else count.longest(t, limit) for t, total in zip(texts, n, strict=True)]
                count.tidy()
                size = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int64())], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fitting_chars"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fitting_chars long")
