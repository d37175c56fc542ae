"""A semi-Markov conditional random field over the pieces of a short zone of text.

A segmentation covers the zone with entities of at most MOST pieces and single outside pieces. An entity scores
the product of its type's weights with features of the whole span (its shape, length, digits, entropy, and the
words around it); an outside piece scores 0. Decoding and the partition sum are dynamic programmes over ends, so
types and boundaries are chosen jointly. Segments are not chosen by pattern: all are scored that hold enough to
be an entity (``worth``).
"""

from __future__ import annotations

import math
import random
import re

import numpy as np

#: Most pieces of an entity; the numbers and addresses that are looked for have fewer.
MOST = 24
TYPES = ("email", "ip", "card", "phone", "secret", "id")
_PIECE = re.compile(rb"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_GROUPS = re.compile(rb"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?:[ .-][0-9]{2,4})?")
_LOCAL = re.compile(rb"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
_SOCIAL = re.compile(rb"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_DATE = re.compile(rb"[0-9]{1,4}([-./])[0-9]{1,2}\1[0-9]{1,4}(?:[ T][0-9:.]+)?")
_KEY = re.compile(rb"(?:AKIA|ASIA)[A-Z0-9]{16}")
_HEX = re.compile(rb"[0-9a-f]{16,}|[A-Za-z0-9_]{20,}")
_MADE = re.compile(rb"(?:gh[pousr]|sk|pk|rk|xox[abp]|glpat|hf|npm)[_-][A-Za-z0-9_-]{16,}")
_RUN = re.compile(rb"[A-Za-z0-9_+/=.~!#%^&*-]+")
_NUMBER = re.compile(rb"[0-9 ().+-]+")
_NAMED = re.compile(rb"(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth)\s*[=:]\s*[\"']?$", re.I)
_CALL = re.compile(rb"(?:phone|tel|call|mobile|cell|fax|whatsapp)\W{1,4}$", re.I)
_IDENT = re.compile(rb"(?:ssn|social security|social|national id|tax id)\W{1,4}$", re.I)
_VALUE_END = re.compile(rb"[\s\"',;)\]}]|\.?$|\.\s")
FEATURES = (
    "bias", "email", "ip", "luhn", "phone", "groups", "key", "hex", "named", "left", "right", "digits13_19", "spaces",
    "local", "social", "date", "made", "run", "entropy", "letters", "mixed", "value", "call", "ident", "length",
)


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = d - 48
        if i % 2:
            x = x * 2 - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _entropy(span: bytes) -> float:
    """Bits a byte."""
    n = len(span)
    return -sum(c / n * math.log2(c / n) for c in (span.count(x) for x in set(span)))


def features(text: bytes, a: int, b: int) -> list[float]:
    """Of the span text[a:b], with the characters around it."""
    span, before = text[a:b], text[max(0, a - 24) : a]
    digits = bytes(c for c in span if 48 <= c <= 57)
    n = len(digits)
    ip = bool(_IP.fullmatch(span)) and all(int(x) < 256 for x in span.split(b"."))
    left = a == 0 or not (text[a - 1 : a].isalnum() or text[a - 1] >= 128)
    right = b == len(text) or not (text[b : b + 1].isalnum() or text[b] >= 128)
    dotted = (a > 1 and text[a - 1] in b".-" and text[a - 2 : a - 1].isdigit()) or (b + 1 < len(text) and text[b] in b".-" and text[b + 1 : b + 2].isalnum())
    run = bool(_RUN.fullmatch(span))
    long = run and b - a >= 16
    named = bool(_NAMED.search(before))
    return [
        1.0, bool(_EMAIL.fullmatch(span)), ip, bool(_CARD.fullmatch(span)) and 13 <= n <= 19 and luhn(digits), bool(_PHONE.fullmatch(span)) and 9 <= n <= 15,
        bool(_GROUPS.fullmatch(span)) and 9 <= n <= 15, bool(_KEY.fullmatch(span)), bool(_HEX.fullmatch(span)) and n >= 3 and n < len(span), named,
        left and not dotted, right and not dotted, 13 <= n <= 19, span.count(b" ") / 4,
        bool(_LOCAL.fullmatch(span)), bool(_SOCIAL.fullmatch(span)), bool(_DATE.fullmatch(span)), bool(_MADE.fullmatch(span)), run, _entropy(span) / 4 if long else 0.0,
        span.isalpha(), long and 0 < n < b - a, named and run and bool(_VALUE_END.match(text, b)), bool(_CALL.search(before)), bool(_IDENT.search(before)), min(b - a, 32) / 32,
    ]


def worth(text: bytes, a: int, b: int, digits: int, ats: int) -> bool:
    """Whether a segment holds enough to be an entity: an address, a number, or a run that is named or opaque.

    Numbers have 4 to 19 digits and three marks or seven digits at least; a run of any length may be a secret.
    """
    if ats:
        return ats == 1 and b - a >= 6 and bool(_RUN.fullmatch(text[a:b].replace(b"@", b".")))
    if _NUMBER.fullmatch(text, a, b):
        return digits <= 19 and (digits >= 7 or digits >= 4 and text.count(b".", a, b) == 3)
    if b - a < 6 or not _RUN.fullmatch(text, a, b):
        return False
    return bool(b - a >= 16 and (digits or _MADE.match(text, a, b)) or _NAMED.search(text, max(0, a - 24), a))


def candidates(text: bytes, low: int = 0) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
    """Pieces, spans of pieces (first, past the last) that may be entities, and their features. Only text[low:] is cut."""
    pieces = [m.span() for m in _PIECE.finditer(text, low)]
    digits = np.concatenate([[0], np.cumsum([sum(48 <= c <= 57 for c in text[a:b]) for a, b in pieces])]).tolist()
    ats = np.concatenate([[0], np.cumsum([text[a:b] == b"@" for a, b in pieces])]).astype(int).tolist()
    spans, rows = [], []
    for i, (a, _) in enumerate(pieces):
        if not (text[a : a + 1].isalnum() or text[a : a + 1] in (b"+", b"(")):
            continue
        for j in range(i + 1, min(i + MOST, len(pieces)) + 1):
            b = pieces[j - 1][1]
            if (text[b - 1 : b].isalnum() or text[b - 1 : b] == b")") and worth(text, a, b, digits[j] - digits[i], ats[j] - ats[i]):
                spans.append((i, j))
                rows.append(features(text, a, b))
    return pieces, spans, np.array(rows, float).reshape(-1, len(FEATURES))


def decode(text: bytes, weights: np.ndarray, low: int = 0) -> list[tuple[str, int, int]]:
    """The best segmentation's entities: type, start, end."""
    pieces, spans, x = candidates(text, low)
    if not spans:
        return []
    gain = x @ weights.T
    kind = gain.argmax(1)
    top = gain.max(1)
    by_end: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(spans):
        by_end.setdefault(j, []).append(k)
    best, back = [0.0] * (len(pieces) + 1), [-1] * (len(pieces) + 1)
    for j in range(1, len(pieces) + 1):
        best[j] = best[j - 1]
        for k in by_end.get(j, ()):
            if (s := best[spans[k][0]] + top[k]) > best[j]:
                best[j], back[j] = s, k
    out, j = [], len(pieces)
    while j > 0:
        if back[j] < 0:
            j -= 1
        else:
            i = spans[back[j]][0]
            out.append((TYPES[kind[back[j]]], pieces[i][0], pieces[j - 1][1]))
            j = i
    return out[::-1]


def gradient(zones: list, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """Of the log likelihood of zones ``(pieces, spans, x, gold)``, gold: {span number: type number}."""
    g, total = np.zeros_like(weights), 0.0
    for n, spans, x, gold in zones:
        s = x @ weights.T
        any_type = np.logaddexp.reduce(s, axis=1) if len(s) else np.zeros(0)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(spans):
            ends[j].append(k)
            starts[i].append(k)
        fwd, bwd = np.zeros(n + 1), np.zeros(n + 1)
        for j in range(1, n + 1):
            fwd[j] = np.logaddexp.reduce([fwd[j - 1], *(fwd[spans[k][0]] + any_type[k] for k in ends[j])])
        for i in range(n - 1, -1, -1):
            bwd[i] = np.logaddexp.reduce([bwd[i + 1], *(bwd[spans[k][1]] + any_type[k] for k in starts[i])])
        if len(s):
            i, j = np.array(spans).T
            p = np.exp(fwd[i][:, None] + s + bwd[j][:, None] - fwd[n])
            g -= p.T @ x
        for k, y in gold.items():
            g[y] += x[k]
            total += s[k, y]
        total -= fwd[n]
    return g, total


def made_up_zone(rng: random.Random) -> tuple[bytes, list[tuple[str, int, int]]]:
    """A zone with its true entities: invented numbers, addresses and keys among look-alikes."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        n = rng.choice([13, 15, 16, 16, 16, 19])
        head = rng.choice("3456") + digits(n - 2)
        last = next(d for d in "0123456789" if luhn((head + d).encode()))
        whole = head + last
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(whole[i : i + 4] for i in range(0, n, 4))

    def phone() -> str:
        d = digits
        return rng.choice([f"+{rng.randint(1, 99)} ({d(3)}) {d(3)}-{d(4)}", f"+{rng.randint(1, 99)} {d(2)} {d(4)} {d(4)}", f"+{rng.randint(1, 99)}-{d(3)}-{d(3)}-{d(4)}", f"+{rng.randint(1, 9)}{d(10)}"])

    def odd() -> str:
        d = digits
        while luhn((n := d(16)).encode()):
            pass
        return rng.choice([str(rng.randint(1900, 2030)), f"{rng.randint(0, 99)}.{d(2)}", f"{rng.randint(1, 9)}.{rng.randint(0, 9)}", f"2024-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{d(1)},{d(3)}.{d(2)}", f"{d(3)}-{d(4)}", n, f"{rng.randint(256, 999)}.{d(2)}.{d(2)}.{d(2)}", f"1.{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}.{d(1)}", name() + d(2), f"{d(2)}:{d(2)}", "@" + name() + d(1), f"({d(4)})", f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{rng.randint(10, 28)}/{rng.randint(10, 12)}/{rng.randint(1990, 2030)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(1)},{d(3)},{d(3)}", d(7), d(8), d(9), d(10), f"x={d(3)}", f"{name()}_{name()}_{name()}", f"total_{name()} = {d(7)}", f"{name()}={name()}{name()}", f"{name()}-{name()}-{d(4)}", f"{d(2)}-{d(7)}", f"{d(4)}-{d(4)}", f"v{d(1)}.{d(2)}.{d(4)}", name() + name() + name() + name() + d(1)])

    def local() -> str:
        d = digits
        return rng.choice(["", "", "call ", "phone: ", "tel. "]) + rng.choice([f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}"])

    def secret() -> str:
        upper = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
        opaque = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
        value = rng.choice([lambda: hexes(rng.choice([18, 32, 40])), lambda: name() + name() + name(), lambda: upper(rng.randint(12, 32)), lambda: opaque(rng.randint(8, 40)), lambda: name() + "-" + name() + digits(2), lambda: name() + "_" + name() + "!" + digits(3)])
        lead = rng.choice(["password", "passwd", "PASSWORD", "secret", "token", "api_key", "apikey", "API_KEY", "access_key"])
        return rng.choice(["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), f"{lead}={value()}", f'{lead} = "{value()}"', f"{lead}: {value()}", hexes(40), rng.choice(["ghp_", "sk-", "hf_", "xoxb-"]) + rng.choice([opaque, upper])(rng.randint(20, 36)), opaque(32) + digits(4)])

    makers = {
        "email": lambda: f"{name()}{rng.choice(['.', '_', '', '-'])}{digits(rng.randint(0, 2))}@{name()}{rng.choice(['', digits(1)])}.{rng.choice(['example.com', 'org', 'co.uk'])}".replace(".@", "@").replace("-@", "@"),
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: rng.choice([phone, phone, local])(),
        "secret": secret,
        "id": lambda: rng.choice(["", "", "SSN ", "ssn: ", "social security "]) + f"{digits(3)}-{digits(2)}-{digits(4)}",
    }
    text, gold = "", []
    for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
        kind = rng.choice([*TYPES, "secret", "odd", "odd", "odd", "odd"])
        part = odd() if kind == "odd" else makers[kind]()
        if text:
            text += rng.choice([" ", " ", ", ", ". "])
        if kind != "odd":
            own = part
            if kind in ("secret", "id", "phone") and (m := re.match(r"[A-Za-z_ ]+[.:=]?[=:]? [\"']?|[A-Za-z_]+[=:]", part)):
                own = part[m.end() :]
            own = own.strip(' "')
            at = len(text) + part.rindex(own)
            gold.append((kind, at, at + len(own)))
        text += part
    return (text + rng.choice(["", ".", ","])).encode(), gold


def train(zones: int = 1500, seed: int = 7, steps: int = 120, decay: float = 0.02) -> np.ndarray:
    """Weights [type, feature] by maximum likelihood on made-up zones."""
    rng = random.Random(seed)
    data = []
    for _ in range(zones):
        text, gold = made_up_zone(rng)
        pieces, spans, x = candidates(text)
        where = {(pieces[i][0], pieces[j - 1][1]): k for k, (i, j) in enumerate(spans)}
        data.append((len(pieces), spans, x, {where[a, b]: TYPES.index(t) for t, a, b in gold if (a, b) in where}))
    w = np.zeros((len(TYPES), len(FEATURES)))
    w[:, 0] = -2
    m = v = np.zeros_like(w)
    for t in range(1, steps + 1):
        g, _ = gradient(data, w)
        g = g / len(data) - decay / 10 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


#: Result of train(); rows: TYPES, columns: FEATURES.
WEIGHTS = np.array(
    [
        [-3.83, 3.71, -0.19, -0.07, -0.06, -0.06, -0.04, -0.13, -0.07, 1.14, 1.14, -1.07, -1.31, -0.22, -0.04, -0.47, -0.07, -2.83, -0.53, -0.01, -0.43, -0.06, -0.12, -0.03, 2.35],
        [-4.11, -0.41, 4.97, -0.09, -0.06, -0.06, -0.04, -0.07, -0.13, 1.41, 1.41, -0.72, -0.69, -0.22, -0.11, -0.63, -0.04, -1.31, -0.58, -0.02, -0.45, -0.11, -0.09, -0.04, -0.18],
        [-3.14, -0.14, -0.19, 5.01, -0.03, -0.03, -0.05, -0.09, -0.06, 0.32, 0.32, 1.52, 0.66, -0.09, -0.05, -0.42, -0.03, -1.03, 0.39, -0.01, 0.06, -0.04, -0.06, -0.04, -0.8],
        [-2.55, -0.32, -0.3, -0.08, 3.24, 3.25, -0.09, -0.11, -0.1, 0.5, 0.5, -0.91, 0.4, 3.73, -0.06, -0.59, -0.04, -1.33, -0.05, -0.02, 0.26, -0.08, 1.5, -0.03, -0.57],
        [-3.16, -0.28, -0.32, -0.19, -0.11, -0.11, 2.13, 2.56, 2.66, 0.14, 0.14, -1.08, -0.51, -0.13, -0.07, -0.52, 2.72, -0.86, 1.95, 0.35, 0.44, 3.01, -0.04, -0.02, 1.21],
        [-2.81, -0.15, -0.22, -0.04, -0.02, -0.02, -0.02, -0.02, -0.05, 0.17, 0.17, -0.44, -0.43, -0.08, 4.56, 1.71, -0.01, -0.98, -0.26, -0.01, -0.21, -0.04, -0.03, 1.34, -0.98],
    ]
)
