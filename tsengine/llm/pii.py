"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The tagger is trained in numpy on windows of a bounded sample of
the same texts: windows labelled with their base spans, windows without any, and windows into which
forms that the patterns miss were put (``forms``: spelled or spaced addresses, IPv6, numbers
grouped or failing their check, phone numbers without a plus sign, account numbers, and access
keys, the fifth kind) or harmless look-alikes (dates, prices, versions, identifiers of files).
Windows of ``WINDOW`` characters at every ``STRIDE`` tile the whole text; a form without a digit,
an ``@`` and a spelled ``dot`` is none of the kinds, so windows without all three are outside.
Every other window is decoded by Viterbi. Windows overlap by half and are reconciled over the whole
text: a character takes its tag from the window in which it is most central, and spans are read
from the joined tags, so none is cut at a window's edge. Spans of the tagger that overlap no base
span are added to them.

Defined results: offsets are code points, end exclusive; a null or empty text has no spans; texts
of any length are searched whole; equal texts have equal spans. Where no text of the sample has
words the result is the base alone. Input columns named like an output give way to it.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.llm.common import crc_of_id, map_texts, table

#: The kinds of the patterns; and of the tagger, which knows access keys, too.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "key")
WINDOW, STRIDE = 96, 48
HIDDEN = 16
#: The training sample: documents read (about; an id brings all its rows), windows trained on as they
#: are and windows with a form put in (both bounds).
SAMPLE_DOCS, SAMPLE_WINDOWS, FORM_WINDOWS = 4000, 2000, 3000
#: Windows that the fit passes over, repeats included.
PASSED = 45_000
#: An added span has at least so many characters.
LEAST = 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each ``@``: back over the local part, on over the domain. Linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
            done = found.end()
        else:
            done = max(done, at + 1)  # no later local part reaches back over an @
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; leftmost and non-overlapping within each kind."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (g.lstrip("0") for g in m.groups())):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# Classes of characters: what the tagger sees. 0 pads, 1 digits, 2 other ASCII, 3 beyond ASCII, 4 and 5 lower
# and upper letters, 6 letters of hexadecimal digits, then the letters of "at" and "dot", then signs.
_SPELLED, _SIGNS = "adot", " .@-+()_%\n:[]\"=/#,"
CLASSES = 7 + len(_SPELLED) + len(_SIGNS)
_CLASS = np.full(128, 2, np.int64)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 1, 4, 5
_CLASS[[ord(c) for c in "bcefBCEF"]] = 6
for _case in (_SPELLED, _SPELLED.upper()):
    _CLASS[[ord(c) for c in _case]] = np.arange(7, 7 + len(_SPELLED))
_CLASS[[ord(c) for c in _SIGNS]] = np.arange(7 + len(_SPELLED), CLASSES)
_D, _O, _T, _AT = (_CLASS[ord(c)] for c in "dot@")


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 3)


def signs(seen: np.ndarray) -> np.ndarray:
    """Places of digits, of ``@``, and of the word ``dot``."""
    letter = np.concatenate([[False], (seen >= 3) & (seen < 7 + len(_SPELLED)), [False]])
    at = np.flatnonzero((seen[:-2] == _D) & (seen[1:-1] == _O) & (seen[2:] == _T))
    at = at[~letter[at] & ~letter[at + 4]]
    return np.union1d(np.flatnonzero((seen == 1) | (seen == _AT)), at)


def windows(seen: np.ndarray) -> np.ndarray:
    """Numbers of the windows that hold a digit, an ``@`` or a spelled dot."""
    place = signs(seen)
    tiles = np.unique(np.concatenate([place // STRIDE, place // STRIDE - 1]))
    return tiles[tiles >= 0]


def cut(seen: np.ndarray, tiles: np.ndarray) -> np.ndarray:
    padded = np.concatenate([seen, np.zeros(WINDOW, np.int64)])
    return padded[(tiles * STRIDE)[:, None] + np.arange(WINDOW)]


def reconciled(tiles: np.ndarray, tags: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Spans of the whole text from the decoded windows, each heard where it is most central."""
    edge = (WINDOW - STRIDE) // 2
    pieces = []  # (start, kind, end, opens a span)
    for t, row in zip(tiles.tolist(), tags):
        begin = t * STRIDE
        lo = 0 if t == 0 else edge
        hi = min(WINDOW if begin + WINDOW >= length else WINDOW - edge, length - begin)
        tag = row[lo:hi]
        if not tag.any():
            continue
        kind = (tag + 1) // 2
        change = np.flatnonzero((np.diff(kind, prepend=-1) != 0) | (tag % 2 == 1))
        stop = np.append(change[1:], len(tag))
        pieces += [
            (begin + lo + int(a), int(kind[a]) - 1, begin + lo + int(b), tag[a] % 2 == 1) for a, b in zip(change, stop) if kind[a]
        ]
    out: list[tuple[int, int, int]] = []
    for start, kind, end, opens in pieces:
        if out and not opens and out[-1][1] == kind and out[-1][2] == start:
            out[-1] = (out[-1][0], kind, end)
        else:
            out.append((start, kind, end))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


TAGS = 1 + 2 * len(KINDS)  # outside; then begin and inside of every kind
_NEVER = np.float32(-1e4)


def _barred() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and starts that no labelling has: inside a kind only after its begin or inside."""
    step, start = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)
    for k in range(len(KINDS)):
        begin, inside = 2 * k + 1, 2 * k + 2
        step[[i for i in range(TAGS) if i not in (begin, inside)], inside] = _NEVER
    return step, start  # a window may start inside a span


class Tagger:
    """Weights of both directions, the emission layer and the CRF."""

    def __init__(self, seed: int = 3):
        rng, h = np.random.default_rng(seed), HIDDEN
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.w["u" + d] = rng.normal(0, 1 / np.sqrt(h), (h, 4 * h))
            self.w["c" + d] = np.zeros(4 * h)
            self.w["c" + d][h : 2 * h] = 1.0  # remember at first
        self.w["out"] = rng.normal(0, 0.3, (2 * h, TAGS))
        self.w["bias"] = np.zeros(TAGS)
        self.w["step"] = np.zeros((TAGS, TAGS))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.barred = _barred()[0]

    def lstm(self, x: np.ndarray, d: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (time, batch, HIDDEN) of one direction over classes (batch, time)."""
        n, t = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, trace = np.empty((t, n, HIDDEN), np.float32), []
        table_, u = self.w["x" + d] + self.w["c" + d], self.w["u" + d]
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table_[x[:, s]] + h @ u
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before_h, before_c = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[s] = h
            if keep:
                trace.append((s, i, f, o, g, before_h, before_c, tc))
        return out, trace

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.lstm(x, "f")[0], self.lstm(x, "b")[0]], 2)
        return both @ self.w["out"] + self.w["bias"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (batch, time) by Viterbi."""
        e, step = self.emissions(x), self.w["step"] + self.barred
        t, n, _ = e.shape
        best, back = e[0], np.empty((t, n, TAGS), np.int8)
        for s in range(1, t):
            total = best[:, :, None] + step
            back[s] = total.argmax(1)
            best = total.max(1) + e[s]
        out = np.empty((n, t), np.int8)
        out[:, -1] = best.argmax(1)
        for s in range(t - 1, 0, -1):
            out[:, s - 1] = back[s][np.arange(n), out[:, s]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood of the tags ``y`` (batch, time) and its gradients."""
        n, t = x.shape
        h = HIDDEN
        states, traces = zip(*(self.lstm(x, d, keep=True) for d in "fb"))
        both = np.concatenate(states, 2)
        e = both @ self.w["out"] + self.w["bias"]
        step = self.w["step"] + self.barred
        # forward and backward sums of the CRF in the log domain
        ahead, behind = np.empty_like(e), np.zeros_like(e)
        ahead[0] = e[0]
        for s in range(1, t):
            ahead[s] = _logsum(ahead[s - 1][:, :, None] + step, 1) + e[s]
        for s in range(t - 2, -1, -1):
            behind[s] = _logsum(step + (e[s + 1] + behind[s + 1])[:, None, :], 2)
        total = _logsum(ahead[-1], 1)
        marginal = np.exp(ahead + behind - total[None, :, None])
        rows, gold = np.arange(n), y.T
        score = np.take_along_axis(e, gold[:, :, None].astype(np.int64), 2).sum() + step[gold[:-1], gold[1:]].sum()
        de = marginal
        de[np.arange(t)[:, None], rows, gold] -= 1
        pairs = np.zeros_like(step)
        for s in range(t - 1):
            pair = ahead[s][:, :, None] + step + (e[s + 1] + behind[s + 1])[:, None, :] - total[:, None, None]
            pairs += np.exp(pair).sum(0)
        np.add.at(pairs, (gold[:-1].ravel(), gold[1:].ravel()), -1)
        flat = de.reshape(-1, TAGS)
        out = {"step": pairs * (self.barred == 0), "out": both.reshape(-1, 2 * h).T @ flat, "bias": flat.sum(0)}
        dboth = de @ self.w["out"].T
        for d, trace, part in zip("fb", traces, (slice(0, h), slice(h, 2 * h))):
            dx, du = np.zeros_like(self.w["x" + d]), np.zeros_like(self.w["u" + d])
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            every = np.arange(CLASSES)[:, None]
            for s, i, f, o, g, before_h, before_c, tc in reversed(trace):
                dh = dh + dboth[s][:, part]
                dc = dc + dh * o * (1 - tc * tc)
                dz = np.concatenate(
                    [dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1
                )
                dx += (x[:, s] == every).astype(np.float32) @ dz
                du += before_h.T @ dz
                dh, dc = dz @ self.w["u" + d].T, dc * f
            out["x" + d], out["u" + d], out["c" + d] = dx, du, dx.sum(0)
        return float(total.sum() - score) / n, {k: v / n for k, v in out.items()}


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.025, seed: int = 3) -> Tagger:
    """Adam with clipped gradients on labelled windows (classes and tags, both (windows, WINDOW))."""
    model, rng = Tagger(seed), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in model.w.items()}
    v = {k: np.zeros_like(w) for k, w in model.w.items()}
    count = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            some = order[lo : lo + batch]
            _, grads = model.gradients(x[some], y[some])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            count += 1
            now = rate * (1 - 0.8 * epoch / max(epochs - 1, 1))
            for k, g in grads.items():
                g = (g * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                model.w[k] -= now * (m[k] / (1 - 0.9**count)) / (np.sqrt(v[k] / (1 - 0.99**count)) + 1e-6)
    return model


def tagged(spans: list[tuple[int, int, int]], length: int) -> np.ndarray:
    """Tags of a text from its spans; where kinds overlap the first kind stands."""
    out = np.zeros(length, np.int8)
    for s, k, e in sorted(spans, key=lambda x: (-x[1], x[0])):
        out[s:e] = 2 * k + 2
        out[s] = 2 * k + 1
    return out


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng: np.random.Generator, low: int = 2, high: int = 9) -> str:
    return "".join(chr(97 + int(i)) for i in rng.integers(0, 26, rng.integers(low, high + 1)))


def _pick(rng: np.random.Generator, options):
    return options[int(rng.integers(len(options)))]


def _drawn(rng: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[int(i)] for i in rng.integers(0, len(alphabet), n))


def _spelled_email(rng: np.random.Generator) -> str:
    at, dot = _pick(rng, ((" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" @ ", " . "), (" AT ", " DOT ")))
    user = _word(rng) + _pick(rng, ("", "." + _word(rng), "_" + _word(rng), _digits(rng, 2)))
    if "dot" in dot.lower() and rng.random() < 0.3:
        user = _word(rng) + dot + _word(rng)
    return user + at + _word(rng, 3) + _pick(rng, ("", dot + _word(rng, 3))) + dot + _pick(rng, ("com", "org", "net", "de", "fr", "es", "info", "co"))


def _hidden_ip(rng: np.random.Generator) -> str:
    if rng.random() < 0.5:
        groups = [_drawn(rng, "0123456789abcdef", int(rng.integers(1, 5))) for _ in range(8)]
        if rng.random() < 0.5:
            at, n = int(rng.integers(1, 4)), int(rng.integers(2, 5))
            groups[at : at + n] = [""]
        out = ":".join(groups)
        return out.upper() if rng.random() < 0.3 else out
    return _pick(rng, (" . ", "[.]", "(.)", " dot ", "[dot]")).join(str(int(i)) for i in rng.integers(0, 256, 4))


def _hidden_card(rng: np.random.Generator) -> str:
    if rng.random() < 0.3:  # account numbers of banks
        head = "".join(chr(65 + int(i)) for i in rng.integers(0, 26, 2)) + _digits(rng, 2)
        rest, gap = _digits(rng, int(rng.integers(12, 21))), _pick(rng, (" ", "", "-"))
        return gap.join([head, *(rest[i : i + 4] for i in range(0, len(rest), 4))])
    sep = _pick(rng, ("", " ", "-", ".", "_", "/", "  "))
    return sep.join(_digits(rng, 4) for _ in range(4)) if rng.random() < 0.8 else sep.join((_digits(rng, 4), _digits(rng, 6), _digits(rng, 5)))


def _hidden_phone(rng: np.random.Generator) -> str:
    a, b, c, sep = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4), _pick(rng, (".", "-", " "))
    return _pick(
        rng,
        (
            f"({a}) {b}{sep}{c}", f"{a}{sep}{b}{sep}{c}", f"1{sep}{a}{sep}{b}{sep}{c}", f"+{a}/{b}/{c}", f"+{_digits(rng, 2)}.{a}.{b}.{c}",
            f"00{_digits(rng, 2)} {a} {b}{c}", f"0{a} {b}{c}", f"0{a}/{b}{c}", f"0{_digits(rng, 1)} " + " ".join(_digits(rng, 2) for _ in range(4)),
        ),
    )


def _key(rng: np.random.Generator) -> str:
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    head = _pick(rng, ("", "", _word(rng, 2, 3) + "_", _word(rng, 2, 3) + "-", _word(rng, 4, 4).upper()))
    alphabet = _pick(rng, ("0123456789abcdef", "0123456789abcdef", mixed, mixed[:26] + mixed[52:], mixed + "-_+/"))
    return head + _drawn(rng, alphabet, int(rng.integers(20, 65)))


def _harmless(rng: np.random.Generator) -> str:
    """Digits and signs that are no personal data."""
    n, word = int(rng.integers(1, 7)), _word(rng)
    day, month, year = int(rng.integers(1, 29)), int(rng.integers(1, 13)), int(rng.integers(1800, 2100))
    return _pick(
        rng,
        (
            _digits(rng, n), f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{month}/{day}/{year}", f"{year}-{year + n}",
            f"{n},{_digits(rng, 3)},{_digits(rng, 3)}", f"${_digits(rng, n)}.{_digits(rng, 2)}", f"{_digits(rng, 2)}%", f"{n}.{month}",
            f"{n}.{month}.{day}", f"version {n}.{month}", f"{day:02}:{month:02}", f"{day:02}:{month:02}:{n:02}", f"{word}{_digits(rng, n)}",
            f"{word}_{_digits(rng, n)}.txt", f"#{_digits(rng, n)}", f"({year})", f"[{n}]", f"{n} x {_digits(rng, 3)}", f"{word} @ {word}",
            f"@{word}", f"the dot on {word}", f"{word} dot {word}", f"{word} at {word}", f"= {_digits(rng, n)}", f"{n}:{month}", f"{n} / {day}",
            f"ISBN {_digits(rng, 3)}-{n}", f"{_digits(rng, 3)} {_digits(rng, 3)}", f"{_digits(rng, 2)}-{_digits(rng, 3)}", f"{word}: {_digits(rng, 8)}",
            f"{word} {_digits(rng, n)} {word} {_digits(rng, 2)}", f"= {_digits(rng, 2)} + {_digits(rng, 2)}", f"https://{word}.org/{word}/{n}",
        ),
    )


_MAKERS = (_spelled_email, _hidden_ip, _hidden_card, _hidden_phone, _key)


def forms(rng: np.random.Generator, n: int) -> list[tuple[int, str]]:
    """(kind, form): what the patterns miss, each kind as often as look-alikes (kind -1, three times as often)."""
    out: list[tuple[int, str]] = []
    while len(out) < n:
        kind = int(rng.integers(0, len(KINDS) + 3))
        made = _MAKERS[kind](rng) if kind < len(KINDS) else _harmless(rng)
        found = base_spans(made)
        if not found:  # a form that the patterns find needs no tagger
            out.append((kind if kind < len(KINDS) else -1, made))
    return out


def put_in(rng: np.random.Generator, left: str, right: str, kind: int, form: str) -> tuple[str, np.ndarray]:
    """A window of real text with a form in it or cut by its edge, and its tags."""
    lead = _pick(rng, (" ", " ", " ", "\n", ": ", " (", ' "', " = ", ', "'))
    tail = {" (": ")", ' "': '"', ', "': '"'}.get(lead, _pick(rng, ("", "", "", ".", ",", ";"))) + _pick(rng, (" ", " ", "\n"))
    if rng.random() < 0.05:
        left, lead = "", ""
    text = left + lead + form + tail + right
    begin = len(left) + len(lead)
    tags = tagged([(begin, kind, begin + len(form))] if kind >= 0 else [], len(text))
    at = int(rng.integers(max(begin + len(form) // 2 - WINDOW + 1, 0), max(min(begin + len(form) // 2, len(text) - WINDOW), 0) + 1))
    tags = np.concatenate([tags[at : at + WINDOW], np.zeros(WINDOW, np.int8)])[:WINDOW]
    return text[at : at + WINDOW], tags


def sample_windows(docs: DataFrame, text: str = "text") -> list[list[str]]:
    """Windows of a bounded sample, each followed by its tags: documents by a hash of the id, then windows by hash.

    Three parts: with base spans, with signs alone, and any (one a document). Windows that may hold
    what the patterns miss (``doubtful``) are none of them, since nothing says whether they do.
    """
    total = docs.count()
    step = max(total // SAMPLE_DOCS, 1)
    some = docs.filter(F.pmod(crc_of_id(), F.lit(step)) == 0).select(F.col(text).alias("text"))
    kinds = T.ArrayType(T.StringType())
    fields = [T.StructField(c, kinds) for c in ("held", "signed", "plain")]

    def build():
        def work(texts: pa.Array) -> list:
            out: list[list] = [[], [], []]
            for t in texts.to_pylist():
                t = t or ""
                tags, parts = bytes(tagged(base_spans(t), len(t)).view(np.uint8) + 65).decode(), ([], [], [])
                places = [(0, i * STRIDE) for i in windows(classes(t)).tolist()]
                if t:
                    places.append((2, zlib.crc32(t.encode("utf-8", "replace")) % ((len(t) - 1) // STRIDE + 1) * STRIDE))
                for part, lo in places:
                    w, marks = t[lo : lo + WINDOW], tags[lo : lo + WINDOW]
                    if not doubtful(w, marks):
                        parts[part or int(marks.count("A") == len(marks))].append(w + marks)
                for column, part in zip(out, parts):
                    column.append(part)
            return [pa.array(c, pa.list_(pa.string())) for c in out]

        return work

    found = map_texts(some, "text", fields, build, keep=[])
    each = found.select(F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(1), F.lit(2)), F.array("held", "signed", "plain"))).alias("part", "w"))
    each = each.select("part", F.explode("w").alias("w")).distinct()
    bounds = (SAMPLE_WINDOWS // 2, SAMPLE_WINDOWS // 2, FORM_WINDOWS)
    drawn = [each.filter(F.col("part") == k).orderBy(F.md5("w"), "w").limit(n) for k, n in enumerate(bounds)]
    return [[r["w"] for r in part.collect()] for part in drawn]


_LONG, _MANY = re.compile(r"\S*[0-9]\S*"), re.compile(r"(?:[0-9][^0-9\n]{0,3}){7}")


def doubtful(window: str, marks: str) -> bool:
    """Outside the base spans: long strings with digits, many digits in a row, an ``@`` or a spelled dot."""
    rest = "".join(c if m == "A" else "x" for c, m in zip(window, marks))
    return "@" in rest or bool(re.search(r"(?i)\bdot\b", rest)) or any(len(m[0]) >= 12 for m in _LONG.finditer(rest)) or bool(_MANY.search(rest))


def training_windows(docs: DataFrame, text: str = "text", seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of the sample as it is, and of its windows with forms put in."""
    cut_ = [[(r[: len(r) // 2], np.frombuffer(r[len(r) // 2 :].encode(), np.uint8) - 65) for r in part] for part in sample_windows(docs, text)]
    rng, rows, plain = np.random.default_rng(seed), cut_[0] + cut_[1], [w for w, _ in cut_[2]]
    context = [w for w in plain if not signs(classes(w)).size] or [w for w in plain if w.strip()]
    if context:
        for kind, form in forms(rng, FORM_WINDOWS):
            rows.append(put_in(rng, _pick(rng, context), _pick(rng, context), kind, form))
    x, y = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for i, (w, tags) in enumerate(rows):
        seen = classes(w)
        x[i, : len(seen)], y[i, : len(tags)] = seen, tags
    return x, y


def train(docs: DataFrame, text: str = "text") -> Tagger | None:
    x, y = training_windows(docs, text)
    if not y.any():
        return None
    return fit(x, y, epochs=max(PASSED // len(x), 1))


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]], batch: int = 768) -> list[list]:
    """Spans of the tagger that overlap no base span."""
    seen = [classes(t) for t in texts]
    tiles = [windows(s) for s in seen]
    out: list[list] = [[] for _ in texts]
    flat = [(i, t) for i, tile in enumerate(tiles) for t in (tile[j : j + batch] for j in range(0, len(tile), batch))]
    decoded: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[tuple[int, np.ndarray]] = []
    size = 0
    for k, (i, part) in enumerate(flat):
        group.append((i, cut(seen[i], part)))
        size += len(part)
        if size >= batch or k == len(flat) - 1:
            tags = tagger.decode(np.concatenate([rows for _, rows in group]))
            at = 0
            for j, rows in group:
                decoded[j].append(tags[at : at + len(rows)])
                at += len(rows)
            group, size = [], 0
    for i, t in enumerate(texts):
        if not decoded[i]:
            continue
        taken = _merged(base[i])
        begins = [s for s, _ in taken]
        for s, k, e in reconciled(tiles[i], np.concatenate(decoded[i]), len(t)):
            near = bisect_left(begins, e)  # the last base span that starts before e
            if e - s >= LEAST and (near == 0 or taken[near - 1][1] <= s):
                out[i].append((s, k, e))
    return out


def _merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, _, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


FIELDS = [
    *[T.StructField(f"n_{k}", T.LongType()) for k in BASE],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_spans", T.LongType()),
]


def find(docs: DataFrame, tagger: Tagger | None, text: str = "text", keep: list[str] | None = None, batch: int = 64) -> DataFrame:
    """``keep`` (default: all columns), counts and digest of the base spans, and all ``spans`` and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # a fixed number of weights

    def build():
        model = shared.value

        def work(texts: pa.Array) -> list:
            columns: list[list] = [[] for _ in FIELDS]
            for lo in range(0, len(texts), batch):
                some = [t or "" for t in texts.slice(lo, batch).to_pylist()]
                base = [base_spans(t) for t in some]
                more = added_spans(model, some, base) if model else [[] for _ in some]
                for b, m in zip(base, more):
                    for k in range(len(BASE)):
                        columns[k].append(sum(s[1] == k for s in b))
                    columns[-3].append(hashlib.sha256(joined(b).encode()).hexdigest())
                    columns[-2].append(joined(sorted(b + m)))
                    columns[-1].append(len(b) + len(m))
            return columns

        return work

    return map_texts(docs, text, FIELDS, build, keep)


def op8_pii(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return find(docs, train(docs), keep=["doc_id"])
