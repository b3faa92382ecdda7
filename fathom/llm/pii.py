"""Personal data: exact base rules, and a character-level bidirectional LSTM with CRF transitions, in numpy.

Base rules find email, ip, card and phone spans (code points, end exclusive), each kind leftmost and non-overlapping, in time linear in the text.
The network is trained from labelled spans: pieces of a bounded sample of the texts, labelled by the base rules, and the same pieces with personal data put in by `planted`, half of it in
forms that no base rule takes (addresses spelt with "at" and "dot", spaced or bracketed dots, phones without a country code, cards grouped by other marks), beside
dates, versions, prices and keys that are none. It tags characters with B and I of each kind or O.

Every text is looked through whole for signs: digits, @ and the word "at". No span without one passes the check of an added span (`checked`), so the network reads the windows within REACH of a sign, and goes
on into further ones as long as a run of tags other than O reaches their border. Overlapping windows are scored, a character's scores come from the window in whose middle it lies, and one Viterbi path is
found over the joined scores, so a span never breaks where windows meet. Stretches where no run of tags other than O can gain (an exact bound from the scores and the transitions) are O without a search. The network adds the spans
that meet no base span and whose mean marginal reaches their kind's bar, set on held-out planted pieces so that at most one added span in fifty misses a labelled one there. An exact check of the digits follows
(`checked`: Luhn, parts of addresses, numbers of digits). Base spans always stay.

Defined cases: a null text is empty; texts are scanned whole, window by window, whatever their length; repeated rows give equal results; an empty table gives no rows;
without any text to train on there is no network and base spans are all; texts over SECTION characters are decoded in sections that overlap by MARGIN on both sides, and a span belongs to the section it
starts in; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_views, under

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
WINDOW, STEP = 256, 216
TRAINED = 128  # characters of a training window
SECTION, MARGIN = 60_000, 512
EMBED, HIDDEN, CHARS = 10, 8, 130  # ASCII, then any other, then padding
TRAIN_TEXTS, PIECE, TRAIN_WINDOWS, HELD_WINDOWS = 600, 2000, 3200, 600
EPOCHS, BATCH, RATE = 8, 32, 0.02
WRONG, LEAST_SURE = 0.02, 0.8  # share of added spans that may miss a labelled one on held-out pieces; the bar is never lower
REACH = 128  # characters around a sign that the network reads in any case
BLOCK, BATCH_CHARS = 1024, 800_000  # windows scored, and characters looked through, at a time

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_GROUP = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out, before = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            a = m.start()
            while a > before and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append((0, a, m.end()))
                before = m.end()
    for m in _CHAIN.finditer(text):
        groups = list(_GROUP.finditer(text, m.start(), m.end()))
        for i in range(0, len(groups) - 3, 4):
            if all(len(p := g.group().lstrip("0")) < 4 and int(p or 0) < 256 for g in groups[i : i + 4]):
                out.append((1, groups[i].start(), groups[i + 3].end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() < 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def checked(kind: int, found: str) -> bool:
    """Whether the digits of an added span can be of its kind."""
    groups = re.findall("[0-9]+", found)
    digits = "".join(groups)
    if kind == 0:
        return len(found) < 255 and re.search(r"@|\bat\b", found) is not None
    if kind == 1:
        return len(groups) == 4 and all(len(g) < 4 and int(g) < 256 for g in groups)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def coded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.minimum(points, 128).astype(np.uint8)


# ---- the network


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def random(*shape):
        return rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)

    p = {"embed": rng.normal(0, 0.5, (CHARS, EMBED)).astype(np.float32), "out": random(2 * HIDDEN, TAGS), "out_b": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32), "first": np.zeros(TAGS, np.float32)}
    for d in "fb":
        p |= {f"x{d}": random(EMBED, 4 * HIDDEN), f"h{d}": random(HIDDEN, 4 * HIDDEN), f"c{d}": np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)}
    return p


def _lstm(p: dict, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (T, n, HIDDEN) of inputs (T, n, EMBED), from the end for d = b."""
    steps, n = x.shape[:2]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    out, saved = np.empty((steps, n, HIDDEN), np.float32), []
    into = x.reshape(-1, EMBED) @ p[f"x{d}"] + p[f"c{d}"]
    into = into.reshape(steps, n, 4 * HIDDEN)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = into[t] + h @ p[f"h{d}"]
        gates = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        before, c = c, f * c + i * g
        tanh = np.tanh(c)
        if keep:
            saved.append((t, h, before, i, f, o, g, tanh))
        h = o * tanh
        out[t] = h
    return out, saved


def _lstm_back(p: dict, d: str, x: np.ndarray, saved: list, dh_out: np.ndarray, grads: dict) -> np.ndarray:
    n = x.shape[1]
    dx, dh, dc = np.empty_like(x), np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    gx, gh, gc = np.zeros_like(p[f"x{d}"]), np.zeros_like(p[f"h{d}"]), np.zeros_like(p[f"c{d}"])
    for t, h, before, i, f, o, g, tanh in reversed(saved):
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tanh * tanh)
        dz = np.hstack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - g * g)])
        gx += x[t].T @ dz
        gh += h.T @ dz
        gc += dz.sum(axis=0)
        dx[t] = dz @ p[f"x{d}"].T
        dh, dc = dz @ p[f"h{d}"].T, dc * f
    grads |= {f"x{d}": gx, f"h{d}": gh, f"c{d}": gc}
    return dx


def emissions(p: dict, codes: np.ndarray, keep: bool = False):
    """Scores (T, n, TAGS) of windows (n, T) of character codes."""
    x = p["embed"][codes.T]
    hf, sf = _lstm(p, "f", x, keep)
    hb, sb = _lstm(p, "b", x, keep)
    h = np.concatenate([hf, hb], axis=2)
    return h @ p["out"] + p["out_b"], (x, h, sf, sb)


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(p: dict, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log forward and backward scores, tag marginals and log normalisers of the CRF."""
    steps = len(e)
    a, b = np.empty_like(e), np.zeros_like(e)
    a[0] = e[0] + p["first"]
    for t in range(1, steps):
        a[t] = e[t] + _logsum(a[t - 1][:, :, None] + p["trans"], 1)
    for t in range(steps - 2, -1, -1):
        b[t] = _logsum(p["trans"][None] + (e[t + 1] + b[t + 1])[:, None, :], 2)
    z = _logsum(a[-1], 1)
    return a, b, np.exp(a + b - z[:, None]), z


def viterbi(p: dict, e: np.ndarray) -> np.ndarray:
    steps, n = e.shape[:2]
    best, back = e[0] + p["first"], np.empty((steps, n, TAGS), np.int8)
    for t in range(1, steps):
        score = best[:, :, None] + p["trans"]
        back[t] = score.argmax(axis=1)
        best = score.max(axis=1) + e[t]
    out = np.empty((n, steps), np.int8)
    out[:, -1] = best.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(n), out[:, t]]
    return out


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y = np.zeros(n, np.int8)
    for kind, a, b in sorted(spans, key=lambda s: s[2] - s[1]):
        y[a:b] = 2 + 2 * kind
        y[a] = 1 + 2 * kind
    return y


def gradients(p: dict, codes: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log likelihood of tags y (n, T), and its gradients."""
    n, steps = y.shape
    e, (x, h, sf, sb) = emissions(p, codes, True)
    a, b, m, z = marginals(p, e)
    gold = np.zeros_like(e)
    gold[np.arange(steps)[:, None], np.arange(n), y.T] = 1
    trans, first = np.zeros_like(p["trans"]), m[0].sum(axis=0) - gold[0].sum(axis=0)
    for t in range(1, steps):
        pair = np.exp(a[t - 1][:, :, None] + p["trans"] + (e[t] + b[t])[:, None, :] - z[:, None, None])
        trans += pair.sum(axis=0) - gold[t - 1].T @ gold[t]
    score = (e * gold).sum() + (p["first"] * gold[0]).sum() + sum(p["trans"][y[:, t - 1], y[:, t]].sum() for t in range(1, steps))
    de = ((m - gold) / n).astype(np.float32)
    dh = de @ p["out"].T
    grads = {"out": np.einsum("tnh,tnk->hk", h, de), "out_b": de.sum(axis=(0, 1)), "trans": trans / n, "first": first / n}
    dx = _lstm_back(p, "f", x, sf, dh[:, :, :HIDDEN], grads) + _lstm_back(p, "b", x, sb, dh[:, :, HIDDEN:], grads)
    embed = np.zeros((CHARS, EMBED))
    for k in range(EMBED):
        embed[:, k] = np.bincount(codes.T.ravel(), dx[:, :, k].ravel(), CHARS)
    grads["embed"] = embed
    return float((z.sum() - score) / n), grads


def _words(rng: np.random.Generator, least: int, most: int) -> str:
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(least, most + 1)))


def _digits(rng: np.random.Generator, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def made(kind: int, rng: np.random.Generator) -> str:
    """Personal data of a kind, in a form of the base rules or, as often, in another."""
    pick = lambda *forms: forms[rng.integers(len(forms))]
    usual = rng.random() < 0.5
    if kind == 0:
        name = pick(_words(rng, 3, 9), f"{_words(rng, 2, 7)}.{_words(rng, 2, 8)}", f"{_words(rng, 2, 6)}{_digits(rng, 2)}", f"{_words(rng, 3, 6)}.{_digits(rng, 2)}")
        host, end = pick(_words(rng, 3, 9), f"mail{_digits(rng, 1)}.{_words(rng, 4, 8)}"), pick("com", "org", "net", "de", "co", "io", "fr")
        at, dot = ("@", ".") if usual else pick((" @ ", "."), ("(at)", "."), ("[at]", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot "), (" (at) ", "."), (" (at) ", " (dot) "), ("@", "[.]"), ("@", " dot "))
        return f"{name}{at}{host.replace('.', dot)}{dot}{end}"
    if kind == 1:
        return ("." if usual else pick("[.]", "(.)", " . ", "[dot]", " dot ")).join(map(str, rng.integers(0, 256, 4)))
    if kind == 2:
        first = pick("4", "51", "37") + _digits(rng, 13)
        number = first[:15] + next(d for d in "0123456789" if luhn(first[:15] + d))
        mark = pick("", " ", "-") if usual else pick(".", "/", "_", "  ", " - ", " . ")
        return mark.join(number[i : i + 4] for i in range(0, 16, 4))
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    if usual:
        return pick(f"+1 ({a}) {b}-{c}", f"+1-{a}-{b}-{c}", f"+{rng.integers(20, 99)} {a} {b}{c}", f"+{rng.integers(20, 99)}.{a}.{b}.{c}")
    return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.integers(20, 99)} {a} {b}{c}", f"0{a[:2]}/{b}{c}", f"0{a} {b} {c}", f"1-{a}-{b}-{c}")


def decoy(rng: np.random.Generator) -> str:
    """Digits and marks that are no personal data."""
    n = lambda a, b: int(rng.integers(a, b))
    hexed = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))
    forms = [
        f"{n(1900, 2030)}-{n(1, 13):02d}-{n(1, 29):02d}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2030)}", f"{n(1, 13)}/{n(1, 29)}/{n(1900, 2030)}", f"{n(0, 24):02d}:{n(0, 60):02d}:{n(0, 60):02d}",
        f"{n(0, 20)}.{n(0, 20)}", f"{n(0, 20)}.{n(0, 20)}.{n(0, 99)}", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 99)}-{n(1, 9)}", f"${n(1, 999)},{n(0, 1000):03d}.{n(0, 100):02d}", f"{n(1, 100)}%", str(n(1, 10**6)),
        f"{n(1900, 2030)}", f"{n(1, 99)}-{n(100, 200)}", f"#{n(1, 10**7)}", f"@{_words(rng, 3, 9)}", f"password={hexed(18)}", f'token = "{hexed(40)}"', f"AKIA{_words(rng, 8, 8).upper()}{_digits(rng, 8)}",
        f"{hexed(8)}-{hexed(4)}-{hexed(4)}", f"{_digits(rng, 6)}.{_digits(rng, 4)}", f"({n(1900, 2030)})", f"[{n(1, 99)}]", f"{n(1, 999)} x {n(1, 999)}", f"p. {n(1, 900)}", f"{n(0, 90)}.{_digits(rng, 5)}, {n(0, 90)}.{_digits(rng, 5)}",
        f"{_words(rng, 3, 8)} at {_words(rng, 3, 8)}", f"{_words(rng, 3, 8)} (at {_words(rng, 3, 8)})", f"{_words(rng, 3, 8)} dot", f"978-{n(0, 9)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{n(0, 9)}",
    ]
    return forms[rng.integers(len(forms))]


def planted(texts: list[str], rng: np.random.Generator, count: int) -> tuple[list[str], list[list[tuple[int, int, int]]]]:
    """Short pieces of texts with personal data, decoys or nothing put between their words, and the labelled spans."""
    out, spans = [], []
    for i in range(count):
        source = texts[rng.integers(len(texts))]
        at = int(rng.integers(0, max(1, len(source) - TRAINED)))
        words = source[at : at + TRAINED].split(" ")
        piece, found = "", []
        put = set(rng.integers(0, len(words) + 1, 2 if i % 4 else 0).tolist())
        for j in range(len(words) + 1):
            if j in put:
                lead = ("", "(", "tel: ", "mail ", "<", '"', "ip=")[rng.integers(7)] if rng.random() < 0.4 else ""
                tail = (".", ",", ")", ">", '"', "\n", ";")[rng.integers(7)] if rng.random() < 0.4 else ""
                kind = int(rng.integers(0, 6))
                new = made(kind, rng) if kind < 4 else decoy(rng)
                piece += lead
                if kind < 4:
                    found.append((kind, len(piece), len(piece) + len(new)))
                piece += f"{new}{tail} "
            if j < len(words):
                piece += words[j] + (" " if j + 1 < len(words) else "")
        met = [s for s in base_spans(piece) if not any(s[1] < z and a < s[2] for _, a, z in found)]
        out.append(piece)
        spans.append(sorted(found + met, key=lambda x: x[1]))
    return out, spans


def examples(texts: list[str], spans: list[list[tuple[int, int, int]]], rng: np.random.Generator, limit: int = TRAIN_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Windows of texts around labelled spans, or anywhere in texts without, as codes and tags."""
    codes, tags = [], []
    for text, found in zip(texts, spans):
        code, y = coded(text), tags_of(len(text), found)
        for centre in [(a + b) // 2 for _, a, b in found] or [len(text) // 2]:
            if len(codes) >= limit:
                break
            at = centre - int(rng.integers(TRAINED // 4, 3 * TRAINED // 4))
            part = np.full(TRAINED, CHARS - 1, np.uint8)
            tag = np.zeros(TRAINED, np.int8)
            lo, hi = max(0, at), min(len(code), at + TRAINED)
            part[lo - at : hi - at], tag[lo - at : hi - at] = code[lo:hi], y[lo:hi]
            codes.append(part)
            tags.append(tag)
    return np.array(codes).reshape(-1, TRAINED), np.array(tags).reshape(-1, TRAINED)


def train(texts: list[str], spans: list[list[tuple[int, int, int]]], seed: int = 5, epochs: int = EPOCHS) -> dict | None:
    """Parameters by Adam on the CRF's likelihood, or None without any span. Deterministic for given texts."""
    rng = np.random.default_rng(seed)
    codes, y = examples(texts, spans, rng)
    if not len(codes) or not y.any():
        return None
    p, moments, step = initial(rng), {}, 0
    for epoch in range(epochs):
        rate, order = RATE * (1 - epoch / epochs) + 0.001, rng.permutation(len(codes))
        for i in range(0, len(order), BATCH):
            rows = order[i : i + BATCH]
            _, grads = gradients(p, codes[rows], y[rows])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
            step += 1
            for k, g in grads.items():
                g = g * min(1, 5 / max(norm, 1e-9))
                m, v = moments.get(k, (0, 0))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[k] = m, v
                p[k] = (p[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def scored(p: dict, codes: np.ndarray) -> np.ndarray:
    """Scores (T, TAGS, n) of windows (n, T), as emissions() but features by windows, so that a step's work lies in long rows; sigmoids as hyperbolic tangents of half."""
    steps, n, half = codes.shape[1], len(codes), np.repeat(np.float32([0.5, 1]), [3 * HIDDEN, HIDDEN])[:, None]
    out = np.empty((steps, TAGS, n), np.float32)
    out[:] = p["out_b"][:, None]
    at = np.ascontiguousarray(codes.T)
    for d, order, rows in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
        table = np.ascontiguousarray((p["embed"] @ p[f"x{d}"] + p[f"c{d}"]).T.astype(np.float32) * half)
        back, emit = np.ascontiguousarray(p[f"h{d}"].T) * half, np.ascontiguousarray(p["out"][rows].T)
        h, c, more = np.zeros((HIDDEN, n), np.float32), np.zeros((HIDDEN, n), np.float32), np.empty((HIDDEN, n), np.float32)
        z = np.empty((4 * HIDDEN, n), np.float32)
        for t in order:
            np.matmul(back, h, out=z)
            z += table[:, at[t]]
            np.tanh(z, out=z)
            z[: 3 * HIDDEN] *= 0.5
            z[: 3 * HIDDEN] += 0.5
            np.multiply(z[:HIDDEN], z[3 * HIDDEN :], out=more)
            c *= z[HIDDEN : 2 * HIDDEN]
            c += more
            np.tanh(c, out=h)
            h *= z[2 * HIDDEN : 3 * HIDDEN]
            out[t] += emit @ h
    return out


def windows(size: int) -> list[tuple[int, int, int]]:
    """(start, first, last): overlapping windows over a section, the last one as long as is left, and which places inside each are decided by it: those nearer its middle than
    the next one's."""
    starts = [0] if size <= WINDOW else [*range(0, size - WINDOW + STEP, STEP)]
    cuts = [0, *[b + (WINDOW - STEP) // 2 for b in starts[1:]], size]
    return [(s, cuts[i] - s, cuts[i + 1] - s) for i, s in enumerate(starts)]


_WORD = np.array([i < 128 and (chr(i).isalnum() or chr(i) == "_") for i in range(256)])
_AT = re.compile(r"\bat\b")


def signs(code: np.ndarray) -> np.ndarray:
    """Places of what every span holds that `checked` takes: digits, @ and the word at (beside other characters than ASCII, also a part of a word)."""
    at = np.zeros(len(code), bool)
    if len(code) > 1:
        at[:-1] = (code[:-1] == ord("a")) & (code[1:] == ord("t"))
        word = np.concatenate([[False], _WORD[code], [False]])
        at[:-1] &= ~word[:-3] & ~word[3:]
    return np.flatnonzero(at | (code == ord("@")) | (code - np.uint8(ord("0")) < 10))


class Joined:
    """The scores of some sections' characters, one section after the other, each followed by a place that must be O.

    Windows within REACH of a sign are read (every: all), then those that an open place borders on, until none is left. gain: each place's best score of another tag over O's, very low where no window was
    read; hot: open places. Scores themselves stay in their windows and are looked up by `at`.
    """

    def __init__(self, p: dict, sections: list[np.ndarray], every: bool = False):
        self.p, self.sections = p, sections
        self.begins = np.cumsum([0, *[len(x) + 1 for x in sections]])
        self.gain, self.known, self.blocks = np.full(self.begins[-1], -1e4, np.float32), np.zeros(self.begins[-1], bool), []
        todo = np.array([(i, *w) for i, x in enumerate(sections) if len(x) for w in windows(len(x))], np.int64).reshape(-1, 4)
        self.section, self.start = todo[:, 0], todo[:, 1]
        begin, end = self.begins[self.section], self.begins[self.section + 1] - 1
        self.base = begin + self.start
        self.first, self.last, self.size = self.base + todo[:, 2], self.base + todo[:, 3], np.minimum(WINDOW, end - self.base)
        self.block, self.row = np.full(len(todo), -1), np.zeros(len(todo), np.int64)
        seen = np.concatenate([np.zeros(0, np.int64), *[self.begins[i] + signs(x) for i, x in enumerate(sections)]])
        near = np.searchsorted(seen, np.maximum(begin, self.first - REACH)) < np.searchsorted(seen, np.minimum(end, self.last + REACH))
        self.hot = np.zeros(0, np.int64)
        near |= every
        while near.any():
            self.read(np.flatnonzero(near))
            open_ = open_places(p, self.gain) & self.known
            self.hot = np.flatnonzero(open_)
            near = (self.block < 0) & ((self.first > begin) & open_[self.first - 1] | open_[self.last])

    def read(self, todo: np.ndarray) -> None:
        """Scores windows."""
        todo = todo[np.argsort(-self.size[todo], kind="stable")]  # blocks of windows of like lengths, so that little padding is scored
        for k in range(0, len(todo), BLOCK):
            part = todo[k : k + BLOCK]
            codes = np.full((len(part), int(self.size[part[0]])), CHARS - 1, np.uint8)
            for r, w in enumerate(part):
                codes[r, : self.size[w]] = self.sections[self.section[w]][self.start[w] : self.start[w] + WINDOW]
            e = scored(self.p, codes)
            more = np.ascontiguousarray((e[:, 1:].max(axis=1) - e[:, 0]).T)
            for r, w in enumerate(part):
                b, first, last = self.base[w], self.first[w], self.last[w]
                self.gain[first:last] = more[r, first - b : last - b]
                self.known[first:last] = True
            self.block[part], self.row[part] = len(self.blocks), np.arange(len(part))
            self.blocks.append(e)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Scores (n, TAGS) of places that were read."""
        w = np.searchsorted(self.first, places, "right") - 1
        out = np.empty((len(places), TAGS), np.float32)
        for k in np.unique(self.block[w]):
            own = self.block[w] == k
            out[own] = self.blocks[k][places[own] - self.base[w[own]], :, self.row[w[own]]]
        return out


def open_places(p: dict, gain: np.ndarray) -> np.ndarray:
    """Places that some run of tags other than O could gain by: all others are O on the best path.

    A run's gain over O is at most the sum over its places of their best gain in score and in a transition, and of the best entry and exit.
    """
    trans = p["trans"].astype(np.float64) - p["trans"][0, 0]
    inner = trans[1:, 1:].max()
    gain = gain.astype(np.float64) + inner
    sums = np.concatenate([[0], np.cumsum(gain)])
    ending = sums[1:] - np.minimum.accumulate(sums)[:-1]
    beginning = np.maximum.accumulate(sums[::-1])[::-1][1:] - sums[:-1]
    return ending + beginning - gain + trans[0, 1:].max() + trans[1:, 0].max() - inner > 0


def spans_of(p: dict, joined: Joined, block: int = 256) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, mean marginal) of the best path's spans over joined scores."""
    hot = joined.hot
    if not len(hot):
        return []
    cut = np.flatnonzero(np.diff(hot) > 1) + 1
    stretches = sorted(((int(g[0]), int(g[-1]) + 1) for g in np.split(hot, cut)), key=lambda s: s[1] - s[0])
    out = []
    for k in range(0, len(stretches), block):
        part = stretches[k : k + block]
        width = part[-1][1] - part[-1][0] + 2
        x = np.full((width, len(part), TAGS), -1e4, np.float32)
        x[:, :, 0] = 0  # O before and after
        for r, (a, b) in enumerate(part):
            x[1 : b - a + 1, r] = joined.at(np.arange(a, b))
        path, sure = viterbi(p, x), marginals(p, x)[2]
        for r, (a, b) in enumerate(part):
            y, i = path[r], 0
            inside = np.flatnonzero(y)
            while i < len(inside):
                s = int(inside[i])
                kind, z = (int(y[s]) - 1) // 2, s + 1
                while z < width and y[z] == 2 + 2 * kind:
                    z += 1
                q = sure[np.arange(s, z), r, y[s:z]]
                out.append((kind, a + s - 1, a + z - 1, float(q.mean())))
                i = int(np.searchsorted(inside, z))
    return sorted(out, key=lambda s: s[1])


def tagged(p: dict, codes: list[np.ndarray], every: bool = False) -> list[list[tuple[int, int, int, float]]]:
    """For each text (given by its codes) the spans the network finds where it reads (every: everywhere): (kind, start, end, mean marginal)."""
    out: list[list] = [[] for _ in codes]
    sections = [(i, a, min(len(c), a + SECTION)) for i, c in enumerate(codes) for a in range(0, len(c), SECTION)]
    at = 0
    while at < len(sections):
        part, size = [], 0
        while at < len(sections) and (not part or size + sections[at][2] - sections[at][1] <= BATCH_CHARS):
            part.append(sections[at])
            size += sections[at][2] - sections[at][1]
            at += 1
        lows = [max(0, a - MARGIN) for _, a, _ in part]
        cuts = [codes[i][lo : b + MARGIN] for lo, (i, a, b) in zip(lows, part)]
        joined = Joined(p, cuts, every)
        for kind, s, z, sure in spans_of(p, joined):
            r = int(np.searchsorted(joined.begins, s, "right")) - 1
            i, a, b = part[r]
            start, end = s - int(joined.begins[r]) + lows[r], z - int(joined.begins[r]) + lows[r]
            if a <= start < b:
                out[i].append((kind, start, end, sure))
    return out


def signed(kind: int, text: str, a: int, z: int) -> bool:
    """Whether an address of mail holds @ or at as a word of its text; what `checked` takes of other kinds holds digits."""
    return kind > 0 or "@" in text[a:z] or bool((m := _AT.search(text, a)) and m.end() <= z)


def added(p: dict, texts: list[str], base: list[list[tuple[int, int, int]]], bar: list[float], every: bool = False) -> list[list[tuple[int, int, int, float]]]:
    """The network's spans that meet no base span, reach their kind's bar and pass the check of their digits."""
    return [
        [(k, a, z, sure) for k, a, z, sure in found if sure >= bar[k] and not any(s < z and a < e for _, s, e in b) and checked(k, text[a:z]) and signed(k, text, a, z)]
        for text, b, found in zip(texts, base, tagged(p, [coded(t) for t in texts], every))
    ]


def all_spans(p: dict | None, texts: list[str]) -> list[tuple[list, list]]:
    """Base spans of each text, and those with the network's added, both by kind, then start."""
    base = [base_spans(t) for t in texts]
    if p is None:
        return [(b, b) for b in base]
    return [(b, sorted({*b, *[x[:3] for x in more]})) for b, more in zip(base, added(p, texts, base, p["bar"].tolist()))]


def half_met(span: tuple, others: list[tuple]) -> bool:
    """Whether one of the others shares at least half of what it and the span cover together, and their kind."""
    k, a, z = span[:3]
    return any(k == o[0] and 2 * (min(z, o[2]) - max(a, o[1])) >= max(z, o[2]) - min(a, o[1]) for o in others)


def fitted(texts: list[str], seed: int = 5) -> dict | None:
    """A network trained on texts and on what is planted in them, with its bar; None without texts."""
    texts = [t for t in texts if t.strip()]
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    own = [base_spans(t) for t in texts]
    rich = [(t, s) for t, s in zip(texts, own) if s][: TRAIN_WINDOWS // 8]
    more, told = planted(texts, rng, TRAIN_WINDOWS)
    p = train([t for t, _ in rich] + more, [s for _, s in rich] + told, seed)
    if p is None:
        return None
    held, truth = planted(texts, rng, HELD_WINDOWS)
    base = [base_spans(t) for t in held]
    got = sorted(((x[3], x[0], half_met(x, w)) for found, w in zip(added(p, held, base, [0.0] * len(KINDS)), truth) for x in found), reverse=True)
    bar = []
    for kind in range(len(KINDS)):
        own = [(sure, right) for sure, k, right in got if k == kind]
        wrong = np.cumsum([not right for _, right in own])
        bar.append(max(LEAST_SURE, min((sure for n, (sure, _) in enumerate(own) if wrong[n] <= WRONG * (n + 1)), default=1.0)))
    p["bar"] = np.array(bar)
    return p


def training_texts(docs: DataFrame, texts: int = TRAIN_TEXTS) -> list[str]:
    """Pieces of at most `texts` distinct texts, the first by a hash: PIECE characters from a place that the hash gives, so long texts train as well as short ones.

    A share of the hash's range is looked through, and a wider one while too few are found, so that hardly more than the sample leaves the executors.
    """
    text = F.col("text").cast("string")
    place = (F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - PIECE, F.lit(0)) + 1) + 1).cast("int")
    read = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).where("text is not null")
    share = min(1.0, 4 * texts / max(1, docs.count()))
    while True:
        some = read.where(under(F.col("h"), share)).select("h", F.substring(F.col("text"), place, F.lit(PIECE)).alias("text"))
        rows = some.groupBy("h").agg(F.min("text").alias("text")).orderBy("h", "text").limit(texts).collect()
        if len(rows) >= texts or share >= 1:
            return [r["text"] for r in rows]
        share = min(1.0, share * 16)


def found(docs: DataFrame, p: dict | None = None) -> DataFrame:
    """doc_id, base and spans of every row: arrays of (kind, start, end). p: a trained network; fitted here on a sample of docs unless given."""
    if p is None:
        p = fitted(training_texts(docs))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, starts, sizes = byte_views(batch.column(1))
            base, every, at = [[]] * len(starts), [[]] * len(starts), 0
            while at < len(starts):  # texts of about BATCH_CHARS at a time
                to = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), BATCH_CHARS, "right")) + at)
                texts = [bytes(raw[starts[r] : starts[r] + sizes[r]]).decode() for r in range(at, to)]
                for r, (b, s) in zip(range(at, to), all_spans(p, texts)):
                    base[r], every[r] = ([{"kind": KINDS[k], "start": a, "end": z} for k, a, z in x] for x in (b, s))
                at = to
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(every, span)], ["doc_id", "base", "spans"])

    schema = "doc_id long, base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digest(spans: DataFrame) -> DataFrame:
    def joined(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
