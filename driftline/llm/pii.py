"""Personal data: base patterns, and a character BiLSTM-CRF that adds what they miss.

Base spans of each kind are leftmost and don't overlap within the kind; they always stay. The tagger is trained in
numpy on ``EXAMPLES`` texts that ``labelled`` writes out: base forms, and forms such as bracketed "at", dotted cards and
phone numbers without a country code, with their spans, among plain numbers, dates and tokens that are nothing, and
among passages without personal data from a bounded sample of the corpus itself (``BACKGROUND`` documents). Every
stretch of a text that has four digits close together, an at sign or a bracketed "at" is decoded, whole or, if it is
long, in overlapping windows; elsewhere none of the kinds can be. A span that a window's border cuts is left to the next
window, whose overlap holds spans of up to ``WINDOW`` / 2 characters, and the spans of all windows of a text are
reconciled by weighted interval scheduling. Padding takes no part in decoding. The decoded ends stand, but that they
cut no word and leave out blanks and stops around them; an added span must look like its kind, hold enough digits (and pass the Luhn test for cards, the
range test for addresses) and may not touch a base span.

Nulls count as empty texts, which have no spans. Positions are code points, ends exclusive. Work is linear in a text's
length. Repeated rows give repeated results; only the key and the text are read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from driftline.llm.common import alone, importable, only, sliced, texts

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, of its context around a trigger, and windows decoded at once.
WINDOW, REACH, BATCH = 512, 128, 128
#: Labelled examples, their length and passes over them.
EXAMPLES, LENGTH, EPOCHS = 1600, 128, 12
#: Documents whose passages stand between labelled spans, and the characters of each.
BACKGROUND, PASSAGE = 64, 4000
EMBED, HIDDEN = 12, 20

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9](?:[^0-9]{0,3}[0-9]){3,}|@|[(\[{<] ?[aA][tT] ?[)\]}>]")
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def part_fits(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> dict[str, list[Span]]:
    """The spans of the base patterns, found in linear time.

    An email's local part is all of the run before its at sign, so looking back from each at sign finds the leftmost
    match; an address takes the next four numbers of a dotted run, whether they pass or not.
    """
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        runs = [(m.start(), m.end()) for m in LOCAL.finditer(text) if text.startswith("@", m.end())]
        done = 0
        for start, at in runs:
            start = max(start, done)
            if start < at and (m := DOMAIN.match(text, at + 1)):
                out["email"].append((start, m.end()))
                done = m.end()
    if DIGIT.search(text):
        for m in DOTTED.finditer(text):
            parts = [(x.start(), x.end()) for x in re.finditer("[0-9]+", m[0])]
            for k in range(0, len(parts) - 3, 4):
                if all(part_fits(m[0][a:b]) for a, b in parts[k : k + 4]):
                    out["ip"].append((m.start() + parts[k][0], m.start() + parts[k + 3][1]))
        for m in CARD.finditer(text):
            found = digits(m[0])
            if 13 <= len(found) <= 19 and luhn(found):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] += [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


# ---- the tagger

PUNCTUATION = "@._-+()[]{}<> :/,;#=\"'|*&$%!?\n"
TAGS = ["O"] + [f"{b}-{k}" for k in KINDS for b in "BI"]
ALPHABET = 3 + 1 + 26 + len(PUNCTUATION)


def _classes() -> np.ndarray:
    """Character class of each code point below 128."""
    table = np.full(128, 2, np.int16)
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            table[c] = 3
        elif ch.isalpha():
            table[c] = 4 + ord(ch.lower()) - 97
        elif ch in PUNCTUATION:
            table[c] = 30 + PUNCTUATION.index(ch)
    return table


CLASSES = _classes()


def classes(text: str) -> np.ndarray:
    """0 pads; 1 is any letter or mark beyond ASCII, 2 any other control or symbol, 3 a digit."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, CLASSES[np.minimum(points, 127)], 1)


def labelled(seed: int, n: int, background: tuple[str, ...] = ()) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their labelled spans; passages of the background stand among them where it has no base spans."""
    rng = random.Random(seed)
    syllables = "the an er on in re nd ou ed ha ti es la de le que ción mente der ein ung ich lich aux eau ré è ö ü ß ñ st ing".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    ascii_word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))

    def email() -> str:
        local = rng.choice([ascii_word(), f"{ascii_word()}.{ascii_word()}", f"{ascii_word()}{number(2)}", f"{ascii_word()}_{number(1)}", ascii_word(), ".".join(ascii_word() + ascii_word() for _ in range(rng.randrange(3, 7)))])
        at = rng.choice(["@", "@", "@", " (at) ", "(at)", " [at] ", "[at]", " @ ", " {at} "])
        dot = "." if at == "@" or rng.random() < 0.5 else rng.choice([" (dot) ", "[dot]", " [dot] ", " . "])
        return local + at + rng.choice([ascii_word() + number(1), ascii_word(), f"mail{dot}{ascii_word()}"]) + dot + rng.choice(["com", "org", "net", f"example{dot}com"])

    def card() -> str:
        body = rng.choice("3456") + number(rng.choice([14, 14, 14, 13, 12]))
        body += next(d for d in "0123456789" if luhn(body + d))
        mark = rng.choice(["", "", " ", "-", ".", "  ", "/"])
        return mark.join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{number(2)} {number(2)} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"00{number(2)} {a} {b} {c}"])

    def passage() -> str:
        whole = rng.choice(background)
        a = rng.randrange(max(1, len(whole)))
        b = a + rng.randrange(3, 40)
        return "" if any(base_spans(whole[max(0, a - REACH) : b + REACH]).values()) else whole[a:b].strip()

    make = {"email": email, "ip": lambda: rng.choice([".", ".", ".", " . ", "[.]"]).join(str(rng.randrange(256)) for _ in range(4)), "card": card, "phone": phone}
    nothing = [lambda: number(rng.randrange(1, 9)), lambda: f"20{number(2)}-0{number(1)}-1{number(1)}", lambda: f"{number(2)}.{number(2)}", lambda: f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: f"{number(1)},{number(3)},{number(3)}", lambda: f"@{ascii_word()}", lambda: f"{number(2)}:{number(2)}", lambda: "(at)", lambda: number(20 + rng.randrange(20))]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < LENGTH - 4:
            x = rng.random()
            if x < 0.16:
                kind = rng.choice(KINDS)
                value = make[kind]()
                if len(text) + len(value) <= LENGTH:
                    spans.append((len(text), len(text) + len(value), kind))
                    text += value
            elif x < 0.25:
                text += rng.choice(nothing)()
            elif background and rng.random() < 0.4:
                text += passage()
            else:
                text += word() if rng.random() < 0.9 else word().upper()
            text += rng.choice([" "] * 8 + [", ", ". ", "\n", "!! ", "; ", " | "])
        out.append((text[:LENGTH].ljust(LENGTH), [s for s in spans if s[1] <= LENGTH]))
    return out


def _tags(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a], out[a + 1 : b] = k, k + 1
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forbidden() -> np.ndarray:
    """-1e4 where a tag can't follow another: an inside tag follows only its own kind's."""
    out = np.zeros((len(TAGS), len(TAGS)), np.float32)
    for i, a in enumerate(TAGS):
        for j, b in enumerate(TAGS):
            if b[0] == "I" and a not in (f"B-{b[2:]}", b):
                out[i, j] = -1e4
    return out


FORBIDDEN = _forbidden()


def _lstm(x: np.ndarray, w: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of (time, batch, features) in one direction."""
    t, n, _ = x.shape
    e = x.shape[2]
    h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    fed = x.reshape(t * n, e) @ w[:e] + b
    fed, out = fed.reshape(t, n, -1), np.empty((t, n, HIDDEN), np.float32)
    for k in range(t):
        z = fed[k] + h @ w[e:]
        gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, c = c, f * c + i * g
        squashed = np.tanh(c)
        if keep is not None:
            keep.append((h, before, i, f, o, g, squashed))
        h = o * squashed
        out[k] = h
    return out


def _lstm_back(x: np.ndarray, w: np.ndarray, keep: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the inputs, the weights and the bias, from those of the hidden states."""
    t, n, e = x.shape
    dz_all = np.empty((t, n, 4 * HIDDEN), np.float32)
    dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
    for k in range(t - 1, -1, -1):
        h, before, i, f, o, g, squashed = keep[k]
        dh = dh + grad[k]
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        dz_all[k] = dz
        dh, dc = dz @ w[e:].T, dc * f
    flat = dz_all.reshape(t * n, -1)
    hidden = np.stack([x[0] for x in keep]).reshape(t * n, HIDDEN)
    dw = np.concatenate([x.reshape(t * n, e).T @ flat, hidden.T @ flat])
    return (flat @ w[:e].T).reshape(t, n, e), dw, flat.sum(axis=0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _crf(emit: np.ndarray, move: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood of the gold tags, for emissions (time, batch, tags) and transitions."""
    t, n, _ = emit.shape
    ahead, behind = np.empty_like(emit), np.zeros_like(emit)
    ahead[0] = emit[0]
    for k in range(1, t):
        ahead[k] = emit[k] + _logsum(ahead[k - 1][:, :, None] + move, 1)
    for k in range(t - 2, -1, -1):
        behind[k] = _logsum(move + (emit[k + 1] + behind[k + 1])[:, None, :], 2)
    whole = _logsum(ahead[-1], 1)
    d_emit = np.exp(ahead + behind - whole[None, :, None])
    d_move = np.zeros_like(move)
    for k in range(1, t):
        d_move += np.exp(ahead[k - 1][:, :, None] + move + (emit[k] + behind[k])[:, None, :] - whole[:, None, None]).sum(axis=0)
    at = np.arange(n)
    for k in range(t):
        d_emit[k, at, gold[k]] -= 1
        if k:
            np.add.at(d_move, (gold[k - 1], gold[k]), -1)
    return d_emit / n, d_move / n


@lru_cache(maxsize=2)
def train(seed: int = 7, background: tuple[str, ...] = (), examples: int = EXAMPLES, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """The tagger's weights, by Adam on mini-batches; the same seed gives the same weights."""
    rng = np.random.default_rng(seed)
    made = labelled(seed, examples, background)
    x = np.stack([classes(t) for t, _ in made]).T
    y = np.stack([_tags(LENGTH, s) for _, s in made]).T
    k, width = len(TAGS), EMBED + HIDDEN
    shape = {"embed": (ALPHABET, EMBED), "w0": (width, 4 * HIDDEN), "w1": (width, 4 * HIDDEN), "b0": (4 * HIDDEN,), "b1": (4 * HIDDEN,), "out": (2 * HIDDEN, k), "bias": (k,), "move": (k, k)}
    p = {n: (rng.normal(size=s) * (0.3 if len(s) > 1 else 0)).astype(np.float32) for n, s in shape.items()}
    p["move"] *= 0
    for b in ("b0", "b1"):
        p[b][HIDDEN : 2 * HIDDEN] = 1
    mean, var, step, size = {n: 0.0 for n in p}, {n: 0.0 for n in p}, 0, 64
    for epoch in range(epochs):
        order = rng.permutation(examples)
        for at in range(0, examples, size):
            pick = order[at : at + size]
            ids, gold = x[:, pick], y[:, pick]
            fed, keep0, keep1 = p["embed"][ids], [], []
            h0, h1 = _lstm(fed, p["w0"], p["b0"], keep0), _lstm(fed[::-1], p["w1"], p["b1"], keep1)
            h = np.concatenate([h0, h1[::-1]], axis=2)
            d_emit, d_move = _crf(h @ p["out"] + p["bias"], p["move"] + FORBIDDEN, gold)
            g = {"out": h.reshape(-1, 2 * HIDDEN).T @ d_emit.reshape(-1, k), "bias": d_emit.sum(axis=(0, 1)), "move": d_move}
            d_h = d_emit @ p["out"].T
            d0, g["w0"], g["b0"] = _lstm_back(fed, p["w0"], keep0, d_h[:, :, :HIDDEN])
            d1, g["w1"], g["b1"] = _lstm_back(fed[::-1], p["w1"], keep1, d_h[::-1, :, HIDDEN:])
            g["embed"] = np.zeros_like(p["embed"])
            np.add.at(g["embed"], ids, d0 + d1[::-1])
            step += 1
            rate = 0.02 * (1 - epoch / epochs)
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for n, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                mean[n] = 0.9 * mean[n] + 0.1 * v
                var[n] = 0.99 * var[n] + 0.01 * v**2
                p[n] = (p[n] - rate * (mean[n] / (1 - 0.9**step)) / (np.sqrt(var[n] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def decode(p: dict[str, np.ndarray], windows: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Spans (start, end, kind, score) of each window by Viterbi search; all windows at once, none seeing what pads it."""
    sizes = np.array([len(w) for w in windows])
    longest, at = int(sizes.max()), np.arange(len(windows))
    ids, turned = np.zeros((longest, len(windows)), np.int16), np.zeros((longest, len(windows)), np.int16)
    for k, w in enumerate(windows):
        ids[: len(w), k] = classes(w)
        turned[: len(w), k] = ids[: len(w), k][::-1]
    back = _lstm(p["embed"][turned], p["w1"], p["b1"])[np.maximum(sizes[None, :] - 1 - np.arange(longest)[:, None], 0), at]
    emit = np.concatenate([_lstm(p["embed"][ids], p["w0"], p["b0"]), back], axis=2) @ p["out"] + p["bias"]
    move, best, came = p["move"] + FORBIDDEN, emit[0], []
    for k in range(1, longest):
        paths, inside = best[:, :, None] + move, (k < sizes)[:, None]
        came.append(np.where(inside, paths.argmax(axis=1), np.arange(len(TAGS))))
        best = np.where(inside, paths.max(axis=1) + emit[k], best)
    tags = np.empty((longest, len(windows)), np.int64)
    tags[-1] = best.argmax(axis=1)
    for k in range(longest - 2, -1, -1):
        tags[k] = came[k][at, tags[k + 1]]
    out = []
    for k, w in enumerate(windows):
        own, spans, start = tags[: len(w), k], [], None
        gain = emit[: len(w), k].max(axis=1) - emit[: len(w), k, 0]
        edges = [*np.flatnonzero((own == 0) | (own % 2 == 1)).tolist(), len(w)]
        for a, b in zip(edges, edges[1:]):
            if own[a]:
                spans.append((a, b, KINDS[(own[a] - 1) // 2], float(gain[a:b].sum())))
        out.append(spans)
    return out


def windows_of(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over all stretches that can hold personal data; each stretch begins and ends beyond ``REACH``."""
    stretches: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if stretches and a <= stretches[-1][1]:
            stretches[-1][1] = max(b, stretches[-1][1])
        else:
            stretches.append([a, b])
    return [(s, min(b, s + WINDOW)) for a, b in stretches for s in (range(a, b - WINDOW // 2, WINDOW // 2) if b - a > WINDOW else (a,))]


#: What an added span may look like; a dot with spaces has them on both sides.
LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[(\[{<] ?[aA][tT] ?[)\]}>]) ?[A-Za-z0-9-]+(?:(?:\.| \. | ?[(\[{<] ?[dD][oO][tT] ?[)\]}>] ?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:(?:\.| \. |\[\.\]|\(\.\))[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[ .\-/]{0,2}[0-9])+"),
    "phone": re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/]{0,2}[0-9])+"),
}


RUNS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
EDGES = frozenset(" \n\t.,;:!?|*")


def trimmed(text: str, a: int, b: int) -> Span:
    """A span that cuts no run of letters and digits (with what an address may hold between them), without blanks and stops at its ends."""
    while a > 0 and text[a - 1] in RUNS and text[a] in RUNS:
        a -= 1
    while b < len(text) and text[b - 1] in RUNS and text[b] in RUNS:
        b += 1
    while a < b and text[a] in EDGES:
        a += 1
    while a < b and text[b - 1] in EDGES:
        b -= 1
    return a, b


def fits(kind: str, value: str) -> bool:
    """Whether an added span holds what its kind must."""
    found = digits(value)
    if not LOOSE[kind].fullmatch(value):
        return False
    if kind == "email":
        return True
    if kind == "ip":
        return all(map(part_fits, re.findall("[0-9]+", value)))
    return 13 <= len(found) <= 19 and luhn(found) if kind == "card" else 10 <= len(found) <= 15


def reconcile(found: list[tuple[int, int, str, float]], taken: list[Span]) -> list[tuple[int, int, str]]:
    """The spans, apart from each other and from those taken, of the largest total score."""
    taken, free = sorted(taken), []
    starts = [a for a, _ in taken]
    ends = np.maximum.accumulate([b for _, b in taken]) if taken else []
    for a, b, kind, score in sorted(set(found), key=lambda x: (x[1], x[0], x[2])):
        k = bisect_right(starts, b)
        if not (k and ends[k - 1] >= a):
            free.append((a, b, kind, score))
    stops, best, pick = [b for _, b, _, _ in free], [0.0], []
    for k, (a, _, _, score) in enumerate(free):
        before = bisect_right(stops, a, 0, k)
        pick.append((best[before] + score > best[k], before))
        best.append(max(best[k], best[before] + score))
    out, k = [], len(free)
    while k:
        if pick[k - 1][0]:
            out.append(free[k - 1][:3])
            k = pick[k - 1][1]
        else:
            k -= 1
    return out[::-1]


def find(p: dict[str, np.ndarray], rows: list[str]) -> list[tuple[dict[str, list[Span]], dict[str, list[Span]]]]:
    """(base spans, all spans) of each whole text."""
    jobs = [(k, a, b) for k, text in enumerate(rows) for a, b in windows_of(text)]
    found: dict[int, list[tuple[int, int, str, float]]] = {}
    jobs.sort(key=lambda j: j[2] - j[1])
    for at in range(0, len(jobs), BATCH):
        part = jobs[at : at + BATCH]
        for (k, a, b), spans in zip(part, decode(p, [rows[k][a:b] for k, a, b in part])):
            for s, e, kind, score in spans:
                if e - s < 3 or (s == 0 and a > 0) or (e == b - a and b < len(rows[k])):
                    continue  # cut by the window's border
                c, d = trimmed(rows[k], a + s, a + e)
                if fits(kind, rows[k][c:d]):
                    found.setdefault(k, []).append((c, d, kind, score))
    out = []
    for k, text in enumerate(rows):
        base = base_spans(text)
        whole = base
        if k in found and (more := reconcile(found[k], [s for spans in base.values() for s in spans])):
            whole = {kind: sorted([*base[kind], *((a, b) for a, b, own in more if own == kind)]) for kind in KINDS}
        out.append((base, whole))
    return out


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind's mark; where spans overlap, the first one's mark stands for all."""
    out, at = [], 0
    for a, b, kind in sorted((a, -b, kind) for kind in KINDS for a, b in spans[kind]):
        b = -b
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _scan(batches: Iterator[pa.RecordBatch], p: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in sliced(batches):
        found = find(p, texts(batch))
        counts = [pa.array([len(base[kind]) for base, _ in found], pa.int64()) for kind in KINDS]
        digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([listed(whole) for _, whole in found], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def background(docs: DataFrame) -> tuple[str, ...]:
    """The beginnings of ``BACKGROUND`` documents, those of the least hashed ids and texts."""
    rows = only(docs, "doc_id", "text").where("length(text) >= 80").withColumn("h", F.xxhash64("doc_id", "text"))
    least = rows.select("h").distinct().orderBy("h").limit(BACKGROUND)  # texts of just these are read, not of each partition's best
    found = rows.join(F.broadcast(least), "h").groupBy("h").agg(F.min(F.substring("text", 1, PASSAGE)).alias("t"))
    return tuple(r.t for r in found.orderBy("h").collect())


def scan(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, base spans by kind (counts and a digest) and all spans of each row."""
    return only(docs, "doc_id", "text").mapInArrow(partial(_scan, p=train(seed, background(docs))), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _redact(batches: Iterator[pa.RecordBatch], p: dict[str, np.ndarray], place: int, counted: int | None) -> Iterator[pa.RecordBatch]:
    alone()
    for batch in sliced(batches):
        rows, columns = batch.column(place).to_pylist(), list(batch.columns)
        found = find(p, ["" if x is None else x for x in rows])
        clean = [x if x is None else redacted(x, whole) for x, (_, whole) in zip(rows, found)]
        columns[place] = pa.array(clean, pa.string())
        if counted is not None:
            n = columns[counted]
            columns[counted] = pa.array([old if x is None else len(x) for x, old in zip(clean, n.to_pylist())], n.type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def redact(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The same rows and columns, all spans in their texts replaced by marks such as [EMAIL], and n_chars to match."""
    whole = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    counted = isinstance(whole, (IntegerType, LongType))
    made = partial(_redact, p=train(seed, background(docs)), place=docs.columns.index("text"), counted=docs.columns.index("n_chars") if counted else None)
    plain = importable(docs).toDF(*(f"c{k}" for k in range(len(docs.columns))))  # columns of any name pass
    return plain.mapInArrow(made, plain.schema).toDF(*docs.columns)
