"""A character tagger in numpy: two LSTMs over character classes, linear scores and a chain with transition weights.

Trained from labelled spans that a seeded generator writes: four kinds in many notations, secrets such as keys and
tokens, and things that look like them (versions, dates, digests, amounts), between words of random letters.
"""

from __future__ import annotations

from functools import lru_cache
from random import Random

import numpy as np

#: Tags; a run of one tag is a span.
KINDS = ("email", "ip", "card", "phone", "secret")
TAGS = 1 + len(KINDS)
#: Characters of a training window, hidden units a direction, batches and their size.
LENGTH, HIDDEN, BATCHES, BATCH = 96, 16, 360, 48

#: Weights are multiples of 1 / GRID.
GRID = 4096
#: Characters of a piece of a sequence in decoding.
PIECE = 256
_SINGLE = "@._%+-()/:,#= \n[]\"'"
CLASSES = 7 + len(_SINGLE)


def _class_table() -> np.ndarray:
    table = np.full(0x250, 5, np.int64)  # 0 outside the text, 5 other letters and signs
    for c in range(128):
        s = chr(c)
        table[c] = 1 if s.isdigit() else 2 if s in "abcdef" else 3 if s.islower() else 4 if s.isupper() else 6
    table[0] = 0  # what pads a window
    for k, s in enumerate(_SINGLE):
        table[ord(s)] = 7 + k
    return table


_TABLE = _class_table()


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point; full-width signs count as the narrow ones."""
    return _TABLE[np.minimum(narrow(points), 0x24F)]


def narrow(points: np.ndarray) -> np.ndarray:
    """Code points with full-width signs replaced by ASCII's."""
    return np.where((points >= 0xFF01) & (points <= 0xFF5E), points - np.uint32(0xFEE0), points)


def _lstm(p: dict, side: str, x: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states, time first, of one direction."""
    table, u = p["e" + side], p["u" + side]
    t, n = x.shape
    size = u.shape[0]
    h, c = np.zeros((n, size), u.dtype), np.zeros((n, size), u.dtype)
    out = np.empty((t, n, size), u.dtype)
    for k in range(t):
        z = table[x[k]] + h @ u
        gate = 0.5 * np.tanh(0.5 * z[:, : 3 * size]) + 0.5
        new = np.tanh(z[:, 3 * size :])
        before, prior = c, h
        c = gate[:, size : 2 * size] * c + gate[:, :size] * new
        wide = np.tanh(c)
        h = gate[:, 2 * size :] * wide
        out[k] = h
        if keep is not None:
            keep.append((gate, new, before, wide, prior))
    return out


def _lstm_back(p: dict, side: str, x: np.ndarray, keep: list, d_out: np.ndarray, grad: dict) -> None:
    u = p["u" + side]
    size = u.shape[0]
    dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
    for k in range(len(x) - 1, -1, -1):
        gate, new, before, wide, prior = keep[k]
        i, f, o = gate[:, :size], gate[:, size : 2 * size], gate[:, 2 * size :]
        dh = dh + d_out[k]
        dc = dc + dh * o * (1 - wide * wide)
        dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * wide * o * (1 - o), dc * i * (1 - new * new)], 1)
        np.add.at(grad["e" + side], x[k], dz)
        grad["u" + side] += prior.T @ dz
        dh, dc = dz @ u.T, dc * f


def emissions(p: dict, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Tag scores of windows of classes, time first."""
    ahead, back = ([], []) if keep is not None else (None, None)
    h = np.concatenate([_lstm(p, "f", x, ahead), _lstm(p, "b", x[::-1], back)[::-1]], 2)
    if keep is not None:
        keep += [ahead, back, h]
    return h @ p["w"] + p["bias"]


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


def _chain_gradient(p: dict, scores: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log-likelihood in the scores and the transitions."""
    t, n, k = scores.shape
    trans = p["trans"]
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for s in range(1, t):
        alpha[s] = scores[s] + _logsum(alpha[s - 1][:, :, None] + trans, 1)
    for s in range(t - 2, -1, -1):
        beta[s] = _logsum(trans + (scores[s + 1] + beta[s + 1])[:, None, :], 2)
    whole = _logsum(alpha[-1], 1)
    own = np.exp(alpha + beta - whole[:, None])
    d_scores = own - np.eye(k)[tags]
    d_trans = np.zeros_like(trans)
    for s in range(1, t):
        d_trans += np.exp(alpha[s - 1][:, :, None] + trans + (scores[s] + beta[s])[:, None, :] - whole[:, None, None]).sum(0)
    np.add.at(d_trans, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    return d_scores, d_trans


def decode(p: dict, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best tags of sequences of any length, laid end to end in ``scores`` (a row a character).

    Each sequence is cut into pieces of PIECE characters. For every tag that may come before a piece, all pieces find
    their best paths at once; then the pieces of a sequence are joined, the tag at each border being the one that makes
    the whole sequence's score largest, and each piece is traced back. The result is that of one pass over the sequence.
    """
    k, trans = scores.shape[1], p["trans"]
    counts = -(-lengths // PIECE)
    first = np.cumsum(counts) - counts
    n = int(counts.sum())
    owner = np.repeat(np.arange(len(lengths)), counts)
    within = (np.arange(n) - first[owner]) * PIECE
    begins = (np.cumsum(lengths) - lengths)[owner] + within
    sizes = np.minimum(PIECE, lengths[owner] - within)
    opening = within == 0
    best = np.where(np.eye(k, dtype=bool), 0.0, -1e9).astype(np.float32) * np.ones((n, 1, 1), np.float32)
    back = np.zeros((int(sizes.max(initial=0)), n, k, k), np.int8)
    for s in range(len(back)):
        live = np.flatnonzero(sizes > s)
        step = np.where(opening[live, None, None], 0.0, trans).astype(np.float32) if s == 0 else trans[None]
        paths = best[live][:, :, :, None] + step[:, None]
        back[s, live] = paths.argmax(2)
        best[live] = paths.max(2) + scores[begins[live] + s][:, None, :]
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for a, b in zip(first.tolist(), (first + counts).tolist()):
        value, trail = np.zeros(k, np.float32), []
        for q in range(a, b):
            whole = value[:, None] + best[q]
            trail.append(whole.argmax(0))
            value = whole.max(0)
        tag = int(value.argmax())
        for q in range(b - 1, a - 1, -1):
            after[q] = tag
            before[q] = tag = int(trail[q - a][tag])
    out = np.empty(len(scores), np.int8)
    tag = after.copy()
    for s in range(len(back) - 1, -1, -1):
        live = np.flatnonzero(sizes > s)
        out[begins[live] + s] = tag[live]
        tag[live] = back[s, live, before[live], tag[live]]
    return out


_LETTERS, _ALNUM, _HEX = "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"


def _word(rng: Random, letters: str = _LETTERS) -> str:
    if letters is _LETTERS and rng.random() < 0.15:
        return rng.choice(("a", "or", "and", "at", "to", "of", "by", "or call", "call", "mail", "see", "from"))
    return "".join(rng.choices(letters, k=rng.randint(1, 8)))


def _digits(rng: Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def sample_item(rng: Random, kind: int) -> str:
    """Something of kind 1 to 5 (email, ip, card, phone, secret), or for 0 something that only looks like one."""
    n, pick = rng.randint, rng.choice
    if kind == 1:
        local = _word(rng) + pick(["", ".", "_", "-", "+"]) + pick([_word(rng), _digits(rng, 2), ""])
        names = [_word(rng, _ALNUM) for _ in range(n(1, 2))] + [pick(["com", "org", "net", "de", "fr", "io"])]
        sign, dot = pick([("@", "."), ("@", "."), (" @ ", "."), ("[at]", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)")])
        return widened(rng, local.rstrip("._-+") + sign + dot.join(names))
    if kind == 2:
        return widened(rng, ".".join(str(n(0, 255)) for _ in range(4)))
    if kind == 3:
        body = str(n(3, 6)) + _digits(rng, pick([13, 14, 14, 14, 15, 17]))
        body = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return widened(rng, pick(["", "", " ", "-", ".", "/"]).join(body[i : i + 4] for i in range(0, len(body), 4)))
    if kind == 4:
        area, a, b = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        plain = pick([
            f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"+{n(1, 98)} {area} {a} {b}", f"+{n(1, 98)}{area}{a}{b}", f"{area}.{a}.{b}", f"+{n(1, 98)}-{area}-{a}-{b}",
            f"0{n(10, 99)} {a}{b}", f"0{n(100, 999)}/{a}{b}", f"0{n(10, 99)}-{a}{b}", f"00{n(10, 98)} {area} {a}{b}", f"0{n(1, 9)} {n(10, 99)} {n(10, 99)} {n(10, 99)} {n(10, 99)}",
        ])
        return widened(rng, plain + pick(["", "", "", f" ext. {n(1, 999)}", f" x{n(1, 999)}"]))
    hexed, mixed = "".join(rng.choices(_HEX, k=pick([24, 32, 40, 40, 64]))), "".join(rng.choices(_ALNUM + _LETTERS.upper(), k=n(20, 44)))
    if kind == 5:
        spoken = "".join("".join(rng.choices(_LETTERS, k=n(3, 7))) + _digits(rng, n(1, 3)) for _ in range(n(4, 6)))
        return pick([hexed, hexed, mixed, spoken.ljust(16, "7"), f"AKIA{''.join(rng.choices(_LETTERS.upper() + '0123456789', k=16))}", f"ghp_{mixed}", f"sk-{mixed}"])
    return pick([
        f"{n(1900, 2029)}-{n(1, 12):02}-{n(1, 28):02}", f"{n(1, 28)}.{n(1, 12)}.{n(1900, 2029)}", f"{n(0, 19)}.{n(0, 19)}", f"{n(0, 19)}.{n(0, 19)}.{n(0, 19)}", f"sha{pick([1, 256])}:{hexed}", f"commit {hexed}", f"md5 {hexed[:24]}",
        _digits(rng, n(1, 8)), f"{n(1, 998)},{_digits(rng, 3)}", f"{n(1, 998)}.{_digits(rng, 3)},{_digits(rng, 2)}", f"@{_word(rng)}", f"{n(1, 23)}:{_digits(rng, 2)}", f"#{_digits(rng, 5)}", f"https://{_word(rng)}.org/{_digits(rng, 5)}/{hexed[:10]}",
        f"({n(1, 98)})", f"+{n(1, 98)}", f"{_word(rng)}{_digits(rng, 2)}", f"{_word(rng)} at {_word(rng)}", f"{n(1, 99)}/{n(1, 99)}", f"{_digits(rng, 3)}-{_digits(rng, 2)}", f"ISBN 978-{n(0, 9)}-{_digits(rng, 4)}-{_digits(rng, 4)}-{n(0, 9)}",
        " ".join(pick(_LETTERS) + _digits(rng, n(1, 3)) for _ in range(n(2, 8))), " ".join(_digits(rng, n(1, 2)) for _ in range(n(2, 5))), f"{_word(rng)} at {_word(rng)}.", f"{n(1, 99)}%",
    ])


_WIDE = {c: c + 0xFEE0 for c in range(33, 127)}
#: What stands before a secret; without such a sign a long run of letters and digits is none.
SIGNS = ('token = "', 'token="', "token: ", 'api_key = "', "api_key=", 'secret: "', 'password = "', "key=", 'Authorization: Bearer ', "")


def widened(rng: Random, s: str) -> str:
    """``s``, rarely in full-width signs."""
    return s.translate(_WIDE) if rng.random() < 0.05 else s


def sample_window(rng: Random) -> tuple[str, list[int]]:
    """A text of LENGTH characters and the tag of each."""
    text, tags = "", []
    while len(text) < LENGTH + 24:
        kind = rng.choices(range(TAGS), [4, 1, 1, 1, 1, 1])[0] if rng.random() < 0.3 else -1
        part = _word(rng) if kind < 0 else sample_item(rng, kind)
        if kind == 5:
            sign = "" if part[:4] in ("AKIA", "ghp_") or part[:3] == "sk-" else rng.choice(SIGNS[:-1])
            text, tags = text + sign, tags + [0] * len(sign)
        if kind < 0 and rng.random() < 0.15:
            part = part.capitalize()
        after = rng.choice([" ", " ", " ", " ", ". ", ", ", ".\n", "\n", ": ", "### ", "&&& "])
        after = '"' + after if kind == 5 and sign.endswith('"') else after
        text += part + after
        tags += [max(kind, 0)] * len(part) + [0] * len(after)
    at = rng.randint(0, len(text) - LENGTH)
    text, tags = text[at : at + LENGTH], tags[at : at + LENGTH]
    if rng.random() < 0.2:  # the end of a text
        end = rng.randint(LENGTH // 4, LENGTH)
        text, tags = text[:end].ljust(LENGTH, "\0"), tags[:end] + [0] * (LENGTH - end)
    return text, tags


def training_batch(rng: Random, n: int) -> tuple[np.ndarray, np.ndarray]:
    rows = [sample_window(rng) for _ in range(n)]
    points = np.array([[ord(c) for c in text] for text, _ in rows])
    return classes(points).T.copy(), np.array([tags for _, tags in rows]).T.copy()


@lru_cache(maxsize=2)
def train(seed: int = 7, batches: int = BATCHES) -> dict[str, np.ndarray]:
    """The weights, after ``batches`` steps of Adam on generated windows; the same for the same arguments.

    Steps are taken in doubles and the result is rounded to a grid far coarser than what the order of a machine's sums
    can change, so that weights, and with them spans, don't depend on the machine.
    """
    numbers, rng = np.random.default_rng(seed), Random(seed)
    draw = lambda *shape: numbers.standard_normal(shape) * 0.25
    p = {"ef": draw(CLASSES, 4 * HIDDEN), "eb": draw(CLASSES, 4 * HIDDEN), "uf": draw(HIDDEN, 4 * HIDDEN), "ub": draw(HIDDEN, 4 * HIDDEN), "w": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS), "trans": np.eye(TAGS)}
    for side in "fb":
        p["e" + side][:, HIDDEN : 2 * HIDDEN] += 1  # remember at first
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, batches + 1):
        x, tags = training_batch(rng, BATCH)
        keep: list = []
        scores = emissions(p, x, keep)
        ahead, back, h = keep
        d_scores, d_trans = _chain_gradient(p, scores, tags)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["trans"], grad["bias"] = d_trans, d_scores.sum((0, 1))
        grad["w"] = h.reshape(-1, 2 * HIDDEN).T @ d_scores.reshape(-1, TAGS)
        d_h = d_scores @ p["w"].T
        _lstm_back(p, "f", x, ahead, d_h[:, :, :HIDDEN], grad)
        _lstm_back(p, "b", x[::-1], back, d_h[::-1, :, HIDDEN:], grad)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values())) / BATCH
        rate = 0.02 * (1 - 0.95 * step / batches)
        for k, g in grad.items():
            g = g / BATCH * min(1.0, 5.0 / max(norm, 1e-9))
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            p[k] = p[k] - rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return {k: (np.round(v * GRID) / GRID).astype(np.float32) for k, v in p.items()}
