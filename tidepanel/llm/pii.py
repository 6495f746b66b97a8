"""Personal data: exact patterns, and a character LSTM with CRF transitions for other notations and for secrets.

The tagger reads overlapping windows. Where windows overlap their scores are averaged, a character counting the more the
further it is from a window's edge, and each run of windows is decoded once over the joined scores, so the tags are the
best sequence for the whole run, whatever its length. Runs of one tag are spans. A span is added if it passes its kind's
check and touches no span of the patterns; those stay as they are.

Every check needs a digit, an ``@`` or an ``at`` in brackets. So a window can only matter if it or a neighbour has one,
and only such windows are read; ``everywhere=True`` reads all.

Defined results: null is the empty text, with no spans; a text of any length is read whole, in memory that grows with
its length; repeated rows are judged alike; an empty table gives an empty table; other columns are ignored, or carried as
they are by ``mask_personal_data``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tagger
from .common import in_arrow
from .tagger import KINDS, luhn

#: The kinds that patterns find.
BASE_KINDS = KINDS[:4]

#: Characters of a window and from one window to the next; windows read at once; characters a slice.
WINDOW, STEP, TOGETHER, SLICE = 128, 64, 512, 1 << 20
#: Characters of runs that are decoded at once, about; a longer run is decoded alone.
DECODED = 1 << 17

Span = tuple[str, int, int]

# fixed values: the patterns of the first four kinds
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile("[0-9@]")
_BRACKETS = re.compile(r"[\[(] ?at ?[\])]", re.IGNORECASE)
_DOT = re.compile(r" ?[\[(] ?dot ?[\])] ?", re.IGNORECASE)
_PIECE = re.compile(r"(?:[^A-Za-z]| ?ext\. ?| x(?=[0-9]))+")
_GROUP = re.compile("[+(]{0,2}[0-9０-９]+")
_EXTENSION = re.compile(r" (?:ext\. ?|x)[0-9]{1,4}\Z")
_NOT_DIGIT = re.compile("[^0-9]+")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL_LETTERS:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            end = found.end()
        else:
            end = at + 1  # the local part of a later address can't hold an @
        at = text.find("@", end)


def valid_ip(s: str) -> bool:
    parts = s.split(".")
    value = lambda p: int(p or 0) if len(p) <= 3 else 256  # noqa: E731  without leading zeros; a number of thousands of digits isn't converted
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and value(p.lstrip("0")) <= 255 for p in parts)


def valid_card(s: str, least: int = 14) -> bool:
    digits = _NOT_DIGIT.sub("", s)
    return least <= len(digits) <= 19 and luhn(digits)


def valid_phone(s: str, least: int = 10) -> bool:
    return least <= len(_NOT_DIGIT.sub("", s)) <= 15


def base_spans(text: str) -> list[Span]:
    """The patterns' spans, leftmost and non-overlapping within each kind, by start and kind."""
    if not _SIGN.search(text):
        return []
    out: list[Span] = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if valid_ip(m.group())]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if valid_card(m.group())]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if valid_phone(m.group())]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _added_check(kind: str, s: str) -> bool:
    """What a tagged span must be: all of a span's sign, and of a length that such data have."""
    s = s.translate(_NARROW)
    if kind == "email":
        plain = _DOT.sub(".", _BRACKETS.sub("@", s)).replace(" @", "@").replace("@ ", "@")
        return re.fullmatch(r"[^\s@]{1,64}@[^\s@.]+(\.[^\s@.]+)+", plain) is not None
    if kind == "ip":
        return valid_ip(s)
    if kind == "secret":
        return re.fullmatch(r"[A-Za-z0-9_+/=-]{16,256}", s) is not None and _SIGN.search(s) is not None and not s.isdigit() and len(set(s)) > 6
    if kind == "card":
        return re.fullmatch(r"[0-9][0-9\x20./-]*[0-9]", s) is not None and valid_card(s, 13)
    plain = _EXTENSION.sub("", s)
    return re.fullmatch(r"\+?[0-9(][0-9()\x20./-]*[0-9]", plain) is not None and valid_phone(plain, 9 if plain.startswith("0") else 10)


_NARROW = {c + 0xFEE0: c for c in range(33, 127)}


def cued(text: str) -> bool:
    """Whether a text has anything that a span needs."""
    return _SIGN.search(text) is not None or _BRACKETS.search(text) is not None or (not text.isascii() and re.search("[０-９＠]", text) is not None)


def _windows(text: str, points: np.ndarray, everywhere: bool) -> np.ndarray:
    """The places where the windows to be read begin: all, or those that have a cue in themselves or a neighbour."""
    n = max(1, -(-(len(points) - WINDOW) // STEP) + 1) if len(points) > WINDOW else 1
    starts = np.arange(n) * STEP
    if everywhere:
        return starts
    plain = tagger.narrow(points)
    cue = np.flatnonzero(((plain >= 48) & (plain <= 57)) | (plain == 64))
    cue = np.concatenate([cue, np.array([m.start() for m in _BRACKETS.finditer(text)], cue.dtype)])
    read = np.zeros(n, bool)
    for shift in range(-(WINDOW // STEP) - 1, WINDOW // STEP + 1):
        k = cue // STEP + shift
        read[k[(k >= 0) & (k < n)]] = True
    return starts[read]


#: What a character of a window counts where windows overlap.
_TRUST = 1.0 + np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]).astype(np.float32)


def _runs(points: list[np.ndarray], jobs: list[tuple[int, int]], weights: dict) -> Iterator[tuple[int, int, np.ndarray]]:
    """``text, place, scores`` of each run of overlapping windows, the windows' scores joined."""
    at, held = -1, None  # the run that is open: its text, begin, sums and weights
    for a in range(0, len(jobs), TOGETHER):
        part = jobs[a : a + TOGETHER]
        x = np.zeros((WINDOW, len(part)), np.int64)
        for column, (k, s) in enumerate(part):
            piece = points[k][s : s + WINDOW]
            x[: len(piece), column] = tagger.classes(piece)
        scores = tagger.emissions(weights, x)
        for column, (k, s) in enumerate(part):
            size = min(WINDOW, len(points[k]) - s)
            if held is None or at != k or s > held[1]:
                if held is not None:
                    yield at, held[0], held[2][: held[1] - held[0]] / held[3][: held[1] - held[0], None]
                at, held = k, [s, s, np.zeros((4 * WINDOW, tagger.TAGS), np.float32), np.zeros(4 * WINDOW, np.float32)]
            begin = s - held[0]
            while begin + size > len(held[3]):
                held[2], held[3] = np.concatenate([held[2], np.zeros_like(held[2])]), np.concatenate([held[3], np.zeros_like(held[3])])
            held[2][begin : begin + size] += scores[:size, column] * _TRUST[:size, None]
            held[3][begin : begin + size] += _TRUST[:size]
            held[1] = s + size
    if held is not None:
        yield at, held[0], held[2][: held[1] - held[0]] / held[3][: held[1] - held[0], None]


def _tagged(text: str, place: int, tags: np.ndarray) -> Iterator[Span]:
    """The checked spans of a run's tags; one of numbers that fails is looked at again in the pieces between its words, and these in their groups of digits."""
    cuts = np.flatnonzero(np.diff(tags)) + 1
    for b, e in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(tags)]]).tolist()):
        if tag := int(tags[b]):
            kind, at = KINDS[tag - 1], place + b
            whole = list(_checked(kind, text[at : place + e], at))
            if not whole and kind in ("ip", "card", "phone"):
                for m in _PIECE.finditer(text, at, place + e):
                    piece, spot = m.group(), m.start()
                    whole += list(_checked(kind, piece, spot)) or _grouped("card", piece, spot) or _grouped(kind, piece, spot)
            yield from whole


def _grouped(kind: str, s: str, at: int) -> list[Span]:
    """The longest checked span among the neighbouring groups of digits of ``s`` that hold two thirds of its digits at least; of equal ones the first."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(s)]
    digits = np.concatenate([[0], np.cumsum([sum(c.isdigit() for c in s[b:e]) for b, e in groups])]).tolist()
    most = {"ip": 4 * 3, "card": 19, "phone": 15 + 4}[kind]  # a phone's extension has up to four digits more
    if 3 * most < 2 * digits[-1]:
        return []
    runs = [(digits[j + 1] - digits[i], i, j) for i in range(len(groups)) for j in range(i, len(groups)) if 3 * (digits[j + 1] - digits[i]) >= 2 * digits[-1] and digits[j + 1] - digits[i] <= most]
    for _, i, j in sorted(runs, key=lambda r: (-r[0], r[1])):
        if found := list(_checked(kind, s[groups[i][0] : groups[j][1]], at + groups[i][0])):
            return found
    return []


def _checked(kind: str, s: str, at: int) -> Iterator[Span]:
    trimmed = s.strip(" \n\t.,;:-/\"'")
    if trimmed and _added_check(kind, trimmed):
        begin = at + s.find(trimmed)
        yield kind, begin, begin + len(trimmed)


def tagged_spans(texts: list[str], weights: dict, everywhere: bool = False) -> list[list[Span]]:
    """The checked spans that the tagger finds in each text."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    jobs = [(k, int(s)) for k, (t, p) in enumerate(zip(texts, points)) if len(p) for s in _windows(t, p, everywhere)]
    out: list[list[Span]] = [[] for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []

    def settle() -> None:
        if not waiting:
            return
        lengths = np.array([len(r[2]) for r in waiting], np.int64)
        tags = tagger.decode(weights, np.concatenate([r[2] for r in waiting]), lengths)
        for (k, place, _), end, size in zip(waiting, np.cumsum(lengths).tolist(), lengths.tolist()):
            out[k] += _tagged(texts[k], place, tags[end - size : end])
        waiting.clear()

    size = 0
    for run in _runs(points, jobs, weights):
        waiting.append(run)
        size += len(run[2])
        if size > DECODED:
            settle()
            size = 0
    settle()
    return out


def all_spans(texts: list[str], weights: dict, everywhere: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """For each text, the patterns' spans and all spans, both by start and kind."""
    base = [base_spans(t) for t in texts]
    read = [k for k, t in enumerate(texts) if everywhere or cued(t)]
    more = dict(zip(read, tagged_spans([texts[k] for k in read], weights, everywhere)))
    out = []
    for k, own in enumerate(base):
        free = [s for s in more.get(k, []) if all(s[2] <= b or s[1] >= e for _, b, e in own)]
        out.append((own, sorted(own + free, key=lambda s: (s[1], KINDS.index(s[0])))))
    return out


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span's name in its place; spans that overlap become one, named after the first."""
    out, at = [], 0
    for kind, b, e in spans:
        if b >= at:
            out += [text[at:b], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(texts):
        size, b = 0, a
        while b < len(texts) and (b == a or size < SLICE):
            size += len(texts[b] or "")
            b += 1
        yield a, b
        a = b


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def find_personal_data(docs: DataFrame, *, text: str = "text", row_id: str = "doc_id", everywhere: bool = False) -> DataFrame:
    """``doc_id``, the patterns' spans ``base`` and all ``spans``, as ``kind:start:end`` joined by commas, in code points."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger.train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _batches(held):
                texts = held[a:b]
                found = all_spans(texts, shared.value, everywhere)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([_joined(x) for x, _ in found], pa.string()), pa.array([_joined(y) for _, y in found], pa.string())], names=["doc_id", "base", "spans"])

    return in_arrow(docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, base string, spans string")


def mask_personal_data(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text`` masked; null stays null, and all other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger.train())
    place, names = docs.columns.index(text), docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])  # so that names with dots or twice in other cases pass

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(place)
            out: list[str | None] = []
            held = column.to_pylist()
            for a, b in _batches(held):
                texts = held[a:b]
                found = all_spans([t or "" for t in texts], shared.value)
                out += [None if t is None else masked(t, y) if y else t for t, (_, y) in zip(texts, found)]
            arrays = list(batch.columns)
            arrays[place] = pa.array(out, column.type)
            yield pa.record_batch(arrays, schema=batch.schema)

    return in_arrow(plain, run, plain.schema).toDF(*names)
