"""BPE encoding and decoding by speculation and verification.

For each word not seen before in a task, greedy longest match proposes tokens. A sequence of tokens is what merging
would give exactly if every adjacent pair is: so all adjacent pairs of all proposals are tested at once, on arrays, and
only words with a failing pair are merged step by step.

Why a pair test: of two neighbours, undo merges from the latest to the earliest, watching the two symbols at the
border. The pair fails if at some time these two could merge, and that merge comes before the one that really used up
one of them.

Defined results: null is the empty text, with no tokens; repeated rows are encoded alike; an empty table gives an empty
table; other columns are ignored. A text or a single word of any length is encoded whole, in time that grows with n log n
and memory that grows with n. The strings of special tokens in a text become these tokens.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow
from .shingles import slices

#: Characters of words kept per task, with 100 for what a word needs besides; when more, the memory is emptied.
KEPT_CHARACTERS = 64 << 20
#: Letters up to which a word is merged without a heap.
SHORT = 64
#: Texts are encoded in slices of about so many characters.
SLICE = 1 << 20

# fixed values: the split of the tokenizer's file, and the same for texts of code points below 256
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
SPLIT_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\x09-\x0d\x20\x85\xa0a-z0-9ªµºß-öø-ÿ²³¹¼½¾]+")
NOT_LATIN = re.compile("[^\x00-\xff]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(free)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary with word ends, from the JSON text of a tokenizer's file."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.strings = [""] * size
        for s, i in [*self.ids.items(), *self.special.items()]:
            self.strings[i] = s
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # the time of each token's merge, 0 for single symbols; the two parts it is made of
        self.time = np.zeros(size, np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank: dict[tuple[str, str], int] = {}
        keys, results = [], []
        for at, (a, b) in enumerate(merges, 1):
            i, j, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[a, b] = at
            keys.append(i * size + j)
            results.append(at)
            if self.left[made] < 0:
                self.time[made], self.left[made], self.right[made] = at, i, j
        order = np.argsort(keys)
        self.size, self.keys, self.times = size, np.array(keys, np.int64)[order], np.array(results, np.int64)[order]
        compound = np.flatnonzero(self.left >= 0)
        sound = self.compatible(self.left[compound], self.right[compound], self.time[compound])
        broken = {self.strings[i] for i in compound[~sound]}
        for i in compound:  # in order of ids: a token of an unsound part is unsound
            if self.strings[self.left[i]] in broken or self.strings[self.right[i]] in broken:
                broken.add(self.strings[i])
        self.sound = {s: i for s, i in self.ids.items() if s not in broken}
        self.longest = max(map(len, self.ids), default=1)
        self.reach: dict[str, int] = {}  # letters of the longest token that begins with two letters
        for s in self.sound:
            self.reach[s[:2]] = max(self.reach.get(s[:2], 1), len(s))
        self.letters = byte_letters()

    def merge_time(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """When two neighbours merge, or a time after all merges."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.times[at], np.int64(1) << 60) if len(self.keys) else np.full(len(key), np.int64(1) << 60)

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of two neighbours comes before ``limit`` or the merges inside them."""
        left, right = left.copy(), right.copy()
        limit = np.full(len(left), np.int64(1) << 59) if limit is None else limit.copy()
        good = np.ones(len(left), bool)
        todo = np.arange(len(left))
        while len(todo):
            l, r = left[todo], right[todo]
            bad = self.merge_time(l, r) < limit[todo]
            good[todo[bad]] = False
            open_ = ~bad & (np.maximum(self.time[l], self.time[r]) > 0)
            todo, l, r = todo[open_], l[open_], r[open_]
            in_left = self.time[l] > self.time[r]  # of equal ones the left was merged first, so the right is undone first
            limit[todo] = np.where(in_left, self.time[l], self.time[r] + 1)
            left[todo] = np.where(in_left, self.right[l], l)
            right[todo] = np.where(in_left, r, self.left[r])
        return good

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over the vocabulary's letters."""
        at, n, out, reach = 0, len(word), [], self.reach
        while at < n:
            if n - at + len(self.end) <= self.longest and (i := self.sound.get(word[at:] + self.end)) is not None:
                out.append(i)
                break
            for stop in range(min(n - 1, at + reach.get(word[at : at + 2], 1)), at, -1):
                if (i := self.sound.get(word[at:stop])) is not None:
                    out.append(i)
                    at = stop
                    break
            else:  # the last letter has no form with a word end
                out.append(self.ids[word[at:]])
                break
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging, always the earliest merge and of these the leftmost, in n log n steps for n letters."""
        parts = [*word[:-1], word[-1] + self.end]
        n = len(parts)
        if n <= SHORT:
            return self._merge_short(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        waiting = [(at, k) for k, pair in enumerate(zip(parts, parts[1:])) if (at := self.rank.get(pair)) is not None]
        heapify(waiting)
        while waiting:
            at, k = heappop(waiting)
            j = after[k]
            if j < 0 or parts[k] is None or self.rank.get((parts[k], parts[j])) != at:
                continue  # what stood here has been merged with something else
            parts[k], parts[j] = parts[k] + parts[j], None
            after[k] = j = after[j]
            if j >= 0:
                before[j] = k
                if (at := self.rank.get((parts[k], parts[j]))) is not None:
                    heappush(waiting, (at, k))
            if (i := before[k]) >= 0 and (at := self.rank.get((parts[i], parts[k]))) is not None:
                heappush(waiting, (at, i))
        return [self.ids[p] for p in parts if p is not None]

    def _merge_short(self, parts: list[str]) -> list[int]:
        """As ``merge``; for few letters looking through all ranks is faster than a heap."""
        rank, never = self.rank.get, 1 << 60
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), never)
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), never)
        return [self.ids[p] for p in parts]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        letters = self.letters
        mapped = [w if w.isascii() and w.isalnum() else "".join([letters[b] for b in w.encode()]) for w in words]
        out = [self.propose(w) for w in mapped]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((i for ids in out for i in ids), np.int64, int(sizes.sum()))
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(out)), sizes)
            inner = np.flatnonzero(owner[1:] == owner[:-1])
            bad = inner[~self.compatible(flat[inner], flat[inner + 1])]
            for w in np.unique(owner[bad]).tolist():
                out[w] = self.merge(mapped[w])
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text, normalised; special tokens as they stand."""
        if self.special_split is not None and "<|" in text:
            out = []
            for k, part in enumerate(self.special_split.split(text)):
                out += [part] if k % 2 else self._pieces(part)
            return out
        return self._pieces(text)

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if NOT_LATIN.search(text) is None:
            return SPLIT_LATIN.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # each letter alone, so no final sigma
        return SPLIT.findall(text)


#: What a task knows: vocabulary, words' numbers, all their ids in a row, where each word's begin and how many, how many ids, characters.
_loaded: dict[int, list] = {}


def forget() -> None:
    """After a task its words go; the vocabulary stays for the worker's next task."""
    for key, state in _loaded.items():
        _loaded[key] = _fresh(state[0])


def _fresh(vocabulary: Vocabulary) -> list:
    return [vocabulary, {}, np.zeros(1 << 18, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0]


def _state(text: str) -> list:
    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = _fresh(Vocabulary(text))
    return _loaded[key]


def _learn(state: list, words: list[str]) -> None:
    vocabulary, codes = state[0], state[1]
    plain = [w for w in words if w not in vocabulary.special]
    encoded = vocabulary.encode_words(plain) + [[vocabulary.special[w]] for w in words if w in vocabulary.special]
    names = plain + [w for w in words if w in vocabulary.special]
    sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
    used, first = state[5], len(codes)
    need = used + int(sizes.sum())
    while need > len(state[2]):
        state[2] = np.concatenate([state[2], np.zeros_like(state[2])])
    while first + len(names) > len(state[3]):
        state[3], state[4] = np.concatenate([state[3], np.zeros_like(state[3])]), np.concatenate([state[4], np.zeros_like(state[4])])
    state[2][used:need] = [i for ids in encoded for i in ids]
    state[3][first : first + len(names)] = used + np.cumsum(sizes) - sizes
    state[4][first : first + len(names)] = sizes
    codes.update(zip(names, range(first, first + len(names))))
    state[5] = need
    state[6] += sum(map(len, names)) + 100 * len(names)


def encode_texts(texts: list[str | None], spec: str) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of the texts in a row, and the n + 1 places where each text begins."""
    state = _state(spec)
    if state[6] > KEPT_CHARACTERS:
        _loaded[hash(spec)] = state = _fresh(state[0])
    found = [state[0].pieces(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, found), np.int64, len(found))
    flat = [w for words in found for w in words]
    new = set(flat).difference(state[1])
    if new:
        _learn(state, sorted(new))
    codes = np.fromiter(map(state[1].__getitem__, flat), np.int64, len(flat))
    sizes = state[4][codes]
    ends = np.cumsum(sizes)
    spots = np.repeat(state[3][codes] - ends + sizes, sizes) + np.arange(int(sizes.sum()))
    places = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
    return state[2][spots], places


def _encoder(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            a = 0
            while a < len(texts):
                part, size, b = [], 0, a
                while b < len(texts) and (b == a or size < SLICE):
                    part.append(texts[b].as_py())
                    size += len(part[-1] or "")
                    b += 1
                ids, places = encode_texts(part, spec.value)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])
                a = b

    return run


def encode(docs: DataFrame, path: str, *, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """``doc_id, ids`` for each row of ``docs``; ``path`` is the tokenizer's JSON file, read once on the driver (about 2 MB)."""
    with open(path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    return in_arrow(docs.select(F.col(row_id).cast("long").alias("doc_id"), F.col(text).alias("text")), _encoder(spec), "doc_id long, ids array<int>", forget)


def _decoder(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.array(_state(spec.value)[0].strings, pa.string())
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            for a, b in slices(places, SLICE):
                tokens = strings.take(lists.slice(a, b - a).flatten())
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(places[a : b + 1] - places[a], pa.int32()), tokens), " ")
                yield pa.record_batch([batch.column(0).slice(a, b - a), lists.slice(a, b - a), texts], names=["doc_id", "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` for ``encoded(doc_id, ids)``: the tokens' strings with a space between, as the tokenizer's file has no decoder."""
    with open(path, encoding="utf-8") as file:
        spec = encoded.sparkSession.sparkContext.broadcast(file.read())
    return in_arrow(encoded.select("doc_id", "ids"), _decoder(spec), "doc_id long, ids array<int>, decoded string", forget)
