"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit distance.

The alphabet is words. The CGK walk reads a word sequence with a pointer that a random bit
of (step, word) moves on or not; two sequences at a small edit distance fall into step
again after an edit, so that their walks are at a small Hamming distance. Each repetition
samples a few steps of the walk; the words read there are the key of a bucket. The walk from every
place of a text is looked up in the buckets of the items, and each item found is compared
exactly around that place. Nothing else leads to an item.

Items are grouped in classes of sizes. The windows of a class are as long as its smallest item (``WINDOW``
words at most), so that one walk serves all its items, and each class has as many repetitions as it needs for the recall
asked for. Longer items of a class are covered by several such windows, side by side and the last at the
item's end: of an item's edits some window has no more than its share, wherever they are.

The walks from all places of a text advance together, step by step, and add up a short signature of the words that each key
samples. A bit map of the items' signatures tells at a glance which places may be in a bucket; only their keys are worked out.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from outlay.llm.common import stored

#: Letters of scripts without spaces between words are words of their own: Thai to Burmese, kana, Han.
_LETTERS = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
_WORD = re.compile(rf"[{_LETTERS}]|[^\W{_LETTERS}]+")
#: The first 256 characters, none of which is one of those letters, lower-cased, and a space for each that no word has.
_LATIN = "".join(c.lower() if _WORD.match(c) else " " for c in map(chr, range(256))).encode("latin-1")
#: Words of a bucket's key, for up to ``FEW`` windows of items in a class and for more: the more there are, the more a key has to tell apart.
SAMPLED, FEW = (5, 6), 50_000
#: Keys that are sampled from one walk.
KEYS = 8
#: Steps of a walk for each word of a window: the pointer moves on at every other, so that it stays inside.
STRETCH = 1.7
UNKNOWN, PAD = -1, -2
#: Words of documents that are handled at once in a task.
CHUNK = 150_000
#: Places whose walks advance together: fewer cost more calls, more no longer save any.
TOGETHER = 1 << 16
#: Sizes in words at which classes of items start, and the most words of a window.
CLASSES, WINDOW = (1, 2, 3, 4, 5, 7, 10, 14), 24
#: A word as a walk meets it: a bit for each step in the lower ``STEPS`` bits (``STRETCH * WINDOW`` are needed), above them its share of a signature.
STEPS = 40
#: Bits of a signature, at least and at most, and places of a bit map for each window.
LEAST, MOST, SPREAD = 16, 22, 16
#: Bytes of an index for each window of an item: a key and its owner, for each of a repetition's keys, with more repetitions than a class has been seen to need.
WINDOW_BYTES = 16 * KEYS * 16
#: Changed items of a class on which repetitions are tried.
TRIED = 640


def edits_allowed(words: int, rate: float) -> int:
    return int(words * rate + 1e-9)


@dataclass
class Part:
    """Windows of the items of one class of sizes and their buckets."""

    size: int  # words of a window
    item: np.ndarray
    offset: np.ndarray  # where the window starts in its item
    repetitions: int
    steps: list[list[list[int]]]  # sampled steps of each repetition's keys
    keys: list[list[np.ndarray]]  # sorted keys
    owners: list[list[np.ndarray]]  # the window behind each key
    bits: int  # of a signature
    may: list[list[list[np.ndarray]]]  # the bit map of the signatures behind each key
    known: int  # fewest words of the vocabulary around a place that can match
    reach: int  # words from a place on in which they are looked for


@dataclass
class Index:
    """Items as word ids, and their parts by classes."""

    item_ids: list[int | None]
    items: list[np.ndarray]
    allowed: list[int]
    vocabulary: dict[str, int]
    latin: dict[bytes, int]  # those of its words that have a byte for each character
    pairs: np.ndarray  # sorted item * words + word, for all words of each item
    parts: list[Part]
    seed: int


def _mix(x: np.ndarray, by: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(3)) * np.uint64((0x9E3779B97F4A7C15 * (2 * by + 1)) % 2**64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Walks:
    """The walks from all places of a stream of word ids, one repetition at a time."""

    def __init__(self, stream: np.ndarray, words: int, seed: int):
        self.stream, self.words, self.seed, self.place = stream, words, seed, np.arange(len(stream))

    def start(self, repetition: int) -> None:
        self.repetition, self.masks = repetition, {}

    def _bit(self, step: int) -> np.ndarray:
        """The random bit of (repetition, step, word) at each place; padding stays where it is."""
        if step // 8 not in self.masks:
            table = _mix(np.arange(self.words + 2), self.seed * 1_000_003 + self.repetition * 8191 + step // 8).astype(np.uint8)
            table[self.words] = 0  # padding stands last but one from the end: ids are -2 and -1
            self.masks[step // 8] = table[self.stream]
        return self.masks[step // 8] >> np.uint8(step % 8) & np.uint8(1)

    def moved(self, first: int, n: int) -> np.ndarray:
        """How far each place is moved on by ``n`` steps from ``first`` on."""
        if n == 0:
            return np.zeros(len(self.stream), np.uint8)
        if n == 1:
            return self._bit(first)
        half = n // 2
        return self._then(self.moved(first, half), self.moved(first + half, n - half), half)

    def _then(self, one: np.ndarray, two: np.ndarray, most: int) -> np.ndarray:
        if most == 1:  # moved by one place or none: no gathering needed
            ahead = np.append(two[1:], two[-1:])
            return one + two + one * (ahead - two)
        return one + two[np.minimum(self.place + one, len(two) - 1)]

    def moves(self, samples: list[list[int]]) -> dict[int, np.ndarray]:
        """How far each place has moved at each sampled step."""
        at, moved, out = 0, np.zeros(len(self.stream), np.uint8), {}
        for step in sorted({x for steps in samples for x in steps}):
            if step > at:
                moved = self._then(moved, self.moved(at, step - at), max(2, at))
                at = step
            out[step] = moved
        return out

    def sampled(self, steps: list[int], moves: dict[int, np.ndarray], at: np.ndarray) -> list[np.ndarray]:
        """The words that a key of the places ``at`` is made of."""
        return [self.stream[np.minimum(at + moves[step][at], len(self.stream) - 1)] for step in steps]

    def keys(self, steps: list[int], moves: dict[int, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the places ``at``, and those of them whose words are all known."""
        key, known = _key(self.sampled(steps, moves, at))
        return key[known], at[known]


def _key(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sampled words, and where all of them are known."""
    key, known = np.zeros(len(words[0]), np.uint64), np.ones(len(words[0]), bool)
    for n, word in enumerate(words):
        known &= word >= 0
        key = key * np.uint64(0xD6E8FEB86659FD93) + word.astype(np.uint64) + np.uint64(n + 1)
    key *= np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(31)), known


def _met(words: int, seed: int, repetition: int) -> np.ndarray:
    """Each word as the walks of a repetition meet it (see ``STEPS``), with the random bits of ``Walks``; unknown words and padding at the end."""
    every = np.arange(words + 2)
    out = _mix(every, 5) >> np.uint64(STEPS) << np.uint64(STEPS)
    for n in range(STEPS // 8):
        bits = _mix(every, seed * 1_000_003 + repetition * 8191 + n) & np.uint64(255)
        bits[words] = 0  # padding stays where it is
        out |= bits << np.uint64(8 * n)
    return out.view(np.int64)


def _bit_map(signatures: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, bool)
    out[signatures & ((1 << bits) - 1)] = True
    return np.packbits(out, bitorder="little")


def _steps(size: int, sampled: int, repetition: int, seed: int) -> list[list[int]]:
    """The sampled steps of each key; those of the very first are so early that no window ends before them, so that equal windows always meet."""
    rng = np.random.default_rng([seed, size, repetition])
    most = lambda n: size if repetition == 0 == n else max(size, int(STRETCH * size))
    return [np.sort(rng.integers(0, most(n), sampled)).tolist() for n in range(KEYS)]


def _stream(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences one behind the other with padding between, and where each starts."""
    sizes = np.array([len(x) for x in sequences], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int64)
    stream = np.full(int(starts[-1]) + 1, PAD, np.int64)
    for s, x in zip(starts.tolist(), sequences, strict=False):
        stream[s : s + len(x)] = x
    return stream, starts[:-1]


def _changed(words: list[int], k: int, substitute: bool, vocabulary: int, rng: np.random.Generator) -> np.ndarray:
    """``words`` after ``k`` random edits."""
    words = list(words)
    if substitute:
        for at in rng.choice(len(words), k, replace=False).tolist():
            words[at] = int(rng.integers(vocabulary))
    else:
        for _ in range(k):
            kind, at = rng.integers(3), int(rng.integers(len(words) + 1))
            words[at : at + (kind != 0)] = [] if kind == 1 else [int(rng.integers(vocabulary))]
    return np.array(words + [UNKNOWN] * k, np.int64)


def _offsets(words: int, size: int) -> list[int]:
    """Where the windows of an item start."""
    return [*range(0, words - size, size), words - size]


def _repetitions(items: list[np.ndarray], size: int, sampled: int, rate: float, vocabulary: int, recall: float, seed: int) -> int:
    """How many repetitions catch a class's items with all their edits at rate ``recall``.

    Tried on its shortest items, which have the fewest windows, and on others: half of the trials have substituted words
    alone, half edits of any kind. Repetitions are added until no more than a fourth of the misses that are
    allowed is left, and then a fifth more of them.
    """
    members = sorted((s for s in items if edits_allowed(len(s), rate)), key=len)
    if not members:
        return 1
    rng = np.random.default_rng(seed)
    tried = members[:30] + [members[i] for i in rng.integers(len(members), size=10).tolist()]
    plain = [tried[n % len(tried)] for n in range(TRIED)]
    changed = [_changed(p.tolist(), edits_allowed(len(p), rate), n // len(tried) % 2 == 1, vocabulary, rng) for n, p in enumerate(plain)]
    r, missed = 0, np.arange(TRIED)
    while len(missed) > (1 - recall) * TRIED / 4:
        (own, at), (other, _) = (_stream([x[i] for i in missed.tolist()]) for x in (plain, changed))
        windows = np.concatenate([a + np.array(_offsets(len(plain[i]), size)) for a, i in zip(at.tolist(), missed.tolist(), strict=True)])
        trial = np.repeat(np.arange(len(missed)), [len(_offsets(len(plain[i]), size)) for i in missed.tolist()])
        of_place = np.append(np.repeat(np.arange(len(missed)), [len(changed[i]) + 1 for i in missed.tolist()]), len(missed))
        samples, met = _steps(size, sampled, r, seed), np.zeros(len(missed) + 1, bool)
        one, two = Walks(own, vocabulary, seed), Walks(other, vocabulary, seed)
        one.start(r)
        two.start(r)
        of_window, its, theirs = dict(zip(windows.tolist(), trial.tolist(), strict=True)), one.moves(samples), two.moves(samples)
        for steps in samples:
            (a, a_at), (b, b_at) = one.keys(steps, its, windows), two.keys(steps, theirs, np.arange(len(other)))
            a ^= _mix(np.array([of_window[x] for x in a_at.tolist()], np.int64), 1)
            met[of_place[b_at[np.isin(b ^ _mix(of_place[b_at], 1), a)]]] = True
        missed, r = missed[~met[:-1]], r + 1
    return -(-r * 6 // 5)


def build(items: list[tuple[int | None, str]], rate: float, recall: float, seed: int) -> Index:
    """Index the items that have words."""
    vocabulary: dict[str, int] = {}
    ids, sequences = [], []
    for item_id, text in items:
        words = _WORD.findall(text.lower())
        if words:
            ids.append(item_id)
            sequences.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64))
    n_words = max(1, len(vocabulary))
    classes: dict[int, list[int]] = {}
    for i, s in enumerate(sequences):
        classes.setdefault(max(c for c in CLASSES if c <= len(s)), []).append(i)
    parts = []
    for _, members in sorted(classes.items()):
        own = [sequences[i] for i in members]
        size = min(WINDOW, *map(len, own))
        windows = [(i, o) for i in members for o in _offsets(len(sequences[i]), size)]
        sampled = SAMPLED[len(windows) > FEW]
        repetitions = _repetitions(own, size, sampled, rate, n_words, recall, seed)
        stream, starts = _stream(own)
        begin = dict(zip(members, starts.tolist(), strict=True))
        starts = np.array([begin[i] + o for i, o in windows])
        walks, steps, keys, owners, may = Walks(stream, n_words, seed), [], [], [], []
        bits = min(MOST, max(LEAST, int(SPREAD * len(windows) - 1).bit_length()))
        shares = (_mix(np.arange(n_words + 2), 5) >> np.uint64(STEPS)).astype(np.int64)
        for r in range(repetitions):
            walks.start(r)
            steps.append(_steps(size, sampled, r, seed))
            keys.append([])
            owners.append([])
            may.append([])
            moves = walks.moves(steps[-1])
            for sample in steps[-1]:
                number = np.argsort(starts, kind="stable")
                key, at = walks.keys(sample, moves, starts)
                may[-1].append([_bit_map(sum(shares[w] for w in walks.sampled(sample, moves, at)), bits)])
                # a place may start windows of one item only, so that it tells the window
                order = np.argsort(key, kind="stable")
                keys[-1].append(key[order])
                owners[-1].append(number[np.searchsorted(starts[number], at[order])])
        edits = edits_allowed(size, rate) + 1  # a window's share, and one for windows that overlap
        parts.append(Part(size, np.array([i for i, _ in windows]), np.array([o for _, o in windows]), repetitions, steps, keys, owners, bits, may, size - edits, size + edits))
    pairs = np.unique(np.concatenate([i * n_words + s for i, s in enumerate(sequences)])) if sequences else np.empty(0, np.int64)
    latin = {w.encode("latin-1"): n for w, n in vocabulary.items() if max(w) < "\u0100"}
    return Index(ids, sequences, [edits_allowed(len(s), rate) for s in sequences], vocabulary, latin, pairs, parts, seed)


def edit_span(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Fewest edits between ``item`` and any part of ``window``, and that part's start and end (the last such end's shortest part)."""
    m, n = len(item), len(window)
    steps = np.arange(n + 1)
    rows = [np.zeros(n + 1, np.int64)]
    for i in range(m):
        up = rows[-1] + 1
        up[1:] = np.minimum(up[1:], rows[-1][:-1] + (window != item[i]))
        rows.append(np.minimum.accumulate(up - steps) + steps)
    best = int(rows[-1].min())
    end = j = int(np.flatnonzero(rows[-1] == best)[-1])
    i = m
    while i:
        if j and rows[i][j] == rows[i - 1][j - 1] + (window[j - 1] != item[i - 1]):
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return best, j, end


def _retrieved(index: Index, part: Part, stream: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, place where it would start) for each place of the stream in a bucket of the class.

    Places with too few words of the vocabulary from there on can't match and aren't walked: only they and
    what their walks may read is put into a shorter stream.
    """
    n = len(stream)
    ahead = known[np.minimum(np.arange(n) + part.reach, n)] - known[:n]
    possible = ahead >= part.known
    if not possible.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    reads = max(x for r in part.steps for s in r for x in s) + 2
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(possible)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + reads, n), -1)
    where = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    shorter, own = stream[where], possible[where]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    kind = np.uint16 if part.bits <= 16 else np.uint32
    met = [_met(max(1, len(index.vocabulary)), index.seed, r) for r in range(part.repetitions)]
    for first in range(0, len(where), TOGETHER):
        piece = shorter[first : first + TOGETHER + reads]
        counted = np.flatnonzero(own[first : first + TOGETHER])
        for r in range(part.repetitions):
            places, signatures = _walked(met[r][piece], counted, part.steps[r], kind)
            for n, (sample, signature) in enumerate(zip(part.steps[r], signatures, strict=True)):
                at = _possible(signature, part.may[r][n][0], part.bits)
                key, known = _key([piece.take(places[step][at], mode="clip") for step in sample])
                if known.any():
                    found.append(_in_buckets(part, r, n, key[known], where[first + counted[at[known]]]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    items, places = zip(*found, strict=True)
    return np.concatenate(items), np.concatenate(places)


def _walked(met: np.ndarray, at: np.ndarray, samples: list[list[int]], kind: type) -> tuple[dict[int, np.ndarray], list[np.ndarray]]:
    """The places that the walks from ``at`` have come to at each sampled step, and the signature of each key."""
    places, signatures = {}, [np.zeros(len(at), kind) for _ in samples]
    for step in range(max(x for s in samples for x in s) + 1):
        word = met.take(at, mode="clip")
        times = [s.count(step) for s in samples]
        if any(times):
            places[step], share = at, (word >> STEPS).astype(kind)
            for signature, n in zip(signatures, times, strict=True):
                for _ in range(n):
                    signature += share
        word >>= step
        word &= 1
        at = at + word
    return places, signatures


def _possible(signatures: np.ndarray, may: np.ndarray, bits: int) -> np.ndarray:
    """Which of the signatures are in the bit map."""
    if bits < 8 * signatures.itemsize:
        signatures = signatures & signatures.dtype.type((1 << bits) - 1)
    bit = may.take(signatures >> 3, mode="clip") >> (signatures & 7).astype(np.uint8)
    return np.flatnonzero((bit & 1).view(bool))


def _in_buckets(part: Part, repetition: int, n: int, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, place where it would start) for the places ``at`` with these keys."""
    keys = part.keys[repetition][n]
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    many = high - low
    flat = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64), many) + np.arange(int(many.sum()))
    owner = part.owners[repetition][n][flat]
    return part.item[owner], np.repeat(at, many) - part.offset[owner]


def _numbered(index: Index, text: str) -> list[int]:
    """The words of a text as numbers. Texts with a byte for each character are cut by a table, which is several times as fast."""
    try:
        return list(map(index.latin.get, text.encode("latin-1").translate(_LATIN).split(), repeat(UNKNOWN)))
    except UnicodeEncodeError:
        return list(map(index.vocabulary.get, _WORD.findall(text.lower()), repeat(UNKNOWN)))


def search(index: Index, texts: list[str]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text number, item number, edits, first word, end word, first character, end character): the best place of each item in each text."""
    if not index.items:
        return []
    words = [_numbered(index, t) for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    # texts stand one behind the other, with padding between
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    stream = np.full(int(starts[-1]) + 1, PAD, np.int64)
    for s, w in zip(starts.tolist(), words, strict=False):
        stream[s : s + len(w)] = w
    known = np.concatenate([[0], np.cumsum(stream >= 0)])
    found = [_retrieved(index, part, stream, known) for part in index.parts]
    item, place = (np.concatenate(x) for x in zip(*found, strict=True))
    sizes, allowed = np.array([len(s) for s in index.items]), np.array(index.allowed)
    # a part of an item may stand in another text than the item's start would
    text = np.searchsorted(starts, np.clip(place + sizes[item] // 2, 0, len(stream) - 1), side="right") - 1
    within = text < len(texts)
    spread = len(stream) + 2 * int(sizes.max())
    packed = np.unique((text[within] * len(sizes) + item[within]) * spread + place[within] + int(sizes.max()))
    seeds = np.stack([packed // spread // len(sizes), packed // spread % len(sizes), packed % spread - int(sizes.max())], axis=1)
    k, m = allowed[seeds[:, 1]], sizes[seeds[:, 1]]
    low = np.maximum(starts[seeds[:, 0]], seeds[:, 2] - k)
    high = np.minimum(starts[seeds[:, 0]] + lengths[seeds[:, 0]], seeds[:, 2] + m + 2 * k)
    # each edit takes one word of the item at most: so many of the window's words must be the item's
    enough = np.zeros(len(seeds), bool)
    step = max(1, 500_000 // int((m + 3 * k).max(initial=1)))
    for a in range(0, len(seeds), step):
        part = slice(a, a + step)
        at = low[part, None] + np.arange(int((high - low)[part].max(initial=0)))
        word = stream[np.minimum(at, len(stream) - 1)]
        inside = (at < high[part, None]) & (word >= 0)
        pair = seeds[part, 1, None] * max(1, len(index.vocabulary)) + np.maximum(word, 0)
        slot = np.minimum(np.searchsorted(index.pairs, pair), len(index.pairs) - 1)
        enough[part] = (inside & (index.pairs[slot] == pair)).sum(axis=1) >= (m - k)[part]
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    seen: set[tuple[int, int, int]] = set()
    for n in np.flatnonzero(enough).tolist():
        t, i, s = seeds[n].tolist()
        known_best = best.get((t, i))
        # neighbouring places see the same words: one look at every k-th is enough, as windows reach k words further
        if (known_best and known_best[0] == 0) or (t, i, s // (int(k[n]) + 1)) in seen:
            continue
        seen.add((t, i, s // (int(k[n]) + 1)))
        a, e = max(int(starts[t]), s - 2 * int(k[n])), min(int(starts[t] + lengths[t]), s + int(m[n]) + 3 * int(k[n]))
        edits, x, y = edit_span(index.items[i], stream[a:e])
        place = (edits, a + x - int(starts[t]), a + y - int(starts[t]))
        if edits <= index.allowed[i] and (known_best is None or place[:2] < known_best[:2]):
            best[t, i] = place
    out = []
    for (t, i), (edits, x, y) in sorted(best.items()):
        spans = [w.span() for w in _WORD.finditer(texts[t].lower())]
        out.append((t, i, edits, x, y, spans[x][0] if x < len(spans) else 0, spans[y - 1][1] if y > x else 0))
    return out


@lru_cache(maxsize=1)
def _opened(shared) -> Index:
    return pickle.loads(shared.value)


class _Shared:
    """A broadcast index that each worker opens once."""

    def __init__(self, broadcast):
        self.broadcast = broadcast

    @property
    def value(self) -> Index:
        return _opened(self.broadcast)


def _counted(texts: pa.Array) -> pa.Array:
    """Windows of each item in its class."""
    out = []
    for text in texts.to_pylist():
        words = len(_WORD.findall(text.lower()))
        out.append(len(_offsets(words, min(WINDOW, max(c for c in CLASSES if c <= words)))) if words else 0)
    return pa.array(out, pa.int64())


_windows = F.arrow_udf(_counted, LongType())


def _built(rate: float, recall: float, seed: int):
    def run(rows: pa.Table) -> pa.Table:
        items = sorted(zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist(), strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        return pa.table({"block": rows.column("block").slice(0, 1), "packed": pa.array([pickle.dumps(build(items, rate, recall, seed))], pa.binary())})

    return run


def _blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str, rate: float, recall: float, index_bytes: int, seed: int) -> Iterator[tuple[_Shared, bool]]:
    """Broadcast indexes of the items, each of at most ``index_bytes`` or so, and whether it is the last. One is alive at a time.

    Items are dealt into blocks by what their windows need in an index, known before it is built; besides, each key of a class of
    sizes has its bit map, 8 kB at least and 4 bytes a window at most. Blocks are built in tasks; the
    driver reads one at a time and hands it on.
    """
    clean = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    clean = stored(spark, clean.withColumn("windows", _windows("text")), "items")
    needed = (clean.agg(F.sum("windows")).first()[0] or 0) * WINDOW_BYTES
    # a fourth less than there is room for, as blocks aren't quite equal
    blocks = 1 if needed <= index_bytes else -(-int(needed) * 4 // (3 * index_bytes))
    clean = clean.drop("windows")
    clean = clean.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    built = stored(spark, clean.groupBy("block").applyInArrow(_built(rate, recall, seed), "block int, packed binary"), "index")
    numbers = sorted(r.block for r in built.select("block").collect())
    for number in numbers:
        shared = spark.sparkContext.broadcast(bytes(built.where(F.col("block") == number).first().packed))
        yield _Shared(shared), number == numbers[-1]
        if number != numbers[-1]:
            shared.unpersist()


def matches(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = 0.2,
    recall: float = 0.99,
    index_bytes: int = 128 << 20,
    seed: int = 11,
) -> DataFrame:
    """One row per document and benchmark item found in it: ``doc_id``, ``item_id``, ``edits``, ``item_words``, the place in words and in characters.

    Words are runs of letters, digits and underscores of the lower-cased text; of scripts that put no
    spaces between words (Han, kana, Thai) each letter is a word. An item is in a
    document if some part of it is within int(``rate`` * words) word edits of the item;
    of several places the one with the fewest edits, then the first, is returned. A place is found
    with a probability of ``recall`` at the most edits, higher with fewer, always with none.
    Items go to the tasks in blocks whose index has at most ``index_bytes`` or so (about 60,000 windows of items), one pass over the documents
    for each block, so that what is broadcast, and opened in each worker, is bounded however large the benchmark is. Null or
    empty texts and items match nothing; items without an id are looked for like others, with a null ``item_id``. Repeated rows: documents with the same id give one row per
    place; repeated items count once. Character places refer to the lower-cased text. Other columns play no part.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, edits int, item_words int, first_word int, end_word int, first_char int, end_char int"
    out = None
    for shared, last in _blocks(spark, items, item_id_col, item_text_col, rate, recall, index_bytes, seed):
        found = texts.mapInArrow(_scan(shared), schema)
        found = found if last else stored(spark, found, "found")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out.distinct()


def clean(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = 0.2,
    recall: float = 0.99,
    index_bytes: int = 128 << 20,
    seed: int = 11,
) -> DataFrame:
    """The rows of ``docs`` that hold no item (see ``matches``), all columns as they are; no row is moved. Null texts stay.

    Between blocks of a large benchmark the rows that are left are written down.
    """
    for shared, last in _blocks(spark, items, item_id_col, item_text_col, rate, recall, index_bytes, seed):
        docs = docs.where(~_holds(shared)(F.coalesce(docs[text_col], F.lit(""))))
        docs = docs if last else stored(spark, docs, "left")
    return docs


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts in parts of about ``CHUNK`` words, each with the number of its first text; only one part's are Python objects at a time."""
    until = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4))) if pa.types.is_string(texts.type) and len(texts) else np.cumsum([len(x.as_py() or "") for x in texts])
    first = 0
    while first < len(texts):
        done = until[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(until, done + 6 * CHUNK, side="right")))
        yield first, texts.slice(first, end - first).to_pylist()
        first = end


def _holds(shared):
    def run(texts: pa.Array) -> pa.Array:
        held = np.zeros(len(texts), bool)
        for first, part in _parts(texts):
            held[[first + row[0] for row in search(shared.value, part)]] = True
        return pa.array(held)

    return F.arrow_udf(run, "boolean")


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = [(first + t, *rest) for first, part in _parts(batch.column("text")) for t, *rest in search(index, part)]
            columns = [batch.column("id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([index.item_ids[r[1]] for r in rows], pa.int64())]
            numbers = [[r[2] for r in rows], [len(index.items[r[1]]) for r in rows], *[[r[k] for r in rows] for k in (3, 4, 5, 6)]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(x, pa.int32()) for x in numbers], names=["doc_id", "item_id", "edits", "item_words", "first_word", "end_word", "first_char", "end_char"])

    return run
