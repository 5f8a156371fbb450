"""Fuzzy name similarity, in Arrow batches: no built-in expression counts insertions and deletions alone.

``composite`` is the definition, a pair at a time. ``best_of`` finds, for each of some names, the best of a block of
candidates: common subsequences of one name with all candidates advance together, letter by letter, and
what can't reach the best so far is left out. Both give the same numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel addition over the letters of ``a``."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rest = full
    for y in b:
        met = rest & places.get(y, 0)
        rest = ((rest + met) | (rest - met)) & full
    return len(a) - rest.bit_count()


def ratio(a: str, b: str) -> float:
    """0 to 100: share of letters that stay when one text is turned into the other by insertions and deletions."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def sorted_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """Best of: the shared words against each side, and the sides with the shared words in front."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    shared, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if shared and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{shared} {only_a}".strip(), f"{shared} {only_b}".strip()
    best = ratio(with_a, with_b)
    return max(best, ratio(shared, with_a), ratio(shared, with_b)) if shared else best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any stretch of the longer, at most as long as itself."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    best, n = 0.0, len(short)
    letters = set(short)
    # a stretch of another length than the whole ends at an end of the longer text; one that begins or ends with a foreign letter is never the best
    for i in range(1 - n, len(long)):
        part = long[max(0, i) : i + n]
        if len(part) == n and part[0] not in letters and i + n < len(long):
            continue
        if 200.0 * len(part) / (n + len(part)) <= best:
            continue
        best = max(best, ratio(short, part))
        if best == 100.0:
            break
    return best


def composite(a: str, b: str) -> float:
    """0 to 1: two fifths sorted words, two fifths word sets, one fifth best stretch."""
    return (0.4 * sorted_ratio(a, b) + 0.4 * set_ratio(a, b) + 0.2 * partial_ratio(a, b)) / 100


#: Letters are counted in so many bins; letters that share one only make a bound looser.
BINS = 64
#: Letters of a name that fit the bits of a number.
BITS = 64


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each text has letters of each bin."""
    out = np.zeros((len(texts), BINS), np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % BINS
    np.add.at(out, (np.repeat(np.arange(len(texts)), sizes), letters), 1)
    return out


def forms_of(texts: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Texts as they are, their words sorted, their distinct words sorted."""
    words = [t.split() for t in texts]
    return texts, [" ".join(sorted(w)) for w in words], [" ".join(sorted(set(w))) for w in words]


class Block:
    """Candidates, ready to be compared with one name after the other."""

    def __init__(self, texts: list[str]):
        self.texts, self.n = texts, len(texts)
        self.forms = forms_of(texts)
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for t in texts for c in t} | {" "}))}
        self.sizes = [np.fromiter(map(len, f), np.int64, self.n) for f in self.forms]
        # by letter, a column for each candidate; forms with the same letters share them
        self.counts = [np.ascontiguousarray(letter_counts(list(f)).T) for f in self.forms]
        self.like = [next(k for k in range(j + 1) if np.array_equal(self.counts[k], self.counts[j])) for j in range(3)]
        self.repeats = self.forms[1] != self.forms[2]
        self.codes = [self._codes(f, s) for f, s in zip(self.forms, self.sizes, strict=True)]
        having: dict[str, list[int]] = {}
        self.words = np.zeros(self.n, np.int64)
        for i, t in enumerate(texts):
            words = set(t.split())
            self.words[i] = len(words)
            for w in words:
                having.setdefault(w, []).append(i)
        self.having = {w: np.array(at, np.int64) for w, at in having.items()}

    def _codes(self, form: list[str], sizes: np.ndarray) -> np.ndarray:
        """A row of letter numbers for each text, 0 behind its end."""
        out = np.zeros((self.n, int(sizes.max(initial=0))), np.int32)
        for i, t in enumerate(form):
            out[i, : len(t)] = [self.alphabet[c] for c in t]
        return out

    def met(self, text: str, form: int) -> np.ndarray:
        """Letters that a text has in common with each candidate, wherever they stand."""
        own, out = letter_counts([text])[0], np.zeros(self.n, np.int32)
        for b in np.flatnonzero(own):
            out += np.minimum(self.counts[form][b], own[b])
        return out

    def masks(self, text: str) -> np.ndarray:
        """For each letter of the alphabet the places where ``text`` has it; none for letters that no candidate has."""
        out = np.zeros(len(self.alphabet) + 1, np.uint64)
        for i, c in enumerate(text):
            if c in self.alphabet:
                out[self.alphabet[c]] |= np.uint64(1 << i)
        return out

    def common(self, masks: np.ndarray, size: int, form: int, at: np.ndarray) -> np.ndarray:
        """Common subsequences' lengths of a text of ``size`` letters (``BITS`` at most) with some candidates."""
        codes = self.codes[form][at, : int(self.sizes[form][at].max(initial=0))]
        return _left(masks[codes], np.full(len(at), _full(size), np.uint64))


def _full(size: int) -> np.uint64:
    return np.uint64((1 << size) - 1)


def _left(steps: np.ndarray, full: np.ndarray) -> np.ndarray:
    """Lengths of common subsequences, a row a pair: ``steps`` has the places met by letter after letter, ``full`` all places of the text they are in."""
    rest = full.copy()
    for j in range(steps.shape[1]):
        met = rest & steps[:, j]
        rest = (rest + met) | (rest - met)
    return (np.bitwise_count(full) - np.bitwise_count(rest & full)).astype(np.int64)


def _stretches(block: Block, masks: np.ndarray, size: int, at: np.ndarray) -> np.ndarray:
    """``partial_ratio`` of a text of ``size`` letters, 1 to ``BITS``, with some candidates that have letters."""
    best = np.zeros(len(at))
    sizes = block.sizes[0][at]
    for short_is_name in (True, False):
        own = np.flatnonzero((sizes >= size) == short_is_name)
        if not len(own):
            continue
        short = np.full(len(own), size) if short_is_name else sizes[own]
        long = sizes[own] if short_is_name else np.full(len(own), size)
        # stretches start from 1 - short to long - 1 and are cut at both ends of the longer text
        times = short + long - 1
        row = np.repeat(np.arange(len(own)), times)
        start = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + 1 - short[row]
        low, high = np.maximum(start, 0), np.minimum(start + short[row], long[row])
        width = high - low
        codes = block.codes[0][at[own]]
        if short_is_name:
            place = low[:, None] + np.arange(int(width.max()))
            letters = codes[row[:, None], np.minimum(place, codes.shape[1] - 1)]
            common = _left(np.where(place < high[:, None], masks[letters], np.uint64(0)), np.full(len(row), _full(size), np.uint64))
        else:
            full = (np.left_shift(np.uint64(1), np.minimum(width, 63).astype(np.uint64)) - np.uint64(1)) | np.where(width == 64, np.uint64(2**64 - 1), np.uint64(0))
            common = _left((masks[codes[:, : int(short.max())]][row] >> low.astype(np.uint64)[:, None]) & full[:, None], full)
        np.maximum.at(best, own[row], 200.0 * common / (short[row] + width))
    return best


#: Pairs whose stretches are tried at once: the best of them may settle the others.
TRIED = 32


def best_of(names: list[str], candidates: list[str], floor: float | list[float] = 0.0) -> list[tuple[float, int]]:
    """For each name the largest composite with any candidate and the first candidate that has it, as if all were compared; (-1, -1) if that is below ``floor`` (one for all, or one a name)."""
    block, out = Block(candidates), []
    for name, least in zip(names, floor if isinstance(floor, list) else [floor] * len(names), strict=True):
        out.append(_best_long(name, candidates, least) if len(name) > BITS or not name.split() else _best(name, block, least))
    return out


def _best_long(name: str, candidates: list[str], floor: float) -> tuple[float, int]:
    """Names of many letters or no words: pair by pair."""
    best, at = -1.0, -1
    for j, c in enumerate(candidates):
        score = composite(name, c)
        if score > best and score >= floor:
            best, at = score, j
    return best, at


def _best(name: str, block: Block, floor: float) -> tuple[float, int]:
    own = [f[0] for f in forms_of([name])]
    words, number, letters = set(name.split()), np.zeros(block.n, np.int64), np.full(block.n, -1, np.int64)
    for w in words & block.having.keys():
        number[block.having[w]] += 1
        letters[block.having[w]] += len(w) + 1  # the shared words, a space between two
    shares = number > 0
    # no common subsequence has a letter more often than both texts
    met: dict[tuple[int, str], np.ndarray] = {}
    for k in range(3):
        key = block.like[k], "".join(sorted(own[k]))
        met[key] = met[k, ""] = met[key] if key in met else block.met(own[k], k)
    most = [200.0 * met[k, ""] / np.maximum(len(own[k]) + block.sizes[k], 1) for k in (1, 2)]
    # where words are shared, the word sets are at 100 if one side has no others; else a side in its order has the letters that it has
    alone = 200.0 * letters / np.maximum(letters + np.minimum(len(own[2]), block.sizes[2]), 1)
    sets_most = np.where(shares, np.where((number == len(words)) | (number == block.words), 100.0, np.maximum(most[1], alone)), most[1])
    stretch = 200.0 * met[0, ""] / np.maximum(np.minimum(len(name), block.sizes[0]) + met[0, ""], 1)
    upper = (0.4 * most[0] + 0.4 * sets_most + 0.2 * stretch) / 100
    best, found, slack = -1.0, -1, 1e-9
    least = floor
    order = np.flatnonzero(upper >= least - slack)
    if not len(order):
        return best, found
    masks = [block.masks(f) for f in own]
    order = order[np.argsort(-upper[order], kind="stable")]
    for i in range(0, len(order), 512):
        at = order[i : i + 512]
        at = at[upper[at] >= least - slack]
        if not len(at):
            break
        in_order = 200.0 * block.common(masks[1], len(own[1]), 1, at) / (len(own[1]) + block.sizes[1][at])
        near = (0.4 * in_order + 0.4 * sets_most[at] + 0.2 * stretch[at]) / 100 >= least - slack
        at, in_order = at[near], in_order[near]
        if not len(at):
            continue
        # the ratio of the word sets, but where words are shared only what it can't exceed
        sets = sets_most[at]
        apart = np.flatnonzero(~shares[at])
        if block.repeats or own[1] != own[2]:
            other = at[apart]
            sets[apart] = np.where(block.sizes[2][other] == 0, 0.0, 200.0 * block.common(masks[2], len(own[2]), 2, other) / (len(own[2]) + block.sizes[2][other]))
        else:
            sets[apart] = in_order[apart]
        # the best stretch has no more in common than the whole
        in_all = block.common(masks[0], len(name), 0, at)
        part = 0.2 * (200.0 * in_all / np.maximum(np.minimum(len(name), block.sizes[0][at]) + in_all, 1))
        bound = 0.4 * in_order + 0.4 * sets + part
        inner = np.argsort(-bound, kind="stable")
        for k in range(0, len(inner), TRIED):
            now = inner[k : k + TRIED]
            now = now[bound[now] / 100 >= least - slack]
            if not len(now):
                break
            shared = now[shares[at[now]]]
            sets[shared] = [set_ratio(name, block.texts[j]) for j in at[shared].tolist()]
            now = now[(0.4 * in_order[now] + 0.4 * sets[now] + part[now]) / 100 >= least - slack]
            if not len(now):
                continue
            partial = np.where(block.sizes[0][at[now]] == 0, 0.0, _stretches(block, masks[0], len(name), at[now]))
            scores = (0.4 * in_order[now] + 0.4 * sets[now] + 0.2 * partial) / 100
            for score, j in zip(scores.tolist(), at[now].tolist(), strict=True):
                if score >= floor and (score > best or (score == best and j < found)):
                    best, found = score, j
            least = max(least, best)
    return best, found


def _found(names: pa.Array, candidates: pa.Array, floor: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("name", pa.string()), ("score", pa.float64()), ("at", pa.int32())]))
    rows = []
    for own, many, least in zip(names.to_pylist(), candidates.to_pylist(), floor.to_pylist(), strict=True):
        rows.append([{"name": n, "score": score, "at": at} for n, (score, at) in zip(own, best_of(own, many, least), strict=True) if at >= 0])
    return pa.array(rows, kind)


#: Two arrays of texts and an array of least scores, one for each of the first texts, to an array of (name, score, place of the best candidate, from 0).
fuzzy_best = F.arrow_udf(_found, T.ArrayType(T.StructType().add("name", T.StringType()).add("score", T.DoubleType()).add("at", T.IntegerType())))


def _reaching(a: pa.Array, b: pa.Array, floor: pa.Array) -> pa.Array:
    out = []
    for x, y, least in zip(a.to_pylist(), b.to_pylist(), floor.to_pylist(), strict=True):
        score = None
        if x is not None and y is not None:
            words = 0.4 * sorted_ratio(x, y) + 0.4 * set_ratio(x, y)
            score = (words + 0.2 * partial_ratio(x, y)) / 100 if (words + 20.0) / 100 >= least - 1e-9 else None
        out.append(score if score is not None and score >= least else None)
    return pa.array(out, pa.float64())


#: Composite of two texts; null where it is below a least score, or where a text is null.
fuzzy_score = F.arrow_udf(_reaching, T.DoubleType())
