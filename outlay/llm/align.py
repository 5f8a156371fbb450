"""Cross-tokenizer alignment: tokens of two tokenizers over the same text, linked where their byte ranges share a group.

Both tokenizers read a space and the text. The byte offsets at which tokens of both end cut the text into groups;
each token of side A is linked with each token of side B in its group. How often an id pair is linked is counted over
all documents, and each link is scored by that count and by whether it is the highest of its A id.

*Encoding.* Between two words that one space parts neither tokenizer joins anything, so a text is cut there and each
distinct word is encoded and aligned once while it is remembered (a bounded memory). A text is never shortened.

*Counting.* The ids of side A are dealt over stripes (id modulo ``stripes``). A task writes the links of a batch of
documents as one pack for each stripe; packs give partial counts, which are merged before they are shuffled by stripe.
A stripe's counts are a dense matrix, its A ids by all B ids, that ``np.add.at`` fills; its row maxima are each A id's
highest count.

*Scoring.* Packs go to their stripe's matrix; a heavy stripe is dealt over several tasks, each with a copy of its counts.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from outlay.llm.common import stored

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how a byte-level vocabulary of this kind cuts a text before it merges bytes.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"
#: UTF-8 bytes of texts that a task aligns at once, and the most of them in a batch of links.
TOGETHER, MOST_ROWS = 4 << 20, 1 << 15
#: Words a worker remembers, the most links of theirs, and the longest word that is encoded together with others.
REMEMBERED, LINKS_REMEMBERED, LONGEST = 150_000, 4 << 20, 64
#: Words that are encoded as one string.
AT_ONCE = 1000
#: Pairs of one group that are made one by one; beyond, its distinct ids are counted first.
FEW_PAIRS = 1 << 16
#: Cells that a task merges before it sends them on; bytes of a stripe's packs in one task.
MERGED, PACKED = 2 << 20, 32 << 20

_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def words_of(text: str) -> list[str]:
    """``text`` cut at single spaces between characters that are no white space: joined by spaces they give the text again."""
    if not text:
        return []
    # as many parts as white space allows: it stands alone everywhere, and there is none but these kinds
    plain = len(text.split()) == 1 + sum(map(text.count, " \n\t\r"))
    return text.split(" ") if plain else _SAFE_CUT.split(text)


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their ids."""

    def __init__(self, a_file: str, b_file: str):
        with open(a_file, encoding="utf-8") as f:
            given = json.load(f)
        letters, special = _byte_letters(), {t["content"] for t in given["added_tokens"]}
        vocabulary = {bytes(map(letters.__getitem__, token)): i for token, i in given["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=CUTS, mergeable_ranks=vocabulary, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.n_a, self.n_b = max(vocabulary.values()) + 1, self.b.get_piece_size()
        self.a_bytes: list[bytes] = [b""] * self.n_a
        for token, i in vocabulary.items():
            self.a_bytes[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Words can be encoded apart if no piece goes on past the end of a word.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        #: Ids as text, with what stands behind one inside a side of a group, at the end of side A and at the end of the group.
        self.inside, self.after_a, self.after_b = (np.array([f"{i}{c}" for i in range(max(self.n_a, self.n_b))], object) for c in ",|;")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a space and ``text`` on both sides."""
        return np.array(self.a.encode_ordinary(" " + text), np.int64), np.array(self.b.encode(text, num_threads=1), np.int64)


@lru_cache(1)
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


@dataclass
class Aligned:
    """Words with their groups; ``links`` holds, word by word, pairs of ids as ``a * n_b + b`` and how often each stands there."""

    good: np.ndarray  # whether both sides give back the word
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[str]
    first: np.ndarray  # where a word's links start; one more than words
    links: np.ndarray
    times: np.ndarray


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of them, for each i."""
    return np.repeat(starts - _starts(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))


def _none(n: int) -> Aligned:
    z = np.zeros(n, np.int64)
    return Aligned(z > 0, z, z, z, z, [""] * n, np.zeros(n + 1, np.int64), z[:0], z[:0])


def _joined(parts: list[Aligned]) -> Aligned:
    at = np.cumsum([0] + [len(p.links) for p in parts])
    first = np.concatenate([p.first[:-1] + s for p, s in zip(parts, at.tolist(), strict=False)] + [at[-1:]])
    each = [np.concatenate([getattr(p, f) for p in parts]) for f in ("good", "n_a", "n_b", "n_groups", "n_links")]
    return Aligned(*each, [g for p in parts for g in p.groups], first, *[np.concatenate([getattr(p, f) for p in parts]) for f in ("links", "times")])


def align_words(t: Tokenizers, words: list[str]) -> Aligned:
    """Align words that are encoded as one string. If that doesn't give back the string, halves are tried, down to single words."""
    if not words:
        return _none(0)
    text = " ".join(words)
    whole = (" " + text).encode()
    a, b = t.encode(text)
    if b"".join(map(t.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(t.b_bytes.__getitem__, b.tolist())) != whole:
        half = len(words) // 2
        return _joined([align_words(t, words[:half]), align_words(t, words[half:])]) if half else _none(1)
    a_end, b_end = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    n = len(common)
    a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
    n_a, n_b = np.bincount(a_group, minlength=n), np.bincount(b_group, minlength=n)
    ends = np.cumsum([len(w.encode()) + 1 for w in words])
    of_group = np.searchsorted(ends, common)
    pairs = n_a * n_b
    small = pairs <= FEW_PAIRS
    a_first, b_first = _starts(n_a), _starts(n_b)
    # small groups: each A token beside each B token of its group
    sizes = np.where(small, n_b, 0)[a_group]
    links = np.repeat(a * t.n_b, sizes) + b[_runs(b_first[a_group], sizes)]
    owner, times = np.repeat(of_group[a_group], sizes), np.ones(len(links), np.int64)
    for g in np.flatnonzero(~small).tolist():
        (x, x_times), (y, y_times) = (np.unique(s[f[g] : f[g + 1]], return_counts=True) for s, f in ((a, a_first), (b, b_first)))
        links = np.concatenate([links, (x[:, None] * t.n_b + y).ravel()])
        times = np.concatenate([times, (x_times[:, None] * y_times).ravel()])
        owner = np.concatenate([owner, np.full(len(x) * len(y), of_group[g])])
    if not small.all():
        order = np.argsort(owner, kind="stable")
        links, times, owner = links[order], times[order], owner[order]
    count = lambda sums: np.bincount(of_group, weights=sums, minlength=len(words)).astype(np.int64)
    last = lambda group: np.append(group[1:] != group[:-1], True)
    flat = np.empty(len(a) + len(b), object)
    flat[np.arange(len(a)) + b_first[a_group]] = np.where(last(a_group), t.after_a[a], t.inside[a])
    flat[np.arange(len(b)) + a_first[b_group + 1]] = np.where(last(b_group), t.after_b[b], t.inside[b])
    cut = np.searchsorted(of_group, np.arange(len(words) + 1))
    cut, listed = (a_first[cut] + b_first[cut]).tolist(), flat.tolist()
    texts = ["".join(listed[s:e])[:-1] for s, e in zip(cut, cut[1:], strict=False)]
    n_links = np.zeros(len(words), np.int64)
    np.add.at(n_links, of_group, pairs)
    return Aligned(np.ones(len(words), bool), count(n_a), count(n_b), count(np.ones(n)), n_links, texts, _starts(np.bincount(owner, minlength=len(words))), links, times)


class Memory:
    """What is known of words, in arrays that grow; forgotten as a whole when there are too many."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known = _none(0)

    def look_up(self, words: list[str]) -> tuple[Aligned, np.ndarray]:
        """The known words, and the place of each of ``words`` among them."""
        if len(self.place) > REMEMBERED or len(self.known.links) > LINKS_REMEMBERED:
            self.forget()
        place = self.place
        new = [w for w in dict.fromkeys(words) if w not in place]
        if new:
            # white space at the end of a text isn't followed by a word, so such words stand alone, and so do long ones
            alone = [w for w in new if len(w) > LONGEST or w[-1:].isspace() or not self.t.apart]
            put = set(alone)
            rest = [w for w in new if w not in put]
            parts = [align_words(self.t, rest[i : i + AT_ONCE]) for i in range(0, len(rest), AT_ONCE)] + [align_words(self.t, [w]) for w in alone]
            for w in rest + alone:
                place[w] = len(place)
            self.known = _joined([self.known, *parts])
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        return self.known, at


def _text_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = TOGETHER) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts, in batches of a few MB (or one text)."""
    for batch in batches:
        ids, texts, start, size = batch.column(0), batch.column(1), 0, 0
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        for i, n in enumerate(lengths):
            if i > start and (size + n > most_bytes or i - start >= MOST_ROWS):
                yield ids.slice(start, i - start), [x or "" for x in texts.slice(start, i - start).to_pylist()]
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield ids.slice(start), [x or "" for x in texts.slice(start).to_pylist()]


PACK = "batch long, stripe int, cells binary, per_cell binary, doc_nos binary, times binary"
DOC = "batch long, doc_no int, n_a long, n_b long, n_groups long, n_links long, groups string"


def _link(a_file: str, b_file: str, stripes: int, id_type: pa.DataType, finish):
    """Rows of documents with their groups, and packs of their links by stripe, in one stream of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(a_file, b_file)
        memory, number = Memory(t), TaskContext.get().partitionId() << 32
        rows_of_stripe = -(-t.n_a // stripes)
        for ids, texts in _text_batches(batches):
            of_doc = [words_of(x) if t.apart else [x] * bool(x) for x in texts]
            flat = [w for words in of_doc for w in words]
            n_words = np.array(list(map(len, of_doc)), np.int64)
            doc = np.repeat(np.arange(len(texts)), n_words)
            known, at = memory.look_up(flat)
            # a text that either side doesn't give back has no tokens at all
            good = np.bincount(doc, weights=~known.good[at], minlength=len(texts)) == 0
            keep = good[doc]
            doc, at = doc[keep], at[keep]
            sums = []
            for x in (known.n_a, known.n_b, known.n_groups, known.n_links):
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, doc, x[at])
                sums.append(total)
            names, cut = list(map(known.groups.__getitem__, at.tolist())), np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
            groups = [finish(";".join(names[s:e])) for s, e in zip(cut, cut[1:], strict=False)]
            n = len(texts)
            yield _rows({"batch": np.full(n, number), "doc_no": np.arange(n, dtype=np.int32), "id": ids, "n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3], "groups": pa.array(groups, pa.string())}, n, id_type)
            yield from _packs(known, doc, at, number, t, stripes, rows_of_stripe, id_type)
            number += 1

    return run


def _packs(known: Aligned, doc: np.ndarray, at: np.ndarray, number: int, t: Tokenizers, stripes: int, rows_of_stripe: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The links of a batch: for each stripe its cells, the documents of each cell and how often each has it."""
    sizes = known.first[at + 1] - known.first[at]
    where = _runs(known.first[at], sizes)
    a, b = np.divmod(known.links[where], t.n_b)
    cell = ((a % stripes) * rows_of_stripe + a // stripes) * t.n_b + b
    key = cell.astype(np.uint64) << np.uint64(16) | np.repeat(doc, sizes).astype(np.uint64)
    order = np.argsort(key)
    key, times = key[order], known.times[where][order]
    if not len(key):
        return
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, times = key[head], np.add.reduceat(times, head)
    cell, doc_no = (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.uint16)
    block = rows_of_stripe * t.n_b
    cell_head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    per_cell = np.diff(np.append(cell_head, len(cell))).astype(np.uint16)
    cells = cell[cell_head]
    edges, cell_edges = (np.searchsorted(x, np.arange(stripes + 1) * block) for x in (cell, cells))
    own = np.flatnonzero(np.diff(edges))
    low = (cells % block).astype(np.uint32)
    small = times.astype(np.uint8) if times.max() < 256 else None
    cut = lambda x, s, e: x[s:e].tobytes()
    columns = {"cells": [], "per_cell": [], "doc_nos": [], "times": []}
    for k in own.tolist():
        s, e, cs, ce = edges[k], edges[k + 1], cell_edges[k], cell_edges[k + 1]
        columns["cells"].append(cut(low, cs, ce))
        columns["per_cell"].append(cut(per_cell, cs, ce))
        columns["doc_nos"].append(cut(doc_no, s, e))
        columns["times"].append(cut(small if small is not None else times, s, e))
    yield _rows({"batch": np.full(len(own), number), "stripe": own.astype(np.int32)} | {k: pa.array(v, pa.binary()) for k, v in columns.items()}, len(own), id_type)


def _rows(columns: dict, n: int, id_type: pa.DataType) -> pa.RecordBatch:
    """A record batch of the mixed rows, null where ``columns`` has nothing."""
    kinds = {"batch": pa.int64(), "doc_no": pa.int32(), "id": id_type, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups": pa.string(), "stripe": pa.int32(), "cells": pa.binary(), "per_cell": pa.binary(), "doc_nos": pa.binary(), "times": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kind) if k in columns and not isinstance(columns[k], pa.Array) else columns[k].cast(kind) if k in columns else pa.nulls(n, kind) for k, kind in kinds.items()], list(kinds))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's packs as partial counts: for each stripe its cells and in how many documents each is."""
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def merge() -> tuple[np.ndarray, np.ndarray]:
        k, c = np.concatenate(keys), np.concatenate(counts)
        u, where = np.unique(k, return_inverse=True)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, where, c)
        return u, total

    def send() -> pa.RecordBatch:
        u, total = merge()
        stripe, cell = u >> 32, (u & 0xFFFFFFFF).astype(np.uint32)
        edges = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]])).tolist()
        pairs = list(zip(edges, [*edges[1:], len(u)], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(stripe[edges].astype(np.int32)), pa.array([cell[s:e].tobytes() for s, e in pairs], pa.binary()), pa.array([total[s:e].tobytes() for s, e in pairs], pa.binary())], ["stripe", "cells", "counts"])

    waiting = 0
    for batch in batches:
        for stripe, cells, per_cell in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            cell = np.frombuffer(cells, np.uint32).astype(np.int64)
            keys.append(stripe << 32 | cell)
            counts.append(np.frombuffer(per_cell, np.uint16).astype(np.int64))
            waiting += len(cell)
        if waiting > MERGED:
            u, total = merge()
            keys, counts, waiting = [u], [total], len(u)
            if waiting > MERGED // 2:
                yield send()
                keys, counts, waiting = [], [], 0
    if keys:
        yield send()


def _counted(rows_of_stripe: int, n_b: int):
    """Each stripe's partial counts, which come one after the other, into its dense matrix; out come the cells in use."""

    def out(stripe: int, block: np.ndarray) -> pa.RecordBatch:
        cells = np.flatnonzero(block)
        return pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([cells.astype(np.uint32).tobytes()], pa.binary()), pa.array([block[cells].tobytes()], pa.binary())], ["stripe", "cells", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, None
        for batch in batches:
            for stripe, cells, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if stripe != now:
                    if now is not None:
                        yield out(now, block)
                    now, block = stripe, np.zeros(rows_of_stripe * n_b, np.int64)
                np.add.at(block, np.frombuffer(cells, np.uint32), np.frombuffer(counts, np.int64))
        if now is not None:
            yield out(now, block)

    return run


def _scored(rows_of_stripe: int, n_b: int, flush: int = 1 << 20):
    """Sums of each document over its links in the stripes of a task. A stripe's counts come before its packs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = best = None
        sums: dict[int, np.ndarray] = {}
        held = 0

        def out() -> pa.RecordBatch:
            found = [(number, np.flatnonzero(x.any(axis=0)), x) for number, x in sums.items()]
            columns = [[d.astype(np.uint16).tobytes() for _, d, _ in found], *[[x[i][d].tobytes() for _, d, x in found] for i in (0, 1)]]
            return pa.RecordBatch.from_arrays([pa.array([number for number, *_ in found], pa.int64()), *[pa.array(c, pa.binary()) for c in columns]], ["batch", "doc_nos", "n_best", "count_sum"])

        for batch in batches:
            for number, cells, counts, per_cell, doc_nos, times in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                cell = np.frombuffer(cells, np.uint32)
                if counts is not None:
                    block = np.zeros(rows_of_stripe * n_b, np.int64)
                    block[cell] = np.frombuffer(counts, np.int64)
                    best = block.reshape(rows_of_stripe, n_b).max(axis=1)
                    continue
                doc = np.frombuffer(doc_nos, np.uint16)
                often = np.frombuffer(times, np.uint8 if len(times) == len(doc) else np.int64).astype(np.int64)
                count = block[cell]
                per = np.frombuffer(per_cell, np.uint16)
                last = int(doc.max())
                mine = sums.get(number)
                if mine is None or mine.shape[1] <= last:
                    grown = np.zeros((2, last + 1), np.int64)
                    if mine is not None:
                        grown[:, : mine.shape[1]] = mine
                        held -= mine.shape[1]
                    mine = sums[number] = grown
                    held += last + 1
                np.add.at(mine[0], doc, often * np.repeat(count == best[cell // n_b], per))
                np.add.at(mine[1], doc, often * np.repeat(count, per))
            if held > flush:
                yield out()
                sums.clear()
                held = 0
        if sums:
            yield out()

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a batch's documents from several tasks, which come one after the other, added up; a row a document."""

    def out(number: int, total: np.ndarray) -> pa.RecordBatch:
        doc = np.flatnonzero(total.any(axis=0))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), number)), pa.array(doc.astype(np.int32)), pa.array(total[0][doc]), pa.array(total[1][doc])], ["batch", "doc_no", "n_best", "count_sum"])

    now, total = None, np.zeros((2, MOST_ROWS), np.int64)
    for batch in batches:
        for number, doc_nos, n_best, count_sum in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if number != now:
                if now is not None:
                    yield out(now, total)
                now = number
                total[:] = 0
            doc = np.frombuffer(doc_nos, np.uint16)
            total[0][doc] += np.frombuffer(n_best, np.int64)
            total[1][doc] += np.frombuffer(count_sum, np.int64)
    if now is not None:
        yield out(now, total)


@dataclass
class Alignment:
    """``documents``: a row a document; ``counts``: each stripe's cells in use with their counts."""

    documents: DataFrame
    counts: DataFrame
    n_b: int
    stripes: int

    def pairs(self) -> DataFrame:
        """Each linked id pair once: a, b, how many documents have it linked, and whether that is the highest of its A id."""
        n_b, stripes = self.n_b, self.stripes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for stripe, cells, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    row, b = np.divmod(np.frombuffer(cells, np.uint32).astype(np.int64), n_b)
                    count = np.frombuffer(counts, np.int64)
                    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    best = np.repeat(np.maximum.reduceat(count, first), np.diff(np.append(first, len(row))))
                    yield pa.RecordBatch.from_arrays([pa.array(row * stripes + stripe), pa.array(b), pa.array(count), pa.array(count == best)], ["a", "b", "docs", "is_best"])

        return self.counts.select("stripe", "cells", "counts").mapInArrow(run, "a long, b long, docs long, is_best boolean")


def align(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, stripes: int = 1024, finish=str) -> Alignment:
    """Align all of ``docs``. Of each row: its id, n_a, n_b, n_groups, n_links, n_best, count_sum and its groups as text.

    ``finish`` is applied to the groups' text (``a1,a2|b1;a3|b2``) where it is made, so that a digest need not carry it;
    null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have the empty text, zeros and no
    links. Rows with equal or null ids each have a row of their own and count apart. Other columns are not read. The
    tokenizers' files must be at the same place on each machine.
    """
    t = tokenizers(a_file, b_file)
    n_b, rows_of_stripe = t.n_b, -(-t.n_a // stripes)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_name = given.schema["id"].dataType.simpleString()
    doc_kinds, pack_kinds = DOC.split(", "), PACK.split(", ")[1:]
    schema = ", ".join([*doc_kinds[:2], f"id {id_name}", *doc_kinds[2:], *pack_kinds])
    mixed = stored(spark, given.mapInArrow(_link(a_file, b_file, stripes, to_arrow_type(given.schema["id"].dataType), finish), schema), "links")
    packs, rows = mixed.where("stripe is not null"), mixed.where("stripe is null")
    partial = packs.select("stripe", "cells", "per_cell").mapInArrow(_merged, "stripe int, cells binary, counts binary")
    counts = stored(spark, partial.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(_counted(rows_of_stripe, n_b), "stripe int, cells binary, counts binary"), "counts")
    # a row a stripe: at most ``stripes`` rows of two numbers
    shares = packs.groupBy("stripe").agg(F.ceil(F.sum(F.octet_length("doc_nos")) / PACKED).cast("int").alias("shares"))
    dealt = packs.join(F.broadcast(shares), "stripe").select("stripe", F.pmod(F.xxhash64("batch"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), "batch", "cells", F.lit(None).cast("binary").alias("counts"), "per_cell", "doc_nos", "times")
    copies = counts.join(F.broadcast(shares), "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("batch"), "cells", "counts")
    both = dealt.unionByName(copies, allowMissingColumns=True).repartition("stripe", "share").sortWithinPartitions("stripe", "share", "kind")
    scored = both.select("batch", "cells", "counts", "per_cell", "doc_nos", "times").mapInArrow(_scored(rows_of_stripe, n_b), "batch long, doc_nos binary, n_best binary, count_sum binary")
    sums = scored.repartition("batch").sortWithinPartitions("batch").mapInArrow(_totals, "batch long, doc_no int, n_best long, count_sum long")
    out = rows.select("batch", "doc_no", "id", "n_a", "n_b", "n_groups", "n_links", "groups").join(sums, ["batch", "doc_no"], "left")
    none = F.lit(0).cast("long")
    out = out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups")
    return Alignment(out, counts, n_b, stripes)
