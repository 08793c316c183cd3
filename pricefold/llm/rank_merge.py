"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

A batch of texts is cut into pre-tokens with array operations (classes of code points, run borders, contractions).
The distinct pre-tokens are one ragged array of symbols, at first bytes. In each step every sequence finds its
lowest-ranked pair of neighbours, and all sequences merge all occurrences of theirs, from the left, at the same time;
a sequence without a ranked pair is done and leaves the array. What survives are the tokens. A merge makes pairs of
higher rank only, so merging equal pairs together gives what merging one by one does.

Nothing is shuffled: tasks see batches of texts, and hold the vocabulary (bounded by its file) and one step of a batch.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.llm.common import steps, word_hashes

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 4
#: Rank of a pair that is no merge.
NEVER = np.int32(2**31 - 1)
#: Sequences of more symbols are merged one at a time, with a table of least ranks by block.
LONG = 2_048
BLOCK = 512
#: Strings whose tokens a task remembers; it may exceed this by those of one step.
MEMO_STRINGS = 1 << 18
#: The pattern's contractions after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    # Bytes that stand for themselves; the others are numbered from 256 on.
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@dataclass
class Vocabulary:
    """Byte-level BPE as arrays: ids of bytes, an open table of merges (pair to rank), their results, bytes of each token, special strings.

    ``splitter`` is the description of the library's pre-tokenizer, which tells the classes of code points.
    """

    byte_ids: np.ndarray
    slots: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    lengths: np.ndarray
    specials: tuple[tuple[str, int], ...]
    splitter: str

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, NEVER where it is no merge."""
        key = (left.astype(np.int64) << 32) | right
        slot = _slot(key, len(self.slots))
        held = self.slots[slot]
        out = np.where(held == key, self.ranks[slot], NEVER)
        todo = np.flatnonzero((held != key) & (held != -1))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) % len(self.slots)
            held = self.slots[slot]
            found = held == key[todo]
            out[todo[found]] = self.ranks[slot[found]]
            more = ~found & (held != -1)
            todo, slot = todo[more], slot[more]
        return out


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _pair_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ranks) by slot of an open table, a quarter full at most; empty slots hold -1. A pair's rank is its place in ``keys``."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    slots, ranks = np.full(size, -1, np.int64), np.full(size, NEVER)
    todo, at = np.arange(len(keys)), _slot(keys, size)
    while len(todo):
        free = slots[at] == -1
        order = np.flatnonzero(free)[np.unique(at[free], return_index=True)[1]]
        slots[at[order]], ranks[at[order]] = keys[todo[order]], todo[order]
        left = np.ones(len(todo), bool)
        left[order] = False
        todo, at = todo[left], (at[left] + 1) % size
    return slots, ranks


def vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE of the tokenizers library; other kinds are refused."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    plain = not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
    if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["normalizer"] or not plain:
        raise ValueError(f"{path} is not a plain byte-level BPE")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens with conditions")
    ids, symbols = model["vocab"], byte_symbols()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64).reshape(-1)
    lengths = np.zeros(max([*ids.values(), 0]) + 1, np.int64)
    for s, i in ids.items():
        lengths[i] = len(s)  # one character for each byte
    return Vocabulary(
        np.array([ids.get(s, -1) for s in symbols], np.int32), *_pair_table(keys), np.array([ids[a + b] for a, b in merges], np.int32).reshape(-1), lengths,
        tuple((t["content"], t["id"]) for t in spec["added_tokens"]), json.dumps(split),
    )


class Classes:
    """Classes of code points as the library's own pre-tokenizer sees them, asked for once for each code point met."""

    def __init__(self, splitter: str):
        from tokenizers import Tokenizer

        empty = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": json.loads(splitter), "post_processor": None, "decoder": None, "model": {"type": "BPE", "vocab": {}, "merges": []}}
        self.split = Tokenizer.from_str(json.dumps(empty)).pre_tokenizer.pre_tokenize_str
        self.known = np.full(0x110000, UNKNOWN, np.int8)

    def of(self, points: np.ndarray) -> np.ndarray:
        out = self.known[points]
        if (out == UNKNOWN).any():
            for p in set(points[out == UNKNOWN].tolist()):
                self.known[p] = next((kind for kind, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(self.split(probe + chr(p))) == 1), SPACE)
            out = self.known[points]
        return out


def special_spans(data: np.ndarray, offs: np.ndarray, specials: tuple[tuple[str, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, ids) of the special strings inside texts, leftmost and longest first; none crosses two texts."""
    found: list[tuple[int, int, int]] = []
    names = {s.encode(): i for s, i in specials if s}
    if names and len(data):
        pattern = re.compile(b"|".join(re.escape(s) for s in sorted(names, key=len, reverse=True)))
        blob = data.tobytes()
        if any(s in blob for s in names):
            for a, b in zip(offs[:-1], offs[1:]):
                found += [(m.start(), m.end(), names[m.group()]) for m in pattern.finditer(blob, int(a), int(b))]
    out = np.array(found, np.int64).reshape(-1, 3)
    return out[:, 0], out[:, 1], out[:, 2]


def pretokens(data: np.ndarray, cuts: np.ndarray, classes: Classes) -> np.ndarray:
    """Byte offsets where pre-tokens start, in order; ``cuts``: offsets that no pre-token or look-ahead crosses (0 included)."""
    if not len(data):
        return np.zeros(0, np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.cumsum(width) - width
    kind = classes.of(points)
    edge = np.zeros(len(points) + 3, bool)
    edge[np.searchsorted(at, cuts[cuts < len(data)])] = True
    edge[len(points) :] = True
    start = edge[: len(points)].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last of several white-space characters before a word starts a pre-token; a plain space takes the word in.
    after = np.flatnonzero(~edge[1 : len(points)] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after] = points[after - 1] != 32
    quote = np.flatnonzero((points == ord("'")) & start)
    padded = np.concatenate((points, np.zeros(3, np.uint32)))
    free = np.ones(len(quote), bool)
    for c in CONTRACTIONS:
        own = free & ~edge[quote + 1]
        for j, x in enumerate(c):
            own &= (padded[quote + 1 + j] == ord(x)) & ~edge[quote + 1 + j]
        i = quote[own]
        for j in range(len(c)):
            start[i + 1 + j] = False
        end = i + 1 + len(c)
        start[end[end < len(points)]] = True
        free &= ~own
    return at[start]


def _ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for each run, one after the other."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total, dtype=np.int64) + np.repeat(first - np.concatenate(([0], np.cumsum(length)[:-1])), length)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(representatives, which): one span for each distinct byte string and, for each span, the place of its own.

    Spans are put together by a 64-bit hash and compared byte by byte; one that differs from its fellows stands for itself.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = word_hashes(data, starts, ends)
    order = np.argsort(hashes)
    new = np.concatenate(([True], np.diff(hashes[order]) != 0))
    reps, which = order[new], np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    mine, length = reps[which], ends - starts
    odd = length != (ends - starts)[mine]
    same = np.flatnonzero(~odd & (mine != np.arange(len(starts))))
    for part in np.array_split(same, max(1, int(length[same].sum()) >> 22)):
        differ = data[_ragged(starts[part], length[part])] != data[_ragged(starts[mine[part]], length[part])]
        if differ.any():
            odd[part[np.unique(np.repeat(np.arange(len(part)), length[part])[differ])]] = True
    alone = np.flatnonzero(odd)
    which[alone] = len(reps) + np.arange(len(alone))
    return np.concatenate((reps, alone)), which


def _leftmost(hits: np.ndarray) -> np.ndarray:
    """Of occurrences that overlap (equal neighbours: a a a) every second one, from the left."""
    if len(hits) < 2:
        return hits
    run = np.concatenate(([True], np.diff(hits) != 1))
    begin = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
    return hits[(np.arange(len(hits)) - begin) % 2 == 0]


def _merged_long(symbols: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Surviving symbols of one long sequence: the same steps, on a linked list with the least rank of each block."""
    n = len(symbols)
    symbols = np.concatenate((symbols, [-1])).astype(np.int64)
    after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n, bool)
    rank = np.full(-(-n // BLOCK) * BLOCK, NEVER)
    rank[: n - 1] = vocab.ranked(symbols[: n - 1], symbols[1:n])
    blocks = rank.reshape(-1, BLOCK)
    least = blocks.min(axis=1)
    while (lowest := least.min()) != NEVER:
        held = np.flatnonzero(least == lowest)
        hits = (held[:, None] * BLOCK + np.arange(BLOCK))[blocks[held] == lowest]
        # A hit right after another overlaps with it: every second one of such a run, from the left.
        run = np.concatenate(([True], after[hits[:-1]] != hits[1:]))
        begin = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - begin) % 2 == 0]
        gone = after[hits]
        symbols[hits] = vocab.results[lowest]
        after[hits] = after[gone]
        before[after[gone[after[gone] < n]]] = hits[after[gone] < n]
        alive[gone] = False
        rank[gone] = NEVER
        changed = np.unique(np.concatenate((hits, before[hits])))
        changed = changed[changed >= 0]
        to = after[changed]
        rank[changed] = np.where(to < n, vocab.ranked(symbols[changed], symbols[np.minimum(to, n)]), NEVER)
        touched = np.unique(np.concatenate((changed, gone, held * BLOCK)) // BLOCK)
        least[touched] = blocks[touched].min(axis=1)
    return symbols[:n][alive]


def merged(symbols: np.ndarray, first: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, first): what survives of each sequence symbols[first[s]:first[s + 1]]; sequences keep their order."""
    total = len(first) - 1
    length = np.diff(first)
    counts = np.zeros(total, np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # (sequence of each symbol, symbols)
    for s in np.flatnonzero(length > LONG):
        left = _merged_long(symbols[first[s] : first[s + 1]], vocab)
        done.append((np.full(len(left), s), left))
    seq = np.repeat(np.arange(total, dtype=np.int32), length)
    symbols = symbols.astype(np.int32)
    if done:
        keep = (length <= LONG)[seq]
        symbols, seq = symbols[keep], seq[keep]
    rank = np.full(len(symbols), NEVER)
    inner = np.flatnonzero(seq[1:] == seq[:-1])
    rank[inner] = vocab.ranked(symbols[inner], symbols[inner + 1])
    while len(symbols):
        starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
        size = np.diff(np.concatenate((starts, [len(seq)])))
        least = np.minimum.reduceat(rank, starts)
        over = np.repeat(least == NEVER, size)
        if over.any():
            done.append((seq[over], symbols[over]))
            symbols, seq, rank = symbols[~over], seq[~over], rank[~over]
            size, least = size[least != NEVER], least[least != NEVER]
        if not len(symbols):
            break
        hits = _leftmost(np.flatnonzero(rank == np.repeat(least, size)))
        symbols[hits] = vocab.results[rank[hits]]
        stay = np.ones(len(symbols), bool)
        stay[hits + 1] = False
        place = np.cumsum(stay) - 1
        symbols, seq, rank, hits = symbols[stay], seq[stay], rank[stay], place[hits]
        marked = np.zeros(len(symbols) + 1, bool)
        marked[hits] = marked[hits - 1] = True
        changed = np.flatnonzero(marked[:-1])
        inside = (changed + 1 < len(seq)) & (seq[changed] == seq[np.minimum(changed + 1, len(seq) - 1)])
        rank[changed[~inside]] = NEVER
        rank[changed[inside]] = vocab.ranked(symbols[changed[inside]], symbols[changed[inside] + 1])
    if not done:
        return np.zeros(0, np.int64), np.zeros(total + 1, np.int64)
    seq, symbols = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
    order = np.argsort(seq, kind="stable")
    counts += np.bincount(seq, minlength=total)
    return symbols[order], np.concatenate(([0], np.cumsum(counts)))


class Memo:
    """Tokens of byte strings that a task has met, as one ragged array; when they are many, the task begins anew.

    ``make(starts, ends)`` gives (ids, first, flag) for the strings at these spans; the flag is kept with each string.
    """

    def __init__(self, make):
        self.make = make
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.first, self.flag = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Place of each span's string in ``ids``, ``first`` and ``flag``; new strings are made first."""
        if len(self.known) > MEMO_STRINGS or len(self.ids) > 8 * MEMO_STRINGS:
            self._clear()
        reps, which = distinct_spans(data, starts, ends)
        blob = data.tobytes()
        strings = [blob[a:b] for a, b in zip(starts[reps].tolist(), ends[reps].tolist())]
        at = list(map(self.known.get, strings))
        new = [i for i, place in enumerate(at) if place is None]
        if new:
            ids, first, flag = self.make(data, starts[reps[new]], ends[reps[new]])
            for place, i in enumerate(new, len(self.flag)):
                at[i] = self.known[strings[i]] = place
            self.ids, self.first = np.concatenate((self.ids, ids)), np.concatenate((self.first, len(self.ids) + first[1:]))
            self.flag = np.concatenate((self.flag, flag))
        at = np.array(at, np.int64)
        return at[which]

    def sizes(self, places: np.ndarray) -> np.ndarray:
        return np.diff(self.first)[places]

    def tokens(self, places: np.ndarray) -> np.ndarray:
        return self.ids[_ragged(self.first[places], self.sizes(places))]


class Encoder:
    """Tokens of batches of texts; one for each task."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.classes, self.memo = vocab, Classes(vocab.splitter), Memo(self._make)

    def _make(self, data, starts, ends):
        symbols = self.vocab.byte_ids[data[_ragged(starts, ends - starts)]]
        if (symbols < 0).any():
            raise ValueError("the vocabulary lacks a byte that a text holds")
        return *merged(symbols, np.concatenate(([0], np.cumsum(ends - starts))), self.vocab), np.ones(len(starts), bool)

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Number of tokens of each text data[offs[d]:offs[d + 1]]; a special string inside a text is one token."""
        a, b, _ = special_spans(data, offs, self.vocab.specials)
        cuts = np.concatenate((offs[:-1], a, b))
        starts = pretokens(data, cuts, self.classes)
        ends = np.concatenate((starts[1:], [len(data)])) if len(starts) else starts
        special = np.zeros(len(starts), bool)
        if len(a):  # pre-tokens inside a special string count as nothing, their string as one token
            inside = np.searchsorted(a, starts, side="right") - 1
            special = (inside >= 0) & (starts < b[np.maximum(inside, 0)])
        total = np.concatenate(([0], np.cumsum(self.memo.sizes(self.memo.places(data, starts[~special], ends[~special])))))
        at = np.searchsorted(starts[~special], offs)
        return np.diff(total[at]) + np.diff(np.searchsorted(a, offs))

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Ids of all tokens in order, special strings being plain text; their lengths are ``vocab.lengths[ids]``."""
        starts = pretokens(data, offs[:-1], self.classes)
        return self.memo.tokens(self.memo.places(data, starts, np.concatenate((starts[1:], [len(data)])) if len(starts) else starts))


def count_tokens(docs: DataFrame, vocab: Vocabulary, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens (long), over_limit (n_tokens > ``limit``) of every row of ``docs``.

    Counts are those of the tokenizers library for the vocabulary's file: without begin, end or added special tokens,
    special strings inside a text being one token each, without truncation or padding. A null text is an empty text:
    no bytes, no tokens. Null and repeated ids keep a row each; other columns are ignored; an empty table gives an
    empty result. Texts of any length are counted whole, a step of some MB or one longer text at a time.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def count(batches):
        encoder = Encoder(vocab)
        for rows, data, offs in steps(batches):
            n = encoder.counts(data, offs)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
