"""Alignment of two tokenizers over a corpus, with link counts in dense vectors behind a minimal perfect hash.

Both tokenizers cut the same bytes (a space and the text); where tokens of both end at one byte they are linked, and the
texts fall into groups. The encoded documents are written once to the shared folder. A first pass aligns them and counts
the links of each id pair within a task. The distinct pairs get a minimal perfect hash (levels of bit arrays: a pair that is
alone at its hash keeps the place, the others go on to the next level); its index is a place in a dense vector of counts.
The tasks' vectors are summed along a tree, slice by slice. A second pass aligns the documents again, looks the
counts up and compares the stored key, so that an unknown pair cannot take another's count.

Linked tokens end at the same byte, so the bytes of one are a suffix of the other's: there are at most as many different pairs as the
vocabularies' tokens have bytes. Keys, hash and vector are bounded by that, whatever the size of the corpus, and the bound is checked.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricefold.llm.common import mixed, steps, stored
from pricefold.llm.rank_merge import Encoder, Memo, Vocabulary, _ragged

META = "▁"
#: Vectors that one node of the tree adds up, and entries of a slice.
FAN_IN = 16
SLICE = 1 << 16
#: Bytes of text that an encoding step holds, and tokens that an alignment step holds.
STEP_BYTES = 1 << 20
STEP_TOKENS = 1 << 18


# ---------------------------------------------------------------- encoding


@dataclass
class Pieces:
    """A sentencepiece model: its file, the bytes of each piece, and whether texts may be cut before each run of spaces."""

    model: bytes
    bytes_of: list[bytes]
    by_words: bool


def pieces(path: str) -> Pieces:
    """Read a sentencepiece model. Where no piece has a space after another character, words can be encoded one by one."""
    import sentencepiece

    with open(path, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    of = [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(META, " ").encode() for i, p in enumerate(names)]
    # Spaces must be kept as they are and one be added, or the words of a text are no texts of their own.
    kept = sp.encode(" a  b ", out_type=str) == sp.encode(" a", out_type=str) + sp.encode(" b", out_type=str) + sp.encode("", out_type=str) + [META]
    return Pieces(model, of, kept and not any(META in p.lstrip(META) for p in names))


class PieceEncoder:
    """Pieces of batches of texts that begin with a space (the one that the model adds); one for each task."""

    def __init__(self, spec: Pieces):
        import sentencepiece

        self.sp, self.spec = sentencepiece.SentencePieceProcessor(model_proto=spec.model), spec
        self.lengths = np.array([len(b) for b in spec.bytes_of], np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.lengths)))
        self.data = np.frombuffer(b"".join(spec.bytes_of), np.uint8)
        self.memo = Memo(self._make)

    def tokens(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, equal): ids[first[d]:first[d + 1]] are a text's pieces; equal: they give back its bytes."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offs), np.int64), np.ones(len(offs) - 1, bool)
        cut = np.zeros(len(data) + 1, bool)
        if self.spec.by_words:
            cut[:-1] = data == 32
            cut[1:-1] &= data[:-1] != 32
        cut[offs] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.concatenate((starts[1:], [len(data)]))
        places = self.memo.places(data, starts, ends)
        wrong = np.concatenate(([0], np.cumsum(~self.memo.flag[places])))
        text = np.searchsorted(starts, offs)
        return self.memo.tokens(places), np.concatenate(([0], np.cumsum(self.memo.sizes(places))))[text], wrong[text[1:]] == wrong[text[:-1]]

    def _make(self, data, starts, ends):
        blob, size = data.tobytes(), ends - starts
        # The model adds the first space itself; a space alone (the last of a text) would be an empty text.
        encoded = self.sp.encode([blob[a + 1 : b].decode() for a, b in zip(starts.tolist(), ends.tolist())], num_threads=1)
        for i in np.flatnonzero(size == 1):
            encoded[i] = [self.sp.piece_to_id(META)]
        n = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter(itertools.chain.from_iterable(encoded), np.int64, int(n.sum()))
        first = np.concatenate(([0], np.cumsum(n)))
        equal = np.diff(np.concatenate(([0], np.cumsum(self.lengths[ids])))[first]) == size
        same = np.flatnonzero(equal)
        own = ids[_ragged(first[same], n[same])]
        made = self.data[_ragged(self.first[own], self.lengths[own])]
        differ = np.concatenate(([0], np.cumsum(made != data[_ragged(starts[same], size[same])])))
        at = np.concatenate(([0], np.cumsum(size[same])))
        equal[same] = differ[at[1:]] == differ[at[:-1]]
        return ids, first, equal


def _spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a space before each that is not empty."""
    full = np.diff(offs) > 0
    to = offs + np.concatenate(([0], np.cumsum(full)))
    out = np.full(to[-1], 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.cumsum(full), np.diff(offs))] = data
    return out, to


def _width(vocabulary: int) -> type:
    """Type of the ids of a vocabulary of this size in stored cells."""
    return np.uint16 if vocabulary <= 1 << 16 else np.int32


def _cells(ids: np.ndarray, first: np.ndarray, kind: type) -> pa.Array:
    """Binary cells of the ids of each text."""
    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first * np.dtype(kind).itemsize).astype(np.int64)), pa.py_buffer(ids.astype(kind))])
    return cells.cast(pa.binary())


def _values(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The opposite of _cells: (ids, first)."""
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    return np.frombuffer(data.tobytes(), kind).astype(np.int64), (offs - offs[0]) // np.dtype(kind).itemsize


def encoded(docs: DataFrame, a: Vocabulary, b: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a, b): the ids of both tokenizers, as binary cells; empty where the two do not give back the same bytes."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches):
        first_of, second = Encoder(a), PieceEncoder(b)
        for rows, data, offs in steps(batches, most=STEP_BYTES):
            data, offs = _spaced(data, offs)
            left = first_of.tokens(data, offs)
            # A byte-level vocabulary has a token for every byte: its tokens' ends cover the texts.
            left_first = np.searchsorted(np.concatenate(([0], np.cumsum(a.lengths[left]))), offs)
            right, right_first, equal = second.tokens(data, offs)
            cells = [_cells(*_kept(left, left_first, equal), _width(len(a.lengths))), _cells(*_kept(right, right_first, equal), _width(len(b.bytes_of)))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *cells], names=["doc_id", "a", "b"])

    return rows.mapInArrow(encode, f"doc_id {kind}, a binary, b binary")


def _kept(ids: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)
    return ids[np.repeat(keep, n)], np.concatenate(([0], np.cumsum(np.where(keep, n, 0))))


# ---------------------------------------------------------------- alignment


@dataclass
class Aligned:
    """Tokens of some documents, in order, and their links: tokens left[link_a] and right[link_b] end together."""

    rows: pa.RecordBatch
    left: np.ndarray
    left_first: np.ndarray
    right: np.ndarray
    right_first: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return (self.left[self.link_a].astype(np.uint64) << np.uint64(32)) | self.right[self.link_b].astype(np.uint64)


def aligned(batches, length_a: np.ndarray, length_b: np.ndarray):
    """Align encoded documents, about STEP_TOKENS tokens (or one longer document) at a time."""
    for batch in batches:
        at, kinds = 0, (_width(len(length_a)), _width(len(length_b)))
        upto = np.concatenate(([0], np.cumsum(pc.binary_length(batch.column("a")).to_numpy(zero_copy_only=False)))) // np.dtype(kinds[0]).itemsize
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + STEP_TOKENS, side="right")) - 1)
            rows = batch.slice(at, end - at)
            left, left_first = _values(rows.column("a"), kinds[0])
            right, right_first = _values(rows.column("b"), kinds[1])
            ends_a, ends_b = np.cumsum(length_a[left]), np.cumsum(length_b[right])
            place = np.searchsorted(ends_b, ends_a)
            place[place == len(ends_b)] = 0
            link_a = np.flatnonzero(ends_b[place] == ends_a) if len(ends_b) else np.zeros(0, np.int64)
            yield Aligned(rows, left, left_first, right, right_first, link_a, place[link_a])
            at = end


# ---------------------------------------------------------------- counts


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: ``index`` maps them one to one onto 0 .. n - 1.

    Other keys map to some place or -1; compare ``keys[index]``.
    """

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], keys: np.ndarray):
        self.levels, self.keys = levels, keys

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """The hash of distinct keys. A level: its size, its bits, and the places before each word of bits."""
        left, levels, base = keys, [], 0
        while len(left):
            size = max(64, -(-2 * len(left) // 64) * 64)
            at = cls._hash(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            levels.append((size, words, base + ones - np.bitwise_count(words)))
            base += int(ones[-1])
            left = left[~alone[at]]
        out = cls(levels, np.zeros(base, np.uint64))
        out.keys[out._place(keys)] = keys
        return out

    @staticmethod
    def _hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            at = self._hash(keys[todo], level, size)
            word, bit = words[at >> 6], np.uint64(1) << (at & 63).astype(np.uint64)
            hit = (word & bit) != 0
            out[todo[hit]] = ranks[at[hit] >> 6] + np.bitwise_count(word[hit] & (bit[hit] - np.uint64(1)))
            todo = todo[~hit]
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 for keys that are not in the set."""
        out = self._place(keys)
        if len(self.keys):
            out[self.keys[out] != keys] = -1
        return out


def _local_counts(length_a: np.ndarray, length_b: np.ndarray):
    def count(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for step in aligned(batches, length_a, length_b):
            own, n = np.unique(step.keys, return_counts=True)
            keys, place = np.unique(np.concatenate((keys, own)), return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, n)), len(keys)).astype(np.int64)  # exact: far below 2 ** 53
        for at in range(0, len(keys), SLICE):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + SLICE].view(np.int64)), pa.array(counts[at : at + SLICE])], names=["pair", "n"])

    return count


def _filled(table: PerfectHash):
    """Dense vector of a task's local counts, as slices; ``node`` is the task's number."""

    def fill(batches):
        from pyspark import TaskContext

        vector, any_ = np.zeros(len(table.keys), np.int64), False
        for batch in batches:
            any_ |= batch.num_rows > 0
            place = table.index(batch.column("pair").to_numpy().view(np.uint64))
            if (place < 0).any():
                raise ValueError("a pair is missing from the hash")
            np.add.at(vector, place, batch.column("n").to_numpy())
        for k, at in enumerate(range(0, len(vector) if any_ else 0, SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]).cast(pa.int32()), pa.array([k], pa.int32()), pa.array([vector[at : at + SLICE].tobytes()])], names=["node", "slice", "counts"])

    return fill


def _added(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in rows.column("counts"))
    return pa.table({"node": pa.array([key[0].as_py()], pa.int32()), "slice": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()])})


def pair_counts(tokens: DataFrame, length_a: np.ndarray, length_b: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
    """The perfect hash of the corpus's linked id pairs and, at each key's place, how many links hold it."""
    local = stored(tokens.select("a", "b").mapInArrow(_local_counts(length_a, length_b), "pair long, n long"), "pairs")
    distinct = local.select("pair").distinct()
    bound = int(length_a.sum() + length_b.sum())
    found = distinct.limit(bound + 1).toArrow().column("pair").to_numpy()
    if len(found) > bound:
        raise ValueError("more linked pairs than tokens that are suffixes of others: the lengths do not fit the vocabularies")
    table = PerfectHash.of(np.sort(found).view(np.uint64))
    if not len(table.keys):
        return table, np.zeros(0, np.int64)
    shape = "node int, slice int, counts binary"
    nodes = local.rdd.getNumPartitions()
    vectors = local.mapInArrow(_filled(table), shape)
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        vectors = vectors.withColumn("node", F.expr(f"CAST(node DIV {FAN_IN} AS INT)")).groupBy("node", "slice").applyInArrow(_added, shape)
    slices = sorted(vectors.select("slice", "counts").collect(), key=lambda r: r["slice"])  # one vector of bounded length
    return table, np.concatenate([np.frombuffer(r["counts"], np.int64) for r in slices])


# ---------------------------------------------------------------- results


def _marked(n: int, marks: str) -> list[str]:
    """The decimal numbers below n, each followed by the first mark, then by the second."""
    return [f"{i}{mark}" for mark in marks for i in range(n)]


def _group_texts(x: Aligned, marked: pa.Array, n_a: int, n_b: int) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` of each document: ids of both sides by group. ``marked``: ids with `,` and `|`, then with `,` and `;`."""
    n, m = len(x.left), len(x.right)
    last_a, last_b = np.zeros(n, bool), np.zeros(m, bool)
    last_a[x.link_a], last_b[x.link_b] = True, True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=len(x.link_a) + 1))))
    after_a = np.cumsum(np.bincount(group_a, minlength=len(x.link_a) + 1))
    item = np.empty(n + m, np.int64)
    item[np.arange(n) + before_b[group_a]] = x.left + n_a * last_a
    item[np.arange(m) + after_a[group_b]] = x.right + 2 * n_a + n_b * last_b
    text = marked.take(pa.array(item))
    offs = np.frombuffer(text.buffers()[1], np.int64)[: n + m + 1]
    blob, ends = (text.buffers()[2] or pa.py_buffer(b"")).to_pybytes().decode("ascii"), offs[x.left_first + x.right_first]
    return [blob[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def align(docs: DataFrame, a: Vocabulary, b: Pieces, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups, the groups' ids as text.

    Both tokenizers encode a space and the text, special strings as plain text. Links are pairs of token occurrences whose byte ranges end
    together; they cut the text into groups. An id pair's count is the number of links in all documents that hold
    it; n_best are links whose count is the greatest of their second id (ties included), count_sum adds up the
    links' counts. Null and empty texts, and texts that one of the two does not give back byte by byte (such as
    those holding the piece model's mark of a space), have no tokens: zeros and an empty text. Null and repeated ids
    keep a row each and count each for itself; other columns are ignored; an empty table gives an empty result.
    Texts of any length are aligned whole.
    """
    spark = docs.sparkSession
    length_a, length_b = a.lengths, np.array([len(x) for x in b.bytes_of], np.int64)
    tokens = stored(encoded(docs, a, b, doc_id, text), "tokens")
    table, counts = pair_counts(tokens, length_a, length_b)
    second = (table.keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    highest = np.zeros(len(length_b), np.int64)
    np.maximum.at(highest, second, counts)
    found = spark.sparkContext.broadcast((table.levels, table.keys, counts, counts == highest[second]))  # bounded by the vocabularies
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def look_up(batches):
        levels, keys, n, best = found.value
        hashed = PerfectHash(levels, keys)
        n_a, n_b = len(length_a), len(length_b)
        marked = pa.array(_marked(n_a, ",|") + _marked(n_b, ",;"), pa.large_string())
        for x in aligned(batches, length_a, length_b):
            place = hashed.index(x.keys)
            if (place < 0).any():
                raise ValueError("a pair is missing from the hash")
            links = np.searchsorted(x.link_a, x.left_first)
            sums = lambda v: pa.array(np.diff(np.concatenate(([0], np.cumsum(v, dtype=np.int64)))[links]))  # noqa: B023, E731
            n_links = pa.array(np.diff(links))
            yield pa.RecordBatch.from_arrays(
                [x.rows.column("doc_id"), pa.array(np.diff(x.left_first)), pa.array(np.diff(x.right_first)), n_links, n_links, sums(best[place]), sums(n[place]), pa.array(_group_texts(x, marked, n_a, n_b), pa.string())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
            )

    return tokens.mapInArrow(look_up, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
