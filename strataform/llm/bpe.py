"""Byte-level BPE by a segment tree.

Leaf i of the tree holds the rank of the pair that starts at byte i, joined with i, so that the root is the
leftmost pair of minimum rank. A merge changes three leaves at most: the merged pair's, that of the token it
swallowed, and its left neighbour's. Each change walks one path to the root, so a piece of n bytes takes
O(n log n), however long it is. Pieces of like length are merged side by side, a step of each at a time, in
whole arrays; long ones one by one.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from strataform.llm.common import held, prepare

NONE = 1 << 62
#: Distinct pieces whose ids a worker keeps; longer ones are not kept.
KEPT, LONGEST = 250_000, 64
#: Leaves of the trees that are worked on side by side, and the fewest trees for which that pays.
LEAVES, FEW = 1 << 17, 16


class Pieces(dict):
    """Numbers of distinct pieces; ``fresh`` are those without ids yet. Those of the others lie in ``flat``."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        number = len(self.sizes) + len(self.fresh)
        self.fresh.append(piece)
        if len(piece) <= LONGEST:
            self[piece] = number
        return number

    def settle(self, encode) -> None:
        flat, starts, sizes = encode([x.encode("utf-8", "surrogatepass") for x in self.fresh])
        self.starts = np.concatenate([self.starts, starts + len(self.flat)])
        self.flat, self.sizes, self.fresh = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes]), []

    @property
    def full(self) -> bool:
        return len(self) > KEPT or len(self.flat) > 16 * KEPT


class ByteBpe:
    """Encodes and decodes by a rank file (lines of base64 token and rank) and a pattern that splits texts."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = pa.array([None] * (1 + max(self.ranks.values(), default=-1)), pa.binary())
        if self.ranks:
            by_rank = {rank: token for token, rank in self.ranks.items()}
            self.tokens = pa.array([by_rank.get(k) for k in range(len(self.tokens))], pa.binary())
        self.split = regex.compile(pattern).findall
        self.pieces = Pieces()
        self.single = np.array([self.ranks.get(bytes([k]), -1) for k in range(256)], np.int64)
        pairs = [(self.ranks[x[:k]] << 32 | self.ranks[x[k:]], rank) for x, rank in self.ranks.items() for k in range(1, len(x)) if x[:k] in self.ranks and x[k:] in self.ranks]
        #: Pairs of tokens that make a token, sorted, and its rank. What stands last is larger than any pair.
        self.pairs, self.merged = np.array([*sorted(pairs), (NONE, 0)], np.int64).T.copy()

    def _pair(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaves of pairs of tokens that start at a byte."""
        key = a << 32 | b
        k = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[k] == key, self.merged[k] << 32 | at, NONE)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of many pieces in one array, and where in it each has how many."""
        starts, sizes = np.zeros(len(pieces), np.int64), np.ones(len(pieces), np.int64)
        by_width: dict[int, list[int]] = {}
        whole, one = [], []
        for i, raw in enumerate(pieces):
            rank = self.ranks.get(raw)
            if rank is None:
                by_width.setdefault(1 << (len(raw) - 1).bit_length(), []).append(i)
            else:
                whole.append(i), one.append(rank)
        parts, size = [np.array(one, np.int64)], len(one)
        starts[whole] = np.arange(len(one))
        for width, some in by_width.items():
            many = len(some) >= FEW and width * FEW <= LEAVES
            step = LEAVES // width if many else 1
            for k in range(0, len(some), step):
                part = some[k : k + step]
                if many:
                    ids, counts = self._side_by_side([pieces[i] for i in part], width)
                else:
                    ids = np.array(self.encode_piece(pieces[part[0]]), np.int64)
                    counts = np.array([len(ids)])
                starts[part], sizes[part] = size + np.cumsum(counts) - counts, counts
                parts.append(ids)
                size += len(ids)
        return np.concatenate(parts).astype(np.int32), starts, sizes

    def _side_by_side(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of at most ``width`` bytes, and how many each has: a tree each, by the steps of ``encode_piece``."""
        rows, column = len(pieces), np.arange(width)
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        live = column < sizes[:, None]
        token = np.zeros((rows, width + 1), np.int64)
        token[:, :width][live] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        if token.min(initial=0) < 0:
            raise ValueError("a byte that no token has")
        tree = np.full((rows, 2 * width), NONE, np.int64)
        paired = column[:-1] < sizes[:, None] - 1
        first, at = np.nonzero(paired)
        tree[:, width:-1][paired] = self._pair(token[first, at], token[first, at + 1], at)
        level = width
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], tree[:, level // 2 : level])
            level //= 2
        after = np.tile(np.arange(1, width + 2), (rows, 1))  # live neighbours by starting byte
        before = np.tile(np.arange(-1, width), (rows, 1))
        token, tree, after, before, living = token.ravel(), tree.ravel(), after.ravel(), before.ravel(), live.ravel()
        run = np.arange(rows)
        while len(run := run[tree[run * (2 * width) + 1] != NONE]):
            flat, root = run * (width + 1), run * (2 * width)
            least = tree[root + 1]
            at = least & 0xFFFFFFFF
            gone = after[flat + at]
            end = after[flat + gone]
            after[flat + at] = end
            before[flat + end] = at  # past the last byte there is a place for it
            token[flat + at] = least >> 32
            living[run * width + gone] = False
            left = before[flat + at]
            has_left = left >= 0
            left = np.where(has_left, left, at)
            right = self._pair(token[flat + at], token[flat + end], at)
            tree[root + width + gone] = NONE
            tree[root + width + at] = np.where(end < sizes[run], right, NONE)
            some = np.flatnonzero(has_left)
            tree[(root + width + left)[some]] = self._pair(token[(flat + left)[some]], token[(flat + at)[some]], left[some])
            paths = [(at + width) >> 1, (gone + width) >> 1, (left + width) >> 1]
            while paths[0][0]:
                for node in paths:
                    tree[root + node] = np.minimum(tree[root + 2 * node], tree[root + 2 * node + 1])
                paths = [node >> 1 for node in paths]
        return token.reshape(rows, width + 1)[:, :width][live], live.sum(1)

    def encode_piece(self, raw: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        ranks = self.ranks
        if raw in ranks:
            return (ranks[raw],)
        n = len(raw)
        width = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            rank = ranks.get(raw[i : i + 2])
            if rank is not None:
                tree[width + i] = rank << 32 | i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # live neighbours by starting byte

        def put(leaf: int, value: int) -> None:
            i = width + leaf
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    break
                tree[i] = least
                i >>= 1

        while tree[1] != NONE:
            at = tree[1] & 0xFFFFFFFF
            gone = after[at]
            end = after[at] = after[gone]
            put(gone, NONE)
            if end < n:
                before[end] = at
                rank = ranks.get(raw[at : after[end]])
                put(at, NONE if rank is None else rank << 32 | at)
            else:
                put(at, NONE)
            left = before[at]
            if left >= 0:
                rank = ranks.get(raw[left:end])
                put(left, NONE if rank is None else rank << 32 | left)
        out, at = [], 0
        while at < n:
            out.append(ranks[raw[at : after[at]]])
            at = after[at]
        return tuple(out)

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text: those of its pieces, copied from where they lie. Null counts as empty."""
        if self.pieces.full:
            self.pieces = Pieces()
        number, split, asked, counts = self.pieces.__getitem__, self.split, array("q"), []
        for text in texts:
            before = len(asked)
            if text:
                asked.extend(map(number, split(text)))
            counts.append(len(asked) - before)
        self.pieces.settle(self.encode_pieces)
        at = np.frombuffer(asked, np.int64) if asked else np.zeros(0, np.int64)
        sizes = self.pieces.sizes[at]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.pieces.flat[np.arange(stops[-1]) + np.repeat(self.pieces.starts[at] - stops[:-1], sizes)]
        edges = stops[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))

    def decode(self, ids: pa.ListArray) -> pa.BinaryArray:
        """The bytes of each array of ids: tokens in a row, cut where arrays end. Null gives null."""
        edges = ids.offsets.to_numpy()
        flat = ids.values.slice(int(edges[0]), int(edges[-1] - edges[0])) if len(ids) else ids.values
        tokens = self.tokens.take(flat)
        if tokens.null_count:
            raise ValueError("an id that no token has")
        bounds = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1, 4 * tokens.offset) if len(tokens) else np.zeros(1, np.int32)
        offsets = pa.py_buffer(np.ascontiguousarray(bounds[edges - edges[0]] if len(ids) else bounds))
        whole = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, tokens.buffers()[2] or pa.py_buffer(b"")])
        return pc.if_else(ids.is_valid(), whole, pa.scalar(None, pa.binary())) if ids.null_count else whole


def codec(rank_file: str, pattern: str) -> ByteBpe:
    """One for each Python worker, which keeps it over tasks."""
    return held(("bpe", rank_file, pattern), lambda: ByteBpe(rank_file, pattern))


def _place(df: DataFrame, column: str, new: str) -> int:
    prepare(df.sparkSession)
    if new in df.columns:
        raise ValueError(f"there is a column {new} already")
    return df.columns.index(column)


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with an array of ids appended. A null text counts as empty, and an empty text has no ids.

    ``ids_col`` can't be a column of ``df`` already. Rows pass through in batches as they come: no shuffle, and
    memory is bounded by a batch and by the memo, whatever the corpus.
    """
    at = _place(df, text_col, ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, bpe.encode(part.column(at).to_pylist())], [*part.schema.names, ids_col])

    schema = StructType([*df.schema.fields, StructField(ids_col, ArrayType(IntegerType()))])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of an array of ids appended, under a name that ``df`` doesn't have; a null array gives null."""
    at = _place(df, ids_col, bytes_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*part.columns, bpe.decode(part.column(at))], [*part.schema.names, bytes_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(bytes_col, BinaryType())]))


def _there_and_back(df: DataFrame, rank_file: str, pattern: str, text_col: str, ids_col: str, bytes_col: str, drop_text: bool) -> DataFrame:
    """What ``encode`` and then ``decode`` append, by one worker for each task: two would hold a codec and a memo each."""
    at = _place(df, text_col, ids_col)
    _place(df, text_col, bytes_col)
    kept = [i for i in range(len(df.columns)) if i != at or not drop_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, at):
                ids = bpe.encode(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), ids, bpe.decode(ids)], [*(part.schema.names[i] for i in kept), ids_col, bytes_col])

    fields = [df.schema.fields[i] for i in kept]
    return df.mapInArrow(run, StructType([*fields, StructField(ids_col, ArrayType(IntegerType())), StructField(bytes_col, BinaryType())]))


def slices(batch: pa.RecordBatch, at: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of its column ``at``, so that what is made of them stays small."""
    if not batch.num_rows:
        return
    step = max(1, batch.num_rows * size // max(1, batch.column(at).nbytes))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, ids_col: str | None = None) -> DataFrame:
    """Digests of an encoding and of its decoding: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    They are those of the columns that ``encode`` and ``decode`` append. ``ids_col`` names a column for the ids
    themselves, behind the digests. With ``carry`` all columns of ``df`` stay in front; clashing names of theirs
    are dropped.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256", *([ids_col] if ids_col else [])]
    text, ids, raw = "text of a round trip", "ids of a round trip", "bytes of a round trip"
    kept = [c for c in df.columns if c not in new] if carry else []
    front = [df[c] for c in kept] if carry else [df[id_col].alias("doc_id")]
    src = df.select(*front, *([] if text_col in kept else [df[text_col].alias(text)]))
    front = [f"`{c}`" for c in src.columns if c != text]
    back = _there_and_back(src, rank_file, pattern, text_col if text_col in kept else text, ids, raw, text_col not in kept)
    digests = [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(raw, 256).alias("decoded_sha256"),
    ]
    return back.select(*front, *digests, *([F.col(ids).alias(ids_col)] if ids_col else []))
