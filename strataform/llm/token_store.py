"""Token ids in binary shards with a minimal perfect hash index.

``shard-N.bin`` holds raw ids, documents in ascending identifier, shards by ascending range. ``shard-N.idx``
maps a key to a slot without storing keys for it: levels of bit arrays, where a key sits at the first level
at which it is alone, and its slot is the number of bits before. Each slot has a fingerprint, which tells
most foreign keys, and the document's place in the payload. A lookup takes constant time.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.llm.common import Memo, get, held, pack, partitions, prepare, put, unpack, written

#: Bits of a level for each of its keys.
GAMMA = 2
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Letters with ASCII punctuation behind them (no apostrophe): a tokenizer that splits there has fewer distinct words.
_TAILED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)").fullmatch
#: Bytes of text handled at a time.
TEXT = 4 << 20


class WordIds:
    """Ids of texts by a tokenizer that drops white space and never joins over it, as packed bytes.

    The library encodes each distinct word once for a memo's life; texts are words looked up.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spaced = [self._encode(x) for x in ("a b", "a", "b", "\n a\t b ")]
        if not spaced[0] == spaced[1] + spaced[2] == spaced[3]:
            raise ValueError(f"{tokenizer_file}: white space counts, so words can't be encoded alone")
        probes = [word + mark for word in ("a", "the", "Übung", "qzx") for mark in [*string.punctuation.replace("'", ""), "...", "),", '."', "?!"]]
        self.tailed = all(self._encode(x) == self._encode(m[1]) + self._encode(m[2]) for x in probes for m in [_TAILED(x)])
        self.memo = Memo(self.encode_word, size=500_000)
        self.bits = Memo(self._encode, size=500_000)

    def _encode(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.dtype).tobytes()

    def encode_word(self, word: str) -> bytes:
        if self.tailed and (m := _TAILED(word)):
            return self.bits[m[1]] + self.bits[m[2]]
        return self.bits[word]

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Of each text, null counting as empty. Distinct words are encoded, and taken by their places."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat, edges = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
        real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # blanks at the ends make empty ones
        edges = np.concatenate([[0], np.cumsum(real)])[edges - edges[0]]
        coded = flat.filter(pa.array(real)).dictionary_encode()
        ids = pa.array(list(map(self.memo.__getitem__, coded.dictionary.to_pylist())), pa.large_binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(ids) + 1, 8 * ids.offset) if len(ids) else np.zeros(1, np.int64)
        for a, b in zip(offsets[edges[:-1]].tolist(), offsets[edges[1:]].tolist(), strict=True):
            yield data[a:b].to_pybytes() if b > a else b""


def word_ids(tokenizer_file: str) -> WordIds:
    return held(("words", tokenizer_file), lambda: WordIds(tokenizer_file))


def _hash(ids: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for step in (nth.astype(np.uint64), np.uint64(0)):
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        x = (x ^ (x >> np.uint64(31))) + step * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash of distinct pairs (identifier, occurrence), built and asked in whole arrays."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, before: np.ndarray):
        self.words, self.sizes, self.before = words, sizes, before
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, ids: np.ndarray, nth: np.ndarray) -> PerfectHash:
        rows, levels, sizes = np.arange(len(ids)), [], []
        while len(rows):
            size = -(-len(rows) * GAMMA // 64) * 64
            at = (_hash(ids[rows], nth[rows], len(sizes) + 1) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            rows = rows[~alone[at]]
        words = np.concatenate(levels).view("<u8") if levels else np.zeros(0, "<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype("<i8")
        return cls(words, np.array(sizes, "<i8"), before)

    def slots(self, ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """-1 for keys that end up nowhere; other foreign keys get some slot, which the fingerprint tells."""
        out, rows = np.full(len(ids), -1, np.int64), np.arange(len(ids))
        for level, size in enumerate(self.sizes):
            at = (_hash(ids[rows], nth[rows], level + 1) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rows[here]] = (self.before[at >> 6] + below)[here]
            rows = rows[~here]
            if not len(rows):
                break
        return out


def _fingerprints(ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    return (_hash(ids, nth, 0) >> np.uint64(32)).astype("<u4")


class Shard:
    """One shard, opened. The payload is mapped, not read."""

    def __init__(self, folder: str, number: int):
        index = unpack(get(f"{folder}/shard-{number:06d}.idx"))
        self.ids, self.nth, self.null = index["ids"], index["nth"], index["null"]
        self.prints, self.starts, self.counts = index["prints"], index["starts"], index["counts"]
        self.hash = PerfectHash(index["words"], index["sizes"], index["before"])
        self.payload = get(f"{folder}/shard-{number:06d}.bin").view(f"<u{index['width'][0]}")

    def places(self, ids: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each key's ids in the payload; the start is -1 for keys that aren't here."""
        slots = self.hash.slots(ids, nth)
        hit = slots >= 0
        hit[hit] = self.prints[slots[hit]] == _fingerprints(ids[hit], nth[hit])
        starts, counts = np.full(len(ids), -1, np.int64), np.zeros(len(ids), np.int64)
        starts[hit], counts[hit] = self.starts[slots[hit]], self.counts[slots[hit]]
        return starts, counts


@lru_cache(maxsize=64)
def shard(folder: str, number: int) -> Shard:
    return Shard(folder, number)


def write(df: DataFrame, folder: str, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents to ``folder`` and returns ``shard, n_docs, n_tokens``, one row for each shard.

    A null or empty text has the end id alone. Null identifiers come first. Rows with the same identifier are
    told apart by their occurrence, in the order of their ids. An empty table makes no shard. Other columns
    aren't read. Ranges of identifiers come from quantiles of that column alone, so texts are read once and
    ids, not texts, are shuffled.
    """
    spark = df.sparkSession
    prepare(spark)
    n = partitions(spark)
    keys = df.select(F.col(id_col).cast("long").alias("doc_id"))
    bounds = np.array(sorted(set(keys.approxQuantile("doc_id", [i / n for i in range(1, n)], max(1e-5, 1 / (8 * n))))) if n > 1 else [], np.int64)
    put(f"{folder}/store.json", [json.dumps({"bounds": bounds.tolist(), "end_id": end_id}).encode()])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_file)
        end = np.array([end_id], words.dtype).tobytes()
        for batch in batches:
            step = max(1, batch.num_rows * TEXT // max(1, batch.column(1).nbytes)) if batch.num_rows else 1
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                ids = part.column(0)
                at = np.searchsorted(bounds, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
                raw = pa.array([x + end for x in words.encode(part.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), ids, raw], ["shard", "doc_id", "raw"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, ids, nulls, sizes, number = word_ids(tokenizer_file).dtype.itemsize, [], [], [], -1

        def payload():
            nonlocal number
            for batch in batches:
                if batch.num_rows:
                    number = batch.column(0)[0].as_py()
                for x in batch.column(2):
                    raw = x.as_py()
                    sizes.append(len(raw) // width)
                    yield raw
                nulls.append(batch.column(1).is_null().to_numpy(zero_copy_only=False))
                ids.append(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False))

        parts = payload()
        first = next(parts, None)
        if first is None:
            return
        number = int(number)
        put(f"{folder}/shard-{number:06d}.bin", _chain(first, parts))
        put(f"{folder}/shard-{number:06d}.idx", [pack(_index(np.concatenate(ids), np.concatenate(nulls), np.array(sizes, np.int64), width))])
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["shard", "n_docs", "n_tokens"])

    encoded = df.select(F.col(id_col).cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(encode, "shard int, doc_id long, raw binary")
    ordered = encoded.repartitionById(n, "shard").sortWithinPartitions(F.asc_nulls_first("doc_id"), "raw")
    return written(ordered.mapInArrow(store, "shard int, n_docs long, n_tokens long"), "token-shards")


def _chain(first, rest):
    yield first
    yield from rest


def _index(ids: np.ndarray, null: np.ndarray, sizes: np.ndarray, width: int) -> dict:
    """Keys in file order, and by slot: fingerprint, start and length."""
    # Null identifiers are a run of their own in front: their occurrences count from -1 down.
    fresh = np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
    row = np.arange(len(ids))
    nth = row - np.maximum.accumulate(np.where(fresh, row, 0))
    nth = np.where(null, -1 - nth, nth).astype("<i8")
    perfect = PerfectHash.build(ids, nth)
    slots = perfect.slots(ids, nth)
    out = {"width": np.array([width], "<i8"), "ids": ids.astype("<i8"), "nth": nth, "null": null.astype("u1")}
    out |= {"words": perfect.words, "sizes": perfect.sizes, "before": perfect.before}
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for name, values in (("prints", _fingerprints(ids, nth)), ("starts", starts.astype("<i8")), ("counts", sizes.astype("<i8"))):
        by_slot = np.empty(len(ids), values.dtype)
        by_slot[slots] = values
        out[name] = by_slot
    return out


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard`` of every document, from the files by their index.

    ``start`` counts the ids of all documents before. The driver holds one number for each shard.
    """
    prepare(spark)
    tokens = {r.shard: r.n_tokens for r in manifest.collect()}
    numbers = sorted(tokens)
    first = dict(zip(numbers, np.concatenate([[0], np.cumsum([tokens[k] for k in numbers])[:-1]]).astype(np.int64).tolist() if numbers else [], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                number = numbers[i]
                s = Shard(folder, number)
                for at in range(0, len(s.ids), 10_000):
                    ids, nth, null = s.ids[at : at + 10_000], s.nth[at : at + 10_000], s.null[at : at + 10_000]
                    starts, counts = s.places(ids, nth)
                    if (starts < 0).any():
                        raise ValueError(f"{folder}: shard {number} lacks keys of its own")
                    crcs = [zlib.crc32(s.payload[a : a + c].astype("<u4").tobytes()) for a, c in zip(starts.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids, pa.int64(), mask=null.astype(bool)), pa.array(starts + first[number]), pa.array(counts), pa.array(crcs, pa.int64()), pa.array(np.full(len(ids), number), pa.int32())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                    )

    return spark.range(0, len(numbers), 1, max(1, len(numbers))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def lookup(keys: DataFrame, folder: str, id_col: str = "doc_id", nth_col: str | None = None) -> DataFrame:
    """``doc_id, ids`` for identifiers asked for, null where the store has none. No shuffle: workers open shards as needed.

    Of rows with one identifier, null ones too, the first is found, in the order of their ids, or the one that
    ``nth_col`` names, from 0 on; then ``nth`` is a column of the result. Other columns aren't read.
    """
    prepare(keys.sparkSession)
    nth = [F.col(nth_col).cast("long").alias("nth")] if nth_col else []
    src = keys.select(F.col(id_col).cast("long").alias("doc_id"), *nth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array(json.loads(get(f"{folder}/store.json").tobytes())["bounds"], np.int64)
        for batch in batches:
            out = []
            asked = batch.column(1).to_pylist() if nth_col else [0] * batch.num_rows
            for x, k in zip(batch.column(0).to_pylist(), asked, strict=True):
                found = None
                if k is not None and k >= 0:
                    try:
                        s = shard(folder, 0 if x is None else int(np.searchsorted(bounds, x, "right")))
                    except FileNotFoundError:
                        s = None
                    if s:
                        key = (0, -1 - k) if x is None else (x, k)
                        (start,), (count,) = s.places(*[np.array([v], np.int64) for v in key])
                        found = s.payload[start : start + count].astype(np.int32) if start >= 0 else None
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return src.mapInArrow(run, f"doc_id long, {'nth long, ' if nth_col else ''}ids array<int>")
