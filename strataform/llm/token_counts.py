"""Token counts without ids: pieces are counted once for each distinct pre-token, and joined to frequencies.

In the vocabularies this is made for no piece has a word mark behind another character, so merges never
cross from a character to a following mark and a text's count is the sum over its pre-tokens, runs of
marks with the characters behind them. Whether that holds is checked when a model is loaded.

The distinct pre-tokens of the corpus are gathered by one shuffle, after those of a task, and each is given to
the model once. What it says goes to the shared folder: for each shard the pre-tokens' 128-bit hashes in order,
and their counts. The texts' frequencies are joined to these files where the texts are, by a search for each
distinct pre-token of a slice; rows of (document, pre-token, frequency), more bytes than the corpus has, stay in
the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import Files, held, pack, partitions, prepare, put, work_dir

MARK = "▁"
#: Bytes of text handled at a time, and distinct pre-tokens and their bytes that a task holds.
TEXT, DISTINCT, BYTES = 4 << 20, 300_000, 32 << 20
#: What a model must leave as it is, but for marks in place of spaces.
PROBES = ("a", " a", "a  b", "a ", "  ", "A\tb\r\nc", "\ufb01 \u00e9\u0301 \uff21", "\x1c x")


class PieceCounter:
    """Counts pieces of pre-tokens, which are given without their first mark: the model puts one in front itself."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError(f"{model_file}: pieces cross word marks")
        for x in PROBES:
            if self.model.normalize(x) != MARK + x.replace(" ", MARK) or sum(map(self.count, re.findall(f"{MARK}({MARK}*[^{MARK}]*)", MARK + x.replace(" ", MARK)))) != len(self.model.encode(x)):
                raise ValueError(f"{model_file}: texts are normalised, or aren't the sum of their pre-tokens")

    def count(self, pre_token: str) -> int:
        return len(self.model.encode(pre_token)) if pre_token else 1  # a mark alone


def pre_tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, without their first marks, and for all in order which it is and whose text's."""
    spaced = pc.replace_substring(texts, MARK, " ")
    lists = pc.split_pattern(spaced, " ")
    flat, edges = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    edges -= edges[0] if len(edges) else 0
    text = np.repeat(np.arange(len(lists)), np.diff(edges))
    filled = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    at = np.arange(len(flat))
    last = np.zeros(len(flat), bool)
    last[edges[1:] - 1] = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)  # an empty text has none
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(filled, at, -1))[:-1]]) if len(flat) else at
    marks = at - np.maximum(before, edges[:-1][text] - 1)
    usual, rest = filled & (marks == 1), np.flatnonzero((filled & (marks > 1)) | (last & ~filled))
    coded = flat.filter(pa.array(usual)).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    other: dict[str, int] = {}
    which = np.full(len(flat), -1, np.int64)
    which[usual] = coded.indices.to_numpy()
    for i, m, word in zip(rest.tolist(), marks[rest].tolist(), flat.take(pa.array(rest)).to_pylist(), strict=True):
        which[i] = other.setdefault(MARK * (m - 1) + word, len(distinct) + len(other))
    real = which >= 0
    return distinct + list(other), which[real], text[real]


def _hashes(words: list[str]) -> np.ndarray:
    """128 bits of each, as two columns."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in words), ">u8").reshape(-1, 2).astype(np.uint64)


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes[:, 0] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


class PieceCounts:
    """The counts of the corpus's pre-tokens, from their files."""

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards, self.files = folder, shards, Files()

    def find(self, words: list[str]) -> np.ndarray:
        hashes = _hashes(words)
        order = np.argsort(hashes[:, 0], kind="stable")
        hashes = hashes[order]
        shard, out = _shard(hashes, self.shards), np.zeros(len(words), np.int64)
        edges = np.flatnonzero(np.diff(shard, prepend=-1, append=self.shards))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            parts = self.files.open(f"{self.folder}/counts-{shard[a]:06d}")
            high, low = parts["high"], parts["low"]
            at = np.searchsorted(high, hashes[a:b, 0])
            while (wrong := np.flatnonzero(low[at] != hashes[a:b, 1])).size:  # alike in their first 64 bits
                at[wrong] += 1
                if (high[at[wrong]] != hashes[a:b, 0][wrong]).any():
                    raise KeyError("a pre-token that wasn't counted")
            out[order[a:b]] = parts["count"][at]
        return out


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * TEXT // max(1, batch.column(at).nbytes)) if batch.num_rows else 1
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def count_pieces(df: DataFrame, model_file: str, text_col: str = "text") -> tuple[str, int]:
    """Counts each distinct pre-token of the texts once. Returns the folder of the counts and its number of shards."""
    spark = df.sparkSession
    prepare(spark)
    folder, shards = work_dir(spark, "piece-counts"), partitions(spark)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.array([], pa.string())

        def rows(words: pa.Array):
            shard = _shard(_hashes(words.to_pylist()), shards) if len(words) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), words], ["shard", "pre_token"])

        for part in _slices(batches, 0):
            words = pa.array(pre_tokens(pc.fill_null(part.column(0), ""))[0], pa.string())
            seen = pc.unique(pa.concat_arrays([seen, words]))
            if len(seen) > DISTINCT or seen.nbytes > BYTES:
                yield rows(seen)
                seen = seen[:0]
        yield rows(seen)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, hashes, counts, shard = counter(model_file), [], [], None
        for batch in batches:
            if batch.num_rows:
                words, shard = batch.column(1).to_pylist(), batch.column(0)[0].as_py()
                hashes.append(_hashes(words))
                counts.append(np.fromiter(map(model.count, words), np.int64, len(words)))
        if shard is not None:
            hashes, counts = np.concatenate(hashes), np.concatenate(counts)
            order = np.lexsort((hashes[:, 1], hashes[:, 0]))
            put(f"{folder}/counts-{shard:06d}", [pack({"high": hashes[order, 0], "low": hashes[order, 1], "count": counts[order].astype("<u4")})])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(counts)], pa.int64())], ["shard", "n"])

    found = df.select(F.col(text_col).alias("text")).mapInArrow(distinct, "shard int, pre_token string")
    once = found.repartitionById(shards, "shard").groupBy("shard", "pre_token").agg(F.lit(1).alias("one")).select("shard", "pre_token")
    once.mapInArrow(count, "shard int, n long").collect()  # one row for each shard
    return folder, shards


def counter(model_file: str) -> PieceCounter:
    return held(("pieces", model_file), lambda: PieceCounter(model_file))


def count_tokens(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row: a null text counts as empty, repeated rows stay.

    An empty text has no tokens. Columns of ``df`` beside identifier and text are not read.
    """
    folder, shards = count_pieces(df, model_file, text_col)
    src = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held(("piece counts", folder), lambda: PieceCounts(folder, shards))
        for part in _slices(batches, 1):
            texts = pc.fill_null(part.column(1), "")
            words, which, text = pre_tokens(texts)
            pairs, frequency = np.unique(text * max(1, len(words)) + which, return_counts=True)
            text, which = np.divmod(pairs, max(1, len(words)))
            tokens = np.zeros(len(texts), np.int64)
            if len(words):
                np.add.at(tokens, text, frequency * table.find(words)[which])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return src.mapInArrow(run, src.select("doc_id").schema.add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean"))
