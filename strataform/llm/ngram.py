"""Language-model scoring by an n-gram trie of Elias-Fano levels.

Level 1 is the vocabulary: sorted 64-bit word hashes. A node of level k is a pair of a context (a node of level
k - 1) and a word; levels are sorted by context and word, so the words behind a context, counted from the
context's base, make one monotone sequence. Pointers (a second monotone sequence) say where each context's
words begin, and a word is found among them by a successor search from that base. Nodes carry smoothed
probabilities, contexts the weights of their shorter ones, both in 16 bits.

Counts are gathered by a shuffle of sorted, delta-coded blocks, one for each range of contexts, and each range
becomes a file of its level in the shared folder. Scoring tasks map the files; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import Files, held, pack, partitions, prepare, put, work_dir, written
from strataform.llm.elias_fano import EliasFano

ORDER = 3
#: Count below which a node of the highest level is dropped; its mass goes to its context's weight. At 1 all stay.
CUTOFF = 1
DISCOUNT = 0.75
#: Added to each count of a word.
ADDED = 0.1
#: Codes of probabilities: steps of 20 / 65535 in the decimal logarithm.
STEP = 20 / 65535
#: Stands behind the words of a text. White space is never in a word.
END = "\n"
#: Distinct words whose ids a task keeps.
TABLE = 1_500_000
#: N-grams counted at a time by a task.
HELD = 1_000_000
#: Bytes of text handled at a time.
TEXT = 4 << 20
#: Pairs of a context and a word are sorted as one number while all of a level are below this, and as two beyond.
KEYS = 1 << 63


def word_hashes(words: list) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 65535).astype("<u2")


def _value(code: np.ndarray) -> np.ndarray:
    return code.astype(np.float64) * -STEP


def _pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences, bytes of a rank together, which the shuffle's compression takes well."""
    deltas = np.diff(keys, prepend=np.uint64(0))
    return len(keys).to_bytes(8, "little") + deltas.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack_counts(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(block, np.uint8, offset=8)
    deltas = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(deltas), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def _summed(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*blocks, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Level:
    """Where the pieces of a level are: their numbers of nodes, in order, over equal ranges of contexts (level 1: of hashes)."""

    def __init__(self, sizes: list[int], contexts: int):
        self.sizes, self.contexts = sizes, contexts
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        pieces = len(sizes)
        self.bounds = np.array([-(-contexts * j // pieces) for j in range(pieces + 1)], np.int64)

    def piece(self, contexts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, contexts, "right") - 1


class Piece:
    """A range of contexts of a level. Its keys count from the range's begin."""

    def __init__(self, parts: dict):
        self.keys = EliasFano(parts, "key_")
        self.code = parts["code"]
        self.count = parts.get("count")
        if "weight" in parts:
            self.pointers, self.weight = EliasFano(parts, "ptr_"), parts["weight"]


class Trie:
    """The model as files; ``levels`` from 1 on, ``total`` tokens."""

    def __init__(self, folder: str, levels: tuple[Level, ...], total: int):
        self.folder, self.levels, self.total = folder, levels, total
        self.words = int(levels[0].starts[-1]) if levels else 0
        self.files = Files(Piece)
        #: Sorted hashes of words asked for, their ids, and their base logarithms.
        self.table = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        self.unit = self.words + 1  # of a context's range; its last place is the unknown word's and stays free
        self.unknown = float(np.log10(ADDED / (total + ADDED * (self.words + 1))))

    def _piece(self, level: int, j: int) -> Piece:
        return self.files.open(f"{self.folder}/level-{level}-{j:06d}")

    def _pieces(self, level: int, of: np.ndarray):
        """Slices of sorted piece numbers."""
        edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])) if len(of) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            j = int(of[a])
            if self.levels[level - 1].sizes[j]:
                yield j, slice(a, b)

    def vocabulary(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted hashes, -1 for unknown ones."""
        level = self.levels[0]
        out = np.full(len(hashes), -1, np.int64)
        of = level.piece((hashes >> np.uint64(32)).astype(np.int64))
        for j, at in self._pieces(1, of):
            found = self._piece(1, j).keys.find(hashes[at] - np.uint64(int(level.bounds[j]) << 32))
            out[at] = np.where(found >= 0, found + level.starts[j], -1)
        return out

    def find(self, k: int, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Nodes of level k, -1 where there is none or an argument is -1."""
        out = np.full(len(contexts), -1, np.int64)
        known = np.flatnonzero((contexts >= 0) & (words >= 0))
        out[known] = self._search(k, contexts[known], words[known], False)[0]
        return out

    def _search(self, k: int, contexts: np.ndarray, words: np.ndarray, full: bool = True) -> tuple[np.ndarray, ...]:
        """Nodes of level k, -1 where there is none. If in full also their logarithms; what each context leaves to
        shorter ones; and whether words stand behind a node at the next level."""
        level = self.levels[k - 1]
        if level.contexts * self.unit < KEYS:
            keys, back = np.unique(contexts * self.unit + words, return_inverse=True)
            asked, inside = keys // self.unit, lambda at, lo: keys[at] - lo * self.unit
        else:
            asked, own, back = _distinct_pairs(contexts, words)
            inside = lambda at, lo: (asked[at] - lo) * self.unit + own[at]
        nodes, log10, weight = np.full(len(asked), -1, np.int64), np.zeros(len(asked)), np.zeros(len(asked))
        for j, at in self._pieces(k, level.piece(asked)):
            p, lo = self._piece(k, j), int(level.bounds[j])
            left = p.weight[asked[at] - lo]
            some = np.flatnonzero(left)  # contexts without words end here
            found = p.keys.find(inside(at, lo)[some].astype(np.uint64))
            hit = found >= 0
            nodes[some[hit] + at.start] = found[hit] + level.starts[j]
            if full:
                weight[at] = _value(left)
                log10[some[hit] + at.start] = _value(p.code[found[hit]])
        if not full:
            return (nodes[back],)
        more = np.zeros(len(asked), bool)
        if k < len(self.levels):
            seen = np.flatnonzero(nodes >= 0)  # nodes rise with their keys
            upper, ranked = self.levels[k], nodes[nodes >= 0]
            for j, at in self._pieces(k + 1, upper.piece(ranked)):
                more[seen[at]] = self._piece(k + 1, j).weight[ranked[at] - upper.bounds[j]] > 0
        return nodes[back], log10[back], weight[back], more[back]

    def successors(self, k: int, context: int) -> tuple[np.ndarray, np.ndarray]:
        """The words behind a context of k - 1 words, and their logarithms, by the context's pointers."""
        level = self.levels[k - 1]
        j = int(level.piece(np.array([context]))[0])
        if not level.sizes[j]:
            return np.zeros(0, np.int64), np.zeros(0)
        p, lo = self._piece(k, j), int(level.bounds[j])
        begin, end = p.pointers.get(np.array([context - lo, context - lo + 1])).astype(np.int64)
        at = np.arange(begin, end)
        return p.keys.get(at).astype(np.int64) - (context - lo) * self.unit, _value(p.code[at])

    def _at(self, k: int, nodes: np.ndarray, read, kind=np.float64) -> np.ndarray:
        """``read(piece, positions)`` of nodes, none of them -1."""
        level = self.levels[k - 1]
        order = np.argsort(nodes, kind="stable")
        ranked = nodes[order]
        got = np.zeros(len(nodes), kind)
        for j, at in self._pieces(k, np.searchsorted(level.starts, ranked, "right") - 1):
            got[at] = read(self._piece(k, j), ranked[at] - level.starts[j], j)
        out = np.empty_like(got)
        out[order] = got
        return out

    def counts(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        known = words >= 0
        out[known] = self._at(1, words[known], lambda p, i, j: p.count[i], np.int64)
        return out

    def base(self, words: np.ndarray) -> np.ndarray:
        return np.log10((self.counts(words) + ADDED) / (self.total + ADDED * (self.words + 1)))

    def _suffix(self, k: int, nodes: np.ndarray) -> np.ndarray:
        """Nodes of level k without their first word, at level k - 1."""
        level = self.levels[k - 1]
        context, word = np.divmod(self._at(k, nodes, lambda p, i, j: p.keys.get(i).astype(np.int64), np.int64), self.unit)
        context += level.bounds[np.searchsorted(level.starts, nodes, "right") - 1]
        return word if k == 2 else self.find(k - 1, self._suffix(k - 1, context), word)

    def log10(self, k: int, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of known words behind contexts of k - 1 words, all of them nodes."""
        if k == 1:
            return self.base(words)
        nodes, out, weight, _ = self._search(k, contexts, words)
        rest = nodes < 0
        if rest.any():
            shorter = self._suffix(k - 1, contexts[rest]) if k > 2 else contexts[rest]
            out[rest] = weight[rest] + self.log10(k - 1, shorter, words[rest])
        return out

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all tokens (-1: unknown), their base logarithms, and the number of each text's tokens.

        Words asked for once keep their place in a table of bounded size, which starts anew when full.
        """
        place, words, sizes = words_of(texts)
        raw = word_hashes(words)
        order = np.argsort(raw)
        raw = raw[order]
        known, ids, bases = self.table
        at = np.minimum(np.searchsorted(known, raw), max(0, len(known) - 1))
        fresh = raw[known[at] != raw] if len(known) else raw
        if len(fresh):
            if len(known) > TABLE:
                known, ids, bases, fresh = known[:0], ids[:0], bases[:0], raw
            found = self.vocabulary(fresh)
            into = np.searchsorted(known, fresh)
            self.table = known, ids, bases = np.insert(known, into, fresh), np.insert(ids, into, found), np.insert(bases, into, self.base(found))
            at = np.searchsorted(known, raw)
        spot = np.empty(len(order), np.int64)
        spot[order] = at
        spot = spot[place]
        return ids[spot], bases[spot], sizes

    def walk(self, ids: np.ndarray, first: np.ndarray, upto: int) -> list[np.ndarray]:
        """For each token its node at levels 1 to ``upto``, -1 where its context or itself is unknown or a text begins."""
        nodes = [ids]
        for k in range(2, upto + 1):
            nodes.append(self.find(k, _before(nodes[-1], first), ids))
        return nodes

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, base score and score of each text."""
        ids, base, sizes = self.tokens(texts)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        known, log10 = ids >= 0, base.copy()
        words, nodes = np.where(known, ids, self.words), ids
        for k in range(2, len(self.levels) + 1):
            contexts = _before(nodes, first)
            some = np.flatnonzero(contexts >= 0)
            found, full, weight, more = self._search(k, contexts[some], words[some])
            nodes = np.full(len(ids), -1, np.int64)
            nodes[some] = np.where(more, found, -1)  # a node without words behind it changes nothing further up
            log10[some] = np.where(found >= 0, full, log10[some] + weight)
        return sizes, np.add.reduceat(known.astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(log10, first)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and the place of each pair among them."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    first = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(first) - 1
    return x[first], y[first], back


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Tokens as places in a list of distinct words, the list, and the number of each text's tokens.

    Texts are lower-cased from A to Z, split at the bytes 9 to 13 and 32, and followed by the end each.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, edges = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    edges -= edges[0] if len(edges) else 0
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # blanks at the ends make empty ones
    before = np.concatenate([[0], np.cumsum(real)])
    counts = before[edges[1:]] - before[edges[:-1]]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    words = coded.dictionary.to_pylist()
    place = np.full(int(counts.sum()) + len(counts), len(words), np.int64)
    place[np.arange(len(coded)) + np.repeat(np.arange(len(counts)), counts)] = coded.indices.to_numpy()
    return place, [*words, END], counts + 1


def _before(nodes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The node before each token's, -1 where a text begins."""
    out = np.concatenate([[-1], nodes[:-1]])
    out[first] = -1
    return out


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, batch.num_rows * TEXT // max(1, batch.column(at).nbytes)) if batch.num_rows else 1
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def _count(texts: DataFrame, folder: str, trie: Trie, k: int, pieces: int, cutoff: int) -> Level:
    """Counts the n-grams of level k and writes its pieces."""
    contexts = 1 << 32 if k == 1 else int(trie.levels[-1].starts[-1])
    bounds = Level([0] * pieces, contexts).bounds
    unit = 1 << 32 if k == 1 else trie.unit
    wide = k > 1 and contexts * unit >= KEYS
    edges = np.array([min(int(b) * unit, (1 << 64) - 1) for b in bounds[1:-1]], np.uint64)
    if max((int(b - a) for a, b in zip(bounds, bounds[1:], strict=False)), default=0) * unit >= 1 << 63 and k > 1:
        raise ValueError(f"level {k}: a piece's keys have more than 63 bits; it takes more shuffle partitions")

    below, total = trie.levels, trie.total

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _opened(folder, total, below)
        held, size = [], 0
        by_piece: dict[int, list] = {}  # of wide keys

        def blocks():
            if wide:
                rows = [(j, _pack_counts(*_summed(parts))) for j, parts in sorted(by_piece.items())]
                by_piece.clear()
            else:
                keys, counts = _summed(held)
                held.clear()
                cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                rows = [(j, _pack_counts(keys[a:b] - np.uint64(int(bounds[j]) * unit), counts[a:b])) for j, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            return pa.RecordBatch.from_arrays([pa.array([j for j, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["piece", "block"])

        for part in _texts(batches, 0):
            if k == 1:
                place, words, _ = words_of(part.column(0))
                held.append((word_hashes(words), np.bincount(place, minlength=len(words))))
            else:
                ids, _, sizes = trie.tokens(part.column(0))
                first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                before = _before(trie.walk(ids, first, k - 1)[-1], first)
                some = (before >= 0) & (ids >= 0)
                if wide:
                    context, word, back = _distinct_pairs(before[some], ids[some])
                    counts, of = np.bincount(back, minlength=len(context)), np.searchsorted(bounds, context, "right") - 1
                    cuts = np.flatnonzero(np.diff(of, prepend=-1, append=pieces))
                    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                        keys = (context[a:b] - bounds[of[a]]) * unit + word[a:b]
                        by_piece.setdefault(int(of[a]), []).append((keys.astype(np.uint64), counts[a:b]))
                    size += len(context)
                else:
                    held.append(np.unique((before[some] * trie.unit + ids[some]).astype(np.uint64), return_counts=True))
            size += len(held[-1][0]) if held and not wide else 0
            if size >= HELD:
                yield blocks()
                size = 0
        if size:
            yield blocks()

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _opened(folder, total, below)
        held, waiting, j = [], 0, -1
        for batch in batches:
            for number, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                j = number
                held.append(_unpack_counts(block.as_py()))
                waiting += len(held[-1][0])
                if waiting > 2 * len(held[0][0]) + HELD:
                    held, waiting = [_summed(held)], 0
        if not held:
            return
        keys, counts = _summed(held)
        lo, hi = int(bounds[j]), int(bounds[j + 1])
        if k == 1:
            parts = {"count": counts.astype("<i8"), "code": np.zeros(0, "<u2")}
        else:
            keys, parts = _smooth(trie, k, keys, counts, lo, hi, cutoff)
        parts |= EliasFano.build(keys, (hi - lo) * unit, "key_")
        put(f"{folder}/level-{k}-{j:06d}", [pack(parts)])
        yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], ["piece", "nodes", "tokens"])

    built = texts.mapInArrow(gather, "piece int, block binary").repartitionById(pieces, "piece").mapInArrow(build, "piece int, nodes long, tokens long")
    sizes = [0] * pieces
    tokens = 0
    for r in written(built, f"level-{k}").collect():  # one row for each piece
        sizes[r.piece] = r.nodes
        tokens += r.tokens
    level = Level(sizes, contexts)
    level.tokens = tokens
    return level


def _smooth(trie: Trie, k: int, keys: np.ndarray, counts: np.ndarray, lo: int, hi: int, cutoff: int) -> tuple[np.ndarray, dict]:
    """Discounted probabilities of the kept nodes of contexts lo to hi, and what each context leaves."""
    context, word = np.divmod(keys.astype(np.int64), trie.unit)
    context += lo
    total = np.bincount(context - lo, counts, hi - lo)
    keep = counts >= cutoff
    keys, context, word, counts = keys[keep], context[keep], word[keep], counts[keep]
    own = (counts - DISCOUNT) / total[context - lo]
    left = 1 - np.bincount(context - lo, own, hi - lo)
    shorter = trie._suffix(k - 1, context) if k > 2 else context
    below = 10 ** trie.log10(k - 1, shorter, word)
    number = np.bincount(context - lo, minlength=hi - lo)
    pointers = np.concatenate([[0], np.cumsum(number)])
    weight = np.where(number > 0, np.maximum(_code(np.log10(np.where(number > 0, left, 1))), 1), 0).astype("<u2")  # 0: no words
    parts = {"code": _code(np.log10(own + left[context - lo] * below)), "weight": weight}
    return keys, parts | EliasFano.build(pointers, len(keys) + 1, "ptr_")


def held_out(id_col: str = "doc_id"):
    """A null identifier counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10, F.lit(0)) == 0


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, cutoff: int = CUTOFF) -> Trie:
    """A model of all rows that aren't held out. Null texts count as empty and have the end as their only token."""
    spark = df.sparkSession
    prepare(spark)
    texts = df.where(~held_out(id_col)).select(F.col(text_col).alias("text"))
    folder, pieces = work_dir(spark, "ngrams"), partitions(spark)
    trie = Trie(folder, (), 0)
    for k in range(1, order + 1):
        level = _count(texts, folder, trie, k, pieces, cutoff if k == order and k > 2 else 1)
        trie = Trie(folder, (*trie.levels, level), level.tokens if k == 1 else trie.total)
        if not level.starts[-1]:
            break
    return trie


def score(df: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row; other columns aren't read.

    A null text counts as empty: its one token is the end. Repeated rows score alike.
    """
    prepare(df.sparkSession)
    src = df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    folder, levels, total = trie.folder, trie.levels, trie.total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _opened(folder, total, levels)
        for part in _texts(batches, 2):
            sizes, known, base, full = model.score(part.column(2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), total)), pa.array(base), pa.array(full)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = src.select("doc_id", "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return src.mapInArrow(run, schema)


def _opened(folder: str, total: int, levels: tuple[Level, ...]) -> Trie:
    """One model at a time in a worker, whose pieces stay mapped over tasks."""
    return held(("ngrams", folder, len(levels)), lambda: Trie(folder, levels, total))
