"""Near-duplicate groups by MinHash bands and sequential Bayesian verification.

1. Each text's shingle set becomes a signature. Sets that are equal become one class from the start.
2. Bands of the signature make buckets; how many hashes a band has follows from the threshold. Within a bucket
   all members are paired with one leader, of a few draws, so that a document meets some leaders of its group. A
   leader of many pairs is joined to them in several runs, so no task gets them all.
3. A pair's signatures are compared batch by batch. It is dropped once the posterior probability that its
   similarity reaches the threshold is below the chosen miss probability. Survivors are verified on full sets.
4. Verified links are contracted to components. Where buckets still hold several components, further rounds
   draw other leaders, and in the end members are paired across components. So members of one component cost
   about a pair each, and no pair of different components that shares a bucket goes unseen. A bucket too large
   for that (documents around one passage, say) is dealt into buckets by shared rare shingles first: of two sets
   at the threshold, each one's rarest shingles, a fifth at 0.8, have one in common.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.llm.common import Files, pack, partitions, prepare, put, work_dir, written
from strataform.llm.components import components
from strataform.llm.words import mix, shingle_set

HASHES = 240
BATCH = 40
MISS = 1e-6
#: Probability at most that a pair at the threshold shares no band.
APART = 1e-5
#: Rounds of new leaders before the members of a bucket are paired across components, and draws of a round. Buckets with
#: the same members have the same leader in a draw, so a member of a large group is in a few pairs, not in one for each band.
ROUNDS, LEADERS = 2, 4
#: Members of a block of a bucket.
BLOCK = 1024
#: Pairs whose signatures are compared at a time, and pairs verified at a time.
PAIRS, FEW = 50_000, 2_000
#: Places of the table that says how rare shingles are.
PLACES = 1 << 20
#: Cells of the matrices for exact intersections; sets that need more are intersected one by one.
MATRIX = 1 << 23
#: So many identifiers are broadcast at most to pick texts; beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000

_RANDOM = np.random.default_rng(20240229)
_A = _RANDOM.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, HASHES, np.uint32)
_BAND = _RANDOM.integers(0, 1 << 63, (2, HASHES), np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(maxsize=8)
def band_rows(similarity: float) -> int:
    """Hashes of a band: as many as let a pair at the threshold share a band, but for ``APART``. 6 at 0.8, where a
    pair shares none of the 40 with a probability of 5e-6, and one at 0.9 with 1e-13."""
    fit = [r for r in range(1, HASHES + 1) if HASHES % r == 0 and (1 - similarity**r) ** (HASHES // r) <= APART]
    if not fit:
        raise ValueError(f"a similarity of {similarity} is too low for {HASHES} hashes")
    return max(fit)


def signature(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        block = np.multiply.outer(_A, x[i : i + 2048])
        block += _B[:, None]
        np.minimum(out, block.min(1), out)
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band, its number among what is hashed."""
    return mix((sig * _BAND[0]).reshape(-1, rows).sum(1, dtype=np.uint64) + _BAND[1, : HASHES // rows]).view(np.int64)


@lru_cache(maxsize=8)
def least_matches(similarity: float, miss: float) -> tuple[int, ...]:
    """For each number of compared hashes at the end of a batch, the matches below which a pair is dropped.

    With m of n matches and no prior knowledge, the chance of a similarity of at least t is that of m
    successes at most in n + 1 draws at t. One byte of a hash is compared, which agrees by accident
    once in 256.
    """
    t = similarity + (1 - similarity) / 256
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _sketches(df: DataFrame, id_col: str, text_col: str, words: int, band: int) -> DataFrame:
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sizes, digests, bands, sigs = [], [], [], []
                for text in part.column(1):
                    shingles = shingle_set(text.as_py(), words)
                    sizes.append(len(shingles))
                    if not len(shingles):
                        digests.append(None), bands.append(None), sigs.append(None)
                        continue
                    sig = signature(shingles)
                    digests.append(blake2b(shingles.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(sig, band))
                    sigs.append(sig.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    ["doc_id", "n_shingles", "digest", "bands", "sig"],
                )

    return src.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary")


class _Pass:
    """What the steps over one corpus share."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, words: int, similarity: float):
        prepare(df.sparkSession)
        self.words, self.similarity = words, similarity
        self.percent = round(100 * similarity)
        self.texts_of = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.all = written(_sketches(df, id_col, text_col, words, band_rows(similarity)), "sketches")
        classes = self.all.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
        self.classes = written(classes, "classes")
        own = self.classes.select(F.col("digest").alias("d"), "rep")
        # An identifier with several texts is one node of the graph: its sets share buckets, and one is compared.
        self.banded = self.all.join(own, (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep"))).select("rep", "n_shingles", "bands", "sig")
        self.sets = written(self.banded.select("rep", "n_shingles", "sig").groupBy("rep").agg(F.max_by(F.struct("n_shingles", "sig"), F.struct("n_shingles", "sig")).alias("x")).select("rep", "x.*"), "sets")
        self.comps = self.texts = None

    def buckets(self, rows: DataFrame) -> DataFrame:
        """Of rows ``key, rep`` those whose key has several."""
        several = rows.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("key")
        return written(rows.join(several, "key", "left_semi"), "buckets")

    def beside(self, pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
        """Pairs ``a, b`` of leaders and members, with the row of ``one`` that has their ``a`` and that of ``two`` for ``b``.

        What belongs to members travels, what belongs to a leader is sent to its pairs. Leaders of over
        1 / (4 * partitions) of all pairs, which are few, have their pairs in several runs.
        """
        spark = pairs.sparkSession
        pairs = written(pairs, "pairs")
        least = max(1, pairs.count() // (4 * partitions(spark)))
        counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
        hot = [(r.a, -(-r.n // least)) for r in counted.collect()]  # at most 4 * partitions + 3
        if not hot:
            return pairs.join(two, "b").join(one, "a")
        hot = F.broadcast(spark.createDataFrame(hot, "a long, runs long"))
        pairs = pairs.join(hot, "a", "left").withColumn("run", F.coalesce(F.pmod(F.xxhash64("b"), "runs"), F.lit(0).cast("long"))).drop("runs")
        more = one.join(hot, "a").where("runs > 1").withColumn("run", F.explode(F.sequence(F.lit(1).cast("long"), F.col("runs") - 1))).drop("runs")
        return pairs.join(two, "b").join(one.withColumn("run", F.lit(0).cast("long")).unionByName(more), ["a", "run"])

    def close(self, pairs: DataFrame) -> DataFrame:
        """``a, b, matches``: the pairs of leaders and members that signatures can't rule out, sizes first."""
        p = self.percent
        one, two = (self.sets.select(F.col("rep").alias(k), F.col("n_shingles").alias(f"n{k}"), F.col("sig").alias(f"s{k}")) for k in "ab")
        both = self.beside(pairs, one, two).where(f"100 * least(na, nb) >= {p} * greatest(na, nb)").select("a", "b", "sa", "sb")
        least = least_matches(self.similarity, MISS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, HASHES) for k in (2, 3))
                alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
                for k, need in enumerate(least):
                    at = slice(k * BATCH, (k + 1) * BATCH)
                    matches[alive] += (x[alive, at] == y[alive, at]).sum(1)
                    alive = alive[matches[alive] >= need]
                rows = pa.array(alive)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(matches[alive])], ["a", "b", "matches"])

        return both.mapInArrow(run, "a long, b long, matches long")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """``a, b``: the pairs whose full sets reach the similarity."""
        words, percent = self.words, self.percent
        one, two = (self.texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
        both = self.beside(pairs.select("a", "b"), one, two).select("a", "b", "ta", "tb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, held = None, None
            for batch in batches:
                a, b, ta, tb = (batch.column(k) for k in range(4))
                linked = []
                for i in range(batch.num_rows):
                    if (key := a[i].as_py()) != last:
                        last, held = key, shingle_set(ta[i].as_py(), words)
                    other = shingle_set(tb[i].as_py(), words)
                    same = len(np.intersect1d(held, other, assume_unique=True))
                    linked.append(100 * same >= percent * (len(held) + len(other) - same))
                keep = pa.array(linked, pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

        return both.mapInArrow(run, "a long, b long")

    def pick_texts(self, ids: DataFrame) -> None:
        """Adds the texts of identifiers to those at hand, one for each."""
        if self.texts is not None:
            ids = ids.join(self.texts.select("id"), "id", "left_anti")
        ids = written(ids, "text-ids")
        few = ids.count() <= BROADCAST_IDS
        rows = self.texts_of.join(F.broadcast(ids) if few else ids, "id", "left_semi")
        # An identifier with several texts is one node of the graph; its least text stands for it.
        more = written(rows, "texts")
        if more.count() != more.select("id").distinct().count():
            more = written(more.groupBy("id").agg(F.min("text").alias("text")), "texts")
        self.texts = more if self.texts is None else self.texts.union(more)

    def labelled(self, pairs: DataFrame, *columns: str) -> DataFrame:
        """Components of columns of a table, beside them: ``ca`` for a, and so on. A node without links is its own."""
        for c in columns:
            if self.comps is None:
                pairs = pairs.withColumn(f"c{c}", F.col(c))
            else:
                of = self.comps.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
                pairs = pairs.join(of, c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
        return pairs

    def add(self, links: DataFrame) -> None:
        """Contracts further links."""
        edges = self.labelled(links, "a", "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
        new = components(edges)
        if self.comps is None:
            self.comps = new
            return
        of = new.select(F.col("node").alias("component"), F.col("component").alias("next"))
        moved = self.comps.join(of, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
        self.comps = written(moved.union(new.join(self.comps, "node", "left_anti")), "components")

    def settle(self, close: DataFrame) -> None:
        """Finds the links among close pairs. First one pair for each member, the likeliest; then those that still matter."""
        close = written(close, "close-pairs")
        self.pick_texts(close.select(F.col("a").alias("id")).union(close.select("b")).distinct())
        first = close.groupBy("b").agg(F.max_by("a", F.struct("matches", -F.col("a"))).alias("a"))
        self.add(written(self.verify(first.select("a", "b")), "links"))
        rest = close.join(first.withColumnRenamed("a", "first"), "b").where("a <> first").select("a", "b")
        self.add(written(self.verify(self.labelled(rest, "a", "b").where("ca <> cb")), "links"))

    def run(self) -> None:
        """Rounds of random leaders, then all pairs across components of the buckets that still have several."""
        buckets = self.buckets(self.banded.select("rep", F.explode("bands").alias("key")))
        for turn in range(ROUNDS):
            draw = F.xxhash64(F.pmod("key", F.lit(LEADERS)), "rep", F.lit(turn))
            chosen = buckets.groupBy("key").agg(F.min_by("rep", draw).alias("leader"))
            pairs = buckets.join(chosen, "key").where("rep <> leader").select("rep", "leader")
            pairs = self.labelled(pairs, "rep", "leader").where("crep <> cleader") if turn else pairs
            self.settle(self.close(pairs.select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()))
            sizes = self.labelled(buckets, "rep").groupBy("key", "crep").agg(F.count(F.lit(1)).alias("n"))
            several = written(sizes.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("key", "n"), "open-keys")
            buckets = written(buckets.select("key", "rep").join(several, "key").select("key", "rep", "n"), "open-buckets")
            if buckets.isEmpty():
                return
        large = buckets.where(F.col("n") > BLOCK).select("rep").distinct()
        large = written(large, "large-buckets")
        if not large.isEmpty():
            buckets = written(buckets.where(F.col("n") <= BLOCK).select("key", "rep", "n").unionByName(self.by_rare_shingles(large)), "open-buckets")
        self.add(written(self.across(buckets), "links"))

    def by_rare_shingles(self, ids: DataFrame) -> DataFrame:
        """``key, rep, n``: buckets in which any two of these sets that reach the similarity are together.

        Of two such sets, in one order of all shingles, the first |set| - least(|set|) + 1 of each have one in common,
        where least is what the intersection must have at least. Rare shingles come first in the order; so buckets
        are small, unless sets have nothing but what many have. How rare they are is counted by hash, in a table of
        a fixed size that is sent to all tasks: where two shingles share a place, the order is another, and as good.
        """
        words, percent, spark = self.words, self.percent, ids.sparkSession
        ids = ids.select(F.col("rep").alias("id"))
        self.pick_texts(ids)
        rows = self.texts.join(ids, "id", "left_semi").select("id", "text")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sets = np.zeros(PLACES, np.int64)
            for batch in batches:
                for text in batch.column(1):
                    np.add.at(sets, (shingle_set(text.as_py(), words) % np.uint64(PLACES)).astype(np.int64), 1)
            some = np.flatnonzero(sets)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sets[some])], ["place", "sets"])

        counted = rows.mapInArrow(count, "place long, sets long").groupBy("place").agg(F.sum("sets").alias("sets")).toArrow()
        table = np.zeros(PLACES, np.int64)
        table[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
        often = spark.sparkContext.broadcast(np.minimum(table, (1 << 32) - 1).astype(np.uint32))

        def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = shingle_set(text.as_py(), words)
                    sets = often.value[(found % np.uint64(PLACES)).astype(np.int64)]
                    first = np.lexsort((found, sets))[: len(found) - -(-len(found) * percent // 100) + 1]
                    first = first[sets[first] > 1]  # what one set alone has meets nothing
                    for at in range(0, len(first), PAIRS):
                        part = found[first[at : at + PAIRS]].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), i))], ["key", "rep"])

        kept = written(self.labelled(rows.mapInArrow(rarest, "key long, rep long"), "rep"), "prefixes")
        several = kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("crep").alias("lo"), F.max("crep").alias("hi")).where("lo <> hi").select("key", "n")
        return self.merged(kept.select("key", "rep").join(several, "key").select("key", "rep", "n"))

    def merged(self, buckets: DataFrame) -> DataFrame:
        """These buckets, those of over ``BLOCK / 8`` members that overlap made one where that is fewer pairs.

        The members of a large group share many buckets, and a pair would be compared in each of them.
        """
        least = BLOCK // 8
        buckets = written(buckets, "rare-buckets")
        large = buckets.where(F.col("n") > least)
        of = components(large.join(large.groupBy("key").agg(F.min("rep").alias("a")), "key").select("a", F.col("rep").alias("b")))
        large = large.join(of.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        large = written(large, "large-rare-buckets")
        sums = large.groupBy("component").agg(F.sum(F.col("n").cast("double")).alias("pairs"), F.count_distinct("rep").alias("members"))
        sums = written(sums.where("double(members) * members <= pairs").select("component", "members"), "merged-buckets")
        whole = large.join(sums, "component").select(F.col("component").alias("key"), "rep", F.col("members").alias("n")).distinct()
        rest = large.join(sums, "component", "left_anti").select("key", "rep", "n")
        return buckets.where(F.col("n") <= least).unionByName(rest).unionByName(whole)

    def store_sets(self, ids: DataFrame) -> tuple[str, int]:
        """Writes the shingle sets of identifiers to files of the shared folder, from which any task can fetch one."""
        spark, words = ids.sparkSession, self.words
        folder, files = work_dir(spark, "shingle-sets"), partitions(spark)
        self.pick_texts(ids)
        rows = self.texts.join(ids.select("id"), "id", "left_semi").select("id", "text", F.pmod("id", F.lit(files)).cast("int").alias("file"))

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, file = {}, 0
            for batch in batches:
                for i, text, file in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):  # noqa: B007
                    held[i] = shingle_set(text.as_py(), words)
            if held:
                ids = np.array(sorted(held), np.int64)
                sizes = np.array([len(held[i]) for i in ids.tolist()], np.int64)
                put(f"{folder}/sets-{file:06d}", [pack({"ids": ids, "ends": np.cumsum(sizes), "sets": np.concatenate([held[i] for i in ids.tolist()])})])
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([len(ids)], pa.int64())], ["file", "n"])

        rows.repartitionById(files, "file").mapInArrow(store, "file int, n long").collect()  # one row for each file
        return folder, files

    def across(self, buckets: DataFrame) -> DataFrame:
        """``a, b``: verified links between members of a bucket that are in different components.

        A bucket is dealt into blocks; each pair of blocks is one unit of work, compared in whole arrays. Pairs
        that signatures can't rule out are verified on full sets there and then, the likeliest first, until
        their components are one: what a unit returns is at most a link for each component that it merges.
        """
        percent, least = self.percent, least_matches(self.similarity, MISS)
        folder, files = self.store_sets(written(buckets.select(F.col("rep").alias("id")).distinct(), "open-ids"))
        rows = self.labelled(buckets, "rep").join(self.sets, "rep").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "crep", "n_shingles", "sig")
        units = rows.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, stored = None, SetFiles(folder, files)
            for batch in batches:
                table = pa.Table.from_batches([batch])
                table = pa.concat_tables([held, table]) if held is not None else table
                if not len(table):
                    continue
                keys = [table.column(c).to_numpy() for c in ("key", "i", "j")]
                edges = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
                held = table.slice(int(edges[-1]) if len(edges) else 0)
                for at, end in zip([0, *edges.tolist()], edges.tolist(), strict=False):
                    yield from linked(table.slice(at, end - at), stored)
            if held is not None:
                yield from linked(held, stored)

        def linked(unit: pa.Table, stored: SetFiles) -> Iterator[pa.RecordBatch]:
            own, rep, comp, size = (unit.column(c).to_numpy() for c in ("own", "rep", "crep", "n_shingles"))
            i, j = unit.column("i")[0].as_py(), unit.column("j")[0].as_py()
            one = np.flatnonzero(own == i)
            two = np.flatnonzero(own == j)
            pick = comp[one][:, None] != comp[two][None, :]
            pick &= 100 * np.minimum(size[one][:, None], size[two][None, :]) >= percent * np.maximum(size[one][:, None], size[two][None, :])
            if i == j:
                pick &= rep[one][:, None] < rep[two][None, :]
            x, y = (k[v] for k, v in zip((one, two), np.nonzero(pick), strict=True))
            if not len(x):
                return
            sigs = np.frombuffer(b"".join(unit.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            kept = []
            for at in range(0, len(x), PAIRS):  # bounds what is compared at a time
                p, q = x[at : at + PAIRS], y[at : at + PAIRS]
                matches = np.zeros(len(p), np.int64)
                for k, need in enumerate(least):
                    batch = slice(k * BATCH, (k + 1) * BATCH)
                    matches += (sigs[p, batch] == sigs[q, batch]).sum(1)
                    alive = matches >= need
                    p, q, matches = p[alive], q[alive], matches[alive]
                kept.append((p, q, matches))
            x, y, matches = (np.concatenate(k) for k in zip(*kept, strict=True))
            order = np.argsort(-matches, kind="stable")
            root = {c: c for c in comp.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            links, at, step = [], 0, FEW
            while at < len(order):
                some = order[at : at + step]
                at, step = at + step, 4 * step  # the first ones merge most; the others share the work on their sets
                roots = np.array([find(c) for c in comp.tolist()])
                some = some[roots[x[some]] != roots[y[some]]]
                same = stored.common(rep[x[some]], rep[y[some]])
                for k in some[100 * same >= percent * (size[x[some]] + size[y[some]] - same)].tolist():
                    a, b = find(comp[x[k]]), find(comp[y[k]])
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append(sorted((rep[x[k]], rep[y[k]])))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

        return units.mapInArrow(run, "a long, b long")


class SetFiles:
    """Shingle sets by identifier, from mapped files, or from as many fetched ones as memory is meant for."""

    def __init__(self, folder: str, files: int):
        self.folder, self.files, self.held = folder, files, Files()

    def get(self, i: int) -> np.ndarray:
        parts = self.held.open(f"{self.folder}/sets-{i % self.files:06d}")
        at = int(np.searchsorted(parts["ids"], i))
        return parts["sets"][parts["ends"][at - 1] if at else 0 : parts["ends"][at]]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes of intersections of pairs. Many pairs of few sets go through a product of membership matrices, without the shingles that one set alone has."""
        if not len(a):
            return np.zeros(0, np.int64)
        left, right = np.unique(a), np.unique(b)
        one, two = ([self.get(i) for i in ids.tolist()] for ids in (left, right))
        rows = len(left) + len(right)
        if len(a) >= 4 * rows:
            _, place, sets = np.unique(np.concatenate([*one, *two]), return_inverse=True, return_counts=True)
            shared = sets > 1
            if rows * int(shared.sum()) <= MATRIX:
                row, some = np.repeat(np.arange(rows), [len(s) for s in [*one, *two]]), shared[place]
                members = np.zeros((rows, int(shared.sum())), np.float32)
                members[row[some], (np.cumsum(shared) - 1)[place[some]]] = 1
                product = members[: len(one)] @ members[len(one) :].T
                return np.rint(product[np.searchsorted(left, a), np.searchsorted(right, b)]).astype(np.int64)
        at, of = dict(zip(left.tolist(), one, strict=True)), dict(zip(right.tolist(), two, strict=True))
        return np.array([len(np.intersect1d(at[p], of[q], assume_unique=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def label_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``df``; its other columns aren't read.

    A group is all that links reach; its least identifier names it and stays. A null text, or one without
    words, has no shingles and no links. Rows without an identifier take no part: their component is null and
    they stay. Rows with the same identifier are one document for links, and repeated rows stay or go together.
    """
    work = _Pass(df, id_col, text_col, words, similarity)
    work.run()
    classes = work.classes.select(F.col("digest").alias("d"), F.col("rep").alias("r"))
    rows = work.all.select("doc_id", "n_shingles", "digest")
    rows = rows.join(classes, (F.col("digest") == F.col("d")) & F.col("doc_id").isNotNull(), "left")
    rows = work.labelled(rows.withColumn("r", F.coalesce("r", "doc_id")).drop("digest", "d"), "r")
    return rows.select("doc_id", "n_shingles", F.col("cr").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("cr"), F.lit(True)).alias("kept"))


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stay, with its columns as they were."""
    gone = written(label_groups(df, id_col, text_col, **options).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    few = gone.count() <= BROADCAST_IDS
    return df.join(F.broadcast(gone) if few else gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
