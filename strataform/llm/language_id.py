"""Language identification in two steps: the family first, then pairs of languages within it.

Texts are hashed byte trigrams, scored by linear models in one gather. One support vector machine for each
family, against the rest, picks the family; within it one machine for each pair of languages votes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.llm.common import prepare

BITS = 15
#: Frequencies are scaled so that a text's vector has a length near 1.
SCALE = 20.0
UNKNOWN = "und"
#: Families by language code; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "bs", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "indic": ("hi", "bn", "mr", "ur", "pa", "gu", "ne"),
    "turkic": ("tr", "az", "kk", "uz", "ky"),
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
has_letter = regex.compile(r"\p{L}").search

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all texts, each with a space at both ends, and where each text's begin."""
    raw = _FOLD[np.frombuffer(b"".join(b" %b " % x for x in texts), np.uint8)].astype(np.uint32)
    ends = np.cumsum([len(x) + 2 for x in texts])
    code = (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    inner = np.ones(len(code), bool)
    inner[ends[:-1] - 1] = inner[ends[:-1] - 2] = False  # those that span two texts
    sizes = np.array([len(x) for x in texts])
    return code[inner], np.concatenate([[0], np.cumsum(sizes)[:-1]])


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    buckets, _ = trigrams([text.encode("utf-8", "surrogatepass") or b" "])
    at, n = np.unique(buckets, return_counts=True)
    return at.astype(np.int32), (n * (SCALE / len(buckets))).astype(np.float32)


def train_svm(rows: list[tuple[np.ndarray, np.ndarray]], sides: np.ndarray, cost: float = 10.0, epochs: int = 20, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by dual coordinate descent."""
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    diagonal = 1 / (2 * cost)
    norms = np.array([float(v @ v) + 1 for _, v in rows]) + diagonal
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            y = sides[i]
            gradient = y * (float(w[at] @ v) + bias) - 1 + diagonal * alpha[i]
            new = max(0.0, alpha[i] - gradient / norms[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[at] += step * v
                bias += step
                alpha[i] = new
    return w, bias


class LanguageModel:
    """Machines as columns of one matrix: ``families`` first, then (a, b) pairs, positive for a."""

    def __init__(self, samples: dict[str, list[tuple[np.ndarray, np.ndarray]]]):
        self.languages = sorted(samples)
        by_family: dict[str, list[str]] = {}
        for x in self.languages:
            by_family.setdefault(FAMILY_OF.get(x, x), []).append(x)
        self.families = sorted(by_family)
        self.members = [by_family[f] for f in self.families]
        rows = [x for lang in self.languages for x in samples[lang]]
        langs = np.array([lang for lang in self.languages for _ in samples[lang]])
        columns = []
        for members in self.members if len(self.families) > 1 else []:
            columns.append(train_svm(rows, np.where(np.isin(langs, members), 1.0, -1.0)))
        self.pairs = [(a, b) for members in self.members for a, b in combinations(members, 2)]
        for a, b in self.pairs:
            columns.append(train_svm(samples[a] + samples[b], np.array([1.0] * len(samples[a]) + [-1.0] * len(samples[b]))))
        self.weights = np.array([w for w, _ in columns], np.float32).T.reshape(1 << BITS, -1).copy()
        self.bias = np.array([b for _, b in columns], np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A text that is null or without letters, or any text if nothing was learned, is unknown with score 0."""
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, x in enumerate(texts) if x and has_letter(x)] if self.languages else []
        if not known:
            return langs, scores
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in known]
        buckets, starts = trigrams(raw)
        sums = np.add.reduceat(self.weights[buckets], starts, axis=0, dtype=np.float64) if self.weights.shape[1] else np.zeros((len(raw), 0))
        margins = sums * (SCALE / np.array([len(x) for x in raw]))[:, None] + self.bias
        n = len(self.families)
        shift = n if n > 1 else 0
        column = {pair: shift + k for k, pair in enumerate(self.pairs)}
        for i, m in zip(known, margins, strict=True):
            f = int(np.argmax(m[:n])) if n > 1 else 0
            score = _sure(m[f]) if n > 1 else 1.0
            members = self.members[f]
            if len(members) > 1:
                votes = dict.fromkeys(members, 0)
                held = dict.fromkeys(members, 0.0)
                for a, b in combinations(members, 2):
                    v = m[column[a, b]]
                    votes[a if v >= 0 else b] += 1
                    held[a] += v
                    held[b] -= v
                best = max(members, key=lambda x: (votes[x], held[x]))
                score *= min(_sure(m[column[p]] * (1 if p[0] == best else -1)) for p in self.pairs if best in p)
            else:
                best = members[0]
            langs[i], scores[i] = best, score
        return langs, scores


def _sure(margin: float) -> float:
    return 1 / (1 + math.exp(-4 * max(-20.0, min(20.0, margin))))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0)) == 0


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, most: int = 20_000, languages: int = 256) -> LanguageModel:
    """Learns from at most ``per_lang`` rows of each language, ``most`` in all, none of them held out.

    The rows are those of the smallest hashes of their identifiers. Rows with a null language are not used,
    nor is a language named like the unknown. Of more than so many ``languages`` those with the most rows are
    learned, which bounds the model: a machine of 128 kB for each family and each pair in one.
    """
    prepare(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & ~held_out("id"))
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    counts = {r["lang"]: r["count"] for r in found.collect()}
    each = max(1, min(per_lang, most // max(1, len(counts))))
    samples: dict[str, list] = {}
    if counts:
        parts = 1 << 30
        # A few more than are needed of each language pass; what is left over goes by rank.
        share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(parts, int(parts * (each * 1.5 + 50) / n))))])
        near = F.pmod(F.xxhash64("id"), F.lit(parts))
        picked = rows.where(F.col("lang").isin(*counts)).withColumn("near", near).where(F.col("near") < F.element_at(share, F.col("lang"))).where(F.col("text").isNotNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [features(x) for x in batch.column(0).to_pylist()]
                at, v = (pa.array([x[k] for x in got], pa.list_(t)) for k, t in ((0, pa.int32()), (1, pa.float32())))
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), at, v], ["lang", "near", "at", "v"])

        for r in picked.select("text", "lang", "near").mapInArrow(run, "lang string, near long, at array<int>, v array<float>").toLocalIterator():
            samples.setdefault(r.lang, []).append((r.near, np.array(r["at"], np.int32), np.array(r.v, np.float32)))
    ordered = {k: [(a, v) for _, a, v in sorted(x, key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))[:each]] for k, x in samples.items()}
    return LanguageModel(ordered)


def label_languages(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row of ``df``; with ``carry`` its columns in front, clashing ones dropped.

    A null identifier counts as held out. Long texts are read whole.
    """
    prepare(df.sparkSession)
    new = ["held_out", "lang_pred", "score"]
    keep = [F.col(f"`{c}`") for c in df.columns if c not in new] if carry else [F.col(id_col).alias("doc_id")]
    src = df.select(F.col(text_col).alias("__text"), *keep, held_out(id_col).alias("held_out"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a size that fit bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            texts = batch.column(0)
            step = max(1, batch.num_rows * (1 << 18) // max(1, texts.nbytes))
            for i in range(0, batch.num_rows, step):
                a, b = shared.value.predict(texts.slice(i, step).to_pylist())
                langs += a
                scores += b
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[1:], "lang_pred", "score"])

    schema = src.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return src.mapInArrow(run, schema)


def keep_identified(df: DataFrame, least: float = 0.02, **options) -> DataFrame:
    """The rows of ``df`` whose text has a language, with its columns: unknown ones and those scored below ``least`` go."""
    out = label_languages(df.select("*", F.lit(None).cast("string").alias("lang_pred")), fit(df, **options), carry=True)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*df.columns)
