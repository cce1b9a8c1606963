"""The pipeline, stage by stage, against a plain version."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_near_and_scores import groups, words

WORDS = {
    "en": "the cat was on a mat and thinking about other things that were there with him",
    "de": "die katze war auf der matte und dachte nach weil nichts anderes dort gewesen ist",
    "fr": "le chat est sur la paillasse et pense aux choses qui ne sont pas avec lui",
    "es": "el gato estaba sobre la alfombra y pensaba en las cosas que no eran suyas",
}


def corpus():
    r = random.Random(11)
    out = []
    for i in range(240):
        lang = r.choice(list(WORDS))
        text = " ".join(r.choices(WORDS[lang].split(), k=r.randint(8, 60)))
        if out and r.random() < 0.25:
            text, lang = out[r.randrange(len(out))][1:3]
            if r.random() < 0.6:
                text = f"{text} {r.choice(WORDS[lang].split())}"
        out.append((i, text, lang, f"s{r.randint(0, 4)}"))
    out += [(900, None, "en", "s0"), (901, "", "en", None), (902, "12 34 !?", "fr", "s1"), (903, " ".join(WORDS["en"].split() * 900), "en", None)]
    return [(d, t, lang, s, len(t or "")) for d, t, lang, s in out]


def plain(docs):
    """Ids that stay after each filter, and how often each is taken."""
    named = [x for x in docs if x[1] and any(ch.isalpha() for ch in x[1])]
    last = {}
    for x in named:
        last[x[1]] = max(last.get(x[1], -1), x[0])
    exact = [x for x in named if last[x[1]] == x[0]]
    group = groups([(x[0], x[1]) for x in exact], 5)
    near = [x for x in exact if group[x[0]][1] == x[0]]
    sizes = defaultdict(int)
    for x in near:
        sizes[x[3]] += len(words(x[1]))
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        share = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and 3 * sizes[s] <= weight[s] * share}
        if not more:
            break
        capped |= more
    taken = {}
    for x in near:
        rate = (3.0 * sizes[x[3]] if x[3] in capped else weight[x[3]] * share) / sizes[x[3]]
        draw = int(hashlib.md5(f"42:{x[0]}:{hashlib.md5(x[1].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 16**13
        taken[x[0]] = int(rate) + (draw < rate - int(rate))
    return [x[0] for x in named], [x[0] for x in exact], [x[0] for x in near], taken


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_are_those_of_a_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named, exact, near, taken = plain(corpus())
    seen, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen.append(sorted(r.doc_id for r in docs.collect()))
        if name != "byte_bpe":
            assert docs.columns == columns
    assert seen[0] == sorted(named) and seen[1] == sorted(exact) and seen[2] == sorted(near)
    assert Counter(seen[3]) == Counter({d: n for d, n in taken.items() if n}) and seen[4] == seen[3]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in docs.collect():
        ids = library.encode_ordinary(r.text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_last_stage_gives_ids(spark, folder):
    stage = dict(corpus_pipeline.STAGES)["byte_bpe"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = stage(spark, docs.withColumn("ids", docs.doc_id), folder)
    assert got.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    rows = got.collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()


def test_run_gives_the_last_stage(spark, folder):
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == Counter({d: n for d, n in plain(corpus())[3].items() if n})


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
