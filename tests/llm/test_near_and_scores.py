"""Near-duplicate groups and language-model scores against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataform.llm import near_dedup, ngram
from strataform.llm.common import written
from strataform.llm.components import components
from strataform.llm.elias_fano import EliasFano

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def groups(docs, n, percent=80):
    sets = {}
    for d, text in docs:
        w = words(text)
        k = min(n, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, families=25, most=14):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = r.choices(vocabulary, k=60)
    out, d = [], 0
    for _ in range(families):
        text = r.choices(vocabulary, k=r.choice((3, 5, 9, 30, 90, 400)))
        if r.random() < 0.5:
            text += passage
        for _ in range(r.randint(1, most)):
            copy = list(text)
            for _ in range(r.randint(0, max(1, len(copy) // 40))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.2:
                copy += r.choices(vocabulary, k=len(copy) // 7)
            out.append((d, " ".join(x.upper() if r.random() < 0.1 else x for x in copy)))
            d += 1
    r.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 4, 256), (2, 5, 256), (3, 4, 2)])
def test_groups_are_those_of_brute_force(spark, seed, n, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    docs = corpus(seed)
    want = groups(docs, n)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in near_dedup.label_groups(df, words=4).collect()}
    assert {d: (x.n_shingles, x.component_id) for d, x in got.items()} == want
    assert all(x.kept == (d == x.component_id) for d, x in got.items())


def test_groups_around_one_passage(spark, monkeypatch):
    """A bucket of many that aren't alike, but for a few: dealt by rare shingles, not compared all with all."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = r.choices(vocabulary, k=120)
    docs = []
    for family in range(90):
        own = r.choices(vocabulary, k=60)
        for copy in range(3 if family % 9 == 0 else 1):
            docs.append((len(docs) * 7 % 1001, " ".join([*passage, *own[: 60 - copy]])))
    want = groups(docs, 5)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    work = near_dedup._Pass(df, "doc_id", "text", 5, 0.8)
    large = written(work.sets.select("rep"), "test")
    dealt = work.by_rare_shingles(large).collect()
    assert {x.key for x in dealt} and max(x.n for x in dealt) <= 16
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.label_groups(df).collect()}
    assert got == want and len({c for _, c in want.values()}) == 90


def large_group(seed, copies, most):
    """Copies of one text with up to ``most`` words changed, so that some are near others and some near none."""
    r = random.Random(seed)
    text = r.choices([f"w{i}" for i in range(4000)], k=160)
    out = []
    for d in range(copies):
        copy = list(text)
        for at in r.sample(range(len(copy)), r.randint(0, most)):
            copy[at] = r.choice(("x", "y", f"z{d}"))
        out.append((d, " ".join(copy)))
    return out


def test_a_large_group_whose_components_merge_early(spark, monkeypatch):
    """More pairs are left in a unit than are verified at a time, and the first ones make its components one."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "FEW", 2)
    monkeypatch.setattr(near_dedup, "ROUNDS", 1)
    monkeypatch.setattr(near_dedup, "LEADERS", 1)
    docs = large_group(3, 150, 12)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.label_groups(df, words=4).collect()}
    expected = groups(docs, 4)
    assert len({c for _, c in expected.values()}) > 5
    assert got == expected


def test_intersections_of_stored_sets(tmp_path):
    r = random.Random(4)
    sets = [np.array(sorted(r.sample(range(90), r.randint(1, 60))), np.uint64) for _ in range(12)]
    near_dedup.put(f"{tmp_path}/sets-000000", [near_dedup.pack({"ids": np.arange(12), "ends": np.cumsum([len(s) for s in sets]), "sets": np.concatenate(sets)})])
    stored = near_dedup.SetFiles(str(tmp_path), 1)
    assert len(stored.common(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
    a, b = (x.ravel() for x in np.meshgrid(np.arange(12), np.arange(12)))
    for some in (slice(None), slice(0, 5)):  # by a product, and one by one
        assert stored.common(a[some], b[some]).tolist() == [len(set(sets[i].tolist()) & set(sets[j].tolist())) for i, j in zip(a[some], b[some], strict=True)]


def test_overlapping_large_buckets_are_one(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    rows = [(key, rep, 10) for key in range(100, 103) for rep in range(10)]  # the same ten members three times
    rows += [(200, 50, 2), (200, 51, 2)]  # a small one
    chain = [(300 + k, 60 + 4 * k + i, 5) for k in range(9) for i in range(5)]  # overlaps in one member: one bucket would be more pairs
    df = spark.createDataFrame(rows + chain, "key long, rep long, n long")
    got = Counter((r.key, r.rep, r.n) for r in near_dedup._Pass.merged(None, df).collect())
    assert got == Counter([*((0, rep, 10) for rep in range(10)), *rows[30:], *chain])


@pytest.mark.parametrize("similarity", [0.3, 0.5, 0.7, 0.9])
def test_links_of_other_thresholds_are_found(spark, similarity):
    r = random.Random(int(similarity * 100))
    docs, linked = [], 0
    for k in range(60):
        own = [f"p{k}w{i}" for i in range(200)]
        cut = int(200 * (1 - similarity) / (1 + similarity)) - r.randint(0, 3)
        docs += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[:-cut] + [f"q{k}w{i}" for i in range(cut)]))]
    want = groups(docs, 1, round(100 * similarity))
    linked = sum(c != d for d, (_, c) in want.items())
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    got = {x.doc_id: x.component_id for x in near_dedup.label_groups(df, words=1, similarity=similarity).collect()}
    assert linked >= 45 and all(got[d] in (c, d) for d, (_, c) in want.items())
    assert sum(got[d] == c != d for d, (_, c) in want.items()) >= 0.99 * linked


def test_bands_follow_from_the_threshold():
    assert near_dedup.band_rows(0.8) == 6 and near_dedup.band_rows(0.5) == 2
    for t in (0.1, 0.3, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99):
        rows = near_dedup.band_rows(t)
        assert (1 - t**rows) ** (near_dedup.HASHES // rows) <= 1e-5
    with pytest.raises(ValueError):
        near_dedup.band_rows(0.01)


@pytest.mark.parametrize("shape", ["hot", "even"])
def test_pairs_of_a_hot_leader_are_dealt(spark, shape):
    df = spark.createDataFrame([(i, f"a b c {i // 2}") for i in range(6)], "doc_id long, text string")
    work = near_dedup._Pass(df, "doc_id", "text", 5, 0.8)
    pairs = [(1 if shape == "hot" and i % 3 else i, i + 1000) for i in range(900)]
    one = spark.createDataFrame([(i, f"x{i}") for i in range(900)], "a long, ta string")
    two = spark.createDataFrame([(i + 1000, f"y{i}") for i in range(900)], "b long, tb string")
    got = work.beside(spark.createDataFrame(pairs, "a long, b long"), one, two)
    assert sorted((x.a, x.b, x.ta, x.tb) for x in got.collect()) == sorted((a, b, f"x{a}", f"y{b - 1000}") for a, b in pairs)


def test_groups_of_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    docs = [(5, None, "a"), (6, "", "b"), (7, " \t\n", "c"), (8, "one", "d"), (4, "ONE", "e"), (9, "one two", "f"), (10, long, "g"), (11, long + " y", "h"), (None, "one", "i"), (12, "one", "j"), (12, "one", "j"), (13, "one\x85two\xa0", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, component_id string")
    got = sorted((x.doc_id or -1, x.n_shingles, x.component_id, x.kept) for x in near_dedup.label_groups(df).collect())
    assert got == sorted(
        [(5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 4, False), (4, 1, 4, True), (9, 1, 9, True), (10, 29996, 10, True), (11, 29997, 10, False), (-1, 1, None, True)]
        + [(12, 1, 4, False)] * 2
        + [(13, 1, 13, True)]
    )
    kept = near_dedup.drop_near(df)
    assert kept.columns == df.columns and sorted(x.component_id for x in kept.collect()) == list("abcefgik")
    assert near_dedup.label_groups(df.where("false")).count() == 0


def test_pruning_keeps_similar_pairs():
    least = near_dedup.least_matches(0.8, near_dedup.MISS)
    for k, m in enumerate(least):
        n = (k + 1) * near_dedup.BATCH
        tail = lambda m, n=n: sum(math.comb(n + 1, i) * 0.80078125**i * 0.19921875 ** (n + 1 - i) for i in range(m + 1))
        assert tail(m) >= near_dedup.MISS > tail(m - 1)


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 500)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize(("n", "universe"), [(0, 5), (1, 1), (5, 3), (1000, 10**6), (5000, 1 << 60), (3000, 1000)])
def test_elias_fano(n, universe):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, universe, n, np.uint64)) if n else np.zeros(0, np.uint64)
    sequence = EliasFano(EliasFano.build(values, universe))
    assert (sequence.get(np.arange(n)) == values).all()
    asked = np.concatenate([r.integers(0, universe, 2000, np.uint64), values])
    first = {}
    for i, v in enumerate(values.tolist()):
        first.setdefault(v, i)
    assert sequence.find(asked).tolist() == [first.get(v, -1) for v in asked.tolist()]


def plain_model(docs, order, cutoff):
    """Probabilities by dictionaries, without codes."""
    grams = [Counter() for _ in range(order + 1)]
    for d, text in docs:
        if d is not None and zlib.crc32(str(d).encode()) % 10:
            tokens = [*words(text), None]
            for k in range(1, order + 1):
                grams[k].update(tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1))
    total, distinct = sum(grams[1].values()), len(grams[1])
    children = [defaultdict(Counter) for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, c in grams[k].items():
            children[k][g[:-1]][g[-1]] = c

    def base(w):
        return (grams[1][(w,)] + 0.1) / (total + 0.1 * (distinct + 1))

    def p(context, w):
        if not context:
            return base(w)
        k = len(context) + 1
        below = p(context[1:], w)
        got = children[k].get(context)
        if not got or w not in {g[0] for g in grams[1]}:
            return below
        floor = cutoff if k == order and k > 2 else 1
        kept = {x: c for x, c in got.items() if c >= floor}
        if not kept:
            return below
        n = sum(got.values())
        left = 1 - sum(c - 0.75 for c in kept.values()) / n
        return (kept[w] - 0.75) / n + left * below if w in kept else left * below

    return grams, total, base, p


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_are_those_of_a_plain_model(spark, order):
    r = random.Random(order)
    vocabulary = "a b c d e f g h The cat SAT on".split()
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 30)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "zzz a qqq"), (503, "a " * 5000), (None, "a b c"), (7, "a b")]
    grams, total, base, p = plain_model(docs, order, 2)
    df = spark.createDataFrame([(d, t, 1.5) for d, t in docs], "doc_id long, text string, score double").repartition(3)
    trie = ngram.train(df, order=order, cutoff=2)
    assert trie.total == total and len(trie.levels) == order
    got = defaultdict(list)
    for x in ngram.score(df, trie).collect():
        got[x.doc_id].append(x)
    for d, text in docs:
        tokens = [*words(text), None]
        want = sum(math.log10(p(tuple(tokens[max(0, i - order + 1) : i]), w)) for i, w in enumerate(tokens))
        near = [x for x in got[d] if x.n_tokens == len(tokens)][0]
        assert near.held_out == (d is None or zlib.crc32(str(d).encode()) % 10 == 0) and near.train_tokens == total
        assert near.n_known == sum(grams[1][(w,)] > 0 for w in tokens)
        assert near.base_score == pytest.approx(sum(math.log10(base(w)) for w in tokens))
        assert near.score == pytest.approx(want, abs=len(tokens) * 1e-3)


def test_default_model_keeps_every_trigram(spark):
    r = random.Random(11)
    docs = [(i, " ".join(r.choices("abcdefghij", k=r.randint(3, 30)))) for i in range(150)]
    grams, _, _, p = plain_model(docs, 3, 1)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    trie = ngram.train(df)
    assert min(grams[3].values()) == 1 and sum(trie.levels[2].sizes) == len(grams[3])
    got = {x.doc_id: x.score for x in ngram.score(df, trie).collect()}
    for d, text in docs:
        tokens = [*words(text), None]
        want = sum(math.log10(p(tuple(tokens[max(0, i - 2) : i]), w)) for i, w in enumerate(tokens))
        assert got[d] == pytest.approx(want, abs=len(tokens) * 1e-3)


def test_wide_keys_give_the_same_model(spark, monkeypatch):
    """As a vocabulary of a billion words would: pairs are sorted as two numbers."""
    r = random.Random(12)
    docs = [(i, " ".join(r.choices("abcdefghij", k=r.randint(0, 30)))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    scores = lambda: sorted((x.doc_id, round(x.score, 9)) for x in ngram.score(df, ngram.train(df, order=4)).collect())
    narrow = scores()
    used = []
    monkeypatch.setattr(ngram, "KEYS", 1)
    pairs = ngram._distinct_pairs
    monkeypatch.setattr(ngram, "_distinct_pairs", lambda a, b: used.append(1) or pairs(a, b))
    trie = ngram.train(df, order=4)
    texts = ngram.pa.array([t for _, t in docs])
    assert [round(x, 9) for x in trie.score(texts)[3]] == [x for _, x in narrow] and used
    a, b, back = pairs(np.array([3, 1, 3, 1]), np.array([2, 9, 2, 1]))
    assert (a.tolist(), b.tolist(), back.tolist()) == ([1, 1, 3], [1, 9, 2], [2, 1, 2, 0])


def test_successors_sum_to_one(spark):
    df = spark.createDataFrame([(i, "a b a c a b b a") for i in range(1, 9)], "doc_id long, text string")
    trie = ngram.train(df, order=2)
    for context in range(trie.words):
        words, log10 = trie.successors(2, context)
        unseen = np.setdiff1d(np.arange(trie.words), words)
        both = trie.log10(2, np.full(trie.words, context), np.concatenate([words, unseen]))
        assert both[: len(words)] == pytest.approx(log10)
        if len(words):
            left = 10 ** trie._search(2, np.array([context]), np.array([trie.words]))[2][0] * 10**trie.unknown
            assert (10**both).sum() + left == pytest.approx(1, abs=2e-3)


def test_scoring_without_training(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = df.where("false")
    assert ngram.score(none, ngram.train(df)).count() == 0
    row = ngram.score(df, ngram.train(none)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_words_of_odd_texts():
    import pyarrow as pa

    r = random.Random(1)
    letters = " \t\n\x0b\x0c\r\x1c\x1f\x85\xa0　aBÉßİ\x00|"
    texts = ["".join(r.choices(letters, k=r.randint(0, 12))) for _ in range(2000)] + [None, ""]
    place, found, sizes = ngram.words_of(pa.array(texts))
    assert [found[i] for i in place] == [w for t in texts for w in [*words(t), "\n"]]
    assert sizes.tolist() == [len(words(t)) + 1 for t in texts]
    place, _, sizes = ngram.words_of(pa.array(texts).slice(100, 500))
    assert len(place) == sizes.sum() and len(sizes) == 500
