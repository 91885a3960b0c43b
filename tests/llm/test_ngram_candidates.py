"""How many pairs n-gram Jaccard looks at and what it shuffles."""

import random

import numpy as np

import corpus_pipeline
from factsieve.llm import ngram_join
from factsieve.llm.store import Scratch


def test_tokens_of_several_documents_come_last_and_few_pairs_meet(spark, monkeypatch):
    rng, rows = random.Random(5), []
    for _ in range(40):
        shared = [f"s{rng.randrange(10**9)}" for _ in range(100)]
        for _ in range(8):
            # the same passage between words of its own: a third of the shingles, far from a link
            own = [f"w{rng.randrange(10**9)}" for _ in range(100)]
            rows.append((len(rows), " ".join([*own[:50], *shared, *own[50:]])))
    rows.append((len(rows), rows[0][1] + " more"))
    pairs, plain = [], Scratch.table

    def table(self, df, name):
        stored = plain(self, df, name)
        if name == "pairs":
            pairs.append(stored.count())
        return stored

    monkeypatch.setattr(Scratch, "table", table)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {i: i for i in range(320)} | {320: 0}
    assert sum(pairs) < 100  # 1128 when the words of the passages come in any order


def test_levels_of_common_tokens():
    common = (np.array([3, 8, 2**63 + 5], np.uint64), np.array([2, 3, 9], np.uint8))
    tokens = np.array([1, 3, 8, 9, 2**63 + 5], np.uint64)
    assert ngram_join.in_order(tokens, common, 0, 5).tolist() == [1, 9, 3, 8, 2**63 + 5]
    none = (np.empty(0, np.uint64), np.empty(0, np.uint8))
    assert ngram_join.in_order(tokens, none, 0, 2).tolist() == [1, 3]


def test_common_tokens_are_bounded_by_whole_levels(spark, monkeypatch):
    # one shingle in 9 texts, one in 4, ten in 2
    texts = ["a b c d e " + f"x{i} y{i} z{i} u{i} v{i}" for i in range(9)]
    texts += ["f g h i j " + f"p{i} q{i} r{i} s{i} t{i}" for i in range(4)]
    for k in range(10):
        texts += [f"k{k} l{k} m{k} n{k} o{k} " + f"m{i}{k} n{i}{k} o{i}{k} g{i}{k} h{i}{k}" for i in range(2)]
    docs = spark.createDataFrame([(t,) for t in texts * 2], "text string").coalesce(1)
    scratch = Scratch(spark, "test")
    tokens, levels = ngram_join._common_tokens(docs, "text", 5, scratch)
    assert sorted(levels.tolist()) == [2] * 10 + [3, 4] and (np.diff(tokens.astype(object)) > 0).all()
    monkeypatch.setattr(ngram_join, "COMMON", 5)
    assert sorted(ngram_join._common_tokens(docs, "text", 5, scratch)[1].tolist()) == [3, 4]
    monkeypatch.setattr(ngram_join, "COMMON", 0)
    assert not len(ngram_join._common_tokens(docs, "text", 5, scratch)[0])


def test_texts_stay_where_they_are_when_copies_are_dropped(spark, tmp_path):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, "other text"), (4, ""), (None, "x y"), (3, "other text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    joins = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(joins)
    spark.conf.set(joins, "-1")
    try:
        kept = corpus_pipeline.one_of_each_group(spark, docs, "")
        assert "SortMergeJoin" not in kept._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect())
    finally:
        spark.conf.set(joins, before)
    assert got == [(0, "x y"), (1, " ".join(words)), (3, "other text"), (4, "")]


def test_sketches_differ_in_no_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 2000):
        for k in (0, 1, 3, n):
            a = rng.integers(0, 2**64, n, np.uint64)
            b = np.concatenate([a[k:], rng.integers(0, 2**64, k // 2, np.uint64)])
            apart = sum(int(x).bit_count() for x in (ngram_join.sketch(a) ^ ngram_join.sketch(b)).view(np.uint64))
            assert apart <= min(k, n) + k // 2
            assert apart > 50 or n < 60 or k < n


def test_a_group_just_below_the_threshold_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        # three words of sixty replaced: two such texts mostly share half to three quarters of their shingles
        words = list(base)
        for k in rng.sample(range(60), 3):
            words[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    pairs, plain = [], Scratch.table

    def table(self, df, name):
        stored = plain(self, df, name)
        if name == "pairs":
            pairs.append(stored.count())
        return stored

    monkeypatch.setattr(Scratch, "table", table)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((want[a], want[b]))
                want = [x if w == y else w for w in want]
    assert got == dict(enumerate(want))
    assert pairs[-1] < 500
