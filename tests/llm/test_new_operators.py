"""Token counts, alignment and periodic runs against plain libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factsieve.llm import alignment, periodic_runs, queries, token_counts
from factsieve.llm.alignment import Fragment, composed, fragment
from factsieve.llm.store import docs_of
from factsieve.llm.tokens import DEFAULT_PIECES, Encoder, Pieces, tokenizer_path

A, B = tokenizer_path(), tokenizer_path(DEFAULT_PIECES)
ALPHABET = ["a", "Bc", " ", " ", "  ", "\n", "\t", "\r", "\x0b", "'s", "é", "日本", "。", "12", ".", "<|endoftext|>", "<s>", " ", "　", "▁", "\x1c", "😀"]
DOCS = "doc_id long, text string, row long, k int, n_tokens string, runs string, keys long"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", 3) for i, t in rows], DOCS)


def mixed(seed, n, longest=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    texts = mixed(1, 300)
    rng = random.Random(2)
    long = " ".join(rng.choice(["the", "quick", "brown", "fóx", "12,5", "jump's", "\n", "über"]) for _ in range(40_000))
    texts += [None, "", " ", long, long, "日本語。" * 30_000, "x" * 90_000, "one two three", "one two three", "▁ one" * 20_000]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (5, "another text of five"), (5, texts[5])]


@pytest.fixture(scope="module")
def plain():
    """The libraries by themselves."""
    default, ordinary = Tokenizer.from_file(A), Tokenizer.from_file(A)
    ordinary.encode_special_tokens = True
    return default, ordinary, sentencepiece.SentencePieceProcessor(model_file=B)


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_cut_texts_have_the_ids_of_whole_ones(plain):
    default, ordinary, pieces = plain
    encoders = Encoder(A), Encoder(A, plain=True), Pieces(B)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet="".join(ALPHABET), max_size=30), max_size=5))
    def check(texts):
        for own, library in zip(encoders, (default, ordinary), strict=False):
            assert list(map(ids, own.encode(texts))) == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert list(map(ids, encoders[2].encode(texts))) == pieces.encode(texts)

    check()
    texts = mixed(6, 3000)
    assert list(map(ids, encoders[0].encode(texts))) == [default.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(map(ids, encoders[2].encode(texts))) == pieces.encode(texts)


def test_segments_join_to_the_text():
    for text in ["", "a", "a b c d", "x" * 50, " a  b \n c", "a " * 40]:
        for most in (1, 5, 100):
            parts = list(token_counts.segments(text, most))
            assert " ".join(parts) == text


def test_balanced_batches():
    sizes = np.array([5, 1, 1, 90, 3, 3, 3, 3, 40, 2])
    ranges = token_counts.balanced(sizes, 20)
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(sizes)))
    assert all(sizes[a:b].sum() <= 20 or b - a == 1 or sizes[a : b - 1].sum() <= 20 for a, b in ranges)
    assert token_counts.balanced(np.zeros(0, np.int64), 5) == []


@pytest.mark.parametrize("path", [A, B])
def test_token_counts(spark, rows, plain, monkeypatch, path):
    got = token_counts.count_tokens(docs_frame(spark, rows), tokenizer=path, limit=6)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    library = (lambda t: len(plain[0].encode(t, add_special_tokens=False).ids)) if path == A else (lambda t: len(plain[2].encode(t)))
    want = []
    for i, text in rows:
        n = library(text or "")
        want.append((i, len((text or "").encode()), n, n > 6))
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(docs_frame(spark, [])).count() == 0


def test_counts_of_segments(plain, monkeypatch):
    monkeypatch.setattr(token_counts, "segments", lambda t, most=0: _segments(t, 7))
    texts = mixed(4, 300) + ["<|endoftext|> a <|endoftext|> b c d e f"]
    for path, library in ((A, lambda t: len(plain[0].encode(t, add_special_tokens=False).ids)), (B, lambda t: len(plain[2].encode(t)))):
        counter = token_counts.Counter(path)
        assert counter.count(texts) == list(map(library, texts))


_segments = token_counts.segments


def pieces_of(text, plain):
    """(ids, bytes) of both sides of one text by the libraries alone, None if one does not spell the text."""
    _, ordinary, model = plain
    wanted = b" " + text.encode()
    letters = alignment.letters_of_bytes()
    a = ordinary.encode(" " + text, add_special_tokens=False)
    a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
    b = model.encode(text)
    names = map(model.id_to_piece, b)
    b_bytes = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(b, names, strict=True)]
    if not text or b"".join(a_bytes) != wanted or b"".join(b_bytes) != wanted:
        return None
    return list(zip(a.ids, a_bytes, strict=True)), list(zip(b, b_bytes, strict=True))


def aligned(text, plain):
    """(groups as text, all links) by walking over both sides."""
    both = pieces_of(text, plain)
    if both is None:
        return "", [], 0, 0, 0
    spans = []
    for side in both:
        at, out = 0, []
        for i, data in side:
            out.append((i, at, at + len(data)))
            at += len(data)
        spans.append(out)
    a, b = spans
    common = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups, links, low, x, y = [], [], 0, 0, 0
    for high in common:
        p, q = x, y
        while x < len(a) and a[x][2] <= high:
            x += 1
        while y < len(b) and b[y][2] <= high:
            y += 1
        groups.append(",".join(str(t[0]) for t in a[p:x]) + "|" + ",".join(str(t[0]) for t in b[q:y]))
        links += [(s[0], t[0]) for s in a[p:x] for t in b[q:y] if s[1] < t[2] and t[1] < s[2]]
        low = high
    assert low == a[-1][2]
    return ";".join(groups), links, len(a), len(b), len(groups)


def aligned_rows(rows, plain):
    found = [(i, *aligned(t or "", plain)) for i, t in rows]
    counts = Counter(p for f in found for p in f[2])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, groups, links, n_a, n_b, n_groups in found:
        n_best = sum(counts[p] == best[p[1]] for p in links)
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, n_groups, len(links), n_best, sum(counts[p] for p in links), digest))
    return out, counts


@pytest.mark.parametrize("most_pairs", [alignment.MAX_PAIRS, 3])
def test_alignment(spark, rows, plain, monkeypatch, most_pairs):
    monkeypatch.setattr(alignment, "MAX_PAIRS", most_pairs)
    documents, pairs = alignment.align(docs_frame(spark, rows))
    want, counts = aligned_rows(rows, plain)
    key = lambda r: (r[0] is not None, r)
    assert sorted(map(tuple, documents.collect()), key=key) == sorted(want, key=key)
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == dict(counts)


def test_alignment_of_long_documents_in_slices(spark, plain, monkeypatch):
    """Slices of a few characters, ranges of a few bytes: all groups come out of the tree."""
    rng = random.Random(9)
    texts = [t for t in mixed(11, 60, 400)] + [" ".join(rng.choice(["日本語", "ab", "x" * 70, "▁"]) for _ in range(200))]
    monkeypatch.setattr(alignment, "SLICE", 12)
    monkeypatch.setattr(alignment, "RANGE", 3)
    monkeypatch.setattr(alignment, "FAN", 3)
    # what tasks use goes with the function, not with the module
    rows = list(enumerate(texts))
    slices = spark.createDataFrame(
        [(i, k, s) for i, t in rows for k, s in enumerate(token_counts.segments(t, 12))], "row long, k int, slice string"
    )
    most = slices.agg({"k": "max"}).first()[0] + 1
    scratch = alignment.Scratch(spark, "test")
    paths = A, B
    parts = alignment._long_parts(slices, paths, most, scratch)
    got = {r["row"]: r for r in alignment._long_documents(parts, paths, True).where("kind = 0").collect()}
    for i, text in rows:
        groups, links, n_a, n_b, n_groups = aligned(text, plain)
        if not groups:
            assert i not in got
            continue
        r = got[i]
        assert r["groups"] == groups and r["digest"] == hashlib.sha256(groups.encode()).hexdigest()
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (n_a, n_b, n_groups, len(links))


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_fragments_compose_in_any_way(data):
    sizes = st.lists(st.integers(1, 4), min_size=1, max_size=12)
    a_ends = np.cumsum(data.draw(sizes))
    b_ends = np.cumsum(data.draw(sizes))
    n = max(a_ends[-1], b_ends[-1])
    a_ends, b_ends = (np.unique(np.append(e, n)) for e in (a_ends, b_ends))
    a, b = np.arange(len(a_ends), dtype=np.uint32), np.arange(100, 100 + len(b_ends), dtype=np.uint32)

    def of(low, high):
        p, q = (slice(*np.searchsorted(e, [low, high], "right")) for e in (a_ends, b_ends))
        return fragment(a[p], a_ends[p], b[q], b_ends[q])

    def flat(f: Fragment):
        """The open ends and all groups, however the closed ones are put together."""
        groups = [
            (x.tolist(), y.tolist())
            for x, y in f.closed
        ]
        return f.cut, [p.tolist() for p in f.prefix], [sum((g[0] for g in groups), []), sum((g[1] for g in groups), [])], [
            p.tolist() for p in f.suffix
        ]

    borders = [0, *sorted(data.draw(st.sets(st.integers(1, int(n)), max_size=6)) | {int(n)})]
    parts = [of(x, y) for x, y in zip(borders, borders[1:], strict=False)]
    whole = flat(of(0, int(n)))
    assert flat(composed(parts)) == whole
    while len(parts) > 1:
        i = data.draw(st.integers(0, len(parts) - 2))
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert flat(parts[0]) == whole


def brute_runs(words, min_length=6, min_exponent=4):
    found = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def repetitive(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        size, letters = rng.randint(0, 70), "abcd"[: rng.randint(1, 4)]
        x = [rng.choice(letters) for _ in range(size)]
        if size and rng.random() < 0.5:
            a = rng.randrange(size)
            p = 1 + (size - a) // rng.randint(3, 10)
            x = x[:a] + [x[a + (i - a) % p] for i in range(a, size)]
        out.append(rng.choice([" ", "\n", " \t"]).join(x))
    return out


@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (2, 2), (4, 3)])
def test_runs_against_brute_force(length, exponent):
    texts = repetitive(3, 500)
    lists, numbers, borders = periodic_runs._numbered([t.encode() for t in texts])
    of = np.repeat(np.arange(len(lists)), np.diff(borders))
    found = periodic_runs.find_runs(numbers, of, length, exponent)
    got = sorted((int(of[s]), int(s - borders[of[s]]), int(n), int(q)) for s, n, q in zip(*found, strict=True))
    assert got == [(i, *r) for i, x in enumerate(lists) for r in brute_runs(x, length, exponent)]


def test_runs_of_very_long_texts():
    for words, want in (
        (["a"] * 200_000, [(0, 200_000, 1)]),
        ([f"x{i % 1000}" for i in range(200_000)], [(0, 200_000, 1000)]),
        ([f"x{i}" for i in range(150_000)], []),
    ):
        _, numbers, _ = periodic_runs._numbered([" ".join(words).encode()])
        found = periodic_runs.find_runs(numbers, np.zeros(len(numbers), np.int64))
        assert [tuple(map(int, r)) for r in zip(*found, strict=True)] == want


def test_periodic_runs_of_a_table(spark):
    texts = [*repetitive(8, 60), None, "", " \n ", "a a a a a a", "A a A a A a A a", "é é é é é é x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b b b b b b b"), (3, texts[3]), (3, "c c c c c c")]
    got = periodic_runs.periodic_runs(docs_frame(spark, rows))
    assert got.columns == ["doc_id", "n_words", "runs", "text"]
    want = []
    for i, text in rows:
        x = (text or "").encode().split()
        runs = brute_runs(x)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, len(x), runs, b" ".join(w for k, w in enumerate(x) if k not in gone).decode()))
    found = [(r["doc_id"], r["n_words"], [tuple(c) for c in r["runs"]], r["text"]) for r in got.collect()]
    key = lambda r: (r[0] is not None, r)
    assert sorted(found, key=key) == sorted(want, key=key)
    assert periodic_runs.periodic_runs(docs_frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs_frame(spark, []), min_exponent=1)


def test_query_of_runs(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, sf_dir).collect()}
    docs = docs_of(spark, sf_dir).select("doc_id", "text").collect()
    assert len(got) == len(docs)
    planted = 0
    for doc in docs:
        x = (doc["text"] or "").encode().split()
        h, n = zlib.crc32(str(doc["doc_id"]).encode()), len(x)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(x)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        r = got[doc["doc_id"]]
        assert r["n_runs"] == len(runs)
        best = None
        for s, m, q in runs:
            if best is None or m * best[2] > best[1] * q:
                best = s, m, q
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == want
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for k, w in enumerate(x) if k not in gone)).hexdigest()
    assert planted


def test_queries_of_counts_and_alignment(spark, sf_dir, plain):
    docs = [(r["doc_id"], r["text"]) for r in docs_of(spark, sf_dir).select("doc_id", "text").collect()]
    counts = {r["doc_id"]: tuple(r) for r in queries.op11_token_counts(spark, sf_dir).collect()}
    for i, t in docs:
        n = len(plain[0].encode(t or "", add_special_tokens=False).ids)
        assert counts[i] == (i, len((t or "").encode()), n, n > 1024)
    got = sorted(map(tuple, queries.op12_fragment_alignment(spark, sf_dir).collect()))
    assert got == sorted(aligned_rows(docs, plain)[0])


def test_an_even_mix_reads_and_shuffles_its_texts_once(spark, tmp_path):
    from factsieve.llm import mixing

    rows = [(i, "word " * (i % 40 + 1), "abc"[i % 3]) for i in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        mixed = mixing.mix(docs)
        plan = mixed._jdf.queryExecution().executedPlan().toString()
        assert plan.count(f"{tmp_path}/docs") == 1, plan
        got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
        # ids that repeat go the longer way, with the same numbers per id and size
        twice = docs.unionByName(docs.where("doc_id < 50")).unionByName(docs.where("doc_id < 20"))
        want = {r.doc_id: r.n for r in mixing.mix_plan(twice).groupBy("doc_id").agg(F.sum("repeats").alias("n")).where("n > 0").collect()}
        uneven = {r.doc_id: r["count"] for r in mixing.mix(twice).groupBy("doc_id").count().collect()}
        held_ids, mixing.BROADCAST_IDS = mixing.BROADCAST_IDS, 0
        try:
            joined = {r.doc_id: r["count"] for r in mixing.mix(twice).groupBy("doc_id").count().collect()}
        finally:
            mixing.BROADCAST_IDS = held_ids
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert got == {r.doc_id: r.repeats for r in mixing.mix_plan(docs).where("repeats > 0").collect()}
    assert uneven == want == joined and any(want[i] % 2 for i in want if 20 <= i < 50)


def test_stored_tables_leave_no_shuffle_files(spark):
    import glob
    import tempfile
    import time

    from factsieve.llm.store import CLEANUP, Scratch

    def files():
        return set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))

    before, held = files(), spark.conf.get(CLEANUP)
    stored = Scratch(spark, "test").table(spark.range(1000).repartition(4, "id"), "rows")
    for _ in range(50):  # they are deleted in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert stored.count() == 1000 and spark.conf.get(CLEANUP) == held


def test_packing_ids_takes_a_byte_per_bit():
    import tracemalloc

    from factsieve.llm import token_output

    ids = np.random.default_rng(5).integers(0, 1 << 15, 1 << 16).astype("<u4")
    tracemalloc.start()
    blocks = token_output.encode_blocks(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000
    starts = np.concatenate([[0], np.cumsum([len(b) for b in blocks])[:-1]])
    assert np.array_equal(token_output.decode_blocks(b"".join(blocks), starts, token_output.BLOCK), ids)


def test_links_that_are_stars_take_no_round(spark, monkeypatch):
    """Rounds are for what is not yet a star, and tables of ids for few files, however many partitions there are."""
    from factsieve.llm.graph import components
    from factsieve.llm.store import Scratch

    made, plain = [], Scratch.table

    def table(self, df, name):
        stored = plain(self, df, name)
        made.append((name, sum(f.endswith(".parquet") for f in stored.inputFiles())))
        return stored

    monkeypatch.setattr(Scratch, "table", table)
    settings = {"spark.sql.shuffle.partitions": "320", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    held = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for links, rounds in (
            ([(10 * k + j, 10 * k) for k in range(60) for j in range(1, 6)], 0),
            ([], 0),
            ([(i, i + 1) for i in range(100, 130)] + [(2, 2), (None, 4)], None),
        ):
            made.clear()
            got = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"))
            found = {r.node: r.root for r in got.collect()}
            if rounds is None:
                assert found == {i: 100 for i in range(101, 131)}
            else:
                assert found == dict(links)
                assert [name for name, _ in made] == ["edges"]
            assert max(n for _, n in made) <= 40
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_stages_of_the_pipeline_bound_what_goes_to_python(spark, rows):
    import corpus_pipeline
    import pyarrow as pa

    from factsieve.llm import quality
    from factsieve.llm.store import BATCH_BYTES

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.createDataFrame([(i, "some words " * 200, "s") for i in range(6000)], "doc_id long, text string, source string")
    docs = docs.coalesce(1)
    before = spark.conf.get(BATCH_BYTES, None)
    try:
        for name, stage in corpus_pipeline.STAGES[3:]:
            spark.conf.unset(BATCH_BYTES)
            stage(spark, docs, "")
            most = max(r.n for r in docs.mapInArrow(sizes, "n long").collect())
            assert most < 5_000_000, (name, most)  # 13 MB in all
        spark.conf.set(BATCH_BYTES, "1000000")
        corpus_pipeline.STAGES[-1][1](spark, docs, "")
        assert spark.conf.get(BATCH_BYTES) == "1000000"
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)
    # the text goes to the votes once
    model = quality.fit_counts(np.zeros((0, quality.TERMS), np.float32), np.zeros(0))
    plan = quality.score(docs, model)._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(" not in plan.split("MapInArrow")[1], plan
    assert quality.score(docs.limit(3), model).columns == ["doc_id", "text", "source", "score", "predicted"]
