"""Jaccard self-join on word shingles by prefixes under several global token orders.

If two sets link (intersection >= t * union), then under *any* order of all tokens the
first ``n - ceil(t * n) + 1`` tokens of both, their prefixes, have a token in common. The
job uses three orders. In each, tokens that many documents hold come last; they differ in
how the others follow each other.

1. One pass counts tokens in blocks of a task to learn which are common. Only tokens that
   a block holds in several sets are passed on, and the most frequent of them, up to a fixed
   number, are known from then on. Any weights give a right result, but the more tokens of
   several documents come last, the fewer pairs meet.
2. Equal sets form one class, found by a 128-bit sum over the set.
3. Prefix tokens of the classes are range-partitioned and sorted by token and place in the
   prefix, and each range is streamed once: a token that only one class has goes no further,
   all others form a list whose first member, with the fewest tokens before this one, is
   its *hub*. Ranges are cut by place and class too, so a token of very many classes is spread;
   the lists at the ends of the ranges are put together afterwards.
4. Each class is paired with the hub it meets in most lists. A pair goes on if the prefixes
   share as many tokens as a link needs under the first order and one under the second and
   third as well; only then the texts are joined to it and the sets compared exactly.
5. Links found give components. A pair is looked for in the list of the first token it
   shares; all it can share stands from there on in both sets, so a member with many tokens before
   that one finds no partner there, and leaves the list. The first member is the
   likeliest partner of all: whoever cannot link with it for its place cannot with any other.
   Lists that still hold several components are given further hubs once, and those that
   hold several after that are joined with themselves: pairs across components (never
   within one) that fit in size and in place on both sides, and whose sketches of 256 bits,
   each the parity of the tokens that fall on it, differ in no more bits than the sets of a
   link can differ in tokens.
   After that no link between different components can be left.

So a group of thousands of copies that resemble each other costs about a pair per member,
and yet each component is complete. Hashes have 64 bits.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.graph import components
from factsieve.llm.store import Scratch, only, text_bytes
from factsieve.llm.words import mix, row_sets, shingle_hashes, some_rows, word_hashes

# Tokens counted together in a task.
BLOCK = 1 << 20
# Common tokens that are known; bounds what is collected and broadcast (nine bytes per token).
COMMON = 1 << 20
# Parities of a set, eight bytes each.
SKETCH = ["s0", "s1", "s2", "s3"]
# Rows of up to so many ids are picked by a broadcast set, of more by a join.
BROADCAST_IDS = 1_000_000
# Hubs per list in the second round.
MORE_HUBS = 4


def _sets(column: pa.Array, n: int) -> list[np.ndarray]:
    return row_sets(*shingle_hashes(*word_hashes(column), n))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def sketch(hashes: np.ndarray) -> np.ndarray:
    """256 parities: two sets differ in at least as many tokens as these differ in bits."""
    odd = np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _levels(tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The logarithm of each token's count; 0 for those that are not among the common ones."""
    known, levels = common
    if not len(known):
        return np.zeros(len(tokens), np.uint8)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    return np.where(known[at] == tokens, levels[at], np.uint8(0))


def in_order(tokens: np.ndarray, common: tuple[np.ndarray, np.ndarray], order: int, count: int) -> np.ndarray:
    """The first ``count`` tokens of a set under one of the global orders."""
    rank = tokens if order == 0 else mix(tokens + np.uint64(order))
    by = np.lexsort((rank, _levels(tokens, common)))
    return tokens[by[:count]]


def _common_tokens(docs: DataFrame, text: str, n: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens found in several sets, sorted, and the logarithms of their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # equal sets of a block count once
        block: dict[tuple[int, int], np.ndarray] = {}
        held = 0

        def repeated() -> pa.RecordBatch:
            tokens, times = np.unique(np.concatenate(list(block.values())), return_counts=True)
            several = times > 1
            columns = [pa.array(tokens[several].view(np.int64)), pa.array(times[several])]
            return pa.RecordBatch.from_arrays(columns, ["token", "n"])

        for batch in some_rows(batches, 0):
            for s in _sets(batch.column(0), n):
                if block.setdefault((len(s), int(s.sum(dtype=np.uint64))), s) is s:
                    held += len(s)
                if held >= BLOCK:
                    yield repeated()
                    block, held = {}, 0
        if held:
            yield repeated()

    rows = docs.select(text_bytes(text)).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = scratch.slim(rows.select("token", F.length(F.bin("n")).alias("level")), "common")
    # the most frequent ones that are not too many, by whole levels
    most, least = 0, 65
    for r in sorted(found.groupBy("level").count().collect(), reverse=True):
        most += r["count"]
        if most > COMMON:
            break
        least = r["level"]
    known = found.where(F.col("level") >= least).toArrow()
    scratch.drop(found)
    tokens = known.column("token").to_numpy().view(np.uint64)
    by = np.argsort(tokens)
    return tokens[by], known.column("level").to_numpy()[by].astype(np.uint8)


def _profiles(docs: DataFrame, id_col: str, text: str, n: int, num: int, den: int, weights) -> DataFrame:
    """Per row: set size, fingerprint of the set; prefix under the first order and sketch."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        common = weights.value
        for batch in some_rows(batches, 1):
            sets = _sets(batch.column(1), n)
            size = np.array([len(s) for s in sets], np.int64)
            hashes = [mix(s) for s in sets]
            f1 = np.array([h.sum(dtype=np.uint64) for h in hashes], np.uint64).view(np.int64)
            f2 = np.array([mix(s ^ np.uint64(0xA5A5)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            prefixes, bits = [], np.zeros((len(sets), len(SKETCH)), np.int64)
            named = batch.column(0).is_valid().to_pylist()
            keys = zip(f1.tolist(), f2.tolist(), strict=True)
            for i, (s, key, ok) in enumerate(zip(sets, keys, named, strict=True)):
                # of equal sets in one task one prefix is enough
                if not len(s) or not ok or key in seen:
                    prefixes.append(None)
                    continue
                seen.add(key)
                prefixes.append(in_order(s, common, 0, prefix_length(len(s), num, den)).view(np.int64))
                bits[i] = sketch(hashes[i])
            columns = [batch.column(0), pa.array(size), pa.array(f1), pa.array(f2), pa.array(prefixes, pa.list_(pa.int64()))]
            columns += [pa.array(np.ascontiguousarray(b)) for b in bits.T]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "f1", "f2", "prefix", *SKETCH])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text).alias("text"))
    columns = ", ".join(["id long, n long, f1 long, f2 long, prefix array<long>", *[f"{s} long" for s in SKETCH]])
    return rows.mapInArrow(profile, columns)


def _lists(tokens: DataFrame, scratch: Scratch) -> DataFrame:
    """``token, place, id, n, hub`` of every token that several ids have; the hub is the first of them by place."""
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["token", "place", "id", "n", "hub"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[np.ndarray], hub, border):
            columns = [pa.array(c) for c in (*rows, hub, np.full(len(hub), border))]
            return pa.RecordBatch.from_arrays(columns, [*names, "border"])

        held = None  # the last row so far, the hub of its list, whether it has company
        first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(c).to_numpy() for c in names[:4]]
            if first is None:
                first = rows[0][0]
            if held is not None:
                rows = [np.append(h, c) for h, c in zip(held[0], rows, strict=True)]
            token, id_ = rows[0], rows[2]
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(token)))
            hub, company = np.repeat(id_[begin], size), np.repeat(size > 1, size)
            if held is not None:
                hub[: size[0]] = held[1]
                company[: size[0]] |= held[2]
            held = ([c[-1] for c in rows], hub[-1], company[-1])
            edge = token == first
            keep = company & ~edge
            keep[-1] = edge[-1] = False
            yield out([c[keep] for c in rows], hub[keep], False)
            yield out([c[edge] for c in rows], hub[edge], True)
        if held is not None:
            yield out([np.array([x]) for x in held[0]], np.array([held[1]]), True)

    ranged = tokens.select(*names[:4]).repartitionByRange(parts, "token", "place", "id")
    ranged = ranged.sortWithinPartitions("token", "place", "id")
    found = scratch.table(ranged.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", border boolean"), "lists")
    # The first list of a range and its last row may belong to a list of its neighbours:
    # whoever shares a token with them, there or here, gets one hub for all.
    edges = found.where("border").select(*names)
    known = found.where("not border").join(edges.select("token").distinct(), "token", "left_semi")
    hubs = edges.union(known.select(*names)).groupBy("token").agg(
        F.min(F.struct("place", "id"))["id"].alias("start"), F.min("id").alias("least"), F.max("id").alias("most")
    )
    late = edges.drop("hub").join(hubs.where("least <> most"), "token").select(*names[:4], F.col("start").alias("hub"))
    return scratch.slim(found.where("not border").select(*names).union(late), "met")


def bounded(ids: DataFrame) -> DataFrame:
    """A stored table of ids for a join; up to a million are broadcast, so that the other side stays where it is."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


class _Candidates:
    """The filters between a candidate pair and the exact comparison."""

    def __init__(self, docs, id_col, text, n, num, den, weights, scratch):
        self.texts = docs.select(
            F.col(f"`{id_col}`").cast("long").alias("id"), text_bytes(text).alias("text")
        ).where("id is not null")
        self.n, self.num, self.den, self.weights, self.scratch = n, num, den, weights, scratch

    def _texts_of(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct()
        ids = self.scratch.slim(ids, "ids")
        found = texts.join(bounded(ids), F.col("id") == F.col("i"), "left_semi")
        kept = self.scratch.table(found, "texts")
        self.scratch.drop(ids)
        return kept

    def _filter(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Pairs whose prefixes share enough tokens under the first order and one under each other.

        Of two prefixes one ends first; common tokens that are not in both prefixes stand
        behind it, so there are no more of them than that set has tokens behind its prefix.
        """
        n, num, den, weights = self.n, self.num, self.den, self.weights

        def prefixes(batches):
            common = weights.value
            for batch in some_rows(batches, 1):
                sets = _sets(batch.column(1), n)
                size = [len(s) for s in sets]
                cut = [[in_order(s, common, k, prefix_length(len(s), num, den)) for s in sets] for k in range(3)]
                # 32 bits of a token are enough to count, with those that look alike added to what is shared;
                # 16 bits are where one is to be shared: tokens that only look alike let a pair pass
                counted = [np.unique((mix(s) >> np.uint64(32)).astype(np.uint32).view(np.int32)) for s in cut[0]]
                alike = [len(s) - len(c) for s, c in zip(cut[0], counted, strict=True)]
                short = [[(mix(s) >> np.uint64(48)).astype(np.uint16).view(np.int16) for s in c] for c in cut[1:]]
                columns = [
                    batch.column(0), pa.array(size, pa.int64()), pa.array(alike, pa.int64()),
                    pa.array(counted, pa.list_(pa.int32())), *[pa.array(c, pa.list_(pa.int16())) for c in short],
                ]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n", "alike", "p1", "p2", "p3"])

        info = texts.mapInArrow(prefixes, "id long, n long, alike long, p1 array<int>, p2 array<short>, p3 array<short>")
        info = self.scratch.table(info, "prefixes")

        def with_both(pairs: DataFrame, names: tuple[str, ...]) -> DataFrame:
            for side in ("a", "b"):
                pairs = pairs.join(info.select(F.col("id").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in names]), side)
            return pairs

        fit = f"a_n * {num} <= b_n * {den} and b_n * {num} <= a_n * {den}"
        shared = F.size(F.array_intersect("a_p1", "b_p1")) + F.col("a_alike") + F.col("b_alike")
        most = shared + F.ceil(F.greatest("a_n", "b_n") * num / den) - 1
        some = with_both(pairs, ("n", "alike", "p1")).where(fit)
        some = some.where(most * (num + den) >= num * (F.col("a_n") + F.col("b_n"))).select("a", "b").distinct()
        # what few pairs are left is held against the other orders
        some = self.scratch.slim(some, "counted")
        kept = with_both(some, ("p2", "p3")).where("arrays_overlap(a_p2, b_p2) and arrays_overlap(a_p3, b_p3)")
        kept = self.scratch.slim(kept.select("a", "b").distinct(), "filtered")
        self.scratch.drop(info, some)
        return kept

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link, by exact comparison of whole texts."""
        n, num, den = self.n, self.num, self.den
        pairs = self.scratch.table(pairs, "pairs")
        near = self._texts_of(pairs, self.texts)
        pairs = self._filter(pairs, near)
        # both sides shuffle the texts, so those of pairs that were dropped go first
        texts = self._texts_of(pairs, near)
        self.scratch.drop(near)

        def verify(batches):
            for batch in some_rows(batches, 2):
                # each different text of the second side is cut into words once
                texts_b = batch.column("b_text").dictionary_encode()
                right = _sets(texts_b.dictionary, n)
                left = _sets(batch.column("a_text"), n)
                good = []
                for x, i in zip(left, texts_b.indices.to_pylist(), strict=True):
                    both = len(np.intersect1d(x, right[i], assume_unique=True))
                    good.append(den * both >= num * (len(x) + len(right[i]) - both) and both > 0)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
        both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
        found = both.select("a", "b", "a_text", "b_text").mapInArrow(verify, "a long, b long")
        found = self.scratch.table(found, "links")
        self.scratch.drop(pairs, texts)
        return found


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    num: int = 4,
    den: int = 5,
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row; links at ``num / den`` or more.

    A null or empty text has no shingle and its own component; rows with fewer than ``n``
    words have one shingle. A null id is never linked and gets a null component. Rows that
    repeat an id count as one document that links through any of its texts. Other columns
    are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = only(docs, [id_col, text_col])
    weights = spark.sparkContext.broadcast(_common_tokens(docs, text_col, n, scratch))
    rows = scratch.table(_profiles(docs, id_col, text_col, n, num, den, weights), "profiles")

    real = rows.where("n > 0 and id is not null")
    classes = scratch.slim(
        real.groupBy("f1", "f2").agg(
            F.min("id").alias("rep"), F.min(F.expr("if(prefix is null, null, id)")).alias("carrier")
        ),
        "classes",
    )
    # One id carries the prefix of its class. Copies in other tasks have one as well, but are few, so
    # that prefixes are read past them instead of being shuffled.
    with_prefix = real.where("prefix is not null")
    others = with_prefix.select("id", "f1", "f2").join(classes.select("f1", "f2", "carrier"), ["f1", "f2"])
    others = scratch.slim(others.where("id <> carrier").select("id", "f1", "f2").distinct(), "others")
    carried = with_prefix.join(bounded(others), ["id", "f1", "f2"], "left_anti")
    prefix = carried.select("id", "n", F.posexplode("prefix").alias("place", "token"))
    lists = _lists(prefix.withColumn("place", F.col("place").cast("long")), scratch)
    # an id with several texts has no sketch, and passes
    sketches = carried.groupBy("id").agg(F.min(F.struct(*SKETCH)).alias("x"), F.max(F.struct(*SKETCH)).alias("y"))
    sketches = scratch.slim(sketches.where("x = y").select("id", "x.*"), "sketches")
    slim = scratch.table(rows.drop("prefix", *SKETCH), "rows")
    sizes = rows.where("prefix is not null").groupBy("id").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    sizes = scratch.slim(sizes, "sizes")
    scratch.drop(rows, others)

    met = lists.where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("times"))
    best = met.groupBy("id").agg(F.max(F.struct("times", "hub")).alias("best"))
    best = best.select(F.col("id").alias("a"), F.col("best.hub").alias("b"), F.col("best.times").alias("shared"))
    for side in ("a", "b"):
        best = best.join(sizes.toDF(side, f"{side}_least", f"{side}_most"), side)
    # what a member shares with its hub in other lists is not counted; such a pair comes up again below
    behind = f"ceil(greatest(a_most, b_most) * {num} / {den}) - 1"
    fit = f"a_least * {num} <= b_most * {den} and b_least * {num} <= a_most * {den}"
    enough = f"(shared + {behind}) * {num + den} >= {num} * (a_least + b_least) and {fit}"
    pairs = scratch.slim(best.where(enough).select("a", "b"), "hubs")
    candidates = _Candidates(docs, id_col, text_col, n, num, den, weights, scratch)
    roots = components(candidates.links(pairs), scratch)

    # Two sets whose first common token is this one share at most what each has from it on, so
    # a partner has at most ``reach`` tokens.
    reach = F.floor((num + den) * (F.col("n") - F.col("place")) / num) - F.col("n")
    placed = lists.select("token", "id", "n", reach.alias("reach"))

    def open_lists(roots: DataFrame) -> DataFrame:
        """Lists of several components, without members whom no other one can reach."""
        named = placed.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        named = scratch.slim(named.withColumn("root", F.coalesce("root", "id")), "named")
        bounds = named.groupBy("token").agg(
            F.min("n").alias("least"), F.max("reach").alias("far"), F.min("root").alias("x"), F.max("root").alias("y")
        )
        alive = named.join(bounds.where("x <> y").drop("x", "y"), "token").where("least <= reach and n <= far")
        alive = scratch.slim(alive.drop("least", "far"), "alive")
        several = alive.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
        still = scratch.slim(alive.join(several.select("token"), "token", "left_semi"), "open")
        scratch.drop(named, alive)
        return still

    def untried(new: DataFrame, tried: DataFrame) -> DataFrame:
        one_way = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return new.select(*one_way).distinct().join(tried.select(*one_way).distinct(), ["a", "b"], "left_anti")

    fits = "root <> root_2 and n <= reach_2 and n_2 <= reach"
    # Once more with other hubs, for members that have too little in common with the first:
    # a few per list by different hashes, where several components are left.
    left = open_lists(roots)
    member = F.struct("id", "root", "n", "reach")
    others = left.groupBy("token").agg(
        *[F.min_by(member, F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in range(MORE_HUBS)]
    )
    hubs = F.explode(F.array_distinct(F.array(*[F.col(f"h{k}") for k in range(MORE_HUBS)]))).alias("h")
    others = others.select("token", hubs).select("token", *[F.col(f"h.{c}").alias(f"{c}_2") for c in ("id", "root", "n", "reach")])
    again = left.join(others, "token").where(fits).select(F.col("id").alias("a"), F.col("id_2").alias("b"))
    again = scratch.slim(untried(again, pairs), "hubs")
    # the stars so far stand for their links
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(stars.union(candidates.links(again)), scratch)
    scratch.drop(left)
    pairs = pairs.union(again)

    left = open_lists(roots)
    scratch.drop(lists)
    left = scratch.slim(left.join(sketches, "id", "left"), "sketched")
    other = left.select("token", *[F.col(c).alias(f"{c}_2") for c in ("id", "root", "n", "reach", *SKETCH)])
    apart = " + ".join(f"bit_count({s} ^ {s}_2)" for s in SKETCH)
    alike = f"coalesce(({apart}) * {num + den} <= {den - num} * (n + n_2), true)"
    across = left.join(other, "token").where(f"{fits} and root < root_2 and {alike}")
    across = across.select(F.col("id").alias("a"), F.col("id_2").alias("b"))
    more = candidates.links(untried(across, pairs))
    joined = more.union(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    # An id with several texts is one document: its classes belong together.
    real = slim.where("n > 0 and id is not null")
    texts_of = real.groupBy("id").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y"))
    several = real.join(texts_of.where("x <> y").select("id"), "id", "left_semi").select("id", "f1", "f2").distinct()
    joined = joined.select("a", "b").union(
        several.join(classes, ["f1", "f2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    )
    # Members of a class hang on the id that carried its prefix.
    of_class = classes.select("rep", "carrier").where("rep <> carrier").select(
        F.col("rep").alias("a"), F.col("carrier").alias("b")
    )
    roots = components(joined.select("a", "b").union(of_class), scratch)
    named = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "f1", "f2", F.coalesce("root", "rep").alias("root")
    )
    named = scratch.slim(named, "named")
    return (
        slim.select("id", "n", "f1", "f2")
        .join(named, ["f1", "f2"], "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("root"))).otherwise(F.col("id")).alias("component_id"),
        )
    )
