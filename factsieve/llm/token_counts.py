"""Token counts of texts: batch encoding inside Arrow functions that returns lengths only.

A task takes its rows some megabytes at a time. Texts are cut at safe boundaries, single
blanks across which the tokenizer never merges (see ``tokens``); a long text goes through
in segments between such blanks, so its tokens are never held together. The different
pieces that a worker has not met yet are encoded in batches of about equal bytes and only
their lengths are kept; a text's count is the sum of the lengths of its pieces. It is one
map over the table, without a shuffle: a large file is divided by bytes by its scan.
"""

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factsieve.llm.store import share_code, text_of
from factsieve.llm.tokens import _CUT, KEPT_PIECES, Encoder, Known, Pieces, apart, cut, encoder, first_pieces, together, tokenizer_path
from factsieve.llm.words import buffer_of, some_rows

LIMIT = 1024
# Text of rows taken at once, of a segment, and of a batch that is encoded in one call: bytes, characters, characters.
ROWS_BYTES = 4 << 20
SEGMENT = 1 << 20
BATCH = 1 << 15
# Batches handed to the library at a time.
CALLS = 8
_counters: dict[str, "Counter"] = {}


def balanced(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of about equal sums, none much above ``most`` unless one item is."""
    if not len(sizes):
        return []
    ends = np.cumsum(sizes)
    n = max(1, -(-int(ends[-1]) // most))
    borders = np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, n + 1) / n) + 1).tolist()
    return list(zip([0, *borders[:-1]], borders, strict=True))


def segments(text: str, most: int = SEGMENT) -> Iterator[str]:
    """Parts that the text joins by blanks, each ended by the first safe blank after ``most`` characters."""
    at = 0
    while len(text) - at > most:
        found = _CUT.search(text, at + most)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


class Counter:
    """Numbers of tokens of one tokenizer; kept by a worker between tasks."""

    def __init__(self, path: str):
        self.encoder: Encoder | Pieces = encoder(path)
        self.known = Known(KEPT_PIECES)

    def _learn(self, words: Iterable[str]) -> None:
        pieces, known = self.known.missing(words), self.known.young
        if isinstance(self.encoder, Pieces):
            for a, b in balanced(np.fromiter(map(len, pieces), np.int64, len(pieces)), BATCH):
                found = self.encoder.model.encode(pieces[a:b], num_threads=1)
                known.update(zip(pieces[a:b], map(len, found), strict=True))
            return
        library, opens = self.encoder.tokenizer, self.encoder.opens
        alike, other = together(pieces)
        ranges = balanced(np.fromiter(map(len, alike), np.int64, len(alike)) + 1, BATCH)
        for i in range(0, len(ranges), CALLS):
            some = ranges[i : i + CALLS]
            joined = [" " + " ".join(alike[a:b]) for a, b in some]
            for (a, b), found in zip(some, library.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, np.int64)
                lengths = np.diff(np.append(np.flatnonzero(opens[ids]), len(ids))).tolist()
                known.update(zip(alike[a:b], lengths, strict=True))
        for p, found in zip(other, library.encode_batch_fast([" " + p for p in other], add_special_tokens=False), strict=True):
            known[p] = len(found.ids)

    def _plain(self, texts: list[str]) -> list[int]:
        """Each text encoded as it is."""
        if isinstance(self.encoder, Pieces):
            return list(map(len, self.encoder.model.encode(texts, num_threads=1)))
        return [len(f.ids) for f in self.encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, texts: list[str], begin: bool) -> list[int]:
        """Counts of parts: of whole texts or their beginnings, or of segments that follow a blank."""
        own_first = begin and isinstance(self.encoder, Encoder)
        found = cut(texts, open_first=not own_first)
        self._learn(chain(found.words, *found.odd.values()))
        get = self.known.young.__getitem__
        sizes = np.fromiter(map(get, found.words), np.int64, len(found.words))[found.number]
        if own_first:
            sizes[found.borders[:-1]] = 0
        sums = np.concatenate([[0], np.cumsum(sizes)])[found.borders]
        out = np.diff(sums).tolist()
        for i, pieces in found.odd.items():
            out[i] = sum(map(get, pieces[1:] if own_first else pieces))
        if own_first:
            return [n + f for n, f in zip(out, self._plain(first_pieces(texts, found)), strict=True)]
        return [n if t else 0 for n, t in zip(out, texts, strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        return apart(texts, self.encoder.whole, self._plain, self._count)

    def _count(self, texts: list[str]) -> list[int]:
        begins, later = [], []
        for i, text in enumerate(texts):
            first, *rest = segments(text)
            begins.append(first)
            later += [(i, s) for s in rest]
        out = self._parts(begins, True)
        for i, s in later:
            out[i] += self._parts([s], False)[0]
        return out


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    limit: int = LIMIT,
) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    ``tokenizer``: a ``.json`` of the tokenizers library or a ``.model`` of sentencepiece;
    nothing is added, cut off or padded, and special strings inside texts count as the
    library takes them by itself. A null or empty text has no bytes and no tokens. Ids may
    be null or repeat; every row is counted. Other columns are ignored. An empty table
    gives an empty result.
    """
    share_code(docs.sparkSession)
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in some_rows(batches, 1, ROWS_BYTES):
            texts = batch.column(1)
            numbers = np.array(count(texts.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(buffer_of(texts)[1])), pa.array(numbers), pa.array(numbers > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
