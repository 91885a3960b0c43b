"""Token ids of many texts with a public tokenizer, as little-endian 32-bit bytes.

Neither kind of tokenizer merges across a single blank that stands behind something other
than a blank and before a visible character: such a blank begins a new piece. So a text is
cut there, each different piece is encoded once per worker and the bytes of the pieces are
put together.
"""

import json
import re
from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
DEFAULT_PIECES = "piece_bpe_32k.model"
# Pieces of a generation that a worker keeps (it has two), and pieces encoded in one call.
KEPT_PIECES = 300_000
AT_ONCE = 500

# How the two vocabularies write a blank.
_BLANK, _WIDE_BLANK = "Ġ", "▁"
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
_encoders: dict[tuple, "Encoder | Pieces"] = {}


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Cut:
    """Texts as pieces joined by blanks; ``borders`` tell where the pieces of each text begin.

    ``number`` is the place of each piece in ``words``. A text with an odd blank has a list of its own in
    ``odd`` instead, and its pieces above count for nothing.
    """

    words: list[str]
    number: np.ndarray
    borders: np.ndarray
    odd: dict[int, list[str]]

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.borders) - 1), np.diff(self.borders))


def cut(texts: list[str], open_first: bool) -> Cut:
    """All pieces of some texts. ``open_first``: a blank goes before each text too, so its first piece is like the others."""
    lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
    found = lists.values.dictionary_encode()
    words, number = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
    borders = lists.offsets.to_numpy().astype(np.int64)
    first = pc.utf8_slice_codeunits(found.dictionary, 0, 1)
    strange = pc.or_(pc.equal(first, ""), pc.utf8_is_space(first)).to_numpy(zero_copy_only=False)
    odd = {}
    if strange.any():
        at = strange[number]
        if not open_first:
            at[borders[:-1]] = False
        rows = np.unique(np.searchsorted(borders, np.flatnonzero(at), "right") - 1)
        odd = {i: _CUT.split(texts[i]) for i in rows.tolist()}
    return Cut(words, number, borders, odd)


class Known:
    """What a worker knows of pieces: of the last ``kept`` met, and of those met before that."""

    def __init__(self, kept: int):
        self.kept = kept
        self.young: dict = {}
        self.old: dict = {}

    def missing(self, words: Iterable[str]) -> list[str]:
        """Which words are not known; the others are kept."""
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = [w for w in words if w not in young]
        young.update([(w, old[w]) for w in new if w in old])
        return [w for w in new if w not in old]


def _put_together(found: Cut, known: dict[str, bytes], firsts: list[bytes] | None) -> list[bytes]:
    """The ids of each text, with what its first piece has instead of the known ids, if given."""
    get = known.__getitem__
    values = list(map(get, found.words))
    size = np.fromiter(map(len, values), np.int64, len(values)) // 4
    flat = np.frombuffer(b"".join(values), "<u4")
    start = (np.cumsum(size) - size)[found.number]
    sizes = size[found.number]
    if firsts is not None:
        sizes[found.borders[:-1]] = 0
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = flat[np.repeat(start - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
    at = (4 * ends[found.borders]).tolist()
    out = [data[x:y] for x, y in zip(at, at[1:], strict=False)]
    for i, pieces in found.odd.items():
        out[i] = b"".join(map(get, pieces if firsts is None else pieces[1:]))
    return out if firsts is None else [f + o for f, o in zip(firsts, out, strict=True)]


def first_pieces(texts: list[str], found: Cut) -> list[str]:
    """The part of each text before its first cut."""
    return [found.odd[i][0] if i in found.odd else t.partition(" ")[0] for i, t in enumerate(texts)]


def apart(texts: list[str], signs: list[str], with_sign: Callable, without: Callable) -> list:
    """The results of one function for texts that contain a sign and of another for the rest, in order."""
    if not signs:
        return without(texts)
    far = [any(s in t for s in signs) for t in texts]
    plain = iter(with_sign([t for t, f in zip(texts, far, strict=True) if f]))
    rest = iter(without([t for t, f in zip(texts, far, strict=True) if not f]))
    return [next(plain) if f else next(rest) for f in far]


def together(pieces: list[str]) -> tuple[list[str], list[str]]:
    """(pieces that can be encoded joined by blanks, the others)."""
    alike = [p for p in pieces if p and " " not in p and not p[0].isspace()]
    return alike, [p for p in pieces if not p or " " in p or p[0].isspace()] if len(alike) < len(pieces) else []


class Encoder:
    """A tokenizer of the ``tokenizers`` library. ``plain``: special strings in a text are ordinary text."""

    def __init__(self, path: str, plain: bool = False, kept: int = KEPT_PIECES):
        from tokenizers import Tokenizer

        source = Path(path).read_text(encoding="utf-8")
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.encode_special_tokens = plain
        # piece without its blank -> ids with it
        self.known = Known(kept)
        vocab = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for token, i in vocab.items() if token.startswith(_BLANK)]] = True
        added = [] if plain else json.loads(source).get("added_tokens") or []
        # A text with a special string that reaches over a blank is not cut.
        self.whole = [t["content"] for t in added if t["lstrip"] or t["rstrip"] or any(map(str.isspace, t["content"]))]

    def _bytes(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: Iterable[str]) -> None:
        """Ids of pieces with their blanks; several at a time, told apart by the one id of each that opens with a blank."""
        new = self.known.missing(words)
        alike, other = together(new)
        known = self.known.young
        for i in range(0, len(alike), AT_ONCE):
            some = alike[i : i + AT_ONCE]
            joined = self._bytes(" " + " ".join(some))
            starts = (np.flatnonzero(self.opens[np.frombuffer(joined, "<u4")]) * 4).tolist()
            if len(starts) != len(some):
                raise ValueError("the tokenizer does not open each word with a blank of its own")
            known.update(zip(some, [joined[a:b] for a, b in zip(starts, [*starts[1:], None], strict=True)], strict=True))
        for p in other:
            known[p] = self._bytes(" " + p)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Four bytes for each id of each text."""
        return apart(texts, self.whole, lambda some: list(map(self._bytes, some)), self._encode)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = cut(texts, open_first=False)
        self.learn(chain(found.words, *found.odd.values()))
        return _put_together(found, self.known.young, list(map(self._bytes, first_pieces(texts, found))))


class Pieces:
    """A sentencepiece model; it puts a blank before each text by itself."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known = Known(kept)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # words do not depend on their neighbours: no blank inside a piece, none dropped, one put in front
        cuttable = not any(_WIDE_BLANK in n.lstrip(_WIDE_BLANK) for n in names) and (
            "".join(self.model.encode("a  b", out_type=str)) == "▁a▁▁b"
        )
        # A text with what the model takes for a blank is not cut.
        self.whole = [_WIDE_BLANK] if cuttable else [""]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", ids).tobytes() for ids in self.model.encode(texts, num_threads=1)]

    def learn(self, words: Iterable[str]) -> None:
        new = self.known.missing(words)
        self.known.young.update(zip(new, self._plain(new), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Four bytes for each id of each text."""
        return apart(texts, self.whole, self._plain, self._encode)

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = cut(texts, open_first=True)
        self.learn(chain(found.words, *found.odd.values()))
        return _put_together(found, self.known.young, None)


def encoder(path: str, plain: bool = False, kept: int = KEPT_PIECES) -> Encoder | Pieces:
    """The worker's encoder of this file; kept between tasks."""
    key = path, plain, kept
    if key not in _encoders:
        _encoders[key] = Pieces(path, kept) if path.endswith(".model") else Encoder(path, plain, kept)
    return _encoders[key]
