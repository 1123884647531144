"""Token ids of whole texts with a public tokenizer file, through the tokenizers library.

A long corpus repeats its words, so a text is cut where its pre-tokenizer is known to cut
(single blanks and line ends), each distinct piece is encoded once per worker, and ids are
gathered by index. Texts with any other white space, or that could hold a special token,
are encoded whole; both ways give the ids of ``Tokenizer.encode(text)``. A column of texts is cut
by Arrow, and only its distinct words become Python objects.
"""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import batched, chain, compress
from unicodedata import is_normalized, normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces a worker holds before it starts afresh; this bounds its memory, not the result.
MOST_PIECES = 1_200_000
MOST_HELD_IDS = 16_000_000
MARKS = frozenset(".,;:!?")


def _byte_letters() -> np.ndarray:
    """How byte-level vocabularies spell a byte: printable ones as themselves, the others, in order, from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    letters = np.arange(256, dtype="<u2")
    hidden = [b for b in range(256) if b not in shown]
    letters[hidden] = 256 + np.arange(len(hidden))
    return letters


BYTE_LETTERS = _byte_letters()
LINE_END = chr(BYTE_LETTERS[10])


def spelled(pieces: Sequence[str]) -> list[str]:
    """The pieces, none of which holds a line end, as byte-level vocabularies spell them."""
    if not pieces:
        return []
    joined = np.frombuffer("\n".join(pieces).encode(), np.uint8)
    return BYTE_LETTERS[joined].tobytes().decode("utf-16-le").split(LINE_END)


#: White space other than blanks and line ends (a fixed value of Unicode).
_OTHER_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "<|")
#: The same as one expression of RE2, for columns: texts in which it is found are not cut.
_UNCUT = r"\A[ \n]|[ \n]\z|[ \n]{2}|<\||[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ANY_SPACE = re.compile(r"[\x1c-\x1f]|<\|")


def distinct_words(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct words of a column in which none holds a blank, and the place among them of each word."""
    if not len(words):
        return [], np.empty(0, np.int32)
    coded = words.dictionary_encode()
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), " ")
    return joined[0].as_py().split(" "), coded.indices.to_numpy()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Index(dict):
    """Piece to number; an unknown piece gets the next number and waits to be encoded.

    Both kinds of tokenizer cut between letters and a mark that follows them, so a word with one
    mark at its end is put together from the word and the mark.
    """

    def __init__(self, codec: "PieceCodec", lead: str):
        self.codec, self.lead = codec, lead

    def __missing__(self, piece: str) -> int:
        codec = self.codec
        if piece.isalpha() and (piece.isascii() or codec.plain(piece)):
            number = codec.count
            codec.count = number + 1
            codec.runs.append((number, self.lead + piece))
        elif piece[-1:] in MARKS and piece[:-1].isalpha():
            number = codec.add(codec.marked, (self[piece[:-1]], codec.first[piece[-1]]))
        else:
            number = codec.add(codec.others, self.lead + piece)
        self[piece] = number
        return number


class PieceCodec:
    """``kind`` is ``"blank"`` for byte-level tokenizers that keep blanks, ``"word"`` for those that lower case and drop white space."""

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.model = self.tokenizer.model
        # Each piece is encoded once, so the model's own cache of words would only cost time.
        self.model._resize_cache(0)
        self.clear()

    def clear(self) -> None:
        self.first, self.after = _Index(self, ""), _Index(self, " ")
        # What waits to be encoded, with its number: runs of letters, words with a mark (as the numbers of both), and all else.
        self.runs, self.marked, self.others = [], [], []
        self.count = 0
        self.ids = np.empty(0, np.uint32)
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, waiting: list, piece: str | tuple[int, int]) -> int:
        number = self.count
        waiting.append((number, piece))
        self.count = number + 1
        return number

    def plain(self, piece: str) -> bool:
        """Whether the tokenizer's normaliser leaves a run of letters as it is."""
        return self.kind == "blank" or is_normalized("NFC", piece) and piece == piece.lower()

    def _regular(self, text: str) -> bool:
        """Whether white space is single blanks and line ends inside the text."""
        return text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in _UNEVEN) and not _OTHER_SPACE.search(text)

    def _encode_waiting(self) -> None:
        if self.count == len(self.starts):
            return
        grown = self.count - len(self.starts)
        self.starts, self.lengths = np.concatenate([self.starts, np.zeros(grown, np.int64)]), np.concatenate([self.lengths, np.zeros(grown, np.int64)])
        # A run of letters is one word of the model, its bytes spelled as the vocabulary has them.
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(word)] for word in spelled([p for _, p in self.runs])]
        found += self._whole([p for _, p in self.others])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        new = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        self._hold([n for n, _ in self.runs] + [n for n, _ in self.others], lengths, new)
        parts = np.array([p for _, p in self.marked], np.int64).reshape(-1, 2)
        self._hold([n for n, _ in self.marked], self.lengths[parts].sum(1), self._gather(parts.reshape(-1)))
        self.runs, self.marked, self.others = [], [], []

    def _whole(self, pieces: list[str]) -> Iterator[list[int]]:
        """The ids of each; short ones are encoded together, as what the tokenizer says of them is held at once."""
        for some in batched(pieces, 64):
            if sum(map(len, some)) < 1 << 16:
                yield from (e.ids for e in self.tokenizer.encode_batch_fast(list(some), add_special_tokens=False))
            else:
                yield from (self.tokenizer.encode(p, add_special_tokens=False).ids for p in some)

    def _hold(self, numbers: list[int], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.starts[numbers] = len(self.ids) + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.ids = np.concatenate([self.ids, ids])

    def _gather(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the pieces, one after the other."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        places = np.repeat(self.starts[numbers] - ends + lengths, lengths)
        places += np.arange(len(places))
        return self.ids[places]

    def _pieces(self, text: str) -> Iterable[int]:
        if self.kind == "word":
            if _ANY_SPACE.search(text):
                return [self.add(self.others, text)]
            if text.isascii():
                return map(self.first.__getitem__, text.lower().split())
            # The tokenizer composes, then lower-cases letter by letter: a capital sigma must not look at its neighbours.
            lower = normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
            return map(self.first.__getitem__, lower.split()) if is_normalized("NFC", lower) else [self.add(self.others, text)]
        if not text or not self._regular(text):
            return [self.add(self.others, text)]
        numbers: list[int] = []
        for n, line in enumerate(text.split("\n")):
            if n:
                numbers.append(self.first["\n"])
            head, *tail = line.split(" ")
            numbers.append(self.first[head])
            numbers += map(self.after.__getitem__, tail)
        return numbers

    def _pieces_of_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the pieces of all texts, and how many each text has."""
        texts = pc.fill_null(texts, "")
        whole = pc.or_(pc.equal(pc.binary_length(texts), 0), pc.match_substring_regex(texts, _UNCUT))
        # No blank is beside another or a line end, so each line end becomes a word of its own.
        lines = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(whole)), "\n", " \n "), " ")
        whole, counts = whole.to_numpy(zero_copy_only=False), np.ones(len(texts), np.int64)
        counts[~whole] = pc.list_value_length(lines).to_numpy()
        words, places = distinct_words(lines.flatten())
        line_end = places == (words.index("\n") if "\n" in words else -1)
        leads = line_end.copy()
        leads[1:] |= line_end[:-1]
        cut = counts[~whole]
        leads[np.cumsum(cut) - cut] = True
        numbers = np.empty(len(places), np.int32)
        for index, chosen in ((self.first, leads), (self.after, ~leads)):
            used = np.zeros(len(words), bool)
            used[places[chosen]] = True
            number = np.zeros(len(words), np.int32)
            number[used] = np.fromiter(map(index.__getitem__, compress(words, used.tolist())), np.int32, int(used.sum()))
            numbers[chosen] = number[places[chosen]]
        found, single = np.empty(int(counts.sum()), np.int32), (np.cumsum(counts) - counts)[whole]
        rest = np.ones(len(found), bool)
        rest[single] = False
        found[rest] = numbers
        found[single] = [self.add(self.others, text) for text in texts.filter(pa.array(whole)).to_pylist()]
        return found, counts

    def encode(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other (a null is an empty text), and how many each has."""
        # Many short-lived lists and no cycles: the collector would only walk the held pieces.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: Sequence[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.count > MOST_PIECES or len(self.ids) > MOST_HELD_IDS:
            self.clear()
        ends = np.empty(len(texts) + 1, np.int64)
        ends[0] = 0
        if isinstance(texts, pa.Array) and self.kind == "blank":
            index, counts = self._pieces_of_column(texts)
            ends[1:] = np.cumsum(counts)
        else:
            numbers: list[int] = []
            for n, text in enumerate(texts.to_pylist() if isinstance(texts, pa.Array) else texts):
                numbers += self._pieces(text or "")
                ends[n + 1] = len(numbers)
            index = np.fromiter(numbers, np.int32, len(numbers))
        self._encode_waiting()
        total = np.concatenate([[0], np.cumsum(self.lengths[index])])
        return self._gather(index), np.diff(total[ends])


_codecs: dict[tuple[str, str], PieceCodec] = {}


def codec(path: str, kind: str) -> PieceCodec:
    """One codec per worker process and tokenizer file; tasks of the same worker share its pieces."""
    if (path, kind) not in _codecs:
        _codecs[path, kind] = PieceCodec(path, kind)
    return _codecs[path, kind]
