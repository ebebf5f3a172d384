"""Whole texts to token ids by a public byte-level vocabulary, a column of texts at a time.

The split pattern of these vocabularies always starts a new piece at a space that a non-space follows,
whatever stands before it. So texts may be cut there: Arrow numbers a column's distinct
pieces, each distinct piece is encoded once and cached, and the ids are gathered by number. The same
ids, at a fraction of the work on text with recurring words. The pattern also ends a piece where ASCII
letters end, where letters follow another visible ASCII character (an apostrophe may belong to them), and around a lone
line end or tab between visible ones. The cuts are found for a whole column at once on its bytes; where characters beyond
ASCII leave a cut in doubt there is none, and the longer piece goes to the library. New words go there
many at a time, straight to the merges.
"""

from __future__ import annotations

import os
import re
import string
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces kept by one worker, some 150 bytes each, in two halves: once the newer is full, the older goes.
CACHE_PIECES = 500_000
#: Bytes of text encoded at once; one longer text stands alone.
COLUMN_BYTES = 4_000_000
#: New words that go to the library in one call.
JOINED = 500

#: What a byte is: an ASCII letter; a digit or mark after which a letter starts a piece (an apostrophe may belong to it); a white space other than the
#: space; a visible ASCII character; the space; a byte that starts a character other than white space; a byte beyond ASCII.
_LETTER, _MARK, _END, _SEEN, _SPACE, _OPENS, _WIDE = 64, 1, 2, 4, 8, 16, 128
_KINDS = bytes(
    (_LETTER if chr(b) in string.ascii_letters else 0)
    | (_MARK if chr(b) in string.digits + string.punctuation and b != 39 else 0)
    | (_END if 9 <= b <= 13 else 0)
    | (_SEEN if 33 <= b <= 126 else 0)
    | (_SPACE if b == 32 else 0)
    | (_OPENS if 33 <= b <= 126 or (b >= 0xC3 and b not in (0xE1, 0xE2, 0xE3)) else 0)
    | (_WIDE if b >= 128 else 0)
    for b in range(256)
)
_OPENING = np.frombuffer(_KINDS, np.uint8) & _OPENS != 0


def id_type(size: int) -> str:
    """The narrowest numpy type for ids below `size`."""
    return "<u2" if size <= 1 << 16 else "<u4"


class PieceEncoder:
    """`encode_piece` gives the ids of any text, `encode_word(word, spaced)` those of letters alone, with or without a space before them."""

    def __init__(self, encode_piece: Callable[[str], Iterable[int]], encode_word: Callable[[str, bool], Iterable[int]], size: int, limit: int = CACHE_PIECES, added: dict[str, int] | None = None, encode_words: Callable[[list[str]], Iterable[bytes]] | None = None):
        """`added`: strings that the library takes for one id wherever a text holds them; texts are cut around them. `encode_words`: the packed ids of many spaced words at once."""
        self.encode_piece, self.encode_word, self.limit, self.dtype = encode_piece, encode_word, limit, np.dtype(id_type(size))
        self.added = added or {}
        self._cuts = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.size = size
        self.encode_words = encode_words or (lambda words: [self._pack(encode_word(w, True)) for w in words])
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.plain: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}  # by the piece without its leading space
        self.before: dict[str, bytes] = {}  # the last full `spaced`; what is met again goes on to the new one

    def _pack(self, ids: Iterable[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _kept(self, cached: dict[str, bytes], piece: str, packed: bytes) -> bytes:
        if len(piece) < 256:
            cached[piece] = packed
        return packed

    def _piece(self, piece: str, spaced: bool) -> bytes:
        """The ids of a piece as `_cut` leaves it, without its space where `spaced`."""
        cached = self.spaced if spaced else self.plain
        if (known := cached.get(piece)) is not None:
            return known
        if spaced and (known := self.before.get(piece)) is not None:
            return self._kept(cached, piece, known)
        if piece.isalpha():
            return self._kept(cached, piece, self._pack(self.encode_word(piece, spaced)))
        stem = piece.rstrip(string.punctuation)
        if stem.isalpha():  # letters beyond ASCII before marks
            return self._kept(cached, piece, self._piece(stem, spaced) + self._piece(piece[len(stem) :], False))
        return self._kept(cached, piece, self._pack(self.encode_piece(" " + piece if spaced else piece)))

    def _whole(self, text: str) -> bytes:
        """A text that holds an added string."""
        parts = self._cuts.split(text)
        return b"".join(self._pack([self.added[p]] if k % 2 else self.encode_piece(p)) for k, p in enumerate(parts) if p)

    def _cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, list[int]]:
        """All pieces of a column of texts, the place of each text's first with the number of all, and the texts that hold an added string, each one piece."""
        column = pc.fill_null(column, "").cast(pa.string())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
        raw = memoryview(data)[at[0] : at[-1]] if data is not None else memoryview(b"")
        at, kind = at - at[0], np.frombuffer(bytes(raw).translate(_KINDS), np.uint8)
        cut = np.zeros(len(kind) + 1, dtype=bool)
        if len(kind) > 1:
            left, right = kind[:-1], kind[1:]
            inner, letter = cut[1:-1], right & _LETTER != 0
            np.greater(left & _LETTER, right & _WIDE | right & _LETTER, out=inner)  # an ASCII letter before anything in ASCII that is none
            inner |= (left & _MARK != 0) & letter
            lone = (kind[1:-1] & _END != 0) & (kind[:-2] & _SEEN != 0) & (kind[2:] & _SEEN != 0)
            cut[1:-2] |= lone
            cut[2:-1] |= lone
            safe = (left & _SPACE != 0) & (right & _OPENS != 0)
            lasts = at[1:-1]
            safe[lasts[(lasts > 0) & (lasts < len(kind))] - 1] = False  # what follows is another text's
            cut[:-2] |= safe
        strange: set[int] = set()
        for a in self.added:
            strange.update(np.flatnonzero(pc.match_substring(column, a).to_numpy(zero_copy_only=False)).tolist())
        for i in strange:
            cut[at[i] : at[i + 1]] = False
        cut[at] = True
        starts = np.flatnonzero(cut).astype(np.int32)
        return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(raw)), np.searchsorted(starts, at), sorted(strange)

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, and where each text's ids begin, with the end of the last; a null text has none."""
        if len(self.spaced) + len(self.plain) > self.limit // 2:
            self.before, self.spaced, self.plain = self.spaced, {}, {}
        if not len(column):
            return np.zeros(0, self.dtype), np.zeros(1, np.int64)
        pieces, first, strange = self._cut(column)
        if not len(pieces):
            return np.zeros(0, self.dtype), np.zeros(len(column) + 1, np.int64)
        coded = pieces.dictionary_encode()
        index, names = coded.indices.to_numpy(), coded.dictionary
        # Spaced pieces first, without their space.
        sizes, (_, offsets, data) = pc.binary_length(names).to_numpy(), names.buffers()
        begins, letters = np.frombuffer(offsets, np.int32)[: len(names)], np.frombuffer(data, np.uint8)
        spaced = letters[begins] == 32
        spaced[spaced] = sizes[spaced] > 1
        two = np.flatnonzero(spaced)
        spaced[two] = _OPENING[letters[begins[two] + 1]]
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        listed = lambda some: some.to_numpy(zero_copy_only=False).tolist()
        words, others = listed(pc.utf8_slice_codeunits(names.filter(pa.array(spaced)), 1)), listed(names.filter(pa.array(~spaced)))
        held = {names[index[first[i]].item()].as_py() for i in strange}
        known, before, new, rest = self.spaced, self.before, [], []
        entries = list(map(known.get, words))
        for k in [k for k, packed in enumerate(entries) if packed is None]:
            w = words[k]
            if (packed := before.get(w)) is not None:
                known[w] = entries[k] = packed
            else:
                (new if w.isalpha() else rest).append(k)
        for k, packed in zip(new, self.encode_words([words[k] for k in new]), strict=True):
            entries[k] = self._kept(known, words[k], packed)
        for k in rest:
            entries[k] = self._whole(" " + words[k]) if held and " " + words[k] in held else self._piece(words[k], True)
        entries += [self._whole(w) if held and w in held else self._piece(w, False) for w in others]
        index = place[index]
        opening = index[first[:-1][first[:-1] < len(index)]]
        for k in np.unique(opening[opening >= len(words)]).tolist():  # a text's first word is met again after a space, as a rule
            if (w := others[k - len(words)]).isalpha():
                self._piece(w, True)
        sizes = np.fromiter(map(len, entries), np.int32, len(entries)) // self.dtype.itemsize
        table, lengths = np.frombuffer(b"".join(entries), dtype=self.dtype), sizes[index]
        reached = np.cumsum(lengths, dtype=np.int32)
        ids = table[np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[index] - (reached - lengths), lengths) + np.arange(reached[-1], dtype=np.int32)]
        return ids, np.append(np.int32(0), reached)[first].astype(np.int64)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, edges = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def by_bytes(frames: Iterator[pa.RecordBatch], column: str = "text", limit: int = COLUMN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of a text column, so that memory follows the slice; one longer text stands alone."""
    for b in frames:
        sizes = pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        edges = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // limit)) + 1).tolist(), b.num_rows]
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            if end > start:
                yield b.slice(start, end - start)


def with_end(ids: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with `end_id` after each text's, and the new edges."""
    moved = edges + np.arange(len(edges))
    out, own = np.empty(len(ids) + len(edges) - 1, dtype=ids.dtype), np.ones(len(ids) + len(edges) - 1, dtype=bool)
    own[moved[1:] - 1] = False
    out[own], out[~own] = ids, end_id
    return out, moved


def binary_column(ids: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Each text's ids as little-endian bytes."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * ids.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, the rest from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@cache
def vocabulary_size(vocabulary: str) -> int:
    return _tokenizer(vocabulary).get_vocab_size()


@cache
def rank_encoder(path: str, pattern: str) -> PieceEncoder:
    """One encoder a worker and file of ranks, backed by the tiktoken library."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return PieceEncoder(encode, lambda word, spaced: encode(" " + word if spaced else word), len(ranks))


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def library_encoder(vocabulary: str, end_id: int = 0) -> PieceEncoder:
    """One encoder a worker and vocabulary, backed by the tokenizers library. Its ids are wide enough for `end_id` too."""
    if (vocabulary, end_id) not in _encoders:
        from tokenizers import Tokenizer, pre_tokenizers

        t = _tokenizer(vocabulary)
        model, letters = t.model, byte_letters()
        space, dtype = letters[32], np.dtype(id_type(max(t.get_vocab_size(), end_id + 1)))
        merges = Tokenizer(model)  # the merges alone, for words that are one piece of the split pattern each
        merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        opens = np.zeros(t.get_vocab_size(), dtype=bool)  # ids that begin with a space
        opens[[i for token, i in t.get_vocab().items() if token.startswith(space)]] = True

        def written(word: str) -> str:
            return word if word.isascii() else word.encode().decode("latin-1").translate(letters)

        def encode_word(word: str, spaced: bool) -> list[int]:  # one piece of the split pattern: straight to the merges
            return [x.id for x in model.tokenize(space + written(word) if spaced else written(word))]

        def encode_words(words: list[str]) -> Iterator[bytes]:
            for at in range(0, len(words), JOINED):
                some = words[at : at + JOINED]
                joined = " ".join([space + written(w) for w in some])
                ids = np.array(merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype=dtype)
                first = np.flatnonzero(opens[ids]) * dtype.itemsize
                if len(first) != len(some):  # a vocabulary without a letter for the space
                    yield from (np.array(encode_word(w, True), dtype=dtype).tobytes() for w in some)
                    continue
                packed, edges = ids.tobytes(), [*first.tolist(), ids.nbytes]
                yield from (packed[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True))

        added = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
        _encoders[vocabulary, end_id] = PieceEncoder(
            lambda piece: t.encode(piece, add_special_tokens=False).ids, encode_word, max(t.get_vocab_size(), end_id + 1), added=added, encode_words=encode_words
        )
    return _encoders[vocabulary, end_id]
