"""Token ids of whole texts by the tokenizers library, with a bounded cache of what stands between spaces.

A tokenizer that parts texts before a space that a visible character follows, and between
a letter and a mark, encodes such pieces once for each worker and looks them up after that. Any other tokenizer encodes whole texts.
Pieces are cut and looked up as Arrow strings over a batch's bytes; only those that the cache lacks become Python strings.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space next to white space, at a text's end, or a NUL: such texts, like those with special tokens, take the slower exact split.
_WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
_ODD = rf"\x00| {_WHITE}| $|\n{_WHITE}|{_WHITE}\n"
_BEFORE_VISIBLE = re.compile(r" (?=\S)")
#: A mark after a letter always begins a token.
_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,:;!?])"
#: Words of letters up to U+00FF, which are encoded many to a text.
_WORD = "[A-Za-zªµºÀ-ÖØ-öø-ÿ]+"
_TOGETHER = 128
#: Longer pieces (bytes) hardly come again, so no cache keeps them.
_LONGEST = 64


def _bytes_in(values: Iterable[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_MARKS, _LETTERS = _bytes_in(b".,:;!?"), _bytes_in(c for c in range(128) if chr(c).isalpha())
_WIDE, _WIDE_LEAD = _bytes_in({*range(0x80, 0xC0)} - {0x97, 0xB7}), 0xC3  # UTF-8 of À to ÿ without × and ÷


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Encoder:
    """Ids of texts, equal to encode(text, add_special_tokens=False).ids of the tokenizer file at path.

    spaced: the tokenizer keeps spaces (byte-level, a word holds the space before
    it); else it drops white space, marks word ends and lower-cases.
    kept: pieces that the cache holds at most from one batch to the next, those of up to 64 bytes that were used last.
    """

    path: str
    spaced: bool
    kept: int = 400_000

    def __post_init__(self) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(self.path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.edge = np.zeros(size, bool)  # byte-level: tokens that start with a space; else tokens that end a word
        for token, i in vocabulary.items():
            self.edge[i] = token.startswith("Ġ") if self.spaced else token.endswith("</w>")
        self.parted = self._parts()
        # the cache: pieces, where their ids lie in flat, how many they are, and in which batch each was used last
        self.known = pa.array([], pa.string())
        self.starts, self.sizes, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.batch = np.zeros(0, self.kind), 0

    def _parts(self) -> bool:
        """Whether the tokenizer itself parts texts before a space that something visible follows, and between a letter and a mark."""
        split, normal = self.tokenizer.pre_tokenizer, self.tokenizer.normalizer
        if split is None or type(self.tokenizer.model).__name__ != "BPE":
            return False
        norm = normal.normalize_str if normal else str

        def edge(left: str, right: str) -> bool:
            at = len(norm(left))
            return all(b <= at or a >= at for _, (a, b) in split.pre_tokenize_str(norm(left + right)))

        letters = [chr(i) for i in range(0x100) if re.match(_MARK[: _MARK.index(")") + 1], chr(i))]
        visible = [chr(i) for i in range(0x21, 0x100) if not chr(i).isspace() and chr(i).isprintable()]
        return all(edge(x, mark) for x in letters for mark in ".,:;!?") and all(edge(x, " " + y) for x in "aZ9.é" for y in visible)

    def _encode(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The library's ids of all pieces, where each piece's begin and how many they are. Plain words are encoded many to a text and parted at word edges."""
        plain = np.asarray(pc.match_substring_regex(pieces, f"^{' ' if self.spaced else ''}{_WORD}$"))
        places, words = np.flatnonzero(plain), pieces.filter(pa.array(plain)).to_pylist()
        joined = [("" if self.spaced else " ").join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)]
        order, sizes, flat, alone = [], [], [], [np.flatnonzero(~plain)]
        for i, e in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            part, ids = places[i * _TOGETHER : (i + 1) * _TOGETHER], np.array(e.ids, self.kind)
            edges = np.flatnonzero(self.edge[ids])
            own = np.diff(edges, append=len(ids)) if self.spaced else np.diff(edges, prepend=-1)
            if len(own) == len(part) and own.sum() == len(ids):
                order.append(part)
                sizes.append(own)
                flat.append(ids)
            else:
                alone.append(part)
        order.append(np.concatenate(alone))
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(pieces.take(pa.array(order[-1])).to_pylist(), add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        flat.append(np.fromiter(chain.from_iterable(rest), self.kind))
        lengths = np.concatenate(sizes)
        back = np.argsort(np.concatenate(order))
        return np.concatenate(flat), (np.cumsum(lengths) - lengths)[back], lengths[back]

    def _runs(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the cache's pieces numbered in own, one after the other, and where each piece's begin; last, where all end."""
        sizes = self.sizes[own]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.starts[own] - ends[:-1], sizes) + np.arange(ends[-1])], ends

    def _lookup(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and where each piece's begin; last, where all end. Pieces that are not known are encoded."""
        n = len(self.known)
        # what is known stands first, each once, so it keeps its numbers and new pieces get the next ones
        coded = pa.concat_arrays([self.known, pieces]).dictionary_encode()
        codes = np.asarray(coded.indices)[n:]
        self.known = coded.dictionary
        if len(self.known) > n:
            flat, starts, sizes = self._encode(self.known.slice(n))
            self.starts = np.concatenate([self.starts, len(self.flat) + starts])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
            self.used = np.concatenate([self.used, np.zeros(len(sizes), np.int64)])
        self.batch += 1
        self.used[codes] = self.batch
        out = self._runs(codes)
        last = np.flatnonzero(np.asarray(pc.binary_length(self.known)) <= _LONGEST)
        if len(last) > self.kept:
            last = np.sort(last[np.argpartition(self.used[last], -self.kept)[-self.kept :]])
        if len(last) < len(self.known):
            self.flat, ends = self._runs(last)
            self.known, self.starts, self.sizes, self.used = self.known.take(pa.array(last)), ends[:-1], self.sizes[last], self.used[last]
        return out

    def _cut(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The pieces of all texts, and the number of each text's first; last, how many there are.

        A piece begins at a text's start and at a mark after a letter; spaced: also at a space, a line break
        and after one; else after a space or a line break, which are dropped, and A-Z are lower-cased.
        """
        texts = texts if self.spaced else pc.ascii_lower(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        line = data == 10
        white = line | (data == 32)
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins[1:] |= (line if self.spaced else white)[:-1] | (_MARKS[data[1:]] & _LETTERS[data[:-1]])
        begins[2:] |= _MARKS[data[2:]] & _WIDE[data[1:-1]] & (data[:-2] == _WIDE_LEAD)
        if self.spaced:
            begins |= white
        starts = np.flatnonzero(begins)
        first = np.searchsorted(starts, offsets)
        starts = np.append(starts, len(data))
        if not self.spaced:
            dropped = np.flatnonzero(white)
            starts -= np.searchsorted(dropped, starts)
            data = data[np.flatnonzero(~white)]
        return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)), first

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.parted:
            whole = self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)
            return [np.array(e.ids, self.kind) for e in whole]
        out: list = [None] * len(texts)
        if not len(texts):
            return out
        odd = np.asarray(pc.match_substring_regex(texts, _ODD if self.spaced else r"\x00"))
        for special in self.specials:
            odd = odd | np.asarray(pc.match_substring(texts, special, ignore_case=True))
        order = np.argsort(odd, kind="stable")  # odd texts come last
        even = len(texts) - int(np.count_nonzero(odd))
        pieces, first = self._cut(texts.take(pa.array(order[:even])) if even < len(texts) else texts)
        more: list[str] = []
        ends: list[int] = []
        for whole in texts.take(pa.array(order[even:])).to_pylist():
            head, *rest = _BEFORE_VISIBLE.split(whole) if self.spaced else [whole]
            more += [head, *(" " + x for x in rest)]
            ends.append(len(pieces) + len(more))
        run, at = self._lookup(pa.concat_arrays([pieces, pa.array(more, pa.string())]) if more else pieces)
        cuts = at[np.concatenate([first, np.array(ends, np.int64)])]
        for j, i in enumerate(order.tolist()):
            out[i] = run[cuts[j] : cuts[j + 1]]
        return out


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, spaced: bool) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = Encoder(path, spaced)
    return _ENCODERS[path, spaced]
