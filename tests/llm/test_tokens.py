"""The encoder's cut, lookup and cache, against the library and a plain cut by patterns."""

import random
import re
import tracemalloc

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stocktake.llm import tokens

KINDS = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
PARTS = ["Straße", "é", "×.", "÷,", "a.", "ÿ!", "Ø?", "naïve", "x;y", "日本。", ".", ",a", "ª.", "don't", "47.1", "ŝ.", "A:", "\U0001f600", "</w>", "Ġ"]


def _texts(r: random.Random, n: int) -> list[str | None]:
    gaps = [" "] * 12 + ["\n"] * 4 + ["", "  ", " \n", "\t"]
    texts = ["".join(r.choice(PARTS) + r.choice(gaps) for _ in range(r.randint(0, 9))).rstrip() for _ in range(n)]
    return [None, "", *texts, "", "a\0b a", " ", "end.", ".begins with a mark", "\nline", None]


@pytest.mark.parametrize("name, spaced", KINDS)
def test_batches_that_fill_the_cache(name, spaced):
    """Pieces leave and come back, odd texts stand between even ones, batches are slices."""
    r, path = random.Random(7), tokens.path_of(name)
    work, library = tokens.Encoder(path, spaced, kept=15), Tokenizer.from_file(path)
    for n in (40, 0, 3, 200):
        texts = _texts(r, n)
        batch = pa.array(["not this one", *texts]).slice(1)
        found = work.texts(batch)
        assert [x.tolist() for x in found] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert len(work.known) <= 15
    assert work.texts(pa.array([], pa.string())) == [] and work.texts(pa.array([None], pa.string()))[0].tolist() == []


@pytest.mark.parametrize("spaced", [True, False])
def test_texts_are_cut_as_patterns_say(spaced):
    work = tokens.Encoder(tokens.path_of(KINDS[0 if spaced else 1][0]), spaced)
    texts = [t or "" for t in _texts(random.Random(3), 300)]
    pieces, first = work._cut(pa.array(texts))
    mark = "(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,:;!?])"
    for text, a, b in zip(texts, first.tolist(), first[1:].tolist()):
        if spaced:
            want = [p for p in re.split(f"(?= )|(?=\n)|(?<=\n)|{mark}", text) if p]
        else:
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            want = [p for word in re.split("[ \n]", lower) for p in re.split(mark, word) if p]
        assert [p for p in pieces.slice(a, b - a).to_pylist() if p] == want


@pytest.mark.parametrize("name, spaced", KINDS)
def test_cached_pieces_are_no_python_objects(name, spaced):
    """A worker holds its cache in a few arrays; a string and ids for each piece cost more memory and time than all else."""
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghij", k=7)) for _ in range(20_000)]
    batch = pa.array([" ".join(words)])
    work = tokens.Encoder(tokens.path_of(name), spaced)
    tracemalloc.start()
    try:
        first = work.texts(batch)[0]
        snapshot = tracemalloc.take_snapshot()
    finally:
        tracemalloc.stop()
    # two strings or more for each piece, when they were keys and values of a dict
    assert sum(s.count for s in snapshot.statistics("filename")) < len(words) // 4
    assert work.texts(batch)[0].tolist() == first.tolist()


@pytest.mark.parametrize("name, spaced", KINDS)
def test_long_pieces_are_not_kept(name, spaced):
    """Texts without spaces are one piece each; the cache is bounded in bytes too, not only in pieces."""
    path = tokens.path_of(name)
    work, library = tokens.Encoder(path, spaced), Tokenizer.from_file(path)
    texts = ["日本" * 500 + str(i) for i in range(20)] + ["x" * 64, "y" * 65, "a  b"]
    for _ in range(2):
        assert [x.tolist() for x in work.texts(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        kept = work.known.to_pylist()
        assert "x" * 64 in kept and max(len(p.encode()) for p in kept) == 64
    odd = pa.array(["a\0 b", "c\0"])
    assert [x.tolist() for x in work.texts(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd.to_pylist()]
