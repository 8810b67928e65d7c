"""The packing plan against plain best-fit decreasing and lower bounds."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import packing

RNG = np.random.default_rng(0)


def of(lengths):
    out = np.zeros(4097, np.int64)
    for length, n in lengths.items():
        out[length] += n
    return out


INPUTS = {
    "four lengths": of({2080: 600, 1088: 600, 1056: 600, 960: 1200}),
    "three thirds": of({1366: 300, 1365: 600, 2000: 500, 2096: 100}),
    "complements": of({1434: 3000, 2662: 700, 1400: 500, 2700: 900}),
    "even": np.bincount(RNG.integers(300, 2200, 3000), minlength=4097),
    "narrow": np.bincount(RNG.integers(700, 1700, 1200), minlength=4097),
    "texts": np.bincount(np.clip(RNG.lognormal(6, 1, 5000).astype(int), 1, 4096), minlength=4097),
    "tiny": of({1: 50, 4096: 3, 4095: 2}), "nothing": of({}), "one": of({7: 1}),
}


def best_fit_decreasing(counts):
    rooms = np.zeros(4097, np.int64)         # open sequences by their room
    opened = 0
    for length in np.repeat(np.arange(4097), counts)[::-1].tolist():
        fits = np.flatnonzero(rooms[length:])
        if len(fits):
            room = length + int(fits[0])
            rooms[room] -= 1
        else:
            room, opened = 4096, opened + 1
        rooms[room - length] += 1
    return opened


@pytest.mark.parametrize("name", list(INPUTS))
def test_never_more_sequences_than_best_fit(name):
    counts = INPUTS[name]
    plan = packing.Plan(counts)
    assert plan.sequences <= best_fit_decreasing(counts)
    lengths = np.repeat(np.arange(4097), counts)
    ranks = np.concatenate([np.arange(n) for n in counts if n] or [np.empty(0, np.int64)])
    if not len(lengths):
        assert plan.sequences == 0
        return
    sequence, offset = plan.find(lengths, ranks)
    assert len(np.unique(sequence)) == plan.sequences
    order = np.lexsort((offset, sequence))
    s, o, n = sequence[order], offset[order], lengths[order]
    first = np.append(True, s[1:] != s[:-1])
    assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all()
    assert (o + n).max() <= 4096


def test_the_program_finds_what_best_fit_misses():
    plan = packing.Plan(INPUTS["four lengths"])
    assert plan.by_best_fit == 1100 and plan.by_program == plan.sequences <= 920
    assert packing.Plan(INPUTS["three thirds"]).by_program < packing.Plan(INPUTS["three thirds"]).by_best_fit


def test_kept_words_survive_forgetting(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello, world! don't stop... É é ÉCOLE", "", "x\x01y <|endoftext|> end", "a.b, c;d (e) 'f' \"G\"", "Hello, again!!!"]
    plain = Tokenizer.from_file(path)
    tokens = packing.WordTokens(path)
    monkeypatch.setattr(packing, "CACHED", 3)
    for text in texts * 2:
        ids, ends = tokens.encode(pa.array([text, "", text]))
        want = [*plain.encode(text, add_special_tokens=False).ids, packing.END_ID]
        assert ids.tolist() == [*want, packing.END_ID, *want]
        assert ends.tolist() == [0, len(want), len(want) + 1, 2 * len(want) + 1]


def test_new_words_are_looked_up_twice(monkeypatch):
    """Each look-up hashes all kept words, so there are two per slice: all words, then their parts."""
    path = public_tokenizers.path("word_bpe_49k.json")
    looked, find = [], packing.WordTokens._find
    monkeypatch.setattr(packing.WordTokens, "_find", lambda self, words: looked.append(len(words)) or find(self, words))
    tokens, plain = packing.WordTokens(path), Tokenizer.from_file(path)
    slices = [["Well, well... it's well!", "x1,y2 (naïve) <|endoftext|>! \x01 a\x01b", ""],
              ["well it's? naïve!! new, NEW; new! (naïve) !", "", "... ,"], ["Well, new! x1,y2"]]
    for n, texts in enumerate(slices):
        ids, ends = tokens.encode(pa.array(texts))
        got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
        assert got == [[*plain.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
        assert len(looked) <= 2 * (n + 1)
    # nothing new in the last slice
    assert len(looked) == 5
    assert len(tokens.known) == len(tokens.ends) - 1 == len(set(tokens.known.to_pylist()))
