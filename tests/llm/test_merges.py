import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from dwell.llm import tokens
from dwell.llm.merges import LONGEST, Merges
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
LATIN = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_merged_words_have_the_ids_of_the_library(library):
    rng = random.Random(5)
    known = [w for w in (t.replace("</w>", "") for t in library.get_vocab()) if w.isascii() and w.isalpha() and w.islower()]
    words = ["".join(rng.choices(LATIN, k=rng.randrange(1, 16))) for _ in range(6000)]
    words += known[:6000] + ["".join(rng.choices(known, k=2)) for _ in range(6000)] + ["aaaaaaa", "a" * LONGEST, "é" * (LONGEST // 2)]
    words = pa.array(sorted(w for w in set(words) if len(w.encode()) <= LONGEST), pa.string())
    merges = Merges.of(library)
    assert merges.fits(words).all()
    ids, starts, sizes = merges.encode(words)
    assert [ids[a : a + n].tolist() for a, n in zip(starts, sizes)] == [e.ids for e in library.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]


def test_which_words_fit(library):
    merges = Merges.of(library)
    words = ["a", "straße", "ÀÉÞ", "a" * LONGEST, "", "a" * (LONGEST + 1), "ł", "ж", "ªº", "中", "İ"]
    assert merges.fits(pa.array(words, pa.string())).tolist() == [True] * 4 + [False] * 7
    assert merges.fits(pa.array([], pa.string())).tolist() == [] and [len(x) for x in merges.encode(pa.array([], pa.string()))] == [0, 0, 0]
    upper = merges.encode(pa.array(["ÀÉÞ"], pa.string()))[0]
    assert upper.tolist() == library.encode("ÀÉÞ", add_special_tokens=False).ids


def test_whole_texts_of_mixed_scripts(library):
    rng, letters = random.Random(6), LATIN + LATIN.upper() + "łžªºµ×÷İıſﬁ́жя中.,!'1 "
    texts = [" ".join("".join(rng.choices(letters if rng.random() < 0.5 else LATIN, k=rng.choice([1, 2, 4, 8, 16, 33, 50]))) for _ in range(40)) for _ in range(400)]
    texts += ["", " ", "word " * 3000, "x" * 5000]
    ids, bounds = tokens.WordEncoder(PATH).encode_column(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.mark.parametrize("part, value", [("dropout", 0.1), ("ignore_merges", True), ("end_of_word_suffix", None)])
def test_other_models_are_left_to_the_library(library, part, value):
    spec = json.loads(library.to_str())
    spec["model"][part] = value
    assert Merges.of(type("Other", (), {"to_str": lambda self: json.dumps(spec)})()) is None
    encoder = tokens.WordEncoder(PATH)
    plain, encoder.merges = encoder.encode_column(pa.array(["one Zwölf drei,"])), None
    assert np.array_equal(plain[0], encoder.encode_column(pa.array(["one Zwölf drei,"]))[0])
