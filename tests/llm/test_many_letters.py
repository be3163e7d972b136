"""Languages with more letters than a table takes."""

import random

import pytest

from peakloom.llm import language
from tests.llm import brute


def test_languages_with_many_letters():
    rng = random.Random(4)

    def prose(first, letters, words):
        known = ["".join(chr(first + rng.randrange(letters)) for _ in range(rng.randrange(1, 5))) for _ in range(150)]
        return " ".join(rng.choice(known) for _ in range(words))

    texts = {"zh": prose(0x4E00, 700, 900), "ko": prose(0xAC00, 400, 900), "ru": prose(0x430, 32, 900), "en": prose(0x61, 26, 300)}
    training = {k: t[: len(t) * 3 // 4] for k, t in texts.items()}
    asked = [(k, texts[k][len(training[k]) :]) for k in texts] + [("zh", training["zh"][:40]), ("ko", "x" + training["ko"][-60:])]
    names, scores = language.predict([t for _, t in asked], language.build(training))
    assert names == [k for k, _ in asked]
    every = {c for t in training.values() for c in t}
    want = [brute.language(t, training, every, language.BLOCK) for _, t in asked]
    assert list(zip(names, scores)) == [(n, pytest.approx(s)) for n, s in want]
