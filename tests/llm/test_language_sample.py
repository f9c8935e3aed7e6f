"""What the language models learn from."""

import random

from scoreloom.llm import language


def test_every_text_has_its_part():
    """A long repeated passage comes first and a copy of it second; the other texts still count, from start to end."""
    random.seed(5)
    long = "das ist ein langer satz " * 2000
    words = {name: ["".join(random.choices(abc, k=6)) for _ in range(60)] for name, abc in (("de", "nopqrs"), ("en", "abcdef"))}
    own = {name: [" ".join(random.choices(w, k=200)) for _ in range(8)] for name, w in words.items()}
    tail = "zyx wvu " * 500
    model = language.Model({"de": [long, long, *own["de"]], "en": [*own["en"][:-1], long[:9000] + tail]}, 8000)
    assert model.predict([own["de"][-1], " ".join(words["de"]), tail])[0] == ["de", "de", "en"]
    assert language.parts([5, 100, 100, 1], 66) == [5, 30, 30, 1]


def test_large_scripts():
    """Two languages whose letters are far more than one small alphabet, besides one of the shared letters."""
    random.seed(7)
    scripts = {"ja": [chr(0x3041 + i) for i in range(80)] + [chr(0x4E00 + i) for i in range(60)], "zh": [chr(0x4E00 + i) for i in range(140)]}
    words = {name: ["".join(random.choices(s, k=4)) for _ in range(150)] for name, s in scripts.items()}
    words["en"] = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=4)) + " " for _ in range(150)]
    texts = {name: ["".join(random.choices(w, k=300)) for _ in range(12)] for name, w in words.items()}
    model = language.Model({name: t[:8] for name, t in texts.items()}, 40_000)
    for name, t in texts.items():
        assert set(model.predict(t[8:])[0]) == {name}
    for name, script in scripts.items():  # every letter of the sample has a symbol of its own
        seen = sorted(set("".join(texts[name][:8])))
        assert len(seen) > 130 and len(set(model.numbers[[ord(c) for c in seen]].tolist())) == len(seen) and set(seen) <= set(script)


def test_size_follows_the_moves():
    """Thousands of letters: at most three moves for each symbol learned, in an array of little more."""
    random.seed(9)
    script = [chr(0x4E00 + i) for i in range(3000)]
    text = "".join(random.choices(script, weights=[1 / (i + 5) for i in range(3000)], k=20_000))
    model = language.Model({"zh": [text]}, 40_000)
    assert model.roots.shape[1] > 1500 and model.moves.nbytes < 8 * (3 * 20_000 + 6000)
