"""The encoder against the tokenizers library on every code point and on mixed strings."""

import random
import sys
import unicodedata

import pytest

from plumbline.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH), bpe.Encoder(bpe.Merges(PATH), None)


@pytest.mark.parametrize("form", ["a%sb", "1%s 2"])
def test_every_code_point(both, form):
    library, own = both
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    other = []
    for i in range(0, len(points), 5000):
        texts = [form % chr(c) for c in points[i : i + 5000]]
        found = library.encode_batch(texts, add_special_tokens=False)
        other += [t for t, f in zip(texts, found, strict=True) if own.encode(t) != f.ids]
    assert not other


def test_mixed_strings(both):
    library, own = both
    r = random.Random(5)
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    marks = [c for c in points if unicodedata.category(chr(c))[0] == "M"]
    for _ in range(20_000):
        text = "".join(chr(r.choice(r.choice((range(32, 0x250), marks, points)))) for _ in range(r.randint(1, 12)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids, skip_special_tokens=False)
