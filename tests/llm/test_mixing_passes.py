"""The passes of the context-mixing scorer: words are numbered once, spellings counted by looking up prepared parts."""

import numpy as np

from plumbline.llm import mixing


def test_passes_read_numbers_not_texts(spark, monkeypatch):
    read, plain = [], mixing.training
    monkeypatch.setattr(mixing, "training", lambda docs, *args: (read.append(docs.columns), plain(docs, *args))[1])
    df = spark.createDataFrame([(k, f"w{k % 7} v{k % 5} only{k}") for k in range(40)], "doc_id long, text string")
    assert mixing.op8(df).count() == 40
    assert len(read) == 2 and all("text" not in columns and "codes" in columns for columns in read)


def test_spellings_are_counted_without_themselves():
    words = [b"alpha", b"alpine", b"beta", b"betamax", b"q" * 90]
    table = np.zeros(2 * int(mixing.SPELL_START[-1]), np.int32)
    mixing.add_spelling(table, words)
    table = table.reshape(-1, 2).T
    speller = mixing.Speller(table.astype(np.uint16), mixing.Mixer(mixing.SPELL_GATES, len(mixing.SPELL_SLOTS)))
    got = np.zeros(mixing.SPELL_GATES * mixing.LEVELS ** len(mixing.SPELL_SLOTS) * 2, np.int32)
    speller.count(got, words, speller.parts())
    want = np.zeros_like(got)
    for _, slots, y, place in mixing.spelling(words):
        for s, bit in zip(slots.T, y.tolist(), strict=True):
            n = table[:, s].astype(np.float32)
            n[bit] = np.maximum(n[bit] - 1, 0)
            seen = n.sum(axis=0)
            number = (place * 4 + sum(seen[-1] > b for b in (0, 2, 20))) * 3 + sum(seen[-2] > b for b in (0, 20))
            for k, x in enumerate(mixing.level(np.log((n[1] + mixing.PRIOR) / (n[0] + mixing.PRIOR)))[::-1]):
                number = number * mixing.LEVELS + int(x)
            want[number * 2 + bit] += 1
    assert (got == want).all() and got.sum() == sum(8 * len(w) for w in words)
