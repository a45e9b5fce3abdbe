"""Encodings of mixed scripts against the tokenizers library itself."""

import random

import numpy as np
import pyarrow as pa
import pytest

from auditlark.llm.encoders import Encoder

PARTS = [
    " ", "  ", "\n", "\t", " ", " ", "　", " ", "\u0085", "​", "﻿", "᠎", "'s", "'LL", "’s", "'ſ", "’", "“x”", "—",
    "é", "é", "́", "̸", "<", "|", "<|endoftext|>", "İ", "I", "ı", "Σ", "ΑΣ", "日本", "١٢", "²", "Ⅷ", "½",
    "\U0001f600", "\U0001f469‍\U0001f467", "हिन", "한", "한", "क़", "Å", "Ω", "ẞ", "ﬁ", "\U0001d4b3", "\x00", "\x1c",
    "a", "B", "12", "3", "!", "..", "don't", "WE'RE",
]


def any_character(rng):
    while 0xD800 <= (c := rng.choice([rng.randrange(0x250), rng.randrange(0x3000), rng.randrange(0x10000), rng.randrange(0x110000)])) < 0xE000:
        pass
    return chr(c)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_mixed_scripts(file):
    rng = random.Random(17)
    texts = ["".join(rng.choice(PARTS) if rng.random() < 0.8 else any_character(rng) for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += [" ".join(texts), "", None]
    encoder = Encoder(file)
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts]).slice(1)):
        got = [x.tolist() for ids, sizes in encoder.ids(column) for x in np.split(ids, np.cumsum(sizes))[:-1]]
        assert got == want
        assert encoder.counts(column).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_the_library_encodes_no_whole_text_without_a_special_string(file, monkeypatch):
    encoder = Encoder(file)
    monkeypatch.setattr(encoder, "tokenizer", type("None", (), {"normalizer": encoder.tokenizer.normalizer, "pre_tokenizer": encoder.tokenizer.pre_tokenizer}))
    assert encoder.counts(pa.array(["it’s 日本", "plain"])).min() > 0
