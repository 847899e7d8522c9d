"""Token ids of random texts against the library: combining marks of all blocks, capitals, composed letters, white space."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_operators import expected_ids

from sparkloom.llm import token_store

MARKS = [chr(c) for c in range(0x300, 0x370)] + [chr(c) for c in (0x483, 0x591, 0x5B0, 0x64B, 0x93C, 0x1AB0, 0x1DC0, 0x20D0, 0x3099, 0xFE20)]
LETTERS = list("abtTZaeouAEOUnNsSkK") + ["ß", "É", "é", "İ", "ı", "Σ", "ς", "Å", "Å", "ﬁ", "Ω", "K", "日", "ー", "ẞ", "ǅ", "1", "٣", "'", "'s", "'S", "-", ".", "<|", "|>", " ", "\n", "\t", " ", " ", "🎉"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts(seed):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(4000):
        n = int(rng.integers(1, 9))
        texts.append("".join(str(rng.choice(MARKS if rng.random() < 0.35 else LETTERS)) for _ in range(n)))
    texts += [f"T{m}" for m in MARKS] + [f"x {c}{m}" for m in MARKS for c in "aAtT"]
    want = expected_ids(texts)
    ids, sizes = token_store._encoder(str(public_tokenizers.path("word_bpe_49k.json")))(pa.array(texts))
    got = np.split(np.asarray(ids), np.cumsum(sizes)[:-1])
    wrong = [(t, list(g), w) for t, g, w in zip(texts, got, want, strict=True) if list(g) not in (w, w[:-1])]
    assert not wrong, (len(wrong), wrong[:3])
