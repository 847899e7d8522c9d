"""Every n-gram of every token is a feature, however long the token is."""

from collections import Counter

import numpy as np

from sparkloom.llm import quality


def counted(tokens):
    return Counter(x for owner, ids in quality.features(tokens) for x in zip(owner.tolist(), ids.tolist(), strict=True))


def test_all_grams_of_long_tokens(monkeypatch):
    tokens = ["漢字" * 100, "a", "", "x" * 79, "word", "0123456789" * 30]
    want = counted(tokens)
    sizes = [len(t.encode()) + 2 for t in tokens]
    assert [sum(n for (o, _), n in want.items() if o == i) for i in range(len(tokens))] == [1 + sum(max(0, s - n + 1) for n in (3, 4, 5)) for s in sizes]
    model = quality.fit(["good words"], [1])
    scored = model.score_tokens(tokens)
    for piece in (1, 7, 64, 300):
        monkeypatch.setattr(quality, "PIECE", piece)
        assert counted(tokens) == want and np.allclose(model.score_tokens(tokens), scored)


def test_text_without_spaces_is_scored_by_its_content():
    good, bad = [["".join(chr(a + (7 * i + k * k) % 40) for k in range(120)) for i in range(40)] for a in (0x4E00, 0x5E00)]
    model = quality.fit(good[:30] + bad[:30], [1] * 30 + [0] * 30)
    sums = [model.score_tokens([t]) for t in good[30:] + bad[30:]]
    scores = [float(model.score(s[:, :2], s[:, 2])[0]) for s in sums]
    assert min(scores[:10]) > max(scores[10:])
