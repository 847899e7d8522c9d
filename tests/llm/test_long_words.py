"""Languages of words without end: pieces give what the whole gives, in bounded memory."""

import tracemalloc

import numpy as np
import pytest

from sparkloom.llm import langid

MODEL = [("en", "the", 5), ("en", "there", 2), ("fr", "le", 5), ("fr", "leurs", 2), ("zh", "日本語", 3)]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50])
def test_pieces_hold_every_gram_once(monkeypatch, piece):
    words = ["a", "", "abcdefgh", "theretherethere" * 9, "日本語" * 11, "xy"]
    for n in range(1, langid.LONGEST + 1):
        whole = [sorted(langid.grams([w], n)[1].tolist()) for w in words]
        with monkeypatch.context() as m:
            m.setattr(langid, "PIECE", piece)
            found: dict[int, list[int]] = {i: [] for i in range(len(words))}
            for owners, texts in langid._pieces(words, n):
                owner, key = langid._grams(texts, n)
                for i, k in zip(owners[owner].tolist(), key.tolist(), strict=True):
                    found[i].append(k)
        assert [sorted(found[i]) for i in range(len(words))] == whole


def test_scores_do_not_depend_on_pieces(monkeypatch):
    model = langid.LanguageModel(MODEL)
    words = ["there" * 400, "leurs" * 300 + "there" * 10, "qqqq", "the", "日本" * 500]
    whole = model.score_words(words)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.allclose(model.score_words(words), whole, atol=1e-5) and whole.any()


def test_sixteen_megabytes_without_a_space():
    model = langid.LanguageModel(MODEL)
    text = "日本語の" * 1_400_000  # three bytes a character
    tracemalloc.start()
    got = model.score_tokens([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20 and model.languages[int(got[0, :-2].argmax())] == "zh" and got[0, -2] == 1
