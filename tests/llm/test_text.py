from __future__ import annotations

import re

from holdfast.llm import text


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(text, "BLOCK_BYTES", 64)
    texts = ["The cat\tthe\x0bCAT", "", None, "a", "  x  y ", "é É", " ".join(f"w{i % 9}" for i in range(80)), "b" * 200]
    seen, back = {}, {}
    for first, last, hashes, before in text.hashed_words(None if t is None else t.encode() for t in texts):
        counts = [*before[1:], len(hashes)]
        for at in range(first, last):
            own = hashes[before[at - first]:counts[at - first]].tolist()
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[at] or "")
            words = ["".join(c.lower() if c.isascii() else c for c in w) for w in words]
            assert len(own) == len(words)
            for word, value in zip(words, own):
                assert seen.setdefault(word, value) == value and back.setdefault(value, word) == word
    assert len(seen) == 2 + 1 + 2 + 2 + 9 + 1


def test_shingles_stay_inside_texts():
    import numpy as np

    hashes = np.arange(1, 8, dtype=np.uint64)  # texts of 3, 0, 1, 3 words
    values, owner = text.shingles(hashes, np.array([0, 3, 3, 4]), 2)
    assert owner.tolist() == [0, 0, 2, 3, 3] and len(set(values.tolist())) == 5
    assert len(text.shingles(hashes[:0], np.array([0]), 2)[0]) == 0
