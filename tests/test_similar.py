"""The similar step looks at a kept text once, and decides as difflib does."""

import difflib
import random
import re

from confab.operators import fold


def row(content):
    return {"sender": "s", "type": "text", "time": None, "content": content}


def test_kept_texts_are_looked_at_once(monkeypatch):
    made = []

    class Counted(difflib.SequenceMatcher):
        def __init__(self, *args, **kwargs):
            made.append(1)
            super().__init__(*args, **kwargs)

    monkeypatch.setattr(fold.difflib, "SequenceMatcher", Counted)
    step, kept = fold.similar_step(), [row("the quick brown fox jumps over dogs " + c * 10) for c in "abc"]
    for i in range(50):
        step(kept, row("the quick brown fox jumps over dogs " + "xyz0123456"[i % 10] * 10))
    assert len(made) <= len(kept)


def test_decides_as_difflib():
    def like(new, old):
        new, old = (re.sub(r"\s+", " ", x.strip()) for x in (new, old))
        return len(new) >= 30 and len(old) >= 30 and difflib.SequenceMatcher(None, new, old).ratio() >= 0.88

    rng, seen = random.Random(1), set()
    for size in (30, 80, 199, 200, 450):
        for letters in ("a", "ab", "abcdefghijkl "):
            for _ in range(12):
                old = "".join(rng.choice(letters) for _ in range(size))
                new = "".join(rng.choice(letters) if rng.random() < rng.choice([0, 0.1, 0.3]) else c for c in old)
                want = like(new, old)
                seen.add(want)
                assert fold.similar_step()([row(old)], row(new)) is not want
    assert seen == {True, False}
