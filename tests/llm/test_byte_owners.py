"""What an owner of byte segments sorts, and that it finds every repeated string."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import suffix_dedup as sd
from tidemark.llm.text import blocks


def _late_places(texts: list[str], size: int) -> set[tuple[int, int]]:
    """Places (text, start) that one owner of all segments finds; a text's id is its number."""
    (block,) = blocks(pa.array(texts))
    _, at, count, owner, anchor = sd.segments(block, size)
    body = sd.cut(block.data, at, count + size - 1)
    hits = sd._answer(size, np.zeros(len(at), np.int64), owner, owner, at - block.bounds[owner], count, anchor, body)
    return {(int(d), int(s) + i) for _, docs, starts, counts in hits for d, s, n in zip(docs, starts, counts, strict=True) for i in range(n)}


@pytest.mark.parametrize("size", [16, 17, 18, 31, 50])
def test_every_repeated_string_is_found(size):
    rng = np.random.default_rng(size)
    passages = ["".join(rng.choice(list("abcdé "), 120)) for _ in range(4)] + ["ab" * 60]
    texts = []
    for _ in range(60):
        t = passages[rng.integers(5)] + passages[rng.integers(5)]
        for _ in range(rng.integers(4)):
            i = rng.integers(len(t))
            t = t[:i] + str(rng.integers(10)) + t[i + 1 :]
        texts.append(t[rng.integers(80) :])
    first, want = {}, set()
    for d, body in enumerate(t.encode() for t in texts):
        for s in range(len(body) - size + 1):
            if first.setdefault(body[s : s + size], d) < d:
                want.add((d, s))
    assert want and _late_places(texts, size) == want


def test_exact_copies_are_not_sorted(monkeypatch):
    rng = np.random.default_rng(1)
    passage, sorted_bytes = "".join(rng.choice(list("abcdefgh "), 2000)), []
    places = sd.repeated_places
    monkeypatch.setattr(sd, "repeated_places", lambda text, *a: sorted_bytes.append(len(text)) or places(text, *a))
    assert len(_late_places([passage] * 3, 50)) == 2 * (2000 - 49)
    assert not sorted_bytes
    changed = passage[:1000] + "#" + passage[1001:]
    assert len(_late_places([passage, changed], 50)) == 2000 - 49 - 50
    assert sum(sorted_bytes) < 800
