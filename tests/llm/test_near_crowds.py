"""Near-dedup finds the same links however large a posting may be before its members meet by rare shingles."""

import random

import pytest
from test_dedup import expected_near, ordered, prose

from reposcope.llm import minhash_dedup


def families():
    """Texts of one template with few own words, a family of near copies, chains at the threshold and others."""
    rng, rows = random.Random(9), []
    template = prose(rng, 120, 500).split()
    for i in range(220):
        words = list(template)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(len(words))] = f"own{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    base = [f"b{k}" for k in range(100)]
    rows += [(300 + step, " ".join(f"x{j}" if j < 4 * step else w for j, w in enumerate(base))) for step in range(10)]
    rows += [(400 + k, prose(rng, rng.choice([1, 2, 30]), 60)) for k in range(50)] + [(500, None), (501, "")]
    return rows


@pytest.mark.parametrize("crowd", [1, 64, 10**9])
def test_crowds(documents, monkeypatch, crowd):
    monkeypatch.setattr(minhash_dedup, "CROWD", crowd)
    rows = families()
    got = minhash_dedup.near_groups(documents(rows), shingle=2).collect()
    assert ordered(r[:4] for r in got) == ordered(expected_near(rows, 2))
