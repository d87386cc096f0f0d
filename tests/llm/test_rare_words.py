"""Words that few labelled rows have."""

import numpy as np
from pagewright.llm import quality


def test_words_of_a_few_toxic_rows_have_weight():
    rng = np.random.default_rng(1)
    toxic = [b"bad%d" % k for k in range(10)]
    rows = []
    for k in range(90):
        words = {b"w%d" % x for x in rng.integers(0, 400, 60)}
        rows.append((sorted(words | ({toxic[k % 10], toxic[(k // 10 + k + 1) % 10]} if k < 15 else set())), 1, int(k < 15)))
    weights, _ = quality.fit(rows)
    assert all(w in weights and weights[w][1] > 0 for w in toxic)
