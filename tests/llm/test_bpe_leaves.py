"""Matches up to a leaf's bytes are merged once, longer ones are joined from leaves; both as tiktoken has them."""

import numpy as np
import public_tokenizers as P
import tiktoken

from pagewright.llm import bpe


def test_a_short_match_is_merged_once_and_a_long_one_joined(monkeypatch):
    coder, rng = bpe.coder_of(P.path("byte_bpe_50k.tiktoken")), np.random.default_rng(9)
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    letters = np.array(list("aeiounstrhldcégñ日"))
    made = {n: [" " + "".join(rng.choice(letters, n)) for _ in range(300)] for n in (1, 2, 6, 11, 40, 90)}
    calls = {"merge": 0, "join": 0}
    for name in calls:
        inner = getattr(coder, name)
        monkeypatch.setattr(coder, name, lambda *a, name=name, inner=inner: (calls.update({name: calls[name] + 1}), inner(*a))[1])
    for n, words in made.items():
        raws = [w.encode() for w in words]
        got = [coder.encode(r) for r in raws]
        assert got == [tik._core_bpe.encode_single_piece(r) for r in raws]
        short = sum(len(r) <= bpe.LEAF for r in raws)
        if short == len(raws):
            assert calls["join"] == 0 and calls["merge"] <= len(raws)
        elif n >= 40:
            assert calls["join"] > 0
        calls.update(merge=0, join=0)
    assert coder.encode(b"") == []
