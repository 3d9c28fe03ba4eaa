"""The tokenizer's caches stay small and change nothing."""

import public_tokenizers

from spectraloom.llm import bpe


def test_caches_do_not_grow_beyond_their_bounds(monkeypatch):
    assert 2 * bpe.CACHE_PIECES <= 200_000 and bpe.CACHE_PAIRS <= 1 << 18
    tok = bpe.load.__wrapped__(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    text = " ".join(f"w{i * 7919:x}q{i}" for i in range(400))
    want = tok.digest(text)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 50)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    small = bpe.load.__wrapped__(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert small.digest(text) == want
    assert len(small.vocabulary._pairs) <= 50 and len(small._young) <= 20 and len(small._old) <= 20
