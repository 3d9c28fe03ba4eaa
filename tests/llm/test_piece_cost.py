"""Tokenizer: a piece's tokens are found without the entries of all its prefixes."""

import random

import public_tokenizers

from spectraloom.llm import bpe


class Counted(dict):
    looked = 0

    def get(self, *key):
        self.looked += 1
        return super().get(*key)


def test_tokens_are_the_prefix_table_s_by_fewer_lookups():
    v = bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).vocabulary
    rng = random.Random(3)
    words = ["".join(rng.choice("aeinrsth") for _ in range(rng.randint(1, 40))).encode() for _ in range(500)]
    odd = [rng.randbytes(rng.randint(1, 40)) for _ in range(300)] + [b"", b" " * 700, b"ab" * 700, "é日".encode() * 99]
    v.tokens(b"the"), [v.tokens(w) for w in words]
    ranks, v.ranks = v.ranks, Counted(v.ranks)
    try:
        quick = [v.tokens(w) for w in words]
        few, v.ranks.looked = v.ranks.looked, 0
        whole = [bpe.PrefixTable(v, w).tokens() for w in words]
        assert quick == whole and few < 0.6 * v.ranks.looked
    finally:
        v.ranks = ranks
    assert all(v.tokens(w) == bpe.PrefixTable(v, w).tokens() for w in odd)
    tok = bpe.Tokenizer(dict(ranks), public_tokenizers.PATTERN)
    tok.vocabulary.tokens = lambda data: [ranks[bytes([c])] for c in data]
    assert len(tok.piece(words[0] + b"qzqz")) == len(words[0]) + 4
