"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its encoding. The
table of those last tokens gives the encoding (walk back from the end), can be
appended to without looking at what came before, and after an edit is kept up
to the edit and refilled behind it.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spectraloom.llm.common import tidied

#: Pieces whose encoding a worker keeps in each of two generations.
CACHE_PIECES = 100_000
#: Pairs of tokens whose test a worker keeps, as one number each.
CACHE_PAIRS = 1 << 18


class Vocabulary:
    """Ranks of a tiktoken file and the test whether two tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token_bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.reachable: set[int] = set()
        self._pairs: dict[int, bool] = {}
        for token in sorted(self.token_bytes):
            self._split(token)
        self._pairs.clear()
        # Most bytes of a token with these first four.
        self._reach: dict[bytes, int] = {}
        for b in ranks:
            if len(b) > 3:
                self._reach[b[:4]] = max(len(b), self._reach.get(b[:4], 0))

    def _split(self, token: int) -> None:
        """The two tokens whose merge makes ``token``; a single byte has none."""
        b = self.token_bytes[token]
        if len(b) == 1:
            self.reachable.add(token)
            return
        for i in range(1, len(b)):
            a, z = self.ranks.get(b[:i]), self.ranks.get(b[i:])
            if a is not None and z is not None and max(a, z) < token and {a, z} <= self.reachable and self._beside(a, z, token):
                self.left[token], self.right[token] = a, z
                self.reachable.add(token)
                return

    def _beside(self, a: int, z: int, below: int) -> bool:
        """Whether merges of rank under ``below`` leave the boundary between a and z alone.

        Undoes the later of the two outer merges step by step; the boundary
        falls if a pair that meets there would have merged earlier.
        """
        limit = below
        while True:
            joined = self.ranks.get(self.token_bytes[a] + self.token_bytes[z])
            if joined is not None and joined < limit:
                return False
            inner_a, inner_z = self.right.get(a), self.left.get(z)
            if inner_a is None and inner_z is None:
                return True
            if inner_z is None or (inner_a is not None and a > z):
                limit, a = a, inner_a
            else:
                limit, z = z + 1, inner_z

    def beside(self, a: int, z: int) -> bool:
        key = a << 32 | z
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._beside(a, z, 1 << 62)
        return known

    def tokens(self, data: bytes) -> list[int]:
        """The tokens of ``data``, from entries of its prefix table that the longest tokens ask for.

        Each end is reached by the one token of its entry, so that an end from
        which no token leads on is never tried again.
        """
        get, known, beside, reach = self.ranks.get, self.reachable, self.beside, self._reach.get
        n = len(data)
        out, begins, dead = [], [], set()
        start, most = 0, min(n, reach(data[:4], 3))
        while start < n:
            for end in range(most, start, -1):
                token = get(data[start:end])
                if token is not None and end not in dead and token in known and (not out or beside(out[-1], token)):
                    out.append(token)
                    begins.append(start)
                    start, most = end, min(n, end + reach(data[end : end + 4], 3))
                    break
            else:
                if not out:
                    raise ValueError("a byte has no token")
                dead.add(start)
                out.pop()
                start, most = begins.pop(), start - 1
        return out


class PrefixTable:
    """Last token of each prefix of ``data``; ``last[i]`` ends the prefix of length i + 1."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> PrefixTable:
        v, last = self.vocabulary, self.last
        ranks, known = v.ranks, v.reachable
        self.data = data = self.data + more
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - v.longest), end):
                token = ranks.get(data[start:end])
                if token is not None and token in known and (not start or v.beside(last[start - 1], token)):
                    last.append(token)
                    break
        return self

    def edit(self, start: int, end: int, new: bytes) -> PrefixTable:
        """Replace ``data[start:end]``; entries before ``start`` stay."""
        tail = self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        return self.append(new + tail)

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.token_bytes[out[-1]])
        return out[::-1]


class Tokenizer:
    """Encodes each match of ``pattern`` by a prefix table; recent pieces are kept in two generations."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary, self.pattern = Vocabulary(ranks), regex.compile(pattern)
        self._text = {i: b"%d" % i for i in self.vocabulary.token_bytes}
        self._young: dict[str, tuple[bytes, bytes]] = {}
        self._old: dict[str, tuple[bytes, bytes]] = {}

    def piece(self, data: bytes) -> list[int]:
        whole = self.vocabulary.ranks.get(data)
        return [whole] if whole is not None else self.vocabulary.tokens(data)

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pattern.findall(text) for i in self.piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.token_bytes.__getitem__, ids))

    def _missing(self, p: str) -> tuple[bytes, bytes]:
        found = self._old.get(p)
        if found is None:
            ids = self.piece(p.encode())
            found = b",".join([self._text[i] for i in ids]), self.decode(ids)
        if len(self._young) >= CACHE_PIECES:
            self._old, self._young = self._young, {}
        self._young[p] = found
        return found

    def forget(self) -> None:
        """Drop the older pieces, and all if the newer ones are many: a worker may do something else next."""
        self._old = {}
        if len(self._young) > CACHE_PIECES // 2:
            self._young = {}

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded bytes."""
        get, missing = self._young.get, self._missing
        parts = [get(p) or missing(p) for p in self.pattern.findall(text)]
        ids = b",".join([a for a, _ in parts])
        return (ids.count(b",") + 1 if parts else 0), hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join([b for _, b in parts])).hexdigest()


@functools.lru_cache(2)
def load(path: str, pattern: str) -> Tokenizer:
    """The tokenizer of a rank file, once per process."""
    with open(path, "rb") as lines:
        return Tokenizer({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>: the token ids of every whole text; a null or empty text has none."""

    @tidied
    def work(batches):
        tok = load(path, pattern)
        for b in batches:
            ids = [tok.encode(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded binary of rows (doc_id, ids); null ids decode to no bytes."""

    @tidied
    def work(batches):
        tok = load(path, pattern)
        for b in batches:
            out = [tok.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    One map over the rows, no shuffle. A null text is empty: no tokens, the
    digests of no bytes. Repeated rows give repeated results; other columns of
    ``docs`` are not read.
    """

    @tidied
    def work(batches):
        tok = load(path, pattern)
        for b in batches:
            n, ids, decoded = [], [], []
            for t in b.column("text"):
                x = tok.digest(t.as_py() or "")
                n.append(x[0]), ids.append(x[1]), decoded.append(x[2])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        tok.forget()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
