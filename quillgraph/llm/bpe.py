"""Byte-level BPE by monoid tree reduction.

A text is halved until a piece is short, the pieces are encoded, and neighbours are joined up the tree. Two levels use the
same rule, "re-encode a window around the seam and let it grow until the tokens outside can't change":

* words: matches of the pattern depend on what follows them only, so a match stays if nothing it looked at lies beyond the
  seam, and re-matching stops as soon as it meets a match boundary of the right part;
* bytes of one long word: a token sequence is its bytes' encoding exactly if every pair of neighbours encodes to itself
  (the first merge across a token boundary would also happen in the pair alone). The window grows until both of its edge
  pairs do.

Decoding joins the tokens' bytes up a balanced tree of slices. Null texts count as empty: no tokens, the hash of no bytes.
Repeated rows give repeated results, and other columns are left out.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from quillgraph.llm.common import per_batch

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Code points of a leaf of words, bytes of a leaf of one word, ids of a leaf of decoding.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 16_384, 64, 65_536
#: Words whose ids a worker remembers, in two generations of at most so many each, and pairs of tokens.
MEMO = 500_000
#: A match ends at least so far before the seam if nothing beyond it was looked at: one lookahead, or an apostrophe's letters.
LOOK = 3


def tree(n: int, leaf: int, encode: Callable[[int, int], list], join: Callable[[list, list, int], list], start: int = 0) -> list:
    """Reduces [start, start + n) by halves: ``encode(from, to)`` of leaves, ``join(left, right, seam)`` of neighbours."""
    if n <= leaf:
        return encode(start, start + n)
    half = n // 2
    return join(tree(half, leaf, encode, join, start), tree(n - half, leaf, encode, join, start + half), start + half)


class Encoder:
    """Encodes and decodes by a rank file of base64 tokens; ``pattern`` cuts a text into words that are encoded separately."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.matcher = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.kept: dict[tuple[int, int], bool] = {}
        self.own = {raw: rank for raw, rank in self.ranks.items() if self.merged(raw) == [rank]}  # some can't be reached by merges
        self.longest = max(map(len, self.own))
        self.four = [rank.to_bytes(4, "little") for rank in range(len(self.tokens))]

    def merged(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, until no neighbours merge. Only for the bytes of one or two tokens: quadratic."""
        ranks, none = self.ranks, 1 << 60
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1], none)
        return [ranks[x] for x in parts]

    def leaf(self, raw: bytes) -> list[int]:
        """The only token sequence whose neighbours all stand: the longest token first, back a step where none fits."""
        ids, ends, own, kept, end = [], [], self.own, self.kept, len(raw)
        at, last, size = 0, -1, min(self.longest, end)
        while at < end:
            for stop in range(min(at + size, end), at, -1):
                token = own.get(raw[at:stop])
                if token is not None:
                    fits = last < 0 or kept.get((last, token))
                    if fits or fits is None and self.stands(last, token):
                        ends.append(at)
                        ids.append(token)
                        at, last, size = stop, token, self.longest
                        break
            else:
                ids.pop()
                size = at - ends[-1] - 1
                at, last = ends.pop(), ids[-1] if ids else -1
        return ids

    def stands(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens are the encoding of their bytes."""
        known = self.kept.get((a, b))
        if known is None:
            if len(self.kept) >= MEMO:
                self.kept.clear()
            known = self.kept[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join_bytes(self, left: list[int], right: list[int], _seam: int = 0) -> list[int]:
        if not left or not right or self.stands(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.leaf(b"".join([self.tokens[i] for i in left[-a:] + right[:b]]))
            ok_left = a == len(left) or self.stands(left[-a - 1], window[0])
            ok_right = b == len(right) or self.stands(window[-1], right[b])
            if ok_left and ok_right:
                return left[:-a] + window + right[b:]
            a, b = a if ok_left else a * 2, b if ok_right else b * 2

    def word_ids(self, word: str) -> list[int]:
        raw = word.encode()
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        return tree(len(raw), LEAF_BYTES, lambda i, j: self.leaf(raw[i:j]), self.join_bytes)

    def packed(self, word: str) -> bytes:
        """A word's ids as little-endian unsigned 32-bit integers."""
        got = self.older.get(word)
        if got is None:
            four = self.four
            got = b"".join([four[x] for x in self.word_ids(word)])
        if len(word) <= 64:
            if len(self.memo) >= MEMO:
                self.memo, self.older = {}, self.memo
            self.memo[word] = got
        return got

    def words(self, text: str) -> list[str]:
        """The pattern's matches over the whole text, found by halves."""

        def join(left: list[str], right: list[str], seam: int) -> list[str]:
            at, back = seam, 0
            while back < len(left) and (back == 0 or at > seam - LOOK):  # the last match, and all that may have looked beyond the seam
                back += 1
                at -= len(left[-back])
            window, ahead, right_at = [], 0, seam
            for m in self.matcher.finditer(text, at, seam + sum(map(len, right))):
                window.append(m.group())
                while right_at < m.end() and ahead < len(right):
                    right_at += len(right[ahead])
                    ahead += 1
                if right_at == m.end():
                    break
            return left[: len(left) - back] + window + right[ahead:]

        return tree(len(text), LEAF_CHARS, lambda i, j: self.matcher.findall(text[i:j]), join)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, packed."""
        memo, packed = self.memo, self.packed  # packed() may begin a new memo; this one serves on till the text's end
        return b"".join([memo.get(w) or packed(w) for w in self.words(text or "")])

    def decode(self, ids: bytes) -> bytes:
        table, all_ids = self.tokens, np.frombuffer(ids, "<u4")
        return b"".join(tree(len(all_ids), LEAF_IDS, lambda i, j: [b"".join([table[x] for x in all_ids[i:j].tolist()])], lambda a, b, _: [b"".join(a + b)]))


@functools.lru_cache(2)
def encoder(vocabulary: str, pattern: str | None = None) -> Encoder:
    """``vocabulary``: a path on every machine, or a name of the public tokenizers' package, which is installed there."""
    import public_tokenizers

    return Encoder(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) of every whole text."""
    kind = docs.schema[id_column].dataType.simpleString()
    return per_batch(docs, [id_column, text_column], lambda keys, texts: {id_column: keys, "ids": [encoder(vocabulary).encode(t) for t in texts]}, f"{id_column} {kind}, ids binary")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, id_column: str = "doc_id") -> DataFrame:
    """doc_id, raw (binary) of packed ids."""
    kind = encoded.schema[id_column].dataType.simpleString()
    return per_batch(encoded, [id_column, "ids"], lambda keys, ids: {id_column: keys, "raw": [encoder(vocabulary).decode(x or b"") for x in ids]}, f"{id_column} {kind}, raw binary")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trips: each text encoded and its ids decoded, in one pass without a shuffle."""

    def work(keys: list, texts: list) -> dict:
        bpe = encoder(vocabulary)
        out: dict = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", "round_trips")}
        for text in texts:
            ids = bpe.encode(text)
            raw = bpe.decode(ids)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(raw).hexdigest())
            out["round_trips"].append(raw == (text or "").encode())
        return {"doc_id": keys} | out

    return per_batch(docs, ["doc_id", "text"], work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trips boolean")
