"""Byte-level BPE encoding and decoding by backtracking over Aho-Corasick matches.

A sequence of tokens is what the merges produce exactly if each token is what the
merges make of its own bytes, and each two neighbours are what the merges make of
their joint bytes. So a pre-token is encoded without running its merges: an
automaton over the vocabulary (bytes mapped to Latin-1 characters) finds, for each
end, the tokens ending there, longest first; the search walks from the end to the
start, takes the longest token that fits its right neighbour, and steps back where
none fits. A suffix has one encoding, so an end that failed once fails for ever: it
is marked, and each end is left at most once. Whether two tokens fit is memoised;
the work is linear in the length of the pre-token.

Nulls count as the empty text, which has no tokens. A pre-token that is a token as
a whole is that token, as rank-file libraries have it. Texts of any length are encoded
whole; repeated rows are encoded alike; empty tables give no rows; other columns aren't
read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import regex
from pyspark.sql import DataFrame

from harrier.llm.common import map_rows, text_of

#: Pre-tokens that a worker keeps encoded, in each of two generations: when the young
#: one is full it becomes the old one, and what is still in use moves up again.
MEMO_ENTRIES = 250_000
#: Pairs of tokens whose compatibility is kept.
FIT_ENTRIES = 400_000
#: Pre-tokens longer than this are encoded each time instead of kept.
MEMO_CHARS = 64


def read_ranks(path: str) -> bytes:
    """The rank file as it is: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return f.read()


class BytePairCodec:
    """Encodes and decodes by one rank file."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks: dict[bytes, int] = {}
        for line in rank_file.splitlines():
            if line.strip():
                token, rank = line.split()
                self.ranks[base64.b64decode(token)] = int(rank)
        self.pieces = {rank: token for token, rank in self.ranks.items()}
        self.size = max(self.pieces, default=0) + 1
        self.split = regex.compile(pattern).findall
        self.matches = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.matches.add_word(token.decode("latin-1"), (len(token), rank))
        self.matches.make_automaton()
        self._whole: dict[int, bool] = {}
        self._fit: dict[int, bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The merges themselves, lowest rank first, leftmost first: only ever run on
        the bytes of one or two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks, none = self.ranks, self.size
        while len(parts) > 1:
            joined = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
            best = min(joined)
            if best == none:
                break
            at = joined.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def whole(self, token: int) -> bool:
        """Do the merges make this token of its own bytes?"""
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merged(self.pieces[token]) == [token]
        return known

    def fit(self, left: int, right: int) -> bool:
        """Do the merges keep the two tokens apart, and as they are?"""
        key = left * self.size + right
        known = self._fit.get(key)
        if known is None:
            if len(self._fit) >= FIT_ENTRIES:
                self._fit.clear()
            known = self._fit[key] = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one pre-token."""
        token = self.ranks.get(piece)
        if token is not None:
            return (token,)
        ending: list[list[tuple[int, int]]] = [[] for _ in range(len(piece) + 1)]
        for last, found in self.matches.iter(piece.decode("latin-1")):
            ending[last + 1].append(found)
        failed = bytearray(len(piece) + 1)
        tokens: list[int] = []
        tried: list[int] = []
        end, k = len(piece), 0
        whole, fit, size = self._whole, self._fit, self.size  # known answers, without a call
        while end:
            choices = ending[end]
            for k in range(k, len(choices)):
                length, token = choices[k]
                if failed[end - length]:
                    continue
                ok = whole.get(token)
                if ok is None:
                    ok = self.whole(token)
                if ok and tokens:
                    ok = fit.get(token * size + tokens[-1])
                    if ok is None:
                        ok = self.fit(token, tokens[-1])
                if ok:
                    tokens.append(token)
                    tried.append(k)
                    end, k = end - length, 0
                    break
            else:
                if not tokens:
                    raise ValueError(f"the vocabulary has no encoding of {piece[:80]!r}")
                failed[end] = 1
                end += len(self.pieces[tokens.pop()])
                k = tried.pop() + 1
        tokens.reverse()
        return tuple(tokens)

    def encode(self, text: str) -> list[int]:
        """The token ids of a text, without special tokens."""
        memo, found = self.memo, []
        for word in self.split(text):
            ids = memo.get(word)
            if ids is None:
                ids = self.older.get(word)
                if ids is None:
                    ids = self.encode_piece(word.encode("utf-8", "surrogatepass"))
                if len(word) <= MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        self.memo, self.older = {}, memo
                        memo = self.memo
                    memo[word] = ids
            found.append(ids)
        return list(chain.from_iterable(found))

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of the tokens; an unknown id is a KeyError."""
        return b"".join(map(self.pieces.__getitem__, ids))


_codecs: dict[bytes, BytePairCodec] = {}


def codec(rank_file: bytes, pattern: str) -> BytePairCodec:
    """One codec for each worker and vocabulary: its memos serve all tasks."""
    key = hashlib.sha256(rank_file + pattern.encode()).digest()
    if key not in _codecs:
        _codecs[key] = BytePairCodec(rank_file, pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of each document: ``(id, token_ids array<int>)``, a row for each row."""
    rank_file = docs.sparkSession.sparkContext.broadcast(read_ranks(path))  # the vocabulary file: about 1 MB

    def rows(values: Iterator[tuple]) -> Iterator[tuple]:
        own = codec(rank_file.value, pattern)
        for key, text in values:
            yield key, own.encode(text)

    return map_rows(docs, [docs[id_col].alias("doc_id"), text_of(text_col)], rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, token_ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of each row's ``token_ids``; null ids count as none."""
    rank_file = encoded.sparkSession.sparkContext.broadcast(read_ranks(path))

    def rows(values: Iterator[tuple]) -> Iterator[tuple]:
        own = codec(rank_file.value, pattern)
        for key, ids in values:
            yield key, own.decode(ids or [])

    return map_rows(encoded, ["doc_id", "token_ids"], rows, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and return ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.

    One narrow pass: neither the ids nor the decoded bytes leave the worker.
    """
    rank_file = docs.sparkSession.sparkContext.broadcast(read_ranks(path))

    def rows(values: Iterator[tuple]) -> Iterator[tuple]:
        own = codec(rank_file.value, pattern)
        decimal = [str(i) for i in range(own.size)]
        for key, text in values:
            ids = own.encode(text)
            joined = " ".join(map(decimal.__getitem__, ids))
            yield key, len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()

    return map_rows(docs, [docs[id_col].alias("doc_id"), text_of(text_col)], rows, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
