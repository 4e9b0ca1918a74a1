"""Byte-level BPE by longest matches and pair compatibility.

Bytes are mapped to Latin-1 so that one automaton over characters finds every
vocabulary entry at every place of a match. Encoding takes the longest entry and
backtracks to a shorter one wherever two neighbours could not stand side by side
in a BPE encoding. Whether they can depends on the two tokens alone, so answers
are remembered, and each place is given up at most once: the work is linear in
the length, and the ids equal those of the ranked merges.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from bidweave.llm.common import prepare

#: Bounds of what a worker remembers; when one is full, it starts anew. Longer pieces aren't remembered.
MAX_PIECES = 300_000
MAX_PAIRS = 1_000_000
MAX_LENGTH = 48
#: Fixed value: the pattern for which texts may be cut at blanks and plain words taken apart; others see whole texts.
CUTTABLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space as the rank files' pattern means it (the Unicode property, which Python's \s exceeds).
WHITE = r"\t-\r \x85\xa0  -     　"
#: A word of plain Latin letters with marks after it: the pattern's matches are these two groups.
_plain = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:%$#&*|]*)", re.ASCII).fullmatch
_before_space = re.compile(rf"[{WHITE}\x1c-\x1f] ")


def split_pattern(pattern: str) -> str:
    """The pattern with white space spelled out, inside and outside of classes."""
    out = re.sub(r"\[\^\\s", lambda _: f"[^{WHITE}", pattern)
    return out.replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


class Codec:
    """Encodes and decodes whole texts with one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank << 8 | min(len(token), 255))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.shorter: dict[int, int] = {}
        self.size = list(map(len, self.bytes_of))
        self.pairs: dict[int, bool] = {}
        self.matches: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        matches = regex.compile(split_pattern(pattern))
        self.find, self.finditer = matches.findall, matches.finditer
        self.cuttable = pattern == CUTTABLE

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; none for a byte or an entry no merge reaches."""
        if token in self.halves:
            return self.halves[token]
        text = self.bytes_of[token]
        parts = [self.ranks[text[i : i + 1]] for i in range(len(text))]
        while len(parts) > 2:
            at, rank = -1, token
            for i in range(len(parts) - 1):
                merged = self.ranks.get(self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]], token)
                if merged < rank:
                    at, rank = i, merged
            if at < 0:
                break
            parts[at : at + 2] = [rank]
        self.halves[token] = found = (parts[0], parts[1]) if len(parts) == 2 else None
        return found

    def _shorter(self, token: int) -> int:
        """The longest other vocabulary entry that starts this one; -1 if none does."""
        if token not in self.shorter:
            text = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), -1)
        return self.shorter[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging would leave ``left`` and ``right`` as neighbours: no merge across their border comes first.

        Both tokens are taken apart, the later merge first; a merge that spans the border and ranks below the
        merge undone would have happened before it.
        """
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        a, b, limit = left, right, 1 << 40
        answer = True
        while True:
            across = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if across is not None and across < limit:
                answer = False
                break
            one, two = self._halves(a), self._halves(b)
            if a > b or (a == b and two is None):
                if one is None:
                    if two is None:
                        break
                    limit, b = b, two[0]
                    if across is not None and across < limit:
                        answer = False
                        break
                    continue
                limit, a = a, one[1]
                if b == left:
                    limit += 1
            else:
                if two is None:
                    if one is None:
                        break
                    limit, a = a, one[1]
                    continue
                limit, b = b + 1, two[0]
        if len(self.pairs) >= MAX_PAIRS:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def encode_match(self, raw: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        latin = raw.decode("latin-1")
        pairs = self.pairs
        greedy: list[int] = []
        for _, found in self.automaton.iter_long(latin):
            token = found >> 8
            if greedy:
                fits = pairs.get(greedy[-1] << 32 | token)
                if not (self.compatible(greedy[-1], token) if fits is None else fits):
                    break
            greedy.append(token)
        else:
            return greedy
        longest = [0] * len(raw)
        for end, found in self.automaton.iter(latin):
            n = found & 255
            if n == 255:
                n = len(self.bytes_of[found >> 8])
            at = end - n + 1
            if n > (longest[at] & 255):
                longest[at] = found
        longest = [found >> 8 for found in longest]
        size, shorter = self.size, self.shorter
        out: list[int] = []
        at, end, token, left = 0, len(raw), longest[0], -1
        dead = bytearray(end + 1)  # places from which no encoding reaches the end
        while at < end:
            while token >= 0:
                to = at + size[token]
                if not dead[to]:
                    if left < 0:
                        break
                    fits = pairs.get(left << 32 | token)
                    if self.compatible(left, token) if fits is None else fits:
                        break
                next_one = shorter.get(token)
                token = self._shorter(token) if next_one is None else next_one
            if token < 0:
                dead[at] = 1
                token = out.pop()
                left = out[-1] if out else -1
                at -= size[token]
                token = self._shorter(token)
                continue
            out.append(token)
            at, left = to, token
            if at < end:
                token = longest[at]
        return out

    def _match(self, match: str) -> bytes:
        got = self.matches.get(match)
        if got is None:
            got = array("I", self.encode_match(match.encode("utf-8"))).tobytes()
            if len(match) <= MAX_LENGTH:
                if len(self.matches) >= MAX_PIECES:
                    self.matches.clear()
                self.matches[match] = got
        return got

    def _piece(self, piece: str) -> bytes:
        plain = _plain(piece)
        if plain:
            word, marks = plain.groups()
            return self._match(word) + self._match(marks) if marks else self._match(word)
        return b"".join(map(self._match, self.find(piece)))

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers.

        The pattern never looks back and no match crosses from other characters into white space, so a text
        may be cut before a space that follows a character that is not white; equal pieces are encoded once.
        """
        if not text:
            return b""
        if not self.cuttable:
            return b"".join(self._match(m[0]) for m in self.finditer(text))
        if "  " in text or _before_space.search(text):
            return self._piece(text) if len(text) < 4096 else b"".join(map(self._piece, _cut(text)))
        first, *rest = text.split(" ")
        known = self.pieces
        out = [self._piece(first)]
        for piece in rest:
            got = known.get(piece)
            if got is None:
                got = self._piece(" " + piece)
                if len(piece) <= MAX_LENGTH:
                    if len(known) >= MAX_PIECES:
                        known.clear()
                    known[piece] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for."""
        got = array("I")
        got.frombytes(ids)
        return b"".join(map(self.bytes_of.__getitem__, got))


_safe_cut = re.compile(rf"(?<=[^{WHITE}\x1c-\x1f])(?=[{WHITE}])")


def _cut(text: str) -> list[str]:
    """Pieces that the pattern can take one by one: cut where white space follows another character."""
    return _safe_cut.split(text)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the bytes decoded from them, for every whole text.

    Null and empty texts have no ids. Rows are independent and nothing is shuffled; repeated rows repeat, null ids stay
    null, other columns are not read, and an empty table gives no rows. A text of any length is encoded piece by piece;
    a single match of the pattern (a long run without blanks, say) takes memory of some hundred times its length.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            n, ids_digest, text_digest = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                ids_digest.append(hashlib.sha256(ids).hexdigest())
                text_digest.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, type=pa.int64()), pa.array(ids_digest), pa.array(text_digest)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
