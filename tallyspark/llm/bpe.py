"""Operator 4: byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a piece there is exactly one token that ends the BPE encoding of that
prefix. The table of these last tokens is built left to right: of the tokens that end the
prefix, longest first, the valid one is the first that BPE would keep apart from the last
token before it. Walking the table backwards gives the encoding, appending bytes only adds
entries, and an edit only redoes entries from the edit on (:class:`PrefixTable`).

Rows are independent, so the DataFrame operator is one narrow ``mapInArrow`` without a
shuffle. Null texts count as empty (no tokens); repeated rows give repeated results; an
empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_map, text_chunks

#: Entries of the caches a Python worker keeps; beyond it they start anew.
CACHE = 400_000


class Vocabulary:
    """Ranks of a byte-level BPE and the rule that says which neighbours BPE keeps apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.longest = max(map(len, ranks), default=0)
        self._apart: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        for rank, token in enumerate(self.tokens):
            if len(token) > 1:
                self.halves[rank] = self._halves(rank, token)
        self._automaton()

    def _halves(self, rank: int, token: bytes) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None if merges never reach it."""
        for cut in range(1, len(token)):
            a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if a is not None and b is not None and a < rank and b < rank and self._reached(a) and self._reached(b) and self._kept(a, b, rank):
                return a, b
        return None

    def _reached(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.halves.get(token) is not None

    def _kept(self, a: int, b: int, below: int) -> bool:
        """Whether merges of rank under ``below`` leave the border between ``a`` and ``b`` alone.

        Undo merges from both sides, the latest first: at each point of time the tokens that
        then touch the border must not have been due for a merge.
        """
        ranks, tokens = self.ranks, self.tokens
        while True:
            due = ranks.get(tokens[a] + tokens[b])
            if due is not None and due < below:
                return False
            one_a, one_b = len(tokens[a]) == 1, len(tokens[b]) == 1
            if one_a and one_b:
                return True
            # the side that was merged last is the one to open; at equal ranks the left merge came first
            if one_b or (not one_a and a > b):
                below, a = a, self.halves[a][1]
            else:
                below, b = b + 1, self.halves[b][0]

    def apart(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= 2 * CACHE:
                self._apart.clear()
            known = self._apart[key] = self._kept(a, b, 1 << 60)
        return known

    def _automaton(self) -> None:
        """A trie of the tokens with failure links: after each byte, the tokens that end there."""
        self.child: dict[int, int] = {}
        at, own, order = 0, [-1], [0]
        for rank, token in enumerate(self.tokens):
            if token and self._reached(rank):
                at = 0
                for byte in token:
                    key = at << 8 | byte
                    if key not in self.child:
                        self.child[key] = len(own)
                        own.append(-1)
                    at = self.child[key]
                own[at] = rank
        below: list[list[tuple[int, int]]] = [[] for _ in own]
        for key, node in self.child.items():
            below[key >> 8].append((key & 255, node))
        self.fail = [0] * len(own)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)  # (token, its length), longest first
        for node in order:  # grows: breadth first
            for byte, down in below[node]:
                self.fail[down] = self._step(self.fail[node], byte) if node else 0
                mine = ((own[down], len(self.tokens[own[down]])),) if own[down] >= 0 else ()
                self.ends[down] = mine + self.ends[self.fail[down]]
                order.append(down)

    def _step(self, state: int, byte: int) -> int:
        node = self.child.get(state << 8 | byte)
        while node is None and state:
            state = self.fail[state]
            node = self.child.get(state << 8 | byte)
        return node or 0

    def extend(self, state: int, byte: int, last: list[int]) -> tuple[int, int]:
        """One byte more: the automaton's state and the prefix's last token, from those of the shorter prefixes."""
        state = self._step(state, byte)
        end, known = len(last), self._apart
        for token, size in self.ends[state]:
            if size == end:
                return state, token
            ok = known.get((last[end - size], token))
            if ok or (ok is None and self.apart(last[end - size], token)):
                return state, token
        raise ValueError("a byte has no token")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class PrefixTable:
    """The last tokens of all prefixes of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.states = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; no earlier entry changes."""
        self.data += more
        for byte in more:
            state, token = self.vocabulary.extend(self.states[-1], byte, self.last)
            self.last.append(token)
            self.states.append(state)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Put ``new`` in place of ``data[start:stop]``; entries up to ``start`` are kept."""
        rest = self.data[stop:]
        self.data, self.last, self.states = self.data[:start], self.last[: start + 1], self.states[: start + 1]
        self.append(new + rest)

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.tokens[self.last[end]])
        return out[::-1]


class Codec:
    """Encodes whole texts: each match of the pattern by itself.

    The distinct unknown pieces of many texts are taken in sorted order, so that each continues the prefix
    table of the one before from their common prefix on.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.vocabulary = Vocabulary(ranks)
        self.pattern = regex.compile(pattern)
        self.cut = splits_at_spaces(pattern)
        self.words: dict[str, bytes] = {}  # packed ids of a space and what follows it up to the next
        self.known: dict[str, bytes] = {}  # and of pieces

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the collector would walk the caches over and over
        try:
            return self._encode_all(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.cut and len(text) > LONG:
                out.append(b"".join(self._encode([part])[0] for part in _slices(text)))
            else:
                out.append(text)
        short = iter(self._encode([t for t in out if isinstance(t, str)]))
        return [t if isinstance(t, bytes) else next(short) for t in out]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > CACHE:
            self.words.clear()
        split = [self._parts(t) for t in texts]
        unknown = set().union(*(words for _, words in split)) - self.words.keys()
        pieces = {w: self.pattern.findall(" " + w) for w in unknown}
        heads = [self.pattern.findall(head) for head, _ in split]
        if len(self.known) > CACHE:
            self.known.clear()
        packed = self.known
        packed.update(self._pieces(set().union(*pieces.values(), *heads) - packed.keys()))
        for w, found in pieces.items():
            self.words[w] = packed[found[0]] if len(found) == 1 else b"".join(map(packed.__getitem__, found))
        ids = [b"".join([*map(packed.__getitem__, head), *map(self.words.__getitem__, words)]) for head, (_, words) in zip(heads, split, strict=True)]
        for w in unknown:
            if len(w) > 64:  # of no use again
                del self.words[w]
        for piece in chain.from_iterable(heads + [pieces[w] for w in unknown if len(w) > 64]):
            if len(piece) > 64:
                packed.pop(piece, None)
        return ids

    def _parts(self, text: str) -> tuple[str, list[str]]:
        """What stands before the first space, and after each; all of a text as its head where that cut is not sure."""
        if not self.cut or _ODD_SPACE.search(text):
            return text, []
        head, *rest = text.split(" ")
        return head, rest

    def _pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of pieces."""
        v, out, before = self.vocabulary, {}, b""
        ranks, tokens, child, ends, known = v.ranks, v.tokens, v.child, v.ends, v._apart
        last, states = [-1], [0]
        for data, piece in sorted((p.encode(), p) for p in pieces):
            if data in ranks:  # a piece that is a token stays whole
                out[piece] = struct.pack("<I", ranks[data])
                continue
            same, most = 0, min(len(before), len(data))
            while same < most and before[same] == data[same]:
                same += 1
            del last[same + 1 :], states[same + 1 :]
            before, state = data, states[same]
            for byte in data[same:]:  # as Vocabulary.extend, in place
                down = child.get(state << 8 | byte)
                state = v._step(state, byte) if down is None else down
                end = len(last)
                for token, size in ends[state]:
                    if size == end:
                        break
                    ok = known.get((last[end - size], token))
                    if ok or (ok is None and v.apart(last[end - size], token)):
                        break
                else:
                    raise ValueError("a byte has no token")
                last.append(token)
                states.append(state)
            ids, end = [], len(data)
            while end:
                ids.append(token := last[end])
                end -= len(tokens[token])
            ids.reverse()
            out[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def decode(self, packed: bytes) -> bytes:
        return self.vocabulary.decode(memoryview(packed).cast("I"))


#: A space that white space or the end follows. Elsewhere a match of the pattern starts at every
#: space, so that a text may be cut there and its parts be looked up whole.
_ODD_SPACE = regex.compile(r" (?:\s|\Z)")
#: A space between other characters, where a long text may be cut.
_SINGLE_SPACE = regex.compile(r"(?<=\S) (?=\S)")
#: Code points from which on a text is taken in slices.
LONG = 1 << 20


def _slices(text: str):
    """The text in parts of about LONG code points."""
    at = 0
    while found := _SINGLE_SPACE.search(text, at + LONG):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def splits_at_spaces(pattern: str) -> bool:
    """Whether the cut at spaces is proven for this pattern."""
    import public_tokenizers

    return pattern == public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids packed])."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(batches):
        c = codec(path, pattern)
        for ids, texts in text_chunks(batches, 1000):
            packed = c.encode_all([t or "" for t in texts])
            out = {
                "doc_id": ids, "n_tokens": [len(p) // 4 for p in packed],
                "ids_sha256": [hashlib.sha256(p).hexdigest() for p in packed],
                "decoded_sha256": [hashlib.sha256(c.decode(p)).hexdigest() for p in packed],
            }
            yield out | ({"ids": packed} if with_ids else {})

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Texts (as bytes) of the packed ids that :func:`encode` returns."""

    def run(batches):
        c = codec(path, pattern)
        for ids, packed in text_chunks(batches):
            yield {"doc_id": ids, "decoded": [c.decode(p or b"") for p in packed]}

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, decoded binary")
