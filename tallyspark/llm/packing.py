"""Operator 3: packing documents into token sequences, by Martello-Toth dominance and best fit.

Lengths are whole numbers up to the capacity, so that an instance of any size is a histogram
of at most ``capacity`` counts. The driver solves on that histogram alone:

1. *Dominance reduction.* For the longest piece ``j`` with room ``r`` left beside it, a set is
   fixed for good if it provably dominates every other set that holds ``j``: ``{j}`` if nothing
   fits; ``{j, r}`` if some piece fills the room exactly; ``{j, k}`` (``k`` the longest that
   fits) if no two pieces fit together, or if no three do and ``k`` is at least as long as any
   two that fit.
2. *Best fit, longest first,* of what is left, many equal pieces at a time.

The plan is a list of runs (length, ranks, sequence, offset). Tasks number their pieces of each
length as they make them; a piece's rank is that number after the counts of the tasks before,
and is looked up in the plan. Texts and ids are never shuffled.

Null texts count as empty. An empty text still has its end token. Only documents longer than
the capacity are cut. Repeated rows are packed as rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm import grams
from tallyspark.llm.common import arrow_map, materialize, text_chunks

#: Words whose ids a Python worker keeps; beyond it the store starts anew.
WORDS = 200_000
#: Code points of texts that are tokenized together; a longer text is a pass of its own, in slices.
PASS = 1 << 20
#: Rows up to which the table of first ranks is broadcast (24 bytes each); a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000

#: Of the 256 characters of Latin-1: 1 for letters, 2 for what is neither letter, digit nor white space; their lower case.
_LATIN = [chr(c) for c in range(256)]
_KIND = np.array([1 if c.isalpha() else 0 if c.isalnum() or c.isspace() else 2 for c in _LATIN], dtype=np.uint8)
_LOWER = b"".join(c.lower().encode("latin-1") for c in _LATIN)


class WordTokenizer(dict):
    """Ids of whole texts for a tokenizer that drops white space: words are looked up, unknown ones encoded together.

    The tokenizer's pieces never span white space, its normalizers work within words, and a piece
    ends where a letter meets a character that is neither letter nor digit. A text's ids are
    therefore those of its words in turn, and a space may be put in at such places, which leaves
    few different words. Keys are words, as Latin-1 bytes in lower case or as text; values are
    places in a store of ids. Special tokens in a text are what the tokenizer makes of them.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # without normalizers, for words of characters under 256 in lower case, which those leave as they are
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        vocabulary = self.plain.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # ids that end a piece
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list = []
        self.starts, self.sizes, self.used = np.zeros(WORDS // 8, np.int64), np.zeros(WORDS // 8, np.int64), 0
        self.flat, self.filled = np.zeros(WORDS, "<u4"), 0

    def __missing__(self, word) -> int:
        self[word] = at = self.used + len(self.new)
        self.new.append(word)
        return at

    def words(self, text: str) -> list:
        if not any(t in text for t in self.special):
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                kind = _KIND[np.frombuffer(raw, np.uint8)]
                cuts = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
                if len(cuts):
                    raw = np.insert(np.frombuffer(raw, np.uint8), cuts, 32).tobytes()
                return raw.translate(_LOWER).replace(b"\n", b" ").split(b" ")
        return text.replace("\n", " ").split(" ")

    def _keep(self, at: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """Store the ids of the words at the places ``at``; ``ends``: where each one's ids end."""
        end = self.filled + len(ids)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.filled : end] = ids
        self.sizes[at] = np.diff(ends, prepend=0)
        self.starts[at] = self.filled + ends - self.sizes[at]
        self.filled = end

    def _learn(self) -> None:
        first, words = self.used, self.new
        self.used, self.new = first + len(words), []
        while self.used > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        forms = [w.decode("latin-1") if isinstance(w, bytes) else w for w in words]
        simple = [i for i, (w, f) in enumerate(zip(words, forms, strict=True)) if isinstance(w, bytes) and f.isalpha()]
        for lo in range(0, len(simple), 1000):  # words of letters are one piece each
            some = simple[lo : lo + 1000]
            ids = np.array(self.plain.encode(" ".join([forms[i] for i in some]), add_special_tokens=False).ids, dtype="<u4")
            self._keep(first + np.array(some), ids, np.flatnonzero(self.last[ids]) + 1)
        for i in sorted(set(range(len(words))).difference(simple)):
            tokenizer = self.plain if isinstance(words[i], bytes) else self.tokenizer
            ids = np.array(tokenizer.encode(forms[i], add_special_tokens=False).ids, dtype="<u4")
            self._keep(np.array([first + i]), ids, np.array([len(ids)]))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if self.used > WORDS or self.filled > 8 * WORDS:
            self.reset()
        split = [self.words(t) for t in texts]
        counts = np.array([len(x) for x in split], dtype=np.int64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(counts.sum()))
        del split
        if self.new:
            long = [w for w in self.new if len(w) > 200]
            self._learn()
            for w in long:  # of no use again
                del self[w]
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth) of every document: its ids, then ``end_id``.

    ``ids`` are little-endian unsigned 32-bit integers. ``nth`` counts a task's pieces of one
    length, ``part`` is the task: together they number all pieces without a shuffle.
    """
    schema = "doc_id long, piece int, start long, length long, ids binary, part int, nth long"
    end = end_id.to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        tok, part, seen = _tokenizer(path), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for doc_ids, texts in (p for ids, texts in text_chunks(batches) for p in grams.passes(ids, [t or "" for t in texts], PASS)):
            if len(texts) == 1:
                ids = np.concatenate([tok.encode_all([t])[0] for t in grams.slices(texts[0], PASS)])
                sizes = np.array([len(ids)])
            else:
                ids, sizes = tok.encode_all(texts)
            packed, lo = ids.tobytes(), 0
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids", "part", "nth")}
            for doc_id, size in zip(doc_ids, sizes.tolist(), strict=True):
                whole, lo = packed[lo : lo + 4 * size] + end, lo + 4 * size
                for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                    ids_of = whole[at : at + 4 * capacity]
                    length = len(ids_of) // 4
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(length)
                    out["ids"].append(ids_of)
                    out["part"].append(part)
                    out["nth"].append(seen[length])
                    seen[length] += 1
            yield out

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)


def _reduce(count: list[int], cap: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fix dominating sets; ``count`` keeps the rest. Returns (how many, [(length, times)])."""
    fixed = []
    for j in range(cap, 0, -1):
        while count[j]:
            room = cap - j
            count[j] -= 1  # the piece itself is no partner
            fits = [x for x in range(room, 0, -1) if count[x]]
            count[j] += 1
            if not fits:
                fixed.append((count[j], [(j, 1)]))
                count[j] = 0
                break
            k = fits[0]
            smallest = []
            for x in reversed(fits):
                smallest += [x] * min(count[x] - (x == j), 3 - len(smallest))
                if len(smallest) == 3:
                    break
            dominates = k == room or len(smallest) < 2 or smallest[0] + smallest[1] > room
            if not dominates and (len(smallest) < 3 or sum(smallest) > room):
                dominates = k >= _best_two(fits, count, j, room)
            if not dominates:
                break
            times = count[j] // 2 if k == j else min(count[j], count[k])
            if k != room:
                times = 1 if k == j or times < 1 else times
            fixed.append((times, [(j, 2)] if k == j else [(j, 1), (k, 1)]))
            count[j] -= times
            count[k] -= times
    return fixed


def _best_two(fits: list[int], count: list[int], j: int, room: int) -> int:
    """The largest sum of two pieces that fit together into ``room``."""
    best, lo, hi = 0, len(fits) - 1, 0  # fits falls
    while hi <= lo:
        total = fits[hi] + fits[lo]
        if total > room:
            hi += 1
        else:
            if hi != lo or count[fits[hi]] - (fits[hi] == j) >= 2:
                best = max(best, total)
            lo -= 1
    return best


def _best_fit(count: list[int], cap: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first: equal open sequences are kept as one group."""
    groups: dict[int, list[list]] = {}  # room -> [[how many, pattern]]
    done = []

    def put(room: int, many: int, pattern: list[tuple[int, int]]) -> None:
        if many:
            if room:
                groups.setdefault(room, []).append([many, pattern])
            else:
                done.append((many, pattern))

    for size in range(cap, 0, -1):
        left = count[size]
        while left:
            room = min((r for r in groups if r >= size), default=None)
            if room is None:
                each = min(cap // size, left)
                many = left // each
                put(cap - each * size, many, [(size, each)])
            else:
                have, pattern = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                each = min(room // size, left)
                many = min(have, left // each)
                put(room, have - many, pattern)
                put(room - each * size, many, [*pattern, (size, each)])
            left -= many * each
    return done + [(many, pattern) for same in groups.values() for many, pattern in same]


def plan(lengths: dict[int, int], cap: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many sequences, [(length, times)]) that together hold every piece once."""
    count = [0] * (cap + 1)
    for size, n in lengths.items():
        count[size] += n
    return _reduce(count, cap) + _best_fit(count, cap)


def runs(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Per length: (first rank, rank after the last, first sequence, times in each, first offset)."""
    used: dict[int, int] = {}
    found: dict[int, list] = {}
    sequence = 0
    for many, pattern in patterns:
        offset = 0
        for size, times in pattern:
            first = used.get(size, 0)
            used[size] = first + many * times
            found.setdefault(size, []).append((first, used[size], sequence, times, offset))
            offset += size * times
        sequence += many
    return found


def pack(piece_rows: DataFrame, capacity: int = 2048, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds sequence_id and offset to a materialized table of pieces with length, part and nth, in place of the last two.

    Only lengths and counts are aggregated; the pieces themselves are not shuffled unless the
    table of first ranks, a row for each length of each part, is too large to broadcast.
    """
    from pyspark.sql import Window

    spark = piece_rows.sparkSession
    counted = materialize(piece_rows.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    totals = {int(r["length"]): r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    found = runs(plan(totals, capacity))
    run = spark.createDataFrame(list(found.items()), "length long, runs array<struct<a:long,b:long,sequence:long,times:long,offset:long>>")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    first = counted.select("length", "part", before.alias("base"))
    first = F.broadcast(first) if counted.count() <= broadcast_rows else first
    placed = piece_rows.join(first, ["length", "part"]).join(F.broadcast(run), "length").withColumn("rank", F.col("base") + F.col("nth"))
    placed = placed.withColumn("run", F.expr("filter(runs, x -> x.a <= rank AND rank < x.b)[0]"))
    return (
        placed.withColumn("sequence_id", F.expr("run.sequence + (rank - run.a) div run.times"))
        .withColumn("offset", F.expr("run.offset + pmod(rank - run.a, run.times) * length"))
        .select(*[c for c in piece_rows.columns if c not in ("part", "nth")], "sequence_id", "offset")
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenize, cut what is too long, and pack: one row per piece, with its ids and their CRC."""
    packed = pack(materialize(pieces(docs, path, capacity, end_id), "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "ids")
