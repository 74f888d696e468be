"""Best-fit packing with exact complements (operator 2).

Documents become token ids and pieces of at most ``capacity`` tokens. What is packed is the histogram of piece lengths,
which has at most ``capacity`` rows however many documents there are. The longest piece left opens a sequence; an index
of the sums of one, two and three lengths, kept under the counts still available, tells whether some combination fills
its gap exactly, and as many sequences as the counts allow are built at once. Pieces without an exact complement are
placed by best fit. The result is a list of patterns (lengths with offsets, times used); pieces take their places in
it by their rank among pieces of equal length.

Defined results: a null text is an empty one, which is the end id alone. Only documents longer than ``capacity`` are cut.
Repeated rows are packed as often as they occur. An empty table gives an empty result. Null ids are kept.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import cut, returned, small_batches

END = 1
#: Kinds of bytes. A stretch ends before a byte of a larger kind, except that only white space ends one after ``_OTHER``.
_OTHER, _LETTER, _SIGN, _SPACE, _LEAD, _MARK = range(6)
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = _LETTER
#: Signs that are one unit when they stand together.
_KIND[list(b"!#$%&*+,-./:;=?@^_~|()[]{}")] = _SIGN
_KIND[9:14] = _KIND[32] = _SPACE
#: First bytes of U+00C0 to U+017F, letters but for a few, and of U+0300 to U+037F, marks that join an ASCII letter.
_KIND[0xC3:0xC6], _KIND[0xCC:0xCE] = _LEAD, _MARK
#: The signs for times and divided by; the capital I with a dot, whose lower case ends in a mark.
_NOT_LETTERS = [0xC397, 0xC3B7, 0xC4B0]
#: Bytes in lower case, with one kind of white space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32


class Encoder:
    """Token ids of whole texts, each distinct stretch of a batch looked up once and encoded if it is new.

    The vocabulary's tokenizer drops white space and never looks across it, so a text's ids are those of its stretches
    in order; full stops and commas are tokens of their own beside letters. Both are checked in the tests. Texts stay in
    Arrow's flat arrays: only stretches that are not known become Python strings.
    """

    def __init__(self, file: str, room: int = 450_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.room = Tokenizer.from_file(file), room
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)  # the last token of a unit
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        # The ids of known stretch i are flat[bounds[i] : bounds[i + 1]].
        self.bounds, self.flat = np.zeros(1, np.int64), np.empty(0, "<u4")

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.array([len(ids) for ids in got], np.int64)
        return np.fromiter(chain.from_iterable(got), "<u4", int(sizes.sum())), sizes

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters alone: one unit each, so many of them are encoded as one text."""
        ids, _ = self._each([" ".join(words)])
        ends = np.flatnonzero(self.ending[ids]) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            return ids, np.diff(ends, prepend=0)
        return self._each(words)  # letters that normalise to several units

    def _learn(self, new: pa.StringArray) -> np.ndarray:
        """Encode ``new`` and return its places among the known stretches."""
        words = [w.lstrip(" ") for w in new.to_numpy(zero_copy_only=False)]
        letters = np.fromiter((w.lower().isalpha() for w in words), bool, len(words))
        order = np.argsort(~letters, kind="stable")
        found = []
        for encode, mine, step in ((self._letters, order[: letters.sum()], 20_000), (self._each, order[letters.sum() :], 1000)):
            for at in range(0, len(mine), step):
                found.append(encode([words[i] for i in mine[at : at + step].tolist()]))
        places = np.empty(len(words), np.int64)
        places[order] = len(self.known) + np.arange(len(words))
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order))])
        self.bounds = np.append(self.bounds, len(self.flat) + np.concatenate([n for _, n in found]).cumsum())
        self.flat = np.concatenate([self.flat, *[ids for ids, _ in found]])
        return places

    def encode(self, texts: pa.Array | list[str]) -> Iterator[np.ndarray]:
        """Ids of each text, little-endian unsigned 32-bit; a null is an empty text."""
        if len(self.known) > self.room or self.known.nbytes > 64 * self.room:
            self.clear()
        stretches, cuts = _stretches((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string()).fill_null(""))
        coded = stretches.dictionary_encode()
        place = pc.index_in(coded.dictionary, value_set=self.known)
        places = place.fill_null(-1).to_numpy().astype(np.int64)
        if place.null_count:
            places[places < 0] = self._learn(coded.dictionary.filter(place.is_null()))
        flat, at = self.flat, places[coded.indices.to_numpy()]
        starts, sizes = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        for a, b in pairwise(cuts.tolist()):
            n = sizes[a:b]
            ends = n.cumsum()
            total = int(ends[-1]) if b > a else 0
            yield flat[np.repeat(starts[a:b] - ends + n, n) + np.arange(total)] if total else np.empty(0, "<u4")


@lru_cache(maxsize=1)
def encoder_of(file: str) -> Encoder:
    """One encoder per Python worker, whose known stretches serve its later tasks too."""
    return Encoder(file)


def _stretches(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Stretches of all texts in order, each with the white space before it, and where each text's begin and the last's end.

    Signs after a letter begin a stretch of their own. ASCII letters are in lower case, for fewer distinct stretches.
    """
    if not len(texts):
        return texts, np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    data, kind = _PLAIN[raw], _KIND[raw]
    lead = np.flatnonzero(kind == _LEAD)
    kind[lead] = kind[lead + 1] = np.where(np.isin(raw[lead].astype(np.int64) << 8 | raw[lead + 1], _NOT_LETTERS), _OTHER, _LETTER)
    marks = np.flatnonzero(kind == _MARK)
    kind[marks] = _OTHER
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = (kind[1:] > kind[:-1]) & ((kind[:-1] != _OTHER) | (kind[1:] == _SPACE))
    # A capital may join a mark where the small letter does not, and the vocabulary's special tokens have signs and one
    # case: texts with either are only cut at white space and keep their case.
    special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
    for i in np.unique(np.searchsorted(offsets, np.append(marks, special), "right") - 1).tolist():
        a, b = offsets[i], offsets[i + 1]
        data[a:b] = raw[a:b]
        edge[a:b] &= kind[a:b] == _SPACE
    edge[offsets] = True
    at = np.flatnonzero(edge).astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(data)), np.searchsorted(at, offsets)


def pieces(file: str, capacity: int):
    """Per document its pieces with place, length and checksum of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(file)
        for batch in returned(batches):
            ids, rows = batch.column("id"), []
            for at, tokens in enumerate(encoder.encode(batch.column("t"))):
                tokens = np.append(tokens, np.array([END], "<u4"))
                for k, start in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[start : start + capacity]
                    rows.append((at, k, start, len(part), zlib.crc32(part.tobytes())))
            at, k, start, length, crc = (list(x) for x in zip(*rows)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return run


class Sums:
    """Which lengths are available, and how many pairs of different or equal lengths make each sum."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts.copy()
        self.capacity = len(counts) - 1
        have = (counts > 0).astype(np.float64)
        size = 2 * len(have)
        both = np.rint(np.fft.irfft(np.fft.rfft(have, size) ** 2, size)).astype(np.int64)[: len(have)]
        self.pairs = both  # ordered pairs; a pair of a length with itself is dropped below where it occurs once
        for x in np.flatnonzero(counts == 1):
            if 2 * x <= self.capacity:
                self.pairs[2 * x] -= 1

    def take(self, length: int, n: int) -> None:
        before = self.counts[length]
        after = self.counts[length] = before - n
        if before > 1 >= after and 2 * length <= self.capacity:
            self.pairs[2 * length] -= 1
        if after == 0 and n:
            others = np.flatnonzero(self.counts[: self.capacity - length + 1])
            self.pairs[length + others] -= 2

    def single(self, gap: int) -> list[int] | None:
        return [gap] if self.counts[gap] else None

    def pair(self, gap: int) -> list[int] | None:
        """Two available lengths with this sum, the larger one as large as can be."""
        if gap < 2 or not self.pairs[gap]:
            return None
        low = np.arange(1, gap // 2 + 1)
        ok = (self.counts[low] > 0) & (self.counts[gap - low] > np.where(low * 2 == gap, 1, 0))
        hit = np.flatnonzero(ok)
        return [gap - int(low[hit[0]]), int(low[hit[0]])] if len(hit) else None

    def triple(self, gap: int) -> list[int] | None:
        """Three available lengths with this sum."""
        if gap < 3:
            return None
        big = np.arange(gap - 2, 0, -1)
        for x in big[(self.counts[big] > 0) & (self.pairs[gap - big] > 0)].tolist():
            rest = self.pair(gap - x)
            if rest and all(self.counts[v] >= [x, *rest].count(v) for v in (x, *rest)):
                return [x, *rest]
        return None


def packed(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (times, [(length, how many)]) that use every piece of the histogram ``counts`` (index: length)."""
    capacity, sums = len(counts) - 1, Sums(counts)
    done: list[tuple[int, list[tuple[int, int]]]] = []
    rest = np.zeros(len(counts), np.int64)
    for length in range(capacity, 0, -1):
        while (n := int(sums.counts[length])):
            gap = capacity - length
            if not gap:
                sums.take(length, n)
                done.append((n, [(length, 1)]))
                continue
            sums.take(length, 1)  # the piece that opens the sequence is not its own complement
            fill = sums.single(gap) or sums.pair(gap) or sums.triple(gap)
            if not fill:
                rest[length] += n
                sums.take(length, n - 1)
                break
            use: dict[int, int] = {}
            for v in (length, *fill):
                use[v] = use.get(v, 0) + 1
            times = min((int(sums.counts[v]) + (v == length)) // k for v, k in use.items())
            for v, k in use.items():
                sums.take(v, times * k - (v == length))
            done.append((times, sorted(use.items(), reverse=True)))
    return done + best_fit(rest)


def best_fit(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first, over groups of equal sequences instead of single ones."""
    capacity = len(counts) - 1
    open_: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by room left
    room = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        while n:
            fits = np.flatnonzero(room[length:])
            if len(fits):
                gap = length + int(fits[0])
                times, parts = open_[gap].pop()
                if not open_[gap]:
                    room[gap] = False
            else:
                each = capacity // length
                gap, times, parts = capacity, -(-n // each), []
            each = min(gap // length, n)
            use = min(times, n // each)
            if use < times:  # the rest of the group stays as it is
                if parts or gap < capacity:
                    open_.setdefault(gap, []).append((times - use, parts))
                    room[gap] = True
            n -= use * each
            left = gap - each * length
            open_.setdefault(left, []).append((use, [*parts, (length, each)]))
            room[left] = left > 0
    return [g for groups in open_.values() for g in groups]


def slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, offset, times, step) of runs of places, by first rank.

    The pieces of ranks first .. first + times * k - 1 lie in ``times`` sequences, ``k`` to each, one after another.
    """
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, parts in patterns:
        offset = 0
        for length, k in parts:
            runs.setdefault(length, []).append((used.get(length, 0), sequence, offset, k))
            used[length] = used.get(length, 0) + times * k
            offset += length * k
        sequence += times
    return {length: np.array(r, np.int64) for length, r in runs.items()}


def placed(places: dict[int, np.ndarray]):
    """Sequence and offset of a piece from its length and its rank among pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                mine, table = length == x, places[int(x)]
                at = np.searchsorted(table[:, 0], rank[mine], "right") - 1
                first, begin, start, k = table[at].T
                inside = rank[mine] - first
                sequence[mine], offset[mine] = begin + inside // k, start + inside % k * x
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")],
                                              pa.array(sequence), pa.array(offset)],
                                             ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, file: str, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text",
         rank_rows: int = 65_536) -> DataFrame:
    """Per piece of ``df``'s documents: id, piece, start, length, ids_crc32, sequence_id and offset.

    Only the histogram (at most ``capacity`` rows) comes to the driver and only the patterns, which have a few runs per
    length, go back out. Ranks are counted in slices of about ``rank_rows`` pieces of a length, so that a length that a
    third of all pieces share is ranked by many tasks.
    """
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    kind = dict(rows.dtypes)["id"]
    shape = f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    with small_batches(df.sparkSession):
        made = cut(rows.mapInArrow(pieces(file, capacity), shape))
    histogram = made.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    places = slots(packed(counts))
    slices = int(max(64, -(-counts.sum() // rank_rows)))
    mixed = made.withColumn("slice", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(slices)))
    totals = mixed.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("length").alias("b_length"), F.col("slice").alias("b_slice"),
                           F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "slice").orderBy("ids_crc32", "id", "piece", "start")
    ranked = mixed.withColumn("within", F.row_number().over(order))
    ranked = ranked.join(before, (F.col("length") == F.col("b_length")) & (F.col("slice") == F.col("b_slice")))
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).cast("long").alias("rank"))
    # Rows that tie in the order are equal, so a recomputed rank gives the same result.
    return ranked.mapInArrow(placed(places), f"{shape}, sequence_id bigint, offset bigint")
