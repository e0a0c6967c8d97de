"""Phrase collocations by a three-way quicksort of suffix pointers.

A phrase is 2 to ``longest`` consecutive words of a piece (the text between marks of punctuation and line ends); it is a candidate if it
occurs ``least`` times in its language. Everything is counted per language, and counts are exact.

1. *Words* are counted per task and summed. A phrase of ``least`` occurrences has only words, and pairs of neighbouring words, of as many.
2. *Pairs* of such words, and then *triples* of such pairs, are counted by a hash whose range is twice the number of words, as sorted and
   packed lists per task. Those that share a hash are counted together, which can only let one pass.
3. *Suffixes*: every place where a frequent pair begins points to the words from there on, as long as pairs and triples go on being frequent.
   Equal suffixes of a task have one entry with a weight, so copied passages shrink before the shuffle.
4. *Routing*: the lists of suffixes go to tasks by their leading word. Where more than ``GROUP`` entries begin alike, equal suffixes are
   summed and routed by two leading words, then three, and so on; such a beginning is a phrase whose count is summed across tasks. So no
   task holds all suffixes of a common beginning.
5. *Sorting*: each task sorts pointers to its suffixes by multikey quicksort: a partition is split by the word at the depth reached
   into smaller, equal and greater; the weight of an equal partition is the count of the phrase up to there. Partitions lighter than
   ``least`` are abandoned, equal ones go one word deeper.

Frequent words, pairs and triples are recognised in tasks by bitmaps of at most ``MOST_BITS`` bits (16 MB), whatever the vocabulary. A bitmap may
let an infrequent word pass, never the reverse: that costs a row and changes no count.

A candidate's score is that of its weakest cut, in integers: floor(scale * a * n / (l * r)). Candidates that only occur inside a longer
one are dropped: one that lies in a longer phrase of the same count also lies in one that is a word longer, so these alone are compared.

Defined results: null and empty texts have no words; a null language is ``und``; a document counts as often as its row is repeated. Texts of
any length pass in blocks. An empty table has no phrases. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.session import checkpointed

#: Bytes of a text taken at once, words counted at once in a task, and words a task remembers.
BLOCK, CHUNK, REMEMBERED = 1 << 20, 1 << 22, 1 << 19

#: Most different suffixes that begin alike in one group of a task.
GROUP = 200_000

#: About so many different pairs' hashes are summed at once.
PART = 1 << 22

#: Bits of a bitmap for each entry, at least, and bits at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27

#: A-Z are lowered; the characters that end a piece become line ends, a tab a space.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))
_GAP = re.compile(rb"[ \n]")
#: Stands for the end of a piece among words; no UTF-8 text has this byte.
_END = b"\xff"


def blocks(text: bytes) -> Iterator[bytes]:
    """A text in lower case, in blocks that end between words; line ends are ends of pieces."""
    text = text.translate(_BYTES)
    at = 0
    while at < len(text):
        cut = _GAP.search(text, at + BLOCK)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
        if text.is_valid:
            yield lang, text.as_buffer().to_pybytes()


def _phrase_batch(counts: dict[str, Iterator[tuple[bytes, int]]]) -> Iterator[pa.RecordBatch]:
    for lang, items in counts.items():
        phrases, numbers = zip(*items, strict=True) if items else ((), ())
        for a in range(0, len(phrases), 50_000):
            part = pa.array(phrases[a : a + 50_000], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(numbers[a : a + 50_000], pa.int64())], ["lang", "phrase", "c"])


def count_words(docs: DataFrame) -> DataFrame:
    """Columns lang, phrase (a word), c. ``docs`` has lang and text."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in _rows(batch):
                for block in blocks(text):
                    counts.setdefault(lang, Counter()).update(block.split())
            if sum(map(len, counts.values())) > REMEMBERED:
                yield from _phrase_batch({k: list(v.items()) for k, v in counts.items()})
                counts = {}
        yield from _phrase_batch({k: list(v.items()) for k, v in counts.items()})

    return docs.mapInArrow(counted, "lang string, phrase string, c long").groupBy("lang", "phrase").agg(F.sum("c").alias("c"))


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode() + _END + word)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of each pair of words, of their hashes."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


_MIX = 0x9FB21C651E98DF25


class Bitmap:
    """Two bits for each entry's hash."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = len(words) * 64 - 1

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(_MIX)
        return (mixed >> np.uint64(8)) & np.uint64(self.mask), (mixed >> np.uint64(36)) & np.uint64(self.mask)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes):
            out &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out

    def has_one(self, h: int) -> bool:
        mixed = (h ^ h >> 32) * _MIX & 0xFFFFFFFFFFFFFFFF
        a, b = mixed >> 8 & self.mask, mixed >> 36 & self.mask
        return bool(int(self.words[a >> 6]) >> (a & 63) & int(self.words[b >> 6]) >> (b & 63) & 1)


def word_hashes(words: DataFrame) -> DataFrame:
    """Column h: the hash of each word of a table with lang and phrase."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_hash(lang, p.as_buffer().to_pybytes()) for lang, p in zip(batch.column("lang").to_pylist(), batch.column("phrase"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).view(np.int64))], ["h"])

    return words.select("lang", "phrase").mapInArrow(hashed, "h long")


def make_bitmap(hashes: DataFrame) -> Bitmap:
    """The bitmap of a column h of hashes; at most ``MOST_BITS`` bits reach the driver."""
    bits = LEAST_BITS
    entries = hashes.count()
    while bits < MOST_BITS and bits < BITS_EACH * entries:
        bits *= 2
    empty = Bitmap(np.zeros(bits // 64, np.uint64))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(empty.places(batch.column("h").to_numpy().view(np.uint64)))
            bit = np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array(bit.view(np.int64))], ["i", "b"])

    found = hashes.mapInArrow(marked, "i long, b long").groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[found.column("i").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return Bitmap(words)


class Codes(dict):
    """Numbers of a language's words as a task meets them; 0 for those that the bitmap hasn't."""

    def __init__(self, lang: str, bitmap: Bitmap):
        super().__init__()
        self.lang, self.bitmap = lang, bitmap
        self.clear()

    def clear(self) -> None:
        super().clear()
        self[_END] = 0
        self.words: list[bytes] = [b""]
        self.hashes: list[int] = [0]

    def __missing__(self, word: bytes) -> int:
        h = word_hash(self.lang, word)
        code = 0
        if self.bitmap.has_one(h):
            code = len(self.words)
            self.words.append(word)
            self.hashes.append(h)
        self[word] = code
        return code


class Stream:
    """The words of one language in a task as one sequence of codes, 0 between pieces; ``take`` gets it chunk by chunk.

    The last ``overlap`` codes of a chunk begin the next one too, and only the places before them are counted at once.
    """

    def __init__(self, lang: str, bitmap: Bitmap, overlap: int):
        self.codes = Codes(lang, bitmap)
        self.overlap, self.parts, self.size = overlap, [], 0

    def add(self, text: bytes) -> None:
        for block in blocks(text):
            words = block.replace(b"\n", b" \xff ").split()
            self.parts.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
        self.parts.append(np.zeros(1, np.int32))

    def take(self, last: bool) -> tuple[np.ndarray, int, np.ndarray, list[bytes]]:
        """The chunk, how many places of it count, and each code's hash and word."""
        chunk = np.concatenate([np.zeros(0, np.int32), *self.parts])
        words, hashes = self.codes.words, np.array(self.codes.hashes, np.uint64)
        rest = chunk[:0] if last else chunk[max(0, len(chunk) - self.overlap) :]
        if len(self.codes) > REMEMBERED:
            self.codes.clear()
            rest = np.array([self.codes[words[c]] if c else 0 for c in rest.tolist()], np.int32)
        self.parts, self.size = [rest], 0
        return chunk, len(chunk) - len(rest), hashes, words


def _per_chunk(docs: DataFrame, bitmap: Bitmap, overlap: int, counted: Callable, schema: str) -> DataFrame:
    """``counted`` turns the chunks of each task into batches: it gets the language and what ``Stream.take`` returns."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Bitmap(shared.value)
        streams: dict[str, Stream] = {}
        for batch in batches:
            for lang, text in _rows(batch):
                stream = streams.get(lang)
                if stream is None:
                    stream = streams[lang] = Stream(lang, words, overlap)
                stream.add(text)
                if stream.size > CHUNK:
                    yield from counted(lang, *stream.take(False))
        for lang, stream in streams.items():
            yield from counted(lang, *stream.take(True))

    return docs.mapInArrow(run, schema)


def _grams(chunk: np.ndarray, hashes: np.ndarray, maps: list[Bitmap], down: np.uint64) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each bitmap (pairs, triples, ...) the places where one of them begins, and the places and hashes of the next longer."""
    begins, every = [chunk > 0], hashes[chunk]
    now = every
    for m in range(2, len(maps) + 3):
        at = np.flatnonzero(begins[-1][:-1] & begins[-1][1:])
        found = pair_hashes(now[at], every[at + m - 1])
        if m < len(maps) + 2:
            now = np.zeros(len(chunk), np.uint64)
            now[at] = found
            begins.append(np.zeros(len(chunk), bool))
            begins[-1][at] = maps[m - 2].has(found >> down)
    return begins[1:], at, found


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: most planes of small numbers are zeros."""
    return pa.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def hash_bits(places: int) -> int:
    """Bits of the hashes of pairs and triples: at least twice the number of ``places`` that they can begin at."""
    return max(16, places.bit_length() + 1)


def frequent_grams(docs: DataFrame, words: Bitmap, maps: list[Bitmap], places: int, least: int) -> DataFrame:
    """Column h: the leading bits of the hashes of what occurs ``least`` times (others may share them): pairs of words, or, given the
    bitmap of pairs, triples.

    The range of the hashes is cut into stretches of about ``PART`` places, each summed at once.
    """
    bits = hash_bits(places)
    split = max(0, (places // PART).bit_length())  # leading bits that number the stretches
    down, part_down = np.uint64(64 - bits), np.uint64(bits - split)
    shared = docs.sparkSession.sparkContext.broadcast([m.words for m in maps])

    def counted(lang: str, chunk: np.ndarray, size: int, hashes: np.ndarray, names: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, at, found = _grams(chunk, hashes, [Bitmap(m) for m in shared.value], down)
        keys, counts = np.unique(found[at < size] >> down, return_counts=True)
        parts = keys >> part_down
        cuts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])[: len(keys)]
        rows = [(int(k[0] >> part_down), len(k), _packed(np.diff(k, prepend=np.uint64(0))), _packed(c)) for k, c in zip(np.split(keys, cuts[1:]), np.split(counts, cuts[1:]), strict=True) if len(k)]
        if rows:
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "n", "steps", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, []

        def out() -> pa.RecordBatch:
            keys, counts = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return pa.RecordBatch.from_arrays([pa.array(keys[first][np.add.reduceat(counts, first) >= least].view(np.int64))], ["h"])

        for batch in batches:
            for part, n, steps, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "n", "steps", "counts")), strict=True):
                if part != now and kept:
                    yield out()
                    kept = []
                now = part
                kept.append((np.cumsum(_unpacked(steps, n)), _unpacked(counts, n).astype(np.int64)))
        if kept:
            yield out()

    packed = _per_chunk(docs, words, len(maps) + 1, counted, "part long, n long, steps binary, counts binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(summed, "h long")


def suffixes(docs: DataFrame, words: Bitmap, maps: list[Bitmap], bits: int, longest: int) -> DataFrame:
    """Lists of suffixes (the words from a place on, while pairs and triples are in ``maps``) by first word: lang, lead, phrases, counts."""
    shared = docs.sparkSession.sparkContext.broadcast([m.words for m in maps])
    down = np.uint64(64 - bits)

    def counted(lang: str, chunk: np.ndarray, size: int, hashes: np.ndarray, names: list[bytes]) -> Iterator[pa.RecordBatch]:
        begins = [np.r_[b, np.zeros(longest, bool)] for b in _grams(chunk, hashes, [Bitmap(m) for m in shared.value], down)[0]]
        at = np.flatnonzero(begins[0][:size])
        if not len(at):
            return
        padded = np.r_[chunk, np.zeros(longest, np.int32)]
        rows = np.zeros((len(at), longest), np.int32)
        rows[:, 0] = padded[at]
        live = np.ones(len(at), bool)
        for k in range(1, longest):
            m = min(k + 1, len(begins) + 1)  # the longest that is known and ends here
            live &= begins[m - 2][at + k + 1 - m]
            rows[live, k] = padded[at + k][live]
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
        counts = np.diff(np.r_[first, len(rows)])
        yield _lists(lang, names, rows[first], counts)

    return _per_chunk(docs, words, longest - 1, counted, "lang string, lead string, phrases array<string>, counts array<long>")


def _lists(lang: str, names: list[bytes], rows: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Sorted rows of codes as one list of phrases for each first word."""
    first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    ends = pa.array(np.r_[first, len(rows)], pa.int32())
    phrases = pa.array([b" ".join([names[x] for x in row if x]) for row in rows.tolist()], pa.binary()).cast(pa.string())
    leads = pa.array([names[x] for x in rows[first, 0].tolist()], pa.binary()).cast(pa.string())
    columns = [pa.array([lang] * len(first)), leads, pa.ListArray.from_arrays(ends, phrases), pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "lead", "phrases", "counts"])


def quicksort_counts(rows: np.ndarray, weights: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(pointer to a row, words, weight) of every beginning of rows that weighs ``least`` or more. 0 is no word."""
    found = []
    todo = [(np.arange(len(rows)), 0)]
    while todo:
        pointers, depth = todo.pop()
        if depth == rows.shape[1] or weights[pointers].sum() < least:
            continue
        symbols = rows[pointers, depth]
        pivot = symbols[len(symbols) // 2]
        equal = pointers[symbols == pivot]
        if len(equal) < len(pointers):
            todo += [(pointers[symbols < pivot], depth), (pointers[symbols > pivot], depth)]
        if pivot and (weight := int(weights[equal].sum())) >= least:
            found.append((int(equal[0]), depth + 1, weight))
            todo.append((equal, depth + 1))
    return found


def _words(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def sorted_counts(given: DataFrame, least: int, longest: int, group: int = GROUP) -> DataFrame:
    """Columns lang, phrase, c: every beginning of two words or more that ``least`` of the suffixes have. ``given``: see ``suffixes``."""
    crowded = checkpointed(given.groupBy("lang", "lead").agg(F.sum(F.size("phrases")).alias("n")).where(F.col("n") > group).select("lang", "lead"))
    routed, counted = given.withColumn("k", F.lit(1)), []
    if not crowded.isEmpty():
        left = given.join(crowded, ["lang", "lead"], "left_semi").select("lang", F.explode(F.arrays_zip("phrases", "counts")).alias("s"))
        left = checkpointed(left.groupBy("lang", F.col("s.phrases").alias("phrase")).agg(F.sum("s.counts").alias("c")))
        routed = routed.join(crowded, ["lang", "lead"], "left_anti").select(routed.columns)
        for k in range(2, longest + 1):
            keyed = left.withColumn("lead", F.substring_index("phrase", " ", k))
            crowded = keyed.groupBy("lang", "lead").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).where(F.col("n") > group)
            crowded = checkpointed(crowded.select("lang", F.col("lead"), F.col("c").alias("all")))
            none = crowded.isEmpty()
            calm = keyed if none else keyed.join(crowded, ["lang", "lead"], "left_anti")
            routed = routed.union(calm.select("lang", "lead", F.array("phrase"), F.array("c"), F.lit(k)))
            if none:
                break
            counted.append(crowded.where(F.col("all") >= least).select("lang", F.col("lead").alias("phrase"), F.col("all").alias("c")))
            left = keyed.join(crowded, ["lang", "lead"], "left_semi").where(_words(F.col("phrase")) > k).select("lang", "phrase", "c")

    def sort(langs: list[str], phrases: list[str], weights: list[int], levels: list[int]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        table = np.zeros((len(phrases), longest + 1), np.int32)  # the language is the first symbol
        for r, (lang, phrase) in enumerate(zip(langs, phrases, strict=True)):
            symbols = [numbers.setdefault(w, len(numbers) + 1) for w in ("\xff" + lang, *phrase.split(" "))]
            table[r, : len(symbols)] = symbols
        weight, level = np.array(weights, np.int64), np.array(levels)
        for k in np.unique(level).tolist():  # shorter beginnings than a group's own are shared with other groups
            own = np.flatnonzero(level == k)
            found = [(int(own[p]), d - 1, w) for p, d, w in quicksort_counts(table[own], weight[own], least) if d - 1 >= max(k, 2)]
            if found:
                columns = [[langs[p] for p, _, _ in found], [" ".join(phrases[p].split(" ")[:d]) for p, d, _ in found], [w for _, _, w in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "phrase", "c"])

    def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[list, ...] = ([], [], [], [])
        key = None
        for batch in batches:
            for lang, lead, phrases, counts, k in zip(*(batch.column(x).to_pylist() for x in ("lang", "lead", "phrases", "counts", "k")), strict=True):
                if len(kept[0]) >= group and (lang, lead, k) != key:
                    yield from sort(*kept)
                    kept = ([], [], [], [])
                key = (lang, lead, k)
                for part, more in zip(kept, ([lang] * len(phrases), phrases, counts, [k] * len(phrases)), strict=True):
                    part.extend(more)
        if kept[0]:
            yield from sort(*kept)

    ordered = routed.repartition("lang", "lead").sortWithinPartitions("lang", "lead", "k")
    found = ordered.mapInArrow(sort_groups, "lang string, phrase string, c long")
    for more in counted:
        found = found.union(more)
    return found


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame, scale: int) -> DataFrame:
    """Columns lang, phrase, a, l, r, n, score of the weakest cut. Factors may pass 64 bits, so they are decimals of 38 digits."""
    size = _words(F.col("phrase"))
    cuts = phrases.select("lang", "phrase", F.col("c").alias("a"), size.alias("m"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - m)"))
    every = phrases.union(words.select("lang", "phrase", "c"))
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l")), ["lang", "first"])
    cuts = cuts.join(every.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.select("lang", "phrase", "a", "n", "k", "l", "r", (wide["a"] * wide["n"] * F.lit(scale).cast("decimal(10,0)")).cast("decimal(38,0)").alias("over"), (wide["l"] * wide["r"]).cast("decimal(38,0)").alias("under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(F.expr("over div under").alias("score"), "k", "a", "l", "r", "n")).alias("s"))
    return best.select("lang", "phrase", "s.a", "s.l", "s.r", "s.n", "s.score")


def drop_covered(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """Without phrases that a longer one covers wherever they occur."""
    longer = phrases.where(_words(F.col("phrase")) > 2)
    longer = longer.withColumn("m", _words(F.col("phrase")))
    inner = F.expr("array(substring_index(phrase, ' ', m - 1), substring_index(phrase, ' ', 1 - m))")
    inner = longer.select("lang", F.explode(inner).alias("phrase"), "c").groupBy("lang", "phrase").agg(F.max("c").alias("most"))
    return found.join(inner, ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, scale: int = 1000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """Each language's ``top`` phrases by score, count and spelling: lang, rank, phrase, a, l, r, n, score."""
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least and occur once at least")
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    vocabulary = checkpointed(count_words(docs))
    totals = vocabulary.groupBy("lang").agg(F.sum("c").alias("n"))
    words = vocabulary.where(F.col("c") >= least)
    word_map = make_bitmap(word_hashes(words))
    places = totals.agg(F.sum("n")).first()[0] or 0
    maps: list[Bitmap] = []
    for _ in range(2, min(longest, 3) + 1):
        maps.append(make_bitmap(checkpointed(frequent_grams(docs, word_map, maps, places, least))))
    phrases = checkpointed(sorted_counts(checkpointed(suffixes(docs, word_map, maps, hash_bits(places), longest)), least, longest))
    found = drop_covered(scored(phrases, words, totals, scale), phrases)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
