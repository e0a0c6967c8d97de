"""Benchmark decontamination by a prefix-filtered set join.

A window is ``size`` consecutive words of an item, or all of a shorter one. Its set is its shingles of up to three words,
ordered by how rare they are in the documents. As a window only counts when all of it occurs, a prefix of one shingle is
enough: a document that has the window has the window's rarest shingle. So

1. items become windows, in blocks whose bytes are bounded (``block_bytes``); a block is what is broadcast;
2. one pass over the documents counts the block's shingles (inside tasks, then by a grouped sum);
3. a second pass joins each document's shingles to the windows' rarest ones, drops a pair when the window would begin
   before the document or end after it, and compares the remaining windows word by word.

A window with a shingle that no document has is dropped before step 3. With more than one block the documents pass
through steps 2 and 3 once per block, their hits in between in the checkpoint folder. No document is shuffled, so neither
hot sources nor large groups of copies gather in a task.

Defined results: null and empty texts have no words and are clean; items without words are ignored; an item with a null
id is listed as ``null``; repeated items count once per id; documents are independent rows, so repeated ones each get
their own result and extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import unused
from tidegrid.session import checkpointed

#: Shingles have up to so many words.
SHINGLE = 3

#: Items are cut into pieces of so many words, overlapping by one word less than a window.
PIECE_WORDS = 1 << 14

#: Every byte that no word contains becomes a space, capitals become small letters.
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def shingle_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of ``length`` ids along the last axis."""
    n = ids.shape[-1] - length + 1
    h = np.zeros((*ids.shape[:-1], max(n, 0)), np.uint64)
    for k in range(length if n > 0 else 0):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[..., k : k + n].astype(np.uint64)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Windows:
    """The windows of one block: word ids, length, and the items that have them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        self.vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            for i in range(max(1, len(ids) - size + 1)):
                seen.setdefault(tuple(ids[i : i + size]), set()).add(item)
        rows = sorted(seen)
        self.items = [sorted(seen[r]) for r in rows]
        self.length = np.array([len(r) for r in rows], np.int64)
        self.ids = np.zeros((len(rows), size), np.int64)
        for i, r in enumerate(rows):
            self.ids[i, : len(r)] = r

    def shingles(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words per shingle, rows, hashes of all shingles of those rows), by window length."""
        for length in np.unique(self.length):
            rows = np.flatnonzero(self.length == length)
            k = min(SHINGLE, int(length))
            yield k, rows, shingle_hashes(self.ids[rows, :length], k)

    def document(self, text: bytes) -> np.ndarray:
        """Ids of a text's words; 0 for words that no window has."""
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words_of(text)], np.int64)


def _document_shingles(ids: np.ndarray, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a document whose shingle is in the sorted ``table``, and the places there."""
    if len(ids) < k or not len(table):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    known = ids > 0
    full = known[: len(ids) - k + 1].copy()
    for j in range(1, k):
        full &= known[j : len(ids) - k + 1 + j]
    at = np.flatnonzero(full)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[at + j].astype(np.uint64)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    spot = np.minimum(np.searchsorted(table, h), len(table) - 1)
    good = table[spot] == h
    return at[good], spot[good]


def _rarest(windows: Windows, tables: dict[int, np.ndarray], counts: dict[int, np.ndarray]):
    """Per shingle length: sorted prefix hashes, where each one's windows start in the list, those windows, offsets."""
    out = {}
    for k, rows, hashes in windows.shingles():
        n = counts[k][np.searchsorted(tables[k], hashes)]
        alive = (n > 0).all(axis=1)
        rows, hashes, n = rows[alive], hashes[alive], n[alive]
        offset = n.argmin(axis=1)
        out.setdefault(k, []).append((hashes[np.arange(len(rows)), offset], rows, offset))
    index = {}
    for k, parts in out.items():
        key, rows, offset = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        distinct, first = np.unique(key[order], return_index=True)
        index[k] = (distinct, np.r_[first, len(order)], rows[order], offset[order])
    return index


def match(ids: np.ndarray, windows: Windows, index) -> tuple[np.ndarray, np.ndarray]:
    """(windows, starts) of all occurrences in a document."""
    found_rows, found_starts = [], []
    for k, (keys, first, rows, offset) in index.items():
        at, spot = _document_shingles(ids, keys, k)
        if not len(at):
            continue
        many = first[spot + 1] - first[spot]
        pick = np.repeat(first[spot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row, start = rows[pick], np.repeat(at, many) - offset[pick]
        inside = (start >= 0) & (start + windows.length[row] <= len(ids))  # positional and length bounds
        row, start = row[inside], start[inside]
        same = np.ones(len(row), bool)
        for j in range(windows.ids.shape[1]):
            live = np.flatnonzero(same & (windows.length[row] > j))
            same[live] = ids[start[live] + j] == windows.ids[row[live], j]
        found_rows.append(row[same])
        found_starts.append(start[same])
    if not found_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_rows), np.concatenate(found_starts)


def _pieces(items: DataFrame, size: int) -> DataFrame:
    """Items as lower-case words in pieces of bounded length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = words_of(text)
                starts = range(0, max(1, len(words) - size + 1), PIECE_WORDS)
                parts = [b" ".join(words[i : i + PIECE_WORDS + size - 1]) for i in starts] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.binary())], ["item", "words"])

    return items.mapInArrow(cut, "item string, words binary")


def _blocks(items: DataFrame, size: int, block_bytes: int) -> Iterator[Windows]:
    pieces = _pieces(items, size)
    total = pieces.agg(F.coalesce(F.sum(F.octet_length("words") + F.lit(16)), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(1.5 * total / block_bytes)) if total > block_bytes else 1
    for b in range(blocks):
        own = pieces.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b) if blocks > 1 else pieces
        yield Windows([(r.item, bytes(r.words).split()) for r in own.toLocalIterator()], size)


def _count_shingles(docs: DataFrame, windows: Windows) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """The block's distinct shingles per length, and how often the documents have each."""
    tables = {}
    for k, _, hashes in windows.shingles():
        tables[k] = np.unique(np.concatenate([tables.get(k, np.zeros(0, np.uint64)), hashes.ravel()]))
    shared = docs.sparkSession.sparkContext.broadcast((windows, tables))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sorted_hashes = shared.value
        sums = {k: np.zeros(len(t), np.int64) for k, t in sorted_hashes.items()}
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                if text.is_valid:
                    ids = own.document(text.as_py())
                    for k, t in sorted_hashes.items():
                        sums[k] += np.bincount(_document_shingles(ids, t, k)[1], minlength=len(t))
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["k", "place", "n"])

    rows = docs.select("text").mapInArrow(count, "k long, place long, n long").groupBy("k", "place").agg(F.sum("n").alias("n")).toPandas()
    counts = {k: np.zeros(len(t), np.int64) for k, t in tables.items()}
    for k, part in rows.groupby("k"):
        counts[int(k)][part["place"].to_numpy(int)] = part["n"].to_numpy(int)
    return tables, counts


def _match_column(text: Column, shared) -> Column:
    """A struct of word count, hit words (as runs of start and end) and items with occurring windows."""
    run = pa.list_(pa.int64())

    @F.arrow_udf("n_words long, hits array<long>, items array<string>")
    def matched(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows, index = shared.value
        for batch in batches:
            counts, hits, items = [], [], []
            for value in batch.cast(pa.binary()):
                ids = windows.document(value.as_py() if value.is_valid else b"")
                rows, starts = match(ids, windows, index)
                counts.append(len(ids))
                if len(rows):
                    edge = np.zeros(len(ids) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + windows.length[rows], -1)
                    inside = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
                    hits.append(np.flatnonzero(inside[1:] != inside[:-1]))
                    items.append(sorted({i for r in np.unique(rows) for i in windows.items[r]}))
                else:
                    hits.append([])
                    items.append([])
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(hits, run), pa.array(items, pa.list_(pa.string()))], ["n_words", "hits", "items"])

    return matched(text)


def _covered(hits: Column) -> Column:
    """Words in the union of runs given as start, end, start, end, ..., maybe of several blocks."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(hits) - 1, F.lit(2)), lambda i: F.struct(F.get(hits, i).alias("a"), F.get(hits, i + 1).alias("b"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def step(acc: Column, p: Column) -> Column:
        new = F.greatest(p["b"] - F.greatest(p["a"], acc["end"]), F.lit(0).cast("long"))
        return F.struct((acc["n"] + new).alias("n"), F.greatest(acc["end"], p["b"]).alias("end"))

    return F.when(F.size(hits) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(pairs, start, step, lambda a: a["n"]))


def find_contamination(
    docs: DataFrame, items: DataFrame, size: int = 10, block_bytes: int = 16 << 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned too: a struct of ``n_words``, ``n_hit`` and ``items``."""
    name = unused(docs, "found")
    texts = docs.select(F.col(text_col).alias("text"))
    named = items.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.col(item_text))
    out, context = docs, docs.sparkSession.sparkContext
    for b, windows in enumerate(_blocks(named, size, block_bytes)):
        shared = context.broadcast((windows, _rarest(windows, *_count_shingles(texts, windows))))
        found = _match_column(F.col(text_col), shared)
        if b == 0:
            out = out.withColumn(name, found)
            continue
        other = unused(out, "more")
        both = out.withColumn(other, found)
        union = F.struct(
            F.col(f"{name}.n_words"),
            F.concat(f"{name}.hits", f"{other}.hits").alias("hits"),
            F.array_union(f"{name}.items", f"{other}.items").alias("items"),
        )
        out = checkpointed(both.withColumn(name, union).drop(other))
    found = F.col(name)
    summed = F.struct(found["n_words"].alias("n_words"), _covered(found["hits"]).alias("n_hit"), F.array_sort(found["items"]).alias("items"))
    return out.withColumn(name, summed), name


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, words, hit words, and the items whose windows occur."""
    found, name = find_contamination(docs.select(F.col(id_col), F.col(text_col)), items, text_col=text_col)
    f = F.col(name)
    return found.select(
        id_col,
        f["n_words"].alias("n_words"),
        f["n_hit"].alias("n_hit"),
        F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f["items"]), 256).alias("items_sha256"),
        (f["n_hit"] > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a hit word, with all their columns."""
    found, name = find_contamination(docs, items, text_col=text_col)
    return found.where(F.col(name)["n_hit"] == 0).drop(name)
