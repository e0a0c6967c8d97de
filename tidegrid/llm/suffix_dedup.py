"""Removal of repeated strings of ``LENGTH`` bytes with a hash-compared suffix sort.

A byte goes if some string of ``LENGTH`` bytes that covers it also starts earlier, in a document of smaller id or in the
same one. Sorting all suffixes of a corpus would move ``LENGTH`` bytes per byte, so the suffixes are thinned out first,
without losing a match:

1. Every string of ``LENGTH`` bytes contains ``LENGTH - GRAM + 1`` grams; the one with the least hash (the leftmost of
   equals) is its *anchor*. Equal strings have equal anchors at the same place. Neighbouring strings mostly share their
   anchor: they form a *run*, some 35 bytes apart. A run is sent as two hashes (of its anchor and of its bytes) and its
   place; runs repeated within a slice of documents are counted there and not sent again, so the copies of a hot passage
   that meet in one task are at most one per slice.
2. Per anchor hash, sorted by the hash of the bytes: all but the earliest of equal runs are repeated as a whole. A run
   whose anchor has no other run is done. The earliest runs of an anchor with several different ones are *contested*.
3. The bytes of contested runs are fetched from their documents. In each group of an anchor the suffixes that start at
   the anchor are sorted, and so are the reversed bytes before it (:mod:`tidegrid.llm.suffix_sort`). Strings that begin
   x bytes before the anchor are equal if the right sides share ``LENGTH - x`` bytes and the left sides x; the common
   prefixes of the two sorted lists give the classes, and all but the earliest of a class are repeated.
   A group of more than ``GROUP`` runs is dealt to several tasks by the hashes of the single strings instead.
4. Spans return to their documents, are united, and cut out.

Equal hashes of 128 bits (anchor and run) are taken as equal runs; step 3 verifies bytes.

Defined results: null and empty texts, and texts shorter than ``LENGTH``, lose nothing. Rows that repeat both id and text
are one document, each row gets its result; rows that repeat an id with another text come in the order of a hash of the
text. A null id comes before all others. Ids are integers. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidegrid.llm.common import slices
from tidegrid.llm.suffix_sort import sort_strings
from tidegrid.session import shared_folder

#: Bytes of a string that counts as repeated, and of a gram.
LENGTH, GRAM = 100, 24

#: Bytes handled at once; a longer text is cut into stretches of starts. Contested runs sorted as one group.
SLICE_BYTES, GROUP = 4 << 20, 20_000

_PLACE_BITS = np.uint64(23)
_RUN = "d long, t long, anchor long, run long, start long, n int, left int"
_FOUND = "contested boolean, d long, t long, anchor long, start long, n int, left int, runs long"
_SPAN = "d long, t long, start long, size long"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the ``GRAM`` bytes at each place, from powers of two of bytes."""
    h, width, parts, at = data.astype(np.uint64) + np.uint64(1), 1, [], 0
    base = np.uint64(0x9E3779B97F4A7C15)
    while width <= GRAM:
        if GRAM & width:
            parts.append((h, at, width))
            at += width
        if 2 * width <= GRAM:
            shift = np.uint64(pow(int(base), width, 1 << 64))
            h = h[: len(h) - width] * shift + h[width:]
        width *= 2
    n = len(data) - GRAM + 1
    out = np.zeros(n, np.uint64)
    for h, offset, size in parts:
        out = out * np.uint64(pow(int(base), size, 1 << 64)) + h[offset : offset + n]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of ``LENGTH`` bytes: the place of its anchor; and the gram hashes."""
    grams = gram_hashes(data)
    span = LENGTH - GRAM + 1
    low = (grams & ~np.uint64((1 << int(_PLACE_BITS)) - 1)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    n = len(data) - LENGTH + 1
    low = np.minimum(low[:n], low[span - width : span - width + n])
    return (low & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64), grams


def runs_of(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of the texts laid end to end in ``raw``: text, start in it, strings, bytes before the anchor, two hashes."""
    data = np.frombuffer(raw, np.uint8)
    if len(data) < LENGTH:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    place, grams = anchors(data)
    first = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)[: len(place)]
    good = np.arange(len(place)) + LENGTH <= (first + lengths)[text]
    starts = np.flatnonzero(good)
    if not len(starts):
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    at = place[starts]
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    n = np.diff(np.r_[head, len(starts)])
    begin, anchor = starts[head], at[head]
    view = memoryview(raw)
    hashes = [xxh3_64_intdigest(view[i:j]) for i, j in zip(begin.tolist(), (begin + n + LENGTH - 1).tolist(), strict=True)]
    owner = text[begin]
    return owner, begin - first[owner], n, anchor - begin, grams[anchor], np.array(hashes, np.uint64)


def _stretches(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts by slices; a text above the slice is cut into overlapping stretches. (row, offset, bytes) of each."""
    for a, b in slices([len(t) for t in texts], SLICE_BYTES):
        if b - a == 1 and len(texts[a]) > SLICE_BYTES:
            for i in range(0, len(texts[a]) - LENGTH + 1, SLICE_BYTES):
                yield [a], [i], [texts[a][i : i + SLICE_BYTES + LENGTH - 1]]
        else:
            yield list(range(a, b)), [0] * (b - a), texts[a:b]


def _spans_of(d, t, start, size) -> tuple[np.ndarray, ...]:
    """Spans with overlapping ones of the same document united."""
    if not len(d):
        return d, t, start, size
    order = np.lexsort((start, t, d))
    d, t, start, end = d[order], t[order], start[order], (start + size)[order]
    fresh = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]
    group = np.cumsum(fresh) - 1
    wide = int(end.max(initial=0)) + 1
    reach = np.maximum.accumulate(group * wide + end) - group * wide  # the furthest end so far in the document
    cut = np.flatnonzero(np.r_[True, fresh[1:] | (start[1:] > reach[:-1])])
    last = np.r_[cut[1:], len(d)] - 1
    return d[cut], t[cut], start[cut], reach[last] - start[cut]


def emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each slice, the earliest of equal ones; the others as united spans without hashes."""
    names = [f.split()[0] for f in _RUN.split(", ")]
    for batch in batches:
        ids, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts = batch.column(2).cast(pa.binary()).to_pylist()
        for rows, offsets, parts in _stretches(texts):
            owner, start, n, left, anchor, run = runs_of(b"".join(parts), np.array([len(p) for p in parts], np.int64))
            if not len(owner):
                continue
            at = np.array(rows)[owner]
            d, t, start = ids[at], ts[at], start + np.array(offsets)[owner]
            order = np.lexsort((start, t, d, run, anchor))
            d, t, start, n, left, anchor, run = (x[order] for x in (d, t, start, n, left, anchor, run))
            fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])]
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(d)), 0))
            later = (d != d[lead]) | (t != t[lead]) | (start != start[lead])
            keep = np.flatnonzero(fresh)
            cols = [d[keep], t[keep], anchor[keep].view(np.int64), run[keep].view(np.int64), start[keep], n[keep].astype(np.int32), left[keep].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)
            if later.any():
                sd, st, ss, size = _spans_of(d[later], t[later], start[later], n[later] + LENGTH - 1)
                empty = pa.nulls(len(sd), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sd), pa.array(st), empty, empty, pa.array(ss), pa.array(size.astype(np.int32)), pa.nulls(len(sd), pa.int32())], names
                )


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Sorted batches, cut so that rows equal in the first ``keys`` columns stay together."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        other = np.zeros(n, bool)
        last = [batch.column(k)[n - 1].as_py() for k in range(keys)]
        if None in last:  # rows without a hash don't belong together
            yield pa.Table.from_batches([*kept, batch])
            kept = []
            continue
        for k in range(keys):
            column = batch.column(k).fill_null(0).to_numpy(zero_copy_only=False)
            other |= column != (last[k] or 0)
        cut = int(other.sum())
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = [batch.slice(cut)]
            continue
        if kept and [kept[-1].column(k)[kept[-1].num_rows - 1].as_py() for k in range(keys)] != last:
            yield pa.Table.from_batches(kept)
            kept = []
        kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept)


def judge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs as spans, and contested ones with the number of runs of their anchor."""
    names = [f.split()[0] for f in _FOUND.split(", ")]

    def out(contested: bool, d, t, anchor, start, n, left, runs) -> pa.RecordBatch:
        cols = [np.full(len(d), contested), d, t, anchor, start, n.astype(np.int32), left.astype(np.int32), runs]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    for table in _groups(batches, 1):
        bare = table.filter(pa.compute.is_null(table["anchor"]))
        if len(bare):
            d, t, start, n = (bare[c].to_numpy() for c in ("d", "t", "start", "n"))
            zero = np.zeros(len(d), np.int64)
            yield out(False, d, t, zero, start, n, zero, zero)
        table = table.filter(pa.compute.is_valid(table["anchor"]))
        if not len(table):
            continue
        anchor, run, d, t, start, n, left = (table[c].to_numpy() for c in ("anchor", "run", "d", "t", "start", "n", "left"))
        new_anchor = np.r_[True, anchor[1:] != anchor[:-1]]
        fresh = new_anchor | np.r_[True, (run[1:] != run[:-1]) | (n[1:] != n[:-1]) | (left[1:] != left[:-1])]
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(d)), 0))
        later = (d != d[lead]) | (t != t[lead]) | (start != start[lead])
        if later.any():
            zero = np.zeros(int(later.sum()), np.int64)
            yield out(False, d[later], t[later], zero, start[later], n[later] + LENGTH - 1, zero, zero)
        group = np.cumsum(new_anchor) - 1
        runs = np.bincount(group[fresh])[group]
        many = fresh & (runs > 1)
        if many.any():
            yield out(True, d[many], t[many], anchor[many], start[many], n[many], left[many], runs[many])


def fetch_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of contested runs; those of large groups string by string, dealt by hash."""
    names = ("anchor", "deal", "d", "t", "start", "left", "bytes")
    kinds = [pa.int64()] * 6 + [pa.binary()]
    for batch in batches:
        lists = batch.column(1)
        wanted = [lists.flatten().field(k).to_numpy().tolist() for k in ("d", "t", "anchor", "start", "n", "left", "runs")]
        rows = zip(*wanted, strict=True)
        out: list[tuple] = []
        for text, many in zip(batch.column(0), pa.compute.list_value_length(lists).to_pylist(), strict=True):
            raw = text.as_buffer().to_pybytes()
            for d, t, anchor, start, n, left, runs in islice(rows, many):
                if runs <= GROUP:
                    out.append((anchor, 0, d, t, start, left, raw[start : start + n + LENGTH - 1]))
                    continue
                for i in range(n):
                    piece = raw[start + i : start + i + LENGTH]
                    deal = 1 + xxh3_64_intdigest(piece) % (1 + runs * LENGTH // GROUP)
                    out.append((anchor, deal, d, t, start + i, left - i, piece))
            if len(out) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def repeated_strings(group: np.ndarray, place: np.ndarray, left: np.ndarray, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(run, x) of the strings x bytes before the anchor that another run of the group has at an earlier place."""
    m = len(parts)
    size = np.array([len(p) for p in parts], np.int64)
    begin = np.cumsum(size) - size
    right_data = np.frombuffer(b"".join(parts), np.uint8)
    left_data = np.frombuffer(b"".join(p[:k][::-1] for p, k in zip(parts, left.tolist(), strict=True)), np.uint8)
    right_order, right_common = sort_strings(right_data, begin + left, size - left, group)
    left_order, left_common = sort_strings(left_data, np.cumsum(left) - left, left, group)
    early = np.argsort(place, kind="stable")
    runs, backs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for x in range(LENGTH - GRAM + 1):
        fits = (left >= x) & (size - left >= LENGTH - x)
        if np.count_nonzero(fits) < 2:
            continue
        right_class[right_order] = np.cumsum(right_common < LENGTH - x)
        left_class[left_order] = np.cumsum(left_common < x)
        own = early[fits[early]]
        _, first, of = np.unique(right_class[own] * (m + 1) + left_class[own], return_index=True, return_inverse=True)
        later = own[place[own] > place[own[first[of]]]]
        runs.append(later)
        backs.append(np.full(len(later), x))
    return np.concatenate(runs), np.concatenate(backs)


def judge_contested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the repeated strings among contested runs."""
    for table in _groups(batches, 2):
        anchor, deal, d, t, start, left = (table[c].to_numpy() for c in ("anchor", "deal", "d", "t", "start", "left"))
        parts = table["bytes"].to_pylist()
        group = np.cumsum(np.r_[True, (anchor[1:] != anchor[:-1]) | (deal[1:] != deal[:-1])])
        order = np.lexsort((start + left, t, d))
        moved = np.r_[True, (d[order][1:] != d[order][:-1]) | (t[order][1:] != t[order][:-1]) | ((start + left)[order][1:] != (start + left)[order][:-1])]
        place = np.empty(len(d), np.int64)
        place[order] = np.cumsum(moved)
        run, back = repeated_strings(group, place, left.astype(np.int64), parts)
        if len(run):
            cols = _spans_of(d[run], t[run], start[run] + left[run] - back, np.full(len(run), LENGTH))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["d", "t", "start", "size"])


def cut_column(text: Column, spans: Column) -> Column:
    """A struct of removed bytes, maximal removed runs, and the bytes kept."""
    fields = [pa.int64(), pa.int64(), pa.binary()]

    @F.arrow_udf("n_removed long, n_spans long, kept binary")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists in batches:
            many = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            row = np.repeat(np.arange(len(texts)), many)
            row, _, start, size = _spans_of(row, np.zeros(len(row), np.int64), flat.field("start").to_numpy(), flat.field("size").to_numpy())
            removed = np.bincount(row, weights=size, minlength=len(texts)).astype(np.int64)
            count = np.bincount(row, minlength=len(texts))
            runs, kept = zip(start.tolist(), (start + size).tolist(), strict=True), []
            for text, n in zip(texts.cast(pa.binary()), count.tolist(), strict=True):
                raw = text.as_py() if text.is_valid else b""
                if n:
                    parts, done = [], 0
                    for a, b in islice(runs, n):
                        parts.append(raw[done:a])
                        done = b
                    raw = b"".join([*parts, raw[done:]])
                kept.append(raw)
            yield pa.StructArray.from_arrays([pa.array(removed, fields[0]), pa.array(count, fields[1]), pa.array(kept, fields[2])], ["n_removed", "n_spans", "kept"])

    return cut(text, spans)


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/repeated-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, bytes, removed bytes, maximal removed runs, and the bytes kept."""
    ids = docs.select(F.col(id_col)).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.col(id_col)).alias("k")).first()
    d = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    t = F.lit(0).cast("long") if ids["n"] == ids["k"] else F.xxhash64(text_col)  # orders texts under a repeated id
    keyed = docs.select(F.col(id_col).alias("doc"), d.alias("d"), t.alias("t"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs = keyed.where(F.octet_length("text") >= LENGTH).select("d", "t", "text").mapInArrow(emit_runs, _RUN)
    dealt = runs.repartition(F.coalesce("anchor", F.xxhash64("d", "t"))).sortWithinPartitions("anchor", "run", "n", "left", "d", "t", "start")
    ordered = dealt.select("anchor", "run", "d", "t", "start", "n", "left")
    found = _written(ordered.mapInArrow(judge_runs, _FOUND))
    fields = ("d", "t", "anchor", "start", "n", "left", "runs")
    wanted = found.where("contested").groupBy("d", "t").agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    texts = keyed.select("d", "t", "text").join(wanted, ["d", "t"]).select("text", "wanted")
    fetched = texts.mapInArrow(fetch_runs, "anchor long, deal long, d long, t long, start long, left long, bytes binary")
    sorted_runs = fetched.repartition("anchor", "deal").sortWithinPartitions("anchor", "deal")
    strings = sorted_runs.mapInArrow(judge_contested, _SPAN)
    whole = found.where("NOT contested").select("d", "t", "start", F.col("n").cast("long").alias("size"))
    spans = whole.union(strings).groupBy("d", "t").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    cut = cut_column(F.col("text"), F.col("spans")).alias("c")
    joined = keyed.join(spans, ["d", "t"], "left").select("doc", F.octet_length("text").cast("long").alias("n_bytes"), cut)
    return joined.select(F.col("doc").alias(id_col), "n_bytes", "c.n_removed", "c.n_spans", "c.kept")


def digests(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What :func:`remove_repeats` returns, with a hash in place of the bytes kept."""
    return cut.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
