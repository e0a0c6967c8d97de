"""SimHash near-duplicates by a generalised pigeonhole search.

*Fingerprints.* A bit of a document's 64-bit fingerprint is 1 if it is set in more than half of the hashes of its shingles
(``shingle`` words, repeats included).

*Links.* Copies share a fingerprint, so the search runs over distinct ones; within four bits of a fingerprint there are
fewer than 700,000 of them, however many documents are near copies. Bits are grouped into partitions of correlated bits
(correlations are summed over all fingerprints). If partition i gets the threshold t_i and the sum of t_i + 1 is
``distance`` + 1, two fingerprints within ``distance`` bits agree on some partition up to t_i bits; a dynamic programme
picks the number of partitions and the thresholds that minimise rows sent plus candidate pairs expected from the bit
frequencies. Each fingerprint goes to the bucket of its own value in each partition, and probes the buckets of the values
up to t_i bits away that are smaller, so every pair meets at one of the two. Inside a bucket all candidates are verified
on the full fingerprints; a task keeps the links only as stars of the components it has seen, never as pairs.

*Components* of fingerprints are found with alternating stars and carried back to the documents.

Defined results: null and empty texts have the fingerprint zero and are linked with each other; documents with fewer
words than a shingle hash all their words as one. A component is named by its smallest document id; null ids name none
unless all ids in it are null. Repeated rows share component and fingerprint; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidegrid.llm.common import unused
from tidegrid.llm.components import components
from tidegrid.session import checkpointed

BITS = 64

#: Shingle hashes held at once; candidate pairs compared at once.
_HASHES, _PAIRS = 1 << 15, 1 << 20


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    """The fingerprint of a text, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][:n].tolist()
    stops = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(joined)]
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, _HASHES):
        some = zip(starts[a : a + _HASHES], stops[a : a + _HASHES], strict=True)
        hashes = np.array([xxh64_intdigest(joined[i:j], seed) for i, j in some], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """The fingerprint of each text, as a long with the same bits."""

    @F.arrow_udf("long")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [fingerprint(t.as_py(), shingle, seed) if t.is_valid else 0 for t in batch.cast(pa.binary())]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return fingerprints(text)


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many both of two bits are set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(raw, axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        if n:
            at = np.arange(BITS * BITS + 1)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.r_[both.ravel(), n].astype(np.int64))], ["at", "n"])

    rows = prints.select("fp").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["at"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def partitions(n: int, both: np.ndarray, count: int) -> list[list[int]]:
    """``count`` groups of bits of equal size, each grown by the bit most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    tie = np.abs(cov / np.outer(scale, scale))
    free, groups = list(range(BITS)), []
    for g in range(count):
        size = len(free) // (count - g)
        group = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(sorted(group))
    return groups


def plan_search(n: int, both: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds. The dynamic programme hands out ``distance`` + 1 units, t + 1 to a partition."""
    p = np.diag(both) / max(n, 1)
    differs = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for count in range(2, distance + 2):
        groups = partitions(n, both, count)
        costs = []
        for group in groups:
            spread = np.array([1.0])  # distribution of the distance of two fingerprints on this partition
            for b in group:
                spread = np.convolve(spread, [1 - differs[b], differs[b]])
            ways, row = 1.0, [0.0]
            for t in range(distance + 1):
                ways *= (len(group) - t + 1) / t if t else 1
                sent = n * (1 + sum(_choose(len(group), k) for k in range(1, t + 1)) / 2)
                row.append(4 * sent + n * n / 2 * spread[: t + 1].sum() if t < len(group) else np.inf)
            costs.append(row)
        table = {0: (0.0, [])}
        for row in costs:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (cost, given) in table.items():
                for units in range(distance + 2 - used):
                    c = cost + row[units]
                    if used + units not in nxt or c < nxt[used + units][0]:
                        nxt[used + units] = (c, [*given, units])
            table = nxt
        cost, given = table[distance + 1]
        if best is None or cost < best[0]:
            best = cost, [(g, units - 1) for g, units in zip(groups, given, strict=True) if units]
    return best[1]


def _choose(n: int, k: int) -> float:
    out = 1.0
    for i in range(k):
        out *= (n - i) / (i + 1)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bucket_rows(prints: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """Rows (part, value, fp): a fingerprint at its own value of each partition and at the smaller values it probes.

    Values stay where they are in the 64 bits; "smaller" compares the differing bits from the top, which
    for a mask means that its highest bit is set in the fingerprint.
    """
    fp = F.col("fp")

    def own(bits: list[int]) -> Column:
        return fp.bitwiseAND(F.lit(_signed(sum(1 << b for b in bits))))

    def probes(part: int, bits: list[int], threshold: int) -> Column:
        chosen = [c for t in range(1, threshold + 1) for c in combinations(bits, t)]
        masks = F.array(*(F.lit(_signed(sum(1 << b for b in c))) for c in chosen))
        tops = F.array(*(F.lit(_signed(1 << max(c))) for c in chosen))
        pairs = F.filter(F.arrays_zip(masks.alias("m"), tops.alias("t")), lambda x: fp.bitwiseAND(x["t"]) != 0)
        return F.transform(pairs, lambda x: F.struct(F.lit(part).alias("part"), own(bits).bitwiseXOR(x["m"]).alias("value")))

    groups = [F.array(F.struct(F.lit(part).alias("part"), own(bits).alias("value"))) for part, (bits, _) in enumerate(plan)]
    groups += [probes(part, bits, threshold) for part, (bits, threshold) in enumerate(plan) if threshold]
    return prints.select("fp", F.explode(F.concat(*groups)).alias("b")).select("b.part", "b.value", "fp")


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links as stars: every node that is not the least of its component, and that least."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def bucket_links(home: np.ndarray, guests: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large bucket that connect the same fingerprints as all links of its members to those at home.

    Taking the members a linked one reaches out of those not reached yet, each is compared with what is left only.
    """
    rest = np.concatenate([home, guests])
    at_home = np.r_[np.ones(len(home), bool), np.zeros(len(guests), bool)]
    us, vs, queue = [], [], []
    while len(rest):
        if not queue:
            first = int(np.argmax(at_home)) if at_home.any() else -1
            if first < 0:
                break
            queue.append((rest[first], True))
            rest, at_home = np.delete(rest, first), np.delete(at_home, first)
        fp, is_home = queue.pop()
        hit = _near(rest, fp, distance) & (at_home | is_home)
        if hit.any():
            us.append(np.full(int(hit.sum()), fp))
            vs.append(rest[hit])
            queue += list(zip(rest[hit], at_home[hit].tolist(), strict=True))
            rest, at_home = rest[~hit], at_home[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def links_of(part: np.ndarray, value: np.ndarray, fp: np.ndarray, masks: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links in whole buckets, given as rows sorted by part and value."""
    first = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (value[1:] != value[:-1])])
    size = np.diff(np.r_[first, len(fp)])
    home = (fp & masks[part]) == value
    homes = np.add.reduceat(home.astype(np.int64), first)
    us, vs = [], []
    small = (homes > 0) & (size > 1) & (homes * size <= _PAIRS // 16)
    for g in np.flatnonzero((homes > 0) & (size > 1) & ~small):
        rows = slice(first[g], first[g] + size[g])
        u, v = bucket_links(fp[rows][home[rows]], fp[rows][~home[rows]], distance)
        us.append(u)
        vs.append(v)
    group = np.repeat(np.arange(len(first)), size)
    left = np.flatnonzero(home & small[group])  # each at home is compared with all rows of its bucket
    many = size[group[left]]
    ends = np.cumsum(many)
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _PAIRS)))
        m = many[a:b]
        x = np.repeat(left[a:b], m)
        y = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[group[left[a:b]]], m)
        good = (x != y) & ((x < y) | ~home[y]) & _near(fp[x], fp[y], distance)
        us.append(fp[x[good]])
        vs.append(fp[y[good]])
        a = b
    none = np.zeros(0, np.uint64)
    u, v = np.concatenate([none, *us]), np.concatenate([none, *vs])
    return local_stars(u, v) if len(u) else (u, v)


def find_links(prints: DataFrame, distance: int, plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Columns u, v: links whose components are those of all pairs within ``distance`` bits. ``prints`` has distinct fp."""
    plan = plan or plan_search(*bit_statistics(prints), distance)
    masks = np.array([sum(1 << b for b in bits) for bits, _ in plan], np.uint64)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []

        def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            u, v = links_of(*rows, masks, distance)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, value, fp = (c.to_numpy() for c in batch.columns)
            rows = (part.astype(np.int64), value.view(np.uint64), fp.view(np.uint64))
            cut = int(((part != part[-1]) | (value != value[-1])).sum())  # sorted: the last bucket may go on
            if not cut:  # the whole batch belongs to the bucket at hand
                if kept and (kept[-1][0][-1] != rows[0][0] or kept[-1][1][-1] != rows[1][0]):
                    yield out(tuple(np.concatenate(x) for x in zip(*kept, strict=True)))
                    kept = []
                kept.append(rows)
                continue
            kept.append(tuple(x[:cut] for x in rows))
            yield out(tuple(np.concatenate(x) for x in zip(*kept, strict=True)))
            kept = [tuple(x[cut:] for x in rows)]
        if kept:
            yield out(tuple(np.concatenate(x) for x in zip(*kept, strict=True)))

    rows = bucket_rows(prints, plan).repartition("part", "value").sortWithinPartitions("part", "value")
    return rows.mapInArrow(links, "u long, v long")


def rooted_documents(docs: DataFrame, distance: int, shingle: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: doc, text_hash, fp, the least fingerprint of its component, and the least id there."""
    text = F.col(text_col)
    printed = checkpointed(
        docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("text_hash"), fingerprint_column(text, shingle, seed).alias("fp"))
    )
    nodes = checkpointed(printed.groupBy("fp").agg(F.min("doc").alias("least")))
    labels = components(find_links(nodes, distance)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(labels, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return printed.join(rooted.select("fp", "root").join(named, "root"), "fp")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits) and the smallest id of its component."""
    found = rooted_documents(docs, distance, shingle, seed, id_col, text_col)
    return found.select(F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, of repeated rows any."""
    return keep_least(docs, rooted_documents(docs, distance, shingle, seed, id_col, text_col), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the row of the smallest id of each root; ``found`` has doc, text_hash and root of every row."""
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull(), F.col("doc").alias("i"), F.col("text_hash").alias("h"))).alias("s")).select("s.i", "s.h")
    name = unused(docs, "text_hash")
    hashed = docs.withColumn(name, F.xxhash64(F.col(text_col)))
    kept = hashed.join(chosen, hashed[id_col].eqNullSafe(chosen["i"]) & (hashed[name] == chosen["h"]), "left_semi")
    return kept.dropDuplicates([id_col, name]).drop(name)
