"""Periodic runs: stretches of words that repeat a period three times or more.

A run is a stretch of consecutive words whose smallest period is q, with at least ``repeats * q`` and at least ``least`` words,
that no neighbouring word extends with that period.

*Where runs can be.* In a run every word lies in a window of ``least - least // repeats`` words that occurs again at a distance of at most a
``repeats``-th of the stretch at hand. Windows are compared by hashes, stretches that no such windows cover are cut away, and what is
left is looked at again until nothing changes. A collision of hashes only keeps a stretch that has no run. This is no
search: it spares trees where there is no periodicity.

*Runs.* For each stretch that is left, Ukkonen's suffix trees of it and of its reversal answer how far two places agree to the right and to the
left (``suffix_tree.Extensions``). Every run has a Lyndon root under the order of the words or under the opposite one: the longest Lyndon
word from i ends where the next smaller suffix begins, at j. So (i, j) for every i, under both orders, are the candidates, and both
extensions of i and j give the run of period j - i around them.

Defined results: null and empty texts have no words and no runs. Documents are independent rows: ties, repeats and extra columns make no
difference. A document is held by one task, with about 100 bytes a word; a stretch that repeats takes about 700 bytes a word while
its trees are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import slices
from tidegrid.llm.suffix_tree import Extensions

#: Texts of about so many bytes make a batch of results.
BATCH_BYTES = 1 << 22

RUN = "struct<start:bigint,length:bigint,period:bigint>"

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every ``width`` consecutive words, of ``words`` given as 64-bit hashes."""
    out, done = None, 0  # the hash of the first ``done`` words of each window
    power, span, level = words * np.uint64(_MIX[0]), 1, 1
    n = len(words) - width + 1
    while True:
        if width & span:
            part = power[done : done + n]
            out = part if out is None else (out ^ (out >> np.uint64(29))) * np.uint64(_MIX[-1]) + part
            done += span
        if 2 * span > width:
            return out
        left = power[: len(power) - span]
        power = (left ^ (left >> np.uint64(31))) * np.uint64(_MIX[level % 5]) + power[span:]
        span, level = 2 * span, level + 1


def stretches(words: np.ndarray, least: int, repeats: int) -> list[tuple[int, int]]:
    """Ranges outside which there is no run, of ``words`` given as 64-bit hashes."""
    width = least - least // repeats
    found, open_ = [], [(0, len(words))]
    while open_:
        a, b = open_.pop()
        m = b - a
        if m < least:
            continue
        hashes = window_hashes(words[a:b], width)
        order = np.argsort(hashes, kind="stable")
        again = (hashes[order[1:]] == hashes[order[:-1]]) & (np.diff(order) <= m // repeats)
        if not again.any():
            continue
        edges = np.zeros(m + 1, np.int64)
        for at in (order[:-1][again], order[1:][again]):
            np.add.at(edges, at, 1)
            np.add.at(edges, at + width, -1)
        covered = np.r_[False, np.cumsum(edges)[:m] > 0, False]
        cuts = np.flatnonzero(covered[1:] != covered[:-1]).reshape(-1, 2) + a
        if len(cuts) == 1 and tuple(cuts[0]) == (a, b):
            found.append((a, b))
        else:
            open_.extend(map(tuple, cuts.tolist()))
    return sorted(found)


def next_smaller(ranks: np.ndarray) -> np.ndarray:
    """For each place but the last, the next place of a smaller rank; the last has the smallest."""
    ranks = ranks.tolist()
    n = len(ranks) - 1
    out = [n] * n
    for i in range(n - 1, -1, -1):
        r, j = ranks[i], i + 1
        while ranks[j] > r:
            j = out[j]
        out[i] = j
    return np.array(out, np.int64)


def runs_of(codes: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """Rows (start, length, period) of the runs of a sequence of integers from 1 on, by start, then period."""
    n = len(codes)
    ahead, back = Extensions(codes), Extensions(codes[::-1])
    rows = []
    i = np.arange(n)
    for sign in (1, -1):
        j = next_smaller(ahead.ranks(sign))
        start = i - back.common(n - i, n - j)
        length = j + ahead.common(i, j) - start
        good = length >= np.maximum(least, repeats * (j - i))
        rows.append(np.stack([start, length, j - i], 1)[good])
    rows = np.unique(np.concatenate(rows), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def text_runs(words: list[bytes], least: int = 24, repeats: int = 3) -> np.ndarray:
    """Rows (start, length, period) of the runs of a text's words, by start, then period."""
    if repeats < 2 or least < repeats:
        raise ValueError("a run repeats its period twice at least, and has as many words as repeats")
    none = np.zeros((0, 3), np.int64)
    if len(words) < least:
        return none
    found = [none]
    for a, b in stretches(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), least, repeats):
        known: dict[bytes, int] = {}
        codes = np.fromiter((known.setdefault(w, len(known) + 1) for w in words[a:b]), np.int64, b - a)
        found.append(runs_of(codes, least, repeats) + [a, 0, 0])
    found = np.concatenate(found)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Without the words that any run has after its first period."""
    if not len(runs):
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]


def runs_column(text: Column, least: int, repeats: int) -> Column:
    """A struct of the runs and the collapsed text."""

    @F.arrow_udf(f"runs array<{RUN}>, collapsed string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            out = []
            for a, b in slices([len(x.as_buffer()) if x.is_valid else 0 for x in batch], BATCH_BYTES):
                each, texts = [], []
                for x in batch[a:b]:
                    words = x.as_py().encode().split() if x.is_valid else []
                    each.append(text_runs(words, least, repeats))
                    texts.append(b" ".join(kept_words(words, each[-1])))
                rows = np.concatenate(each)
                ends = np.cumsum([0, *map(len, each)])
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                out.append(pa.StructArray.from_arrays([lists, pa.array(texts, pa.binary()).cast(pa.string())], ["runs", "collapsed"]))
            yield pa.concat_arrays(out) if out else pa.array([], pa.struct([("runs", pa.list_(kind)), ("collapsed", pa.string())]))

    return found(text)


def periodic_runs(docs: DataFrame, least: int = 24, repeats: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``runs`` (start, length and period in words, by start, then period) and the ``collapsed`` text."""
    found = docs.select(F.col(id_col), runs_column(F.col(text_col), least, repeats).alias("found"))
    return found.select(id_col, "found.runs", "found.collapsed")


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: number of runs, the run of the greatest exponent, and hashes of all runs and of the collapsed text."""

    def greater(best: Column, x: Column) -> Column:
        mine, other = x["length"] * best["period"], best["length"] * x["period"]  # exact: words of a text fit 31 bits
        tie = (x["start"] < best["start"]) | (x["start"] == best["start"]) & (x["period"] < best["period"])
        return F.when((mine > other) | (mine == other) & tie, x).otherwise(best)

    best = F.when(F.size("runs") > 0, F.aggregate("runs", F.col("runs")[0], greater))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    return found.select(
        F.col(id_col),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
