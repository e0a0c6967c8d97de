"""Token counts by byte-pair merging over a heap and a linked list.

A text is cut at special strings and then by the tokenizer's pattern. Within a piece the lowest-rank adjacent pair
is merged again and again; a piece of n bytes with m merges is n - m tokens, so no identifier is ever looked up.

Null and empty texts have no tokens. Rows are independent of each other: repeated rows, ties and extra columns make no
difference. A piece of n bytes takes O(n log n) steps, so very long words need no special path.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.bpe_files import Merges, load_merges
from tidegrid.llm.common import once

#: Fixed value: the pattern that splits text before byte-level merging. White space is the Unicode property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Pieces up to this many characters are remembered, and so many of them, per worker process.
REMEMBERED_CHARS, REMEMBERED = 40, 400_000

_PLACE = (1 << 32) - 1


def merged_length(symbols: list[int], merges: Merges) -> int:
    """Tokens left of the numbered symbols when no pair can be merged any more."""
    n, rank, product = len(symbols), merges.rank, merges.product
    live = [*symbols, -1]
    after, before = list(range(1, n + 1)), list(range(-1, n))
    heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(live[i] << 20 | live[i + 1])) is not None]
    heapify(heap)
    left = n
    while heap:
        entry = heappop(heap)
        i, r = entry & _PLACE, entry >> 32
        j = after[i]
        if live[i] < 0 or live[j] < 0 or rank.get(live[i] << 20 | live[j]) != r:
            continue  # one of the two has been merged meanwhile
        live[i], live[j] = product[r], -1
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (s := rank.get(live[i] << 20 | live[k])) is not None:
                heappush(heap, s << 32 | i)
        h = before[i]
        if h >= 0 and (s := rank.get(live[h] << 20 | live[i])) is not None:
            heappush(heap, s << 32 | h)
    return left


def count_text(text: str, merges: Merges, known: dict[str, int], pieces, split) -> int:
    """Tokens of one text. ``known`` remembers pieces."""
    total = 0
    for part in split.split(text) if split and "<" in text else (text,):
        if part in merges.specials:
            total += 1
            continue
        found = pieces.findall(part)
        counts = list(map(known.get, found))
        if None in counts:
            for at, n in enumerate(counts):
                if n is None:
                    n = counts[at] = known.get(found[at])
                    if n is None:
                        n = counts[at] = merged_length(list(found[at].encode()), merges)
                        if len(found[at]) <= REMEMBERED_CHARS:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[found[at]] = n
        total += sum(counts)
    return total


def count_column(text: Column, path: str) -> Column:
    """Tokens of each text under the tokenizer file at ``path``."""

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = load_merges(path)
        known = once(("pieces", path), dict)
        pieces, split = regex.compile(PIECES), merges.special_pattern
        for batch in batches:
            out = [count_text(t.as_py(), merges, known, pieces, split) if t.is_valid else 0 for t in batch]
            yield pa.array(out, pa.int64())

    return tokens(text)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), count_column(text, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
