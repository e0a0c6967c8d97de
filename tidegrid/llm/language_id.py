"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams (one to three characters, letters in lower case, everything else a single space)
of every training row, per language: inside each task first, then by a grouped sum, so only one row per language and
bucket reaches the driver. The log-probability matrix (languages x buckets) is broadcast; its size is fixed by the
number of languages and ``buckets``. Scoring looks the n-grams of a text up in numpy and sums their columns.

Defined results: a null text and a text without a letter get ``und`` with score 0; so does everything if no row has
both a text and a language. Rows with a null language or text don't train. Of equally likely languages the first in
order of names wins. Repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import once

UNKNOWN = "und"

#: Characters hashed at once, so that very long texts need no more memory.
_CHUNK = 1 << 20


@dataclass
class LanguageModel:
    """``table[b, l]`` is the log-probability of bucket b in language l; ``prior`` that of the language."""

    names: list[str]
    prior: np.ndarray
    table: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.table)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return once(("letters",), lambda: np.array([chr(c).isalpha() for c in range(0x110000)]))


def ngram_buckets(text: str, buckets: int) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, in chunks of bounded size."""
    for start in range(0, len(text), _CHUNK):
        part = text[max(0, start - 2) : start + _CHUNK]  # the two characters before complete its n-grams
        codes = np.frombuffer(f" {part.lower()} ".encode("utf-32-le"), np.uint32)
        codes = np.where(letters()[codes], codes, 32).astype(np.uint64)
        codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]  # runs of spaces become one
        h = codes * np.uint64(0x9E3779B97F4A7C15)
        found = [h]
        for n in (1, 2):
            h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + codes[n:]
            found.append(h)
        every = np.concatenate(found)
        every = (every ^ (every >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        yield ((every >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def train(docs: DataFrame, buckets: int = 1 << 14, smoothing: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts over all rows of ``docs``. The driver receives one row per language and used bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
                seen[buckets] += 1
                for found in ngram_buckets(text.as_py(), buckets):
                    seen[:buckets] += np.bincount(found, minlength=buckets)
        for lang, seen in sums.items():
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(seen[at])], ["lang", "bucket", "n"])

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counted = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    names = sorted(got["lang"].unique())
    place = {name: i for i, name in enumerate(names)}
    counts = np.zeros((buckets + 1, len(names)))
    counts[got["bucket"].to_numpy(int), got["lang"].map(place).to_numpy(int)] = got["n"].to_numpy(float)
    grams, rows_of = counts[:buckets], counts[buckets]
    table = np.log(grams + smoothing) - np.log(grams.sum(axis=0) + smoothing * buckets)
    prior = np.log(np.maximum(rows_of, 1)) - np.log(max(rows_of.sum(), 1))
    return LanguageModel(names, prior, table)


def score(text: str | None, model: LanguageModel) -> tuple[str, float]:
    """The likeliest language and its posterior probability."""
    if text is None or not model.names or not has_letter(text):
        return UNKNOWN, 0.0
    total = model.prior.copy()
    for found in ngram_buckets(text, model.buckets):
        used = np.bincount(found, minlength=model.buckets)
        at = np.flatnonzero(used)
        total += used[at] @ model.table[at]
    best = int(np.argmax(total))
    return model.names[best], float(1 / np.exp(total - total[best]).sum())


def predict_column(text: Column, model: LanguageModel, session) -> Column:
    """A struct of ``lang_pred`` and ``score`` for each text."""
    shared = session.sparkContext.broadcast((model.names, model.prior, model.table))

    @F.arrow_udf("lang_pred string, score double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = LanguageModel(*shared.value)
        for batch in batches:
            found = [score(t.as_py(), own) for t in batch]
            langs, scores = zip(*found, strict=True) if found else ((), ())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text)


def held_out_column(id_col: str = "doc_id") -> Column:
    """Whether the remainder of the id's crc32 by 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out and predict every row."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(named.where(~held_out_column()))
    found = predict_column(F.col("text"), model, docs.sparkSession)
    return named.select("doc_id", held_out_column().alias("held_out"), found.alias("p")).select(
        F.col("doc_id").alias(id_col), "held_out", "p.lang_pred", "p.score"
    )
