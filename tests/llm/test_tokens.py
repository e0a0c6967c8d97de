"""Token counts and encoding against the tokenizers library."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm.bpe_files import load_merges
from tidegrid.llm.bpe_stream import Decoder, Encoder, digests, encode_decode, merge_window, stream_word, sufficient_lookahead
from tidegrid.llm.token_count import merged_length, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def texts() -> list[str]:
    r = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|", "a", " ", "\n", "  ", "'s", "é", "é", "12", "##", "the", "hello", "Σ", "ß", "|>", "İ", "日本", "\x1c", "\xa0", "Ᲊ"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    return [*made, "", "a" * 20000, "ab" * 8000, "é" * 3000, "!" * 4000, "the" * 3000]


def test_counts_equal_the_library(spark):
    every = texts()
    want = [len(x.ids) for x in Tokenizer.from_file(BYTES).encode_batch(every, add_special_tokens=False)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(every)], "doc_id long, text string, n_tokens string").repartition(3)
    got = {r.doc_id: (r.n_tokens, r.n_bytes, r.over_limit) for r in token_counts(docs, BYTES).collect()}
    assert got == {i: (n, len(t.encode()), n > 1024) for i, (n, t) in enumerate(zip(want, every, strict=True))}


def test_null_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None), (1, None), (None, ""), (2, "x y"), (2, "x y")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(docs, BYTES).collect())
    assert got == [(0, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (2, 3, 2, False), (2, 3, 2, False)]
    assert token_counts(docs.where("doc_id > 9"), BYTES).count() == 0


def test_round_trip_equals_the_library(spark):
    every = texts()
    library = Tokenizer.from_file(WORDS)
    want = [x.ids for x in library.encode_batch(every, add_special_tokens=False)]
    decoded = library.decode_batch(want, skip_special_tokens=False)
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (list(r.ids), r.decoded) for r in encode_decode(docs, WORDS).collect()}
    assert got == {i: (x, t) for i, (x, t) in enumerate(zip(want, decoded, strict=True))}


def test_round_trip_of_nulls(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "Hi")], "doc_id long, text string")
    assert sorted((r.n_tokens for r in digests(encode_decode(docs, WORDS)).collect())) == [0, 0, 1]
    assert encode_decode(docs.where(F.lit(False)), WORDS).count() == 0


def test_streaming_is_stable_for_every_split(spark):
    """The transducer with the least look-ahead gives what merging the whole word gives."""
    encoder, r = Encoder(WORDS), random.Random(8)
    for _ in range(60):
        word = "".join(r.choice(["ing", "tion", "th", "e", "an", "s", "er", "ha", "a"]) for _ in range(400)).encode()
        symbols = [*word[:-1], word[-1] + 256]
        assert list(stream_word(iter(symbols), encoder.merges, encoder.widths, encoder.lookahead)) == merge_window(symbols, encoder.merges)
    assert 0 < sufficient_lookahead(encoder.merges) < 1000


def test_heap_equals_repeated_search():
    merges, r = load_merges(BYTES), random.Random(2)
    for _ in range(300):
        symbols = [r.choice(b" theinand") for _ in range(r.randint(1, 60))]
        assert merged_length(symbols, merges) == len(merge_window(symbols, merges))


def test_bytes_come_back_as_text():
    encoder, decoder = Encoder(WORDS), Decoder(WORDS, "bytes")
    assert decoder.decode(encoder.encode("größe 東京 <|endoftext|>").tolist()) == "größe 東京 <|endoftext|>"
    assert decoder.decode(encoder.encode("東").tolist()[:1]) in ("�", "東 ", "東")
    with pytest.raises(ValueError):
        Decoder(WORDS, "other")
