"""Byte-pair encoding as a transducer with bounded look-ahead, and decoding as a state machine.

*Encoding.* Whether a merge happens near the end of what has been read can depend on symbols not read yet. That
uncertainty moves left only through a chain of overlapping merges, each later in the merge list than the one before,
so the list itself bounds how far it reaches: :func:`sufficient_lookahead`. The transducer keeps a window of a few
look-aheads, merges it, emits the tokens that end before the uncertain zone, and drops their symbols. Dropping is safe
because a boundary between tokens splits the encoding: the right part alone encodes to the same tokens. Memory is
constant in the length of a word.

*Decoding.* :class:`Decoder` takes identifiers one after another. In ``pieces`` mode it writes what the tokenizer file
asks for, which without a decoder section is the tokens' names joined by spaces. In ``bytes`` mode it turns the names
back into bytes and those into text, holding at most an unfinished UTF-8 character, with word ends as spaces.

Null texts are treated as empty; an empty text has no tokens and decodes to an empty text. Rows are independent, so
ties, repeated rows, empty tables and extra columns make no difference.
"""

from __future__ import annotations

import codecs
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenizers import Regex as LibraryRegex
from tokenizers import normalizers, pre_tokenizers

from tidegrid.llm.bpe_files import Merges, byte_alphabet, load_merges
from tidegrid.llm.common import once, slices

#: Fixed value: the pieces that the word tokenizer keeps. White space is the Unicode property.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"

#: The same pieces of texts in which :data:`BEYOND` finds nothing, for the faster of the two pattern engines. There
#: a letter is a word character but for digits, fractions and the underscore, and x1c to x1f are not white space.
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|[_\x1c-\x1f])+")

#: Every character below is assigned in all versions of Unicode at hand.
BEYOND = regex.compile("[^\\x00-\u0557]")

REMEMBERED_CHARS, REMEMBERED = 40, 500_000

#: Texts held at once as Python objects.
SLICE_ROWS = 500


def sufficient_lookahead(merges: Merges) -> int:
    """Symbols before the end of the input read so far that symbols still to come may change.

    Going through the list from its end, ``reach[t]`` is how far left of a symbol ``t`` the doubt about ``t`` can
    spread through merges not considered yet: a merge ``(x, t)`` puts ``x`` and ``xt`` in doubt, and those spread only
    through later merges.
    """
    width = {}
    for s, name in enumerate(merges.names):
        body = name.removesuffix(merges.word_end) if merges.word_end else name
        width[s] = max(1, len(body))
    reach: dict[int, int] = {}
    most = 0
    for (x, t), xt in zip(reversed(merges.pairs), reversed(merges.product), strict=True):
        far = width[x] + max(reach.get(x, 0), reach.get(xt, 0))
        reach[t] = max(reach.get(t, 0), far)
        most = max(most, far)
    return most


def merge_window(symbols: list[int], merges: Merges) -> list[int]:
    """The tokens of a short run of symbols: the lowest-rank pair first, the leftmost of equals."""
    rank, product = merges.rank, merges.product
    live = list(symbols)
    ranks = [rank.get(a << 20 | b, 1 << 40) for a, b in zip(live, live[1:], strict=False)]
    while ranks:
        low = min(ranks)
        if low == 1 << 40:
            break
        i = ranks.index(low)
        live[i : i + 2] = [product[low]]
        del ranks[i]
        if i:
            ranks[i - 1] = rank.get(live[i - 1] << 20 | live[i], 1 << 40)
        if i < len(ranks):
            ranks[i] = rank.get(live[i] << 20 | live[i + 1], 1 << 40)
    return live


def stream_word(symbols: Iterator[int], merges: Merges, widths: list[int], lookahead: int) -> Iterator[int]:
    """The tokens of a word of any length, emitted once they are stable."""
    window: list[int] = []
    full = 4 * lookahead
    for s in symbols:
        window.append(s)
        if len(window) < full:
            continue
        stable, at = len(window) - lookahead, 0
        for token in merge_window(window, merges):
            if at + widths[token] > stable:
                break
            yield token
            at += widths[token]
        if at == 0:  # a single token spans the stable zone; only a longer window can tell
            full *= 2
        else:
            full = 4 * lookahead
        del window[:at]
    yield from merge_window(window, merges)


class Encoder:
    """Texts to identifiers under one tokenizer file."""

    def __init__(self, path: str):
        self.merges = load_merges(path)
        m = self.merges
        self.lookahead = sufficient_lookahead(m)
        self.widths = [max(1, len(n.removesuffix(m.word_end) if m.word_end else n)) for n in m.names]
        self.ids = [m.vocabulary.get(n, -1) for n in m.names]
        self.words, self.split = regex.compile(WORDS), m.special_pattern
        self.known: dict[str, bytes] = {}  # identifiers of four bytes
        self.library_normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.library_split = pre_tokenizers.Split(LibraryRegex(WORDS.replace(r"\p{White_Space}", r"\s")), "removed", invert=True)

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        symbols = [*raw[:-1], raw[-1] + 256]
        if len(symbols) < 4 * self.lookahead:  # the window never fills
            tokens = merge_window(symbols, self.merges)
        else:
            tokens = stream_word(iter(symbols), self.merges, self.widths, self.lookahead)
        return [self.ids[s] for s in tokens]

    def pieces(self, part: str) -> list[str]:
        if part.isascii() or not BEYOND.search(part):
            return LATIN_WORDS.findall(normal(part))
        if any(unicodedata.category(c) == "Cn" for c in set(part)):
            # Characters that this Python doesn't know yet: the library's own tables decide.
            return [w for w, _ in self.library_split.pre_tokenize_str(self.library_normal.normalize_str(part))]
        return self.words.findall(normal(part))

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        known = self.known
        for part in self.split.split(text) if self.split and "<" in text else (text,):
            special = self.merges.specials.get(part)
            if special is not None:
                out.append(special.to_bytes(4, sys.byteorder))
                continue
            words = self.pieces(part)
            coded = list(map(known.get, words))
            if None in coded:
                for at, ids in enumerate(coded):
                    if ids is None:
                        ids = known.get(words[at])
                        if ids is None:
                            ids = np.array(self.word(words[at]), np.int32).tobytes()
                            if len(words[at]) <= REMEMBERED_CHARS:
                                if len(known) >= REMEMBERED:
                                    known.clear()
                                known[words[at]] = ids
                        coded[at] = ids
            out += coded
        return np.frombuffer(b"".join(out), np.int32)


def normal(text: str) -> str:
    """Composed and in lower case, each character by itself; the pieces drop white space, so none is rewritten."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class Decoder:
    """Identifiers to text, a token at a time; the state is one unfinished character at most."""

    def __init__(self, path: str, mode: str = "pieces"):
        m = load_merges(path)
        self.mode = mode
        self.names = {i: n for n, i in [*m.vocabulary.items(), *m.specials.items()]}
        self.specials = set(m.specials.values())
        if mode == "bytes":
            value = {c: b for b, c in enumerate(byte_alphabet())}
            self.raw = {}
            for i, name in self.names.items():
                if i not in self.specials:
                    ends = bool(m.word_end) and name.endswith(m.word_end)
                    body = name.removesuffix(m.word_end) if ends else name
                    self.raw[i] = bytes(value[c] for c in body) + b" " * ends
        elif mode != "pieces":
            raise ValueError(f"unknown mode {mode!r}")
        self.reset()

    def reset(self) -> None:
        self.first = True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, token: int) -> str:
        """What this token adds for certain."""
        if self.mode == "pieces":
            before, self.first = ("" if self.first else " "), False
            return before + self.names[token]
        if token in self.specials:
            return self.utf8.decode(b"", True) + self.names[token]
        return self.utf8.decode(self.raw[token])

    def finish(self) -> str:
        """What is left at the end; the decoder is then ready for the next text."""
        rest = self.utf8.decode(b"", True)
        self.reset()
        return rest

    def feed_all(self, tokens: list[int]) -> str:
        """As :meth:`feed` for a run of tokens."""
        if self.mode != "pieces" or not tokens:
            return "".join(map(self.feed, tokens))
        before, self.first = ("" if self.first else " "), False
        return before + " ".join(map(self.names.__getitem__, tokens))

    def decode(self, ids: list[int]) -> str:
        out = self.feed_all(ids)
        return out + self.finish()


def coded_column(text: Column, path: str, mode: str = "pieces") -> Column:
    """A struct of the identifiers of each text and of the text that they decode to."""
    kinds = [pa.list_(pa.int32()), pa.string()]

    @F.arrow_udf("ids array<int>, decoded string")
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = once(("encoder", path), lambda: Encoder(path))
        decoder = once(("decoder", path, mode), lambda: Decoder(path, mode))
        for batch in batches:
            parts = [pa.StructArray.from_arrays([pa.array([], k) for k in kinds], ["ids", "decoded"])]
            for a, b in slices(batch.is_valid().cast("int64").to_pylist(), SLICE_ROWS):
                ids = [encoder.encode(t or "") for t in batch[a:b].to_pylist()]
                texts = [decoder.decode(x.tolist()) for x in ids]
                parts.append(pa.StructArray.from_arrays([pa.array(ids, kinds[0]), pa.array(texts, kinds[1])], ["ids", "decoded"]))
            yield pa.concat_arrays(parts)

    return code(text)


def encode_decode(docs: DataFrame, path: str, mode: str = "pieces", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, identifiers and decoded text."""
    return docs.select(F.col(id_col), coded_column(F.col(text_col), path, mode).alias("c")).select(id_col, "c.ids", "c.decoded")


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hashes of what :func:`encode_decode` returns."""
    return coded.select(
        F.col(id_col),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
