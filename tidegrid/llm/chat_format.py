"""Chat formatting at token level.

*Segments.* Every role and text is encoded on its own, so no token reaches over the edge of a segment. This is done row by row,
before anything is shuffled.

*Assembly.* The turns of a conversation, in order, are strung together: the template's control strings are reserved ids above the
tokenizer's vocabulary, spliced between the segments; the place of every segment, the loss mask and the position of a turn in its
conversation are prefix sums (+1 where a learned text begins, -1 where it ends).

*Escapes.* A control string inside a role or text gets a backslash after its first character, one that already has backslashes there
gets one more; taking one away again is the inverse. So the rendered text has control strings only where the template put them, and no
text can produce a reserved id.

A formatted conversation is one row per turn, in order by ``seq``, with the position of its first token: a conversation of any length
passes through a task batch by batch and is never held as a whole. ``read_back`` needs only these rows.

Defined results: a null text or role is empty. Turns are ordered by turn (null first), then role, then the ids of the text; repeated rows are turns of
their own. Rows with a null conversation id form one conversation. Texts of any length are encoded in pieces cut where the tokenizer's
pattern ends a word anyway, so the ids are those of the whole text. An empty table has no conversations. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidegrid.llm.common import once, slices

#: Texts are given to the tokenizer library in pieces and batches of about so many characters.
PIECE_CHARS, BATCH_CHARS = 1 << 16, 1 << 20

#: Between a character that is no white space and a single space before a word, the tokenizer's pattern always ends a word.
_SAFE_CUT = re.compile(r"(?<=[^\s])(?= [^\s])")


@dataclass(frozen=True)
class Template:
    """How turns are marked. ``marks`` has (role, string before, string after); other roles are named between ``role`` strings."""

    begin: str = "<s>"
    marks: tuple[tuple[str, str, str], ...] = (("user", "[INST]", "[/INST]"), ("system", "[SYS]", "[/SYS]"), ("assistant", "", "</s>"))
    role: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    end: str = "</s>"
    learned: frozenset[str] = field(default_factory=lambda: frozenset({"assistant"}))

    def __post_init__(self) -> None:
        control = self.control
        if sum(not before for _, before, _ in self.marks) > 1 or not all((self.begin, self.end, *self.role, *(after for _, _, after in self.marks))):
            raise ValueError("one role at most may go without a string before it, and no other string may be empty")
        if any(c[0] in d[1:] or c[0] == "\\" for c in control for d in control):
            raise ValueError("the first character of a control string may stand nowhere else in one")
        if len(set(openings := [self.role[0], *(b for _, b, _ in self.marks)])) < len(openings):
            raise ValueError("two roles open alike")

    @property
    def control(self) -> list[str]:
        """The control strings, in the order of their reserved ids."""
        return list(dict.fromkeys([self.begin, self.end, *self.role, *(c for _, b, a in self.marks for c in (b, a) if c)]))

    @property
    def pattern(self) -> str:
        """A control string or an escaped one; the second group is the backslashes."""
        return "|".join(f"(?:{re.escape(c[0])})\\\\*(?:{re.escape(c[1:])})" for c in self.control)

    def escape(self, text: str) -> str:
        return re.sub(self.pattern, lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern, lambda m: m[0].replace("\\", "", 1) if "\\" in m[0] else m[0], text)


class Codec:
    """Texts to ids and back under a byte-level tokenizer file, and the reserved ids of a template above its vocabulary."""

    def __init__(self, path: str, template: Template):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # strings like the file's own special tokens are ordinary text
        self.library.no_truncation()
        self.library.no_padding()
        self.template = template
        self.first = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.reserved = {c: self.first + i for i, c in enumerate(template.control)}
        self.control = {i: c for c, i in self.reserved.items()}
        self.marks = {role: (self.reserved.get(before, -1), self.reserved[after]) for role, before, after in template.marks}
        self.roles = {before: role for role, (before, _) in self.marks.items()}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            at = 0
            while len(text) - at > PIECE_CHARS:
                cut = _SAFE_CUT.search(text, at + PIECE_CHARS)
                if cut is None:
                    break
                pieces.append(text[at : cut.start()])
                owner.append(i)
                at = cut.start()
            pieces.append(text[at:])
            owner.append(i)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for a, b in slices([len(p) for p in pieces], BATCH_CHARS):
            for i, coded in zip(owner[a:b], self.library.encode_batch_fast(pieces[a:b], add_special_tokens=False), strict=True):
                out[i].append(np.array(coded.ids, np.int32))
        return [np.concatenate(x) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a whole segment."""
        cuts = range(PIECE_CHARS, len(ids), PIECE_CHARS)
        names = [self.library.id_to_token(i) for part in np.split(ids, cuts) for i in part.tolist()]
        return "".join(names).translate(_bytes_of_names()).encode("latin-1").decode("utf-8")


def _bytes_of_names() -> dict[int, str]:
    """Byte-level token names spell bytes as printable characters: those that are printable stand for themselves, the others for 256, 257, ..."""

    def make() -> dict[int, str]:
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        return {b: chr(b) for b in plain} | {256 + i: chr(b) for i, b in enumerate(rest)}

    return once(("byte names",), make)


def _codec(path: str, template: Template) -> Codec:
    return once(("chat", path, repr(template)), lambda: Codec(path, template))


class Layout(NamedTuple):
    """Ids, loss mask and ends of consecutive turns."""

    ids: np.ndarray
    mask: np.ndarray
    ends: np.ndarray


def assemble(roles: list[str], role_ids: list[np.ndarray], text_ids: list[np.ndarray], first: np.ndarray, codec: Codec) -> Layout:
    """Strings the segments of turns together. ``first`` marks turns that begin a conversation."""
    t = codec.template
    named = np.array([r not in codec.marks for r in roles], bool)
    marks = [codec.marks.get(r, (codec.reserved[t.role[0]], codec.reserved[t.end])) for r in roles]
    opening, closing = (np.array(x, np.int32).reshape(-1) for x in (zip(*marks, strict=True) if marks else ([], [])))
    # A turn: [begin] [opening] [role, end of role] text closing
    lengths = np.zeros((len(roles), 6), np.int64)
    lengths[:, 0] = first
    lengths[:, 1] = opening >= 0
    lengths[:, 2] = [len(r) if n else 0 for r, n in zip(role_ids, named, strict=True)]
    lengths[:, 3] = named
    lengths[:, 4] = [len(x) for x in text_ids]
    lengths[:, 5] = 1
    ends = np.cumsum(lengths.reshape(-1)).reshape(lengths.shape)
    starts = ends - lengths
    total = int(ends[-1, -1]) if len(roles) else 0
    ids = np.empty(total, np.int32)
    ids[starts[first, 0]] = codec.reserved[t.begin]
    ids[starts[opening >= 0, 1]] = opening[opening >= 0]
    ids[starts[named, 3]] = codec.reserved[t.role[1]]
    ids[starts[:, 5]] = closing
    edges = np.zeros(total + 1, np.int8)
    for k, (role, text) in enumerate(zip(role_ids, text_ids, strict=True)):
        if named[k]:
            ids[starts[k, 2] : ends[k, 2]] = role
        ids[starts[k, 4] : ends[k, 4]] = text
    learned = np.array([r in t.learned for r in roles], bool) & (lengths[:, 4] > 0)
    edges[starts[learned, 4]] += 1
    edges[ends[learned, 4]] -= 1
    return Layout(ids, np.cumsum(edges[:-1], dtype=np.int8), ends[:, 5] if len(roles) else np.zeros(0, np.int64))


def _lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(values, kind))


def encode_turns(turns: DataFrame, path: str, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv, turn, role, and the ids of its escaped role and text. Nothing is shuffled."""
    conv_type = turns.schema[conv_col].dataType.simpleString()
    turn_type = turns.schema[turn_col].dataType.simpleString()
    given = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, template)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices([len(x.as_buffer()) for x in texts], BATCH_CHARS):
                part = batch.slice(a, b - a)
                roles = part.column("role").to_pylist()
                known = dict.fromkeys(r for r in roles if r not in codec.marks)
                known = dict(zip(known, codec.encode([template.escape(r) for r in known]), strict=True))
                none = np.zeros(0, np.int32)
                ids = codec.encode([template.escape(x) for x in part.column("text").to_pylist()])
                role_ids = [known.get(r, none) for r in roles]
                lists = [_lists(np.concatenate([none, *x]), np.cumsum([len(y) for y in x]), pa.int32()) for x in (role_ids, ids)]
                yield pa.RecordBatch.from_arrays([part.column("conv"), part.column("turn"), part.column("role"), *lists], ["conv", "turn", "role", "role_ids", "text_ids"])

    return given.mapInArrow(coded, f"conv {conv_type}, turn {turn_type}, role string, role_ids array<int>, text_ids array<int>")


def format_conversations(turns: DataFrame, path: str, template: Template = Template(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conversation, ``seq`` (0, 1, ... in order), ``start`` (position of its first token there), ``ids`` and ``loss_mask``."""
    coded = encode_turns(turns, path, template, conv_col, turn_col, role_col, text_col)
    conv_type = coded.schema["conv"].dataType.simpleString()

    def spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, template)
        last, seq, start = (), 0, 0  # of the conversation at hand; () is none, not even that of null
        for batch in batches:
            sizes = [len(x) for x in batch.column("text_ids")]
            for a, b in slices(sizes, BATCH_CHARS):
                part = batch.slice(a, b - a)
                convs = part.column("conv").to_pylist()
                before = [last, *((c,) for c in convs[:-1])]
                first = np.array([(c,) != p for c, p in zip(convs, before, strict=True)], bool)
                arrays = [[x.values.to_numpy() for x in part.column(name)] for name in ("role_ids", "text_ids")]
                layout = assemble(part.column("role").to_pylist(), *arrays, first, codec)
                length = np.diff(np.r_[0, layout.ends])
                seqs, starts = [], []
                for new, n in zip(first.tolist(), length.tolist(), strict=True):
                    if new:
                        seq = start = 0
                    seqs.append(seq)
                    starts.append(start)
                    seq, start = seq + 1, start + n
                last = (convs[-1],)
                lists = [_lists(layout.ids, layout.ends, pa.int32()), _lists(layout.mask, layout.ends, pa.int8())]
                yield pa.RecordBatch.from_arrays([part.column("conv"), pa.array(seqs, pa.int64()), pa.array(starts, pa.int64()), *lists], ["conv", "seq", "start", "ids", "loss_mask"])

    ordered = coded.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text_ids")
    return ordered.mapInArrow(spliced, f"conv {conv_type}, seq long, start long, ids array<int>, loss_mask array<tinyint>").withColumnRenamed("conv", conv_col)


def parse_turn(ids: np.ndarray, mask: np.ndarray, codec: Codec) -> tuple[str, str, str, str]:
    """Role, text and learned text of one formatted turn, and the string that it renders to."""
    t = codec.template
    at = np.flatnonzero(ids >= codec.first).tolist()
    cuts = np.split(np.arange(len(ids)), at)  # each part after the first begins with a reserved id
    shown, role, text = [], None, None
    for part in cuts:
        if not len(part):
            continue
        head = codec.control.get(int(ids[part[0]]))
        body = codec.decode(ids[part[1:] if head else part])
        shown.append((head or "") + body)
        if head is None or head == t.begin and len(part) > 1 or codec.roles.get(int(ids[part[0]])) is not None:
            role, text = codec.roles[int(ids[part[0]]) if head not in (None, t.begin) else -1], body
        elif head == t.role[0]:
            role = t.unescape(body)
        elif head == t.role[1]:
            text = body
    if text is None:  # nothing but the closing string
        role, text = codec.roles[-1], ""
    learned = codec.decode(ids[mask > 0])
    return role, t.unescape(text), t.unescape(learned), "".join(shown)


def read_back(formatted: DataFrame, path: str, template: Template = Template(), conv_col: str = "conv_id") -> DataFrame:
    """One row per formatted turn, from its ids and mask alone: conversation, seq, role, text, ``learned`` and ``formatted`` text."""
    given = formatted.select(F.col(conv_col).alias("conv"), "seq", "ids", "loss_mask")
    conv_type = given.schema["conv"].dataType.simpleString()

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, template)
        for batch in batches:
            for a, b in slices([len(x) for x in batch.column("ids")], BATCH_CHARS):
                part = batch.slice(a, b - a)
                pairs = zip(part.column("ids"), part.column("loss_mask"), strict=True)
                read = [parse_turn(x.values.to_numpy(), m.values.to_numpy(), codec) for x, m in pairs]
                columns = [pa.array(x, pa.string()) for x in zip(*read, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("conv"), part.column("seq"), *columns], ["conv", "seq", "role", "text", "learned", "formatted"])

    return given.mapInArrow(parsed, f"conv {conv_type}, seq long, role string, text string, learned string, formatted string").withColumnRenamed("conv", conv_col)


def conversation_digests(read: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation: turns, hash of roles and texts, characters and hash of the learned text, characters of the formatted text.

    A hash of a whole conversation takes its bytes in order, so its turns pass through one task, streamed; nothing of it is kept.
    """
    given = read.select(F.col(conv_col).alias("conv"), "seq", "role", "text", "learned", "formatted")
    conv_type = given.schema["conv"].dataType.simpleString()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        now, turns, texts = (), None, None
        counts = [0, 0, 0]
        done: list[tuple] = []

        def close() -> None:
            if now:
                done.append((now[0], counts[0], turns.hexdigest(), counts[1], texts.hexdigest(), counts[2]))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            kind = batch.column("conv").type
            for conv, role, text, learned, shown in zip(*(batch.column(c) for c in ("conv", "role", "text", "learned", "formatted")), strict=True):
                if (key := (conv.as_py(),)) != now:
                    close()
                    now, turns, texts, counts = key, hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
                text, learned = text.as_py(), learned.as_py()
                turns.update(f"{role.as_py()}\n{text}\n".encode())
                texts.update(learned.encode())
                counts[0] += 1
                counts[1] += len(learned)
                counts[2] += len(shown.as_py())
            if done:
                yield out()
        close()
        if done:
            yield out()

    ordered = given.repartition("conv").sortWithinPartitions("conv", "seq")
    schema = f"conv {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.mapInArrow(hashed, schema).withColumnRenamed("conv", conv_col)
