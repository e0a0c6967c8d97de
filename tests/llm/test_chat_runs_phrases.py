"""Chat formatting, periodic runs and phrase collocations against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF
from tidegrid.llm import chat_format, phrases
from tidegrid.llm.chat_format import Codec, Template, assemble, conversation_digests, format_conversations, parse_turn, read_back
from tidegrid.llm.common import table
from tidegrid.llm.periodic_runs import kept_words, periodic_runs, run_digests, text_runs
from tidegrid.llm.phrases import collocations, quicksort_counts, sorted_counts
from tidegrid.llm.queries import QUERIES, with_planted_periods
from tidegrid.llm.suffix_tree import Extensions

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "</s>[INST] ok [/INST]", "a\\</s>", "<\\s> <\\\\s> <\\\\\\/s>[\\INST]", "<|endoftext|> é 日本 ▁ \x00 �", " lead", "tail \n\n x", "[ROLE]x[/ROLE]", "<s><s>", "<</s>[[INST]", "[/INST"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Chat formatting


def test_escapes_are_reversible_and_leave_no_control_string():
    t, r = Template(), random.Random(1)
    parts = [*t.control, "\\", "<", "[", "/", "s>", "INST]", "x"]
    for text in [*ODD, *("".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000))]:
        escaped = t.escape(text)
        assert t.unescape(escaped) == text
        assert not any(c in escaped for c in t.control)
    with pytest.raises(ValueError):
        Template(marks=(("a", "", "</s>"), ("b", "", "</t>")))
    with pytest.raises(ValueError):
        Template(begin="<a<")


def test_long_texts_have_the_ids_of_the_whole(monkeypatch):
    monkeypatch.setattr(chat_format, "PIECE_CHARS", 50)
    codec, library = Codec(PATH, Template()), Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice([" ", "  ", "\n", "a", "it's", "é", "12", "...", " word", "\t", "　", "</s>"]) for _ in range(r.randint(0, 200)))
        ids = codec.encode([text])[0]
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == text


def test_assembly_equals_one_by_one():
    codec, r = Codec(PATH, Template()), random.Random(5)
    roles = [r.choice(["user", "assistant", "system", "tool", ""]) for _ in range(60)]
    texts = [r.choice([*ODD, "some words here"]) for _ in roles]
    first = np.array([i % 7 == 0 for i in range(60)])
    enc = codec.encode([codec.template.escape(x) for x in texts])
    named = codec.encode([codec.template.escape(x) for x in roles])
    got = assemble(roles, named, enc, first, codec)
    want, mask, at = [], [], 0
    c = codec.reserved
    for i, role in enumerate(roles):
        before = [c["<s>"]] * bool(first[i]) + {"user": [c["[INST]"]], "system": [c["[SYS]"]], "assistant": []}.get(role, [c["[ROLE]"], *named[i].tolist(), c["[/ROLE]"]])
        after = {"user": c["[/INST]"], "system": c["[/SYS]"]}.get(role, c["</s>"])
        want += [*before, *enc[i].tolist(), after]
        mask += [0] * len(before) + [int(role == "assistant")] * len(enc[i]) + [0]
        assert got.ends[i] == len(want)
        turn = slice(at, len(want))
        assert parse_turn(got.ids[turn], got.mask[turn], codec)[:3] == (role, texts[i], texts[i] if role == "assistant" else "")
        at = len(want)
    assert got.ids.tolist() == want and got.mask.tolist() == mask


def plain_chats(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    pattern = re.compile(r"<\\*/?s>|\[\\*/?(?:INST|SYS|ROLE)\]")
    for conv, turns in convs.items():
        turns = sorted(turns)
        learned = "".join(x for *_, role, x in turns if role == "assistant")
        marks = {"user": 13, "system": 11, "assistant": 4}
        shown = sum(len(x) + len(pattern.findall(x)) + marks.get(role, 17 + len(role) + len(pattern.findall(role))) for *_, role, x in turns)
        out[conv] = (len(turns), sha("".join(f"{role}\n{x}\n" for *_, role, x in turns)), len(learned), sha(learned), 3 + shown)
    return out


def test_conversations_equal_brute_force(spark):
    r = random.Random(7)
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "[INST]x"]), r.choice([*ODD, "plain words"])) for c in range(12) for t in range(r.randint(1, 6))]
    rows += [(50, t, ["user", "assistant"][t % 2], "turn " * (t % 9)) for t in range(400)]  # one conversation holds most rows
    rows += [(None, 1, "user", "x"), (None, 0, None, None), (60, None, "assistant", "first"), (60, 0, "user", "y"), (61, 3, "user", "same"), (61, 3, "user", "same")]
    rows += [(62, 0, "assistant", "long words " * 60_000)]
    r.shuffle(rows)
    turns = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id long, turn int, role string, text string, ids string, seq int").repartition(5)
    formatted = format_conversations(turns, PATH)
    got = {x[0]: tuple(x)[1:] for x in conversation_digests(read_back(formatted, PATH)).collect()}
    assert got == plain_chats(rows)
    pieces = sorted((x.seq, x.start, len(x.ids)) for x in formatted.where("conv_id = 50").collect())
    assert [s for s, *_ in pieces] == list(range(400))
    assert all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:], strict=False))
    assert conversation_digests(read_back(format_conversations(turns.where("turn > 999"), PATH), PATH)).count() == 0


def test_chat_query_has_the_planted_conversation(spark):
    got = {r.conv_id: r for r in QUERIES["op11_chat_format"](spark, SF).collect()}
    text = "</s>[INST] ok [/INST]"
    assert got[-7].turns_sha256 == sha(f"user\n{text}\nassistant\n{text}\n")
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256, got[-7].formatted_chars) == (2, 21, sha(text), 3 + 13 + 4 + 2 * 24)


# Periodic runs


def plain_runs(w, least, repeats):
    found = []
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            run = w[i : j + q]
            if len(run) >= max(least, repeats * q) and not any(run[d:] == run[:-d] for d in range(1, q)):
                found.append((i, len(run), q))
            i = j + 1
    return sorted(found, key=lambda x: (x[0], x[2]))


def made_words(r):
    w = [b"%d" % r.randint(1, r.choice([1, 2, 3, 30])) for _ in range(r.randint(0, 130))]
    for _ in range(r.randint(0, 3) if w else 0):
        a, p, n = r.randrange(len(w)), r.randint(1, 15), r.randint(1, 80)
        for x in range(a + p, min(len(w), a + n)):
            w[x] = w[x - p]
    return w


def test_extensions_and_orders():
    r = random.Random(1)
    for _ in range(400):
        s = [int(x) for x in made_words(r)][:40]
        if not s:
            continue
        n, e = len(s), Extensions(np.array(s))
        pairs = [(a, b) for a in range(n + 1) for b in range(n + 1) if a != b]
        common = [next((k for k in range(n) if a + k >= n or b + k >= n or s[a + k] != s[b + k]), n) for a, b in pairs]
        assert e.common(*np.array(pairs).T).tolist() == common
        for sign in (1, -1):
            assert np.argsort(e.ranks(sign)).tolist() == sorted(range(n + 1), key=lambda a: [sign * x for x in s[a:]])


def test_runs_equal_brute_force():
    r = random.Random(2)
    for _ in range(700):
        w = made_words(r)
        for least, repeats in ((24, 3), (6, 2), (10, 4)):
            assert [tuple(x) for x in text_runs(w, least, repeats).tolist()] == plain_runs(w, least, repeats)
    with pytest.raises(ValueError):
        text_runs([], 24, 1)


def plain_digest(w):
    runs = plain_runs(w, 24, 3)
    best = max(runs, key=lambda x: (x[1] * 5040 * 5040 // x[2], -x[0], -x[2]), default=None)
    if best:
        best = min((x for x in runs if x[1] * best[2] == best[1] * x[2]), key=lambda x: (x[0], x[2]))
    dropped = {k for a, n, q in runs for k in range(a + q, a + n)}
    kept = b" ".join(x for k, x in enumerate(w) if k not in dropped).decode()
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def test_run_digests_equal_brute_force(spark):
    r = random.Random(9)
    texts = [b" ".join(made_words(r)).decode() for _ in range(150)]
    texts += ["", "  \x0b\t ", None, "a b " * 30 + "c d e " * 40 + "　x " * 24, "so " * 24, "so " * 23, "\x1cx " * 30]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "so " * 30, 1), (3, texts[3], 1)], "doc_id long, text string, runs int")
    got = [tuple(x) for x in run_digests(periodic_runs(docs)).collect()]
    assert {x[0]: x[1:] for x in got if x[0] is not None} == {i: plain_digest((t or "").encode().split()) for i, t in enumerate(texts)}
    assert len(got) == len(texts) + 2
    assert run_digests(periodic_runs(docs.where("doc_id > 9999"))).count() == 0


def test_long_text_of_one_period():
    words = [b"%d" % (i % 700) for i in range(60_000)]
    runs = text_runs([b"x", *words, b"y"])
    assert runs.tolist() == [[1, 60_000, 700]]
    assert kept_words([b"x", *words, b"y"], runs) == [b"x", *words[:700], b"y"]


def plain_planted(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_run_query_equals_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = {d: plain_digest(plain_planted(d, t)) for d, t in docs if len((t or "").split()) < 1500}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert {d: got[d] for d in want} == want and len(got) == len(docs)
    assert sum(x[0] > 0 for x in got.values()) > 5
    odd = spark.createDataFrame([(i, t) for i in range(40) for t in (None, "", " ", "one", "a b\x0bc")], "doc_id long, text string")
    assert sorted((r.doc_id, (r.text or "").split()) for r in with_planted_periods(odd).collect()) == sorted((r.doc_id, [x.decode() for x in plain_planted(*r)]) for r in odd.collect())


# Phrases


def plain_collocations(rows, least, longest, top, scale=1000):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            totals[lang] += len(w)
            for m in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in f.items() if b >= least):
                continue
            score, k = min((scale * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, totals[lang], -s))
    return sorted(out)


def made_rows():
    r = random.Random(11)
    vocabulary = ["The", "of", "sea", "ship", "old", "é", "\x1cx", "日本", "Man", "and\xa0the"]
    rows = []
    for i in range(160):
        words = [r.choice(vocabulary if r.random() < 0.7 else vocabulary[:3]) + r.choice(["", "", "", ".", "\n", "!", "\x0b"]) for _ in range(r.randint(0, 60))]
        rows.append((r.choice(["en", "en", "en", None, "und", "de"]), r.choice([" ", "\t", "  "]).join(words)))
    rows += [("en", "old man and the sea ship sails away now")] * 40 + [("en", None), ("fr", ""), ("fr", None), (None, "one two")]
    return rows


@pytest.mark.parametrize(("least", "longest", "small"), [(20, 5, False), (6, 4, True), (3, 2, False), (1, 5, True)])
def test_collocations_equal_brute_force(spark, monkeypatch, least, longest, small):
    rows = made_rows() if least > 1 else made_rows()[::9]
    if small:  # blocks, chunks, remembered words and bitmaps of small size, and crowded beginnings: the same result
        for name, value in (("BLOCK", 7), ("CHUNK", 40), ("REMEMBERED", 5), ("LEAST_BITS", 64), ("MOST_BITS", 64), ("PART", 50)):
            monkeypatch.setattr(phrases, name, value)
        monkeypatch.setattr(phrases.sorted_counts, "__defaults__", (3,))
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "lang string, text string, phrase string").repartition(3)
    got = sorted(tuple(x) for x in collocations(docs, least, longest, top=30).collect())
    assert got == plain_collocations(rows, least, longest, 30)
    assert collocations(docs.where("lang = 'none'"), least, longest).count() == 0


def test_quicksort_counts():
    r = random.Random(4)
    rows = np.array([[r.randint(1, 4) if k < r.randint(2, 5) else 0 for k in range(5)] for _ in range(500)], np.int32)
    rows = np.where(np.cumsum(rows == 0, 1) > 0, 0, rows)
    weights = np.array([r.randint(1, 5) for _ in rows], np.int64)
    want = Counter()
    for row, w in zip(rows.tolist(), weights.tolist(), strict=True):
        for d in range(1, 6):
            if 0 not in row[:d]:
                want[tuple(row[:d])] += w
    got = {tuple(rows[p, :d].tolist()): w for p, d, w in quicksort_counts(rows, weights, 20)}
    assert got == {k: v for k, v in want.items() if v >= 20}


def test_crowded_beginnings_go_deeper(spark):
    r = random.Random(6)
    given = Counter(("en", " ".join(["the", "sea", *(r.choice("abcd") for _ in range(r.randint(0, 3)))])) for _ in range(3000))
    given.update({("en", "a b"): 9, ("de", "the sea a"): 4, ("en", "a c d"): 50})
    lists = defaultdict(lambda: ([], []))
    for (lang, phrase), c in given.items():
        for part in (c // 2, c - c // 2):  # as from two tasks
            phrases_, counts = lists[lang, phrase.split()[0], part % 2]
            phrases_.append(phrase)
            counts.append(part)
    frame = spark.createDataFrame([(*k[:2], *v) for k, v in lists.items()], "lang string, lead string, phrases array<string>, counts array<long>")
    want = Counter()
    for (lang, phrase), c in given.items():
        w = phrase.split()
        for d in range(2, len(w) + 1):
            want[lang, " ".join(w[:d])] += c
    for group in (1, 2, 5, 30, 1000):
        rows = sorted_counts(frame, 8, 5, group).collect()
        assert {(x.lang, x.phrase): x.c for x in rows} == {k: v for k, v in want.items() if v >= 8}
        assert len({(x.lang, x.phrase) for x in rows}) == len(rows)
