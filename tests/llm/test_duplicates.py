"""Decontamination, suffix deduplication, SimHash and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

import corpus_pipeline
from tests.conftest import SF
from tidegrid.llm import decontaminate, suffix_dedup
from tidegrid.llm.common import table
from tidegrid.llm.components import components
from tidegrid.llm.decontaminate import contamination, drop_contaminated, find_contamination
from tidegrid.llm.pii import find_spans, mask
from tidegrid.llm.queries import ORACLES, QUERIES
from tidegrid.llm.quality_rules import quality_rules
from tidegrid.llm.simhash import find_links, keep_one, near_duplicates, plan_search
from tidegrid.llm.suffix_sort import sort_strings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain_hits(docs, items):
    windows: dict[tuple, set] = {}
    for item, t in items:
        w = WORD.findall(small(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if item is None else str(item))
    out = []
    for doc, t in docs:
        w, hit, found = WORD.findall(small(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_of_the_given_tables(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = sorted((tuple(r) for r in contamination(docs, items).collect()), key=str)
    want = plain_hits([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and any(r[-1] for r in want)


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_contamination_of_odd_rows(spark, block):
    items = [(1, "the"), (2, "of and"), (None, "a b c"), (4, "!!"), (5, None), (6, "the of " * 12), (6, "the of " * 12)]
    docs = [(1, "The of and a B c"), (2, None), (3, ""), (4, "the of the " * 7), (5, "a b"), (5, "a b"), (None, "x a b c")]
    left = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, found string")
    right = spark.createDataFrame(items, "item_id long, text string")
    frame, name = find_contamination(left, right, block_bytes=block)
    got = sorted(((r.doc_id, r[name].n_words, r[name].n_hit, len(r[name]["items"])) for r in frame.collect()), key=str)
    assert got == [r[:4] for r in plain_hits(docs, items)]
    assert {r.doc_id for r in drop_contaminated(left, right).collect()} == {r[0] for r in plain_hits(docs, items) if not r[-1]}
    assert contamination(left.where("doc_id > 9"), right).count() == 0
    assert contamination(left, right.where("item_id > 9")).where("contaminated").count() == 0


def test_long_items_are_cut_without_losing_windows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[k : k + 10])) for k in range(51)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    assert contamination(docs, items).where("n_hit = 10").count() == 51


def plain_cut(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(c for c, x in zip(b, gone, strict=True) if not x)
        out[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), kept)
    return out


def made_documents():
    r = random.Random(1)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(6)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(30, 120))) for _ in range(12)]
    docs = []
    for i in range(120):
        kind = r.random()
        if kind < 0.2:
            t = r.choice(["a", "ab"]) * r.randint(0, 300)
        else:
            t = " ".join(r.choice([*passages, " ".join(r.choice(words) for _ in range(5))]) for _ in range(r.randint(1, 6)))
            if kind < 0.6:
                p = r.randrange(len(t))
                t = t[:p] + "X" + t[p + 1 :]
        docs.append((i, t))
    return [*docs, (500, None), (501, ""), (502, "é" * 120), (503, "x" * 99), (504, "x" * 100)]


@pytest.mark.parametrize(("group", "piece"), [(20_000, 4 << 20), (3, 300)])
def test_repeats_equal_brute_force(spark, monkeypatch, group, piece):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", piece)
    docs = made_documents()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert got == plain_cut(docs)


def test_repeats_of_odd_rows(spark):
    long = "0123456789" * 9 + "the end of it"
    rows = [(1, long, 0), (1, long, 0), (2, long, 0), (None, "z" + long, 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(0, 0), (1, 103), (1, 103), (2, 103), (3, 0)]  # the null id comes first, so its copy stays
    assert suffix_dedup.remove_repeats(docs.where("doc_id > 9")).count() == 0


def test_sorting_by_hashes():
    r = random.Random(1)
    for _ in range(20):
        parts = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 150))]
        group = np.sort(np.array([r.randint(0, 3) for _ in parts]))
        size = np.array([len(p) for p in parts])
        order, common = sort_strings(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size, group)
        keys = [(group[i], parts[i]) for i in order]
        assert keys == sorted(keys)
        for k in range(1, len(order)):
            a, b = keys[k - 1], keys[k]
            n = next((i for i, (x, y) in enumerate(zip(a[1], b[1], strict=False)) if x != y), min(len(a[1]), len(b[1])))
            assert common[k] == (n if a[0] == b[0] else -1)


def test_sorting_empty_strings():
    none = np.zeros(3, np.int64)
    order, common = sort_strings(np.zeros(0, np.uint8), none, none, np.array([1, 1, 2]))
    assert order.tolist() == [0, 1, 2] and common.tolist() == [-1, 0, -1]


def plain_print(t: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", small(t))
    if not w:
        return 0
    hashes = [xxhash.xxh64(" ".join(w[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    prints, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4) + i + 1:
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_near_duplicates_of_the_given_table(spark):
    docs = table(spark, SF, "documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [plain_print(t) for _, t in rows]
    want = {d: (f"{p:016x}", rows[c][0]) for (d, _), p, c in zip(rows, prints, plain_components(prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("cut", [None, [(0, 21, 1), (21, 42, 1), (42, 64, 0)], [(0, 32, 2), (32, 64, 1)]])
def test_links_of_dense_groups(spark, cut):
    r = random.Random(2)
    prints = {r.getrandbits(64) for _ in range(600)}
    for centre in [r.getrandbits(64), r.getrandbits(64), 0]:
        for _ in range(600):
            x = centre
            for _ in range(r.randint(0, 9)):
                x ^= 1 << r.randrange(64)
            prints.add(x)
    prints = sorted(prints)
    want = plain_components(prints)
    signed = np.array(prints, np.uint64).view(np.int64)
    frame = spark.createDataFrame(pd.DataFrame({"fp": signed}))
    plan = cut and [(list(range(a, b)), t) for a, b, t in cut]
    root = {r.u: r.v for r in components(find_links(frame, 4, plan)).collect()}
    mine = [root.get(x, x) for x in signed.tolist()]
    assert len(set(mine)) == len(set(want)) == len(set(zip(mine, want, strict=True)))


def test_plans_cover_every_pair():
    r = np.random.default_rng(0)
    both = np.full((64, 64), 0.25) + np.eye(64) * 0.25
    for n in (10, 10**5, 10**7, 10**10):
        plan = plan_search(n, both * n, 4)
        bits = [b for group, _ in plan for b in group]
        assert len(set(bits)) == len(bits) and sum(t + 1 for _, t in plan) == 5
        for _ in range(50):
            flipped = set(r.choice(64, 4, replace=False).tolist())
            assert any(len(flipped & set(group)) <= t for group, t in plan)


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(3, text, 1), (3, text, 1), (7, text, 1), (5, None, 1), (4, "", 1), (None, "lone words here", 1), (None, text, 1), (9, "two words", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(3, 3), (3, 3), (7, 3), (5, 4), (4, 4), (None, None), (None, 3), (9, 9)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in keep_one(docs).collect()), key=str)
    assert kept == sorted([(3, text), (4, ""), (None, "lone words here"), (9, "two words")], key=str)
    assert near_duplicates(docs.where("doc_id > 99")).count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1002), (1002, 1001), (5000, 5000)]
    got = {r.u: r.v for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000, 1002: 1000}


def test_pipeline_equals_brute_force(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    keep = {r.doc_id for r in quality_rules(docs).collect() if r.kept}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in keep)
    first = plain_components([plain_print(t) for _, t in rows])
    rows = [r for i, r in enumerate(rows) if first[i] == i]
    clean = {r[0] for r in plain_hits(rows, [(r.item_id, r.text) for r in items.collect()]) if not r[-1]}
    masked = {d: mask(t, find_spans(t)) for d, t in rows if d in clean}
    from tidegrid.llm.bpe_stream import Encoder

    encoder = Encoder(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: encoder.encode(t).tolist() for d, t in masked.items()}
    assert 0 < len(got) < docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_stages_take_odd_tables(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, found string, masked int"
    odd = spark.createDataFrame([(None, None, None, None, None, None, None), (1, "", "en", None, 0, "x", 1), (1, "a b", None, "s", 3, None, 2)], kind)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SF).collect()
        stage(spark, odd.where("doc_id > 5"), SF).collect()


def test_every_operator_is_registered():
    assert sorted({int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES}) == [*range(1, 14)]
    assert set(ORACLES) <= set(QUERIES)
