"""Language identification and language-model scores: held-out accuracy and behaviour at the edges."""

from __future__ import annotations

import numpy as np

from tests.conftest import SF
from tidegrid.llm.common import table
from tidegrid.llm.language_id import identify
from tidegrid.llm.lm_score import LanguageModel, Shape, Trainer, fit, pseudo_likelihood, word_buckets, word_classes


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    found = {r.doc_id: r for r in identify(docs).collect()}
    held = [(r.lang, found[r.doc_id].lang_pred) for r in docs.collect() if found[r.doc_id].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "123 !!", "de"), (5, "", None), (None, "the dog", None), (7, "the " * 600_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs).collect()}
    assert found[3] == found[4] == found[5] == ("und", 0.0)
    assert found[None][0] == "en" and found[7][0] == "en" and found[2][0] == "de"
    assert {r.lang_pred for r in identify(docs.where("lang IS NULL")).collect()} == {"und"}
    assert identify(docs.where("doc_id > 99")).count() == 0


def test_scores_beat_word_frequencies_and_notice_order(spark):
    docs = table(spark, SF, "documents")
    shape = Shape(buckets=512, size=8, classes=16)
    texts = [word_buckets(r.text.encode(), shape.buckets) for r in docs.select("text").collect()]
    counts = np.bincount(np.concatenate(texts), minlength=shape.buckets)
    classes, within = word_classes(counts, shape.classes)
    trainer = Trainer(shape, classes)
    for _ in range(3):
        trainer.learn(texts)
    model = LanguageModel(shape, trainer.flat, classes, within)
    words = np.concatenate(texts)
    share = (counts + 0.5) / (counts + 0.5).sum()
    shuffled = words.copy()
    np.random.default_rng(0).shuffle(shuffled)
    assert model.score(texts).sum() > np.log(share[words]).sum()
    assert model.score(texts).sum() > model.score([shuffled]).sum()


def test_probabilities_add_up(spark):
    docs = table(spark, SF, "documents")
    shape = Shape(buckets=64, size=4, classes=8)
    model = fit(docs, shape)
    around = np.array([3, 9, 0, 17, 40])
    total = 0.0
    for word in range(shape.buckets):
        each = around.copy()
        each[2] = word
        alone = model.score([each])[0]
        others = 0.0  # the scores of the other four places, with the same word in the middle
        left, right, weights, bias = shape.parts(model.flat)
        from tidegrid.llm.lm_score import class_scores, hidden, stream

        joined, at = stream([each], shape.buckets)
        s = class_scores(hidden(left, right, joined, at), weights, bias)
        for k in (0, 1, 3, 4):
            others += s[k, model.classes[each[k]]] + model.within[each[k]]
        total += np.exp(alone - others)
    assert abs(total - 1) < 1e-3


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 5), (2, None, 5), (None, "", 5)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.n_tokens, r.log_prob < 0, r.mean_log_prob is None) for r in pseudo_likelihood(docs).collect()))
    assert got == [(0, False, True), (0, False, True), (3, True, False), (3, True, False)]
    assert pseudo_likelihood(docs.where("doc_id > 9")).count() == 0
