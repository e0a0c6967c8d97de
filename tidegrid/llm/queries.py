"""The registered queries of the numbered operators, with SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from tidegrid.llm.bpe_stream import digests, encode_decode
from tidegrid.llm.chat_format import conversation_digests, format_conversations, read_back
from tidegrid.llm.common import table
from tidegrid.llm.decontaminate import contamination
from tidegrid.llm.html_text import extract_pages
from tidegrid.llm.language_id import identify
from tidegrid.llm.lm_score import pseudo_likelihood
from tidegrid.llm.periodic_runs import periodic_runs, run_digests
from tidegrid.llm.phrases import collocations
from tidegrid.llm.pii import counts_and_hashes, find_pii
from tidegrid.llm.quality_rules import quality_rules
from tidegrid.llm.simhash import near_duplicates
from tidegrid.llm.suffix_dedup import digests as cut_digests
from tidegrid.llm.suffix_dedup import remove_repeats
from tidegrid.llm.token_count import token_counts

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS words
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows)),
hits AS (
    SELECT doc_id, i, p.n, item FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS words FROM places) p
    JOIN windows USING (n, words)
),
hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
_CONTROL = r"""<\\*/?s>|\[\\*/?(ROLE|INST|SYS)\]"""
_CHAT = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
    SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS shown,
        CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 4
            ELSE 17 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS marks,
        CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned
    FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    CAST(sum(length(learned)) AS BIGINT) AS loss_chars, sha256(string_agg(learned, '' ORDER BY turn)) AS loss_sha256,
    CAST(3 + sum(shown + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
_PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
    SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
    FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m)
),
f AS (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
cuts AS (
    SELECT lang, phrase, a, m, k, array_to_string(list_slice(p, 1, k), ' ') AS first, array_to_string(list_slice(p, k + 1, m), ' ') AS rest
    FROM (SELECT lang, phrase, a, m, string_split(phrase, ' ') AS p, unnest(range(1, m)) AS k FROM f WHERE m > 1)
),
scores AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.a AS l, y.a AS r, n.n,
        (1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN n ON n.lang = c.lang
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scores) WHERE o = 1),
kept AS (
    SELECT * FROM best b WHERE NOT EXISTS (
        SELECT 1 FROM f g WHERE g.lang = b.lang AND g.m > len(string_split(b.phrase, ' ')) AND g.a >= b.a
            AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')
    )
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""


@query()
def op1_token_counts(spark, sf):
    return token_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op6_bpe_round_trip(spark, sf):
    coded = encode_decode(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return digests(coded)


@query()
def op2_language_id(spark, sf):
    return identify(table(spark, sf, "documents"))


@query()
def op8_quality_rules(spark, sf):
    return quality_rules(table(spark, sf, "documents"))


@query()
def op7_pii(spark, sf):
    return counts_and_hashes(find_pii(table(spark, sf, "documents")))


@query(_DECONTAMINATION)
def op3_decontamination(spark, sf):
    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op4_html_text(spark, sf):
    return extract_pages(table(spark, sf, "pages"))


@query()
def op10_simhash_duplicates(spark, sf):
    return near_duplicates(table(spark, sf, "documents"))


@query()
def op5_suffix_dedup(spark, sf):
    return cut_digests(remove_repeats(table(spark, sf, "documents")))


@query()
def op9_lm_score(spark, sf):
    return pseudo_likelihood(table(spark, sf, "documents"))


@query(_CHAT)
def op11_chat_format(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    path = public_tokenizers.path("byte_bpe_50k.json")
    return conversation_digests(read_back(format_conversations(turns.union(more), path), path))


def with_planted_periods(docs):
    """``docs`` with the words from one place on replaced by a cycle of the first of them, in every tenth document by the checksum of its id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def cycled(words):  # a lambda's argument, so that the text is split once
        n = F.size(words)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (F.floor((n - a) / (3 + g % 8)) + 1).cast("int")
        rest = F.slice(words, a + 1, n - a)
        cycles = F.flatten(F.array_repeat(F.slice(rest, 1, p), (F.floor((n - a) / p) + 1).cast("int")))
        return F.array_join(F.concat(F.slice(words, 1, a), F.slice(cycles, 1, n - a)), " ")

    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    return docs.withColumn("text", F.when(h % 10 == 0, F.transform(F.array(words), cycled)[0]).otherwise(F.col("text")))


@query()
def op12_periodic_runs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return run_digests(periodic_runs(with_planted_periods(docs)))


@query(_PHRASES)
def op13_phrase_collocations(spark, sf):
    return collocations(table(spark, sf, "documents"))
