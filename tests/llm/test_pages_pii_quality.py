"""Main text, personal data and quality rules against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from tests.conftest import SF
from tidegrid.llm.common import table
from tidegrid.llm.html_text import extract_pages, main_text
from tidegrid.llm.pii import BASE, counts_and_hashes, find_pii, find_spans, luhn, mask_pii
from tidegrid.llm.quality_rules import keep_good, measure, quality_rules

PARAGRAPH = "Some words of an article that are long enough to count as text, again and again."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<script>x</script><style>p{}</style>", ""),
        ("just words", "just words"),
        (f"<nav><a href=a>Home</a></nav><h1>Title</h1><p>{PARAGRAPH}<p>Short.</p><footer>&copy; me</footer>", f"Title\n\n{PARAGRAPH}\n\nShort."),
        (f"<article><p>{PARAGRAPH}</p><div class='ad banner'>Buy</div><p>End &amp; all</p></article><p>{PARAGRAPH}</p>", f"{PARAGRAPH}\n\nEnd & all"),
        (f"<div class=comments><p>{PARAGRAPH}</p></div><form><p>Name</p></form><div><p>{PARAGRAPH} <b>bold</b>\n text</div>", f"{PARAGRAPH} bold text"),
        (f"<ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>{PARAGRAPH}<br>next&nbsp;line</p>", f"{PARAGRAPH} next line"),
        (f"<p title='a>b'>{PARAGRAPH}</p><!-- <p>no</p> --><aside><p>side</p></aside>", PARAGRAPH),
        (f"<body><p>{PARAGRAPH}</p><div id=cookie-notice>We use cookies</div><p>Tail", f"{PARAGRAPH}\n\nTail"),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<h1>Title</h1>\n<div class=ad>\n <p>Buy</p>\n</div>\n<p>{PARAGRAPH}</p>", f"Title\n\n{PARAGRAPH}"),
        (f"<p>{PARAGRAPH}</p>\n<table>\n<tbody>\n<tr>\n<td>Cell</td>\n</tr>\n</tbody>\n</table>\n<p>Short end.</p>", f"{PARAGRAPH}\n\nCell\n\nShort end."),
        (f"<h1>Title</h1><div class=ad>Buy</div><div class=promo>Now</div><p>{PARAGRAPH}</p>", f"Title\n\n{PARAGRAPH}"),
        (f"<article>\n <h1>Title</h1>\n <div class=ad>\n  <p>Buy</p>\n </div>\n <aside>x</aside>\n <p>{PARAGRAPH}</p>\n</article>", f"Title\n\n{PARAGRAPH}"),
        ("<main><p>One.</p>\n<div class=ad>x</div>\n<div class=ad>y</div>\n<p>Two.</p></main>", "One.\n\nTwo."),
        (f"<article class='post social share'><p>{PARAGRAPH}</p></article>", PARAGRAPH),
        (f"<div class='page has-sidebar no-comments'><p>{PARAGRAPH}</p><div class='has-text sidebar'>side</div></div>", PARAGRAPH),
    ],
)
def test_article_lines_are_kept_whole(html, text):
    assert main_text(html) == text


def test_pages_match_their_articles(spark):
    import html as entities

    for r in extract_pages(table(spark, SF, "pages")).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.DOTALL)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?p>|</?h1>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_broken_markup_takes_linear_time():
    for page in ("<div>" * 30000, "<a " * 30000, "<p " * 30000 + '"' * 10001, "<" * 50000, "<!--" * 20000, "<p title='" * 20000):
        main_text(page)


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x", 2)], "page_id long, url string, html string, n_chars int")
    assert sorted((r.text, r.n_chars) for r in extract_pages(pages).collect()) == [("", 0), ("", 0), ("x", 1)]
    assert extract_pages(pages.where("page_id > 5")).count() == 0


def plain_spans(t: str):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    for alphabet in ("a@.b-1 ", "0123. 5-+()", "+1 23.4-@a", "4 -0."):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert [tuple(s[:3]) for s in find_spans(t) if s.kind in BASE] == plain_spans(t)


def test_further_kinds_need_checksum_or_context():
    kinds = lambda t: [s.kind for s in find_spans(t)]
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 now") == ["iban"]
    assert kinds("pay to GB83 WEST 1234 5698 7654 32 now") == []
    assert kinds("my phone is 555-123-4567") == ["phone_local"] and kinds("part 555-123-4567") == []
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("123-45-6789") == []
    assert kinds('token = "11acdfb36bb72224148e6160f674b4be45601bff"') == ["secret"]
    for t in ("1" * 100000, "a" * 100000, "1 " * 50000, "1." * 50000, "+1" * 50000, "a@" * 50000, "AB12" * 25000):
        find_spans(t)


def test_pii_rows(spark):
    docs = spark.createDataFrame([(1, "mail é a.b@c.de or 10.0.0.1", 26, "x"), (2, None, None, "x"), (2, "", 0, "x"), (None, "clean", 5, "x")], "doc_id long, text string, n_chars long, masked string")
    got = {(r.doc_id, r.spans, r.n_email, r.n_ip, r.base_sha256) for r in counts_and_hashes(find_pii(docs)).collect()}
    none, some = hashlib.sha256(b"").hexdigest(), "email:7:15,ip:19:27"
    assert got == {(1, some, 1, 1, hashlib.sha256(some.encode()).hexdigest()), (2, "", 0, 0, none), (None, "", 0, 0, none)}
    masked = {(r.doc_id, r.text, r.n_chars, r.masked) for r in mask_pii(docs).collect()}
    assert masked == {(1, "mail é <EMAIL> or <IP>", 22, "x"), (2, None, None, "x"), (2, "", 0, "x"), (None, "clean", 5, "x")}


def plain_measures(t: str, least: int):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)

    def inside(k):
        seen, hit = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)), set()
        for i in range(len(words) - k + 1):
            if seen[tuple(words[i : i + k])] > 1:
                hit |= set(range(i, i + k))
        return len(hit)

    longest = 0
    while any(n > 1 for n in Counter(tuple(words[i : i + longest + 1]) for i in range(len(words) - longest)).values()):
        longest += 1
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), inside(3), inside(least), longest]


def test_measures_equal_brute_force():
    r = random.Random(3)
    made = ["", "a", "a a a", "   \n\n"] + ["".join(r.choice(["a", "b", "c ", "\n", " ", "é ", "# ", "a b c\n"]) for _ in range(r.randint(0, 80))) for _ in range(200)]
    assert measure([t.encode() for t in made], 5).tolist() == [plain_measures(t, 5) for t in made]


def test_quality_rows(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, 1), (1, good, 1), (2, "short", 1), (3, None, 1), (None, "", 1), (4, "again and again " * 60, 1), (5, (good + "\n") * 2, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rules int")
    got = sorted((r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality_rules(docs).collect())
    assert got == [(0, 0, True, False), (1, 80, False, True), (1, 80, False, True), (2, 1, True, False), (3, 0, True, False), (4, 180, True, False), (5, 160, True, False)]
    assert [tuple(r) for r in keep_good(docs).collect()] == [(1, good, 1), (1, good, 1)]
    assert keep_good(docs.where("doc_id > 9")).count() == 0


def test_covered_share_decides_alone(spark):
    other, passage = [f"w{i}" for i in range(180)], [f"p{i}" for i in range(60)]
    text = " ".join([*passage, *other, *passage])
    docs = spark.createDataFrame([(1, text), (2, " ".join([*passage[:30], *other, *passage[:30]]))], "doc_id long, text string")
    got = sorted((r.doc_id, r.base_failed, r.longest_repeat, r.n_covered_words, r.kept) for r in quality_rules(docs).collect())
    assert got == [(1, False, 60, 120, False), (2, False, 30, 60, True)]
