"""Language identification and page extraction."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter
from math import log10

import pytest
from pyspark.sql import functions as F

from meterlens.llm import html_text, language
from meterlens.llm.html_text import main_text
from meterlens.llm.queries import languages, page_texts


def test_held_out_accuracy(spark, sf_dir):
    rows = languages(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    joined = rows.join(docs, "doc_id").collect()
    assert len(joined) == docs.count()
    held = [r for r in joined if r.held_out]
    assert 0.2 < len(held) / len(joined) < 0.5
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in joined)


@pytest.fixture(scope="module")
def model(spark):
    rows = [
        ("en", "the cat and the dog ate the bread"),
        ("de", "die katze und der hund fressen das brot"),
        ("fr", "le chat et le chien mangent du pain"),
        (None, "qqq"),
        ("en", None),
    ]
    return language.learn(spark.createDataFrame(rows * 3, "lang string, text string"))


def test_words_first_then_shorter_grams(model):
    assert model.languages == ["de", "en", "fr"]
    assert model.word_scores("the")[1] > model.word_scores("the")[0]
    assert "katzen" not in model.words and model.word_scores("katzen")[0] > language.UNSEEN
    longest = [g for g in language.grams("katzen", 4) if g in model.grams]
    means = [sum(x) / len(longest) for x in zip(*(model.grams[g] for g in longest), strict=True)]
    assert model.word_scores("katzen") == pytest.approx(means)
    assert model.word_scores("文") == [language.UNSEEN] * 3


def test_predictions(spark, model):
    texts = {
        1: "the dog", 2: "der hund", 3: "le chien", 4: None, 5: "", 6: "123 !!", 7: "文", 8: "hunde",
    }
    docs = spark.createDataFrame(
        [*texts.items(), (None, "the")], "doc_id long, text string"
    ).withColumn("lang", F.lit("never read"))
    got = language.with_language(docs, model).collect()
    found = {r.doc_id: r.predicted.lang for r in got}
    assert [found[k] for k in (1, 2, 3, 4, 5, 6, 8)] == ["en", "de", "fr", "und", "und", "und", "de"]
    assert found[7] == "de"  # all equally unlikely: the first by name
    assert language.with_language(docs.limit(0), model).count() == 0
    nothing = language.learn(docs.limit(0))
    assert {r.predicted.lang for r in language.with_language(docs, nothing).collect()} == {"und"}


@pytest.mark.parametrize("cells", [0, 40, 400_000])
def test_all_counts_of_all_languages_are_used(spark, monkeypatch, cells):
    """Against a plain loop, whatever is broadcast: more languages than 100, and a word that is
    rare in a large language but the commonest of a small one."""
    monkeypatch.setattr(language, "COMMON_CELLS", cells)
    rng = random.Random(3)
    letters = "abcdefghijklmnop"
    rows = [(f"l{n:03}", " ".join("".join(rng.choices(letters, k=4)) for _ in range(6))) for n in range(120)]
    rows += [("big", " ".join(f"w{''.join(rng.choices(letters, k=6))}" for _ in range(25_000)))]
    rows += [("big", "shared " * 3), ("small", "shared")]
    frame = spark.createDataFrame(rows, "lang string, text string")
    model = language.learn(frame)
    assert len(model.languages) == 122
    counts = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(text.split())
    assert len(model.words) == len(set().union(*counts.values()))
    assert model.word_scores("shared")[model.languages.index("big")] == pytest.approx(
        log10(3 / counts["big"].total()), abs=1e-8
    )
    texts = [text[:200] for _, text in rows] + ["shared", "abcd xyz", "shareds' unknown-ÄÖ qq", "ÄÖ", "a"]
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts]], "text string")
    got = {}
    for r in language.with_language(docs, model).collect():
        assert got.setdefault(r.text, r.predicted) == r.predicted
    for text in texts:
        sums = [sum(x) for x in zip(*map(model.word_scores, language.words_in(text)), strict=True)]
        best = max(sums)
        assert sums[model.languages.index(got[text].lang)] == pytest.approx(best, abs=1e-6)
        share = 1 / sum(10 ** (x - best) for x in sums)
        assert got[text].score == pytest.approx(share, rel=1e-4)


def test_top_entries(spark):
    rows = [("a", f"w{n:02}", 100 - n // 2) for n in range(40)] + [("b", "x", 1), ("b", "y", 1)]
    counts = spark.createDataFrame(rows, "lang string, entry string, n long")

    def top(most):
        return sorted((r.lang, r.entry) for r in language._top(counts, most, "lang").collect())

    assert top(1) == []  # two entries share each count
    assert top(5) == [("a", f"w{n:02}") for n in range(4)] + [("b", "x"), ("b", "y")]
    assert len(top(1000)) == len(rows)


def test_gram_column_equals_grams(spark):
    words = ["a", "ab", "katze", "é"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    for size in range(1, language.LONGEST_GRAM + 1):
        column = language._gram_column(F.col("w"), size)
        for r in rows.select("w", column.alias("g")).collect():
            assert [g.entry for g in r.g] == language.grams(r.w, size)


def page(rng):
    """A page with everything around the article, and the article's blocks."""
    def text(n):
        return " ".join(rng.choices(["alpha", "beta,", "gamma.", "delta", "epsilon;"], k=n)) + "."

    blocks = [text(rng.choice([1, 3, 40, 80])) for _ in range(rng.randint(3, 8))]
    blocks.append(text(90))
    body = "".join(rng.choice([f"<p>{b}</p>", f"<p>{b}", f"<p><b>{b}</b></p>"]) for b in blocks)
    tag = rng.choice(["article", "main", 'div class="story"'])
    around = [
        "<nav><ul>" + "<li><a href='/'>Link</a></li>" * 8 + "</ul></nav>",
        f'<div class="ad">{text(6)}</div>',
        f"<aside><p>{text(30)}</p></aside>",
        '<form><p>Sign up <input name="a"><button>Go</button></p></form>',
    ]
    rng.shuffle(around)
    html = (
        "<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style></head><body>"
        f"<header><h1>Site</h1></header>{around[0]}{around[1]}<script>var a = '</p>';</script>"
        f"<{tag}><h1>Headline here</h1>{body}</{tag.split()[0]}>{around[2]}{around[3]}"
        f'<div id="comments"><p>{text(50)}</p><p>{text(20)}</p></div>'
        f'<div class="cookie-notice">{text(9)}</div><footer>&copy; {text(5)}</footer></body></html>'
    )
    return html, "\n".join(["Headline here", *blocks])


def test_articles_without_what_surrounds_them():
    rng = random.Random(8)
    for _ in range(100):
        html, want = page(rng)
        assert main_text(html) == want


def test_article_with_one_long_part():
    lead, long = "Lead text, of some length. " * 12, "Body text, of more length. " * 30
    parts = f"<h1>Title</h1><div class=lead>{lead}</div><div class=body>{long}</div>"
    want = f"Title\n{lead.strip()}\n{long.strip()}"
    assert main_text(f"<body><article>{parts}</article></body>") == want
    assert main_text(f"<body><main><section>{parts}</section></main></body>") == want
    for tag in ("section", "blockquote", "pre", "ul><li", "table><tr><td", "section><section"):
        end = "".join(f"</{t}>" for t in reversed(tag.split("><")))
        for around in ("article", "div"):
            html = f"<{around}><h2>Title</h2><p>Short.</p><{tag}>{long}{end}<p>Last.</p></{around}>"
            assert main_text(f"<body>{html}</body>") == f"Title\nShort.\n{long.strip()}\nLast."


def test_classes_that_only_look_like_marks():
    parts = "<h1>Title</h1>" + "<p>Some text, of some length, in the article.</p>" * 9
    want = "\n".join(["Title", *["Some text, of some length, in the article."] * 9])
    for name in (
        "content has-sidebar", "no-sidebar", "overflow-hidden", "ad-free", "with-comments",
        "post-share-wide", "md:hidden", "widget", "social notice",
    ):
        html = f"<div class='{name}'>{parts}</div><div class='sidebar-left'><p>Aside, as such.</p></div>"
        assert main_text(f"<body>{html}</body>") == want, name
        html = f"<div class='{name}'><article>{parts}</article></div>"
        html += f"<div id='comments'>{'<article><p>A reply, to this.</p></article>' * 40}</div>"
        if name not in ("widget", "social notice"):
            assert main_text(f"<body>{html}</body>") == want, name
    for name in ("ad", "ad-slot", "site-nav", "sidebar", "cookie-notice big", "related_posts"):
        html = f"<div><h1>Title</h1><p>Text, here. <span class='{name}'>Not, this.</span> And here.</p>"
        html += f"<div class='{name}'><p>Not, this either.</p></div><p>Other text, at the end.</p></div>"
        assert main_text(html) == "Title\nText, here. And here.\nOther text, at the end.", name


def flat(*around, after=""):
    """A page without article, main, or other tags that tell its parts."""
    story = "".join(f"<p>Sentence {n}, of the story, is here. It goes on, for a while.</p>" for n in range(12))
    want = [f"Sentence {n}, of the story, is here. It goes on, for a while." for n in range(12)]
    html = f"<body>{''.join(around)}<h1>Headline</h1>{story}{after}</body>"
    return html, "\n".join(["Headline", *want])


def test_flat_pages():
    """What the tags don't tell, names, paths and links do."""
    links = "".join(f"<li><a href='/{n}'>Place {n}</a></li>" for n in range(9))
    before = [
        '<div id="header"><p>The Daily Site, since 1900.</p></div>',
        '<div class="masthead">The Daily Site</div>',
        '<div class="top-menu-bar"><a href="/">Home</a> <a href="/x">About, and more</a></div>',
        f"<ul>{links}</ul>",
        "<div class='x1'><p>Edition of today</p></div>",
        "<div><div>Weather</div><div>Sport</div></div>",
    ]
    owner = "Copyright 2024 The Daily Site, its owners, and all who write for it, in all lands. " * 3
    after = [
        f"<p>{owner}</p>",
        f"<div class='feedback'>{'<p>A reader writes, at some length, that it is so. Is it?</p>' * 6}</div>",
        f"<div class='x9'><ul>{links}</ul></div>",
        f"<table><tr><td>{links}</td></tr></table>",
    ]
    for part in before:
        html, want = flat(part)
        assert main_text(html) == want, part
    for part in after:
        html, want = flat(after=part)
        assert main_text(html) == want, part
    html, want = flat(*before, after="".join(after))
    assert main_text(html) == want


def test_names_inside_an_article():
    text = "<p>Some text, of some length, in the article. More of it.</p>" * 6
    want = ["Some text, of some length, in the article. More of it."] * 6
    for name in ("alert", "related-work", "social-history", "notice"):
        html = f"<body><article>{text}<div class='{name}'>Mind this, please.</div></article></body>"
        assert main_text(html) == "\n".join([*want, "Mind this, please."]), name
    for name in ("related_posts", "share", "social-links", "comments", "ad"):
        html = f"<body><article>{text}<div class='{name}'>Not this, please.</div></article></body>"
        assert main_text(html) == "\n".join(want), name


def test_thresholds_decide(monkeypatch):
    """With all paths, or the best one only, the flat page gives another text."""
    box = "<div class='x1'><p>Edition of today</p></div>"
    html, want = flat(box, after="<div class='y'><p>A last part, in a box of its own. It is as long as others.</p></div>")
    want += "\nA last part, in a box of its own. It is as long as others."
    assert main_text(html) == want
    monkeypatch.setattr(html_text, "SPREAD", 0.0)
    assert "Edition of today" in main_text(html)
    monkeypatch.setattr(html_text, "SPREAD", 1e9)
    assert "A last part" not in main_text(html)


def slow_content_paths(blocks):
    """Ratios by plain loops over pieces."""
    kinds = {}
    for b in blocks:
        kinds.setdefault(b.element.path, []).append(b)

    def ratio(b, measure):
        group = kinds[b.element.path]
        return sum(map(measure, group)) / len(group)

    def smooth(n, measure):
        total = weight = 0
        for k, other in enumerate(blocks):
            if abs(k - n) <= html_text.REACH:
                w = 2.718281828459045 ** (-((k - n) ** 2) / 2)
                total += w * ratio(other, measure)
                weight += w
        return total / weight

    def points(b):
        return sum(unicodedata.category(c)[0] == "P" for c in b.text)

    scores = {}
    for path, group in kinds.items():
        at = [n for n, b in enumerate(blocks) if b.element.path == path]
        fused = [smooth(n, lambda b: len(b.text)) * (1 + smooth(n, points)) for n in at]
        linked = sum(len(b.text) * b.linked for b in group) / sum(len(b.text) for b in group)
        scores[path] = sum(fused) / len(fused) * (1 - linked)
    every = [scores[b.element.path] for b in blocks]
    mean = sum(every) / len(every)
    spread = (sum((x - mean) ** 2 for x in every) / len(every)) ** 0.5
    least = min(html_text.SPREAD * spread, max(scores.values()))
    return {p for p, x in scores.items() if x >= least - 1e-9}


def test_content_paths_equal_plain_loops():
    rng = random.Random(21)
    for _ in range(40):
        blocks = html_text.blocks_of(page(rng)[0])
        assert html_text.content_paths(blocks) == slow_content_paths(blocks)


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    assert main_text("<nav>a</nav>") == ""
    assert main_text("just text &amp; more\n lines") == "just text & more lines"
    assert main_text("<p>a<br>b&nbsp;c &lt;d&gt;</p><p>e<b>f</b>g</p>") == "a b c <d>\nefg"
    assert main_text("<div><p>one<p>two<ul><li>x<li>y</ul></div") == "one\ntwo\nx\ny"
    assert main_text("<p>cut <b") == "cut"
    assert main_text('<p title="a > b">quoted</p><p title="open>next</p>') == "quoted\nnext"
    assert main_text("<p>a</p><script>if (a < b) {'<p>no</p>'}") == "a"
    assert main_text("<p>" + "long " * 20_000) == ("long " * 20_000).strip()


def test_page_query(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = page_texts(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == main_text(pages[r.page_id]) and r.n_chars == len(r.text)
        assert r.text and "<p>" not in r.text


def test_page_columns_stay(spark):
    pages = spark.createDataFrame(
        [(1, "<p>a", "x"), (1, "<p>a", "x"), (None, None, None)], "page_id long, html string, path string"
    )
    got = html_text.with_main_text(pages).collect()
    assert sorted((r.text, r.path or "") for r in got) == [("", ""), ("a", "x"), ("a", "x")]
    assert html_text.with_main_text(pages.limit(0)).count() == 0
