"""Problem 1: signs of markup, the content region, and the structure that cleaning keeps."""

import random
import time

import pytest

from kiteloom.llm import markup
from kiteloom.llm.markup import best_stretch, clean_text, holds_markup

MARKED = [
    "<p>Hello</p>", "a<br>b", "&lt;p&gt;escaped&lt;/p&gt;", "text <!-- note --> more", "fish &amp; chips", "a&nbsp;b", "it&#8217;s", "## Heading\n\ntext", "some **bold** text", "a `code` b", "[link](https://x)",
    "![alt](img.png)", "~~gone~~ now", "* one\n* two", "1. one\n2. two", "> quoted", "| a | b |\n|---|---|\n| 1 | 2 |", "```\ncode\n```", "== Title ==\ntext", "'''bold''' and ''italic''", "see [[Page|this]] page",
    "fact<ref>note</ref> here", "\\section{One} text", "an \\emph{important} word", "the sum $a_{n} = 1$ holds", "\\[ L = \\lambda W \\]", "as shown~\\cite{x1}", "cut off in a <a href=\"https://x",
]
PROSE = [
    "We page someone only if a < b and b > 12.", "x -> y with ~40 rows", "from $19 to $1200 this week", "ticket #75 and the C# port", "R&D and Q&A teams [sic]", "Paths like ~/alert/_cache | remote", "3 * 6 * 2 units",
    "The type is List<int> here", "Map<String, Item> & more", "https://x.example/a_b/c~d?x=1&y=2", "C:\\new\\server\\out", "The string ${HOME} stays", "we write {{ user.name }} there", "#channel & room", "it was cut [...]", "", "   ",
    "snake_case_name and 5*x", "a 5'' screen", "- said the operator", "3. Oktober war der Tag", "the latency stays < 5 ms",
]


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(text):
    assert holds_markup(text)


@pytest.mark.parametrize("text", PROSE)
def test_signs_of_prose_are_no_markup(text):
    assert not holds_markup(text)
    assert clean_text(text) == (text, 0, 0.0)


def test_structure_is_kept():
    page = '<h2>Title</h2><p>Some <b>bold</b> &amp; <a href="/x">linked</a> words.</p><ul><li>one</li><li>two</li></ul><pre><code>x = 1 &lt; 2\ny</code></pre><table><tr><td>a</td><td>b</td></tr></table><p>$a_{1}$</p>'
    clean = clean_text(page)[0]
    for part in ("## Title", "Some bold & linked words.", "- one\n", "- two", "```\nx = 1 < 2\ny\n```", "| a | b |", "$a_{1}$"):
        assert part in clean
    assert "<" not in clean.replace("1 < 2", "")
    assert clean_text("== T ==\n* a\n* ''b''\n[[P|q]]")[0] == "## T\n\n- a\n- b\nq"
    assert clean_text("\\section{T}\n\\begin{itemize}\n\\item a\n\\end{itemize}\nan \\emph{x \\textbf{y}} \\(z^2\\)")[0] == "## T\n\n- a\n\nan x y \\(z^2\\)"
    assert clean_text("### T\n\n- a **b** [c](http://d) `e`")[0] == "### T\n\n- a b c `e`"
    assert clean_text("&lt;p&gt;a &amp;amp; b&lt;/p&gt;")[0] == "a & b"


def test_frame_is_left_out():
    page = '<div><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav><script>var x = 1;</script></div><p>' + "The content has many plain words here. " * 4 + '</p><div><footer><a href="/p">Privacy</a></footer></div>'
    clean = clean_text(page)[0]
    assert clean.startswith("The content") and "var x" not in clean and "Home" not in clean


def test_best_stretch_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        scores = [rng.uniform(-1, 1) for _ in range(rng.randint(0, 25))]
        want = max([0.0] + [sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)])
        got, begin, end = best_stretch(scores)
        assert abs(got - want) < 1e-9 and abs(sum(scores[begin:end]) - got) < 1e-9


def test_cleaning_what_is_clean_changes_nothing_more():
    for text in MARKED[:10]:
        once = clean_text(text)[0]
        assert not holds_markup(once) or once.startswith(("#", "-", "|", "`", ">", "1.")) or "`" in once


def test_messy_tables(spark):
    rows = [(1, "<p>a</p>", 1, "x"), (1, "<p>a</p>", 1, "x"), (2, None, 2, None), (3, "", 3, ""), (4, "plain", 4, "y"), (5, "<b>" + "long " * 200_000 + "</b>", 5, "z"), (None, "<i>k</i>", 6, "w")]
    df = spark.createDataFrame(rows, "item_id long, summary string, rec_id int, value string")
    got = markup.marked_values([("feed_items", df, "item_id", "summary")]).collect()
    assert sorted((r.rec_id is None, r.rec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 5), (True, 0)]
    clean = {r.rec_id: r.clean for r in markup.cleaned_values([("feed_items", df, "item_id", "summary")]).collect()}
    assert clean[1] == "a" and clean[5] == ("long " * 200_000).strip()
    assert markup.marked_values([("t", df.limit(0), "item_id", "summary")]).count() == 0


def test_the_jvm_filter_lets_all_markup_through(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(MARKED)], "item_id long, summary string")
    assert markup.marked_values([("t", df, "item_id", "summary")]).count() == len(MARKED)


def test_trigger_lets_all_markup_through_and_long_constructs_count(spark):
    long = "some words of a span " * 40 + "end"
    values = ["==Heading==", ">quote", "１. first\n２. second", f"$$x = {long}$$", f"`{long}`", f"``{long}``", f"*{long}*", f"_{long}_", f"**{long}**", f"__{long}__", f"~~{long}~~", f"\\[{long}\\]", f"\\({long}\\)", f"[[{long}]]", f"[{long}](https://x.example/a)"]
    prose = ["a = b", "It is 5 > 3 here.", "plain text"]
    df = spark.createDataFrame(list(enumerate(values + prose)), "seq long, body string")
    assert sorted(r.rec_id for r in markup.marked_values([("articles", df, "seq", "body")]).collect()) == list(range(len(values)))


def test_unclosed_marks_cost_linear_time():
    for mark in ("$$ a", "\\[ a", "\\( a", "`` a", "**a ", "__a ", "[[a", "[a", "{{a", "*a ", "~~a "):
        began = time.process_time()
        markup.markup_tokens(mark * 3000)
        assert time.process_time() - began < 5, mark


def test_the_scan_weighs_what_prose_may_hold():
    assert not holds_markup("- one thing we saw") and holds_markup("- one thing\n- another thing")
    assert not holds_markup("- one thing\n" + "plain words stand here " * 20 + "\n- far away")
    signs = "- one # ~ thing < 5 | $ & more\n- another"
    assert markup.evidence_score(markup.markup_tokens(signs), markup.evidence_weights()) < markup.evidence_score(markup.markup_tokens("- one thing here is more\n- another"), markup.evidence_weights())
    weights = markup.evidence_weights()
    assert weights["sign"] < 0 and weights["word"] < 0 and weights["bullet"] < weights["least"] < weights["strong"]


def words_of(text):
    return [w for w in text.replace("`", " ").replace("#", " ").split() if w not in "-*"]


def test_no_word_outside_the_frame_is_lost():
    for text in ["<p>…but they got <a href='/x'>the</a> fast page.</p>", "<p>It has a linter that <a href='/x'>clients expected.</a></p>\n<p>One more paragraph.</p>", "<p>Plain words.</p><p><a href='/q'>A last link</a></p>",
                 "<p><a href='/q'>A first link</a></p><p>Plain words.</p>", "<ul><li><a href='/1'>one</a></li><li><a href='/2'>two</a></li></ul>", "see [one](/a) and [two](/b)", "- [one](https://a)\n- [two](https://b)", "<a href='/1'>all of it</a>"]:
        plain = markup.re.sub(r"<[^<>]*>|\]\([^()]*\)|\[", " ", text)
        assert words_of(clean_text(text)[0]) == words_of(plain), text
    menu = "<ul>" + "".join(f"<li><a href='/{i}'>menu{i}</a></li>" for i in range(4)) + "</ul>"
    assert clean_text(menu + "<p>Plain words of the page.</p>" + menu)[0].strip(" -\n") == "Plain words of the page."
    rng = random.Random(4)
    for _ in range(100):
        (_, _), (content, _), (_, _) = page = markup.labelled_page(rng)
        if 'href="x' in content or 'href="https://x' in content:
            continue  # a tag that stays open takes what follows
        whole = clean_text("".join(t for t, _ in page))[0]
        assert set(clean_text("<p>" + content)[0].split()) - set(whole.split()) == set()


def test_notes_that_stay_open_cost_linear_time_and_no_text():
    assert clean_text("a <ref>note</ref> b <ref name='x'/> c <ref>open")[0] == "a b c open"
    for mark in ("<ref>a ", "&lt;a b ", "&lt;!-- a "):
        began = time.process_time()
        clean_text("''x'' " + mark * 4000)
        assert time.process_time() - began < 5, mark


def test_tokens_are_those_of_the_whole_alternation():
    whole = markup.re.compile("|".join(f"(?P<{n}>{shape})" for n, shape in markup.SHAPES.items()), markup._FLAGS)
    rng = random.Random(9)
    texts = [*MARKED, *PROSE, *("".join(t for t, _ in markup.labelled_page(rng)) for _ in range(80))]
    pieces = ["<p>", "</", "&lt;", "a", " ", "\n", "*", "**", "_", "`", "~~", "$", "\\[", "\\]", "[[", "]]", "[", "](", ")", "{{", "|", "}}", "=", "==", "'", "''", "!", "#", "- ", "1. ", "> ", "|-", "---", "&amp;", "\\emph{", "}"]
    texts += ["".join(rng.choice(pieces) for _ in range(30)) for _ in range(400)]
    for text in texts:
        want = [(markup.token_class(m.lastgroup, m[0]), m.start(), m.end()) for m in whole.finditer(text) if m.end() > m.start()]
        assert markup.markup_tokens(text) == want, text
