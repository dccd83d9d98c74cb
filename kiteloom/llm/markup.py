"""Problem 1: HTML, Markdown, wiki and LaTeX residue to clean text.

A value is cut into words and markup tokens. Token classes carry weights learned from labelled pages:
words score positive, tags negative. One linear scan finds the contiguous stretch of maximal score,
the content region; it is rendered to plain text that keeps headings, lists, code, tables and
formulas. A second scan of the same kind, over weights that tell markup from signs that belong to
prose, finds the stretch with the strongest evidence of markup and so decides whether a value holds any.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.plans.runtime import spread

# HTML elements by the part they play.
BLOCK = "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre blockquote table thead tbody tfoot tr td th caption br hr figure figcaption section article main details summary".split()
INLINE = "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr img".split()
FRAME = "html head body title meta link base script style noscript template div nav header footer aside form input button label select option textarea iframe svg path video audio source picture object embed center".split()
_TAGS = "|".join(sorted({*BLOCK, *INLINE, *FRAME}, key=len, reverse=True))
_DROPPED = {"script", "style", "noscript", "template", "head", "svg", "iframe", "nav", "form", "button"}
# LaTeX commands whose argument is text.
_TEXT_COMMANDS = "emph textbf textit texttt textsf textsc underline text mbox url footnote section subsection subsubsection paragraph chapter title caption".split()

_ATTR = r"(?:\s[^<>]*|/)?"
#: Token classes, tried in this order.
SHAPES = {
    "comment": r"<!--(?:.*?-->|.*$)",
    "ref": r"</?(?:ref|nowiki)\b[^<>]*>",
    "tag": rf"</?(?:{_TAGS}){_ATTR}>",
    "cut_tag": rf"</?(?:{_TAGS})(?:\s[^<>]*)?\Z|</?\Z|<!-?\Z",
    "escaped": rf"&(?:amp;)?lt;(?:/?(?:{_TAGS})(?:\s(?:(?!&(?:amp;)?[gl]t;).)*|/)?&(?:amp;)?gt;|!--(?:(?!--&|&(?:amp;)?lt;!--).)*--&(?:amp;)?gt;)",
    "escaped_cut": rf"&(?:amp;)?lt;/?(?:(?:{_TAGS})(?:\s(?:(?!&(?:amp;)?gt;).)*)?)?(?:&(?:g|gt)?)?\Z",
    "entity": r"&(?:amp;)?(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});",
    "fence": r"^[ ]{0,3}(?:```|~~~)[^\n`]*$",
    "math": r"\$\$(?:[^$]|\$(?!\$))+\$\$|\\\[.{1,400}?\\\]|\\\[(?:(?!\\\[).)+?\\\]|\\\(.{1,200}?\\\)|\\\((?:(?!\\\().)+?\\\)|(?<![\w\\$])\$(?=[^$\n]*[\\^_={}])(?=\S)[^$\n]+(?<=\S)\$(?!\w)",
    "environment": r"\\(?:begin|end)\{[a-zA-Z]+\*?\}(?:\[[^\]\n]*\])?",
    "item": r"\\item\b(?:\[[^\]\n]*\])?",
    "citation": r"~?\\(?:cite[tp]?|ref|eqref|label|pageref)\{[^{}\n]*\}",
    "href": r"\\href\{[^{}\n]*\}\{",
    "command": rf"\\(?:{'|'.join(_TEXT_COMMANDS)})\*?\{{",
    "other_command": r"\\(?:usepackage|documentclass|maketitle|tableofcontents|includegraphics|vspace|hspace|noindent|newpage|bigskip|medskip|smallskip)\b\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?",
    "wiki_heading": r"^={2,6}[ \t]*\S[^\n]*?={2,6}[ \t]*$",
    "wiki_table": r"^(?:\{\||\|\}|\|-)[^\n]*$",
    "wiki_file": r"\[\[(?:File|Image|Datei|Archivo|Category|Kategorie|Categoría|파일|분류):[^\[\]\n]*\]\]",
    "wiki_link": r"\[\[[^\[\]\n|]+(?:\|[^\[\]\n]*)?\]\]",
    "wiki_url": r"(?<!\])\[https?://[^\s\]]+[ ][^\]\n]+\]",
    "wiki_template": r"\{\{[^{}|\n]+\|[^{}\n]*\}\}",
    "wiki_quotes": r"'{5}|'''|(?<![\w'])''(?=[^\s'])|(?<=[^\s'\d])''(?![\w'])",
    "image": r"!\[[^\[\]\n]*\]\([^()\s]+(?:[ ]+\"[^\"\n]*\")?\)",
    "link": r"(?<![!\[])\[[^\[\]\n]+\]\((?:[^()\s]|\([^()\s]*\))+(?:[ ]+\"[^\"\n]*\")?\)|(?<=[\]\w])\]\(https?:[^\s)]*\Z|(?<![!\[\w])\[[^\[\]\n]+\]\([^()\s]*\Z|(?<![!\[\w])\[[^\[\]\n]+\]\[[\w-]+\]",
    "code": r"(?<![`\\])`(?!`)[^`\n]+`(?!`)|``[^\n]{1,300}?``(?!`)|``(?:(?!``)[^\n])+``(?!`)",
    "strike": r"~~(?=\S)[^~\n]+(?<=\S)~~",
    "strong": r"(?<![*\w\\])\*\*(?=[^\s*])(?:[^\n]{1,400}?|(?:(?!\*\*)[^\n])+)(?<=[^\s*])\*\*(?!\*)|(?<![\w_\\])__(?=[^\s_])(?:[^\n]{1,400}?|(?:(?!__)[^\n])+)(?<=[^\s_])__(?![\w_])",
    "emphasis": r"(?<![*\w\\])\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*(?![*\w])|(?<![\w_\\/])_(?=[^\s_])[^_\n]+(?<=[^\s_])_(?![\w_])",
    "heading": r"^[ ]{0,3}\#{1,6}[ \t]+(?=\S)",
    "bullet": r"^[ \t]{0,8}(?:[*+\-]|[*\#:;]{1,4})[ \t]+(?=\S)",
    "number": r"^[ \t]{0,8}\d{1,3}[.)][ \t]+(?=\S)",
    "quote": r"^[ ]{0,3}>[ ]?(?=\S)",
    "table_rule": r"^[ ]*\|?[ ]*:?-{3,}:?[ ]*(?:\|[ ]*:?-{3,}:?[ ]*)+\|?[ ]*$",
    "table_row": r"^[ ]*\|[^\n|]*\|(?:[^\n|]*\|)*[ ]*$",
    "rule": r"^[ ]{0,3}(?:-{3,}|\*{3,}|_{3,})[ ]*$",
    "sign": r"[<>]=?|[*~#|$\\_`]+|&(?=\W|\w+(?!\w*;))",
}
#: Shapes that stand at the start of a line, and the first signs of all others.
AT_LINE = {"fence", "wiki_heading", "wiki_table", "heading", "bullet", "number", "quote", "table_rule", "table_row", "rule"}
FIRST = {
    "comment": "<", "ref": "<", "tag": "<", "cut_tag": "<", "escaped": "&", "escaped_cut": "&", "entity": "&", "math": "$\\", "environment": "\\", "item": "\\", "citation": "~\\",
    "href": "\\", "command": "\\", "other_command": "\\", "wiki_file": "[", "wiki_link": "[", "wiki_url": "[", "wiki_template": "{", "wiki_quotes": "'", "image": "!", "link": "[]",
    "code": "`", "strike": "~", "strong": "*_", "emphasis": "*_", "sign": "<>*~#|$\\_`&",
}
_FLAGS = re.MULTILINE | re.DOTALL | re.IGNORECASE
_CANDIDATE = re.compile(r"^|[<>&$\\~\[\]{'!`*_#|]", re.MULTILINE)


def _token_patterns(line: bool) -> dict[str, re.Pattern]:
    """By first sign (or '' for any other), the shapes that may start there, in order."""
    signs = sorted({c for chars in FIRST.values() for c in chars})
    return {
        c: re.compile("|".join(f"(?P<{n}>{shape})" for n, shape in SHAPES.items() if (line and n in AT_LINE) or c in FIRST.get(n, " ")) or r"(?!)", _FLAGS)
        for c in signs
    } | {"": re.compile("|".join(f"(?P<{n}>{SHAPES[n]})" for n in SHAPES if line and n in AT_LINE) or r"(?!)", _FLAGS)}


_INLINE_TOKENS, _LINE_TOKENS = _token_patterns(False), _token_patterns(True)


#: Cheap superset of all markup, for the JVM: a value without any of these holds none.
TRIGGER = r"[<&$`\\\[{|]|\*\*|~~|__|''|(?m)^[ \t]*(?:[*+#:;>=-]+|\p{Nd}{1,3}[.)])[ \t]|^[ ]{0,3}>|^={2,6}[^\n]*={2,6}[ \t]*$|(?<![\w*])\*[^\s*]|(?<![\w_])_[^\s_]|^[ \t]*[-*_]{3,}[ \t]*$"


#: What has been worked out once; plain dictionaries travel to the executors with the functions.
_ENTITIES: dict[str, bool] = {}
_WEIGHTS: dict[str, dict[str, float]] = {}


def _is_entity(name: str) -> bool:
    if name not in _ENTITIES:
        _ENTITIES[name] = html.unescape(f"&{name};") != f"&{name};"
    return _ENTITIES[name]


def token_class(kind: str, text: str) -> str:
    """Class of a token; references that are none count as signs."""
    if kind == "entity" and text[1] != "#" and not _is_entity(text[1:-1]):
        return "sign"
    if kind == "cut_tag" and text in ("<", "</"):
        return "sign"
    return kind


def markup_tokens(text: str) -> list[tuple[str, int, int]]:
    """(class, start, end) of the markup tokens and signs of a text.

    Shapes are tried only at the starts of lines and at the signs that they begin with.
    """
    out, at, end = [], 0, len(text)
    while at < end:
        found = _CANDIDATE.search(text, at)
        if found is None:
            break
        at = found.start()
        if at >= end:
            break
        patterns = _LINE_TOKENS if at == 0 or text[at - 1] == "\n" else _INLINE_TOKENS
        match = patterns.get(text[at], patterns[""]).match(text, at)
        if match is None or match.end() == at:
            at += 1
            continue
        out.append((token_class(match.lastgroup, match[0]), at, match.end()))
        at = match.end()
    return out


def best_stretch(scores: list[float]) -> tuple[float, int, int]:
    """Score, start and end of the contiguous stretch of maximal sum; (0, 0, 0) where nothing is positive."""
    best, begin, end = 0.0, 0, 0
    running, since = 0.0, 0
    for i, score in enumerate(scores):
        if running <= 0:
            running, since = 0.0, i
        running += score
        if running > best:
            best, begin, end = running, since, i + 1
    return best, begin, end


# ---------------------------------------------------------------- labelled pages and weights

_SENTENCES = [
    "The team moved the queue to another host and read the logs again.", "We kept the index small because each lookup costs time.",
    "Nach zwei Tagen war der Dienst wieder schnell genug für alle.", "El equipo cambió la parte antigua del servicio en otoño.",
    "다음 달에는 오래된 저장소 하나를 더 정리했습니다.", "Most readers never saw the change, but they noticed the speed.",
]
# Prose in which signs belong to the text.
_PROSE_SIGNS = [
    "We page someone only if a < b and b > 12.", "Results hold for x -> y with ~40 rows.", "The bill went from $19 to $1200 this week.",
    "See ticket #9 and the C# port of it.", "R&D and Q&A teams share it [sic].", "Paths like ~/alert/_cache stay local | remote.",
    "It costs 3 * 6 * 2 units per mirror.", "The type is List<int> in the registry.", "Use Map<String, Item> & keep C:\\temp\\new for now.",
    "Look at https://example.org/a_b/c~d?x=1&y=2 for more.", "The value is <= 5 or >= 9 in AT&T's case.", "Version 2 > version 1, snake_case_name and 5*x.",
]
# Lines that prose opens like a list or parts by a rule.
_PROSE_LINES = ["- said the operator, and left.", "3. Oktober war der Tag der Umstellung.", "* Prices may change.", "---", "1. The first point stands alone here."]
# One example of each way to write markup; {s} is a sentence, {w} a short part of one.
_FORMS = [
    "<p>{s}</p>", "<p><b>{w}</b> {s}</p>", "<h2>{w}</h2><p>{s}</p>", "<ul><li>{s}</li><li>{s}</li></ul>", "<pre><code>{s}</code></pre>", "<blockquote>{s}</blockquote>",
    "<table><tr><td>{s}</td><td>{s}</td></tr></table>", '<p>{s} <a href="/x">{w}</a> {s}</p>', '{s} <img src="/x.png" alt="{w}"/> {s}', "{s}<!-- {w} -->", "{s} &amp; {w}&nbsp;{w} &#8217;",
    "&lt;p&gt;{s}&lt;/p&gt;", '{s} &lt;a href="x', '{s} <a href="https://x', "## {w}\n\n{s} **{w}**", "* {s}\n* {s}", "1. {s}\n2. {s}", "> {s}", "{s} `{w}` {s}", "```\n{s}\n```", "~~{w}~~ {s}", "*{w}* {s} _{w}_",
    "{s} [{w}](https://x.example/a) {s}", "![{w}](https://x.example/a.png)", "| {w} | {w} |\n|---|---|\n| {w} | {w} |", "== {w} ==\n{s}", "'''{w}''' {s} ''{w}''", "{s} [[{w}|{w}]] {s}", "[[File:x.png|{w}]] {s}",
    "{s} [https://x.example {w}] {s}", "{s}<ref>{w}</ref>", "{{|\n| {w} || {w} |\n|-\n|}}", "{{{{note|{w}}}}} {s}", "\\section{{{w}}} {s}", "{s} \\emph{{{w}}} {s}", "{s} \\cite{{x1}} {s}", "\\href{{x}}{{{w}}} {s}",
    "\\begin{{itemize}}\n\\item {s}\n\\end{{itemize}}", "{s} $a_{{n}} = 1$ {s}", "\\[ L = \\lambda W \\] {s}", "\\usepackage{{x}} \\maketitle {s}", "{s}\n\n---\n\n{s}",
]
_LINKS = ["Home", "About", "Blog", "Log in", "Next", "Previous", "Archive", "Privacy", "Share"]


def labelled_page(rng: random.Random) -> list[tuple[str, str]]:
    """Stretches of a made page: (text, 'content' | 'frame')."""
    links = "".join(f'<li><a href="/{w.lower()}">{w}</a></li>' for w in rng.sample(_LINKS, 4))
    content = []
    for _ in range(rng.randint(3, 8)):
        s = rng.choice(_SENTENCES)
        content.append(rng.choice(_FORMS).format(s=s, w=s[:12].strip()))
    return [
        (f'<div class="top"><nav><ul>{links}</ul></nav><script>var a=1;</script></div><div>', "frame"),
        ("\n".join(content), "content"),
        (f'</div><div class="end"><footer><a href="/p">{rng.choice(_LINKS)}</a> <a href="/q">{rng.choice(_LINKS)}</a></footer></div>', "frame"),
    ]


#: Characters of a gap that count as one word in the evidence, so that distant signs do not add up.
GAP_CHARS = 6
#: What a value's evidence must have beyond any labelled prose.
MARGIN = 0.5
#: Blocks of nothing but links that make a menu where they stand in a row.
MENU_BLOCKS = 3
_MENU_FRAME = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "svg", "iframe", "button"}


def evidence_score(tokens: list[tuple[str, int, int]], weights: dict[str, float]) -> float:
    """Score of the stretch of tokens with the strongest evidence of markup; words between them score negative."""
    best = running = 0.0
    gap, at = weights["word"] / GAP_CHARS, 0
    for kind, start, end in tokens:
        running = max(running + gap * (start - at), 0.0) + weights[kind]
        best = max(best, running)
        at = end
    return best


def evidence_weights(seed: int = 13, values: int = 1500) -> dict[str, float]:
    """Log odds of each token class in pages with markup against prose; 'word' is the cost of a word, 'least' the score that counts.

    `least` lies MARGIN above the best stretch of any prose labelled here.
    """
    if "evidence" in _WEIGHTS:
        return _WEIGHTS["evidence"]
    rng, marked, prose, held = random.Random(seed), Counter(), Counter(), []
    for i in range(values):
        marked.update({kind for text, _ in labelled_page(rng) for kind, _, _ in markup_tokens(text)})
        text = rng.choice(_PROSE_SIGNS) + " " + rng.choice(_SENTENCES)
        if i % 40 == 0:
            text = rng.choice([rng.choice(_PROSE_LINES) + "\n" + text, text + "\n" + rng.choice(_PROSE_LINES)])
        held.append(markup_tokens(text))
        prose.update({kind for kind, _, _ in held[-1]})
    weights = {n: math.log((marked[n] + 1) / values) - math.log((prose[n] + 0.2) / values) for n in SHAPES}
    weights["sign"] = min(max(weights["sign"], -1.0), -0.1)  # one sign alone undoes no list
    weights["word"] = -0.1
    weights["least"] = max(evidence_score(tokens, weights) for tokens in held) + MARGIN
    _WEIGHTS["evidence"] = weights
    return weights


def region_class(kind: str, piece: str) -> str:
    """Class by which the region scan scores a token."""
    if kind in ("tag", "escaped", "cut_tag", "escaped_cut"):
        name, _ = _tag_name(piece)
        return "a" if name == "a" else "frame" if name in FRAME else "inline" if name in INLINE else "block"
    return "structure"


def region_elements(text: str, tokens: list[tuple[str, int, int]]) -> list[list]:
    """[class, words, start, end] of the markup tokens and of the stretches of words between them.

    Words are 'word', or 'frameword' inside an element of the frame and in menus: MENU_BLOCKS or more blocks in
    a row that hold links only. Links among other words are words.
    """
    out: list[list] = []
    at, in_link, depth = 0, False, Counter()
    block: list[int] = []  # the stretches of words in the current block
    linked, plain = 0, 0
    blocks: list[tuple[list[int], bool]] = []

    def close() -> None:
        nonlocal block, linked, plain
        if block:
            blocks.append((block, linked > 0 and plain == 0))
        block, linked, plain = [], 0, 0

    def words(upto: int) -> None:
        nonlocal linked, plain
        n = len(text[at:upto].split())
        if n:
            block.append(len(out))
            linked, plain = linked + n * in_link, plain + n * (not in_link)
            out.append(["frameword" if sum(depth.values()) else "word", n, at, upto])

    for kind, start, end in tokens:
        if kind == "sign":
            continue
        words(start)
        piece = text[start:end]
        cls = region_class(kind, piece)
        if cls == "a":
            in_link = not _tag_name(piece)[1]
        elif cls in ("block", "frame"):
            close()
            name, closing = _tag_name(piece)
            if name in _MENU_FRAME and kind in ("tag", "escaped"):
                depth[name] = max(0, depth[name] + (-1 if closing else 1))
        out.append([cls, 0, start, end])
        at = end
    words(len(text))
    close()
    first = 0
    for i in range(len(blocks) + 1):
        if i == len(blocks) or not blocks[i][1]:
            if i - first >= MENU_BLOCKS:
                for k in (k for own, _ in blocks[first:i] for k in own):
                    out[k][0] = "frameword"
            first = i + 1
    return out


def region_weights(seed: int = 11, pages: int = 400) -> dict[str, float]:
    """Log odds of each region class in the content against the frame of labelled pages; words score positive, tags negative."""
    if "region" in _WEIGHTS:
        return _WEIGHTS["region"]
    rng, inside, outside = random.Random(seed), Counter(), Counter()
    for _ in range(pages):
        parts = labelled_page(rng)
        text = "".join(t for t, _ in parts)
        first, last = len(parts[0][0]), len(parts[0][0]) + len(parts[1][0])
        for cls, n, start, end in region_elements(text, markup_tokens(text)):
            (inside if first <= start and end <= last else outside)[cls] += n or 1
    names = {"word", "frameword", "a", "frame", "inline", "block", "structure"}
    total_in, total_out = sum(inside.values()) + len(names), sum(outside.values()) + len(names)
    odds = {n: math.log((inside[n] + 1) / total_in) - math.log((outside[n] + 1) / total_out) for n in names}
    for name in names:
        odds[name] = max(odds[name], 0.5) if name == "word" else min(odds[name], -0.05)
    _WEIGHTS["region"] = odds
    return odds


def content_region(text: str, tokens: list[tuple[str, int, int]]) -> tuple[int, int]:
    """Start and end of the content: the stretch of maximal score, and what lies between it and words further out.

    So only frame is cut off: words outside frame elements and menus are never lost. A text without any such word
    is kept whole.
    """
    weights = region_weights()
    elements = region_elements(text, tokens)
    _, begin, end = best_stretch([weights[cls] * max(n, 1) for cls, n, _, _ in elements])
    own = [i for i, e in enumerate(elements) if e[0] == "word"]
    if end == 0 or not own:
        return 0, len(text)
    begin, end = min(begin, own[0]), max(end, own[-1] + 1)
    # structure that borders the region belongs to it
    while begin > 0 and elements[begin - 1][0] in ("block", "inline", "structure", "a"):
        begin -= 1
    while end < len(elements) and elements[end][0] in ("block", "inline", "structure", "a"):
        end += 1
    return elements[begin][2], elements[end - 1][3]


# ---------------------------------------------------------------- rendering

def _tag_name(piece: str) -> tuple[str, bool]:
    bare = html.unescape(html.unescape(piece)) if piece.startswith("&") else piece
    m = re.match(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)", bare)
    return (m[2].lower(), bool(m[1])) if m else ("", False)


def _render(text: str, tokens: list[tuple[str, int, int]], depth: int = 0) -> str:
    out: list[str] = []
    at, skip, pre, braces = 0, None, False, 0
    lists: list[list] = []
    noted: dict[int, int] = {}  # notes: where each begins and ends
    opened = None
    for kind, start, end in tokens:
        if kind == "ref" and text[start + 1: start + 4].lower() == "ref" and text[end - 2] != "/":
            opened = start if opened is None else opened
        elif kind == "ref" and opened is not None and text[start: start + 5].lower() == "</ref":
            noted[opened], opened = end, None

    def raw(upto: int) -> None:
        nonlocal braces
        piece = text[at:upto]
        if skip is None and piece:
            while braces and "}" in piece:
                piece = piece.replace("}", "", 1)
                braces -= 1
            out.append(piece)

    def inner(piece: str) -> str:
        return _render(piece, [t for t in markup_tokens(piece) if t[0] != "sign"], depth + 1) if depth < 4 else piece

    def line() -> None:
        if out and not "".join(out[-1:]).endswith("\n"):
            out.append("\n")

    for kind, start, end in tokens:
        if start < at:
            continue
        raw(start)
        piece, at = text[start:end], end
        if kind in ("tag", "cut_tag", "escaped", "escaped_cut"):
            name, closing = _tag_name(piece)
            if skip is not None:
                if closing and name == skip:
                    skip = None
                continue
            if name in _DROPPED and not closing and kind in ("tag", "escaped"):
                skip = name
            elif re.fullmatch(r"h[1-6]", name):
                out.append("\n\n" if closing else "\n\n" + "#" * int(name[1]) + " ")
            elif name in ("ul", "ol"):
                lists.pop() if closing and lists else None if closing else lists.append([name, 0])
                line()
            elif name == "li":
                if not closing:
                    line()
                    if lists and lists[-1][0] == "ol":
                        lists[-1][1] += 1
                        out.append(f"{lists[-1][1]}. ")
                    else:
                        out.append("- ")
            elif name == "pre":
                pre = not closing
                out.append("\n```\n")
            elif name in ("code", "kbd", "samp", "tt") and not pre:
                out.append("`")
            elif name == "blockquote":
                out.append("\n\n" if closing else "\n\n> ")
            elif name in ("td", "th"):
                out.append(" | " if closing else "")
            elif name == "tr":
                line()
                out.append("" if closing else "| ")
            elif name == "img":
                alt = re.search(r"alt\s*=\s*[\"']([^\"']*)", html.unescape(piece))
                out.append(alt[1] if alt else "")
            elif name == "br":
                out.append("\n")
            elif name in BLOCK or name == "div":
                out.append("\n\n")
        elif skip is not None:
            continue
        elif kind == "ref":
            if start in noted:
                at = noted[start]
        elif kind in ("comment", "citation", "other_command", "wiki_file", "rule", "wiki_template"):
            pass
        elif kind == "entity":
            out.append(html.unescape(html.unescape(piece)).replace("\xa0", " "))
        elif kind in ("math", "fence", "table_row"):
            out.append(piece)
        elif kind == "table_rule":
            out.append(piece)
        elif kind == "environment":
            if re.search(r"verbatim|lstlisting|minted", piece):
                out.append("\n```\n")
            elif re.search(r"equation|align|math", piece):
                out.append("$$")
            else:
                line()
        elif kind == "item":
            line()
            out.append("-")
        elif kind in ("command", "href"):
            level = piece.count("sub") + 2 if "section" in piece or "chapter" in piece else 0
            close, opened = at, 1
            while close < len(text) and opened:
                opened += {"{": 1, "}": -1}.get(text[close], 0)
                close += 1
            body = inner(text[at: close - 1 if not opened else close])
            out.append(f"\n\n{'#' * level} {body}\n\n" if level else f"`{body}`" if "texttt" in piece else body)
            at = close
        elif kind == "wiki_heading":
            level = len(piece) - len(piece.lstrip("="))
            out.append(f"\n\n{'#' * level} {inner(piece.strip().strip('=').strip())}\n\n")
        elif kind == "wiki_table":
            line()
        elif kind == "wiki_link":
            out.append(inner(piece[2:-2].split("|")[-1]))
        elif kind == "wiki_url":
            out.append(inner(piece[1:-1].split(" ", 1)[1]))
        elif kind == "wiki_quotes":
            pass
        elif kind in ("link", "image"):
            out.append(inner(piece.lstrip("![").split("](")[0].split("][")[0].strip("[]")))
        elif kind == "code":
            out.append("`" + piece.strip("`").strip() + "`")
        elif kind in ("strike", "strong"):
            out.append(inner(piece[2:-2]))
        elif kind == "emphasis":
            out.append(inner(piece[1:-1]))
        elif kind == "heading":
            out.append(piece.strip() + " ")
        elif kind == "bullet":
            mark = piece.strip()
            out.append("1. " if set(mark) == {"#"} else "- " if mark in ("*", "+", "-") else piece)
        elif kind in ("number", "quote"):
            out.append(piece)
    raw(len(text))
    return "".join(out)


def _tidy(text: str) -> str:
    lines = [re.sub(r"[ \t\r\f\v]+", " ", line).strip() for line in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def analysed(text: str) -> tuple[list[tuple[str, int, int]], float]:
    """(tokens, evidence of markup) of a value; the evidence is 0 where the best stretch does not exceed what prose reaches."""
    weights = evidence_weights()
    tokens = markup_tokens(text)
    score = evidence_score(tokens, weights)
    return tokens, score if score >= weights["least"] else 0.0


def clean_text(text: str) -> tuple[str, int, float]:
    """(plain text of the content region, markup tokens, evidence of markup) of a value."""
    tokens, evidence = analysed(text)
    if not evidence:
        return text, 0, 0.0
    low, high = content_region(text, tokens)
    marks = [t for t in tokens if t[0] != "sign"]
    inside = [(k, s - low, e - low) for k, s, e in marks if s >= low and e <= high]
    return _tidy(_render(text[low:high], inside)), len(marks), evidence


def clean_batch(text: pd.Series) -> pd.DataFrame:
    rows = [clean_text(t) if t is not None else (None, None, None) for t in text]
    return pd.DataFrame(rows, columns=["clean", "n_markup", "evidence"])


def holds_markup(text: str) -> bool:
    return analysed(text)[1] > 0


def evidence_batch(text: pd.Series) -> pd.Series:
    return pd.Series([t is not None and holds_markup(t) for t in text], dtype="bool")


CLEANED = "struct<clean:string,n_markup:int,evidence:double>"


def cleaned_values(parts: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tab, rec_id, field, clean, n_markup) of every value that holds markup.

    Values without any sign that could be markup never leave the JVM. Null and empty values give no row,
    repeated rows repeated results; a value of nothing but markup gets an empty text.
    """
    result = None
    region_weights(), evidence_weights()  # fitted on the driver, once
    run = F.pandas_udf(clean_batch, CLEANED)
    for tab, df, key, column in parts:
        slim = df.select(F.col(key).cast("long").alias("rec_id"), F.col(column).alias("value")).filter(F.col("value").rlike(TRIGGER))
        rows = spread(slim).withColumn("c", run("value")).filter(F.col("c.evidence") > 0).select(
            F.lit(tab).alias("tab"), "rec_id", F.lit(column).alias("field"), F.col("c.clean").alias("clean"), F.col("c.n_markup").alias("n_markup")
        )
        result = rows if result is None else result.unionByName(rows)
    return result


def marked_values(parts: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tab, rec_id, field) of the values of `cleaned_values`, without rendering them."""
    result = None
    evidence_weights()  # fitted on the driver, once
    run = F.pandas_udf(evidence_batch, "boolean")
    for tab, df, key, column in parts:
        slim = df.select(F.col(key).cast("long").alias("rec_id"), F.col(column).alias("value")).filter(F.col("value").rlike(TRIGGER))
        rows = spread(slim).filter(run("value")).select(F.lit(tab).alias("tab"), "rec_id", F.lit(column).alias("field"))
        result = rows if result is None else result.unionByName(rows)
    return result
