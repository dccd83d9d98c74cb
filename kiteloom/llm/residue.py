"""Problem 7: template residue, filler and error-page text in place of content.

Character n-gram models of filler, notices and natural prose give each n-gram of a text a log likelihood
ratio. Windows of positive mean ratio localise residue; a text of which such windows cover most is residue as
a whole. Placeholders left where a value belonged are localised by windows of the same kind: one model is
fitted on prose in which words were replaced by placeholders, the other on what stands around brackets and
the like in natural prose, which holds texts that write about placeholders too. All texts of the columns are read
for the models: their n-grams are counted in the executors.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.batches import SUMMANDS, slices, summands, summed
from kiteloom.plans.runtime import spread

#: Characters of an n-gram, of a window, and bins of the hashed n-grams.
N, WINDOW, BINS = 5, 24, 1 << 18
#: Share of the letters that residue windows must cover.
COVERAGE = 0.55
#: Mean log ratio from which a window is residue.
RATIO = 0.4
#: Texts that natural prose with signs of placeholders weighs at most, beside the made examples, however many are read.
WEIGHT = 4000

# Words of the customary filler text.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute "
    "irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident "
    "sunt culpa qui officia deserunt mollit anim id est laborum nibh viverra mauris pulvinar ornare lectus tellus massa augue "
    "porta sapien vitae felis nunc erat vestibulum curabitur pellentesque"
).split()

# Stand-in texts that editors ship with templates, in the four languages.
FILLERS = [
    "Your description goes here.", "Your text goes here.", "Add a short intro for readers here", "Click to edit this block",
    "Sample text. Replace before publishing.", "TODO: write an excerpt", "TODO: add summary", "tk tk tk", "TBD", "[Insert summary here]",
    "Insert text here.", "Lorem ipsum dolor sit amet.", "This is a placeholder text.", "Type your content here.", "Placeholder text",
    "Hier steht Ihr Text.", "Beschreibung hier einfügen", "Hier Text einfügen", "Mustertext. Vor der Veröffentlichung ersetzen.",
    "Blindtext, bitte ersetzen.", "Escriba aquí su texto.", "Texto de ejemplo. Sustituir antes de publicar.", "Añada aquí una descripción",
    "여기에 본문을 입력하세요.", "설명을 입력해 주세요", "내용 준비 중입니다. 예시 문구입니다.", "내용을 입력하세요", "요약을 여기에 작성하세요.",
]

# Notices of errors, blocks, sign-ins and scripts, in the four languages; # is a number, @ a code.
NOTICES = [
    "404 Not Found", "# Not Found. The page you requested does not exist.", "Page not found. The address does not exist any more.",
    "403 Forbidden. Access denied. Reference @", "403 Forbidden. Request blocked. Reference @", "403 Forbidden. You have no permission. Reference @",
    "# Internal Server Error", "500 Internal Server Error\nupstream @", "502 Bad Gateway\nedge @", "503 Service Unavailable\nedge @",
    "504 Gateway Timeout\nupstream @", "# Service Unavailable\nnode @", "# Gateway Timeout", "# Bad Gateway nginx", "429 Too Many Requests",
    "Too many requests. Try again in # seconds.", "Something went wrong. Reload the page or come back later.",
    "Application error: a client-side exception has occurred (@).", "Your session has expired. Code @", "Your session has expired. Sign in again.",
    "Sign in to continue reading. This content is for members.", "Subscribe to continue reading.",
    "Please enable JavaScript to view this page.", "You need to enable JavaScript to view this page.", "You need to enable scripts to view this page.",
    "You need to enable JavaScript to run this app.", "JavaScript is required to view this content.", "Please turn on scripts in your browser.",
    "Please enable cookies to continue.", "Checking your browser... Ray @", "Checking your browser before accessing. Ray @",
    "Verifying that you are human... Ray @", "Verifying that you are human… Ray @", "One moment before you continue. Ray @", "One moment… Ray @",
    "Just a moment... Ray ID: @", "Access denied. Error code @", "The site is down for maintenance. Please come back later.",
    "Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.", "Seite nicht gefunden. Die Adresse existiert nicht mehr.", "Zugriff verweigert (@).",
    "Wartungsarbeiten. Bitte versuchen Sie es später erneut.", "Ihre Sitzung ist abgelaufen.", "Ein Fehler ist aufgetreten. Bitte laden Sie die Seite neu.",
    "Active JavaScript para ver esta página.", "Página no encontrada.", "Página no encontrada. La dirección ya no existe.", "Acceso denegado. Referencia @",
    "Servicio en mantenimiento. Inténtelo más tarde.", "Su sesión ha caducado.", "Se ha producido un error. Vuelva a cargar la página.",
    "이 페이지를 보려면 자바스크립트를 켜 주세요.", "브라우저에서 스크립트 실행을 허용해야 합니다.", "페이지를 찾을 수 없습니다. 주소를 다시 확인해 주세요.",
    "접근이 거부되었습니다. 오류 코드 @", "서비스 점검 중입니다. 잠시 후 다시 시도해 주세요.", "세션이 만료되었습니다. 다시 로그인해 주세요.",
    "오류가 발생했습니다. 페이지를 새로 고쳐 주세요.",
]
# Parts of notices that the page is missing.
MISSING = (
    ["404 ", "404 - ", "Error 404 ", "Error 404: "],
    ["Nothing here.", "Not Found.", "Page not found."],
    ["The page you asked for", "The page at this address", "The page you requested"],
    ["was moved.", "does not exist.", "could not be found.", "is no longer available."],
)
# Navigation that stands over such notices.
NAVIGATION = ["Home | Blog | About", "Menu\nSearch", "Skip to content", "Home\nBlog\nContact", ""]

# Words that name template fields.
FIELD_WORDS = (
    "title author name first last user full date time reading summary excerpt description category product site page post tag tags url link "
    "slug email company city content body text intro subtitle headline image insert year month day price count id here block"
).split()
# How templates mark their fields; {f} is the field.
FIELD_FORMS = ["{{{{ {f} }}}}", "{{{{{f}}}}}", "{{{{{{{f}}}}}}}", "${{{f}}}", "#{{{f}}}", "@{{{f}}}", "@@{f}@@", "%%{f}%%", "%({f})s", "{{% block {f} %}}", "{{% {f} %}}", "<%= {f} %>", "[{f}]", "{{{f}}}", "__{f}__", "<<{f}>>"]
# Lines that templates open with; {p} and {q} are fields.
FIELD_LINES = ["{p}", "{p} | {q}", "{p} - {q}", "Hello {p}, this is what {q} wrote.", "Hi {p},", "By {p} on {q}.", "Written by {p}.", "Read {p} in {q} minutes.", "{p} min read", "The {p} again", "{q}: {p}", "for {p} now", "Welcome, {p}!", "von {p} am {q}", "por {p} el {q}", "{p} 님의 {q}"]
# Sentences about placeholders and other rightly written brackets; {p} is a placeholder.
MENTIONS = [
    "The string {p} is expanded by the shell.", "In the template we write {p} where the value should be.", "The variable {p} gets replaced.", "The placeholder {p} is escaped here.", "The macro called {p} is substituted.",
    "The syntax {p} is like any other expression.", "Use the literal {p} as it stands.", "Die Zeichenkette {p} wird ersetzt.", "In der Vorlage schreiben wir {p}, wo der Wert stehen soll.", "La cadena {p} se sustituye.",
    "En la plantilla escribimos {p} donde va el valor.", "문자열 {p} 은 치환됩니다.", "템플릿에 {p} 라고 씁니다.", "They share it [sic].", "It was cut [...]", "see [title](https://x.example)", "a list of [[Home|title]] pages",
    "\\emph{{title}} and \\frac{{a}}{{b}} in $a_{{n}}$", "the call {{ return cache; }} ends", "we add {{b + c}} to it", "100 % of %s", "def __init__(self):", "x << 2 and y >> 1", "a[0] = b[i]", "\\begin{{itemize}} \\item x \\end{{itemize}}",
    "as shown~\\cite{{x1}} in [1]", "{{{{note|text}}}}", "[link][1]", "if a < b and b > c", "- [ ] open task", "- [x] done", "`{{}}` and `[]`", "{{\"a\": 1}}", "user@@host", "50%% more",
]
# Markup whose signs are no placeholder's; {w} and {v} are words.
BRACKETED = [
    "[[{w}]]", "[[{w}|{v}]]", "[{w}](https://x.example/{v})", "[{w}](/{v}/{w})", "![{w}](https://x.example/{v}.png)", "__{w}__", "__{w} {v}__", "__{w}__.", "__{w}__,", "\\emph{{{w}}}", "\\textbf{{{w}}}", "\\texttt{{{w}}}", "\\section{{{w} {v}}}",
    "\\subsection*{{{w} {v}}}", "\\paragraph{{{w} {v}}}", "\\begin{{itemize}} \\item {w} {v} \\end{{itemize}}", "\\cite{{{w}1}}", "\\href{{https://x.example}}{{{w}}}", "$a_{{n}} = {w}$", "$$\\sum_{{i=1}}^{{n}} x_{{i}}$$", "{{{{{w}|{v}}}}}",
    "{{| class=x |- | {w} || {v} |}}", "[https://x.example/{w} {v}]", "[{w}][1]", "[1]", "[...]", "[…]", "[[file:{w}.png|{v}]]", "`{{{w}}}`", "<!-- {w} -->",
]
#: Signs that open a placeholder: no text without one of them is read for placeholders.
OPENING = re.compile(r"[{\[]+|@@|%[%(]|<[%<]|__")
#: Characters before and after such a sign that its window takes in, lengths of n-grams, and mean log ratio of a placeholder.
BEFORE, AFTER, GRAMS, FIELD_RATIO = 10, 16, (3, 5), 0.1
#: Made examples of templates.
TEMPLATES = 6000


def ngram_bins(texts: list[str], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the n-gram at every character of the texts (each followed by N newlines), and the texts' starts."""
    tail = "\n" * N
    joined = tail.join(texts) + tail + tail
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h = np.zeros(len(points) - N, dtype=np.uint32)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ points[k: len(points) - N + k]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
    lengths = np.fromiter((len(t) + N for t in texts), dtype=np.int64, count=len(texts))
    return (h >> np.uint32(14)).astype(np.int64), np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def simplified(text: str) -> str:
    """Lower case, tags gone, digits and codes as one sign, blanks as one."""
    text = re.sub(r"<[^<>]{0,300}>", " ", text) if "<" in text else text
    text = re.sub(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+", "0", text.lower())
    return re.sub(r"\s+", " ", text).strip()


def residue_examples(seed: int = 7) -> tuple[list[str], list[str]]:
    """Labelled filler and notices, made from the fixed texts."""
    rng = random.Random(seed)
    filler = [simplified(t) for t in FILLERS for _ in range(25)]
    for _ in range(1500):
        words = [rng.choice(LOREM) for _ in range(rng.randint(8, 30))]
        if rng.random() < 0.4:
            words[:2] = ["lorem", "ipsum"]
        filler.append(" ".join(words) + ".")
    notices = []
    missing = [f"{a}{b} {c} {d}" for a in MISSING[0] for b in MISSING[1] for c in MISSING[2] for d in MISSING[3]]
    for text in NOTICES + rng.sample(missing, 40):
        for nav in NAVIGATION:
            made = text.replace("#", str(rng.randint(1, 500))).replace("@", f"{rng.getrandbits(32):08x}")
            notices.append(simplified(nav + "\n" + made))
    return filler, notices


def gram_counts(texts: list[str]) -> np.ndarray:
    """How often the texts hold each bin; what follows a text's end counts as newlines, so the counts of parts add up."""
    if not texts:
        return np.zeros(BINS)
    bins, starts = ngram_bins(texts)
    ends = np.append(starts[1:], len(bins))
    within = np.ones(len(bins), dtype=bool)
    within[(ends[:, None] - np.arange(1, N + 1)).ravel()] = False
    counts = np.bincount(bins[within], minlength=BINS).astype(np.float64)
    counts[bins[-1]] += N * len(texts)  # the last n-gram holds newlines only
    return counts


def _frequencies(counts: np.ndarray) -> np.ndarray:
    return counts / max(counts.sum(), 1)


class ResidueModel:
    """Log ratios of the n-gram bins, for filler and for notices, against prose."""

    def __init__(self, ratios: np.ndarray):
        self.ratios = ratios

    @classmethod
    def of_counts(cls, natural: np.ndarray) -> ResidueModel:
        """From the `gram_counts` of natural prose."""
        floor = 2e-6  # an n-gram that none of the models knows says nothing
        base = _frequencies(natural) + floor
        ratios = np.stack([np.log((_frequencies(gram_counts(made)) + floor) / base) for made in residue_examples()])
        return cls(np.clip(ratios, -4, 4).astype(np.float32))

    @classmethod
    def fit(cls, prose: list[str]) -> ResidueModel:
        natural = [simplified(t) for t in prose]
        return cls.of_counts(gram_counts(cls.of_counts(gram_counts(natural)).prose(natural)))

    def prose(self, texts: list[str]) -> list[str]:
        """The (simplified) texts that are no residue: a table holds some itself, so the model is fitted again without."""
        return [t for t, c in zip(texts, self.coverage(texts)) if c < COVERAGE]

    def coverage(self, texts: list[str]) -> np.ndarray:
        """Share of each (simplified) text that lies in windows of residue."""
        if not texts:
            return np.zeros(0)
        bins, starts = ngram_bins(texts)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        covered = np.zeros(len(bins), dtype=bool)
        # the n-grams that cross a text's end count nothing; sums run over the n-grams inside a window
        inside = np.zeros(len(bins) + 1, dtype=np.int64)
        grams = np.maximum(lengths - N + 1, 0)
        np.add.at(inside, starts, 1)
        np.add.at(inside, starts + grams, -1)
        inside = np.cumsum(inside[:-1]) > 0
        width = WINDOW - N + 1
        counts = np.concatenate(([0], np.cumsum(inside)))
        at = np.arange(len(bins))
        low, high = np.maximum(at - width // 2, 0), np.minimum(at + width // 2 + 1, len(bins))
        known = counts[high] - counts[low]
        for ratios in self.ratios:
            sums = np.concatenate(([0.0], np.cumsum(np.where(inside, ratios[bins], 0.0), dtype=np.float64)))
            covered |= (sums[high] - sums[low]) > RATIO * np.maximum(known, 1)
        total = np.concatenate(([0], np.cumsum(covered & inside)))
        return (total[starts + grams] - total[starts]) / np.maximum(grams, 1)


# ---------------------------------------------------------------- placeholders

def untagged(text: str) -> str:
    return re.sub(r"</?[a-zA-Z!][^<>%]*>", " ", text) if "<" in text else text


def field_text(text: str) -> str:
    """Lower case with a sign before words in capitals, tags gone, digits as one sign, blanks as one; what marks a field is kept."""
    text = untagged(text)
    text = re.sub(r"(?<![A-Za-z_])(_*)([A-Z]{2}[A-Z_]*)", r"\1^\2", text)
    return re.sub(r"\s+", " ", re.sub(r"\d+", "0", text.lower())).strip()


def _field(rng: random.Random) -> str:
    words = rng.sample(FIELD_WORDS, rng.choice([1, 1, 2, 2, 3]))
    form, name = rng.choice(FIELD_FORMS), rng.choice(["_", "_", ".", " ", "-"]).join(words)
    return form.format(f=name.upper() if form.startswith("__") or rng.random() < 0.3 else name)


def template_examples(prose: list[str], seed: int = 11) -> list[str]:
    """Labelled templates: lines of fields, and stretches of prose with fields in place of words."""
    rng, out = random.Random(seed), []
    stretches = [w for w in (t.split(" ") for t in prose) if len(w) >= 4] or [s.split(" ") for s in FILLERS if s.count(" ") >= 3]
    for i in range(TEMPLATES):
        if i % 3:
            words = rng.choice(stretches)
            at = rng.randrange(len(words))
            out.append(" ".join([*words[max(0, at - 5): at], _field(rng), *words[at + 1: at + 6]]))
        else:
            line = rng.choice(FIELD_LINES).format(p=_field(rng), q=_field(rng))
            out.append(line + " " + " ".join(rng.choice(stretches)[:6]) if rng.random() < 0.5 else line)
    return [field_text(t) for t in out]


def template_lines(seed: int = 11) -> list[str]:
    """The templates among TEMPLATES examples that are lines of fields only."""
    rng = random.Random(seed)
    return [field_text(rng.choice(FIELD_LINES).format(p=_field(rng), q=_field(rng))) for _ in range(TEMPLATES // 6)]


def mention_examples(prose: list[str], seed: int = 12) -> list[str]:
    """Labelled prose about placeholders, and stretches of prose with markup in place of words."""
    rng = random.Random(seed)
    out = [m.format(p=_field(rng)) for m in MENTIONS for _ in range(TEMPLATES // 20 if "{p}" in m else 40)]
    stretches = [w for w in (t.split(" ") for t in prose) if len(w) >= 4]
    for _ in range(TEMPLATES if stretches else 0):
        words = rng.choice(stretches)
        at = rng.randrange(len(words))
        form = rng.choice(BRACKETED).format(w=words[at].strip("[]{}()"), v=rng.choice(words).strip("[]{}()"))
        out.append(" ".join([*words[max(0, at - 5): at], form, *words[at + 1: at + 6]]))
    return [field_text(t) for t in out]


def _around_openings(texts: list[str], starts: np.ndarray, size: int) -> np.ndarray:
    """Which characters of the joined texts lie in the window of a sign that may open a placeholder."""
    edge = np.zeros(size + 1, dtype=np.int64)
    for start, text in zip(starts, texts):
        for m in OPENING.finditer(text):
            edge[max(start, start + m.start() - BEFORE)] += 1
            edge[min(start + len(text), start + m.end() + AFTER)] -= 1
    return np.cumsum(edge[:-1]) > 0


def field_counts(texts: list[str]) -> np.ndarray:
    """How often the windows of opening signs hold each bin, by the lengths of GRAMS."""
    counts = np.zeros((len(GRAMS), BINS))
    for k, n in enumerate(GRAMS if texts else ()):
        bins, starts = ngram_bins(texts, n)
        counts[k] = np.bincount(bins[_around_openings(texts, starts, len(bins))], minlength=BINS)
    return counts


class FieldModel:
    """Log ratios of n-gram bins around opening signs: templates against prose."""

    def __init__(self, ratios: np.ndarray):
        self.ratios = ratios

    @classmethod
    def of_counts(cls, templates: np.ndarray, mentions: np.ndarray) -> FieldModel:
        """From the `field_counts` of templates and of prose."""
        shares = [own / own.sum(axis=1, keepdims=True) + 2e-5 for own in (templates, mentions)]
        return cls(np.clip(np.log(shares[0] / shares[1]), -3, 3).astype(np.float32))

    @classmethod
    def fit(cls, prose: list[str]) -> FieldModel:
        natural = [field_text(t) for t in prose]
        plain = [t for t in natural if not OPENING.search(t)]
        marked = [t for t in natural if OPENING.search(t)]
        return cls.refined(field_counts(template_examples(plain)), field_counts(mention_examples(plain)), lambda model: field_counts(model.prose(marked)))

    @classmethod
    def refined(cls, templates: np.ndarray, mentions: np.ndarray, kept: Callable[[FieldModel], np.ndarray]) -> FieldModel:
        """Fitted on made texts, then with what is no template of the tables, which hold templates themselves; `kept` counts it."""
        model = cls.of_counts(templates, mentions)
        for _ in range(2):
            model = cls.of_counts(templates, mentions + kept(model))
        return model

    def prose(self, texts: list[str]) -> list[str]:
        return [t for t, k in zip(texts, self.placeholders(texts)) if not k]

    def placeholders(self, texts: list[str]) -> np.ndarray:
        """Placeholders left in each text (as of `field_text`): opening signs whose window is likelier in a template, side by side ones once."""
        found = np.zeros(len(texts), dtype=np.int64)
        own = [i for i, t in enumerate(texts) if OPENING.search(t)]
        if not own:
            return found
        some = [texts[i] for i in own]
        bins, starts = ngram_bins(some)
        score = np.zeros(len(bins))
        for table, n in zip(self.ratios, GRAMS):
            score += table[bins if n == N else ngram_bins(some, n)[0]]
        sums = np.concatenate(([0.0], np.cumsum(score)))
        for i, start, text in zip(own, starts, some):
            last = -1
            for m in OPENING.finditer(text):
                low, high = max(0, m.start() - BEFORE), min(len(text), m.end() + AFTER)
                if (sums[start + high] - sums[start + low]) > FIELD_RATIO * (high - low):
                    found[i] += m.start() > last
                    last = high
        return found


def residue_batch(ratios: np.ndarray, field_ratios: np.ndarray):
    model, fields = ResidueModel(ratios), FieldModel(field_ratios)

    def run(text: pd.Series) -> pd.DataFrame:
        values = [t or "" for t in text]
        plain = [simplified(t) for t in values]
        covered = np.concatenate([np.zeros(0), *(model.coverage(plain[part]) for part in slices(plain))])
        marked = [field_text(t) if OPENING.search(t) else "" for t in values]
        holds = np.concatenate([np.zeros(0, np.int64), *(fields.placeholders(marked[part]) for part in slices(marked))])
        return pd.DataFrame({"coverage": covered, "n_placeholders": holds})

    return run


RESIDUE = "struct<coverage:double,n_placeholders:int>"


def made_from(text: str, repeats: int) -> tuple[list[str], list[str]]:
    """(templates, markup) made from one text without tags, of the kinds of `template_examples` and `mention_examples`."""
    words, rng = text.split(), random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    templates, markup = [], []
    for _ in range(repeats if len(words) >= 4 else 0):
        at = rng.randrange(len(words))
        before, after = words[max(0, at - 5): at], words[at + 1: at + 6]
        if rng.random() < 0.8:
            templates.append(" ".join([*before, _field(rng), *after]))
        else:
            templates.append(rng.choice(FIELD_LINES).format(p=_field(rng), q=_field(rng)) + " " + " ".join(words[:6]))
        form = rng.choice(BRACKETED).format(w=words[at].strip("[]{}()"), v=rng.choice(words).strip("[]{}()"))
        markup.append(" ".join([*before, form, *after]))
    return [field_text(t) for t in templates], [field_text(t) for t in markup]


def _summed_texts(values: DataFrame, count: Callable[[list[str]], np.ndarray], size: int) -> np.ndarray:
    """The sum of `count` over bounded parts of the texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(size)
        for batch in batches:
            texts = batch["value"].tolist()
            for part in slices(texts):
                sums += count(texts[part])
        yield summands(sums)

    return summed(values.mapInPandas(run, SUMMANDS), size)


def fit_residue_models(columns: list[tuple[DataFrame, str]]) -> tuple[ResidueModel, FieldModel]:
    """Fits the models on all texts of the columns.

    The first pass counts the n-grams of all prose and of the examples that are made from it, the others those of
    what the models so far hold for prose. Each text makes examples by a hash of its content, and all counts are whole
    numbers, so files and partitions change nothing. The driver gets sums only.
    """
    texts = reduce(DataFrame.unionByName, [df.select(F.col(name).alias("value")).filter(F.length(F.trim("value")) >= N) for df, name in columns])
    total = texts.count()
    if not total:
        return ResidueModel.fit([]), FieldModel.fit([])
    texts, repeats, both = spread(texts), -(-TEMPLATES // total), len(GRAMS) * BINS

    def first(values: list[str]) -> np.ndarray:
        made = [made_from(t, repeats) for t in map(untagged, values) if not OPENING.search(t)]
        templates, markup = ([t for m in made for t in m[k]] for k in (0, 1))
        return np.concatenate((gram_counts([simplified(t) for t in values]), field_counts(templates).ravel(), field_counts(markup).ravel(), [len(markup)]))

    sums = _summed_texts(texts, first, BINS + 2 * both + 1)
    # as many made examples as without a table, and the fixed ones beside them
    lines, fixed = field_counts(template_lines()), field_counts(mention_examples([]))
    share = TEMPLATES / max(sums[-1], 1)
    templates = sums[BINS: BINS + both].reshape(-1, BINS) * share * 5 / 6 + lines if sums[-1] else field_counts(template_examples([]))
    mentions = sums[BINS + both: -1].reshape(-1, BINS) * share + fixed

    base = ResidueModel.of_counts(sums[:BINS])
    model = ResidueModel.of_counts(_summed_texts(texts, lambda values: gram_counts(base.prose([simplified(t) for t in values])), BINS))
    marked = texts.filter(F.col("value").rlike(OPENING.pattern))

    def kept(fields: FieldModel) -> np.ndarray:
        def count(values: list[str]) -> np.ndarray:
            return field_counts(fields.prose([t for t in map(field_text, values) if OPENING.search(t)])).ravel()

        return _summed_texts(marked, count, both).reshape(-1, BINS) * min(1, WEIGHT / total)

    return model, FieldModel.refined(templates, mentions, kept)


def scored_residue(parts: list[tuple[str, DataFrame, str, str]], models: tuple[ResidueModel, FieldModel] | None = None) -> DataFrame:
    """(tab, rec_id, field, coverage, n_placeholders, excluded) of every value that is not empty.

    `excluded` holds where residue covers at least COVERAGE of the value or a placeholder is left in it.
    Null, empty and blank values give no row; repeated rows give repeated results.
    """
    model, fields = models or fit_residue_models([(df, column) for _, df, _, column in parts])
    run = F.pandas_udf(residue_batch(model.ratios, fields.ratios), RESIDUE)
    result = None
    for tab, df, key, column in parts:
        slim = df.select(F.col(key).cast("long").alias("rec_id"), F.col(column).alias("value")).filter(F.trim("value") != "")
        rows = spread(slim).withColumn("r", run("value")).select(
            F.lit(tab).alias("tab"), "rec_id", F.lit(column).alias("field"),
            F.round("r.coverage", 4).alias("coverage"), F.col("r.n_placeholders").alias("n_placeholders"),
            ((F.col("r.coverage") >= COVERAGE) | (F.col("r.n_placeholders") > 0)).alias("excluded"),
        )
        result = rows if result is None else result.unionByName(rows)
    return result
