"""Problems 7 and 10: residue and reading levels, by held-out accuracy and on messy tables."""

import random

import numpy as np
import pytest

from kiteloom.llm import reading_level, residue
from kiteloom.llm.reading_level import ReadingModel, isotonic
from kiteloom.llm.residue import COVERAGE, FieldModel, ResidueModel, field_text, residue_examples, simplified

PROSE = [
    "We kept the queue small and replaced one worker at a time.", "Nach zwei Tagen war der Dienst wieder schnell genug für alle.", "El equipo cambió la parte antigua del servicio en otoño.", "다음 달에는 오래된 저장소 하나를 더 정리했습니다.",
    "Our guide shows why a page that says please enable JavaScript still needs plain content for readers of the old service.", "Designers used lorem ipsum in the steady mock, so we audited a check that stops it before release.",
    "A 503 Service Unavailable from the cache now starts a retry after 60 seconds in the worker.", "Every retry in October reached the gateway before the ledger had been isolated by the platform group.",
]
RESIDUE = ["Please enable JavaScript to view this page.", "Menu\nSearch\n404 Not Found. The page you requested does not exist.", "Lorem ipsum dolor sit amet nunc velit.", "<h1>Access denied. Error code 1a2b3c4d</h1>", "Hier steht Ihr Text.", "여기에 본문을 입력하세요."]


@pytest.fixture(scope="module")
def model():
    return ResidueModel.fit(PROSE * 40)


@pytest.fixture(scope="module")
def fields():
    return FieldModel.fit(PROSE * 40)


def test_placeholders_of_held_out_examples(fields):
    from kiteloom.llm.residue import mention_examples, template_examples

    prose = [field_text(t) for t in PROSE]
    templates, others = template_examples(prose, seed=501)[:600], mention_examples(prose, seed=502)[::20]
    assert (fields.placeholders(templates) > 0).mean() > 0.9 and (fields.placeholders(others) > 0).mean() < 0.03
    assert fields.placeholders([]).tolist() == [] and fields.placeholders(["", "plain"]).tolist() == [0, 0]


def test_residue_covers_and_prose_does_not(model):
    assert (model.coverage([simplified(t) for t in RESIDUE]) >= COVERAGE).all()
    assert (model.coverage([simplified(t) for t in PROSE]) < COVERAGE).all()
    filler, notices = residue_examples(seed=99)  # made with another seed than the fit's
    held_out = random.Random(1).sample(filler, 200) + random.Random(1).sample(notices, 200)
    assert (model.coverage(held_out) >= COVERAGE).mean() > 0.98
    assert model.coverage([]).shape == (0,) and model.coverage(["", "a"]).tolist() == [0.0, 0.0]


@pytest.mark.parametrize("text", ["{{ post_date }}", "Hello #{FIRST_NAME}, welcome", "by @@author@@", "%%title%% here", "%(name)s min", "{% block title %} |", "the [TITLE] again", "for {category} now", "${SITE.NAME} - x", "@{summary}", "[Insert summary here]"])
def test_placeholders_left_in(fields, text):
    assert fields.placeholders([field_text(text)])[0] > 0


@pytest.mark.parametrize("text", ["The string ${HOME} is expanded by the shell.", "In the template we write {{ user.name }} where the value goes.", "R&D share it [sic].", "\\emph{title} and \\frac{a}{b}", "[title](https://x)", "[[Home|title]]", "{ return cache; }", "it was cut [...]", "a {b + c}", "100 % of %s"])
def test_texts_about_placeholders(fields, text):
    assert fields.placeholders([field_text(text)]).tolist() == [0]


def test_messy_residue_tables(spark, model, fields):
    rows = [(1, RESIDUE[0]), (1, RESIDUE[0]), (2, None), (3, "  "), (4, PROSE[0]), (5, PROSE[0] * 20_000), (6, "by {{ author }} today")]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "seq long, body string, coverage double")
    got = sorted((r.rec_id, r.excluded) for r in residue.scored_residue([("articles", df, "seq", "body")], (model, fields)).collect())
    assert got == [(1, True), (1, True), (4, False), (5, False), (6, True)]
    assert residue.scored_residue([("articles", df.limit(0), "seq", "body")]).count() == 0


def test_residue_models_are_fitted_on_all_texts(spark, monkeypatch):
    from kiteloom.llm.residue import mention_examples, template_examples

    monkeypatch.setattr(residue, "SAMPLE_ROWS", 5, raising=False)  # once a bound of what was read
    rows = [f"{t} {chr(97 + i % 26) * (i // 26 + 1)}" for i in range(40) for t in PROSE] + RESIDUE + ["by {{ author }} today", "", None]
    model, fields = residue.fit_residue_models([(spark.createDataFrame([(t,) for t in rows], "body string").repartition(3), "body")])
    assert np.array_equal(model.ratios, ResidueModel.fit([t for t in rows if t]).ratios)
    prose = [field_text(t) for t in PROSE]
    templates, others = template_examples(prose, seed=501)[:600], mention_examples(prose, seed=502)[::20]
    assert (fields.placeholders(templates) > 0).mean() > 0.9 and (fields.placeholders(others) > 0).mean() < 0.03


def made(rng, level):
    easy, hard = "cat dog sun box run see big red cup map".split(), "notwithstanding heterogeneous parameterization amortization consequently epistemological".split()
    words = [rng.choice(hard if rng.random() < (level - 1) / 3.2 else easy) for _ in range(80)]
    step = 3 + 4 * level
    return " ".join(w + ("." if i % step == step - 1 else "") for i, w in enumerate(words)) + "."


def test_levels_on_held_out_texts():
    rng = random.Random(4)
    grades = [rng.randint(1, 4) for _ in range(400)]
    texts = [made(rng, g) for g in grades]
    model = ReadingModel.fit(texts[:300], grades[:300])
    got, score = model.levels(texts[300:])
    assert (got == np.array(grades[300:])).mean() > 0.9 and (abs(got - np.array(grades[300:])) <= 1).all()


def test_isotonic_is_the_least_squares_fit():
    x, y = np.arange(6.0), np.array([1, 3, 2, 2, 5, 4.0])
    kx, ky = isotonic(x, y)
    fit = np.interp(x, kx, ky)
    assert np.allclose(fit, [1, 7 / 3, 7 / 3, 7 / 3, 4.5, 4.5]) and (np.diff(fit) >= 0).all()


def test_messy_documents(spark):
    docs = spark.createDataFrame([(1, "One two. Three.", "x"), (2, None, "x"), (3, "", None), (1, "One two. Three.", "x"), (None, "lost", "x"), (4, "long words " * 50_000, "x")], "doc_id long, text string, channel string")
    labels = spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "a", 9), (99, "a", 1), (4, "a", None)], "doc_id long, annotator string, band int")
    got = reading_level.reading_levels(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == [1, 1, 2, 3, 4] and all(1 <= r.band <= 4 for r in got)
    assert {r.band for r in reading_level.reading_levels(docs, labels.limit(0)).collect()} == {3}
    assert reading_level.reading_levels(docs.limit(0), labels).count() == 0
    assert reading_level.level_profile(reading_level.reading_levels(docs, labels), docs).count() >= 1


def test_features_stand_for_the_texts():
    texts = ["One two two. Three!", "", "Und der Dienst, 12 mal."]
    data = reading_level.Texts(texts)
    again = reading_level.Texts.of_rows(data.rows())
    weights, syntax = np.random.default_rng(1).random(reading_level.BINS), np.random.default_rng(2).random((4, len(reading_level.SYNTAX)))
    assert np.allclose(data.scores(weights, syntax), again.scores(weights, syntax)) and len(data.shares) == 2 + 1 + 1 + 5
