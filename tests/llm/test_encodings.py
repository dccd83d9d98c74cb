"""Problem 2: round trips through every chain, and texts that are rightly written."""

import pytest

from kiteloom.llm import encodings
from kiteloom.llm.encodings import CHAINS, LOSSY, classify, fit_on, pieces_of, repair_text

CLEAN = [
    "Größere Änderung für die Übersicht – störanfällig", "Después de 77 días volvió a ser rápido", "¿Por qué eligió otro tubería?", "처음에는 파서 문제라고 판단했지만 설정을 문서화했습니다", "“It’s only a cluster” — how it grew…",
    "naïve façade in São Paulo", "±5 % jitter · 20 °C « ok »", "CÓMO CAMBIÓ LA VERSIÓN", "What?? Really?", "a ? b : c", "https://x.example/view?post=a&b=?c", "plain ascii", "🚀 launch", "Überprüfung größer als zuvor", "내부 로그 장애가 반복되자 플랫폼 조직은 구성을 압축했습니다",
]


@pytest.fixture(scope="module")
def model():
    return fit_on(CLEAN * 3)


def verdict(model, text):
    return repair_text(text, classify(model, sorted(set(pieces_of(text)))))


@pytest.mark.parametrize("text", CLEAN)
def test_right_texts_are_no_case(model, text):
    assert verdict(model, text) == (None, text, True)


@pytest.mark.parametrize("chain", [c for c in CHAINS if c.startswith("utf8>") and c not in ("utf8>cp949",)])
@pytest.mark.parametrize("text", ["Größere Änderung für die Übersicht", "Después de 77 días", "처음에는 파서 문제라고 판단했지만"])
def test_kept_bytes_are_restored(model, chain, text):
    garbled = CHAINS[chain][0](text)
    found, fixed, whole = verdict(model, garbled)
    assert found and whole and fixed == text


@pytest.mark.parametrize("chain", ["cp949>latin-1", "cp949>cp1252"])
def test_legacy_korean_is_restored(model, chain):
    text = "처음에는 파서 문제라고 판단했지만 설정을 문서화했습니다"
    found, fixed, whole = verdict(model, CHAINS[chain][0](text))
    assert found and fixed == text


@pytest.mark.parametrize("chain", list(LOSSY))
def test_lost_characters_are_found_and_not_invented(model, chain):
    text = "처음에는 파서 문제라고 판단했지만" if "latin" not in chain else "Größere Änderung für Übersicht"
    found, _, whole = verdict(model, LOSSY[chain](text))
    assert found and not whole


def test_a_part_may_be_garbled(model):
    part = CHAINS["utf8>cp1252"][0]("für")
    found, fixed, whole = verdict(model, f"Größere Änderung {part} die Übersicht")
    assert found and fixed == "Größere Änderung für die Übersicht" and whole


def test_messy_tables(spark, model):
    bad = CHAINS["utf8>cp1252"][0]("Größere Änderung")
    rows = [(1, bad, "c"), (1, bad, "c"), (2, None, "c"), (3, "", "c"), (4, "Größere", "c"), (5, "ß " * 100_000 + bad, "c")]
    df = spark.createDataFrame(rows, "seq long, title string, chain string")
    got = encodings.garbled_values([("articles", df, "seq", "title")], model).collect()
    assert sorted(r.rec_id for r in got) == [1, 1, 5] and {r.fixed for r in got if r.rec_id == 1} == {"Größere Änderung"}
    assert encodings.garbled_values([("articles", df.limit(0), "seq", "title")]).count() == 0
