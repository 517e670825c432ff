from __future__ import annotations

import time

import pytest

from gleaner.functions.encoding import ENCODINGS, _TABLES, repair_encoding
from gleaner.functions.modify import reformat_text

TEXTS = [
    "Déjà vu à l’été, « garçon » naïf, cœur, 5 € près de Zürich",
    "Straße, größer, Übermaß – „Ärger“",
    "Привет, мир: это обычный текст и ещё слова",
    "नमस्ते दुनिया, यह एक वाक्य है",
    "¿Mañana? El niño comió jamón…",
    "Καλημέρα κόσμε, 日本語 と 한국어, emoji 😀👍",
]
CLEAN = [
    *TEXTS,
    "CAFÉ” ist „SPASS“, Spaß” und ß® nicht",
    "ESPAÑ… Ñ… mot—État l’été “é” «À» 5€à",
    "√π/2 and √2π, ± 3°, ½ × ¾, µm ≤ Å",
    "класс «Р», витамин «В», СССР», Рівне, Україна є, №5",
    "São Paulo, Ângela, MÜNCHEN, ÅNGSTRÖM, coração, pão",
    "ÀÉÎÕÜ àéîõü ÿ Ÿ œ Œ ﬁn",
    "“É” – “à”—“é”…",
    "nle. Èéç an; Èèê Èêêpa, SSöä SSüzu",
    "Trần Hưng Đạo, Đà Nẵng, Łódź, žluťoučký kůň",
]


def misread(text: str, encoding: str) -> str:
    back = {b: c for c, b in _TABLES[encoding].items()}
    return "".join(back.get(b, chr(b)) for b in text.encode("utf-8"))


@pytest.mark.parametrize("encoding", ENCODINGS)
@pytest.mark.parametrize("text", TEXTS)
def test_round_trip_once_and_twice(text, encoding):
    once = misread(text, encoding)
    assert repair_encoding(once) == text
    assert repair_encoding(misread(once, encoding)) == text


@pytest.mark.parametrize("first", ENCODINGS[:3])
@pytest.mark.parametrize("second", ENCODINGS[:3])
def test_mixed_chains(first, second):
    for text in TEXTS[:2]:
        assert repair_encoding(misread(misread(text, first), second)) == text


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_left_alone(text):
    assert repair_encoding(text) == text


def test_damage_in_part_of_a_text():
    assert repair_encoding("l’Ã©tÃ© et l’été") == "l’été et l’été"
    assert reformat_text("schÃ¶n &amp; gut") == "schön & gut"


@pytest.mark.parametrize("unit", ["Ã©", "Ã", "Ð¿Ñ€", "é", "Â", "√", "Рі", "Ã© "])
def test_time_in_proportion(unit):
    started = time.perf_counter()
    repair_encoding(unit * 200_000)
    assert time.perf_counter() - started < 6
