import pytest

from quillspan.llm.garbled import ContextCost, certain_signs, contexts, repair, repair_texts

CLEAN = "L’été dernier, le château d’eau près du canal – 4 € – était déjà fermé. Größe: übergroß, „Käufer“. Señal débil… ¿mañana?"


def cost_of(texts):
    seen = {}
    for t in texts:
        for c in {c for w in t.split() for c in contexts(w)}:
            seen[c] = seen.get(c, 0) + 1
    return ContextCost(len(texts), seen)


MODEL = cost_of([CLEAN] * 400)


@pytest.mark.parametrize("shown", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"])
def test_utf8_read_as_something_else(shown):
    original = "L'été près du café, Größe übergroß"
    bad = original.encode().decode(shown, "replace")
    r = repair(bad, MODEL)
    assert r.garbled
    if "�" not in bad:
        assert r.restored == original


def test_nested_layers():
    bad = "crème brûlée – 4 €"
    for _ in range(3):
        bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in bad.encode())
    assert repair(bad, MODEL) == repair(bad, MODEL)
    assert repair(bad, MODEL).restored == "crème brûlée – 4 €"
    assert repair(bad, MODEL).layers == 3


@pytest.mark.parametrize("shown", ["mac_roman", "cp437", "cp1251"])
def test_one_byte_pairs(shown):
    bad = CLEAN.replace("‰", "").encode("cp1252").decode(shown)
    assert repair(bad, MODEL).restored == CLEAN


def test_part_of_a_text_and_entities():
    assert repair("A ligação até à praia sem explicaÃ§Ã£o.", MODEL).restored == "A ligação até à praia sem explicação."
    assert repair("isn&acirc;€™t S&Atilde;£o", MODEL).restored == "isn’t São"


def test_japanese():
    text = "古い水車は静かに修理中である。まだ動く。"
    bad = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode("cp932"))
    assert repair(bad, MODEL).restored == text


def test_lost_characters_are_found_but_not_restored():
    r = repair("To everyone� relief", MODEL)
    assert r.garbled and r.restored is None


@pytest.mark.parametrize("text", [None, "", " ", "plain & simple", CLEAN, "AMANHÃ HÁ REUNIÃO", "É ÎLE Æ Ø ß", "┌──┬──┐", "Ωμέγα ≥ 3 ± 0,5 °C", "Это всё. «СССР»", "続きは明日。", "Română: mâine, însă", "🙂👍🏽 ok", "﻿BOM first", "JA, GROSS: “Ä“, ß“", "— … £12.40 ™ § 4", "Étrangement, la bibliothèque précède l’école"])
def test_intended_characters_stay(text):
    assert not repair(text, MODEL).garbled
    if text:
        assert certain_signs(text) == 0


def test_table(spark):
    rows = [(1, "cafÃ© Ã©", "a"), (2, None, "b"), (3, "", "c"), (4, "fine", "d"), (4, "fine", "d"), (5, "x " * 100000 + "naÃ¯ve Ã©", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, garbled string")
    got = sorted((r["doc_id"], r["garbled"]) for r in repair_texts(df).collect())
    assert got == [(1, True), (2, False), (3, False), (4, False), (4, False), (5, True)]
    assert repair_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("shown,meant", [("mac_roman", "cp1252"), ("cp437", "cp1252"), ("koi8-r", "cp1251")])
def test_a_third_garbled_by_one_pair_is_found(spark, shown, meant):
    words = "café près déjà fermé château élève müssen größer schön mañana señal année même forêt" if meant == "cp1252" else "Вода стоит ещё долго Мельница старая Река течёт Берег Дорога Зима Осень прошла Школа"
    words = words.split()
    texts = [" ".join(words[(i + k * (1 + i % 5)) % len(words)] for k in range(6)) + f" {i}" for i in range(600)]
    bad = {i for i in range(600) if i % 3 == 0}
    rows = [(i, t.encode(meant).decode(shown) if i in bad else t) for i, t in enumerate(texts)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in repair_texts(df).where("garbled").collect()}
    assert not {i for i in got if i < 1000} - bad
    assert len(bad - got) <= len(bad) / 50
    assert set(range(1000, 1300)) <= got
