"""Cross-parsing of whole lines against running text."""

from __future__ import annotations

import random

import numpy as np

from weblattice.llm.language import Automaton, Model, fit, spell

ORDERS = {"es": ["la casa roja de la mujer esta aqui"], "pt": ["aqui esta roja la mujer de casa la"]}


def test_word_order_tells_languages_with_the_same_words():
    model = Model(ORDERS)
    scores = model.scores([ORDERS["es"][0].split(), ORDERS["pt"][0].split()])
    assert scores.argmin(axis=1).tolist() == [0, 1]
    assert np.ptp(scores, axis=1).min() > 0


def test_fit_keeps_running_lines_and_drops_mislabelled_ones():
    en = ["the page links to the other page", "the menu is on the left side"]
    de = ["die Seite verweist auf die andere Seite", "das Menü steht auf der linken Seite"]
    labelled = fit([("en", x) for x in en * 4] + [("de", x) for x in de * 4] + [("de", en[0])])
    assert labelled == {"en": [" ".join(spell(x)) for x in en], "de": [" ".join(spell(x)) for x in de]}


def test_lines_abreast_count_as_one_by_one():
    draw = random.Random(7)
    texts = {k: ["".join(draw.choice("abc ") for _ in range(60))] for k in ("en", "fr", "it")}
    lines = ["".join(draw.choice("abcx é") for _ in range(draw.randrange(40))) for _ in range(200)]
    model = Model(texts)
    automata = [Automaton(f" {texts[k][0]} ") for k in model.languages]
    assert model.phrases(lines).tolist() == [[a.phrases(x) for a in automata] for x in lines]
