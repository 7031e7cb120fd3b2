"""Residue: every text reaches the grammars."""

from __future__ import annotations

from weblattice.llm.residue import residue, without_residue

SERVED = [
    "The page does not exist.", "This page is gone.", "Rate limit exceeded", "Please sign in to continue", "Verify you are human", "Slow down",
    "Servicio no disponible", "Servizio non disponibile", "La pagina non esiste", "Accès interdit", "Page inexistante",
    "The quick brown fox jumps over the lazy dog.", "Content to follow",
]
CONTENT = ["Links between sections help readers.", "Ein Absatz über Verweise.", "", None]


def test_residue_without_common_trigger_words_is_found(spark):
    docs = spark.createDataFrame(list(enumerate(SERVED + CONTENT)), "doc_id long, text string")
    assert {r.doc_id for r in residue(docs).collect()} == set(range(len(SERVED)))
    assert {r.doc_id for r in without_residue(docs).collect()} == set(range(len(SERVED), len(SERVED) + len(CONTENT)))


TOLD = [
    "Set ${HOME} before running.", "Error 404: what it means and how to fix it", "Lorem ipsum dolor sit amet is the printer's classic filler text.",
    "Under construction: lessons from twenty years of road building", "The placeholder {{ user.name }} is replaced by the reader's name.",
    "Write `{{ user.name }}` into the template.", "```\n{{ page.title }}\n```", 'The page said "404 Not Found" last week.',
    "Write {{ a.b }} for the name. Use the variable {{ c.d }} for the title. {{ e.f }} is replaced by the date.",
]


def test_tutorials_and_tales_are_content(spark):
    docs = spark.createDataFrame(list(enumerate(TOLD)), "doc_id long, text string")
    assert residue(docs).collect() == []


def test_long_placeholders_and_messages_are_found(spark):
    long = ["Dear {{ user.name | default: '" + "x" * 300 + "' }}, welcome.", "java.lang.IllegalStateException: " + "y" * 400, "Hello «user.name»", "Stack trace: main"]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(long)], "doc_id string, text string")
    assert {r.doc_id for r in residue(docs).collect()} == {"0", "1", "2", "3"}


def test_empty_table(spark):
    assert residue(spark.createDataFrame([], "doc_id long, text string")).collect() == []
