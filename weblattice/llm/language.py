"""Language of documents and of lines by cross-parsing entropy.

For each language a suffix automaton holds labelled running text: whole lines,
their words in lower case and parted by blanks. A line is parsed against it
from left to right into phrases, each the longest piece that stands in the
labelled text, over word ends too; with c phrases against n labelled
characters, c·log2(n) estimates the line's bits under that language. The
language with the least wins. A page's count is the sum of its lines' counts.
Many lines walk the automata of all languages at once, in NumPy.

The labelled text is a bounded sample (:class:`Sample`). Labels are noisy, so
the automata take only the lines that a first fit assigns to their label. The
first fit must not know the lines themselves, else each would be found whole
under its label; it parses single words against each label's most frequent
ones. Everything else covers all rows and whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblattice.llm.furniture import CODE, Cutter, page_lines, profiled_pages

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")

# Two-letter codes of ISO 639-1 with the three-letter codes of ISO 639-2 and English names.
NAMES = {
    "en": ("eng", "english"), "de": ("deu", "ger", "german"), "fr": ("fra", "fre", "french"), "es": ("spa", "spanish", "castilian"),
    "pt": ("por", "portuguese"), "it": ("ita", "italian"), "nl": ("nld", "dut", "dutch", "flemish"), "sv": ("swe", "swedish"),
    "da": ("dan", "danish"), "no": ("nor", "norwegian"), "nb": ("nob",), "nn": ("nno",), "fi": ("fin", "finnish"), "pl": ("pol", "polish"),
    "cs": ("ces", "cze", "czech"), "sk": ("slk", "slo", "slovak"), "hu": ("hun", "hungarian"), "ro": ("ron", "rum", "romanian"),
    "bg": ("bul", "bulgarian"), "el": ("ell", "gre", "greek"), "ru": ("rus", "russian"), "uk": ("ukr", "ukrainian"), "tr": ("tur", "turkish"),
    "ar": ("ara", "arabic"), "he": ("heb", "hebrew"), "fa": ("fas", "per", "persian"), "hi": ("hin", "hindi"), "zh": ("zho", "chi", "chinese"),
    "ja": ("jpn", "japanese"), "ko": ("kor", "korean"), "vi": ("vie", "vietnamese"), "th": ("tha", "thai"), "id": ("ind", "indonesian"),
    "ca": ("cat", "catalan"), "eu": ("eus", "baq", "basque"), "gl": ("glg", "galician"), "hr": ("hrv", "croatian"), "sr": ("srp", "serbian"),
    "sl": ("slv", "slovenian"), "et": ("est", "estonian"), "lv": ("lav", "latvian"), "lt": ("lit", "lithuanian"), "la": ("lat", "latin"),
}
CODES = {alias: code for code, aliases in NAMES.items() for alias in (code, *aliases)}


def named_language(label: str | None) -> str | None:
    """The two-letter code a label names, or None; see the module's fixed values."""
    first = re.match(r"\s*([^\W\d_]+)(?![^\W_])", label or "")
    return CODES.get(first.group(1).lower()) if first else None


@dataclass(frozen=True)
class Sample:
    """Bounds of the labelled sample per language.

    rows and characters a row taken to fit, characters of the first fit's
    distinct words and of running text. A language that fewer than
    ``least_rows`` rows of the sample are labelled with can't be fitted; its
    pages come out under the nearest fitted language, with a low confidence.
    """

    rows: int = 300
    row_chars: int = 20_000
    chars: int = 24_000
    running: int = 40_000
    least_rows: int = 3


class Automaton:
    """Suffix automaton of a text; one dictionary of transitions per state."""

    def __init__(self, text: str):
        self.size = max(len(text), 2)
        go: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(go)
            go.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(go)
                    go.append(dict(go[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.go = go

    def phrases(self, text: str) -> int:
        """How many longest matches it takes to spell the text; a character that never stands in the labelled text is a phrase."""
        go, n, at, end = self.go, 0, 0, len(text)
        while at < end:
            n += 1
            state = go[0].get(text[at])
            at += 1
            while state is not None and at < end:
                state = go[state].get(text[at])
                if state is not None:
                    at += 1
        return n


#: Lines that walk the automata at once.
ABREAST = 4096


class Model:
    """The automata of several languages in one table of transitions.

    ``texts`` has the labelled pieces per language: lines, or single words.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        signs = sorted({c for pieces in texts.values() for t in pieces for c in t} | {" "})
        self.width = len(signs) + 1
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in signs]] = np.arange(1, self.width)
        code, tables, roots, sizes, at = {c: i for i, c in enumerate(signs, 1)}, [np.zeros(self.width, np.int32)], [], [], self.width
        for x in self.languages:
            a = Automaton(" " + " ".join(texts[x]) + " ")
            counts = np.fromiter(map(len, a.go), np.int64, len(a.go))
            table = np.zeros(len(a.go) * self.width, np.int32)
            signs_of = np.fromiter((code[c] for g in a.go for c in g), np.int64, counts.sum())
            table[np.repeat(np.arange(len(a.go)), counts) * self.width + signs_of] = np.fromiter((at + to * self.width for g in a.go for to in g.values()), np.int64, counts.sum())
            roots.append(at)
            sizes.append(a.size)
            tables.append(table)
            at += len(table)
        self.go = np.concatenate(tables)
        self.root = np.array(roots, np.int32)[:, None]
        first = self.go[self.root + np.arange(self.width)] if roots else np.zeros((0, self.width), np.int32)
        self.first = np.where(first == 0, self.root, first) if roots else first
        self.bits = np.log2(np.array(sizes, float))

    def phrases(self, lines: list[str]) -> np.ndarray:
        """Phrases per line (rows) and language (columns), as :meth:`Automaton.phrases` counts them."""
        out = np.zeros((len(lines), len(self.languages)), np.int64)
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        for k in range(0, len(order), ABREAST):
            own = order[k : k + ABREAST]
            lengths = np.array([len(lines[i]) for i in own])
            text = np.frombuffer("".join(lines[i] for i in own).encode("utf-32-le", "surrogatepass"), np.uint32)
            codes = self.code[text]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            # Lines stand longest first, so those still running are the first so many.
            running = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), side="left")
            state = np.repeat(self.root, len(own), axis=1)
            n = np.zeros((len(self.languages), len(own)), np.int32)
            for j, m in enumerate(running.tolist()):
                c = codes[starts[:m] + j]
                now = state[:, :m]
                to = self.go[now + c]
                ended = to == 0
                n[:, :m] += ended | (now == self.root)
                state[:, :m] = np.where(ended, self.first[:, c], to)
            out[own] = n.T
        return out

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """Bits per text (rows) and language (columns); equal texts are parsed once."""
        seen: dict[str, int] = {}
        at = [seen.setdefault(f" {' '.join(t)} " if t else "", len(seen)) for t in texts]
        return (self.phrases(list(seen)) * self.bits)[at] if at else np.zeros((0, len(self.languages)))

    def word_scores(self, texts: list[list[str]]) -> np.ndarray:
        """As :meth:`scores`, with each word parsed alone."""
        words = sorted({w for t in texts for w in t})
        place = {w: i for i, w in enumerate(words)}
        bits = self.phrases([f" {w} " for w in words]) * self.bits
        return np.array([bits[[place[w] for w in t]].sum(axis=0) for t in texts]).reshape(len(texts), len(self.languages))


def spell(line: str) -> list[str]:
    return WORD.findall(line.lower())


#: A word counts as a label's own in the first fit if it has this share of its highest frequency under any label.
PURITY = 0.5


def fit(rows: list[tuple[str, str]], sample: Sample = Sample()) -> dict[str, list[str]]:
    """Labelled lines per language from (label, text) rows, less those that the first fit gives to another label."""
    by: dict[str, list[list[str]]] = {}
    for code, text in rows:
        lines = by.setdefault(code, [])
        lines += [s for s in map(spell, page_lines(text)) if len(s) >= 4]
    counts = Counter(code for code, _ in rows)
    by = {k: v for k, v in by.items() if counts[k] >= sample.least_rows and v}
    first = _vocabulary(by, sample, PURITY)
    model = Model(first) if len(first) > 1 else None
    out = {}
    for code in first:
        lines = by[code]
        if model is not None:
            best = model.word_scores(lines).argmin(axis=1)
            lines = [s for s, b in zip(lines, best) if model.languages[b] == code]
        out[code] = _running(lines, sample.running)
    return {k: v for k, v in out.items() if v}


def _running(lines: list[list[str]], room: int) -> list[str]:
    """Distinct lines, in the order of the sample, as far as there is room; the last is cut to it."""
    out = []
    for line in dict.fromkeys(map(" ".join, lines)):
        if room <= 0:
            break
        out.append(line[:room])
        room -= len(line) + 1
    return out


def _vocabulary(by: dict[str, list[list[str]]], sample: Sample, purity: float) -> dict[str, list[str]]:
    """The most frequent words under each label, less those that stand far more often under another."""
    counts = {code: Counter(w for s in lines for w in s) for code, lines in by.items()}
    totals = {code: max(1, sum(c.values())) for code, c in counts.items()}
    top: dict[str, float] = {}
    for code, c in counts.items():
        for w, n in c.items():
            top[w] = max(top.get(w, 0.0), n / totals[code])
    out = {}
    for code, c in counts.items():
        words, room = [], sample.chars
        for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0])):
            if n / totals[code] < purity * top[w]:
                continue
            room -= len(w) + 1
            if room < 0:
                break
            words.append(w)
        out[code] = words
    return {k: v for k, v in out.items() if v}


def fit_from(rows: DataFrame, key: str, text: str, label: str, sample: Sample = Sample()) -> dict[str, list[str]]:
    """Fit on at most ``sample.rows`` rows per language, those with the smallest hash of their key.

    Partial limits inside each partition keep the shuffle to the sample's size.
    """
    tag = F.lower(F.regexp_extract(F.col(label), r"^\s*(\p{L}+)(?![\p{L}\p{N}])", 1))
    code = F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), tag)
    h = F.xxhash64(F.col(key), F.lit(17))
    ranked = (
        rows.select(F.col(key).alias("k"), F.left(F.col(text), F.lit(sample.row_chars)).alias("t"), code.alias("c"), h.alias("h")).where("c is not null and t is not null")
        .withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("h", "k"))).where(F.col("r") <= sample.rows)
    )
    found = sorted((r.c, r.h, r.t) for r in ranked.select("c", "h", "t").collect())
    return fit([(c, t) for c, _, t in found], sample)


_models: dict[bytes, Model] = {}


def model_of(texts: dict[str, list[str]]) -> Model:
    """The worker's model, built once."""
    key = hashlib.sha256(repr(sorted(texts.items())).encode()).digest()
    if key not in _models:
        _models.clear()
        _models[key] = Model(texts)
    return _models[key]


#: A line counts as written in another language from so many words on, and if that language saves so
#: many bits a word against the page's own, and this share of them.
LINE_WORDS, LINE_BITS, LINE_SHARE = 4, 4.0, 0.25


def judge(lines: list[list[str]], scores: np.ndarray) -> tuple[int, list[int], np.ndarray] | None:
    """(language of most of the text, language per line, its lead per line) from words and bits."""
    sizes = np.array([sum(map(len, s)) for s in lines])
    words = np.array([len(s) for s in lines])
    if not sizes.sum():
        return None
    n = scores.shape[1]
    whole = int(scores[words > 0].sum(axis=0).argmin())
    best = scores.argmin(axis=1)
    at = np.arange(len(lines))
    sure = (words >= LINE_WORDS) & (scores[:, whole] - scores[at, best] >= np.maximum(LINE_BITS * words, LINE_SHARE * scores[:, whole]))
    each = np.where(sure, best, whole)
    main = int(np.bincount(each, weights=sizes, minlength=n).argmax())
    if main != whole:
        sure = (words >= LINE_WORDS) & (scores[:, main] - scores[at, best] >= np.maximum(LINE_BITS * words, LINE_SHARE * scores[:, main]))
        each = np.where(sure, best, main)
    if n == 1:
        lead = np.ones(len(lines))
    else:
        two = np.partition(scores, 1, axis=1)
        lead = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
    return main, each.tolist(), lead


SLUG = re.compile(r"\S*/\S+-\S+")


def _own_lines(lines: list[str], bad: list[bool]) -> tuple[list[int], list[list[str]]]:
    numbers, words = [], []
    for n, (line, b) in enumerate(zip(lines, bad), 1):
        if b or CODE.match(line):
            continue
        s = spell(SLUG.sub(" ", line) if "/" in line else line)
        if s:
            numbers.append(n)
            words.append(s)
    return numbers, words


def page_languages(pages: DataFrame, links: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """The language of each page and of each line of its own text that differs from it.

    Rows: page_id, line_no (0 the page), lang, confidence (the winner's lead in
    bits over the next language, as a share) and foreign (characters of lines in other languages). Pages
    with a null text, or with no own words, have no row. Furniture lines, cut
    by :mod:`weblattice.llm.furniture`, don't count; nor does code.
    """
    labelled = fit_from(pages, "id", "body_text", "lang", sample)
    cut, everywhere = profiled_pages(pages, links)
    schema = pa.schema([("page_id", pa.int64()), ("line_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("foreign", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(labelled) if labelled else None
        cutter = Cutter(everywhere)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            if model is not None:
                rows, own = [], []
                for (key, _), lines, bad in cutter.pages(b):
                    rows.append(key)
                    own.append(_own_lines(lines, bad))
                scores = model.scores([w for _, words in own for w in words])
                at = 0
                for r, (numbers, words) in zip(rows, own):
                    part = scores[at : at + len(words)]
                    at += len(words)
                    found = judge(words, part) if words else None
                    if found is None:
                        continue
                    main, each, lead = found
                    total = part.sum(axis=0)
                    two = np.sort(total)[:2]
                    sure = 1.0 if len(two) < 2 else float(1 - two[0] / max(two[1], 1e-9))
                    other = [(n, e, s, sum(map(len, w))) for n, e, s, w in zip(numbers, each, lead, words) if e != main]
                    for x in ((r, 0, model.languages[main], sure, sum(o[3] for o in other)), *((r, n, model.languages[e], float(s), c) for n, e, s, c in other)):
                        for col, v in zip(out, x):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return cut.mapInArrow(run, "page_id long, line_no int, lang string, confidence double, foreign int")


def with_labels(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``label``, the language the page's label names, or null."""
    tag = F.lower(F.regexp_extract(F.col("lang"), r"^\s*(\p{L}+)(?![\p{L}\p{N}])", 1))
    code = F.element_at(F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair]), tag)
    labels = pages.select(F.col("id").alias("_id"), code.alias("label"))
    return found.join(labels, found["page_id"] == labels["_id"], "left").drop("_id")


def language_cases(pages: DataFrame, links: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """Pages whose label is missing or wrong (line_no 0), and lines in another language."""
    rows = with_labels(page_languages(pages, links, sample), pages)
    return rows.where("line_no > 0 or label is null or label != lang").select("page_id", "line_no", "lang")
