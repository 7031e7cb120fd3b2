"""Page furniture against main content by consensus over hosts.

A page reaches us as lines of text plus the links a crawler saw in its DOM. Its
*containers* are its lines; a container's *generalised path* is either the
tag-class path of the links that make it up (``dom_path`` without positions, or
``template_signature`` where the path is missing), or, for text outside links,
the line's template: its words without numbers, dates, the site's own name and
other capitalised names.

1. Score: each page scores its containers (share of the line covered by links
   of a furniture class, own title or heading, sentence or not, site name).
2. Vote, in Spark: pages vote on paths per host, by the regions a crawler gave
   their links and by the repetition of their lines; per-host tallies are summed
   over hosts. A path wins where it repeats on its host, or on several hosts,
   more than prose does. All tallies combine on the map side.
3. Re-extract: each page is cut again with the winning paths of its host.

Nulls: pages with a null text give no rows; null titles, headings, anchors,
paths and regions are no evidence. Pages without links are cut by templates
alone. Repeated link rows count once. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblattice.operators.skew import SALTS, hot_keys
from weblattice.session import checkpointed

LETTERS = re.compile(r"[^\W\d_]+")
#: Words with a capital letter of the Latin, Greek or Cyrillic script.
CAPITAL = re.compile(r"\b[A-ZÀ-ÖØ-ÞΑ-ΩА-Я][^\W\d_]*")
#: A day, a month's name and a year.
DATE = re.compile(r"\b\d{1,2}(?:\.|st|nd|rd|th)?\s+(?:de\s+)?[^\W\d_]{3,}\.?\s+(?:de\s+)?\d{4}\b")
#: Signs between the entries of a menu or a trail of crumbs.
SEPARATORS = re.compile(r"\s*[|·»›/>•–—→⇒▸∙⋅~]\s*|\t+")
#: Ornaments after a line's end.
ORNAMENTS = " \t\r\xa0…*→»«\"”’)]"
DIGIT = re.compile(r"\d")
CODE = re.compile(r"^\s*(?:[$#>]\s|[a-z]+ -{1,2}\w|[<{}\[\]]|\w+\(|\w+\s*=)")
#: A path wins over hosts on so many, and on this share of all.
MIN_HOSTS, HOST_SHARE = 3, 0.001
#: Labels and templates must hold this share of a host's pages to win on the host alone.
LABEL_SHARE, LOCAL_SHARE, LOCAL_PAGES = 0.02, 0.08, 4
#: What sentences without the site's name need beyond that.
PROSE_SHARE, PROSE_PAGES = 0.15, 8
OUTER_SHARE, OUTER_PAGES = 0.9, 12
#: Labels and templates on this share of all hosts hold on every host.
EVERYWHERE = 0.005


def letters(text: str) -> str:
    return "".join(LETTERS.findall(text)).lower()


def brand_of(url: str | None) -> str:
    """The site's name as its host spells it: the longest label but the last, without a number."""
    m = re.match(r"[a-z][a-z0-9+.-]*://([^/?#:@]+)", url or "", re.I)
    if not m:
        return ""
    parts = m.group(1).lower().split(".")
    name = max(parts[:-1] or parts, key=len)
    return re.sub(r"[-_]?\d+$", "", name)


def plain(word: str) -> str:
    """A word without accents, as host names have it."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def template(line: str, found: list[str], brand: str) -> tuple[list[str], bool, bool]:
    """The words of a line's template, whether the site's name stands in it, whether it is all capitals.

    ``found`` are the line's runs of letters.
    """
    if DIGIT.search(line) and DATE.search(line):
        found = LETTERS.findall(DATE.sub(" ", line))
    if len(found) > 1 and line.isupper():
        low = [w.lower() for w in found]
        out = [w for w in low if not named(w, brand)]
        return out, len(out) < len(low), True
    # All words but names begin with a small letter, or stand first.
    names = CAPITAL.findall(line)
    out, branded = found, False
    if names:
        out = [w for w in found if w not in names]
        first = found[0] not in out
        low = [w.lower() for w in names]
        branded = bool(brand) and any(named(w, brand) for w in low)
        if first and not named(found[0].lower(), brand):
            out.insert(0, found[0].lower())
    if brand and brand in out:
        branded, out = True, [w for w in out if w != brand]
    return out, branded, False


def named(word: str, brand: str) -> bool:
    """Whether a word in lower case is the site's name."""
    return word == brand or (len(word) == len(brand) and not word.isascii() and plain(word) == brand)


def digest(words: list[str], capitals: bool = False) -> int:
    """A signed 64-bit key of a template."""
    h = xxhash.xxh3_64_intdigest(("^" if capitals else "") + " ".join(words))
    return h - (1 << 64) if h >= 1 << 63 else h


ENDS = frozenset(".!?:;")


def _prose(line: str, words: list[str]) -> bool:
    return len(words) >= 4 and line.rstrip(ORNAMENTS)[-1:] in ENDS


def page_lines(text: str) -> list[str]:
    return unicodedata.normalize("NFC", text).split("\n")


def _own(title, h1, headings) -> set[str]:
    return {letters(unicodedata.normalize("NFC", t)) for t in (title, h1, *(headings or ())) if t} - {""}


def _arrow(fn: Callable, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(n).to_pylist() for n in b.schema.names])
            out = fn(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


#: Lines a worker remembers; a bound on memory only.
MEMORY = 20_000
_memory: dict = {}


def _votes(rows) -> list[list]:
    """(run_id, key, label, prose, branded, outer) once per page and template.

    outer: the first or the last sentence line of the page, where notices stand.
    """
    out: list[list] = [[], [], [], [], [], []]
    for run_id, url, text, title, h1, headings, aside in rows:
        brand, own = brand_of(url), _own(title, h1, headings)
        side = {letters(unicodedata.normalize("NFC", a)) for a in (aside or ()) if a} - {""}
        seen: dict[int, list] = {}
        running: list[list] = []
        last = None
        for line in page_lines(text):
            found = LETTERS.findall(line)
            if not found:
                continue
            key = "".join(found).lower()
            if key in side:
                if last is not None:
                    last[0] = 1
                last = None
                continue
            last = None
            if key in own:
                continue
            memo = _memory.get((brand, line))
            if memo is None:
                words, branded, capitals = template(line, found, brand)
                memo = (digest(words, capitals) if words else None, branded, _prose(line, words))
                if len(_memory) >= MEMORY:
                    _memory.clear()
                _memory[brand, line] = memo
            k, branded, prose = memo
            if k is None:
                continue
            mark = seen.setdefault(k, [0, 0, 0, 0])
            mark[1] |= prose
            mark[2] |= branded
            last = mark
            if prose and not branded:
                running.append(mark)
        for mark in (*running[:1], *running[-1:]):
            mark[3] = 1
        for k, marks in seen.items():
            for c, v in zip(out, (run_id, k, *marks)):
                c.append(v)
    return out


_VOTES = pa.schema([("run_id", pa.int64()), ("k", pa.int64()), ("label", pa.int32()), ("prose", pa.int32()), ("branded", pa.int32()), ("outer", pa.int32())])


def generalised_path(path: Column) -> Column:
    """A tag-class path without positions and numbers, in lower case."""
    return F.regexp_replace(F.lower(path), r":nth-[a-z-]+\([^)]*\)|\[\d+\]|\d+", "")


#: The furniture class that a region speaks for.
REGIONS = {"nav": "nav", "header": "nav", "breadcrumb": "crumb", "aside": "aside", "footer": "footer", "main": "main", "body": "main"}
CLASSES = ("main", "nav", "crumb", "aside", "footer")
#: A host's own votes on a path count against so many votes cast as all hosts cast theirs.
PRIOR = 5.0
#: Up to so many (host, path) winners are broadcast; more are joined by shuffle.
BROADCAST_PATHS = 200_000


def classed_links(links: DataFrame) -> DataFrame:
    """(id, run_id, source_fetch_id, anchor_text, c): links with the class their path won on their host, null for main content.

    Each link is its page's vote for the class of its region on its generalised
    path; links without a path vote on their template signature. Per host the
    class with most votes wins a path, hosts with few votes following the
    others; equal votes go to the earlier of :data:`CLASSES`. A wrong or
    missing region is outvoted.
    """
    region = F.element_at(F.create_map(*[F.lit(x) for kv in REGIONS.items() for x in kv]), F.lower("dom_region"))
    slim = links.select(
        "id", "run_id", "source_fetch_id", "anchor_text",
        F.coalesce(generalised_path(F.col("dom_path")), F.concat(F.lit("#"), F.col("template_signature")), F.lit("")).alias("g"), region.alias("v"),
    )
    votes = [F.count_if(F.col("v") == k).alias(k) for k in CLASSES]
    local = slim.groupBy("run_id", "g").agg(*votes)
    over_all = local.groupBy("g").agg(*[F.sum(k).alias(f"all_{k}") for k in CLASSES])
    every = sum((F.col(f"all_{k}") for k in CLASSES[1:]), F.col("all_main"))
    scores = [F.struct((F.col(k) + PRIOR * F.col(f"all_{k}") / F.greatest(every, F.lit(1))).alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("k")) for i, k in enumerate(CLASSES)]
    won = F.when(every > 0, F.array_max(F.array(*scores))["k"])
    winners = checkpointed(local.join(over_all, "g").select(F.col("run_id").alias("_r"), F.col("g").alias("_g"), won.alias("c")))
    small = winners.count() <= BROADCAST_PATHS
    joined = slim.join(F.broadcast(winners) if small else winners, slim["run_id"].eqNullSafe(winners["_r"]) & (slim["g"] == winners["_g"]), "left")
    return joined.select("id", "run_id", "source_fetch_id", "anchor_text", F.nullif(F.col("c"), F.lit("main")).alias("c"))


def _with_links(pages: DataFrame, classed: DataFrame) -> DataFrame:
    """Pages with the anchors of their side lists; one shuffle of the texts by fetch_id."""
    side = (
        classed.where(F.col("anchor_text").isNotNull() & (F.col("c") == "aside"))
        .groupBy(F.col("source_fetch_id").alias("_f")).agg(F.collect_set("anchor_text").alias("aside"))
    )
    slim = pages.where("body_text is not null").select(
        "id", "run_id", "fetch_id", "url", "body_text", "title", "h1", F.col("headings.text").alias("headings")
    )
    return slim.join(side, slim["fetch_id"] == side["_f"], "left").drop("_f", "fetch_id")


def host_sizes(pages: DataFrame) -> DataFrame:
    return pages.where("body_text is not null").groupBy("run_id").agg(F.count(F.lit(1)).alias("pages"))


@dataclass(frozen=True)
class Everywhere:
    """Labels and templates on :data:`EVERYWHERE` of all hosts: at most a host's mean number of them over that share."""

    labels: frozenset[str]
    wins: frozenset[int]


def host_profiles(pages: DataFrame, classed: DataFrame, joined_pages: DataFrame) -> tuple[DataFrame, Everywhere]:
    """The vote: per run_id its ``labels`` (menu entries), ``wins`` and ``heads`` (templates; heads start a side list).

    A path wins on its own host by its share of the host's pages, or on all its
    hosts by the number of hosts: :data:`MIN_HOSTS`, and :data:`HOST_SHARE` of
    all. What holds on :data:`EVERYWHERE` of all hosts comes apart.
    """
    sized = host_sizes(pages)
    slim = joined_pages.select("run_id", "url", "body_text", "title", "h1", "headings", "aside")
    ballots = slim.mapInArrow(_arrow(_votes, _VOTES), "run_id long, k long, label int, prose int, branded int, outer int")
    tallies = ballots.groupBy("run_id", "k").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("label"), (F.avg("prose") > 0.5).alias("prose"), F.max("branded").alias("branded"),
        F.sum("outer").alias("outer"),
    )
    # Read three times below; the ballots cost a pass over all texts in Python, so they are cast once.
    local = checkpointed(tallies).join(sized, "run_id")
    all_hosts = sized.count()
    least = max(MIN_HOSTS, math.ceil(HOST_SHARE * all_hosts))
    over_hosts = (
        local.groupBy("k").agg(
            F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("g_n"), F.sum("pages").alias("g_pages"), F.max("n").alias("g_max"),
            F.sum("label").alias("g_label"), F.sum("outer").alias("g_outer"),
        ).where(F.col("hosts") >= least)
    )
    joined = local.join(over_hosts, "k", "left")
    n, share = F.col("n"), F.col("n") / F.col("pages")
    wide = F.col("hosts").isNotNull()
    often = F.coalesce((F.col("g_max") >= PROSE_PAGES) & (F.col("g_n") / F.col("g_pages") >= PROSE_SHARE), F.lit(False))
    outside = F.coalesce((F.col("g_n") >= OUTER_PAGES) & (F.col("g_outer") / F.col("g_n") >= OUTER_SHARE), F.lit(False))
    here = (n >= LOCAL_PAGES) & (share >= LOCAL_SHARE)
    prose = F.col("prose")
    won = (
        F.when(~prose, wide | here)
        .when(F.col("branded") == 1, wide | ((n > LOCAL_PAGES) & (share >= 0.2)))
        .otherwise((wide & (often | outside)) | ((n >= 2 * PROSE_PAGES) & (share >= 0.5)))
    )
    head = won & (F.col("label") + F.coalesce("g_label", F.lit(0)) >= 0.3 * (n + F.coalesce("g_n", F.lit(0))))
    wins = joined.where(won).groupBy("run_id").agg(F.collect_list("k").alias("wins"), F.collect_list(F.when(head, F.col("k"))).alias("heads"))

    key = F.regexp_replace(F.lower("anchor_text"), r"[^\p{L}]", "")
    entries = classed.select("run_id", key.alias("a"), "c")
    tally = (
        entries.where("a != ''").groupBy("run_id", "a").agg(
            F.count_if(F.col("c").isin("nav", "crumb", "footer")).alias("yes"), F.count_if(F.col("c").isNull() | (F.col("c") == "aside")).alias("no")
        ).where("yes > no")
    )
    tally = checkpointed(tally.join(sized, "run_id"))
    shared = tally.groupBy("a").agg(F.count(F.lit(1)).alias("hosts"))
    labels = (
        tally.join(shared, "a").where((F.col("hosts") >= least) | (F.col("yes") >= F.greatest(F.lit(2), LABEL_SHARE * F.col("pages"))))
        .groupBy("run_id").agg(F.collect_list("a").alias("labels"))
    )
    widest = max(MIN_HOSTS, EVERYWHERE * all_hosts)
    labels_all = [r.a for r in shared.where(F.col("hosts") >= widest).select("a").collect()]
    wins_all = [r.k for r in joined.where(won).groupBy("k").agg(F.count(F.lit(1)).alias("hosts")).where(F.col("hosts") >= widest).select("k").collect()]
    own = sized.select("run_id").join(labels, "run_id", "left").join(wins, "run_id", "left")
    return own, Everywhere(frozenset(labels_all), frozenset(wins_all))


#: Verdicts on a line: content, furniture, start of a side list, menu, crumbs if the page's title fits.
OTHER, WON, HEAD, MENU, CRUMBS = range(5)


class _Starts:
    """Whether some label begins with a word."""

    def __init__(self, labels):
        self.labels, self.seen = labels, {}

    def __contains__(self, word: str) -> bool:
        hit = self.seen.get(word)
        if hit is None:
            if len(self.seen) >= MEMORY:
                self.seen.clear()
            hit = self.seen[word] = any(x.startswith(word) for x in self.labels)
        return hit


class Profile:
    """A host's winning paths, ready to cut its pages."""

    __slots__ = ("heads", "labels", "memory", "menu", "starts", "wins")

    def __init__(self, labels, wins, heads):
        self.labels, self.wins, self.heads = frozenset(labels or ()), frozenset(wins or ()), frozenset(heads or ())
        self.memory: dict = {}
        self.starts = _Starts(self.labels)
        alternatives = "|".join(map(re.escape, sorted(self.labels, key=lambda x: (-len(x), x))))
        self.menu = re.compile(f"(?:{alternatives})+") if alternatives else None

    def known(self, words: list[str], capitals: bool) -> int | None:
        """The winning template that the words fit, if any.

        In capitals names can't be told from words, so up to two words may be left out.
        """
        k = digest(words, capitals)
        if k in self.wins:
            return k
        if capitals:
            n = len(words)
            for i in range(n + 1):
                for j in range(i, n + 1):
                    k = digest([w for x, w in enumerate(words) if x != i and x != j])
                    if k in self.wins:
                        return k
        return None

    def cut(self, lines: list[str], brand: str, own: set[str], side: set[str]) -> list[bool]:
        """For each line, whether it is furniture."""
        out = [False] * len(lines)
        items = False  # whether a side list is open
        for i, line in enumerate(lines):
            found = LETTERS.findall(line)
            if not found:
                continue
            key = "".join(found).lower()
            if key in own:
                items = False
                continue
            if key in side:
                out[i] = True
                continue
            verdict = self.memory.get((brand, line))
            if verdict is None:
                verdict = self._verdict(line, found, key, brand)
                if len(self.memory) >= MEMORY:
                    self.memory.clear()
                self.memory[brand, line] = verdict
            if verdict == CRUMBS:
                verdict = MENU if self._crumbs(line, own) else self._by_template(line, found, brand)
            if verdict == MENU:
                out[i], items = True, False
            elif verdict:
                out[i] = True
                items = items or verdict == HEAD
            elif items and line.rstrip(ORNAMENTS)[-1:] not in ENDS and len(found) > 2 and not CODE.match(line):
                out[i] = True
            else:
                items = False
        return out

    def _verdict(self, line: str, found: list[str], key: str, brand: str) -> int:
        if key in self.labels or (self.menu is not None and (self.menu.fullmatch(key) if len(key) < 400 else self._labels_only(key))):
            return MENU
        if found[0].lower() in self.starts and SEPARATORS.search(line):
            return CRUMBS  # depends on the page's title
        return self._by_template(line, found, brand)

    def _labels_only(self, key: str) -> bool:
        """Whether labels alone make up a long line, in time that grows with its length only."""
        lengths = sorted({len(x) for x in self.labels})
        reached = {0}
        for at in range(len(key)):
            if at in reached:
                reached.discard(at)
                reached.update(at + n for n in lengths if key[at : at + n] in self.labels)
                if not reached:
                    return False
        return len(key) in reached

    def _by_template(self, line: str, found: list[str], brand: str) -> int:
        words, _, capitals = template(line, found, brand)
        if "©" in line and len(words) <= 12:
            return MENU
        k = self.known(words, capitals) if words else None
        return OTHER if k is None else HEAD if k in self.heads else WON

    def _crumbs(self, line: str, own: set[str]) -> bool:
        parts = [letters(p) for p in SEPARATORS.split(line)]
        parts = [p for p in parts if p]
        if len(parts) < 2 or parts[0] not in self.labels:
            return False
        rest = parts[1:]
        hits = sum(p in self.labels for p in rest) + (parts[-1] in own)
        return 2 * hits >= len(rest) or (len(rest) <= 2 and not _prose(line, rest + ["", "", ""]))


class Cutter:
    """Cuts the pages of a partition of :func:`profiled_pages`: a host's profile comes first, then its pages."""

    def __init__(self, everywhere: Everywhere):
        self.everywhere = everywhere
        self.run_id, self.profile = None, Profile(everywhere.labels, everywhere.wins, ())

    def pages(self, batch: pa.RecordBatch) -> Iterator[tuple[tuple, list[str], list[bool]]]:
        """((id, body_text), lines, furniture or not) of each page of a batch."""
        cols = [batch.column(n).to_pylist() for n in ("lead", "id", "run_id", "url", "body_text", "title", "h1", "headings", "aside", "labels", "wins", "heads")]
        for lead, key, run_id, url, text, title, h1, headings, aside, labels, wins, heads in zip(*cols):
            if lead:
                self.run_id = run_id
                self.profile = Profile(self.everywhere.labels.union(labels or ()), self.everywhere.wins.union(wins or ()), heads)
                continue
            if run_id != self.run_id:  # pages without a run have no host
                self.run_id, self.profile = run_id, Profile(self.everywhere.labels, self.everywhere.wins, ())
            lines = page_lines(text)
            own = _own(title, h1, headings)
            side = {letters(unicodedata.normalize("NFC", a)) for a in aside if a} - own - {""} if aside else frozenset()
            yield (key, text), lines, self.profile.cut(lines, brand_of(url), own, side)


def profiled_pages(pages: DataFrame, links: DataFrame) -> tuple[DataFrame, Everywhere]:
    """Pages behind their host's winning paths, and what holds on all hosts.

    Within a partition the rows of a host stand together, its profile (``lead``)
    before its pages, so a profile is sent once and no task holds a host's
    pages at once. A hot host's pages spread over sub-keys, each with a copy of
    the profile.
    """
    classed = classed_links(links)
    rows = _with_links(pages, classed)
    profiles, everywhere = host_profiles(pages, classed, rows)
    hot = F.broadcast(hot_keys(host_sizes(pages), ["run_id"], "pages").select(F.col("run_id").alias("_h"), F.lit(True).alias("_hot")))

    def spread(df: DataFrame, z: Column) -> DataFrame:
        return df.join(hot, df["run_id"].eqNullSafe(F.col("_h")), "left").withColumn("_z", z).drop("_h", "_hot")

    texts = spread(rows, F.when(F.col("_hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(0)).withColumn("lead", F.lit(False))
    leads = spread(profiles, F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).withColumn("lead", F.lit(True))
    both = texts.unionByName(leads, allowMissingColumns=True)
    return both.repartition("run_id", "_z").sortWithinPartitions("run_id", "_z", F.desc("lead")), everywhere


def _map_pages(pages: DataFrame, links: DataFrame, fn: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    rows, everywhere = profiled_pages(pages, links)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(everywhere)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(fn(cutter.pages(b)), schema)], schema=schema)

    return rows.mapInArrow(run, ddl)


def _found(pages) -> list[list]:
    ids, numbers = [], []
    for (key, _), _, bad in pages:
        mine = [n for n, b in enumerate(bad, 1) if b]
        numbers += mine
        ids += [key] * len(mine)
    return [ids, numbers]


def furniture_lines(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, line_no) of each line that is not the page's own content."""
    schema = pa.schema([("page_id", pa.int64()), ("line_no", pa.int32())])
    return _map_pages(pages, links, _found, schema, "page_id long, line_no int")


def _cleaned(pages) -> list[list]:
    out: list[list] = [[], [], []]
    for (key, text), lines, bad in pages:
        raw = text.split("\n")
        out[0].append(key)
        out[1].append("\n".join(line for line, b in zip(raw if len(raw) == len(lines) else lines, bad) if not b))
        out[2].append(sum(bad))
    return out


def main_text(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(page_id, main_text, removed_lines) of each page with a text."""
    schema = pa.schema([("page_id", pa.int64()), ("main_text", pa.string()), ("removed_lines", pa.int32())])
    return _map_pages(pages, links, _cleaned, schema, "page_id long, main_text string, removed_lines int")
