"""REF of all pairs of a run's pages as products of blocks, so that pairs are never shuffled or written in between.

:func:`run_rows` sends a run's texts to one task, or, where it has more than
:data:`STRIP` pages, to one task per strip of its pages; :func:`over_pairs`
builds the run's text model there and walks the strip's pages as donors, a block
of them at a time against all targets. Only what a query returns leaves the
task, so disk follows the texts and not the square of a run's pages. A run's
words must fit into a task (a crawl's page limit bounds a run).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages of a run that are donors in one task; each strip reads all texts of its run.
STRIP = 2048
#: Pairs that are held at once, products of single terms that are added at once, rows of a batch.
_CELLS, _HITS, _BATCH = 2_000_000, 1_000_000, 100_000
#: Kinds of rows: names, texts by field, links of a donor, wanted targets.
_NAME, _TEXT, _LINK, _WANTED = range(4)
FIELDS = {"title": 0, "links": 1, "body": 2}
OUTCOMES = ["utility", "section", "prominent-link", "make-visible", "add-link"]


def run_rows(names: DataFrame, texts: DataFrame, facts: tuple[Column, Column] | None = None, links: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """The rows that :func:`over_pairs` reads, a run's strip in one task.

    ``names`` is (run_id, doc, node); ``texts`` (run_id, doc, field, words), any
    number of rows for a page; ``links`` (run_id, src, dst, omega, body);
    ``wanted`` (run_id, node); ``facts`` are a page's section and whether it is
    a utility page, expressions over the column ``url``.
    """
    # Runs of several strips are at most a strip-th of all pages.
    large = names.groupBy("run_id").agg(F.ceil(F.count(F.lit(1)) / STRIP).cast("int").alias("_k")).where("_k > 1")
    large = F.broadcast(large)

    def row(rows: DataFrame, home: str | None, kind: int, **of: Column) -> DataFrame:
        k = F.coalesce("_k", F.lit(1))
        at = F.pmod(F.xxhash64(home), k).cast("int") if home else F.explode(F.sequence(F.lit(0), k - 1))
        every = {"doc": "bigint", "node": "string", "text": "string", "x": "int", "w": "double"}
        rows = rows.join(large, "run_id", "left").withColumn("strip", at)
        return rows.select("run_id", "strip", F.lit(kind).alias("kind"), *[of.get(c, F.lit(None)).cast(t).alias(c) for c, t in every.items()])

    section, utility = facts or (F.lit(""), F.lit(False))
    own = F.pmod(F.xxhash64("url"), F.coalesce("_k", F.lit(1)))
    named = names.withColumnRenamed("node", "url").join(large, "run_id", "left").select("run_id", "doc", "url", own.cast("int").alias("own"), section.alias("s"), utility.alias("u"))
    out = row(named, None, _NAME, doc=F.col("doc"), node=F.col("url"), text=F.col("s"), x=F.coalesce(F.col("u"), F.lit(False)).cast("int"), w=F.col("own"))
    long = F.filter("words", lambda t: F.length(t) >= 2)
    field = F.element_at(F.create_map(*[F.lit(x) for kv in FIELDS.items() for x in kv]), F.col("field"))
    out = out.unionByName(row(texts, None, _TEXT, doc=F.col("doc"), text=F.array_join(long, " "), x=field))
    if links is not None:
        out = out.unionByName(row(links, "src", _LINK, node=F.col("src"), text=F.col("dst"), x=F.col("body").cast("int"), w=F.col("omega")))
    if wanted is not None:
        out = out.unionByName(row(wanted, None, _WANTED, node=F.col("node")))
    parts = 4 * int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Strips of a run go to tasks that follow each other, so that they don't meet in one.
    return out.repartitionById(parts, F.pmod(F.xxhash64("run_id") + F.col("strip"), F.lit(parts)).cast("int")).sortWithinPartitions("run_id", "strip")


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """``x`` times ten to ``digits`` as whole numbers, rounded as Spark's ``round`` does: by the shortest decimal form."""
    y = x * 10.0**digits
    out = np.floor(y + 0.5)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < np.maximum(1e-6, y * 1e-15)):
        out.flat[i] = int((Decimal(repr(float(x.flat[i]))).scaleb(digits)).to_integral_value(ROUND_HALF_UP))
    return out


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return half_up(x, digits) / 10.0**digits


class _Run:
    """A run's text model, and the donors of one strip."""

    def __init__(self, rows: pa.Table, epsilon: float) -> None:
        kind = rows["kind"].to_numpy()
        of = lambda k: rows.filter(pa.array(kind == k))
        names = of(_NAME)
        names = names.take(pc.sort_indices(names["doc"]))
        self.epsilon, self.run, self.strip = epsilon, rows["run_id"][0].as_py(), rows["strip"][0].as_py()
        self.docs, self.n = names["doc"].to_numpy(), names.num_rows
        self.names = names["node"].combine_chunks()
        self.section = np.array(names["text"].to_pylist(), dtype=object)
        self.utility = names["x"].to_numpy() > 0
        self.home = np.flatnonzero(names["w"].to_numpy() == self.strip)
        self.links, self.wanted = of(_LINK), of(_WANTED)
        self._terms(of(_TEXT))

    def at(self, nodes: pa.ChunkedArray) -> np.ndarray:
        """The places of nodes, -1 for others than crawled pages."""
        return pc.fill_null(pc.index_in(nodes, self.names), -1).to_numpy().astype(np.int64)

    def _terms(self, texts: pa.Table) -> None:
        doc = np.searchsorted(self.docs, ids := texts["doc"].to_numpy())
        doc[doc == self.n] = 0
        known = (self.docs[doc] == ids) & (pc.binary_length(texts["text"]).to_numpy() > 0)  # other pages than those that stand for a node
        lists = pc.split_pattern(texts["text"].filter(pa.array(known)), " ").combine_chunks()
        owner = np.repeat(doc[known] * 3 + texts["x"].to_numpy()[known], pc.list_value_length(lists).to_numpy())
        coded = lists.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()  # by bytes, as Spark and SQL compare
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.dictionary, v = coded.dictionary.take(pa.array(order)), max(len(order), 1)
        key, tf = np.unique(owner * v + place[coded.indices.to_numpy()], return_counts=True)
        field, doc, code = key // v % 3, key // v // 3, key % v
        pair, back = np.unique(doc * v + code, return_inverse=True)
        df, cf = np.bincount(pair % v, minlength=v), np.bincount(code, tf, minlength=v)
        n = len(np.unique(doc))
        often = np.flatnonzero(df >= max(2, math.ceil(0.5 * n)))
        often = often[np.lexsort((often, -cf[often], -df[often]))]
        kept = np.ones(v, bool)
        kept[often[: math.floor(len(order) * 0.07)]] = False
        idf = np.log((1 + n) / (1 + df)) + 1
        donor, target = (kept[code] & (field > 0)), (kept[code] & (field != 1))
        held = np.zeros(len(pair), bool)
        held[back[donor]] = True
        self.d_doc, self.d_code = pair[held] // v, pair[held] % v
        asked = np.zeros(len(pair), bool)
        asked[back[target]] = True
        w = np.bincount(back, np.where(target, tf * idf[code], 0.0), minlength=len(pair))[asked]
        t_doc, t_code = pair[asked] // v, pair[asked] % v
        heavy = np.lexsort((t_code, -half_up(w, 9), t_doc))  # a target's heaviest terms first
        self.t_doc, self.t_code, self.t_w, self.v = t_doc[heavy], t_code[heavy], w[heavy], v
        self.total = np.bincount(self.t_doc, self.t_w, minlength=self.n)
        self.na, self.nb = np.bincount(self.d_doc, minlength=self.n), np.bincount(self.t_doc, minlength=self.n)
        self.texts = (self.na + self.nb) > 0

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(donors, held, ref, count): of a block of donors the terms they hold, REF and common terms against all pages; REF is 0 unless above epsilon."""
        home, v, n = self.home[self.na[self.home] > 0], self.v, self.n
        asked = np.bincount(self.t_code, minlength=v)
        inside = np.isin(self.d_doc, home)
        given = np.bincount(self.d_code[inside], minlength=v)
        # A product of dense columns takes about a thirtieth of adding a pair's term by itself.
        dense = np.flatnonzero(given * asked > 0.03 * len(home) * n)
        column = np.full(v, -1)
        column[dense] = np.arange(len(dense))
        often = column[self.t_code] >= 0
        weights, ones = np.zeros((len(dense), n)), np.zeros((len(dense), n), np.float32)
        weights[column[self.t_code[often]], self.t_doc[often]] = self.t_w[often]
        ones[column[self.t_code[often]], self.t_doc[often]] = 1
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(self.t_code[rare], kind="stable")]
        r_doc, r_w = self.t_doc[rare], self.t_w[rare]
        start = np.searchsorted(self.t_code[rare], np.arange(v + 1))
        size, total = max(1, _CELLS // max(n, 1)), np.where(self.total > 0, self.total, 1.0)
        first = np.searchsorted(self.d_doc, np.arange(n + 1))
        for i in range(0, len(home), size):
            src = home[i : i + size]
            held = np.zeros((len(src), v), bool)
            own = np.repeat(np.arange(len(src)), self.na[src])
            code = self.d_code[np.concatenate([np.arange(first[d], first[d + 1]) for d in src])]
            held[own, code] = True
            m = held[:, dense].astype(np.float64) @ weights
            count = held[:, dense].astype(np.float32) @ ones
            seldom = column[code] < 0
            own, code = own[seldom], code[seldom]
            hits = start[code + 1] - start[code]
            ends = np.cumsum(hits)
            a = 0
            while a < len(own):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _HITS)))
                h = hits[a:b]
                which = np.repeat(start[code[a:b]] - np.cumsum(h) + h, h) + np.arange(h.sum())
                flat = np.repeat(own[a:b] * n, h) + r_doc[which]
                np.add.at(m.reshape(-1), flat, r_w[which])
                np.add.at(count.reshape(-1), flat, np.float32(1))
                a = b
            m /= total
            m[np.arange(len(src)), src] = 0
            m[m <= self.epsilon] = 0
            yield src, held, m, count

    def pairs(self, pick: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple]:
        """(block, i, j, ref, rho): the related pairs, or those cells that ``pick`` names, as places in the block and of the target."""
        for block in self.blocks():
            _, _, m, _ = block
            sums = m.sum(axis=1)
            i, j = np.divmod(np.flatnonzero(m if pick is None else pick(block[0], m, sums)), self.n)
            ref = m[i, j]
            yield block, i, j, ref, ref / np.where(sums > 0, sums, 1.0)[i]

    def batches(self, src: np.ndarray, dst: np.ndarray, **more) -> Iterator[dict]:
        for a in range(0, len(src), _BATCH):
            part = slice(a, a + _BATCH)
            ends = {e: self.names.take(pa.array(x[part])) for e, x in (("src", src), ("dst", dst))}
            yield ends | {k: x[part] for k, x in more.items()}


def related(run: _Run) -> Iterator[dict]:
    for (src, _, _, count), i, j, ref, rho in run.pairs():
        yield from run.batches(src[i], j, ref=_rounded(ref, 7), rho=_rounded(rho, 7), matched_count=count[i, j].astype(np.int64))


def jaccard(run: _Run) -> Iterator[dict]:
    for (src, _, _, count), i, j, _, _ in run.pairs():
        common = count[i, j].astype(np.float64)
        yield from run.batches(src[i], j, jaccard=_rounded(common / (run.na[src[i]] + run.nb[j] - common), 9))


def heaviest(run: _Run, k: int = 3) -> Iterator[dict]:
    """The ``k`` common terms of each pair that weigh most."""
    first = np.searchsorted(run.t_doc, np.arange(run.n + 1))
    for (src, held, _, _), i, j, _, _ in run.pairs():
        for a in range(0, len(i), _BATCH):
            si, sj = i[a : a + _BATCH], j[a : a + _BATCH]
            at, found = np.full((len(si), k), -1), np.zeros(len(si), np.int64)
            left, entry, end = np.arange(len(si)), first[sj], first[sj + 1]
            while len(left):
                e = entry[left]
                hit = held[si[left], run.t_code[e]]
                got = left[hit]
                at[got, found[got]] = e[hit]
                found[got] += 1
                entry[left] += 1
                left = left[(found[left] < k) & (entry[left] < end[left])]
            p, r = np.nonzero(at >= 0)
            e = at[p, r]
            yield from ({**x, "term": run.dictionary.take(pa.array(x["term"]))} for x in run.batches(src[si[p]], sj[p], rank=(r + 1).astype(np.int32), term=run.t_code[e], contribution=_rounded(run.t_w[e] / run.total[sj[p]], 7)))


def _linked(run: _Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, omega, body) of links between crawled pages, by source."""
    a, b = run.at(run.links["node"]), run.at(run.links["text"])
    ok = np.flatnonzero((a >= 0) & (b >= 0))
    ok = ok[np.argsort(a[ok], kind="stable")]
    return a[ok], b[ok], run.links["w"].to_numpy()[ok], run.links["x"].to_numpy()[ok] > 0


def diagnosable(run: _Run, alpha: float = 0.1) -> Iterator[dict]:
    """Pairs whose rho may exceed ``alpha``, and links between pages with words: what a diagnosis needs. rho is 0 where they aren't related, omega -1 where there is no link."""
    a, b, omega, _ = _linked(run)
    ok = run.texts[a] & run.texts[b] & (a != b)
    a, b, omega = a[ok], b[ok], omega[ok]
    seen = np.zeros(run.n, bool)
    for src, _, m, _ in run.blocks():
        seen[src] = True
        sums = m.sum(axis=1)
        rho = m / np.where(sums > 0, sums, 1.0)[:, None]
        place = np.full(run.n, -1)
        place[src] = np.arange(len(src))
        of = place[a] >= 0
        link = np.full(m.shape, -1.0)
        link[place[a[of]], b[of]] = omega[of]
        i, j = np.nonzero((rho > alpha - 1e-8) | (link >= 0))
        yield from run.batches(src[i], j, ref=m[i, j], rho=rho[i, j], omega=link[i, j])
    rest = ~seen[a]  # linking pages that hold no term
    none = np.zeros(int(rest.sum()))
    yield from run.batches(a[rest], b[rest], ref=none, rho=none, omega=omega[rest])


def _judged(run: _Run, alpha: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(targets, donors, ref, outcome) by block; outcome is a place in OUTCOMES, -1 where the pair isn't related."""
    wanted = np.unique(run.at(run.wanted["node"]))
    wanted = wanted[wanted >= 0]
    a, b, omega, body = _linked(run)
    a, b, omega = a[body], b[body], omega[body]
    t = run.section[wanted]
    for src, _, m, _ in run.blocks():
        ref, s = m[:, wanted], run.section[src][:, None]
        out = np.where((s != t) & (s != "") & (t != ""), 1, 4).astype(np.int8)
        place = np.full(run.n, -1)
        place[src] = np.arange(len(src))
        of = place[a] >= 0
        link = np.zeros(m.shape, np.int8)
        link[place[a[of]], b[of]] = np.where(omega[of] >= alpha, 2, 3)
        link = link[:, wanted]
        out = np.where((out == 4) & (link > 0), link, out)
        out[run.utility[src]] = 0
        out[ref == 0] = -1
        yield wanted, src, ref, out


def outcomes(run: _Run, alpha: float = 0.1) -> Iterator[dict]:
    """(dst, outcome, pairs): related pairs into wanted targets by the first rule that holds."""
    counts, wanted = 0, np.zeros(0, np.int64)
    for wanted, _, _, out in _judged(run, alpha):
        counts = counts + np.stack([(out == c).sum(axis=0) for c in range(len(OUTCOMES))])
    if len(wanted):
        c, t = np.nonzero(counts)
        yield {"dst": run.names.take(pa.array(wanted[t])), "outcome": pa.array(OUTCOMES).take(pa.array(c)), "pairs": counts[c, t].astype(np.int64)}


def best(run: _Run, k: int = 30, alpha: float = 0.1) -> Iterator[dict]:
    """(src, dst, outcome, ref): of each wanted target the ``k`` admitted donors of this strip with the highest rounded REF, then the smallest name."""
    order = pc.sort_indices(run.names).to_numpy()
    last = np.empty(run.n, np.int64)
    last[order] = np.arange(run.n)[::-1]  # the smallest name has the highest
    top, wanted = None, np.zeros(0, np.int64)
    for wanted, src, ref, out in _judged(run, alpha):
        key = (half_up(ref, 7).astype(np.int64) << 33) | (last[src][:, None] << 1) | (out == 3)
        key[out < 3] = -1
        key = key if top is None else np.vstack([top, key])
        top = np.partition(key, len(key) - k, axis=0)[-k:] if len(key) > k else key
    if top is not None:
        r, t = np.nonzero(top >= 0)
        key = top[r, t]
        src = order[run.n - 1 - ((key >> 1) & 0xFFFFFFFF)]
        yield {"src": run.names.take(pa.array(src)), "dst": run.names.take(pa.array(wanted[t])), "outcome": pa.array(OUTCOMES).take(pa.array(np.where(key & 1, 3, 4))), "ref": (key >> 33) / 1e7}


def over_pairs(rows: DataFrame, what: Callable[[_Run], Iterator[dict]], schema: str, epsilon: float = 0.2) -> DataFrame:
    """(run_id, then ``schema``): what ``what`` yields for each strip of ``rows``, which :func:`run_rows` made."""
    run_type = rows.schema["run_id"].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]

    def results(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        if not pc.any(pc.equal(table["kind"], _NAME)).as_py():
            return
        run = _Run(table, epsilon)
        run_id = pa.scalar(run.run, table.schema.field("run_id").type)
        for x in what(run):
            columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in (x[c] for c in names)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.repeat(run_id, len(columns[0])), *columns], ["run_id", *names])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at = [], None
        for batch in batches:
            ids, strips = batch["run_id"].to_numpy(zero_copy_only=False), batch["strip"].to_numpy()
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (strips[1:] != strips[:-1])) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if parts and at != (ids[a], strips[a]):
                    yield from results(parts)
                    parts = []
                at = (ids[a], strips[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield from results(parts)

    return rows.mapInArrow(task, f"run_id {run_type}, {schema}")
