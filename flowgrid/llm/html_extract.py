"""Main text of web pages by wrapper induction.

1. Each host has up to REFERENCES reference pages (of each part of its pages by a hash of page_id, the
   least by another hash); a page's tree is its block elements, with runs of like siblings as one slot.
   References that match an earlier one of their host well are left out.
2. Each page is aligned with its host's references by simple tree matching, and votes for the one with
   the largest match: whether each matched slot's text equals the reference's, and how long it is
   outside of links.  A page that reads like the reference all over has no vote.  Votes are summed by
   (host, reference, slot).
3. A wrapper is a reference with its votes.  Slots that nearly always read the same are template.  The
   content region is made of the article and main elements if they hold at least half of all varying
   text, and else is the deepest container that holds all of it; menus, footers, forms and elements
   named as boilerplate don't count, but if nothing varies beside those that are so by name alone, the
   host's names mean nothing and are ignored.
4. Each page is aligned again; the nodes of the content region (with unmatched siblings of its kind)
   give the text, without boilerplate elements and template slots.  A page that none of the references
   fits, and hosts with too little evidence (fewer than LEAST_VOTES votes on each slot), use the
   page's own article and main elements, or else the deepest container of all its text.

Wrappers are bounded by a few pages a host.  If all of them, votes included, are within BROADCAST_BYTES
they are broadcast, else they are joined to the pages by host.

A header counts as the page's, and is left out, unless it stands in an article, main or section element.
Constant text inside an article is template as well: what at least CONSTANT of a host's pages say.

Cases: null html is empty and gives an empty text; a null url, or one without a host, makes the host
''; repeated rows get equal results; ties for a reference go to the smaller page_id; broken and cut
off markup is read as far as it goes, and nesting may be of any depth; a long page is held by one
task as a tree, several times its size, 500 rows at a time going in and out; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.llm import dom
from flowgrid.llm.common import checkpointed
from flowgrid.llm.urlfilter import host_of

BROADCAST_BYTES = 16 << 20
REFERENCES = 3
#: A later reference of a host is left out if so large a share of both trees' slots match.
SAME_KIND = 0.7
#: Pages that must have voted on a slot before it can be template, and the share that must agree.
LEAST_VOTES, CONSTANT = 8, 0.95


def _open(slots: list[dom.Slot], least: int) -> list[bool]:
    """Which slots have no mark of at least so much, on them or above them."""
    out = [True] * len(slots)
    for s in slots:  # parents before children
        out[s.index] = out[s.index] and s.mark < least
        for c in s.slots:
            out[c.index] = out[s.index]
    return out


def _sums(slots: list[dom.Slot], chars: dict[int, int], least: int) -> list[int]:
    """Characters of each slot with all that is in it, marked elements left out."""
    total = [0] * len(slots)
    for s in reversed(slots):  # children before parents
        total[s.index] = 0 if s.mark >= least else chars.get(s.index, 0) + sum(total[c.index] for c in s.slots)
    return total


def _lowest(slots: list[dom.Slot], total: list[int]) -> dom.Slot:
    """The deepest container of all that the root holds."""
    at = slots[0]
    while inner := [c for c in at.slots if c.slots and total[c.index] == total[at.index]]:
        at = inner[0]
    return at


def _stories(slots: list[dom.Slot], least: int) -> list[dom.Slot]:
    """The outermost article and main elements, in page order."""
    found, todo = [], [slots[0]]
    while todo:
        s = todo.pop()
        if s.mark >= least:
            continue
        if s.nodes[0].tag in ("article", "main"):
            found.append(s)
        else:
            todo.extend(reversed(s.slots))
    return found


class Wrapper:
    """A reference's skeleton, with what the votes say about its slots."""

    def __init__(self, root: dom.Slot, slots: list[dom.Slot], votes: dict[int, tuple[int, int, int]]):
        self.root, self.slots = root, slots
        self.texts = [s.text() for s in slots]
        self.matches: OrderedDict[bytes, list[tuple[int, int]]] = OrderedDict()
        self.template = {k for k, (n, same, _) in votes.items() if n >= LEAST_VOTES and same >= CONSTANT * n}
        varying = {k: chars for k, (_, _, chars) in votes.items() if k not in self.template}
        self.least = dom.NAMED
        total = _sums(slots, varying, self.least)
        if not total[0]:
            self.least = dom.SURE
            total = _sums(slots, varying, self.least)
        #: "stories": the article and main elements; a number: that slot; None: not known.
        self.region: str | int | None = None
        if total[0] and max((n for n, _, _ in votes.values()), default=0) >= LEAST_VOTES:
            stories = sum(total[s.index] for s in _stories(slots, self.least))
            self.region = "stories" if stories and 2 * stories >= total[0] else _lowest(slots, total).index

    def align(self, page: dom.Slot) -> list[tuple[int, int]]:
        """(reference slot, page slot) pairs; pages of one shape share them."""
        found = self.matches.get(page.shape)
        if found is None:
            found = self.matches[page.shape] = dom.simple_tree_matching(self.root, page)
            if len(self.matches) > 1000:
                self.matches.popitem(last=False)
        return found


def wrappers(refs: list[str], votes: dict[int, dict[int, tuple[int, int, int]]]) -> dict[int, Wrapper]:
    """By their numbers, the references of a host that differ enough."""
    out: dict[int, Wrapper] = {}
    for k, html in enumerate(refs):
        root = dom.skeleton(dom.parse(html))
        slots = dom.numbered(root)
        if any(2 * len(w.align(root)) >= SAME_KIND * (len(slots) + len(w.slots)) for w in out.values()):
            continue
        out[k] = Wrapper(root, slots, votes.get(k, {}))
    return out


def fitting(known: dict[int, Wrapper], page: dom.Slot) -> tuple[int | None, list[tuple[int, int]]]:
    """The number of the reference with the largest match (the first of equals), and the match."""
    best: tuple[int | None, list] = (None, [])
    for k, w in known.items():
        if len(pairs := w.align(page)) > len(best[1]):
            best = k, pairs
    return best


def main_text(html: str, known: dict[int, Wrapper]) -> str:
    """A page's text by its host's wrappers."""
    if not html:
        return ""
    page = dom.skeleton(dom.parse(html))
    slots = dom.numbered(page)
    number, matched = fitting(known, page)
    nodes, drop, least = [], set(), dom.NAMED
    if number is not None and known[number].region is not None:
        wrapper, pairs = known[number], dict(matched)
        least = wrapper.least
        if wrapper.region == "stories":
            found = _stories(slots, least)
        else:
            at = pairs.get(wrapper.region)
            kind, is_open, taken = wrapper.slots[wrapper.region].label, _open(slots, least), set(pairs.values())
            beside = next(([c for c in s.slots if c.index not in taken and c.label == kind] for s in slots if at in [c.index for c in s.slots]), [])
            found = [slots[k] for k in sorted([at, *(c.index for c in beside)]) if is_open[k]] if at is not None else []
        nodes = [n for s in found for n in s.nodes]
        for ref in wrapper.template:
            if nodes and ref in pairs and not slots[pairs[ref]].slots and slots[pairs[ref]].text() == wrapper.texts[ref]:
                drop.update(map(id, slots[pairs[ref]].nodes))
    if not nodes:
        nodes = [n for s in _stories(slots, least) for n in s.nodes]
    if not nodes:
        nodes = _lowest(slots, _sums(slots, {s.index: len(s.text().strip()) for s in slots}, least)).nodes
    skip = (lambda n: id(n) in drop) if drop else (lambda n: False)
    return "\n\n".join(b for n in nodes for b in dom.blocks(n, skip, least))


def _references(pages: DataFrame) -> DataFrame:
    """(host, refs): each host's reference pages."""
    first = F.min_by("html", F.struct(F.xxhash64("page_id"), "page_id", "html"))
    part = F.pmod(F.xxhash64(F.lit(1), "page_id"), F.lit(REFERENCES)).alias("part")
    parts = pages.where("html <> ''").groupBy("host", part).agg(first.alias("html"))
    return parts.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("part", "html"))), lambda x: x["html"]).alias("refs"))


def _small(found: DataFrame) -> bool:
    bytes_ = F.octet_length(F.array_join("refs", "")) + F.octet_length("host") + 40 * F.greatest(F.size("votes"), F.lit(0)) + 200
    return (found.agg(F.sum(bytes_)).first()[0] or 0) <= BROADCAST_BYTES


def _with_wrappers(pages: DataFrame, found: DataFrame, run, schema: str) -> DataFrame:
    """run(rows) over pages; each row is (page_id, url, host, html, its host's wrappers by number)."""
    if _small(found):
        rows = {r.host: (r.refs, r.votes) for r in found.select("host", "refs", "votes").collect()}  # within BROADCAST_BYTES
        shared = pages.sparkSession.sparkContext.broadcast(rows)
        source = pages.select("page_id", "url", "host", "html")
    else:
        shared = None
        source = pages.join(found.withColumnRenamed("host", "h"), F.col("host") == F.col("h"), "left").select("page_id", "url", "host", "html", "refs", "votes")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: OrderedDict[str, dict[int, Wrapper]] = OrderedDict()

        def known(host: str, refs, votes) -> dict[int, Wrapper]:
            if host not in made:
                by_ref: dict[int, dict[int, tuple[int, int, int]]] = {}
                for v in votes or []:
                    by_ref.setdefault(v["ref"], {})[v["slot"]] = (v["n"], v["same"], v["chars"])
                made[host] = wrappers(refs or [], by_ref)
                if len(made) > 200:
                    made.popitem(last=False)
            return made[host]

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids, urls, hosts, pages_html = (c.to_pylist() for c in part.columns[:4])
                if shared:
                    sets = [known(h, *shared.value.get(h, (None, None))) for h in hosts]
                else:  # only a host's first row is turned into Python values
                    sets = [made[h] if h in made else known(h, part.column(4)[i].as_py(), part.column(5)[i].as_py()) for i, h in enumerate(hosts)]
                yield from run(list(zip(ids, urls, hosts, pages_html, sets, strict=True)))

    return source.mapInArrow(work, schema)


def induce(pages: DataFrame) -> DataFrame:
    """(host, refs, votes) of every host; pages has page_id, url, host, html."""
    no_votes = F.expr("cast(null as array<struct<ref:int,slot:int,n:bigint,same:bigint,chars:bigint>>)")
    refs = checkpointed(_references(pages).withColumn("votes", no_votes))

    def vote(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int, int], list[int]] = {}
        for _, _, host, html, known in rows:
            if not known or not html:
                continue
            page = dom.skeleton(dom.parse(html))
            slots = dom.numbered(page)
            number, pairs = fitting(known, page)
            if number is None:
                continue
            wrapper, is_open = known[number], _open(slots, dom.SURE)
            equal = [slots[own].text() == wrapper.texts[ref] for ref, own in pairs]
            if all(same for same, (_, own) in zip(equal, pairs, strict=True) if is_open[own]) and len(pairs) == len(slots) == len(wrapper.slots):
                continue  # a copy of the reference says nothing of what varies
            for same, (ref, own) in zip(equal, pairs, strict=True):
                at = sums.setdefault((host, number, ref), [0, 0, 0])
                at[0] += 1
                at[1] += same
                at[2] += slots[own].plain()
        keys = list(sums)
        cols = [*([k[j] for k in keys] for j in range(3)), *([sums[k][j] for k in keys] for j in range(3))]
        types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = ["host", "ref", "slot", "n", "same", "chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    votes = _with_wrappers(pages, refs, vote, "host string, ref int, slot int, n long, same long, chars long")
    sums = votes.groupBy("host", "ref", "slot").agg(*[F.sum(c).alias(c) for c in ("n", "same", "chars")])
    entry = F.struct("ref", "slot", "n", "same", "chars")
    by_host = sums.groupBy(F.col("host").alias("h")).agg(F.collect_list(entry).alias("found"))  # as many as the references have slots
    out = refs.drop("votes").join(by_host, F.col("host") == F.col("h"), "left").select("host", "refs", F.col("found").alias("votes"))
    return checkpointed(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    host = F.coalesce(host_of(F.col("url")), F.lit("")).alias("host")
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host, F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def texts(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = [main_text(html, known) for _, _, _, html, known in rows]
        cols = ([r[0] for r in rows], pa.int64()), ([r[1] for r in rows], pa.string()), (out, pa.string()), (list(map(len, out)), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in cols], names=["page_id", "url", "text", "n_chars"])

    return _with_wrappers(read, induce(read), texts, "page_id long, url string, text string, n_chars long")
