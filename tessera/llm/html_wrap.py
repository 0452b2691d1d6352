"""Main text of web pages by wrapper induction.

Pages of one host and layout (which containers stand where) are parsed into block trees and
aligned by simple tree matching. A node whose text is the same in all aligned pages is
template; what varies fills slots. The main slot is the lowest container that still holds
most of the varying text; of its parts, those that have one shape in every page and little
text or mostly links (menus, adverts) are no content either. The wrapper is this annotated
tree. Every page is then aligned with the wrapper of its layout, and the text below the node
that takes the main slot's place is its main text, without what aligns with template.

The slot is decided by alignment alone. Inside it, and on pages without a wrapper, elements
that name themselves furniture (nav, footer, aside, form, or a class such as "comments") are
left out: that is the tie-breaker for what varies from page to page but is no article.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.dom import TEXT, Page, Shapes, read_page
from tessera.operators.joins import counted_join
from tessera.session import durable

# fixed values: elements that can be a slot
CONTAINERS = frozenset("article body center div main section table tbody td tr html form".split())
HEADINGS = frozenset("h1 h2 h3".split())
_BATCH = 256


def _tag(name: str) -> str:
    return name.partition(".")[0]


def layout_of(page: Page) -> int:
    """Number of a page's layout: the names of the containers at most two levels below the body (or the root)."""
    from xxhash import xxh3_64_intdigest

    top = next((i for i, n in enumerate(page.name) if _tag(n) == "body"), 0)
    seen = set()
    for i in page.kids[top]:
        if page.name[i] != TEXT:
            seen.add(page.name[i])
            # below articles and sections the structure is the writer's, not the template's
            if _tag(page.name[i]) in ("div", "main", "table", "center", "form"):
                seen.update(f"{page.name[i]}/{page.name[k]}" for k in page.kids[i] if _tag(page.name[k]) in CONTAINERS)
    return xxh3_64_intdigest("\n".join(sorted(seen))) >> 1


class _Texts:
    """Sums over the blocks of subtrees of a page."""

    def __init__(self, page: Page):
        from xxhash import xxh3_64_intdigest

        n = len(page.name)
        self.hash, self.mass, self.links = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for node, _, _, text, linked in page.blocks:
            self.hash[node + 1], self.mass[node + 1], self.links[node + 1] = xxh3_64_intdigest(text), len(text), linked
        for sums in (self.hash, self.mass, self.links):
            for i in range(n):
                sums[i + 1] += sums[i]

    def of(self, page: Page, i: int) -> tuple[int, int, int]:
        """Text hash, characters and characters in links of the subtree of node ``i``."""
        end = i + page.size[i]
        return (self.hash[end] - self.hash[i]) % 2**64, self.mass[end] - self.mass[i], self.links[end] - self.links[i]


def induce(pages: list[str]) -> str | None:
    """The wrapper of a layout from some of its pages, as text; None if fewer than two differ or nothing varies.

    From three pages on, nodes of the same text in all of them are template; two pages can be
    copies of an article, so there only the structure counts.
    """
    trees = sorted((read_page(p) for p in sorted(set(pages))), key=lambda t: len(t.name))
    if len(trees) < 2:
        return None
    base, shapes = trees[len(trees) // 2], Shapes()
    of = {id(t): shapes.of(t) for t in trees}
    texts = {id(t): _Texts(t) for t in trees}
    n = len(base.name)
    stats = [[texts[id(base)].of(base, i)] for i in range(n)]
    forms = [{of[id(base)][i]} for i in range(n)]
    for tree in trees:
        if tree is not base:
            for i, j in shapes.pairs(base, tree, of[id(base)], of[id(tree)]):
                stats[i].append(texts[id(tree)].of(tree, j))
                forms[i].add(of[id(tree)][j])
    constant = [len(trees) > 2 and len(s) == len(trees) and len({h for h, *_ in s}) == 1 and s[0][1] > 0 for s in stats]
    mass = [sum(m - k for _, m, k in s) / len(trees) for s in stats]  # text outside links, a page
    fixed = [0.0] * n
    for i in range(n - 1, -1, -1):
        fixed[i] = mass[i] if constant[i] else sum(fixed[k] for k in base.kids[i])
    varying = [m - f for m, f in zip(mass, fixed)]
    main, top = 0, None
    while varying[main] > 0:
        if _tag(base.name[main]) in CONTAINERS:
            top = main
        inner = [k for k in base.kids[main] if varying[k] >= varying[main] / 2 and _tag(base.name[k]) in CONTAINERS]
        if not inner:
            break
        main = max(inner, key=lambda k: varying[k])
    if top is None:
        return None
    flags = [""] * n
    for i in range(n):
        if constant[i]:
            flags[i] = f"t{stats[i][0][0]:x}"
    path, at = [], top
    while at:
        at = base.parent[at]
        path.append(at)
    flags[top] = "m"
    for i in path:  # the article's own heading may stand beside its container
        for k in base.kids[i]:
            if k < top and _tag(base.name[k]) in HEADINGS and varying[k] > 0:
                flags[k] = "h"
    for i in base.kids[top]:
        seen = sum(1 for _ in stats[i]) == len(trees) and len(forms[i]) == 1
        whole, linked = sum(m for _, m, _ in stats[i]), sum(k for *_, k in stats[i])
        if seen and not flags[i] and _tag(base.name[i]) in (*CONTAINERS, "ul", "ol") and whole and (2 * linked > whole or 20 * mass[i] < varying[top]):
            flags[i] = "x"
    # inside the slot template is known by its name and text, wherever more or fewer paragraphs put it
    inside = range(top + 1, top + base.size[top])
    inner = sorted({(base.name[i], flags[i]) for i in inside if flags[i][:1] == "t" and flags[base.parent[i]][:1] != "t"})
    for i in inside:
        flags[i] = "" if flags[i][:1] == "t" else flags[i]
    kept = [False] * n
    for i in range(n - 1, -1, -1):
        kept[i] = kept[i] or i not in inside or bool(flags[i])
        if kept[i] and i:
            kept[base.parent[i]] = True
    depth = [0] * n
    rows = []
    for i in range(n):
        depth[i] = depth[base.parent[i]] + 1 if i else 0
        if kept[i]:
            rows.append([depth[i], base.name[i], flags[i][:1]])
    return json.dumps([rows, inner], ensure_ascii=False, separators=(",", ":"))


class Wrapper:
    """A wrapper as read back: its tree and the flags of its nodes."""

    def __init__(self, said: str):
        self.page, self.flags, open_at = Page(), [""], [0]
        rows, inner = json.loads(said)
        self.inner = {(name, flag) for name, flag in inner}
        for depth, name, flag in rows[1:]:
            del open_at[depth:]
            self.page.name.append(name)
            self.page.parent.append(open_at[-1])
            open_at.append(len(self.page.name) - 1)
            self.flags.append(flag)
        self.page.finish()
        self.shapes = Shapes()
        self.of = self.shapes.of(self.page)

    def places(self, page: Page) -> list[tuple[int, str]]:
        """Nodes of ``page`` that align with flagged nodes, and the flags."""
        if len(self.shapes.name) > 50_000:  # forget the shapes of earlier pages
            self.shapes = Shapes()
            self.of = self.shapes.of(self.page)
        pairs = self.shapes.pairs(self.page, page, self.of, self.shapes.of(page))
        return [(j, self.flags[i]) for i, j in pairs if self.flags[i]]


def plain_text(page: Page) -> str:
    """Without a wrapper: the blocks of articles, without those of the whole page, that stand in no furniture."""
    inside = [text for _, furniture, article, text, _ in page.blocks if article >= 0 and furniture <= article]
    return "\n".join(inside or [text for _, furniture, _, text, _ in page.blocks if furniture < 0])


def main_text(page: Page, wrapper: Wrapper | None) -> tuple[str, bool]:
    """The main text and whether a wrapper decided it."""
    places = wrapper.places(page) if wrapper else []
    main = next((j for j, flag in places if flag == "m"), None)
    if main is None:
        return plain_text(page), False
    end = main + page.size[main]
    gone = [(j, j + page.size[j]) for j, flag in places if flag == "x"]
    if wrapper.inner:
        texts, names = _Texts(page), {name for name, _ in wrapper.inner}
        gone += [(j, j + page.size[j]) for j in range(main + 1, end) if page.name[j] in names and (page.name[j], f"t{texts.of(page, j)[0]:x}") in wrapper.inner]
    dead = [0] * (len(page.name) + 1)
    for a, b in gone:
        dead[a] += 1
        dead[b] -= 1
    for i in range(1, len(dead)):
        dead[i] += dead[i - 1]
    heads = [(j, j + page.size[j]) for j, flag in places if flag == "h"]
    # furniture counts below the slot only: the slot itself may stand in a form that holds the whole page
    own = lambda node, furniture: (main <= node < end and furniture <= main) or (furniture < 0 and any(a <= node < b for a, b in heads))
    found = [text for node, furniture, _, text, _ in page.blocks if own(node, furniture) and not dead[node]]
    return ("\n".join(found), True) if found else (plain_text(page), False)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def induce_wrappers(pages: DataFrame, samples: int = 8, most_nodes: int = 4000, broadcast_rows: int = 500_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per host: host, n (its pages) and wrappers, an array of (layout, n, wrapper).

    Every page is read to find its layout. A layout's wrapper comes from up to ``samples``
    different pages of it (those of the smallest hash in as many classes), of at most ``most_nodes`` blocks
    where it has such pages; a layout of longer pages only takes its two shortest ones, whatever their length.
    So an alignment's cost hangs on a layout's pages, not on the host's size. The ids of the sample are broadcast up to ``broadcast_rows``, so pages aren't
    shuffled for it. Pages without host, id or html take no part.
    """

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(at, _BATCH)
                trees = [read_page(h) for h in rows.column(3).to_pylist()]
                found = [pa.array(map(layout_of, trees), type=pa.int64()), pa.array([len(t.name) for t in trees], type=pa.int32())]
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], *found], names=["host", "id", "h", "layout", "nodes"])

    kind = pages.schema[id_col].dataType.simpleString()
    keyed = pages.select(host_of(F.col(url_col)).alias("host"), F.col(id_col).alias("id"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    keyed = keyed.filter("host <> '' AND id IS NOT NULL AND html <> ''")
    known = durable(keyed.mapInArrow(read, f"host string, id {kind}, h bigint, layout bigint, nodes int"), "layouts")
    sizes = known.groupBy("host", "layout").agg(F.count("*").alias("n"))
    over = F.when(F.col("nodes") > most_nodes, F.col("nodes")).otherwise(0).alias("over")
    chosen = known.groupBy("host", "layout", F.pmod("h", F.lit(samples)).alias("class")).agg(F.min(F.struct(over, "h", "id")).alias("least"))
    # at most ``samples`` rows a layout
    chosen = chosen.select("host", "layout", "least.*", F.row_number().over(Window.partitionBy("host", "layout").orderBy("least")).alias("at"), F.min("least.over").over(Window.partitionBy("host", "layout")).alias("best"))
    chosen = durable(chosen.filter((F.col("over") == 0) | (F.col("best") > 0) & (F.col("at") <= 2)).select("host", "layout", "h", "id"), "sample")
    few = F.broadcast(chosen) if chosen.count() <= broadcast_rows else chosen
    # rows that repeat a sampled page are one
    sample = keyed.join(few, ["host", "id", "h"]).dropDuplicates(["host", "layout", "h"]).select("host", "layout", "html")

    def work(key, frame):
        import pandas as pd

        return pd.DataFrame({"host": [key[0]], "layout": [key[1]], "wrapper": [induce(frame["html"].tolist())]})

    made = sample.groupBy("host", "layout").applyInPandas(work, "host string, layout bigint, wrapper string").filter("wrapper IS NOT NULL")
    own = made.join(sizes, ["host", "layout"]).groupBy("host").agg(F.collect_list(F.struct("layout", "n", "wrapper")).alias("wrappers"))
    return sizes.groupBy("host").agg(F.sum("n").alias("n")).join(own, "host", "left")


def extract_pages(pages: DataFrame, wrappers: DataFrame, broadcast_bytes: int = 32_000_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_chars and wrapped (whether a wrapper decided).

    A page takes the wrapper of its layout, else its host's most frequent one. A null or
    empty page has an empty text; a page without a host, or of a host without wrappers, is
    read without one. Repeated pages give repeated rows. ``wrappers`` (a stored table) are
    broadcast up to ``broadcast_bytes``; beyond that only those of hosts with many pages
    are, and the other pages are shuffled by host.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        read: dict[str, Wrapper] = {}

        def text_of(html: str | None, known: list | None) -> tuple[str, bool]:
            if not html:
                return "", False
            page = read_page(html)
            if not known:
                return main_text(page, None)
            layout = layout_of(page)
            said = max(known, key=lambda w: (w["layout"] == layout, w["n"], w["layout"]))["wrapper"]
            if said not in read:
                if len(read) > 2000:
                    read.clear()
                read[said] = Wrapper(said)
            return main_text(page, read[said])

        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                rows = batch.slice(at, _BATCH)
                found = [text_of(h, w) for h, w in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())]
                texts = [t for t, _ in found]
                columns = [*rows.columns[:2], pa.array(texts, type=pa.string()), pa.array(map(len, texts), type=pa.int64()), pa.array([w for _, w in found])]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, url_col, "text", "n_chars", "wrapped"])

    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    size = wrappers.agg(F.sum(F.length(F.to_json("wrappers")))).first()[0] or 0
    if size <= broadcast_bytes:
        joined = keyed.join(F.broadcast(wrappers), "host", "left").select("id", "url", "html", "wrappers")
    else:
        joined = counted_join(keyed, wrappers.filter("wrappers IS NOT NULL"), ["host"], "n", 10_000, "left").select("id", "url", "html", "wrappers")
    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars bigint, wrapped boolean")
