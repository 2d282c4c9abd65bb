"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a labelled path of elements, its styles are the
sequences of children it has on different pages, its contents the text blocks it holds. On ``m`` pages,

* a node's presentation is as important as the entropy, to base ``m``, of its styles;
* its content is as important as one less the mean entropy of its blocks over the pages: a block that
  stands on every page counts 0, one that stands on a single page counts 1.

A node's importance weighs both (``GAMMA``), halved if its name hints at something else than text (``HINTED``). A
branch in which no node with text reaches ``NOISE`` is cut from every page of the host. Plain paragraphs, headings,
lists and tables of an article are cut one by one: if a block's own importance, one less the
logarithm to base ``m`` of the number of pages that show it, is ``REPEATED`` at most, so that it stands on nearly all
pages of the host. Pages with the same text are one
page of the tree, and a host needs ``PAGES`` pages to be judged. What markup names as menu, header,
footer, sidebar, notice, advert, form, script or comment goes beforehand, and where articles are marked, only
they are looked at. Inside an article a name is such a verdict only if it says nothing else.

The tree is a table of counts made by partial sums; a host with a third of all pages is no hot
spot, since a task sends one row per node and block. The list of cut nodes goes to every task while
it is of proven size; beyond, it comes to the pages by a join.

Defined results: null or empty html gives an empty text. A page without a usable url is judged by its
markup alone. Repeated pages give equal results. Other columns stay.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import appended, free_names, stored
from quadrat.llm.dom import Block, Page, main_blocks, read

#: Weight of content in a node's importance, importance below which a node is noise, pages to judge a host.
GAMMA, NOISE, PAGES = 0.9, 0.25, 3
#: What a hint leaves of a node's importance, and the importance up to which a plain block is a repeated one.
HINTED, REPEATED = 0.5, 0.1
#: Cut nodes that may go to every task (about 40 bytes each).
NODES = 200_000


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def repeated_key(block: Block) -> int:
    """Stands for a plain block of a node among the nodes to cut."""
    return _hash(f"{block.chain[-1] if block.chain else 0}:{block.text}")


def _parsed(source: str | None) -> tuple[Page, list[Block]]:
    page = read(source or "")
    return page, main_blocks(page)


def page_nodes(source: str | None):
    """What a page adds to its host's tree: digest, then nodes with the nodes above them, styles, contents, and more.

    The last two are the keys of its plain blocks, and the nodes with hints. Contents are whole blocks, compared in
    lower case and with all digits alike; plain blocks are compared as they are.
    """
    page, blocks = _parsed(source)
    chains = {b.chain[:k] for b in blocks for k in range(1, len(b.chain) + 1)}
    above = [list(c) for c in sorted(chains)]
    styles = [(c[-1], _hash("|".join(s))) for c in sorted(chains) for s in sorted(page.styles.get(c, ()))]
    contents = sorted({(b.chain[-1] if b.chain else 0, _hash(re.sub(r"\d", "0", b.text.lower()))) for b in blocks})
    plain = sorted({repeated_key(b) for b in blocks if b.plain})
    hinted = sorted(page.hinted & {n for c in chains for n in c})
    return _hash("\n".join(b.text for b in blocks)), above, styles, contents, plain, hinted


def trees(pages: DataFrame, url: str, source: str) -> DataFrame:
    """One row per page: ``host, digest, above, style_of, style, content_of, content, plain, hinted``."""
    kind = pa.schema([
        ("host", pa.string()), ("digest", pa.int64()), ("above", pa.list_(pa.list_(pa.int64()))),
        *[(n, pa.list_(pa.int64())) for n in ("style_of", "style", "content_of", "content", "plain", "hinted")],
    ])

    def run(batches):
        for batch in batches:
            rows = []
            for u, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest, above, styles, contents, plain, hinted = page_nodes(s)
                sides = [[x[k] for x in part] for part in (styles, contents) for k in (0, 1)]
                rows.append((host_of(u), digest, above, *sides, plain, hinted))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    return pages.select(url, source).mapInArrow(
        run, "host string, digest long, above array<array<long>>, "
        + ", ".join(f"{c} array<long>" for c in ("style_of", "style", "content_of", "content", "plain", "hinted"))
    )


def noise(tree: DataFrame, least_pages: int = PAGES, below: float = NOISE, gamma: float = GAMMA) -> DataFrame:
    """``host, node``: nodes of branches without an important node, and keys of repeated plain blocks."""
    distinct = tree.where("host <> '' and size(content) > 0").dropDuplicates(["host", "digest"])
    distinct = stored(distinct, "site-pages")
    hosts = distinct.groupBy("host").agg(F.count("*").alias("m")).where(F.col("m") >= least_pages)

    def seen(of: str, what: str) -> DataFrame:
        """How many pages of the host show each style or block of a node."""
        pairs = distinct.select("host", F.explode(F.arrays_zip(F.col(of).alias("node"), F.col(what).alias("what"))).alias("x"))
        return pairs.groupBy("host", "x.node", "x.what").agg(F.count("*").alias("k"))

    apart = 1 - F.log("k") / F.log("m")
    content = seen("content_of", "content").join(hosts, "host")
    content = content.groupBy("host", "node").agg(F.avg(apart).alias("content"))
    style = seen("style_of", "style").join(hosts, "host")
    k = F.col("k").cast("double")
    style = style.groupBy("host", "node").agg(
        ((F.log(F.sum(k)) - F.sum(k * F.log(k)) / F.sum(k)) / F.log(F.max("m"))).alias("style")
    )
    hinted = distinct.select("host", F.explode("hinted").alias("node")).distinct().withColumn("hint", F.lit(HINTED))
    own = content.join(style, ["host", "node"], "left").join(hinted, ["host", "node"], "left")
    weight = gamma * F.col("content") + (1 - gamma) * F.coalesce("style", F.lit(0.0))
    own = own.select("host", "node", (weight * F.coalesce("hint", F.lit(1.0))).alias("weight"))
    chains = distinct.select("host", F.explode("above").alias("above")).distinct()
    chains = chains.select("host", F.element_at("above", -1).alias("node"), "above")
    branch = own.join(chains, ["host", "node"]).select("host", "weight", F.explode("above").alias("node"))
    low = branch.groupBy("host", "node").agg(F.max("weight").alias("weight")).where(F.col("weight") < below).select("host", "node")
    plain = distinct.select("host", F.explode("plain").alias("node")).groupBy("host", "node").agg(F.count("*").alias("k"))
    repeated = plain.join(hosts, "host").where(apart <= REPEATED).select("host", "node")
    return low.unionByName(repeated)


def main_text(source: str | None, cut) -> str:
    """The page's text without the branches and blocks in ``cut``."""
    _, blocks = _parsed(source)

    def stays(b: Block) -> bool:
        if b.plain:
            return repeated_key(b) not in cut
        return not any(n in cut for n in b.chain)

    return "\n".join(b.text for b in blocks if not cut or stays(b))


def extracted(df: DataFrame, url: str = "url", source: str = "html", nodes: int = NODES, text: str = "text",
              n_chars: str = "n_chars") -> DataFrame:
    """Append the main text of each page and its number of characters."""
    if clash := {c.lower() for c in df.columns} & {text.lower(), n_chars.lower()}:
        raise ValueError(f"columns exist already: {sorted(clash)}; choose other names")
    u, s, key, cut = free_names([*df.columns, text, n_chars], "page_url", "page_html", "page_key", "cut")
    rows = df.withColumns({u: F.col(f"`{url}`"), s: F.col(f"`{source}`")})
    found = stored(noise(trees(rows, u, s)), "site-noise")
    schema = f"`{text}` string, `{n_chars}` long"
    if found.count() <= nodes:
        sets: dict[str, set[int]] = {}
        for r in found.toArrow().to_pylist():
            sets.setdefault(r["host"], set()).add(r["node"])
        sent = df.sparkSession.sparkContext.broadcast(sets)

        def make(urls, sources):
            got = [
                main_text(x, sent.value.get(host_of(w)) if sent.value else None)
                for w, x in zip(urls.to_pylist(), sources.to_pylist(), strict=True)
            ]
            return [got, [len(g) for g in got]]

        return appended(rows, make, schema, [u, s], [u, s])

    rows = rows.withColumn(key, F.xxhash64(u, s))

    def nodes_of(urls, sources):
        nodes = []
        for x in sources.to_pylist():
            _, above, _, _, plain, _ = page_nodes(x)
            nodes.append([a[-1] for a in above] + plain)
        return [[host_of(w) for w in urls.to_pylist()], nodes]

    asked = appended(rows.select(u, s, key), nodes_of, "host string, nodes array<bigint>", [u, s], [u, s])
    cuts = asked.select(key, "host", F.explode("nodes").alias("node")).join(found, ["host", "node"])
    cuts = cuts.groupBy(key).agg(F.collect_set("node").alias(cut))

    def make_joined(sources, cut_lists):
        got = [main_text(x, set(c) if c else None) for x, c in zip(sources.to_pylist(), cut_lists.to_pylist(), strict=True)]
        return [got, [len(g) for g in got]]

    return appended(rows.join(cuts, key, "left"), make_joined, schema, [s, cut], [u, s, key, cut])
