"""HTML extraction: site style trees."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.checkpoint import discard, materialise
from tidemark.llm._dom import HIDDEN, _hash, identify, parse, visible_text
from tidemark.llm._frames import map_frames
from tidemark.llm._text import batches

#: Low nodes that may be sent to every worker as sorted arrays: 8 bytes each and each host's name once, so some 16 MB at most.
BROADCAST_NODES = 1_000_000
#: Pages that stand more than once on a host, in a table of hashes that may be broadcast: 24 bytes each and the host's name, so some 60 MB at most.
BROADCAST_COPIES = 1_000_000
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_COLUMNS = ["host", "node", "depth", "above", "style", "children", "feature", "n", "s"]


def _tree_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over many pages, each by its weight. A style: how many pages have it. A feature (a sentence of a leaf): n = sum of its counts c by page, s = sum of c ln c."""
    styles: dict[tuple, float] = defaultdict(float)
    features: dict[tuple, list[float]] = {}

    def flush() -> pd.DataFrame:
        rows = [(h, k, d, a, st, c, None, float(n), 0.0) for (h, k, d, a, st, c), n in styles.items()]
        rows += [(h, k, None, None, None, None, f, n, s) for (h, k, f), (n, s) in features.items()]
        styles.clear()
        features.clear()
        out = pd.DataFrame(rows, columns=_COLUMNS)
        for c in ("depth", "above", "style", "children", "feature"):
            out[c] = out[c].astype("Int64")
        return out

    for frame in batches(frames, "html", 1 << 20):
        for host, page, weight in zip(frame.host, frame.html, frame.weight):
            if not page:
                continue
            for node, depth, above in identify(parse(page)):
                if node.tag in HIDDEN:
                    continue
                styles[host, node.key, depth, above, node.style, len(node.children)] += weight
                if node.text is not None:
                    mine: dict[int, int] = defaultdict(int)
                    for sentence in _SENTENCE.split(node.text):
                        mine[_hash(sentence)] += 1
                    for f, c in mine.items():
                        sums = features.setdefault((host, node.key, f), [0.0, 0.0])
                        sums[0] += weight * c
                        sums[1] += weight * c * math.log(c)
        if len(styles) + len(features) > 100_000:
            yield flush()
    yield flush()


def _weighted(pages: DataFrame) -> DataFrame:
    """Pages with weight 1 / n where n rows of a host have the same html, so that copies count as one page."""
    spare = pages.select("host", F.xxhash64("html").alias("page"), "html")
    many = materialise(spare.groupBy("host", "page").count().where("count > 1"), "page-copies")
    few = many.count() <= BROADCAST_COPIES
    twice = many.select(F.col("host").alias("h"), F.col("page").alias("p"), "count")
    joined = spare.join(F.broadcast(twice) if few else twice, spare.host.eqNullSafe(F.col("h")) & (F.col("page") == F.col("p")), "left")
    return joined.select("host", "html", (F.lit(1.0) / F.coalesce("count", F.lit(1))).alias("weight"))


def importance(pages: DataFrame, gamma: float = 0.9, min_pages: int = 8) -> DataFrame:
    """(host, node, importance) of every node of each host's style tree; pages has host and html.

    A node with m pages has importance 1 if m = 1; else, with children, the entropy to
    base m of its styles, and without, 1 less the mean entropy to base m of its features
    over pages. A node's composite importance adds its children's: (1 - gamma^l) own +
    gamma^l sum over its l styles of their share times the mean over the style's children.
    Nodes on fewer than ``min_pages`` pages, too few to tell, have importance 1, however many pages the host has.
    Equal pages of a host count as one, so that what is copied doesn't look like furniture.

    Null or empty html gives no nodes, a null host is a host; an empty table gives an empty one; other columns play no part.
    """
    shape = "host string, node bigint, depth int, above bigint, style bigint, children int, feature bigint, n double, s double"
    raw = materialise(_weighted(pages).mapInPandas(_tree_frames, shape), "style-trees")
    styles = raw.where("style IS NOT NULL").groupBy("host", "node", "depth", "above", "style", "children").agg(F.sum("n").alias("pages"))
    own = styles.groupBy("host", "node", "depth", "above").agg(
        F.round(F.sum("pages"), 9).alias("m"), F.count("*").alias("l"), F.sum(F.col("pages") * F.ln("pages")).alias("e"), F.max("children").alias("children")
    )
    base = F.when(F.col("m") > 1, F.ln("m"))
    own = own.select("host", "node", "depth", "above", "m", "l", "children", F.coalesce((base - F.col("e") / F.col("m")) / base, F.lit(1.0)).alias("spread"))
    feature = raw.where("feature IS NOT NULL").groupBy("host", "node", "feature").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    feature = feature.groupBy("host", "node").agg(F.avg(F.ln("n") - F.col("s") / F.col("n")).alias("mean"))
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in ("host", *cols)]
    nodes = own.join(feature, same(own, feature, "node"), "left").select(own["*"], F.coalesce("mean", F.lit(0.0)).alias("mean"))
    leaf = F.when(F.col("m") > 1, 1 - F.least(F.col("mean") / F.ln("m"), F.lit(1.0))).otherwise(F.lit(1.0))
    nodes = nodes.withColumn("own", F.when(F.col("children") > 0, F.col("spread")).otherwise(leaf))
    few = F.round("m", 6) < min_pages  # weights of copies add up to about 1
    nodes = materialise(nodes.select("host", "node", "depth", "above", "l", "m", "own", few.alias("few")), "style-nodes")
    links = materialise(styles.where("children > 0").select("host", "node", "depth", "style", "children", "pages"), "styles")
    deepest = nodes.agg(F.max("depth")).first()[0]
    done, below = [], None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = nodes.where(F.col("depth") == depth)
        if below is None:
            mixed = here.withColumn("under", F.lit(None).cast("double"))
        else:  # hidden children count as nothing in a style's mean
            style = below.groupBy("host", "above").agg(F.sum("importance").alias("sum"))
            mine = links.where(F.col("depth") == depth)
            joined = mine.join(style, mine.host.eqNullSafe(style.host) & (mine.style == style.above), "left").select(mine["*"], F.coalesce("sum", F.lit(0.0)).alias("sum"))
            under = joined.groupBy("host", "node").agg((F.sum(F.col("pages") * F.col("sum") / F.col("children")) / F.sum("pages")).alias("under"))
            mixed = here.join(under, same(here, under, "node"), "left").select(here["*"], "under")
        fade = F.pow(F.lit(gamma), F.col("l"))
        value = F.when(F.col("few"), F.lit(1.0)).when(F.col("under").isNull(), F.col("own")).otherwise((1 - fade) * F.col("own") + fade * F.col("under"))
        below = materialise(mixed.select("host", "node", "above", value.alias("importance")), "importance")
        done.append(below)
    discard(raw)
    out = None
    for part in done:
        out = part if out is None else out.union(part)
    return nodes.select("host", "node", F.lit(1.0).alias("importance")) if out is None else out.select("host", "node", "importance")


def extract(pages: DataFrame, threshold: float = 0.6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **how) -> DataFrame:
    """Visible text of each page without the branches that its host's style tree finds unimportant.

    Pages of a host are merged into a style tree (see ``importance``); only sums over
    pages are shuffled. A branch goes if every node of it has an importance below
    ``threshold``. Scripts, styles, comments and the head are never text.

    Returns page_id, url, text (a line for each block), n_removed (branches) for each row.

    - null html: text null, n_removed 0. Empty html: empty text. Broken html is read as far as it goes.
    - null url, or one without a host: such pages make up one host. Null page_id: handled as any other row.
    - a branch, or a host, with fewer than min_pages different pages: nothing is removed; among fewer, pages that
      merely resemble each other can't be told from furniture. Repeated rows: each gives a row, equal pages count once.
    - elements nested deeper than 48 are put beside each other at that depth (browsers do so at 512): no text is lost. The text of a textarea, a form's content, is left out.
    - empty table: empty result. Other columns play no part, whatever their names.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    work = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    low = materialise(importance(work, **how).where(F.col("importance") < threshold).select("host", "node"), "low-nodes")
    shape = f"page_id {kind}, url string, text string, n_removed int"

    def clean(frames: Iterator[pd.DataFrame], of) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "html", 1 << 20):
            done = [(None, 0) if page is None else visible_text(parsed, gone) for page, parsed, gone in of(frame)]
            yield pd.DataFrame({"page_id": frame.id.array, "url": frame.url.array, "text": [t for t, _ in done], "n_removed": [r for _, r in done]})

    if low.count() <= BROADCAST_NODES:
        rows = low.groupBy("host").agg(F.array_sort(F.collect_list("node")).alias("nodes")).toArrow().to_pandas()
        known = pages.sparkSession.sparkContext.broadcast({h: np.asarray(v, np.int64) for h, v in zip(rows.host, rows.nodes)})
        nothing = np.zeros(0, np.int64)

        def by_host(frame: pd.DataFrame):
            for h, page in zip(frame.host, frame.html):
                root = parse(page or "")
                keys = np.fromiter((n.key for n, _, _ in identify(root)), np.int64)
                yield page, root, set(keys[np.isin(keys, known.value.get(h, nothing))].tolist())

        return map_frames(work, lambda frames: clean(frames, by_host), shape)

    # too many: each page's nodes are matched by a join, and only its own low ones come back to it
    def nodes_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "html", 1 << 20):
            rows = [(k, h, n.key) for k, h, page in zip(frame.key, frame.host, frame.html) if page for n, _, _ in identify(parse(page))]
            yield pd.DataFrame(rows, columns=["key", "host", "node"])

    keyed = work.withColumn("key", F.xxhash64("host", "html"))
    rows = keyed.select("key", "host", "html").mapInPandas(nodes_of, "key bigint, host string, node bigint")
    mine = rows.join(low, ["host", "node"], "left_semi").groupBy("key").agg(F.collect_set("node").alias("gone"))

    def by_page(frame: pd.DataFrame):
        for gone, page in zip(frame.gone, frame.html):
            root = parse(page or "")
            identify(root)
            yield page, root, frozenset() if gone is None else set(np.asarray(gone).tolist())

    return map_frames(keyed.join(mine, "key", "left"), lambda frames: clean(frames, by_page), shape)


def op9_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
