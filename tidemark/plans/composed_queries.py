"""Pages with shadow roots and slots: the pages of the table, each with a component made from its own title."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import names
from tidemark.sources import pages as scan
from tidemark.sources.tables import table

# Expressions of both engines: a page's title as plain words, a word of its own, and one of eight components with these two in it.
_TITLE = "trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '[^A-Za-z0-9]+', ' '{}))"
_WORD = "'p' || cast(page_id as varchar(20))"
_PARTS = [
    ('<x-a><template shadowrootmode="open"><button><slot name="t">Fallback</slot> <slot></slot></button></template><span slot="t">', "t", "</span>", "w", "</x-a>"),
    ('<x-a><template shadowrootmode="open"><button><slot name="t">Fallback</slot><slot></slot></button></template></x-a>',),
    ('<x-a><template shadowrootmode="closed"><button>closed</button></template><button>', "t", "</button></x-a>"),
    ('<x-a><template shadowrootmode="open"><x-b><template shadowrootmode="open"><a href="/x"><slot></slot></a></template><slot></slot></x-b></template>', "t", "</x-a>"),
    ('<section><template shadowrootmode="open"><button><slot hidden></slot>', "w", "</button></template>", "t", "</section>"),
    ('<div><template shadowrootmode="open"><button><slot name="t"></slot></button><button><slot name="t">second</slot></button></template><b slot="t">', "t", "</b></div>"),
    ('<x-a><template shadowrootmode="open"><button aria-labelledby="k">own</button><i id="k">inner ', "w", '</i></template><i id="k">', "t", '</i><button aria-labelledby="k">x</button></x-a>'),
    ('<ul><li><template shadowrootmode="open"><button>no</button></template><button>', "t", " ", "w", "</button></li></ul>"),
]
_SNIPPET = "case page_id % 8 " + " ".join(f"when {k} then " + " || ".join(p if i % 2 else f"'{p}'" for i, p in enumerate(parts)) for k, parts in enumerate(_PARTS)) + " end"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "pages").select("page_id", "html", F.expr(_TITLE.format("")).alias("t"), F.expr(_WORD).alias("w"))
    return told.select("page_id", "html", F.expr(_SNIPPET).alias("snippet"))


def composed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the components' buttons and links, over slots and shadow roots."""
    nodes = scan.nodes(_components(spark, sf_dir).select("page_id", F.col("snippet").alias("html")))
    return names.in_order(nodes, **names.UNBOUNDED).where("role in ('button', 'link')").select("page_id", "role", "name", "name_source")


def composed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buttons and links of every page and its component, by the kind of root that they stand in."""
    nodes = scan.nodes(_components(spark, sf_dir).select("page_id", F.concat("html", "snippet").alias("html")))
    found = nodes.where("tag in ('a', 'button')").join(scan.roots(nodes).select("page_id", "context", "kind"), ["page_id", "context"])
    return found.groupBy("page_id", "kind").agg(F.count("*").alias("n"))


def slot_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the components show where: each slot's number of assigned nodes and the length of their text."""
    nodes = scan.nodes(_components(spark, sf_dir).select("page_id", F.col("snippet").alias("html")))
    shown = scan.flattened(nodes)
    text = nodes.where("tag = '#text'").select("page_id", "node", F.trim("text").alias("text"))
    slots = nodes.where("tag = 'slot'").select("page_id", F.col("node").alias("parent"))
    below = shown.join(slots, ["page_id", "parent"])
    # an assigned element's text stands one level below it
    deeper = below.join(shown.select("page_id", F.col("node").alias("inner"), F.col("parent").alias("node")), ["page_id", "node"]).select("page_id", F.col("inner").alias("node"))
    found = below.select("page_id", "node").unionByName(deeper).distinct().join(text, ["page_id", "node"])
    return found.groupBy("page_id").agg(F.count("*").alias("n_texts"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


_PAGES = f"p as (select page_id, html, {_TITLE.format(', ' + chr(39) + 'g' + chr(39))} as t, {_WORD} as w, page_id % 8 as v from pages)"
_STRIPPED = "regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style|template|noscript)\\b[^>]*>.*?</(script|style|template|noscript)\\s*>', '', 'g')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"composed_names": composed_names, "composed_candidates": composed_candidates, "slot_assignments": slot_assignments}

SQL = {
    "composed_names": f"""
        with {_PAGES}, n as (
            select page_id, 'button' as role, trim(t || ' ' || w) as name, 'contents' as name_source from p where v in (0, 7)
            union all select page_id, 'button', 'Fallback', 'contents' from p where v = 1
            union all select page_id, case v when 3 then 'link' else 'button' end, t, 'contents' from p where v in (2, 3)
            union all select page_id, 'button', w, 'contents' from p where v = 4
            union all select page_id, 'button', unnest([t, 'second']), 'contents' from p where v = 5
            union all select page_id, 'button', unnest(['inner ' || w, t]), 'aria-labelledby' from p where v = 6)
        select page_id, role, name, case when name = '' and name_source = 'contents' then 'none' else name_source end as name_source from n""",
    "composed_candidates": f"""
        with {_PAGES}, own as (select page_id, 'document' as kind, len(regexp_extract_all({_STRIPPED}, '(?i)<(a|button)\\b')) + case when v in (2, 6, 7) then 1 else 0 end as n from p),
        shadow as (select page_id, 'shadow' as kind, case when v = 5 then 2 else 1 end as n from p where v not in (2, 7))
        select page_id, kind, n::bigint as n from (select * from own union all select * from shadow) where n > 0""",
    "slot_assignments": f"""
        with {_PAGES}, shown as (
            select page_id, unnest([t, w]) as text from p where v = 0 union all select page_id, 'Fallback' from p where v = 1 union all
            select page_id, t from p where v in (3, 4) union all select page_id, unnest([t, 'second']) from p where v = 5)
        select page_id, count(*) as n_texts, sum(length(text))::bigint as n_chars from shown where text <> '' group by page_id""",
}
