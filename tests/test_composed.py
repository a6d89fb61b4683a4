"""Shadow roots and slots: the parser, the trees, the names over them, and the limits of names."""

from tidemark.operators import names
from tidemark.sources import pages as scan


def tree(html):
    return [(r[3] if r[3] != "#text" else r[7], r[1], r[8]) for r in scan.walk(html)]


def test_open_roots_are_rows_and_other_templates_are_not():
    html = '<x-a><template shadowrootmode="open"><p>in<li>deep</template>light</x-a><div><template>no</template><template shadowrootmode="closed"><b>no</b></template></div><x-b><template shadowrootmode="open">one</template><template shadowrootmode="open">two</template></x-b>end'
    assert tree(html) == [("x-a", None, 0), (scan.SHADOW, 0, 1), ("p", 1, 1), ("in", 2, 1), ("li", 2, 1), ("deep", 4, 1), ("light", 0, 0), ("div", None, 0), ("x-b", None, 0), (scan.SHADOW, 8, 2), ("one", 9, 2), ("end", None, 0)]
    assert tree("<input><template shadowrootmode=open><b>x</b></template>y") == [("input", None, 0), ("y", None, 0)]
    # an end tag inside a root closes nothing outside it, frames keep contexts of their own
    nested = '<x-a><template shadowrootmode=open></x-a><iframe srcdoc="<i>f</i>"></iframe></template>t</x-a>'
    assert tree(nested) == [("x-a", None, 0), (scan.SHADOW, 0, 1), ("iframe", 1, 1), ("t", 0, 0), ("i", None, 2), ("f", 4, 2)]


def named(spark, html, **limits):
    df = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    return [(r["tag"], r["name"], r["status"]) for r in names.accessible_names(scan.nodes(df), **limits).orderBy("node").collect()]


def test_names_follow_slots(spark):
    html = '<x-a><template shadowrootmode="open"><button>Go <slot name="s">none</slot>!</button><label for="k">Outer</label></template><i slot="s">to</i><i slot="other">lost</i><input id="k"></x-a>'
    found = dict((t, n) for t, n, _ in named(spark, html))
    assert found["button"] == "Go to!" and found["input"] == ""  # a label's ids are those of its own root


def test_limits_of_names_are_parameters(spark):
    assert [s for t, _, s in named(spark, f"<button>{'x' * 8000}</button>")] == ["complete"]
    assert [s for t, _, s in named(spark, f"<button>{'x' * 9000}</button>")] == ["limited"] and [s for t, _, s in named(spark, f"<button>{'x' * 9000}</button>", longest=10_000)] == ["complete"]
    many = "<button aria-labelledby=a>x</button><i id=a>A</i>" + "<b></b>" * 30 + "<a href=/>y</a>"
    assert [(t, s) for t, _, s in named(spark, many, most_nodes=20) if t != "b"] == [("button", "limited"), ("i", "complete"), ("a", "complete")]


def test_flattened_tree_and_roots(spark):
    html = '<x-a><template shadowrootmode="open"><slot name="s"><b>fallback</b></slot><slot></slot></template><i slot="s">one</i><i slot="t">two</i>three</x-a>'
    nodes = scan.nodes(spark.createDataFrame([(1, html)], "page_id bigint, html string"))
    tags = {r["node"]: r["text"] if r["tag"] == "#text" else r["tag"] for r in nodes.collect()}
    shown = {(tags[r["node"]], tags.get(r["parent"])) for r in scan.flattened(nodes).collect()}
    assert shown == {("x-a", None), ("slot", "x-a"), ("i", "slot"), ("one", "i"), ("three", "slot"), ("two", "i"), ("fallback", "b")}
    assert sorted((r["context"], r["kind"], r["host"], r["n_nodes"]) for r in scan.roots(nodes).collect()) == [(0, "document", None, 6), (1, "shadow", 0, 4)]
    assert scan.flattened(nodes.limit(0)).count() == scan.roots(nodes.limit(0)).count() == 0
