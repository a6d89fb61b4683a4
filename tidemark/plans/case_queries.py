"""Queries over what the table's pages lack: every page is dealt one of some small pages, with words of its title in it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import sanitize_label
from tidemark.operators import names, semantics, snapshots
from tidemark.sources import pages as scan
from tidemark.sources.inline import common_table, dealt, dealt_table, frame
from tidemark.sources.tables import table

# (page, html, tag of the element told of, role, name, source, description, source, fallback)
NAMED = [
    (1, "<b id=x>One</b><b id=y>Two</b><button aria-labelledby='y x y nope'>no</button>", "button", "button", "Two One", "aria-labelledby", "", "none", None),
    (2, "<b id=x></b><button aria-labelledby=x aria-label=Label>text</button>", "button", "button", "", "aria-labelledby", "", "none", None),
    (3, "<button aria-labelledby=nope>text</button>", "button", "button", "text", "contents", "", "none", None),
    (4, "<button aria-label=' Go  now '>no</button>", "button", "button", "Go now", "aria-label", "", "none", None),
    (5, "<label for=q>Find</label><label for=q>it</label><input id=q placeholder=p>", "input", "textbox", "Find it", "label", "", "none", None),
    (6, "<label>Mail <input></label>", "input", "textbox", "Mail", "label", "", "none", None),
    (7, "<label>Flash <input type=checkbox id=t> the screen <input value=3 aria-hidden=true> times</label>", "input", "checkbox", "Flash the screen times", "label", "", "none", None),
    (8, "<img alt='A  tree'>", "img", "img", "A tree", "alt", "", "none", None),
    (9, "<img alt='' title=Tip>", "img", "img", "", "alt", "Tip", "title", None),
    (10, "<input type=submit>", "input", "button", "Submit", "native", "", "none", None),
    (11, "<input type=reset value=''>", "input", "button", "", "native", "", "none", None),
    (12, "<input type=image>", "input", "button", "Submit Query", "native", "", "none", None),
    (13, "<a href=/x>Read <i>more</i><div>now</div></a>", "a", "link", "Read more now", "contents", "", "none", None),
    (14, "<a href=/x title=Tip></a>", "a", "link", "Tip", "title", "", "none", None),
    (15, "<button aria-hidden=true>x</button>", "button", "button", "", "none", "", "none", None),
    (16, "<fieldset><legend>Card <b>data</b></legend><input></fieldset>", "fieldset", "group", "Card data", "native", "", "none", None),
    (17, "<button>Pay <input value=20> now</button>", "button", "button", "Pay 20 now", "contents", "", "none", None),
    (18, "<button>Secret <input type=password value=hunter> x</button>", "button", "button", "Secret x", "contents", "", "none", None),
    (19, "<button>Pick <select><option>a<option selected>b</select></button>", "button", "button", "Pick b", "contents", "", "none", None),
    (20, "<b id=d>More</b><button aria-describedby='d' title=Tip>Go</button>", "button", "button", "Go", "contents", "More", "aria-describedby", None),
    (21, "<button aria-description='  told  ' title=Tip>Go</button>", "button", "button", "Go", "contents", "told", "aria-description", None),
    (22, "<button title=Tip>Go</button>", "button", "button", "Go", "contents", "Tip", "title", None),
    (23, "<input placeholder=' Your name '>", "input", "textbox", "", "none", "", "none", "Your name"),
    (24, "<button><span style='display:none'>no</span>yes</button>", "button", "button", "yes", "contents", "", "none", None),
    (25, "<div hidden><b id=x>Kept <i hidden>all</i></b></div><button aria-labelledby=x>n</button>", "button", "button", "Kept all", "aria-labelledby", "", "none", None),
    (26, "<p aria-label=no>text</p>", "p", "paragraph", "", "none", "", "none", None),
    (27, "<iframe srcdoc='<b id=x>Inner</b>'></iframe><button aria-labelledby=x>Outer</button>", "button", "button", "Outer", "contents", "", "none", None),
    (28, "<div hidden><button>x</button></div>", "button", "button", "", "none", "", "none", None),
    (29, "<button>a<br>b<script>c</script></button>", "button", "button", "a b", "contents", "", "none", None),
    (30, "<table><caption>Sums</caption><tr><td>1</td></tr></table>", "table", "table", "Sums", "native", "", "none", None),
    (31, "<div>" * 200 + "<button>deep</button>" + "</div>" * 200, "button", None, "", "none", "", "none", None),
]

# (page, html, role, its source) of each page's first element, and of its last.
ROLED = [
    (1, "<a>x</a>", None, "none"), (2, "<a href=/x>x</a>", "link", "implicit"), (3, "<h3>x</h3>", "heading", "implicit"), (4, "<img alt=''>", "presentation", "implicit"), (5, "<img>", "img", "implicit"), (6, "<img alt='' title=t>", "img", "implicit"), (7, "<select></select>", "combobox", "implicit"),
    (8, "<select multiple></select>", "listbox", "implicit"), (9, "<select size=3></select>", "listbox", "implicit"), (10, "<input type=search>", "searchbox", "implicit"), (11, "<input list=x>", "combobox", "implicit"), (12, "<input type=number>", "spinbutton", "implicit"), (13, "<input type=range>", "slider", "implicit"),
    (14, "<input type=checkbox>", "checkbox", "implicit"), (15, "<input type=hidden>", None, "none"), (16, "<section>x</section>", None, "none"), (17, "<section aria-label=x>x</section>", "region", "implicit"), (18, "<form title=t></form>", "form", "implicit"), (19, "<th scope=row>x</th>", "rowheader", "implicit"),
    (20, "<th>x</th>", "columnheader", "implicit"), (21, "<header>x</header>", "banner", "implicit"), (22, "<article><header>x</header></article>", None, "none"), (23, "<div role='foo button'>x</div>", "button", "explicit"), (24, "<button role=none>x</button>", "button", "implicit"), (25, "<div role=none>x</div>", "none", "explicit"),
    (26, "<div role=presentation aria-label=x>x</div>", None, "none"), (27, "<textarea></textarea>", "textbox", "implicit"), (28, "<nav>x</nav>", "navigation", "implicit"), (29, "<input type=submit>", "button", "implicit"), (30, "<li role=option>x</li>", "option", "explicit"),
]
# (page, html, reasons of its last element)
REASONED = [
    (1, "<button>x</button>", "native-control"), (2, "<div role=alert>x</div>", "role,context"), (3, "<div contenteditable>x</div>", "editable"), (4, "<div contenteditable=false>x</div>", None), (5, "<div tabindex=-1>x</div>", "tabindex"), (6, "<h2>x</h2>", "context"), (7, "<p aria-live=polite>x</p>", "context"), (8, "<p aria-live=off>x</p>", None),
    (9, "<iframe></iframe>", "frame"), (10, "<div style='color:red; cursor: pointer'>x</div>", "pointer"), (11, "<a style='cursor:pointer'>x</a>", "native-control"), (12, "<summary tabindex=0 role=button>x</summary>", "native-control,role,tabindex"), (13, "<div>x</div>", None), (14, "<template><button>x</button></template>", None), (15, "<div contenteditable=PLAINTEXT-ONLY>x</div>", "editable"),
]

# Elements, frames, ids, labels and hidden parts of small pages.
PAGES = [
    (1, "<div id=a><p id=b>one</p><p>two</p></div><p class=c aria-live=polite>three</p>"),
    (2, "<label for=q>L1</label><label>L2 <button>b</button></label><input id=q type=hidden><input id=q2><i aria-labelledby='q2 none q2 q'>t</i>"),
    (3, "<iframe srcdoc='<a href=/x>in</a>'></iframe><iframe></iframe><iframe src=/y></iframe>"),
    (4, "<div style='display: none'><p>a<b>b</b></p></div><p aria-hidden=true>c</p><p>d</p>"),
    (5, "<input type=checkbox checked aria-expanded=true value=v><input type=password value=s required><select multiple value=z></select><span tabindex=0>x</span><div contenteditable>e</div>"),
    (6, ""),
]
PAGE = "page_id bigint, html string"
PAGES = [(p, h.replace(">one<", ">{t}<").replace(">L1<", ">{t}<")) for p, h in PAGES]

#: A page's title as plain words, in both engines; the pattern of all replacements is global in one of them by default.
_TITLE = "coalesce(nullif(trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '[^A-Za-z0-9]+', ' '{})), ''), 'x')"


def _titled(row: tuple) -> tuple:
    """A case whose told name has a word that stands once in its page: the title takes the word's place in both."""
    for word in sorted(re.findall(r"\b[A-Za-z]{2,}\b", row[4]), key=len, reverse=True):
        if len(re.findall(rf"(?<!=)\b{word}\b", row[1])) == len(re.findall(word, row[1])) == row[4].count(word) == 1:
            return (row[0], re.sub(rf"\b{word}\b", "{t}", row[1]), *row[2:4], row[4].replace(word, "{t}"), *row[5:])
    return row


NAMED = [_titled(r) for r in NAMED]


def _case(n: int):
    return F.col("page_id") % n + 1


def _dealt_pages(spark, sf_dir, rows: list[tuple], ddl: str = PAGE) -> DataFrame:
    """Every page of the table with one of the listed ones in place of its html, in turn."""
    cases = frame(spark, ddl, rows).withColumnsRenamed({"page_id": "case_no", "html": "listed"})
    told = table(spark, sf_dir, "pages").select("page_id", F.expr(_TITLE.format("")).alias("t"))
    both = told.join(F.broadcast(cases), _case(len(rows)) == F.col("case_no"))
    return both.withColumn("html", F.expr("replace(listed, '{t}', t)")).drop("listed", "t")


def _by_case(spark, sf_dir, ddl: str, rows: list[tuple]) -> DataFrame:
    """Rows listed for a case (``page_id``) as rows of every page that was dealt it."""
    cases = frame(spark, ddl, rows).withColumnRenamed("page_id", "case_no")
    told = table(spark, sf_dir, "pages").select("page_id", _case(len(PAGES)).alias("case_no"))
    return told.join(F.broadcast(cases), "case_no").drop("case_no")


def _nodes(spark, sf_dir):
    return scan.nodes(_dealt_pages(spark, sf_dir, PAGES))


def name_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names, descriptions and fallbacks of one element of each page."""
    pages = _dealt_pages(spark, sf_dir, [r[:3] for r in NAMED], "page_id bigint, html string, tag string")
    found = names.accessible_names(scan.nodes(pages)).join(pages.select("page_id", F.col("tag").alias("wanted")), "page_id").where("tag = wanted")
    first = found.groupBy("page_id").agg(F.min_by(F.struct(*(c for c in names.NAME.names if c not in ("page_id", "node", "tag"))), "node").alias("r")).select("page_id", "r.*")
    return first.select("page_id", "role", "name", "name_source", "description", "description_source", "fallback", "status")


# (id, label, what is shown)
LABELS = [(1, "a\u202eb\u200bc", "a b c"), (2, "x" * 121, "x" * 119 + "…"), (3, "😀" * 60 + "y", "😀" * 60 + "y…"), (4, "\u00a0 a\u3000b\t", "a b"), (5, "a\u00adb", "a\u00adb"), (6, "é" * 120, "é" * 120), (7, "\u2066\ufeff", ""), (8, "😀" * 200, "😀" * 119 + "…"), (9, "a\u2028b\u0085c", "a b c")]


def label_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with bidi, zero-width and wide characters as they are shown."""
    return dealt(table(spark, sf_dir, "events"), "id bigint, label string", [r[:2] for r in LABELS]).select("id", sanitize_label(F.col("label")).alias("shown"))


def role_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of the last element of each page, and where it comes from."""
    found = semantics.with_roles(scan.nodes(_dealt_pages(spark, sf_dir, [r[:2] for r in ROLED])))
    last = found.groupBy("page_id").agg(F.max_by(F.struct("role", "role_source"), "node").alias("r"))
    return last.select("page_id", "r.role", F.col("r.role_source").alias("source"))


def reason_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why elements are candidates: pages without any don't come out."""
    found = semantics.candidates(scan.nodes(_dealt_pages(spark, sf_dir, [r[:2] for r in REASONED])))
    return found.groupBy("page_id").agg(F.max(F.array_join("reasons", ",")).alias("reasons"))


def page_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes are at or below the first element of each page."""
    roots = table(spark, sf_dir, "pages").select("page_id", F.lit(0).alias("root"))
    return scan.subtree(_nodes(spark, sf_dir), roots).groupBy("page_id").agg(F.count("*").alias("n"))


def covering_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of some roots those that no other contains."""
    roots = _by_case(spark, sf_dir, "page_id bigint, root int", [(1, 0), (1, 1), (1, 5), (4, 1), (4, 3)])
    return scan.covering(roots, _nodes(spark, sf_dir)).select("page_id", F.col("root").cast("bigint").alias("root"))


def frame_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.frames(_nodes(spark, sf_dir)).groupBy("page_id", "access").agg(F.count("*").alias("n"))


def node_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts and sorted attributes of the first two pages."""
    e = semantics.evidence(_nodes(spark, sf_dir).where(_case(len(PAGES)) < 3))
    shown = F.array_join(F.transform("attrs", lambda a: F.concat(a["key"], F.lit("="), a["value"])), ";")
    return e.select("page_id", F.col("node").cast("bigint").alias("node"), "kind", F.coalesce("text", shown).alias("told"))


def id_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = semantics.references(_nodes(spark, sf_dir))
    return r.select("page_id", F.col("pos").cast("bigint").alias("pos"), "id", F.col("target").isNotNull().alias("found"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _nodes(spark, sf_dir)
    t = semantics.label_targets(n).join(n.select("page_id", F.col("node").alias("target"), "tag"), ["page_id", "target"])
    return t.select("page_id", "tag", F.size("labels").cast("bigint").alias("n_labels"))


def hidden_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantics.hidden_nodes(_nodes(spark, sf_dir)).groupBy("page_id").agg(F.count("*").alias("n"))


def candidate_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, value and key of the candidates of one page, and why each is one; a password's value is never read."""
    n = _nodes(spark, sf_dir).where(_case(len(PAGES)) == 5)
    s = semantics.snapshots(n).join(semantics.candidates(n).select("page_id", "node", "tag", F.array_join("reasons", ",").alias("reasons"), semantics.labelable().alias("labelable")), ["page_id", "node"])
    state = F.array_join(F.transform(F.array_sort(F.map_entries("state")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return s.select(F.col("node").cast("bigint").alias("node"), "tag", "reasons", F.coalesce("labelable", F.lit(False)).alias("labelable"), state.alias("state"), "value", F.length(semantics.snapshot_key(F.struct("state", "value", "parent"))).cast("bigint").alias("key_length"))


def dirty_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached nodes that a changed node contains or on which they depend."""
    cached = _by_case(spark, sf_dir, "page_id bigint, node int, path array<int>, depends_on array<int>", [(1, 1, [0, 1], None), (1, 3, [0, 3], [5]), (1, 5, [5], None), (2, 4, [4], [9]), (2, 9, [9], [])])
    dirty = _by_case(spark, sf_dir, "page_id bigint, root int", [(1, 5), (2, 4), (3, 0)])
    return snapshots.affected(cached, dirty).select("page_id", F.col("node").cast("bigint").alias("node"))


def element_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role that each page's elements go by: generic where they have none."""
    r = semantics.with_roles(_nodes(spark, sf_dir)).select("page_id", semantics.element_role(F.col("role"), _case(len(PAGES)) != 4).alias("role"))
    return r.groupBy("page_id", "role").agg(F.count("*").alias("n"))


def _rows(ddl: str, rows: list[tuple], cases: int = len(PAGES), named: bool = True) -> str:
    """What must come out for each case, for every page that is dealt it, with the page's title in it."""
    columns = [tuple(c.strip().split(" ", 1)) for c in ddl.split(",")]
    told = ", ".join(f"replace({c}, '{{t}}', t) as {c}" if k == "string" else c for c, k in columns if c != "page_id")
    number = "p.page_id, " if named else ""
    return f"with {common_table('r', ddl, rows)}, p as (select page_id, {_TITLE.format(', ' + chr(39) + 'g' + chr(39))} as t from pages) select {number}{told} from p join r on r.page_id = p.page_id % {cases} + 1"


SQL = {
    "name_cases": _rows(
        "page_id bigint, role string, name string, name_source string, description string, description_source string, fallback string, status string",
        [(r[0], *r[3:], "complete" if r[3] else "limited") for r in NAMED],
        len(NAMED),
    ),
    "label_cases": f"with {dealt_table('r', 'id bigint, shown string', [(i, shown) for i, _, shown in LABELS])} select id, shown from r",
    "role_cases": _rows("page_id bigint, role string, source string", [(i, role, source) for i, _, role, source in ROLED], len(ROLED)),
    "reason_cases": _rows("page_id bigint, reasons string", [(i, why) for i, _, why in REASONED if why], len(REASONED)),
    "page_subtrees": _rows("page_id bigint, n bigint", [(1, 5), (2, 2), (3, 1), (4, 5), (5, 1)]),
    "covering_roots": _rows("page_id bigint, root bigint", [(1, 0), (1, 5), (4, 1)]),
    "frame_access": _rows("page_id bigint, access string, n bigint", [(3, "same-origin", 1), (3, "unloaded", 1), (3, "opaque", 1)]),
    "node_evidence": _rows(
        "page_id bigint, node bigint, kind string, told string",
        [(1, 0, "attributes", "id=a"), (1, 1, "attributes", "id=b"), (1, 2, "text", "{t}"), (1, 4, "text", "two"), (1, 5, "attributes", "aria-live=polite;class=c"), (1, 6, "text", "three"),
         (2, 0, "attributes", "for=q"), (2, 1, "text", "{t}"), (2, 3, "text", "L2"), (2, 5, "text", "b"), (2, 6, "attributes", "id=q;type=hidden"), (2, 7, "attributes", "id=q2"), (2, 8, "attributes", "aria-labelledby=q2 none q2 q"), (2, 9, "text", "t")],
    ),
    "id_references": _rows("page_id bigint, pos bigint, id string, found boolean", [(2, 0, "q2", True), (2, 1, "none", False), (2, 2, "q", True)]),
    "label_counts": _rows("page_id bigint, tag string, n_labels bigint", [(2, "button", 1)]),
    "hidden_counts": _rows("page_id bigint, n bigint", [(4, 7)]),
    "candidate_snapshots": _rows(
        "page_id bigint, node bigint, tag string, reasons string, labelable boolean, state string, value string, key_length bigint",
        [(5, 0, "input", "native-control", True, "aria-expanded=true;checked=true", "v", 109), (5, 1, "input", "native-control", True, "required=true", None, 72), (5, 2, "select", "native-control", True, "multiple=true", "z", 71),
         (5, 3, "span", "tabindex", False, "", None, 39), (5, 5, "div", "editable", False, "", None, 39)],
        named=False,
    ),
    "dirty_dependents": _rows("page_id bigint, node bigint", [(1, 3), (1, 5), (2, 4)]),
    "element_roles": _rows(
        "page_id bigint, role string, n bigint",
        [(1, "generic", 1), (1, "paragraph", 3), (2, "generic", 4), (2, "button", 1), (2, "textbox", 1), (3, "generic", 3), (3, "link", 1), (4, "generic", 5), (5, "checkbox", 1), (5, "generic", 3), (5, "listbox", 1)],
    ),
}

QUERIES = {name: globals()[name] for name in SQL}
