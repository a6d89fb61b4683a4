"""Interaction candidates, roles and accessible names of page nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import flat

# The element classes, roles and attributes of HTML and WAI-ARIA that decide results.
CONTROLS = ("a", "button", "input", "select", "textarea", "summary")
CONTEXT = ("h1", "h2", "h3", "h4", "h5", "h6", "label", "output")
IGNORED = ("script", "style", "template", "noscript")
LABELABLE = ("button", "meter", "output", "progress", "select", "textarea")
ROLES = (
    "alert alertdialog application article banner blockquote button caption cell checkbox code columnheader combobox "
    "complementary contentinfo definition deletion dialog directory document emphasis feed figure form generic grid "
    "gridcell group heading img insertion link list listbox listitem log main marquee math menu menubar menuitem "
    "menuitemcheckbox menuitemradio meter navigation none note option paragraph presentation progressbar radio "
    "radiogroup region row rowgroup rowheader scrollbar search searchbox separator slider spinbutton status strong "
    "subscript superscript switch tab table tablist tabpanel term textbox time timer toolbar tooltip tree treegrid treeitem"
).split()
NAMED_BY_CONTENT = "button cell checkbox columnheader gridcell heading link menuitem menuitemcheckbox menuitemradio option radio row rowheader switch tab tooltip treeitem".split()
NEVER_NAMED = "caption code deletion emphasis generic insertion none paragraph presentation strong subscript superscript".split()
GLOBAL_ARIA = "atomic busy controls current describedby description details disabled dropeffect errormessage flowto grabbed haspopup hidden invalid keyshortcuts label labelledby live owns relevant roledescription".split()
NATIVE = {
    "button": "button", "textarea": "textbox", "nav": "navigation", "main": "main", "aside": "complementary", "article": "article", "dialog": "dialog",
    "ul": "list", "ol": "list", "li": "listitem", "table": "table", "tr": "row", "td": "cell", "thead": "rowgroup", "tbody": "rowgroup", "tfoot": "rowgroup",
    "progress": "progressbar", "meter": "meter", "fieldset": "group", "figure": "figure", "output": "status", "option": "option", "optgroup": "group",
    "hr": "separator", "p": "paragraph", "blockquote": "blockquote", "details": "group", "summary": "button", "svg": "img",
}
INPUT_ROLES = {"button": "button", "submit": "button", "reset": "button", "image": "button", "checkbox": "checkbox", "radio": "radio", "range": "slider", "number": "spinbutton"}
SECTIONS = ("article", "aside", "main", "nav", "section")


def _lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


# The native flags and aria states of a snapshot.
STATE_FLAGS = {"disabled": "disabled", "checked": "checked", "selected": "selected", "multiple": "multiple", "required": "required", "readOnly": "readonly"}
STATE_ARIA = ("expanded", "invalid", "checked", "selected", "required", "readonly", "disabled")


def has(name: str) -> Column:
    return F.col("attrs")[name].isNotNull()


def input_type() -> Column:
    """The type of an input as a browser reads it; null for other elements."""
    return F.when(F.col("tag") == "input", F.coalesce(F.nullif(F.lower(F.col("attrs")["type"]), F.lit("")), F.lit("text")))


def labelable() -> Column:
    return F.col("tag").isin(*LABELABLE) | ((F.col("tag") == "input") & (input_type() != "hidden"))


def candidate_reasons() -> Column:
    """Why a node (tag, attrs) is a candidate, in a fixed order; ``pointer`` only where nothing else holds."""
    attrs = F.col("attrs")
    live = F.coalesce(attrs["aria-live"], F.lit("off"))
    context = F.col("tag").isin(*CONTEXT) | F.coalesce(attrs["role"].isin("alert", "status"), F.lit(False)) | (live != "off")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("tag").isin(*CONTROLS), "native-control"),
            F.when(has("role"), "role"),
            F.when(F.lower(attrs["contenteditable"]).isin("", "true", "plaintext-only"), "editable"),
            F.when(has("tabindex"), "tabindex"),
            F.when(context, "context"),
            F.when(F.col("tag") == "iframe", "frame"),
        )
    )
    pointer = F.coalesce(attrs["style"].rlike(r"(?i)(^|;)\s*cursor\s*:\s*pointer"), F.lit(False))
    none = F.array().cast("array<string>")
    return F.when(F.col("tag").isin(*IGNORED, "#text"), none).when(F.size(reasons) > 0, reasons).when(pointer, F.array(F.lit("pointer"))).otherwise(none)


def candidates(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("reasons", candidate_reasons()).where(F.size("reasons") > 0)


def implicit_role() -> Column:
    """The role that HTML gives a node (tag, attrs, ancestors); null for none."""
    tag, attrs, kind = F.col("tag"), F.col("attrs"), input_type()
    named = has("aria-label") | has("aria-labelledby") | has("title")
    bare_image = (attrs["alt"] == "") & ~named & ~has("tabindex")
    many = has("multiple") | (F.coalesce(F.regexp_extract(attrs["size"], r"^\s*(\d+)", 1).try_cast("int"), F.lit(0)) > 1)
    textual = F.when(has("list"), "combobox").when(kind == "search", "searchbox").otherwise("textbox")
    sectioned = F.exists("ancestors", lambda a: a.isin(*SECTIONS))
    return (
        F.when(tag.isin("a", "area"), F.when(has("href"), "link"))
        .when(tag.rlike("^h[1-6]$"), "heading")
        .when(tag == "img", F.when(F.coalesce(bare_image, F.lit(False)), "presentation").otherwise("img"))
        .when(tag == "select", F.when(many, "listbox").otherwise("combobox"))
        .when(tag == "input", F.when(kind.isin("email", "tel", "text", "url", "search"), textual).otherwise(_lookup(INPUT_ROLES)[kind]))
        .when(tag.isin("header", "footer"), F.when(~sectioned, F.when(tag == "header", "banner").otherwise("contentinfo")))
        .when(tag.isin("section", "form"), F.when(named, F.when(tag == "section", "region").otherwise("form")))
        .when(tag == "th", F.when(attrs["scope"].isin("row", "rowgroup"), "rowheader").otherwise("columnheader"))
        .otherwise(_lookup(NATIVE)[tag])
    )


def explicit_role() -> Column:
    """The first known token of the role attribute, unless it would hide a node that users can reach."""
    attrs, tag = F.col("attrs"), F.col("tag")
    token = F.get(F.filter(F.split(F.coalesce(attrs["role"], F.lit("")), r"[\t\n\f\r ]+"), lambda t: t.isin(*ROLES)), F.lit(0))
    control = tag.isin("button", "input", "select", "textarea", "summary") & ~has("disabled") & F.coalesce(input_type() != "hidden", F.lit(True))
    focusable = has("tabindex") | (tag.isin("a", "area") & has("href")) | control | has("contenteditable")
    aria = F.exists(F.map_keys("attrs"), lambda k: k.isin(*(f"aria-{a}" for a in GLOBAL_ARIA)))
    return F.when(token.isNotNull() & (~token.isin("none", "presentation") | (~focusable & ~aria)), token)


def with_roles(nodes: DataFrame) -> DataFrame:
    """Adds role and role_source (explicit, implicit or none) to element rows."""
    out = nodes.where("tag <> '#text'").withColumn("_e", explicit_role()).withColumn("_i", implicit_role())
    source = F.when(F.col("_e").isNotNull(), "explicit").when(F.col("_i").isNotNull(), "implicit").otherwise("none")
    return out.withColumn("role", F.coalesce("_e", "_i")).withColumn("role_source", source).drop("_e", "_i")


def element_role(role: Column, complete: Column) -> Column:
    return F.when(complete, F.coalesce(role, F.lit("generic"))).otherwise("generic")


def hides_itself() -> Column:
    """Whether a node's own attributes hide it and all below; style sheets are not known here."""
    attrs = F.col("attrs")
    style = F.coalesce(attrs["style"].rlike(r"(?i)(^|;)\s*(display\s*:\s*none|content-visibility\s*:\s*hidden)"), F.lit(False))
    return has("hidden") | F.coalesce(attrs["aria-hidden"] == "true", F.lit(False)) | style


def hidden_nodes(nodes: DataFrame) -> DataFrame:
    """``(page_id, node)`` of all nodes at or below a node that hides itself, by a join on the path."""
    hiding = nodes.where("tag <> '#text'").where(hides_itself()).select("page_id", F.col("node").alias("root"))
    return nodes.select("page_id", "node", F.explode("path").alias("root")).join(hiding, ["page_id", "root"]).select("page_id", "node").distinct()


def references(nodes: DataFrame, attribute: str = "aria-labelledby") -> DataFrame:
    """``(page_id, node, pos, id, target)``: each different id an attribute lists, in order, and the first node with it.

    target is null where the page has no such id.
    """
    listed = nodes.where(F.col("attrs")[attribute].isNotNull()).select("page_id", "context", "node", F.posexplode(F.array_distinct(F.filter(F.split(F.col("attrs")[attribute], r"[\t\n\f\r ]+"), lambda t: t != ""))).alias("pos", "id"))
    first = nodes.where(F.col("attrs")["id"].isNotNull()).groupBy("page_id", "context", F.col("attrs")["id"].alias("id")).agg(F.min("node").alias("target"))
    return listed.join(first, ["page_id", "context", "id"], "left").select("page_id", "node", "pos", "id", "target")


def label_targets(nodes: DataFrame) -> DataFrame:
    """``(page_id, target, labels)``: each labelled control and its labels in tree order."""
    labels = nodes.where("tag = 'label'")
    first = nodes.where(F.col("attrs")["id"].isNotNull()).groupBy("page_id", "context", F.col("attrs")["id"].alias("id")).agg(F.min("node").alias("target"))
    can = nodes.where(labelable()).select("page_id", F.col("node").alias("target"))
    by_id = labels.where(has("for")).select("page_id", "context", "node", F.col("attrs")["for"].alias("id")).join(first, ["page_id", "context", "id"]).select("page_id", "node", "target").join(can, ["page_id", "target"], "left_semi").select("page_id", "node", "target")
    inner = nodes.where(labelable()).select("page_id", F.col("node").alias("target"), F.explode("path").alias("node"))
    nested = labels.where(~has("for")).select("page_id", "node").join(inner, ["page_id", "node"]).groupBy("page_id", "node").agg(F.min("target").alias("target"))
    return by_id.unionByName(nested).groupBy("page_id", "target").agg(F.sort_array(F.collect_list("node")).alias("labels"))


def live_value(tag: Column, attrs: Column) -> Column:
    """The value of an input, text area or select as its attribute tells it; a password is never read."""
    kind = F.lower(F.coalesce(attrs["type"], F.lit("text")))
    return F.when(tag.isin("input", "textarea", "select") & ~((tag == "input") & (kind == "password")), F.coalesce(attrs["value"], F.lit("")))


def native_state(attrs: Column) -> Column:
    """The state flags and aria states that are set, as one map."""
    flags = F.filter(F.array(*(F.when(F.map_contains_key(attrs, a), F.struct(F.lit(k).alias("k"), F.lit("true").alias("v"))) for k, a in STATE_FLAGS.items())), lambda e: e.isNotNull())
    aria = F.filter(F.array(*(F.when(attrs[f"aria-{k}"].isNotNull(), F.struct(F.lit(f"aria-{k}").alias("k"), attrs[f"aria-{k}"].alias("v"))) for k in STATE_ARIA)), lambda e: e.isNotNull())
    return F.map_from_entries(F.concat(flags, aria))


def snapshots(nodes: DataFrame) -> DataFrame:
    """``(page_id, node, state, value, parent)`` of candidates: what a later scan is compared with; parent is an element."""
    return candidates(nodes).select("page_id", "node", native_state(F.col("attrs")).alias("state"), live_value(F.col("tag"), F.col("attrs")).alias("value"), "parent")


def snapshot_key(s: Column) -> Column:
    """One text for equal snapshots: the state's entries in order, the value and the parent."""
    state = F.array_sort(F.map_entries(s["state"]))
    return F.to_json(F.struct(state.alias("state"), s["value"].alias("value"), s["parent"].alias("parent")), {"ignoreNullFields": "false"})


def in_language_order(entries: Column) -> Column:
    """The entries of a map of texts, by their keys as an English dictionary orders them."""
    keyed = F.transform(F.map_entries(entries), lambda e: F.struct(F.collate(e["key"], "en").alias("by"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def evidence(nodes: DataFrame) -> DataFrame:
    """``(page_id, node, kind, text, attrs)``: text rows, and element rows that have attributes."""
    text = nodes.where("tag = '#text'").select("page_id", "node", F.lit("text").alias("kind"), flat(F.col("text")).alias("text"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("attrs"))
    attrs = nodes.where((F.col("tag") != "#text") & (F.size("attrs") > 0)).select("page_id", "node", F.lit("attributes").alias("kind"), F.lit(None).cast("string").alias("text"), in_language_order(F.col("attrs")).alias("attrs"))
    return text.where("text <> ''").unionByName(attrs)
