"""Trees: lines by their indentation, and elements with what stands above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chains import follow
from .storage import cut

#: A line of an accessibility snapshot, and the roles whose values are left out.
ITEM = r'^ *- ([A-Za-z0-9_-]+)(?: "((?:[^"\\]|\\.)*+)")?'
PRIVATE = r'(?m)^(\s*- (?:textbox|searchbox)(?: "(?:[^"\\]|\\.)*")?(?: \[[^\]]+\])?):.*$'


def sanitized_snapshot(text: Column) -> Column:
    """A snapshot without what was typed into its text boxes."""
    return F.regexp_replace(text, PRIVATE, "$1")


def snapshot_identity(text: Column) -> Column:
    """(role, name) of the first item of a snapshot."""
    first = F.get(F.filter(F.split(text, "\n", -1), lambda x: F.startswith(F.trim(x), F.lit("- "))), F.lit(0))
    return _identity(F.trim(first))


def _identity(line: Column) -> Column:
    name = F.when(F.regexp_like(line, F.lit(r'^ *- [A-Za-z0-9_-]+ "')), F.replace(F.regexp_extract(line, ITEM, 2), F.lit('\\"'), F.lit('"')))
    return F.struct(F.nullif(F.regexp_extract(line, ITEM, 1), F.lit("")).alias("role"), name.alias("name"))


def line_tree(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, indent, role, name, parent, depth_step) for the items of snapshots: parent is the nearest line before with a
    smaller indentation, null for the outermost. Texts are sanitised first.

    A line answers for every indentation of its text that is larger than its own; of the answers for an indentation the last
    one before a line counts. That is one window over (text, indentation), and no text is gathered into a row; a text costs its
    lines times its different indentations."""
    lines = texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(sanitized_snapshot(F.col(text_col)), "\n", -1)).alias("line", "told"))
    items = lines.filter(F.regexp_like("told", F.lit(r"^ *- [A-Za-z0-9_-]"))).withColumn("indent", F.length("told") - F.length(F.ltrim("told")))
    levels = items.groupBy("id").agg(F.array_sort(F.collect_set("indent")).alias("levels"))  # indentations of one text
    held = items.select("id", "line", "indent").join(levels, "id")
    answers = held.select("id", "line", F.explode(F.filter("levels", lambda v: v > F.col("indent"))).alias("level"), F.lit(False).alias("asks"))
    asked = items.select("id", "line", F.col("indent").alias("level"), F.lit(True).alias("asks"))
    before = W.partitionBy("id", "level").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    found = answers.unionByName(asked).withColumn("parent", F.last(F.when(~F.col("asks"), F.col("line")), ignorenulls=True).over(before)).filter("asks")
    rows = items.join(found.select("id", "line", "parent"), ["id", "line"])
    return rows.select("id", "line", "indent", _identity(F.col("told"))["role"].alias("role"), _identity(F.col("told"))["name"].alias("name"), "parent")


def navigation_records(elements: DataFrame) -> DataFrame:
    """(id, element, label_kind, label, destination_kind, destination, ancestors) of the links of elements (id, parent, kind,
    name, title, place, destination_kind, destination, text): a link is an a or a Link with a destination. Its label is the texts
    below it in their order, or dynamic, the expressions below it. ancestors: 'name' or 'name: title' of the elements above it
    that are no links, the outermost first. Trees of any depth are climbed by doubling, but only from what has elements below
    it; all other elements, and then the texts, take over the way of their parent."""
    link = F.col("name").isin("a", "Link") | F.endswith("name", F.lit(".Link"))
    rows = elements.withColumn("__link", (F.col("kind") == "element") & F.coalesce(link, F.lit(False)))
    told = F.concat("name", F.when(F.col("title").isNotNull(), F.concat(F.lit(": "), "title")).otherwise(F.lit("")))
    shown = (F.col("kind") == "element") & ~F.col("__link")
    rows = rows.withColumn("__step", F.struct(F.when(F.col("__link"), F.col("id")).alias("link"), F.coalesce(shown, F.lit(False)).alias("shown"), F.when(shown, told).alias("told")))
    text = F.coalesce(F.col("kind").isin("text", "dynamic"), F.lit(False))
    stems = rows.filter(~text)
    inner = _inner(stems)
    strange = inner.filter("there is null").select("node")
    if not strange.isEmpty() and not rows.filter(text).join(strange, F.col("id") == F.col("node"), "left_semi").isEmpty():
        stems, inner = rows, _inner(rows)  # there are elements below texts
    inner = inner.filter("there")
    walked = follow(inner.select("node", "next", "step"), trail="step").ended
    tops = inner.filter("next is null").select(F.col("node").alias("end"), F.col("step").alias("top"))
    ways = walked.join(tops, "end").select(F.col("node").alias("parent"), F.concat("trail", F.array("top")).alias("above"))
    held = stems.filter("parent is not null").join(ways, "parent")
    held = held.unionByName(stems.filter("parent is null").withColumn("above", F.expr("slice(array(__step), 1, 0)")))
    path = F.reverse(F.transform(F.filter("above", lambda x: x["shown"]), lambda x: x["told"]))
    links = held.filter("__link and destination is not null").select("id", F.col("name").alias("element"), "destination_kind", "destination", path.alias("ancestors"))
    around = F.filter(F.transform(F.concat(F.array("__step"), "above"), lambda x: x["link"]), lambda x: x.isNotNull())
    around = held.select(F.col("id").alias("parent"), around.alias("links")).filter(F.size("links") > 0)
    texts = rows.filter(text & F.col("parent").isNotNull()).select("parent", F.struct("place", "kind", "text").alias("part")).join(around, "parent")
    parts = texts.select("parent", F.explode("links").alias("id"), "part").groupBy("parent", "id").agg(F.collect_list("part").alias("parts"))
    labels = parts.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"))  # what is said in one link
    dynamic = F.filter("parts", lambda p: p["kind"] == "dynamic")
    kind = F.when(F.size(dynamic) > 0, F.lit("dynamic")).otherwise(F.lit("static"))
    said = F.when(F.size(dynamic) > 0, F.array_join(F.transform(dynamic, lambda p: p["text"]), ", ")).otherwise(F.coalesce(F.array_join(F.transform("parts", lambda p: p["text"]), " "), F.lit("")))
    out = links.join(labels.select("id", kind.alias("label_kind"), said.alias("label")), "id", "left")
    return out.select("id", "element", F.coalesce("label_kind", F.lit("static")).alias("label_kind"), F.coalesce("label", F.lit("")).alias("label"), "destination_kind", "destination", "ancestors")


def _inner(stems: DataFrame) -> DataFrame:
    """(node, next, step, there): the names that stand as parents, with the stem of that name where there is one; stored."""
    parents = stems.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
    return cut(parents.join(stems.select(F.col("id").alias("node"), F.col("parent").alias("next"), F.col("__step").alias("step"), F.lit(True).alias("there")), "node", "left"), "inner")
