"""Previews that repeat the code beside them in a figure.

A figure's panes are the elements directly inside it. Its first pane with a ``pre`` is its code; another pane is redundant if all its short texts stand in
the code's text, or some of them where it also has a drawing or names a host. Captions, panes with links, controls or lists, and panes without such
texts stay. A figure inside a figure has panes of its own, and its rows count for these alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pagemill.operators.content import STARTS, fits, one_of
from pagemill.operators.elements import so_far

# Elements whose own text is a segment, what makes a pane more than a preview, drawings, a host's form, and the bounds of what is compared.
SEGMENTS = ("p", "li", "div", "span")
MORE_THAN_PREVIEW = ("button", "input", "select", "textarea", "form", "video", "audio", "iframe", "table", "ul", "ol", "blockquote")
PREVIEW_DRAWINGS = ("svg", "canvas")
HOST_FORM = r"(?i)^[a-z0-9.-]+\.[a-z]{2,}$"
SEGMENT_CHARS, MOST_SEGMENTS = 60, 12


def _joined(pieces: str) -> str:
    """SQL: texts in order, as one with single spaces."""
    return f"btrim(regexp_replace(array_join(transform(array_sort({pieces}), x -> x.text), ''), '(?U)\\\\s+', ' '))"


def _sql(*expressions: str):
    return [F.expr(x) for x in expressions]


def panes(rows: DataFrame, key: str) -> DataFrame:
    """(key, figure, pane, last, name, code, more, drawn, text, segments): the panes of each figure, told by the places of their start rows.

    The rows of a page are dealt once, by its key. A row's level is the number of figures open around it; the pane of a row is the last one that began
    at its level, if it is still open, whatever inner figures ended in between.
    """
    figure, page = "name = 'figure'", f"`{key}`"
    opened = f"sum(CASE WHEN {figure} AND kind = 'start' THEN 1 WHEN {figure} AND kind = 'end' THEN -1 ELSE 0 END) OVER {so_far(key)}"
    # attributes are asked before the rows are shuffled, and stay behind; so does text that isn't compared
    weighty = f"{STARTS} AND ({one_of('name', MORE_THAN_PREVIEW)} OR (name = 'a' AND attrs['href'] IS NOT NULL)) AS weighty"
    narrow = rows.where("kind <> 'page'").selectExpr(page, "pos", "kind", "name", "CASE WHEN kind = 'text' THEN text END AS text", "node", "parent", "last", weighty)
    counted = narrow.selectExpr("*", f"{opened} + CASE WHEN {figure} AND kind = 'end' THEN 1 ELSE 0 END AS level", f"count_if({STARTS}) OVER {so_far(key)} AS n")
    at_level = f"(PARTITION BY {page}, level ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    figures = counted.where("level > 0").selectExpr("*", f"max(CASE WHEN kind = 'start' AND {figure} THEN pos END) OVER {at_level} AS figure")
    begun = figures.selectExpr("*", f"max(CASE WHEN kind = 'start' AND parent = figure THEN named_struct('pos', pos, 'last', last, 'name', name) END) OVER {at_level} AS pane")
    inside = begun.where("pane.pos > figure AND pos <= pane.last").selectExpr("*", "CASE WHEN kind IN ('text', 'data') THEN parent ELSE node END AS element")
    more = "weighty AND pos > pane.pos"
    by_element = (
        inside.groupBy(key, "figure", "pane", "element")
        .agg(*_sql("max(CASE WHEN kind = 'start' THEN name END) AS name", f"bool_or(coalesce({more}, false)) AS more", f"bool_or(coalesce({STARTS} AND pos > pane.pos AND {one_of('name', PREVIEW_DRAWINGS)}, false)) AS drawn",
                   "max(CASE WHEN kind IN ('start', 'end') THEN n END) - min(CASE WHEN kind IN ('start', 'end') THEN n END) AS held", "collect_list(CASE WHEN kind = 'text' THEN named_struct('pos', pos, 'text', text) END) AS pieces"))
        .selectExpr("*", f"CASE WHEN element <> pane.pos AND held = 0 AND {one_of('name', SEGMENTS)} THEN {_joined('pieces')} END AS segment")
    )
    by_pane = by_element.groupBy(key, "figure", "pane").agg(*_sql("bool_or(coalesce(name = 'pre', false)) AS code", "bool_or(more) AS more", "bool_or(drawn) AS drawn", "flatten(collect_list(pieces)) AS pieces", f"collect_set(CASE WHEN char_length(segment) BETWEEN 1 AND {SEGMENT_CHARS} THEN segment END) AS segments"))
    return by_pane.selectExpr(page, "figure", "pane.pos AS pane", "pane.last AS last", "pane.name AS name", "code", "more", "drawn", f"{_joined('pieces')} AS text", "segments")


def redundant(rows: DataFrame, key: str) -> DataFrame:
    """(key, pane, last): the panes that repeat the code of their figure."""
    code = f"min(CASE WHEN code THEN named_struct('pane', pane, 'text', text) END) OVER (PARTITION BY `{key}`, figure)"
    beside = panes(rows, key).selectExpr("*", f"{code} AS shown").where("shown.text <> '' AND pane <> shown.pane AND name <> 'figcaption' AND NOT more")
    told = beside.selectExpr("*", "CASE WHEN size(segments) > 0 THEN segments WHEN text <> '' THEN array(text) ELSE array() END AS parts")
    judged = told.selectExpr("*", "size(filter(parts, x -> contains(shown.text, x))) AS found").where(f"size(parts) BETWEEN 1 AND {MOST_SEGMENTS} AND NOT exists(parts, x -> char_length(x) > {SEGMENT_CHARS})")
    return judged.where(f"found = size(parts) OR (found > 0 AND (drawn OR exists(parts, x -> {fits('x', HOST_FORM)})))").select(key, "pane", "last")


def without(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``rows`` without the elements of ``found(key, pane, last)``: these join the rows as marks, so that the rows are dealt once, by their page."""
    marks = found.selectExpr(f"`{key}`", "pane AS pos", "last AS _until")
    all_rows = rows.unionByName(marks, allowMissingColumns=True)
    covered = f"coalesce(max(_until) OVER (PARTITION BY `{key}` ORDER BY pos, _until DESC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= pos, false)"
    return all_rows.selectExpr("*", f"{covered} AS _gone").where("NOT _gone AND _until IS NULL").drop("_until", "_gone")
