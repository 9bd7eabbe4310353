"""What of a page is content: noise removal, regions and content scores over the rows of ``elements``.

All steps keep the page's key as the only shuffle: an element is judged by its own row and the counts of what it holds, and what it covers is a running
maximum over the page, so elements are removed, protected and chosen at any depth. Conditions are SQL text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pagemill.operators.elements import BLOCKS, covered, so_far

# Elements without content of their own, and roles, states and words that mark navigation, widgets and promotion.
STRUCTURAL = ("script", "style", "noscript", "iframe", "object", "template", "form", "button", "input", "select", "textarea")
DRAWINGS = ("svg", "canvas")
HEAD = ("head", "title", "meta", "link", "base")
NAVIGATION_ROLES = ("navigation", "banner", "complementary", "contentinfo", "tree", "menubar", "menu", "dialog", "alertdialog", "search")
WIDGET_ROLES = ("tabpanel", "tab", "tablist", "dialog", "alertdialog", "menu", "menuitem", "option", "listbox", "combobox", "tooltip", "alert")
PROMOTION = ("banner", "promo", "announcement", "cta", "advert", "ads", "sponsor", "recommend", "breadcrumb", "breadcrumbs", "taglist", "twitter-tweet", "fb-post", "instagram-media", "social-embed", "author-bio", "byline", "sharedaddy", "sharing")
PROMOTION_BESIDE_CONTENT = ("ad", "related", "comment")
PROMOTION_OF = {
    "cookie-banners": ("cookie", "consent", "popup", "modal", "overlay", "toast"), "newsletters": ("newsletter", "subscribe"), "social-share": ("share", "social", "share-button"),
    "author-blocks": ("author-bio", "byline", "author-info", "writer-profile"), "related-content": ("related-post", "related-article", "more-stories", "recommended-posts"), "nav-footer": (),
}
CONTROL_CLASSES = ("content-icon-container", "edit-this-page", "toc-overlay-icon", "theme-toggle-container", "sidebar-toggle", "sidebar-drawer", "toc-drawer", "mobile-header", "sidebar-overlay", "toc-overlay", "baseline-indicator", "back-to-top", "backtotop", "headerlink", "article-footer")
CONTROL_TAGS = ("baseline-indicator", "mdn-content-feedback", "interactive-example")
SITE_HEADER = r"(?i)\b(?:site-header|masthead|topbar|navbar|nav|menu|header-nav)\b"
FIXED_PLACE = r"\b(?:fixed|sticky|z-(?:4\d|50))\b"
HIDING_STYLE = r"(?i)\b(?:display\s*:\s*none|visibility\s*:\s*hidden)\b"
PERMALINK = r"(?i)\b(?:mark|permalink|hash-link|anchor(?:js)?-?link|header-?link|heading-anchor|deep-link)\b"
COPY_CLASS = r"\bcopy(?:-?(?:btn|button|code))?\b"
LEAST_KEPT_CHARS = 500
LIVE_CHARS = 160
DENSE_LINKS, DENSE_SHARE = 10, 0.5

# Where a page's content may be, in order.
REGIONS = (
    ("article", ""), ("main", ""), ("", "role=main"), ("", "id=content"), ("", "id=main-content"), ("", "class=content"), ("", "class=main-content"),
    ("", "class=post-content"), ("", "class=article-content"), ("", "class=entry-content"), ("", "itemprop=articleBody"), ("", "data-content"),
    ("", "class=post-body"), ("", "class=article-body"),
)
LEAST_REGION = 100

#: Scores: a paragraph of 25 characters or more counts 1, 1 for each comma and up to 3 for its hundreds of characters, to its parent in full and to its
#: grandparent by half; the share of an element's text in links takes that share of its score. Beside the best element stay siblings with a fifth of its
#: score (and 10 at least), and long paragraphs with few links.
LEAST_PARAGRAPH = 25
SIBLING_SHARE, LEAST_SIBLING = 0.2, 10.0
LEAST_SCORE = 4.0


@dataclass(frozen=True)
class Rules:
    """What a user may choose: categories of noise, words of class names and ids of their own, and selectors (``tag``, ``.class``, ``#id``, ``[name=value]``)."""

    categories: tuple[str, ...] = tuple(PROMOTION_OF)
    words: tuple[str, ...] = ()
    selectors: tuple[str, ...] = ()
    aggressive: bool = False
    keep_drawings: bool = False
    #: whether previews that repeat the code of their figure go; pages with figures are read twice then
    previews: bool = False


def lit(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def one_of(value: str, names) -> str:
    names = ", ".join(lit(n) for n in names)
    return f"coalesce({value} IN ({names}), false)" if names else "false"


def attr(name: str) -> str:
    """SQL: an attribute of a row's element; null without it."""
    return f"attrs[{lit(name)}]"


def has_class(*names: str) -> str:
    """SQL: whether one of the element's classes is one of ``names``."""
    return f"exists(split(coalesce({attr('class')}, ''), '[ \\\\t\\\\r\\\\n]+'), c -> c IN ({', '.join(lit(n) for n in names)}))"


def selected(selector: str) -> str:
    """SQL: whether a row's element fits a simple selector."""
    if selector.startswith("."):
        return has_class(selector[1:])
    if selector.startswith("#"):
        return f"{attr('id')} = {lit(selector[1:])}"
    if selector.startswith("["):
        name, _, value = selector[1:-1].partition("=")
        return f"{attr(name)} = {lit(value.strip(chr(34) + chr(39)))}" if value else f"{attr(name)} IS NOT NULL"
    return f"name = {lit(selector.lower())}"


def fits(value: str, pattern: str) -> str:
    return f"coalesce({value} RLIKE {lit(pattern)}, false)"


def _words(names) -> str:
    return r"(?i)(?:^|[^a-z0-9])(?:" + "|".join(names) + r")(?:$|[^a-z0-9])"


def _any(*conditions: str) -> str:
    return "(" + " OR ".join(f"coalesce({c}, false)" for c in conditions) + ")"


STARTS = "kind IN ('start', 'void')"


def noise_mark(rules: Rules) -> str:
    """SQL: 1 if the element of a start row is noise, 2 if it is unless it stands in a line of text or is an editor's text, else 0; judged by its own row and the counts of what it holds."""
    role, classes, ids = attr("role"), f"coalesce({attr('class')}, '')", f"coalesce({attr('id')}, '')"
    dense = f"(links >= {DENSE_LINKS} AND (chars = 0 OR links * 100 >= {DENSE_SHARE} * chars))"
    structural_tags = STRUCTURAL + (() if rules.keep_drawings else DRAWINGS)
    widget = _any(one_of(role, WIDGET_ROLES), f"{attr('data-state')} IN ('inactive', 'closed') AND NOT {one_of('name', STRUCTURAL)}", f"{attr('data-orientation')} IN ('horizontal', 'vertical')", f"{attr('data-accordion-item')} IS NOT NULL", f"{attr('data-radix-collection-item')} IS NOT NULL")
    hidden = _any(f"{attr('hidden')} IS NOT NULL", f"{attr('aria-hidden')} = 'true'", fits(attr("style"), HIDING_STYLE))
    kept = f"""coalesce(CASE WHEN {role} IN ('dialog', 'alertdialog') THEN in_main OR chars > {LEAST_KEPT_CHARS} OR titles > 0
        WHEN name IN ('nav', 'footer') THEN mains > 0 OR (chars >= {LEAST_KEPT_CHARS} AND NOT {dense})
        WHEN name = 'aside' THEN in_main AND navs = 0 AND NOT {dense} END, false)"""
    # an image that only noscript holds stays
    structural = f"({one_of('name', structural_tags)} AND NOT {widget} AND NOT (name = 'noscript' AND coalesce(images > 0 AND solid = 0, false)))"
    navigation = "false"
    if "nav-footer" in rules.categories:
        both = f"concat_ws(' ', {classes}, {ids})"
        header = f"(name = 'header' AND ({one_of(role, NAVIGATION_ROLES)} OR {fits(both, SITE_HEADER)}) AND coalesce(titles, 0) = 0)"
        navigation = f"(name IN ('nav', 'footer', 'aside') OR {header} OR {one_of(role, NAVIGATION_ROLES)} OR contains({classes}, 'breadcrumb'))"
    if "cookie-banners" in rules.categories:
        navigation = f"({navigation} OR coalesce({role} = 'dialog', false))"
    words = tuple(dict.fromkeys([*PROMOTION, *[w for c in rules.categories for w in PROMOTION_OF[c]], *rules.words]))
    promotion = f"({_any(fits(classes, _words(words)), fits(ids, _words(words)))} AND NOT in_main AND coalesce(mains, 0) = 0)"
    if rules.aggressive:
        promotion = f"({promotion} OR ({_any(fits(classes, _words(PROMOTION_BESIDE_CONTENT)), fits(ids, _words(PROMOTION_BESIDE_CONTENT)))} AND NOT in_main))"
    fixed = f"({fits(classes, FIXED_PLACE)} AND coalesce(chars, 0) < {LEAST_KEPT_CHARS})"
    small = _any(
        has_class("sr-only", "visually-hidden", "screen-reader-text"), f"{attr('aria-live')} IS NOT NULL AND name IN ('div', 'span', 'p') AND chars <= {LIVE_CHARS} AND parts = 0",
        f"name = 'a' AND {fits(attr('href'), r'[?&]utm_(?:source|medium|campaign)=')}", f"name IN ('button', 'a', 'li') AND {role} = 'tab'",
        f"name = 'a' AND {attr('href')} LIKE '#%' AND solid = 0 AND images = 0 AND (in_heading OR {fits(classes, PERMALINK)})",
        has_class(*CONTROL_CLASSES), one_of("name", CONTROL_TAGS), f"{attr('title')} = 'Edit this page'",
        f"name IN ('button', 'a', 'div', 'span') AND {fits(classes, COPY_CLASS)} AND parts = 0",
        *[selected(x) for x in rules.selectors],
    )
    # most elements have no attributes: only their names count
    dialog = f"(name = 'dialog' AND NOT (in_main OR chars > {LEAST_KEPT_CHARS} OR titles > 0))"
    plain = f"({dialog} OR ({'name IN (' + chr(39) + 'nav' + chr(39) + ', ' + chr(39) + 'footer' + chr(39) + ', ' + chr(39) + 'aside' + chr(39) + ') AND NOT ' + kept if 'nav-footer' in rules.categories else 'false'}) OR {one_of('name', HEAD + CONTROL_TAGS)})"
    marked = f"((({hidden} AND NOT {widget}) OR {navigation} OR {promotion} OR {fixed}) AND NOT {kept}) OR {small}"
    names = [x for x in rules.selectors if x[0] not in ".#["]
    sure = f"{plain} OR {one_of('name', names)} OR (size(attrs) > 0 AND ({marked}))"
    return f"CASE WHEN NOT ({STARTS}) OR name IN ('html', 'body') THEN 0 WHEN {sure} THEN 1 WHEN {structural} THEN 2 ELSE 0 END"


def judged(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Element rows with what their attributes and counts tell of each by itself: ``_mark`` (of noise), ``_gallery``, ``_rank`` (of regions) and ``_tail`` (of a text).

    Nothing here looks at other rows, so it is done before the rows are shuffled, and most counts stay behind. Windows stand between this step and the
    rest; in one generated function with them it would be too large for the JVM to compile (over 8 000 bytes).
    """
    gallery = f"coalesce({STARTS} AND {one_of('name', sorted(BLOCKS))} AND images > 0 AND {fits(attr('class'), 'gallery|slideshow|carousel')}, false)"
    rank = f"CASE WHEN kind = 'start' AND size > {LEAST_REGION} THEN {region_rank()} END"
    # the end of a text that ends with a space, maybe before a line's end; others are not looked through
    ends = " OR ".join(f"endswith(text, {lit(c)})" for c in " \n\r\u0085\u2028\u2029")
    return rows.selectExpr("*", f"{noise_mark(rules)} AS _mark", f"{gallery} AS _gallery", f"{rank} AS _rank", f"CASE WHEN {ends} THEN right(text, 4) END AS _tail")


def cleaned_rows(rows: DataFrame, key: str, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``elements`` without noise, with ``gallery`` (lies in a set of images) and ``editor`` (an editor's text that stands for its hidden block).

    Images of galleries stay, even of hidden slides, and nothing else of these; headings keep the elements that hold them.
    """
    above = f"OVER (PARTITION BY `{key}` ORDER BY pos)"
    rows = rows if "_mark" in rows.columns else judged(rows, rules)
    editor = f"coalesce({STARTS} AND name = 'textarea' AND lag(name) {above} = 'pre' AND lag(kind) {above} = 'end' AND lag({attr('aria-hidden')}) {above} = 'true', false) AS editor"
    # a button in a line of text stays with its text, and an editor's text stays as well
    in_line = f"(name = 'button' AND {fits('_before', '[A-Za-z0-9_,.] $')})"
    marked = rows.selectExpr("*", editor, f"lag(_tail) {above} AS _before").selectExpr("*", f"coalesce(_mark = 1 OR (_mark = 2 AND NOT {in_line} AND NOT editor), false) AS _noise")
    flagged = marked.selectExpr("*", f"{covered(key, '_noise AND NOT _gallery')} AS _out", f"{covered(key, '_gallery')} AS gallery", f"{covered(key, '_gallery AND _noise')} AS _lost")
    kept = flagged.where("kind = 'page' OR (kind <> 'data' AND ((gallery AND name = 'img' AND NOT _lost) OR (NOT _out AND (NOT gallery OR _gallery))))")
    return kept.drop("_mark", "_tail", "_before", "_noise", "_gallery", "_out", "_lost")


def region_rank(regions=REGIONS) -> str:
    """SQL: the place in ``regions`` of the first that a row's element fits; null if none."""
    tests = []
    for n, (tag, wanted) in enumerate(regions):
        name, _, value = wanted.partition("=")
        test = f"name = {lit(tag)}" if tag else selected(f".{value}" if name == "class" else f"[{wanted}]")
        tests.append(f"WHEN {test} THEN {n}")
    return f"CASE {' '.join(tests)} END"


#: SQL: whether a start row is a paragraph that has points, and how many.
IS_PARAGRAPH = f"(kind = 'start' AND name IN ('p', 'td', 'pre', 'blockquote', 'li', 'dd') AND chars >= {LEAST_PARAGRAPH} AND parts = 0)"
POINTS = "(1.0D + commas + least(floor(chars / 100), 3))"


def scored(rows: DataFrame, key: str) -> DataFrame:
    """Element rows with ``score`` and ``density`` (share of the text in links) of each element.

    Each paragraph sends its points to parent and grandparent, as rows of these elements that a window by element adds up.
    """
    sent = "named_struct('node', node, 'points', 0.0D, 'own', true)"
    to = lambda node, share: f"named_struct('node', {node}, 'points', {POINTS} * {share}, 'own', false)"
    spread = rows.selectExpr("*", f"explode(CASE WHEN {IS_PARAGRAPH} THEN array({sent}, {to('parent', '1.0D')}, {to('grand', '0.5D')}) ELSE array({sent}) END) AS _s")
    summed = spread.selectExpr("*", f"sum(_s.points) OVER (PARTITION BY `{key}`, _s.node) AS _sum", "coalesce(link_chars / greatest(chars, 1), 0.0D) AS density").where("_s.own")
    return summed.selectExpr("*", "_sum * (1 - density) AS score").drop("_s", "_sum")


def regions(rows: DataFrame, key: str) -> DataFrame:
    """Scored rows with ``region`` (of the page's chosen element: tier 0 by name or 1 by score, pos, last, parent, score) and ``in_region``: the first region by name that is long enough, else the element with the best score, if it is as long, and its siblings."""
    named = f"kind = 'start' AND size > {LEAST_REGION} AND _rank IS NOT NULL"
    best = f"kind = 'start' AND size > {LEAST_REGION} AND score >= {LEAST_SCORE} AND name NOT IN ('html', 'p', 'li', 'td', 'tr', 'pre')"
    choice = lambda tier, order: f"named_struct('tier', {tier}, 'order', CAST({order} AS DOUBLE), 'pos', pos, 'last', last, 'parent', parent, 'score', score)"
    known = rows.selectExpr("*", f"min(CASE WHEN {named} THEN {choice(0, '_rank')} WHEN {best} THEN {choice(1, '-score')} END) OVER (PARTITION BY `{key}`) AS region")
    beside = f"kind = 'start' AND parent = region.parent AND (score >= greatest({LEAST_SIBLING}D, {SIBLING_SHARE}D * region.score) OR (name = 'p' AND chars > 80 AND density < 0.25))"
    chosen = f"(pos = region.pos OR (region.tier = 1 AND {beside}))"
    # a region by name is what lies inside of it
    return known.selectExpr("*", f"coalesce(region IS NOT NULL AND {covered(key, chosen)} AND (region.tier = 1 OR pos NOT IN (region.pos, region.last)), false) AS in_region").drop("_rank")
