"""Job cards out of stored HTML, as tables and column expressions.

A page is cut into tokens by one pattern.  Tokens become rows, and windows over the tags of one name
find where each element ends: opening and closing tags of one nesting level take turns.  An element
covers an interval of tokens, so it stands inside one that matches a step of a selector when the
furthest end of those before it is not yet reached: a running maximum, whatever the page holds.
Likewise the first element of a card that matches a field is the next one that does, if the card
covers it.  So every element is looked at once for each step, and the work grows with the page.
Then a page is one row again, with its tokens and its cards, and texts are cut out of the tokens.
Which element holds which field is data, one specification per site.

A tag that is never closed reaches to the end of its page.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacancylake.functions import cards
from vacancylake.functions.arrays import let
from vacancylake.functions.entities import unescape
from vacancylake.schemas import POSTING

# Selectors of the cards of each site and of their fields.
CARD_SPECS: dict[str, dict[str, str]] = {
    "linkedin": {
        "card": "ul.jobs-search__results-list li",
        "title": "a.job-card-list__title, a[href*='/jobs/view/']",
        "company": ".job-card-container__company-name, .base-search-card__subtitle a,"
        " .job-card-list__subtitle a",
        "location": ".job-card-container__metadata-item, .job-search-card__location",
    },
    "itviec": {
        "card": "div.job, div.job-details, div#jobs div.job-info",
        "title": "a.title, a.job__title, h3 a",
        "company": "a.company, .company, .employer",
        "location": ".location, .cities, li.city",
    },
    "topcv": {
        "card": "div.job-item-default, div.box-job, .job-list .job-item",
        "title": "h3 a, .title a",
        "company": ".company, .company-name a, .company-name",
        "location": ".address, .job-address, .job-location",
        "salary": ".salary, .job-salary",
    },
    "vietnamworks": {
        "card": "div.job-item, div.job-card, .jobs-list .job-item",
        "title": "h3 a, .job-title a",
        "company": ".company a, .company, .company-name",
        "location": ".location, .job-location, .address",
        "posted_at": "time, .posted-date, .job__deadline",
    },
}
DESCRIPTION_SELECTORS = [
    ".jobs-description__content",
    ".show-more-less-html__markup",
    ".jobs-description-content__text",
    ".job-details-jobs-unified-top-card__job-description",
    ".jobs-unified-top-card__job-description",
    ".jobs-description",
    ".description__text",
]
PANEL_SELECTORS = [".jobs-search__job-details--container", ".scaffold-layout__detail"]
PANEL_PARTS = "p, div, span, li, h1, h2, h3, h4, h5, h6"
NOT_DESCRIPTION = [
    "job-title", "company-name", "location", "metadata", "applicant", "posted", "nav",
    "button", "header",
]
# Tags without content, and those that begin and end a line.
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"]
LINE_TAGS = [
    "article", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ol", "p", "section", "tr", "ul",
]

#: Comments, hidden elements as a whole, tags with their quoted values, text.
TOKEN = (
    r"""(?s)<!--.*?-->|<(?i:script|style)\b.*?</(?i:script|style)\s*>"""
    r"""|</?[a-zA-Z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>|<[!?][^>]*+>|[^<]++|<"""
)
ATTRIBUTES = ["class", "id", "href", "datetime", "aria-label"]


def _attribute(token: Column, name: str) -> Column:
    """Value of an attribute of a tag, quoted or not; empty where it is missing."""
    found = F.regexp_extract(token, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return unescape(F.regexp_replace(found, r"""^["']|["']$""", ""))


def page_tokens(pages: DataFrame, html: str, *kept: str) -> DataFrame:
    """One row per token with ``page``, ``kept`` columns, ``at`` and ``piece``, what it adds to the text.

    A token that opens an element has ``opens``, the last token of the element as ``end``, its
    ``tag``, some attributes, and ``classes``.  All windows are within a page, so the rows are dealt once.
    """
    numbered = pages.select(F.monotonically_increasing_id().alias("page"), *kept, F.col(html).alias("html"))
    rows = numbered.select(
        "page", *kept, F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), F.lit(0))).alias("at", "token")
    )
    name = F.lower(F.regexp_extract("token", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    hidden = name.isin("script", "style") | F.col("token").rlike("^<[!?]")
    opens = F.col("token").rlike("^<[a-zA-Z]") & ~hidden
    closes = F.startswith(F.col("token"), F.lit("</")) & (name != "")
    rows = rows.withColumns({"tag": name, "opens": opens, "closes": closes})
    is_line = F.col("tag").isin(LINE_TAGS) & (F.col("opens") | F.col("closes"))
    is_text = ~F.startswith(F.col("token"), F.lit("<")) | (F.col("token") == "<")
    piece = F.when(is_line, "\n").when(is_text, unescape(F.col("token"))).otherwise("")
    nests = (F.col("opens") & ~F.col("tag").isin(VOID_TAGS)) | F.col("closes")
    step = F.when(nests & F.col("opens"), 1).when(nests, -1).otherwise(0)
    same_tag = Window.partitionBy("page", "tag").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"piece": piece, "nests": nests, "step": step})
    rows = rows.withColumn("level", F.sum("step").over(same_tag) + F.when(F.col("closes"), 1).otherwise(0))
    turns = Window.partitionBy("page", "tag", "level", "nests").orderBy("at")
    last = F.max("at").over(Window.partitionBy("page"))
    rows = rows.withColumn("end", F.when(F.col("nests"), F.coalesce(F.lead("at").over(turns), last)).otherwise(F.col("at")))
    rows = rows.drop("closes", "nests", "step", "level")
    found = {a.replace("-", "_"): F.when(F.col("opens"), _attribute(F.col("token"), a)) for a in ATTRIBUTES}
    return rows.withColumns(found).withColumn("classes", F.split(F.trim("class"), r"\s+"))


def _simple(step: str) -> Column:
    """Condition of one step of a selector: tag, classes, id, part of an attribute."""
    tag = re.match(r"[a-z0-9]*", step).group()
    bare = re.sub(r"\[.*?\]", "", step)
    conditions = [F.array_contains("classes", c) for c in re.findall(r"\.([\w-]+)", bare)]
    conditions += [F.col("id") == F.lit(i) for i in re.findall(r"#([\w-]+)", bare)]
    conditions += [
        F.contains(F.col(name.replace("-", "_")), F.lit(part))
        for name, part in re.findall(r"\[([\w-]+)\*='([^']*)'\]", step)
    ]
    if tag:
        conditions.append(F.col("tag") == F.lit(tag))
    return reduce(Column.__and__, conditions, F.col("opens"))


def _paths(selector: str) -> list[tuple[str, ...]]:
    return [tuple(path.split()) for path in selector.split(",")]


def _of_group(group: str | None, conditions: dict[str, Column]) -> Column:
    """The condition of the row's own group; of all rows where there are no groups."""
    if group is None:
        return next(iter(conditions.values()), F.lit(False))
    chosen = F.lit(False)
    for name, condition in conditions.items():
        chosen = F.when(F.col(group) == name, condition).otherwise(chosen)
    return F.coalesce(chosen, F.lit(False))


def with_matches(rows: DataFrame, selectors: dict[str, dict[str, str]], group: str | None = None) -> DataFrame:
    """``rows`` of ``page_tokens`` with a flag per name of ``selectors``: the token opens a matching element.

    ``selectors``: name -> group -> comma-separated selectors, whose steps apart by blanks are
    ancestors; ``group`` names the column that tells which one counts in a row.  The steps above an
    element take a column for each that one group has of the same depth.
    """
    before = Window.partitionBy("page").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    above: dict[str, list[tuple[str, ...]]] = {}
    for by_group in selectors.values():
        for name, selector in by_group.items():
            found = above.setdefault(name, [])
            found += [path[:n] for path in _paths(selector) for n in range(1, len(path)) if path[:n] not in found]
    slots: dict[tuple[str, tuple[str, ...]], str] = {}

    def matches(name: str, path: tuple[str, ...]) -> Column:
        own = _simple(path[-1])
        return own & F.col(slots[name, path[:-1]]) if len(path) > 1 else own

    made: list[str] = []
    for depth in range(1, max((len(p) for paths in above.values() for p in paths), default=0) + 1):
        columns: list[dict[str, Column]] = []
        for name, paths in above.items():
            for i, path in enumerate(p for p in paths if len(p) == depth):
                columns += [{}] * (i + 1 - len(columns))
                columns[i] = {**columns[i], name: matches(name, path)}
                slots[name, path] = f"_inside_{depth}_{i}"
        ends = {f"_inside_{depth}_{i}": F.max(F.when(_of_group(group, c), F.col("end"))).over(before) for i, c in enumerate(columns)}
        made += ends
        rows = rows.withColumns({n: F.coalesce(e >= F.col("at"), F.lit(False)) for n, e in ends.items()})
    flags = {
        flag: _of_group(group, {name: reduce(Column.__or__, [matches(name, p) for p in _paths(s)]) for name, s in by_group.items()})
        for flag, by_group in selectors.items()
    }
    return rows.withColumns(flags).drop(*made)


def inner_text(tokens: Column, start: Column, end: Column) -> Column:
    """Text inside an element, line by line, blanks single and empty lines left out."""
    pieces = F.transform(F.slice(tokens, start + 1, end - start + 1), lambda t: t["piece"])
    lines = F.transform(
        F.split(F.array_join(pieces, ""), "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    )
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _text(tokens: Column, element: Column) -> Column:
    return F.when(element.isNotNull(), inner_text(tokens, element["at"], element["end"]))


def _source(tokens: Column, element: Column) -> Column:
    own = F.slice(tokens, element["at"] + 1, element["end"] - element["at"] + 1)
    return F.array_join(F.transform(own, lambda t: t["token"]), "")


def _none_if_empty(text: Column) -> Column:
    """The text is computed once; a condition on it would compute it again."""
    return F.get(F.filter(F.array(text), lambda t: t != ""), F.lit(0))


FIELDS = ["title", "company", "location", "salary", "posted_at"]


def parse_cards(pages: DataFrame, key: str, site: str, html: str) -> DataFrame:
    """One row per job card with a title, over pages or over stored single cards.

    ``site`` and ``html`` name columns.  Unknown sites yield nothing.  Cards may stand inside cards;
    an element belongs to all that cover it.
    """
    known = pages.where(F.col(site).isin(list(CARD_SPECS)) & F.col(html).isNotNull())
    known = known.select(F.col(key).alias("_key"), F.col(site).alias("_site"), F.col(html).alias("_html"))
    flags = {f: {name: spec[f] for name, spec in CARD_SPECS.items() if f in spec} for f in ["card", *FIELDS]}
    rows = with_matches(page_tokens(known, "_html", "_key", "_site"), {f"is_{f}": by_site for f, by_site in flags.items()}, "_site")
    # The next element of each field after a token; from the last token backwards.
    behind = Window.partitionBy("page").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("page").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    extra = {"title": ["href"], "posted_at": ["datetime"]}
    following = {
        f"next_{f}": F.last(F.when(F.col(f"is_{f}"), F.struct("at", "end", *extra.get(f, []))), ignorenulls=True).over(behind)
        for f in FIELDS
    }
    is_box = F.col("opens") & F.col("tag").isin("span", "div")
    rows = rows.withColumns(following).withColumns(
        {"boxes": F.sum(is_box.cast("int")).over(so_far), "card_no": F.sum(F.col("is_card").cast("int")).over(so_far)}
    )
    inside = {f: F.when(F.col(f"next_{f}.at") <= F.col("end"), F.col(f"next_{f}")).alias(f) for f in FIELDS}
    card = F.struct("at", "end", "card_no", "boxes", *inside.values())
    titled = F.col("is_card") & (F.col("next_title.at") <= F.col("end"))
    page = rows.groupBy("page").agg(
        F.first("_key").alias("_key"),
        F.first("_site").alias("_site"),
        F.array_sort(F.collect_list(F.struct("at", "token", "piece", "boxes"))).alias("tokens"),
        F.array_sort(F.collect_list(F.when(is_box, F.struct("at", "end", "aria_label")))).alias("boxes"),
        F.array_sort(F.collect_list(F.when(titled, card))).alias("cards"),
    )
    tokens, boxes = F.col("tokens"), F.col("boxes")

    def text(element: Column) -> Column:
        return _none_if_empty(_text(tokens, element))

    def read(c: Column) -> Column:
        # Elements that stand inside are neighbours: the card's own box is counted with those before it.
        held = F.slice(boxes, c["boxes"] + 1, F.get(tokens, c["end"])["boxes"] - c["boxes"])
        texts = F.flatten(F.transform(held, lambda e: F.array(_text(tokens, e), e["aria_label"])))
        return F.struct(
            c["card_no"].cast("int").alias("card_no"),
            _text(tokens, c["title"]).alias("title"),
            text(c["company"]).alias("company"),
            text(c["location"]).alias("location"),
            _none_if_empty(c["title"]["href"]).alias("url"),
            text(c["salary"]).alias("salary"),
            F.coalesce(_none_if_empty(c["posted_at"]["datetime"]), text(c["posted_at"])).alias("posted_at"),
            _text(tokens, c).alias("card_text"),
            F.filter(texts, lambda t: t != "").alias("element_texts"),
            _source(tokens, c).alias("card_html"),
        )

    found = page.select(F.col("_key").alias(key), F.col("_site").alias("site"), F.explode(F.transform("cards", read)).alias("c"))
    return found.select(key, "site", "c.*")


def parse_descriptions(pages: DataFrame, key: str, html: str) -> DataFrame:
    """``parts`` and ``fragments`` of the description of every page, in reading order."""
    known = pages.select(F.col(key).alias("_key"), F.coalesce(F.col(html), F.lit(" ")).alias("_html"))
    chosen = {f"part_{i}": s for i, s in enumerate(DESCRIPTION_SELECTORS)}
    chosen |= {f"panel_{i}": s for i, s in enumerate(PANEL_SELECTORS)}
    rows = with_matches(page_tokens(known, "_html", "_key"), {n: {"": s} for n, s in chosen.items()})
    named = reduce(Column.__or__, [F.contains("class", F.lit(w)) for w in NOT_DESCRIPTION])
    rows = rows.withColumn("fragment", F.col("opens") & F.col("tag").isin(PANEL_PARTS.split(", ")) & ~named)
    page = rows.groupBy("page").agg(
        F.first("_key").alias(key),
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("tokens"),
        *[F.array_sort(F.collect_list(F.when(F.col(n), F.struct("at", "end")))).alias(n) for n in [*chosen, "fragment"]],
    )
    tokens = F.col("tokens")
    parts = F.concat(*[F.col(n) for n in chosen if n.startswith("part_")])
    panel = F.coalesce(*[F.get(n, F.lit(0)) for n in chosen if n.startswith("panel_")])

    def fragments(outer: Column) -> Column:
        held = F.filter("fragment", lambda e: (e["at"] > outer["at"]) & (e["at"] <= outer["end"]))
        return F.transform(held, lambda e: _text(tokens, e))

    return page.select(
        key,
        F.transform(parts, lambda e: _text(tokens, e)).alias("parts"),
        F.when(panel.isNotNull(), let(panel, fragments)).otherwise(F.array().cast("array<string>")).alias("fragments"),
    )


def description(parts: Column, fragments: Column) -> Column:
    """The description elements of a page, or else the first long enough parts of its details panel."""
    return F.coalesce(cards.join_fragments(parts), cards.join_panel_fragments(fragments))


def postings_from_pages(pages: DataFrame, key: str, site: str, html: str, details: str | None = None) -> DataFrame:
    """Job cards as rows of ``schemas.POSTING``, after ``key`` and ``card_no``.

    Applicants come from the text of the card, else from single elements of it; the time of posting
    from its own element, else from the text.  ``details`` names a column with the page that
    describes the posting.
    """
    found = parse_cards(pages, key, site, html)
    described = F.lit(None).cast("string")
    if details:
        texts = parse_descriptions(pages, key, details).select(key, description(F.col("parts"), F.col("fragments")).alias("described"))
        found, described = found.join(texts, key, "left"), F.col("described")
    values = {
        "job_id": F.xxhash64("site", "url"),
        "source": F.col("site"),
        "posted_at": F.coalesce("posted_at", cards.posted_at(F.col("card_text"))),
        "applicants": F.coalesce(cards.applicants(F.col("card_text")), cards.applicants_of_elements(F.col("element_texts"))),
        "description": described,
        "tags": F.array().cast("array<string>"),
        "raw": F.struct("card_html"),
        "timestamp": F.current_timestamp(),
    }
    columns = [values.get(f.name, F.col(f.name) if f.name in found.columns else F.lit(None)) for f in POSTING]
    return found.select(key, "card_no", *[c.cast(f.dataType).alias(f.name) for c, f in zip(columns, POSTING)])
