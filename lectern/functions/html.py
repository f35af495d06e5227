"""Text of HTML: as Python's parser sees it, or by patterns that any SQL engine has."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lectern.functions.common import column
from lectern.functions.text import collapse, normalize

# Tags that part words, and the entities the patterns decode, the ampersand last.
BREAKS = ("br", "div", "p", "li", "tr")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


#: Tags that no parser treats in a way of its own; without attributes they can be told by a pattern.
SIMPLE = ("a", "b", "i", "u", "em", "strong", "span", "sub", "sup", "table", "tbody", "thead", "td", "th", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", *BREAKS)


class _Tokens(HTMLParser):
    """What the parser finds, in order: tags as (tag, True), text as (text, False)."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tokens: list[tuple[str, bool]] = []
        self.handle_data = lambda data: self.tokens.append((data, False))
        self.handle_endtag = lambda tag: self.tokens.append((tag, True))
        self.handle_starttag = lambda tag, _: self.tokens.append((tag, True))
        self.feed(html)
        self.close()


def plain_text(html: str | None) -> str:
    """The text between the tags; a tag that parts words counts as a blank."""
    pieces = []
    for value, is_tag in _Tokens(html or "").tokens:
        if not is_tag:
            pieces.append(value)
        elif value in BREAKS:
            pieces.append(" ")
    return "".join(pieces)


@F.pandas_udf(StringType())
def _plain(html: pd.Series) -> pd.Series:
    return html.map(plain_text, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _plain_each(blocks: pd.Series) -> pd.Series:
    return blocks.map(lambda html: [plain_text(h) for h in html], na_action="ignore")


def _without_simple_tags(html: Column) -> Column:
    parted = F.regexp_replace(html, rf"(?i)</?(?:{'|'.join(BREAKS)})\s*/?>", " ")
    return F.regexp_replace(parted, rf"(?i)</?(?:{'|'.join(SIMPLE)})\s*/?>", "")


def _needs_parser(text: Column) -> Column:
    """Whether anything but simple tags was there."""
    return F.contains(text, F.lit("<")) | F.contains(text, F.lit("&"))


def html_to_text(html: Column | str) -> Column:
    """What the parser sees as text, script and style contents included; normalised.

    Only what has more than simple tags goes to the parser.
    """
    html = F.coalesce(column(html), F.lit(""))
    simple = _without_simple_tags(html)
    return normalize(F.when(_needs_parser(simple), _plain(F.when(_needs_parser(simple), html))).otherwise(simple))


def html_to_text_fast(html: Column | str) -> Column:
    """Without scripts and styles, by patterns that any SQL engine has."""
    text = F.regexp_replace(F.coalesce(column(html), F.lit("")), r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "")
    text = F.regexp_replace(text, rf"(?i)</?(?:{'|'.join(BREAKS)})(?:\s[^>]*)?/?>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", "")
    for entity, character in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return collapse(text)


def response_text(blocks: Column | str) -> Column:
    """Texts of readable blocks in reading order, as the parser sees them; blocks without an order come first."""
    ready = F.filter(column(blocks), lambda b: ~F.coalesce(b["skipped"], F.lit(False)) & ~F.coalesce(b["error"], F.lit(False)) & (F.coalesce(b["html"], F.lit("")) != ""))
    ordered = F.array_sort(F.transform(ready, lambda b, i: F.struct(F.coalesce(b["reading_order"], F.lit(0)).alias("o"), i.alias("i"), b["html"].alias("h"))))
    html = F.transform(ordered, lambda b: b["h"])
    simple = F.transform(html, _without_simple_tags)
    hard = F.exists(simple, _needs_parser)
    return normalize(F.array_join(F.when(hard, _plain_each(F.when(hard, html))).otherwise(simple), " "))
