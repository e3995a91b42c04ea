"""Elements of a page by height, so that expressions can step over whole ones, however nested.

An element without elements in it has height 0, one that holds some is one higher than the
highest of them.  `by_height` gives each height a pair of marks of its own, taken
from characters that no text may hold, in place of the tags.  Between the marks of a
height stand lower ones only, so an element ends at the next closing mark of its
height, and siblings are what stands between the marks of their parent.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Heights that are told apart; a higher element keeps its tags and is not stepped over.
HEIGHTS = 12
_FIRST = 0xFDD0
_OPEN = [chr(_FIRST + 2 * k) for k in range(HEIGHTS)]
_CLOSE = [chr(_FIRST + 2 * k + 1) for k in range(HEIGHTS)]
#: Between the name and attributes of an element and its content.
_INSIDE = chr(0xFDEF)
_MARKS = f"{chr(_FIRST)}-{_INSIDE}"
_OPENS, _CLOSES = f"[{''.join(_OPEN)}]", f"[{''.join(_CLOSE)}]"

# Tags that end a paragraph which has no end of its own.
_BLOCKS = ("address|article|aside|blockquote|body|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|"
           "h[1-6]|header|hr|html|li|main|menu|nav|ol|pre|section|table|tbody|td|tfoot|th|thead|tr|ul")

#: Patterns, all without groups and all possessive: text, a whole element, and either of them.
TEXT = f"[^<{_MARKS}]++"
ELEMENT = "(?:" + "|".join(f"{o}[^{c}]*+{c}" for o, c in zip(_OPEN, _CLOSE)) + ")"
NODE = f"(?:{TEXT}|{ELEMENT})"
#: The end of any element.
END = _CLOSES


def start(tag: str, attributes: str = "") -> str:
    """Pattern of the beginning of an element, up to its content."""
    return rf"{_OPENS}{tag}\b{attributes}[^{_INSIDE}]*+{_INSIDE}"


def with_class(words: str) -> str:
    """For `start`: a class attribute that holds the words."""
    return (rf"(?=[^{_INSIDE}]*?\sclass\s*+=\s*+(?:\"[^\"{_INSIDE}]*?{words}|'[^'{_INSIDE}]*?{words}"
            rf"|[^\s\"'{_INSIDE}]*?{words}))")


def said_first(tag: str, words: str) -> str:
    """Pattern of a whole element whose first own text holds the words."""
    return rf"{start(tag)}{ELEMENT}*+[^<{_MARKS}]*?{words}{NODE}*+{END}"


def own_text(tag: str) -> str:
    """Pattern of an element up to its first own text, which is the group."""
    return rf"{start(tag)}{ELEMENT}*+({TEXT})"


def none_said(tag: str) -> str:
    """Pattern of a whole element of that kind without a text of its own."""
    return rf"{start(tag)}{ELEMENT}*+{END}"


def by_height(page: Column, in_tag: str, void: str) -> Column:
    """The page with marks in place of the tags; `in_tag` and `void` are the patterns of what stands in a tag and of an empty one."""
    page = F.regexp_replace(page, f"[{_MARKS}]", "")
    page = F.regexp_replace(page, r"<(?![A-Za-z/])", "&lt;")
    page = F.regexp_replace(page, f"(?is){void}", f"{_OPEN[0]}br {_INSIDE}{_CLOSE[0]}")
    open_paragraph = (rf"(?is)(<p\b{in_tag}>(?:[^<]++|<(?!/?p\b|/?(?:{_BLOCKS})\b))*+)(?!</p\s*+>)(?=<|\z)")
    page = F.regexp_replace(page, open_paragraph, "$1</p>")
    for opening, closing in zip(_OPEN, _CLOSE):
        page = F.regexp_replace(page, rf"(?is)<([a-z][a-z0-9]*+)\b({in_tag})>([^<]*+)</\1\s*+>",
                                f"{opening}$1$2{_INSIDE}$3{closing}")
    return page
