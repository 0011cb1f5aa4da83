"""HTML read tag by tag, in linear time whatever the markup."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

_NAME = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
#: Comments, declarations, tags whose attributes are well quoted, other tags; each may be cut off by the end.
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|{_NAME}((?:\"[^\"]*\"|'[^']*'|[^>\"']++)*+)(?:>|\Z)|{_NAME}([^>]*)(?:>|\Z)", re.S)

# HTML's block elements.
BLOCKS = frozenset(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul".split())


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?![a-zA-Z0-9:-])[^>]*>", re.I)


def events(html: str, raw: frozenset[str]) -> Iterator[tuple[str, str, bool, str]]:
    """(text before the tag, its lower-case name, is it an end tag, attributes); the last one has no name.

    What is inside an element of ``raw`` is left out, to the end of the page where it isn't closed.
    """
    at = 0
    while m := _TAG.search(html, at):
        before, at = html[at : m.start()], m.end()
        closing, name, attributes = m[1] or m[4], (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        if name in raw and not closing and not attributes.endswith("/"):
            end = _raw_end(name).search(html, at)
            at = end.end() if end else len(html)
        if name or before:
            yield before, name, bool(closing), attributes
    yield html[at:], "", False, ""
