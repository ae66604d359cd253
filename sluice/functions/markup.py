"""A parser of HTML that takes any text for a page, in time linear in its length."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser


class ForgivingParser(HTMLParser):
    """The standard parser, but for pages that it fails on or is slow with.

    A marked section other than CDATA is a comment up to the next `>`, as
    browsers have it, and so is one of CDATA that never ends.  That nothing of
    a kind ends any more is found out once, not for each that begins; and what
    stands after the last `>` is text at once, as nothing can end there.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self._endless: set[str] = set()

    def parse_comment(self, i: int, report: int = 1) -> int:
        return -1 if "--" in self._endless else self._noted("--", super().parse_comment(i, report))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = -1
        if "[" not in self._endless and self.rawdata[i : i + 9].lower() == "<![cdata[":
            end = self._noted("[", super().parse_marked_section(i, report))
        return self.parse_bogus_comment(i) if end < 0 else end

    def _noted(self, kind: str, end: int) -> int:
        """Notes that no more of a kind ends, where the parser says so by -1."""
        if end < 0:
            self._endless.add(kind)
        return end

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not wanted

    def parse(self, page: str) -> None:
        """The whole page, and no more after it."""
        last = page.rfind(">") + 1
        self.feed(page[:last])
        self.close()
        if last < len(page) and not self.cdata_elem:
            self.handle_data(unescape(page[last:]))
