"""Leaf blocks of an HTML page: runs of text between block borders, with their ancestors."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

#: Elements whose borders do not end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr "
                   # formulas
                   "annotation annotation-xml math merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot "
                   "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is not shown.
HIDDEN = frozenset("script style noscript template head title svg iframe object textarea select option "
                   "canvas audio video annotation annotation-xml".split())
#: Elements that can stand in a head; any other ends it, as text does.
HEAD_PARTS = frozenset("base head link meta noscript script style template title".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
                   "main nav ol p pre section table ul".split())
SPACE = re.compile(r"\s+")


class _Blocks(HTMLParser):
    """Collects ``(text, link_chars, inner, around)``: the innermost block element, and all open
    elements as a set of tags (``t:nav``) and words of classes, ids and roles (``c:menu``)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str, frozenset]] = []
        self.open: list[tuple[str, tuple]] = []
        self.open_of: Counter = Counter()
        self.blocks_open: list[str] = [""]
        self.around: Counter = Counter()
        self.around_set: frozenset | None = None
        self.hidden = 0
        self.text: list[str] = []
        self.linked = 0
        self.link = 0

    def cut(self):
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                if self.around_set is None:
                    self.around_set = frozenset(self.around)
                self.blocks.append((text, self.linked, self.blocks_open[-1], self.around_set))
            self.text = []
        self.linked = 0

    def end_head(self):
        """A head whose end tag is left out ends at what cannot stand in it."""
        if self.open and self.open[-1][0] == "head":
            self.close("head")

    def handle_starttag(self, tag, attrs):
        if tag not in HEAD_PARTS:
            self.end_head()
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self.cut()
            if tag in ENDS_P:
                self.close("p", 1)
        if tag == "li":
            self.close("li", 2)
        if tag == "body":
            self.close("head")
        if tag in VOID:
            return
        marks = () if tag in INLINE else (f"t:{tag}",)
        for name, value in attrs if marks else ():
            if name in ("class", "id", "role") and value:
                marks += tuple(f"c:{w}" for w in re.split(r"[^a-z]+", value.lower()) if w)
        self.open.append((tag, marks))
        self.open_of[tag] += 1
        if marks:
            self.blocks_open.append(tag)
            self.around.update(marks)
            self.around_set = None
        self.hidden += tag in HIDDEN
        self.link += tag == "a"

    def close(self, tag, reach=None):
        """End the innermost open ``tag`` and what is open inside it; with ``reach``
        only among that many innermost block elements."""
        if not self.open_of[tag] or (reach is not None and tag not in self.blocks_open[-reach:]):
            return
        while True:  # what is walked over is taken out, so no element is met twice
            gone, marks = self.open.pop()
            self.open_of[gone] -= 1
            self.hidden -= gone in HIDDEN
            self.link -= gone == "a"
            if marks:
                self.blocks_open.pop()
                self.around_set = None
                for m in marks:
                    self.around[m] -= 1
                    if not self.around[m]:
                        del self.around[m]
            if gone == tag:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if tag not in INLINE:
            self.cut()
        self.close(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if data.strip():
            self.end_head()
        if not self.hidden:
            self.text.append(data)
            if self.link:
                self.linked += len(data.strip())

    def unknown_decl(self, data):
        pass

    def close_document(self):
        super().close()
        self.cut()


def leaf_blocks(html: str | None) -> list[tuple[str, int, str, frozenset]]:
    """The visible blocks of a page in order; none for a null or empty page."""
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    parser.close_document()
    return parser.blocks
