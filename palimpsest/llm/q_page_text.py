"""op9: the page text query."""

from palimpsest.llm import page_text
from palimpsest.llm.common import read

NAME = "op9_page_text"


def query(spark, sf_dir):
    """The main text of every page."""
    pages = read(spark, sf_dir, "pages")
    return page_text.extract(pages, page_text.fit(pages))
