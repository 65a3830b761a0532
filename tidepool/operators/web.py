"""Pages of the web as memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import rules

#: Characters of a page that are read, and such that its memory holds.
READ, HELD = 50_000, 2_000


def page_memories(pages: DataFrame, id: str, url: str, text: str, context: Column) -> DataFrame:
    """(id, content, memory_type, chars, importance) of pages with an address of the web: the first ``HELD`` characters behind the address, how many
    of the first ``READ`` there are, and an importance by what ``context`` says. Other addresses and null ones have no memory; a null text is empty."""
    read = F.substring(F.coalesce(F.col(text), F.lit("")), 1, READ)
    rows = pages.where(F.col(url).startswith("http://") | F.col(url).startswith("https://"))
    content = F.concat(F.lit("[URL: "), F.col(url), F.lit("]\n"), F.substring(read, 1, HELD))
    return rows.select(id, content.alias("content"), F.lit("reference").alias("memory_type"), F.char_length(read).cast("long").alias("chars"), rules.worth(F.coalesce(context, F.lit(""))).alias("importance"))
