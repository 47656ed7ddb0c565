"""Text cleaning and projection, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Entities that are decoded, one after another in this order, with their text.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
#: The prompt that surrounds a text.
PROMPT_BEFORE, PROMPT_AFTER = "<start_of_turn>user\n", "<end_of_turn>\n<start_of_turn>model\n"


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def decode_entities(text: Column) -> Column:
    """Decodes in sequence, so &amp;lt; ends as <, and removes other decimal and named entities; hexadecimal ones stay."""
    for name, plain in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(plain))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)&#\d+;", ""), r"(?U)&\w+;", "")


def clean_text(text: Column) -> Column:
    """Without tags and entities, white space of any script collapsed, trimmed; null stays null."""
    return F.trim(F.regexp_replace(decode_entities(strip_tags(text)), r"(?U)\s+", " "))


def preview(text: Column, length: int) -> Column:
    """At most length characters, with an ellipsis where some are cut."""
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def signature(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])


def prompt(text: Column) -> Column:
    return F.concat(F.lit(PROMPT_BEFORE), text, F.lit(PROMPT_AFTER))


def filled(text: Column) -> Column:
    """Whether a text is neither null nor blank."""
    return F.coalesce(F.trim(text), F.lit("")) != ""


def token_count(text: Column) -> Column:
    """White-space separated tokens; null and blank texts have none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"))
