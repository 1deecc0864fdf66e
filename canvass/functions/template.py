"""Prompt templates compiled into one ``concat`` expression.

The template is parsed once on the driver with ``string.Formatter`` (the
same grammar as ``str.format``: ``{name}`` fields, ``{{``/``}}`` escapes)
and becomes ``concat(literal, value, literal, ...)``.  Rendering is a single
pass, so a value that itself contains ``{website}`` is inserted verbatim.
Unknown fields fail while the plan is built, before any row is processed.
"""

from __future__ import annotations

import string
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import prompt_value

# Template variables and the lead column each one reads.
TEMPLATE_VARIABLES: dict[str, str | None] = {
    "company_name": "company_name",
    "company_address": "company_address",
    "company_phone": "company_phone",
    "website": "website",
    "rating": "rating",
    "review_count": "review_count",
    "research_brief": "research_brief",
    "linkedin_url": "linkedin_url",
    "facebook_url": "facebook_url",
    "instagram_url": "instagram_url",
    "twitter_url": "twitter_url",
    "product_description": None,  # the caller's text, inserted as is
}

DEFAULT_TEMPLATE = (Path(__file__).with_name("default_prompt.txt")).read_text(encoding="utf-8")


def parse_template(template: str) -> list[tuple[str, str | None]]:
    """[(literal, field or None)], validated against TEMPLATE_VARIABLES."""
    parts = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if field is not None:
            if field == "" or field.isdigit():
                raise ValueError("positional template fields are not supported")
            if field not in TEMPLATE_VARIABLES:
                raise KeyError(field)
            if spec or conv:
                raise ValueError(f"format spec/conversion not supported: {{{field}}}")
        parts.append((literal, field))
    return parts


def render_prompt(template: str, product_description: str, columns) -> Column:
    """Column with the rendered prompt for each row.

    ``columns`` are the input's column names: a variable whose column is
    absent renders as 'N/A', like a missing field.
    """
    present = set(columns)
    pieces: list[Column] = []
    for literal, field in parse_template(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is None:
            continue
        src = TEMPLATE_VARIABLES[field]
        if src is None:
            pieces.append(F.lit(product_description))
        elif src in present:
            pieces.append(prompt_value(F.col(src)))
        else:
            pieces.append(F.lit("N/A"))
    return F.concat(*pieces) if pieces else F.lit("")
