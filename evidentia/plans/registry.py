"""All queries of the library's own operators, with their SQL."""

from __future__ import annotations

from evidentia.plans import matching, pictures, relational, requests, reviews, scalars, screens, sections

FLAGSHIP = "verified_claims"


def queries() -> dict:
    return {**scalars.queries(), **relational.queries(), **requests.queries(), **screens.queries(), **sections.queries(), **matching.queries(), **pictures.queries(), **reviews.queries()}


def oracle_sql() -> dict[str, str]:
    return {**scalars.oracle_sql(), **relational.oracle_sql(), **requests.oracle_sql(), **screens.oracle_sql(), **sections.oracle_sql(), **matching.oracle_sql(), **pictures.oracle_sql(), **reviews.oracle_sql()}
