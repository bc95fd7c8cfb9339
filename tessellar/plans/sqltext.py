"""Fragments of DuckDB SQL that several oracles share."""

from __future__ import annotations

from tessellar.functions.text import SEARCH_STOPWORDS


def tokens(text: str) -> str:
    """The search tokens of an expression, as a list."""
    names = f"regexp_extract_all({text}, '[A-Za-z_][A-Za-z0-9_]*')"
    return (
        f"list_concat(list_concat("
        f"list_filter(list_transform({names}, lambda w: lower(w)), lambda w: length(w) > 1), "
        f"flatten(list_transform({names}, lambda w: list_filter(list_transform("
        f"regexp_extract_all(regexp_replace(w, '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z][a-z][a-z0-9]*|[A-Z]+|[a-z0-9]+'), "
        f"lambda p: lower(p)), lambda p: length(p) > 1 AND p <> lower(w))))), "
        f"list_transform(regexp_extract_all({text}, '[0-9]+(?:[.,][0-9]+)+|[0-9]+'), lambda n: replace(n, ',', '')))"
    )


STOPWORDS = "(" + ", ".join(f"'{w}'" for w in SEARCH_STOPWORDS) + ")"


def numeric_heavy(text: str) -> str:
    """Whether the text is numeric-heavy."""
    lines = f"list_filter(regexp_split_to_array({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda s: regexp_matches(s, '\\S'))"
    body = "regexp_replace(s, '\\s+', '', 'g')"
    numeric = (
        f"length({body}) >= 8 AND (NOT regexp_matches({body}, '\\p{{L}}') "
        f"OR length(regexp_replace({body}, '[^0-9.,+eE-]', '', 'g')) * 2 >= length({body}))"
    )
    n = f"len(list_filter({lines}, lambda s: {numeric}))"
    return f"({n} > 0 AND {n} * 2 >= len({lines}))"
