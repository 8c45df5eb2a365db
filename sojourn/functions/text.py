"""Text expressions: title case, path strings, substring rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sojourn.functions.nulls import is_in

# The words title case leaves in lower case, unless they come first.
SMALL_WORDS = (
    "a", "and", "are", "as", "at", "be", "but", "by", "en", "for", "from", "if", "in", "into",
    "is", "nor", "not", "of", "on", "or", "per", "so", "than", "that", "the", "v", "v.", "via",
    "vs", "vs.", "with",
)
# The words title case leaves as they are, wherever they stand.
KEPT_WORDS = (
    "all", "above", "after", "along", "also", "among", "any", "both", "can", "few", "it", "less",
    "log", "many", "more", "over", "some", "their", "then", "this", "under", "until", "using",
    "von", "when", "where", "which", "will", "without", "yet", "you", "your",
)
# Fixed value: what separates two words of a title.
WORD_OR_BREAK = r"""[ \-/"()\n\t]|[^ \-/"()\n\t]+"""

PATH_SEPARATOR = "; "


def title_case(col: Column) -> Column:
    """Lower case, then a capital on each word but the small ones; null stays null.

    The parts of a hyphenated word count as words. Single letters stay in lower case.
    """

    def capital(word: Column, i: Column) -> Column:
        small = (i > 0) & is_in(word, SMALL_WORDS)
        return F.when(small | is_in(word, KEPT_WORDS) | (F.length(word) == 1), word).otherwise(
            F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))
        )

    words = F.regexp_extract_all(F.lower(col), F.lit(WORD_OR_BREAK), F.lit(0))
    return F.array_join(F.transform(words, capital), "")


def split_path(path: Column, separator: str = PATH_SEPARATOR) -> Column:
    """``"A; B; "`` to ``["A", "B"]``: the empty part behind a closing separator is dropped."""
    parts = F.split(path, separator)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def close_path(path: Column, separator: str = PATH_SEPARATOR) -> Column:
    """Append the separator, so that paths of one person can be strung together. Null stays null."""
    return F.concat(path, F.lit(separator))


def passes_through(path: Column, code: str) -> Column:
    """The ``LIKE '%code%'`` rule on a path string."""
    return path.contains(code)
