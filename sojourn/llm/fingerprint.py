"""Document fingerprints: a Merkle tree over the sections and paragraphs of a text.

Sections are parted by an empty line, paragraphs by a line end; a leaf is a piece of a paragraph of at most
LEAF_CHARS characters that ends with its sentence. Each node is the md5 of its children's hashes. Equal texts
have equal roots, and where roots differ, the branches that differ lead to the edited paragraphs.

A fingerprint is the root, a colon, and the leaves by 8 digits each: sections joined by "/", paragraphs by ";"
and leaves by ",". All of it are native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sojourn.llm.common import prepare
from sojourn.operators.topk import with_row_index
from sojourn.session import write_once

LEAF_CHARS = 64
LEAF = f"[^.!?]{{1,{LEAF_CHARS}}}[.!?]*|[.!?]+"
_DIGITS = 8


def tree(text: Column) -> Column:
    """The leaves' hashes by section and paragraph."""
    return F.transform(
        F.split(text, "\n\n"),
        lambda section: F.transform(
            F.split(section, "\n"),
            lambda paragraph: F.transform(F.regexp_extract_all(paragraph, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x)),
        ),
    )


def _parent(children: Column) -> Column:
    return F.md5(F.array_join(children, ""))


def paragraph_nodes(leaves: Column) -> Column:
    """Hashes of the paragraphs, by section."""
    return F.transform(leaves, lambda section: F.transform(section, _parent))


def section_nodes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, _parent)


def root(leaves: Column) -> Column:
    return _parent(section_nodes(paragraph_nodes(leaves)))


def fingerprint(leaves: Column) -> Column:
    short = F.transform(
        leaves,
        lambda section: F.array_join(
            F.transform(
                section,
                lambda paragraph: F.array_join(F.transform(paragraph, lambda x: F.substring(x, 1, _DIGITS)), ","),
            ),
            ";",
        ),
    )
    return F.concat(root(leaves), F.lit(":"), F.array_join(short, "/"))


def leaf_set(print_: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    leaves = F.split(F.substring(print_, 34, 1 << 30), "[,;/]")
    return F.array_distinct(F.filter(leaves, lambda x: x != ""))


def likeness(left: Column, right: Column, left_set: Column, right_set: Column) -> Column:
    """1 for equal fingerprints, else twice the common leaves as a share of both leaf sets."""
    size = F.size(left_set) + F.size(right_set)
    shared = 2 * F.size(F.array_intersect(left_set, right_set)) / F.greatest(size, F.lit(1))
    return F.when(left == right, 1.0).otherwise(shared)


def edited_paragraphs(left: Column, right: Column) -> Column:
    """(section, paragraph) places, from 0, where two trees of `paragraph_nodes` differ; equal sections are skipped.

    Where the numbers of sections or paragraphs differ, the places that only one side has count as edited.
    """

    def differs(x: Column, y: Column, i: Column) -> Column:
        return ~F.get(x, i).eqNullSafe(F.get(y, i))

    sections = F.sequence(F.lit(0), F.greatest(F.size(left), F.size(right)) - 1)

    def within(i: Column) -> Column:
        a = F.coalesce(F.get(left, i), F.array().cast("array<string>"))
        b = F.coalesce(F.get(right, i), F.array().cast("array<string>"))
        places = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b), F.lit(1)) - 1)
        return F.transform(
            F.filter(places, lambda j: differs(a, b, j)),
            lambda j: F.struct(i.alias("section"), j.alias("paragraph")),
        )

    return F.flatten(F.transform(F.filter(sections, lambda i: differs(left, right, i)), within))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and n_chars of each row; a null text is an empty one."""
    prepare(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    leaves = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), tree(text).alias("leaves"))
    return leaves.select("doc_id", "n_chars", fingerprint(F.col("leaves")).alias("fingerprint"))


def with_successor(docs: DataFrame) -> DataFrame:
    """doc_id and text of each document, and of the one with the next smaller id (after the last: the first)
    `next_id`, `next_fingerprint` and `donor`, the first half as many characters as the document has itself.

    Rows of one id are ordered by a hash of their text, and equal rows count as one. Only ids, hashes and
    lengths are sorted. A text is shuffled once, and what its neighbour needs of it once more.
    """
    filled = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = filled.select("*", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("h2"))
    keyed = keyed.groupBy("h1", "h2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    listed = filled.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("h1"),
        F.xxhash64(F.lit(1), "text", "doc_id").alias("h2"),
        F.length("text").alias("n"),
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("h1"), F.col("h2")]
    numbered = write_once(with_row_index(listed.distinct(), order, "place"))
    total = numbered.count()
    before = numbered.select(
        (F.col("place") % total + 1).alias("place"),
        F.col("h1").alias("for1"),
        F.col("h2").alias("for2"),
        F.floor(F.col("n") / 2).cast("int").alias("half"),
    )
    pairs = write_once(numbered.select("h1", "h2", "place").join(before, "place").drop("place"))
    placed = keyed.join(pairs, ["h1", "h2"])
    given = placed.select(  # with the id, so that both sides need the same columns of one shuffle
        F.col("for1").alias("to1"),
        F.col("for2").alias("to2"),
        F.col("doc_id").alias("next_id"),
        F.substring("text", F.lit(1), F.col("half")).alias("donor"),
        fingerprint(tree(F.col("text"))).alias("next_fingerprint"),
    )
    found = placed.join(given, (F.col("h1") == F.col("to1")) & (F.col("h2") == F.col("to2")))
    return found.select("doc_id", "text", "next_id", "donor", "next_fingerprint")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of an edited text and of its successor, and how alike they are.

    The edited text's last half (rounded down) is replaced by as many characters from the successor's begin,
    or by all of it. One row per distinct pair of id and text; an empty table gives none.
    """
    prepare(docs.sparkSession)
    chars = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), chars - F.floor(chars / 2).cast("int")), F.col("donor"))
    texts = with_successor(docs).select(
        "doc_id", "text", "next_id", "next_fingerprint", chars.cast("long").alias("n_chars"), edited.alias("edited")
    )
    prints = texts.select(
        "doc_id",
        "n_chars",
        "next_id",
        "next_fingerprint",
        F.sha2("edited", 256).alias("edited_sha256"),
        tree(F.col("text")).alias("a"),
        tree(F.col("edited")).alias("b"),
    ).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "next_id",
        "next_fingerprint",
        fingerprint(F.col("a")).alias("fingerprint"),
        fingerprint(F.col("b")).alias("edited_fingerprint"),
    )
    sets = prints.select(
        "*",
        leaf_set(F.col("fingerprint")).alias("a"),
        leaf_set(F.col("edited_fingerprint")).alias("b"),
        leaf_set(F.col("next_fingerprint")).alias("c"),
    )
    own, a = F.col("fingerprint"), F.col("a")
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(own, F.col("edited_fingerprint"), a, F.col("b")).alias("near_edited"),
        likeness(own, F.col("next_fingerprint"), a, F.col("c")).alias("near_next"),
        "next_id",
    )


def _sql_tree(text: str) -> str:
    pieces = f"list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: md5(x))"
    return (
        f"list_transform(string_split({text}, chr(10) || chr(10)), "
        f"lambda s: list_transform(string_split(s, chr(10)), lambda p: {pieces}))"
    )


def _sql_fingerprint(leaves: str) -> str:
    node = "md5(array_to_string({}, ''))"
    paragraphs = f"list_transform(s, lambda p: {node.format('p')})"
    top = node.format(f"list_transform({leaves}, lambda s: {node.format(paragraphs)})")
    short = "array_to_string(list_transform(p, lambda x: substr(x, 1, 8)), ',')"
    return (
        f"{top} || ':' || array_to_string(list_transform({leaves}, lambda s: "
        f"array_to_string(list_transform(s, lambda p: {short}), ';')), '/')"
    )


def _sql_likeness(left: str, right: str) -> str:
    def leaves(p: str) -> str:
        return f"list_distinct(list_filter(regexp_split_to_array(substr({p}, 34), '[,;/]'), lambda x: x <> ''))"

    size = f"(len({leaves(left)}) + len({leaves(right)}))"
    shared = f"len(list_intersect({leaves(left)}, {leaves(right)}))"
    return f"CASE WHEN {left} = {right} THEN 1.0 ELSE 2.0 * {shared} / greatest({size}, 1) END"


SQL = f"""
WITH ordered AS (SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC),
      first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next_text,
    coalesce(lead(doc_id) OVER (ORDER BY doc_id DESC), first_value(doc_id) OVER (ORDER BY doc_id DESC)) AS next_id FROM documents),
edited AS (SELECT *, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2)
    AS edited FROM ordered),
trees AS (SELECT doc_id, next_id, length(text) AS n_chars, sha256(edited) AS edited_sha256,
    {_sql_tree("text")} AS a, {_sql_tree("edited")} AS b, {_sql_tree("next_text")} AS c FROM edited),
prints AS (SELECT doc_id, next_id, n_chars, edited_sha256, {_sql_fingerprint("a")} AS fingerprint,
    {_sql_fingerprint("b")} AS edited_fingerprint, {_sql_fingerprint("c")} AS next_fingerprint FROM trees)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
  {_sql_likeness("fingerprint", "edited_fingerprint")} AS near_edited,
  {_sql_likeness("fingerprint", "next_fingerprint")} AS near_next, next_id
FROM prints"""
