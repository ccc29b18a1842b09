"""Licence scans with a positional index of rare words.

A template is a licence phrase with a mandatory part. The corpus gives each
licence word its document frequency. Of each mandatory part, the ANCHORS words of
highest IDF are posted: word -> (template, place in the mandatory part). A file
looks its licence words up; every hit of a posted word proposes a start of the
template, and the starts that the different anchors propose are intersected, so
that only places remain where the rare words stand at their relative positions.
There the mandatory words are verified, and a licence is named if enough of the
whole template agrees. As every place of a mandatory part holds all its anchors,
no place is missed. Phrases that are mandatory as a whole give the base labels.
All is one row's SQL expression; only the document frequencies (one number for
each licence word) are aggregated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a template's words that have to agree.
AGREE = 0.5
#: Rare words of a mandatory part whose places are intersected.
ANCHORS = 2
#: More than the words of any text.
PLACES = 1 << 32

#: Phrases and labels; the mandatory words stand in brackets.
BASE = [
    ("gpl", "[gnu general public license]"),
    ("apache", "[apache license]"),
    ("cc-by", "[cc by]"),
    ("mit", "[mit license]"),
]
MORE = [
    ("gpl-2.0", "licensed under the [gnu general public license version 2]"),
    ("gpl-3.0", "licensed under the [gnu general public license version 3]"),
    ("lgpl", "licensed under the gnu [lesser general public license]"),
    ("agpl", "licensed under the gnu [affero general public license]"),
    ("apache-2.0", "licensed under the [apache license version 2 0]"),
    ("mit-grant", "[permission is hereby granted free of charge] to any person obtaining a copy of this software"),
    ("cc-by-4.0", "licensed under [cc by 4 0]"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc-by-nc", "licensed under [cc by nc] 4 0"),
    ("cc-by-nd", "licensed under [cc by nd] 4 0"),
    ("cc0", "[cc0 1 0] universal public domain dedication"),
    ("creative-commons", "licensed under a [creative commons attribution] 4 0 international license"),
    ("bsd", "[redistribution and use in source and binary forms] with or without modification are permitted"),
    ("mpl-2.0", "subject to the terms of the [mozilla public license] v 2 0"),
    ("epl", "under the terms of the [eclipse public license]"),
    ("isc", "released under the [isc license]"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    first: int  # of the mandatory words
    mandatory: tuple[str, ...]
    base: bool


def templates() -> list[Template]:
    out = []
    for base, some in ((True, BASE), (False, MORE)):
        for label, phrase in some:
            before, rest = phrase.split("[")
            inside, after = rest.split("]")
            out.append(Template(label, (*before.split(), *inside.split(), *after.split()), len(before.split()), tuple(inside.split()), base))
    return out


def with_words(docs: DataFrame) -> DataFrame:
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0)).alias("words"))


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of a fixed vocabulary stands."""
    found = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def quoted(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and `found`: array of (label, base, start word of the mandatory part, agreement 0 to 1).

    A null, empty or wordless text has no words and nothing found. Texts are
    scanned whole, however long. Repeated rows are scanned each; an empty table
    gives no rows; other columns are left unread.
    """
    known = templates()
    words = with_words(docs)
    frequency = document_frequencies(words, sorted({w for t in known for w in t.mandatory}))
    # anchor number -> word -> (template, place); a template with fewer different words has its first anchor in the other lists too
    postings: list[dict[str, list[str]]] = [{} for _ in range(ANCHORS)]
    for k, t in enumerate(known):
        by_idf = sorted(range(len(t.mandatory)), key=lambda i: (frequency.get(t.mandatory[i], 0), i))
        rare = [i for n, i in enumerate(by_idf) if t.mandatory[i] not in {t.mandatory[j] for j in by_idf[:n]}]
        for posted, place in zip(postings, [*rare, *[rare[0]] * ANCHORS], strict=False):
            posted.setdefault(t.mandatory[place], []).append(f"named_struct('t', {k}, 'at', {place})")
    looked_up = ", ".join(f"'{w}'" for w in sorted(set().union(*postings)))
    spec = "array(" + ", ".join(
        f"named_struct('label', '{t.label}', 'base', {str(t.base).lower()}, 'first', {t.first}, 'words', {quoted(t.words)}, 'mandatory', {quoted(t.mandatory)})" for t in known
    ) + ")"

    hits = words.withColumn("hits", F.expr(f"filter(transform(words, (w, i) -> named_struct('w', w, 'i', i)), h -> h.w in ({looked_up}))"))
    proposed = []
    for posted in postings:
        index = "map(" + ", ".join(f"'{w}', array({', '.join(p)})" for w, p in sorted(posted.items())) + ")"
        own = ", ".join(f"'{w}'" for w in sorted(posted))
        # a template and a start are one number, so that the intersection hashes numbers
        proposed.append(f"flatten(transform(filter(hits, h -> h.w in ({own})), h -> transform(filter({index}[h.w], p -> p.at <= h.i), p -> p.t * {PLACES}L + h.i - p.at)))")
    both = proposed[0]
    for other in proposed[1:]:
        both = f"array_intersect({both}, {other})"
    aligned = hits.withColumn("aligned", F.expr(f"transform({both}, a -> named_struct('t', cast(a div {PLACES}L as int), 'start', cast(a % {PLACES}L as int)))"))
    there = aligned.withColumn("there", F.expr(f"filter(aligned, a -> slice(words, a.start + 1, size({spec}[a.t].mandatory)) = {spec}[a.t].mandatory)"))
    agree = f"size(filter(sequence(0, size({spec}[a.t].words) - 1), j -> get(words, a.start - {spec}[a.t].first + j) = {spec}[a.t].words[j])) / size({spec}[a.t].words)"
    found = F.expr(f"transform(there, a -> named_struct('label', {spec}[a.t].label, 'base', {spec}[a.t].base, 'start', a.start, 'agreement', {agree}))")
    return there.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.filter(found, lambda x: x["agreement"] >= AGREE).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """One row for each document: counts and first and last place of the base phrases, labels, and the best agreement."""
    base = "filter(found, x -> x.base)"
    return scanned.select(
        "doc_id",
        "n_words",
        F.expr(f"cast(size({base}) as bigint)").alias("n_base"),
        F.expr(f"cast(array_min(transform({base}, x -> x.start)) as bigint)").alias("first_word"),
        F.expr(f"cast(array_max(transform({base}, x -> x.start)) as bigint)").alias("last_word"),
        F.expr(f"array_join(array_sort(array_distinct(transform({base}, x -> x.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(found, x -> x.label))), ',')").alias("labels"),
        F.expr("coalesce(array_max(transform(found, x -> x.agreement)), 0D)").alias("score"),
    )


def sql() -> str:
    """DuckDB SQL for `digest`, which tries every word of every document."""
    found = []
    for t in templates():
        here = f"words[i + 1 : i + {len(t.mandatory)}] = {list(t.mandatory)}"
        agree = " + ".join(f"(i + {j - t.first} >= 0 AND coalesce(words[i + {j - t.first + 1}], '') = '{w}')::INT" for j, w in enumerate(t.words))
        found.append(
            f"CASE WHEN list_has_all(words, {list(t.mandatory)}) THEN list_filter(list_transform(list_filter(range(0, len(words)), lambda i: {here}), "
            f"lambda i: {{'label': '{t.label}', 'base': {str(t.base).lower()}, 'start': i, 'agreement': ({agree}) / {len(t.words)}.0::DOUBLE}}), lambda x: x.agreement >= {AGREE}) ELSE [] END"
        )
    return f"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS words FROM documents
), f AS (
  SELECT doc_id, len(words) AS n_words, flatten([{", ".join(found)}]) AS found FROM w
), b AS (
  SELECT *, list_filter(found, lambda x: x.base) AS base FROM f
)
SELECT doc_id, n_words, len(base)::BIGINT AS n_base,
       list_min(list_transform(base, lambda x: x.start)) AS first_word, list_max(list_transform(base, lambda x: x.start)) AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(found, lambda x: x.label))), ',') AS labels,
       coalesce(list_max(list_transform(found, lambda x: x.agreement)), 0.0)::DOUBLE AS score
FROM b
"""
