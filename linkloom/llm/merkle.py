"""Document fingerprints: a Merkle tree over sections, paragraphs and blocks.

A section ends with a blank line, a paragraph with a line break, and a block is
BLOCK code points of a paragraph; nothing of the text lies outside a block. Each
node is the hash of its children's hashes, so equal roots mean equal texts, and
two trees are compared from the root down: branches with equal hashes are
skipped, differing ones lead to the edited block. Everything is a Spark SQL
expression of one row; only finding the next document needs a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.llm.common import partition_keys

BLOCK = 32
SECTIONS, PARAGRAPHS, BLOCKS = r"(?s).+?(?:\n\n+|\z)", r"[^\n]*\n|[^\n]+", f"(?s).{{1,{BLOCK}}}"


def parts(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds `name`, the tree of column `text`: root, section and paragraph hashes, and the blocks' (60 bits each)."""
    leaves = F.transform(parts(F.col(text), SECTIONS), lambda s: F.transform(parts(s, PARAGRAPHS), lambda p: F.transform(parts(p, BLOCKS), F.md5)))
    df = df.withColumn("_leaves", leaves)
    df = df.withColumn("_paragraphs", F.transform("_leaves", lambda s: F.transform(s, lambda p: F.md5(F.concat(F.lit("p"), F.array_join(p, ""))))))
    df = df.withColumn("_sections", F.transform("_paragraphs", lambda s: F.md5(F.concat(F.lit("s"), F.array_join(s, "")))))
    short = F.transform("_leaves", lambda s: F.transform(s, lambda p: F.transform(p, lambda b: F.conv(F.substring(b, 1, 15), 16, 10).cast("bigint"))))
    tree = F.struct(
        F.sha2(F.concat(F.lit("d"), F.array_join("_sections", "")), 256).alias("root"),
        F.col("_sections").alias("sections"), F.col("_paragraphs").alias("paragraphs"), short.alias("blocks"),
    )
    return df.withColumn(name, tree).drop("_leaves", "_paragraphs", "_sections")


def likeness(a: str, b: str) -> Column:
    """1 for equal roots, else twice the common distinct blocks over the distinct blocks of both (0 if one has none)."""
    left, right = (F.array_distinct(F.flatten(F.flatten(f"{x}.blocks"))) for x in (a, b))
    both = F.size(left) + F.size(right)
    return F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), 1.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / both)


def first_difference(a: str, b: str) -> Column:
    """'section/paragraph/block' (each from 0) of the first differing branch; null for equal roots."""
    section = _first(f"{a}.sections", f"{b}.sections")
    paragraph = _first(f"get({a}.paragraphs, {section})", f"get({b}.paragraphs, {section})")
    block = _first(f"get(get({a}.blocks, {section}), {paragraph})", f"get(get({b}.blocks, {section}), {paragraph})")
    return F.expr(f"if({a}.root = {b}.root, null, concat_ws('/', {section}, {paragraph}, {block}))")


def _first(a: str, b: str) -> str:
    m = f"greatest(coalesce(size({a}), 0), coalesce(size({b}), 0))"
    return f"coalesce(get(filter(sequence(0, {m}), i -> not (get({a}, i) <=> get({b}, i))), 0), 0)"


#: Bytes of text in a range of ids, about.
RANGE = 64 << 20


def with_next(docs: DataFrame, id_column: str, columns: list[str], tie: Column, least: int = 1) -> DataFrame:
    """Adds `next_<column>` of the row that follows in the order of ids; after the last comes the first.

    Ids are cut into ranges of about equal size; each range is ordered by a task
    of its own and holds a copy of the first row of the next range as its last
    one. Only the cuts and each range's first id reach the driver. There are `least`
    ranges or more.
    """
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)
    ids = docs.select(id_column)
    cuts = sorted({float(c) for c in ids.approxQuantile(id_column, [i / ranges for i in range(1, ranges)], 0.25 / ranges)}) if ranges > 1 else []
    number = F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts)}), c -> c <= {id_column}))") if cuts else F.lit(0)
    number = F.when(F.col(id_column).isNull(), 0).otherwise(number)
    heads = ids.withColumn("_range", number).groupBy("_range").agg(F.min(F.struct(F.col(id_column).isNotNull().alias("known"), F.col(id_column).alias("id"))).alias("h")).orderBy("_range").collect()
    if not heads:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in columns))
    after = {h["h"]["id"]: heads[k - 1]["_range"] for k, h in enumerate(heads)}  # a range's first row also ends the range before
    known = [i for i in after if i is not None]
    first = docs.where(F.col(id_column).isin(known) | (F.col(id_column).isNull() if None in after else F.lit(False)))
    one = Window.partitionBy(id_column).orderBy(tie)
    first = first.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    place = F.coalesce(*(F.when(F.col(id_column).eqNullSafe(F.lit(i)), F.lit(r)) for i, r in after.items()))
    rows = docs.withColumns({"_range": number, "_copy": F.lit(False)}).unionByName(first.withColumns({"_range": place, "_copy": F.lit(True)}))
    keys = partition_keys(spark, ranges)  # small numbers would meet in some partitions and leave others empty
    rows = rows.withColumn("_range", F.get(F.array(*map(F.lit, keys)), F.col("_range").cast("int"))).repartition(ranges, "_range")
    order = Window.partitionBy("_range").orderBy("_copy", F.col(id_column).asc_nulls_first(), tie)
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(~F.col("_copy")).drop("_range", "_copy")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text and `tree` of every row, repeated rows each.

    A null text is empty: a root over no sections. A text of any length is hashed
    whole, within its row; an empty table gives no rows.
    """
    return with_tree(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "tree")


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Each document's tree against that of an edited text and that of the next document.

    The edited text has its last quarter replaced by the start of the next
    document, in the order of doc_id (null ids first, equal ids by text hash).
    A null text is empty; a text of any length is hashed whole, by one row's expression.
    Repeated rows are rows of their own; a single row is its own next; an empty
    table gives no rows; other columns are left unread.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = with_next(texts, "doc_id", ["text"], F.xxhash64("text"), size // RANGE)  # trees are larger than texts, so only texts are shuffled
    rows = with_tree(with_tree(rows, "text", "tree"), "next_text", "next_tree")
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    rows = rows.select("doc_id", "n_chars", "tree", "next_tree", edited.alias("edited"))
    return with_tree(rows, "edited", "edited_tree")
