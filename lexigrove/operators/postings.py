"""The inverted index: one row per word of a document, and the rows of its variants."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexigrove import schema as S
from lexigrove.functions.once import once
from lexigrove.functions.stem import compounds, stem_column
from lexigrove.functions.text import fold_column, words_column

#: A position as one number: the attribute's place times this, plus the position in the document.
ATTRIBUTE_STEP = 1 << 40


def text_of(name: str, kind: str) -> Column:
    """An attribute as text; arrays as sorted elements after their places."""
    column = F.col(f"`{name}`")
    if kind in S.MULTI:
        return F.array_join(F.transform(F.array_sort(F.filter(column.cast("array<string>"), lambda x: x.isNotNull())), lambda x, i: F.concat(i.cast("string"), F.lit("."), x)), ".")
    if kind == S.GEO:
        return F.concat_ws(".", F.lit("lat"), column["lat"].cast("string"), F.lit("lng"), column["lng"].cast("string"))
    return column.cast("string")


def postings(docs: DataFrame, attributes: Sequence[tuple[str, str]], doc_id: str = "doc_id") -> DataFrame:
    """(term, doc_id, attribute, position, folded) of every word of the (name, kind) attributes, in their order.

    Positions count from 1 through all attributes of a document. No shuffle; each word is folded once, whatever is asked of its
    term later. Null texts have no words.
    """
    # the generator's input is an expression: of a column, Spark would filter by its size first, and look for the words again
    lists = [F.coalesce(words_column(text_of(name, kind)), F.array().cast("array<string>")) for name, kind in attributes]
    key = F.col(f"`{doc_id}`").alias("doc_id")
    if len(lists) == 1:
        each, attribute = docs.select(key, F.posexplode(lists[0]).alias("at", "word")), F.lit(0)
    else:
        names, attribute = [f"w{i}" for i in range(len(lists))], F.lit(len(lists) - 1)
        rows = docs.select(key, *(words.alias(n) for words, n in zip(lists, names)))
        each = rows.select("*", F.posexplode(F.concat(*names)).alias("at", "word"))
        ends = [F.size("w0")]
        for n in names[1:-1]:
            ends.append(ends[-1] + F.size(n))
        for i in reversed(range(len(ends))):
            attribute = F.when(F.col("at") < ends[i], F.lit(i)).otherwise(attribute)
    each = once(each, fold_column(F.col("word")), "term")
    return each.select("term", "doc_id", attribute.alias("attribute"), (F.col("at") + 1).alias("position"), (F.col("term") != F.lower("word")).alias("folded"))


def with_variants(base: DataFrame, languages: DataFrame | str | None = None, split_compounds: bool = False) -> DataFrame:
    """The postings with those of their stems and compound parts, at the same positions and marked as folded.

    Stems and parts are found once per distinct word and language, where those that are equal become one, and joined back. A
    position of a document has one word, and no variant is its own word, so no (term, document, position) comes twice.
    languages: the one of all documents, or (doc_id, language), or (doc_id, attribute, language) with one for each attribute.
    """
    plain = base.withColumn("variant", F.lit(False))
    if isinstance(languages, DataFrame):
        own = base.join(languages, ["doc_id", "attribute"] if "attribute" in languages.columns else "doc_id", "left")
    else:
        own = base.withColumn("language", F.lit(languages).cast("string"))
    own = own.withColumn("language", F.coalesce("language", F.lit("")))
    words, found = own.select("term", "language").distinct(), []
    if languages is not None:
        found.append(words.select("term", "language", stem_column(F.col("term"), F.col("language")).alias("other")).where("other <> term"))
    if split_compounds:
        found.append(words.join(compounds(base).withColumnRenamed("part", "other"), "term").select("term", "language", "other"))
    if not found:
        return plain
    variants = (found[0] if len(found) == 1 else found[0].unionByName(found[1])).distinct()
    marked = (F.col("other").alias("term"), "doc_id", "attribute", "position", F.lit(True).alias("folded"), F.lit(True).alias("variant"))
    return plain.unionByName(own.join(variants, ["term", "language"]).select(*marked))


def with_form(rows: DataFrame, form: Column, repeated: DataFrame | None = None) -> DataFrame:
    """The postings with those of another form of each word, made from the word alone and marked as folded; of equal (term, document, position) the plain word's stays.

    A position of a document has one word, so what is equal is made from one row and nothing is shuffled. repeated: (doc_id) of
    the ids that several documents have, whose words are compared with one another.
    """
    plain, other = F.struct("term", "folded", F.lit(False).alias("variant")), F.struct(F.col("__form").alias("term"), F.lit(True).alias("folded"), F.lit(True).alias("variant"))
    each = rows.withColumn("__form", form).select("doc_id", "attribute", "position", F.inline(F.when(F.col("__form") != F.col("term"), F.array(plain, other)).otherwise(F.array(plain))))
    each = each.select("term", "doc_id", "attribute", "position", "folded", "variant")
    if repeated is None or repeated.isEmpty():
        return each
    ids = repeated.select(F.col("doc_id").alias("__id"))
    same = F.col("doc_id").eqNullSafe(F.col("__id"))
    return each.join(ids, same, "left_anti").unionByName(first_of_position(each.join(ids, same, "left_semi")))


def first_of_position(rows: DataFrame) -> DataFrame:
    """One row per (term, doc_id, position), the plain word's before its variants'."""
    w = Window.partitionBy("doc_id", "position", "term").orderBy("variant", "attribute")
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def vocabulary(rows: DataFrame) -> DataFrame:
    """(term, length) of the distinct terms."""
    return rows.select("term").distinct().withColumn("length", F.length("term"))


def prefixes(vocab: DataFrame, least: int, most: int) -> DataFrame:
    """(prefix, term) of every proper prefix of least to most letters."""
    ends = F.sequence(F.lit(least), F.least(F.lit(most), F.col("length") - 1))
    return vocab.where(F.col("length") > least).select(F.explode(F.transform(ends, lambda i: F.substring("term", F.lit(1), i))).alias("prefix"), "term")


def states(term: Column, alphabet: int, length: int) -> Column:
    """States that a term runs through in the automaton over letters folded to an alphabet: from each, one per letter."""
    letters = F.filter(F.split(F.substring(term, 1, length), ""), lambda c: c != "")
    return F.aggregate(letters, F.array().cast("array<bigint>"), lambda s, c: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) * alphabet + F.ascii(c) % alphabet + 1)))
