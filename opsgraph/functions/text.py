"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words left out of questions (never out of documents).
STOPWORDS = tuple(
    """
    a an and are as at be but by for from has have how i if in into is it its of on
    or that the their then there these they this to was were what when where which
    who why will with you your do does did been being had not no can could would
    should about after all any before more most other some such than
    """.split()
)
#: A word or an identifier, after lower-casing; ASCII only, so accents end a token.
TOKEN = "[a-z0-9_]+"


def tokens(text: str | Column) -> Column:
    """All tokens in order, repeats included; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def query_terms(text: str | Column) -> Column:
    """Tokens without stopwords; all tokens if nothing else is left."""
    found = tokens(text)
    kept = F.filter(found, lambda t: ~t.isin(*STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(found)


def _cut(term: Column, n: int) -> Column:
    return F.expr("''") if n is None else F.substring(term, F.lit(1), F.length(term) - n)


def stem(term: Column) -> Column:
    """A light English stem: plural endings, then -eed, -ed or -ing where a vowel stays. Names with digits and short words stay as they are."""
    plural = (
        F.when(F.endswith(term, F.lit("sses")), F.concat(_cut(term, 4), F.lit("ss")))
        .when(F.endswith(term, F.lit("ies")), F.concat(_cut(term, 3), F.lit("i")))
        .when(F.endswith(term, F.lit("ss")), term)
        .when(F.endswith(term, F.lit("s")), _cut(term, 1))
        .otherwise(term)
    )

    def past(t: Column) -> Column:
        fits = lambda ending: F.endswith(t, F.lit(ending)) & (F.length(t) - len(ending) >= 3) & F.rlike(_cut(t, len(ending)), F.lit("[aeiou]"))
        return F.when(fits("eed"), F.concat(_cut(t, 3), F.lit("e"))).when(fits("ed"), _cut(t, 2)).when(fits("ing"), _cut(t, 3)).otherwise(t)

    stemmed = past(plural)
    return F.when(F.rlike(term, F.lit("[0-9]")) | (F.length(term) <= 3), term).otherwise(F.when(stemmed == "", F.lit("x")).otherwise(stemmed))


def stemmed_tokens(text: str | Column) -> Column:
    return F.transform(tokens(text), stem)


def stemmed_query_terms(text: str | Column) -> Column:
    """Stopwords go before stems are taken, or "this" would come back as "thi"."""
    return F.transform(query_terms(text), stem)


def approx_tokens(text: str | Column) -> Column:
    """A token for every four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def capitalised(text: str | Column) -> Column:
    """First letter upper case, all others lower: not every word's, as initcap has it."""
    c = F.col(text) if isinstance(text, str) else text
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def blank_to_null(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.trim(c) != "", c)


def paragraphs(*parts: Column) -> Column:
    """The parts that aren't null or empty, a blank line between them."""
    return F.concat_ws("\n\n", *(F.when(p != "", p) for p in parts))


def fingerprint(rows: DataFrame, by: str, text: str, order: str, width: int = 1024, levels: int = 3) -> DataFrame:
    """(by, fingerprint): a digest of each group's texts that depends on their order.

    A tree: texts' sha256 (each text closed by NUL) are joined by runs of `width` order numbers, the
    runs' digests by runs of `width` runs, and so on; no row gathers more than that until the last.
    """
    now = rows.select(by, F.col(order).alias("_o"), F.sha2(F.concat(F.col(text), F.lit("\0")), 256).alias("_d"))
    for level in range(levels):
        last = level == levels - 1
        keys = [F.col(by)] if last else [F.col(by), F.floor(F.col("_o") / width).alias("_o")]
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_d"))), lambda x: x["_d"]), "")
        now = now.groupBy(*keys).agg(F.sha2(joined, 256).alias("_d"))
    return now.withColumnRenamed("_d", "fingerprint")
