"""Quality rules whose thresholds follow each language and source.

Fixed cut-offs misjudge languages with longer words or sources with tables.
Here every measure's cut-offs come from mergeable quantile sketches per
language and source: counts of rows in cells of equal relative width, with the
largest value of each cell.  Partial counts form where the rows are, so a
source with a third of all rows costs no more than another; sums and maxima do
not depend on order, so any run and any partitioning gives the same cut-offs;
and sketches of sources add up to those of languages and of the corpus, so the
rows are read once.  A group's cut-offs are
drawn towards its language's as though it had ``prior`` rows more with those,
and a language's towards the corpus's in the same way, so that a group of any
size is judged by one rule.  The cut-offs are joined back and the rows
filtered.

Only built-in functions run here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: White space that parts words, and symbols counted (fixed values).
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: Measures, in the order of their cut-offs.
MEASURES = ("symbol_share", "dup_line_share", "repeat_share", "word_length")

#: What one incident adds to each measure in a text of one word: a symbol, a
#: repeated line, a window of five words said twice; word length has no steps.
INCIDENTS = (1.0, 5.0, 10.0, 0.0)


@dataclass(frozen=True)
class QualityRules:
    """Base rules: fewest words, and the share of repeated words in percent.

    Adaptive rules: a text fails where a measure lies beyond the group's
    ``upper`` quantile plus ``reach`` times the distance from the median to
    that quantile.  Where most texts are alike that distance is nothing, so it
    is at least what one incident makes in the group's median text.
    ``prior``: rows that the wider group's cut-offs count for.  ``cells``:
    cells of a sketch for each doubling of a value, so that a quantile is off
    by one part in ``cells`` at most.
    """

    least_words: int = 10
    repeat_percent: int = 20
    upper: float = 0.75
    reach: float = 4.0
    prior: int = 200
    cells: int = 64


def _words(text: Column) -> Column:
    blank = F.translate(text, BLANKS, " " * len(BLANKS))
    return F.filter(F.split(blank, " "), lambda w: w != "")


def measured(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Costly steps run only for the texts that need them: a text whose 5-word
    window hashes are all distinct has no repeated window, and one whose lines
    are all distinct no repeated line.  For the others windows are sorted with
    hash and place in one long, so that equal windows become neighbours; those
    found are compared again by their words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("_text", text).withColumn("_words", _words(F.col("_text")))
    docs = docs.withColumns({"_lines": F.split("_text", "\n"), "_hash": F.transform("_words", lambda w: F.xxhash64(w))})
    marked = F.lit(False)
    for symbol in SYMBOLS:
        marked = marked | F.col("_text").contains(symbol)
    full = F.filter("_lines", lambda x: F.translate(x, BLANKS, "") != "")
    n = F.size("_words")
    docs = docs.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.when(marked, F.length("_text") - F.length(F.translate("_text", SYMBOLS, "")))
            .otherwise(F.lit(0))
            .cast("long"),
            "n_dup_lines": F.when(
                F.size(F.array_distinct("_lines")) < F.size("_lines"), F.size(full) - F.size(F.array_distinct(full))
            )
            .otherwise(F.lit(0))
            .cast("long"),
            "_two": F.zip_with("_hash", F.slice("_hash", 2, F.greatest(n, F.lit(1))), lambda x, y: F.xxhash64(x, y)),
        }
    )
    docs = docs.withColumn("_four", F.zip_with("_two", F.slice("_two", 3, F.greatest(n, F.lit(1))), lambda x, y: F.xxhash64(x, y)))
    five = F.zip_with("_four", F.slice("_hash", 5, F.greatest(n, F.lit(1))), lambda x, y: F.xxhash64(x, y))
    docs = docs.withColumn("_five", F.slice(five, 1, F.greatest(n - 4, F.lit(0))))
    repeated = F.size(F.array_distinct("_five")) < F.size("_five")
    # 2^20 words leave 43 bits of hash; longer texts leave fewer.
    docs = docs.withColumn("_bits", F.greatest(F.lit(20), F.length(F.bin(n)) + 1))
    key = F.expr("transform(_five, (h, i) -> shiftleft(shiftright(h, _bits + 1), _bits) + i + 1)")
    docs = docs.withColumn("_keys", F.when(repeated, F.sort_array(key)))
    twin = F.expr(
        "filter(_keys, (k, i) -> shiftright(k, _bits) = shiftright(get(_keys, i - 1), _bits)"
        " or shiftright(k, _bits) = shiftright(get(_keys, i + 1), _bits))"
    )
    docs = docs.withColumn("_twins", twin)
    place = "cast(k - shiftleft(shiftright(k, _bits), _bits) as int)"
    windows = F.expr(
        f"array_sort(transform(_twins, k -> struct(_hash[{place} - 1] as a, _hash[{place}] as b, _hash[{place} + 1] as c,"
        f" _hash[{place} + 2] as d, _hash[{place} + 3] as e, {place} as p)))"
    )
    docs = docs.withColumn("_windows", F.when(F.size("_twins") > 0, windows))
    same = "x.a = {0}.a and x.b = {0}.b and x.c = {0}.c and x.d = {0}.d and x.e = {0}.e"
    places = F.expr(
        "sort_array(transform(filter(_windows, (x, i) ->"
        f" ({same.format('get(_windows, i - 1)')}) or ({same.format('get(_windows, i + 1)')})), x -> x.p))"
    )
    docs = docs.withColumn("_places", places)
    covered = F.expr("aggregate(transform(_places, (p, i) -> if(i = 0, 5, least(5, p - _places[i - 1]))), 0L, (s, x) -> s + x)")
    docs = docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    return docs.drop(*[c for c in docs.columns if c.startswith("_")])


def _sketched(measures: DataFrame, keys: list[str], rules: QualityRules) -> DataFrame:
    """(keys, measure, cell, n, top): sketches of every measure per group; of a
    group at most some thousands of rows, whatever its size."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in (*MEASURES, "step")]))
    cell = F.when(F.col("value") > 0, F.floor(F.log2("value") * rules.cells)).otherwise(F.lit(-(1 << 40)))
    rows = measures.select(*keys, each.alias("m")).select(*keys, "m.measure", "m.value")
    return rows.groupBy(*keys, "measure", cell.cast("long").alias("cell")).agg(F.count("*").alias("n"), F.max("value").alias("top"))


def _merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "cell").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def _thresholds(sketches: DataFrame, keys: list[str], rules: QualityRules) -> DataFrame:
    """(keys, _rows, max_ of each measure): a quantile is the largest value of
    the cell in which its rank falls."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketches.withColumns({"_upto": F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("n").over(group)})
    at = lambda m, q: F.min(F.when((F.col("measure") == m) & (F.col("_upto") >= F.ceil(F.col("_all") * q)), F.struct("cell", "top")))["top"]
    limits = []
    for m, incident in zip(MEASURES, INCIDENTS, strict=True):
        high, mid = at(m, rules.upper), at(m, 0.5)
        limits.append((high + rules.reach * F.greatest(high - mid, incident * at("step", 0.5))).alias(f"max_{m}"))
    return ranked.groupBy(*keys).agg(F.max("_all").alias("_rows"), *limits)


def quality_decisions(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the measures with cut-offs.

    docs: doc_id, text, lang, source.  Null and empty texts have no words and
    fail the base rules; null lang and source are groups of their own;
    repeated rows are judged alike; other columns are ignored; no rows give
    no rows.
    """
    counts = measured(docs.select("doc_id", "text", "lang", "source")).drop("text")
    n = F.greatest(F.col("n_words"), F.lit(1))
    counts = counts.withColumns(
        {
            "symbol_share": F.col("n_symbols") / n,
            "dup_line_share": F.col("n_dup_lines") / n * 5,
            "repeat_share": F.col("n_repeat_words") / n,
            "word_length": F.col("word_chars") / n,
            "base_failed": (F.col("n_words") < rules.least_words)
            | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words")),
        }
    )
    counts = staged(counts, "quality")
    sound = counts.where("not base_failed").withColumn("step", 1 / n)
    sketches = staged(_sketched(sound, ["lang", "source"], rules), "sketches")
    own = _thresholds(sketches, ["lang", "source"], rules)
    language = _thresholds(_merged(sketches, ["lang"]), ["lang"], rules)
    corpus = _thresholds(_merged(sketches, []), [], rules).select(*[F.col(f"max_{m}").alias(f"all_{m}") for m in MEASURES])
    own = own.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.col("_rows").alias("_own_rows"), *[F.col(f"max_{m}").alias(f"own_{m}") for m in MEASURES])
    language = language.select(F.col("lang").alias("_k"), F.col("_rows").alias("_lang_rows"), *[F.col(f"max_{m}").alias(f"lang_{m}") for m in MEASURES])
    joined = (
        counts.join(own, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
        .join(language, F.col("lang").eqNullSafe(F.col("_k")), "left")
        .crossJoin(F.broadcast(corpus))
    )

    def drawn(limit: Column, rows: Column, wider: Column) -> Column:
        """A limit as the mean with the wider group's, which counts as ``prior`` rows."""
        return F.coalesce((rows * limit + rules.prior * wider) / (rows + rules.prior), wider)

    passes = F.lit(True)
    for m in MEASURES:
        limit = drawn(F.col(f"lang_{m}"), F.col("_lang_rows"), F.col(f"all_{m}"))
        limit = drawn(F.col(f"own_{m}"), F.col("_own_rows"), limit)
        passes = passes & F.coalesce(F.col(m) <= limit, F.lit(True))
    return joined.select(
        "doc_id",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"],
        (~F.col("base_failed") & passes).alias("kept"),
        *MEASURES,
    )
