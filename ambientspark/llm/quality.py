"""Quality rules: a threshold table compiled into one Spark projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Shorter texts say nothing by their stop words.
STOP_WORDS_FROM = 50
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the of and to in a is that it for on was as be with by this are or at from an not have has "
    "der die das und in den von zu mit ist im für auf nicht eine ein des dem sich als auch es an "
    "The Der Die Das In La Le Les El Los De Et Und "
    "de la le les et des en un une du que est pour dans qui sur pas au avec ce il ne se plus par "
    "el los las del y que en un una por con no su para es se al lo como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if its metric lies outside [least, most]; a metric without a value (no words) never fails."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The base rules decide base_failed; of the words in repeated 5-word windows at most a fifth may be.
BASE = (Rule("few_words", "n_words", least=10), Rule("repeated_words", "repeat_percent", most=20))
RULES = (
    Rule("word_length", "mean_word_chars", least=1.5, most=25),
    Rule("symbols", "symbols_per_word", most=0.3),
    Rule("stop_words", "stop_word_ratio", least=0.01),
    Rule("duplicate_lines", "dup_line_ratio", most=0.5),
    Rule("upper_case", "upper_char_ratio", most=0.5),
)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _windows(words: Column, size: int) -> Column:
    """Hashes of the windows of `size` words, in order; none if there are fewer words."""

    def hashes(h: Column) -> Column:
        return F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)])), 1, F.greatest(F.size(h) - size + 1, F.lit(0)))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), hashes)


def _covered(windows: Column, size: int) -> Column:
    """Words that lie in a window found twice or more.

    Sorts (hash, place), keeps the places whose hash equals a neighbour's, and adds up what each adds in order of place.
    """

    def in_order(pairs: Column) -> Column:
        both = F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
        return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

    def total(places: Column) -> Column:
        nexts = F.concat(F.slice(places, 2, F.size(places)), F.array(F.lit(2**31 - 1)))
        return F.aggregate(F.zip_with(places, nexts, lambda a, b: F.least(b - a, F.lit(size))), F.lit(0), lambda s, x: s + x)

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        _let(_let(pairs, in_order), lambda places: F.when(F.size(places) == 0, F.lit(0)).otherwise(total(places))))


def metric_struct(text: str = "text", stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> Column:
    """All metrics of a text in one expression, which evaluates each part once."""
    body = F.coalesce(F.col(text), F.lit(""))
    spaced = body
    for c in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(spaced, " ", -1), "")
    lines = F.filter(F.split(body, "\n", -1), lambda line: line.rlike(f"[^{SPACES}]"))

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _let(_windows(w, WINDOW), lambda h: _covered(h, WINDOW)).cast("long").alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(list(stop_words)))).cast("long").alias("n_stop_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"))

    counted = F.struct(
        _let(words, measured).alias("w"),
        F.regexp_count(body, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit("\\p{Lu}")).alias("n_upper"),
        _let(lines, lambda a: F.struct(F.size(a).alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))).alias("l"))

    def ratios(c: Column) -> Column:
        w, n = c["w"], F.nullif(c["w"]["n_words"], F.lit(0).cast("long"))
        return F.struct(
            w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), c["n_symbols"].alias("n_symbols"),
            c["l"]["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
            (100 * w["n_repeat_words"] / n).alias("repeat_percent"), (w["word_chars"] / n).alias("mean_word_chars"),
            (c["n_symbols"] / n).alias("symbols_per_word"), F.when(n >= STOP_WORDS_FROM, w["n_stop_words"] / n).alias("stop_word_ratio"),
            (c["n_upper"] / F.nullif(w["word_chars"], F.lit(0).cast("long"))).alias("upper_char_ratio"),
            (c["l"]["n_dup_lines"] / F.nullif(c["l"]["n_lines"], F.lit(0))).alias("dup_line_ratio"))

    return _let(counted, ratios)


def metrics(docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> DataFrame:
    """docs with the struct `quality_metrics` beside their own columns. Built-in functions only, no shuffle.

    Words are what ASCII white space separates. Windows of five words are compared by 64-bit hashes of their words' hashes inside
    one text. A null text has no words and counts of 0; ratios to zero words or lines are null.
    """
    return docs.withColumn("quality_metrics", metric_struct(text, stop_words))


def _outside(rule: Rule, found: Column) -> Column:
    value = found[rule.metric]
    low = F.lit(False) if rule.least is None else value < rule.least
    high = F.lit(False) if rule.most is None else value > rule.most
    return F.coalesce(low | high, F.lit(False))


def _any_outside(rules: tuple[Rule, ...], found: Column) -> Column:
    failed = F.lit(False)
    for r in rules:
        failed = failed | _outside(r, found)
    return failed


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text",
           stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> DataFrame:
    """docs with quality_metrics, base_failed, kept and failed_rules (names, in the tables' order), in place of columns of these names that docs has.

    Every row stays, repeated ones too; a document is kept if it fails no rule of either table. The stop words given are those of four languages (English, German,
    French, Spanish): a text of STOP_WORDS_FROM words or more in another language fails the rule on them unless its own are added.
    """
    scored = metrics(docs, text, stop_words)
    found = F.col("quality_metrics")
    failed = F.filter(F.array(*[F.when(_outside(r, found), F.lit(r.name)) for r in (*base, *rules)]), lambda x: x.isNotNull())
    return scored.withColumns({"base_failed": _any_outside(base, found), "failed_rules": failed}).withColumn("kept", F.size("failed_rules") == 0)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, text: str = "text",
            stop_words: tuple[str, ...] | list[str] = STOP_WORDS) -> DataFrame:
    """The rows of docs that fail no rule of either table, with the columns of docs.

    The condition is one expression over one struct: a filter on the columns of `judged` would be pushed below them and
    evaluate the metrics once for each rule.
    """
    return docs.where(_let(metric_struct(text, stop_words), lambda found: ~_any_outside((*base, *rules), found)))
