"""Personal data: patterned entities, and identifiers found by the contexts that those entities induce."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ambientspark.llm.common import as_rows, staged

KINDS = ("email", "ip", "card", "phone")
#: Stands for a character that is known to be inside an entity; a text's own is replaced first, so positions stay.
MARK = "\ue000"
NO_WORD = "\x01"
#: The base patterns, rewritten without nested repeats so that no text overflows the matcher's stack.
LOCAL = "A-Za-z0-9._%+" + MARK + "-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]*+"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"[0-9][0-9{MARK}]{{12,}}"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IP_OK = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Words with a digit, which may be identifiers of any form.
CANDIDATE = r"(?<!\S)[^\s0-9]*+[0-9]\S*"
LEAST_CANDIDATE = 5
#: Characters on either side in which context words are looked for.
CONTEXT = 60
ROUNDS = 3
#: A pattern counts if it holds at least so many different known entities.
SUPPORT = 3
#: A value is an identifier if its patterns make it so likely.
CONFIDENT = 0.8


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _places(text: Column, pattern: str) -> Column:
    """(start, end, value) of the matches, in code points from 0: running sums over what lies between them and the matches."""

    def run(found: Column) -> Column:
        pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("hit"))
        hits = F.filter(pairs, lambda x: x["hit"].isNotNull())
        none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)").alias("out"))

        def add(s: Column, x: Column) -> Column:
            start = s["at"] + F.length(x["gap"])
            end = start + F.length(x["hit"])
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))).alias("out"))

        return F.aggregate(hits, none, add)["out"]

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), run)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled (less 9 above 9), ends in 0."""

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return s + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) of the base kinds in order of kind, then start; built-in functions only."""
    plain = F.replace(text, F.lit(MARK), F.lit(NO_WORD))
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    joined = F.regexp_replace(plain, r"(?<=[0-9])[ -](?=[0-9])", MARK)
    digits = lambda s: F.length(_digits(s["value"]))
    found = {
        "email": F.when(F.contains(text, F.lit("@")), _places(dotted, EMAIL)).otherwise(_none()),
        "ip": F.when(text.rlike(IP), F.filter(_places(text, IP), lambda s: s["value"].rlike(IP_OK))).otherwise(_none()),
        "card": F.when(text.rlike("[0-9](?:[ -]?[0-9]){12}"), F.filter(
            _places(joined, CARD), lambda s: _let(_digits(s["value"]), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False))))).otherwise(_none()),
        "phone": F.when(text.rlike(r"\+[0-9]"), F.filter(_places(text, PHONE), lambda s: digits(s).between(9, 15))).otherwise(_none()),
    }

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*[named(k, v) for k, v in found.items()])


def _with_context(text: Column, spans: Column) -> Column:
    """Each span with the patterns it stands in: the two words and the one before it, and the one after."""

    def words(s: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT, F.lit(0))
        left = F.lower(F.substr(text, low + 1, s["start"] - low))
        right = F.lower(F.substr(text, s["end"] + 1, F.lit(CONTEXT)))
        one, two = F.regexp_extract(left, r"(?U)(\w+)\W*$", 1), F.regexp_extract(left, r"(?U)(\w+\W+\w+)\W*$", 1)
        after = F.regexp_extract(right, r"(?U)^\W*(\w+)", 1)
        return F.filter(F.array(F.when(two != "", F.concat(F.lit("2<"), two)), F.when(one != "", F.concat(F.lit("1<"), one)), F.when(after != "", F.concat(F.lit("1>"), after))),
                        lambda x: x.isNotNull())

    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), words(s).alias("patterns")))


def entities(text: Column) -> Column:
    """Array of the base spans (kind set) and the other words with digits (kind null) of a text, with their patterns."""
    text = F.coalesce(text, F.lit(""))

    def both(base: Column) -> Column:
        words = F.filter(_places(text, CANDIDATE), lambda c: (c["end"] - c["start"] >= LEAST_CANDIDATE)
                         & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        other = F.transform(words, lambda c: F.struct(F.lit(None).cast("string").alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value")))
        return _with_context(text, F.concat(base, other))

    none = "cast(array() as array<struct<kind: string, start: int, end: int, value: string, patterns: array<string>>>)"
    return F.when(text.rlike("[0-9@]"), _let(base_spans(text), both)).otherwise(F.expr(none))


def bootstrapped(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """value, kind of the identifiers that contexts reveal in `found` (rows with `entities`, a stored table).

    The graph links patterns to the different values they surround, over the whole corpus. Base entities have score 1 for
    their kind. Each round, a pattern's score for a kind is the share of its values' scores among all its values, if it
    surrounds at least `support` known ones; a value's score is what its patterns leave unlikely, multiplied out. Values
    that reach `confident` become known and teach the next round. Pairs are reduced to distinct ones before they meet, so a
    context or value that very many documents share is a sum, never a list.
    """
    flat = found.select(F.explode("entities").alias("e"))
    edges = staged(flat.select(F.explode("e.patterns").alias("pattern"), F.xxhash64("e.value").alias("node"), "e.value", "e.kind")
                   .groupBy("pattern", "node", "value").agg(F.min("kind").alias("kind")))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    known = staged(edges.where("kind is not null").select("node", "value", "kind").distinct())
    taught = known.limit(0)
    for _ in range(rounds):
        scored = edges.select("pattern", "node", "value").join(known.unionByName(taught), ["node", "value"])
        pattern = scored.groupBy("pattern", F.col("kind").alias("k")).agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= support)
        pattern = pattern.join(sizes, "pattern").select("pattern", "k", (F.col("hits") / F.col("n")).alias("score"))
        value = edges.where("kind is null").join(pattern, "pattern").groupBy("node", "value", "k").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("likely"))
        best = value.groupBy("node", "value").agg(F.max(F.struct("likely", "k")).alias("b")).where(F.col("b.likely") >= confident)
        taught = staged(best.select("node", "value", F.col("b.k").alias("kind")))
    return taught.select("value", "kind")


def _row() -> Column:
    return F.monotonically_increasing_id().alias("_row")


def _found_spans(scan: DataFrame) -> DataFrame:
    """_row and the array `more` of (kind, start, end) that contexts reveal, for rows that have any."""
    identifiers = bootstrapped(scan).select(F.col("value").alias("v"), F.col("kind").alias("k"))
    words = scan.select("_row", F.explode(F.filter("entities", lambda e: e["kind"].isNull())).alias("e"))
    hits = words.join(identifiers, words["e.value"] == identifiers.v)
    return hits.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(F.concat(F.lit("found_"), "k").alias("kind"), F.col("e.start").alias("start"), F.col("e.end").alias("end")))).alias("more"))


def _base(entities_: Column | str) -> Column:
    return F.transform(F.filter(entities_, lambda e: e["kind"].isNotNull()), lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end")))


def personal_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, base (kind, start, end) and more (kind found_..., start, end), in code points.

    Both are in order of kind, then start. A null or empty text has none; repeated rows and null ids are kept.
    """
    scan = staged(docs.select(_row(), "doc_id", entities(F.col("text")).alias("entities")))
    empty = F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)")
    return scan.join(_found_spans(scan), "_row", "left").select("doc_id", _base("entities").alias("base"), F.coalesce("more", empty).alias("more"))


def personal_digest(spans: DataFrame) -> DataFrame:
    """Counts and positions of personal_spans' rows."""

    def joined(items: Column | str) -> Column:
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_found"))


def _replaced(text: Column, spans: Column) -> Column:
    """text with [KIND] in place of each span; of overlapping ones the first to start, then the longer, is named."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def add(s: Column, x: Column) -> Column:
        end = -x["back"]
        name = F.concat(F.lit("["), F.upper(F.regexp_replace(x["kind"], "^found_", "")), F.lit("]"))
        kept = F.substr(text, s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        return F.struct(F.greatest(s["at"], end).alias("at"),
                        F.when(x["start"] >= s["at"], F.concat(s["out"], F.array(kept, name))).otherwise(s["out"]).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(ordered, none, add, lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, s["at"] + 1, F.length(text))))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by [EMAIL], [IP], [CARD] or [PHONE]; all rows and columns stay, whatever their names.

    The scan is stored once with its rows. Only rows with candidate words meet the found identifiers; the others do not move.
    """
    scan = staged(as_rows(docs, _row(), entities(F.col("text")).alias("entities")))
    open_rows = F.exists("entities", lambda e: e["kind"].isNull())
    more = _found_spans(scan.select("_row", "entities"))
    empty = F.expr("cast(array() as array<struct<kind: string, start: int, end: int>>)")
    settled = scan.where(~open_rows).select("doc", _base("entities").alias("spans"))
    rest = scan.where(open_rows).join(more, "_row", "left").select("doc", F.concat(_base("entities"), F.coalesce("more", empty)).alias("spans"))
    text = F.col("doc.text")
    kept = F.when(F.size("spans") > 0, _replaced(text, F.col("spans"))).otherwise(text).alias("text")
    columns = [kept if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns]
    return settled.select(*columns).unionByName(rest.select(*columns))
