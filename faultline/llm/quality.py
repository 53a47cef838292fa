"""Quality rules whose thresholds adapt to each language and source.

Every document is measured by expressions over its text alone.  The measures go into
quantile sketches: counts of logarithmic bins whose width is at most 1/32 of the value, so
sketches merge by adding counts and the same rows give the same sketch however they are dealt
out.  A sketch per language and source, or where that has few documents its merge over the
language or over everything, gives quartiles; a measure far beyond them rejects the document.
There is no Python on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import cut

SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: measure -> (least spread, whether low values reject too).  Rates are per 10,000 words, letters
#: or lines; lengths are in hundredths of a character.
MEASURES = {
    "symbol_rate": (250, False),
    "upper_rate": (300, False),
    "word_length": (100, True),
    "dup_line_rate": (1500, False),
    "repeat_rate": (750, False),
}
#: Spreads beyond a quartile that a document may lie.
SPREADS = 4
#: Languages and sources up to which their limits are sent to every executor (some MB); beyond, shuffled.
SENT_GROUPS = 50_000
#: Documents that a sketch needs before its own quartiles are used.
ENOUGH = 50


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice; ``hashes`` holds every window's."""
    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = _let(placed, lambda s: F.filter(s, lambda x, k: (
        F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))))
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    return _let(places, lambda p: F.lit(WINDOW) + F.aggregate(
        F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))),
        F.lit(0), lambda total, x: total + x))


def measured(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang, source and the counts of every document; null texts count as empty.

    ``keep`` names further columns to carry along.
    """
    text, n = F.col("_text"), F.col("n_words")
    keep = tuple(c for c in keep if c not in ("doc_id", "lang", "source"))
    return (
        docs.select("doc_id", "lang", "source", *keep, F.coalesce("text", F.lit("")).alias("_text"))
        .withColumn("_trimmed", F.btrim(text, F.lit(SEPARATORS)))
        .withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>"))
                    .otherwise(F.split("_trimmed", "[\\x20\\x09-\\x0D]+")))
        .withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != ""))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("_windows", F.when(n > WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_words"), i, WINDOW)))))
        .select(
            "doc_id", "lang", "source", *keep, "n_words",
            F.length(F.translate(text, SEPARATORS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("_windows").isNull() | (F.size(F.array_distinct("_windows")) == F.size("_windows")), F.lit(0))
            .otherwise(_repeated(F.col("_windows"))).cast("long").alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"))
    )


def _measures() -> dict[str, Column]:
    def rate(a: str, b: str, of: int) -> Column:
        return F.floor(F.col(a) * of / F.greatest(F.col(b), F.lit(1)))

    return {
        "symbol_rate": rate("n_symbols", "n_words", 10_000), "upper_rate": rate("n_upper", "word_chars", 10_000),
        "word_length": rate("word_chars", "n_words", 100), "dup_line_rate": rate("n_dup_lines", "n_lines", 10_000),
        "repeat_rate": rate("n_repeat_words", "n_words", 10_000),
    }


def _floor_of_bin(value: Column) -> Column:
    """The least value in the bin of ``value``: exact below 64, then 32 bins per doubling."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    width = F.pow(F.lit(2), shift).cast("long")
    return value - value % width


def sketches(rows: DataFrame) -> DataFrame:
    """Counts per lang, source, measure and bin."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _floor_of_bin(F.col(m)).alias("bin")) for m in MEASURES]))
    return (rows.select("lang", "source", pairs.alias("x")).groupBy("lang", "source", "x.measure", "x.bin")
            .agg(F.count(F.lit(1)).alias("n")))


def merged(bins: DataFrame, *keys: str) -> DataFrame:
    """The sketches added up over everything but ``keys``, and their quartiles per measure."""
    total = bins.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    placed = total.withColumn("_upto", F.sum("n").over(group.orderBy("bin"))).withColumn("_all", F.sum("n").over(group))
    quartile = [F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * q, F.col("bin"))) for q in (1, 2, 3)]
    return placed.groupBy(*keys, "measure").agg(F.max("_all").alias("n"), *[q.alias(f"q{i}") for i, q in enumerate(quartile, 1)])


def _limits(quartiles: DataFrame, *keys: str) -> DataFrame:
    """One row per group: its size and the lowest and highest value allowed for each measure."""
    columns = [F.max("n").alias("n")]
    for name, (least, low) in MEASURES.items():
        of = F.col("measure") == name
        spread = F.greatest(F.col("q3") - F.col("q2"), F.col("q2") - F.col("q1"), F.lit(least)) * SPREADS
        columns.append(F.max(F.when(of, F.col("q3") + spread)).alias(f"{name}_high"))
        if low:
            columns.append(F.max(F.when(of, F.col("q1") - spread)).alias(f"{name}_low"))
    return quartiles.groupBy(*keys).agg(*columns)


def thresholds(rows: DataFrame) -> DataFrame:
    """Limits for every lang and source: its own, or those of the language or of all documents.

    Null languages and sources are groups like any other.
    """
    bins = sketches(rows)
    own = _limits(merged(bins, "lang", "source"), "lang", "source").alias("s")
    lang = _limits(merged(bins, "lang"), "lang").alias("l")
    every = _limits(merged(bins)).withColumn("top", F.least("n", F.lit(0))).alias("a")
    names = [c for c in own.columns if c not in ("lang", "source", "n")]
    joined = own.join(lang, F.col("s.lang").eqNullSafe(F.col("l.lang")), "left")
    joined = joined.join(every, F.least("s.n", F.lit(0)) == F.col("a.top"), "left")
    return joined.select("s.lang", "s.source", *[
        F.when(F.col("s.n") >= ENOUGH, F.col(f"s.{c}")).when(F.col("l.n") >= ENOUGH, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
        for c in names])


def quality(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the counts, ``base_failed`` and ``kept``.

    Empty, null and short texts (under 20 words) fail the base rules; repeated rows are judged
    alike; columns beyond doc_id, text, lang and source are not read.  The counts are stored
    once and used for the sketches and the verdict, with the columns that ``keep`` names.
    """
    counts = cut(measured(docs, keep))
    rows = counts.withColumns(_measures())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    fair = F.lit(True)
    for name, (_, low) in MEASURES.items():
        fair &= F.col(name) <= F.col(f"t.{name}_high")
        if low:
            fair &= F.col(name) >= F.col(f"t.{name}_low")
    limits = cut(thresholds(rows.filter(F.col("n_words") > 0)))
    if limits.count() <= SENT_GROUPS:
        limits = F.broadcast(limits)
    limits = limits.alias("t")
    same = F.col("r.lang").eqNullSafe(F.col("t.lang")) & F.col("r.source").eqNullSafe(F.col("t.source"))
    return rows.alias("r").join(limits, same, "left").select(
        "doc_id", *(F.col(f"r.{c}") for c in keep), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.coalesce(fair, F.lit(False))).alias("kept"))


def _sql_limits() -> str:
    rows = []
    for name, (least, low) in MEASURES.items():
        spread = f"greatest(q3 - q2, q2 - q1, {least}) * {SPREADS}"
        rows.append(f"max(CASE WHEN measure = '{name}' THEN q3 + {spread} END) AS {name}_high")
        if low:
            rows.append(f"max(CASE WHEN measure = '{name}' THEN q1 - {spread} END) AS {name}_low")
    return ", ".join(rows)


def sql(documents: str = "documents") -> str:
    """The same result in DuckDB's SQL."""
    limits = [f"{m}_high" for m in MEASURES] + [f"{m}_low" for m, (_, low) in MEASURES.items() if low]
    chosen = ", ".join(f"CASE WHEN s.n >= {ENOUGH} THEN s.{c} WHEN l.n >= {ENOUGH} THEN l.{c} ELSE a.{c} END AS {c}" for c in limits)
    fair = " AND ".join([f"r.{m} <= t.{m}_high" for m in MEASURES] + [f"r.{m} >= t.{m}_low" for m, (_, low) in MEASURES.items() if low])

    def quartiles(keys: str) -> str:
        comma = f"{keys}, " if keys else ""
        return f"""
          SELECT {comma}max(n_all) AS n, {_sql_limits()} FROM (
            SELECT {comma}measure, max(n_all) AS n_all, min(bin) FILTER (upto * 4 >= n_all) AS q1,
                   min(bin) FILTER (upto * 4 >= n_all * 2) AS q2, min(bin) FILTER (upto * 4 >= n_all * 3) AS q3
            FROM (SELECT {comma}measure, bin, sum(n) OVER (PARTITION BY {comma}measure ORDER BY bin) AS upto,
                         sum(n) OVER (PARTITION BY {comma}measure) AS n_all
                  FROM (SELECT {comma}measure, bin, count(*) AS n FROM bins GROUP BY ALL))
            GROUP BY {comma}measure) {f"GROUP BY {keys}" if keys else ""}"""

    measures = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS v FROM rated WHERE n_words > 0" for m in MEASURES)
    return rf"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM {documents}),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_line_texts
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM texts)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY doc_id),
counted AS (
  SELECT t.doc_id, t.lang, t.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t.t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines - n_line_texts, 0)::BIGINT AS n_dup_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
         len(regexp_extract_all(t.t, '\p{{Lu}}'))::BIGINT AS n_upper
  FROM texts t LEFT JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
rated AS (
  SELECT *, n_symbols * 10000 // greatest(n_words, 1) AS symbol_rate, n_upper * 10000 // greatest(word_chars, 1) AS upper_rate,
         word_chars * 100 // greatest(n_words, 1) AS word_length, n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_line_rate,
         n_repeat_words * 10000 // greatest(n_words, 1) AS repeat_rate
  FROM counted),
measures AS ({measures}),
bins AS (SELECT lang, source, measure, v - v % (1 << greatest(length(bin(v)) - 6, 0)::INT)::BIGINT AS bin FROM measures),
own AS ({quartiles("lang, source")}),
langs AS ({quartiles("lang")}),
every AS ({quartiles("")}),
limits AS (
  SELECT s.lang, s.source, {chosen} FROM own s LEFT JOIN langs l ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN every a),
judged AS (
  SELECT r.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {fair} AS fair
  FROM rated r LEFT JOIN limits t ON r.lang IS NOT DISTINCT FROM t.lang AND r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(fair, false) AS kept
FROM judged"""
