"""How a set of filters interact: what each removes in every order in which they can be applied.

Texts are read once and become one narrow row with a bit per failed filter.  Rows are added up to mask
cells, at most ``2 ** len(FILTERS)`` per part.  A recursive common table expression extends each prefix of
filters by every unused letter, joins it to the masks and carries the bits applied so far; each level of
the recursion says what its step does to each mask.  The cells of the parts are joined to that by mask, so
the recursion stays the same size whatever the corpus holds.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import cut

SEPARATORS = " \t\n\x0b\f\r"
LETTERS = "ABCDE"
#: Fixed limits: words of A, percent of distinct words of B, percent of capitals of C, signs of D.
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SIGNS = 200, 50, 2, "#$%&*|"
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def facts(docs: DataFrame) -> DataFrame:
    """doc_id, part, the bits of A to D and a digest of each text.

    A null text is empty: no words, so it fails A only (and E after a smaller id with an empty text).
    A null source is the part of the empty string.
    """
    text, n = F.col("_text"), F.size("_words")
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    worded = (
        docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("_text"))
        .withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    tests = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct("_words")) < DISTINCT_PERCENT * n,
        100 * capitals > CAPITALS_PERCENT * F.length(text),
        F.length(F.translate(text, SIGNS, "")) < F.length(text))
    mask = sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))
    return worded.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, those of good quality and toxic ones per part and set of failed filters.

    E fails where a smaller doc_id holds the same text.  The first holder of a text is found by partial
    minima and matched by text and id together, so a text that stands in a third of all rows meets in no task.
    A row with a null doc_id is no copy and makes none; repeated rows count each; labels of one
    document are joined into one.
    """
    rows = cut(facts(docs))
    named = rows.filter(F.col("doc_id").isNotNull())
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    marked = (labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
              .agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic")))
    judged = named.join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
    copies = F.when(F.col("is_first").isNull(), 1 << LETTERS.index("E")).otherwise(0)
    known = judged.select("part", (F.col("mask") + copies).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"),
                          F.coalesce("toxic", F.lit(0)).alias("toxic"))
    nameless = rows.filter(F.col("doc_id").isNull()).select("part", "mask", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return known.unionByName(nameless).groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def _recursion(n: int) -> str:
    """Levels of the recursion: each adds one unused letter to a prefix, per mask, with the bits applied before."""
    return f"""
    WITH RECURSIVE masks AS (SELECT CAST(id AS INT) AS mask FROM range({1 << n})),
    letters AS (SELECT substring('{LETTERS[:n]}', CAST(id AS INT) + 1, 1) AS letter, CAST(shiftleft(1, CAST(id AS INT)) AS INT) AS bit FROM range({n})),
    prefixes (prefix, step, mask, before, bit) AS (
        SELECT CAST('' AS STRING), 0, mask, 0, 0 FROM masks
        UNION ALL
        SELECT concat(p.prefix, l.letter), p.step + 1, m.mask, p.before | p.bit, l.bit
        FROM prefixes p JOIN letters l ON ((p.before | p.bit) & l.bit) = 0 JOIN masks m ON m.mask = p.mask)
    SELECT prefix, step, mask,
           CAST((mask & (before | bit)) = 0 AS INT) AS kept,
           CAST((mask & bit) <> 0 AND (mask & before) = 0 AS INT) AS removed,
           CAST((mask & bit) <> 0 AND (mask & before) <> 0 AS INT) AS redundant,
           CAST(mask = bit AS INT) AS unique_fails
    FROM prefixes WHERE step > 0"""


def interactions(cells: DataFrame, n: int = len(LETTERS)) -> DataFrame:
    """One row per part, order of the first ``n`` letters and step, with METRICS and the filter's Shapley sum.

    ``cells`` is read twice: it should be a stored table.  A part has the same orders whatever its cells hold;
    without cells there are no parts and no rows.
    """
    # Read three times below; its size depends on n alone.
    steps = cut(cells.sparkSession.sql(_recursion(n)))
    sums = [F.sum(F.col(m) * F.col("docs")) for m in METRICS[:4]] + [F.sum(F.col("removed") * F.col(c)) for c in ("good", "toxic")]
    by_prefix = (cells.join(F.broadcast(steps), "mask").groupBy("part", "prefix", "step")
                 .agg(*[s.alias(m) for m, s in zip(METRICS, sums, strict=True)]))
    letter = F.substring("prefix", -1, 1)
    # A prefix of length k begins (n - k)! of the orders.
    weight = F.element_at(F.lit([factorial(n - k) for k in range(1, n + 1)]), F.col("step")).cast("long")
    shapley = (by_prefix.groupBy("part", letter.alias("letter")).agg(F.sum(F.col("removed") * weight).alias("shapley")))
    orders = steps.filter(F.col("step") == n).select(F.col("prefix").alias("filter_order")).distinct()
    places = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    places = places.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    # n * n! rows: sent whole.
    return (by_prefix.join(F.broadcast(places), ["prefix", "step"]).withColumn("letter", letter)
            .join(shapley, ["part", "letter"]).select("part", "filter_order", "step", *METRICS, "shapley"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters over ``docs``, per source; columns beyond those read may be of any name."""
    return interactions(cut(mask_cells(docs, labels)))


def sql() -> str:
    """The same in SQL, without recursion: every order is judged from the documents' own flags."""
    words = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
    names = [f"l{i}" for i in range(5)]
    orders = ", ".join(f"letters AS {x}({x})" for x in names)
    apart = " AND ".join(f"{a} <> {b}" for i, a in enumerate(names) for b in names[i + 1:])
    failing = " + ".join(f"CASE WHEN {t} THEN '{x}' ELSE '' END" for x, t in (
        ("A", f"n < {LEAST_WORDS}"), ("B", f"100 * distinct_words < {DISTINCT_PERCENT} * n"),
        ("C", f"100 * capitals > {CAPITALS_PERCENT} * chars"), ("D", "signs"), ("E", "coalesce(doc_id > first_id, false)"))).replace(" + ", " || ")
    return f"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, len({words}) AS n, len(list_distinct({words})) AS distinct_words,
               length(coalesce(text, '')) AS chars, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS capitals,
               regexp_matches(coalesce(text, ''), '[#$%&*|]') AS signs,
               min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
        FROM documents),
    l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
    flags AS (SELECT part, {failing} AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
    cells AS (SELECT part, fails, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM flags GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    orders AS (SELECT {' || '.join(names)} AS filter_order FROM {orders} WHERE {apart}),
    steps AS (SELECT filter_order, s AS step, substr(filter_order, s, 1) AS letter, substr(filter_order, 1, s - 1) AS earlier
              FROM orders, range(1, 6) AS r(s)),
    judged AS (
        SELECT part, filter_order, step, letter, docs, good, toxic, fails, contains(fails, letter) AS hit,
               len(translate(fails, earlier, '')) < len(fails) AS gone
        FROM cells, steps),
    sums AS (
        SELECT part, filter_order, step, letter,
               sum(CASE WHEN NOT hit AND NOT gone THEN docs ELSE 0 END) AS kept, sum(CASE WHEN hit AND NOT gone THEN docs ELSE 0 END) AS removed,
               sum(CASE WHEN hit AND gone THEN docs ELSE 0 END) AS redundant, sum(CASE WHEN fails = letter THEN docs ELSE 0 END) AS unique_fails,
               sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
        FROM judged GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
           CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
           CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
    FROM sums"""
