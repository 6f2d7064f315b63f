r"""Quality rules: fixed base rules, then thresholds that adapt to each language and source.

``measure`` adds the rules' counts to every document, within the row and without a shuffle.
``judge`` summarises four ratios of the documents that pass the base rules, per (lang, source) and
per language, with Spark's mergeable quantile sketch (``percentile_approx``: partial sketches on
the map side, merged after the shuffle), turns quantiles into fences and joins them back.  A
document is kept if no ratio lies beyond its group's fence.

A fence is the outer decile, moved out by ``FENCE`` times its distance from the median, or by what
``OCCURRENCES`` more occurrences make in the group's median document where that is more.  No width
is fixed: both come from the sketch.  A group of ``n`` documents has the weight n / (n + ``PRIOR``)
against its language, and where its median lies inside its language's fence, its own fence is not
wider than that one: a source with much junk of one kind does not set its own standard.

Defined results: a null or blank text has no words and fails the base rules; a null language
or source counts as the empty string; repeated rows are judged alike and each counts in the
sketches; an empty table gives an empty result; extra columns pass through, and input columns
named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.staging import stage

#: Fixed values of the base rules: space classes of words, and the symbols that count.
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

FENCE = 4.0  # distances between the median and the outer decile
OCCURRENCES = 5.0
PRIOR = 50.0  # documents
#: Words that a 3-word window and its repeat cover.
PAIR = 6.0
ACCURACY = 2_000  # of the sketch: rank error 1 / ACCURACY


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more.

    Windows are sorted as (hash, position): equal neighbours are the repeats, and the
    sorted positions tell how many words they cover.  O(n log n) in the text's words.
    """

    def covered(at: Column) -> Column:
        last = F.size(at) - 1
        steps = F.transform(at, lambda p, i: F.when(i < last, F.least(F.lit(3), F.get(at, i + 1) - p)).otherwise(F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    def repeats(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s, i, j: F.coalesce(F.get(s, j)["h"] == F.get(s, i)["h"], F.lit(False))
        hits = let(pairs, lambda s: F.filter(F.transform(s, lambda x, i: F.when(same(s, i, i - 1) | same(s, i, i + 1), x["i"])), lambda p: p.isNotNull()))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(hits), covered))

    def of_words(w: Column) -> Column:
        window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), window)
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(hashes, repeats))

    return let(words, of_words)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines`` and ``base_failed``."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, SPACE, -1), lambda w: w != "")
    out = documents.drop(*COUNTS, "n_lines", "base_failed", "kept")
    counted = F.struct(
        F.length(F.translate(body, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _dup_lines(body).cast("long").alias("n_dup_lines"),
        F.size(F.split(body, "\n", -1)).cast("long").alias("n_lines"),
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
    )
    out = out.withColumn("__m", counted)
    out = out.select(
        *documents.drop(*COUNTS, "n_lines", "base_failed", "kept").columns,
        *(F.col(f"__m.w.{c}" if c in ("n_words", "n_repeat_words") else f"__m.{c}").alias(c) for c in (*COUNTS, "n_lines")),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_share": F.col("n_repeat_words") / words,
        "chars_per_word": F.col("word_chars") / words,
    }


#: Ratios that have a lower fence too.
BOTH = ("chars_per_word",)


def _fences(fence: float, occurrences: float) -> dict[str, Column]:
    """``high_*`` and ``low_*`` of a row of quantiles (``q_*``: lower decile, median, upper decile)."""
    at = lambda k, i: F.get(F.col(f"q_{k}"), F.lit(i))
    words, lines = (F.greatest(at(k, 1), F.lit(1)).cast("double") for k in ("n_words", "n_lines"))
    one = {
        "symbols_per_word": F.lit(1.0) / words,
        "dup_line_share": F.lit(1.0) / lines,
        "repeat_word_share": F.lit(PAIR) / words,
        "chars_per_word": at("chars_per_word", 1) / words,
    }
    width = lambda k, spread: F.greatest(spread * F.lit(fence), one[k] * F.lit(occurrences))
    out = {f"high_{k}": at(k, 2) + width(k, at(k, 2) - at(k, 1)) for k in one}
    return out | {f"low_{k}": at(k, 0) - width(k, at(k, 1) - at(k, 0)) for k in BOTH}


def thresholds(measured: DataFrame, fence: float = FENCE, occurrences: float = OCCURRENCES, prior: float = PRIOR) -> DataFrame:
    """Fences per language and source: ``lang, source, high_*, low_*``.

    One pass makes the sketches of groups and of languages; what leaves a task is a row a group.
    """
    ratios = _ratios()
    keyed = measured.where(~F.col("base_failed")).select(
        F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "n_words", "n_lines", *(c.alias(k) for k, c in ratios.items())
    )
    sketches = [F.percentile_approx(k, [0.1, 0.5, 0.9], ACCURACY).alias(f"q_{k}") for k in (*ratios, "n_words", "n_lines")]
    sketched = keyed.groupingSets([("lang", "source"), ("lang",)], "lang", "source").agg(F.count("*").alias("n"), *sketches)
    fenced = sketched.select("lang", "source", "n", *(F.get(F.col(f"q_{k}"), F.lit(1)).alias(f"mid_{k}") for k in ratios), *(c.alias(k) for k, c in _fences(fence, occurrences).items()))
    fenced = stage(fenced.coalesce(1), "quality-sketches")
    sides = [f"high_{k}" for k in ratios] + [f"low_{k}" for k in BOTH]
    whole = fenced.where("source IS NULL").select(F.col("lang").alias("__lang"), *(F.col(c).alias(f"__{c}") for c in sides))
    both = fenced.where("source IS NOT NULL").join(whole, F.col("lang") == F.col("__lang"))
    weight = F.col("n") / (F.col("n") + F.lit(prior))

    def settled(side: str) -> Column:
        own, lang, mid = F.col(side), F.col(f"__{side}"), F.col(f"mid_{side.partition('_')[2]}")
        apart, tighter = (mid > lang, F.least(own, lang)) if side.startswith("high") else (mid < lang, F.greatest(own, lang))
        return lang + weight * (F.when(apart, own).otherwise(tighter) - lang)

    return both.select("lang", "source", *(settled(c).alias(c) for c in sides))


def judge(measured: DataFrame, fence: float = FENCE, occurrences: float = OCCURRENCES, prior: float = PRIOR) -> DataFrame:
    """Add ``kept`` to measured documents.

    ``measured`` is staged, so that texts are measured once for the sketches and the filter.
    The table of fences is staged as well: Spark sees its size and broadcasts it only below
    its threshold; beyond that the join is a sort-merge join whose hot keys AQE splits.
    """
    measured = stage(measured, "quality-measured")
    fences = stage(thresholds(measured, fence, occurrences, prior).coalesce(1), "quality-fences")
    fences = fences.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *(F.col(c).alias(f"__{c}") for c in fences.columns[2:]))
    keys = (F.coalesce(measured["lang"], F.lit("")) == F.col("__lang")) & (F.coalesce(measured["source"], F.lit("")) == F.col("__source"))
    inside = F.lit(True)
    for k, ratio in _ratios().items():
        inside = inside & (ratio <= F.col(f"__high_{k}"))
        if k in BOTH:
            inside = inside & (ratio >= F.col(f"__low_{k}"))
    joined = measured.join(fences, keys, "left")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return joined.select(*measured.columns, kept.alias("kept"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "source", "text")
    judged = judge(measure(documents).drop("text"))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept")


#: Exact quantiles: the sketch's are exact as well while a group has fewer rows than its accuracy.
ORACLE_OP3 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY rid),
m AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(string_split(t, chr(10))) AS n_lines FROM w LEFT JOIN covered USING (rid)),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS a, n_dup_lines / greatest(n_lines, 1) AS b,
  n_repeat_words / greatest(n_words, 1) AS c, word_chars / greatest(n_words, 1) AS e FROM m),
p AS (SELECT lang, source, UNNEST([a, b, c, e, n_words::DOUBLE, n_lines::DOUBLE]) AS x, UNNEST(['a', 'b', 'c', 'e', 'w', 'l']) AS k FROM r WHERE NOT base_failed),
s AS (SELECT lang, source, k, count(*) AS n, quantile_disc(x, 0.1) AS q1, quantile_disc(x, 0.5) AS q5, quantile_disc(x, 0.9) AS q9 FROM p GROUP BY GROUPING SETS ((lang, source, k), (lang, k))),
u AS (SELECT s.lang, s.source, s.k, s.n, s.q5, s.q1, s.q9,
  CASE s.k WHEN 'a' THEN 1.0::DOUBLE / greatest(w.q5, 1) WHEN 'b' THEN 1.0::DOUBLE / greatest(l.q5, 1) WHEN 'c' THEN 6.0::DOUBLE / greatest(w.q5, 1) ELSE s.q5 / greatest(w.q5, 1) END AS one
  FROM s JOIN s w ON s.lang = w.lang AND s.source IS NOT DISTINCT FROM w.source AND w.k = 'w' JOIN s l ON s.lang = l.lang AND s.source IS NOT DISTINCT FROM l.source AND l.k = 'l'
  WHERE s.k IN ('a', 'b', 'c', 'e')),
f AS (SELECT lang, source, k, n, q5, q9 + greatest((q9 - q5) * 4.0::DOUBLE, one * 5.0::DOUBLE) AS high, q1 - greatest((q5 - q1) * 4.0::DOUBLE, one * 5.0::DOUBLE) AS low FROM u),
z AS (SELECT f.lang, f.source, f.k, g.high + f.n / (f.n + 50.0::DOUBLE) * (CASE WHEN f.q5 > g.high THEN f.high ELSE least(f.high, g.high) END - g.high) AS high,
  g.low + f.n / (f.n + 50.0::DOUBLE) * (CASE WHEN f.q5 < g.low THEN f.low ELSE greatest(f.low, g.low) END - g.low) AS low
  FROM f JOIN f g ON f.lang = g.lang AND f.k = g.k AND f.source IS NOT NULL AND g.source IS NULL),
fence AS (SELECT lang, source, max(high) FILTER (k = 'a') AS ha, max(high) FILTER (k = 'b') AS hb, max(high) FILTER (k = 'c') AS hc, max(high) FILTER (k = 'e') AS he, max(low) FILTER (k = 'e') AS le FROM z GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND a <= ha AND b <= hb AND c <= hc AND e <= he AND e >= le AS kept
FROM r LEFT JOIN fence USING (lang, source)
"""
