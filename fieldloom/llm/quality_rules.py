"""Quality rules: base counts, and distribution divergence from language references.

The verdict compares a document's character-class histogram and its common-word histogram with those of all
documents of its language, by Jensen-Shannon distance (base 2, 0 to 1). A document must be long enough for
either comparison to count. Everything is DataFrame expressions.

* Character classes: lower-case letters, white space, upper-case letters, digits, sentence punctuation, rest.
* Common words: the ``COMMON`` most frequent words of the language in the whole table (ties: smaller word
  first), and one class for all other words.
* Languages with ``MIN_DOCS`` documents have a reference, however many there are; documents of smaller ones, which
  would be held against themselves, are not compared. References are broadcast if they are ``MAX_SHARED`` at most, and
  joined by language beyond that, with the hot languages broadcast.

Repeated three-word windows are found without a shuffle: every window becomes one long, a truncated hash above
its position; the longs are sorted as primitives, and only windows whose truncated hash occurs again are
compared as strings.

Defined results: an empty table gives no rows; a null or empty text has no words and fails the base rule; a null lang
is a language like any other; words that tie in frequency go by code point; distances of the limit itself pass; very long
texts are counted whole; rows are judged one by one, so that null ids, repeated ids and repeated rows are reported as
often as they occur; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checkpointed, documents, joined_by_key, let

COMMON = 20
#: Documents from which a language has a reference, and references that are broadcast whole.
MIN_DOCS = 20
MAX_SHARED = 10_000
#: Largest distances that pass, and the least sizes at which a distance counts.
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.32
MIN_CHARS = 200
MIN_WORDS = 100
#: Patterns deleted one after the other; what a deletion removes is the class's count, the last class is the rest.
CLASSES = (r"\p{Ll}+", r"[\x20\x09-\x0D]+", r"\p{Lu}+", r"[0-9]+", r"[.,;:?!'()-]+")
N_CLASSES = len(CLASSES) + 1
#: Before a language's name, so that a null one has a name too.
OWN = "="


def class_counts(text: Column) -> Column:
    """Array of counts of each character class."""

    def cut(left: Column, patterns: tuple[str, ...], counts: list[Column]) -> Column:
        if not patterns:
            return F.array(*counts, F.length(left).cast("long"))
        return let(F.regexp_replace(left, patterns[0], ""), lambda rest: cut(rest, patterns[1:], [*counts, (F.length(left) - F.length(rest)).cast("long")]))

    return let(text, lambda t: cut(t, CLASSES, []))


def repeated_window_words(words: Column) -> Column:
    """Words of an array that lie in a three-word window found twice or more."""

    def count(w: Column) -> Column:
        return let(F.coalesce(F.size(w), F.lit(0)), lambda n: F.when(n < 4, F.lit(0)).otherwise(let(F.coalesce(F.shiftleft(F.lit(1).cast("long"), 1) * F.pow(F.lit(2.0), F.length(F.bin(n)) - 1).cast("long") - 1, F.lit(0)).cast("long"), lambda low: positions(w, n, low))))

    def positions(w: Column, n: Column, low: Column) -> Column:
        def window_key(i: Column) -> Column:
            h = F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
            return F.coalesce(h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))

        keys = F.sort_array(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), window_key))
        return let(keys, lambda s: covered(w, s, low))

    def covered(w: Column, s: Column, low: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            near = F.coalesce(F.get(s, j + 1).bitwiseXOR(x) <= low, F.lit(False)) & (F.coalesce(F.get(s, j + 1).bitwiseXOR(x), F.lit(-1)) >= 0)
            far = F.coalesce(F.get(s, j - 1).bitwiseXOR(x) <= low, F.lit(False)) & (F.coalesce(F.get(s, j - 1).bitwiseXOR(x), F.lit(-1)) >= 0)
            return near | far

        def window_at(x: Column) -> Column:
            p = x.bitwiseAND(low).cast("int")
            return F.struct(F.concat_ws(" ", F.get(w, p - 1), F.get(w, p), F.get(w, p + 1)).alias("g"), p.alias("p"))

        return let(F.array_sort(F.transform(F.filter(s, twin), window_at)), repeats)

    def repeats(c: Column) -> Column:
        same = F.filter(c, lambda x, j: F.coalesce(F.get(c, j + 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(c, j - 1)["g"] == x["g"], F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda x: F.coalesce(x["p"], F.lit(0)))), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    return let(words, count)


def distance(counts: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance between counts / total and a reference distribution."""

    def part(p: Column, q: Column) -> Column:
        def half(x: Column) -> Column:
            return F.when(x > 0, F.lit(0.5) * x * F.log2(F.lit(2.0) * x / (p + q))).otherwise(F.lit(0.0))

        return half(p) + half(q)

    divergence = F.aggregate(F.zip_with(counts, reference, lambda c, q: part(c / total, q)), F.lit(0.0), lambda a, x: a + x)
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def shares(counts: list[Column], total: Column) -> Column:
    return F.array(*[F.when(total > 0, c / total).otherwise(F.lit(0.0)) for c in counts])


def references(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(lang, docs, classes, common, common_shares) of every language with a reference, and whether they are few enough to be broadcast."""
    sums = [F.sum(F.col("k")[i]).alias(f"k{i}") for i in range(N_CLASSES)]
    each = docs.select("lang", class_counts(F.col("text")).alias("k")).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *sums)
    each = checkpointed(each.where(F.col("docs") >= MIN_DOCS))
    few = each.count() <= MAX_SHARED
    total = sum((F.col(f"k{i}") for i in range(1, N_CLASSES)), F.col("k0"))
    classes = each.select("lang", "docs", shares([F.col(f"k{i}") for i in range(N_CLASSES)], total).alias("classes"))
    own = each.select(F.col("lang").alias("own"))
    known = docs.join(F.broadcast(own), F.col("lang") == F.col("own"), "left_semi") if few else docs
    words = known.select("lang", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "word"))
    top = words.withColumn("place", place).where(F.col("place") <= COMMON)
    top = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    common = totals.join(top, "lang").select("lang", F.transform("top", lambda x: x["word"]).alias("common"), F.transform("top", lambda x: x["n"] / F.col("total")).alias("head"))
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate("head", F.lit(0.0), lambda a, x: a + x))
    found = classes.join(common, "lang", "left").select("lang", "docs", "classes", F.coalesce("common", F.array().cast("array<string>")).alias("common"), F.coalesce(F.concat("head", F.array(rest)), F.array(F.lit(1.0))).alias("common_shares"))
    return found, few


def spread() -> Column:
    """Something to deal rows of hot languages by."""
    return F.concat(F.lit("/"), F.md5(F.monotonically_increasing_id().cast("string").cast("binary")))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and both distances (null: not compared)."""
    lang = F.concat(F.lit(OWN), F.coalesce(F.col("lang").cast("string"), F.lit("")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), lang.alias("lang"))
    refs, few = references(docs)
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_dup_lines = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_window_words(w).cast("long").alias("n_repeat_words"),
            # every word between spaces of its own, so that neighbours do not share one
            F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" ")).alias("padded"),
        )

    measured = docs.select(
        "doc_id",
        "lang",
        class_counts(text).alias("k"),
        let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), counts).alias("c"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        n_dup_lines.cast("long").alias("n_dup_lines"),
    )
    # characters outside of words are the second class
    everything = F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x)
    measured = measured.select("doc_id", "lang", "k", "c.padded", "c.n_words", (everything - F.col("k")[1]).alias("word_chars"), "n_symbols", "n_dup_lines", "c.n_repeat_words")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    measured = measured.withColumn("base_failed", failed)

    # a reference is COMMON words and as many numbers
    found = refs.select("lang", "docs", F.struct("classes", "common", "common_shares").alias("r"))
    joined = measured.join(F.broadcast(found.drop("docs")), "lang", "left") if few else joined_by_key(measured, checkpointed(found), ["lang"], "docs", spread())

    classes = distance(F.col("k"), F.greatest(everything, F.lit(1).cast("long")), F.col("r.classes"))

    def common_counts(t: Column) -> Column:
        hits = F.transform(F.col("r.common"), lambda c: (F.length(t) - F.length(F.replace(t, F.concat(F.lit(" "), c, F.lit(" ")), F.lit("")))) / (F.length(c) + 2))
        return let(hits, lambda h: F.concat(h, F.array(F.col("n_words") - F.aggregate(h, F.lit(0.0), lambda a, x: a + x))))

    long_enough = ~F.col("base_failed") & F.col("r").isNotNull()
    class_distance = F.when(long_enough & (F.col("word_chars") >= MIN_CHARS), classes)
    word_distance = F.when(long_enough & (F.col("n_words") >= MIN_WORDS), let(let(F.col("padded"), common_counts), lambda h: distance(h, F.col("n_words"), F.col("r.common_shares"))))
    out = joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", class_distance.alias("class_distance"), word_distance.alias("word_distance"))
    far = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    return out.withColumn("kept", ~F.col("base_failed") & ~far)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).drop("class_distance", "word_distance")


SQL = rf"""
WITH d0 AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, '{OWN}' || coalesce(lang, '') AS lang FROM documents
), own AS (
  SELECT lang, count(*) AS docs FROM d0 GROUP BY lang HAVING count(*) >= {MIN_DOCS}
), d AS (
  SELECT rid, doc_id, text, CASE WHEN lang IN (SELECT lang FROM own) THEN lang END AS ref FROM d0
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM (
    SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3))
), rep AS (
  SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM win CROSS JOIN range(3) t(j) WHERE n >= 2 GROUP BY rid
), t1 AS (SELECT *, regexp_replace(text, '\p{{Ll}}+', '', 'g') AS t FROM w
), t2 AS (SELECT *, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS u FROM t1
), t3 AS (SELECT *, regexp_replace(u, '\p{{Lu}}+', '', 'g') AS v FROM t2
), t4 AS (SELECT *, regexp_replace(v, '[0-9]+', '', 'g') AS x FROM t3
), t5 AS (SELECT *, regexp_replace(x, '[.,;:?!''()-]+', '', 'g') AS y FROM t4
), cls AS (
  SELECT rid, doc_id, ref, text, w, len(w) AS n_words, [length(text) - length(t), length(t) - length(u), length(u) - length(v), length(v) - length(x), length(x) - length(y), length(y)] AS k FROM t5
), part AS (
  SELECT ref, i, sum(k[i]) AS n FROM cls CROSS JOIN range(1, {N_CLASSES + 1}) t(i) GROUP BY ref, i
), classes AS (
  SELECT ref, i, n::DOUBLE / sum(n) OVER (PARTITION BY ref) AS q FROM part
), tok AS (
  SELECT rid, ref, unnest(w) AS word FROM cls
), cnt AS (
  SELECT ref, word, count(*) AS n FROM tok GROUP BY ref, word
), common AS (
  SELECT ref, word, n::DOUBLE / sum(n) OVER (PARTITION BY ref) AS q, row_number() OVER (PARTITION BY ref ORDER BY n DESC, word) AS place FROM cnt
), top AS (SELECT * FROM common WHERE place <= {COMMON}
), pick AS (
  SELECT rid, ref AS r FROM cls
), hits AS (
  SELECT p.rid, p.r, t.place, t.q, count(k.word) AS n FROM pick p JOIN top t ON t.ref = p.r LEFT JOIN tok k ON k.rid = p.rid AND k.word = t.word GROUP BY ALL
), bins AS (
  SELECT rid, n::DOUBLE AS n, q FROM hits
  UNION ALL
  SELECT p.rid, c.n_words - coalesce(h.n, 0), greatest(0.0::DOUBLE, 1.0::DOUBLE - coalesce(h.q, 0.0::DOUBLE))
  FROM pick p JOIN cls c USING (rid) LEFT JOIN (SELECT rid, sum(n) AS n, sum(q) AS q FROM hits GROUP BY rid) h USING (rid)
), wd AS (
  SELECT rid, sqrt(greatest(sum(
      CASE WHEN n > 0 THEN 0.5::DOUBLE * (n / n_words) * log2(2.0::DOUBLE * (n / n_words) / (n / n_words + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN 0.5::DOUBLE * q * log2(2.0::DOUBLE * q / (n / n_words + q)) ELSE 0 END), 0.0::DOUBLE)) AS dist
  FROM bins JOIN cls USING (rid) WHERE n_words > 0 GROUP BY rid
), cd AS (
  SELECT rid, sqrt(greatest(sum(
      CASE WHEN p > 0 THEN 0.5::DOUBLE * p * log2(2.0::DOUBLE * p / (p + q)) ELSE 0 END
    + CASE WHEN q > 0 THEN 0.5::DOUBLE * q * log2(2.0::DOUBLE * q / (p + q)) ELSE 0 END), 0.0::DOUBLE)) AS dist
  FROM (SELECT p.rid, c.q, s.k[c.i]::DOUBLE / list_sum(s.k) AS p FROM pick p JOIN cls s USING (rid) JOIN classes c ON c.ref = p.r WHERE list_sum(s.k) > 0)
  GROUP BY rid
), m AS (
  SELECT cls.*, coalesce(list_sum(list_transform(w, lambda a: length(a))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda a: regexp_matches(a, '[^\x20\x09-\x0D]')) AS lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM cls LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed
         AND NOT (word_chars >= {MIN_CHARS} AND coalesce(cd.dist, 0) > {MAX_CLASS_DISTANCE})
         AND NOT (n_words >= {MIN_WORDS} AND coalesce(wd.dist, 0) > {MAX_WORD_DISTANCE}) AS kept
FROM b LEFT JOIN wd USING (rid) LEFT JOIN cd USING (rid)
"""
