"""Spelling variants: words one inserted, deleted or replaced character apart, grouped below their commonest form.

Permuterm: a word with a terminator, turned so that every position stands once at the end, gives its rotations.  Words that differ in one place
have rotations that agree in all but the last character: ``a x b`` and ``a y b`` both turn to ``b$a`` and a last character, and ``a b`` itself turns
to ``b$a`` with nothing behind.  So each rotation is filed under the prefix that skips its last, edited character, and each whole
rotation under itself; rows are sorted by prefix and edited character, and one scan of each prefix range finds a word's neighbours: the other
rows of the range (replacements) and the row without a character (a deletion, or seen from there an insertion).  Of equal
characters side by side only the last may be the deleted one, so a pair meets in exactly one range and can be counted there.

A range holds at most one row for each letter of the alphabet and one without, however common its words are: nothing has to be split.  A scan emits a
row for each word that has neighbours in the range, with their number and the commonest, never the pairs.

Roots follow forms by pointer jumping.  A form is at least twice as common as its word, so chains end, and the number of jumps is the
logarithm of the longest chain.

Defined cases: null and empty texts have no words; a null ``doc_id`` alters no word; texts and words of any length are taken whole; ties go to
the smallest word in code-point order; repeated rows count again; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm._crc_sql import CRC_TABLE, crc32_sql
from plumbline.session import cut_lineage

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALTER_SHARE = 97
LEAST_LENGTH = 5
LEAST_COUNT = 3
FORM_RATIO = 2
END = "$"  # no letter


def word_counts(docs: DataFrame, alter_share: int = ALTER_SHARE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words of all texts; in one of ``alter_share`` words of a document a letter is left out."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary"))
    # One shorter than wanted can never be a word, and needs no hash.
    hashed = low.filter(F.length("run") >= least_length).withColumn("h", h)
    gap = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % alter_share == 0, F.concat(F.substr("run", F.lit(1), gap), F.substr("run", gap + 2))).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).filter(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """``range, edit, n``: every rotation under its prefix and last letter, and whole under itself with an empty ``edit``."""
    whole = F.concat("word", F.lit(END))
    turned = lambda i: F.concat(F.substr(whole, i + 1), F.substr("word", F.lit(1), i))
    size = F.length("word")
    full = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(turned(i).alias("range"), F.lit("").alias("edit")))
    short = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
        F.concat(F.substr(whole, i + 1), F.substr("word", F.lit(1), i - 1)).alias("range"), F.substr("word", i, F.lit(1)).alias("edit")))
    return words.select("n", F.inline(F.concat(full, short))).select("range", "edit", "n")


def restored(edit: Column) -> Column:
    """The word of a row of a range, with ``edit`` in the skipped place."""
    cut = F.instr("range", END)
    return F.concat(F.substr("range", cut + 1), edit, F.substr("range", F.lit(1), cut - 1))


def neighbours(words: DataFrame) -> DataFrame:
    """``word, n_near, best`` of the words that have neighbours; ``best``: minus count and word, least first."""
    scan = Window.partitionBy("range").orderBy("edit")
    all_of = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = scan.rowsBetween(Window.unboundedPreceding, -1), scan.rowsBetween(1, Window.unboundedFollowing)
    letter = F.col("edit") != ""
    deletable = letter & (F.substr("range", F.lit(1), F.lit(1)) != F.col("edit"))
    row = F.struct((-F.col("n")).alias("minus"), F.col("edit"))
    scanned = rotations(words).select(
        "range", "edit", "n", deletable.alias("deletable"),
        F.count(F.when(letter, 1)).over(all_of).alias("letters"), F.count(F.when(deletable, 1)).over(all_of).alias("deletables"),
        F.max(F.when(~letter, F.col("n"))).over(all_of).alias("whole_n"), F.min(F.when(deletable, row)).over(all_of).alias("longer"),
        F.min(F.when(letter, row)).over(before).alias("lower"), F.min(F.when(letter, row)).over(after).alias("upper"))
    hits = F.when(letter, F.col("letters") - 1 + F.when(F.col("deletable") & F.col("whole_n").isNotNull(), 1).otherwise(0)).otherwise(F.col("deletables"))
    other = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.col(x).minus.alias("minus"), restored(F.col(x).edit).alias("word")))
    shorter = F.when(F.col("deletable") & F.col("whole_n").isNotNull(), F.struct((-F.col("whole_n")).alias("minus"), restored(F.lit("")).alias("word")))
    best = F.when(letter, F.least(other("lower"), other("upper"), shorter)).otherwise(other("longer"))
    found = scanned.withColumn("hits", hits).filter("hits > 0").select(restored(F.col("edit")).alias("word"), "hits", best.alias("best"))
    return found.groupBy("word").agg(F.sum("hits").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form`` rows: each follows its form's form until there is none."""
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        state = cut_lineage(state.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("moved")


def spelling_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of distinct words with their counts."""
    words = cut_lineage(words.select("word", "n"))
    near = neighbours(words)
    told = cut_lineage(words.join(near, "word", "left").withColumn("_counts", -F.col("best.minus") >= ratio * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("_counts"), F.col("best.word")).alias("form"), F.when(F.col("_counts"), -F.col("best.minus")).alias("form_n")))
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(word_counts(docs))


OP12_SQL = f"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (
        SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS times
        FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
    hashed AS (SELECT run, times, {crc32_sql("concat(doc_id, ':', run)")} AS h, doc_id FROM runs, crc WHERE length(run) >= {LEAST_LENGTH}),
    altered AS (
        SELECT times, CASE WHEN doc_id IS NOT NULL AND h % {ALTER_SHARE} = 0
                           THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word
        FROM hashed),
    words AS (
        SELECT word, CAST(sum(times) AS BIGINT) AS n FROM altered WHERE length(word) >= {LEAST_LENGTH}
        GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
    holes AS (
        SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
        FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS BIGINT) AS i FROM words)),
    pairs AS (
        SELECT x.word, y.word AS near, y.n FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
        UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON x.a || x.b = y.word
        UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON x.a || x.b = y.word),
    near AS (SELECT word, count(*) AS n_near, min((-n, near)) AS best FROM pairs GROUP BY word),
    told AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
               CASE WHEN -best[1] >= {FORM_RATIO} * w.n THEN best[2] END AS form, CASE WHEN -best[1] >= {FORM_RATIO} * w.n THEN -best[1] END AS form_n
        FROM words w LEFT JOIN near USING (word)),
    ways AS (
        SELECT word, word AS root, form AS next FROM told
        UNION ALL SELECT w.word, t.word, t.form FROM ways w JOIN told t ON w.next = t.word)
    SELECT t.word, t.form, w.root, t.n, t.n_near, t.form_n FROM told t JOIN ways w ON w.word = t.word AND w.next IS NULL
"""
