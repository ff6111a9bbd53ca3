"""Quality rules with risk-controlled thresholds, with DataFrame operations only.

Statistics of a text become ratios with a fixed grid of cut-offs. Labelled good documents are the holdout: for each
stratum and each rule only cut-offs are used whose false rejections are provably few. The proof is an exact
binomial (Clopper-Pearson) test: with n good documents in a stratum, a cut-off that rejects k of them is safe if
P(X <= k | n, alpha) <= delta / m, where m is the number of rules in all strata (Bonferroni). A rule's cut-offs are
nested, so they are tested in a fixed sequence from the laxest one, each at that whole level, until one fails: an unsafe
cut-off is only ever used if the first unsafe one of its sequence passes its test, so they need no correction among
themselves. With confidence 1 - delta every chosen cut-off at once has a false rejection rate under alpha. A rule's
alpha is the overall one divided by the number of rules, as a document goes if any rule rejects it. Strata are two-letter languages and
'other' for the rest, at most 677, which bounds every table of thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, cut, stored, text_or_empty

#: Words in a repeated window.
WINDOW = 8

#: A good document may be rejected by the chosen cut-offs this often, with this confidence.
ALPHA, DELTA = 0.05, 0.05

#: Rules: name -> (statistic in 0..1 that is high for bad texts). The grid has GRID cut-offs for each.
GRID = 50


def _adjacent_hash(hashes: Column, by: int) -> Column:
    """Hash of each element with the one `by` further on; as many elements less."""
    n = F.size(hashes)
    return F.when(n > by, F.zip_with(F.slice(hashes, F.lit(1), n - by), F.slice(hashes, F.lit(by + 1), n - by), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def _repeated_windows(hashes: Column) -> Column:
    """Starts (from 0, ascending) of the windows whose hash occurs twice or more: sort by hash, compare neighbours."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(ordered)
    pairs = F.zip_with(F.slice(ordered, F.lit(1), n - 1), F.slice(ordered, F.lit(2), n - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    return F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull()))))


def _covered(starts: Column) -> Column:
    """Words in windows that begin at these sorted starts."""
    n = F.size(starts)
    steps = F.zip_with(F.slice(starts, F.lit(1), n - 1), F.slice(starts, F.lit(2), n - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return F.when(n > 0, F.aggregate(steps, F.lit(WINDOW).cast("long"), lambda s, x: s + x)).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """`keep`, then the counts of each whole text; a null text counts as empty.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words are those of the contract; n_adjacent (words equal to
    the word before), n_upper (A-Z) and n_marks (! and |) serve rules of the method.
    """
    text = text_or_empty(text_col)
    w = docs.select(*(keep or []), text.alias("_q_text")).withColumn("_q_words", F.regexp_extract_all("_q_text", F.lit(WORD), F.lit(0)))
    w = w.withColumn("_q_lines", F.filter(F.split("_q_text", "\n", -1), lambda line: line.rlike(WORD)))
    w = w.withColumn("_q_h1", F.transform("_q_words", lambda x: F.xxhash64(x)))
    w = w.withColumn("_q_h2", _adjacent_hash(F.col("_q_h1"), 1))
    w = w.withColumn("_q_h4", _adjacent_hash(F.col("_q_h2"), 2))
    w = w.withColumn("_q_h8", _adjacent_hash(F.col("_q_h4"), 4))
    n = F.size("_q_h1")
    same = F.zip_with(F.slice("_q_h1", F.lit(1), n - 1), F.slice("_q_h1", F.lit(2), n - 1), lambda a, b: a == b)
    repeats = F.when(F.size(F.array_distinct("_q_h8")) < F.size("_q_h8"), _covered(_repeated_windows(F.col("_q_h8")))).otherwise(F.lit(0).cast("long"))

    def count(kept_out: str) -> Column:
        return F.length(F.regexp_replace("_q_text", kept_out, "")).cast("long")

    found = F.struct(
        n.cast("long").alias("n_words"),
        count(SPACE).alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_q_lines").cast("long").alias("n_lines"),
        repeats.alias("n_repeat_words"),
        F.when(n > 1, F.size(F.filter(same, lambda x: x))).otherwise(0).cast("long").alias("n_adjacent"),
        count(r"[^A-Z]+").alias("n_upper"),
        count(r"[^!|]+").alias("n_marks"),
    )
    # A generator between the counts and what is made of them: a filter on them is not pushed below, where each of its
    # uses of a count would compute the count anew.
    return w.select(*[c for c in w.columns if not c.startswith("_q_")], F.inline(F.array(found)))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """The rules' statistics, each from 0 to 1 and higher for worse texts."""
    words, chars, lines = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1)), F.greatest("n_lines", F.lit(1))
    long_words = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("word_chars") / words - 5) / 25))
    return {
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeat_words": F.col("n_repeat_words") / words,
        "adjacent": F.col("n_adjacent") / words,
        "upper": F.col("n_upper") / chars,
        "marks": F.col("n_marks") / chars,
        "long_words": long_words,
    }


def stratum(lang: Column) -> Column:
    return F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise(F.lit("other"))


def _bin(ratio: Column) -> Column:
    """The largest cut-off number whose cut-off (number / GRID) the ratio exceeds or reaches; 0 rejects nothing."""
    return F.floor(F.least(ratio, F.lit(1.0)) * GRID).cast("int")


def _binned(stats: DataFrame, lang_col: str) -> DataFrame:
    return stats.withColumn("_q_stratum", stratum(F.col(lang_col))).withColumns({f"_q_bin_{name}": _bin(r) for name, r in ratios().items()})


def _allowed_rejections(n: Column, alpha: float, level: Column) -> Column:
    """The largest k with P(X <= k | n, alpha) <= level, or -1; the terms' logarithms come from their ratios."""
    start = F.struct((n * F.log(F.lit(1 - alpha))).alias("log_term"), F.lit(0.0).alias("below"), F.lit(-1).cast("long").alias("k"))

    def step(s: Column, j: Column) -> Column:
        cdf = s["below"] + F.exp(s["log_term"])
        odds = (n - j) / (j + 1) * F.lit(alpha / (1 - alpha))
        return F.struct((s["log_term"] + F.when(odds > 0, F.log(odds)).otherwise(F.lit(-1e9))).alias("log_term"), cdf.alias("below"), F.when(cdf <= level, j).otherwise(s["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * alpha)), start, step, lambda s: s["k"])


def thresholds(labelled: DataFrame, *, lang_col: str = "lang", quality_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum: _q_stratum and, for each rule, _q_cut_<rule>: the chosen cut-off number, null if none is.

    labelled: statistics of documents with their labels; those that pass the base rules are the holdout. Of the safe
    cut-offs of a rule the one with the most bad documents caught less good ones lost is chosen, the higher of equals,
    and none if it would lose as many as it catches. An empty holdout gives no thresholds, so nothing is rejected.
    """
    rules = list(ratios())
    holdout = _binned(labelled.where(F.col(quality_col).isin(0, 1)).where(~base_failed()), lang_col)
    tall = holdout.select("_q_stratum", F.col(quality_col).alias("good"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_q_bin_{r}").alias("bin")) for r in rules])).alias("x"))
    counts = tall.groupBy("_q_stratum", "x.rule", "x.bin").agg(F.sum("good").alias("n_good"), F.sum(1 - F.col("good")).alias("n_bad"))
    of_rule, everything = Window.partitionBy("_q_stratum", "rule"), Window.partitionBy()
    down = of_rule.orderBy(F.desc("bin"))
    tested = F.size(F.collect_set("_q_stratum").over(everything)) * len(rules)
    falls = counts.select(
        "_q_stratum",
        "rule",
        "bin",
        F.sum("n_good").over(of_rule).alias("n"),
        F.sum("n_good").over(down).alias("lost"),
        F.sum("n_bad").over(down).alias("caught"),
        (F.lit(delta) / tested).alias("level"),
    )
    limits = falls.groupBy("_q_stratum", "level").agg(F.max("n").alias("n")).withColumn("most", _allowed_rejections(F.col("n"), alpha / len(rules), F.col("level")))
    safe = falls.join(F.broadcast(limits.select("_q_stratum", "most")), "_q_stratum").where((F.col("bin") > 0) & (F.col("lost") <= F.col("most")) & (F.col("caught") > F.col("lost")))
    cuts = safe.groupBy("_q_stratum", "rule").agg(F.max(F.struct((F.col("caught") - F.col("lost")).alias("gain"), "bin")).alias("best"))
    return cuts.groupBy("_q_stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("best.bin"))).alias(f"_q_cut_{r}") for r in rules])


def judged(stats: DataFrame, cuts: DataFrame, lang_col: str = "lang") -> DataFrame:
    """stats with base_failed and kept. cuts is broadcast: at most 677 rows of a few numbers."""
    rejected = F.lit(False)
    for rule in ratios():
        rejected = rejected | F.coalesce(F.col(f"_q_bin_{rule}") >= F.col(f"_q_cut_{rule}"), F.lit(False))
    out = _binned(stats, lang_col).join(F.broadcast(cuts.withColumnRenamed("_q_stratum", "_q_of")), F.col("_q_stratum") == F.col("_q_of"), "left")
    out = out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)
    return out.drop(*[c for c in out.columns if c.startswith("_q_")])


def _with_labels(stats: DataFrame, labels: DataFrame, doc_col: str, quality_col: str) -> DataFrame:
    """Labels with several rows for a document count as good only if all are."""
    one = labels.where(F.col(doc_col).isNotNull()).groupBy(F.col(doc_col).alias("_l_doc")).agg(F.min(quality_col).alias("quality"))
    return stats.join(one, F.col(doc_col) == F.col("_l_doc")).drop("_l_doc")


def score(docs: DataFrame, labels: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the five counts, base_failed, kept: one row per row of docs.

    Null and empty texts have no words and fail the base rules; a null or odd language belongs to the stratum 'other';
    rows that repeat an id are judged one by one; an empty table gives an empty result.
    """
    stats = cut(statistics(docs, text_col, [F.col(doc_col).alias("doc_id"), F.col(lang_col).alias("lang")]))
    cuts = thresholds(_with_labels(stats, labels.select(F.col(doc_col).alias("doc_id"), quality_col), "doc_id", quality_col), alpha=alpha, delta=delta)
    return judged(stats, cuts).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quality_col: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns, of any names. Texts are read once: rows are stored
    with their counts, thresholds are made from the counts alone, and then the rows are judged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    counted = stored(statistics(docs, text_col, [row, F.col(doc_col).alias("doc_id"), F.col(lang_col).alias("lang")]))
    cuts = cut(thresholds(_with_labels(counted.drop("row"), labels.select(F.col(doc_col).alias("doc_id"), quality_col), "doc_id", quality_col), alpha=alpha, delta=delta))
    return judged(counted, cuts).where("kept").select("row.*")
