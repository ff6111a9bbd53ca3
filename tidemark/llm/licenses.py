"""License scans: ordered signature rules behind a keyword gate, with DataFrame operations only.

Every whole text becomes words. A text with none of the rules' keywords is done; the others are put into a canonical
form, words joined by single spaces, and meet only the rules whose keyword they have. Marks put around a signature's
matches give the word positions of all of them in one pass. Detections in order of their start then meet a running
record of how far each priority's detections reach: one that lies inside another of the same or a higher priority is
suppressed. Both passes are linear in the words and in the detections of a text, whatever its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .license_rules import BASE, rules

#: Words: runs of digits, lower-case letters and everything beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_OPEN, _CLOSE = "\x01", "\x02"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PRIORITIES = 4


def _spans(canonical: Column, signature: Column | str) -> Column:
    """Array of (start, end): the words of each match, from 0, the end exclusive. canonical: ' w1 w2 ... '."""
    pattern = F.concat(F.lit("(?<= )("), signature if isinstance(signature, Column) else F.lit(signature), F.lit(")(?= )"))
    marked = F.split(F.trim(F.regexp_replace(canonical, pattern, F.lit(f"{_OPEN} $1 {_CLOSE}"))), " ", -1)

    def at(mark: str) -> Column:
        return F.filter(F.transform(marked, lambda w, i: F.when(w == mark, i)), lambda i: i.isNotNull())

    starts = F.transform(at(_OPEN), lambda p, k: p - 2 * k)
    ends = F.transform(at(_CLOSE), lambda p, k: p - 2 * k - 1)
    return F.when(F.rlike(canonical, pattern), F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), e.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _survivors(found: Column) -> Column:
    """(labels, score) of the detections that are not suppressed. Detections sort by start, longer and higher first."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["end"]).alias("end"), (-d["priority"]).alias("priority"), d["ordinal"].alias("ordinal"), d["label"].alias("label"), d["confidence"].alias("confidence"))))
    state = F.struct(F.array(*[F.lit(-1)] * _PRIORITIES).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(s: Column, d: Column) -> Column:
        end, priority = -d["end"], -d["priority"]
        inside = F.exists(F.slice(s["reach"], priority + 1, F.lit(_PRIORITIES) - priority), lambda r: r >= end)
        return F.struct(
            F.transform(s["reach"], lambda r, p: F.when(p == priority, F.greatest(r, end)).otherwise(r)).alias("reach"),
            F.when(inside, s["labels"]).otherwise(F.array_union(s["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, s["score"]).otherwise(F.greatest(s["score"], d["confidence"])).alias("score"),
        )

    return F.aggregate(ordered, state, step, lambda s: F.struct(s["labels"].alias("labels"), s["score"].alias("score")))


def scan(docs: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per row of docs.

    Base detections (phrases of the contract) are counted at all places and always keep their labels; the rules' labels
    are those of detections that survive suppression. score is the highest confidence among them, 0 without any. Null
    and empty texts have no words and empty labels; repeated rows are scanned alike; other columns are ignored.
    """
    table = rules()
    keywords = F.array(*map(F.lit, sorted({r[3] for r in table} | {w for _, phrase in BASE for w in phrase.split()[:1]})))
    literal = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(c).alias("confidence"), F.lit(label).alias("label"), F.lit(k).alias("keyword"), F.lit(s).alias("signature"), F.lit(n).alias("ordinal")) for n, (p, c, label, k, s) in enumerate(table)])
    text = text_or_empty(text_col)
    # Full lower case never hides an ASCII keyword and keeps word boundaries, so it serves for counting and for the gate.
    t = docs.select(F.col(doc_col).alias("doc_id"), text.alias("_t")).withColumn("_words", F.regexp_extract_all(F.lower("_t"), F.lit(TOKEN), F.lit(0)))
    t = t.select("doc_id", F.size("_words").cast("long").alias("n_words"), F.when(F.arrays_overlap("_words", keywords), F.col("_t")).alias("_t"))
    t = t.withColumn("_words", F.when(F.col("_t").isNotNull(), F.regexp_extract_all(F.translate("_t", _UPPER, _LOWER), F.lit(TOKEN), F.lit(0)))).drop("_t")
    t = t.withColumn("_present", F.array_intersect("_words", keywords)).withColumn("_canonical", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))).drop("_words")

    def of_phrase(label: str, phrase: str) -> Column:
        return F.transform(_spans(F.col("_canonical"), phrase), lambda s: F.struct(F.lit(label).alias("label"), s["start"].alias("start")))

    base = F.concat(*[of_phrase(label, phrase) for label, phrase in BASE])
    candidates = F.filter(literal, lambda r: F.array_contains(F.col("_present"), r["keyword"]))
    found = F.flatten(
        F.transform(candidates, lambda r: F.transform(_spans(F.col("_canonical"), r["signature"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), r["label"].alias("label"), r["ordinal"].alias("ordinal"))))
    )
    gated = F.col("_canonical").isNotNull()
    t = t.withColumn("_base", F.when(gated, base)).withColumn("_kept", F.when(gated, _survivors(found)))
    no_labels = F.array().cast("array<string>")
    base_labels = F.array_sort(F.array_distinct(F.coalesce(F.col("_base.label"), no_labels)))
    return t.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("_base"), F.lit(0)).cast("long").alias("n_base"),
        F.array_min("_base.start").cast("long").alias("first_word"),
        F.array_max("_base.start").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce(F.col("_kept.labels"), no_labels))), ",").alias("labels"),
        F.coalesce("_kept.score", F.lit(0.0)).alias("score"),
    )
