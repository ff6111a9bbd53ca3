"""Names as people type them: brands and models by a ladder of scores, and the search for a described car."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Short names of brands.
BRAND_ALIASES = {
    "vw": "volkswagen", "volk": "volkswagen", "volks": "volkswagen", "merc": "mercedes-benz", "benz": "mercedes-benz", "mb": "mercedes-benz",
    "chevy": "chevrolet", "alfa": "alfa romeo", "aston": "aston martin", "land": "land rover", "landrover": "land rover", "rover": "land rover",
    "range rover": "land rover", "rangerover": "land rover", "rolls": "rolls-royce", "rr": "rolls-royce", "citroen": "citroen",
    "ds": "ds automobiles", "dsautomobiles": "ds automobiles", "lynk": "lynk & co", "lynk co": "lynk & co", "ssangyong": "ssangyong / kgm",
    "kgm": "ssangyong / kgm", "gwm": "ora (gwm)", "ora": "ora (gwm)", "mini": "mini", "bmw": "bmw",
}
#: The least score of a match, and of one that is left after a model's last word was dropped.
ACCEPT, RETRY = 60, 80


def _let(body: Callable[..., Column], **values: Column) -> Column:
    """body of values that are worked out once, however often it uses them."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, lambda s: body(*[s[k] for k in values])), F.lit(0))


def edits_allowed(n: Column) -> Column:
    return F.when(n <= 3, 0).when(n <= 5, 1).when(n <= 9, 2).otherwise(3)


def within_edits(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b) <= edits_allowed(F.least(F.length(a), F.length(b)))


def tokens_close(a: Column, b: Column) -> Column:
    """Two compact words: equal, one the start of most of the other, or a few edits apart."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    prefix = (a.startswith(b) | b.startswith(a)) & (short / long >= 0.7)
    return (a != "") & (b != "") & ((a == b) | ((short >= 3) & (prefix | within_edits(a, b))))


def loosely(query: Column, candidate: Column) -> Column:
    """Whether two names could mean the same: as a whole, or word by word either way, or in most words."""
    def words(n: Column) -> Column:
        return F.filter(F.transform(F.split(n, " "), X.compact_name), lambda w: w != "")

    def long(n: Column) -> Column:
        return F.filter(n, lambda w: F.length(w) >= 2)

    def test(q, c, qc, cc, qt, ct):
        return _let(lambda qs, cs: judge(q, c, qc, cc, qt, ct, qs, cs, F.size(F.filter(qs, lambda a: F.exists(cs, lambda b: tokens_close(a, b))))), qs=long(qt), cs=long(ct))

    def judge(q, c, qc, cc, qt, ct, qs, cs, shared):
        some = (F.size(qs) >= 1) & (F.size(cs) >= 1) & (shared >= 1)
        covered = F.forall(qt, lambda a: F.exists(ct, lambda b: tokens_close(a, b))) | F.forall(ct, lambda b: F.exists(qt, lambda a: tokens_close(a, b)))
        whole = (q == c) | ((qc != "") & (qc == cc)) | ((F.length(qc) >= 4) & (F.length(cc) >= 4) & within_edits(qc, cc))
        by_word = (F.size(qt) > 0) & (F.size(ct) > 0) & (covered | (some & ((shared >= F.least(F.size(qs), F.size(cs))) | ((F.size(qs) >= 2) & (shared / F.size(qs) >= 0.6)))))
        return F.when((q == "") | (c == ""), False).otherwise(whole | by_word)

    return _let(lambda q, c: _let(lambda qc, cc, qt, ct: test(q, c, qc, cc, qt, ct), qc=X.compact_name(q), cc=X.compact_name(c), qt=words(q), ct=words(c)), q=X.soft_model(query), c=X.soft_model(candidate))


def brand_alias(c: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in BRAND_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(aliases, X.soft_model(c)), F.element_at(aliases, X.compact_name(c)))


def brand_score(query: Column, brand: Column) -> Column:
    """How well a typed brand fits a catalog's brand key; -1 for not at all."""
    q, c = X.compact_name(query), X.compact_name(brand)
    first = F.split(X.soft_model(brand), " ")
    soft = X.soft_model(query)
    return (
        F.when((q == "") | (c == ""), -1)
        .when(X.normalize_brand(query) == brand, 100)
        .when(q == c, 95)
        .when(brand_alias(query) == brand, 92)
        .when((F.size(first) >= 2) & (soft == first[0]) & (F.length(soft) >= 3), 88)
        .when(c.startswith(q) & (F.length(q) >= 4), 80)
        .when(q.startswith(c) & (F.length(c) >= 4), 78)
        .when(within_edits(q, c), 70 - F.levenshtein(q, c))
        .when(loosely(query, brand), 60)
        .otherwise(-1)
    ).cast("double")


def model_score(query: Column, model: Column) -> Column:
    def score(q, c, qc, cc):
        longer = F.abs(F.length(qc) - F.length(cc))
        starts = q.startswith(F.concat(c, F.lit(" "))) | c.startswith(F.concat(q, F.lit(" ")))
        return (
            F.when((q == "") | (c == ""), -1.0)
            .when(q == c, 100.0)
            .when((qc != "") & (qc == cc), 95.0)
            .when(loosely(q, c), 80.0 - F.least(longer, F.lit(20)))
            .when((F.length(qc) >= 3) & (F.length(cc) >= 3) & within_edits(qc, cc), 70.0 - F.levenshtein(qc, cc))
            .when(starts, 65 - F.abs(F.length(q) - F.length(c)) * 0.1)
            .otherwise(-1.0)
        )

    return _let(lambda q, c: _let(lambda qc, cc: score(q, c, qc, cc), qc=X.compact_name(q), cc=X.compact_name(c)), q=X.canonical_model(X.soft_model(query)), c=X.canonical_model(X.soft_model(model)))


def _deletions(word: Column) -> Column:
    """A compact word with as many letters left out as edits are allowed at its length, in every way, and with fewer. Words
    within their allowed edits have one of these in common."""
    def less(words: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1))))))

    none, own = F.array().cast("array<string>"), F.array(word)
    out, last = own, own
    for k in range(1, 4):
        last = F.when(edits_allowed(F.length(word)) >= k, less(last)).otherwise(none)
        out = F.concat(out, last)
    return F.array_distinct(out)


def _starts(word: Column, least: Column) -> Column:
    """The beginnings of a word with at least that many letters, itself included."""
    n = F.length(word)
    return F.when(n >= least, F.transform(F.sequence(least, n), lambda k: F.substr(word, F.lit(1), k))).otherwise(F.array().cast("array<string>"))


def _tagged(tag: str, words: Column) -> Column:
    return F.transform(words, lambda w: F.concat(F.lit(tag), w))


def _loose_keys(name: Column) -> Column:
    """Keys of which two names have one in common if `loosely` holds, or the whole names are within edits: deletions of the whole
    compact name, and of its words deletions and long beginnings."""
    def keys(whole: Column, words: Column) -> Column:
        near = F.flatten(F.transform(words, _deletions))
        long = F.flatten(F.transform(words, lambda w: _starts(w, F.greatest(F.lit(3), F.ceil(F.length(w) * 0.7).cast("int")))))
        return F.concat(_tagged("w", _deletions(whole)), _tagged("t", near), _tagged("s", long))

    split = lambda soft: F.filter(F.transform(F.split(soft, " "), X.compact_name), lambda w: w != "")
    return _let(lambda soft: _let(keys, whole=X.compact_name(soft), words=split(soft)), soft=X.soft_model(name))


def brand_keys(name: Column, typed: bool) -> Column:
    """Keys of a typed brand, or of a brand of the catalog: some key is common wherever brand_score accepts."""
    compact, soft, none = X.compact_name(name), X.soft_model(name), F.array().cast("array<string>")
    keys = [_loose_keys(name), _tagged("w", _let(_deletions, compact=compact))]
    if typed:
        keys += [_tagged("n", F.array_compact(F.array(X.normalize_brand(name), brand_alias(name)))), F.array(F.concat(F.lit("f"), soft)), F.array(F.concat(F.lit("a"), compact)), _tagged("b", _starts(compact, F.lit(4)))]
    else:
        keys += [F.array(F.concat(F.lit("n"), name)), F.array(F.concat(F.lit("f"), F.split(soft, " ")[0])), _tagged("a", _starts(compact, F.lit(4))), F.array(F.concat(F.lit("b"), compact))]
    return F.filter(F.array_distinct(F.coalesce(F.concat(*keys), none)), lambda k: k.isNotNull())


def model_keys(name: Column, typed: bool) -> Column:
    """The same for models and model_score; both sides have keys of one kind."""
    both = lambda m: F.concat(_loose_keys(m), _tagged("w", _let(_deletions, compact=X.compact_name(m))))
    return F.array_distinct(_let(both, m=X.canonical_model(X.soft_model(name))))


def name_pairs(typed: DataFrame, names: DataFrame, query: str, name: str, keys, on: tuple[str, str] | None = None) -> DataFrame:
    """Distinct pairs of typed (query, ...) and names (name, ...) that have a key in common, each once; on: columns of both that must
    be equal as well. An equi-join on the keys, so a name meets the few that are spelt like it and not the whole catalog."""
    asked = typed.withColumn("_key", F.explode(keys(F.col(query), True)))
    held = names.withColumn("_held", F.explode(keys(F.col(name), False)))
    same = F.col("_key") == F.col("_held")
    if on:
        same &= F.col(on[0]) == F.col(on[1])
    return asked.join(held, same).drop("_key", "_held").distinct()


def resolve(inputs: DataFrame, dimension: DataFrame, query: str, name: str, score) -> DataFrame:
    """inputs with best and score: the name of the dimension that fits best, the first in order of equal ones; null under
    the accepted score. A model that none fits is tried once more without its last word, at a score of RETRY.

    Each distinct typed name is scored against the names that share a key with it (brand_keys, model_keys), which are all
    that the score can accept. Nothing runs while the plan is built.
    """
    keys = {brand_score: brand_keys, model_score: model_keys}[score]
    typed, names = inputs.select(query).distinct(), dimension.select(name).distinct()

    def best_of(pairs: DataFrame, asked: str, least: float) -> DataFrame:
        scored = pairs.withColumn("score", score(F.col(asked), F.col(name))).where(F.col("score") >= least)
        best = scored.groupBy(query).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(name).alias("name"))).alias("b"))
        return best.select(F.col(query).alias("_typed"), F.col("b.name").alias("best"), (-F.col("b.s")).alias("score"))

    best = best_of(name_pairs(typed, names, query, name, keys), query, ACCEPT)
    if score is model_score:
        left = typed.join(best, F.col(query) == F.col("_typed"), "left_anti")
        words = F.split(X.soft_model(F.col(query)), " ")
        heads = left.where(F.size(words) >= 2).withColumn("_head", F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))
        best = best.unionByName(best_of(name_pairs(heads, names, "_head", name, keys), "_head", RETRY))
    return inputs.join(best, F.col(query) == F.col("_typed"), "left").drop("_typed")


def recovery_score(price: Column, year: Column, km: Column, hint_price: float | None, hint_year: int | None, hint_km: int | None) -> Column:
    """How well a car fits what someone remembers of it; -1 if one of the hints rules it out."""
    score, miss = F.lit(0), F.lit(False)

    def ladder(diff: Column, steps, beyond: float) -> tuple[Column, Column]:
        out = F
        for most, points in steps:
            out = out.when(diff <= most, points)
        return out.otherwise(0), diff > beyond

    if hint_price:
        s, m = ladder(F.abs(price - hint_price) / hint_price, ((0.08, 120), (0.15, 80), (0.25, 40), (0.35, 5)), 0.35)
        score, miss = score + s, miss | m
    if hint_year and hint_year > 1990:
        s, m = ladder(F.abs(year - hint_year), ((0, 100), (1, 70), (2, 25)), 2)
        score, miss = score + s, miss | m
    if hint_km:
        s, m = ladder(F.abs(km - hint_km) / max(hint_km, 1), ((0.15, 40), (0.3, 20), (0.45, 5)), 0.55)
        score, miss = score + s, miss | m
    return F.when(miss, -1).otherwise(score)
