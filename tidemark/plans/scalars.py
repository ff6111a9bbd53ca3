"""Queries: scalar functions over literal variants and table rows, catalogs, names, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as X
from ..functions import timewin as W
from ..operators import catalog as C
from ..operators import fuzzy as Z
from ..operators import search as R
from .registry import Data, query


def values(*rows) -> str:
    """A SQL VALUES list."""
    def lit(v) -> str:
        if v is None:
            return "NULL"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def expected(name: str, schema: str, rows: list[tuple], f) -> None:
    """Register a query over literal inputs whose results are known: rows are (input, result), f makes result of input.
    The inputs meet all nations, so that the expression runs over table rows and is not folded away."""
    kind = "VARCHAR" if schema == "string" else "BIGINT"

    @query(f"SELECT n_nationkey, a AS input, CAST(b AS {kind}) AS result FROM nation, (VALUES {values(*rows)}) v(a, b)", name=name)
    def run(d: Data):
        inputs = d.rows([(r[0],) for r in rows], "input string")
        nations = d.table("nation").select("n_nationkey")
        return nations.crossJoin(F.broadcast(inputs)).withColumn("result", f(F.col("input")).cast("string" if schema == "string" else "long"))


expected("brand_normalize", "string", [("AlfaRomeo", "alfa romeo"), (" BMW ", "bmw"), ("VW", "volkswagen"), ("Mercedes Benz", "mercedes-benz"), ("MERCEDES-AMG", "mercedes-benz"), ("Škoda", "skoda"), ("Citroën", "citroen"), ("Rolls Royce", "rolls-royce"), ("Land  Rover", "land rover"), ("Unknown", ""), ("Tesla", "tesla"), ("Alfa", "alfa romeo")], X.normalize_brand)
expected("brand_display", "string", [("bmw", "BMW"), ("vw", "Volkswagen"), ("mercedes", "Mercedes-Benz"), ("SEAT", "Seat"), ("tOYOTA", "Toyota"), ("audi", "Audi")], X.display_brand)
expected("model_normalize", "string", [("4 Series", "serie 4"), ("serie 4", "serie 4"), ("4er", "serie 4"), ("Series 4", "serie 4"), ("i4", "i4"), ("X4", "x4"), ("M4", "m4"), ("A-Class", "clase a"), ("Clase A", "clase a"), ("A Klasse", "clase a"), ("G Wagon", "clase g"), ("C_Max/Grand", "c max grand"), ("class a", "class a"), ("Mégane", "megane"), ("unknown", "")], X.normalize_model)
expected("model_display", "string", [("4 series", "Serie 4"), ("leon fr", "Leon Fr"), ("A-Class", "Clase A")], X.display_model)
expected("model_alias_expand", "string", [("serie 4", "serie 4,4 series,series 4,4er,4 er"), ("g class", "clase g,g class,g klasse,class g,g wagon,gwagen,g wagen"), ("Golf", "golf")], lambda c: F.array_join(X.model_aliases(c), ","))
expected("fuel_normalize", "string", [("Diésel / gasóleo", "Diesel"), ("2.0 TDI", "Diesel"), ("electro/diesel", "Diesel"), ("Híbrido", "Hybrid"), ("Plug-in", "Hybrid"), ("EV", "Electric"), ("Elektro", "Electric"), ("Benzin", "Petrol"), ("gas", "Petrol"), ("Autogas (LPG)", "LPG"), ("GLP", "LPG"), ("", "Unknown"), ("S line quattro", "Unknown")], X.fuel_type)
expected("transmission_normalize", "string", [("Automático", "Automatic"), ("DSG", "Automatic"), ("S-Tronic 7", "Automatic"), ("Manual", "Manual"), ("Schaltgetriebe", "Manual"), ("?", "Unknown")], X.transmission)
expected("spec_token_normalize", "string", [("  S   Line ", "s line"), ("FR", "fr")], X.spec_token)
expected("engine_key", "string", [("0 TFSI", "tfsi"), ("30 TFSI", "30 tfsi"), ("0.0 TDI", "tdi"), ("2.0_TDI", "2.0 tdi")], X.engine_key)
expected("engine_label", "string", [("1.5 bluehdi", "1.5 BlueHDi"), ("0 tfsi", "TFSI"), ("1.8 vvt-i", "1.8 VVT-i"), ("1.0 ecoboost", "1.0 EcoBoost")], X.engine_label)
expected("engine_query_values", "string", [("tfsi", "tfsi,0 tfsi,0.0 tfsi"), ("2.0 tdi", "2.0 tdi")], lambda c: F.array_join(X.engine_query_values(c), ","))
expected("version_tokens", "string", [("2,0 TDI 150 CV S-tronic", "2.0,tdi,2.0 tdi"), ("A4 Avant (2.0)", "a4,avant,2.0,a4 avant,avant 2.0"), ("x", "x"), ("110cv", "")], lambda c: F.array_join(X.version_tokens(c), ","))
expected("power_parse", "long", [("1.5 dCi 115 CV", 115), ("85 kW", 116), ("110kW (150 CV)", 150), ("150", 150), ("(100 ps)", 100), ("15 cv", None), ("2001 hp", None), ("abc", None)], lambda c: N.power_cv(c, allow_bare=True))
expected("price_parse", "long", [("12.500 €", 12500), ("12 500,00", 12500), ("€ 9.990", 9990), ("free", None), ("1,250.50", 1250)], N.parse_amount)
expected("year_parse", "long", [("03/2019", 2019), ("'19", None)], N.parse_year)
expected("engine_heuristic", "string", [("Range Rover Sport D300 3.0 dynamic", "d300"), ("520d xDrive", "520d"), ("A4 40 TFSI quattro", "40 tfsi"), ("AVANTGARDE", None), ("1.2 allure", None), ("Volvo V60 2.4", None), ("1.0 TSI Life", "1.0 tsi"), ("4.0 V8 biturbo", "4.0 v8"), ("S65 V12", "v12")], C.engine_heuristic)
expected("country_normalize", "string", [("uk", "GB"), (" es ", "ES"), ("DE", "DE")], X.country_code)
expected("chat_markdown", "string", [("### Title", "<b>Title</b>"), ("a **b** <c>", "a <b>b</b> &lt;c&gt;")], X.chat_markdown)
expected("text_clean", "string", [("a\u00a0b   c", "a b c")], X.clean_text)


@query(f"SELECT n_nationkey, a AS price, CAST(b AS DOUBLE) AS result FROM nation, (VALUES (0.0, NULL), (5.0, 5000.0), (9.5, 9.5), (50.0, 50000.0), (99.5, 99.5), (500.0, 500.0), (1e9, 1e9), (1000000001.0, NULL)) v(a, b)")
def price_sanitize(d: Data):
    prices = d.rows([(x,) for x in (0.0, 5.0, 9.5, 50.0, 99.5, 500.0, 1e9, 1000000001.0)], "price double")
    return d.table("nation").select("n_nationkey").crossJoin(F.broadcast(prices)).withColumn("result", N.sanitize_price(F.col("price")))


_FOLD = "translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


@query(f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents")
def accent_fold(d: Data):
    return d.table("documents").select("doc_id", F.md5(X.fold(F.col("text"))).alias("folded"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Style' WHEN contains(p_name, 'red') THEN 'FR' ELSE 'Base' END AS trims FROM part")
def trim_match(d: Data):
    trims = d.rows([("x", "x", "Base"), ("x", "x", "FR"), ("x", "x", "Style")], "brand string, model string, trim string")
    parts = d.table("part").select(F.col("p_partkey").alias("portal_id"), F.lit("x").alias("brand_norm"), F.lit("x").alias("model_norm"), F.concat(F.regexp_replace("p_name", "red", "FR"), F.when(F.col("p_size") % 2 == 0, " Style").otherwise("")).alias("version"))
    found = C.trims_of(parts, trims)
    # A version that names both is shown by its longest trim here.
    return found.select(F.col("portal_id").alias("p_partkey"), F.substring_index("trims", ",", 1).alias("trims"))


@query("SELECT p_partkey, (contains(p_name, 'gear') OR NOT contains(p_name, 'widget')) AS fits FROM part")
def trim_base_default(d: Data):
    return d.table("part").select("p_partkey", C.matches_trims(F.col("p_name"), ["Base", "Gear"], ["Base", "Gear", "Widget"]).alias("fits"))


@query("SELECT p_partkey, b.word, levenshtein(split_part(p_name, ' ', 2), b.word) AS distance FROM part, (VALUES ('widget'), ('gear'), ('bolt')) b(word)")
def edit_distance(d: Data):
    words = d.rows([("widget",), ("gear",), ("bolt",)], "word string")
    return d.table("part").crossJoin(F.broadcast(words)).select("p_partkey", "word", F.levenshtein(F.element_at(F.split("p_name", " "), 2), F.col("word")).cast("long").alias("distance"))


BRANDS = ["volkswagen", "mercedes-benz", "alfa romeo", "land rover", "audi", "bmw", "seat", "skoda", "chevrolet", "rolls-royce", "peugeot", "renault"]
TYPED = [("Volkwagen", "volkswagen"), ("Mercdes", "mercedes-benz"), ("mercedez", "mercedes-benz"), ("Alfa", "alfa romeo"), ("Landrover", "land rover"), ("VW", "volkswagen"), ("merc", "mercedes-benz"), ("chevy", "chevrolet"), ("Audi", "audi"), ("Pegueot", "peugeot"), ("xyzzy", None)]


@query(f"SELECT c_custkey, a AS typed, b AS best FROM customer, (VALUES {values(*TYPED)}) v(a, b)")
def fuzzy_brand_resolve(d: Data):
    typed = d.rows([(t,) for t, _ in TYPED], "typed string")
    inputs = d.table("customer").select("c_custkey").crossJoin(F.broadcast(typed))
    return Z.resolve(inputs, d.rows([(b,) for b in BRANDS], "brand string"), "typed", "brand", Z.brand_score).select("c_custkey", "typed", "best")


MODELS = ["golf", "golf gti", "leon", "serie 4", "clase a", "a4", "208", "duster", "range rover sport"]
TYPED_MODELS = [("Golff", "golf"), ("4 Series", "serie 4"), ("A Klasse", "clase a"), ("Leon FR", "leon"), ("Dustre", "duster"), ("zzz", None), ("Range Rover Sprt", "range rover sport")]


@query(f"SELECT c_custkey, a AS typed, b AS best FROM customer, (VALUES {values(*TYPED_MODELS)}) v(a, b)")
def fuzzy_model_resolve(d: Data):
    typed = d.rows([(t,) for t, _ in TYPED_MODELS], "typed string")
    inputs = d.table("customer").select("c_custkey").crossJoin(F.broadcast(typed))
    return Z.resolve(inputs, d.rows([(m,) for m in MODELS], "model string"), "typed", "model", Z.model_score).select("c_custkey", "typed", "best")


_ALLOWED = "CASE WHEN {0} <= 3 THEN 0 WHEN {0} <= 5 THEN 1 WHEN {0} <= 9 THEN 2 ELSE 3 END"
_TWO = "least(length(x), length(y))"


@query(f"""t AS (SELECT DISTINCT substr(p_name, 1, p_partkey % length(p_name)) || substr(p_name, p_partkey % length(p_name) + 2) AS typed FROM part),
n AS (SELECT DISTINCT p_name AS name FROM part),
w AS (SELECT typed, name, list_filter(string_split(trim(typed), ' '), lambda x: x <> '') AS a, string_split(name, ' ') AS b, replace(typed, ' ', '') AS q, replace(name, ' ', '') AS c FROM t, n),
k AS (SELECT *, [[x = y OR ({_TWO} >= 3 AND (((starts_with(x, y) OR starts_with(y, x)) AND {_TWO} / greatest(length(x), length(y)) >= 0.7) OR levenshtein(x, y) <= {_ALLOWED.format(_TWO)})) FOR y IN b] FOR x IN a] AS m, levenshtein(q, c) AS d, {_ALLOWED.format("least(length(q), length(c))")} AS allowed FROM w),
s AS (SELECT *, len(list_filter(m, lambda r: list_bool_or(r))) AS qn, len(list_filter(range(1, len(b) + 1), lambda j: list_bool_or(list_transform(m, lambda r: r[j])))) AS cn FROM k),
z AS (SELECT typed, name, CASE WHEN trim(typed) = name THEN 100.0 WHEN q = c THEN 95.0
   WHEN (least(length(q), length(c)) >= 4 AND d <= allowed) OR qn = len(a) OR cn = len(b) OR (qn >= 1 AND (qn >= least(len(a), len(b)) OR (len(a) >= 2 AND qn / len(a) >= 0.6))) THEN 80.0 - least(abs(length(q) - length(c)), 20)
   WHEN least(length(q), length(c)) >= 3 AND d <= allowed THEN 70.0 - d ELSE -1.0 END AS score FROM s)
SELECT typed, arg_min(name, struct_pack(s := -score, n := name)) FILTER (score >= 60) AS best, max(score) FILTER (score >= 60)::DOUBLE AS score FROM z GROUP BY typed""", listings=True)
def name_resolve(d: Data):
    """Names of the parts, each spelt without one of its letters, against all names."""
    at = F.col("p_partkey") % F.length("p_name")
    typed = d.table("part").select(F.concat(F.substr("p_name", F.lit(1), at.cast("int")), F.substr("p_name", (at + 2).cast("int"))).alias("typed")).distinct()
    return Z.resolve(typed, d.table("part").select(F.col("p_name").alias("name")), "typed", "name", Z.model_score)


LOOSE = [("Leon FR", "leon", 1), ("golf gti", "golf", 1), ("Audi", "bmw", 0), ("range rover", "rover range", 1), ("megane", "megan", 1), ("a4", "a5", 0)]


@query(f"SELECT n_nationkey, a, b, c::BIGINT AS fits FROM nation, (VALUES {values(*LOOSE)}) v(a, b, c)")
def loose_name_match(d: Data):
    pairs = d.rows([(a, b) for a, b, _ in LOOSE], "a string, b string")
    return d.table("nation").select("n_nationkey").crossJoin(F.broadcast(pairs)).withColumn("fits", Z.loosely(F.col("a"), F.col("b")).cast("long"))


_RECOVER = """sc AS (SELECT *, CASE WHEN abs(price - 40000) / 40000 > 0.35 OR abs(year - 1995) > 2 OR abs(mileage_km - 20000) / 20000.0 > 0.55 THEN -1 ELSE
  CASE WHEN abs(price - 40000) / 40000 <= 0.08 THEN 120 WHEN abs(price - 40000) / 40000 <= 0.15 THEN 80 WHEN abs(price - 40000) / 40000 <= 0.25 THEN 40 ELSE 5 END
  + CASE abs(year - 1995) WHEN 0 THEN 100 WHEN 1 THEN 70 ELSE 25 END
  + CASE WHEN abs(mileage_km - 20000) / 20000.0 <= 0.15 THEN 40 WHEN abs(mileage_km - 20000) / 20000.0 <= 0.3 THEN 20 WHEN abs(mileage_km - 20000) / 20000.0 <= 0.45 THEN 5 ELSE 0 END END AS score FROM listing)"""


@query(f"{_RECOVER} SELECT brand_norm, portal_id, score FROM (SELECT *, row_number() OVER (PARTITION BY brand_norm ORDER BY score DESC, updated_at DESC, portal_id) AS r FROM sc WHERE score >= 0) WHERE r = 1", listings=True)
def recover_best_match(d: Data):
    from ..operators.dedup import keep_first

    scored = d.listing.withColumn("score", Z.recovery_score(F.col("price"), F.col("year"), F.col("mileage_km"), 40_000, 1995, 20_000)).where("score >= 0")
    return keep_first(scored, ["brand_norm"], [F.desc("score"), F.desc("updated_at"), F.col("portal_id")]).select("brand_norm", "portal_id", "score")


#: Models as typed, and what they mean in the stock: exact, misspelt, in the wrong case, and nothing.
TYPED_STOCK = [("PROMO", "promo"), ("promoo", "promo"), ("Standart", "standard"), (" small ", "small"), ("xyzzy", None)]


@query(f"""t(k, model) AS (VALUES {", ".join(f"({k}, {repr(m) if m else 'NULL'})" for k, (_, m) in enumerate(TYPED_STOCK))}),
q AS (SELECT c_custkey AS id, 'brand#' || (1 + c_custkey % 25) AS brand, t.model, 20000.0 + (c_custkey % 8) * 10000 AS hp, CASE WHEN c_custkey % 4 <> 0 THEN 1993 + c_custkey % 6 END AS hy,
  CASE WHEN c_custkey % 9 <> 0 THEN 5000 * (c_custkey % 9) END AS hk, c_custkey % 2 = 0 AS again, CASE WHEN c_custkey % 3 = 0 THEN 'red' ELSE '' END AS word FROM customer JOIN t ON t.k = c_custkey % {len(TYPED_STOCK)}),
c AS (SELECT q.id, q.again, q.id AS uid, l.*, abs(price - hp) / hp AS dp, abs(year - hy) AS dy, abs(mileage_km - hk) / hk::DOUBLE AS dk FROM q JOIN listing l ON l.brand_norm = q.brand AND l.model_norm = q.model
  AND (hy IS NULL OR abs(year - hy) <= 2) AND price BETWEEN floor(hp * 0.75 + 0.5) AND floor(hp * 1.25 + 0.5) AND contains(version, word)),
s AS (SELECT *, CASE WHEN dp > 0.35 OR coalesce(dy > 2, false) OR coalesce(dk > 0.55, false) THEN -1 ELSE CASE WHEN dp <= 0.08 THEN 120 WHEN dp <= 0.15 THEN 80 WHEN dp <= 0.25 THEN 40 ELSE 5 END
  + CASE dy WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 25 ELSE 0 END + CASE WHEN dk IS NULL THEN 0 WHEN dk <= 0.15 THEN 40 WHEN dk <= 0.3 THEN 20 WHEN dk <= 0.45 THEN 5 ELSE 0 END END AS score FROM c),
had AS (SELECT DISTINCT user_id AS hu, o.brand_norm AS hb, o.model_norm AS hm, o.year AS hyr, o.mileage_km AS hkm, o.price AS hpr FROM sent JOIN listing o ON o.portal_id = sent.listing_id),
gone AS (SELECT DISTINCT id AS gi, portal_id AS gp FROM s JOIN had ON hu = uid AND hb = brand_norm AND hm = model_norm AND hyr = year AND abs(hkm - mileage_km) <= 1000 AND abs(hpr - price) / greatest((hpr + price) / 2, 1) <= 0.05 WHERE NOT again)
SELECT id AS request_id, portal_id, score FROM s LEFT JOIN gone ON gi = id AND gp = portal_id WHERE score >= 0 AND gi IS NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, updated_at DESC, portal_id) = 1""", listings=True)
def inventory_search(d: Data):
    return R.search(_requests(d), d.listing, _models(d), d.sent)


def _models(d: Data):
    return d.table("part").select(F.lower("p_brand").alias("brand"), F.lower("p_type").alias("model")).distinct()


def _requests(d: Data):
    """A described car for each customer."""
    k = F.col("c_custkey")
    model = F.element_at(F.array(*[F.lit(m) for m, _ in TYPED_STOCK]), (k % len(TYPED_STOCK) + 1).cast("int"))
    return d.table("customer").select(
        k.alias("request_id"), k.alias("user_id"), F.concat(F.lit(" Brand#"), (1 + k % 25).cast("string")).alias("brand"), model.alias("model"), F.when(k % 3 == 0, F.array(F.lit("Red"), F.lit("Italy"))).alias("specs"),
        (20000.0 + (k % 8) * 10000).alias("price"), F.when(k % 4 != 0, 1993 + k % 6).alias("year"), F.when(k % 9 != 0, 5000 * (k % 9)).alias("km"), (k % 2 == 0).alias("again"),
    )


@query(f"""t(k, model) AS (VALUES {", ".join(f"({k}, {repr(m) if m else 'NULL'})" for k, (_, m) in enumerate(TYPED_STOCK))})
SELECT c_custkey AS request_id, count(*) AS n FROM customer JOIN t ON t.k = c_custkey % {len(TYPED_STOCK)} JOIN sent ON user_id = c_custkey JOIN listing l ON portal_id = listing_id
WHERE levenshtein('brand' || (1 + c_custkey % 25), replace(l.brand_norm, '#', '')) <= 2 AND l.model_norm = t.model AND (c_custkey % 3 <> 0 OR contains(l.version, 'red')) GROUP BY ALL""", listings=True)
def same_car_gate(d: Data):
    """How many of the adverts that a customer has got are the car that they describe."""
    asked = R.resolved(_requests(d), _models(d)).select("request_id", F.col("user_id").alias("who"), F.col("brand").alias("q_brand"), F.col("model").alias("q_model"), "brand_best", "model_best", F.coalesce("specs", F.array().cast("array<string>")).alias("specs"))
    stock = d.listing.select("portal_id", "brand_norm", "model_norm", "version")
    got = d.sent.join(asked, F.col("user_id") == F.col("who")).join(stock, F.col("listing_id") == F.col("portal_id"))
    same = R.is_same_car(F.col("q_brand"), F.col("brand_best"), F.col("q_model"), F.col("model_best"), F.col("specs"), F.col("brand_norm"), F.col("model_norm"), F.col("version"))
    return got.where(same).groupBy("request_id").agg(F.count("*").alias("n"))


@query("""SELECT event_id, isodow(ts)::INT AS weekday, hour(ts)::BIGINT AS hour, (isodow(ts) <= 5 AND hour(ts) BETWEEN 8 AND 20) AS business,
  (isodow(ts) IN (1, 3, 5) AND hour(ts) >= 9 AND hour(ts) < 21) AS open, (hour(ts) >= 22 OR hour(ts) < 6) AS night FROM events""")
def schedule_window(d: Data):
    ts = F.col("ts").cast("timestamp")
    days = F.array(F.lit(1), F.lit(3), F.lit(5))
    return d.table("events").select("event_id", W.iso_weekday(ts).alias("weekday"), F.hour(ts).cast("long").alias("hour"), W.business_hours(ts).alias("business"), W.window_open(ts, days, F.lit(9), F.lit(21)).alias("open"), W.hour_in(F.hour(ts), F.lit(22), F.lit(6)).alias("night"))


@query("""SELECT event_id, strftime(CASE WHEN isodow(ts) IN (1, 3) AND hour(ts) >= 9 AND hour(ts) < 21 THEN ts ELSE
  (SELECT min(h) FROM (SELECT date_trunc('hour', ts) + to_hours(k) AS h FROM range(1, 337) r(k)) WHERE isodow(h) IN (1, 3) AND hour(h) >= 9 AND hour(h) < 21) END, '%Y-%m-%d %H:%M:%S') AS opens FROM events""")
def next_opening(d: Data):
    ts = F.col("ts").cast("timestamp")
    opens = W.next_opening(ts, F.array(F.lit(1), F.lit(3)), F.lit(9), F.lit(21))
    return d.table("events").select("event_id", F.date_format(opens, "yyyy-MM-dd HH:mm:ss").alias("opens"))


@query("SELECT event_id, hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Madrid')::BIGINT AS hour FROM events")
def madrid_hour(d: Data):
    return d.table("events").select("event_id", F.hour(W.wall_clock(F.col("ts").cast("timestamp"))).cast("long").alias("hour"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '1234567' ELSE array_to_string(list_sort(list_distinct([(1 + c_custkey % 6)::INT, 3])), '') END || ' ' || CASE WHEN c_custkey % 30 < 7 THEN 7 WHEN c_custkey % 30 > 12 THEN 12 ELSE c_custkey % 30 END
  || '-' || CASE WHEN c_custkey % 5 = 0 THEN 21 ELSE 19 END || '/' || CASE WHEN c_custkey % 10 IN (1, 2, 3, 4) THEN c_custkey % 10 ELSE 2 END AS prefs FROM customer""")
def schedule_clamp(d: Data):
    k = F.col("c_custkey")
    days = F.when(k % 7 == 0, F.array(F.lit(0), F.lit(9))).otherwise(F.array((1 + k % 6).cast("int"), F.lit(3), F.lit(8), F.lit(3)))
    p = W.clamped_preferences(days, k % 30, F.when(k % 5 != 0, k % 18), k % 10)
    return d.table("customer").select("c_custkey", p.alias("p")).select("c_custkey", F.concat(F.array_join(F.transform("p.days", lambda x: x.cast("string")), ""), F.lit(" "), F.col("p.start").cast("string"), F.lit("-"), F.col("p.end").cast("string"), F.lit("/"), F.col("p.interval").cast("string")).alias("prefs"))
