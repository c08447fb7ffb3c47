"""Queries over texts made from the tables' keys, dates and prices, and the SQL that says what the normaliser makes of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import swedish
from .language import _LISTS, _SMALL, quoted
from .records import _MILLIONS
from .tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _list(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


_WORDS = f"l AS (SELECT {_LISTS}, {_list(swedish.ORDINALS[k] for k in range(1, 21))} AS nth, {_list(swedish.MONTHS)} AS months)"
_NTH = f"CASE WHEN {{0}} BETWEEN 1 AND 20 THEN nth[{{0}}] WHEN {{0}} BETWEEN 21 AND 29 THEN 'tjugo' || nth[{{0}} - 20] WHEN {{0}} = 30 THEN 'trettionde' WHEN {{0}} = 31 THEN 'trettioförsta' ELSE {_SMALL} END"
_YEAR = f"CASE WHEN {{0}} BETWEEN 1100 AND 1999 THEN {_SMALL.replace('{0}', '({0} // 100)')} || 'hundra' || CASE WHEN {{0}} % 100 > 0 THEN {_SMALL.replace('{0}', '({0} % 100)')} ELSE '' END WHEN {{0}} BETWEEN 2000 AND 2099 THEN 'tjugohundra' || CASE WHEN {{0}} % 100 > 0 THEN {_SMALL.replace('{0}', '({0} % 100)')} ELSE '' END ELSE {_MILLIONS} END"


def _padded(c, width: int):
    return F.lpad(c.cast("string"), width, "0")


@query(f"WITH {_WORDS}, n AS (SELECT DISTINCT p_partkey % 40 AS n, p_partkey % 2500 AS y FROM part) SELECT n, y, {_NTH.format('n')} AS nth, {_YEAR.format('y')} AS year FROM n, l")
def ordinals_and_years(spark, sf_dir):
    """Ordinals, and years in hundreds."""
    n = table(spark, sf_dir, "part").select((F.col("p_partkey") % 40).alias("n"), (F.col("p_partkey") % 2500).alias("y")).distinct()
    return n.select("n", "y", swedish.ordinal_words("n").alias("nth"), swedish.year_words("y").alias("year"))


_DAYS = "SELECT DISTINCT 1050 + o_orderkey % 1100 AS y, 1 + (o_orderkey // 7) % 13 AS m, 1 + (o_orderkey // 3) % 31 AS d FROM orders"


@query(
    f"""WITH {_WORDS}, n AS ({_DAYS}) SELECT y, m, d, 'Den ' || CASE WHEN m <= 12 THEN {_NTH.format('d')} || ' ' || months[m] || ' ' || {_YEAR.format('y')} ELSE {_MILLIONS.format('y')} || '-' || {_SMALL.format('m')} || '-' || {_SMALL.format('d')} END || ' kom det.' AS said FROM n, l"""
)
def date_words(spark, sf_dir):
    """Dates inside a text; one in a thirteenth month stays a date for the number rule alone."""
    k = F.col("o_orderkey")
    n = table(spark, sf_dir, "orders").select((1050 + k % 1100).alias("y"), (1 + F.floor(k / 7) % 13).alias("m"), (1 + F.floor(k / 3) % 31).alias("d")).distinct()
    said = F.concat(F.lit("Den "), _padded(F.col("y"), 4), F.lit("-"), _padded(F.col("m"), 2), F.lit("-"), _padded(F.col("d"), 2), F.lit("  kom det ."))
    return n.select("y", "m", "d", swedish.normalise(said).alias("said"))


_DIGITS = "ones[{0} // 10 + 1] || ' ' || ones[{0} % 10 + 1]"


@query(
    f"""WITH {_WORDS}, n AS (SELECT DISTINCT o_orderkey % 26 AS h, (o_orderkey // 5) % 63 AS m, o_orderkey % 2 AS dot FROM orders)
    SELECT h, m, dot, 'Tåget, klockan ' || CASE WHEN h < 24 AND m < 60 THEN {_SMALL.format('h')} || CASE WHEN m > 0 THEN ' och ' || {_SMALL.format('m')} ELSE '' END
    WHEN dot = 1 THEN {_SMALL.format('h')} || ' komma ' || {_DIGITS.format('m')} ELSE {_SMALL.format('h')} || ':' || {_SMALL.format('m')} END || '!' AS said FROM n, l"""
)
def time_words(spark, sf_dir):
    """Clock times with a colon or a point; those beyond 23:59 fall to the rules that follow."""
    k = F.col("o_orderkey")
    n = table(spark, sf_dir, "orders").select((k % 26).alias("h"), (F.floor(k / 5) % 63).alias("m"), (k % 2).alias("dot")).distinct()
    said = F.concat(F.lit("Tåget, kl. "), F.col("h").cast("string"), F.when(F.col("dot") == 1, ".").otherwise(":"), _padded(F.col("m"), 2), F.lit("!"))
    return n.select("h", "m", "dot", swedish.normalise(said).alias("said"))


@query(
    f"""WITH {_WORDS}, n AS (SELECT DISTINCT (o_totalprice * 100)::DECIMAL(18, 0)::BIGINT AS cents FROM orders)
    SELECT cents, 'Pris: ' || {_MILLIONS.format('(cents // 100)')} || ' komma ' || {_DIGITS.format('(cents % 100)')} || ' kronor, ' || {_SMALL.format('(cents % 100)')} || ' procent och mer' AS said FROM n, l"""
)
def decimal_words(spark, sf_dir):
    """Prices with decimals, an abbreviation, a percent sign and an ampersand."""
    cents = (F.col("o_totalprice") * 100).cast("decimal(18,0)").cast("long").alias("cents")
    n = table(spark, sf_dir, "orders").select(cents).distinct()
    c = F.col("cents")
    said = F.concat(F.lit("Pris: "), F.floor(c / 100).cast("string"), F.lit(","), _padded(c % 100, 2), F.lit(" kr, "), (c % 100).cast("string"), F.lit(" %&mer"))
    return n.select("cents", swedish.normalise(said).alias("said"))


@query(
    f"""WITH {_WORDS}, n AS (SELECT DISTINCT (o_orderkey * 7919) % 1000000 AS n FROM orders)
    SELECT n, 'x ' || {_MILLIONS.format('n')} || ' — ' || {_MILLIONS.format('n')} || ' y' || n || ', z a b' AS said FROM n, l"""
)
def grouped_numbers(spark, sf_dir):
    """Numbers in groups of three and plain, a number inside a word, quotes, dashes and junk."""
    n = table(spark, sf_dir, "orders").select(((F.col("o_orderkey") * 7919) % 1_000_000).alias("n")).distinct()
    k = F.col("n")
    grouped = F.when(k >= 1000, F.concat(F.floor(k / 1000).cast("string"), F.lit(" "), _padded(k % 1000, 3))).otherwise(k.cast("string"))
    said = F.concat(F.lit('  "x"  '), grouped, F.lit("—"), k.cast("string"), F.lit(" y"), k.cast("string"), F.lit(" , z*a_b#  "))
    return n.select("n", swedish.normalise(said).alias("said"))


_SHORT = list(swedish.ABBREVIATIONS)
_PAIRS = f"p AS (SELECT unnest({_list(_SHORT)}) AS short, unnest({_list(swedish.ABBREVIATIONS.values())}) AS whole, unnest(range({len(_SHORT)})) AS i)"


@query(
    f"""WITH {_PAIRS}, c AS (SELECT DISTINCT c_custkey % {len(_SHORT)} AS i, c_nationkey FROM customer), n AS (SELECT n_nationkey, lower(n_name) AS word FROM nation)
    SELECT short, word, translate(word, '_', ' ') || ' ' || whole || ' b (' || whole || ') x' || short || ' och ' || whole || ', slut' AS said FROM c JOIN p USING (i) JOIN n ON n_nationkey = c_nationkey"""
)
def abbreviations_in_texts(spark, sf_dir):
    """Each abbreviation between spaces, in brackets, before a comma, and inside a word, where it stays."""
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") % len(_SHORT)).alias("i"), F.col("c_nationkey").alias("n_nationkey")).distinct()
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("word"))
    rows = c.join(F.broadcast(n), "n_nationkey").withColumn("short", F.element_at(F.array(*map(F.lit, _SHORT)), (F.col("i") + 1).cast("int")))
    s = F.col("short")
    said = F.concat("word", F.lit(" "), s, F.lit(" b ("), s, F.lit(") x"), s, F.lit(" och "), s, F.lit(", slut"))
    return rows.select("short", "word", swedish.normalise(said).alias("said"))


@query(f"WITH {_WORDS}, n AS (SELECT DISTINCT o_custkey AS n FROM orders) SELECT n, 'Bil nummer ' || {_MILLIONS.format('n')} || ' kostar ' || {_MILLIONS.format('(n * 7)')} || ' kronor.' AS normalised FROM n, l")
def normalize_flow(spark, sf_dir):
    """the verb over a table of texts."""
    from .. import api

    n = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("n")).distinct()
    texts = n.withColumn("text", F.concat(F.lit("  Bil nr "), F.col("n").cast("string"), F.lit(" kostar  "), (F.col("n") * 7).cast("string"), F.lit(" kr .")))
    return api.normalize(texts).select("n", "normalised")


@query(
    """WITH m AS (SELECT source AS system, avg((n_chars % 50) / 200.0::DOUBLE) AS cer, avg(2.2 + (n_chars % 30) / 40.0::DOUBLE) AS mos, avg((n_chars % 7) * 0.4::DOUBLE) AS comb, count(*) AS n FROM documents GROUP BY source)
    SELECT system, round(cer, 9) AS cer, round(mos, 9) AS mos, round(comb, 9) AS comb, n, CASE WHEN cer > 0.20 THEN 'FAIL-intelligibility' WHEN mos < 2.5 THEN 'FAIL-quality' WHEN comb < 1.2 THEN 'ok (comb low)' ELSE 'ok (comb audible)' END AS verdict FROM m"""
)
def evaluate_flow(spark, sf_dir):
    """The verb over a table of metrics: a system's means and verdict."""
    from .. import api

    n = F.col("n_chars")
    metrics = table(spark, sf_dir, "documents").select(F.col("source").alias("system"), ((n % 50) / 200.0).alias("cer"), (2.2 + (n % 30) / 40.0).alias("dnsmos"), ((n % 7) * 0.4).alias("comb"))
    return api.evaluate(metrics).select("system", F.round("mean_cer", 9).alias("cer"), F.round("mean_dnsmos", 9).alias("mos"), F.round("mean_comb", 9).alias("comb"), "n", "verdict")
