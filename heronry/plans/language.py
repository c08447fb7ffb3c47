"""Queries over texts and phonemes, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phonemes as ph
from ..functions import swedish, text
from ..operators import folds, stats
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


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_NORM = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-zåäöéü ]+', ' ', 'g'), ' +', ' ', 'g'))"
_FOLD = "translate({0}, 'åäöéü', '12345')"


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def norm_text(spark, sf_dir):
    """T1."""
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_metric("text").alias("norm"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, {_NORM.format('text')} AS norm FROM conversations), p AS (SELECT a.conv_id, a.turn, {_FOLD.format('a.norm')} AS r, {_FOLD.format('b.norm')} AS h FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, CASE WHEN length(r) = 0 THEN CASE WHEN length(h) > 0 THEN 1.0 ELSE 0.0 END ELSE levenshtein(r, h)::DOUBLE / length(r) END AS cer FROM p"""
)
def cer_pairs(spark, sf_dir):
    """A turn against the next one."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.norm_metric("text").alias("norm"))
    b = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("norm").alias("hyp"))
    return t.join(b, ["conv_id", "turn"]).select("conv_id", "turn", text.cer("norm", "hyp").alias("cer"))


_VOCAB = "vocab AS (SELECT unnest([" + ", ".join(quoted(s) for s in ph.VOCABULARY) + "]) AS s, unnest([" + ", ".join(map(str, ph.VOCABULARY.values())) + "]) AS id)"
_CHARS = "chars AS (SELECT doc_id, unnest(string_split(text, '')) AS s FROM documents)"


@query(f"WITH {_VOCAB}, {_CHARS} SELECT s AS symbol, count(*) AS n FROM chars WHERE s <> ' ' AND s <> '' AND s NOT IN (SELECT s FROM vocab) GROUP BY s")
def oov_char_histogram(spark, sf_dir):
    """J9, A6, O4."""
    return stats.symbol_counts(table(spark, sf_dir, "documents"), ph.unknown_symbols("text")).orderBy(F.desc("n"), "symbol")


@query(f"WITH {_VOCAB}, {_CHARS} SELECT s AS symbol, count(DISTINCT doc_id) AS n_docs FROM chars WHERE s <> ' ' AND s <> '' AND s NOT IN (SELECT s FROM vocab) GROUP BY s")
def oov_doc_frequency(spark, sf_dir):
    """A8."""
    return stats.symbol_documents(table(spark, sf_dir, "documents"), "doc_id", ph.unknown_symbols("text"))


@query("SELECT item_id, trim(regexp_replace(translate(replace(replace(text || ' ʏʉ ɵɧɭ-x ˈuːɕˌɛj uːəsˈɛs', 'ˈuːɕˌɛj', 'ˈuːkɛj'), 'uːəsˈɛs', 'ˈɔs'), 'ʏʉɵɧɭ-̃', 'yɨɜʂl'), '\\s+', ' ', 'g')) AS ph FROM benchmark")
def phoneme_remap(spark, sf_dir):
    """T16."""
    b = table(spark, sf_dir, "benchmark").where("text is not null")
    return b.select("item_id", ph.remap(F.concat("text", F.lit(" ʏʉ ɵɧɭ-x ˈuːɕˌɛj uːəsˈɛs"))).alias("ph"))


@query(f"WITH {_VOCAB}, c AS (SELECT item_id, unnest(string_split(text, '')) AS s, generate_subscripts(string_split(text, ''), 1) AS i FROM benchmark) SELECT item_id, '0,' || string_agg(id, ',' ORDER BY i) || ',0' AS ids FROM c JOIN vocab USING (s) GROUP BY item_id")
def encode_lenient(spark, sf_dir):
    """T17."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(ph.encode("text").cast("array<string>"), ",").alias("ids"))


@query("SELECT doc_id, trim(s) AS sentence, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]?')) AS s FROM (SELECT doc_id, translate(text, chr(10), ' ') AS text FROM documents)) WHERE length(trim(s)) > 0 GROUP BY ALL")
def sentences(spark, sf_dir):
    """T13."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "\n", " ").alias("text"))
    return d.select("doc_id", F.explode(text.sentences("text")).alias("sentence")).groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


@query("SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-zåäöéèüáàâäëïöüA-ZÅÄÖ]+|[,.!?;:\\-]')) AS tok FROM conversations) GROUP BY tok")
def tokens(spark, sf_dir):
    """T14."""
    return stats.symbol_counts(table(spark, sf_dir, "conversations"), text.tokens("text"), "tok")


LEXICON = [("the", "ð ə"), ("and", "a n d"), ("was", "w ɒ z"), ("die", "d iː"), ("und", "ʊ n t"), ("que", "k ə"), ("la", "l a"), ("with", "w ɪ θ"), ("for", "f ɔː")]
CUSTOM = [("the", "ð iː"), ("de", "d ə"), ("La", "l ɑː")]
_LEX = "base AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(w)}, {quoted(i)})" for w, i in LEXICON) + ") AS v(word, ipa)), custom AS (SELECT lower(word) AS word, ipa FROM (VALUES " + ", ".join(f"({quoted(w)}, {quoted(i)})" for w, i in CUSTOM) + ") AS v(word, ipa)), lex AS (SELECT coalesce(c.word, b.word) AS word, replace(coalesce(c.ipa, b.ipa), ' ', '') AS ipa FROM base b FULL JOIN custom c ON b.word = c.word)"


@query(
    rf"""WITH {_LEX}, s AS (SELECT item_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]?')) AS sent, generate_subscripts(regexp_extract_all(text, '[^.!?]+[.!?]?'), 1) AS si FROM benchmark),
    t AS (SELECT item_id, si, unnest(regexp_extract_all(sent, '[a-zåäöéèüáàâäëïöüA-ZÅÄÖ]+|[,.!?;:\-]')) AS tok, generate_subscripts(regexp_extract_all(sent, '[a-zåäöéèüáàâäëïöüA-ZÅÄÖ]+|[,.!?;:\-]'), 1) AS ti FROM s),
    w AS (SELECT *, NOT regexp_full_match(tok, '[,.!?;:\-]') AS is_word FROM t),
    x AS (SELECT w.*, CASE WHEN is_word AND coalesce(lag(is_word) OVER (PARTITION BY item_id, si ORDER BY ti), false) THEN ' ' ELSE '' END || CASE WHEN is_word THEN coalesce(ipa, '') ELSE tok END AS piece FROM w LEFT JOIN lex ON is_word AND lower(tok) = lex.word),
    y AS (SELECT item_id, si, string_agg(piece, '' ORDER BY ti) AS ph FROM x GROUP BY ALL)
    SELECT b.item_id, coalesce(z.phonemes, '') AS phonemes FROM benchmark b LEFT JOIN (SELECT item_id, string_agg(ph, ' ' ORDER BY si) AS phonemes FROM y WHERE ph <> '' GROUP BY item_id) z USING (item_id)"""
)
def phonemise(spark, sf_dir):
    """J1, J11, W14, T15."""
    frames = [spark.createDataFrame([(w, i, k) for k, (w, i) in enumerate(rows)], "word string, ipa string, seq long").withColumn("ipa", F.split("ipa", " ")) for rows in (LEXICON, CUSTOM)]
    return ph.phonemise(table(spark, sf_dir, "benchmark").select("item_id", "text"), ph.lexicon_with_precedence(*frames), "item_id", "text")


_OWN = """t AS (SELECT doc_id, si, ti, tok, lower(tok) AS word, NOT regexp_full_match(tok, '[,.!?;:\\-]') AS is_word FROM (SELECT doc_id, si, unnest(regexp_extract_all(sent, '[a-zåäöéèüáàâäëïöüA-ZÅÄÖ]+|[,.!?;:\\-]')) AS tok, generate_subscripts(regexp_extract_all(sent, '[a-zåäöéèüáàâäëïöüA-ZÅÄÖ]+|[,.!?;:\\-]'), 1) AS ti
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]+[.!?]?')) AS sent, generate_subscripts(regexp_extract_all(text, '[^.!?]+[.!?]?'), 1) AS si FROM documents))),
    x AS (SELECT *, CASE WHEN is_word AND coalesce(lag(is_word) OVER (PARTITION BY doc_id, si ORDER BY ti), false) THEN ' ' ELSE '' END || CASE WHEN NOT is_word THEN tok WHEN left(md5(word), 1) = '0' THEN '' ELSE reverse(word) || 'ː' END AS piece FROM t),
    y AS (SELECT doc_id, si, string_agg(piece, '' ORDER BY ti) AS ph FROM x GROUP BY ALL)"""


@query(f"WITH {_OWN} SELECT doc_id, md5(coalesce(z.phonemes, '')) AS phonemes FROM documents LEFT JOIN (SELECT doc_id, string_agg(ph, ' ' ORDER BY si) AS phonemes FROM y WHERE ph <> '' GROUP BY doc_id) z USING (doc_id)")
def phonemise_documents(spark, sf_dir):
    """Whole documents by a lexicon made from their own words, a sixteenth of them missing."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = d.select(F.explode(F.array_distinct(F.filter(text.tokens("text"), text.is_word))).alias("word")).select(F.lower("word").alias("word")).distinct()
    lexicon = words.where(F.left(F.md5("word"), F.lit(1)) != "0").select("word", F.split(F.concat(F.reverse("word"), F.lit("ː")), "").alias("ipa"))
    return ph.phonemise(d, lexicon, "doc_id", "text").select("doc_id", F.md5("phonemes").alias("phonemes"))


@query(f"WITH {_LEX}, w AS (SELECT DISTINCT lower(tok) AS word FROM (SELECT unnest(regexp_extract_all(text, '[a-zåäöéèüáàâäëïöüA-ZÅÄÖ]+')) AS tok FROM conversations)) SELECT word, string_to_array(word, '') IS NOT NULL AS spelled, length(word) AS n FROM w WHERE word NOT IN (SELECT word FROM lex)")
def g2p_fallback(spark, sf_dir):
    """distinct words that the lexicon lacks, through a backend in batches."""
    from ..functions.backends import g2p_fallback as backend

    words = table(spark, sf_dir, "conversations").select(F.explode(F.filter(text.tokens("text"), text.is_word)).alias("tok")).select(F.lower("tok").alias("word")).distinct()
    known = [w.lower() for w, _ in LEXICON + CUSTOM]
    got = backend("letters")(words.where(~F.col("word").isin(known)))
    return got.select("word", (F.array_join("ipa", "") == F.col("word")).alias("spelled"), F.size("ipa").alias("n"))


_SMALL = """CASE WHEN {0} < 20 THEN ones[{0} + 1] ELSE tens[{0} // 10 - 1] || CASE WHEN {0} % 10 > 0 THEN ones[{0} % 10 + 1] ELSE '' END END"""
_HUND = "CASE WHEN {0} < 100 THEN " + _SMALL + " ELSE ones[{0} // 100 + 1] || 'hundra' || CASE WHEN {0} % 100 > 0 THEN " + _SMALL.replace("{0}", "({0} % 100)") + " ELSE '' END END"
_LISTS = "[" + ", ".join(map(quoted, swedish.ONES)) + "] AS ones, [" + ", ".join(map(quoted, swedish.TENS)) + "] AS tens"


@query(
    f"""WITH n AS (SELECT DISTINCT o_custkey AS n FROM orders UNION SELECT DISTINCT o_custkey * 977 FROM orders), l AS (SELECT {_LISTS})
    SELECT n, CASE WHEN n < 1000 THEN {_HUND.format('n')} ELSE CASE WHEN n // 1000 = 1 THEN 'ettusen' ELSE {_HUND.format('(n // 1000)')} || 'tusen' END || CASE WHEN n % 1000 > 0 THEN ' ' || {_HUND.format('(n % 1000)')} ELSE '' END END AS words
    FROM n, l WHERE n < 1000000"""
)
def int_words(spark, sf_dir):
    """T5, below a million; ``large_numbers`` goes on."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("n")).distinct()
    n = o.union(o.select(F.col("n") * 977)).distinct().where("n < 1000000")
    return n.select("n", swedish.int_words("n").alias("words"))


#: Inputs of the normaliser and what the rules give for them, derived by hand.
GOLDEN = [
    ("Mötet är 2026-07-06 kl. 14:30 och kostar 1 250 kr.", "Mötet är sjätte juli tjugohundratjugosex klockan fjorton och trettio och kostar ettusen tvåhundrafemtio kronor."),
    ("Pris: 2,5 kr", "Pris: två komma fem kronor"),
    ("Det är 25 % rabatt & 3.14!", "Det är tjugofem procent rabatt och tre och fjorton!"),
    ("25.50", "tjugofem komma fem noll"),
    ("2026-13-40", "tvåtusen tjugosex-tretton-fyrtio"),
    ("42", "fyrtiotvå"),
    ("21000", "tjugoetttusen"),
    ("1000000", "en miljon"),
    ("2500000", "två miljoner femhundratusen"),
    ("1999-12-31", "trettioförsta december nittonhundranittionio"),
    ("Kl 9:00, t.ex. ca 3 st.", "Kl nio, till exempel cirka tre stycken"),
    ("på14 dagar", "på14 dagar"),
    ("  ", ""),
    ("a*b_c  —d", "a b c — d"),
]


_REGION = "translate(lower(r_name), '_0123456789', ' abcdefghij')"


@query("SELECT r_regionkey, input, trim(output || ' och ' || " + _REGION + ") AS output FROM region, (VALUES " + ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in GOLDEN) + ") AS v(input, output)")
def normalise_sv(spark, sf_dir):
    """The rules on cases worked out by hand, each before every region's name."""
    names = table(spark, sf_dir, "region").select("r_regionkey", F.translate(F.lower("r_name"), "_0123456789", " abcdefghij").alias("name"))
    rows = names.withColumn("input", F.explode(F.array(*(F.lit(a) for a, _ in GOLDEN))))
    return rows.select("r_regionkey", "input", swedish.normalise(F.concat("input", F.lit(" och "), "name")).alias("output"))


@query(None)
def normalise_documents(spark, sf_dir):
    """T3 over whole documents."""
    return table(spark, sf_dir, "documents").select("doc_id", swedish.normalise("text").alias("output"))


@query(None)
def split_lines(spark, sf_dir):
    """W12, T18 over the documents' lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where("length(trim(t)) > 0")
    return lines.select("doc_id", "line", F.posexplode(folds.split_line(F.trim("t"))).alias("piece", "text"))


@query("SELECT doc_id, try_cast(list_filter(string_split_regex(trim(line), '\\s+'), lambda x: true)[2] AS DOUBLE) AS metric FROM (SELECT doc_id, source || ' ' || CASE WHEN doc_id % 3 = 0 THEN 'bad' ELSE (n_chars / 4.0)::VARCHAR END || ' ok' AS line FROM documents)")
def report_fields(spark, sf_dir):
    """T21."""
    line = F.concat("source", F.lit(" "), F.when(F.col("doc_id") % 3 == 0, "bad").otherwise((F.col("n_chars") / 4.0).cast("string")), F.lit(" ok"))
    return table(spark, sf_dir, "documents").select("doc_id", text.field_of_report(line, 2).alias("metric"))
