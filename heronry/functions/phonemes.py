"""Phoneme strings: vocabulary, repairs, remapping, encoding and lexicon lookup."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import IS_WORD, SENTENCE, TOKEN, col, is_word

#: Symbols and their sparse ids in a space of 178 (fixed values).
SLOTS = 178
VOCABULARY = {
    ";": 1, ":": 2, ",": 3, ".": 4, "!": 5, "?": 6, "—": 9, "…": 10, '"': 11, "(": 12, ")": 13, "“": 14, "”": 15, " ": 16, "̃": 17,
    "ʣ": 18, "ʥ": 19, "ʦ": 20, "ʨ": 21, "ᵝ": 22, "ꭧ": 23, "A": 24, "I": 25, "O": 31, "Q": 33, "S": 35, "T": 36, "W": 39, "Y": 41, "ᵊ": 42,
    "a": 43, "b": 44, "c": 45, "d": 46, "e": 47, "f": 48, "h": 50, "i": 51, "j": 52, "k": 53, "l": 54, "m": 55, "n": 56, "o": 57, "p": 58,
    "q": 59, "r": 60, "s": 61, "t": 62, "u": 63, "v": 64, "w": 65, "x": 66, "y": 67, "z": 68, "ɑ": 69, "ɐ": 70, "ɒ": 71, "æ": 72, "β": 75,
    "ɔ": 76, "ɕ": 77, "ç": 78, "ɖ": 80, "ð": 81, "ʤ": 82, "ə": 83, "ɚ": 85, "ɛ": 86, "ɜ": 87, "ɟ": 90, "ɡ": 92, "ɥ": 99, "ɨ": 101, "ɪ": 102,
    "ʝ": 103, "ɯ": 110, "ɰ": 111, "ŋ": 112, "ɳ": 113, "ɲ": 114, "ɴ": 115, "ø": 116, "ɸ": 118, "θ": 119, "œ": 120, "ɹ": 123, "ɾ": 125,
    "ɻ": 126, "ʁ": 128, "ɽ": 129, "ʂ": 130, "ʃ": 131, "ʈ": 132, "ʧ": 133, "ʊ": 135, "ʋ": 136, "ʌ": 138, "ɣ": 139, "ɤ": 140, "χ": 142,
    "ʎ": 143, "ʒ": 147, "ʔ": 148, "ˈ": 156, "ˌ": 157, "ː": 158, "ʰ": 162, "ʲ": 164, "↓": 169, "→": 171, "↗": 172, "↘": 173, "ᵻ": 177,
}
#: Sequences that are wrong as a whole (fixed values), and symbols outside the vocabulary with what stands in
#: for them; the hyphen and the combining tilde go.
REPAIRS = {"ˈuːɕˌɛj": "ˈuːkɛj", "uːəsˈɛs": "ˈɔs"}
REMAP_FROM, REMAP_TO = "ʏʉɵɧɭ-̃", "yɨɜʂl"


def remap(c: str | Column) -> Column:
    """Repairs, then the symbol map, then single spaces."""
    out = col(c)
    for bad, good in REPAIRS.items():
        out = F.replace(out, F.lit(bad), F.lit(good))
    return F.trim(F.regexp_replace(F.translate(out, REMAP_FROM, REMAP_TO), r"(?U)\s+", " "))


def vocabulary_map() -> Column:
    return F.map_from_arrays(F.split(F.lit("\x01".join(VOCABULARY)), "\x01"), F.split(F.lit(",".join(map(str, VOCABULARY.values()))), ",").cast("array<int>"))


def encode(c: str | Column, strict: bool = False, pad: bool = True) -> Column:
    """Ids of the symbols; unknown ones are dropped, or fail the query if ``strict``; 0 at both ends with ``pad``."""
    table = vocabulary_map()
    symbols = F.filter(F.split(col(c), ""), lambda x: F.length(x) > 0)
    ids = F.transform(symbols, lambda x: F.try_element_at(table, x))
    if strict:
        ids = F.transform(symbols, lambda x: F.coalesce(F.try_element_at(table, x), F.raise_error(F.concat(F.lit("symbol not in the vocabulary: "), x)).cast("int")))
    ids = F.filter(ids, lambda x: x.isNotNull())
    return F.concat(F.array(F.lit(0)), ids, F.array(F.lit(0))) if pad else ids


def unknown_symbols(c: str | Column) -> Column:
    """Symbols outside the vocabulary, spaces exempt, in order and with repeats."""
    # what is known goes first, in one pass over the text; only the rest is split
    return F.filter(F.split(F.translate(col(c), " " + "".join(VOCABULARY), ""), ""), lambda x: F.length(x) > 0)


def lexicon_with_precedence(*lexicons: DataFrame) -> DataFrame:
    """One pronunciation a word; later lexicons win, and within one its last line (``seq``)."""
    from functools import reduce

    ranked = [x.select(F.lower("word").alias("word"), "ipa", F.lit(k).alias("rank"), F.col("seq").cast("long").alias("seq")) for k, x in enumerate(lexicons)]
    best = reduce(DataFrame.unionByName, ranked).groupBy("word").agg(F.max_by("ipa", F.struct("rank", "seq")).alias("ipa"))
    return best


#: Bytes of a lexicon that is broadcast: by the plan's statistics (which know no filter), then as it is.
PLAN_BYTES, LEXICON_BYTES = 512 << 20, 64 << 20
_WORD = re.compile(IS_WORD)


def _collected(lexicon: DataFrame) -> dict[str, str] | None:
    """A lexicon checked to be small as one mapping, else None. One job, and none where the plan says it is large."""
    if int(str(lexicon._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > PLAN_BYTES:
        return None
    size = F.octet_length("word") + F.octet_length("ipa") + 32
    if (lexicon.agg(F.sum(size)).first()[0] or 0) > LEXICON_BYTES:
        return None
    rows = lexicon.toArrow()
    return dict(zip(rows["word"].to_pylist(), rows["ipa"].to_pylist()))


def spoken(sents: pa.Array, lexicon: dict[str, str]) -> pa.Array:
    """The phonemes of lists of sentences of tokens. Each distinct token is looked up once."""
    per_text = pc.fill_null(pc.list_value_length(sents), 0).to_numpy()
    flat = pc.list_flatten(sents)
    per_sent = pc.list_value_length(flat).to_numpy()
    tokens = pc.list_flatten(flat).dictionary_encode()
    names, at = tokens.dictionary.to_pylist(), tokens.indices.to_numpy()
    word = np.array([bool(_WORD.fullmatch(t)) for t in names], bool)
    plain = [lexicon.get(t.lower(), "") if w else t for t, w in zip(names, word)]
    ends = np.concatenate([[0], np.cumsum(per_sent)])
    follows = np.ones(len(at) + 1, bool)
    follows[ends] = False
    gap = word[at] & np.concatenate([[False], word[at[:-1]]])[: len(at)] & follows[: len(at)]
    pieces = pa.array(plain + [" " + p for p in plain], pa.string()).take(pa.array(at + gap * len(names)))
    said = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces), "")
    keep = pc.greater(pc.utf8_length(said), 0)
    kept = np.bincount(np.repeat(np.arange(len(per_text)), per_text), keep.to_numpy(zero_copy_only=False), len(per_text)).astype(np.int64)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), said.filter(keep)), " ")


def phonemise(df: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text", fallback=None) -> DataFrame:
    """(key, phonemes). Words are looked up, misses go to ``fallback`` once each, else give nothing.

    A space stands between words that follow one another, none after punctuation; sentences without a phoneme are
    left out, the others are joined by a space. ``fallback`` maps a frame of (word) to (word, ipa). A lexicon that is
    checked to be small is broadcast as a hash table, which a lookup's time does not depend on, and no text is shuffled.
    Of a larger one each text meets the words that it holds by a hash-partitioned join."""
    tokens = lambda t: F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), 0), lambda s: F.regexp_extract_all(s, F.lit(TOKEN), 0))
    rows = df.select(F.col(key), tokens(text).alias("__s"))
    words = F.filter(F.flatten("__s"), is_word)
    if fallback is not None:
        held = rows.select(F.explode(F.array_distinct(F.transform(words, F.lower))).alias("word")).distinct()
        lexicon = lexicon.select("word", "ipa").unionByName(fallback(held.join(lexicon.select("word"), "word", "left_anti")))
    lexicon = lexicon.select("word", F.array_join("ipa", "").alias("ipa"))
    table = _collected(lexicon)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, phonemes string"
    if table is not None:
        shared = df.sparkSession.sparkContext.broadcast(table)

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), spoken(b.column(1), shared.value)], [key, "phonemes"])

        return rows.mapInArrow(run, schema)
    # a word that comes twice for a key does no harm below; texts are cut into tokens after they have met their words, as
    # they are smaller whole
    used = rows.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.transform(words, F.lower))).alias("word"))
    per = used.join(lexicon, "word").groupBy("k").agg(F.collect_list("word").alias("words"), F.collect_list("ipa").alias("ipas"))
    whole = df.select(F.col(key), F.col(text).alias("__t")).join(per, F.col(key).eqNullSafe(F.col("k")), "left")
    rows = whole.select(key, tokens("__t").alias("__s"), "words", "ipas")

    def run_own(batches):
        for b in batches:
            own = (dict(zip(w or [], i or [])) for w, i in zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.concat_arrays([spoken(b.column(1).slice(k, 1), lex) for k, lex in enumerate(own)])], [key, "phonemes"])

    return rows.mapInArrow(run_own, schema)
