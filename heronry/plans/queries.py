"""All queries of the engine but those of the training-data package, and their SQL."""

from . import audio, corpus, language, records, speech, spoken

QUERIES = corpus.QUERIES | language.QUERIES | audio.QUERIES | records.QUERIES | speech.QUERIES | spoken.QUERIES
ORACLE_SQL = corpus.SQL | language.SQL | audio.SQL | records.SQL | speech.SQL | spoken.SQL
