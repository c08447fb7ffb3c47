"""Pluggable model backends (F1-F3): grapheme-to-phoneme for words that a lexicon lacks, and clip scorers."""

from __future__ import annotations

import importlib
import os
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_G2P: dict[str, Callable[[], Callable[[list[str]], list[list[str]]]]] = {}


def register_g2p(name: str, loader: Callable[[], Callable[[list[str]], list[list[str]]]]) -> None:
    """A loader returns a function from words to IPA token lists; it runs once a task."""
    _G2P[name] = loader


def spelled_out(words: list[str]) -> list[list[str]]:
    """The built-in stand-in: letters as symbols."""
    return [list(w) for w in words]


register_g2p("letters", lambda: spelled_out)


def resolve_g2p(backend: str = "auto", module: str | None = None) -> str:
    """a registered name; "auto" takes the module named by HERONRY_G2P_MODULE if it loads, else warns and takes the
    built-in; "neural" fails where that module can't be loaded."""
    if backend in _G2P:
        return backend
    module = module or os.environ.get("HERONRY_G2P_MODULE")
    try:
        if not module:
            raise ImportError("no neural module is named")
        found = importlib.import_module(module)
        call = found.phonemize if hasattr(found, "phonemize") else found.G2P()
        register_g2p(module, lambda: lambda words: [list(call(w)) for w in words])
        return module
    except ImportError as e:
        if backend == "neural":
            raise
        warnings.warn(f"G2P falls back to letters: {e}", stacklevel=2)
        return "letters"


def g2p_fallback(backend: str = "letters") -> Callable[[DataFrame], DataFrame]:
    """(word) to (word, ipa) for distinct words, in batches, the model loaded once a task."""
    loader = _G2P[backend]

    def fallback(words: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = None
            for b in batches:
                model = model or loader()
                yield pd.DataFrame({"word": b.word, "ipa": model(b.word.tolist())})

        return words.mapInPandas(run, "word string, ipa array<string>")

    return fallback


def score_clips(df: DataFrame, loader: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """a clip scorer over whole batches; ``loader`` makes the model once a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for b in batches:
            model = model or loader()
            yield model(b)

    return df.mapInPandas(run, schema)


#: What a language tag routes to (fixed values); an unknown tag fails.
LANGUAGES = {"sv": "sv", "en": "a", "en-us": "a", "en-gb": "b", "es": "e", "fr": "f", "hi": "h", "it": "i", "pt": "p", "zh": "z", "ja": "j"}


def route(lang: str) -> str:
    if lang not in LANGUAGES:
        raise KeyError(f"no voice pipeline for {lang!r}; known: {', '.join(LANGUAGES)}")
    return LANGUAGES[lang]
