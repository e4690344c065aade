"""Many keywords in one scan of a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many keywords are told by one test each; more by an automaton, whose keywords may have so many letters in all.
FEW, LETTERS_SENT = 16, 32 << 20


@lru_cache(maxsize=8)
def automaton(words: tuple[str, ...]) -> ahocorasick.Automaton:
    """Built once a worker. Each word's value is its first place in the list; the empty word is left out."""
    made = ahocorasick.Automaton()
    for place, word in reversed(list(enumerate(words))):
        if word:
            made.add_word(word, place)
    made.make_automaton()
    return made


def places_in(text: str, made: ahocorasick.Automaton, always: set[int]) -> set[int]:
    """The places of the words that a text contains, in one scan, and those of what every text contains."""
    return {place for _, place in made.iter(text)} | always if len(made) else always


def scanned(text: Column, words: list[str], give: Callable[[set[int]], object], kind: str) -> Column:
    """give(places of the words in the text) for each text; null for null texts. The words go to all tasks."""
    letters = sum(map(len, words))
    if letters > LETTERS_SENT:
        raise ValueError(f"{letters} letters of keywords are more than one automaton is sent with ({LETTERS_SENT}); join the texts' parts with a table of them")
    sent = tuple(words)

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        made, always = automaton(sent), {sent.index("")} if "" in sent else set()
        for texts in batches:
            yield pd.Series([None if t is None else give(places_in(t, made, always)) for t in texts], dtype=object)

    return run(text)
