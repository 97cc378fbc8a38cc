"""Fuzzy search for short license notices.

A notice may differ from its wording by a bounded number of edits. It is split into one piece
more than that: by the pigeonhole principle a notice within the bound holds at least one piece
unchanged. The pieces (seeds) are found by one exact pass over the text; around each the regex
library matches the whole notice with its bounded-error operator, and the places with their
edits are reported. Phrases with no edits allowed are their own seeds.

Texts are compared as words joined by one blank (A-Z in lower case; runs of ASCII letters,
digits and anything beyond ASCII). Null and empty texts have no words and no places; repeated
rows are searched each. Other columns are kept.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlens.llm.common import small_batches, text_slices
from meterlens.llm.words import plain_words


class Notice(NamedTuple):
    label: str
    wording: str
    edits: int = 0
    base: bool = False


#: Fixed phrases and labels; they stand word by word.
PHRASES = (
    Notice("gpl", "gnu general public license", base=True),
    Notice("apache", "apache license", base=True),
    Notice("cc-by", "cc by", base=True),
    Notice("mit", "mit license", base=True),
)
#: Short notices found with edits, from the public texts of the licenses.
NOTICES = (
    Notice("gpl", "licensed under the gnu general public license", 4),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl", "gnu affero general public license", 3),
    Notice("apache", "licensed under the apache license version 2 0", 4),
    Notice("mit", "released under the mit license", 3),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    Notice("cc-by", "licensed under a creative commons attribution", 4),
    Notice("cc-by-nc", "licensed under cc by nc", 1),
    Notice("cc-by-sa", "licensed under cc by sa", 1),
    Notice("bsd", "redistribution and use in source and binary forms", 5),
    Notice("mpl", "mozilla public license", 2),
    Notice("isc", "permission to use copy modify and or distribute this software", 5),
    Notice("proprietary", "all rights reserved", 2),
)

PLACES_TYPE = (
    "n_words int, places array<struct<label:string,base:boolean,word:int,end_word:int,edits:int,"
    "score:double>>"
)


class NoticeFinder:
    """Seeds and patterns of a list of notices."""

    def __init__(self, notices: tuple[Notice, ...]):
        self.notices = notices
        self.seeds = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, notice in enumerate(notices):
            for start, piece in self.split(notice):
                pieces.setdefault(piece, []).append((n, start))
        for piece, uses in pieces.items():
            self.seeds.add_word(piece, (len(piece), uses))
        self.seeds.make_automaton()
        # (?e): each match is narrowed so that no edit is spent on what stands beside it.
        self.patterns = [
            regex.compile(f"(?e)(?:{regex.escape(x.wording, literal_spaces=True)}){{e<={x.edits}}}")
            for x in notices
        ]
        # (?b): the fewest edits that make all of a place the wording.
        self.whole = [
            regex.compile(f"(?b)(?:{regex.escape(x.wording, literal_spaces=True)}){{e<={x.edits}}}")
            for x in notices
        ]

    @staticmethod
    def split(notice: Notice) -> list[tuple[int, str]]:
        """One piece more than edits, with where it starts in the wording."""
        count, size = notice.edits + 1, len(notice.wording)
        bounds = [n * size // count for n in range(count + 1)]
        return [(a, notice.wording[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """For each notice the stretches of the text that may hold it, joined where they
        overlap."""
        found: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.seeds.iter(text):
            for n, start in uses:
                notice = self.notices[n]
                begin = max(0, last + 1 - size - start - notice.edits)
                end = begin + len(notice.wording) + 2 * notice.edits + 1
                spans = found.setdefault(n, [])
                spans.append((begin, min(end, len(text))))
        for n, spans in found.items():
            spans.sort()
            done = [spans[0]]
            for begin, end in spans[1:]:
                if begin < done[-1][1]:
                    done[-1] = (done[-1][0], max(end, done[-1][1]))
                else:
                    done.append((begin, end))
            found[n] = done
        return found

    def find(self, text: str) -> list[tuple[Notice, int, int, int]]:
        """(notice, start, end, edits) in a text of words with one blank between them; a place
        begins and ends with whole words, and its edits are those of all its letters."""
        out = []
        for n, spans in self.windows(text).items():
            notice, seen = self.notices[n], set()
            for begin, end in spans:
                search = self._fuzzy if notice.edits else self._exact
                for *place, edits in search(n, text, begin, end):
                    if tuple(place) not in seen:
                        seen.add(tuple(place))
                        out.append((notice, *place, edits))
        return out

    def _exact(self, n: int, text: str, begin: int, end: int):
        """All places of a phrase that stand for themselves, also those that overlap."""
        wording = self.notices[n].wording
        at = text.find(wording, begin, end)
        while at >= 0:
            stop = at + len(wording)
            if (at == 0 or text[at - 1] == " ") and (stop == len(text) or text[stop] == " "):
                yield at, stop, 0
            at = text.find(wording, at + 1, end)

    def _fuzzy(self, n: int, text: str, begin: int, end: int):
        """Places of a notice within its bound. A match is widened to whole words, and letters that
        this adds are edits too; where they are too many, the search goes on from the next word."""
        at = begin
        while match := self.patterns[n].search(text, at, end):
            start, stop = match.span()
            while start < stop and text[start] == " ":
                start += 1
            while stop > start and text[stop - 1] == " ":
                stop -= 1
            start, stop = text.rfind(" ", 0, start) + 1, text.find(" ", stop)
            stop = len(text) if stop < 0 else stop
            whole = None
            if stop - start <= len(self.notices[n].wording) + self.notices[n].edits:
                whole = self.whole[n].fullmatch(text, start, stop)
            if whole:
                yield start, stop, sum(whole.fuzzy_counts)
                at = max(match.end(), at + 1)
            else:
                at = text.find(" ", match.start() + 1, end)
                if at < 0:
                    return

    def judge(self, text: str | None) -> dict:
        words = plain_words(text)
        joined = b" ".join(words).decode()
        places, word, upto = [], 0, 0
        for notice, start, stop, edits in sorted(self.find(joined), key=lambda f: f[1]):
            word += joined.count(" ", upto, start)
            upto = start
            places.append(
                {
                    "label": notice.label,
                    "base": notice.base,
                    "word": word,
                    "end_word": word + joined.count(" ", start, stop) + 1,
                    "edits": edits,
                    "score": 1.0 - edits / len(notice.wording),
                }
            )
        places.sort(key=lambda p: (p["word"], p["end_word"], p["label"], p["base"]))
        return {"n_words": len(words), "places": places}


@lru_cache(maxsize=4)
def finder(notices: tuple[Notice, ...]) -> NoticeFinder:
    return NoticeFinder(notices)


def _places_udf(notices: tuple[Notice, ...]):
    place = pa.struct(
        {
            "label": pa.string(),
            "base": pa.bool_(),
            "word": pa.int32(),
            "end_word": pa.int32(),
            "edits": pa.int32(),
            "score": pa.float64(),
        }
    )
    kind = pa.struct({"n_words": pa.int32(), "places": pa.list_(place)})

    @F.arrow_udf(PLACES_TYPE)
    def places(texts: pa.Array) -> pa.Array:
        found = finder(notices)
        return pa.array([found.judge(t) for part in text_slices(texts) for t in part], kind)

    return places


def with_notices(
    docs: DataFrame,
    text: str = "text",
    into: str = "notices",
    notices: tuple[Notice, ...] = PHRASES + NOTICES,
) -> DataFrame:
    """Add a struct: number of words, and the places with label, first word, end word
    (exclusive), edits and a score of 1 minus edits by length."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, _places_udf(tuple(notices))(F.col(text)))


def labels(places: Column) -> Column:
    """Distinct labels, sorted, joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def base_places(notices: Column) -> Column:
    return F.filter(notices["places"], lambda p: p["base"])
