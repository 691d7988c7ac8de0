"""License scans: exact phrases and fuzzy short notices over whole texts.

The text is reduced to its words joined by single spaces, and all positions are counted in words.  A notice of n
characters may be off by k edits.  It is cut into k + 1 seeds; k edits can't touch all of them, so each true match holds
a seed unchanged (pigeonhole).  One automaton finds all seeds of all notices in one pass; around each seed the regex
library verifies the notice with at most k errors and gives its span.  Without a seed no verification runs.
"""

from __future__ import annotations

import bisect
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.llm.arrowtext import map_texts, utf8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases that count wherever their words stand consecutively, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices of public licences in words, the label of each, and the most edits allowed.
NOTICES = {
    "licensed under the apache license": ("apache", 3),
    "apache license version 2 0": ("apache", 2),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 6),
    "under the terms of the mit license": ("mit", 3),
    "licensed under the mit license": ("mit", 2),
    "released under the mit license": ("mit", 2),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 6),
    "redistribution and use in source and binary forms": ("bsd", 4),
    "licensed under the bsd license": ("bsd", 2),
    "bsd 2 clause license": ("bsd", 1),
    "bsd 3 clause license": ("bsd", 1),
    "subject to the terms of the mozilla public license": ("mpl", 4),
    "mozilla public license version 2 0": ("mpl", 3),
    "licensed under the gnu general public license": ("gpl", 4),
    "terms of the gnu general public license": ("gpl", 3),
    "gnu lesser general public license": ("lgpl", 3),
    "gnu affero general public license": ("agpl", 3),
    "gnu free documentation license": ("gfdl", 3),
    "eclipse public license": ("epl", 2),
    "common development and distribution license": ("cddl", 4),
    "boost software license": ("boost", 2),
    "artistic license 2 0": ("artistic", 1),
    "academic free license": ("afl", 2),
    "microsoft public license": ("ms-pl", 2),
    "european union public licence": ("eupl", 3),
    "python software foundation license": ("psf", 3),
    "sil open font license": ("ofl", 2),
    "server side public license": ("sspl", 2),
    "business source license": ("busl", 2),
    "university of illinois ncsa open source license": ("ncsa", 4),
    "open database license": ("odbl", 2),
    "do what the fuck you want to public license": ("wtfpl", 4),
    "this is free and unencumbered software released into the public domain": ("unlicense", 6),
    "dedicated to the public domain": ("public-domain", 3),
    "licensed under cc by": ("cc-by", 2),
    "licensed under a creative commons attribution": ("cc-by", 4),
    "creative commons attribution share alike": ("cc-by-sa", 4),
    "creative commons attribution noncommercial": ("cc-by-nc", 4),
    "creative commons attribution noderivatives": ("cc-by-nd", 4),
    "creative commons zero": ("cc0", 2),
    "cc0 1 0 universal": ("cc0", 1),
    "all rights reserved": ("reserved", 2),
}
#: Areas whose verdict a text keeps, so that what repeats is verified once.
KEPT = 4096
MATCHES = "array<struct<label:string,first_word:bigint,last_word:bigint,edits:int,exact:boolean,score:double>>"


class NoticeScanner:
    """Finds exact phrases and notices within a bounded number of edits."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, tuple[str, int]]):
        import ahocorasick
        import regex

        self.phrases = {f" {phrase} ": label for phrase, label in phrases.items()}
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, (label, edits)) in enumerate(notices.items()):
            pattern = regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={edits}}}")
            self.notices.append((notice, label, edits, pattern))
            cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(notice[begin:end], []).append((number, begin))
        self.seeds = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def exact(self, text: str) -> list[tuple[int, str, int]]:
        """(character position, label, words) of each phrase in text, which begins and ends with a space."""
        found = []
        for phrase, label in self.phrases.items():
            at = text.find(phrase)
            while at >= 0:
                found.append((at, label, phrase.count(" ") - 1))
                at = text.find(phrase, at + 1)
        return found

    def fuzzy(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(begin, end, label, edits, length of the notice) of each verified notice.

        The area of a seed holds all matches with this seed in its place, and no two that don't overlap.  Of matches of one
        notice that overlap, the one of fewest edits stays, then the first.
        """
        found: dict[int, set[tuple[int, int, int]]] = {}
        kept: dict[tuple[int, str], tuple[int, int, int] | None] = {}
        for last, (length, places) in self.seeds.iter(text):
            for number, offset in places:
                notice, _, edits, pattern = self.notices[number]
                begin = max(0, last + 1 - length - offset - edits)
                area = text[begin : last + 1 - length - offset + len(notice) + edits]
                if (number, area) not in kept:
                    if len(kept) >= KEPT:
                        kept.clear()
                    match = pattern.search(area)
                    kept[number, area] = match and (sum(match.fuzzy_counts), match.start(), match.end())
                if own := kept[number, area]:
                    found.setdefault(number, set()).add((own[0], begin + own[1], begin + own[2]))
        out = []
        for number, spans in found.items():
            notice, label, _, _ = self.notices[number]
            taken: list[tuple[int, int]] = []
            for edits, begin, end in sorted(spans):
                at = bisect.bisect(taken, (begin, end))
                if (at and taken[at - 1][1] > begin) or (at < len(taken) and taken[at][0] < end):
                    continue
                taken.insert(at, (begin, end))
                out.append((begin, end, label, edits, len(notice)))
        return sorted(out)

    def scan(self, text: str) -> tuple[int, list[dict]]:
        """The number of words of a lower-cased text, and all matches."""
        words = WORD.findall(text)
        plain = f" {' '.join(words)} "
        exact, fuzzy, matches = self.exact(plain), self.fuzzy(plain), []
        blanks = list(accumulate((len(word) + 1 for word in words), initial=0)) if exact or fuzzy else []
        for at, label, size in exact:
            first = bisect.bisect_left(blanks, at)
            matches.append({"label": label, "first_word": first, "last_word": first + size - 1, "edits": 0, "exact": True, "score": 1.0})
        for begin, end, label, edits, length in fuzzy:
            inner = plain[begin:end]
            begin, end = begin + len(inner) - len(inner.lstrip()), end - len(inner) + len(inner.rstrip())
            first = bisect.bisect_right(blanks, begin) - 1
            last = bisect.bisect_left(blanks, end) - 1
            matches.append({"label": label, "first_word": first, "last_word": max(first, last), "edits": edits, "exact": False, "score": 1.0 - edits / length})
        return len(words), matches


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict | None = None, notices: dict | None = None
) -> DataFrame:
    """One row for each row of docs: id_col, n_words, matches (label, first_word, last_word, edits, exact, score).

    exact marks the phrases, each place a match of its own; the others are verified notices.  No row moves between tasks.
    A null text has no words and no matches.  Repeated rows and null ids give a row each; an empty table gives none.
    Other columns of docs are not read, so their names can't clash.
    """
    phrases = PHRASES if phrases is None else phrases
    notices = NOTICES if notices is None else notices

    def make():
        scanner = NoticeScanner(phrases, notices)

        def work(texts):
            raw, ends = utf8(texts)
            lowered = raw.tobytes().lower()  # of bytes: A-Z alone
            found = [scanner.scan(lowered[a:b].decode("utf-8", "replace")) for a, b in zip(ends, ends[1:], strict=False)]
            kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("exact", pa.bool_()), ("score", pa.float64())]))
            return [pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], kind)]

        return work

    return map_texts(docs, id_col, text_col, f"n_words bigint, matches {MATCHES}", make)


def summarise(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document: counts and places of the exact phrases, labels of either kind, and the best score."""
    exact = F.filter("matches", lambda m: m["exact"])

    def labels(matches: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")

    return scanned.select(
        id_col,
        "n_words",
        F.size(exact).cast("bigint").alias("n_base"),
        F.array_min(F.transform(exact, lambda m: m["first_word"])).alias("first_word"),
        F.array_max(F.transform(exact, lambda m: m["first_word"])).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
    )
