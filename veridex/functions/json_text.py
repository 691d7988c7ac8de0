"""Canonical JSON of texts of any shape and depth, in Arrow batches.

Texts go through the standard library's compiled decoder and encoder.  Those nested deeper than these recurse go through one
pass over the tokens with a stack of its own, so depth is bounded by memory alone.  Names are sorted, the last of repeated
ones counts, blanks go, whole numbers are written as such, other numbers in their shortest form, and characters beyond
ASCII as escapes.  Names can be left out at any depth on the way.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections.abc import Callable, Iterable
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BLANK = re.compile(r"[ \t\n\r]*")
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
WORDS = ("null", "true", "false")
#: Characters from which on a whole number is none: Python converts few more.
LONGEST_WHOLE = 4000


def _whole(digits: str) -> int:
    if len(digits) >= LONGEST_WHOLE:
        raise ValueError("too long a number")
    return int(digits)


def _finite(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise ValueError("a number beyond doubles")
    return value


def _no_constant(word: str) -> None:
    raise ValueError(word)  # NaN and Infinity aren't JSON


@functools.lru_cache(16)
def _compiled(without: frozenset[str]) -> tuple[Callable, Callable]:
    """A decoder that leaves out fields of these names, and an encoder."""
    kept = (lambda pairs: {name: value for name, value in pairs if name not in without}) if without else None
    decoder = json.JSONDecoder(parse_int=_whole, parse_float=_finite, parse_constant=_no_constant, object_pairs_hook=kept)
    return decoder.decode, json.JSONEncoder(sort_keys=True, separators=(",", ":"), check_circular=False).encode


def canonical(text: str, without: frozenset[str] = frozenset()) -> str | None:
    """The canonical form of one JSON text without fields of these names; null for what isn't JSON, has a number beyond
    doubles, or a character that isn't one."""
    decode, encode = _compiled(without)
    try:
        return encode(decode(text))
    except RecursionError:
        return scanned(text, without)
    except ValueError:
        return None


def scanned(text: str, without: frozenset[str] = frozenset()) -> str | None:
    """canonical() by a pass over the tokens, for texts of any depth."""
    at, stack = BLANK.match(text).end(), []  # of open containers: [closing sign, rendered values or {name: value}, name]
    while True:
        done = None  # a rendered value
        sign = text[at : at + 1]
        if sign in ("{", "["):
            stack.append(["}", {}, None] if sign == "{" else ["]", [], None])
            at = BLANK.match(text, at + 1).end()
            if text[at : at + 1] != stack[-1][0]:
                if sign == "{" and (at := _name(text, at, stack[-1])) < 0:
                    return None
                continue
        elif sign == '"':
            try:
                value, at = scanstring(text, at + 1)
                done = json.dumps(value)
            except ValueError:
                return None
        elif word := next((w for w in WORDS if text.startswith(w, at)), None):
            done, at = word, at + len(word)
        elif number := NUMBER.match(text, at):
            at = number.end()
            value = float(number[0]) if number[1] or number[2] else int(number[0]) if len(number[0]) < LONGEST_WHOLE else None
            if value is None or value in (float("inf"), float("-inf")):
                return None
            done = repr(value)
        else:
            return None
        while True:  # a value is done, or the innermost container closes
            at = BLANK.match(text, at).end()
            if done is not None:
                if not stack:
                    return done if at == len(text) else None
                top = stack[-1]
                if top[0] == "]":
                    top[1].append(done)
                elif top[2] not in without:
                    top[1][top[2]] = done
                if text[at : at + 1] == ",":
                    at = BLANK.match(text, at + 1).end()
                    if top[0] == "}" and (at := _name(text, at, top)) < 0:
                        return None
                    break
            if text[at : at + 1] != stack[-1][0]:
                return None
            close, held, _ = stack.pop()
            at += 1
            if close == "]":
                done = f"[{','.join(held)}]"
            else:
                done = "{" + ",".join(f"{json.dumps(name)}:{held[name]}" for name in sorted(held)) + "}"


def _name(text: str, at: int, top: list) -> int:
    """Reads a field's name and colon into the container; where its value begins, or -1."""
    if text[at : at + 1] != '"':
        return -1
    try:
        top[2], at = scanstring(text, at + 1)
    except ValueError:
        return -1
    at = BLANK.match(text, at).end()
    return BLANK.match(text, at + 1).end() if text[at : at + 1] == ":" else -1


def canonical_json(text: Column, without: Iterable[str] = ()) -> Column:
    """canonical() of a column; equal values have equal texts, whatever the order of names, blanks and escapes."""
    names = frozenset(without)

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: canonical(x, names), na_action="ignore")

    return run(text)


def digest(text: Column, without: Iterable[str] = ()) -> Column:
    """The SHA-256 of the canonical form, in hexadecimal digits."""
    return F.sha2(canonical_json(text, without), 256)


def map_digest(names: Column, digests: Column) -> Column:
    """An aggregate: the digest of an object of names and digests, whatever the order of the rows."""
    pairs = F.array_sort(F.collect_list(F.struct(names.cast("string").alias("name"), digests.alias("digest"))))
    return F.sha2(canonical_json(F.to_json(F.map_from_entries(pairs))), 256)
