"""The analysis pipeline: tokenize, length limit, lower case, stop words, stemming, ASCII folding.

``Analyzer.tokens`` turns a text column (or an array of texts, whose positions go on from one to the next)
into array<struct<text, position, position_length, byte_start, byte_end, input_index>>. Dropped tokens
keep their position; offsets are bytes of the raw input. Analyzers of white space without byte offsets
have a form without Python, ``Analyzer.terms``; all others run every stage in one Arrow-batched UDF.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import segment
from ..functions.stopwords import LANGUAGES, stop_words
from ..functions.unicode import LOWER_OF_0130, WHITE_SPACE, fold_map, lower_map, lower_strings
from . import stem_english, stem_germanic, stem_romance, stem_russian, stem_uralic

STEMMERS = {
    "english": stem_english.stem, "german": stem_germanic.german, "swedish": stem_germanic.swedish, "norwegian": stem_germanic.norwegian,
    "danish": stem_germanic.danish, "dutch": stem_germanic.dutch, "spanish": stem_romance.spanish, "french": stem_romance.french, "italian": stem_romance.italian,
    "portuguese": stem_romance.portuguese, "romanian": stem_romance.romanian, "russian": stem_russian.russian, "finnish": stem_uralic.finnish,
    "hungarian": stem_uralic.hungarian,
}
_SPLIT = re.compile(f"([^{WHITE_SPACE}]+)")
TOKEN = T.StructType([T.StructField("text", T.StringType()), *(T.StructField(n, T.IntegerType()) for n in ("position", "position_length", "byte_start", "byte_end", "input_index"))])


#: Terms that a worker remembers; forgetting costs time, no result.
MEMO = 200_000


class _Memo(dict):
    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, key):
        out = self[key] = self.f(key)
        return out


@lru_cache(maxsize=8)
def _memo(analyzer: Analyzer) -> _Memo:
    return _Memo(analyzer._term)


@dataclass(frozen=True)
class Analyzer:
    """Options, checked when made. language: of stop words and stemming."""

    tokenizer: str = "uax29"
    case_sensitive: bool = False
    ascii_folding: bool = False
    stemming: bool = False
    remove_stopwords: bool = False
    language: str = "english"
    max_token_length: int | None = None

    def __post_init__(self):
        if self.tokenizer not in ("uax29", "whitespace"):
            raise ValueError("tokenizer is uax29 or whitespace")
        if (self.stemming or self.remove_stopwords) and self.case_sensitive:
            raise ValueError("stemming and stop words need lower case")
        if (self.stemming or self.remove_stopwords) and self.tokenizer == "whitespace":
            raise ValueError("stemming and stop words need the uax29 tokenizer")
        if self.stemming and self.language not in STEMMERS:
            raise ValueError(f"no stemmer for {self.language}")
        if self.remove_stopwords and self.language not in LANGUAGES:
            raise ValueError(f"no stop words for {self.language}")
        if self.max_token_length is not None and not 0 <= self.max_token_length <= 255:
            raise ValueError("max_token_length is 0 to 255")

    def _one(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, int]:
        """Terms of a text, their positions, their first and last character (2 rows), and how many positions it takes."""
        latin = segment.is_latin_text(text)
        # lower case moves no character of a Latin text, so that it can go first
        source = text.lower() if latin and not self.case_sensitive else text
        if self.tokenizer == "uax29" and not latin:
            spans = list(segment.words(text))
            terms, at = [text[a:b] for a, b in spans], np.array(spans, np.int64).reshape(-1, 2).T
        else:  # between and in tokens by turns
            parts = (segment.LATIN_SPLIT if self.tokenizer == "uax29" else _SPLIT).split(source)
            cuts = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
            terms, at = parts[1::2], np.stack([cuts[:-1:2], cuts[1::2]])
        n = len(terms)
        keep = np.arange(n)
        if self.max_token_length is not None and (long := at[1] - at[0] > self.max_token_length).any():
            keep = np.flatnonzero(~long)
            terms = [terms[i] for i in keep.tolist()]
        terms = self._finish(terms)
        if self.remove_stopwords:
            some = [t is not None for t in terms]
            terms, keep = list(itertools.compress(terms, some)), keep[some]
        return terms, keep, at[:, keep], n

    def _finish(self, terms: list[str]) -> list[str | None]:
        """What lower case, stop words (None), stemming and folding make of terms, each looked at once a worker."""
        if not (self.ascii_folding or self.stemming or self.remove_stopwords) and (self.case_sensitive or all(map(str.isascii, terms))):
            return terms if self.case_sensitive else list(map(str.lower, terms))
        memo = _memo(self)
        if len(memo) > MEMO:
            memo.clear()
        return list(map(memo.__getitem__, terms))

    def _term(self, term: str) -> str | None:
        lower = lower_map()
        if not self.case_sensitive:
            term = term.lower() if term.isascii() else term.translate(lower)
        if self.remove_stopwords and term in stop_words(self.language):
            return None
        if self.stemming:
            term = STEMMERS[self.language](term)
        if self.ascii_folding and not term.isascii():
            term = term.translate(fold_map())
            if not self.case_sensitive:
                term = term.translate(lower)
        return term

    def analyze(self, inputs: list[str]) -> Iterator[tuple[str, int, int, int, int, int]]:
        """Tokens of a list of texts, as TOKEN has them."""
        _, terms, *numbers = self._columns([inputs])
        positions, starts, ends, index = (x.tolist() for x in numbers)
        yield from zip(terms, positions, [1] * len(terms), starts, ends, index, strict=True)

    def _columns(self, rows: list[list[str]]) -> tuple[list[int], list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of lists of texts: how many tokens each list has, then the columns of all their tokens."""
        counts: list[int] = []
        terms: list[str] = []
        numbers = [(_NONE, _NONE, _NONE, _NONE)]
        for inputs in rows:
            first, base = len(terms), 0
            for i, text in enumerate(inputs):
                t, positions, at, n = self._one(text)
                if not text.isascii():
                    at = segment.byte_offsets(text)[at]
                numbers.append((positions + base, at[0], at[1], np.full(len(t), i)))
                terms += t
                base += n
            counts.append(len(terms) - first)
        return counts, terms, *(np.concatenate(x) for x in zip(*numbers, strict=True))

    def tokens(self, text: Column, many: bool = False) -> Column:
        """array<TOKEN> of a text column, or of an array of texts if ``many`` (null: null)."""
        columns = self._columns

        @F.arrow_udf(T.ArrayType(TOKEN))
        def run(texts: pa.Array) -> pa.Array:
            counts, terms, *numbers = columns([[] if t is None else [y or "" for y in t] if many else [t] for t in texts.to_pylist()])
            positions, starts, ends, index = (pa.array(x, pa.int32()) for x in numbers)
            ones = pa.array(np.ones(len(terms), np.int32))
            tokens = pa.StructArray.from_arrays([pa.array(terms, pa.string()), positions, ones, starts, ends, index], TOKEN.names)
            return segment.lists(counts, tokens, texts.is_null())

        return run(text)

    def terms(self, text: Column) -> Column:
        """array<string> of the terms of a text column, in order (null: null).

        Tokenizing, lower case, length and stop words of white-space tokens and of Latin texts are expressions
        in the JVM; stems and folded forms are then found once per distinct term of a batch. Only other texts,
        and no other, go to a Python worker to be split.
        """
        split = _split(text) if self.tokenizer == "whitespace" else segment.latin_words(F.when(segment.is_latin(text), text))
        if self.max_token_length is None and not self.case_sensitive:  # lower case of the text is that of its tokens
            out = _split(lower(text)) if self.tokenizer == "whitespace" else segment.latin_words(F.lower(F.when(segment.is_latin(text), text)))
        else:
            out = split if self.max_token_length is None else F.filter(split, lambda x: F.char_length(x) <= self.max_token_length)
            if not self.case_sensitive:
                out = F.transform(out, lower)
        if self.remove_stopwords:
            stops = sorted(stop_words(self.language))
            out = F.filter(out, lambda x: ~x.isin(stops))
        if self.stemming or self.ascii_folding:
            out = self._finish_udf()(out)
        if self.tokenizer == "whitespace":
            return out
        latin = segment.is_latin(text)
        return F.when(latin, out).otherwise(F.transform(self.tokens(F.when(~latin, text)), lambda t: t["text"]))

    def _finish_udf(self):
        finish = self._finish

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def run(terms: pa.Array) -> pa.Array:
            flat = terms.flatten()
            if not len(flat):
                return terms
            known = flat.dictionary_encode()
            done = pa.array(finish(known.dictionary.to_pylist()), pa.string()).take(known.indices)
            return segment.lists(terms.value_lengths().fill_null(0), done, terms.is_null())

        return run


_NONE = np.zeros(0, np.int64)


def _split(text: Column) -> Column:
    """array<string> of what stands between white space."""
    return F.array_remove(F.split(text, f"[{WHITE_SPACE}]+"), "")


def exploded(df: DataFrame, array: str, name: str) -> DataFrame:
    """df with a row for each element of an array column, in column ``name``; other columns but the array stay.

    Unlike explode(), explode_outer() makes the optimizer infer no filter on the array's size, for which a
    UDF that makes the array would run a second time.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != array]
    return df.select(*rest, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def posexploded(df: DataFrame, array: str, name: str) -> DataFrame:
    """exploded() with the place of each element in column ``position``."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != array]
    return df.select(*rest, F.posexplode_outer(array).alias("position", name)).where(F.col("position").isNotNull())


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def lower(text: Column) -> Column:
    """Lower case of each code point by itself, in the JVM, by the fixed map of all other forms."""
    return F.when(_ascii(text), F.lower(text)).otherwise(F.translate(F.replace(text, F.lit("\u0130"), F.lit(LOWER_OF_0130)), *lower_strings()))


#: Of the letters whose folding is longer, those of living orthographies: looked for first.
COMMON = "ßÆæŒœÞþ"


def ascii_fold(text: Column) -> Column:
    """ASCII folding in the JVM: one translate for single letters, a replace for each that expands.

    A text is looked over for expanding letters by deleting them: that is one pass, whatever their number.
    """
    single = {chr(c): s for c, s in fold_map().items() if len(s) == 1}
    longer = {chr(c): s for c, s in fold_map().items() if len(s) > 1}

    def wide(x: Column, letters: str) -> Column:
        out = x
        for c in letters:
            out = F.replace(out, F.lit(c), F.lit(longer[c]))
        return F.when(F.char_length(F.translate(x, letters, "")) < F.char_length(x), out).otherwise(x)

    rest = "".join(c for c in longer if c not in COMMON)
    folded = wide(wide(F.translate(text, "".join(single), "".join(single.values())), COMMON), rest)
    return F.when(_ascii(text), text).otherwise(folded)
