"""Edit distances and agreement of two texts.

Distances of short texts are the built-in ones.  Word distances become character distances by
writing each word that both sides have as a letter of its own, and any other word as one of
two letters that never match.  The built-in distance takes the product of both lengths, so
pairs beyond ``CELLS`` go to an Arrow function that handles many pairs at once, near the diagonal and 64
cells to a word (:mod:`lectern.functions.edits`).  The agreement ratio has no equivalent in SQL and is an
Arrow function; equal and empty texts are decided before it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from lectern.functions.common import bind, column
from lectern.functions.edits import many_edits

#: Letters for words that both sides have: more than fit into CELLS.
ALPHABET = "".join(map(chr, range(0x4E00, 0x9E00)))
#: Product of two lengths up to which the built-in distance is used.
CELLS = 2_000


def bit_edits(pattern: Sequence[Hashable], text: Sequence[Hashable]) -> int:
    """Levenshtein distance of one pair; the differences between neighbours of a column are two integers' bits."""
    m = len(pattern)
    if not m or not len(text):
        return m + len(text)
    at: dict[Hashable, list[int]] = {}
    for k, symbol in enumerate(pattern):
        at.setdefault(symbol, []).append(k)
    masks = {}
    for symbol, places in at.items():
        bits = bytearray(-(-m // 8))
        for k in places:
            bits[k >> 3] |= 1 << (k & 7)
        masks[symbol] = int.from_bytes(bits, "little")
    whole, top = (1 << m) - 1, m - 1
    rises, falls, edits = whole, 0, m
    for symbol in text:
        equal = masks.get(symbol, 0)
        diagonal = (((equal & rises) + rises) ^ rises | equal | falls) & whole
        across_up = falls | (whole ^ (diagonal | rises))
        across_down = rises & diagonal
        edits += (across_up >> top) - (across_down >> top)
        across_up = (across_up << 1 | 1) & whole
        across_down = across_down << 1 & whole
        rises = across_down | (whole ^ (diagonal | across_up))
        falls = across_up & diagonal
    return edits


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _numbered(a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    """Both texts' words by number."""
    ids: dict[str, int] = {}
    one, two = ([ids.setdefault(t, len(ids)) for t in x.split(" ") if t] for x in (a, b))
    return np.array(one, np.uint32), np.array(two, np.uint32)


def _where_both(edits: Callable[[list[str], list[str]], np.ndarray], a: pd.Series, b: pd.Series) -> pd.Series:
    both = (a.notna() & b.notna()).to_numpy()
    out = pd.Series(pd.NA, index=a.index, dtype="Int32")
    if both.any():
        out[both] = edits(a[both].tolist(), b[both].tolist())
    return out


@F.pandas_udf(IntegerType())
def _long_char_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return _where_both(lambda x, y: many_edits([(_codes(p), _codes(q)) for p, q in zip(x, y, strict=True)]), a, b)


def char_edits(reference: Column | str, text: Column | str) -> Column:
    """Equal texts, the most common case, cost a comparison."""
    reference, text = column(reference), column(text)
    long = (reference != text) & (F.length(reference).cast("bigint") * F.length(text) > CELLS)
    far = _long_char_edits(F.when(long, reference), F.when(long, text))
    return F.when(reference == text, 0).when(long, far).otherwise(F.levenshtein(reference, text))


def cer(reference: Column | str, text: Column | str) -> Column:
    """Edits per character; null for an empty reference."""
    return char_edits(reference, text) / F.nullif(F.length(column(reference)), F.lit(0))


def words(text: Column | str) -> Column:
    return F.filter(F.split(column(text), " "), lambda t: t != "")


@F.pandas_udf(IntegerType())
def _long_word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return _where_both(lambda x, y: many_edits([_numbered(p, q) for p, q in zip(x, y, strict=True)]), a, b)


def word_edits(reference: Column | str, text: Column | str) -> Column:
    """Edits of words; both texts are normalised."""
    reference, text = column(reference), column(text)
    sides = F.struct(words(reference).alias("a"), words(text).alias("b"))
    long = (reference != text) & (F.size(words(reference)).cast("bigint") * F.size(words(text)) > CELLS)

    def spelled(side: Column, both: Column, other: str) -> Column:
        place = lambda t: F.array_position(both, t).cast("int")
        letter = lambda t: bind(place(t), lambda k: F.when(k > 0, F.substr(F.lit(ALPHABET), k, F.lit(1))).otherwise(F.lit(other)))
        return F.array_join(F.transform(side, letter), "")

    with_both = lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.array_distinct(F.array_intersect(s["a"], s["b"])).alias("both"))
    short = bind(sides, lambda s: bind(with_both(s), lambda t: F.levenshtein(spelled(t["a"], t["both"], "a"), spelled(t["b"], t["both"], "b"))))
    far = _long_word_edits(F.when(long, reference), F.when(long, text))
    return F.when(reference == text, 0).when(long, far).otherwise(short)


@F.pandas_udf(StructType().add("edits", IntegerType()).add("word_edits", IntegerType()))
def _both_edits(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"edits": _long_char_edits.func(a, b), "word_edits": _long_word_edits.func(a, b)})


def both_edits(reference: Column | str, text: Column | str) -> Column:
    """struct(edits, word_edits) of columns that hold their texts; null where both are equal."""
    reference, text = column(reference), column(text)
    return _both_edits(F.when(reference != text, reference), F.when(reference != text, text))


def wer(reference: Column | str, text: Column | str) -> Column:
    """Word edits per reference word; null for an empty reference."""
    return word_edits(reference, text) / F.nullif(F.size(words(reference)), F.lit(0))


def ratio(a: str, b: str) -> float:
    """Twice the characters in matching blocks over all characters.

    The longest common block is found, then those before and after it.  In a ``b`` of 200
    characters or more, those that make up over a hundredth of it don't start a block but may
    extend one, so only the places of the others are looked at.
    """
    where: dict[str, list[int]] = {}
    for j, character in enumerate(b):
        where.setdefault(character, []).append(j)
    if len(b) >= 200:
        where = {c: places for c, places in where.items() if len(places) <= len(b) // 100 + 1}
    rare = [i for i, character in enumerate(a) if character in where]
    matched, open_ = 0, [(0, len(a), 0, len(b))]
    while open_:
        a_lo, a_hi, b_lo, b_hi = open_.pop()
        i_best, j_best, size = a_lo, b_lo, 0
        runs: dict[int, int] = {}  # by the end in b: length of the common run that ends at the last place of a
        last = -2
        for k in range(bisect_left(rare, a_lo), bisect_left(rare, a_hi)):
            i = rare[k]
            before, runs = runs if i == last + 1 else {}, {}
            last, places = i, where[a[i]]
            for m in range(bisect_left(places, b_lo), len(places)):
                j = places[m]
                if j >= b_hi:
                    break
                runs[j] = length = before.get(j - 1, 0) + 1
                if length > size:
                    i_best, j_best, size = i - length + 1, j - length + 1, length
        while i_best > a_lo and j_best > b_lo and a[i_best - 1] == b[j_best - 1]:
            i_best, j_best, size = i_best - 1, j_best - 1, size + 1
        while i_best + size < a_hi and j_best + size < b_hi and a[i_best + size] == b[j_best + size]:
            size += 1
        if size:
            matched += size
            open_ += [(a_lo, i_best, b_lo, j_best), (i_best + size, a_hi, j_best + size, b_hi)]
    return 2 * matched / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def agreement(a: Column | str, b: Column | str) -> Column:
    """Matching characters over all, twice; two empty texts agree 0."""
    a, b = column(a), column(b)
    hard = (a != b) & (a != "") & (b != "")
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(_ratio(F.when(hard, a), F.when(hard, b)))
