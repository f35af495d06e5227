"""Text and path functions: Column in, Column out.

All of them stay in generated code, except the composition of accents, which Spark
lacks: it is an Arrow function that gets the texts with non-ASCII characters, and nulls for the others.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.functions.common import column

# The white space that the data model knows, beyond Java's \s.
WHITE_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
TELUGU = r"\x{0c00}-\x{0c7f}"
JOINERS = r"\x{200c}\x{200d}"
MARKERS = ("processed_sample_set", "sample_set")
OCR_MISSING = "[OCR_MISSING]"
COMPLETED = ("ok", "empty_output")


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t) if t is not None else None)


def nfc(text: Column | str) -> Column:
    """Composed accents; of an ASCII text only a null crosses to Python."""
    text = column(text)
    return F.coalesce(_compose(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def collapse(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(column(text), F.lit("")), WHITE_SPACE, " "))


def normalize(text: Column | str) -> Column:
    """Composed, white space collapsed and trimmed; null is empty."""
    return nfc(collapse(text))


def normalized_label(text: Column | str) -> Column:
    """Composed and trimmed; inner white space stays."""
    edges = f"^{WHITE_SPACE}|{WHITE_SPACE}$"
    return nfc(F.regexp_replace(F.coalesce(column(text), F.lit("")), edges, ""))


def ascii_fold(text: Column | str) -> Column:
    """Every character beyond printable ASCII as a question mark."""
    return F.regexp_replace(column(text), r"[^\x20-\x7e]", "?")


def clean_script(text: Column | str, letters: str = TELUGU) -> Column:
    """Only one script's letters, joiners, spaces, and hyphens between two letters; ``text`` is normalised."""
    letter = f"[{letters}]"
    return collapse(F.regexp_replace(column(text), f"(?<!{letter})-|-(?!{letter})|[^{letters}{JOINERS} -]", " "))


def script_count(text: Column | str, letters: str = TELUGU) -> Column:
    return F.regexp_count(column(text), F.lit(f"[{letters}]"))


def script_flags(text: Column | str, letters: str = TELUGU, least: int = 2, script: str = "telugu") -> Column:
    """struct(text, suspicious_output, suspicious_reason, character_count) of a normalised text."""
    clean = clean_script(text, letters)
    count = script_count(clean, letters)
    reason = F.when(count == 0, f"no_{script}_text").when(count < least, f"fewer_than_{least}_{script}_characters").otherwise("")
    return F.struct(clean.alias("text"), (reason != "").alias("suspicious_output"), reason.alias("suspicious_reason"), count.alias("character_count"))


def output_status(text: Column | str) -> Column:
    return F.when(column(text) == "", "empty_output").otherwise("ok")


def completed(status: Column | str) -> Column:
    """False, not null, for a null status."""
    return F.coalesce(column(status).isin(*COMPLETED), F.lit(False))


def natural_key(text: Column | str, fold: bool = True) -> Column:
    """A sortable array that alternates text and number parts, the first being text."""
    text = column(text)
    parts = F.regexp_extract_all(F.lower(text) if fold else text, F.lit(r"(\d+|\D+)"), 1)
    first = F.when(text.rlike(r"^\d"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    # a number of any length sorts as its digits behind how many they are
    digits = lambda t: F.regexp_replace(t, "^0+(?=.)", "")
    number = lambda t: F.when(t.rlike(r"^\d+$"), F.concat(F.lpad(F.length(digits(t)).cast("string"), 10, "0"), digits(t))).otherwise("")
    return F.transform(F.concat(first, parts), lambda t: F.struct(F.when(t.rlike(r"^\d+$"), "").otherwise(t).alias("s"), number(t).alias("n")))


def path_parts(path: Column | str) -> Column:
    return F.split(F.regexp_replace(F.coalesce(column(path), F.lit("")), r"\.[^./]+$", ""), "/")


def _as_key(parts: Column) -> Column:
    names = ("split", "writer_id", "page_id", "image")
    return F.struct(*[F.element_at(parts, k + 1).alias(n) for k, n in enumerate(names)])


def _after_marker(parts: Column) -> list[tuple[Column, Column]]:
    """(condition, tail) of the markers, where exactly four parts follow."""
    out = []
    for marker in MARKERS:
        at = F.array_position(parts, marker).cast("int")
        out.append(((at > 0) & (F.size(parts) - at == 4), F.slice(parts, at + 1, F.lit(4))))
    return out


def image_key_lenient(path: Column | str) -> Column:
    """The four parts after a marker folder, else the last four of at least four."""
    parts = path_parts(path)
    (one, tail_one), (two, tail_two) = _after_marker(parts)
    return F.when(one, _as_key(tail_one)).when(two, _as_key(tail_two)).when(F.size(parts) >= 4, _as_key(F.slice(parts, -4, 4)))


def image_key_strict(path: Column | str) -> Column:
    """A path of exactly four parts, or the four after a marker folder, else null."""
    parts = path_parts(path)
    (one, tail_one), (two, tail_two) = _after_marker(parts)
    return F.when(F.size(parts) == 4, _as_key(parts)).when(one, _as_key(tail_one)).when(two, _as_key(tail_two))


def record_image_key(relative: Column | str, absolute: Column | str, strict: bool = False) -> Column:
    key = image_key_strict if strict else image_key_lenient
    return F.coalesce(key(relative), key(absolute))


def page_key(split: Column | str = "split", writer: Column | str = "writer_id", page: Column | str = "page_id") -> Column:
    return F.concat_ws("_", column(split), column(writer), column(page))


def page_key_of(key: Column | str) -> Column:
    key = column(key)
    return F.concat_ws("_", key["split"], key["writer_id"], key["page_id"])


def image_order(image: Column | str) -> Column:
    """The number before the first underscore; others sort last."""
    return F.coalesce(F.split_part(column(image), F.lit("_"), F.lit(1)).try_cast("int"), F.lit(2**31 - 1))


def split_order(split: Column | str) -> Column:
    split = column(split)
    return F.when(split == "train", 0).when(split == "val", 1).when(split == "test", 2).otherwise(3)


def safe_name(name: Column | str) -> Column:
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(column(name), r"[^A-Za-z0-9_.-]+", "_"), F.lit("_")), F.lit("")), F.lit("model"))


def config_fields(path: Column | str) -> Column:
    """struct(configuration, model, input_kind, run) of a results path relative to its root."""
    folders = F.slice(F.split(column(path), "/"), F.lit(1), F.size(F.split(column(path), "/")) - 1)
    kind = F.coalesce(F.get(folders, F.lit(1)), F.lit("unknown"))
    return F.struct(
        F.array_join(folders, "/").alias("configuration"),
        F.coalesce(F.get(folders, F.lit(0)), F.lit("unknown")).alias("model"),
        kind.alias("input_kind"),
        F.coalesce(F.get(folders, F.lit(2)), kind).alias("run"),
    )


def numbered(regions: Column | str) -> Column:
    """Regions as lines ``1. text``."""
    return F.array_join(F.transform(column(regions), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def reasons(*parts: tuple[Column, Column | str]) -> Column:
    """The texts whose conditions hold, each once, in order, joined by semicolons."""
    found = F.array(*[F.when(condition, text if isinstance(text, Column) else F.lit(text)) for condition, text in parts])
    return F.array_join(F.array_distinct(F.array_compact(found)), ";")


def format_number(value: Column | str) -> Column:
    value = column(value)
    return F.when(value.isNotNull(), F.format_string("%.2f", value.cast("double"))).otherwise("N/A")


def output_path(relative: Column | str, folder: str, suffix: str) -> Column:
    """``folder``/relative path with another suffix."""
    return F.concat(F.lit(f"{folder}/"), F.regexp_replace(column(relative), r"\.[^./]+$", ""), F.lit(suffix))
