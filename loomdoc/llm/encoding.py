"""Problem 4: text that was decoded with the wrong character encoding.

Round-trip repair. A run of characters is encoded again under a candidate legacy encoding and strictly
decoded as the intended one; the step is repeated for nested layers and is taken when a garbling cost
drops. Runs whose bytes are no longer complete mark the text as lost.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings that text is wrongly read with, by how common the mistake is.
LEGACY = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_15")
#: Single-byte text read with another single-byte encoding.
SINGLE_BYTE = (("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"))
#: Characters outside ASCII, the Indic blocks with their joiners, and the signs of careful typing.
SUSPECT = r"[^\x00-\x7Fऀ-෿​-‍‐-―‘’“”•…₹]"

_SIGNS = set("§±°£€²³–—’‘“”…•₹©®™×÷½¼¾·«»¿¡µ¶†‡")
_TIDY = set("§±°£€²³–—’‘“”…•₹×½")


@lru_cache(maxsize=None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Character to byte; bytes that the encoding leaves undefined stand for the C1 character of that number, as lenient readers have it."""
    table = {}
    for b in range(256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table[chr(b)] = b
    return table


def _encode(text: str, encoding: str) -> bytes | None:
    table = _bytes_of(encoding)
    try:
        return bytes([table[c] for c in text])
    except KeyError:
        return None


def _char_cost(text: str, i: int) -> float:
    c = text[i]
    o = ord(c)
    if o < 128:
        return 0.0
    if 0x900 <= o < 0xE00 or o in (0x200B, 0x200C, 0x200D):
        return 0.2
    if o < 0xA0 or o == 0xFFFD or unicodedata.category(c) in ("Cc", "Cn", "Co"):
        return 4.0
    left, right = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
    if c in "“‘":
        return 0.5 if not left.isalnum() and not right.isspace() else 2.5
    if c == "”":
        return 0.5 if not left.isspace() and not right.isalnum() and "“" in text[:i] else 2.5
    if c == "’":
        return 0.5 if not left.isspace() else 2.5
    if c == "…":
        return 0.5 if not right.isalpha() else 2.5
    if c in "–—":
        return 0.5 if left.isspace() == right.isspace() else 2.5
    if c in _TIDY:
        unit = c in "²³" and left.isalpha() or c == "°" and right.isalpha()
        return 0.5 if unit or not (left.isalpha() or right.isalpha()) else 2.5
    if c.isalpha() and o < 0x250:
        beside = [x for x in (left, right) if x.isalpha()]
        if not beside:
            return 1.2 if left.isspace() and right.isspace() else 2.5
        return 1.0 if all(x.isupper() == c.isupper() or (i == 0 or not left.isalpha()) and c.isupper() for x in beside) else 2.5
    if o == 0xA0:
        return 1.0
    if 0x2500 <= o < 0x2600:
        return 3.0
    return 1.5 if c in _SIGNS else 2.5


def garbling_cost(text: str) -> float:
    return sum(_char_cost(text, i) for i, c in enumerate(text) if c > "\x7f")


_RUN = re.compile(r"[^\x00-\x7f]+")
_COMPLETE = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})")
_BROKEN = re.compile(rb"[\xe0-\xf4][\x80-\xbf]+")


@lru_cache(maxsize=100_000)
def _run_step(run: str) -> str | None:
    """One layer off a run of non-ASCII characters, or nothing if no encoding makes it cheaper."""
    best, least = None, garbling_cost(run) - 0.5
    for encoding in LEGACY:
        raw = _encode(run, encoding)
        if raw is None:
            continue
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if len(text) < len(run) and (cost := garbling_cost(text)) < least:
            best, least = text, cost
    return best


@lru_cache(maxsize=100_000)
def _run_lost(run: str) -> bool:
    """Whether a run that cannot be decoded strictly holds the greater part of multi-byte characters."""
    for encoding in ("cp1252", "latin-1", "cp437", "mac_roman", "cp850"):
        raw = _encode(run, encoding)
        if raw is None or len(raw) < 2:
            continue
        rest = _COMPLETE.sub(b"", raw)
        if rest != raw and len(rest) <= len(raw) / 2 and garbling_cost(run) > 2 or _BROKEN.fullmatch(rest):
            return True
    return False


def _single_byte(piece: str) -> str:
    """A sentence whose single-byte text was read with another single-byte encoding."""
    odd = {c for c in piece if c > "\x7f"}
    if not odd:
        return piece
    best, least = piece, garbling_cost(piece) * 0.67
    for wrong, intended in SINGLE_BYTE:
        raw = _encode(piece, wrong)
        if raw is None:
            continue
        try:
            text = raw.decode(intended)
        except UnicodeDecodeError:
            continue
        if (cost := garbling_cost(text)) < least:
            best, least = text, cost
    return best


_SPACED = re.compile("Ã (?=Â[^ ])")


def repair(text: str) -> tuple[str, bool]:
    """The text with every layer of wrong decoding taken off, and whether characters were lost for good."""
    while True:  # each layer that comes off makes the text shorter
        fixed = _RUN.sub(lambda m: _run_step(m[0]) or m[0], _SPACED.sub("Ã\xa0", text))
        if fixed == text:
            break
        text = fixed
    pieces = re.split(r"((?<=[.।])[ \t]|\n)", text)
    text = "".join(p if len(p) < 2 else _single_byte(p) for p in pieces)
    lost = "�" in text or any(_run_lost(m[0]) for m in _RUN.finditer(text))
    return text, lost


def suspect(content: Column) -> Column:
    return F.coalesce(content.rlike(SUSPECT), F.lit(False))


def repair_encoding(df: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of ``df`` whose ``content`` was decoded wrongly: key, restored text and md5, and whether characters were lost.

    Only rows with a suspect character leave the JVM. One row per key: repeated keys count once.
    Null or empty content and text without suspect characters give no row; a null key is a key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, text in zip(batch["_k"], batch["_t"]):
                restored, lost = repair(text)
                if lost or restored != text:
                    rows.append((k, None if lost else restored, "" if lost else hashlib.md5(restored.encode("utf-8", "surrogatepass")).hexdigest(), lost))
            yield pd.DataFrame(rows, columns=["_k", "restored", "restored_md5", "lost"])

    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("_k"), F.col(content).alias("_t")).where(suspect(F.col("_t")))
    return (
        found.mapInPandas(run, f"_k {kind}, restored string, restored_md5 string, lost boolean")
        .dropDuplicates(["_k"])
        .withColumnRenamed("_k", key)
    )
