"""Coordinates from free text: decimal pairs, degrees and minutes, degrees, minutes and seconds.

A text becomes a list of tokens: numbers, hemisphere letters and commas; everything else
(degree, minute and second marks, spaces) only separates. The list is cut into two sides
and each side read as one angle.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A decimal comma is followed at once by digits and then by a mark or a letter of a hemisphere.
_TOKEN = re.compile(r"""(?P<number>[+-]?(?:\d+,\d+(?=[\s°'"′″]*[NSEWnsew]|°)|\d+\.?\d*|\.\d+))|(?P<letter>[NSEWnsew](?![A-Za-z]))|(?P<comma>,)""")
_LATITUDE, _LONGITUDE = frozenset("NS"), frozenset("EW")


def _tokens(text: str) -> list[float | str]:
    out: list[float | str] = []
    for found in _TOKEN.finditer(text):
        if found.lastgroup == "number":
            out.append(float(found.group().replace(",", ".")))
        else:
            out.append(found.group().upper())
    return out


def _sides(tokens: list[float | str]) -> tuple[list[float | str], list[float | str]]:
    """Two lists: cut at the only comma, else where one angle's letter ends it or the next one's begins it, else in the middle."""
    if "," in tokens:
        cut = tokens.index(",")
        first, second = tokens[:cut], tokens[cut + 1 :]
        if "," in second:
            raise ValueError("more than two parts")
        return first, second
    letters = [k for k, t in enumerate(tokens) if isinstance(t, str)]
    if len(letters) == 2:
        # letters stand after their numbers, or before them
        cut = letters[1] if letters[0] == 0 else letters[0] + 1
    else:
        cut = len(tokens) // 2
    return tokens[:cut], tokens[cut:]


def _angle(side: list[float | str], positive: str, negative: str) -> float:
    """Degrees of one to three numbers. A letter decides the sign; without one a single number keeps its own.

    Without a letter, degrees with minutes are positive as a latitude and keep a minus as
    a longitude, and a longitude above 180 turns negative: what the results to match have.
    """
    numbers = [t for t in side if isinstance(t, float)]
    letters = {t for t in side if isinstance(t, str)}
    if not 1 <= len(numbers) <= 3:
        raise ValueError("an angle has one to three numbers")
    size = sum(abs(n) / 60**k for k, n in enumerate(numbers))
    if negative in letters:
        return -size
    if positive in letters:
        return size
    if positive == "E":
        return -size if numbers[0] < 0 or size > 180 else size
    return numbers[0] if len(numbers) == 1 else size


def normalize(text: str) -> tuple[float, float]:
    """Latitude and longitude, unchecked; raises ValueError for what doesn't hold two angles. Words without any number read as 0, 0."""
    tokens = _tokens(text)
    if not any(isinstance(t, float) for t in tokens) and len(text.strip()) > 1:
        return 0.0, 0.0
    first, second = _sides(tokens)
    if _LATITUDE & set(second) or _LONGITUDE & set(first):
        first, second = second, first
    return _angle(first, "N", "S"), _angle(second, "E", "W")


def parse_gps(text: str | None) -> tuple[str, str] | None:
    """Latitude and longitude as texts, or None for what is no place on earth."""
    if not text or not text.strip():
        return None
    try:
        lat, lon = normalize(text)
    except ValueError:
        return None
    return (str(lat), str(lon)) if -90 <= lat <= 90 and -180 <= lon <= 180 else None


@F.pandas_udf(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))
def _parse(texts: pd.Series) -> pd.DataFrame:
    found = [parse_gps(t) for t in texts]
    return pd.DataFrame({"lat": [float(f[0]) if f else None for f in found], "lon": [float(f[1]) if f else None for f in found]}, dtype="float64")


def gps(text: Column) -> Column:
    """``lat, lon`` of each text, null where it is no place; a small grammar, so a vectorised function."""
    return _parse(text)
