"""Arrow-batched Unicode forms that Spark's built-ins lack."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return texts.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def fold_text(text: str) -> str:
    """Case-folded, decomposed, without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def triple_repeat(texts: pd.Series) -> pd.Series:
    """Whether a passage of 30 characters or more stands three times in a row.

    A run of equal characters at distance d must be 2 d long; candidates for d come from equal 15-character
    grams, so that long texts need no backtracking."""
    return texts.map(has_triple, na_action="ignore")


def has_triple(text: str, least: int = 30) -> bool:
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(codes)
    if n < 3 * least:
        return False
    # Starts of a triple recur at distance d: only distances between equal grams can be one.
    seen: dict[bytes, int] = {}
    tried: set[int] = set()
    width = least // 2
    for i in range(0, n - width + 1):
        gram = text[i : i + width]
        last = seen.get(gram)
        seen[gram] = i
        d = i - last if last is not None else 0
        if d >= least and d not in tried and 3 * d <= n:
            tried.add(d)
            same = codes[:-d] == codes[d:]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
            if len(edge) and int((edge[1::2] - edge[::2]).max()) >= 2 * d:
                return True
        elif 0 < d < least:
            # A short period p repeats: any multiple of it that is long enough may be the passage.
            for k in range(-(-least // d) * d, n // 3 + 1, d):
                if k in tried:
                    break
                tried.add(k)
                same = codes[:-k] == codes[k:]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
                if len(edge) and int((edge[1::2] - edge[::2]).max()) >= 2 * k:
                    return True
                break
    return False
