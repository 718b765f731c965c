"""Text expressions: whitespace, tokens, fingerprints and identities.

Native expressions stay in the JVM; the exact forms that need full Unicode normalisation take Arrow batches and
get only the texts for which the native form may differ.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's str.isspace holds for, as a Java character class.
BLANK = r"\p{IsWhite_Space}\x1c-\x1f"
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def visible_length(text: Column) -> Column:
    """Characters that aren't blank."""
    return F.length(F.regexp_replace(text, f"[{BLANK}]", ""))


def is_blank(text: Column) -> Column:
    return F.coalesce(visible_length(text) == 0, F.lit(True))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def tokens(text: Column) -> Column:
    """Case-folded words: letters and digits with inner apostrophes. Null and empty texts have none."""
    return F.regexp_extract_all(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("ß"), F.lit("ss")), F.lit(WORD), F.lit(0))


def tokenize(text: str | None) -> list[str]:
    """The exact tokens of one text: NFKC, case folding, words."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold()) if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def _exact(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else tokenize(t) for t in text], dtype=object)


# Ranges whose characters normalisation leaves as they are in any order, and whose lower case is their folded case;
# in them only blanks and punctuation change, which are in no token.
UNCHANGED = (
    r"\x00-\x7e -§©«-®°±¶·»¿-įĴ-ľŁ-ňŊ-ž"
    r"Ѐ-҂Ҋ-ӿ،-؛؞-ْ٠-ٴٹ-ەऀ-ऻऽ-ॗॠ-ॿሀ-፼"
    r" -‖‘-‧ 　-〩ぁ-ゖゝゞァ-ヾ㐀-䶿一-鿼가-힣"
    r"！（），：；？"
)


def exact_tokens(text: Column) -> Column:
    """Tokens with full normalisation; texts that normalisation leaves as they are never reach Python."""
    simple = F.coalesce(text.rlike(f"^[{UNCHANGED}]*$"), F.lit(True))
    return F.coalesce(_exact(F.when(~simple, text)), tokens(text))


def distinct_terms(words: Column) -> Column:
    return F.array_sort(F.array_distinct(words))


def fingerprint(text: Column) -> Column:
    return F.sha2(text, 256)


def identity(prefix: str, *parts: Column) -> Column:
    """``prefix`` and the hash of the parts joined by colons."""
    return F.concat(F.lit(prefix), F.sha2(F.concat_ws(":", *parts), 256))


def is_identity(col: Column, prefix: str = "") -> Column:
    return F.coalesce(col.rlike(f"^{re.escape(prefix)}[0-9a-f]{{64}}$"), F.lit(False))


def canonical_json(value: object) -> str:
    """Sorted keys, no blanks, raw UTF-8; non-finite numbers are refused."""

    def plain(x: object) -> object:
        if isinstance(x, float) and not math.isfinite(x):
            raise ValueError("non-finite number")
        if hasattr(x, "asDict"):
            x = x.asDict()
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if hasattr(x, "tolist"):
            x = x.tolist()
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


@F.pandas_udf(T.StringType())
def canonical(struct: pd.DataFrame) -> pd.Series:
    """Canonical JSON of a struct column."""
    rows = struct.to_dict("records")
    return pd.Series([canonical_json({k: None if v is pd.NA or v is pd.NaT else v for k, v in r.items()}) for r in rows], dtype=object)


def strict_json(text: str) -> object:
    """Parsed JSON; duplicate keys and non-finite numbers are refused."""

    def pairs(items: list) -> dict:
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise ValueError("duplicate key")
        return dict(items)

    def refuse(x: str) -> float:
        raise ValueError(f"non-finite number {x}")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)
