"""Similarity of two values, 0 to 100: numbers and dates as native expressions, text and identifiers as a pandas UDF.

Text: 0.30 ratio + 0.20 partial + 0.25 token sort + 0.25 token set. Identifiers: 0.4 ratio + 0.3 partial + 0.3 token
sort. ratio is 200 * LCS / (len a + len b), with the longest common subsequence found on whole-text bit masks. partial is
the best ratio of the shorter text against windows of its length in the longer one, those cut off at its ends included.
token sort compares the words in order of the alphabet; token set compares shared words with shared words plus the rest
of either side. Case matters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import batchsim
from .canon import date_of, number_of, text_of

KINDS = ("text", "numeric", "date", "identifier")

# Words in a column's name that tell its kind, looked for in this order.
DATE_WORDS = ("date", "time", "created", "updated", "timestamp", "day", "month", "year")
NUMERIC_WORDS = ("amount", "value", "price", "cost", "total", "sum", "balance", "quantity", "qty")
ID_WORDS = ("id", "ref", "reference", "number", "account", "code", "key")


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence; one step of big-integer arithmetic for each character of b."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def ratio(a: str, b: str) -> float:
    return 200 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if not a and not b else 0.0
    if len(a) == len(b):
        return max(_best_window(a, b), _best_window(b, a))
    return _best_window(a, b) if len(a) < len(b) else _best_window(b, a)


def _best_window(short: str, long: str) -> float:
    """The best ratio of `short` with a window of its length. Windows slide with a count of the characters that both have,
    whatever their order; only those that this bound lets beat the best so far are compared."""
    n, best = len(short), 0.0
    if short in long:
        return 100.0
    lacking, common = Counter(short), 0
    for at in range(1 - n, len(long)):
        if at + n <= len(long):
            c = long[at + n - 1]
            common += lacking[c] > 0
            lacking[c] -= 1
        if at > 0:
            c = long[at - 1]
            lacking[c] += 1
            common -= lacking[c] > 0
        size = min(at + n, len(long)) - max(0, at)
        if 200 * common > best * (n + size):
            best = max(best, ratio(short, long[max(0, at) : at + n]))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    common, with_a, with_b = " ".join(both), " ".join(both + left), " ".join(both + right)
    best = ratio(with_a, with_b)
    return max(best, ratio(common, with_a), ratio(common, with_b)) if both else best


def text_similarity(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return min(100.0, 0.3 * ratio(a, b) + 0.2 * partial_ratio(a, b) + 0.25 * token_sort_ratio(a, b) + 0.25 * token_set_ratio(a, b))


def identifier_similarity(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    return min(100.0, 0.4 * ratio(a, b) + 0.3 * partial_ratio(a, b) + 0.3 * token_sort_ratio(a, b))


def _udf(kind: str):
    def scores(a: pd.Series, b: pd.Series) -> pd.Series:
        both = a.notna() & b.notna()
        out = pd.Series(float("nan"), index=a.index)
        out[both] = batchsim.scores(a[both].tolist(), b[both].tolist(), kind)
        return out.astype(object).where(both, None).astype("Float64")

    return F.pandas_udf(scores, T.DoubleType())


text_score, identifier_score = _udf("text"), _udf("identifier")


def numeric_score(a: Column, b: Column) -> Column:
    """100 less the difference in per cent of b, at least 0; against 0 only 0 counts."""
    near = F.greatest(F.lit(0.0), F.lit(100.0) - F.abs(a - b) / F.when(b != 0, F.abs(b)) * 100)
    return F.when(a == b, F.lit(100.0)).when(b == 0, F.lit(0.0)).otherwise(near)


def date_score(a: Column, b: Column) -> Column:
    """By the gap in days between two dates (text yyyy-MM-dd): 100, 95 for a day, to 65 in a week, to about 0 in 30 days."""
    d = F.abs(F.datediff(F.to_date(a), F.to_date(b)))
    month = F.greatest(F.lit(0.0), F.lit(65.0) - (d - 7) * F.lit(2.8))
    return F.when(d == 0, 100.0).when(d == 1, 95.0).when(d <= 7, F.lit(95.0) - (d - 1) * F.lit(5.0)).when(d <= 30, month).otherwise(0.0)


def forms(df: DataFrame, name: str, kind: str) -> list[Column]:
    """What a comparison of the kind needs of a column, taken once before rows meet: text, number or date."""
    out = [text_of(df, name).alias("t")]
    if kind == "numeric":
        out.append(number_of(df, name).alias("n"))
    if kind == "date":
        out.append(date_of(df, name).alias("d"))
    return out


def score(kind: str, a: Column, b: Column, native: bool = False) -> Column:
    """The similarity of two values; a, b: structs of `forms`. Two nulls score 50, one null 0, equal trimmed texts 100.

    Values that are no number or date fall back on text, unless `native`: they score 0 then and no Python runs.
    """
    check_kind(kind)
    text_a, text_b = F.trim(a["t"]), F.trim(b["t"])

    def in_python(udf: Callable[[Column, Column], Column], decided: Column) -> Column:
        """A UDF is computed for every row before the branch is chosen, so rows that are decided give it nulls."""
        open_ = ~decided & (text_a != text_b)
        return udf(F.when(open_, text_a), F.when(open_, text_b))

    if kind in ("numeric", "date"):
        form, by_value = ("n", numeric_score) if kind == "numeric" else ("d", date_score)
        decided = a[form].isNotNull() & b[form].isNotNull()
        rest = F.when(decided, by_value(a[form], b[form])).otherwise(F.lit(0.0) if native else in_python(text_score, decided))
    else:
        rest = in_python(identifier_score if kind == "identifier" else text_score, F.lit(False))
    return F.when(a["t"].isNull() & b["t"].isNull(), 50.0).when(a["t"].isNull() | b["t"].isNull(), 0.0).when(text_a == text_b, 100.0).otherwise(rest)


def check_kind(kind: str) -> None:
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")


def column_kind(name: str, samples: Sequence = ()) -> str:
    """The kind of a column: by words in its name, else by up to 10 of its values (70 % numbers, 70 % dates), else text."""
    low = name.lower()
    for kind, known in (("date", DATE_WORDS), ("numeric", NUMERIC_WORDS), ("identifier", ID_WORDS)):
        if any(w in low for w in known):
            return kind
    values = [v for v in samples if v is not None][:10]
    if not values:
        return "text"

    def is_number(v) -> bool:
        try:
            float(v)
        except (TypeError, ValueError):
            return False
        return True

    if sum(map(is_number, values)) >= 0.7 * len(values):
        return "numeric"
    if pd.to_datetime(pd.Series([str(v) for v in values]), errors="coerce", format="mixed").notna().sum() >= 0.7 * len(values):
        return "date"
    return "text"
