"""Text: cleaning, tokens, vocabulary tests, similarity of strings, hashing into vectors."""

from __future__ import annotations

import html
import re
import string
import unicodedata
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters and digits of lower-cased text; and the second ranker's, which keeps +, # and full stops.
WORDS_A, WORDS_B = "[a-z0-9]+", "[A-Za-z0-9+#.]+"


def tokens_a(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS_A})"))


def tokens_b(text: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({WORDS_B})")), lambda x: F.lower(x))


class Form(NamedTuple):
    """How text becomes terms, for code in Arrow batches: the same terms as tokens_a and tokens_b give on the JVM."""

    #: For each byte what it becomes: itself or its lower case within a term, a space between terms.
    table: bytes
    #: Whether letters beyond ASCII are lower-cased first: two of them become ASCII letters.
    folds: bool

    def terms(self, text: str | None) -> list[bytes]:
        if not text:
            return []
        if self.folds and not text.isascii():
            text = text.lower()
        return text.encode().translate(self.table).split()


def _form(signs: str, folds: bool) -> Form:
    kept = (string.ascii_lowercase + string.digits + signs).encode()
    return Form(bytes(b + 32 if 65 <= b <= 90 else b if b in kept else 32 for b in range(256)), folds)


FORM_A, FORM_B = _form("", True), _form("+#.", False)


def clean_string(value: str | None) -> str:
    """Compatibility forms and character references first, then tags to spaces, then white space to single spaces."""
    if value is None:
        return ""
    plain = re.sub(r"<[^>]+>", " ", html.unescape(unicodedata.normalize("NFKC", value)))
    return " ".join(plain.replace("\xa0", " ").split())


@F.pandas_udf(T.StringType())
def _clean(values: pd.Series) -> pd.Series:
    return values.map(clean_string, na_action="ignore")


def clean_text(text: Column | str) -> Column:
    """clean_string. Spark has neither the compatibility forms nor the table of character references, so texts with references,
    tags or characters beyond ASCII go to Python in batches; all others stay on the JVM, and Python gets a null for them."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    plain = ~col.rlike(r"[&<]|[^\x00-\x7F]")
    return F.when(plain, F.btrim(F.regexp_replace(col, r"[\s\x0B\x1C-\x1F]+", " "))).otherwise(_clean(F.when(~plain, col)))


def clean_ascii(text: Column | str) -> Column:
    """clean_text, all on the JVM, for text without compatibility characters and with the basic references only."""
    col = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        col = F.replace(col, F.lit(entity), F.lit(plain))
    return F.btrim(F.regexp_replace(F.regexp_replace(col, "<[^>]+>", " "), r"(?U)\s+", " "))


def empty_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def split_list(text: Column | str, clean=F.btrim, separators: str = r"[,\|]") -> Column:
    """The parts between commas or bars, cleaned, without empty ones; none of null."""
    return F.coalesce(F.filter(F.transform(F.split(text, separators), lambda x: clean(x)), lambda x: x != ""), F.array().cast("array<string>"))


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any term is a substring. Null text has none."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms]), F.lit(False))


def hits(text: Column, terms: list[str]) -> Column:
    """The terms that are substrings, in order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in terms]))


def any_member(values: Column, terms: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, terms))), F.lit(False))


def flags(named: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in named.items()]))


def last_tokens(text: Column, limit: int = 2048) -> Column:
    """At most the last `limit` tokens between white space; the text itself where it has no more."""
    parts = F.split(F.btrim(text), r"\s+")
    # So few characters can't be more tokens, so most texts are not split.
    return F.when(F.char_length(text) < 2 * limit - 1, text).when(F.size(parts) > limit, F.array_join(F.slice(parts, -limit, limit), " ")).otherwise(text)


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        here = row & places.get(c, 0)
        row = ((row + here) | (row - here)) & full
    return len(a) - row.bit_count()


def edit_ratio(a: str, b: str) -> float:
    """100 times the share of characters kept by insertions and deletions only: 2 * LCS / (len a + len b)."""
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Similarity of two texts as sets of tokens: 100 where one set holds the other, 0 where one is empty."""
    left, right = set((a or "").split()), set((b or "").split())
    if not left or not right:
        return 0.0
    both, only_a, only_b = (" ".join(sorted(s)) for s in (left & right, left - right, right - left))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = " ".join(filter(None, (both, only_a))), " ".join(filter(None, (both, only_b)))
    best = edit_ratio(with_a, with_b)
    return max(best, edit_ratio(both, with_a), edit_ratio(both, with_b)) if both else best


@F.pandas_udf(T.DoubleType())
def token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def name_similarity(a: str, b: str) -> float:
    """For short names: the best of plain, token-sorted and token-set ratios, the latter two weighing 0.95."""
    by_order = edit_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(edit_ratio(a, b), 0.95 * by_order, 0.95 * token_set_ratio(a, b))


def bucket_and_sign(token: Column, dim: int) -> tuple[Column, Column]:
    """Feature hashing by SHA-256: the first four bytes choose the bucket, the parity of the fifth the sign."""
    digest = F.sha2(token, 256)
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % dim
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, F.lit(1)).otherwise(F.lit(-1))
    return bucket.cast("int"), sign


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
