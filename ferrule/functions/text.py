"""Text normal forms, identifiers and digests as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ferrule.functions.answers import squeezed


@F.pandas_udf(StringType())
def _composed_folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


@F.pandas_udf(StringType())
def _compatible_folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def _plain(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$")


def folded(text: Column, compatible: bool = False) -> Column:
    """NFC (or NFKC) and case folding; ASCII texts stay with built-in functions, others go through Arrow."""
    other = (_compatible_folded if compatible else _composed_folded)(F.when(~_plain(text), text))
    return F.when(_plain(text), F.lower(text)).otherwise(other)


def surface(text: Column) -> Column:
    """An answer's surface: straight quotes, folded, single spaces, without one full stop at the end."""
    straight = F.translate(text, "’‘“”", "''\"\"")
    s = squeezed(folded(straight))
    return F.when(s.endswith("."), F.rtrim(F.left(s, F.length(s) - 1))).otherwise(s)


def letters_only(text: Column) -> Column:
    """Letters and digits, NFKC and folded, after marks like [12] go."""
    return F.regexp_replace(folded(F.regexp_replace(text, r"\[\d+\]", ""), compatible=True), r"[^\p{L}\p{N}]", "")


def words_only(text: Column) -> Column:
    """Runs of word characters of any script, lowered, with single spaces between."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"((?U)\w+)"), 1), " ")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_title(url: Column) -> Column:
    """The path, percent signs decoded (a plus stays), underscores as spaces, lowered."""
    path = F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    return F.lower(F.translate(decoded, "_", " "))


def page_of(identifier: Column) -> Column:
    """(document, page) of "document_page12"; null where it isn't of that form."""
    form = r"^(.*)_page(\d+)$"
    return F.when(identifier.rlike(form), F.struct(F.regexp_extract(identifier, form, 1).alias("document"), F.regexp_extract(identifier, form, 2).cast("int").alias("page")))


def flattened_markup(text: Column) -> Column:
    """Tags as spaces, the five named references decoded, single spaces."""
    bare = F.regexp_replace(text, "<[^>]+>", " ")
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        bare = F.replace(bare, F.lit(f"&{name};"), F.lit(sign))
    return squeezed(bare)


def redacted(text: Column, key: str | None = None) -> Column:
    """Keys of the form sk-... and a given secret as [redacted]."""
    out = F.regexp_replace(text, r"sk-[A-Za-z0-9_-]{8,}", "[redacted]")
    return F.replace(out, F.lit(key), F.lit("[redacted]")) if key else out


def list_digest(ids: Column) -> Column:
    """SHA-256 of ids joined by line feeds, in the order of the array."""
    return F.sha2(F.array_join(ids, "\n"), 256)


def record_digest(*fields: Column) -> Column:
    """SHA-256 of a canonical JSON object: the fields in the order given, which is that of their names, without spaces."""
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def seed(*parts: Column, digits: int = 15) -> Column:
    """A whole number from the first hex digits of the SHA-256 of parts joined by bars."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) by hash, of 52 bits."""
    return seed(*parts, digits=13) / F.lit(float(1 << 52))
