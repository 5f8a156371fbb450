"""Text expressions: cleaning, supplier names, flags, codes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from outlay import reference


#: All letters that are white space to a pattern with ``(?U)``.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; a pattern would take several times as long."""
    return F.trim(c, F.lit(WHITE))


def clean(c: Column) -> Column:
    """Stripped; null where the text stands for nothing."""
    return F.when(~strip(c).isin(*reference.NULL_TOKENS), strip(c))


def clean_all(texts: Column) -> Column:
    """``clean`` for each of an array of texts: a loop, so that the program of a row stays short enough to be compiled, however many columns there are."""
    return F.transform(F.transform(texts, strip), lambda c: F.when(~c.isin(*reference.NULL_TOKENS), c))


def title_case(c: Column) -> Column:
    """Each run of letters starts with a capital and goes on in small letters."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for blank and null texts."""
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", 0).otherwise(F.size(F.split(strip(c), r"\s+")))


def _longest_first(texts) -> list[str]:
    return sorted(texts, key=lambda t: (-len(t), t))


def _java(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def normalise_name(c: Column) -> Column:
    """A supplier's name for comparison; '' for null and blank names.

    Lower case; without a leading "trading as"; legal forms cut off the end as often as one
    stands there, unless nothing would be left; abbreviations written out, longest first; only
    hyphens inside words stay of the punctuation; single spaces.
    """
    lower = F.lower(strip(F.coalesce(c, F.lit(""))))
    s = strip(F.regexp_replace(lower, r"^\s*(?:t/a|t\.a\.|trading\s+as)\s+", ""))
    forms = "|".join(_java(x) for x in _longest_first(reference.LEGAL_FORMS))
    cut = strip(F.regexp_replace(s, rf"(?U)(?:(?<!\w)(?:{forms})\s*)+$", ""))
    s = F.when(cut == "", lower).otherwise(cut)
    for short in sorted(reference.ABBREVIATIONS, key=lambda a: -len(a)):
        s = F.regexp_replace(s, rf"(?U)\b{_java(short)}\b", reference.ABBREVIATIONS[short])
    s = F.regexp_replace(s, r"(?U)[^\w\s-]", " ")
    s = F.regexp_replace(s, r"(?U)(?<!\w)-|-(?!\w)", " ")
    return strip(F.regexp_replace(s, r"(?U)\s+", " "))


def canonical_id(normalised: Column) -> Column:
    """Id of a supplier: the first 12 hex digits of the SHA-256 of its normalised name."""
    return F.substring(F.sha2(normalised.cast("binary"), 256), 1, 12)


def payment_terms_days(c: Column) -> Column:
    """The first run of digits in a payment term; null if there is none."""
    return F.regexp_extract(clean(c), r"(\d+)", 1).try_cast("int")


def gl_normalised(c: Column) -> Column:
    """A ledger code without leading zeros; '0' if it has nothing else."""
    return F.when(c.isNotNull(), F.coalesce(F.nullif(F.regexp_replace(strip(c), "^0+", ""), F.lit("")), F.lit("0")))


def _has_any(c: Column, words) -> Column:
    """Holds one of ``words``: a loop, so that the text is worked out once and the program of a row stays short enough to be compiled."""
    listed = F.array(*[F.lit(w) for w in words])
    return F.coalesce(F.exists(F.array(c), lambda text: F.exists(listed, lambda w: F.contains(text, w))), F.lit(False))


def document_type(amount: Column, invoice: Column) -> Column:
    number = F.upper(invoice)
    credit = F.coalesce(amount < 0, F.lit(False)) | F.coalesce(number.startswith("CN-") | number.startswith("CR-"), F.lit(False))
    return F.when(credit, "CREDIT_NOTE").otherwise("INVOICE")


def is_intercompany(name: Column) -> Column:
    return _has_any(F.upper(name), reference.INTERCOMPANY) | F.coalesce(F.upper(name).startswith("IC-"), F.lit(False))


def is_tax_line(description: Column, gl: Column) -> Column:
    return _has_any(F.lower(description), reference.TAX) | F.coalesce(strip(gl).startswith("2"), F.lit(False))


def is_freight_line(description: Column) -> Column:
    return _has_any(F.lower(description), reference.FREIGHT)


def weak_description_words(c: Column) -> Column:
    """Null, one of the generic words, or under five words."""
    return c.isNull() | F.lower(strip(c)).isin(*reference.WEAK_DESCRIPTIONS) | (word_count(c) < 5)


def weak_description_chars(c: Column) -> Column:
    """Null, one of the generic words, or under 20 characters."""
    return c.isNull() | F.lower(F.trim(c)).isin(*reference.WEAK_DESCRIPTIONS) | (F.length(F.trim(c)) < 20)


def contains_text(c: Column, query: str) -> Column:
    """Holds ``query``, whatever the case; false for null."""
    return F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))


def without_code_fence(c: Column) -> Column:
    """A model's answer without the code fence around its JSON."""
    return F.trim(F.regexp_replace(strip(c), r"(?s)^```(?:json)?\s*|\s*```$", ""))
