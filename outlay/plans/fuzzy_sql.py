"""The composite score of two names as SQL, for checking: common subsequences as bits that move through a list of letters."""

from __future__ import annotations


def _common(a: str, b: str) -> str:
    """Length of the longest common subsequence; ``a`` has 60 letters at most."""
    full = f"((1::BIGINT << length({a})) - 1)"
    mask = f"lambda y: coalesce(list_sum(list_transform(range(length({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = y THEN 1::BIGINT << i ELSE 0 END)), 0)::BIGINT"
    step = f"lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({full}, list_transform(string_split({b}, ''), {mask})), {step})))"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {_common(a, b)} / (length({a}) + length({b})) END"


def scored(pairs: str) -> str:
    """Common table expressions over ``pairs`` (``name``, ``candidate``: words with single spaces); the last, ``scored``, adds ``score``."""
    joined = lambda words: f"array_to_string({words}, ' ')"
    part = "substr(long, greatest(i, 0) + 1, least(i + length(short), length(long)) - greatest(i, 0))"
    return f"""p0 AS (
  SELECT name, candidate, list_sort(string_split(name, ' ')) AS wa, list_sort(string_split(candidate, ' ')) AS wb FROM {pairs}
), p1 AS (
  SELECT *, {joined('wa')} AS sa, {joined('wb')} AS sb, list_sort(list_distinct(wa)) AS xa, list_sort(list_distinct(wb)) AS xb,
    CASE WHEN length(name) <= length(candidate) THEN name ELSE candidate END AS short, CASE WHEN length(name) <= length(candidate) THEN candidate ELSE name END AS long FROM p0
), p2 AS (
  SELECT *, {joined('list_filter(xa, lambda w: list_contains(xb, w))')} AS shared, {joined('list_filter(xa, lambda w: NOT list_contains(xb, w))')} AS only_a,
    {joined('list_filter(xb, lambda w: NOT list_contains(xa, w))')} AS only_b FROM p1
), p3 AS (
  SELECT *, trim(shared || ' ' || only_a) AS with_a, trim(shared || ' ' || only_b) AS with_b FROM p2
), p4 AS (
  SELECT *, {_ratio('sa', 'sb')} AS by_words, {_ratio('with_a', 'with_b')} AS r1, {_ratio('shared', 'with_a')} AS r2, {_ratio('shared', 'with_b')} AS r3,
    list_max(list_transform(range(1 - length(short), length(long)), lambda i: 200.0::DOUBLE * {_common('short', part)} / (length(short) + length({part})))) AS stretch FROM p3
), scored AS (
  SELECT name, candidate, (0.4::DOUBLE * by_words + 0.4::DOUBLE * CASE WHEN shared <> '' AND (only_a = '' OR only_b = '') THEN 100.0::DOUBLE WHEN shared <> '' THEN greatest(r1, r2, r3) ELSE r1 END + 0.2::DOUBLE * stretch) / 100 AS score FROM p4
)"""
