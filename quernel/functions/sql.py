"""The text functions under SQL names, as SQL functions of the session: no Python runs when they are used."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quernel.functions.text import COUNTED_WORD, ENGLISH_SUFFIXES, RUSSIAN_ENDINGS, TOKEN


def _cases(w: str, endings: list[str], guard: str) -> str:
    out = []
    for n in sorted({len(e) for e in endings}, reverse=True):
        same = ", ".join(f"'{e}'" for e in endings if len(e) == n)
        out.append(f"WHEN {guard.format(n=n)} AND substring({w}, -{n}, {n}) IN ({same}) THEN left({w}, length({w}) - {n})")
    return f"CASE {' '.join(out)} ELSE {w} END"


def _stems(words: str) -> str:
    english = "named_struct('e', NOT w RLIKE '^[а-яё]' AND octet_length(w) >= 3, 'w', CASE WHEN w RLIKE '^[а-яё]' THEN {ru} WHEN octet_length(w) < 3 THEN w WHEN endswith(w, 'sses') OR endswith(w, 'ies') THEN left(w, length(w) - 2) WHEN endswith(w, 'ss') THEN w WHEN endswith(w, 's') AND octet_length(w) > 3 THEN left(w, length(w) - 1) ELSE w END)"
    out = f"transform({words}, w -> {english.format(ru=_cases('w', RUSSIAN_ENDINGS, 'length(w) >= {n} + 2'))})"
    steps = [
        "CASE WHEN endswith(p.w, 'eed') THEN IF(octet_length(p.w) > 4, left(p.w, length(p.w) - 2), p.w) WHEN endswith(p.w, 'ed') AND octet_length(p.w) > 4 THEN concat(left(p.w, length(p.w) - 2), ' ') WHEN endswith(p.w, 'ing') AND octet_length(p.w) > 5 THEN concat(left(p.w, length(p.w) - 3), ' ') ELSE p.w END",
        "CASE WHEN endswith(p.w, ' ') AND substring(p.w, -2, 1) = substring(p.w, -3, 1) AND substring(p.w, -2, 1) BETWEEN 'a' AND 'z' THEN left(p.w, length(p.w) - 2) WHEN endswith(p.w, ' ') THEN left(p.w, length(p.w) - 1) ELSE p.w END",
        "CASE WHEN endswith(p.w, 'y') AND octet_length(p.w) > 2 AND substring(p.w, -2, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN concat(left(p.w, length(p.w) - 1), 'i') ELSE p.w END",
        _cases("p.w", ENGLISH_SUFFIXES, "octet_length(p.w) > {n} + 2"),
    ]
    for s in steps:
        out = f"transform({out}, p -> named_struct('e', p.e, 'w', IF(p.e, {s}, p.w)))"
    return f"transform({out}, p -> p.w)"


def definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, result type, body)."""
    words = f"transform(regexp_extract_all(coalesce(s, ''), '{TOKEN}', 0), x -> lower(x))"
    return {
        "text_tokens": ("s STRING", "ARRAY<STRING>", words),
        "text_counted_words": ("s STRING", "ARRAY<STRING>", f"filter(regexp_extract_all(lower(coalesce(s, '')), '{COUNTED_WORD}', 0), x -> length(x) >= 2)"),
        "word_stems": ("a ARRAY<STRING>", "ARRAY<STRING>", _stems("a")),
        "text_terms": ("s STRING", "ARRAY<STRING>", f"array_distinct({_stems(f'array_distinct({words})')})"),
        "text_year": ("s STRING", "STRING", "nullif(regexp_extract(s, '20[0-9]{2}', 0), '')"),
        "text_without_citations": ("s STRING", "STRING", "regexp_replace(regexp_replace(s, '[\\\\[][0-9]+[\\\\]]', ''), '[\\\\[]править[^\\\\]]*[\\\\]]', '')"),
    }


def register(spark: SparkSession) -> list[str]:
    """Define every function in the session; gives their names."""
    found = definitions()
    for name, (parameters, kind, body) in found.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(found)
