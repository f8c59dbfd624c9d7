"""Text functions, Column to Column, all of them built-in Spark expressions.

Patterns start with ``(?U)`` where classes must be Unicode-aware. Each has a ``*_sql``
twin where an oracle needs the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of variable tokens that line templates mask, in this order.
RUNTIME_MASKS = (
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"\d{1,2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s*[+-]\d{4}", "<TS>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"),
    (r"\b0[xX][0-9a-fA-F]+\b", "<HEX>"),
    (r"\b[0-9a-fA-F]{16,}\b", "<HEX>"),
    (r"\b\d+(?:\.\d+)?\b", "<NUM>"),
)
# The benchmark's masks; no long bare hex, no floats, 0x in lower case only.
BENCH_MASKS = (*RUNTIME_MASKS[:4], (r"\b0x[0-9a-fA-F]+\b", "<HEX>"), (r"\b\d+\b", "<NUM>"))
# Severities from the gravest.
SEVERITIES = ("FATAL", "CRITICAL", "ERROR", "EXCEPTION", "TRACEBACK", "WARN")
PLACEHOLDERS = ("TS", "UUID", "IP", "HEX", "NUM", "RAND")

#: A word or a mark of punctuation, with the white space before it; or trailing white space.
WORD_TOKEN = r"\s*[\p{L}\p{N}_]+|\s*[^\p{L}\p{N}_\s]|\s+"
QC_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def _mask(line: Column, masks) -> Column:
    def replaced(masks) -> Column:
        out = line
        for pattern, name in masks:
            out = F.regexp_replace(out, "(?U)" + pattern, name)
        return out

    # without a digit only a number of hexadecimal letters alone may be there
    return F.when(line.rlike(r"(?U)\d"), replaced(masks)).otherwise(replaced([m for m in masks if m[1] in ("<UUID>", "<HEX>")]))


def _mask_sql(line: str, masks) -> str:
    for pattern, name in masks:
        line = f"regexp_replace({line}, '{pattern}', '{name}', 'g')"
    return line


def normalize_line(line: Column) -> Column:
    """The run-time template key: seven masks in order, white space kept."""
    return _mask(line, RUNTIME_MASKS)


def normalize_line_sql(line: str) -> str:
    return _mask_sql(line, RUNTIME_MASKS)


def normalize_key(line: Column) -> Column:
    """The benchmark's template key: six masks, trimmed."""
    return F.trim(_mask(line, BENCH_MASKS))


def normalize_key_sql(line: str) -> str:
    return f"trim({_mask_sql(line, BENCH_MASKS)})"


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def survival_norm(text: Column) -> Column:
    return F.lower(collapse_whitespace(text))


def survives(answer: Column, compressed: Column) -> Column:
    """Whether the answer is in the text, but for case and white space."""
    return F.contains(survival_norm(compressed), survival_norm(answer))


def survival_norm_sql(text: str) -> str:
    return rf"lower(trim(regexp_replace({text}, '\s+', ' ', 'g')))"


def severity_rank(line: Column) -> Column:
    """The place of the first of ``SEVERITIES`` in the line, in any case; 6 without any."""
    up, rank = F.upper(line), F.lit(len(SEVERITIES))
    for i in reversed(range(len(SEVERITIES))):
        rank = F.when(F.contains(up, F.lit(SEVERITIES[i])), F.lit(i)).otherwise(rank)
    return rank


def severity_rank_sql(line: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(upper({line}), '{s}') THEN {i}" for i, s in enumerate(SEVERITIES)) + f" ELSE {len(SEVERITIES)} END"


def word_tokens(text: Column) -> Column:
    """Tokens that tile the text."""
    return F.regexp_extract_all(text, F.lit(WORD_TOKEN), F.lit(0))


def word_tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{WORD_TOKEN}')"


def token_count(text: Column) -> Column:
    return F.size(word_tokens(text))


def qc_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(QC_TOKEN), F.lit(0))


def qc_tokens_sql(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{QC_TOKEN}')"


def occurrences(text: Column, needle: Column) -> Column:
    """How often ``needle`` is in ``text`` without overlap; 0 for an empty one."""
    n = F.length(needle)
    return F.when(n == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.greatest(n, F.lit(1))).cast("int"))


def occurrences_sql(text: str, needle: str) -> str:
    return f"CASE WHEN length({needle}) = 0 THEN 0 ELSE (length({text}) - length(replace({text}, {needle}, ''))) // length({needle}) END"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- randomness of tokens -----------------------------------------------------------------


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole)


def _left(token: Column, pattern: str) -> Column:
    """How many characters of the token match the class ``pattern``."""
    return F.length(token) - F.length(F.regexp_replace(token, pattern, ""))


def vowel_ratio(token: Column) -> Column:
    """Vowels among ASCII letters."""
    return _share(_left(token, "[aeiouAEIOU]"), _left(token, "[A-Za-z]"))


def case_transition_rate(token: Column) -> Column:
    """Changes between lower and upper case from letter to letter, a pair of letters."""
    letters = F.regexp_replace(token, "[^A-Za-z]", "")
    # a run ends where case changes: runs less one are the changes
    runs = F.size(F.regexp_extract_all(letters, F.lit("[a-z]+|[A-Z]+"), F.lit(0)))
    return F.when(F.length(letters) < 2, F.lit(0.0)).otherwise((runs - 1).cast("double") / (F.length(letters) - 1))


def max_consonant_run(token: Column) -> Column:
    runs = F.regexp_extract_all(token, F.lit("[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def entropy(token: Column) -> Column:
    """Shannon entropy, bits a character."""
    n = F.length(token).cast("double")
    chars = F.filter(F.split(token, ""), lambda c: c != "")
    p = lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))) / n
    return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), lambda a, c: a - p(c) * F.log2(p(c)))


def is_random_token(token: Column) -> Column:
    """At least two of five signs of a random blob, in a token of 12 or more characters."""
    letters = _left(token, "[A-Za-z]")
    votes = [vowel_ratio(token) < 0.30, case_transition_rate(token) >= 0.30, max_consonant_run(token) >= 5, entropy(token) >= 4.0, token.rlike("[0-9]") & (letters >= 4)]
    return (F.length(token) >= 12) & (letters > 0) & (sum((v.cast("int") for v in votes[1:]), votes[0].cast("int")) >= 2)


ALNUM = "[A-Za-z0-9]+"
LONG_ALNUM = "[A-Za-z0-9]{12,}"  # the runs that may be random


def alnum_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ALNUM), F.lit(0))


def mask_random(text: Column) -> Column:
    """Random runs become ``<RAND>``: long runs and what is between them are zipped again."""
    runs, gaps = F.regexp_extract_all(text, F.lit(LONG_ALNUM), F.lit(0)), F.split(text, LONG_ALNUM, -1)
    masked = F.transform(runs, lambda r: F.when(is_random_token(r), F.lit("<RAND>")).otherwise(r))
    whole = F.array_join(F.zip_with(gaps, masked, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    return F.when(text.rlike(LONG_ALNUM), whole).otherwise(text)


def template_key(line: Column) -> Column:
    """The sampling key: masks, random runs, digits, then runs of placeholders made one."""
    key = F.regexp_replace(bound(normalize_line(line), mask_random), "(?U)\\d+", "<NUM>")
    one = "<(?:" + "|".join(PLACEHOLDERS) + ")>"
    return F.regexp_replace(key, rf"{one}(?:\s+{one})+", "<RAND>")


def is_wordlike(token: Column) -> Column:
    letters = _left(token, "[A-Za-z]")
    return token.isin(*PLACEHOLDERS) | ((letters > 0) & ~is_random_token(token) & ~((F.length(token) >= 12) & (vowel_ratio(token) < 0.20)))


def _alnum_length(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0), lambda a, r: a + F.length(r))


def signal_ratio(text: Column) -> Column:
    """The share of alphanumeric characters in word-like runs; 1 without any."""
    runs = alnum_runs(text)
    total = _alnum_length(runs)
    return F.when(total == 0, F.lit(1.0)).otherwise(_alnum_length(F.filter(runs, is_wordlike)).cast("double") / total)


def is_low_signal(text: Column, min_ratio: float = 0.30, min_alnum: int = 24) -> Column:
    return (_alnum_length(alnum_runs(text)) >= min_alnum) & (signal_ratio(text) < min_ratio)


# The SQL twins of the above, by a token's characters.
def vowel_ratio_sql(t: str) -> str:
    letters = rf"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"
    return rf"CASE WHEN {letters} = 0 THEN 0.0 ELSE length(regexp_replace({t}, '[^aeiouAEIOU]', '', 'g'))::DOUBLE / {letters} END"


def is_random_sql(t: str) -> str:
    letters = rf"regexp_replace({t}, '[^A-Za-z]', '', 'g')"
    flips = rf"CASE WHEN length({letters}) < 2 THEN 0.0 ELSE (len(regexp_extract_all({letters}, '[a-z]+|[A-Z]+')) - 1)::DOUBLE / (length({letters}) - 1) END"
    run = rf"coalesce(list_max(list_transform(regexp_extract_all({t}, '[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]+'), lambda x: length(x))), 0)"
    p = rf"((length({t}) - length(replace({t}, c, '')))::DOUBLE / length({t}))"
    ent = rf"coalesce(-list_sum(list_transform(list_sort(list_distinct(string_split({t}, ''))), lambda c: {p} * log2({p}))), 0.0)"
    votes = [f"({vowel_ratio_sql(t)}) < 0.30", f"({flips}) >= 0.30", f"{run} >= 5", f"{ent} >= 4.0", f"(regexp_matches({t}, '[0-9]') AND length({letters}) >= 4)"]
    return f"(length({t}) >= 12 AND length({letters}) > 0 AND " + " + ".join(f"({v})::INT" for v in votes) + " >= 2)"


def is_wordlike_sql(t: str) -> str:
    names = ", ".join(f"'{p}'" for p in PLACEHOLDERS)
    letters = rf"length(regexp_replace({t}, '[^A-Za-z]', '', 'g'))"
    return f"({t} IN ({names}) OR ({letters} > 0 AND NOT {is_random_sql(t)} AND NOT (length({t}) >= 12 AND ({vowel_ratio_sql(t)}) < 0.20)))"


# --- numbers ------------------------------------------------------------------------------


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def hop_decay_exp(hops: Column, alpha: float = 0.5) -> Column:
    return F.exp(-F.lit(float(alpha)) * F.greatest(hops.cast("double"), F.lit(0.0)))


def hop_decay_linear(hops: Column, most: int = 6) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - hops.cast("double") / float(most))


def round_half_even(x: Column) -> Column:
    return F.rint(x).cast("bigint")


def hash_share(key: Column) -> Column:
    """The first 32 bits of the key's SHA-256, as a share of one."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_share_sql(key: str) -> str:
    return f"('0x' || sha256({key})[1:8])::BIGINT / 4294967296.0::DOUBLE"
