"""Column helpers for text: whitespace, counting, offsets, folds and rounding.

Everything here is a built-in expression, so it stays in the JVM and touches one row
at a time: no shuffle, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the Python string methods see it: Unicode white space and four separators.
# SPACE is the inside of a character class and needs the (?U) flag in front of the pattern.
SPACE = r"\s\x1c-\x1f"
WORD = rf"(?U)[^{SPACE}]+"
SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Drop Unicode whitespace from both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def squeeze(text: Column) -> Column:
    """Collapse every whitespace run to one space and trim."""
    return F.trim(F.regexp_replace(text, rf"(?U)[{SPACE}]+", " "))


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def line_list(text: Column) -> Column:
    return F.split(text, LINE_BREAK, -1)


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"(?U)[^{SPACE}]")


def contains_fold(text: Column, term: Column) -> Column:
    return F.contains(F.lower(text), F.lower(term))


def literal_regex(term: str, fold: bool = True, whole: bool = False) -> str:
    """A pattern that matches `term` itself (quoted), optionally as a whole word."""
    quoted = r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"
    body = rf"\b{quoted}\b" if whole else quoted
    return ("(?iuU)" if fold else "(?U)") + body


def quoted(term: Column) -> Column:
    """A case-folding pattern for each row's own term."""
    return F.concat(F.lit(r"(?iu)\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def literal(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def let_sql(value: str, name: str, body: str) -> str:
    """SQL form of `let`: evaluate once, use as `name`."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running_sum_sql(values: str) -> str:
    """For each element of an array of longs, the sum up to and with it.

    Each pass adds the value 1, 2, 4... places before, so a long document costs n*log(n) additions.
    """
    steps = ", ".join(str(1 << k) for k in range(31))
    return let_sql(values, "arr_", f"aggregate(filter(array({steps}), d_ -> d_ < size(arr_)), arr_, "
                   "(sums_, d_) -> transform(sums_, (v_, i_) -> v_ + coalesce(get(sums_, i_ - d_), 0L)))")


def find_all_sql(text: str, pattern: str) -> str:
    """All matches with 0-based code-point offsets: array<struct<start,value>>.

    The pattern must not match the empty string. Match offsets follow from the
    pieces between matches: start_i = everything before it, pieces and matches.
    Written as SQL text because it is used inside larger lambdas.
    """
    regex = literal(pattern)
    steps = "transform(hits_, (h_, n_) -> get(gap_, n_) + length(h_))"
    placed = "transform(hits_, (h_, n_) -> named_struct('start', int(get(upto_, n_) - length(h_)), 'value', h_))"
    found = let_sql(f"transform(split({text}, {regex}, -1), g_ -> bigint(length(g_)))", "gap_",
                    let_sql(running_sum_sql(steps), "upto_", placed))
    none = "cast(array() as array<struct<start:int,value:string>>)"
    return let_sql(f"regexp_extract_all({text}, {regex}, 0)", "hits_", f"if(size(hits_) = 0, {none}, {found})")


def find_all(column: str, pattern: str) -> Column:
    return F.expr(find_all_sql(column, pattern))


def strip_sql(text: str) -> str:
    return f"btrim({text}, {literal(SPACE_CHARS)})"


def squeeze_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, {literal(rf'(?U)[{SPACE}]+')}, ' '))"


def ranked_terms(tokens: Column) -> Column:
    """Distinct tokens as array<struct<rank_key,first_at,term>>, most frequent first.

    Ties keep first appearance. One sort and one scan of run boundaries.
    """
    marked = F.sort_array(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: (k == 0) | (F.get(s, k)["w"] != F.get(s, k - 1)["w"]),
        )
        return let(starts, lambda at: F.sort_array(F.transform(at, lambda k, j: F.struct(
            (k - F.coalesce(F.get(at, j + 1), F.size(s))).alias("rank_key"),
            F.get(s, k)["i"].alias("first_at"),
            F.get(s, k)["w"].alias("term"),
        ))))

    return F.when(F.size(tokens) > 0, let(marked, runs)).otherwise(
        F.array().cast("array<struct<rank_key:int,first_at:int,term:string>>")
    )


def py_round(value: Column, digits: int = 2) -> Column:
    """Round like Python's round(): half to even on the exact binary value.

    The fraction is counted in steps of 2^-52 (up to three digits fit a long); what is
    finer than a step exists only below 1 and is carried exactly beside it.
    """
    if not 0 <= digits <= 3:
        raise ValueError("digits must be between 0 and 3")
    scale = 10 ** digits
    step = 1 << 52

    def rounded(x: Column) -> Column:
        whole = F.floor(x)

        def from_bits(bits: Column) -> Column:
            finer = (bits - F.floor(bits)) * F.lit(float(scale))

            def from_total(total: Column) -> Column:
                kept = F.shiftright(total, 52)
                rest = total.bitwiseAND(F.lit(step - 1))
                half = F.lit(step // 2)
                tie_up = (finer > F.floor(finer)) | (kept % 2 == 1)
                up = (rest > half) | ((rest == half) & tie_up)
                return (whole * scale + kept + F.when(up, 1).otherwise(0)) / F.lit(float(scale))
            return let(F.floor(bits) * scale + F.floor(finer), from_total)
        return let((x - whole) * F.lit(float(step)), from_bits)

    magnitude = let(F.abs(value.cast("double")), rounded)
    return F.when(value < 0, -magnitude).otherwise(magnitude)


def digest(text: Column, length: int = 12) -> Column:
    """A short stable digest, for logging without the content."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def page_label(first: Column, last: Column) -> Column:
    """'p. 3' or 'pp. 3–5'; empty when there is no page."""
    return (
        F.when(first.isNull(), F.lit(""))
        .when(first == last, F.concat(F.lit("p. "), first.cast("string")))
        .otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("–"), last.cast("string")))
    )
