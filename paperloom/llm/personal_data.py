"""Personal data by candidate boosting.

Strict rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers; these
spans always stay. Beside them, high-recall generators propose looser, overlapping spans
(spelt-out addresses, numbers with unusual separators). Each candidate has format features
(length, digits, separators, check digit, octets) and context features (telling words
before it, neighbouring characters). The strict shape is no label, since only candidates
without it are scored. Labels come from strict spans written otherwise (other separators,
spelt-out signs, no plus) in their own context and after a telling word, from a few fixed
spans for families the corpus has not, and from candidates that break the family's check or
have nothing that tells of it. Candidates that pass the check and are told of have no label;
they are for the trees to judge. Boosted trees are fitted on a bounded sample of distinct
feature rows (`sample`, drawn by hash); a threshold per family is calibrated to `precision`
by one weighted aggregate of the scores of all labelled candidates, the fitted ones among
them, half way to the next lower score and where a candidate is at least as likely as not.
Candidates above their threshold that touch no strict span are added; of overlapping
ones the highest score wins, then the earlier, then the longer.

Null text counts as empty. Rows are independent, so repeated rows repeat their result; an
empty table gives an empty result. The trees run as SQL expressions; no Python runs on the
data.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.llm import boosting
from paperloom.llm.common import stash

LOCAL = "[A-Za-z0-9._%+-]"
#: Strict kinds in report order. Possessive forms: the plain patterns never need to give back what these take.
STRICT = (
    ("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){13,}+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$"
AT, DOT = r"\x20?(?:@|[(\[]at[)\]])\x20?", r"\x20?(?:\.|[(\[]dot[)\]])\x20?"
#: Generators by family.
LOOSE = (
    ("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++"),
    ("ip", r"(?<![0-9A-Za-z])[0-9]{1,3}(?:[.,:_-][0-9]{1,3}){3}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{0,2}[0-9]{2,7}){2,4}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\+|00)?(?:[0-9]{1,3}[\x20./-]?(?=\())?\(?[0-9]{2,4}[)\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-]?[0-9]{2,4}){1,3}(?![0-9])"),
)
WORDS = {
    "email": r"(?i)(?:e-?mail|contact|write|mailto|address)[^.\n]{0,12}$",
    "ip": r"(?i)(?:\bip\b|host|server|address|client|gateway)[^.\n]{0,12}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|payment|\bcc\b)[^.\n]{0,12}$",
    "phone": r"(?i)(?:phone|tel|call|mobile|fax|whatsapp|contact)[^.\n]{0,12}$",
}
FEATURES = ["family_no", "size", "digits", "letters", "marks", "blanks", "groups", "plus", "at_sign", "spelt", "brackets", "dated", "checked", "octets", "told", "joined_left", "joined_right"]
#: Strict spans written otherwise: SQL of a value `v`, and what it is: sure by itself, told only by context, or wrong in any context.
SPLIT = "regexp_replace({}, '([0-9]{{4}})(?=[0-9])', '$1{}')"
BUMPED = "concat(left(d, length(d) - 1), string((int(right(d, 1)) + 1) % 10))"
ALTERED = {
    "email": (("replace(v, '@', '[at]')", "sure"), ("replace(v, '@', ' (at) ')", "sure"), ("replace(v, '@', ' @ ')", "told"),
              ("concat(split_part(v, '@', 1), '[at]', replace(split_part(v, '@', 2), '.', '[dot]'))", "sure")),
    "ip": (*((f"replace(v, '.', '{x}')", "told") for x in ",:-_"), *((f"replace(regexp_replace(v, '^[0-9]+', '999'), '.', '{x}')", "wrong") for x in ",:-_")),
    "card": (*((SPLIT.format("d", x), "sure") for x in ("/", ".", "_", "  ")), *((SPLIT.format(BUMPED, x), "wrong") for x in ("/", ".", "_", "  ", "", "-"))),
    "phone": (("substring(v, 2)", "sure_in_brackets"), ("concat('00', substring(v, 2))", "sure"), *((rf"regexp_replace(regexp_replace(v, '^\\\\+[0-9]+[^0-9]*', ''), '[^0-9]+', '{x}')", "told") for x in "./- "),
              (r"regexp_replace(v, '^\\+[0-9]+[ .-]*', '')", "sure_in_brackets"), ("'2024-01-15'", "wrong"), ("'15.01.2024'", "wrong"), ("'2024-01-15 10'", "wrong"), ("'12-34-56'", "wrong")),
}
TELLING = {"email": "e-mail ", "ip": "host ", "card": "card ", "phone": "tel "}
#: So that a family has labels in a corpus without strict spans of it.
FIXED = (("email", "jo.doe@example.com"), ("email", "info7@mail.example.org"), ("email", "jo@ab.de"), ("email", "sam@example.net"), ("ip", "192.0.2.44"), ("ip", "10.20.30.40"), ("card", "4111111111111111"),
         ("card", "5500005555555559"), ("phone", "+1 (555) 123-4567"), ("phone", "+44 20 7946 0958"), ("phone", "+49 30 1234 5678"), ("phone", "+1 555 123 4567"), ("phone", "+33 1 98 76 54 32"))
FIXED_TIMES = 20  # each counts as so many
GRAIN = 64  # scores are counted in steps of one part of this
SAMPLE = 4000
PRECISION = 0.98
CONTEXT = 30


def digits_of(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


def check_digit_sql(v: str) -> str:
    """Whether the digits of `v` pass the Luhn check."""
    total = ("aggregate(transform(reverse(filter(split(d, ''), x -> x <> '')), (x, i) -> "
             "if(i % 2 = 0, int(x), if(int(x) > 4, 2 * int(x) - 9, 2 * int(x)))), 0, (a, x) -> a + x) % 10 = 0")
    return T.let_sql(digits_of(v), "d", f"if(d = '', false, {total})")


def valid_sql(kind: str, v: str) -> str:
    if kind == "ip":
        return f"{v} rlike {T.literal(OCTETS)}"
    if kind == "card":
        return f"(length({digits_of(v)}) between 14 and 19 and {check_digit_sql(v)})"
    if kind == "phone":
        return f"length({digits_of(v)}) between 10 and 15"
    return "true"


def strict_spans(text: str) -> Column:
    """array<struct<start,kind_no,kind,end>> of the strict kinds."""
    groups = [
        f"transform(filter({T.find_all_sql(text, pattern)}, h -> {valid_sql(kind, 'h.value')}), h -> "
        f"named_struct('start', h.start, 'kind_no', {number}, 'kind', '{kind}', 'end', h.start + length(h.value)))"
        for number, (kind, pattern) in enumerate(STRICT)]
    return F.expr(f"array_sort(concat({', '.join(groups)}))")


def loose_spans(text: str) -> Column:
    """Candidates with features."""
    groups = []
    for number, (family, pattern) in enumerate(LOOSE):
        count = lambda what: f"double(length(v) - length(regexp_replace(v, {T.literal(what)}, '')))"
        fields = {
            "family_no": f"{number}D", "size": "double(length(v))", "digits": count("[0-9]"), "letters": count("[A-Za-z]"),
            "marks": count(r"[._/,:()\[\]-]"), "blanks": count(r"\x20"), "groups": "double(size(split(v, '[^0-9A-Za-z]+')))",
            "plus": "double(int(v rlike '^([+]|00)'))", "at_sign": "double(int(contains(v, '@')))",
            "spelt": "double(int(v rlike '[(\\\\[](at|dot)[)\\\\]]'))", "brackets": "double(int(v rlike '[(][0-9]+[)]'))",
            "dated": "double(int(v rlike '(^|[^0-9])(19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}' or v rlike '^[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](19|20)[0-9]{2}'))",
            "checked": f"double(int({check_digit_sql('v')}))", "octets": f"double(int(regexp_replace(v, '[,:_-]', '.') rlike {T.literal(OCTETS)}))",
            "told": f"double(int(left_ rlike {T.literal(WORDS[family])}))",
            "joined_left": "double(int(left_ rlike '[A-Za-z0-9+.,:/-]$'))", "joined_right": "double(int(right_ rlike '^[A-Za-z0-9+:/-]'))",
        }
        struct = ", ".join(f"'{k}', {v}" for k, v in fields.items())
        # A short stretch around the hit, cut once; the hit is put back together from it.
        made = T.let_sql("h.value", "v", T.let_sql(
            f"substring({text}, greatest(h.start - {CONTEXT}, 0) + 1, least(h.start, {CONTEXT}))", "left_", T.let_sql(
                f"substring({text}, h.start + length(h.value) + 1, 1)", "right_",
                f"named_struct('start', h.start, 'end', h.start + length(v), 'kind_no', {number}, 'kind', '{family}', {struct})")))
        groups.append(f"transform({T.find_all_sql(text, pattern)}, h -> {made})")
    return F.expr(f"concat({', '.join(groups)})")


def proposed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Strict spans with what stands around them, and the candidates with `hit`: touches a strict span."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.select("key", "_text", strict_spans("_text").alias("strict"), loose_spans("_text").alias("loose"))
    hit = "transform(loose, c -> named_struct('c', c, 'hit', exists(strict, s -> s.start < c.end and c.start < s.end)))"
    shown = (f"transform(strict, s -> named_struct('kind', s.kind, 'before', substring(_text, greatest(s.start - {CONTEXT}, 0) + 1, least(s.start, {CONTEXT})), "
             "'v', substring(_text, s.start + 1, s.end - s.start), 'after', substring(_text, s.end + 1, 1)))")
    return rows.select("key", "strict", F.expr(hit).alias("loose"), F.expr(shown).alias("shown"))


def altered(rows: DataFrame) -> DataFrame:
    """Labelled candidates (`c`, `label`) from strict spans (kind, before, v, after) written otherwise."""
    ways = {kind: ", ".join(f"named_struct('w', {sql}, 'what', '{what}')" for sql, what in made) for kind, made in ALTERED.items()}
    cases = " ".join(f"when '{kind}' then array({made})" for kind, made in ways.items())
    words = " ".join(f"when '{kind}' then '{word}'" for kind, word in TELLING.items())
    written = rows.select("*", F.expr(digits_of("v")).alias("d")).select("*", F.explode(F.expr(f"case kind {cases} end")).alias("o"))
    written = written.select("kind", "after", "o.w", "o.what", F.explode(F.expr(f"array(before, concat(before, ' ', case kind {words} end))")).alias("before"))
    found = written.select("kind", "what", F.length("before").alias("at"), F.length("w").alias("n"), F.expr(f"length({digits_of('w')})").alias("d"),
                           F.concat("before", "w", "after").alias("_text"))
    found = found.select("*", strict_spans("_text").alias("strict"), F.explode(loose_spans("_text")).alias("c"))
    # The candidate that takes in (nearly) the whole span; what became strict again is never scored.
    found = found.filter("c.kind = kind and c.start >= at and c.end <= at + n and 3 * c.digits >= 2 * d and not exists(strict, s -> s.start < c.end and c.start < s.end)")
    label = "what <> 'wrong' and (what = 'sure' or c.told = 1 or (what = 'sure_in_brackets' and c.brackets = 1))"
    return found.select("c", F.expr(f"double(int({label}))").alias("label"))


def unlikely(rows: DataFrame) -> DataFrame:
    """Candidates outside strict spans that break their family's check or that nothing tells of."""
    check = ("case c.kind when 'ip' then c.octets = 1 when 'card' then c.checked = 1 and c.digits between 14 and 19 "
             "when 'phone' then c.dated = 0 and c.digits between 10 and 15 else true end")
    told = "(c.told = 1 or (c.kind = 'email' and c.spelt = 1) or (c.kind = 'card' and c.joined_left = 0 and c.joined_right = 0) or (c.kind = 'phone' and (c.brackets = 1 or c.plus = 1)))"
    return rows.select(F.explode("loose").alias("e")).filter("not e.hit").select("e.c").filter(f"not ({check} and {told})").select("c", F.lit(0.0).alias("label"))


def score_sql(models: list[boosting.Model], of: str) -> str:
    """The score by the trees of a candidate's family."""
    names = [of + f for f in FEATURES]
    return f"case {names[0]} {' '.join(f'when {i}D then {m.sql(names)}' for i, m in enumerate(models))} end"


def train(rows: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> tuple[list[boosting.Model], list[float]]:
    """Trees per family from at most `sample` distinct labelled candidates chosen by hash, and one threshold per family from all of them."""
    fixed = rows.sparkSession.sql("select inline(array({}))".format(", ".join(
        f"named_struct('kind', '{kind}', 'before', 'and then', 'v', '{v}', 'after', ' ')" for kind, v in FIXED)))
    fixed = fixed.select("kind", F.concat("before", F.lit(" ")).alias("before"), "v", "after", F.explode(F.expr(f"sequence(1, {FIXED_TIMES})"))).drop("col")
    labelled = altered(rows.select(F.inline("shown")).unionByName(fixed)).unionByName(unlikely(rows))
    # Equal feature rows count once with their number, so a copied passage cannot fill the sample.
    columns = [*FEATURES, "label"]
    table = stash(labelled.select(*[F.col(f"c.{f}").alias(f) for f in FEATURES], "label").groupBy(*columns).agg(F.count(F.lit(1)).alias("times")), "pii-labels")
    chosen = table.orderBy(F.xxhash64(*columns), *columns).limit(sample).collect()
    drawn = np.array([[float(v) for v in r] for r in chosen]).reshape(len(chosen), len(columns) + 1)
    of = [drawn[drawn[:, 0] == family] for family in range(len(LOOSE))]
    models = [boosting.fit(own[:, :-2], own[:, -2], np.sqrt(own[:, -1]), trees=30, depth=3) for own in of]
    counted = table.select("family_no", "label", "times", F.expr(f"floor({GRAIN} * ({score_sql(models, '')}))").alias("step")).groupBy("family_no", "step").agg(
        F.sum(F.col("label") * F.col("times")).alias("right"), F.sum("times").alias("all")).collect()
    cuts = []
    for family in range(len(LOOSE)):
        steps = sorted((r for r in counted if r["family_no"] == family and r["step"] is not None), key=lambda r: -r["step"])
        cut, right, total = float("inf"), 0.0, 0
        for r, below in zip(steps, [*(x["step"] for x in steps[1:]), -GRAIN * 100], strict=True):
            right, total = right + r["right"], total + r["all"]
            if right and right >= precision * total and r["step"] >= 0:
                cut = max((r["step"] + below) / 2 / GRAIN, 0.0)
        cuts.append(cut)
    return models, cuts


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """Per document: key, `strict` and `spans` (strict and added), by start, then kind."""
    rows = stash(proposed(docs, key, text), "pii-candidates")
    models, cuts = train(rows, sample, precision)
    clear = "filter(loose, e -> not e.hit)"
    scored = (f"transform({clear}, e -> named_struct('score', {score_sql(models, 'e.c.')}, "
              "'start', e.c.start, 'kind_no', e.c.kind_no, 'kind', e.c.kind, 'end', e.c.end))")
    limits = " or ".join(f"(s.kind_no = {i} and s.score >= {cut!r}D)" for i, cut in enumerate(cuts) if np.isfinite(cut)) or "false"
    kept = rows.select("key", "strict", F.expr(f"filter({scored}, s -> {limits})").alias("_over"))
    better = "(o.score > s.score or (o.score = s.score and (o.start < s.start or (o.start = s.start and (o.end > s.end or (o.end = s.end and o.kind_no < s.kind_no))))))"
    added = (f"transform(filter(_over, s -> not exists(_over, o -> o.start < s.end and s.start < o.end and {better})), "
             "s -> named_struct('start', s.start, 'kind_no', s.kind_no, 'kind', s.kind, 'end', s.end))")
    return kept.select("key", "strict", F.expr(f"array_sort(concat(strict, {added}))").alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """Counts and digest of the strict spans and the list of all spans per document."""
    counts = [F.expr(f"bigint(size(filter(strict, s -> s.kind = '{kind}')))").alias(f"n_{kind}") for kind, _ in STRICT]
    return detect(docs, **options).select(
        F.col("key").alias("doc_id"), *counts, F.sha2(joined(F.col("strict")).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size("strict")).cast("long").alias("n_added"))
