"""Documents as books (one row per document, pages inside) and edits on their pages.

A document arrives as one row, so its pages are cut, edited and counted inside that row.
No operator here groups pages by document: there is no shuffle except the join of an
instruction table to its documents, whose key is unique on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed, scale
from paperloom.functions import text as T
from paperloom.session import settle


def to_books(docs: DataFrame, lines_per_page: int = 10, text: str = "text") -> DataFrame:
    """Replace `text` by `pages`: array<struct<page,text>>, `lines_per_page` lines each."""
    size = F.lit(lines_per_page)

    def cut(lines: Column) -> Column:
        last = F.floor((F.size(lines) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(
            (i + 1).alias("page"), F.array_join(F.slice(lines, i * size + 1, size), "\n").alias("text")
        ))

    return docs.withColumn("pages", T.let(F.split(text, "\n", -1), cut)).drop(text)


def to_pages(books: DataFrame, *keep: str) -> DataFrame:
    """One row per page."""
    return books.select(*keep, F.explode("pages").alias("_p")).select(*keep, "_p.page", "_p.text")


def split_on_markers(text: Column) -> Column:
    """Pages of text that carries '--- Page N ---' markers: array<struct<page,text>>, cleaned.

    Text before the first marker belongs to page 1; blank pages are dropped.
    """
    marker = r"--- Page \d+ ---"
    numbers = F.regexp_extract_all(text, F.lit(r"--- Page (\d+) ---"), F.lit(1))
    bodies = F.split(text, marker, -1)
    pages = T.let(numbers, lambda n: F.transform(bodies, lambda b, i: F.struct(
        F.when(i == 0, F.lit(1)).otherwise(F.get(n, i - 1).cast("int")).alias("page"),
        clean_text(b).alias("text"),
    )))
    return F.filter(pages, lambda p: p["text"] != "")


def clean_text(text: Column) -> Column:
    """Squeeze newlines and spaces, drop page markers and unusual characters, trim."""
    out = F.regexp_replace(text, r"\n+", "\n")
    out = F.regexp_replace(out, r" +", " ")
    out = F.regexp_replace(out, r"(?U)--- Page \d+ ---", "")
    out = F.regexp_replace(out, rf"(?U)[^\w{T.SPACE}.,!?;:\-()]", " ")
    return T.squeeze(out)


# ------------------------------------------------------------------ profile

def page_profile(pages: DataFrame) -> DataFrame:
    """Size, orientation, character count and text layer of each page."""
    return (
        pages.withColumn("characters", F.length(T.strip(F.col("text"))))
        .withColumn("orientation", F.when(F.col("width") > F.col("height"), "landscape").otherwise("portrait"))
        .withColumn("text_layer", F.when(F.col("characters") >= fixed.TEXT_LAYER_CHARS, "native").otherwise("none"))
        .withColumn("width", T.py_round(F.col("width"), 1))
        .withColumn("height", T.py_round(F.col("height"), 1))
    )


def assess_pages(pages: DataFrame) -> DataFrame:
    """Which pages would need recognition, and why."""
    counted = pages.withColumn("characters", F.length(T.strip(F.col("text"))))
    needs = F.col("characters") < fixed.TEXT_LAYER_CHARS
    return counted.withColumn("needs_ocr", needs).withColumn("reason", F.when(
        needs, "No extractable text; the page is probably an image."
    ).otherwise(F.concat(F.col("characters").cast("string"), F.lit(" characters of extractable text."))))


def text_layer_class(total: Column, native: Column) -> Column:
    return (
        F.when(total == 0, "empty").when(native == total, "native")
        .when(native == 0, "no_text_layer").otherwise("mixed")
    )


def classify_books(books: DataFrame) -> DataFrame:
    """Text-layer class per document, in place: no grouping."""
    has_text = F.transform("pages", lambda p: F.length(T.strip(p["text"])) >= fixed.TEXT_LAYER_CHARS)
    return (
        books.withColumn("_native", has_text)
        .withColumn("page_count", F.size("pages"))
        .withColumn("pages_with_text", F.size(F.filter("_native", lambda n: n)))
        .withColumn("needing", F.filter(
            F.transform("_native", lambda n, i: F.when(~n, i + 1)), lambda p: p.isNotNull()
        ))
        .withColumn("classification", text_layer_class(F.col("page_count"), F.col("pages_with_text")))
        .drop("_native")
    )


# ------------------------------------------------------------------ editing

def _selection_error(selection: Column, total: Column) -> Column:
    """Reason a 1-based selection is refused, else null."""
    bad = F.filter(selection, lambda p: (p < 1) | (p > total))
    return F.when(F.size(F.coalesce(selection, F.array().cast("array<int>"))) == 0, "No pages were selected.").when(
        F.size(bad) > 0,
        F.concat(F.lit("Page "), F.get(bad, F.lit(0)).cast("string"), F.lit(" is out of range; the document has "),
                 total.cast("string"), F.lit(" page(s).")),
    )


def dedupe_selection(selection: Column) -> Column:
    """Each page once, first mention kept."""
    return F.array_distinct(selection)


def renumber(pages: Column) -> Column:
    return F.transform(pages, lambda p, i: F.struct((i + 1).alias("page"), p["text"].alias("text")))


def _edit(books: DataFrame, edits: DataFrame, reason: Column, result: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """Apply one instruction per document; refused instructions come back with their reason."""
    joined = edits.join(books, key, "left").withColumn("reason", F.when(F.col("pages").isNull(), "The document was not found.").otherwise(reason))
    done = joined.filter(F.col("reason").isNull()).withColumn("pages", renumber(result))
    refused = joined.filter(F.col("reason").isNotNull()).select(key, "reason")
    return done.select(*books.columns), refused


def _pick(selection: Column, pages: Column) -> Column:
    return F.transform(selection, lambda n: F.get(pages, n - 1))


def reorder(books: DataFrame, edits: DataFrame, key: str = "doc_id"):
    """edits(key, selection): a permutation of all pages."""
    total, order = F.size("pages"), dedupe_selection(F.col("selection"))
    reason = F.coalesce(_selection_error(F.col("selection"), total), F.when(
        F.size(order) != total,
        F.concat(F.lit("A reorder must list every page exactly once ("), F.size(order).cast("string"),
                 F.lit(" given, "), total.cast("string"), F.lit(" expected).")),
    ))
    return _edit(books, edits, reason, _pick(order, F.col("pages")), key)


def delete_pages(books: DataFrame, edits: DataFrame, key: str = "doc_id"):
    total, targets = F.size("pages"), dedupe_selection(F.col("selection"))
    reason = F.coalesce(_selection_error(F.col("selection"), total), F.when(
        F.size(targets) == total, "A document must keep at least one page."))
    return _edit(books, edits, reason, F.filter("pages", lambda p: ~F.array_contains("selection", p["page"])), key)


def extract_pages(books: DataFrame, edits: DataFrame, key: str = "doc_id"):
    order = dedupe_selection(F.col("selection"))
    return _edit(books, edits, _selection_error(F.col("selection"), F.size("pages")), _pick(order, F.col("pages")), key)


def duplicate_pages(books: DataFrame, edits: DataFrame, key: str = "doc_id"):
    """Each chosen page is followed by its copy."""
    doubled = F.flatten(F.transform("pages", lambda p: F.when(
        F.array_contains("selection", p["page"]), F.array(p, p)).otherwise(F.array(p))))
    return _edit(books, edits, _selection_error(F.col("selection"), F.size("pages")), doubled, key)


def _after_error(total: Column, what: str) -> Column:
    return F.when((F.col("after") < 0) | (F.col("after") > total), F.concat(
        F.lit(f"Cannot insert after page "), F.col("after").cast("string"), F.lit("; the document has "),
        total.cast("string"), F.lit(f" page(s).{what}")))


def _with_source(edits: DataFrame, books: DataFrame, key: str) -> DataFrame:
    """Bring the source document's pages (and the selected ones) next to the instruction."""
    source = books.select(F.col(key).alias("source"), F.col("pages").alias("source_pages"))
    chosen = F.coalesce(F.col("selection"), F.transform("source_pages", lambda p, i: i + 1))
    return edits.join(source, "source", "left").withColumn("chosen", chosen)


def _source_error() -> Column:
    bad = F.filter("chosen", lambda n: (n < 1) | (n > F.size("source_pages")))
    return F.when(F.col("source_pages").isNull(), "The source document was not found.").when(F.size(bad) > 0, F.concat(
        F.lit("The source document has "), F.size("source_pages").cast("string"), F.lit(" page(s); page "),
        F.get(bad, F.lit(0)).cast("string"), F.lit(" was requested."),
    )).when(F.size("chosen") == 0, "No source pages were selected.")


def insert_pages(books: DataFrame, edits: DataFrame, key: str = "doc_id"):
    """edits(key, source, after, selection): pages of another document put after page `after`."""
    prepared = _with_source(edits, books, key)
    total = F.size("pages")
    result = F.concat(
        F.filter("pages", lambda p: p["page"] <= F.col("after")),
        _pick(F.col("chosen"), F.col("source_pages")),
        F.filter("pages", lambda p: p["page"] > F.col("after")),
    )
    reason = F.coalesce(_after_error(total, " Use 0 to insert at the beginning."), _source_error())
    return _edit(books, prepared, reason, result, key)


def replace_pages(books: DataFrame, edits: DataFrame, key: str = "doc_id"):
    """edits(key, source, targets, selection): swap target pages for source pages, in order."""
    prepared = _with_source(edits, books, key).withColumn("ordered", F.sort_array(F.array_distinct("targets")))
    total = F.size("pages")
    outside = F.filter("ordered", lambda p: (p < 1) | (p > total))
    reason = F.coalesce(
        F.when(F.size("ordered") == 0, "No pages were named for replacement.")
        .when(F.size(outside) > 0, F.concat(
            F.lit("Page(s) "), F.array_join(outside.cast("array<string>"), ", "),
            F.lit(" do not exist; the document has "), total.cast("string"), F.lit("."))),
        _source_error(),
        F.when(F.size("ordered") != F.size("chosen"), F.concat(
            F.size("ordered").cast("string"), F.lit(" page(s) are being replaced but "),
            F.size("chosen").cast("string"), F.lit(" replacement page(s) were supplied. The counts must match."))),
    )
    result = F.transform("pages", lambda p: F.when(
        F.array_contains("ordered", p["page"]),
        F.get("source_pages", F.get("chosen", F.array_position("ordered", p["page"]).cast("int") - 1) - 1),
    ).otherwise(p))
    return _edit(books, prepared, reason, result, key)


def insert_blank(books: DataFrame, edits: DataFrame, key: str = "doc_id"):
    """edits(key, after, count): 1-100 empty pages after page `after`."""
    reason = F.coalesce(
        _after_error(F.size("pages"), ""),
        F.when((F.col("count") < 1) | (F.col("count") > 100), "Between 1 and 100 blank pages can be added at once."),
    )
    blanks = F.transform(F.sequence(F.lit(1), F.col("count")), lambda i: F.struct(i.alias("page"), F.lit("").alias("text")))
    result = F.concat(
        F.filter("pages", lambda p: p["page"] <= F.col("after")), blanks,
        F.filter("pages", lambda p: p["page"] > F.col("after")),
    )
    return _edit(books, edits, reason, result, key)


def merge_books(requests: DataFrame, books: DataFrame, key: str = "doc_id"):
    """requests(request_id, ord, key): every page of the merged documents with its new number: (merged, refused).

    A request that names an unknown document is refused as a whole, with the number of such documents. Positions come from a running sum of page counts, so no merged document is ever
    gathered in one place, however many documents one request names.
    """
    # Numbers first: only page counts go through the running sum, text is joined once at the end.
    named = settle(scale.null_safe_join(requests, books.select(key, F.size("pages").alias("_n")), [key], "left"))
    unknown = named.filter(F.col("_n").isNull()).groupBy("request_id").agg(F.count(F.lit(1)).alias("unknown"))
    refused = unknown.select("request_id", "unknown", F.concat(F.col("unknown").cast("string"), F.lit(" of the documents to merge do not exist.")).alias("reason"))
    counted = named.join(unknown.select("request_id"), "request_id", "left_anti")
    placed = scale.running_before(counted, ["request_id"], "ord", F.col("_n"), "_before").join(books.select(key, "pages"), key)
    return placed.select("request_id", "ord", key, "_before", F.explode("pages").alias("_p")).select(
        "request_id", (F.col("_before") + F.col("_p.page")).alias("page"), key,
        F.col("_p.page").alias("source_page"), F.col("_p.text").alias("text"),
    ), refused


def split_ranges(books: DataFrame, ranges: DataFrame, key: str = "doc_id"):
    """ranges(key, part, first, last): inclusive page ranges, each a new document."""
    joined = ranges.join(books, key, "left")
    bad = F.col("pages").isNull() | (F.col("first") < 1) | (F.col("last") > F.size("pages")) | (F.col("first") > F.col("last"))
    refused = joined.filter(bad).select(key, "part", F.when(F.col("pages").isNull(), "The document was not found.").otherwise(F.concat(
        F.lit("Range "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"),
        F.lit(" is invalid for a "), F.size("pages").cast("string"), F.lit("-page document."),
    )).alias("reason"))
    done = joined.filter(~bad).withColumn(
        "pages", renumber(F.slice("pages", F.col("first"), F.col("last") - F.col("first") + 1)))
    return done.select(*books.columns, "part"), refused


def rotate_geometry(pages: DataFrame) -> DataFrame:
    """Turn pages by `degrees`; anything but a multiple of 90 is refused."""
    ok = F.pmod("degrees", F.lit(90)) == 0
    return pages.withColumn("new_rotation", F.when(ok, F.pmod(F.col("rotation") + F.col("degrees"), F.lit(360)))).withColumn(
        "reason", F.when(~ok, "Rotation must be a multiple of 90 degrees."))


def crop_geometry(pages: DataFrame) -> DataFrame:
    """Clamp a crop box (l,b,r,t) to the page (ml,mb,mr,mt); an empty result is refused."""
    left, bottom = F.greatest("ml", "l"), F.greatest("mb", "b")
    right, top = F.least("mr", "r"), F.least("mt", "t")
    reason = F.when((F.col("r") <= F.col("l")) | (F.col("t") <= F.col("b")),
                    "Crop box must have positive width and height.").when(
        (right <= left) | (top <= bottom), F.concat(F.lit("Crop box does not overlap page "), F.col("page").cast("string"), F.lit(".")))
    boxed = pages.withColumn("reason", reason)
    for name, value in (("new_l", left), ("new_b", bottom), ("new_r", right), ("new_t", top)):
        boxed = boxed.withColumn(name, F.when(F.col("reason").isNull(), value))
    return boxed


def view_rect(words: DataFrame, height: str = "height") -> DataFrame:
    """Bottom-left coordinates (x0,y0,x1,y1) as a top-left view rectangle."""
    return (
        words.withColumn("view_x", F.col("x0")).withColumn("view_y", F.col(height) - F.col("y1"))
        .withColumn("view_width", F.col("x1") - F.col("x0")).withColumn("view_height", F.col("y1") - F.col("y0"))
    )


# ------------------------------------------------------------------ numbering

def page_labels(books: DataFrame, selection: Column | None = None, template: str = "{page}", start: int = 1) -> DataFrame:
    """Sequential labels over the selected pages, in the order given: label rows per page."""
    if template.replace("{page}", "").replace("{total}", "").count("{"):
        raise ValueError("Page number format may only use {page} and {total}.")
    chosen = F.coalesce(selection, F.transform("pages", lambda p: p["page"])) if selection is not None else F.transform(
        "pages", lambda p: p["page"])
    picked = books.withColumn("_sel", dedupe_selection(chosen)).select(
        *[c for c in books.columns if c != "pages"], F.size("_sel").alias("_n"), F.posexplode("_sel").alias("_i", "page"))
    label = F.replace(
        F.replace(F.lit(template), F.lit("{page}"), (F.col("_i") + start).cast("string")),
        F.lit("{total}"), (F.col("_n") + start - 1).cast("string"))
    return picked.withColumn("label", label).drop("_i", "_n")


def bates(books: DataFrame, prefix: str = "", suffix: str = "", start: int = 1, digits: int = 6, key: str = "doc_id") -> DataFrame:
    """One running number over every page of the corpus, in `key` order, zero-padded."""
    counted = books.select(key, F.transform("pages", lambda p: p["page"]).alias("_numbers"))
    placed = scale.running_before(counted, [], key, F.size("_numbers"), "_before")
    number = (F.col("_before") + F.col("page") + (start - 1)).cast("string")
    padded = F.when(F.length(number) < digits, F.lpad(number, digits, "0")).otherwise(number)
    return placed.select(key, "_before", F.explode("_numbers").alias("page")).select(
        key, "page", F.concat(F.lit(prefix), padded, F.lit(suffix)).alias("label"))
