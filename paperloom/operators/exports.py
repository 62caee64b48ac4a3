"""Export forms of pages, tables and summaries.

Bodies are built inside each document's row; write them with the usual DataFrame writers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.functions import text as T


def text_body(pages: Column) -> Column:
    blank = F.lit(T.SPACE_CHARS)
    return F.array_join(F.transform(pages, lambda p: F.rtrim(F.concat(
        F.lit("--- Page "), p["page"].cast("string"), F.lit(" ---\n"), p["text"]), blank)), "\n\n")


def export_text(books: DataFrame, key: str = "doc_id") -> DataFrame:
    return books.select(key, text_body(F.col("pages")).alias("body"))


def is_heading(line: Column) -> Column:
    """A short line without closing punctuation, all in capitals or in title case.

    Title case: a small letter never begins a word, a capital never follows another letter with case.
    """
    cased = line.rlike(r"[\p{Lu}\p{Ll}]")
    upper = ~line.rlike(r"\p{Ll}")
    title = ~line.rlike(r"(?:^|[^\p{Lu}\p{Ll}])\p{Ll}") & ~line.rlike(r"[\p{Lu}\p{Ll}]\p{Lu}")
    return (F.size(T.word_list(line)) <= 9) & ~line.rlike(r"[.,;:]\z") & cased & (upper | title)


def marked_line(line: Column) -> Column:
    return F.when(is_heading(line), F.concat(F.lit("## "), line)).otherwise(line)


def page_lines(books: DataFrame, *keep: str) -> DataFrame:
    """Non-blank lines with their place: keep..., page, line_no, line."""
    pages = books.select(*keep, F.explode("pages").alias("_p"))
    lines = pages.select(*keep, F.col("_p.page").alias("page"), F.posexplode(T.line_list(F.col("_p.text"))).alias("line_no", "line"))
    return lines.withColumn("line", T.strip(F.col("line"))).filter(F.col("line") != "")


def markdown_lines(books: DataFrame, *keep: str) -> DataFrame:
    """Lines as Markdown: headings are inferred, everything else is kept."""
    return page_lines(books, *keep).withColumn("heading", is_heading(F.col("line"))).withColumn("markdown", marked_line(F.col("line")))


def export_markdown(books: DataFrame, key: str = "doc_id") -> DataFrame:
    """One body per document, headings judged by the same rule without leaving the row."""
    def page(p: Column) -> Column:
        lines = F.filter(F.transform(T.line_list(p["text"]), T.strip), lambda x: x != "")
        body = F.transform(lines, lambda x: F.concat(marked_line(x), F.lit("\n")))
        return F.concat(F.array(F.concat(F.lit("\n<!-- page "), p["page"].cast("string"), F.lit(" -->\n"))), body)
    return books.select(key, T.strip(F.array_join(F.flatten(F.transform("pages", page)), "\n")).alias("body"))


def escape_html(text: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def html_body(pages: Column) -> Column:
    def page(p: Column) -> Column:
        lines = F.filter(F.transform(T.line_list(p["text"]), T.strip), lambda x: x != "")
        number = p["page"].cast("string")
        return F.concat(
            F.lit('<section class="page" id="page-'), number, F.lit('"><h2>Page '), number, F.lit("</h2>"),
            F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), escape_html(x), F.lit("</p>"))), ""), F.lit("</section>"))
    return F.array_join(F.transform(pages, page), "")


def export_html(books: DataFrame, key: str = "doc_id") -> DataFrame:
    return books.select(key, F.concat(F.lit(fixed.HTML_HEAD), html_body(F.col("pages")), F.lit("</body></html>")).alias("body"))


def export_json(books: DataFrame, tables: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Nested JSON: page_count and pages with text, words and tables.

    `tables` is a per-document array<struct<page,index,rows>> and joins on its unique key.
    """
    rows = books
    held = F.array().cast("array<struct<page:int,index:int,rows:array<array<string>>>>")
    if tables is not None:
        rows = books.join(tables.select(key, "tables"), key, "left")
        held = F.coalesce("tables", held)
    pages = F.transform("pages", lambda p: F.struct(
        p["page"].alias("page"), p["text"].alias("text"), T.word_list(p["text"]).alias("words"),
        F.transform(F.filter(held, lambda t: t["page"] == p["page"]), lambda t: t["rows"]).alias("tables")))
    return rows.select(key, F.to_json(F.struct(F.size("pages").alias("page_count"), pages.alias("pages"))).alias("body"))


def table_cells(tables: DataFrame, *keep: str) -> DataFrame:
    """Ragged tables (page, index, rows array<array<string>>) as one row per cell, values coerced."""
    rows = tables.select(*keep, "page", "index", F.posexplode("rows").alias("row_no", "_cells"))
    cells = rows.select(*keep, "page", "index", "row_no", F.posexplode("_cells").alias("col_no", "cell"))
    return cells.withColumn("value", coerce_cell(F.col("cell")))


def csv_lines(page: Column, index: Column, rows: Column) -> Column:
    """A table as CSV lines: a heading with page and number, its rows, an empty line."""
    def quote(c: Column) -> Column:
        doubled = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(c.rlike('[,"\r\n]'), doubled).otherwise(c)

    head = F.concat(F.lit("# Page "), page.cast("string"), F.lit(" — table "), index.cast("string"))
    body = F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: quote(F.coalesce(c, F.lit("")))), ","))
    return F.concat(F.array(head), body, F.array(F.lit("")))


def export_tables(tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """CSV lines of each table under a heading line with page and number: key, page, index, line_no, line."""
    lines = csv_lines(F.col("page"), F.col("index"), F.col("rows"))
    return tables.select(key, "page", "index", F.posexplode(lines).alias("line_no", "line"))


def xml_safe(text: Column) -> Column:
    """Text without the characters XML cannot carry."""
    return F.regexp_replace(text, r"[^\t\n\r\x20-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", "")


def coerce_cell(cell: Column) -> Column:
    """A cell as struct<i,d,s>: whole number, decimal number or text."""
    def typed(text: Column) -> Column:
        bare = F.replace(text, F.lit(","), F.lit(""))
        numeric = text.rlike(fixed.CELL_NUMBER.replace("$", r"\n?\z"))
        decimal = F.contains(text, F.lit("."))
        whole = F.when(numeric & ~decimal, bare.try_cast("decimal(38,0)"))
        real = F.when(numeric & decimal, bare.try_cast("double"))
        return F.struct(whole.alias("i"), real.alias("d"), F.when(whole.isNull() & real.isNull(), text).alias("s"))
    return T.let(T.strip(xml_safe(cell)), typed)


def summary_rows(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Section CSV of a summary run."""
    return sections.select(
        key, F.col("idx").alias("section"), T.page_label(F.col("first_page"), F.col("last_page")).alias("pages"),
        F.length("summary").alias("summary_characters"), F.when(F.col("failed"), "Failed").otherwise("Success").alias("status"), "summary")


def export_summary(sections: DataFrame, summaries: DataFrame, mode: str, generated: str, key: str = "doc_id") -> DataFrame:
    """Text report per document. Sections per document are few (its length over the chunk budget)."""
    listed = sections.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        "idx", T.page_label(F.col("first_page"), F.col("last_page")).alias("pages"), "summary"))).alias("_s"))
    bar = "-" * 60
    parts = F.array_join(F.transform("_s", lambda s: F.concat(
        F.lit("\nSection "), s["idx"].cast("string"), F.lit(" ("), s["pages"], F.lit(")\n"), s["summary"])), "\n")
    head = F.concat(
        F.lit("PDF SUMMARY REPORT\n" + "=" * 60 + "\nDocument      : "), F.col(key).cast("string"), F.lit(f"\nSummary type  : {mode}\nPages         : "),
        F.col("page_count").cast("string"), F.lit("\nSections      : "), F.col("section_count").cast("string"),
        F.lit(f"\nModel         : \nGenerated     : {generated}\n\nSUMMARY\n{bar}\n"), F.col("combined"), F.lit(f"\n\nSECTION SUMMARIES\n{bar}\n"))
    return summaries.join(listed, key).select(key, F.concat(head, parts).alias("body"))


def block_types(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Blocks between blank lines: list, heading with level 1-3, or paragraph; keep..., block_no, kind, level, body."""
    def classify(block: Column) -> Column:
        lines = F.transform(F.split(block, "\n", -1), lambda x: F.rtrim(x, F.lit(T.SPACE_CHARS)))

        def judged(ls: Column) -> Column:
            shown = F.filter(ls, lambda x: x != "")
            bullets = F.filter(shown, lambda x: F.substring(F.ltrim(x, F.lit(T.SPACE_CHARS)), 1, 2).isin("- ", "* "))
            marker = F.ltrim(F.get(ls, F.lit(0)), F.lit(T.SPACE_CHARS))
            level = F.length(F.regexp_extract(marker, "^#*", 0))
            title = T.strip(F.regexp_replace(marker, "^#*", ""))
            heading = (level > 0) & (level <= 3) & (title != "")
            rest = T.strip(F.array_join(F.when(heading, F.slice(ls, 2, F.size(ls))).otherwise(ls), "\n"))
            items = F.array_join(F.transform(shown, lambda x: T.strip(F.substr(F.ltrim(x, F.lit(T.SPACE_CHARS)), F.lit(3)))), "\n")

            def made(kind: str, lvl: Column, body: Column) -> Column:
                return F.struct(F.lit(kind).alias("kind"), lvl.cast("int").alias("level"), body.alias("body"))
            none = F.lit(0)
            return F.when((F.size(bullets) > 0) & (F.size(bullets) == F.size(shown)), F.array(made("list", none, items))).otherwise(F.concat(
                F.when(heading, F.array(made("heading", level, title))).otherwise(F.array().cast("array<struct<kind:string,level:int,body:string>>")),
                F.when(rest != "", F.array(made("paragraph", none, rest))).otherwise(F.array().cast("array<struct<kind:string,level:int,body:string>>"))))
        return T.let(lines, judged)

    blocks = F.filter(F.transform(F.split(F.col(text), "\n\n", -1), lambda b: F.regexp_replace(b, r"^\n+|\n+\z", "")), lambda b: ~T.is_blank(b))
    return docs.select(*keep, F.posexplode(F.flatten(F.transform(blocks, classify))).alias("block_no", "_b")).select(
        *keep, "block_no", "_b.kind", "_b.level", "_b.body")


def export_csv(books: DataFrame, tables: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """All tables of a document under each other, each below a line with its page and number: key, body.

    `tables` is a per-document array<struct<page,index,rows>>; a document without tables has an empty body.
    The tables stay in their document's row.
    """
    if tables is None:
        return books.select(key, F.lit("").alias("body"))
    lines = F.flatten(F.transform("tables", lambda t: csv_lines(t["page"], t["index"], t["rows"])))
    held = tables.select(key, F.array_join(lines, "\n").alias("body"))
    return books.select(key).join(held, key, "left").select(key, F.coalesce("body", F.lit("")).alias("body"))


#: What a target is made by, and what of a document it keeps.
EXPORTERS: dict[str, tuple[Callable[..., DataFrame], str]] = {
    "txt": (export_text, "text-only"), "md": (export_markdown, "text-only"), "html": (export_html, "text-only"),
    "json": (export_json, "structural"), "csv": (export_csv, "structural"),
}


def export(books: DataFrame, target: str, tables: DataFrame | None = None) -> DataFrame:
    """Documents in one form: doc_id, target, fidelity, body. Only structural forms take `tables`."""
    if target not in EXPORTERS:
        raise ValueError(f"Unknown target '{target}'. Expected one of: {', '.join(sorted(EXPORTERS))}.")
    make, fidelity = EXPORTERS[target]
    made = make(books, tables) if fidelity == "structural" else make(books)
    return made.select("doc_id", F.lit(target).alias("target"), F.lit(fidelity).alias("fidelity"), "body")


def write_exports(books: DataFrame, targets: list[str], path: str, tables: DataFrame | None = None) -> DataFrame:
    """Write documents in several forms, one folder a target, and read them back. A target's folder is replaced as a whole."""
    for target in targets:
        export(books, target, tables).drop("target").write.mode("overwrite").parquet(f"{path}/target={target}")
    return books.sparkSession.read.parquet(path).filter(F.col("target").isin(targets))
