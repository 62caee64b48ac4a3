"""Paging, file digests, threads, outlines, redaction to a version, batches, exports and as-of versions against plain Python."""

import datetime
import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from paperloom.operators import exports as X
from paperloom.operators import lifecycle as L
from paperloom.operators import model_map as MM
from paperloom.operators import sensitive as D
from paperloom.operators import tenancy as M
from paperloom.operators import versions as V
from paperloom.session import scratch_path
from paperloom.sources import tables as IO

PAGES = "array<struct<page:int,text:string>>"


# ------------------------------------------------------------------ paging

def test_pages_by_key_and_by_place(spark):
    draw = random.Random(1)
    rows = [(i, draw.choice([None, 1, 2, 3]), draw.choice([None, "a", "b"])) for i in range(300)]
    table = spark.createDataFrame(rows, "id int, a int, b string").repartition(7)
    nulls = lambda v, low: (v is not None, v) if low else (v is None, 0 if v is None else -v)
    order = sorted(rows, key=lambda r: (nulls(r[1], False), (r[2] is not None, r[2] or ""), r[0]))
    keys = [("a", True), ("b", False), ("id", False)]
    seen, last = [], None
    while True:
        page = M.page_after(table, keys, 47, last).collect()
        if not page:
            break
        seen += [tuple(r) for r in page]
        last = page[-1].asDict()
    assert seen == order
    for offset in (0, 1, 46, 250, 299, 300, 1000):
        page = M.page_of(table, [F.col("a").desc(), F.col("b"), F.col("id")], 60, offset)
        assert [tuple(r) for r in page.collect()] == order[offset:offset + 60]
    assert {r.total for r in M.with_total(M.page_of(table, [F.col("id")], 5), table).collect()} == {300}
    assert M.page_after(table.limit(0), keys, 5).count() == 0 and M.page_of(table.limit(0), [F.col("id")], 5, 3).count() == 0
    with pytest.raises(ValueError):
        M.page_of(table, [F.col("id")], 0)


# ------------------------------------------------------------------ files

def test_files_of_any_size_are_hashed(spark, tmp_path):
    files = {"empty": b"", "small": b"abc", "even": bytes(range(256)) * 8, "large": random.Random(2).randbytes(5000)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.name: r for r in IO.scan_files(spark, str(tmp_path), range_bytes=1024).collect()}
    del files["empty"]  # Spark's reader lists no empty files
    assert set(got) == set(files)
    for name, data in files.items():
        parts = [data[i:i + 1024] for i in range(0, len(data), 1024)] or [b""]
        assert got[name].content_hash == hashlib.sha256(data).hexdigest() and got[name].length == len(data) and got[name].accepted
        assert got[name].range_hash == hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).hexdigest()
    capped = {r.name: r for r in IO.scan_files(spark, str(tmp_path), max_bytes=3000, range_bytes=1024).collect()}
    assert [n for n, r in capped.items() if not r.accepted] == ["large"] and capped["large"].content_hash is None


# ------------------------------------------------------------------ trees

def plain_threads(rows):
    ids = {(d, i): p for d, i, p in rows}
    out = {}
    for d, i, p in rows:
        if p is None or (d, p) not in ids:
            out[d, i] = (p is None, 0, i)
            continue
        steps, at, seen = 0, i, set()
        while True:
            up = ids[d, at]
            if up is None or (d, up) not in ids:
                out[d, i] = (True, steps, at)
                break
            if at in seen:
                out[d, i] = (False, None, None)
                break
            seen.add(at)
            at, steps = up, steps + 1
    return out


def test_threads_with_cycles(spark):
    draw = random.Random(3)
    rows = [(1, i, None if i == 0 else i - 1) for i in range(60)]
    rows += [(2, 0, 1), (2, 1, 2), (2, 2, 0), (2, 3, 0), (2, 4, 4), (2, 5, None), (2, 6, 5), (2, 7, 99), (2, 8, 7)]
    rows += [(3, i, draw.choice([None, draw.randrange(40)])) for i in range(40)]
    rows += [(None, 1, None), (None, 2, 1), (None, 3, 7)]
    table = spark.createDataFrame(rows, "doc int, id int, parent_id int")
    got = {(r.doc, r.id): (r.valid, r.depth, r.root) for r in L.thread_depths(table).collect()}
    assert got == plain_threads(rows)
    assert L.thread_depths(table.limit(0)).count() == 0


def plain_outline(depths):
    out = []
    for i, d in enumerate(depths):
        parent = None
        for j in range(i - 1, -1, -1) if d > 0 else []:
            if depths[j] == d - 1:
                parent = j
                break
            if depths[j] < d - 1:
                break
        out.append(parent)
    return out


def test_outlines(spark):
    draw = random.Random(4)
    cases = [[draw.randint(0, 4) for _ in range(draw.randint(0, 30))] for _ in range(40)] + [[0, 3, 1, 2, 2, 0, 1], [5, 4, 3], []]
    table = spark.createDataFrame([(n, [(d, "t") for d in c]) for n, c in enumerate(cases)], "n int, e array<struct<depth:int,title:string>>")
    got = {r.n: r.p for r in table.select("n", L.nest_outline(F.col("e")).alias("p")).collect()}
    assert got == {n: plain_outline(c) for n, c in enumerate(cases)}


def test_a_long_outline_takes_seconds(spark):
    draw = random.Random(5)
    depths = [draw.randint(0, 6) for _ in range(10_000)]
    table = spark.createDataFrame([(1, [(d, "t") for d in depths])], "n int, e array<struct<depth:int,title:string>>")
    started = time.perf_counter()
    got = table.select(L.nest_outline(F.col("e")).alias("p")).collect()[0].p
    assert time.perf_counter() - started < 20
    assert got[:2000] == plain_outline(depths[:2000])


# ------------------------------------------------------------------ redaction

def test_redaction_appends_versions(spark):
    books = spark.createDataFrame([
        (1, [(1, "Mail a@example.com or b@example.com."), (2, "IP 10.0.0.1 and a@example.com")]), (2, [(1, "nothing")]), (3, [(1, "call 10.0.0.2")]),
        (None, [(1, "x@example.com")]), (4, [(None, "y@example.com"), (1, None)]), (5, [])], f"doc_id int, pages {PAGES}")
    stored = spark.createDataFrame([(1, 1), (1, 4), (2, 1), (None, 2), (4, 1)], "doc_id int, version long")
    decisions = spark.createDataFrame([(1, 1, 5, "email", True), (1, 2, 3, "ip_address", True), (1, 2, 16, "email", False), (3, 1, 5, "ip_address", True),
                                       (None, 1, 0, "email", True), (4, None, 0, "email", True), (9, 1, 0, "email", True), (1, 1, 22, "email", None)],
                                      "doc_id int, page int, start int, kind string, approved boolean")
    appended, refused, reviewed = D.redact_versions(books, stored, decisions)
    got = {r.doc_id: r for r in appended.collect()}
    assert set(got) == {1, None, 4} and {r.doc_id for r in refused.collect()} == {3}
    assert got[1].version == 5 and got[1].hit_count == 2 and got[None].version == 3 and got[4].version == 2
    assert [p.text for p in got[1].pages] == ["Mail " + " " * 13 + " or b@example.com.", "IP " + " " * 8 + " and a@example.com"]
    assert got[1].content_hash == hashlib.sha256("\f".join(p.text for p in got[1].pages).encode()).hexdigest()
    assert got[4].pages[0].text == " " * 13
    seen = {(r.doc_id, r.page, r.start): r.approved for r in reviewed.collect()}
    assert seen == {(1, 1, 5): True, (1, 1, 22): False, (1, 2, 3): True, (1, 2, 16): False, (3, 1, 5): True, (None, 1, 0): True, (4, None, 0): True}
    empty = D.redact_versions(books.limit(0), stored, decisions)
    assert [t.count() for t in empty] == [0, 0, 0]


# ------------------------------------------------------------------ batches

def test_each_missing_key_is_processed_once(spark):
    now = datetime.datetime(2024, 1, 2)
    docs = spark.createDataFrame([(i, f"h{i % 4}" if i % 9 else None, f"text {i % 4}") for i in range(60)], "doc_id int, content_hash string, text string")
    cache = spark.createDataFrame([("h1", "kept", now), ("h1", "older", now - datetime.timedelta(hours=3)), ("h2", "stale", now - datetime.timedelta(days=3))], "content_hash string, result string, created_at timestamp")
    calls = spark.sparkContext.accumulator(0)

    def model(system, user):
        calls.add(1)
        return user.upper(), 1

    def work(misses):
        return MM.model_map(misses.withColumn("prompt", F.col("text")), model).withColumn("result", F.col("reply"))
    got = MM.process_batch(docs, cache, ["content_hash"], F.lit(now), work).collect()
    assert len(got) == 60 and calls.value == 4  # h0, h2, h3 and the null key
    assert all((r.source, r.result) == ("cache", "kept") for r in got if r.content_hash == "h1")
    assert all(r.source == "processed" and r.result == r.text.upper() for r in got if r.content_hash in ("h0", "h2", "h3"))
    assert len({r.result for r in got if r.content_hash is None}) == 1


def test_documents_without_text_come_back(spark):
    books = spark.createDataFrame([(1, [(1, "Some text.")]), (2, [(1, " ")]), (3, [])], f"doc_id int, pages {PAGES}")
    got = {r.doc_id: r for r in MM.analyse(books, model=lambda s, u: ('{"document_type": "note"}', 1)).collect()}
    assert got[1].document_type == "note" and not got[1].parse_error and got[1].reason is None
    assert got[2].parse_error and got[3].parse_error and "no text" in got[2].reason and got[3].pages_used == 0


# ------------------------------------------------------------------ exports

def test_exports_declare_their_fidelity(spark):
    books = spark.createDataFrame([(1, [(1, "a b\nc")]), (2, [(1, "x")])], f"doc_id int, pages {PAGES}")
    tables = spark.createDataFrame([(1, [(1, 1, [["a", "b,c"], ["d", 'e"f', None]]), (2, 1, [])])], "doc_id int, tables array<struct<page:int,index:int,rows:array<array<string>>>>")
    bodies = {r.doc_id: r for r in X.export(books, "csv", tables).collect()}
    assert bodies[1].body == '# Page 1 — table 1\na,"b,c"\nd,"e""f",\n\n# Page 2 — table 1\n' and bodies[2].body == "" and bodies[1].fidelity == "structural"
    path = scratch_path(spark, "exports")
    written = X.write_exports(books, ["csv", "txt", "json", "md", "html"], path, tables)
    assert {(r.target, r.fidelity) for r in written.collect()} == {("csv", "structural"), ("txt", "text-only"), ("json", "structural"), ("md", "text-only"), ("html", "text-only")}
    assert written.count() == 10 and X.write_exports(books.limit(1), ["txt"], path).count() == 1
    with pytest.raises(ValueError, match="Unknown target"):
        X.export(books, "docx")


# ------------------------------------------------------------------ versions

def test_versions_as_of_a_time(spark):
    start = datetime.datetime(2024, 1, 1)
    hour = datetime.timedelta(hours=1)
    rows = [("a", n + 1, start + n * hour) for n in range(50)] + [("b", 1, start), (None, 1, start + hour)]
    asked = [("a", start - hour), ("a", start), ("a", start + 10.5 * hour), ("a", start + 900 * hour), ("b", start + hour), ("c", start), (None, start + hour), (None, start), ("a", start)]
    versions = spark.createDataFrame(rows, "doc string, version long, created_at timestamp")
    wanted = spark.createDataFrame(asked, "doc string, at timestamp")
    want = {(d, t): max((v for e, v, c in rows if e == d and c <= t), default=None) for d, t in asked}
    for bits in (40, 30):
        assert {(r.doc, r.at): r.version for r in V.as_of(versions, wanted, bits=bits).collect()} == want
    found, refused = V.version_at(versions, spark.createDataFrame([("a", 3), ("a", 99), ("z", 1), (None, 1), ("b", None)], "doc string, version long"))
    assert {(r.doc, r.version) for r in found.collect()} == {("a", 3), (None, 1)}
    assert {(r.doc, r.version) for r in refused.collect()} == {("a", 99), ("z", 1), ("b", None)}
