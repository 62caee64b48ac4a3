"""Versions, caches, tenancy, signing, jobs and logs over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fixed, scale
from paperloom.functions import text as T
from paperloom.operators import lifecycle as L
from paperloom.operators import tenancy as M
from paperloom.operators import versions as V
from paperloom.plans.registry import query
from paperloom.plans.sqlparts import quoted
from paperloom.sources.tables import load


def choose(values, index):
    """values[index % len(values)] as a column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def choose_sql(values, index):
    return f"list_extract([{quoted(values)}], CAST(({index}) % {len(values)} AS INTEGER) + 1)"


# ------------------------------------------------------------------ versions
# The lineage of a document is its source; later ids are later versions.

VERSIONS_SQL = """
versions AS (
  SELECT source AS doc, doc_id AS seq, sha256(text) AS content_hash, strlen(text) AS size_bytes,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version FROM documents
)"""


def raw_versions(spark, folder):
    return load(spark, folder, "documents").select(
        F.col("source").alias("doc"), F.col("doc_id").alias("seq"),
        F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").alias("size_bytes"))


def versions(spark, folder):
    return V.number_versions(raw_versions(spark, folder))


@query("WITH " + VERSIONS_SQL + " SELECT doc, seq, version FROM versions")
def numbered_versions(spark, folder):
    return versions(spark, folder).select("doc", "seq", "version")


@query("WITH old AS (SELECT source, count(*) AS top FROM documents WHERE doc_id % 3 <> 0 GROUP BY source)" + """
SELECT source AS doc, doc_id AS seq, coalesce(top, 0) + row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version
FROM documents LEFT JOIN old USING (source) WHERE doc_id % 3 = 0""")
def appended_versions(spark, folder):
    rows = raw_versions(spark, folder)
    existing = V.number_versions(rows.filter(F.col("seq") % 3 != 0))
    return V.number_versions(rows.filter(F.col("seq") % 3 == 0), existing=existing).select("doc", "seq", "version")


@query("SELECT source AS doc, count(*) AS versions, count(*) AS latest FROM documents GROUP BY source")
def version_totals(spark, folder):
    return V.version_counts(versions(spark, folder))


@query("WITH " + VERSIONS_SQL + " SELECT doc, seq, content_hash, version FROM versions QUALIFY row_number() OVER (PARTITION BY doc ORDER BY version DESC) = 1")
def latest_versions(spark, folder):
    return V.latest(versions(spark, folder)).select("doc", "seq", "content_hash", "version")


# Versions are created an hour apart; asked for are every third document's number, two beyond the last, and times around.
DATED_SQL = VERSIONS_SQL + """,
dated AS (SELECT *, TIMESTAMP '2024-01-01' + to_hours(CAST(seq AS INTEGER)) AS created_at FROM versions)"""


def dated(spark, folder):
    return versions(spark, folder).withColumn("created_at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("seq").cast("int")))


@query("WITH " + DATED_SQL + """,
asked AS (SELECT DISTINCT source AS doc, doc_id % 7 * 3 AS version FROM documents)
SELECT doc, version, seq, content_hash, CASE WHEN seq IS NULL THEN 'There is no version ' || version || ' of this document.' END AS reason FROM asked LEFT JOIN versions USING (doc, version)""")
def given_versions(spark, folder):
    asked = load(spark, folder, "documents").select(F.col("source").alias("doc"), (F.col("doc_id") % 7 * 3).alias("version"))
    found, refused = V.version_at(versions(spark, folder), asked)
    return found.select("doc", "version", "seq", "content_hash", F.lit(None).cast("string").alias("reason")).unionByName(
        refused.select("doc", "version", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("content_hash"), "reason"))


@query("WITH " + DATED_SQL + """,
asked AS (SELECT DISTINCT source AS doc, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 37 - 600 AS INTEGER)) AS moment FROM documents)
SELECT doc, epoch_us(moment) AS at_us, (SELECT max(version) FROM dated d WHERE d.doc = a.doc AND d.created_at <= a.moment) AS version FROM asked a""")
def versions_as_of(spark, folder):
    asked = load(spark, folder, "documents").select(F.col("source").alias("doc"), (
        F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("doc_id") * 37 - 600).cast("int"))).alias("at"))
    return V.as_of(dated(spark, folder), asked).select("doc", F.unix_micros("at").alias("at_us"), "version")


@query("WITH " + VERSIONS_SQL + " SELECT doc, version, version = max(version) OVER (PARTITION BY doc) AS current, content_hash[1:16] AS short_hash FROM versions")
def version_history(spark, folder):
    return V.history(versions(spark, folder)).select("doc", "version", "current", "short_hash")


@query("WITH " + VERSIONS_SQL + """
SELECT doc, seq, version, min(version) OVER w AS first_version, version > min(version) OVER w AS reused
FROM versions WINDOW w AS (PARTITION BY doc, content_hash)""")
def reused_content(spark, folder):
    return V.mark_reuse(versions(spark, folder)).select("doc", "seq", "version", "first_version", "reused")


@query("WITH " + VERSIONS_SQL + """,
asked AS (SELECT doc, max(version) AS latest, CASE max(version) % 3 WHEN 0 THEN max(version) WHEN 1 THEN 1 ELSE max(version) + 5 END AS wanted FROM versions GROUP BY doc)
SELECT a.doc, CASE WHEN wanted = latest OR content_hash IS NULL THEN wanted ELSE latest + 1 END AS version,
  CASE WHEN wanted = latest THEN NULL ELSE content_hash END AS content_hash,
  CASE WHEN wanted = latest THEN 'Version ' || wanted || ' is already the current version.'
       WHEN content_hash IS NULL THEN 'Version ' || wanted || ' does not exist.' ELSE 'restored-v' || wanted END AS note
FROM asked a LEFT JOIN versions v ON v.doc = a.doc AND v.version = wanted""")
def restored_versions(spark, folder):
    stored = versions(spark, folder)
    latest = F.col("latest")
    requests = V.version_counts(stored).select("doc", F.when(latest % 3 == 0, latest).when(latest % 3 == 1, 1).otherwise(latest + 5).alias("version"))
    appended, refused = V.restore(stored, requests)
    return appended.select("doc", "version", "content_hash", F.col("label").alias("note")).unionByName(
        refused.select("doc", "version", F.lit(None).cast("string").alias("content_hash"), F.col("reason").alias("note")))


@query("WITH " + VERSIONS_SQL + """,
l AS (SELECT *, lag(size_bytes) OVER (PARTITION BY doc ORDER BY version) AS before FROM versions)
SELECT doc, version, before AS before_size_bytes,
  CASE WHEN before > 0 THEN greatest(0.0::DOUBLE, (before - size_bytes) * 100.0::DOUBLE / before) ELSE 0.0 END AS percent_saved FROM l""")
def size_changes(spark, folder):
    return V.size_change(versions(spark, folder)).select("doc", "version", "before_size_bytes", "percent_saved")


@query("SELECT lang, sha256(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_holder FROM documents GROUP BY ALL HAVING count(*) > 1")
def duplicate_content(spark, folder):
    return V.exact_duplicates(load(spark, folder, "documents"), "lang", "text", "doc_id")


@query("""SELECT doc_id, md5(source || '_' || sha256(text) || '_' || lang) AS cache_key, k AS storage_key,
  regexp_full_match(k, '[a-z0-9]+(?:/[a-zA-Z0-9._-]+)+') AS valid FROM (
  SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'S' ELSE 's' END || doc_id % 9 || '/' || doc_id || '/v' || doc_id % 4 || '-' ||
    CASE WHEN doc_id % 3 = 0 THEN 'file' ELSE 'ocr-' || lang END AS k FROM documents)""")
def stored_keys(spark, folder):
    i = F.col("doc_id")
    docs = load(spark, folder, "documents")
    workspace = F.concat(F.when(i % 5 == 0, "S").otherwise("s"), (i % 9).cast("string"))
    kind = F.when(i % 3 == 0, "!?").otherwise(F.concat(F.lit("ocr-*"), "lang"))
    return docs.select(
        "doc_id", V.cache_key(F.col("source"), F.sha2(F.col("text").cast("binary"), 256), F.col("lang")).alias("cache_key"),
        V.storage_key(workspace, i, i % 4, kind).alias("storage_key")).withColumn("valid", V.storage_key_ok(F.col("storage_key")))


@query("SELECT source || '/' || doc_id AS key FROM documents WHERE source <> 'src1'")
def dropped_prefix(spark, folder):
    keys = load(spark, folder, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"))
    return V.drop_prefix(keys, "/src1/")


@query("""SELECT l_orderkey AS doc_id, l_partkey AS part, l_quantity AS score FROM lineitem WHERE l_orderkey % 5 <> 0
UNION ALL SELECT l_orderkey, l_partkey, l_quantity + 100 FROM lineitem WHERE l_orderkey % 5 = 0 AND l_quantity > 30""")
def replaced_rows(spark, folder):
    target = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("score"))
    scanned = target.filter(F.col("doc_id") % 5 == 0)
    fresh = scanned.filter(F.col("score") > 30).withColumn("score", F.col("score") + 100)
    return V.replace_rows(target, fresh, ["doc_id"], replaced=scanned)


@query("""
WITH p AS (
  SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 2 = 0) AS seg, arg_max(o_totalprice, o_orderkey) FILTER (o_orderkey % 3 = 0) AS bal
  FROM orders GROUP BY o_custkey)
SELECT c_custkey, c_name, coalesce(bal, c_acctbal) AS c_acctbal, coalesce(seg, c_mktsegment) AS c_mktsegment
FROM customer LEFT JOIN p ON o_custkey = c_custkey""")
def patched_rows(spark, folder):
    target = load(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    patches = load(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("c_mktsegment"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("c_acctbal"))
    return V.apply_patches(target, patches, "c_custkey", "seq")


CACHE_SQL = """
cache AS (SELECT sha256(text) AS content_hash, 'k' || doc_id % 3 AS kind, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 120 AS INTEGER)) AS created_at FROM documents WHERE doc_id % 2 = 0),
live AS (SELECT * FROM cache WHERE created_at + INTERVAL 24 HOUR >= TIMESTAMP '2024-01-05')"""


def cached(spark, folder):
    docs = load(spark, folder, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
                                                    F.concat(F.lit("k"), (F.col("doc_id") % 3).cast("string")).alias("kind"))
    cache = docs.filter(F.col("doc_id") % 2 == 0).withColumn(
        "created_at", F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 120).cast("int"))).drop("doc_id")
    return docs, cache, F.lit("2024-01-05").cast("timestamp")


@query("WITH " + CACHE_SQL + """
SELECT doc_id, 'k' || doc_id % 3 AS kind FROM documents d WHERE NOT EXISTS (
  SELECT 1 FROM live WHERE live.content_hash = sha256(d.text) AND live.kind = 'k' || d.doc_id % 3)""")
def cache_misses(spark, folder):
    docs, cache, now = cached(spark, folder)
    return V.cache_misses(docs, cache, ["content_hash", "kind"], now).select("doc_id", "kind")


@query("WITH " + CACHE_SQL + " SELECT kind, count(*) AS live FROM live GROUP BY kind")
def live_cache(spark, folder):
    _, cache, now = cached(spark, folder)
    return V.live_cache(cache, now).groupBy("kind").agg(F.count(F.lit(1)).alias("live"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'pages' ELSE '' END AS unknown, CASE WHEN p_partkey % 7 <> 0 THEN
  'author=' || p_brand || CASE WHEN p_partkey % 2 = 0 THEN ';keywords=' || p_type ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ';title=' || p_name END END AS merged
FROM part""")
def merged_metadata(spark, folder):
    i = F.col("p_partkey")
    parts = load(spark, folder, "part").select(
        "p_partkey", F.create_map(F.lit("title"), F.col("p_name"), F.lit("author"), F.col("p_brand")).alias("metadata"),
        F.map_from_entries(F.array_compact(F.array(
            F.when(i % 3 == 0, F.struct(F.lit("title").alias("k"), F.lit("").alias("v"))),
            F.when(i % 2 == 0, F.struct(F.lit("keywords").alias("k"), F.col("p_type").alias("v"))),
            F.when(i % 7 == 0, F.struct(F.lit("pages").alias("k"), F.lit("9").alias("v")))))).alias("changes"))
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("merged")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return V.merge_metadata(parts).select("p_partkey", "unknown", shown.alias("merged"))


# ------------------------------------------------------------------ tenancy

ROLES = ["owner", "admin", "member", "viewer"]
MEMBERS_SQL = f"""
members AS (
  SELECT c_nationkey AS workspace_id, c_custkey AS user_id, {choose_sql(ROLES, 'c_custkey')} AS role FROM customer
  UNION ALL SELECT (c_nationkey + 7) % 25, c_custkey, 'viewer' FROM customer WHERE c_custkey % 3 = 0
),
items AS (SELECT o_orderkey AS item_id, o_orderkey % 25 AS workspace_id, o_orderpriority || '_' || o_orderkey AS name, o_orderstatus = 'P' AS archived, o_orderdate AS created_at FROM orders)"""


def members(spark, folder):
    people = load(spark, folder, "customer").select("c_nationkey", "c_custkey")
    first = people.select(F.col("c_nationkey").alias("workspace_id"), F.col("c_custkey").alias("user_id"), choose(ROLES, F.col("c_custkey")).alias("role"))
    second = people.filter(F.col("c_custkey") % 3 == 0).select(
        ((F.col("c_nationkey") + 7) % 25).alias("workspace_id"), F.col("c_custkey").alias("user_id"), F.lit("viewer").alias("role"))
    return first.unionByName(second)


def items(spark, folder):
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 25).alias("workspace_id"),
        F.concat_ws("_", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("name"),
        (F.col("o_orderstatus") == "P").alias("archived"), F.col("o_orderdate").alias("created_at"))


@query("WITH " + MEMBERS_SQL + " SELECT item_id, workspace_id FROM items WHERE workspace_id IN (SELECT workspace_id FROM members WHERE user_id = 9)")
def visible_items(spark, folder):
    return M.visible(items(spark, folder), members(spark, folder), 9).select("item_id", "workspace_id")


@query("WITH " + MEMBERS_SQL + " SELECT n_nationkey AS workspace_id, n_name AS name, role FROM nation JOIN members ON workspace_id = n_nationkey WHERE user_id = 9")
def my_workspaces(spark, folder):
    spaces = load(spark, folder, "nation").select(F.col("n_nationkey").alias("workspace_id"), F.col("n_name").alias("name"))
    return M.my_workspaces(spaces, members(spark, folder), 9).select("workspace_id", "name", "role")


@query("WITH " + MEMBERS_SQL + " SELECT user_id, c_name AS name, role FROM members JOIN customer ON c_custkey = user_id WHERE workspace_id = 3")
def workspace_members(spark, folder):
    users = load(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return M.workspace_members(members(spark, folder), users, 3).select("user_id", "name", "role")


NEEDS = ["read", "write", "manage"]


@query("WITH " + MEMBERS_SQL + f""",
requests AS (SELECT event_id AS request_id, user_id, (event_id * 25 + c_nationkey) % 1400 AS item_id, {choose_sql(NEEDS, 'event_id')} AS need FROM events JOIN customer ON c_custkey = user_id)
SELECT request_id, CASE WHEN role IS NULL THEN 'not_found'
  WHEN need = 'write' AND role NOT IN ('owner', 'admin', 'member') OR need = 'manage' AND role NOT IN ('owner', 'admin') THEN 'forbidden' ELSE 'allowed' END AS outcome
FROM requests r LEFT JOIN items i USING (item_id) LEFT JOIN members m ON m.workspace_id = i.workspace_id AND m.user_id = r.user_id""")
def authorised(spark, folder):
    users = load(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    requests = load(spark, folder, "events").select("event_id", "user_id").join(users, "user_id").select(
        F.col("event_id").alias("request_id"), "user_id", ((F.col("event_id") * 25 + F.col("c_nationkey")) % 1400).alias("item_id"),
        choose(NEEDS, F.col("event_id")).alias("need"))
    return M.authorise(requests, items(spark, folder), members(spark, folder)).select("request_id", "outcome")


@query("WITH " + MEMBERS_SQL + """,
requests AS (
  SELECT l_orderkey AS request_id, c_custkey AS user_id,
    (l_partkey // 25) * 25 + CASE WHEN l_linenumber % 5 = 0 THEN (c_nationkey + 7) % 25 WHEN l_linenumber % 7 = 3 THEN 1 ELSE c_nationkey END AS item_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey)
SELECT request_id, bool_and(role IS NOT NULL) AS all_visible, min(i.workspace_id) = max(i.workspace_id) AS one_workspace, count(*) AS items,
  bool_and(role IS NOT NULL) AND coalesce(min(i.workspace_id) = max(i.workspace_id), false) AS accepted
FROM requests r LEFT JOIN items i USING (item_id) LEFT JOIN members m ON m.workspace_id = i.workspace_id AND m.user_id = r.user_id GROUP BY request_id""")
def authorised_sets(spark, folder):
    users = load(spark, folder, "customer").select("c_custkey", "c_nationkey")
    orders = load(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = load(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    home = F.when(F.col("l_linenumber") % 5 == 0, (F.col("c_nationkey") + 7) % 25).when(F.col("l_linenumber") % 7 == 3, 1).otherwise(F.col("c_nationkey"))
    requests = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).join(users, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("l_orderkey").alias("request_id"), F.col("c_custkey").alias("user_id"), (F.floor(F.col("l_partkey") / 25) * 25 + home).alias("item_id"))
    return M.authorise_all(requests, items(spark, folder), members(spark, folder))


CHANGES_SQL = MEMBERS_SQL + """,
changes AS (
  SELECT min(o_orderkey) AS change_id, CASE WHEN c_custkey % 4 = 0 AND c_nationkey % 5 = 0 OR c_custkey % 6 = 1 THEN 'remove' ELSE 'add' END AS action,
    CASE WHEN c_custkey % 4 = 0 AND c_nationkey % 5 = 0 OR c_custkey % 5 > 1 THEN c_nationkey ELSE (c_nationkey + 1) % 25 END AS workspace_id,
    CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 17 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS user_id, 'member' AS role
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey, c_nationkey
),
judged AS (
  SELECT c.*, CASE WHEN action = 'add' AND c_custkey IS NULL THEN 'no such user' WHEN action = 'add' AND m.role IS NOT NULL THEN 'already a member'
    WHEN action = 'remove' AND m.role IS NULL THEN 'not a member'
    WHEN action = 'remove' AND m.role = 'owner' AND (SELECT count(*) FROM members o WHERE o.workspace_id = c.workspace_id AND o.role = 'owner')
      <= count(*) FILTER (action = 'remove' AND m.role = 'owner') OVER (PARTITION BY c.workspace_id)
      AND change_id = max(CASE WHEN action = 'remove' AND m.role = 'owner' THEN change_id END) OVER (PARTITION BY c.workspace_id) THEN 'last owner' ELSE 'applied' END AS outcome
  FROM changes c LEFT JOIN customer ON c_custkey = c.user_id LEFT JOIN members m ON m.workspace_id = c.workspace_id AND m.user_id = c.user_id
)"""


def membership_batch(spark, folder):
    people = load(spark, folder, "customer").select("c_custkey", "c_nationkey")
    first = load(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("change_id"))
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    leaving = (c % 4 == 0) & (n % 5 == 0)
    changes = people.join(first, c == F.col("o_custkey")).select(
        "change_id", F.when(leaving | (c % 6 == 1), "remove").otherwise("add").alias("action"),
        F.when(leaving | (c % 5 > 1), n).otherwise((n + 1) % 25).alias("workspace_id"),
        F.when((c % 4 != 0) & (c % 17 == 0), c + 1000000000).otherwise(c).alias("user_id"), F.lit("member").alias("role"))
    return M.apply_memberships(members(spark, folder), changes, people.select(c.alias("user_id")))


@query("WITH " + CHANGES_SQL + " SELECT change_id, outcome FROM judged")
def membership_outcomes(spark, folder):
    return membership_batch(spark, folder)[1]


@query("WITH " + CHANGES_SQL + """
SELECT workspace_id, user_id, role FROM members m WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.outcome = 'applied' AND action = 'remove' AND j.workspace_id = m.workspace_id AND j.user_id = m.user_id)
UNION ALL SELECT workspace_id, user_id, role FROM judged WHERE outcome = 'applied' AND action = 'add'""")
def membership_snapshot(spark, folder):
    return membership_batch(spark, folder)[0]


@query("WITH " + MEMBERS_SQL + " SELECT item_id, name FROM items WHERE workspace_id = 3 AND NOT archived AND name ILIKE '%-h%_1%'")
def library_listing(spark, folder):
    return M.list_items(items(spark, folder), 3, "-h%_1").select("item_id", "name")


@query("WITH " + MEMBERS_SQL + " SELECT item_id, strftime(created_at, '%Y-%m-%d') AS day FROM items WHERE workspace_id = 3 ORDER BY created_at DESC, item_id LIMIT 20 OFFSET 20")
def library_page(spark, folder):
    found = M.list_items(items(spark, folder), 3, include_archived=True)
    return M.page_of(found, [F.col("created_at").desc(), F.col("item_id")], 20, 20).select("item_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"))


@query("WITH " + MEMBERS_SQL + " SELECT workspace_id, count(*) AS total FROM items WHERE NOT archived GROUP BY workspace_id")
def library_totals(spark, folder):
    return M.workspace_totals(items(spark, folder))


@query("WITH " + MEMBERS_SQL + """, l AS (SELECT item_id, created_at FROM items WHERE workspace_id = 3)
SELECT item_id, strftime(created_at, '%Y-%m-%d') AS day, (SELECT count(*) FROM l) AS total FROM l ORDER BY created_at DESC, item_id LIMIT 250 OFFSET 20""")
def library_page_after(spark, folder):
    """The page behind the twentieth item, found by that item's key."""
    found = M.list_items(items(spark, folder), 3, include_archived=True).select("item_id", "created_at")
    keys = [("created_at", True), ("item_id", False)]
    seen = M.page_after(found, keys, 20).collect()
    page = M.page_after(found, keys, 250, seen[-1].asDict() if len(seen) == 20 else None)
    return M.with_total(page, found).select("item_id", F.date_format("created_at", "yyyy-MM-dd").alias("day"), "total")


@query("SELECT s_suppkey AS asset_id, s_name AS name FROM supplier WHERE s_nationkey = 4")
def own_assets(spark, folder):
    assets = load(spark, folder, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("user_id"))
    return M.own_assets(assets, 4).select("asset_id", "name")


@query("SELECT conv_id, turn FROM conversations WHERE turn = 2 AND role = 'user' AND NOT conv_id % 4 = 0")
def annotation_listing(spark, folder):
    notes = load(spark, folder, "conversations").select("conv_id", "turn", F.col("turn").alias("page"), F.col("role").alias("kind"), (F.col("conv_id") % 4 == 0).alias("resolved"))
    return M.list_annotations(notes, page=2, kind="user", include_resolved=False).select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM conversations ORDER BY turn, conv_id, role")
def annotations_in_order(spark, folder):
    return M.in_order(load(spark, folder, "conversations"), "turn", "conv_id", "role").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, length(text) AS characters FROM conversations WHERE turn >= 1 AND turn < 3")
def page_slice(spark, folder):
    return M.page_slice(load(spark, folder, "conversations"), "turn", 1, 3).select("conv_id", "turn", F.length("text").alias("characters"))


# ------------------------------------------------------------------ jobs and logs

JOBS_SQL = f"""
jobs AS (
  SELECT event_id AS job_id, user_id % 25 AS workspace_id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'completed'
    WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS state, event_id % 5 AS attempts, 3 AS max_attempts, ts AS locked_at FROM events
)"""


def jobs(spark, folder):
    kind = F.col("event_type")
    return load(spark, folder, "events").select(
        F.col("event_id").alias("job_id"), (F.col("user_id") % 25).alias("workspace_id"),
        F.when(kind == "view", "queued").when(kind == "click", "processing").when(kind == "purchase", "completed")
        .when(kind == "error", "failed").otherwise("cancelled").alias("state"),
        (F.col("event_id") % 5).alias("attempts"), F.lit(3).alias("max_attempts"), F.col("ts").alias("locked_at"))


@query("WITH " + JOBS_SQL + " SELECT job_id FROM jobs WHERE workspace_id = 3 AND state = 'failed'")
def job_listing(spark, folder):
    return M.list_jobs(jobs(spark, folder), 3, "failed").select("job_id")


@query("WITH " + JOBS_SQL + " SELECT workspace_id, state, count(*) AS jobs FROM jobs GROUP BY ALL")
def job_states(spark, folder):
    return L.state_counts(jobs(spark, folder), "workspace_id")


@query("WITH " + JOBS_SQL + """
SELECT job_id, attempts, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS next_state
FROM jobs WHERE state = 'processing' AND locked_at < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 900 SECOND""")
def stalled_jobs(spark, folder):
    return L.stalled(jobs(spark, folder), F.lit("2024-01-15 12:00:00").cast("timestamp")).select("job_id", "attempts", "next_state")


@query("WITH " + JOBS_SQL + """,
r AS (SELECT o_orderkey AS request_id, o_orderkey * 3 AS job_id, CASE WHEN o_orderkey % 2 = 0 THEN 'retry' ELSE 'cancel' END AS action FROM orders),
d AS (SELECT request_id, CASE WHEN state IS NULL THEN 'not found'
  WHEN action = 'retry' AND state NOT IN ('failed', 'cancelled') THEN 'Only failed or cancelled jobs can be retried (state is ' || state || ')'
  WHEN action = 'cancel' AND state IN ('completed', 'failed', 'cancelled') THEN 'Job is already ' || state END AS reason FROM r LEFT JOIN jobs USING (job_id))
SELECT request_id, reason, reason IS NULL AS accepted FROM d""")
def job_requests(spark, folder):
    k = F.col("o_orderkey")
    requests = load(spark, folder, "orders").select(k.alias("request_id"), (k * 3).alias("job_id"), F.when(k % 2 == 0, "retry").otherwise("cancel").alias("action"))
    return L.eligible(requests, jobs(spark, folder)).select("request_id", "reason", "accepted")


@query("""SELECT user_id % 25 AS workspace_id, event_type AS operation, CASE WHEN event_id % 3 = 0 THEN 'tokens' ELSE 'pages' END AS unit_kind,
  sum(CAST(round(value * 100) AS BIGINT)) AS units, count(*) AS records FROM events GROUP BY ALL""")
def usage_totals(spark, folder):
    usage = load(spark, folder, "events").select(
        (F.col("user_id") % 25).alias("workspace_id"), F.col("event_type").alias("operation"),
        F.when(F.col("event_id") % 3 == 0, "tokens").otherwise("pages").alias("unit_kind"), F.round(F.col("value") * 100).cast("long").alias("units"))
    return L.usage_totals(usage, ["workspace_id", "operation", "unit_kind"])


@query("SELECT event_type AS action, CASE WHEN value > 5 THEN 'ok' ELSE 'denied' END AS result, count(*) AS entries FROM events GROUP BY ALL")
def audit_totals(spark, folder):
    return L.audit_counts(load(spark, folder, "events").select(F.col("event_type").alias("action"), F.when(F.col("value") > 5, "ok").otherwise("denied").alias("result")))


@query("SELECT conv_id, turn, nullif(text[1:500], '') AS detail FROM conversations")
def audit_details(spark, folder):
    return load(spark, folder, "conversations").select("conv_id", "turn", L.audit_detail(F.col("text")).alias("detail"))


@query("""SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error')::DOUBLE / count(*) * 100 AS success_rate,
  sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / count(*) / 100 AS mean_seconds, count(DISTINCT event_type) AS summary_types FROM events GROUP BY user_id""")
def run_statistics(spark, folder):
    runs = load(spark, folder, "events").select("user_id", F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
                                                 F.round(F.col("value") * 100).cast("long").alias("cents"), F.col("event_type").alias("summary_type"))
    return L.run_stats(runs, "user_id")


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER) AS rank FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 50""")
def recent_runs(spark, folder):
    return L.last_n(load(spark, folder, "events").select("user_id", "event_id", "ts"), "user_id", [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_id", "rank")


@query("""SELECT user_id AS batch_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
  count(*) FILTER (event_type = 'view') AS from_cache FROM events GROUP BY user_id""")
def batch_outcomes(spark, folder):
    kind = F.col("event_type")
    results = load(spark, folder, "events").select(F.col("user_id").alias("batch_id"), F.when(kind == "error", "failed").alias("error"),
                                                    F.when(kind == "view", "cache").otherwise("processed").alias("source"))
    return L.batch_outcome(results)


# ------------------------------------------------------------------ signing
# A customer's orders stand for the recipients of one request.

SIGNERS_SQL = """
signers AS (
  SELECT o_custkey AS request_id, o_orderkey AS recipient, o_orderkey % 7 AS ord, o_custkey % 2 = 0 AS sequential,
    CASE o_orderstatus WHEN 'F' THEN 'signed' WHEN 'P' THEN 'declined' ELSE 'pending' END AS state FROM orders
),
turned AS (
  SELECT *, NOT sequential OR coalesce(bool_and(state = 'signed') OVER (PARTITION BY request_id ORDER BY ord RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS may_sign FROM signers
)"""


def signers(spark, folder):
    status = F.col("o_orderstatus")
    return load(spark, folder, "orders").select(
        F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("recipient"), (F.col("o_orderkey") % 7).alias("ord"),
        (F.col("o_custkey") % 2 == 0).alias("sequential"), F.when(status == "F", "signed").when(status == "P", "declined").otherwise("pending").alias("state"))


@query("WITH " + SIGNERS_SQL + " SELECT request_id, recipient, may_sign FROM turned")
def signing_turns(spark, folder):
    return L.turns(signers(spark, folder), "recipient").select("request_id", "recipient", "may_sign")


@query("WITH " + SIGNERS_SQL + """
SELECT request_id, count(*) AS recipients, count(*) FILTER (state <> 'signed') AS remaining,
  CASE WHEN count(*) FILTER (state <> 'signed') = 0 THEN 'completed' ELSE 'partially_signed' END AS next_state FROM signers GROUP BY request_id""")
def outstanding_signers(spark, folder):
    return L.outstanding(signers(spark, folder))


STATES = list(fixed.ALLOWED_TRANSITIONS)
PAIRS = ", ".join(f"('{a}', '{b}')" for a, nexts in fixed.ALLOWED_TRANSITIONS.items() for b in nexts)


@query(f"""
WITH s AS (SELECT user_id, event_id, {choose_sql(STATES, 'event_id * 7 + user_id // 3 + event_id // 11')} AS state FROM events),
p AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS prev_state FROM s)
SELECT user_id, event_id, prev_state, state, (prev_state, state) IN (VALUES {PAIRS}) AS allowed FROM p WHERE prev_state <> state""")
def state_steps(spark, folder):
    e = F.col("event_id")
    log = load(spark, folder, "events").select("user_id", "event_id", choose(STATES, e * 7 + F.floor(F.col("user_id") / 3) + F.floor(e / 11)).alias("state"))
    return L.check_transitions(log, ["user_id"], "event_id").select("user_id", "event_id", "prev_state", "state", "allowed")


@query("""
SELECT c_custkey AS request_id, CASE WHEN c_custkey % 5 = 0 THEN 'Only a draft request can be sent.' WHEN count(o_orderkey) = 0 THEN 'Add at least one recipient before sending.'
  WHEN count(o_orderkey) FILTER (o_orderstatus = 'P') = 0 THEN 'Place at least one field before sending.' END AS reason
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def sendable_requests(spark, folder):
    counted = load(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("recipients"), F.count_if(F.col("o_orderstatus") == "P").alias("fields"))
    requests = load(spark, folder, "customer").select(F.col("c_custkey").alias("request_id")).join(
        counted.withColumnRenamed("o_custkey", "request_id"), "request_id", "left").fillna(0, ["recipients", "fields"])
    drafts = requests.withColumn("state", F.when(F.col("request_id") % 5 == 0, "sent").otherwise("draft"))
    return L.sendable(drafts).select("request_id", "reason")


# Lines of an order are the fields of its signer; a wrong submitter is named in one line of nine.
FIELDS_SQL = """
fields AS (
  SELECT o_custkey AS request_id, o_orderkey AS recipient, l_linenumber * 1000000 + l_partkey AS field_id, min(l_quantity) > 20 AS required,
    CASE WHEN min(l_quantity) % 3 = 0 THEN NULL ELSE 'v' END AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL
),
submitted AS (SELECT request_id, CASE WHEN field_id % 9 = 0 THEN recipient + 1 ELSE recipient END AS recipient, field_id FROM fields)"""


def signer_fields(spark, folder, deal=lambda rows, key: rows):
    # Dealt by order: a task that sorts, joins and groups its share in memory must not get a larger one because few cores are there.
    orders = deal(load(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    lines = deal(load(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey")
    grouped = lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(
        F.col("o_custkey").alias("request_id"), F.col("o_orderkey").alias("recipient"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("field_id")).agg(F.min("l_quantity").alias("q"))
    fields = grouped.select("request_id", "recipient", "field_id", (F.col("q") > 20).alias("required"), F.when(F.col("q") % 3 != 0, "v").alias("value"))
    submitted = fields.select("request_id", F.when(F.col("field_id") % 9 == 0, F.col("recipient") + 1).otherwise(F.col("recipient")).alias("recipient"), "field_id")
    return fields, submitted


@query("WITH " + FIELDS_SQL + " SELECT request_id, recipient, field_id FROM submitted EXCEPT SELECT request_id, recipient, field_id FROM fields")
def foreign_fields(spark, folder):
    fields, submitted = signer_fields(spark, folder, scale.deal)
    return L.foreign_fields(submitted, fields).distinct()


@query("WITH " + SIGNERS_SQL + "," + FIELDS_SQL + """,
foreign_ones AS (SELECT request_id, recipient, count(*) AS n FROM (SELECT DISTINCT * FROM submitted EXCEPT SELECT request_id, recipient, field_id FROM fields) GROUP BY ALL),
gaps AS (SELECT request_id, recipient, min(field_id) AS label FROM fields WHERE required AND value IS NULL GROUP BY ALL),
closed AS (SELECT request_id, bool_and(state = 'signed') AS done FROM signers GROUP BY request_id)
SELECT t.request_id, t.recipient, CASE WHEN state = 'signed' THEN 'You have already signed this document.' WHEN state = 'declined' THEN 'You declined this request.'
  WHEN done OR t.request_id % 11 = 0 THEN 'This request is ' || CASE WHEN t.request_id % 11 = 0 THEN 'expired' ELSE 'completed' END || '.'
  WHEN NOT may_sign THEN 'It is not your turn to sign yet.' WHEN n > 0 THEN 'A field was submitted that is not assigned to you.'
  WHEN label IS NOT NULL THEN '''' || label || ''' is required.' END AS reason
FROM turned t JOIN closed USING (request_id) LEFT JOIN foreign_ones f ON f.request_id = t.request_id AND f.recipient = t.recipient
LEFT JOIN gaps g ON g.request_id = t.request_id AND g.recipient = t.recipient""")
def submission_checks(spark, folder):
    people = L.turns(signers(spark, folder), "recipient")
    fields, submitted = signer_fields(spark, folder)
    strangers = L.foreign_fields(submitted, fields).distinct().groupBy("request_id", "recipient").agg(F.count(F.lit(1)).alias("foreign_fields"))
    gaps = L.missing_required(
        fields.withColumn("kind", F.lit("text")).withColumn("read_only", F.lit(False)),
        fields.select("request_id", "recipient", "field_id", F.lit(None).cast("string").alias("value")), ["request_id", "recipient", "field_id"],
    ).groupBy("request_id", "recipient").agg(F.min("field_id").cast("string").alias("missing_field"))
    done = L.outstanding(signers(spark, folder)).select("request_id", F.when(F.col("request_id") % 11 == 0, "expired").when(
        F.col("remaining") == 0, "completed").otherwise("sent").alias("request_state"))
    joined = people.join(done, "request_id").join(strangers, ["request_id", "recipient"], "left").join(gaps, ["request_id", "recipient"], "left")
    return L.check_submission(joined).select("request_id", "recipient", "reason")


@query("""
WITH a AS (SELECT l_orderkey AS request_id, CASE WHEN l_suppkey % 50 = 0 THEN '' ELSE 's' || l_suppkey % 40 || '@x.org' END AS email, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT request_id, sum(n) AS recipients, CASE WHEN bool_or(email = '') THEN 'Every recipient needs an email address.'
  WHEN min(CASE WHEN n > 1 AND email <> '' THEN email END) IS NOT NULL THEN min(CASE WHEN n > 1 AND email <> '' THEN email END) || ' is listed more than once.' END AS reason
FROM a GROUP BY request_id""")
def recipient_lists(spark, folder):
    s = F.col("l_suppkey")
    people = load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.when(s % 50 == 0, "  ").otherwise(
        F.concat(F.when(s % 3 == 0, " S").otherwise("s"), (s % 40).cast("string"), F.lit("@X.org\t"))).alias("email"))
    return L.normalise_recipients(people)


@query("""
WITH people AS (SELECT DISTINCT o_custkey AS request_id, 'r' || o_orderkey % 6 || '@x.org' AS email, o_orderkey % 6 AS recipient_id FROM orders)
SELECT l_orderkey % 1500 AS request_id, l_partkey AS field_id, 'r' || l_linenumber % 7 || '@x.org' AS address, recipient_id,
  CASE WHEN recipient_id IS NULL THEN 'Field assigned to unknown recipient ''r' || l_linenumber % 7 || '@x.org''.' END AS reason
FROM lineitem LEFT JOIN people ON people.request_id = l_orderkey % 1500 AND people.email = 'r' || l_linenumber % 7 || '@x.org'""")
def assigned_fields(spark, folder):
    people = load(spark, folder, "orders").select(F.col("o_custkey").alias("request_id"), F.concat(
        F.lit("r"), (F.col("o_orderkey") % 6).cast("string"), F.lit("@x.org")).alias("email"), (F.col("o_orderkey") % 6).alias("recipient_id")).distinct()
    fields = load(spark, folder, "lineitem").select((F.col("l_orderkey") % 1500).alias("request_id"), F.col("l_partkey").alias("field_id"), F.concat(
        F.lit(" R"), (F.col("l_linenumber") % 7).cast("string"), F.lit("@x.org")).alias("email"))
    return L.assign_fields(fields, people).select("request_id", "field_id", L.normalise_email(F.col("email")).alias("address"), "recipient_id", "reason")


@query("WITH " + VERSIONS_SQL + """
SELECT seq AS request_id, seq % 4 <> 1 AS intact FROM versions""")
def frozen_versions(spark, folder):
    stored = versions(spark, folder)
    i = F.col("seq")
    requests = stored.select(i.alias("request_id"), "doc", "version", F.when(i % 4 == 1, F.lit("0000")).when(i % 4 != 2, F.col("content_hash")).alias("frozen_hash"))
    return L.check_frozen(requests, stored).select("request_id", "intact")


# ------------------------------------------------------------------ form fields

@query("""
WITH f AS (SELECT p_partkey, list_extract(['Tx', 'Btn', 'Ch', 'Sig', 'Zz'], p_partkey % 5 + 1) AS type,
  p_size % 4 + CASE WHEN p_partkey % 3 = 0 THEN 4096 ELSE 0 END + CASE WHEN p_partkey % 4 = 0 THEN 32768 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 65536 ELSE 0 END
  + CASE WHEN p_partkey % 6 < 3 THEN 131072 ELSE 0 END AS flags FROM part)
SELECT p_partkey, CASE type WHEN 'Btn' THEN CASE WHEN flags & 65536 <> 0 THEN 'pushbutton' WHEN flags & 32768 <> 0 THEN 'radio' ELSE 'checkbox' END
  WHEN 'Ch' THEN CASE WHEN flags & 131072 <> 0 THEN 'dropdown' ELSE 'listbox' END WHEN 'Tx' THEN CASE WHEN flags & 4096 <> 0 THEN 'multiline' ELSE 'text' END
  WHEN 'Sig' THEN 'signature' ELSE 'unknown' END AS kind, flags & 2 <> 0 AS required, flags & 1 <> 0 AS read_only FROM f""")
def field_kinds(spark, folder):
    i = F.col("p_partkey")
    flags = (F.col("p_size") % 4 + F.when(i % 3 == 0, 4096).otherwise(0) + F.when(i % 4 == 0, 32768).otherwise(0)
             + F.when(i % 7 == 0, 65536).otherwise(0) + F.when(i % 6 < 3, 131072).otherwise(0))
    fields = load(spark, folder, "part").select("p_partkey", choose(["Tx", "Btn", "Ch", "Sig", "Zz"], i).alias("type"), flags.alias("flags"))
    return L.classify_field(fields).select("p_partkey", "kind", "required", "read_only")


@query("""
WITH f AS (SELECT p_partkey, list_extract(['text', 'checkbox', 'radio'], CAST(p_partkey % 3 AS INTEGER) + 1) AS kind, p_size % 2 = 0 AS required, p_size % 5 = 0 AS read_only,
  list_extract(['', ' ', 'Off', 'x'], CAST(p_partkey % 4 AS INTEGER) + 1) AS stored, CASE WHEN p_partkey % 7 > 2 THEN list_extract(['', 'Off', '/Off', 'yes'], CAST(p_size % 4 AS INTEGER) + 1) END AS submitted FROM part)
SELECT p_partkey, kind FROM f WHERE required AND NOT read_only
  AND (trim(coalesce(stored, '')) = '' OR kind <> 'text' AND trim(stored) IN ('Off', '/Off')) AND (trim(coalesce(submitted, '')) = '' OR kind <> 'text' AND trim(submitted) IN ('Off', '/Off'))""")
def missing_fields(spark, folder):
    i = F.col("p_partkey")
    part = load(spark, folder, "part")
    fields = part.select("p_partkey", choose(["text", "checkbox", "radio"], i).alias("kind"), (F.col("p_size") % 2 == 0).alias("required"),
                         (F.col("p_size") % 5 == 0).alias("read_only"), choose(["", " ", "Off", "x"], i).alias("value"))
    values = part.filter(i % 7 > 2).select("p_partkey", choose(["", "Off", "/Off", "yes"], F.col("p_size")).alias("value"))
    return L.missing_required(fields, values, ["p_partkey"]).select("p_partkey", "kind")


KINDS = ["text", "multiline", "checkbox", "radio", "dropdown", "date", "signature", "slider"]


@query(f"""
WITH s AS (SELECT p_size AS doc_id, p_partkey AS seq, {choose_sql(KINDS, 'p_partkey')} AS type, CASE WHEN p_partkey % 13 = 0 THEN '9' ELSE 'f' END || '.' || (p_partkey // 50) % 29 AS name,
  p_partkey % 6 AS page, CASE WHEN p_partkey % 8 = 3 THEN 0 ELSE 10 END AS width, p_partkey % 3 AS option_count, 4 AS page_count FROM part),
f AS (SELECT *, min(seq) OVER (PARTITION BY doc_id, name) AS first_seq FROM s)
SELECT seq, CASE WHEN type = 'slider' THEN 'Unsupported field type ''slider''. Supported: checkbox, date, dropdown, multiline, radio, signature, text.'
  WHEN NOT regexp_full_match(name, '[A-Za-z][A-Za-z0-9_.-]{{0,63}}') THEN 'Field name ''' || name || ''' is invalid. Use letters, digits, dot, dash or underscore, starting with a letter.'
  WHEN seq > first_seq THEN 'Duplicate field name ''' || name || '''.'
  WHEN page < 1 OR page > page_count THEN 'Field ''' || name || ''' is on page ' || page || ', but the document has ' || page_count || ' page(s).'
  WHEN width <= 0 THEN 'Field ''' || name || ''' has no size.'
  WHEN type IN ('dropdown', 'radio') AND option_count < 2 THEN 'Field ''' || name || ''' is a ' || type || ' and needs at least two options.' END AS reason FROM f""")
def field_checks(spark, folder):
    i = F.col("p_partkey")
    part = load(spark, folder, "part")
    specs = part.select(
        F.col("p_size").alias("doc_id"), i.alias("seq"), choose(KINDS, i).alias("type"),
        F.concat(F.when(i % 13 == 0, "9").otherwise("f"), F.lit("."), (F.floor(i / 50) % 29).cast("string")).alias("name"), (i % 6).alias("page"),
        F.when(i % 8 == 3, 0).otherwise(10).alias("width"), F.lit(5).alias("height"), (i % 3).alias("option_count"))
    counts = part.select(F.col("p_size").alias("doc_id")).distinct().withColumn("page_count", F.lit(4))
    return L.validate_fields(specs, counts).select("seq", "reason")


ELEMENTS = ["form_fields", "outline_entries", "annotations", "embedded_files"]


@query("SELECT l_orderkey AS doc_id, " + ", ".join(f"count(*) FILTER (l_linenumber % 4 = {n}) AS {name}" for n, name in enumerate(ELEMENTS)) + " FROM lineitem GROUP BY l_orderkey")
def hidden_elements(spark, folder):
    return L.hidden_counts(load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), choose(ELEMENTS, F.col("l_linenumber")).alias("element")))


@query("""
WITH p AS (SELECT o_orderkey, list_filter(['metadata', 'javascript', 'files', 'bookmarks'], lambda x, i: (o_custkey >> (i - 1)) & 1 = 1) AS present,
  list_filter(['metadata', 'javascript', 'files', 'bookmarks'], lambda x, i: i <> 1 + o_orderkey % 4) AS wanted FROM orders)
SELECT o_orderkey, array_to_string(list_filter(present, lambda x: list_contains(wanted, x)), ',') AS removed FROM p WHERE list_has_any(present, wanted)""")
def sanitised_parts(spark, folder):
    parts = F.array(*[F.lit(x) for x in ("metadata", "javascript", "files", "bookmarks")])
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    rows = load(spark, folder, "orders").select(
        "o_orderkey", F.filter(parts, lambda x, i: F.pmod(F.floor(cust / F.pow(F.lit(2), i)), F.lit(2)) == 1).alias("present"),
        F.filter(parts, lambda x, i: i != order % 4).alias("requested"))
    removed = rows.select("o_orderkey", L.removed_parts(F.col("present"), F.col("requested")).alias("removed"))
    return removed.filter(F.size("removed") > 0).withColumn("removed", F.array_join("removed", ","))


# ------------------------------------------------------------------ trees

@query("""
WITH RECURSIVE c AS (SELECT conv_id AS doc, turn AS id, CASE WHEN turn = 0 THEN NULL WHEN conv_id % 10 = 0 AND turn = 3 THEN 99 ELSE (turn - 1) // 2 END AS parent_id FROM conversations),
t AS (SELECT doc, id, parent_id IS NULL AS valid, 0 AS depth, id AS root FROM c WHERE parent_id IS NULL OR NOT EXISTS (SELECT 1 FROM c p WHERE p.doc = c.doc AND p.id = c.parent_id)
  UNION ALL SELECT c.doc, c.id, true, t.depth + 1, t.root FROM c JOIN t ON t.doc = c.doc AND t.id = c.parent_id)
SELECT doc, id, valid, depth, root FROM t""")
def comment_threads(spark, folder):
    turn = F.col("turn")
    comments = load(spark, folder, "conversations").select(F.col("conv_id").alias("doc"), turn.alias("id"), F.when(turn == 0, None).when(
        (F.col("conv_id") % 10 == 0) & (turn == 3), F.lit(99)).otherwise(F.floor((turn - 1) / 2)).alias("parent_id"))
    return L.thread_depths(comments)
