"""Who may see and change what. Memberships are joined by Spark, which broadcasts them
only when it has measured them to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.session import settle


def visible(items: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    """Items in the user's workspaces, in one query."""
    mine = members.filter(F.col("user_id") == user_id).select("workspace_id")
    return items.join(mine, "workspace_id", "left_semi")


def my_workspaces(workspaces: DataFrame, members: DataFrame, user_id: int) -> DataFrame:
    mine = members.filter(F.col("user_id") == user_id).select("workspace_id", "role")
    return workspaces.join(mine, "workspace_id")


def workspace_members(members: DataFrame, users: DataFrame, workspace_id: int) -> DataFrame:
    return members.filter(F.col("workspace_id") == workspace_id).join(users, "user_id")


def authorise(requests: DataFrame, items: DataFrame, members: DataFrame) -> DataFrame:
    """requests(request_id, user_id, item_id, need): outcome allowed / forbidden / not_found."""
    placed = requests.join(items.select("item_id", "workspace_id"), "item_id", "left")
    known = placed.join(members.select("workspace_id", "user_id", "role"), ["workspace_id", "user_id"], "left")
    enough = (
        F.when(F.col("need") == "write", F.col("role").isin(fixed.WRITE_ROLES))
        .when(F.col("need") == "manage", F.col("role").isin(fixed.MANAGE_ROLES)).otherwise(True))
    return known.withColumn("outcome", F.when(F.col("role").isNull(), "not_found").when(enough, "allowed").otherwise("forbidden"))


def authorise_all(requests: DataFrame, items: DataFrame, members: DataFrame) -> DataFrame:
    """requests(request_id, user_id, item_id): every item visible, all in one workspace."""
    judged = authorise(requests.withColumn("need", F.lit("read")), items, members)
    return judged.groupBy("request_id").agg(
        F.bool_and(F.col("outcome") == "allowed").alias("all_visible"),
        (F.min("workspace_id") == F.max("workspace_id")).alias("one_workspace"),
        F.count(F.lit(1)).alias("items"),
    ).withColumn("accepted", F.col("all_visible") & F.coalesce("one_workspace", F.lit(False)))


def apply_memberships(members: DataFrame, changes: DataFrame, users: DataFrame):
    """changes(change_id, action add|remove, workspace_id, user_id, role), at most one per member.

    Returns (new_members, outcomes). The last owner of a workspace may not be removed: of
    several owner removals in one batch, as many pass (lowest change_id first) as leave one.
    """
    known = changes.join(users.select("user_id", F.lit(True).alias("_user")), "user_id", "left")
    held = known.join(
        members.select("workspace_id", "user_id", F.col("role").alias("_held")), ["workspace_id", "user_id"], "left")
    owners = members.filter(F.col("role") == "owner").groupBy("workspace_id").agg(F.count(F.lit(1)).alias("_owners"))
    joined = held.join(owners, "workspace_id", "left")
    leaving = (F.col("action") == "remove") & (F.col("_held") == "owner")
    # The last of a batch is kept when every owner asked to leave.
    batch = joined.filter(leaving).groupBy("workspace_id").agg(
        F.count(F.lit(1)).alias("_leaving"), F.max("change_id").alias("_last"))
    judged = joined.join(batch, "workspace_id", "left")
    reason = (
        F.when((F.col("action") == "add") & F.col("_user").isNull(), "no such user")
        .when((F.col("action") == "add") & F.col("_held").isNotNull(), "already a member")
        .when((F.col("action") == "remove") & F.col("_held").isNull(), "not a member")
        .when(leaving & (F.col("_leaving") >= F.col("_owners")) & (F.col("change_id") == F.col("_last")), "last owner")
    )
    outcomes = judged.withColumn("outcome", F.coalesce(reason, F.lit("applied")))
    applied = outcomes.filter(F.col("outcome") == "applied")
    removed = applied.filter(F.col("action") == "remove").select("workspace_id", "user_id")
    added = applied.filter(F.col("action") == "add").select("workspace_id", "user_id", "role")
    result = members.select("workspace_id", "user_id", "role").join(removed, ["workspace_id", "user_id"], "left_anti").unionByName(added)
    return result, outcomes.select("change_id", "outcome")


def list_items(items: DataFrame, workspace_id: int, search: str | None = None, include_archived: bool = False) -> DataFrame:
    """Library listing. The term goes into ILIKE as it is: % and _ act as wildcards."""
    found = items.filter(F.col("workspace_id") == workspace_id)
    if not include_archived:
        found = found.filter(~F.col("archived"))
    return found.filter(F.col("name").ilike(f"%{search}%")) if search else found


def list_jobs(jobs: DataFrame, workspace_id: int, state: str | None = None) -> DataFrame:
    if state is not None and state not in fixed.JOB_STATES:
        raise ValueError(f"Unknown state '{state}'. Expected one of: {', '.join(fixed.JOB_STATES)}.")
    found = jobs.filter(F.col("workspace_id") == workspace_id)
    return found.filter(F.col("state") == state) if state else found


def list_annotations(notes: DataFrame, page: int | None = None, kind: str | None = None, include_resolved: bool = True) -> DataFrame:
    found = notes
    if page is not None:
        found = found.filter(F.col("page") == page)
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    return found if include_resolved else found.filter(~F.col("resolved"))


def page_of(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of results by its place in the order.

    The first page is a top-k: each task keeps its best `limit` rows. A deeper one is a range-partitioned
    sort, written once; the rows before it are counted per partition, not gathered.
    """
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    if offset == 0:
        return rows.orderBy(*order).limit(limit)
    # The id holds the partition of the sort in its upper bits and the place within it in the lower 33.
    placed = settle(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    counts = placed.groupBy(F.shiftright("_id", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    place, before = F.lit(None).cast("long"), 0
    for part, n in sorted((r["part"], r["n"]) for r in counts):
        if before < offset + limit and before + n > offset:
            local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
            place = F.when(F.shiftright("_id", 33) == part, local + before).otherwise(place)
        before += n
    return placed.withColumn("_place", place).filter((F.col("_place") >= offset) & (F.col("_place") < offset + limit)).orderBy("_place").drop("_id", "_place")


def page_after(rows: DataFrame, keys: list[tuple[str, bool]], limit: int, last: dict | None = None) -> DataFrame:
    """The page behind the row `last` (its key values), or the first page: no page costs more than the first.

    keys: (column, descending); together they must tell rows apart. Rows before the key are filtered at the
    scan where the source can, and each task keeps its best `limit` rows. Nulls come first where a
    key ascends and last where it descends, as Spark sorts them.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    if last is not None:
        behind, same = F.lit(False), F.lit(True)
        for column, descending in keys:
            c, v = F.col(column), F.lit(last[column])
            if last[column] is None:
                beyond = F.lit(False) if descending else c.isNotNull()
            else:
                beyond = F.coalesce(c < v, F.lit(True)) if descending else F.coalesce(c > v, F.lit(False))
            behind, same = behind | (same & beyond), same & c.eqNullSafe(v)
        rows = rows.filter(behind)
    return rows.orderBy(*[F.col(c).desc() if d else F.col(c) for c, d in keys]).limit(limit)


def with_total(page: DataFrame, rows: DataFrame) -> DataFrame:
    """A page with the number of all rows it was taken from."""
    return page.withColumn("total", rows.agg(F.count(F.lit(1))).scalar())


def workspace_totals(items: DataFrame, include_archived: bool = False) -> DataFrame:
    """Number of items per workspace, counted before the shuffle."""
    shown = items if include_archived else items.filter(~F.col("archived"))
    return shown.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("total"))


def own_assets(assets: DataFrame, user_id: int) -> DataFrame:
    return assets.filter(F.col("user_id") == user_id)


def in_order(rows: DataFrame, *order: Column | str) -> DataFrame:
    """All rows in a stated order: a range-partitioned sort, without a cut."""
    return rows.orderBy(*order)


def page_slice(rows: DataFrame, position: str, first: int, stop: int) -> DataFrame:
    """Rows whose position lies in [first, stop)."""
    return rows.filter((F.col(position) >= first) & (F.col(position) < stop))
