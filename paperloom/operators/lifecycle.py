"""Signing requests, jobs and their event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import fixed, scale
from paperloom.functions import text as T


def turns(recipients: DataFrame, seq: str, request: str = "request_id") -> DataFrame:
    """May each recipient sign now? In sequential requests every lower order must be signed.

    The lowest unsigned order of a request decides for all its recipients, so one partial
    aggregate replaces a window over the request.
    """
    pending = recipients.groupBy(request).agg(
        F.min(F.when(F.col("state") != "signed", F.col("ord"))).alias("_first_open"), F.count(F.lit(1)).alias("_n"))
    joined = scale.attach(recipients, pending, [request], "_n", F.col(seq))
    free = ~F.col("sequential") | F.col("_first_open").isNull() | (F.col("ord") <= F.col("_first_open"))
    return joined.withColumn("may_sign", free).drop("_first_open", "_n")


def outstanding(recipients: DataFrame, request: str = "request_id") -> DataFrame:
    """Remaining signers per request and the state that follows."""
    counted = recipients.groupBy(request).agg(
        F.count(F.lit(1)).alias("recipients"), F.count_if(F.col("state") != "signed").alias("remaining"))
    return counted.withColumn("next_state", F.when(F.col("remaining") == 0, "completed").otherwise("partially_signed"))


def transition_allowed(before: Column, after: Column) -> Column:
    """Whether a state may follow another; null when either is unknown."""
    pairs = F.create_map(*[
        x for state, nexts in fixed.ALLOWED_TRANSITIONS.items()
        for x in (F.lit(state), F.array(*[F.lit(n) for n in nexts]).cast("array<string>"))])
    return F.array_contains(F.try_element_at(pairs, before), after)


def check_transitions(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each event with the state before it and whether the step is allowed; repeats are left out."""
    stepped = scale.previous(events, keys, order, ["state"])
    moved = stepped.filter(F.col("prev_state").isNotNull() & (F.col("prev_state") != F.col("state")))
    return moved.withColumn("allowed", transition_allowed(F.col("prev_state"), F.col("state")))


def state_counts(jobs: DataFrame, *keys: str) -> DataFrame:
    return jobs.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("jobs"))


def eligible(requests: DataFrame, jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """requests(job_id, action retry|cancel): accepted, or the reason it is refused."""
    joined = requests.join(jobs.select(key, "state"), key, "left")
    reason = (
        F.when(F.col("state").isNull(), "not found")
        .when((F.col("action") == "retry") & ~F.col("state").isin(fixed.RETRYABLE_STATES), F.concat(
            F.lit("Only failed or cancelled jobs can be retried (state is "), F.col("state"), F.lit(")")))
        .when((F.col("action") == "cancel") & F.col("state").isin(fixed.TERMINAL_JOB_STATES), F.concat(
            F.lit("Job is already "), F.col("state"))))
    return joined.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def sendable(requests: DataFrame) -> DataFrame:
    """requests(state, recipients, fields): may a draft be sent? The first failing rule is named."""
    reason = (
        F.when(F.col("state") != "draft", "Only a draft request can be sent.")
        .when(F.col("recipients") == 0, "Add at least one recipient before sending.")
        .when(F.col("fields") == 0, "Place at least one field before sending."))
    return requests.withColumn("reason", reason).withColumn("accepted", reason.isNull())


def check_submission(subs: DataFrame) -> DataFrame:
    """First rule a submission breaks.

    Columns: state (recipient), request_state, may_sign, foreign_fields, missing_field (a label or null).
    """
    return subs.withColumn("reason", (
        F.when(F.col("state") == "signed", "You have already signed this document.")
        .when(F.col("state") == "declined", "You declined this request.")
        .when(F.col("request_state").isin(fixed.CLOSED_REQUEST_STATES), F.concat(F.lit("This request is "), F.col("request_state"), F.lit(".")))
        .when(~F.col("may_sign"), "It is not your turn to sign yet.")
        .when(F.col("foreign_fields") > 0, "A field was submitted that is not assigned to you.")
        .when(F.col("missing_field").isNotNull(), F.concat(F.lit("'"), F.col("missing_field"), F.lit("' is required.")))))


def foreign_fields(values: DataFrame, fields: DataFrame) -> DataFrame:
    """Submitted values (request_id, recipient, field_id) that are not the submitter's."""
    return values.join(fields.select("request_id", "recipient", "field_id"), ["request_id", "recipient", "field_id"], "left_anti")


def normalise_email(email: Column) -> Column:
    return F.lower(T.strip(F.coalesce(email, F.lit(""))))


def normalise_recipients(recipients: DataFrame, request: str = "request_id") -> DataFrame:
    """Per request: number of recipients and the reason a list is refused (no address, repeats)."""
    per_address = recipients.withColumn("email", normalise_email(F.col("email"))).groupBy(request, "email").agg(
        F.count(F.lit(1)).alias("_n"))
    rolled = per_address.groupBy(request).agg(
        F.sum("_n").alias("recipients"), F.bool_or(F.col("email") == "").alias("_blank"),
        F.min(F.when((F.col("_n") > 1) & (F.col("email") != ""), F.col("email"))).alias("_twice"))
    return rolled.withColumn("reason", F.when(F.col("_blank"), "Every recipient needs an email address.").when(
        F.col("_twice").isNotNull(), F.concat("_twice", F.lit(" is listed more than once.")))).drop("_blank", "_twice")


def assign_fields(fields: DataFrame, recipients: DataFrame) -> DataFrame:
    """fields(request_id, field_id, email) to recipients(request_id, email, recipient_id); unknown ones carry a reason."""
    address = normalise_email(F.col("email"))
    people = recipients.select("request_id", address.alias("_address"), "recipient_id")
    joined = fields.withColumn("_address", address).join(people, ["request_id", "_address"], "left")
    return joined.withColumn("reason", F.when(
        (F.col("_address") != "") & F.col("recipient_id").isNull(),
        F.concat(F.lit("Field assigned to unknown recipient '"), F.col("_address"), F.lit("'.")))).drop("_address")


def check_frozen(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """requests(request_id, doc, version, frozen_hash): is the source version unchanged?"""
    stored = versions.select("doc", "version", "content_hash")
    return requests.join(stored, ["doc", "version"], "left").withColumn(
        "intact", F.coalesce(F.col("frozen_hash").isNull() & F.col("content_hash").isNotNull() | (F.col("frozen_hash") == F.col("content_hash")), F.lit(False)))


def stalled(jobs: DataFrame, now: Column, seconds: int = fixed.STALL_SECONDS) -> DataFrame:
    """Jobs locked longer than the limit: requeue while attempts remain, else fail."""
    late = (F.col("state") == "processing") & (F.col("locked_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    return jobs.filter(late).withColumn(
        "next_state", F.when(F.col("attempts") < F.col("max_attempts"), "queued").otherwise("failed"))


def last_n(rows: DataFrame, owner: str, order: list[Column], n: int = 50) -> DataFrame:
    """The newest n rows per owner. Spark cuts each task's share to n before the shuffle."""
    from pyspark.sql import Window

    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(owner).orderBy(*order)))
    return ranked.filter(F.col("rank") <= n)


# ------------------------------------------------------------------ form fields

def classify_field(fields: DataFrame) -> DataFrame:
    """Field kind from its type (Tx, Btn, Ch, Sig) and flag bits."""
    def flag(bit: int) -> Column:
        return F.col("flags").bitwiseAND(F.lit(bit)) != 0
    kind = (
        F.when(F.col("type") == "Btn", F.when(flag(fixed.FLAG_PUSHBUTTON), "pushbutton").when(flag(fixed.FLAG_RADIO), "radio").otherwise("checkbox"))
        .when(F.col("type") == "Ch", F.when(flag(fixed.FLAG_COMBO), "dropdown").otherwise("listbox"))
        .when(F.col("type") == "Tx", F.when(flag(fixed.FLAG_MULTILINE), "multiline").otherwise("text"))
        .when(F.col("type") == "Sig", "signature").otherwise("unknown"))
    return fields.withColumn("kind", kind).withColumn("required", flag(fixed.FLAG_REQUIRED)).withColumn("read_only", flag(fixed.FLAG_READ_ONLY))


def is_set(kind: Column, value: Column) -> Column:
    shown = T.strip(value)
    return F.coalesce((shown != "") & ~(kind.isin("checkbox", "radio") & shown.isin("/Off", "Off")), F.lit(False))


def missing_required(fields: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Required, writable fields with neither a submitted nor a stored value."""
    joined = fields.join(values.select(*keys, F.col("value").alias("submitted")), keys, "left")
    return joined.filter(
        F.col("required") & ~F.col("read_only") & ~is_set(F.col("kind"), F.col("submitted")) & ~is_set(F.col("kind"), F.col("value")))


def validate_fields(specs: DataFrame, page_counts: DataFrame, doc: str = "doc_id", seq: str = "seq") -> DataFrame:
    """First rule each field specification breaks, or null.

    Columns: doc_id, seq, type, name, page, width, height, option_count. The first of several equal
    names in a document (lowest seq) is the valid one.
    """
    first = specs.groupBy(doc, "name").agg(F.min(seq).alias("_first"), F.count(F.lit(1)).alias("_n"))
    joined = scale.attach(specs, first, [doc, "name"], "_n", F.col(seq)).join(page_counts.select(doc, "page_count"), doc, "left")
    name = F.col("name")
    reason = (
        F.when(~F.col("type").isin(fixed.FIELD_KINDS), F.concat(
            F.lit("Unsupported field type '"), F.col("type"), F.lit("'. Supported: " + ", ".join(sorted(fixed.FIELD_KINDS)) + ".")))
        .when(~name.rlike(fixed.FIELD_NAME_PATTERN), F.concat(F.lit("Field name '"), name, F.lit(
            "' is invalid. Use letters, digits, dot, dash or underscore, starting with a letter.")))
        .when(F.col(seq) > F.col("_first"), F.concat(F.lit("Duplicate field name '"), name, F.lit("'.")))
        .when((F.col("page") < 1) | (F.col("page") > F.coalesce("page_count", F.lit(0))), F.concat(
            F.lit("Field '"), name, F.lit("' is on page "), F.col("page").cast("string"), F.lit(", but the document has "),
            F.coalesce("page_count", F.lit(0)).cast("string"), F.lit(" page(s).")))
        .when((F.col("width") <= 0) | (F.col("height") <= 0), F.concat(F.lit("Field '"), name, F.lit("' has no size.")))
        .when(F.col("type").isin("dropdown", "radio") & (F.col("option_count") < 2), F.concat(
            F.lit("Field '"), name, F.lit("' is a "), F.col("type"), F.lit(" and needs at least two options."))))
    return joined.withColumn("reason", reason).drop("_first", "_n", "page_count")


# ------------------------------------------------------------------ logs

def usage_totals(usage: DataFrame, keys: list[str]) -> DataFrame:
    return usage.groupBy(*keys).agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("records"))


def audit_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action", "result").agg(F.count(F.lit(1)).alias("entries"))


def audit_detail(detail: Column) -> Column:
    """Details are cut at 500 characters; an empty one is null."""
    cut = F.substring(F.coalesce(detail, F.lit("")), 1, 500)
    return F.when(cut != "", cut)


def run_stats(runs: DataFrame, *keys: str) -> DataFrame:
    """Total runs, success rate, mean time and the kinds of summary seen."""
    base = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), (F.count_if(F.col("status") == "success") / F.count(F.lit(1)) * 100).alias("success_rate"),
        (F.sum("cents") / F.count(F.lit(1)) / 100).alias("mean_seconds"), F.count_distinct("summary_type").alias("summary_types"))
    return base


def batch_outcome(results: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Successes over total, failures, and how many answers came from the cache."""
    return results.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("error").isNull()).alias("succeeded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("source") == "cache").alias("from_cache"))


def hidden_counts(elements: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many fields, outline entries, annotations and attachments each document carries."""
    kinds = ["form_fields", "outline_entries", "annotations", "embedded_files"]
    return elements.groupBy(key).agg(*[F.count_if(F.col("element") == k).alias(k) for k in kinds])


def removed_parts(present: Column, requested: Column) -> Column:
    """What a clean-up really removed: present and asked for."""
    return F.array_intersect(present, requested)


# ------------------------------------------------------------------ trees

def thread_depths(comments: DataFrame) -> DataFrame:
    """Root and depth of every comment (doc, id, parent_id).

    A reply whose parent is not in its document is invalid and counts as a root. Replies that lead into a
    circle have no root: they come back invalid, without depth and root.

    Comments whose root is known are set aside; only the others, joined on unique (doc, id), take part
    in a round, and each round doubles their links. A way up is shorter than the number of replies, so what
    is still open when the links are that long goes round in a circle.
    """
    from paperloom.session import settle

    replies = comments.filter(F.col("parent_id").isNotNull())
    ids = comments.select("doc", F.col("id").alias("parent_id"), F.lit(True).alias("_known")).distinct()
    checked = scale.null_safe_join(replies, ids, ["doc", "parent_id"], "left")
    zero = F.lit(0)
    done = comments.filter(F.col("parent_id").isNull()).select("doc", "id", F.lit(True).alias("valid"), zero.alias("depth"), F.col("id").alias("root")).unionByName(
        checked.filter(F.col("_known").isNull()).select("doc", "id", F.lit(False).alias("valid"), zero.alias("depth"), F.col("id").alias("root")))
    done = settle(done)
    # `up` is `depth` steps above the comment.
    open_ = settle(checked.filter(F.col("_known")).select("doc", "id", F.col("parent_id").alias("up"), F.lit(1).alias("depth")))
    count, reach = open_.count(), 1
    while reach <= 2 * count and not open_.isEmpty():
        ends = done.select("doc", F.col("id").alias("up"), F.lit(None).cast(comments.schema["id"].dataType).alias("_up"), F.col("depth").alias("_steps"), F.col("root").alias("_root"))
        ways = open_.select("doc", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_steps"), F.lit(None).cast(comments.schema["id"].dataType).alias("_root"))
        moved = settle(scale.null_safe_join(open_, ends.unionByName(ways), ["doc", "up"]).withColumn("depth", F.col("depth") + F.col("_steps")))
        done = settle(done.unionByName(moved.filter(F.col("_up").isNull()).select("doc", "id", F.lit(True).alias("valid"), "depth", F.col("_root").alias("root"))))
        open_ = moved.filter(F.col("_up").isNotNull()).select("doc", "id", F.col("_up").alias("up"), "depth")
        reach *= 2
    nothing = F.lit(None)
    return done.unionByName(open_.select("doc", "id", F.lit(False).alias("valid"), nothing.cast("int").alias("depth"), nothing.cast(comments.schema["id"].dataType).alias("root")))


def nest_outline(entries: Column) -> Column:
    """Parents of a document's flat outline (array<struct<depth,title>>): array<int>, position or null.

    An entry nests under the last entry one level up that no shallower entry has closed. One fold keeps the
    open entries, one for each depth reached, from the outermost to the innermost.
    """
    kind = "struct<open:array<struct<depth:int,at:int>>,parents:array<int>>"
    start = F.struct(F.array().alias("open"), F.array().alias("parents")).cast(kind)

    def add(acc: Column, entry: Column) -> Column:
        depth = F.greatest(F.coalesce(entry["depth"], F.lit(0)), F.lit(0)).cast("int")
        outer = F.filter(acc["open"], lambda o: o["depth"] < depth)
        above = F.try_element_at(outer, F.lit(-1))
        parent = F.when(above["depth"] == depth - 1, above["at"])
        return F.struct(
            F.concat(outer, F.array(F.struct(depth.alias("depth"), F.size(acc["parents"]).alias("at")))).alias("open"),
            F.concat(acc["parents"], F.array(parent)).alias("parents")).cast(kind)
    return F.aggregate(entries, start, add, lambda acc: acc["parents"])
