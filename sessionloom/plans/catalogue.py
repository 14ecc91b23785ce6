"""Named queries over the driver's tables, each with the SQL it can be checked with.

A query applies operators to the driver's tables in the roles of ``adapters``. Times and
sizes are scaled to those tables; every list has a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import blobstore as B
from ..functions.shared import place_of
from ..operators import browsing as R
from ..operators import burden as U
from ..operators import fulltext as X
from ..operators import outcomes as O
from ..operators import search as H
from ..operators import store as S
from . import adapters as D
from .adapters import table, with_roles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_roles(sql) if not sql.lstrip().startswith("--raw") else sql
        return f

    return add


# -- analytics --------------------------------------------------------------------------------


@query("""SELECT (SELECT count(*) FROM sessions) AS total_sessions, (SELECT min(created_at) FROM sessions) AS first_session,
    (SELECT max(modified_at) FROM sessions) AS last_session, (SELECT count(*) FROM session_messages) AS total_messages,
    count(*) AS total_blobs, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_blob_bytes FROM content_store""")
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overview(D.sessions(spark, sf_dir), D.session_messages(spark, sf_dir), D.content_store(spark, sf_dir))


_DAILY = """SELECT CAST(day AS VARCHAR) AS date, count(*) AS message_count, count(DISTINCT session_id) AS session_count,
    count(*) FILTER (WHERE tool_name <> 'view') AS tool_call_count FROM event_calls {where} GROUP BY 1"""


@query(_DAILY.format(where=""))
def daily_activity(spark, sf_dir):
    return A.daily(D.event_calls(spark, sf_dir), call=F.col("tool_name") != "view")


@query(_DAILY.format(where="WHERE CAST(day AS VARCHAR) >= '2024-01-05' AND CAST(day AS VARCHAR) <= '2024-01-20'"))
def daily_activity_range(spark, sf_dir):
    return A.daily(D.event_calls(spark, sf_dir), start="2024-01-05", end="2024-01-20", call=F.col("tool_name") != "view")


@query("""--raw
    SELECT p_brand AS model, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(sum(l_quantity), 0) AS BIGINT) + CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS total
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def model_usage_ranked(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), "p_partkey")
    rows = part.join(table(spark, sf_dir, "lineitem"), F.col("l_partkey") == F.col("p_partkey"), "left")
    usage = rows.select("model", F.col("l_quantity").alias("input_tokens"), F.col("l_linenumber").alias("output_tokens"))
    return A.token_totals(usage, "model", ["input_tokens", "output_tokens"])


@query("SELECT tool_name, count(*) AS n FROM tool_calls GROUP BY 1 ORDER BY n DESC, tool_name LIMIT 3")
def tool_frequency(spark, sf_dir):
    return A.tool_frequency(D.tool_calls(spark, sf_dir), limit=3)


@query("""SELECT tool_name, count(*) AS n FROM tool_calls WHERE "timestamp" >= '1994-01-01' AND "timestamp" <= '1995-06-30'
    GROUP BY 1 ORDER BY n DESC, tool_name LIMIT 20""")
def tool_frequency_range(spark, sf_dir):
    return A.tool_frequency(D.tool_calls(spark, sf_dir), start="1994-01-01", end="1995-06-30")


_BREAKDOWN = """SELECT {key} AS {name}, count(*) AS session_count, CAST(coalesce(sum(m), 0) AS BIGINT) AS message_count,
    CAST(coalesce(sum(c), 0) AS BIGINT) AS tool_call_count
    FROM sessions LEFT JOIN (SELECT session_id, count(*) AS m FROM session_messages GROUP BY 1) mm ON mm.session_id = id
    LEFT JOIN (SELECT session_id, count(*) AS c FROM tool_calls GROUP BY 1) cc ON cc.session_id = id {where} GROUP BY 1"""


@query(_BREAKDOWN.format(key="project_slug", name="project_slug", where=""))
def project_breakdown(spark, sf_dir):
    return A.by_project(D.sessions(spark, sf_dir), D.session_messages(spark, sf_dir), D.tool_calls(spark, sf_dir))


@query(_BREAKDOWN.format(key="project_slug", name="project_slug", where="WHERE created_at >= '1994-01-01' AND created_at <= '1996-12-31'"))
def project_breakdown_range(spark, sf_dir):
    return A.by_project(D.sessions(spark, sf_dir), D.session_messages(spark, sf_dir), D.tool_calls(spark, sf_dir), "1994-01-01", "1996-12-31")


@query(_BREAKDOWN.format(key="coalesce(source_kind, 'unknown')", name="source_kind", where=""))
def llm_breakdown(spark, sf_dir):
    return A.by_source_kind(D.sessions(spark, sf_dir), D.session_messages(spark, sf_dir), D.tool_calls(spark, sf_dir))


@query("SELECT CAST(CAST(CAST(created_at AS TIMESTAMP) AS DATE) AS VARCHAR) AS date, project_slug, count(*) AS session_count FROM sessions GROUP BY 1, 2")
def daily_project_breakdown(spark, sf_dir):
    return A.daily_projects(D.sessions(spark, sf_dir)).withColumn("date", F.col("date").cast("string"))


_ENTRIES = """SELECT coalesce(n_chars, 0) AS size, source AS owner, quality IS NOT NULL AS indexed FROM documents LEFT JOIN labels USING (doc_id)"""


@query(f"""--raw
    WITH t AS (SELECT count(*) AS files, count(*) FILTER (WHERE indexed) AS indexed_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes,
      CAST(coalesce(sum(size) FILTER (WHERE indexed), 0) AS BIGINT) AS indexed_bytes, count(DISTINCT owner) AS owners,
      count(DISTINCT owner) FILTER (WHERE indexed) AS indexed_owners FROM ({_ENTRIES}))
    SELECT *, round(CASE WHEN files = 0 THEN 0.0 ELSE 100.0 * indexed_files / files END, 6) AS files_percent,
      round(CASE WHEN bytes = 0 THEN 0.0 ELSE 100.0 * indexed_bytes / bytes END, 6) AS bytes_percent,
      round(CASE WHEN owners = 0 THEN 0.0 ELSE 100.0 * indexed_owners / owners END, 6) AS owners_percent FROM t""")
def coverage(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    entries = docs.join(labels, "doc_id", "left").select(F.coalesce("n_chars", F.lit(0)).alias("size"), F.col("source").alias("owner"), F.col("quality").isNotNull().alias("indexed"))
    return A.coverage(entries)


_RULES = [("%/EN/%", "english"), ("%.html%", "html"), ("%page=%", "listing"), ("%#top", "anchor")]


@query("""--raw
    SELECT CASE WHEN url ILIKE '%/EN/%' THEN 'english' WHEN url ILIKE '%.html%' THEN 'html' WHEN url ILIKE '%page=%' THEN 'listing'
    WHEN url ILIKE '%#top' THEN 'anchor' ELSE 'other' END AS kind, count(*) AS n FROM pages GROUP BY 1""")
def coverage_by_kind(spark, sf_dir):
    return A.coverage_by_kind(table(spark, sf_dir, "pages"), "url", _RULES)


@query("SELECT coalesce(outcome, 'unknown') AS outcome, n FROM (SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome)")
def outcome_distribution(spark, sf_dir):
    return A.outcome_distribution(D.outcomes(spark, sf_dir))


@query("SELECT coalesce(reason_code, 'unknown') AS reason, count(*) AS n FROM outcomes WHERE outcome IS DISTINCT FROM 'success' GROUP BY 1")
def failure_reasons(spark, sf_dir):
    return A.failure_reasons(D.outcomes(spark, sf_dir))


@query("""WITH c AS (SELECT coalesce(outcome, 'unknown') AS outcome, n FROM (SELECT outcome, count(*) AS n FROM outcomes GROUP BY outcome))
    SELECT outcome, n, round(n / sum(n) OVER (), 9) AS share_of_total, round(n / max(n) OVER (), 9) AS share_of_max FROM c""")
def outcome_shares(spark, sf_dir):
    return A.with_shares(A.outcome_distribution(D.outcomes(spark, sf_dir)))


@query("""SELECT (SELECT count(*) FROM content_store) AS blobs, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM content_store) AS bytes,
    count(*) AS refs, round(CASE WHEN count(*) = 0 THEN 0.0 ELSE 1 - CAST((SELECT count(*) FROM content_store) AS DOUBLE) / count(*) END, 9) AS dedup_ratio
    FROM blob_references""")
def storage_overview(spark, sf_dir):
    return A.storage_overview(D.content_store(spark, sf_dir), D.blob_references(spark, sf_dir))


@query("SELECT kind, count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes FROM content_store GROUP BY kind")
def storage_by_kind(spark, sf_dir):
    return A.storage_by_kind(D.content_store(spark, sf_dir))


@query("SELECT hash, kind, size FROM content_store ORDER BY size DESC, hash LIMIT 20")
def largest_blobs(spark, sf_dir):
    return A.largest_blobs(D.content_store(spark, sf_dir))


@query(f"""WITH b AS ({_BREAKDOWN.format(key="project_slug", name="project_slug", where="")}),
    s AS (SELECT project_slug, min(created_at) AS first_session, max(modified_at) AS last_session,
          arg_max(project_path, (modified_at, id)) AS project_path FROM sessions GROUP BY 1),
    f AS (SELECT project_slug, count(DISTINCT file_path) AS files_touched FROM file_references r JOIN sessions ON sessions.id = r.session_id GROUP BY 1)
    SELECT b.*, first_session, last_session, project_path, coalesce(files_touched, 0) AS files_touched
    FROM b LEFT JOIN s USING (project_slug) LEFT JOIN f USING (project_slug)""")
def projects_page(spark, sf_dir):
    return A.projects_page(D.sessions(spark, sf_dir), D.session_messages(spark, sf_dir), D.tool_calls(spark, sf_dir), D.file_references(spark, sf_dir))


@query("""WITH c AS (SELECT project_slug, tool_name, count(*) AS n FROM tool_calls JOIN sessions ON sessions.id = session_id GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_slug ORDER BY n DESC, tool_name) AS INTEGER) AS rank FROM c)
    SELECT * FROM r WHERE rank <= 5""")
def top_tools_per_project(spark, sf_dir):
    return A.top_tools(D.sessions(spark, sf_dir), D.tool_calls(spark, sf_dir))


@query("""SELECT file_path, count(DISTINCT session_id) AS sessions, string_agg(DISTINCT operation, ',' ORDER BY operation) AS operations,
    max(session_id) AS last_session FROM file_references GROUP BY 1 ORDER BY sessions DESC, file_path LIMIT 50""")
def file_provenance(spark, sf_dir):
    return A.file_provenance(D.file_references(spark, sf_dir))


@query("""SELECT count(*) AS sessions, count(*) FILTER (WHERE source_kind = 'F') AS finished, count(*) FILTER (WHERE source_kind = 'O') AS open,
    count(*) FILTER (WHERE source_kind IS NULL) AS unknown, CAST(coalesce(sum(message_count), 0) AS BIGINT) AS messages
    FROM sessions WHERE created_at >= '1995-01-01' AND created_at < '1995-02-01'""")
def digest_stats(spark, sf_dir):
    return A.digest_stats(D.sessions(spark, sf_dir), "1995-01-01", "1995-02-01", "F", "O")


# -- browsing ---------------------------------------------------------------------------------

_SESSION_LIST = """WITH s AS (SELECT DISTINCT m.session_id, outcome, reason_code FROM messages m LEFT JOIN outcomes o ON o.session_id = m.session_id {where}),
    p AS (SELECT * FROM s ORDER BY session_id DESC LIMIT 20 OFFSET {offset})
    SELECT p.*, (SELECT count(*) FROM messages m WHERE m.session_id = p.session_id) AS message_count,
      (SELECT substr(arg_min(content, (turn_index, id)), 1, 200) FROM messages m WHERE m.session_id = p.session_id AND type = 'user') AS first_text
    FROM p"""


@query(_SESSION_LIST.format(where="", offset=10))
def session_list(spark, sf_dir):
    return R.session_list(D.messages(spark, sf_dir), D.outcomes(spark, sf_dir), offset=10)


@query(_SESSION_LIST.format(where="WHERE outcome = 'success'", offset=0))
def session_list_filtered(spark, sf_dir):
    return R.session_list(D.messages(spark, sf_dir), D.outcomes(spark, sf_dir), outcome="success")


@query(_SESSION_LIST.format(where="", offset=5).rsplit("SELECT p.*", 1)[0] + """, l AS (SELECT p.session_id,
      (SELECT substr(arg_min(content, (turn_index, id)), 1, 200) FROM messages m WHERE m.session_id = p.session_id AND type = 'user') AS first_text FROM p)
    SELECT l.session_id, first_text, CASE WHEN o.outcome = 'success' THEN 'About ' || l.session_id WHEN s.project_slug IS NOT NULL THEN s.project_slug ELSE first_text END AS title
    FROM l LEFT JOIN outcomes o ON o.session_id = l.session_id LEFT JOIN sessions s ON s.id = l.session_id""")
def session_titles(spark, sf_dir):
    listed = R.session_list(D.messages(spark, sf_dir), D.outcomes(spark, sf_dir), offset=5)
    enriched = _enrichments(spark, sf_dir).withColumn("title", F.concat(F.lit("About "), F.col("session_id").cast("string")))
    prompts = D.sessions(spark, sf_dir).select(F.col("id").alias("session_id"), F.col("project_slug").alias("first_prompt"))
    return R.titled(listed, enriched, prompts).select("session_id", "first_text", "title")


@query("""SELECT count(*) AS total FROM (SELECT DISTINCT m.session_id, outcome FROM messages m LEFT JOIN outcomes o ON o.session_id = m.session_id) WHERE outcome = 'success'""")
def session_list_total(spark, sf_dir):
    return R.session_total(D.messages(spark, sf_dir), D.outcomes(spark, sf_dir), "success")


@query("""SELECT session_id, substr(arg_min(content, (turn_index, id)), 1, 200) AS first_text FROM messages WHERE type = 'user' GROUP BY 1""")
def session_detail(spark, sf_dir):
    return R.first_user_text(D.messages(spark, sf_dir))


@query("""SELECT id, turn_index, type, substr(content, 1, 100) AS preview, CAST(strlen(content) AS BIGINT) AS size FROM messages WHERE session_id = 5
    ORDER BY turn_index, id LIMIT 100""")
def message_page(spark, sf_dir):
    return R.message_page(D.messages(spark, sf_dir), 5)


@query("""SELECT t.id, t."timestamp", tool_name, p_name AS input, s_name AS output FROM tool_calls t LEFT JOIN part ON p_partkey = input_hash
    LEFT JOIN supplier ON s_suppkey = output_hash AND s_acctbal > 0 WHERE session_id = 1""")
def session_tools(spark, sf_dir):
    inputs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hash"), F.col("p_name").alias("content"))
    outputs = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("hash"), F.col("s_name").alias("content"))
    return R.session_tools(D.tool_calls(spark, sf_dir), inputs, outputs, 1)


@query("""SELECT session_id AS id, count(*) AS blocks, string_agg(type, ',' ORDER BY turn_index) AS roles FROM messages GROUP BY 1""")
def messages_with_blocks(spark, sf_dir):
    rows = D.messages(spark, sf_dir)
    blocks = rows.select(F.col("session_id").alias("message_id"), F.col("turn_index").alias("block_index"), F.col("type").alias("block_type"), F.lit("").alias("content_hash"), F.lit("").alias("tool_name"))
    whole = R.messages_with_blocks(rows.select(F.col("session_id").alias("id")).distinct(), blocks)
    return whole.select("id", F.size("blocks").cast("long").alias("blocks"), F.array_join(F.transform("blocks", lambda b: b["block_type"]), ",").alias("roles"))


@query("""--raw
    SELECT page_id, url FROM pages WHERE url ILIKE '%EXAMPLE.net%' ORDER BY url, page_id LIMIT 20 OFFSET 5""")
def file_references_page(spark, sf_dir):
    return R.file_page(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "EXAMPLE.net", 20, 5, ("page_id",))


@query("SELECT hash, kind, size FROM content_store WHERE hash = (SELECT max(hash) FROM content_store)")
def blob_lookup(spark, sf_dir):
    """A user names the hash; here it is the largest, of the table that is laid out by hash."""
    blobs = B.stored(spark, sf_dir, lambda: D.content_store(spark, sf_dir))
    last = blobs.agg(F.max("hash")).first()[0]
    return B.lookup(blobs, last).select("hash", "kind", "size")


@query("""SELECT d.doc_id, d.size, coalesce(strlen(s.content), 0) AS text_bytes FROM blob_references d JOIN content_store s USING (hash)""")
def references_with_texts(spark, sf_dir):
    blobs = B.stored(spark, sf_dir, lambda: D.content_store(spark, sf_dir))
    rows = B.with_texts(D.blob_references(spark, sf_dir).select("doc_id", "hash", "size"), blobs, {"hash": "found"})
    return rows.select("doc_id", "size", F.octet_length("found").cast("long").alias("text_bytes"))


@query("SELECT hash, count(*) AS refs, min(doc_id) AS first_ref FROM blob_references GROUP BY 1 HAVING count(*) > 1")
def blob_refs(spark, sf_dir):
    return D.blob_references(spark, sf_dir).groupBy("hash").agg(F.count("*").alias("refs"), F.min("doc_id").alias("first_ref")).filter("refs > 1")


@query("--raw\n SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unlabelled_documents(spark, sf_dir):
    return R.without(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("--raw\n SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR c_nationkey IS NULL")
def not_backed_up(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    ordered = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    missing = R.without(customers, ordered, "c_custkey")
    known = R.within(customers, ordered, "c_custkey").filter("c_nationkey IS NULL")
    return missing.unionByName(known).select("c_custkey")


@query("--raw\n SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def labelled_semi(spark, sf_dir):
    return R.within(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")


_PENDING = """SELECT session_id, CASE WHEN outcome = 'failed' THEN 'rejected' WHEN outcome IS NULL THEN 'pending_review' ELSE 'approved' END AS approval_status,
    message_count AS enriched_at FROM outcomes"""


def _enrichments(spark, sf_dir):
    status = F.expr("CASE WHEN outcome = 'failed' THEN 'rejected' WHEN outcome IS NULL THEN 'pending_review' ELSE 'approved' END")
    return D.outcomes(spark, sf_dir).select("session_id", status.alias("approval_status"), F.col("message_count").alias("enriched_at"))


@query(f"""WITH e AS ({_PENDING}) SELECT e.session_id, approval_status, enriched_at, project_slug FROM e JOIN outcomes o USING (session_id)
    WHERE approval_status = 'pending_review' ORDER BY enriched_at DESC, e.session_id LIMIT 20""")
def review_queue(spark, sf_dir):
    return R.review_queue(_enrichments(spark, sf_dir), D.outcomes(spark, sf_dir).select("session_id", "project_slug"))


@query(f"""WITH e AS ({_PENDING}) SELECT CASE WHEN approval_status = 'pending_review' AND session_id % 2 = 0 THEN 'approved' ELSE approval_status END AS approval_status,
    count(*) AS n FROM e GROUP BY 1""")
def review_approve(spark, sf_dir):
    rows = _enrichments(spark, sf_dir)
    ids = rows.filter("session_id % 2 = 0").select("session_id")
    return S.reviewed(rows, ids, "approved").groupBy("approval_status").agg(F.count("*").alias("n"))


@query("""--raw
    SELECT l_orderkey AS session_id, CASE WHEN min(1 - l_discount * 5) >= 0.75 THEN 'approved' ELSE 'pending_review' END AS approval_status FROM lineitem GROUP BY 1""")
def auto_approve(spark, sf_dir):
    tags = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), (1 - F.col("l_discount") * 5).alias("confidence"))
    return S.auto_approved(tags, 0.75)


# -- context burden ---------------------------------------------------------------------------

_PLACED = """WITH placed AS (SELECT *, CAST(strlen(content) AS BIGINT) AS size, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, id) AS idx,
    count(*) OVER (PARTITION BY session_id) AS n FROM messages),
    b AS (SELECT *, n - idx + 1 AS remaining, size * (n - idx + 1) AS burden FROM placed)"""


def burden_rows(spark, sf_dir):
    rows = D.messages(spark, sf_dir).withColumn("size", F.octet_length("content").cast("long")).drop("content")
    return U.burden(U.positions(rows, ["turn_index", "id"]), F.col("size"))


_BY = """{placed} SELECT {key}, count(*) AS items, CAST(sum(size) AS BIGINT) AS bytes, round(avg(size), 6) AS avg_bytes, CAST(sum(burden) AS BIGINT) AS burden,
    round(sum(burden) / (SELECT sum(burden) FROM b), 9) AS share FROM b GROUP BY 1"""


@query(_BY.format(placed=_PLACED, key="type"))
def context_burden_by_role(spark, sf_dir):
    return U.by_group(burden_rows(spark, sf_dir), "type")


@query(_BY.format(placed=_PLACED, key="session_id"))
def context_burden_by_session(spark, sf_dir):
    return U.by_group(burden_rows(spark, sf_dir), "session_id")


@query(_PLACED + """, g AS (SELECT session_id, CAST(sum(burden) AS BIGINT) AS burden FROM b GROUP BY 1),
    t AS (SELECT * FROM g ORDER BY burden DESC, session_id LIMIT 20)
    SELECT session_id, burden, round(sum(burden) OVER (ORDER BY burden DESC, session_id ROWS UNBOUNDED PRECEDING) / (SELECT sum(burden) FROM g), 9) AS cumulative_share FROM t""")
def context_burden_top_share(spark, sf_dir):
    return U.top_share(burden_rows(spark, sf_dir), "session_id")


@query(_PLACED + """SELECT CAST(sum(burden) AS BIGINT) AS uncapped, CAST(sum(least(size, 100) * remaining) AS BIGINT) AS cap_100,
    CAST(sum(least(size, 250) * remaining) AS BIGINT) AS cap_250, CAST(sum(least(size, 500) * remaining) AS BIGINT) AS cap_500,
    CAST(sum(least(size, 1000) * remaining) AS BIGINT) AS cap_1000 FROM b""")
def burden_flat_cap(spark, sf_dir):
    return U.flat_caps(burden_rows(spark, sf_dir), [100, 250, 500, 1000])


_TIERS = [(3, 1000), (5, 500)]


@query(_PLACED + """SELECT CAST(sum(burden) AS BIGINT) AS uncapped,
    CAST(sum(least(size, CASE WHEN remaining < 3 THEN 1000 WHEN remaining < 5 THEN 500 ELSE 200 END) * remaining) AS BIGINT) AS capped FROM b""")
def burden_dynamic_cap(spark, sf_dir):
    return U.dynamic_caps(burden_rows(spark, sf_dir), _TIERS, 200)


@query(_PLACED + "SELECT count(*) AS items, CAST(sum(size * (least(n, 4) - idx + 1)) AS BIGINT) AS burden FROM b WHERE idx <= 4")
def burden_session_cap(spark, sf_dir):
    return U.session_cap(burden_rows(spark, sf_dir), 4)


@query(_PLACED + """, k AS (SELECT size, least(n, 4) - idx + 1 AS r FROM b WHERE idx <= 4)
    SELECT count(*) AS items, CAST(sum(least(size, CASE WHEN r < 3 THEN 1000 WHEN r < 5 THEN 500 ELSE 200 END) * r) AS BIGINT) AS burden FROM k""")
def burden_combined(spark, sf_dir):
    return U.combined(burden_rows(spark, sf_dir), 4, _TIERS, 200)


@query("""WITH l AS (SELECT *, lag(tool_name) OVER (PARTITION BY session_id ORDER BY sec, id) AS before FROM event_calls)
    SELECT session_id, count(*) FILTER (WHERE before = 'view' AND tool_name = 'click') AS transitions FROM l GROUP BY 1""")
def transition_count(spark, sf_dir):
    return U.transitions(D.event_calls(spark, sf_dir), "view", "click", ["sec", "id"])


@query("""WITH r AS (SELECT *, sum(CASE WHEN tool_name = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY sec, id ROWS UNBOUNDED PRECEDING) AS run FROM event_calls),
    g AS (SELECT session_id, run, count(*) FILTER (WHERE tool_name <> 'signup') AS calls FROM r GROUP BY 1, 2)
    SELECT session_id, max(calls) AS longest FROM g GROUP BY 1""")
def calls_since_user(spark, sf_dir):
    return U.since_user(D.event_calls(spark, sf_dir), ["sec", "id"], F.col("tool_name") == "signup")


@query(_PLACED + """, r AS (SELECT *, sum(CASE WHEN type = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn_index, id ROWS UNBOUNDED PRECEDING) AS run FROM b),
    g AS (SELECT session_id, max(c) AS longest FROM (SELECT session_id, run, count(*) FILTER (WHERE type <> 'user') AS c FROM r GROUP BY 1, 2) GROUP BY 1)
    SELECT b.session_id, max(n) > 6 AS long_session, coalesce(max(size > 900 AND idx > 3), false) AS late_large_output, max(longest) > 1 AS long_run
    FROM b JOIN g ON g.session_id = b.session_id GROUP BY 1""")
def tripwires(spark, sf_dir):
    return U.tripwires(burden_rows(spark, sf_dir), 6, 1, 900, 3, ["turn_index", "id"], F.col("type") == "user")


@query("""WITH s AS (SELECT size, (size >= 500)::INT + (size >= 1000)::INT + (size >= 5000)::INT + (size >= 20000)::INT AS bucket FROM blob_references)
    SELECT bucket, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM s GROUP BY 1""")
def size_histogram(spark, sf_dir):
    return U.histogram(D.blob_references(spark, sf_dir), "size", [500, 1000, 5000, 20000])


@query("WITH t AS (SELECT tool_name AS file_path, session_id, count(*) AS reads FROM event_calls GROUP BY 1, 2) SELECT reads, count(*) AS pairs FROM t GROUP BY 1")
def reread_histogram(spark, sf_dir):
    return U.reread_histogram(D.event_calls(spark, sf_dir).withColumnRenamed("tool_name", "file_path"))


@query("""WITH t AS (SELECT file_path, count(DISTINCT session_id) AS sessions FROM file_references WHERE operation = 'read' GROUP BY 1)
    SELECT sessions, count(*) AS files FROM t GROUP BY 1""")
def cross_session_reads(spark, sf_dir):
    return U.cross_session_reads(D.file_references(spark, sf_dir).filter("operation = 'read'"))


@query("""WITH m AS (SELECT session_id, count(*) AS m FROM messages GROUP BY 1), c AS (SELECT session_id, count(*) AS c FROM tool_calls GROUP BY 1)
    SELECT round(avg(m), 6) AS avg_messages, max(m) AS max_messages, round(avg(coalesce(c, 0)), 6) AS avg_calls, max(coalesce(c, 0)) AS max_calls
    FROM m LEFT JOIN c USING (session_id)""")
def session_depth(spark, sf_dir):
    return U.depth(D.messages(spark, sf_dir), D.tool_calls(spark, sf_dir))


@query("""WITH e AS (SELECT file_path, session_id, max(message_id) AS last_edit FROM file_references WHERE operation <> 'read' GROUP BY 1, 2),
    r AS (SELECT coalesce(last_edit > message_id, false) AS followed FROM file_references f LEFT JOIN e USING (file_path, session_id) WHERE operation = 'read')
    SELECT count(*) AS reads, count(*) FILTER (WHERE NOT followed) AS unedited, round(100 * count(*) FILTER (WHERE NOT followed) / count(*), 6) AS percent FROM r""")
def unedited_reads(spark, sf_dir):
    return U.unedited_reads(D.file_references(spark, sf_dir))


@query("""--raw
    SELECT CASE WHEN json_extract(props, '$.k') IS NULL THEN 'none' WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 50 THEN 'surgical' ELSE 'full' END AS reading,
    count(*) AS n FROM events GROUP BY 1""")
def surgical_reads(spark, sf_dir):
    return U.readings(table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long"), 50)


@query(_PLACED + """, g AS (SELECT session_id, CAST(sum(burden) AS DOUBLE) AS burden FROM b GROUP BY 1)
    SELECT round(quantile_cont(burden, 0.5), 6) AS p50, round(quantile_cont(burden, 0.95), 6) AS p95, round(quantile_cont(burden, 0.99), 6) AS p99,
    count(*) FILTER (WHERE burden > 10000) AS over FROM g""")
def session_burden_percentiles(spark, sf_dir):
    return U.percentiles(burden_rows(spark, sf_dir), 10_000)


@query(_PLACED + """, g AS (SELECT session_id, sum(burden) AS burden FROM b GROUP BY 1)
    SELECT count(*) AS sessions, true AS p50_near, true AS p95_near, true AS p99_near FROM g""")
def session_burden_sketches(spark, sf_dir):
    """Quantiles from sketches that are kept for groups of sessions and merged; here whether their ranks are as near as is stated."""
    rows = burden_rows(spark, sf_dir).withColumn("part", F.pmod("session_id", F.lit(7)))
    q = U.merged_quantiles(U.burden_sketches(rows, "part"))
    per = rows.groupBy("session_id").agg(F.sum("burden").alias("burden"))
    rank = lambda p: F.sum((F.col("burden") <= F.col(p)).cast("long")) / F.count("*")
    below = lambda p: F.sum((F.col("burden") < F.col(p)).cast("long")) / F.count("*")
    near = [((below(p) - U.RANK_ERROR <= at) & (at <= rank(p) + U.RANK_ERROR)).alias(f"{p}_near") for p, at in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))]
    return per.crossJoin(F.broadcast(q)).agg(F.count("*").alias("sessions"), *near)  # one row of quantiles


@query("""SELECT a.session_id, a.id, b.id AS then_id, b.sec - a.sec AS gap FROM event_calls a JOIN event_calls b ON a.session_id = b.session_id
    AND a.tool_name = 'view' AND b.tool_name = 'click' AND b.sec > a.sec AND b.sec <= a.sec + 7200""")
def write_then_edit_window(spark, sf_dir):
    return U.followed_within(D.event_calls(spark, sf_dir), "view", "click", 7200)


@query("""SELECT session_id, id, last_value(CASE WHEN type = 'assistant' THEN id END IGNORE NULLS) OVER
    (PARTITION BY session_id ORDER BY turn_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS parent FROM messages""")
def carry_forward_parent(spark, sf_dir):
    rows = D.messages(spark, sf_dir).drop("content")
    return U.carry_forward(rows, ["turn_index", "id"], F.col("type") == "assistant", "id").select("session_id", "id", "parent")


@query("""SELECT tool_name, count(*) AS calls, CAST(sum(size) AS BIGINT) AS bytes, round(avg(size), 6) AS avg_bytes FROM tool_calls GROUP BY 1""")
def tool_sizes(spark, sf_dir):
    return A.sizes_by_tool(D.tool_calls(spark, sf_dir))


# -- content store ----------------------------------------------------------------------------


@query("SELECT doc_id, hash, size >= 256 AS worth_dedup FROM blob_references")
def content_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return rows.select("doc_id", S.content_hash("text").alias("hash"), S.worth_dedup("text").alias("worth_dedup"))


@query("""WITH old AS (SELECT hash FROM blob_references WHERE doc_id % 3 = 0),
    new AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS r FROM blob_references WHERE doc_id % 3 <> 0 AND hash NOT IN (SELECT hash FROM old))
    SELECT doc_id, hash FROM new WHERE r = 1""")
def dedup_first_wins(spark, sf_dir):
    rows = D.blob_references(spark, sf_dir).select("doc_id", "hash")
    return S.first_wins(rows.filter("doc_id % 3 <> 0"), ["hash"], ["doc_id"], rows.filter("doc_id % 3 = 0"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sec DESC, id DESC) AS r FROM event_calls WHERE id % 2 = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sec, id) AS r FROM event_calls WHERE id % 2 = 0)
    SELECT session_id, id, tool_name FROM n WHERE r = 1
    UNION ALL SELECT session_id, id, tool_name FROM o WHERE r = 1 AND session_id NOT IN (SELECT session_id FROM n)""")
def upsert_last_wins(spark, sf_dir):
    rows = D.event_calls(spark, sf_dir).select("session_id", "id", "sec", "tool_name")
    old = S.first_wins(rows.filter("id % 2 = 0"), ["session_id"], ["sec", "id"])
    return S.last_wins(old, rows.filter("id % 2 = 1"), ["session_id"], ["sec", "id"]).drop("sec")


@query("""WITH u AS (SELECT * FROM event_calls WHERE tool_name = 'view'), r AS (SELECT session_id, max_by(id, (sec, id)) AS output FROM event_calls WHERE tool_name = 'purchase' GROUP BY 1)
    SELECT u.session_id, u.id, r.output FROM u LEFT JOIN r USING (session_id)""")
def output_link(spark, sf_dir):
    rows = D.event_calls(spark, sf_dir)
    uses = rows.filter("tool_name = 'view'").select("session_id", "id", F.lit(None).cast("long").alias("output"))
    results = rows.filter("tool_name = 'purchase'").select("session_id", F.col("id").alias("output"), F.struct("sec", "id").alias("ord"))
    return S.link_outputs(uses, results, "session_id", "output", "ord")


@query("""WITH u AS (SELECT session_id, id, sec FROM event_calls WHERE tool_name = 'signup'), r AS (SELECT session_id, id, sec FROM event_calls WHERE tool_name = 'purchase'),
    j AS (SELECT u.session_id, u.id, r.id AS result_id, r.sec AS result_sec, row_number() OVER (PARTITION BY u.session_id, u.id ORDER BY r.sec, r.id) AS k
          FROM u JOIN r ON u.session_id = r.session_id AND r.sec > u.sec)
    SELECT session_id, id, result_id, result_sec FROM j WHERE k = 1""")
def first_result_match(spark, sf_dir):
    rows = D.event_calls(spark, sf_dir).select("session_id", "id", "sec", "tool_name")
    return S.match_first_result(rows.filter("tool_name = 'signup'").drop("tool_name"), rows.filter("tool_name = 'purchase'").drop("tool_name"), ["session_id"])


@query("""WITH l AS (SELECT *, lag(tool_name) OVER w AS before, lag(id) OVER w AS use_id FROM event_calls WHERE tool_name IN ('signup', 'purchase')
      WINDOW w AS (PARTITION BY session_id ORDER BY sec, id))
    SELECT session_id, use_id, id AS result_id FROM l WHERE tool_name = 'purchase' AND before = 'signup'""")
def consumed_uses(spark, sf_dir):
    rows = D.event_calls(spark, sf_dir).filter(F.col("tool_name").isin("signup", "purchase")).select("session_id", "id", "sec", "tool_name")
    return S.consumed_uses(rows, ["session_id"], ["sec", "id"], F.col("tool_name") == "signup")


_REDACT_SQL = "text"
for _p in S.SECRETS:
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_p}', '[REDACTED]', 'g')"


@query(f"""--raw
    SELECT doc_id, sha256({_REDACT_SQL}) AS redacted_hash, {_REDACT_SQL} <> text AS changed FROM documents WHERE text IS NOT NULL""")
def redact_documents(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", S.redacted("text").alias("r"))
    return rows.select("doc_id", S.content_hash("r").alias("redacted_hash"), (F.col("r") != F.col("text")).alias("changed"))


@query("""WITH f AS (SELECT session_id, turn_index, id, sha256(type || '' || sha256(content)) AS fp FROM messages)
    SELECT session_id, sha256(string_agg(fp, '' ORDER BY turn_index, id)) AS fingerprint FROM f GROUP BY 1""")
def session_fingerprint(spark, sf_dir):
    fp = S.message_fingerprint(F.col("type"), F.lit(""), F.array(S.content_hash("content")))
    return S.session_fingerprint(D.messages(spark, sf_dir).withColumn("fingerprint", fp), ["turn_index", "id"])


_SNAPSHOTS = """WITH now AS (SELECT doc_id AS path, coalesce(n_chars, 0) AS size, CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END AS mtime FROM documents WHERE doc_id % 7 <> 0),
    known AS (SELECT doc_id AS path, coalesce(n_chars, 0) AS size, 1 AS mtime, coalesce(n_chars, 0) // 2 AS "offset" FROM documents WHERE doc_id % 4 <> 0)"""


def _snapshots(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.coalesce("n_chars", F.lit(0)).alias("size"))
    now = rows.filter("path % 7 <> 0").withColumn("mtime", F.expr("CASE WHEN path % 5 = 0 THEN 2 ELSE 1 END"))
    known = rows.filter("path % 4 <> 0").withColumn("mtime", F.lit(1)).withColumn("offset", F.expr("size div 2"))
    return now, known


@query(_SNAPSHOTS + """SELECT now.path, CASE WHEN known.path IS NULL THEN 'new' WHEN now.mtime = known.mtime AND now.size = known.size THEN 'unchanged' ELSE 'modified' END AS status,
    CASE WHEN known.path IS NOT NULL AND NOT (now.mtime = known.mtime AND now.size = known.size) THEN "offset" ELSE 0 END AS start FROM now LEFT JOIN known USING (path)""")
def change_detection(spark, sf_dir):
    return S.changes(*_snapshots(spark, sf_dir))


@query(_SNAPSHOTS + "SELECT path FROM known WHERE path NOT IN (SELECT path FROM now)")
def deleted_paths(spark, sf_dir):
    return S.deleted(*_snapshots(spark, sf_dir))


@query("""--raw
    SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) FILTER (WHERE json_extract(props, '$.missing') IS NULL) AS missing FROM events GROUP BY 1""")
def json_payload_stats(spark, sf_dir):
    v = F.try_parse_json("props")
    rows = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(v, "$.k", "long").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("m"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("k"), F.count_if(F.col("m").isNull()).alias("missing"))


# -- search -----------------------------------------------------------------------------------

_INDEX = """WITH t AS (SELECT hash, col, unnest(words) AS term, generate_subscripts(words, 1) AS position FROM
      (SELECT hash, 'kind' AS col, regexp_extract_all(lower(kind), '[a-z0-9]+') AS words FROM content_store
       UNION ALL SELECT hash, 'content', regexp_extract_all(lower(content), '[a-z0-9]+') FROM content_store)),
    size AS (SELECT hash, count(*) AS length FROM t GROUP BY 1)"""
_SCORE = """, st AS (SELECT count(*) AS cnt, avg(length) AS mean FROM size), many AS (SELECT phrase, count(*) AS n FROM f GROUP BY 1),
    sc AS (SELECT f.hash, -sum(CASE WHEN ln((cnt - n + 0.5) / (n + 0.5)) <= 0 THEN 1e-6 ELSE ln((cnt - n + 0.5) / (n + 0.5)) END
             * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))) AS rank, count(*) AS held
           FROM f JOIN many USING (phrase) JOIN size USING (hash), st GROUP BY 1)"""


def _index(spark, sf_dir, stem: bool = False):
    """The stored index of the content store, built by the first query of an application that asks for it."""
    path = place_of(spark, "stems" if stem else "words", sf_dir)
    try:
        return X.read(spark, path)
    except FileNotFoundError:
        X.add(D.content_store(spark, sf_dir), path, stem)
        return X.read(spark, path)


def _ranked(spark, sf_dir, text: str, stem: bool = False) -> DataFrame:
    return X.find(_index(spark, sf_dir, stem), text).select("hash", "rank")


@query(_INDEX + """SELECT (SELECT count(*) FROM size) AS blobs, count(*) AS tokens, count(DISTINCT term) AS terms FROM t""")
def search_index(spark, sf_dir):
    index = _index(spark, sf_dir)
    return index.totals.select(F.col("blobs").cast("long").alias("blobs"), F.col("tokens").cast("long").alias("tokens")).crossJoin(F.broadcast(X.vocabulary(index)))


@query(_INDEX + """, f AS (SELECT hash, CASE term WHEN 'with' THEN 0 ELSE 1 END AS phrase, count(*) AS f FROM t WHERE term IN ('with', 'erth') GROUP BY 1, 2)"""
       + _SCORE + """, h AS (SELECT hash, rank FROM sc WHERE held = 2)
    SELECT h.hash, round(rank, 6) AS rank, doc_id, kind FROM h LEFT JOIN blob_references USING (hash) ORDER BY h.rank, h.hash, doc_id LIMIT 10""")
def bm25_search(spark, sf_dir):
    found = H.hits(_ranked(spark, sf_dir, "with erth"), D.blob_references(spark, sf_dir).select("hash", "doc_id", "kind"))
    return found.withColumn("rank", F.round("rank", 6))


_OF_THE = """SELECT a.hash FROM t a JOIN t b ON a.hash = b.hash AND a.col = b.col AND a.position + 1 = b.position AND a.term = 'of' AND b.term = 'the'"""


@query(_INDEX + f", p AS ({_OF_THE}), f AS (SELECT hash, 0 AS phrase, count(*) AS f FROM p GROUP BY 1)" + _SCORE + "SELECT hash, round(rank, 6) AS rank FROM sc")
def phrase_search(spark, sf_dir):
    return _ranked(spark, sf_dir, '"of the"').withColumn("rank", F.round("rank", 6))


@query(_INDEX + """SELECT hash FROM (SELECT DISTINCT hash FROM t WHERE term = 'with') WHERE hash IN (SELECT hash FROM t WHERE term IN ('for', 'from'))
    AND hash NOT IN (SELECT hash FROM t WHERE term = 'src3')""")
def boolean_search(spark, sf_dir):
    return _ranked(spark, sf_dir, "with AND (for OR from) NOT src3").select("hash")


@query(_INDEX + f""", f AS (
      SELECT hash, 0 AS phrase, count(*) AS f FROM t WHERE col = 'content' AND term = 'with' GROUP BY 1
      UNION ALL SELECT hash, 1, count(*) FROM ({_OF_THE} AND a.col = 'content') GROUP BY 1
      UNION ALL SELECT hash, 2, count(*) FROM t WHERE starts_with(term, 'er') GROUP BY 1
      UNION ALL SELECT hash, 3, count(*) FROM t WHERE col = 'kind' AND term = 'src1' GROUP BY 1)""" + _SCORE + """,
    held AS (SELECT hash, bool_or(phrase IN (0, 1)) AS one_of, bool_or(phrase = 2) AS begun, bool_or(phrase = 3) AS of_kind FROM f GROUP BY 1)
    SELECT hash, round(rank, 6) AS rank FROM sc JOIN held USING (hash) WHERE one_of AND begun AND NOT of_kind""")
def search_expression(spark, sf_dir):
    """Nested: a column, a phrase, a prefix, all three operators. Of what NOT excludes, nothing is counted."""
    return _ranked(spark, sf_dir, 'content : (with OR "of the") AND er* NOT kind:src1').withColumn("rank", F.round("rank", 6))


@query(_INDEX + ", f AS (SELECT hash, 0 AS phrase, count(*) AS f FROM t WHERE starts_with(term, 'wit') GROUP BY 1)" + _SCORE + "SELECT hash, round(rank, 6) AS rank FROM sc")
def search_prefix(spark, sf_dir):
    return _ranked(spark, sf_dir, "wit*").withColumn("rank", F.round("rank", 6))


@query()
def stemmed_search(spark, sf_dir):
    """Stems and folds marks, so it has no SQL; tests hold it against a full-text engine."""
    return H.hits(_ranked(spark, sf_dir, "with OR ing", True), D.blob_references(spark, sf_dir).select("hash", "doc_id", "kind")).withColumn("rank", F.round("rank", 6))


@query()
def search_page(spark, sf_dir):
    """The 20 best blobs of a query with the best window of each; tests hold windows against a full-text engine."""
    found = X.page(X.find(_index(spark, sf_dir), '"of the" OR with OR erth'), D.content_store(spark, sf_dir), 20)
    return found.withColumn("rank", F.round("rank", 6))


@query()
def snippets(spark, sf_dir):
    rows = D.content_store(spark, sf_dir)
    return rows.select("hash", H.snippet(F.col("content"), F.array(F.lit("with"), F.lit("avec"))).alias("snippet"))


_CONTEXT = """, c AS (SELECT h.hash, h.rank, doc_id AS message_id, tool_name AS type, e.session_id, project_slug, owner AS summary
      FROM h LEFT JOIN blob_references b USING (hash) LEFT JOIN event_calls e ON e.id = b.doc_id LEFT JOIN sessions s ON s.id = e.session_id)"""
_KIND = """, f AS (SELECT hash, CASE col WHEN 'kind' THEN 0 ELSE 1 END AS phrase, count(*) AS f FROM t
      WHERE (col = 'kind' AND term = 'src1') OR (col = 'content' AND term = 'with') GROUP BY 1, 2)""" + _SCORE + ", h AS (SELECT hash, rank FROM sc WHERE held = 2)" + _CONTEXT
_WORD = ", f AS (SELECT hash, 0 AS phrase, count(*) AS f FROM t WHERE term = 'with' GROUP BY 1)" + _SCORE + ", h AS (SELECT hash, rank FROM sc)" + _CONTEXT


def _search(spark, sf_dir, text, project=None):
    """Blobs are referred to by events as messages, in orders as sessions (an event's user is its order)."""
    references = D.blob_references(spark, sf_dir).withColumnRenamed("doc_id", "message_id")
    messages = D.event_calls(spark, sf_dir).withColumnRenamed("tool_name", "type")
    return H.with_context(_ranked(spark, sf_dir, text), references, messages, D.sessions(spark, sf_dir).withColumnRenamed("owner", "summary"), project)


@query(_INDEX + _KIND + """SELECT hash, kind, round(rank, 6) AS rank, message_id, type, session_id, project_slug, summary FROM c JOIN content_store USING (hash)
    ORDER BY c.rank, c.hash, message_id LIMIT 20""")
def search_filtered(spark, sf_dir):
    found = _search(spark, sf_dir, "kind:src1 AND content:With")
    return H.page_of_hits(found, D.content_store(spark, sf_dir), ["with"], 20).drop("snippet").withColumn("rank", F.round("rank", 6))


@query(_INDEX + _WORD + """SELECT hash, round(rank, 6) AS rank, message_id, type, session_id, project_slug, summary FROM c WHERE project_slug = '1-URGENT'""")
def search_project(spark, sf_dir):
    return _search(spark, sf_dir, "with", project="1-URGENT").withColumn("rank", F.round("rank", 6))


@query(_INDEX + _WORD + "SELECT count(*) AS total FROM c")
def search_total(spark, sf_dir):
    return _search(spark, sf_dir, "with").agg(F.count("*").alias("total"))


# -- enrichment input -------------------------------------------------------------------------


@query("""SELECT session_id, string_agg(DISTINCT tool_name, ', ' ORDER BY tool_name) AS tools FROM tool_calls GROUP BY 1""")
def digest_input(spark, sf_dir):
    return D.tool_calls(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("tool_name")), ", ").alias("tools"))


@query("""WITH m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, id) AS rank FROM messages),
    n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, id) AS number FROM m WHERE rank <= 40 AND content <> ''),
    l AS (SELECT session_id, number, type || ': ' || CASE WHEN strlen(content) <= 500 THEN content
      ELSE substr(content, 1, CAST(len(list_filter(range(1, 501), lambda k: strlen(substr(content, 1, CAST(k AS INTEGER))) <= 500)) AS INTEGER)) || '...' END AS line FROM n WHERE number <= 20),
    b AS (SELECT *, coalesce(sum(strlen(line)) OVER (PARTITION BY session_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes FROM l)
    SELECT session_id, string_agg(line, chr(10) ORDER BY number) AS digest FROM b WHERE bytes < 7500 GROUP BY 1""")
def session_digest(spark, sf_dir):
    from ..operators.enrich import digests

    return digests(D.messages(spark, sf_dir), ["turn_index", "id"])


@query()
def heuristic_enrichment(spark, sf_dir):
    from ..operators.enrich import digests, enrich

    return enrich(digests(D.messages(spark, sf_dir), ["turn_index", "id"]))


@query("""--raw
    SELECT doc_id, CASE WHEN text IS NULL OR strlen(text) <= 40 THEN text
      ELSE substr(text, 1, CAST(len(list_filter(range(1, 41), lambda k: strlen(substr(text, 1, CAST(k AS INTEGER))) <= 40)) AS INTEGER)) || '...' END AS short FROM documents""")
def short_texts(spark, sf_dir):
    """Every document's text cut at 40 bytes, at the edge of a character."""
    return table(spark, sf_dir, "documents").select("doc_id", T.cut_bytes(F.col("text"), 40).alias("short"))


@query()
def cut_texts(spark, sf_dir):
    """The same as ``short_texts``; held against a brute-force version instead of SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", T.cut_bytes(F.col("text"), 40).alias("short"))


@query("""WITH r AS (SELECT s.*, outcome, reason_code FROM sessions s LEFT JOIN outcomes o ON o.session_id = s.id WHERE created_at >= '1995-01-01' AND created_at < '1995-01-08'),
    f AS (SELECT * FROM r ORDER BY created_at, id LIMIT 50)
    SELECT count(*) AS session_count, count(*) FILTER (WHERE outcome = 'success') AS success_count, count(*) FILTER (WHERE outcome = 'failed') AS failed_count,
      count(*) FILTER (WHERE outcome = 'partial') AS partial_count, count(*) FILTER (WHERE outcome = 'abandoned') AS abandoned_count,
      CAST(coalesce(sum(message_count), 0) AS BIGINT) AS message_count,
      (SELECT string_agg(project_slug || ' ' || id || ': ' || coalesce(outcome, 'unlabeled') || coalesce(' (' || reason_code || ')', ''), chr(10) ORDER BY created_at, id) FROM f) AS content
    FROM r""")
def weekly_digest(spark, sf_dir):
    from ..operators.enrich import weekly

    return weekly(D.sessions(spark, sf_dir), D.outcomes(spark, sf_dir), "1995-01-01", "1995-01-08")


@query()
def classified_sessions(spark, sf_dir):
    from ..operators.enrich import classify, digests

    return classify(digests(D.messages(spark, sf_dir), ["turn_index", "id"]))


def _learned_sql() -> str:
    pairs = [(c, k) for c, kinds in O.CLASSES.items() for k in kinds]
    counts = ", ".join(f"count(*) FILTER (WHERE {c} = '{k}') AS {c}_{k}" for c, k in pairs)
    every = {c: " + ".join(f"{c}_{k}" for k in kinds) for c, kinds in O.CLASSES.items()}
    weight = ", ".join(
        f"""CASE WHEN bucket >= 0 AND {every[c]} = 0 THEN 0 ELSE CAST(round(ln(({c}_{k} + 1) / CAST(CASE WHEN bucket = -1 THEN {every[c]} + {len(O.CLASSES[c])}
          ELSE sum({c}_{k}) FILTER (WHERE bucket >= 0) OVER () + count(*) FILTER (WHERE bucket >= 0 AND {every[c]} > 0) OVER () END AS DOUBLE)) * {O.SCALE}) AS BIGINT) END AS {c}_{k}"""
        for c, k in pairs
    )
    sums = ", ".join(f"CAST(sum({c}_{k}) AS BIGINT) AS {c}_{k}" for c, k in pairs)
    best = {c: f"greatest({', '.join(f'{c}_{k}' for k in kinds)})" for c, kinds in O.CLASSES.items()}
    first = {c: "CASE " + " ".join(f"WHEN {c}_{k} = {best[c]} THEN '{k}'" for k in kinds) + " END" for c, kinds in O.CLASSES.items()}
    parts = " + ".join(f"exp((outcome_{k} - {best['outcome']}) / CAST({O.SCALE} AS DOUBLE))" for k in O.OUTCOMES)
    return f"""WITH w AS (SELECT doc_id AS session_id, [-1] || list_distinct(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER))) AS buckets FROM documents),
    l AS (SELECT session_id, outcome, CASE WHEN outcome <> 'success' THEN coalesce(reason_code, 'unknown') END AS reason_code FROM outcomes WHERE outcome IS NOT NULL),
    x AS (SELECT unnest(buckets) AS bucket, outcome, reason_code FROM w JOIN l USING (session_id) UNION ALL SELECT range, NULL, NULL FROM range(-1, {O.BUCKETS})),
    c AS (SELECT bucket, {counts} FROM x GROUP BY bucket),
    m AS (SELECT bucket, {weight} FROM c),
    t AS (SELECT session_id, unnest(buckets) AS bucket FROM w WHERE session_id NOT IN (SELECT session_id FROM l)),
    s AS (SELECT session_id, {sums} FROM t JOIN m USING (bucket) GROUP BY session_id)
    SELECT session_id, {first['outcome']} AS outcome, CASE WHEN {first['outcome']} <> 'success' THEN {first['reason_code']} END AS reason_code, round(1 / ({parts}), 4) AS probability FROM s"""


@query(_learned_sql())
def learned_outcomes(spark, sf_dir):
    """What the labelled documents teach about those without a label, by the words of their whole texts."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("digest"))
    return O.learned(texts, D.outcomes(spark, sf_dir), words=T.plain_tokens)


@query("""WITH d AS (SELECT CAST(day AS VARCHAR) AS date, count(DISTINCT session_id) AS session_count FROM event_calls GROUP BY 1),
    s AS (SELECT *, CAST(date AS DATE) - CAST(dayofweek(CAST(date AS DATE)) AS INTEGER) AS sunday FROM d)
    SELECT date, session_count, CAST((sunday - (SELECT min(sunday) FROM s)) // 7 AS BIGINT) AS week, CAST(dayofweek(CAST(date AS DATE)) AS INTEGER) AS weekday,
      least(session_count / 8.0, 1.0) AS intensity FROM s""")
def activity_heatmap(spark, sf_dir):
    days = D.event_calls(spark, sf_dir).groupBy(F.col("day").cast("string").alias("date")).agg(F.countDistinct("session_id").alias("session_count"))
    return A.heatmap(days)


@query("""SELECT DISTINCT project_slug, CAST(list_sum(list_transform(string_split(project_slug, ''), lambda c: ascii(c))) % 8 AS INTEGER) AS colour FROM sessions""")
def project_colours(spark, sf_dir):
    rows = D.sessions(spark, sf_dir).select("project_slug").distinct()
    return A.card(rows, "project_slug", F.lit(None).cast("string")).select("project_slug", "colour")


@query("""WITH n AS (SELECT max(CAST(created_at AS TIMESTAMP)) + INTERVAL 810 MINUTE AS now FROM sessions),
    h AS (SELECT id, CAST(created_at AS TIMESTAMP) AS t, (epoch_us(now) - epoch_us(CAST(created_at AS TIMESTAMP))) / 3.6e9 AS h FROM sessions, n)
    SELECT id, CASE WHEN h < 1 THEN 'just now' WHEN h < 24 THEN CAST(floor(h) AS BIGINT) || 'h ago' WHEN h < 48 THEN 'yesterday' ELSE strftime(t, '%b %-d') END AS age FROM h""")
def session_ages(spark, sf_dir):
    """Ages of all sessions, seen half a day and more behind the last one."""
    rows = D.sessions(spark, sf_dir)
    now = F.broadcast(rows.agg((F.max(F.to_timestamp("created_at")) + F.expr("INTERVAL 810 MINUTES")).alias("now")))  # one row
    return rows.crossJoin(now).select("id", A.age(F.to_timestamp("created_at"), F.col("now")).alias("age"))


# -- analyses of tokens and files ---------------------------------------------------------------


@query("""SELECT tool_name AS model, count(*) AS messages, count(DISTINCT session_id) AS sessions FROM event_calls GROUP BY 1""")
def model_sessions(spark, sf_dir):
    return A.model_sessions(D.event_calls(spark, sf_dir).withColumnRenamed("tool_name", "model"))


@query("""SELECT coalesce(nullif(lower(regexp_extract(coalesce(p_name, ''), '[.]([A-Za-z0-9]+)$', 1)), ''), 'none') AS extension, count(*) AS calls, count(DISTINCT p_name) AS files
    FROM tool_calls LEFT JOIN (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_name || '.' || p_brand[-1] END AS p_name FROM part WHERE p_partkey % 5 <> 0) ON p_partkey = input_hash
    WHERE tool_name IN ('AF', 'RF') GROUP BY 1""")
def reads_by_extension(spark, sf_dir):
    path = F.when(F.col("p_partkey") % 4 != 0, F.concat("p_name", F.lit("."), F.right("p_brand", F.lit(1))))
    inputs = table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("hash"), path.alias("path"))
    return A.reads_by_extension(D.tool_calls(spark, sf_dir), inputs, F.col("tool_name").isin("AF", "RF"))


@query("""WITH placed AS (SELECT session_id, id, count(*) OVER (PARTITION BY session_id) - row_number() OVER (PARTITION BY session_id ORDER BY turn_index, id) + 1 AS remaining FROM tool_calls)
    SELECT tool_name, count(*) AS calls, CAST(sum(s) AS BIGINT) AS bytes, CAST(sum(s * remaining) AS BIGINT) AS burden
    FROM tool_calls c JOIN placed p ON p.id = c.id JOIN (SELECT s_suppkey, CAST(round(s_acctbal) AS BIGINT) AS s FROM supplier WHERE s_acctbal > 0) ON s_suppkey = output_hash GROUP BY 1""")
def burden_by_output(spark, sf_dir):
    calls = D.tool_calls(spark, sf_dir)
    placed = U.positions(calls.select("session_id", "id", "turn_index"), ["turn_index", "id"])
    blobs = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("hash"), F.round("s_acctbal").cast("long").alias("size"))
    return U.by_output(calls.withColumn("message_id", F.col("id")), placed, blobs)


_FILED = "SELECT id, session_id, tool_name, sec, CAST(floor(value) AS BIGINT) % 3 AS file_path FROM event_calls WHERE value IS NOT NULL"


@query(f"""WITH c AS ({_FILED}) SELECT a.session_id, a.file_path, a.id, b.id AS then_id, b.sec - a.sec AS gap FROM c a JOIN c b
    ON a.session_id = b.session_id AND a.file_path = b.file_path AND a.tool_name = 'view' AND b.tool_name = 'click' AND b.sec > a.sec AND b.sec <= a.sec + 14400""")
def edit_of_same_file_window(spark, sf_dir):
    calls = D.event_calls(spark, sf_dir).filter("value IS NOT NULL").withColumn("file_path", F.expr("CAST(floor(value) AS BIGINT) % 3"))
    return U.followed_within(calls, "view", "click", 14400, ("session_id", "file_path"))


@query("--raw\n SELECT count(*) FILTER (WHERE quality IS NULL OR quality < 1) AS outdated, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id)")
def outdated_versions(spark, sf_dir):
    return A.outdated(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"), "quality", 1)


@query("""WITH t AS (SELECT count(*) AS total, count(*) FILTER (WHERE type = 'user') AS done FROM messages)
    SELECT total, CAST(greatest(1, ceil(total / 20.0)) AS BIGINT) AS pages, CAST(3 AS BIGINT) AS page, round(least(100.0, 100.0 * done / total), 6) AS percent FROM t""")
def page_and_progress(spark, sf_dir):
    totals = D.messages(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("type") == "user").alias("done"))
    return totals.select("total", *A.page_numbers(F.col("total"), 20, 40), A.progress(F.col("done"), F.col("total")).alias("percent"))


@query("""SELECT id, CASE WHEN length(content) > 80 THEN substr(content, 1, 80) || chr(10) || '... (truncated)' ELSE content END AS shown FROM messages""")
def truncated_messages(spark, sf_dir):
    return D.messages(spark, sf_dir).select("id", A.marked_cut(F.col("content"), 80).alias("shown"))


@query("""WITH t AS (SELECT max(CAST(created_at AS DATE)) AS today FROM sessions)
    SELECT d AS days, (SELECT count(*) FROM sessions, t WHERE created_at >= CAST(today - CAST(d AS INTEGER) AS VARCHAR)) AS sessions FROM (VALUES (7), (30), (90), (180), (365)) v(d)
    UNION ALL SELECT 0, count(*) FROM sessions""")
def trailing_windows(spark, sf_dir):
    rows = D.sessions(spark, sf_dir).select("created_at", F.to_date("created_at").alias("day"))
    today = F.broadcast(rows.agg(F.max("day").alias("today")))  # one row
    spans = (7, 30, 90, 180, 365)
    counts = [F.count_if(F.col("created_at") >= A.trailing_start(F.col("today"), d)).alias(str(d)) for d in spans]
    totals = rows.crossJoin(today).agg(*counts, F.count("*").alias("0"))
    return totals.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, (*spans, 0))), F.array(*[F.col(f"`{d}`") for d in (*spans, 0)]))).alias("days", "sessions"))


@query("""--raw
    SELECT page_id, string_split(url, '/')[-1] AS name, CASE WHEN length(url) >= 36 THEN right(url, 36) END AS tail, url NOT LIKE '%' || chr(10) || '%' AND regexp_full_match(url, 'http://[^/]*/(.*/)?[0-9]*[.]html') AS fits FROM pages""")
def path_functions(spark, sf_dir):
    url = F.col("url")
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", T.last_segment(url).alias("name"), T.trailing_uuid(url).alias("tail"), url.rlike(r"^http://[^/]*/(?:.*/)?[0-9]*\.html$").alias("fits"))


@query("""SELECT id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824.0) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576.0) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024.0)
      ELSE n || ' B' END AS shown, strftime(to_timestamp(n // 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp FROM (SELECT id, sec * (id % 4 + 1) % 5000000000 AS n FROM event_calls)""")
def value_functions(spark, sf_dir):
    rows = D.event_calls(spark, sf_dir).select("id", F.expr("sec * (id % 4 + 1) % 5000000000").alias("n"))
    return rows.select("id", T.human_bytes(F.col("n")).alias("shown"), T.epoch_millis_text(F.col("n")).alias("stamp"))


@query("""SELECT s.id, coalesce(CASE WHEN outcome = 'success' THEN reason_code END, source_kind, s.project_slug) AS title FROM sessions s LEFT JOIN outcomes o ON o.session_id = s.id""")
def display_titles(spark, sf_dir):
    known = D.outcomes(spark, sf_dir).select(F.col("session_id").alias("id"), "outcome", "reason_code")
    title = R.display_title(F.col("outcome") == "success", F.col("reason_code"), F.col("source_kind"), F.col("project_slug"))
    return D.sessions(spark, sf_dir).join(known, "id", "left").select("id", title.alias("title"))


@query("""WITH t AS (SELECT session_id, tool_name AS tag, count(*) AS confidence FROM tool_calls GROUP BY 1, 2)
    SELECT id, coalesce(string_agg(tag, ',' ORDER BY confidence DESC, tag), '') AS tags FROM sessions LEFT JOIN t ON t.session_id = id GROUP BY 1""")
def session_tags(spark, sf_dir):
    tags = D.tool_calls(spark, sf_dir).groupBy(F.col("session_id").alias("id"), F.col("tool_name").alias("tag")).agg(F.count("*").alias("confidence"))
    return R.tags_of(D.sessions(spark, sf_dir).select("id"), tags, "id").select("id", F.array_join("tags", ",").alias("tags"))


# -- stored enrichments, outcomes, digests and lists ---------------------------------------------


def _enriched(spark, sf_dir):
    """Conversations as enriched sessions: a tag for each role, its confidence the role's share of the turns."""
    rows = D.messages(spark, sf_dir).groupBy("session_id", "type").agg(F.count("*").alias("n"))
    tags = rows.groupBy("session_id").agg(F.sum("n").alias("all"), F.collect_list(F.struct("type", "n")).alias("t"))
    tags = tags.select("session_id", F.transform("t", lambda t: F.struct(t["type"].alias("tag"), F.round(t["n"] / F.col("all"), 6).alias("confidence"))).alias("tags"))
    sure = F.forall("tags", lambda t: t["confidence"] >= 0.5)
    return tags.withColumn("title", F.concat(F.lit("conversation "), F.col("session_id").cast("string"))).withColumn("approval_status", F.when(sure, "approved").otherwise("pending_review"))


_SHARES = """WITH n AS (SELECT session_id, type AS tag, count(*) AS n FROM messages GROUP BY 1, 2),
    g AS (SELECT session_id, tag, round(n / sum(n) OVER (PARTITION BY session_id), 6) AS confidence FROM n)"""


@query(_SHARES + """SELECT session_id, 'conversation ' || session_id AS title, '2025-01-01' AS enriched_at, 'stub' AS model, 2 AS version,
    CASE WHEN min(confidence) >= 0.5 THEN 'approved' ELSE 'pending_review' END AS approval_status, CASE WHEN min(confidence) >= 0.5 THEN '2025-01-01' END AS reviewed_at FROM g GROUP BY 1""")
def stored_enrichments(spark, sf_dir):
    return S.stored_enrichments(_enriched(spark, sf_dir), "stub", "2025-01-01", 2)[0]


@query(_SHARES + """SELECT * FROM g UNION ALL SELECT doc_id, source, 1.0 FROM documents WHERE source IS NOT NULL AND doc_id NOT IN (SELECT session_id FROM g WHERE session_id IS NOT NULL)""")
def stored_tags(spark, sf_dir):
    """Documents have their source as a tag, until the conversation of the same id is enriched."""
    old = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select(F.col("doc_id").alias("session_id"), F.col("source").alias("tag"), F.lit(1.0).alias("confidence"))
    enriched = _enriched(spark, sf_dir)
    return S.retagged(old, S.stored_enrichments(enriched, "stub", "2025-01-01", 2)[1], enriched)


@query("""SELECT session_id, CASE WHEN session_id % 7 = 0 THEN 'partial' ELSE outcome END AS outcome, CASE WHEN session_id % 7 = 0 THEN 'unknown' ELSE reason_code END AS reason_code,
    session_id % 7 = 0 AS is_user_labeled FROM outcomes""")
def manual_outcomes(spark, sf_dir):
    known = D.outcomes(spark, sf_dir).select("session_id", "outcome", "reason_code", F.lit(False).alias("is_user_labeled"))
    labels = known.filter("session_id % 7 = 0").select("session_id", F.lit("partial").alias("outcome"), F.lit("unknown").alias("reason_code"))
    return S.labelled(known, labels, by_user=True)


@query("SELECT id, created_at, modified_at, project_slug FROM sessions ORDER BY modified_at DESC, id LIMIT 50 OFFSET 10")
def sessions_by_modified(spark, sf_dir):
    return S.newest(D.sessions(spark, sf_dir).select("id", "created_at", "modified_at", "project_slug"), "modified_at", "id", 50, 10)


@query("""SELECT id, session_id, content_hash, tool_input_hash, p.p_name AS content, q.p_name AS tool_input FROM (SELECT id, session_id, input_hash AS content_hash, output_hash AS tool_input_hash FROM tool_calls) c
    LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) p ON p.p_partkey = content_hash LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) q ON q.p_partkey = tool_input_hash""")
def block_contents(spark, sf_dir):
    blocks = D.tool_calls(spark, sf_dir).select("id", "session_id", F.col("input_hash").alias("content_hash"), F.col("output_hash").alias("tool_input_hash"))
    blobs = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("hash"), F.col("p_name").alias("content"))
    return R.blocks_with_contents(blocks, blobs)


@query("""WITH t AS (SELECT session_id, tool_name, lag(tool_name) OVER (PARTITION BY session_id ORDER BY sec, id) AS before FROM event_calls)
    SELECT session_id, count(*) FILTER (WHERE before = 'view' AND tool_name = 'click') > 2 AS ping_pong FROM t GROUP BY 1""")
def transition_tripwire(spark, sf_dir):
    calls = D.event_calls(spark, sf_dir)
    return U.with_transitions(calls.select("session_id").distinct(), calls, "view", "click", 2, ["sec", "id"])


@query("SELECT substr(created_at, 1, 10) AS date, string_agg(DISTINCT project_slug, ',' ORDER BY project_slug) AS projects FROM sessions GROUP BY 1")
def day_projects(spark, sf_dir):
    return A.day_projects(D.sessions(spark, sf_dir)).select(F.col("date").cast("string").alias("date"), F.array_join("projects", ",").alias("projects"))


# -- event-time windows (an addition: batch runs of what the streams do) -------------------------


def _stamped(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _shown(rows: DataFrame, window: str) -> DataFrame:
    text = lambda c: F.date_format(c, D.STAMP)
    return rows.withColumn("start", text(F.col(f"{window}.start"))).withColumn("end", text(F.col(f"{window}.end"))).drop(window)


@query("""--raw
    SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end",
    event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2, 3""")
def event_windows_tumbling(spark, sf_dir):
    from ..streaming.tail import tumbling

    return _shown(tumbling(_stamped(spark, sf_dir), "ts", "1 hour", "event_type"), "window")


@query("""--raw
    WITH w AS (SELECT date_trunc('hour', ts) - to_hours(CAST(i AS INTEGER)) AS s, value FROM events, range(2) r(i))
    SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, strftime(s + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY 1, 2""")
def event_windows_sliding(spark, sf_dir):
    from ..streaming.tail import tumbling

    return _shown(tumbling(_stamped(spark, sf_dir), "ts", "2 hours", slide="1 hour"), "window")


@query("""--raw
    WITH l AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM l)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n, round(sum(value), 6) AS total
    FROM g GROUP BY user_id, run""")
def event_windows_session(spark, sf_dir):
    from ..streaming.tail import session_windows

    return _shown(session_windows(_stamped(spark, sf_dir), "ts", "6 hours", "user_id"), "session_window")
