"""Tenant-scoped reads, access decisions and keyed changes, on nation as offices, supplier as users, customer as clients, orders as
cases and lineitem as invoice lines and milestones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.dml import delete_keys, insert_ignore, partial_update, upsert
from docketry.operators.policies import Policies
from docketry.operators.tenancy import TenantView, leaked
from docketry.plans.base import Tables, query


@query("SELECT c_custkey AS client_id, c_name AS name, c_nationkey AS office_id FROM customer")
def tenant_scan(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("client_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("office_id"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 7 AND c_mktsegment = 'BUILDING'")
def filter_eq(t: Tables) -> DataFrame:
    return TenantView(t.customer, 7, "c_nationkey").rows(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_custkey = 5")
def cases_filtered(t: Tables) -> DataFrame:
    wanted = {"o_orderstatus": "O", "o_custkey": 5, "o_orderpriority": None}
    out = t.orders
    for column, value in wanted.items():
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 5, 8, 13, 21)")
def filter_in(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_custkey").isin(1, 2, 5, 8, 13, 21)).select("o_orderkey", "o_custkey")


_INVITES = """(SELECT 'tok' || CAST(c_custkey AS STRING) AS token, c_nationkey AS office_id, CASE WHEN c_custkey % 3 = 0 THEN 'Client' ELSE 'client' END || CAST(c_custkey AS STRING) || '@x.org' AS email,
CASE WHEN c_custkey % 7 = 0 THEN 'admin' ELSE 'member' END AS role, CASE c_custkey % 4 WHEN 0 THEN TIMESTAMP '2024-01-05 00:00:00' WHEN 1 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS expires_at,
CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' END AS accepted_at FROM customer) AS t"""


@query(f"SELECT token, office_id, email FROM {_INVITES} WHERE accepted_at IS NULL")
def pending_invites(t: Tables) -> DataFrame:
    return t.made(_INVITES).where(F.col("accepted_at").isNull()).select("token", "office_id", "email")


_REQUESTS = """(SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 11 = 0 THEN 'none' ELSE 'tok' END || CAST(s_suppkey * 3 + s_suppkey % 2 AS STRING) AS token,
CASE WHEN s_suppkey % 6 = 0 THEN 'other' ELSE 'CLIENT' END || CAST(s_suppkey * 3 + s_suppkey % 2 AS STRING) || '@X.org' AS caller FROM supplier) AS r"""
_STATUS = "CASE WHEN i.office_id IS NULL THEN 'not_found' WHEN i.accepted_at IS NOT NULL THEN 'used' WHEN i.expires_at < TIMESTAMP '2024-01-15 00:00:00' THEN 'expired' WHEN lower(i.email) <> lower(r.caller) THEN 'email_mismatch' ELSE 'ok' END"


def _invite_status():
    return F.when(F.col("office_id").isNull(), "not_found").when(F.col("accepted_at").isNotNull(), "used").when(F.col("expires_at") < F.lit("2024-01-15 00:00:00").cast("timestamp"), "expired").when(F.lower("email") != F.lower("caller"), "email_mismatch").otherwise("ok")


@query(f"SELECT r.token, r.caller, {_STATUS} AS status FROM {_REQUESTS} LEFT JOIN (SELECT * FROM {_INVITES}) i ON r.token = i.token")
def invite_status(t: Tables) -> DataFrame:
    return t.made(_REQUESTS).join(t.made(_INVITES), "token", "left").select("token", "caller", _invite_status().alias("status"))


@query(f"SELECT i.token, i.email, i.role, n.n_name AS office FROM (SELECT * FROM {_INVITES}) i JOIN nation n ON n.n_nationkey = i.office_id")
def invite_preview(t: Tables) -> DataFrame:
    return t.made(_INVITES).join(t.nation, F.col("office_id") == F.col("n_nationkey")).select("token", "email", "role", F.col("n_name").alias("office"))


@query(f"""SELECT s.s_suppkey AS user_id, CASE WHEN a.office_id IS NOT NULL THEN a.office_id ELSE s.s_nationkey END AS office_id FROM supplier s
LEFT JOIN (SELECT i.office_id, r.user_id FROM {_REQUESTS} JOIN (SELECT * FROM {_INVITES}) i ON r.token = i.token WHERE ({_STATUS}) = 'ok') a ON a.user_id = s.s_suppkey""")
def accept_invite(t: Tables) -> DataFrame:
    ok = t.made(_REQUESTS).join(t.made(_INVITES), "token").where(_invite_status() == "ok").select("office_id", "user_id")
    users = t.supplier.select(F.col("s_suppkey").alias("user_id"), "s_nationkey")
    return users.join(ok, "user_id", "left").select("user_id", F.coalesce("office_id", "s_nationkey").alias("office_id"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr' AND source IN ('src1', 'src2', 'src3')")
def meta_filter_in(t: Tables) -> DataFrame:
    return t.documents.where((F.col("lang") == "fr") & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "lang")


@query("SELECT o.o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey = 3)")
def assert_in_office(t: Tables) -> DataFrame:
    mine = TenantView(t.customer, 3, "c_nationkey").rows()
    return t.orders.join(mine, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey = 11")
def rls_select(t: Tables) -> DataFrame:
    return TenantView(t.customer, 11, "c_nationkey").rows().select("c_custkey", "c_name", "c_acctbal")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 4 OR s_name = 'Supplier#000000009' OR s_nationkey = 2")
def rls_users(t: Tables) -> DataFrame:
    return t.supplier.where((F.col("s_suppkey") == 4) | (F.col("s_name") == "Supplier#000000009") | (F.col("s_nationkey") == 2)).select("s_suppkey", "s_name")


@query("SELECT l.doc_id FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang IN ('de', 'es'))")
def rls_role_exists(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.where(F.col("lang").isin("de", "es")).select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey IS NOT NULL AND c_nationkey <> 7 AND c_mktsegment = 'BUILDING'")
def tenancy_canary(t: Tables) -> DataFrame:
    return leaked(t.customer.where(F.col("c_mktsegment") == "BUILDING"), 7, "c_nationkey").select("c_custkey", "c_nationkey")


@query("SELECT c_custkey AS id, c_name AS full_name, coalesce(c_mktsegment, '') AS segment, CAST(c_nationkey AS VARCHAR) AS office, c_acctbal < 0 AS in_debt FROM customer")
def normalize_client(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.coalesce("c_mktsegment", F.lit("")).alias("segment"), F.col("c_nationkey").cast("string").alias("office"), (F.col("c_acctbal") < 0).alias("in_debt"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 3 OR s_acctbal > 9000")
def self_or_super(t: Tables) -> DataFrame:
    return t.supplier.where((F.col("s_suppkey") == 3) | (F.col("s_acctbal") > 9000)).select("s_suppkey", "s_name")


_CALLERS = "(SELECT s_suppkey AS user_id, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS office_id, CASE s_suppkey % 3 WHEN 0 THEN 'member' WHEN 1 THEN 'admin' ELSE 'owner' END AS office_role FROM supplier) AS t"


@query(f"SELECT user_id, CASE WHEN office_id IS NULL THEN 409 ELSE 200 END AS any_member, CASE WHEN office_id IS NULL THEN 409 WHEN office_role IN ('admin', 'owner') THEN 200 ELSE 403 END AS as_admin, CASE WHEN office_id IS NULL THEN 409 WHEN office_role = 'owner' THEN 200 ELSE 403 END AS as_owner FROM {_CALLERS}")
def authz_decision(t: Tables) -> DataFrame:
    homeless = F.col("office_id").isNull()

    def ladder(*roles: str):
        return F.when(homeless, 409).when(F.col("office_role").isin(*roles), 200).otherwise(403)

    return t.made(_CALLERS).select("user_id", F.when(homeless, 409).otherwise(200).alias("any_member"), ladder("admin", "owner").alias("as_admin"), ladder("owner").alias("as_owner"))


_CONSENTS = """(SELECT c_custkey AS user_id, 'ai' AS purpose, CASE WHEN c_custkey % 3 = 0 THEN '2023-01' ELSE '2024-06' END AS version, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-07-01 00:00:00' END AS withdrawn_at FROM customer
UNION ALL SELECT c_custkey, 'mail', '2024-06', CASE WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2024-07-01 00:00:00' END FROM customer WHERE c_custkey % 2 = 0) AS t"""
_NEW_CONSENTS = "(SELECT c_custkey * 2 AS user_id, CASE WHEN c_custkey % 8 = 1 THEN 'mail' ELSE 'ai' END AS purpose, '2024-06' AS version, CAST(NULL AS TIMESTAMP) AS withdrawn_at FROM customer WHERE c_custkey % 4 = 1) AS t"


@query(f"SELECT user_id, purpose, withdrawn_at IS NULL AND version = '2024-06' AS active FROM {_CONSENTS}")
def consent_active(t: Tables) -> DataFrame:
    return t.made(_CONSENTS).select("user_id", "purpose", (F.col("withdrawn_at").isNull() & (F.col("version") == "2024-06")).alias("active"))


@query(f"SELECT * FROM {_CONSENTS} WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM {_NEW_CONSENTS}) n WHERE n.user_id = t.user_id AND n.purpose = t.purpose) UNION ALL SELECT * FROM {_NEW_CONSENTS}")
def consent_upsert(t: Tables) -> DataFrame:
    return upsert(t.made(_CONSENTS), t.made(_NEW_CONSENTS), "user_id", "purpose")


@query(f"SELECT user_id, purpose, CASE WHEN user_id % 10 = 1 THEN FALSE ELSE withdrawn_at IS NULL AND version = '2024-06' END AS active, CASE WHEN user_id % 10 = 1 OR withdrawn_at IS NOT NULL THEN 'withdrawn' WHEN version = '2024-06' THEN 'granted' ELSE 'outdated' END AS status FROM {_CONSENTS}")
def consent_status(t: Tables) -> DataFrame:
    rows = partial_update(t.made(_CONSENTS), {"withdrawn_at": F.lit("2024-08-01").cast("timestamp")}, F.col("user_id") % 10 == 1)
    gone, current = F.col("withdrawn_at").isNotNull(), F.col("version") == "2024-06"
    return rows.select("user_id", "purpose", (~gone & current).alias("active"), F.when(gone, "withdrawn").when(current, "granted").otherwise("outdated").alias("status"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer", name="partial_update")
def partial_update_rows(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_nationkey")
    return partial_update(rows, {"c_mktsegment": F.lit("MOVED")}, F.col("c_custkey") % 10 == 0)


_FILES = "(SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS case_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS client_id FROM documents) AS t"


@query(f"SELECT id FROM {_FILES} WHERE (case_id IS NULL) = (client_id IS NULL)")
def xor_violation(t: Tables) -> DataFrame:
    return t.made(_FILES).where(F.col("case_id").isNull() == F.col("client_id").isNull()).select("id")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.page'), json_extract_string(props, '$.ref'), event_type) AS label FROM events""")
def coalesce_backfill(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.page"), F.get_json_object("props", "$.ref"), "event_type").alias("label"))


@query("""SELECT event_id, list_contains(json_keys(props), 'page') AS has_page FROM events""")
def json_has_key(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.array_contains(F.json_object_keys("props"), "page"), F.lit(False)).alias("has_page"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END, 1) AS office_id FROM customer")
def backfill_default(t: Tables) -> DataFrame:
    holes = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey")).alias("office_id"))
    return holes.select("c_custkey", F.coalesce("office_id", F.lit(1)).alias("office_id"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, 12) AS office_id, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM customer")
def auto_stamp(t: Tables) -> DataFrame:
    new = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")).alias("office_id"))
    return TenantView(new, 12).stamp(new).withColumn("updated_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 50 OR c_custkey % 2 = 0", name="insert_ignore")
def insert_ignore_rows(t: Tables) -> DataFrame:
    base, new = t.customer.where("c_custkey <= 50").select("c_custkey", "c_name"), t.customer.where("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return insert_ignore(base, new, "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer")
def upsert_by_id(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_mktsegment").alias("segment"))
    return upsert(rows, rows.where("c_custkey % 5 = 0").withColumn("segment", F.lit("new")), "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> 0")
def delete_by_ids(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey")
    return delete_keys(rows, rows.where("o_orderkey % 7 = 0"), "o_orderkey")


@query("""SELECT 'client' AS kind, c_custkey AS id, CAST(NULL AS BIGINT) AS part FROM customer WHERE c_custkey % 10 <> 0
UNION ALL SELECT 'case', o_orderkey, NULL FROM orders WHERE o_custkey % 10 <> 0
UNION ALL SELECT 'invoice', l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_custkey % 10 = 0)""")
def cascade_delete_client(t: Tables) -> DataFrame:
    """What is left once every tenth client is gone: clients, their cases, the cases' invoices."""
    gone = t.customer.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    cases = t.orders.select("o_orderkey", "o_custkey")
    gone_cases = cases.join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    none = F.lit(None).cast("long").alias("part")
    clients = t.customer.join(gone, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("client").alias("kind"), F.col("c_custkey").alias("id"), none)
    left = delete_keys(cases, gone, "o_custkey").select(F.lit("case").alias("kind"), F.col("o_orderkey").alias("id"), none)
    invoices = delete_keys(t.lineitem.select("l_orderkey", "l_linenumber"), gone_cases, "l_orderkey").select(F.lit("invoice").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("part"))
    return clients.unionByName(left).unionByName(invoices)


# A case's rows, by their number: documents, milestones, invoices.
_CASE_ROWS = "CASE l_linenumber % 3 WHEN 0 THEN 'document' WHEN 1 THEN 'milestone' ELSE 'invoice' END"


@query(f"""SELECT {_CASE_ROWS} AS kind, l_orderkey, l_linenumber, CASE WHEN o.o_orderkey IS NULL THEN l_orderkey END AS case_id FROM lineitem l
LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0) o ON o.o_orderkey = l.l_orderkey WHERE o.o_orderkey IS NULL OR l_linenumber % 3 = 2""")
def cascade_delete_case(t: Tables) -> DataFrame:
    """Documents and milestones of a deleted case go with it, invoices stay without a case."""
    gone = t.orders.where("o_orderkey % 6 = 0").select("o_orderkey", F.lit(True).alias("gone"))
    rows = t.lineitem.select(F.expr(_CASE_ROWS).alias("kind"), "l_orderkey", "l_linenumber").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return rows.where(F.col("gone").isNull() | (F.col("kind") == "invoice")).select("kind", "l_orderkey", "l_linenumber", F.when(F.col("gone").isNull(), F.col("l_orderkey")).alias("case_id"))


@query("SELECT c_nationkey AS office_id, CAST(count(*) AS BIGINT) AS deleted FROM customer WHERE c_nationkey = 9 GROUP BY c_nationkey")
def delete_all_count(t: Tables) -> DataFrame:
    return TenantView(t.customer, 9, "c_nationkey").rows().groupBy(F.col("c_nationkey").alias("office_id")).agg(F.count("*").alias("deleted"))


@query("""SELECT 'office' AS kind, CAST(1000 + s_suppkey AS BIGINT) AS office_id, CAST(NULL AS BIGINT) AS user_id, 'created' AS role FROM supplier WHERE s_suppkey % 7 = 0 AND s_acctbal < 0
UNION ALL SELECT 'member', CASE WHEN s_suppkey % 7 = 0 AND s_acctbal < 0 THEN 1000 + s_suppkey WHEN s_acctbal < 0 THEN NULL ELSE s_nationkey END, s_suppkey, CASE WHEN s_suppkey % 7 = 0 AND s_acctbal < 0 THEN 'owner' WHEN s_acctbal < 0 THEN NULL ELSE 'member' END FROM supplier
UNION ALL SELECT 'refused', s_nationkey, s_suppkey, NULL FROM supplier WHERE s_suppkey % 7 = 0 AND s_acctbal >= 0""")
def create_office(t: Tables) -> DataFrame:
    """Every seventh user asks for an office: who has none (here: a negative balance) gets one and is stamped its owner, who has one is
    refused. The offices made, all members after it, and the refusals."""
    users = t.supplier.select(F.col("s_suppkey").alias("user_id"), F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey")).cast("long").alias("office_id"))
    asks, alone = F.col("user_id") % 7 == 0, F.col("office_id").isNull()
    own = (F.lit(1000) + F.col("user_id")).cast("long")
    made = users.where(asks & alone).select(F.lit("office").alias("kind"), own.alias("office_id"), F.lit(None).cast("long").alias("user_id"), F.lit("created").alias("role"))
    members = users.select(F.lit("member").alias("kind"), F.when(asks & alone, own).otherwise(F.col("office_id")).alias("office_id"), F.col("user_id").cast("long").alias("user_id"), F.when(asks & alone, "owner").when(~alone, "member").alias("role"))
    refused = users.where(asks & ~alone).select(F.lit("refused").alias("kind"), "office_id", F.col("user_id").cast("long").alias("user_id"), F.lit(None).cast("string").alias("role"))
    return made.unionByName(members).unionByName(refused)


@query("SELECT s_nationkey AS office_id, s_suppkey AS user_id, s_name AS name FROM supplier WHERE s_nationkey = 5")
def list_members(t: Tables) -> DataFrame:
    return TenantView(t.supplier, 5, "s_nationkey").rows().select(F.col("s_nationkey").alias("office_id"), F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))


@query("SELECT event_id, user_id, CASE WHEN event_id % 11 = 0 AND event_type = 'view' THEN 'revoked' WHEN event_type = 'view' THEN 'pending' ELSE 'used' END AS status FROM events")
def revoke_invite(t: Tables) -> DataFrame:
    """Pending invites among those named are revoked; used ones stay as they are."""
    pending = F.col("event_type") == "view"
    return t.events.select("event_id", "user_id", F.when(pending & (F.col("event_id") % 11 == 0), "revoked").when(pending, "pending").otherwise("used").alias("status"))


@query("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN substr(repeat('title ' || CAST(conv_id AS VARCHAR) || ' ', 40), 1, 200) ELSE 'New chat' END AS title FROM (SELECT DISTINCT conv_id FROM conversations) x")
def rename_session(t: Tables) -> DataFrame:
    """Sessions are created as 'New chat'; every fourth is renamed, to 200 characters at most."""
    made = t.conversations.select("conv_id").distinct().withColumn("title", F.lit("New chat"))
    names = made.where("conv_id % 4 = 0").select("conv_id", F.left(F.repeat(F.concat(F.lit("title "), F.col("conv_id").cast("string"), F.lit(" ")), 40), F.lit(200)).alias("title"))
    return upsert(made, names, "conv_id")


_CHANGES = "(SELECT s_suppkey AS actor, CAST(floor(s_suppkey / 8) AS BIGINT) AS actor_office, s_suppkey + s_suppkey % 6 AS target, CASE s_suppkey % 5 WHEN 0 THEN 'boss' WHEN 1 THEN 'member' WHEN 2 THEN NULL ELSE 'admin' END AS new_role FROM supplier) AS c"
_MEMBERS = "(SELECT s_suppkey AS user_id, CAST(floor(s_suppkey / 8) AS BIGINT) AS office_id, CASE WHEN s_suppkey % 8 = 1 THEN 'owner' WHEN s_suppkey % 8 = 2 THEN 'admin' ELSE 'member' END AS role FROM supplier) AS m"


@query(f"""SELECT c.actor, c.target, CASE WHEN c.actor = c.target THEN 'self' WHEN m.office_id IS NULL OR m.office_id <> c.actor_office THEN 'not_found' WHEN m.role = 'owner' THEN 'owner' WHEN c.new_role IS NULL THEN 'empty' WHEN c.new_role NOT IN ('admin', 'member') THEN 'bad_role' ELSE 'ok' END AS outcome
FROM {_CHANGES} LEFT JOIN {_MEMBERS} ON m.user_id = c.target""")
def update_member(t: Tables) -> DataFrame:
    ladder = F.when(F.col("actor") == F.col("target"), "self").when(F.col("office_id").isNull() | (F.col("office_id") != F.col("actor_office")), "not_found").when(F.col("role") == "owner", "owner").when(F.col("new_role").isNull(), "empty").when(~F.col("new_role").isin("admin", "member"), "bad_role").otherwise("ok")
    return t.made(_CHANGES).join(t.made(_MEMBERS), F.col("target") == F.col("user_id"), "left").select("actor", "target", ladder.alias("outcome"))


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id % 3 <> 0")
def delete_session(t: Tables) -> DataFrame:
    turns = t.conversations.select("conv_id", "turn", "role")
    return delete_keys(turns, turns.where("conv_id % 3 = 0").select("conv_id").distinct(), "conv_id")


_SYNC = "(SELECT replace(c_name, 'Customer', 'Supplier') AS email, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'ADMIN' ELSE 'Client' END AS role FROM customer) AS t"


@query(f"SELECT s_name AS email, 'member' AS role FROM supplier UNION ALL SELECT email, coalesce(lower(role), 'paralegal') FROM {_SYNC} WHERE email NOT IN (SELECT s_name FROM supplier)")
def sync_user(t: Tables) -> DataFrame:
    known = t.supplier.select(F.col("s_name").alias("email"), F.lit("member").alias("role"))
    return insert_ignore(known, t.made(_SYNC).select("email", F.coalesce(F.lower("role"), F.lit("paralegal")).alias("role")), "email")


_UPLOADS = """(SELECT 'doc' || CAST(doc_id AS STRING) || CASE doc_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.exe' WHEN 3 THEN '.docx' WHEN 4 THEN '.txt' WHEN 5 THEN '.pdf.png' ELSE '' END AS name,
CASE doc_id % 9 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/x-msdownload' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 3 THEN 'text/plain' WHEN 4 THEN 'image/png' WHEN 5 THEN 'text/html' WHEN 6 THEN 'application/pdf' ELSE 'text/plain' END AS mime,
doc_id % 100 * 1048576 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS bytes FROM documents) AS t"""


@query(f"SELECT name, mime IN ('application/pdf', 'text/plain', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document') AND bytes <= 52428800 AS valid FROM {_UPLOADS}")
def upload_valid(t: Tables) -> DataFrame:
    allowed = F.col("mime").isin("application/pdf", "text/plain", "application/vnd.openxmlformats-officedocument.wordprocessingml.document")
    return t.made(_UPLOADS).select("name", (allowed & (F.col("bytes") <= 50 << 20)).alias("valid"))


@query(f"SELECT name, CASE WHEN mime = 'application/pdf' THEN 'pdf' WHEN mime LIKE '%wordprocessingml%' THEN 'docx' WHEN mime LIKE 'text/%' THEN 'txt' ELSE 'unsupported' END AS extractor FROM {_UPLOADS}")
def mime_dispatch(t: Tables) -> DataFrame:
    return t.made(_UPLOADS).select("name", F.when(F.col("mime") == "application/pdf", "pdf").when(F.col("mime").contains("wordprocessingml"), "docx").when(F.col("mime").startswith("text/"), "txt").otherwise("unsupported").alias("extractor"))


@query(f"SELECT name, regexp_matches(lower(name), '\\.pdf$') OR mime = 'application/pdf' AS is_pdf, regexp_matches(lower(name), '\\.docx$') AS is_docx, mime LIKE 'image/%' AS is_image FROM {_UPLOADS}")
def sniff_type(t: Tables) -> DataFrame:
    return t.made(_UPLOADS).select("name", (F.lower("name").endswith(".pdf") | (F.col("mime") == "application/pdf")).alias("is_pdf"), F.lower("name").endswith(".docx").alias("is_docx"), F.col("mime").startswith("image/").alias("is_image"))


@query("SELECT event_id, ts < TIMESTAMP '2024-01-15 00:00:00' AS expired FROM events")
def ttl_expired(t: Tables) -> DataFrame:
    as_of = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return t.events.select("event_id", (F.col("ts") < as_of - F.expr("INTERVAL 24 HOURS")).alias("expired"))


@query("SELECT doc_id, 'library/' || source || '/' || '2024/03/' || printf('%08d', doc_id) || '_text.txt' AS key FROM documents")
def object_key(t: Tables) -> DataFrame:
    day = F.date_format(F.lit("2024-03-09").cast("date"), "yyyy/MM")
    return t.documents.select("doc_id", F.concat_ws("/", F.lit("library"), "source", day, F.concat(F.format_string("%08d", "doc_id"), F.lit("_text.txt"))).alias("key"))


@query("SELECT url, CASE WHEN url LIKE 'http%' THEN 'url' ELSE 'key' END AS kind FROM pages")
def resolve_url(t: Tables) -> DataFrame:
    return t.pages.select("url", F.when(F.col("url").startswith("http"), "url").otherwise("key").alias("kind"))


_ERRORS = "(SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN 'Invalid login credentials' WHEN 1 THEN 'INVALID LOGIN of ' WHEN 2 THEN 'Email not confirmed' WHEN 3 THEN 'quota exceeded for project ' WHEN 4 THEN 'Not confirmed, Quota' WHEN 5 THEN 'quot' ELSE 'boom ' END || event_type AS message FROM events) AS t"


@query(f"SELECT id, CASE WHEN contains(lower(message), 'invalid login') THEN 'wrong_credentials' WHEN contains(lower(message), 'not confirmed') THEN 'unconfirmed' WHEN contains(lower(message), 'quota') THEN 'quota' ELSE 'unknown' END AS code FROM {_ERRORS}")
def error_map(t: Tables) -> DataFrame:
    low = F.lower("message")
    return t.made(_ERRORS).select("id", F.when(low.contains("invalid login"), "wrong_credentials").when(low.contains("not confirmed"), "unconfirmed").when(low.contains("quota"), "quota").otherwise("unknown").alias("code"))


# Six tables and their policies: an office is a nation; orders, their lines and the region follow their customers and nations.
_POLICIES = {
    "customer": "c_nationkey = auth_office_id()",
    "supplier": "s_nationkey = auth_office_id() OR s_suppkey = auth_user_id()",
    "nation": "n_nationkey = auth_office_id()",
    "orders": "EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)",
    "lineitem": "EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)",
    "part": "auth_office_id() IS NOT NULL",
}


def _as_office(t: Tables, office: int | None, user: int | None = 1) -> Policies:
    return Policies(t.spark, {name: f"{t.sf_dir}/{name}.parquet" for name in (*_POLICIES, "region")}, _POLICIES, user, office)


@query("""SELECT 'customer' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_nationkey = 5
UNION ALL SELECT 'supplier', count(*), sum(s_suppkey) FROM supplier WHERE s_nationkey = 5 OR s_suppkey = 1 UNION ALL SELECT 'nation', count(*), sum(n_nationkey) FROM nation WHERE n_nationkey = 5
UNION ALL SELECT 'orders', count(*), sum(o_orderkey) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)
UNION ALL SELECT 'lineitem', count(*), sum(l_partkey) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 5)
UNION ALL SELECT 'part', count(*), sum(p_partkey) FROM part UNION ALL SELECT 'region', 0, NULL""")
def policy_select(t: Tables) -> DataFrame:
    """What one office sees of every table; of one without a policy, nothing."""
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey", "orders": "o_orderkey", "lineitem": "l_partkey", "part": "p_partkey", "region": "r_regionkey"}
    return _as_office(t, 5).select(" UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS n, sum({key}) AS `keys` FROM {name}" for name, key in keys.items()))


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 1000000, c_nationkey, 'NEW' FROM customer WHERE c_nationkey = 5 AND c_acctbal > 0")
def policy_insert(t: Tables) -> DataFrame:
    mine = _as_office(t, 5)
    return mine.insert("customer", "SELECT c_custkey + 1000000 AS c_custkey, c_name, CAST(auth_office_id() AS INT) AS c_nationkey, c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_acctbal > 0").select("c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey = 5 AND c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def policy_update(t: Tables) -> DataFrame:
    """The rows of others stay as they are, though the condition holds for them as well."""
    return _as_office(t, 5).update("customer", {"c_mktsegment": "'DEBT'"}, "c_acctbal < 0").select("c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey = 5 AND c_acctbal < 0)")
def policy_delete(t: Tables) -> DataFrame:
    return _as_office(t, 5).delete("customer", "c_acctbal < 0").select("c_custkey", "c_nationkey")


# Invites are the customers' (a token, an office, an e-mail), and every supplier asks for one; some of them are used, expired, or another's.
_ASKED = "SELECT s_suppkey AS user_id, s_nationkey, s_suppkey * 3 AS token, CASE WHEN s_suppkey % 5 = 0 THEN 'x' ELSE 'U' || CAST(s_suppkey * 3 AS STRING) || '@Law.org' END AS email FROM supplier"
_OFFERED = "SELECT c_custkey AS token, c_nationkey AS office_id, c_custkey % 4 = 0 AS used, c_acctbal < 0 AS expired, 'u' || CAST(c_custkey AS STRING) || '@law.org' AS email FROM customer WHERE c_custkey % 9 > 0"
_ANSWERED = "CASE WHEN i.token IS NULL THEN 'not_found' WHEN i.used THEN 'used' WHEN i.expired THEN 'expired' WHEN lower(r.email) <> lower(i.email) THEN 'other_email' ELSE 'ok' END"


@query(f"""WITH a AS (SELECT r.user_id, r.s_nationkey, r.token, i.office_id, {_ANSWERED} AS answer FROM ({_ASKED}) r LEFT JOIN ({_OFFERED}) i ON i.token = r.token)
SELECT 'user' AS kind, user_id AS id, CASE WHEN answer = 'ok' THEN office_id ELSE s_nationkey END AS office_id, CAST(NULL AS BIGINT) AS used_by, answer FROM a
UNION ALL SELECT 'invite', i.token, i.office_id, a.user_id, coalesce(a.answer, CASE WHEN i.used THEN 'used' ELSE 'open' END) FROM ({_OFFERED}) i LEFT JOIN a ON a.token = i.token AND a.answer = 'ok'""")
def accept_invites(t: Tables) -> DataFrame:
    """Both sides of an acceptance: the user joins the office, the invite is stamped with who used it; a refusal changes neither."""
    asked, offered = t.spark.sql(_ASKED.replace("FROM supplier", "FROM {supplier}"), supplier=t.supplier), t.spark.sql(_OFFERED.replace("FROM customer", "FROM {customer}"), customer=t.customer)
    other = F.lower("email") != F.lower("invited")
    answer = F.when(F.col("office_id").isNull(), "not_found").when(F.col("used"), "used").when(F.col("expired"), "expired").when(other, "other_email").otherwise("ok")
    answered = asked.join(offered.withColumnRenamed("email", "invited"), "token", "left").withColumn("answer", answer)
    users = answered.select(F.lit("user").alias("kind"), F.col("user_id").alias("id"), F.when(F.col("answer") == "ok", F.col("office_id")).otherwise(F.col("s_nationkey")).alias("office_id"), F.lit(None).cast("long").alias("used_by"), "answer")
    stamps = answered.where("answer = 'ok'").select("token", F.col("user_id").alias("used_by"), "answer")
    invites = offered.join(stamps, "token", "left").select(F.lit("invite").alias("kind"), F.col("token").alias("id"), "office_id", "used_by", F.coalesce("answer", F.when(F.col("used"), "used").otherwise("open")).alias("answer"))
    return users.unionByName(invites)
