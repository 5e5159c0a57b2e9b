"""Contracts, joins, provenance, splits and file layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.match_queries import sql_matched
from catalog.views import (
    BASE_NS, DAY_NS, slot_width, TYPES, SQL_MEMBERSHIPS, SQL_MESSAGES, SQL_OBSERVATIONS, _mod, boxes, event_points, memberships,
    messages, observations, r6, table, ts_ns, with_sql,
)
from trustweave.functions.canonical import frame_local_group, number_text
from trustweave.operators import contracts as C
from trustweave.operators import governance as R
from trustweave.operators.joins import (
    absent_keys, cardinality_violations, checked_join, duplicate_keys, key_difference,
)
from trustweave.operators.match import match_messages
from trustweave.operators.overlays import replace_observations
from trustweave.schemas import SPLIT_ROLES
from trustweave.sources.files import (
    DECIMAL_DIGITS, OMITTED_LEADING_ZEROES, cloud_metadata, index_clouds, index_labels,
    parse_ascii_clouds, parse_labels,
)


def duplicate_keys_query(spark, d):
    return duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


SQL_DUPLICATES = "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1,2 HAVING count(*)>1"


def checked_join_query(spark, d):
    """Orders to customers, many to one, with an overlapping column renamed."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.col("o_totalprice").alias("amount"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), F.col("c_acctbal").alias("amount"), "c_mktsegment")
    return checked_join(orders, customers, ["custkey"], "many_to_one", "left", {"amount": "balance"})


SQL_CHECKED = """SELECT o_custkey AS custkey, o_orderkey, o_totalprice AS amount, c_acctbal AS balance, c_mktsegment
FROM orders LEFT JOIN customer ON c_custkey=o_custkey"""


def join_cardinality(spark, d):
    """A one-to-one claim that both sides break."""
    left = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"))
    right = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"))
    return cardinality_violations(left, right, ["orderkey"], "one_to_one")


SQL_CARDINALITY = """SELECT 'left' AS side, l_orderkey AS orderkey, count(*) AS rows FROM lineitem GROUP BY l_orderkey HAVING count(*)>1
UNION ALL SELECT 'right', o_orderkey, count(*) FROM orders GROUP BY o_orderkey HAVING count(*)>1"""


def anti_unknown(spark, d):
    """Part keys that occur in lines but not in a registry of every third part."""
    known = table(spark, d, "part").filter(_mod("p_partkey", 3) == 0).select(F.col("p_partkey").alias("key"))
    return absent_keys(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")), known, ["key"])


SQL_ANTI = """SELECT DISTINCT l_partkey AS key FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey%3=0)"""


def missing_and_extra_frames(spark, d):
    """Days of every other event type against the days of an anchor type, per user."""
    rows = table(spark, d, "events").select(
        "user_id", "event_type", F.floor((ts_ns() - BASE_NS) / DAY_NS).alias("day")
    )
    others = F.explode(F.array(*[F.lit(t) for t in TYPES if t != "view"])).alias("event_type")
    anchor = rows.filter(F.col("event_type") == "view").select("user_id", others, "day")
    other = rows.filter(F.col("event_type") != "view")
    return key_difference(anchor, other, ["user_id", "event_type", "day"])


SQL_DIFFERENCE = f"""WITH r AS (SELECT user_id, event_type, (epoch_us(ts)*1000-{BASE_NS})//{DAY_NS} AS day FROM events),
a AS (SELECT DISTINCT user_id, t AS event_type, day FROM r, (SELECT unnest(['click','purchase','signup','error']) AS t) WHERE event_type='view'),
o AS (SELECT DISTINCT user_id, event_type, day FROM r WHERE event_type<>'view')
SELECT *, 'missing' AS difference FROM (SELECT * FROM a EXCEPT SELECT * FROM o)
UNION ALL SELECT *, 'extra' FROM (SELECT * FROM o EXCEPT SELECT * FROM a)"""


def message_contract(spark, d):
    """Messages with planted faults: an empty agent, early arrival, negative pose time."""
    rows = messages(spark, d).withColumn("n", F.col("source_time_ns") % 1_000_003)
    bad = rows.withColumns({
        "agent_id": F.when(_mod("n", 401) == 0, "").otherwise(F.col("agent_id")),
        "arrival_time_ns": F.when(_mod("n", 307) == 0, F.col("source_time_ns") - 1).otherwise(F.col("arrival_time_ns")),
        "pose_source_time_ns": F.when(_mod("n", 503) == 0, -1).otherwise(F.col("pose_source_time_ns")),
    })
    return C.violations(bad, ["session_id", "source_time_ns"], C.message_rules())


SQL_MESSAGE_CONTRACT = with_sql(f"{SQL_MESSAGES}, m AS (SELECT *, source_time_ns%1000003 AS n FROM messages)", """
SELECT session_id, source_time_ns, 'agent_id_not_empty' AS rule FROM m WHERE n%401=0
UNION ALL SELECT session_id, source_time_ns, 'arrival_not_before_source' FROM m WHERE n%307=0
UNION ALL SELECT session_id, source_time_ns, 'pose_source_time_ns_nonnegative' FROM m WHERE n%503=0""")


def contract_violations(spark, d):
    """Observation contract: vectors of absent messages and scores outside [0, 1]."""
    rows = observations(spark, d).withColumns({
        "vector": F.when(_mod("event_id", 38) == 0, F.array(F.lit(1.0))).otherwise(F.col("payload")),
        "peer_corroboration_score": F.when(_mod("event_id", 77) == 1, 1.5).otherwise(F.col("peer_corroboration_score")),
        "two_sided_count_residual": F.when(_mod("event_id", 91) == 2, -1.0).otherwise(F.col("two_sided_count_residual")),
    })
    return C.violations(rows, ["event_id"], C.observation_rules())


SQL_VIOLATIONS = """SELECT event_id, 'vector_needs_message' AS rule FROM events WHERE event_id%38=0
UNION ALL SELECT event_id, 'peer_corroboration_score_in_unit_interval' FROM events WHERE event_id%77=1
UNION ALL SELECT event_id, 'residual_nonnegative' FROM events WHERE event_id%91=2"""
# an absent message (event_id%19=0) with a vector occurs exactly where event_id%38=0


def label_contract(spark, d):
    rows = boxes(spark, d).withColumn("class_id", _mod("box", 5).cast("int")).withColumn(
        "size_x_m", F.when(_mod("box", 50) == 0, 0.0).otherwise(F.col("size_x_m"))
    )
    return C.violations(rows, ["box"], C.label_rules())


SQL_LABEL_CONTRACT = """SELECT p_partkey AS box, 'class_id_known' AS rule FROM part WHERE p_partkey%5 NOT IN (1,2,3)
UNION ALL SELECT p_partkey, 'size_positive' FROM part WHERE p_partkey%50=0"""


def membership_contract(spark, d):
    rows = memberships(spark, d).withColumn(
        "message_expected", F.col("message_expected") | (_mod("sync_frame_id", 7) == 3)
    )
    return C.violations(rows, ["session_id", "agent_id", "sync_frame_id"], C.membership_rules())


SQL_MEMBERSHIP_CONTRACT = """SELECT u.user_id::VARCHAR AS session_id, agent_id, day AS sync_frame_id, 'non_member_expects_nothing' AS rule
FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(['click','view','purchase','signup','error','beacon']) AS agent_id) a, (SELECT unnest(range(30)) AS day) dd
WHERE NOT ((user_id*day)%29<>0 OR day=0) AND day%7=3"""


# -- provenance ------------------------------------------------------------------

def _lineage(spark, d):
    docs = table(spark, d, "documents")
    role = F.element_at(F.array(*[F.lit(r) for r in SPLIT_ROLES]), (_mod(F.length("source"), 4) + 1).cast("int"))
    return docs.select(
        F.col("source").alias("sequence_id"), F.col("lang").alias("session_id"),
        F.sha2("text", 256).alias("source_episode_id"),
        F.concat_ws("-", "source", F.floor(F.col("doc_id") / 10).cast("string")).alias("neighboring_frame_block_id"),
        F.concat_ws("-", "lang", _mod("doc_id", 50).cast("string")).alias("clean_counterpart_id"),
        F.lit("clean").alias("variant_id"), role.alias("role"),
        F.col("doc_id").cast("string").alias("agent_id"), F.lit(None).cast("string").alias("object_key"),
    )


def leakage(spark, d):
    out = R.leakage(_lineage(spark, d))
    return out.select("kind", F.sha2("group_key", 256).alias("group_sha256"), "roles", "rows", "first_role", "last_role")


SQL_LINEAGE = """lineage AS (SELECT source, lang, doc_id, sha256(text) AS h,
 (['regression_development','training','calibration','final_test'])[length(source)%4+1] AS role FROM documents),
g AS (SELECT role, 'sequence_session' AS kind, source||chr(0)||lang AS k FROM lineage
 UNION ALL SELECT role, 'source_episode', h FROM lineage
 UNION ALL SELECT role, 'neighboring_frame_block', source||'-'||(doc_id//10) FROM lineage
 UNION ALL SELECT role, 'clean_counterpart', lang||'-'||(doc_id%50) FROM lineage)"""

SQL_LEAKAGE = with_sql(SQL_LINEAGE, """
SELECT kind, sha256(k) AS group_sha256, count(DISTINCT role) AS roles, count(*) AS rows, min(role) AS first_role, max(role) AS last_role
FROM g GROUP BY kind, k HAVING count(DISTINCT role)>1""")


def _splits(spark, d):
    """Split registry derived from the document sources (bounded by their number)."""
    role = F.element_at(F.array(*[F.lit(r) for r in SPLIT_ROLES]), (_mod(F.length("sequence_id"), 3) + 1).cast("int"))
    return table(spark, d, "documents").select(F.col("source").alias("sequence_id")).distinct().select(
        F.concat(F.lit("src-"), "sequence_id").alias("source_id"), "sequence_id", role.alias("role"),
        F.lit(True).alias("resolved"), (_mod(F.length("sequence_id"), 5) != 0).alias("frozen"),
    )


def split_guard(spark, d):
    """Lineage rows against the registry: role conflicts and roles not frozen."""
    return R.role_conflicts(_lineage(spark, d), _splits(spark, d)).groupBy(
        "sequence_id", "role", "assigned_role", "problem"
    ).agg(F.count("*").alias("rows"))


SQL_SPLIT_GUARD = with_sql(SQL_LINEAGE + """,
s AS (SELECT DISTINCT source, (['regression_development','training','calibration','final_test'])[length(source)%3+1] AS assigned_role, length(source)%5<>0 AS frozen FROM documents)""", """
SELECT source AS sequence_id, role, assigned_role, CASE WHEN NOT frozen THEN 'not_frozen' ELSE 'role_conflict' END AS problem, count(*) AS rows
FROM lineage JOIN s USING (source) WHERE NOT frozen OR role<>assigned_role GROUP BY ALL""")


def forbidden_actions(spark, d):
    requests = table(spark, d, "documents").select(
        F.col("source").alias("sequence_id"),
        F.element_at(F.array(*[F.lit(a) for a in ("attack_generation", "normalizer_fit", "calibration", "final_evaluation")]),
                     (_mod("doc_id", 4) + 1).cast("int")).alias("action"),
    ).distinct()
    return R.forbidden_actions(requests, _splits(spark, d), R.allowed_actions(spark)).select("sequence_id", "action")


SQL_FORBIDDEN = """WITH q AS (SELECT DISTINCT source, (['attack_generation','normalizer_fit','calibration','final_evaluation'])[(doc_id%4+1)::INT] AS action FROM documents),
s AS (SELECT DISTINCT source, (['regression_development','training','calibration','final_test'])[length(source)%3+1] AS role, length(source)%5<>0 AS frozen FROM documents)
SELECT source AS sequence_id, action FROM q JOIN s USING (source)
WHERE NOT (frozen AND (action='attack_generation' OR (action='normalizer_fit' AND role='training') OR (action='calibration' AND role='calibration') OR (action='final_evaluation' AND role='final_test')))"""


def split_rules(spark, d):
    return R.split_problems(_splits(spark, d)).select("sequence_id", "rule")


SQL_SPLIT_RULES = """WITH s AS (SELECT DISTINCT source, length(source)%3=0 AS dev, length(source)%5<>0 AS frozen FROM documents)
SELECT source AS sequence_id, 'frozen' AS rule FROM s WHERE NOT frozen
UNION ALL SELECT NULL, 'sole_development_source' FROM (SELECT count(*) FILTER (WHERE dev) AS n FROM s) WHERE n<>1"""

HASHED = ["doc_id", "lang", "source", "n_chars", "text"]


def row_hash(spark, d):
    docs = table(spark, d, "documents").withColumn("share", F.col("n_chars") / 4000000.0)
    return R.row_hashes(docs, [*HASHED, "share"]).select("doc_id", "row_sha256")


# shares are multiples of 1/4000000; DuckDB prints exponents from 1e-5 down, as JSON does
SQL_ROW_HASH = """SELECT doc_id, sha256('{"doc_id":'||doc_id||',"lang":"'||lang||'","n_chars":'||n_chars||',"share":'||
 (n_chars/4000000.0::DOUBLE)::VARCHAR||',"source":"'||source||'","text":'||to_json(text)||'}'||chr(10)) AS row_sha256 FROM documents"""


def table_hash(spark, d):
    return R.table_hash(table(spark, d, "documents"), HASHED)


SQL_TABLE_HASH = """WITH h AS (SELECT h, count(*) AS n FROM (SELECT sha256('{"doc_id":'||doc_id||',"lang":"'||lang||'","n_chars":'||n_chars||',"source":"'||source||'","text":'||to_json(text)||'}'||chr(10)) AS h FROM documents) GROUP BY h),
a AS (SELECT substr(h,1,6) AS p, sha256(string_agg(h||':'||n, chr(10) ORDER BY h||':'||n)) AS l FROM h GROUP BY 1),
b AS (SELECT substr(p,1,4) AS p, p||':'||l AS line FROM a),
c AS (SELECT p, sha256(string_agg(line, chr(10) ORDER BY line)) AS l FROM b GROUP BY p),
e AS (SELECT substr(p,1,2) AS p, p||':'||l AS line FROM c),
f AS (SELECT p, sha256(string_agg(line, chr(10) ORDER BY line)) AS l FROM e GROUP BY p),
g AS (SELECT p||':'||l AS line FROM f)
SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS table_sha256 FROM g"""


def _inventory(spark, d):
    return table(spark, d, "documents").select(
        F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"), "doc_id",
    )


def inventory(spark, d):
    return _inventory(spark, d).select("path", "bytes", "sha256")


SQL_INVENTORY = "SELECT 'docs/'||doc_id||'.txt' AS path, strlen(text)::BIGINT AS bytes, sha256(text) AS sha256 FROM documents"


def inventory_verify(spark, d):
    """Recorded inventory against one with missing, resized and altered files."""
    real = _inventory(spark, d)
    i = F.col("doc_id")
    recorded = real.filter(_mod(i, 50) != 1).withColumn("bytes", F.col("bytes") + F.when(_mod(i, 51) == 2, 1).otherwise(0))
    found = real.filter(_mod(i, 53) != 3).withColumn("sha256", F.when(_mod(i, 54) == 4, F.sha2(F.lit(""), 256)).otherwise(F.col("sha256")))
    return R.verify_inventory(recorded, found)


SQL_INVENTORY_VERIFY = """SELECT 'docs/'||doc_id||'.txt' AS path, CASE WHEN doc_id%53=3 THEN 'missing' WHEN doc_id%50=1 THEN 'unexpected'
 WHEN doc_id%51=2 THEN 'size_mismatch' ELSE 'sha256_mismatch' END AS problem FROM documents
WHERE (doc_id%53=3 AND doc_id%50<>1) OR (doc_id%50=1 AND doc_id%53<>3)
 OR (doc_id%50<>1 AND doc_id%53<>3 AND (doc_id%51=2 OR (doc_id%54=4 AND sha256(text)<>sha256(''))))"""


def manifest_rules(spark, d):
    rows = _inventory(spark, d).withColumn(
        "path", F.when(_mod("doc_id", 90) == 0, F.concat(F.lit("../"), "path"))
        .when(_mod("doc_id", 91) == 0, F.lit("docs/same.txt")).otherwise(F.col("path"))
    )
    return R.manifest_problems(rows)


SQL_MANIFEST = """WITH m AS (SELECT CASE WHEN doc_id%90=0 THEN '../docs/'||doc_id||'.txt' WHEN doc_id%91=0 THEN 'docs/same.txt' ELSE 'docs/'||doc_id||'.txt' END AS path FROM documents)
SELECT path, 'path_safe' AS rule FROM m WHERE path LIKE '../%' UNION ALL SELECT path, 'unique_path' FROM m GROUP BY path HAVING count(*)>1"""


def fingerprints(spark, d):
    """Request fingerprints that ignore the producer command."""
    rows = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("producer_command")
    )
    return R.request_fingerprint(rows).select("o_orderkey", "fingerprint")


SQL_FINGERPRINTS = """SELECT o_orderkey, sha256('{"o_custkey":'||o_custkey||',"o_orderkey":'||o_orderkey||',"o_orderpriority":"'||o_orderpriority||'"}'||chr(10)) AS fingerprint FROM orders"""


def number_texts(spark, d):
    """JSON number text over many magnitudes."""
    return table(spark, d, "events").select("event_id", number_text(F.pow(F.lit(2.0), _mod("event_id", 40) - 20)).alias("text"))


SQL_NUMBERS = "SELECT event_id, pow(2.0::DOUBLE, event_id%40-20)::VARCHAR AS text FROM events"


# -- file layouts ----------------------------------------------------------------

def _paths(spark, d):
    e = F.col("event_id")
    name = F.concat(
        F.col("event_type"), F.lit("_"), e.cast("string"), F.lit("_"), (F.col("user_id") + 1_700_000_000).cast("string"),
        F.lit("."), (e * 7919).cast("string"), F.when(_mod(e, 40) == 0, ".txt").otherwise(".pcd"),
    )
    return table(spark, d, "events").select("event_id", F.concat(F.lit("/data/PointClouds/s1/"), name).alias("path"))


def cloud_index(spark, d):
    paths = _paths(spark, d)
    left = index_clouds(paths, OMITTED_LEADING_ZEROES)
    right = index_clouds(paths, DECIMAL_DIGITS).select("event_id", F.col("source_time_ns").alias("decimal_time_ns"))
    return left.join(right, "event_id").select(
        "event_id", "agent_id", "sync_frame_id", "source_time_ns", "decimal_time_ns", "timestamp_text", "problem"
    )


# a fraction of more than nine digits is no nanosecond time: such a name is invalid, as in CLOUD_NAME
SQL_CLOUD_INDEX = """WITH e AS (SELECT *, event_id%40<>0 AND length(f)<=9 AS ok FROM (SELECT *, (event_id*7919)::VARCHAR AS f, user_id+1700000000 AS s FROM events))
SELECT event_id, CASE WHEN ok THEN event_type END AS agent_id, CASE WHEN ok THEN event_id END AS sync_frame_id,
 CASE WHEN ok THEN s*1000000000+lpad(f,9,'0')::BIGINT END AS source_time_ns, CASE WHEN ok THEN s*1000000000+rpad(f,9,'0')::BIGINT END AS decimal_time_ns,
 CASE WHEN ok THEN s||'.'||f END AS timestamp_text, CASE WHEN NOT ok THEN 'invalid_cloud_name' END AS problem FROM e"""


def label_index(spark, d):
    paths = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("/data/labels/s1/frame_"), (F.col("p_partkey") - 1).cast("string"),
                              F.when(_mod("p_partkey", 30) == 0, ".csv").otherwise(".txt")).alias("path")
    )
    return index_labels(paths).select("p_partkey", "sync_frame_id", "problem")


SQL_LABEL_INDEX = """SELECT p_partkey, CASE WHEN p_partkey%30<>0 AND p_partkey>=1 THEN p_partkey-2 END AS sync_frame_id,
 CASE WHEN p_partkey%30=0 OR p_partkey<1 THEN 'invalid_label_name' WHEN p_partkey-2<0 THEN 'negative_frame' END AS problem FROM part"""


def label_parse(spark, d):
    """A label text per part: two boxes, a blank line (of a tab or nothing), sometimes a
    broken line; lines may be led by spaces or a tab."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    first = F.concat_ws(" ", s(_mod(k, 3) + 1), s(F.col("p_size")), s(_mod(k, 10)), s(_mod(k, 8)), s(_mod(k, 9) + 1), F.lit("2.5"), F.lit("1e0"), s(_mod(k, 314) / 100.0))
    second = F.when(_mod(k, 20) == 0, F.lit("1 2 3")).when(_mod(k, 21) == 0, F.lit("1 a 3 4 5 6 7 8")).when(_mod(k, 3) == 0, F.concat(F.lit("\t"), first, F.lit(" \t"))).otherwise(F.concat(F.lit("  "), first, F.lit(" ")))
    blank = F.when(_mod(k, 2) == 0, "\n\t\n").otherwise("\n\n")
    texts = table(spark, d, "part").select("p_partkey", F.concat(first, blank, second, F.lit("\n")).alias("content"))
    return parse_labels(texts).select(
        "p_partkey", F.col("local_index").cast("bigint").alias("local_index"), "class_id",
        *[r6(c).alias(c) for c in ("center_x_m", "center_y_m", "center_z_m", "size_x_m", "size_y_m", "size_z_m", "yaw_rad")], "problem",
    )


SQL_LABEL_PARSE = """WITH p AS (SELECT *, unnest([0,1]) AS i FROM part),
q AS (SELECT *, CASE WHEN i=1 AND p_partkey%20=0 THEN 'field_count' WHEN i=1 AND p_partkey%21=0 THEN 'invalid_number' END AS problem FROM p)
SELECT p_partkey, i::BIGINT AS local_index, CASE WHEN problem IS NULL THEN (p_partkey%3+1)::INTEGER END AS class_id,
 CASE WHEN problem IS NULL THEN p_size::DOUBLE END AS center_x_m, CASE WHEN problem IS NULL THEN (p_partkey%10)::DOUBLE END AS center_y_m,
 CASE WHEN problem IS NULL THEN (p_partkey%8)::DOUBLE END AS center_z_m, CASE WHEN problem IS NULL THEN (p_partkey%9+1)::DOUBLE END AS size_x_m,
 CASE WHEN problem IS NULL THEN 2.5::DOUBLE END AS size_y_m, CASE WHEN problem IS NULL THEN 1.0::DOUBLE END AS size_z_m,
 CASE WHEN problem IS NULL THEN round((p_partkey%314)/100.0::DOUBLE,6)+0.0 END AS yaw_rad, problem FROM q"""


def _cloud_texts(spark, d):
    """An ASCII cloud of two points per event."""
    e = F.col("event_id")
    num = lambda c: number_text(c)
    head = F.when(_mod(e, 50) == 0, "x y z ring").otherwise("x y z intensity")
    body = lambda k: F.concat_ws(" ", num(F.col("x")), num(F.col("y")), num(F.col("z")), num(F.col("intensity") + k))
    return event_points(spark, d).select("event_id", F.concat(
        F.lit("# .PCD v0.7\nVERSION 0.7\nFIELDS "), head, F.lit("\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS 2\nDATA "),
        F.when(_mod(e, 60) == 0, "binary_compressed").otherwise("ascii"), F.lit("\n"), body(0.0), F.lit("\n"), body(1.0), F.lit("\n"),
    ).alias("content"))


def cloud_points(spark, d):
    out = parse_ascii_clouds(_cloud_texts(spark, d), ["x", "y", "z", "intensity"])
    return out.select(
        "event_id", "declared_points", "parsed_points", "problem", F.col("point_index").cast("bigint").alias("point_index"),
        *[r6(c).alias(c) for c in ("x", "y", "z", "intensity")],
    )


SQL_CLOUD_POINTS = """SELECT event_id, 2::BIGINT AS declared_points, 2::BIGINT AS parsed_points, NULL::VARCHAR AS problem, i::BIGINT AS point_index, round(value/10.0::DOUBLE,6)+0.0 AS x,
 round((event_id%100)/10.0::DOUBLE-5,6)+0.0 AS y, (event_id%8-4)::DOUBLE+0.0 AS z,
 CASE WHEN event_id%50<>0 THEN (event_id%4000+i)::DOUBLE END AS intensity
FROM events, (SELECT unnest([0,1]) AS i) WHERE event_id%60<>0
UNION ALL SELECT event_id, 2, 0, 'unsupported_encoding', NULL, NULL, NULL, NULL, NULL FROM events WHERE event_id%60=0"""


def cloud_audit(spark, d):
    return cloud_metadata(_cloud_texts(spark, d)).select("event_id", "points", "encoding", "problem")


SQL_CLOUD_AUDIT = """SELECT event_id, 2::BIGINT AS points, CASE WHEN event_id%60=0 THEN 'binary_compressed' ELSE 'ascii' END AS encoding,
 CASE WHEN event_id%50=0 THEN 'missing_field' WHEN event_id%60=0 THEN 'unsupported_encoding' END AS problem FROM events"""

def frame_contract(spark, d):
    """Matched frames with planted faults, checked as a frame table."""
    frames = match_messages(
        memberships(spark, d), messages(spark, d), max_age_ns=2 * DAY_NS, slot_ns=slot_width(spark, d)
    )
    day = F.col("sync_frame_id")
    faulty = frames.withColumns({
        "match_age_ns": F.col("match_age_ns") + F.when(day == 3, 1).otherwise(0),
        "message_present": F.col("message_present") | ((day == 5) & (F.col("reason_code") == "missing_message")),
    })
    return C.violations(faulty, ["session_id", "agent_id", "sync_frame_id"], C.frame_rules())


SQL_FRAME_CONTRACT = with_sql(sql_matched("causal"), """
SELECT session_id, agent_id, sync_frame_id, 'age_is_decision_minus_source' AS rule FROM matched WHERE source_matched AND sync_frame_id=3
UNION ALL SELECT session_id, agent_id, sync_frame_id, 'missing_message_is_absent' FROM matched WHERE reason_code='missing_message' AND sync_frame_id=5""")


def frame_table_audit(spark, d):
    """Frame table with repeated keys, object keys on frame rows and empty ids."""
    base = memberships(spark, d).select(
        F.lit("e").alias("experiment_id"),
        F.when(F.col("sync_frame_id") == 7, "").otherwise("v").alias("variant_id"),
        "sequence_id", "session_id", "sync_frame_id", "decision_time_ns",
        F.lit(None).cast("bigint").alias("source_time_ns"), "agent_id", F.lit("vehicle").alias("agent_type"),
        F.when(F.col("sync_frame_id") == 9, "0").alias("object_key"),
    )
    doubled = base.unionByName(base.filter("sync_frame_id = 11"))
    return C.validate_table(doubled, "frame").select("session_id", "agent_id", "sync_frame_id", "rule")


SQL_FRAME_AUDIT = with_sql(SQL_MEMBERSHIPS, """
SELECT session_id, agent_id, sync_frame_id, CASE sync_frame_id WHEN 7 THEN 'variant_id_not_empty' WHEN 9 THEN 'frame_has_no_object' ELSE 'unique_key' END AS rule
FROM memberships WHERE sync_frame_id IN (7,9,11)""")


def replaced_observations(spark, d):
    """Whole replacement of named observations, marked as corrupted."""
    base = observations(spark, d).select("event_id", "kinematic_error_m", "peer_corroboration_score")
    new = base.filter(_mod("event_id", 23) == 0).select(
        "event_id", F.lit(0.057).alias("kinematic_error_m"), F.lit(None).cast("double").alias("peer_corroboration_score")
    )
    out = replace_observations(base, new, ["event_id"], ["kinematic_error_m", "peer_corroboration_score"])
    return out.select("event_id", r6("kinematic_error_m").alias("kin"), r6("peer_corroboration_score").alias("peer"), "corrupted")


SQL_REPLACED = with_sql(SQL_OBSERVATIONS, """
SELECT event_id, CASE WHEN event_id%23=0 THEN 0.057::DOUBLE ELSE round(kin,6)+0.0 END AS kin,
 CASE WHEN event_id%23<>0 THEN round(peer,6)+0.0 END AS peer, event_id%23=0 AS corrupted FROM observations""")


def object_groups(spark, d):
    """Frame-scoped object group keys of all boxes, hashed for comparison."""
    key = frame_local_group(F.lit("seq"), F.lit("ses"), F.col("frame"), F.col("box"))
    return boxes(spark, d).select("box", F.sha2(key, 256).alias("group_sha256"))


SQL_GROUPS = """SELECT p_partkey AS box, sha256('seq'||chr(0)||'ses'||chr(0)||'frame='||(p_partkey%1000)||chr(0)||'local-object='||p_partkey) AS group_sha256 FROM part"""

QUERIES = {
    "frame_contract": (frame_contract, SQL_FRAME_CONTRACT),
    "frame_table_audit": (frame_table_audit, SQL_FRAME_AUDIT),
    "replaced_observations": (replaced_observations, SQL_REPLACED),
    "object_groups": (object_groups, SQL_GROUPS),
    "duplicate_keys": (duplicate_keys_query, SQL_DUPLICATES),
    "checked_join": (checked_join_query, SQL_CHECKED),
    "join_cardinality": (join_cardinality, SQL_CARDINALITY),
    "anti_unknown": (anti_unknown, SQL_ANTI),
    "key_difference": (missing_and_extra_frames, SQL_DIFFERENCE),
    "message_contract": (message_contract, SQL_MESSAGE_CONTRACT),
    "contract_violations": (contract_violations, SQL_VIOLATIONS),
    "label_contract": (label_contract, SQL_LABEL_CONTRACT),
    "membership_contract": (membership_contract, SQL_MEMBERSHIP_CONTRACT),
    "leakage": (leakage, SQL_LEAKAGE),
    "split_guard": (split_guard, SQL_SPLIT_GUARD),
    "forbidden_actions": (forbidden_actions, SQL_FORBIDDEN),
    "split_rules": (split_rules, SQL_SPLIT_RULES),
    "row_hash": (row_hash, SQL_ROW_HASH),
    "table_hash": (table_hash, SQL_TABLE_HASH),
    "inventory": (inventory, SQL_INVENTORY),
    "inventory_verify": (inventory_verify, SQL_INVENTORY_VERIFY),
    "manifest_rules": (manifest_rules, SQL_MANIFEST),
    "fingerprints": (fingerprints, SQL_FINGERPRINTS),
    "number_texts": (number_texts, SQL_NUMBERS),
    "cloud_index": (cloud_index, SQL_CLOUD_INDEX),
    "label_index": (label_index, SQL_LABEL_INDEX),
    "label_parse": (label_parse, SQL_LABEL_PARSE),
    "cloud_points": (cloud_points, SQL_CLOUD_POINTS),
    "cloud_audit": (cloud_audit, SQL_CLOUD_AUDIT),
}
