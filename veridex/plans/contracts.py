"""Files that Spark writes from the tables, held against manifests; canonical JSON; strict joins and cascades of reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridex.functions import decide, json_text
from veridex.functions import text as tx
from veridex.operators import joins, metrics, risk, validate
from veridex.plans.analysis import _SWEPT, GRID, observations
from veridex.plans.register import registrar
from veridex.plans.relational import predictions
from veridex.sources import files, lines, release
from veridex.sources.shared import new_path
from veridex.sources.tables import table

query, QUERIES, ORACLES = registrar()

_K = "TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)"


def event_files(spark, d) -> str:
    """A folder of JSON lines for each type of event, of those with a k of 5 or more."""
    events = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("int")).filter("k >= 5")
    path = f"{new_path(spark)}/release"
    events.select("event_id", "k", "event_type").write.partitionBy("event_type").json(path)
    return path


@query(
    "v7_release_manifest",
    f"""WITH c AS (SELECT 'event_type=' || event_type AS path, count(*) AS declared, count(*) FILTER (WHERE {_K} >= 5) AS held FROM events GROUP BY 1)
SELECT path, 'records_differ' AS issue, CAST(declared AS VARCHAR) AS expected, CAST(held AS VARCHAR) AS found FROM c WHERE path <> 'event_type=view' AND declared <> held
UNION ALL SELECT 'event_type=view', 'file_surplus', NULL, NULL FROM c WHERE path = 'event_type=view' AND held > 0
UNION ALL SELECT path, 'digest_missing', NULL, NULL FROM c WHERE path <> 'event_type=view'
UNION ALL SELECT 'event_type=none', unnest(['digest_missing', 'file_missing']), NULL, NULL UNION ALL SELECT '../' || min(path), 'path_leaves_folder', NULL, NULL FROM c""",
)
def release_manifest(spark, d):
    """The manifest counts all events of a type, the files leave some out; one type isn't in it, one of it isn't there, and
    one path leads out."""
    root = event_files(spark, d)
    declared = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("records")).filter("event_type <> 'view'")
    rows = declared.select(F.concat(F.lit("event_type="), "event_type").alias("path"), "records")
    first = table(spark, d, "events").agg(F.concat(F.lit("../event_type="), F.min("event_type")).alias("path"), F.lit(None).cast("bigint").alias("records"))
    absent = spark.createDataFrame([("event_type=none", None)], "path string, records bigint")
    manifest = rows.union(first).union(absent).withColumns({"kind": F.lit("events"), "safe_to_publish": F.lit(True)})
    found = release.release_issues(spark, root, manifest, {"raw": "(?i)raw"})
    folder = F.when(F.col("issue") == "file_surplus", F.substring_index("path", "/", 1)).otherwise(F.col("path"))
    return found.withColumn("path", folder).distinct()


@query("v13_stored_manifest", f"SELECT event_type, count(*) FILTER (WHERE {_K} >= 5) AS computed, count(*) AS declared FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE {_K} >= 5) <> count(*)")
def stored_manifest(spark, d):
    """Counts of the files themselves against those that a manifest written from the whole table declares."""
    root, path = event_files(spark, d), new_path(spark)
    whole = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    whole.agg(F.to_json(F.struct(F.collect_list(F.struct("event_type", "n")).alias("counts"))).alias("value")).write.text(path)  # a row a type
    declared = files.json_rows(spark, path, "event_type string, n bigint", "counts")
    held = files.json_lines(spark, root, "event_id bigint, k int, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return validate.reconciled(held, declared, "event_type", "n")


@query(
    "s2_malformed_lines",
    """WITH b AS (SELECT event_id, user_id % 8 AS b, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS line FROM events)
SELECT 'b=' || b AS folder, line, event_id FROM b WHERE event_id % 97 = 0""",
)
def malformed(spark, d):
    """Lines cut short in eight files, found by file and number."""
    events = table(spark, d, "events").select((F.col("user_id") % 8).alias("b"), "event_id", F.to_json(F.struct("event_id", "event_type")).alias("value"))
    cut = F.when(F.col("event_id") % 97 == 0, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    path = new_path(spark)
    events.repartition("b").sortWithinPartitions("b", "event_id").select("b", cut.alias("value")).write.partitionBy("b").text(path)
    found = lines.malformed_lines(spark, path, "event_id bigint, event_type string")
    return found.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "line", F.regexp_extract("value", r'"event_id":(\d+)', 1).cast("bigint").alias("event_id"))






def nested_props(spark, d) -> DataFrame:
    """The props of events inside others, with names in no order, a name to go, and ten levels around it all."""
    props = F.col("props")
    text = F.concat(F.lit('{"host": 1, "b": ['), props, F.lit(', {"z" : 1.50, "host":[], "a":'), props, F.lit('}],"a":"é'), "event_type", F.lit('"}'))
    return table(spark, d, "events").select("event_id", "user_id", F.concat(F.lit('{"n":' * 10), text, F.lit("}" * 10)).alias("text"))


def _canonical(host: bool) -> str:
    outer, inner = (',"host":1', ',"host":[]') if host else ("", "")
    k = "json_extract_string(props, '$.k')"
    body = f"""'{{"a":"\\u00e9' || event_type || '","b":[{{"k":' || {k} || '}},{{"a":{{"k":' || {k} || '}}{inner},"z":1.5}}]{outer}}}'"""
    return f"""repeat('{{"n":', 10) || {body} || repeat('}}', 10)"""


@query("f18_canonical_json_digest", f"SELECT event_id, sha256({_canonical(True)}) AS digest, left(sha256({_canonical(True)}), 16) AS short FROM events")
def canonical_digest(spark, d):
    digest = json_text.digest(F.col("text"))
    return nested_props(spark, d).select("event_id", digest.alias("digest")).select("event_id", "digest", F.left("digest", F.lit(16)).alias("short"))


@query("p11_keys_removed_from_untyped_json", f"SELECT event_id, {_canonical(False)} AS record FROM events")
def untyped_without_keys(spark, d):
    return nested_props(spark, d).select("event_id", json_text.canonical_json(F.col("text"), ["host"]).alias("record"))


@query(
    "a40_map_digest",
    """WITH o AS (SELECT o_custkey, string_agg('"' || o_orderkey || '":"' || sha256(o_orderstatus) || '"', ',' ORDER BY CAST(o_orderkey AS VARCHAR)) AS body FROM orders GROUP BY 1)
SELECT o_custkey, sha256('{' || body || '}') AS digest FROM o""",
)
def map_digests(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.sha2("o_orderstatus", 256).alias("digest"))
    return rows.groupBy("o_custkey").agg(json_text.map_digest(F.col("o_orderkey"), F.col("digest")).alias("digest"))


@query("j5_strict_one_to_one", "SELECT l.doc_id, quality, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def strict_join(spark, d):
    """Stops on a label without its one document, or a document of a label that comes twice."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    return joins.strict_one_to_one(labels, docs, "doc_id")


@query(
    "a32_wald_interval",
    """WITH x AS (SELECT count(*) AS n, avg(((n_chars > 1000) = (quality = 1))::INT) AS p FROM labels JOIN documents USING (doc_id))
SELECT n, p, greatest(0, p - 1.96::DOUBLE * sqrt(p * (1 - p) / n)) AS low, least(1, p + 1.96::DOUBLE * sqrt(p * (1 - p) / n)) AS high FROM x""",
)
def interval(spark, d):
    found = metrics.wald(predictions(spark, d), F.col("gold") == F.col("pred"))
    return found.select("n", *(F.round(c, 9).alias(c) for c in ("p", "low", "high")))


ORACLES["a32_wald_interval"] = f"SELECT n, round(p, 9) AS p, round(low, 9) AS low, round(high, 9) AS high FROM ({ORACLES['a32_wald_interval']})"


@query(
    "a23_closest_candidate",
    f"""WITH {_SWEPT}, b AS (SELECT *, least(1.0, failures / trusted + sqrt(ln(50 / 0.1::DOUBLE) / (2 * trusted))) AS bound FROM s WHERE trusted > 0),
c AS (SELECT * FROM b ORDER BY bound, trusted DESC, threshold LIMIT 1)
SELECT alpha, c.threshold, c.trusted, c.failures, round(c.bound, 6) AS bound, EXISTS (SELECT 1 FROM b WHERE b.bound <= alpha) AS certified FROM c, (VALUES (0.05::DOUBLE), (0.3), (0.6), (0.9)) v(alpha)""",
)
def closest_candidate(spark, d):
    """The threshold nearest to a certificate, for several levels of risk, and whether one is certified."""
    best = risk.closest(risk.hoeffding(risk.sweep(observations(spark, d), "score", "failed", GRID), 0.1, 50))
    levels = best.withColumn("alpha", F.explode(F.array(*map(F.lit, [0.05, 0.3, 0.6, 0.9]))))
    return levels.select("alpha", "threshold", "trusted", "failures", F.round("bound", 6).alias("bound"), (F.col("bound") <= F.col("alpha")).alias("certified"))


_REASONS = [
    ("metadata_missing", "o_orderdate IS NULL OR c_name IS NULL", "o_orderdate IS NULL OR c_name IS NULL"),
    ("status_excluded", "o_orderstatus NOT IN ('F', 'O')", "o_orderstatus NOT IN ('F', 'O')"),
    ("segment_excluded", "c_mktsegment = 'MACHINERY'", "c_mktsegment = 'MACHINERY'"),
    ("before_cutoff", "o_orderdate < TIMESTAMP '1993-01-01 00:00:00'", "o_orderdate < TIMESTAMP '1993-01-01 00:00:00'"),
    ("price_invalid", "isnan(o_totalprice) OR o_totalprice <= 0", "isnan(o_totalprice) OR o_totalprice <= 0"),
    ("price_outside_limit", "o_totalprice > 400000", "o_totalprice > 400000"),
    ("priority_excluded", "o_orderpriority LIKE '5%'", "o_orderpriority LIKE '5%'"),
    ("no_lines", "parts IS NULL", "parts IS NULL"),
    ("list_lengths_differ", "size(parts) <> size(suppliers)", "len(parts) <> len(suppliers)"),
    ("parts_repeat", "size(array_distinct(parts)) < size(parts)", "len(list_distinct(parts)) < len(parts)"),
]


@query(
    "p12_eligibility_of_ten_reasons",
    f"""WITH l AS (SELECT l_orderkey, list(l_partkey) AS parts, list(l_suppkey) FILTER (WHERE l_quantity > 1) AS suppliers FROM lineitem GROUP BY 1),
x AS (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT CASE {" ".join(f"WHEN {sql} THEN '{name}'" for name, _, sql in _REASONS)} ELSE 'eligible' END AS reason, count(*) AS n FROM x GROUP BY 1""",
)
def eligibility(spark, d):
    """The first of ten reasons that an order isn't eligible for, over its customer and its lines; else eligible."""
    held = F.when(F.col("l_quantity") > 1, F.col("l_suppkey"))
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"), F.collect_list(held).alias("suppliers"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    reason = decide.first_match([(F.expr(test), name) for name, test, _ in _REASONS], "eligible")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


ORACLES["p12_eligibility_of_ten_reasons"] = ORACLES["p12_eligibility_of_ten_reasons"].replace("list(l_suppkey) FILTER (WHERE l_quantity > 1)", "coalesce(list(l_suppkey) FILTER (WHERE l_quantity > 1), [])")


@query(
    "v5_overlap_on_three_keys",
    """WITH p AS (SELECT *, p_partkey % 10 = 0 AS held, p_partkey % 1000 AS own FROM part), k AS (SELECT 'own' AS key, CAST(own AS VARCHAR) AS value, held FROM p UNION ALL SELECT 'p_name', p_name, held FROM p UNION ALL SELECT 'brand_size', p_brand || '/' || p_size, held FROM p)
SELECT key, count(*) AS overlap FROM (SELECT key, value FROM k GROUP BY 1, 2 HAVING bool_or(held) AND NOT bool_and(held)) GROUP BY 1""",
)
def overlaps(spark, d):
    """For each of three keys, how many values stand on both sides of a split; keys without any are left out."""
    part = table(spark, d, "part").withColumn("held", F.col("p_partkey") % 10 == 0)
    keys = {"own": (F.col("p_partkey") % 1000).cast("string"), "p_name": F.col("p_name"), "brand_size": F.concat_ws("/", "p_brand", F.col("p_size").cast("string"))}
    pairs = F.array(*(F.struct(F.lit(name).alias("key"), value.alias("value")) for name, value in keys.items()))
    sides = part.select("held", F.inline(pairs)).groupBy("key", "value").agg(F.bool_or("held").alias("some"), F.bool_and("held").alias("all"))
    return sides.filter("some AND NOT all").groupBy("key").agg(F.count(F.lit(1)).alias("overlap"))


@query(
    "t21_best_record_by_mode",
    """WITH r AS (SELECT l_suppkey, l_returnflag AS record, avg(CASE WHEN l_linestatus = 'F' THEN l_discount END) AS a, min(l_tax) FILTER (WHERE l_quantity > 49) AS b, -sum(greatest(0, 20 - l_quantity)) AS deficit FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, CASE l_suppkey % 3 WHEN 0 THEN 'accuracy' WHEN 1 THEN 'least' ELSE 'floor' END AS mode, round(coalesce(a, -1), 9) AS x, round(coalesce(b, -1), 9) AS y FROM r)
SELECT l_suppkey, mode, record FROM m QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE mode WHEN 'accuracy' THEN x WHEN 'least' THEN y ELSE deficit END DESC, CASE mode WHEN 'accuracy' THEN y ELSE x END DESC, CASE mode WHEN 'floor' THEN y ELSE deficit END DESC, record) = 1""",
)
def best_by_mode(spark, d):
    """The best of each supplier's records, by an order of metrics that its mode sets; a missing metric is -1."""
    rows = table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_returnflag").alias("record")).agg(
        F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_discount"))).alias("a"), F.min(F.when(F.col("l_quantity") > 49, F.col("l_tax"))).alias("b"),
        (-F.sum(F.greatest(F.lit(0), 20 - F.col("l_quantity")))).alias("deficit"),
    )
    mode = F.element_at(F.array(*map(F.lit, ["accuracy", "least", "floor"])), (F.col("l_suppkey") % 3 + 1).cast("int"))
    x, y, deficit = F.round(F.coalesce("a", F.lit(-1.0)), 9), F.round(F.coalesce("b", F.lit(-1.0)), 9), F.col("deficit").cast("double")
    score = decide_tuple(mode, {"accuracy": (x, y, deficit), "least": (y, x, deficit), "floor": (deficit, x, y)})
    best = Window.partitionBy("l_suppkey").orderBy(score.desc(), "record")
    return rows.select("l_suppkey", mode.alias("mode"), "record", F.row_number().over(best).alias("rn")).filter("rn = 1").drop("rn")


def decide_tuple(mode, orders):
    """The metrics of a record in the order of its mode, as one value that compares field by field."""
    out = None
    for name, fields in orders.items():
        own = F.struct(*(field.alias(f"m{i}") for i, field in enumerate(fields)))
        out = F.when(mode == name, own) if out is None else out.when(mode == name, own)
    return out


@query(
    "f15_lists_of_both_kinds",
    """WITH x AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'A | ' || s_name || ' || ' || s_nationkey WHEN 1 THEN ' NaN ' WHEN 2 THEN NULL ELSE s_name END AS piped, s_nationkey || ' / x/' || s_nationkey AS slashed FROM supplier)
SELECT s_suppkey, CASE WHEN piped IS NULL OR lower(trim(piped)) IN ('', 'nan', 'none', 'null') THEN [] ELSE list_filter(list_transform(string_split(piped, '|'), lambda c: trim(c)), lambda c: c <> '') END AS piped,
list_filter(list_transform(string_split(slashed, '/'), lambda c: trim(c)), lambda c: c <> '') AS slashed FROM x""",
)
def lists(spark, d):
    m = F.col("s_suppkey") % 4
    piped = F.when(m == 0, F.concat(F.lit("A | "), "s_name", F.lit(" || "), F.col("s_nationkey").cast("string"))).when(m == 1, " NaN ").when(m == 3, F.col("s_name"))
    slashed = F.concat(F.col("s_nationkey").cast("string"), F.lit(" / x/"), F.col("s_nationkey").cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", tx.listed(piped).alias("piped"), tx.listed(slashed, "/", unique=False).alias("slashed"))


_ROW_RULES = [
    ("id_missing", "doc_id IS NOT NULL", None),
    ("id_negative", "doc_id >= 0", None),
    ("language_unknown", "lang IN ('de', 'en', 'es')", None),
    ("source_malformed", "source RLIKE '^[a-z]+[0-9]+$'", "regexp_matches(source, '^[a-z]+[0-9]+$')"),
    ("text_blank", "trim(text) <> ''", None),
    ("size_differs", "n_chars = length(text)", None),
    ("size_outside_limit", "n_chars BETWEEN 1 AND 5000", None),
    ("control_character", "NOT text RLIKE '[\\\\x00-\\\\x08]'", "NOT regexp_matches(text, '[\\x00-\\x08]')"),
    ("address_inside", "NOT contains(text, '@')", None),
    ("end_missing", "text RLIKE '[.!?]\\\\s*$'", "regexp_matches(text, '[.!?]\\s*$')"),
    ("markup_inside", "NOT text RLIKE '<[a-z]+>'", "NOT regexp_matches(text, '<[a-z]+>')"),
]


@query(
    "v1_issues_of_eleven_rules",
    "SELECT doc_id, issue FROM (" + " UNION ALL ".join(f"SELECT doc_id, 'document_{name}' AS issue FROM documents WHERE NOT coalesce({other or test}, false)" for name, test, other in _ROW_RULES) + ")",
)
def row_issues(spark, d):
    """Every rule that a document breaks, with a prefix; a rule that is null is broken."""
    return validate.issues(table(spark, d, "documents"), "doc_id", [(f"document_{name}", F.expr(test)) for name, test, _ in _ROW_RULES])


@query(
    "p13_agreement_checks",
    """SELECT page_id, regexp_extract(url, '[^/]*$', 0) <> '' AS has_name, contains(url, regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AND regexp_extract(url, '^[a-z]+://([^/]+)', 1) <> '' AS host_agrees,
contains(html, url) AS names_itself, coalesce(isfinite(TRY_CAST(regexp_extract(html, '[0-9]+', 0) AS DOUBLE)), false) AS finite, coalesce(TRY_CAST(regexp_extract(html, '[0-9]+', 0) AS DOUBLE) / 100 BETWEEN 0 AND 1, false) AS in_unit FROM pages""",
)
def agreement(spark, d):
    """Checks of a page's own values: its name, its host, whether it names itself, and its first number."""
    host, number = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1), F.regexp_extract("html", "[0-9]+", 0).try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return table(spark, d, "pages").select(
        "page_id", (F.regexp_extract("url", "[^/]*$", 0) != "").alias("has_name"), (F.contains("url", host) & (host != "")).alias("host_agrees"), F.contains("html", "url").alias("names_itself"),
        F.coalesce(finite, F.lit(False)).alias("finite"), F.coalesce((number / 100).between(0, 1), F.lit(False)).alias("in_unit"),
    )


@query(
    "h14_observed_pairs",
    """WITH p AS (SELECT DISTINCT o_orderpriority AS action, o_orderstatus AS status FROM orders WHERE o_orderkey % 5 <> 0 AND o_totalprice > 300000),
a AS (SELECT DISTINCT o_orderpriority AS action FROM orders), s AS (SELECT DISTINCT o_orderstatus AS status FROM orders)
SELECT a.action, s.status, row_number() OVER (ORDER BY a.action, s.status) - 1 AS place, p.action IS NOT NULL AS observed FROM a CROSS JOIN s LEFT JOIN p ON p.action = a.action AND p.status = s.status""",
)
def observed_pairs(spark, d):
    """All actions with all statuses in order, and which pairs the training rows hold; the domains are few values each."""
    orders = table(spark, d, "orders")
    domains = orders.agg(F.array_sort(F.collect_set("o_orderpriority")).alias("actions"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"))
    pairs = F.flatten(F.transform("actions", lambda a: F.transform("statuses", lambda s: F.struct(a.alias("action"), s.alias("status")))))
    every = domains.select(F.posexplode(pairs).alias("place", "pair")).select("pair.*", F.col("place").cast("bigint").alias("place"))
    train = orders.filter("o_orderkey % 5 <> 0 AND o_totalprice > 300000").select(F.col("o_orderpriority").alias("action"), F.col("o_orderstatus").alias("status")).distinct()
    return every.join(train.withColumn("observed", F.lit(True)), ["action", "status"], "left").select("action", "status", "place", F.coalesce("observed", F.lit(False)).alias("observed"))
