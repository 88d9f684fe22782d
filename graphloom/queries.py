"""Queries on the driver tables, each with the SQL it equals."""

from __future__ import annotations

import atexit
import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import convert as C
from .functions import keys as K
from .functions import text as X
from .model import registry
from .operators import batching, build, export, lookup, validate
from .plans import config, dag, declarative, events, metadata
from .session import configure

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark, d: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{d}/{name}.parquet")


def key(prefix: str, *columns: str):
    return F.concat_ws(":", F.lit(prefix), *[F.col(c).cast("string") for c in columns])


# ---- projection of the driver tables onto the graph ----------------------------------------------------------------


def customers(spark, d):
    return build.entities(table(spark, d, "customer").withColumn("name", F.col("c_name")), type="shop_customer", classes=["Person"], key=key("customer", "c_custkey"), step="fetch-customers", assign={"segment": F.col("c_mktsegment"), "nation": F.col("c_nationkey").cast("string")})


def suppliers(spark, d):
    return build.entities(table(spark, d, "supplier").withColumn("name", F.col("s_name")), type="shop_supplier", classes=["Vendor"], key=key("supplier", "s_suppkey"), step="fetch-suppliers", assign={"nation": F.col("s_nationkey").cast("string")})


def nations(spark, d):
    return build.entities(table(spark, d, "nation").withColumn("name", F.col("n_name")), type="shop_nation", classes=["Site"], key=key("nation", "n_nationkey"), step="fetch-nations", assign={"code": F.col("n_nationkey").cast("string")})


def orders(spark, d):
    return build.entities(table(spark, d, "orders").withColumn("name", F.col("o_orderkey").cast("string")), type="shop_order", classes=["Record"], key=key("order", "o_orderkey"), step="fetch-orders", assign={"state": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})


def lines(spark, d):
    return build.entities(table(spark, d, "lineitem").withColumn("name", F.col("l_orderkey").cast("string")), type="shop_order_line", classes=["Record"], key=key("line", "l_orderkey", "l_linenumber"), step="fetch-lines", assign={"part": F.col("l_partkey"), "supplier": F.col("l_suppkey"), "cents": F.round(F.col("l_extendedprice") * 100).cast("long"), "flag": F.col("l_returnflag")})


def customer_orders(spark, d):
    return build.relationships(table(spark, d, "orders"), "HAS", from_key=key("customer", "o_custkey"), to_key=key("order", "o_orderkey"), from_type="shop_customer", to_type="shop_order", step="fetch-orders")


def order_lines(spark, d):
    return build.relationships(table(spark, d, "lineitem"), "CONTAINS", from_key=key("order", "l_orderkey"), to_key=key("line", "l_orderkey", "l_linenumber"), from_type="shop_order", to_type="shop_order_line", step="fetch-lines")


def nation_customers(spark, d):
    return build.relationships(table(spark, d, "customer"), "HAS", from_key=key("nation", "c_nationkey"), to_key=key("customer", "c_custkey"), from_type="shop_nation", to_type="shop_customer", step="fetch-customers")


HEAD = ("_key", "_type", "step_id")


def all_entities(spark, d):
    out = None
    for f in (nations, customers, suppliers, orders, lines):
        e = f(spark, d).select(*HEAD)
        out = e if out is None else out.unionByName(e)
    return out


def all_relationships(spark, d):
    out = None
    for f in (nation_customers, customer_orders, order_lines):
        r = f(spark, d).select(*HEAD, "_class", "_fromEntityKey", "_toEntityKey")
        out = r if out is None else out.unionByName(r)
    return out


_OBJECTS = """
  SELECT 'nation:' || n_nationkey AS _key, 'shop_nation' AS _type, 'fetch-nations' AS step_id FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'shop_customer', 'fetch-customers' FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'shop_supplier', 'fetch-suppliers' FROM supplier
  UNION ALL SELECT 'order:' || o_orderkey, 'shop_order', 'fetch-orders' FROM orders
  UNION ALL SELECT 'line:' || l_orderkey || ':' || l_linenumber, 'shop_order_line', 'fetch-lines' FROM lineitem"""
_EDGES = """
  SELECT 'nation:' || c_nationkey || '|has|customer:' || c_custkey AS _key, 'shop_nation_has_customer' AS _type, 'fetch-customers' AS step_id, 'HAS' AS _class, 'nation:' || c_nationkey AS _fromEntityKey, 'customer:' || c_custkey AS _toEntityKey FROM customer
  UNION ALL SELECT 'customer:' || o_custkey || '|has|order:' || o_orderkey, 'shop_customer_has_order', 'fetch-orders', 'HAS', 'customer:' || o_custkey, 'order:' || o_orderkey FROM orders
  UNION ALL SELECT 'order:' || l_orderkey || '|contains|line:' || l_orderkey || ':' || l_linenumber, 'shop_order_contains_line', 'fetch-lines', 'CONTAINS', 'order:' || l_orderkey, 'line:' || l_orderkey || ':' || l_linenumber FROM lineitem"""


# ---- tier 1: objects, keys, lookups ---------------------------------------------------------------------------------


@query(f"SELECT step_id, _type, count(*) AS n FROM ({_OBJECTS} UNION ALL SELECT _key, _type, step_id FROM ({_EDGES})) GROUP BY 1, 2")
def type_counts_by_step(spark, d):
    return all_entities(spark, d).unionByName(all_relationships(spark, d).select(*HEAD)).groupBy("step_id", "_type").agg(F.count("*").alias("n"))


@query(f"SELECT * FROM ({_EDGES})")
def direct_relationships(spark, d):
    return all_relationships(spark, d)


@query("SELECT o_orderkey, 'customer:' || o_custkey AS wanted, 'customer:' || c_custkey AS found_key, c_name AS found_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def find_entity_lookup(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", key("customer", "o_custkey").alias("wanted"))
    return lookup.find_entity(o, "wanted", customers(spark, d).select("_key", "name")).select("o_orderkey", "wanted", F.col("found__key").alias("found_key"), "found_name")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def has_key_semi(spark, d):
    o = orders(spark, d).select("_key", F.col("name").cast("long").alias("o_orderkey"))
    ends = order_lines(spark, d).select(F.col("_fromEntityKey").alias("_key"))
    return lookup.has_key(o, "_key", ends).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def has_key_anti(spark, d):
    o = orders(spark, d).select("_key", F.col("name").cast("long").alias("o_orderkey"))
    ends = order_lines(spark, d).select(F.col("_fromEntityKey").alias("_key"))
    return lookup.has_key(o, "_key", ends, negate=True).select("o_orderkey")


@query(f"SELECT _key, step_id FROM ({_OBJECTS}) WHERE _type = 'shop_customer'")
def iterate_entities_by_type(spark, d):
    return all_entities(spark, d).where(F.col("_type") == "shop_customer").select("_key", "step_id")


@query(f"SELECT _key, _fromEntityKey, _toEntityKey FROM ({_EDGES}) WHERE _type = 'shop_customer_has_order'")
def iterate_relationships_by_type(spark, d):
    return all_relationships(spark, d).where(F.col("_type") == "shop_customer_has_order").select("_key", "_fromEntityKey", "_toEntityKey")


@query("SELECT o_orderkey, 'customer:' || o_custkey || '|' || lower('HAS') || '|order:' || o_orderkey AS k FROM orders")
def relationship_key_gen(spark, d):
    return table(spark, d, "orders").select("o_orderkey", K.relationship_key(key("customer", "o_custkey"), F.lit("HAS"), key("order", "o_orderkey")).alias("k"))


@query("""SELECT * FROM (VALUES ('aws_vpc', 'aws_lambda_function', 'aws_vpc_has_lambda_function'), ('azure_sql_server', 'azure_sql_database', 'azure_sql_server_has_database'),
 ('aws_instance', 'aws_instance', 'aws_instance_has_instance'), ('employee', 'user_endpoint', 'employee_has_user_endpoint'), ('employee', 'employee', 'employee_has_'), ('shop_order', 'shop_order_line', 'shop_order_has_line')) AS t(f, t, r)""")
def relationship_type_gen(spark, d):
    rows = [("aws_vpc", "aws_lambda_function"), ("azure_sql_server", "azure_sql_database"), ("aws_instance", "aws_instance"), ("employee", "user_endpoint"), ("employee", "employee"), ("shop_order", "shop_order_line")]
    return spark.createDataFrame(rows, "f string, t string").withColumn("r", K.relationship_type(F.lit("HAS"), F.col("f"), F.col("t")))


# ---- tier 2: builders and scalar functions --------------------------------------------------------------------------


@query("SELECT 'customer:' || c_custkey AS _key, 'shop_customer' AS _type, 'Person' AS cls, c_name AS name, c_name AS \"displayName\", c_mktsegment AS segment FROM customer")
def entity_build(spark, d):
    return customers(spark, d).select("_key", "_type", F.array_join("_class", ",").alias("cls"), "name", "displayName", "segment")


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type = 'purchase' THEN false END AS active FROM events")
def entity_active_flag(spark, d):
    words = F.when(F.col("event_type").isin("click", "view"), "Enabled").when(F.col("event_type") == "purchase", "inactive").otherwise("unknown")
    e = table(spark, d, "events").select("event_id", words.alias("status"))
    return build.entities(e, type="app_event", classes=["Record"], key=F.col("event_id"), step="s", assign={"event_id": F.col("event_id")}).select("event_id", "active")


@query("SELECT event_id, epoch_us(ts) // 1000 AS created_on FROM events")
def entity_created_on(spark, d):
    e = table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("createdAt"))
    return build.entities(e, type="app_event", classes=["Record"], key=F.col("event_id"), step="s", assign={"event_id": F.col("event_id")}).select("event_id", F.col("createdOn").alias("created_on"))


@query("SELECT s_suppkey, s_name AS name, 'x' AS category FROM supplier")
def entity_whitelist(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("name"), F.lit("x").alias("category"), F.lit("no").alias("unknownProperty"), F.array(F.lit("t")).alias("tags"))
    e = build.entities(s, type="shop_supplier", classes=["Vendor"], key=F.col("s_suppkey"), step="s")
    return e.select(F.col("_key").cast("long").alias("s_suppkey"), *[c for c in e.columns if not c.startswith("_") and c not in ("step_id", "displayName")])


@query("""SELECT s, CASE WHEN lower(s) IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(s, '[0-9]+(\\.[0-9]+)?') THEN 'number' ELSE 'string' END AS kind,
 CASE WHEN regexp_full_match(s, '[0-9]+(\\.[0-9]+)?') THEN CAST(s AS DOUBLE) END AS d FROM (SELECT p_size || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.50' ELSE 'e3' END AS s FROM part UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN 'TRUE' ELSE '-' || p_size END FROM part)""".replace("\\\\", "\\"))
def parse_string_value(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "").when(F.col("p_partkey") % 3 == 1, ".50").otherwise("e3")).alias("s"))
    b = p.select(F.when(F.col("p_partkey") % 2 == 0, "TRUE").otherwise(F.concat(F.lit("-"), F.col("p_size").cast("string"))).alias("s"))
    return a.unionAll(b).withColumn("v", C.parse_string_value(F.col("s"))).select("s", "v.kind", "v.d")


@query("SELECT * FROM (VALUES ('createdOn', true), ('created_at', true), ('startTime', true), ('birth_date', true), ('name', false), ('On', false), ('money', false), ('timestamp', false)) AS t(name, is_time)")
def time_property_names(spark, d):
    names = ["createdOn", "created_at", "startTime", "birth_date", "name", "On", "money", "timestamp"]
    return spark.createDataFrame([(n,) for n in names], "name string").withColumn("is_time", X.F.coalesce(C.is_time_property(F.col("name")), F.lit(False)))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 2 = 0 THEN 1601942400999 END AS sec, epoch_ms(date_trunc('second', ts)) AS http, epoch_ms(date_trunc('day', ts)) AS us FROM events")
def parse_time(spark, d):
    e = table(configure(spark), d, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    http, us = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.date_format("ts", "MMM d, yyyy")
    return e.select("event_id", C.parse_time(iso).alias("ms"), C.parse_time(F.when(F.col("event_id") % 2 == 0, "1601942400.99999").otherwise("garbage"), "sec").alias("sec"), C.parse_time(http).alias("http"), C.parse_time(us).alias("us"))


@query("SELECT p_partkey, unnest(['partName', 'retailPrice2', 'xmlHttpRequest', 'p2PName']) AS k, unnest([p_name, p_brand, p_type, p_name]) AS v FROM part")
def convert_properties(spark, d):
    m = F.create_map(F.lit("part_name"), F.col("p_name"), F.lit("Retail Price2"), F.col("p_brand"), F.lit("gone"), F.lit(None).cast("string"), F.lit("XMLHttpRequest"), F.col("p_type"), F.lit("p2p_name"), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.explode(C.convert_properties(m)).alias("k", "v"))


@query("""SELECT p_partkey, p_size AS "x.partSize", 1577836800000 AS "x.createdOn", '["' || p_brand || '","' || p_type || '"]' AS "x.kinds", '{"Brand":"' || p_brand || '"}' AS "x.detail" FROM part""")
def convert_columns(spark, d):
    src = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("part_size"), F.lit("2020-01-01T00:00:00Z").alias("createdOn"), F.array("p_brand", "p_type").alias("Kinds"), F.struct(F.col("p_brand").alias("Brand")).alias("detail"))
    props = C.convert_columns(src.drop("p_partkey"), prefix="x", parse_time_names=True, stringify_array=True, stringify_object=True)
    return src.select("p_partkey", *props).withColumn("x.createdOn", F.col("`x.createdOn`").cast("long"))


@query("SELECT p_partkey, unnest(['x.brand', 'x.retailPrice']) AS k, unnest([p_type, p_name]) AS v FROM part")
def name_value_pairs(spark, d):
    one = lambda n, v: F.struct(F.lit(n).alias("Name"), v.alias("Value"))
    a = F.array(one("brand", F.col("p_brand")), one("", F.col("p_name")), one("empty", F.lit("")), one("brand", F.col("p_type")), one("Retail Price", F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", F.explode(C.name_value_pairs(a, "x", fields=("Name", "Value"))).alias("k", "v"))


@query("SELECT c_custkey, to_base64(from_hex(sha256('\"' || c_name || '\"'))) AS h FROM customer")
def sha256_b64(spark, d):
    return table(spark, d, "customer").select("c_custkey", C.sha256_base64(C.json_text(F.col("c_name"))).alias("h"))


@query("SELECT doc_id, CASE WHEN length(text) > 4096 THEN left(text, 4093) || '...' ELSE text END AS t FROM documents")
def truncate_value(spark, d):
    return table(spark, d, "documents").select("doc_id", C.truncate_value(F.col("text")).alias("t"))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_type || CASE WHEN p_partkey % 2 = 0 THEN ' , ' || p_brand ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN ',' ELSE ' ' END), lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM part")
def tag_string_split(spark, d):
    s = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit(" , "), "p_brand")).otherwise(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(X.split_tags(s), "|").alias("tags"))


@query("SELECT c_custkey, 'label' AS labels, 'tag.Owner|tag.label|tag.name' AS names, lower(c_name) AS owner, c_mktsegment AS display FROM customer")
def tag_map_assign(spark, d):
    one = lambda k, v: F.struct(F.lit(k).alias("Key"), v.alias("Value"))
    none = F.lit(None).cast("string")
    m = F.map_concat(X.key_value_tags(F.array(one("Owner", F.col("c_name")), one("label", F.lit("True")), one("name", F.col("c_mktsegment")), one("", F.col("c_name")), one("nothing", none))), F.create_map(F.lit("absent"), none))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(X.label_tags(m)), "|").alias("labels"), F.array_join(F.array_sort(F.map_keys(X.tag_properties(m))), "|").alias("names"), X.common_tag(m, "owner").alias("owner"), X.tag_name(m).alias("display"))


@query("""SELECT * FROM (VALUES ('10.0.0.1/32', true, false, false, false, false), ('0.0.0.0/0', false, true, false, true, true), ('127.0.0.1', false, false, true, false, true), ('::1/128', true, false, true, true, false), ('8.8.8.8', false, false, false, true, true), ('172.20.1.1', false, false, false, false, true), ('2001:db8::/32', true, false, false, true, false))
 AS t(ip, host, internet, loopback, public, v4) WHERE true""".replace("('10.0.0.1/32', true, false, false, false, false)", "('10.0.0.1/32', true, false, false, false, true)"))
def ip_classify(spark, d):
    rows = ["10.0.0.1/32", "0.0.0.0/0", "127.0.0.1", "::1/128", "8.8.8.8", "172.20.1.1", "2001:db8::/32"]
    ip = F.col("ip")
    return spark.createDataFrame([(r,) for r in rows], "ip string").select("ip", X.is_host(ip).alias("host"), X.is_internet(ip).alias("internet"), X.is_loopback(ip).alias("loopback"), X.is_public(ip).alias("public"), X.is_ipv4(ip).alias("v4"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'n' ELSE 'größe_' END || regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN p_size || p_type ELSE p_brand END, '[^A-Za-z0-9_]', '_', 'g') AS n FROM part")
def sanitize_names(spark, d):
    s = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.col("p_size").cast("string"), "p_type")).otherwise(F.concat(F.lit("größe{"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", X.sanitize_name(s).alias("n"))


@query("SELECT event_id, replace(props, '\"', '\\\"') AS v FROM events")
def sanitize_values(spark, d):
    return table(spark, d, "events").select("event_id", X.sanitize_value(F.col("props")).alias("v"))


@query("SELECT c_custkey, c_name AS name, ' ' || c_mktsegment AS kept FROM customer")
def trim_strings(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), F.concat(F.lit(" "), "c_mktsegment").alias("kept"))
    return C.trim_strings(c, keep=("kept",))


@query("SELECT s_suppkey, s_suppkey BETWEEN 10 AND 999999 AS asn, s_suppkey < 256 AS ip, s_suppkey % 40 <= 32 AS cidr, s_suppkey % 2 = 0 AS six FROM supplier")
def format_checks(spark, d):
    k = F.col("s_suppkey")
    cidr = F.concat(F.lit("10.0.0.1/"), (k % 40).cast("string"))
    six = F.when(k % 4 == 0, "2001:db8::1").when(k % 4 == 2, "::ffff:10.0.0.1").when(k % 4 == 1, ":").otherwise("1:2:3:4:5:6:7:8:9")
    return table(spark, d, "supplier").select("s_suppkey", X.has_format(F.concat(F.lit("AS"), k.cast("string")), "asn").alias("asn"), X.has_format(F.concat(F.lit("10.0.0."), k.cast("string")), "ip").alias("ip"), X.has_format(cidr, "ipCidr").alias("cidr"), X.has_format(six, "ip").alias("six"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 2 AS payloads FROM events")
def raw_data_extract(spark, d):
    e = table(spark, d, "events").select("event_id", F.array(F.struct(F.lit("default").alias("name"), F.col("props").alias("raw"))).alias("_raw"))
    e = build.add_raw_data(e, "more", F.lit("{}"))
    return e.select("event_id", F.get_json_object(build.raw_data(e), "$.k").cast("long").alias("k"), F.size("_raw").alias("payloads"))


@query("SELECT event_id, event_id % 5 <> 0 AS ok FROM events")
def raw_data_names_unique(spark, d):
    one = lambda n: F.struct(n.alias("name"), F.col("props").alias("raw"))
    e = table(spark, d, "events").select("event_id", F.array(one(F.lit("default")), one(F.when(F.col("event_id") % 5 == 0, "default").otherwise("other"))).alias("_raw"))
    return e.select("event_id", build.raw_names_unique().alias("ok"))


# ---- tier 3: accounting ----------------------------------------------------------------------------------------------


@query(f"SELECT _key AS key, count(*) AS count FROM ({_OBJECTS}) GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return lookup.duplicate_keys(all_entities(spark, d))


@query("SELECT lower(c_mktsegment) AS key, count(*) AS count FROM customer GROUP BY 1 HAVING count(*) > 1")
def normalized_key_dedup(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("_key"))
    return lookup.duplicate_keys(c, F.lower)


@query(f"SELECT DISTINCT lower(_key) AS key FROM ({_OBJECTS} UNION ALL SELECT _key, _type, step_id FROM ({_EDGES}))")
def encountered_keys(spark, d):
    return all_entities(spark, d).unionByName(all_relationships(spark, d).select(*HEAD)).select(F.lower("_key").alias("key")).distinct()


@query(f"SELECT _type, count(DISTINCT _key) = count(_key) AS keys_distinct FROM ({_OBJECTS}) GROUP BY 1")
def keys_distinct(spark, d):
    return all_entities(spark, d).groupBy("_type").agg((F.count_distinct("_key") == F.count("_key")).alias("keys_distinct"))


_LINES = "SELECT 'line:' || l_orderkey || ':' || l_linenumber AS _key, l_partkey AS part, l_suppkey AS supplier, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, l_returnflag AS flag FROM lineitem"


@query(f"""WITH l AS (SELECT * FROM ({_LINES}) UNION ALL SELECT * FROM ({_LINES}) WHERE part % 20 = 0 UNION ALL SELECT _key, part, supplier, cents, '?' FROM ({_LINES}) WHERE part % 30 = 0),
 r AS (SELECT *, row_number() OVER w AS rn, first_value(part) OVER w AS p0, first_value(flag) OVER w AS f0 FROM l WINDOW w AS (PARTITION BY _key ORDER BY part, supplier, cents, flag ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT _key, part AS duplicate_part, p0 AS original_part, flag = f0 AS properties_match FROM r WHERE rn > 1""")
def duplicate_entity_report(spark, d):
    """Lines of which some come as exact copies and some tied but for a property."""
    x = lines(spark, d).select("_key", "part", "supplier", "cents", "flag")
    x = x.unionAll(x.where("part % 20 = 0")).unionAll(x.where("part % 30 = 0").withColumn("flag", F.lit("?")))
    r = lookup.duplicate_report(x, ["part", "supplier", "cents"], ["flag"])
    return r.select("_key", "duplicate_part", "original_part", "properties_match")


@query("""SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['n.tags', 'n.deep.size', 'kind'] ELSE ['kind', 'n'] END) AS path, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['array_values_mismatch', 'value_mismatch', 'type_mismatch'] ELSE ['type_mismatch', 'missing_in_duplicate'] END) AS kind FROM customer""")
def property_diff_nested(spark, d):
    k = F.col("c_custkey")
    nested = lambda tag, size: F.struct(F.array(F.lit("x"), F.lit(tag)).alias("tags"), F.struct(F.lit(size).alias("size"), F.col("c_name").alias("name")).alias("deep"))
    c = table(spark, d, "customer").select("c_custkey", F.struct(F.lit(1).alias("kind"), nested("a", 1).alias("n")).alias("a"), F.struct(F.lit("1").alias("kind"), F.when(k % 2 == 0, nested("b", 2)).alias("n")).alias("b"))
    return lookup.property_diff(c, ["kind", "n"], keep=["c_custkey"])


@query("""SELECT c_custkey, p AS path, k AS kind FROM (SELECT c_custkey, 'name' AS p, CASE WHEN c_custkey % 3 = 0 THEN 'value_mismatch' END AS k FROM customer UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 5 = 0 THEN 'missing_in_duplicate' END FROM customer
 UNION ALL SELECT c_custkey, 'extra', CASE WHEN c_custkey % 7 = 0 THEN 'missing_in_original' END FROM customer) WHERE k IS NOT NULL""")
def property_diff(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("extra")).alias("a"), F.struct(F.when(k % 3 == 0, "other").otherwise(F.col("c_name")).alias("name"), F.when(k % 5 != 0, F.col("c_mktsegment")).alias("segment"), F.when(k % 7 == 0, "x").alias("extra")).alias("b"))
    return lookup.property_diff(c, ["name", "segment", "extra"], keep=["c_custkey"])


STEPS = [
    dag.StepSpec("fetch-nations", types=("shop_nation",), partial_types=("shop_nation",)),
    dag.StepSpec("fetch-customers", types=("shop_customer", "shop_nation_has_customer"), depends_on=("fetch-nations",), ingestion_source="people"),
    dag.StepSpec("fetch-suppliers", types=("shop_supplier",), depends_on=("fetch-nations",), ingestion_source="people"),
    dag.StepSpec("fetch-orders", types=("shop_order",), depends_on=("fetch-customers",), ingestion_source="sales"),
    dag.StepSpec("fetch-lines", types=("shop_order_line", "shop_order_contains_line"), depends_on=("fetch-orders", "fetch-suppliers"), graph_id="details", ingestion_source="sales"),
]
_STEP_TYPES = "(VALUES ('fetch-nations', 'shop_nation'), ('fetch-customers', 'shop_customer'), ('fetch-customers', 'shop_nation_has_customer'), ('fetch-suppliers', 'shop_supplier'), ('fetch-orders', 'shop_order'), ('fetch-lines', 'shop_order_line'), ('fetch-lines', 'shop_order_contains_line')) AS s(step_id, _type)"
_STEP_DEPS = "(VALUES ('fetch-customers', 'fetch-nations'), ('fetch-suppliers', 'fetch-nations'), ('fetch-orders', 'fetch-customers'), ('fetch-lines', 'fetch-orders'), ('fetch-lines', 'fetch-suppliers')) AS e(step_id, dep)"
_STEP_LIST = "(VALUES (0, 'fetch-nations', NULL, NULL), (1, 'fetch-customers', NULL, 'people'), (2, 'fetch-suppliers', NULL, 'people'), (3, 'fetch-orders', NULL, 'sales'), (4, 'fetch-lines', 'details', 'sales')) AS l(ordinal, step_id, graph_id, source)"
_CLOSURE = f"WITH RECURSIVE reach(step_id, ancestor) AS (SELECT step_id, dep FROM {_STEP_DEPS} UNION SELECT r.step_id, e.dep FROM reach r JOIN (SELECT * FROM {_STEP_DEPS}) e ON r.ancestor = e.step_id)"


def steps(spark):
    return dag.steps_frame(configure(spark), STEPS)


def declared(spark):
    return steps(spark).select("step_id", F.explode("types").alias("_type"))


@query(f"SELECT step_id, string_agg(DISTINCT _type, ',' ORDER BY _type) AS types FROM ({_OBJECTS} UNION ALL SELECT _key, _type, step_id FROM ({_EDGES})) GROUP BY 1")
def encountered_types(spark, d):
    o = all_entities(spark, d).unionByName(all_relationships(spark, d).select(*HEAD))
    return o.groupBy("step_id").agg(F.array_join(F.array_sort(F.collect_set("_type")), ",").alias("types"))


@query(f"SELECT DISTINCT o.step_id, o._type FROM ({_OBJECTS} UNION ALL SELECT _key, _type, step_id FROM ({_EDGES})) o ANTI JOIN {_STEP_TYPES} ON o.step_id = s.step_id AND o._type = s._type")
def undeclared_types(spark, d):
    o = all_entities(spark, d).unionByName(all_relationships(spark, d).select(*HEAD))
    return o.select("step_id", "_type").distinct().join(declared(spark), ["step_id", "_type"], "left_anti")


@query(f"SELECT step_id, _type, step_id = 'fetch-nations' AS partial FROM {_STEP_TYPES}")
def declared_types(spark, d):
    s = steps(spark).select("step_id", F.explode("types").alias("_type"), "partial_types")
    return s.select("step_id", "_type", F.array_contains("partial_types", F.col("_type")).alias("partial"))


@query(f"SELECT DISTINCT _type FROM {_STEP_TYPES} WHERE step_id IN ('fetch-nations', 'fetch-orders', 'fetch-lines')")
def partial_datasets(spark, d):
    own = spark.createDataFrame([(s.id, "failure" if s.id == "fetch-orders" else "success") for s in STEPS], "step_id string, outcome string")
    status = dag.final_status(steps(spark), own)
    bad = status.where(F.col("status").isin(dag.FAILURE, dag.PARTIAL)).join(steps(spark), "step_id").select(F.explode("types").alias("_type"))
    always = status.where(F.col("status") != dag.DISABLED).join(steps(spark), "step_id").select(F.explode("partial_types").alias("_type"))
    return bad.unionAll(always).distinct()


@query(f"SELECT step_id, count(*) AS n, min(_key) AS first_key, max(_key) AS last_key FROM ({_OBJECTS}) GROUP BY 1")
def entities_by_step(spark, d):
    return all_entities(spark, d).groupBy("step_id").agg(F.count("*").alias("n"), F.min("_key").alias("first_key"), F.max("_key").alias("last_key"))


_SIZE = "strlen('{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\",\"o_orderpriority\":\"' || o_orderpriority || '\"}')"


@query(f"SELECT o_orderkey, CAST({_SIZE} AS BIGINT) AS bytes FROM orders")
def object_size_bytes(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.object_size("o_orderkey", "o_orderstatus", "o_orderpriority").alias("bytes"))


@query(f"SELECT o_orderstatus AS step, CAST(sum({_SIZE}) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def size_by_step(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("step")).agg(F.sum(C.object_size("o_orderkey", "o_orderstatus", "o_orderpriority")).alias("bytes"))


_PROPS = "SELECT p_partkey, 'p_name' AS prop, strlen(p_name) + 2 AS bytes FROM part UNION ALL SELECT p_partkey, 'p_brand', strlen(p_brand) + 2 FROM part UNION ALL SELECT p_partkey, 'p_size', strlen(CAST(p_size AS VARCHAR)) FROM part"


def _property_sizes(spark, d):
    return C.property_sizes(table(spark, d, "part"), ["p_name", "p_brand", "p_size"], ["p_partkey"])


@query(f"SELECT p_partkey, prop, CAST(bytes AS BIGINT) AS bytes FROM ({_PROPS})")
def property_sizes(spark, d):
    return _property_sizes(spark, d).select("p_partkey", "prop", "bytes")


@query(f"SELECT p_partkey, arg_max(prop, bytes * 10 - rank) AS prop, CAST(max(bytes) AS BIGINT) AS bytes FROM (SELECT *, CASE prop WHEN 'p_name' THEN 0 WHEN 'p_brand' THEN 1 ELSE 2 END AS rank FROM ({_PROPS})) GROUP BY 1")
def largest_property(spark, d):
    return C.largest_property(_property_sizes(spark, d), ["p_partkey"])


@query("SELECT user_id, arg_max(event_id, strlen(props) * 1000000000 - event_id) AS event_id, CAST(max(strlen(props)) AS BIGINT) AS bytes FROM events GROUP BY 1")
def largest_raw_data(spark, d):
    n = F.octet_length("props").cast("long")
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(n, -F.col("event_id"))).alias("event_id"), F.max(n).alias("bytes"))


@query("SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 3 AS chunk FROM orders")
def chunk_ids(spark, d):
    return batching.chunk_ids(table(spark, d, "orders"), ["o_orderkey"], 3, ["o_custkey"]).select("o_orderkey", "chunk")


@query(f"SELECT _key, _class FROM ({_EDGES}) WHERE _type <> 'shop_order_contains_line' UNION ALL SELECT _key, _class FROM ({_EDGES}) WHERE _class = 'HAS'")
def edge_union_all(spark, d):
    r = all_relationships(spark, d)
    return r.where("_type <> 'shop_order_contains_line'").select("_key", "_class").unionByName(r.where("_class = 'HAS'").select("_key", "_class"))


def _mapped(spark, d):
    return build.mapped_relationships(table(spark, d, "supplier"), "IS", source_key=key("supplier", "s_suppkey"), source_type="shop_supplier", target={"_type": F.lit("shop_nation"), "code": F.when(F.col("s_suppkey") % 4 != 0, F.col("s_nationkey").cast("string")).otherwise("none"), "name": F.lit("no such nation")}, filter_keys=[["_type", "name"], ["_type", "code"]], step="fetch-suppliers")


@query("SELECT kind, count(*) AS n FROM (SELECT 'direct' AS kind FROM customer UNION ALL SELECT 'mapped' FROM supplier) GROUP BY 1")
def split_direct_mapped(spark, d):
    both = nation_customers(spark, d).select("_key").unionByName(_mapped(spark, d).select("_key", "_mapping"), allowMissingColumns=True)
    direct, mapped = lookup.split_mapped(both)
    return direct.select(F.lit("direct").alias("kind")).unionAll(mapped.select(F.lit("mapped").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT _type, count(*) AS n FROM ({_OBJECTS}) WHERE NOT (step_id = 'fetch-lines' AND _type = 'shop_order_line') GROUP BY 1")
def indexable_filter(spark, d):
    off = spark.createDataFrame([("fetch-lines", "shop_order_line", False), ("fetch-orders", "shop_order", True)], "step_id string, _type string, indexed boolean")
    return lookup.indexed(all_entities(spark, d), off).groupBy("_type").agg(F.count("*").alias("n"))


# ---- tier 4: mapped relationships, differences ----------------------------------------------------------------------

_CODE = "CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'none' END"
_MKEY = f"'supplier:' || s_suppkey || '|is|FORWARD:_type=shop_nation:name=no such nation:_type=shop_nation:code=' || {_CODE}"


@query(f"SELECT {_MKEY} AS _key, 'shop_supplier_is_nation' AS _type, 'IS' AS _class, 'supplier:' || s_suppkey AS source_key FROM supplier")
def mapped_relationships(spark, d):
    return _mapped(spark, d).select("_key", "_type", "_class", F.col("_mapping.source_key").alias("source_key"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS m FROM customer")
def class_match(spark, d):
    k = F.col("c_custkey") % 4
    none = F.lit(None).cast("array<string>")
    classes = F.when(k == 1, none).otherwise(F.array(F.lit("User"), F.lit("Person")))
    wanted = F.when(k == 0, none).when(k == 3, F.array(F.lit("Host"))).otherwise(F.array(F.lit("Person")))
    return table(spark, d, "customer").select("c_custkey", X.class_match(classes, wanted).alias("m"))


def _resolved(spark, d):
    return lookup.resolve_targets(_mapped(spark, d), nations(spark, d), ["_type", "code", "name"])


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'customer:' || o_custkey WHEN 1 THEN NULL WHEN 2 THEN 'customer:' || o_custkey
 ELSE (SELECT min('customer:' || c_custkey) FROM customer c WHERE c.c_mktsegment = x.c_mktsegment) END AS target_key FROM orders JOIN customer x ON c_custkey = o_custkey""")
def mapped_class_resolution(spark, d):
    """Each order mapped to a customer by name and class: a class that it has, one that it lacks, none; or by its segment, which thousands share."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 4
    cls = F.when(k == 0, "Person").when(k == 1, "Person,Host").when(k == 3, "Person")
    m = build.mapped_relationships(o, "HAS", source_key=key("order", "o_orderkey"), source_type="shop_order", target={"_type": F.lit("shop_customer"), "_class": cls, "name": F.when(k != 3, F.col("c_name")), "segment": F.when(k == 3, F.col("c_mktsegment"))}, filter_keys=[["_type", "_class", "name", "segment"]], properties={"_key": F.col("o_orderkey").cast("string")})
    return lookup.resolve_targets(m, customers(spark, d), ["_type", "name", "segment"]).select(F.col("_key").cast("long").alias("o_orderkey"), "target_key")


@query(f"SELECT {_MKEY} AS _key, CASE WHEN s_suppkey % 4 <> 0 AND s_nationkey IN (SELECT n_nationkey FROM nation) THEN 'nation:' || s_nationkey END AS target_key FROM supplier")
def mapped_target_resolution(spark, d):
    return _resolved(spark, d).select("_key", "target_key")


@query("SELECT 'supplier:' || s_suppkey AS from_key, CASE WHEN s_suppkey % 4 <> 0 THEN 'nation:' || s_nationkey ELSE 'stub' END AS target, s_suppkey % 4 = 0 AS placeholder FROM supplier")
def mapped_edge_resolution(spark, d):
    e = lookup.resolved_edges(_resolved(spark, d))
    return e.select("from_key", F.when(F.col("placeholder"), "stub").otherwise(F.col("to_key")).alias("target"), "placeholder")


@query("SELECT DISTINCT 'supplier:' || s_suppkey AS _key FROM supplier WHERE s_suppkey % 3 <> 0")
def missing_source_entities(spark, d):
    have = suppliers(spark, d).where(F.substring_index("_key", ":", -1).cast("long") % 3 == 0)
    return lookup.missing_sources(_mapped(spark, d), have)


@query("SELECT 'shop_nation' AS _type, 'none' AS code, CAST(count(*) AS BIGINT) AS used FROM supplier WHERE s_suppkey % 4 = 0")
def placeholder_entities(spark, d):
    p = lookup.placeholders(_resolved(spark, d))
    return p.select(F.col("target")["_type"].alias("_type"), F.col("target")["code"].alias("code"), "used")


@query("SELECT c_custkey, count(s_suppkey) AS targets FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1 HAVING count(s_suppkey) <> 1")
def mapped_target_cardinality(spark, d):
    c, sup = table(spark, d, "customer"), table(spark, d, "supplier")
    return lookup.target_counts(c, "c_nationkey", sup, "s_nationkey").select("c_custkey", "targets").where("targets <> 1")


@query("SELECT 'shop_customer_has_order' AS _type, 'to' AS missing, count(*) AS n FROM orders WHERE o_orderstatus = 'F' HAVING count(*) > 0")
def dangling_edges(spark, d):
    have = customers(spark, d).select("_key").unionByName(orders(spark, d).where("state <> 'F'").select("_key"))
    return lookup.dangling_edges(customer_orders(spark, d), have).groupBy("_type", "missing").agg(F.count("*").alias("n"))


@query("SELECT 'order:' || o_orderkey AS _key, CASE WHEN o_orderkey % 5 = 0 THEN 'removed' WHEN o_orderkey % 7 = 0 THEN 'added' WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE 'same' END AS change FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)")
def snapshot_diff_entities(spark, d):
    k = F.substring_index("_key", ":", -1).cast("long")
    o = orders(spark, d)
    return lookup.snapshot_diff(o.where(k % 7 != 0), o.where(k % 5 != 0).withColumn("state", F.when(k % 3 == 0, "X").otherwise(F.col("state"))), ["state", "priority"])


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'same' ELSE 'removed' END AS change, count(*) AS n FROM orders GROUP BY 1")
def snapshot_diff_relationships(spark, d):
    r = customer_orders(spark, d)
    new = r.where(F.substring_index("_toEntityKey", ":", -1).cast("long") % 2 == 0)
    return lookup.snapshot_diff(r, new, ["_fromEntityKey", "_toEntityKey", "_class"]).groupBy("change").agg(F.count("*").alias("n"))


@query("""SELECT 'first' AS job, 'shop_order' AS _type, 'created' AS action, count(*) AS n FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'first', 'shop_supplier', 'created', count(*) FROM supplier
 UNION ALL SELECT 'second', 'shop_order', CASE WHEN o_orderkey % 5 = 0 THEN 'kept_partial' WHEN o_orderkey % 7 = 0 THEN 'created' WHEN o_orderkey % 3 = 0 THEN 'updated' ELSE 'unchanged' END, count(*) FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0) GROUP BY 3
 UNION ALL SELECT 'second', 'shop_supplier', 'deleted', count(*) FROM supplier
 UNION ALL SELECT 'current', 'shop_order', 'there', count(*) FROM orders WHERE NOT (o_orderkey % 5 = 0 AND o_orderkey % 7 = 0)""")
def snapshot_sync(spark, d):
    """Two jobs of one instance, the second with orders as a partial dataset and without suppliers; a third is aborted."""
    from .plans.snapshots import Snapshots

    k = F.substring_index("_key", ":", -1).cast("long")
    o = orders(spark, d).select("_key", "_type", "state", "priority")
    jobs = Snapshots(configure(spark), _scratch(spark, "snapshots"))
    first = jobs.initiate("integration-external", instance="i")
    jobs.upload(first, o.where(k % 7 != 0))
    jobs.upload(first, suppliers(spark, d).select("_key", "_type", F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("priority")))
    done = _written(spark, jobs.actions(first, ["state", "priority"]).withColumn("job", F.lit("first")))
    jobs.finalize(first)
    second = jobs.initiate("integration-external", instance="i")
    jobs.upload(second, o.where(k % 5 != 0).withColumn("state", F.when(k % 3 == 0, "X").otherwise(F.col("state"))))
    again = _written(spark, jobs.actions(second, ["state", "priority"], ["shop_order"]).withColumn("job", F.lit("second")))
    jobs.finalize(second, ["shop_order"])
    third = jobs.initiate("integration-external", instance="i")
    jobs.upload(third, o.limit(1))
    jobs.abort(third, "given up")
    now = jobs.current().select("_key", "_type", F.lit("there").alias("action"), F.lit("current").alias("job"))
    return done.unionByName(again).unionByName(now).groupBy("job", "_type", "action").agg(F.count("*").alias("n"))


@query("""SELECT 'node' AS kind, count(*) AS n FROM customer WHERE c_custkey % 2 = 1
 UNION ALL SELECT 'edge', count(*) FROM orders WHERE o_custkey % 2 = 1 AND o_orderkey % 3 <> 0""")
def wipe_instance(spark, d):
    """Customers of two instances; removing one takes its nodes, its edges and those that touch its nodes."""
    c = customers(spark, d).withColumn("even", F.substring_index("_key", ":", -1).cast("long") % 2 == 0)
    nodes = export.nodes(c.where("even").drop("even"), "a", ["name"]).unionByName(export.nodes(c.where("NOT even").drop("even"), "b", ["name"]))
    r = customer_orders(spark, d)
    third = F.substring_index("_toEntityKey", ":", -1).cast("long") % 3 == 0
    edges = export.edges(r.where(third), "a", ["_class"]).unionByName(export.edges(r.where(~third), "b", ["_class"]))
    n, e = export.wipe_instance(nodes, edges, "a")
    return n.select(F.lit("node").alias("kind")).unionAll(e.select(F.lit("edge").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


# ---- tier 5: steps and metadata --------------------------------------------------------------------------------------


@query(f"{_CLOSURE} SELECT step_id, ancestor FROM reach")
def step_dependency_closure(spark, d):
    return dag.closure(steps(spark))


@query("SELECT * FROM (VALUES ('fetch-nations', 'success'), ('fetch-customers', 'failure'), ('fetch-suppliers', 'disabled'), ('fetch-orders', 'partial_success_due_to_dependency_failure'), ('fetch-lines', 'disabled')) AS t(step_id, status)")
def step_status_propagation(spark, d):
    own = {"fetch-customers": "failure", "fetch-suppliers": "disabled"}
    return dag.final_status(steps(spark), spark.createDataFrame([(s.id, own.get(s.id, "success")) for s in STEPS], "step_id string, outcome string"))


@query(f"SELECT l.step_id, e.dep, CAST(least(count(e.dep) OVER (PARTITION BY l.step_id), 4) AS INTEGER) AS colour FROM {_STEP_LIST} LEFT JOIN {_STEP_DEPS} ON l.step_id = e.step_id")
def step_dependency_edges(spark, d):
    return steps(spark).select("step_id", F.explode_outer("depends_on").alias("dep"), F.least(F.size("depends_on"), F.lit(4)).alias("colour"))


@query(f"SELECT coalesce(graph_id, 'default') AS graph_id, string_agg(step_id, ',' ORDER BY ordinal) AS steps FROM {_STEP_LIST} GROUP BY 1")
def steps_by_graph(spark, d):
    g = steps(spark).groupBy(F.coalesce("graph_id", F.lit(dag.DEFAULT_GRAPH)).alias("graph_id")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "step_id"))).alias("s"))
    return g.select("graph_id", F.array_join(F.transform("s", lambda x: x["step_id"]), ",").alias("steps"))


@query(f"{_CLOSURE} SELECT l.step_id, l.step_id = 'fetch-orders' OR l.step_id IN (SELECT ancestor FROM reach WHERE step_id = 'fetch-orders') AS enabled FROM {_STEP_LIST}")
def step_selection(spark, d):
    return configure(spark).createDataFrame(list(dag.select_steps(STEPS, {"fetch-orders"}).items()), "step_id string, enabled boolean")


@query(f"SELECT 'fetch-orders' AS step_id, 'cached' AS status, count(*) AS n FROM orders UNION ALL SELECT 'fetch-nations', 'success', count(*) FROM nation UNION ALL SELECT 'fetch-customers', 'success', count(*) FROM customer UNION ALL SELECT 'fetch-suppliers', 'success', count(*) FROM supplier UNION ALL SELECT 'fetch-lines', 'success', count(*) FROM lineitem")
def step_cache_load(spark, d):
    """A run that takes one step's rows from the folder of an earlier run instead of running the step."""
    from .sources.files import move

    root = _scratch(spark, "cache")
    orders(spark, d).select(*HEAD).write.parquet(f"{root}/graph/fetch-orders")
    move(spark, f"{root}/graph", f"{root}/cache")
    path = dag.cache_path(spark, f"{root}/cache", STEPS, "fetch-lines", "fetch-orders")
    pipeline = _pipeline(spark, d)
    pipeline.run(spark, cache={"fetch-orders": {"entities": spark.read.parquet(path)}})
    return _results(spark, pipeline)


@query(f"SELECT step_id, coalesce(source = 'sales', false) AS disabled, CASE WHEN source = 'sales' THEN 'USER_CONFIG' END AS reason FROM {_STEP_LIST}")
def ingestion_source_states(spark, d):
    instance = config.local_instance({}, {"DISABLED_INGESTION_SOURCES": "sales, none"})
    states = dag.start_states(STEPS, instance.disabled_sources)
    return configure(spark).createDataFrame([(i, x["disabled"], x["reason"]) for i, x in states.items()], "step_id string, disabled boolean, reason string")


@query(f"SELECT l.source, e.step_id AS child FROM {_STEP_LIST} JOIN {_STEP_DEPS} ON e.dep = l.step_id WHERE l.source IS NOT NULL GROUP BY ALL")
def ingestion_source_children(spark, d):
    return configure(spark).createDataFrame([(k, c) for k, v in dag.source_children(STEPS).items() for c in v], "source string, child string")


@query("SELECT 'permissions' AS kind, string_agg(DISTINCT r_name, ',' ORDER BY r_name) AS items FROM region WHERE r_name <> ''")
def authorization_rollup(spark, d):
    r = table(spark, d, "region").select(F.array("r_name", F.lit(""), "r_name").alias("permissions"))
    return metadata.authorization(r, ["permissions"]).select("kind", F.array_join("items", ",").alias("items"))


@query("SELECT o_orderstatus AS cls, o_orderpriority AS type, min(o_orderkey) AS first_ordinal FROM orders GROUP BY 1, 2")
def graph_schema_distinct(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("cls"), F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("first_ordinal"))
    return lookup.first_by(o, ["cls", "type"], F.col("first_ordinal"))


def _catalogue():
    nation, _ = metadata.entity_metadata("Nation", ["Site"], "shop_nation")
    customer, _ = metadata.entity_metadata("Customer", ["Person"], "shop_customer")
    order, _ = metadata.entity_metadata("Order", ["Record"], "shop_order")
    supplier, _ = metadata.entity_metadata("Supplier", ["Vendor", "Person"], "shop_supplier")
    rel = metadata.RelationshipMeta
    has = rel("shop_nation_has_customer", "HAS", "shop_nation", "shop_customer")
    declared = [("fetch-suppliers", [supplier, rel("shop_supplier_is_nation", "IS", "shop_supplier", "shop_nation", "REVERSE"), rel("shop_supplier_is_company", "IS", "shop_supplier", "company", "FORWARD")]), ("fetch-orders", [order, rel("shop_customer_has_order", "HAS", "shop_customer", "shop_order"), has]), ("fetch-customers", [customer, has]), ("fetch-nations", [nation])]
    return metadata.catalogue(declared, dag.check_steps(STEPS))


@query("""SELECT * FROM (VALUES (0, 'entity', 'shop_customer', 'Person'), (1, 'entity', 'shop_nation', 'Site'), (2, 'entity', 'shop_order', 'Record'), (3, 'entity', 'shop_supplier', 'Vendor+Person'),
 (4, 'relationship', 'shop_customer|HAS|shop_order', ''), (5, 'relationship', 'shop_nation|HAS|shop_customer', ''), (6, 'mapped', 'shop_supplier|IS|company', 'FORWARD'), (7, 'mapped', 'shop_supplier|IS|shop_nation', 'REVERSE')) AS t(position, kind, what, detail)""")
def metadata_catalog(spark, d):
    c = _catalogue()
    rows = [("entity", e.type, "+".join(e.classes)) for e in c.entities] + [("relationship", f"{r.source}|{r.cls}|{r.target}", "") for r in c.relationships] + [("mapped", f"{r.source}|{r.cls}|{r.target}", r.direction) for r in c.mapped]
    return configure(spark).createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, kind string, what string, detail string")


@query("""SELECT * FROM (VALUES ('### Entities', 4), ('### Mapped Relationships', 2), ('### Relationships', 2)) AS t(section, rows)""")
def metadata_document(spark, d):
    """Sections of the catalogue's document, put between markers, and their rows."""
    text = metadata.put_section("# About\n<!-- a -->\nold\n<!-- b -->\nend", metadata.document(_catalogue()), "<!-- a -->", "<!-- b -->")
    rows = [(x.split("\n")[0], sum(y.startswith("| ") for y in x.split("\n")) - 2) for x in text.split("\n\n### ")[1:]]
    return configure(spark).createDataFrame([(f"### {a}", n) for a, n in rows if "old" not in text and text.endswith("end")], "section string, rows int")




@query("""SELECT * FROM (VALUES ('node', 'company', 'placeholder', ''), ('node', 'shop_nation', 'entity', ''), ('node', 'shop_supplier', 'entity', ''), ('edge', 'shop_supplier', 'company', 'IS*'), ('edge', 'shop_nation', 'shop_supplier', 'IS*'), ('edge', 'shop_nation', 'shop_customer', 'HAS')) AS t(kind, a, b, label)""")
def type_graph(spark, d):
    n, e = metadata.type_graph(configure(spark), _catalogue(), ["shop_nation", "shop_supplier"])
    nodes = n.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("kind").alias("b"), F.lit("").alias("label"))
    return nodes.unionByName(e.select(F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.concat("label", F.when(F.col("mapped"), "*").otherwise("")).alias("label")))


@query("SELECT * FROM (VALUES ('fetch-orders', 'shop_order_old', 'only_in_spec'), ('fetch-orders', 'shop_order', 'only_in_code')) AS t(step_id, _type, side)")
def spec_conformance(spark, d):
    code = declared(spark)
    return metadata.conformance(code.withColumn("_type", F.when(F.col("_type") == "shop_order", "shop_order_old").otherwise(F.col("_type"))), code)


@query(f"""WITH o AS (SELECT DISTINCT step_id, _type FROM ({_OBJECTS} UNION ALL SELECT _key, _type, step_id FROM ({_EDGES})))
SELECT coalesce(o.step_id, s.step_id) AS step_id, coalesce(o._type, s._type) AS _type, CASE WHEN o._type IS NULL THEN 'not_produced' ELSE 'undeclared' END AS problem FROM o FULL JOIN {_STEP_TYPES} ON o.step_id = s.step_id AND o._type = s._type WHERE o._type IS NULL OR s._type IS NULL""")
def step_conformance(spark, d):
    return metadata.undeclared(all_entities(spark, d).unionByName(all_relationships(spark, d).select(*HEAD)), declared(spark))


@query("SELECT 'customer:' || c_custkey AS _key, p AS property, 'required' AS validation FROM customer, (VALUES ('firstName'), ('lastName')) AS r(p)")
def schema_conformance(spark, d):
    return validate.conformance(customers(spark, d), ["Person"])


@query("""SELECT p_partkey, unnest(CASE p_partkey % 5 WHEN 0 THEN ['#shop_host platform enum', '#shop_host vendor type'] WHEN 1 THEN ['#Host ipAddress format', '#Host platform enum', '#Host vendor type'] WHEN 2 THEN [' _type required'] WHEN 3 THEN [' _class required'] ELSE [''] END) AS error,
 CASE p_partkey % 5 WHEN 0 THEN '#Host type-already-validated' WHEN 1 THEN '#plain not-found' WHEN 4 THEN '#plain not-found|#Nothing not-found' ELSE '' END AS skipped FROM part""")
def entity_validation(spark, d):
    """Entities of a type with a schema of its own, of a class alone, without type, without class, and of an unknown class."""
    k = F.col("p_partkey") % 5
    e = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("_key"), F.when(k == 0, "shop_host").when(k != 2, "plain").alias("_type"), F.when(k == 4, F.array(F.lit("Nothing"))).when(k != 3, F.array(F.lit("Host"))).alias("_class"), F.col("p_name").alias("name"), F.col("p_name").alias("displayName"), F.lit("beos").alias("platform"), F.when(k == 1, "10.0.0.999").otherwise("10.0.0.1").alias("ipAddress"), F.lit(1).alias("vendor"))
    v = validate.validate_entities(e, _hosts(), types={"shop_host": (["Host"], {"vendor": registry.Property()})})
    shown = lambda c, *f: F.transform(c, lambda x: F.concat_ws(" ", *[F.coalesce(x[n], F.lit("")) for n in f]))
    errors = F.when(F.col("valid"), F.array(F.lit(""))).otherwise(shown(F.col("errors"), "schema", "property", "validation"))
    return v.select(F.col("_key").cast("long").alias("p_partkey"), F.explode(errors).alias("error"), F.array_join(shown(F.col("skipped"), "schema", "reason"), "|").alias("skipped"))


def _hosts():
    known = registry.default_registry()
    host = known.get("Host")
    return registry.Registry([*known.schemas.values(), registry.ClassSchema("Host", host.parents, {**host.properties, "vendor": registry.Property()}, host.required)])


@query("""WITH q AS (SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 10 = 0 THEN 'q' || (p_partkey - 1) ELSE 'q' || p_partkey END AS id, CASE WHEN p_partkey % 15 = 0 THEN 'Same title' ELSE 'Title ' || p_partkey END AS title FROM part WHERE p_partkey > 0)
SELECT 'id' AS "check", id, id AS value FROM q WHERE ordinal % 10 = 0
 UNION ALL SELECT 'title', id, title FROM q WHERE title = 'Same title' AND ordinal > 15
 UNION ALL SELECT 'tag', id, 'red' FROM q WHERE ordinal % 4 = 0
 UNION ALL SELECT 'query_name', id, 'good' FROM q WHERE ordinal % 6 = 0""")
def question_pack_uniqueness(spark, d):
    """A pack of questions, one for each part, written as documents, loaded, and checked for ids, titles, tags and names of queries that repeat."""
    from .sources import questions

    k = F.col("p_partkey").cast("long")
    ask = lambda query, name=F.lit(None): F.struct(name.cast("string").alias("name"), F.lit(query).alias("query"))
    tags = F.concat(F.array(F.lit("red"), F.lit("blue")), F.when(k % 4 == 0, F.array(F.lit("red"))).otherwise(F.array().cast("array<string>")))
    asked = F.array(ask("FIND a", F.lit("good")), ask("FIND b"), ask("FIND c", F.when(k % 6 == 0, "good").otherwise("bad")))
    pack = table(spark, d, "part").where(k > 0).select(k.alias("ordinal"), F.concat(F.lit("q"), F.when(k % 10 == 0, k - 1).otherwise(k)).alias("id"), F.when(k % 15 == 0, "Same title").otherwise(F.concat(F.lit("Title "), k)).alias("title"), F.lit("").alias("description"), asked.alias("queries"), tags.alias("tags"))
    path = _scratch(spark, "questions")
    questions.write(pack, path)
    return questions.problems(questions.load(spark, path))


def _pipeline(spark, d):
    configure(spark)
    make = {"fetch-nations": nations, "fetch-customers": customers, "fetch-suppliers": suppliers, "fetch-orders": orders, "fetch-lines": lines}
    bound = [dag.StepSpec(s.id, types=s.types, depends_on=s.depends_on, graph_id=s.graph_id, run=lambda sp, ctx, out, f=make[s.id]: {"entities": f(sp, d)}) for s in STEPS]
    return dag.Pipeline(bound, graph_order=("details",), before=lambda df: df.select(*HEAD))


def _results(spark, pipeline):
    rows = [(r.id, r.status, n) for r in pipeline.results.values() for n in r.counts.values()]
    return spark.createDataFrame(rows, "step_id string, status string, n long")


@query(f"SELECT step_id, 'success' AS status, count(*) AS n FROM ({_OBJECTS}) GROUP BY 1")
def step_results(spark, d):
    pipeline = _pipeline(spark, d)
    pipeline.run(spark)
    return _results(spark, pipeline)


@query(f"SELECT row_number() OVER (ORDER BY ordinal, name DESC) - 1 AS position, 'job-1' AS job, name, CASE name WHEN 'step_start' THEN 'Starting step ' || step_id ELSE 'Completed step ' || step_id || ': success' END AS description FROM {_STEP_LIST}, (VALUES ('step_start'), ('step_end')) AS e(name)")
def step_events(spark, d):
    """Events of the steps, published through a queue whose service fails once; a queue without a job publishes nothing."""
    sent = []
    queue, idle = events.EventQueue(sent.append, "job-1"), events.EventQueue(lambda e: sent.append({"name": "never", "description": ""}))
    for s in STEPS:
        events.StepLog(queue).step_start(s.id)
        events.StepLog(idle).step_start(s.id)
        events.StepLog(queue).step_end(s.id, dag.SUCCESS)
    queue.on_idle()
    return configure(spark).createDataFrame([(i, queue.job, e["name"], e["description"]) for i, e in enumerate(sent)], "position long, job string, name string, description string")


@query("SELECT p_partkey, unnest(['region', 'apiKey', 'other']) AS name, unnest([p_brand, '***', '***']) AS shown FROM part")
def mask_config(spark, d):
    fields = {"region": config.Field(), "apiKey": config.Field(mask=True)}
    p = table(spark, d, "part").select("p_partkey", "p_brand", F.explode(F.array(*map(F.lit, ("region", "apiKey", "other")))).alias("name"))
    return p.select("p_partkey", "name", events.shown_column(fields, F.col("name"), F.col("p_brand")).alias("shown"))


@query("SELECT 'customer:' || c_custkey AS _key, upper(c_name) AS name FROM customer")
def before_add_hook(spark, d):
    step = dag.StepSpec("fetch-customers", run=lambda sp, ctx, out: {"entities": customers(sp, d)})
    frames, _ = dag.Pipeline([step], before=lambda df: df.withColumn("name", F.upper("name"))).run(spark)
    return frames["fetch-customers"]["entities"].select("_key", "name")


@query("""SELECT 'entities' AS collection, 'supplier-' || s_suppkey AS _key, 'shop_supplier' AS _type, s_name || '|shop' AS detail FROM supplier
 UNION ALL SELECT 'parent', 'nation:' || s_nationkey || '|has|supplier-' || s_suppkey, 'shop_nation_has_supplier', 'HAS' FROM supplier
 UNION ALL SELECT 'direct0', 'supplier-' || s_suppkey || '|uses|' || s_nationkey, 'shop_supplier_uses_code', 'USES' FROM supplier WHERE false
 UNION ALL SELECT 'mapped0', 'supplier-' || s_suppkey || '|is|FORWARD:code=' || s_nationkey || ':country=here', 'shop_supplier_is_mapped_entity', 'IS' FROM supplier""")
def declarative_step(spark, d):
    """A template of one step, compiled and run: entities by key path, mapped and static fields, the parent's edges and mapped ones."""
    template = {"steps": [{"id": "fetch-suppliers", "entity": {"_type": "shop_supplier", "_class": "Vendor", "_keyPath": "body.id", "fieldMappings": {"name": "body.label"}, "staticFields": {"category": "shop"}}, "parentAssociation": {"parentEntityType": "shop_nation", "relationshipClass": "HAS"}, "response": {"responseType": "LIST"}, "mappedRelationships": [{"_class": "IS", "direction": "FORWARD", "mappings": [{"sourceProperty": "body.nation", "targetProperty": "code"}, {"targetValue": "here", "targetProperty": "country"}]}]}]}
    body = F.struct(F.concat(F.lit("supplier-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("nation")).alias("body")
    (step,) = declarative.compile_template(template, lambda spec, made: table(spark, d, "supplier").select(body, key("nation", "s_nationkey").alias("_parent_key")))
    made, _ = dag.Pipeline([step]).run(spark)
    out = made["fetch-suppliers"]
    rows = out["entities"].select(F.lit("entities").alias("collection"), "_key", "_type", F.concat_ws("|", "name", "category").alias("detail"))
    for name in ("parent", "mapped0"):
        rows = rows.unionByName(out[name].select(F.lit(name).alias("collection"), "_key", "_type", F.col("_class").alias("detail")))
    return rows


# ---- tier 6: batches, exports ---------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE r AS (SELECT o_custkey % 50 AS g, o_orderkey, CAST({_SIZE} AS BIGINT) AS s, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS i FROM orders),
 p(g, i, o_orderkey, filled, batch) AS (SELECT g, i, o_orderkey, s, CAST(0 AS BIGINT) FROM r WHERE i = 1
 UNION ALL SELECT r.g, r.i, r.o_orderkey, CASE WHEN p.filled + r.s >= 1000 THEN r.s ELSE p.filled + r.s END, CASE WHEN p.filled + r.s >= 1000 THEN p.batch + 1 ELSE p.batch END FROM p JOIN r ON r.g = p.g AND r.i = p.i + 1)
SELECT g, o_orderkey, batch FROM p""")
def upload_batches(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("g"), "o_orderkey", C.object_size("o_orderkey", "o_orderstatus", "o_orderpriority").alias("bytes"))
    return batching.pack_batches(o, group=["g"], order="o_orderkey", size="bytes", limit=1000).select("g", "o_orderkey", "batch")


@query("SELECT 'customer:' || c_custkey AS id, c_name || chr(10) || '[shop_customer]' AS label, 'entity' AS kind FROM customer UNION ALL SELECT 'order:' || o_orderkey, '[missing]', 'missing' FROM orders WHERE o_orderstatus = 'F'")
def viz_nodes(spark, d):
    nodes = customers(spark, d).select(F.col("_key").alias("id"), F.concat_ws("\n", "name", F.lit("[shop_customer]")).alias("label"), F.lit("entity").alias("kind"))
    have = customers(spark, d).select("_key").unionByName(orders(spark, d).where("state <> 'F'").select("_key"))
    gone = lookup.dangling_edges(customer_orders(spark, d), have).where("missing = 'to'").select(F.col("_toEntityKey").alias("id")).distinct()
    return nodes.unionByName(gone.select("id", F.lit("[missing]").alias("label"), F.lit("missing").alias("kind")))


@query(f"SELECT _fromEntityKey AS source, _toEntityKey AS target, _class AS label FROM ({_EDGES}) WHERE _class = 'HAS' UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'IS' FROM supplier WHERE s_suppkey % 4 <> 0")
def viz_edges(spark, d):
    direct = all_relationships(spark, d).where("_class = 'HAS'").select(F.col("_fromEntityKey").alias("source"), F.col("_toEntityKey").alias("target"), F.col("_class").alias("label"))
    mapped = lookup.resolved_edges(_resolved(spark, d)).where("NOT placeholder").select(F.col("from_key").alias("source"), F.col("to_key").alias("target"), F.lit("IS").alias("label"))
    return direct.unionByName(mapped)


@query("""SELECT 'customer:' || c_custkey AS _key, ':shop_customer:Person' AS labels, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN 'new' END AS extra FROM customer""")
def graph_nodes_export(spark, d):
    """Customers as nodes; a second export of some of them is merged over the first, property by property."""
    c = customers(spark, d)
    again = c.where(F.substring_index("_key", ":", -1).cast("long") % 3 == 0).select("_key", "_type", "_class", F.upper("name").alias("name"), F.lit("new").alias("extra field"))
    n = export.upsert(export.nodes(c, "i", ["name", "segment"]), export.nodes(again, "i", ["name", "extra field"]))
    return n.select("_key", "labels", F.col("properties")["name"].alias("name"), F.col("properties")["segment"].alias("segment"), F.try_element_at("properties", F.lit("extra_field")).alias("extra"))


@query(f"""SELECT _fromEntityKey AS start_key, _toEntityKey AS end_key, ':' || _class AS label, '' AS end_label FROM ({_EDGES})
 UNION ALL SELECT 'supplier:' || s_suppkey, '|is|FORWARD:_type=shop_nation:name=no such nation:_type=shop_nation:code=' || {_CODE}, ':IS', ':shop_nation' FROM supplier
 UNION ALL SELECT 'target', '|is|FORWARD:_type=shop_nation:name=no such nation:_type=shop_nation:code=' || {_CODE}, 'node', ':shop_nation' FROM supplier GROUP BY 2""")
def graph_edges_export(spark, d):
    """Direct and mapped relationships as edges, and the target nodes that mapped ones create."""
    direct = export.edges(all_relationships(spark, d), "i", ["_class"])
    mapped = export.edges(_mapped(spark, d), "i", ["_class"])
    made = export.created_targets(_mapped(spark, d), "i").select(F.lit("target").alias("start_key"), F.col("_key").alias("end_key"), F.lit("node").alias("label"), F.col("labels").alias("end_label"))
    return direct.unionByName(mapped).select("start_key", "end_key", "label", "end_label").unionByName(made)


@query(f"WITH l AS ({_LINES}) SELECT _key, arg_max(part, (part, supplier, cents)) AS part FROM l GROUP BY 1")
def latest_line(spark, d):
    return lookup.latest_wins(lines(spark, d).select("_key", "part", "supplier", "cents"), ["_key"], ["part", "supplier", "cents"]).select("_key", "part")


def _written(spark, df):
    """A frame as it is now, as a table of its own."""
    path = _scratch(spark, "now")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _scratch(spark, name):
    """A folder in the shared checkpoint folder; it goes when the application ends."""
    import uuid

    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_graphloom_scratch"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


_folders: list = []


@atexit.register
def _clear():
    from .sources.files import remove_storage

    for spark, path in _folders:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # the JVM may be gone at interpreter exit
                remove_storage(spark, path)


@query(f"SELECT _type, count(*) AS n FROM ({_OBJECTS}) GROUP BY 1")
def export_by_type(spark, d):
    path = _scratch(spark, "export")
    all_entities(spark, d).write.partitionBy("_type").json(path)
    return spark.read.schema("_key string, step_id string, _type string").json(path).groupBy("_type").agg(F.count("*").alias("n"))


@query("SELECT 'customer:' || c_custkey AS _key, c_name AS name, c_mktsegment AS segment FROM customer")
def csv_roundtrip(spark, d):
    from .sources import store

    path = _scratch(spark, "csv")
    store.write_csv(customers(spark, d).select("_key", "_type", "name", "segment"), path)
    return store.read_csv(spark, path, "_key string, name string, segment string, _type string").select("_key", "name", "segment")


@query("SELECT _key FROM (SELECT 'supplier:' || s_suppkey AS _key FROM supplier)")
def partitioned_write(spark, d):
    from .sources import store

    s = store.ParquetStore(spark, _scratch(spark, "store"))
    s.write(all_entities(spark, d))
    return s.by_type("shop_supplier").select("_key")


@query("SELECT 'customer:' || c_custkey AS _key, c_name AS name FROM customer")
def scan_graph_entities(spark, d):
    from .sources import store

    path = _scratch(spark, "graph")
    store.write_collection(customers(spark, d).select("_key", "_type", "name"), path)
    return store.read_collection(spark, path, "_key string, _type string, name string").select("_key", "name")


@query("SELECT 'nation:' || c_nationkey || '|has|customer:' || c_custkey AS _key FROM customer")
def scan_graph_relationships(spark, d):
    from .sources import store

    path = _scratch(spark, "graph")
    store.write_collection(nation_customers(spark, d).select("_key", "_type"), path, "relationships")
    return store.read_collection(spark, path, "_key string, _type string", "relationships").select("_key")


# ---- without SQL ------------------------------------------------------------------------------------------------------


@query()
def shrink_raw_data(spark, d):
    """Batches of 20 events after shrinking to 2,000 bytes; those of more bytes could not shrink further and have no upload."""
    e = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 20).cast("long").alias("batch"), F.to_json(F.struct(F.col("event_id").cast("string").alias("_key"), F.array(F.struct(F.lit("default").alias("name"), F.struct(F.col("props").alias("props"), F.col("event_type").alias("kind")).alias("rawData"))).alias("_rawData"))).alias("payload"))
    return batching.shrink_batches(e, "batch", "payload", 2000, order="event_id").select("batch", "rows", "bytes", "truncated")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_upload(spark, d):
    from .streaming import upload

    out, src = _scratch(spark, "uploaded"), _scratch(spark, "source")
    e = table(spark, d, "events").select("event_id", "event_type")
    e.repartition(4).write.parquet(src)
    upload.upload_stream(upload.read_table_stream(spark, src, e.schema), lambda df, n: df.write.mode("append").parquet(out), out + "-checkpoint")
    return spark.read.schema(e.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT event_id FROM events")
def stream_dedup(spark, d):
    from .streaming import upload

    out, src = _scratch(spark, "deduped"), _scratch(spark, "source")
    e = table(spark, d, "events").select("event_id", "ts")
    e.unionAll(e.where("event_id % 10 = 0")).write.parquet(src)
    q = upload.distinct_keys(upload.read_table_stream(spark, src, e.schema, 100), "event_id", "ts", "3650 days")
    q.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id")


@query("SELECT c_custkey, c_name FROM customer")
def paginated_source(spark, d):
    """Customers laid out as chains of JSON pages and read back page by page."""
    from .sources.paginated import PagesSource

    spark.dataSource.register(PagesSource)
    path, chains, size = _scratch(spark, "pages"), 4, 50
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.pmod("c_custkey", F.lit(chains)).alias("chain"))
    c = batching.chunk_ids(c, ["c_custkey"], size, ["chain"]).withColumnRenamed("chunk", "page")
    last = c.groupBy("chain").agg(F.max("page").alias("last"))
    name = lambda page: F.concat(F.col("chain").cast("string"), F.lit("-"), page.cast("string"), F.lit(".json"))
    pages = c.groupBy("chain", "page").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("items")).join(last, "chain")
    pages = pages.select(name(F.col("page")).alias("name"), F.to_json(F.struct("items", F.when(F.col("page") < F.col("last"), name(F.col("page") + 1)).alias("next"))).alias("body"))
    root = path if "://" in path else f"file://{path.removeprefix('file:')}"

    def put(batches):
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(root)
        store.create_dir(folder, recursive=True)
        for pdf in batches:
            for page, body in zip(pdf["name"], pdf["body"], strict=True):
                with store.open_output_stream(f"{folder}/{page}") as f:
                    f.write(body.encode())
            yield pdf[["name"]]

    pages.mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()
    rows = spark.read.format("pages").option("path", root).option("starts", ",".join(f"{i}-0.json" for i in range(chains))).load()
    item = F.from_json("item", "c_custkey long, c_name string").alias("x")
    return rows.select(item).select("x.c_custkey", "x.c_name")