"""Registered queries of the typed XML engine over the driver's tables, each with DuckDB SQL for the same rows.

Documents are written from the tables by the encoder and read back by the decoder, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marlstone.functions import text
from marlstone.functions.codecs import Codecs, as_is, decimal_reader
from marlstone.operators.decode import OPTIONS, decode, explode_items, items_are
from marlstone.operators.encode import encode, encoded, estimated, utf8
from marlstone.plans import wire
from marlstone.plans.model import Enum, Many, Member, Model, Ref
from marlstone.sources.xmlio import session

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

STATUS = Enum("Status", ("F", "O", "P"))
ORDER = Model().subject("Order", ("OrderKey", "long"), ("CustKey", "long"), ("OrderDate", "dateTime"), ("Status", STATUS), ("Priority", "string"), root=True)
NATION = Model().subject("Region", ("RegionKey", "int"), ("Name", "string"), root=True).subject("Nation", ("NationKey", "int"), ("Name", "string"), ("Region", Ref("Region")), root=True)
NAMES = Model().subject("Names", ("RegionKey", "int"), ("Members", Many("string")), root=True)
BASKET = Model(Codecs(readers={"decimal": decimal_reader(18, 2)})).subject("Line", ("Number", "int"), ("PartKey", "long"), ("Price", "decimal"), ("Returned", "boolean")).subject("Basket", ("OrderKey", "long"), ("Lines", Many(Ref("Line"))), root=True)
PARTY = (
    Model()
    .subject("Party", ("Key", "long"), ("Name", "string"), abstract=True)
    .subject("Client", ("Segment", "string"), base="Party")
    .subject("Vendor", ("Rank", "int?"), base="Party")
    .subject("Directory", ("NationKey", "int"), ("Parties", Many(Ref("Party"))), root=True)
    .subject("Holder", ("Id", "long"), ("Party", Ref("Party")), root=True)
    .derive("Party", "Client")
    .derive("Party", "Vendor")
)
KIND = Enum("Kind", ("click", "view", "purchase", "error", "signup", "login", "logout", "search", "scroll", "refund", "cart", "add_to_cart", "share"))
TEXT = Model().subject("Doc", ("Id", "long"), ("Text", "string"), root=True)
GRADE = Model().subject("Grade", ("Id", "long"), ("Quality", "int?"), ("Lang", "string"), root=True)
INTS = Model().subject("Ints", ("Tiny", "byte"), ("UTiny", "unsignedByte"), ("Short", "short"), ("UShort", "unsignedShort"), ("Int", "int"), ("UInt", "unsignedInt"), ("Long", "long"), ("ULong", "unsignedLong"), root=True)


def query(name: str, sql: str):
    def put(f):
        def run(spark, sf_dir):
            own = session(spark)
            own.conf.set("spark.sql.execution.replaceHashWithSortAgg", "true")  # where rows are sorted by their group already
            return f(lambda t: own.read.parquet(f"{sf_dir}/{t}.parquet"))

        _QUERIES[name], _SQL[name] = run, sql
        return f

    return put


def order_struct(status="o_orderstatus"):
    return F.struct(F.col("o_orderkey").alias("OrderKey"), F.col("o_custkey").alias("CustKey"), F.col("o_orderdate").alias("OrderDate"), F.col(status).alias("Status"), F.col("o_orderpriority").alias("Priority"))


def order_xml(t) -> DataFrame:
    return t("orders").select(encoded(order_struct(), ORDER, "Order").alias("xml"))


def order_columns(df: DataFrame) -> DataFrame:
    d = F.col("decoded")
    return df.select(d.OrderKey.alias("order_key"), d.CustKey.alias("cust_key"), d.OrderDate.cast("timestamp_ntz").alias("order_date"), d.Status.alias("status"), d.Priority.alias("priority"))


ORDER_SQL = "SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderdate AS order_date, o_orderstatus AS status, o_orderpriority AS priority FROM orders"
ORDER_TEXT = "'<Order><OrderKey>' || o_orderkey || '</OrderKey><CustKey>' || o_custkey || '</CustKey><OrderDate>' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '0</OrderDate><Status>' || o_orderstatus || '</Status><Priority>' || o_orderpriority || '</Priority></Order>'"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = session(spark)
    docs = order_xml(lambda t: own.read.parquet(f"{sf_dir}/{t}.parquet"))
    return decode(docs, "xml", ORDER, "Order", paths=["Status"]).groupBy(F.col("decoded.Status").alias("status")).agg(F.count("*").alias("n"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- documents, in and out


@query("decode_document", ORDER_SQL)
def _(t):
    return order_columns(decode(order_xml(t), "xml", ORDER, "Order"))


@query("decode_grouped", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return decode(order_xml(t), "xml", ORDER, "Order", paths=["Status"]).groupBy(F.col("decoded.Status").alias("status")).agg(F.count("*").alias("n"))


@query("encode_document", f"SELECT o_orderkey AS order_key, {ORDER_TEXT} AS xml FROM orders")
def _(t):
    return t("orders").select(F.col("o_orderkey").alias("order_key"), encoded(order_struct(), ORDER, "Order").alias("xml"))


@query("encode_head", f"SELECT o_orderkey AS order_key, '{text.PROLOG}' || {ORDER_TEXT} AS xml FROM orders")
def _(t):
    return t("orders").select(F.col("o_orderkey").alias("order_key"), encoded(order_struct(), ORDER, "Order", prolog=True).alias("xml"))


@query("decode_pruned", "SELECT o_orderkey AS order_key FROM orders")
def _(t):
    return decode(order_xml(t), "xml", ORDER, "Order", paths=["OrderKey"]).select(F.col("decoded.OrderKey").alias("order_key"))


@query("decode_prolog", ORDER_SQL)
def _(t):
    docs = order_xml(t).select(F.concat(F.lit(text.PROLOG + "\n<!-- a --> <!-- b -->\n "), "xml", F.lit("\n<!-- end -->")).alias("xml"))
    return order_columns(decode(docs, "xml", ORDER, "Order"))


@query("decode_comments", ORDER_SQL)
def _(t):
    docs = order_xml(t).select(F.regexp_replace("xml", "><", "> <!-- c <x/> --> <!-- d --> <").alias("xml"))
    return order_columns(decode(docs, "xml", ORDER, "Order"))


@query("decode_unknown", ORDER_SQL)
def _(t):
    docs = order_xml(t).select(F.replace("xml", F.lit("<CustKey>"), F.lit("<Other><Deep>1</Deep></Other><custkey>x</custkey><CustKey>")).alias("xml"))
    return order_columns(decode(docs, "xml", ORDER, "Order"))


@query("decode_ignore", "SELECT o_orderkey AS order_key, 0 AS n_hidden FROM orders")
def _(t):
    m = Model().subject("Order", ("OrderKey", "long"), Member("CustKey", "long", ignored=True), root=True)
    got = decode(order_xml(t), "xml", m, "Order")
    hidden = sum(f.name == "CustKey" for f in got.schema["decoded"].dataType.fields)
    return got.select(F.col("decoded.OrderKey").alias("order_key"), F.lit(hidden).alias("n_hidden"))


@query("xsi_type_root", "SELECT o_orderkey AS order_key, 'Order' AS kind FROM orders")
def _(t):
    head = F.lit(f'<object xmlns:p3="{text.XSI}" p3:type="Order">')
    docs = order_xml(t).select(F.concat(head, F.expr("substring(xml, 8, length(xml) - 15)"), F.lit("</object>")).alias("xml"))
    return decode(docs, "xml", ORDER, "Order").select(F.col("decoded.OrderKey").alias("order_key"), text.xsi_type(F.col("xml")).alias("kind"))


@query("decode_last_wins", "SELECT o_orderkey AS order_key, o_custkey AS cust_key FROM orders")
def _(t):
    docs = order_xml(t).select(F.replace("xml", F.lit("<CustKey>"), F.lit("<CustKey>-1</CustKey><CustKey>")).alias("xml"))
    return decode(docs, "xml", ORDER, "Order").select(F.col("decoded.OrderKey").alias("order_key"), F.col("decoded.CustKey").alias("cust_key"))


# -- fragments


@query("root_name", "SELECT o_orderkey AS order_key, 'Order' AS name FROM orders")
def _(t):
    xml = encoded(order_struct(), ORDER, "Order", prolog=True)
    return t("orders").select(F.col("o_orderkey").alias("order_key"), text.root_name(xml).alias("name"))


@query("cut_head", f"SELECT o_orderkey AS order_key, {ORDER_TEXT} AS body FROM orders")
def _(t):
    xml = F.concat(F.lit(" " + text.PROLOG + "\n<!-- one --> <!-- two -->\n"), encoded(order_struct(), ORDER, "Order"), F.lit(" \n"))
    return t("orders").select(F.col("o_orderkey").alias("order_key"), text.cut_head(xml).alias("body"))


@query("first_child", "SELECT o_orderkey AS order_key, 'OrderKey' AS name, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def _(t):
    c = text.first_child(encoded(order_struct(), ORDER, "Order"))
    return t("orders").select(F.col("o_orderkey").alias("order_key"), c.alias("c")).select("order_key", F.col("c.name").alias("name"), F.col("c.text").alias("value"))


@query("inner_body", f"SELECT o_orderkey AS order_key, substring({ORDER_TEXT}, 8, length({ORDER_TEXT}) - 15) AS body FROM orders")
def _(t):
    return t("orders").select(F.col("o_orderkey").alias("order_key"), text.inner(encoded(order_struct(), ORDER, "Order")).alias("body"))


@query("has_comment", "SELECT page_id, contains(html, '<!--') AS found FROM pages")
def _(t):
    return t("pages").select("page_id", text.has_comment(F.col("html")).alias("found"))


@query("has_cdata", "SELECT page_id, contains(html, '<![CDATA[') AS found FROM pages")
def _(t):
    return t("pages").select("page_id", text.has_cdata(F.col("html")).alias("found"))


@query("leading_comment_len", "SELECT doc_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 14 + 2 + 7 + length(lang) ELSE 0 END AS INTEGER) AS n FROM documents")
def _(t):
    x = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<!-- first --> "), F.lit(" <!--"), "lang", F.lit("--><a>1</a><!-- no -->"))).otherwise(F.lit("<a><!-- x --></a>"))
    return t("documents").select("doc_id", text.leading_comment_length(x).alias("n"))


@query("attributes", "SELECT n_nationkey AS nation_key, 'p' AS prefix, 'id' AS name, CAST(n_regionkey AS VARCHAR) AS value, 'q' AS xsi_prefix, 2 AS n FROM nation")
def _(t):
    x = F.concat(F.lit(f'<Nation xmlns:q="{text.XSI}" p:id="'), "n_regionkey", F.lit('"><A x="1"/></Nation>'))
    found = text.find_attribute(x, name="id")
    return t("nation").select(F.col("n_nationkey").alias("nation_key"), found["prefix"].alias("prefix"), found["name"].alias("name"), found["value"].alias("value"), text.xsi_prefix(x).alias("xsi_prefix"), F.size(text.attributes(x)).alias("n"))


# -- nested records, lists, polymorphism


@query("decode_nested", "SELECT n_nationkey AS nation_key, n_name AS name, r_regionkey AS region_key, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.select(F.struct(F.col("n_nationkey").alias("NationKey"), F.col("n_name").alias("Name"), F.struct(F.col("r_regionkey").alias("RegionKey"), F.col("r_name").alias("Name")).alias("Region")).alias("v"))
    d = F.col("decoded")
    return decode(encode(n, "v", NATION, "Nation"), "xml", NATION, "Nation").select(d.NationKey.alias("nation_key"), d.Name.alias("name"), d.Region.RegionKey.alias("region_key"), d.Region.Name.alias("region"))


@query("encode_nested", "SELECT n_nationkey AS nation_key, '<Nation><NationKey>' || n_nationkey || '</NationKey><Name>' || n_name || '</Name><Region><RegionKey>' || r_regionkey || '</RegionKey><Name>' || r_name || '</Name></Region></Nation>' AS xml FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    v = F.struct(F.col("n_nationkey").alias("NationKey"), F.col("n_name").alias("Name"), F.struct(F.col("r_regionkey").alias("RegionKey"), F.col("r_name").alias("Name")).alias("Region"))
    return n.select(F.col("n_nationkey").alias("nation_key"), encoded(v, NATION, "Nation").alias("xml"))


def names(t) -> DataFrame:
    g = t("nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("m"))
    return g.select(F.col("n_regionkey").alias("region_key"), F.struct(F.col("n_regionkey").alias("RegionKey"), F.col("m").alias("Members")).alias("v"))


@query("encode_list", "SELECT n_regionkey AS region_key, '<Names><RegionKey>' || n_regionkey || '</RegionKey><Members>' || string_agg('<string>' || n_name || '</string>', '' ORDER BY n_name) || '</Members></Names>' AS xml FROM nation GROUP BY n_regionkey")
def _(t):
    return encode(names(t), "v", NAMES, "Names").select("region_key", "xml")


@query("decode_list", "SELECT n_regionkey AS region_key, n_name AS name FROM nation")
def _(t):
    got = decode(encode(names(t), "v", NAMES, "Names"), "xml", NAMES, "Names")
    return explode_items(got, "decoded", "Members", ["region_key"]).select("region_key", F.col("item").alias("name"))


@query("decode_list_empty", "SELECT n_regionkey AS region_key, CAST(CASE n_regionkey % 3 WHEN 0 THEN -1 WHEN 1 THEN 0 ELSE 1 END AS INTEGER) AS n FROM nation")
def _(t):
    x = F.when(F.col("n_regionkey") % 3 == 0, "<Names></Names>").when(F.col("n_regionkey") % 3 == 1, "<Names><Members></Members></Names>").otherwise("<Names><Members><string></string></Members></Names>")
    got = decode(t("nation").select(F.col("n_regionkey").alias("region_key"), x.alias("xml")), "xml", NAMES, "Names")
    return got.select("region_key", F.coalesce(F.size("decoded.Members"), F.lit(-1)).alias("n"))


@query("decode_item_guard", "SELECT n_regionkey AS region_key, CAST(count(*) AS INTEGER) AS n, true AS clean FROM nation GROUP BY 1")
def _(t):
    docs = encode(names(t), "v", NAMES, "Names")
    got = decode(docs, "xml", NAMES, "Names")
    return got.select("region_key", F.size("decoded.Members").alias("n"), items_are(F.col("xml"), "/*/Members", "string").alias("clean"))


def baskets(t) -> DataFrame:
    line = F.struct(F.col("l_linenumber").alias("Number"), F.col("l_partkey").alias("PartKey"), F.col("l_extendedprice").cast("decimal(18,2)").alias("Price"), (F.col("l_returnflag") == "R").alias("Returned"))
    # lines hardly meet before they are dealt, so that lists of them are made once, from sorted rows, and not on both sides of the shuffle
    lines = t("lineitem").select("l_orderkey", line.alias("line")).repartition("l_orderkey").sortWithinPartitions("l_orderkey")
    g = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("Lines"))
    return g.select(F.struct(F.col("l_orderkey").alias("OrderKey"), "Lines").alias("v"))


@query("decode_list_struct", "SELECT l_orderkey AS order_key, l_linenumber AS number, l_partkey AS part_key, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_returnflag = 'R' AS returned FROM lineitem")
def _(t):
    got = decode(encode(baskets(t), "v", BASKET, "Basket"), "xml", BASKET, "Basket").select(F.col("decoded.OrderKey").alias("order_key"), "decoded")
    items = explode_items(got, "decoded", "Lines", ["order_key"])
    return items.select("order_key", F.col("Number").alias("number"), F.col("PartKey").alias("part_key"), F.col("Price").cast("decimal(18,2)").alias("price"), F.col("Returned").alias("returned"))


@query("encode_list_struct", "SELECT l_orderkey AS order_key, '<Basket><OrderKey>' || l_orderkey || '</OrderKey><Lines>' || string_agg('<Line><Number>' || l_linenumber || '</Number><PartKey>' || l_partkey || '</PartKey><Price>' || CAST(l_extendedprice AS DECIMAL(18,2)) || '</Price><Returned>' || CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END || '</Returned></Line>', '' ORDER BY l_linenumber, l_partkey, CAST(l_extendedprice AS DECIMAL(18,2)), l_returnflag = 'R') || '</Lines></Basket>' AS xml FROM lineitem GROUP BY l_orderkey")
def _(t):
    return encode(baskets(t), "v", BASKET, "Basket").select(F.col("v.OrderKey").alias("order_key"), "xml")


#: keys that a document of a growing list takes at most
BLOCK = 64


def parties(t) -> DataFrame:
    """A row for each party: k its nation, block a part of the nation's parties, so that no document grows with the tables."""
    none = lambda k: F.lit(None).cast(k)
    c = t("customer").select(F.col("c_nationkey").alias("k"), F.expr(f"c_custkey div {BLOCK}").alias("block"), F.struct(F.lit("Client").alias("_type"), F.col("c_mktsegment").alias("Segment"), F.col("c_custkey").alias("Key"), F.col("c_name").alias("Name"), none("int").alias("Rank")).alias("p"))
    s = t("supplier").select(F.col("s_nationkey").alias("k"), F.expr(f"s_suppkey div {BLOCK}").alias("block"), F.struct(F.lit("Vendor").alias("_type"), none("string").alias("Segment"), F.col("s_suppkey").alias("Key"), F.col("s_name").alias("Name"), (F.col("s_suppkey") % 7).cast("int").alias("Rank")).alias("p"))
    return c.unionByName(s)


@query("decode_poly_list", "SELECT c_nationkey AS nation_key, 'Client' AS kind, c_custkey AS key, c_name AS name, c_mktsegment AS segment, CAST(NULL AS INTEGER) AS rank FROM customer UNION ALL SELECT s_nationkey, 'Vendor', s_suppkey, s_name, NULL, CAST(s_suppkey % 7 AS INTEGER) FROM supplier")
def _(t):
    g = parties(t).groupBy("k", "block").agg(F.sort_array(F.collect_list("p")).alias("m")).select(F.struct(F.col("k").alias("NationKey"), F.col("m").alias("Parties")).alias("v"))
    got = decode(encode(g, "v", PARTY, "Directory"), "xml", PARTY, "Directory").select(F.col("decoded.NationKey").alias("nation_key"), "decoded")
    return explode_items(got, "decoded", "Parties", ["nation_key"]).select("nation_key", F.col("_type").alias("kind"), F.col("Key").alias("key"), F.col("Name").alias("name"), F.col("Segment").alias("segment"), F.col("Rank").alias("rank"))


PARTY_SQL = f"""
SELECT k AS nation_key, block, '<Directory><NationKey>' || k || '</NationKey><Parties>' || string_agg(x, '' ORDER BY kind, segment, key) || '</Parties></Directory>' AS xml FROM (
  SELECT c_nationkey AS k, c_custkey // {BLOCK} AS block, 'Client' AS kind, c_mktsegment AS segment, c_custkey AS key, '<Party xmlns:xsi="{text.XSI}" xsi:type="Client"><Segment>' || c_mktsegment || '</Segment><Key>' || c_custkey || '</Key><Name>' || c_name || '</Name></Party>' AS x FROM customer
  UNION ALL SELECT s_nationkey, s_suppkey // {BLOCK}, 'Vendor', '', s_suppkey, '<Party xmlns:xsi="{text.XSI}" xsi:type="Vendor"><Rank>' || (s_suppkey % 7) || '</Rank><Key>' || s_suppkey || '</Key><Name>' || s_name || '</Name></Party>' FROM supplier
) GROUP BY k, block"""


@query("encode_poly_list", PARTY_SQL)
def _(t):
    v = parties(t).groupBy("k", "block").agg(F.sort_array(F.collect_list("p")).alias("m"))
    return encode(v.select(F.col("k").alias("nation_key"), "block", F.struct(F.col("k").alias("NationKey"), F.col("m").alias("Parties")).alias("v")), "v", PARTY, "Directory").select("nation_key", "block", "xml")


@query("decode_poly_tags", "SELECT c_nationkey AS nation_key, 'Client' AS kind, c_custkey AS key FROM customer")
def _(t):
    g = t("customer").groupBy("c_nationkey", F.expr(f"c_custkey div {BLOCK}")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<Client><Key>"), "c_custkey", F.lit("</Key></Client>")))), "").alias("m"))
    docs = g.select(F.concat(F.lit("<Directory><NationKey>"), "c_nationkey", F.lit("</NationKey><Parties>"), "m", F.lit("</Parties></Directory>")).alias("xml"))
    got = decode(docs, "xml", PARTY, "Directory").select(F.col("decoded.NationKey").alias("nation_key"), "decoded")
    return explode_items(got, "decoded", "Parties", ["nation_key"]).select("nation_key", F.col("_type").alias("kind"), F.col("Key").alias("key"))


@query("encode_poly_member", f"SELECT c_custkey AS key, '<Holder><Id>' || c_custkey || '</Id><Party xmlns:xsi=\"{text.XSI}\" xsi:type=\"Client\"><Segment>' || c_mktsegment || '</Segment><Key>' || c_custkey || '</Key><Name>' || c_name || '</Name></Party></Holder>' AS xml FROM customer")
def _(t):
    c = parties(t).where("p._type = 'Client'").select(F.col("p.Key").alias("key"), F.struct(F.col("p.Key").alias("Id"), F.col("p").alias("Party")).alias("v"))
    return encode(c, "v", PARTY, "Holder").select("key", "xml")


@query("decode_poly_member", "SELECT c_custkey AS id, 'Client' AS kind, c_name AS name, c_mktsegment AS segment FROM customer")
def _(t):
    x = F.concat(F.lit(f'<Holder xmlns:p3="{text.XSI}"><Id>'), "c_custkey", F.lit('</Id><Party p3:type="Client"><Name>'), text.escape(F.col("c_name")), F.lit("</Name><Segment>"), "c_mktsegment", F.lit("</Segment></Party></Holder>"))
    d = F.col("decoded")
    return decode(t("customer").select(x.alias("xml")), "xml", PARTY, "Holder").select(d.Id.alias("id"), d.Party._type.alias("kind"), d.Party.Name.alias("name"), d.Party.Segment.alias("segment"))


@query("decode_poly_unknown_member", "SELECT c_custkey AS id, true AS absent FROM customer")
def _(t):
    x = F.concat(F.lit(f'<Holder xmlns:x="{text.XSI}"><Id>'), "c_custkey", F.lit('</Id><Party x:type="Stranger"><Name>n</Name></Party></Holder>'))
    return decode(t("customer").select(x.alias("xml")), "xml", PARTY, "Holder").select(F.col("decoded.Id").alias("id"), F.col("decoded.Party").isNull().alias("absent"))


@query("encode_member_order", "SELECT s_suppkey AS key, 'Rank,Key,Name' AS members FROM supplier")
def _(t):
    s = parties(t).where("p._type = 'Vendor'").select(F.col("p.Key").alias("key"), F.struct(F.col("p.Key").alias("Id"), F.col("p").alias("Party")).alias("v"))
    tags = F.regexp_extract_all(F.substring_index(encoded(F.col("v"), PARTY, "Holder"), "<Party", -1), F.lit("<([A-Z][a-z]+)>"), 1)
    return s.select("key", F.array_join(tags, ",").alias("members"))


# -- scalars


@query("encode_enum", "SELECT event_id, '<Event><Id>' || event_id || '</Id><Kind>' || event_type || '</Kind></Event>' AS xml FROM events")
def _(t):
    m = Model().subject("Event", ("Id", "long"), ("Kind", KIND), root=True)
    return t("events").select("event_id", encoded(F.struct(F.col("event_id").alias("Id"), F.col("event_type").alias("Kind")), m, "Event").alias("xml"))


@query("decode_enum", "SELECT event_id, event_type FROM events")
def _(t):
    m = Model().subject("Event", ("Id", "long"), ("Kind", KIND), root=True)
    docs = t("events").select(encoded(F.struct(F.col("event_id").alias("Id"), F.col("event_type").alias("Kind")), m, "Event").alias("xml"))
    return decode(docs, "xml", m, "Event").select(F.col("decoded.Id").alias("event_id"), F.col("decoded.Kind").alias("event_type"))


@query("decode_list_enum", "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def _(t):
    m = Model().subject("User", ("Id", "long"), ("Kinds", Many(KIND)), root=True)
    g = t("events").groupBy("user_id", F.expr("event_id div 4096")).agg(F.collect_list("event_type").alias("k")).select(F.struct(F.col("user_id").alias("Id"), F.col("k").alias("Kinds")).alias("v"))
    got = decode(encode(g, "v", m, "User"), "xml", m, "User").select(F.col("decoded.Id").alias("user_id"), "decoded")
    return explode_items(got, "decoded", "Kinds", ["user_id"]).groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct("item").alias("kinds"))


@query("decode_datetime", "SELECT event_id, ts FROM events")
def _(t):
    m = Model().subject("Event", ("Id", "long"), ("At", "dateTime"), root=True)
    docs = t("events").select(encoded(F.struct(F.col("event_id").alias("Id"), F.col("ts").alias("At")), m, "Event").alias("xml"))
    return decode(docs, "xml", m, "Event").select(F.col("decoded.Id").alias("event_id"), F.col("decoded.At").cast("timestamp_ntz").alias("ts"))


@query("encode_datetime", "SELECT event_id, '<Event><At>' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '0</At></Event>' AS xml FROM events")
def _(t):
    m = Model().subject("Event", ("At", "dateTime"), root=True)
    return t("events").select("event_id", encoded(F.struct(F.col("ts").alias("At")), m, "Event").alias("xml"))


@query("encode_date_format", "SELECT event_id, '<Event><At>' || strftime(ts, '%Y/%m/%d') || '</At></Event>' AS xml FROM events")
def _(t):
    m = Model(Codecs(date_pattern="yyyy/MM/dd")).subject("Event", ("At", "dateTime"), root=True)
    return t("events").select("event_id", encoded(F.struct(F.col("ts").alias("At")), m, "Event").alias("xml"))


@query("decode_guid", "SELECT c_custkey AS key, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)")
def _(t):
    m = Model().subject("Ident", ("Key", "long"), ("Id", "guid"), root=True)
    raw = F.upper(F.regexp_replace(F.md5("c_name"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    docs = t("customer").select(F.concat(F.lit("<Ident><Key>"), "c_custkey", F.lit("</Key><Id> "), raw, F.lit("</Id></Ident>")).alias("xml"))
    return decode(docs, "xml", m, "Ident").select(F.col("decoded.Key").alias("key"), F.col("decoded.Id").alias("id"))


@query("decode_boolean", "SELECT l_orderkey AS order_key, l_linenumber AS number, l_returnflag = 'R' AS returned FROM lineitem")
def _(t):
    m = Model().subject("L", ("K", "long"), ("N", "int"), ("R", "boolean"), root=True)
    v = F.struct(F.col("l_orderkey").alias("K"), F.col("l_linenumber").alias("N"), (F.col("l_returnflag") == "R").alias("R"))
    d = F.col("decoded")
    return decode(t("lineitem").select(encoded(v, m, "L").alias("xml")), "xml", m, "L").select(d.K.alias("order_key"), d.N.alias("number"), d.R.alias("returned"))


@query("decode_decimal", "SELECT l_orderkey AS order_key, l_linenumber AS number, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem")
def _(t):
    m = Model(Codecs(readers={"decimal": decimal_reader(18, 2)})).subject("L", ("K", "long"), ("N", "int"), ("P", "decimal"), root=True)
    v = F.struct(F.col("l_orderkey").alias("K"), F.col("l_linenumber").alias("N"), F.col("l_extendedprice").cast("decimal(18,2)").alias("P"))
    d = F.col("decoded")
    return decode(t("lineitem").select(encoded(v, m, "L").alias("xml")), "xml", m, "L").select(d.K.alias("order_key"), d.N.alias("number"), d.P.cast("decimal(18,2)").alias("price"))


def ints(t) -> DataFrame:
    k = F.col("p_partkey")
    v = F.struct((k % 256 - 128).cast("tinyint").alias("Tiny"), (k % 256).cast("smallint").alias("UTiny"), (k % 65536 - 32768).cast("smallint").alias("Short"), (k % 65536).cast("int").alias("UShort"), (-k).cast("int").alias("Int"), (F.lit(4294967295) - k).alias("UInt"), (k - F.lit(9223372036854775807)).alias("Long"), (F.expr("18446744073709551615BD").cast("decimal(20,0)") - k).cast("decimal(20,0)").alias("ULong"))
    return t("part").select(k.alias("key"), v.alias("v"))


@query("decode_integers", "SELECT p_partkey AS key, CAST(p_partkey % 256 - 128 AS TINYINT) AS tiny, CAST(p_partkey % 256 AS SMALLINT) AS utiny, CAST(p_partkey % 65536 - 32768 AS SMALLINT) AS short, CAST(p_partkey % 65536 AS INTEGER) AS ushort, CAST(-p_partkey AS INTEGER) AS int_, 4294967295 - p_partkey AS uint, p_partkey - 9223372036854775807 AS long_, CAST(18446744073709551615::HUGEINT - p_partkey AS DECIMAL(20,0)) AS ulong FROM part")
def _(t):
    d = F.col("decoded")
    got = decode(encode(ints(t), "v", INTS, "Ints"), "xml", INTS, "Ints")
    return got.select("key", d.Tiny.alias("tiny"), d.UTiny.alias("utiny"), d.Short.alias("short"), d.UShort.alias("ushort"), d.Int.alias("int_"), d.UInt.alias("uint"), d.Long.alias("long_"), d.ULong.alias("ulong"))


@query("encode_integers", "SELECT p_partkey AS key, '<Ints><Tiny>' || (p_partkey % 256 - 128) || '</Tiny><UTiny>' || (p_partkey % 256) || '</UTiny><Short>' || (p_partkey % 65536 - 32768) || '</Short><UShort>' || (p_partkey % 65536) || '</UShort><Int>' || (-p_partkey) || '</Int><UInt>' || (4294967295 - p_partkey) || '</UInt><Long>' || (p_partkey - 9223372036854775807) || '</Long><ULong>' || (18446744073709551615::HUGEINT - p_partkey) || '</ULong></Ints>' AS xml FROM part")
def _(t):
    return encode(ints(t), "v", INTS, "Ints").select("key", "xml")


def escaped(x: str) -> str:
    """SQL for the text that ``x`` is written as."""
    return f"array_to_string(list_transform(string_split(replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;'), ''), lambda c: CASE WHEN unicode(c) = 13 OR unicode(c) BETWEEN 160 AND 255 OR unicode(c) > 65535 THEN '&#' || unicode(c) || ';' ELSE c END), '')"


ESCAPED = escaped("text")


@query("encode_string", f"SELECT doc_id, '<Doc><Id>' || doc_id || '</Id><Text>' || {ESCAPED} || '</Text></Doc>' AS xml FROM documents")
def _(t):
    return t("documents").select("doc_id", encoded(F.struct(F.col("doc_id").alias("Id"), F.col("text").alias("Text")), TEXT, "Doc").alias("xml"))


@query("roundtrip_string", "SELECT doc_id, text FROM documents")
def _(t):
    docs = t("documents").select(encoded(F.struct(F.col("doc_id").alias("Id"), F.col("text").alias("Text")), TEXT, "Doc").alias("xml"))
    return decode(docs, "xml", TEXT, "Doc").select(F.col("decoded.Id").alias("doc_id"), F.col("decoded.Text").alias("text"))


@query("roundtrip_json_text", "SELECT event_id, props FROM events")
def _(t):
    docs = t("events").select(encoded(F.struct(F.col("event_id").alias("Id"), F.col("props").alias("Text")), TEXT, "Doc").alias("xml"))
    return decode(docs, "xml", TEXT, "Doc").select(F.col("decoded.Id").alias("event_id"), F.col("decoded.Text").alias("props"))


@query("decode_cdata", "SELECT doc_id, text FROM documents")
def _(t):
    d = t("documents").withColumn("text", F.replace("text", F.lit("]]>"), F.lit("]]]]><![CDATA[>")))  # over two sections
    x = F.concat(F.lit("<Doc><Id>"), "doc_id", F.lit("</Id><Text><![CDATA["), "text", F.lit("]]></Text></Doc>"))
    return decode(d.select(x.alias("xml")), "xml", TEXT, "Doc").select(F.col("decoded.Id").alias("doc_id"), F.col("decoded.Text").alias("text"))


@query("decode_entities", "SELECT doc_id, chr(160) || lang || chr(233) || '&' || chr(8364) || chr(255) AS text FROM documents")
def _(t):
    x = F.concat(F.lit("<Doc><Id>"), "doc_id", F.lit("</Id><Text>&nbsp;"), "lang", F.lit("&eacute;&amp;&euro;&#xFF;</Text></Doc>"))
    return decode(t("documents").select(x.alias("xml")), "xml", TEXT, "Doc").select(F.col("decoded.Id").alias("doc_id"), F.col("decoded.Text").alias("text"))


@query("encode_utf8", f"SELECT doc_id, CAST(octet_length(encode('<Doc><Id>' || doc_id || '</Id><Text>' || {ESCAPED} || '</Text></Doc>')) AS INTEGER) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", F.octet_length(utf8(F.struct(F.col("doc_id").alias("Id"), F.col("text").alias("Text")), TEXT, "Doc")).alias("n"))


@query("estimate_length", "SELECT doc_id, CAST(11 + 9 + 21 + 13 + length(text) + 4 * length(regexp_replace(text, '[^<>&`\"]', '', 'g')) AS BIGINT) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", estimated(F.struct(F.col("doc_id").alias("Id"), F.col("text").alias("Text")), TEXT, "Doc").alias("n"))


@query("estimate_orders", f"SELECT o_orderkey AS order_key, CAST({len(text.PROLOG)} + 15 + 21 + 21 + 19 + 21 + 23 + 33 + 17 + length(o_orderstatus) + 21 + length(o_orderpriority) AS BIGINT) AS n FROM orders")
def _(t):
    return t("orders").select(F.col("o_orderkey").alias("order_key"), estimated(order_struct(), ORDER, "Order", prolog=True).alias("n"))


# -- null, empty, absent, nil


def grades(t) -> DataFrame:
    return t("documents").join(t("labels"), "doc_id", "left").select("doc_id", F.struct(F.col("doc_id").alias("Id"), F.col("quality").alias("Quality"), F.when(F.col("lang") != "en", F.col("lang")).alias("Lang")).alias("v"))


@query("encode_nullable", "SELECT d.doc_id, '<Grade><Id>' || d.doc_id || '</Id><Quality>' || coalesce(CAST(quality AS VARCHAR), '') || '</Quality>' || CASE WHEN lang <> 'en' THEN '<Lang>' || lang || '</Lang>' ELSE '' END || '</Grade>' AS xml FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    return encode(grades(t), "v", GRADE, "Grade").select("doc_id", "xml")


@query("decode_nullable", "SELECT d.doc_id, quality, nullif(lang, 'en') AS lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    got = decode(encode(grades(t), "v", GRADE, "Grade").select("xml"), "xml", GRADE, "Grade")
    return got.select(F.col("decoded.Id").alias("doc_id"), F.col("decoded.Quality").alias("quality"), F.col("decoded.Lang").alias("lang"))


@query("encode_null", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN NULL ELSE '<Grade><Id>' || doc_id || '</Id><Quality></Quality></Grade>' END AS xml FROM documents")
def _(t):
    v = F.when(F.col("doc_id") % 2 == 1, F.struct(F.col("doc_id").alias("Id"), F.lit(None).cast("int").alias("Quality"), F.lit(None).cast("string").alias("Lang")))
    return t("documents").select("doc_id", encoded(v, GRADE, "Grade").alias("xml"))


@query("decode_bodyless", "SELECT doc_id, CAST(NULL AS INTEGER) AS quality, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'x/>y' END AS lang FROM documents")
def _(t):
    lang = F.when(F.col("doc_id") % 3 == 0, "<Lang />").when(F.col("doc_id") % 3 == 1, "<Lang></Lang>").otherwise("<Lang><![CDATA[x/>y]]></Lang>")
    docs = t("documents").select(F.concat(F.lit("<Grade><Quality/><Id>"), "doc_id", F.lit("</Id>"), lang, F.lit("</Grade>")).alias("xml"))
    return decode(docs, "xml", GRADE, "Grade").select(F.col("decoded.Id").alias("doc_id"), F.col("decoded.Quality").alias("quality"), F.col("decoded.Lang").alias("lang"))


@query("decode_nil", "SELECT doc_id, CAST(NULL AS INTEGER) AS quality, CAST(NULL AS VARCHAR) AS lang FROM documents")
def _(t):
    docs = t("documents").select(F.concat(F.lit(f'<Grade xmlns:xsi="{text.XSI}"><Quality xsi:nil="true" /><Id>'), "doc_id", F.lit('</Id><Lang xsi:nil="true"></Lang></Grade>')).alias("xml"))
    return decode(docs, "xml", GRADE, "Grade").select(F.col("decoded.Id").alias("doc_id"), F.col("decoded.Quality").alias("quality"), F.col("decoded.Lang").alias("lang"))


@query("decode_defaults", "SELECT doc_id, 0 AS a, false AS b, '00000000-0000-0000-0000-000000000000' AS c, CAST(NULL AS INTEGER) AS d, CAST(NULL AS VARCHAR) AS e, 7 AS f, 'none' AS g FROM documents")
def _(t):
    m = Model().subject("X", ("K", "long"), ("A", "int"), ("B", "boolean"), ("C", "guid"), ("D", "int?"), ("E", "string"), ("F", "int"), ("G", "string"), root=True, factory={"F": 7, "G": "none"})
    docs = t("documents").select(F.concat(F.lit("<X><K>"), "doc_id", F.lit("</K></X>")).alias("xml"))
    d = F.col("decoded")
    return decode(docs, "xml", m, "X").select(d.K.alias("doc_id"), d.A.alias("a"), d.B.alias("b"), d.C.alias("c"), d.D.alias("d"), d.E.alias("e"), d.F.alias("f"), d.G.alias("g"))


@query("decode_empty_root", "SELECT doc_id, true AS is_there, 0 AS quality_default FROM documents")
def _(t):
    m = Model().subject("Grade", ("Quality", "int"), root=True)
    x = F.when(F.col("doc_id") % 3 == 0, "<Grade/>").when(F.col("doc_id") % 3 == 1, "<Grade   />").otherwise("<Grade><!-- nothing --></Grade>")
    return decode(t("documents").select("doc_id", x.alias("xml")), "xml", m, "Grade").select("doc_id", F.col("decoded").isNotNull().alias("is_there"), F.col("decoded.Quality").alias("quality_default"))


# -- custom codecs, recursion, turns


@query("custom_codecs", "SELECT p_partkey AS key, '<P><Size>' || printf('%X', p_size) || '</Size></P>' AS xml, p_size AS size FROM part")
def _(t):
    own = Codecs(readers={"int": lambda c: F.conv(c, 16, 10).cast("int")}, writers={"int": lambda c: F.hex(c.cast("long"))})
    m = Model(own).subject("P", ("Size", "int"), root=True)
    docs = t("part").select(F.col("p_partkey").alias("key"), encoded(F.struct(F.col("p_size").alias("Size")), m, "P").alias("xml"))
    return decode(docs, "xml", m, "P").select("key", "xml", F.col("decoded.Size").alias("size"))


@query("recursive_subject", "SELECT o_custkey AS cust_key, o_orderkey AS order_key FROM orders")
def _(t):
    m = Model().subject("Node", ("Key", "long"), ("Next", Ref("Node")), root=True)
    docs = t("orders").select(F.concat(F.lit("<Node><Key>"), "o_custkey", F.lit("</Key><Next><Key>"), "o_orderkey", F.lit("</Key></Next></Node>")).alias("xml"))
    return decode(docs, "xml", m, "Node").select(F.col("decoded.Key").alias("cust_key"), F.col("decoded.Next.Key").alias("order_key"))


@query("decode_conversations", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    m = Model().subject("Turn", ("N", "long"), ("Role", "string"), ("Text", "string")).subject("Talk", ("Id", "long"), ("Turns", Many(Ref("Turn"))), root=True)
    turn = F.struct(F.col("turn").alias("N"), F.col("role").alias("Role"), F.col("text").alias("Text"))
    g = t("conversations").groupBy("conv_id", F.expr(f"turn div {BLOCK}")).agg(F.collect_list(turn).alias("Turns")).select(F.struct(F.col("conv_id").alias("Id"), "Turns").alias("v"))
    got = decode(encode(g, "v", m, "Talk").select("xml"), "xml", m, "Talk").select(F.col("decoded.Id").alias("conv_id"), "decoded")
    return explode_items(got, "decoded", "Turns", ["conv_id"]).select("conv_id", F.col("N").alias("turn"), F.col("Role").alias("role"), F.col("Text").alias("text"))


@query("wire_schema", "SELECT r_regionkey AS region_key, 'struct<OrderKey:string,CustKey:string,OrderDate:string,Status:string,Priority:string>' AS wire, 'struct<OrderKey:string>' AS pruned FROM region")
def _(t):
    return t("region").select(F.col("r_regionkey").alias("region_key"), F.lit(wire.struct(ORDER, "Order").simpleString()).alias("wire"), F.lit(wire.struct(ORDER, "Order", {"OrderKey": {}}).simpleString()).alias("pruned"))


# -- the parser for what has a plain form, too; characters that are written as references; guards and refused documents


@query("decode_parser", ORDER_SQL)
def _(t):
    return order_columns(decode(order_xml(t), "xml", ORDER, "Order", plain_form=False))


def astral(c: Column) -> Column:
    """Each text with characters beyond U+FFFF and a carriage return before it, in it and after it."""
    half = F.expr("CAST(length(text) div 2 AS INT)")
    return F.concat(F.lit("😀a"), F.substr(c, F.lit(1), half), F.lit("\r𝔘b😀"), F.substr(c, half + 1), F.lit("😀 after"))


ASTRAL = "'😀a' || substring(text, 1, length(text) // 2) || chr(13) || '𝔘b😀' || substring(text, length(text) // 2 + 1) || '😀 after'"


@query("encode_astral", f"SELECT doc_id, '<Doc><Id>' || doc_id || '</Id><Text>' || {escaped(ASTRAL)} || '</Text></Doc>' AS xml FROM documents")
def _(t):
    return t("documents").select("doc_id", encoded(F.struct(F.col("doc_id").alias("Id"), astral(F.col("text")).alias("Text")), TEXT, "Doc").alias("xml"))


@query("roundtrip_astral", f"SELECT doc_id, {ASTRAL} AS text FROM documents")
def _(t):
    docs = t("documents").select(encoded(F.struct(F.col("doc_id").alias("Id"), astral(F.col("text")).alias("Text")), TEXT, "Doc").alias("xml"))
    return decode(docs, "xml", TEXT, "Doc").select(F.col("decoded.Id").alias("doc_id"), F.col("decoded.Text").alias("text"))


@query("encode_raw_string", "SELECT doc_id, '<Doc><Id>' || doc_id || '</Id><Text><b>' || lang || '</b>&amp;</Text></Doc>' AS xml FROM documents")
def _(t):
    m = Model(Codecs(writers={"string": as_is})).subject("Doc", ("Id", "long"), ("Text", "string"), root=True)
    return t("documents").select("doc_id", encoded(F.struct(F.col("doc_id").alias("Id"), F.concat(F.lit("<b>"), "lang", F.lit("</b>&amp;")).alias("Text")), m, "Doc").alias("xml"))


@query("encode_guid", "SELECT c_custkey AS key, '<Ident><Id>' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] || '</Id></Ident>' AS xml FROM (SELECT c_custkey, md5(c_name) AS h FROM customer)")
def _(t):
    m = Model().subject("Ident", ("Id", "guid"), root=True)
    raw = F.upper(F.regexp_replace(F.md5("c_name"), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return t("customer").select(F.col("c_custkey").alias("key"), encoded(F.struct(raw.alias("Id")), m, "Ident").alias("xml"))


@query("encode_boolean", "SELECT l_orderkey AS order_key, l_linenumber AS number, '<L><R>' || CASE WHEN l_returnflag = 'R' THEN 'true' ELSE 'false' END || '</R></L>' AS xml FROM lineitem")
def _(t):
    m = Model().subject("L", ("R", "boolean"), root=True)
    return t("lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("number"), encoded(F.struct((F.col("l_returnflag") == "R").alias("R")), m, "L").alias("xml"))


@query("encode_decimal", "SELECT l_orderkey AS order_key, l_linenumber AS number, '<L><P>' || CAST(l_extendedprice AS DECIMAL(18,2)) || '</P></L>' AS xml FROM lineitem")
def _(t):
    m = Model().subject("L", ("P", "decimal"), root=True)
    return t("lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("number"), encoded(F.struct(F.col("l_extendedprice").cast("decimal(18,2)").alias("P")), m, "L").alias("xml"))


@query("decode_decimal_guard", "SELECT p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN p_partkey + 0.1234567891 WHEN 1 THEN CAST(p_partkey + 0.5 AS DECIMAL(28,10)) END AS price, p_partkey % 3 = 2 AS refused FROM part")
def _(t):
    m = Model().subject("P", ("P", "decimal?"), root=True)
    tail = F.when(F.col("p_partkey") % 3 == 0, ".1234567891").when(F.col("p_partkey") % 3 == 1, ".500000000000").otherwise(".123456789012345")
    docs = t("part").select("p_partkey", F.concat(F.lit("<P><P>"), "p_partkey", tail, F.lit("</P></P>")).alias("xml"))
    got = decode(docs, "xml", m, "P", bad="why")
    return got.select(F.col("p_partkey").alias("key"), F.col("decoded.P").alias("price"), F.col("why").isNotNull().alias("refused"))


@query("decode_datetime_raw", "SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || (event_id % 10) AS ts_raw FROM events")
def _(t):
    m = Model().subject("Event", ("Id", "long"), ("At", "dateTime"), root=True)
    docs = t("events").select(F.concat(F.lit("<Event><Id>"), "event_id", F.lit("</Id><At>"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), (F.col("event_id") % 10).cast("string"), F.lit("</At></Event>")).alias("xml"))
    d = F.col("decoded")
    return decode(docs, "xml", m, "Event", raw_dates=True).select(d.Id.alias("event_id"), d.At.cast("timestamp_ntz").alias("ts"), d.At_raw.alias("ts_raw"))


@query("decode_wrong_item", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, c_custkey % 3 = 0 AS refused FROM customer")
def _(t):
    tag = F.when(F.col("c_custkey") % 3 == 0, "int").otherwise("string")
    x = F.concat(F.lit("<Names><RegionKey>1</RegionKey><Members><string>a</string><"), tag, F.lit(">"), text.escape(F.col("c_name")), F.lit("</"), tag, F.lit("></Members></Names>"))
    got = decode(t("customer").select("c_custkey", x.alias("xml")), "xml", NAMES, "Names", bad="why")
    return got.select(F.col("c_custkey").alias("key"), F.try_element_at("decoded.Members", F.lit(2)).alias("name"), F.col("why").isNotNull().alias("refused"))


@query("decode_enum_tags", "SELECT event_id, event_type AS first, 'click' AS second FROM events")
def _(t):
    m = Model().subject("User", ("Id", "long"), ("Kinds", Many(KIND)), root=True)
    x = F.concat(F.lit("<User><Id>"), "event_id", F.lit("</Id><Kinds><Whatever>"), "event_type", F.lit("</Whatever><Kind>click</Kind></Kinds></User>"))
    d = F.col("decoded")
    return decode(t("events").select(x.alias("xml")), "xml", m, "User").select(d.Id.alias("event_id"), d.Kinds[0].alias("first"), d.Kinds[1].alias("second"))


@query("decode_cdata_tags", "SELECT c_custkey AS key, 'see <Client> ' || c_name || ' </Client>' AS name FROM customer")
def _(t):
    x = F.concat(F.lit("<Directory><NationKey>1</NationKey><Parties><!-- <Vendor> --><Client><Key>"), "c_custkey", F.lit("</Key><Name><![CDATA[see <Client> "), "c_name", F.lit(" </Client>]]></Name></Client></Parties></Directory>"))
    p = F.col("decoded.Parties")[0]
    return decode(t("customer").select(x.alias("xml")), "xml", PARTY, "Directory").select(p.Key.alias("key"), p.Name.alias("name"))


@query("decode_entities_cdata", "SELECT doc_id, chr(160) || '&nbsp;<' || lang || '>' || chr(233) AS text FROM documents")
def _(t):
    x = F.concat(F.lit("<Doc><Id>"), "doc_id", F.lit("</Id><Text>&nbsp;<![CDATA[&nbsp;<]]>"), "lang", F.lit("&gt;&eacute;</Text></Doc>"))
    return decode(t("documents").select(x.alias("xml")), "xml", TEXT, "Doc").select(F.col("decoded.Id").alias("doc_id"), F.col("decoded.Text").alias("text"))


@query("decode_permissive", "SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 4 = 3 THEN o_custkey END AS cust_key, CASE o_orderkey % 4 WHEN 0 THEN 'not well-formed' WHEN 1 THEN 'not a valid long: x' WHEN 2 THEN 'not a Order document: Odd' END AS why FROM orders")
def _(t):
    k = F.col("o_orderkey") % 4
    xml = F.col("xml")
    bad = F.when(k == 0, F.expr("substring(xml, 1, length(xml) - 4)")).when(k == 1, F.replace(xml, F.lit("<CustKey>"), F.lit("<CustKey>x</CustKey><B>"))).when(k == 2, F.replace(xml, F.lit("Order>"), F.lit("Odd>"))).otherwise(xml)
    bad = F.when(k == 1, F.regexp_replace(bad, "<B>([0-9]+)</CustKey>", "<B>$1</B>")).otherwise(bad)
    docs = t("orders").select("o_orderkey", encoded(order_struct(), ORDER, "Order").alias("xml")).select("o_orderkey", bad.alias("xml"))
    return decode(docs, "xml", ORDER, "Order", bad="why").select(F.col("o_orderkey").alias("order_key"), F.col("decoded.CustKey").alias("cust_key"), "why")


@query("decode_deep", "SELECT o_orderkey AS order_key, o_custkey AS inmost, true AS refused_at_3, '<Node><Key>1</Key><Next><Key>2</Key><Next><Key>3</Key><Next><Key>4</Key><Next><Key>' || o_custkey || '</Key></Next></Next></Next></Next></Node>' AS xml FROM orders")
def _(t):
    m = Model().subject("Node", ("Key", "long"), ("Next", Ref("Node")), root=True)
    docs = t("orders").select("o_orderkey", F.concat(F.lit("<Node>" + "".join(f"<Key>{i}</Key><Next>" for i in range(1, 5)) + "<Key>"), "o_custkey", F.lit("</Key>" + "</Next>" * 4 + "</Node>")).alias("given"))
    got = decode(docs, "given", m, "Node", depth=5)
    got = decode(got, "given", m, "Node", into="less", bad="why")
    return encode(got, "decoded", m, "Node").select(F.col("o_orderkey").alias("order_key"), F.col("decoded.Next.Next.Next.Next.Key").alias("inmost"), F.col("why").isNotNull().alias("refused_at_3"), "xml")


assert OPTIONS["mode"] == "FAILFAST"
