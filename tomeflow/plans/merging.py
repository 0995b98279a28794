"""Queries on merging, overload sets, orders, names and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.core import placed, table
from tomeflow.functions import names
from tomeflow.operators import filters, legible, lint, merge, order, overloads, relates, resolve
from tomeflow.plans.registry import query


@query("""
SELECT l_partkey, arg_min(l_returnflag, (l_orderkey, l_linenumber)) FILTER (l_returnflag <> '') AS first_flag,
       arg_max(l_suppkey, (l_orderkey, l_linenumber)) AS last_supplier, bool_or(l_linestatus = 'F') AS any_closed, min(l_linenumber) AS mode
FROM lineitem GROUP BY l_partkey""")
def merged_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a part are merged in order of (order, line); of lines that
    repeat both, the one that is read first decides, as the first and as the last. Null
    keys come after all others."""
    l = placed(spark, sf_dir, "lineitem")
    back = F.struct(*merge.falling("l_orderkey", "l_linenumber"), "place").alias("back")
    l = l.select("l_partkey", F.struct(*merge.rising("l_orderkey", "l_linenumber"), "place").alias("seq"), back, F.col("l_returnflag").alias("first_flag"), F.col("l_suppkey").alias("last_supplier"), (F.col("l_linestatus") == "F").alias("any_closed"), F.col("l_linenumber").alias("mode"))
    return merge.merge_symbols(l, "seq", first=["first_flag"], last=["last_supplier"], flags=["any_closed"], mode="mode", id_col="l_partkey", back="back")


@query("""
WITH l AS (SELECT l_suppkey AS id, l_linestatus = 'F' AS is_def, l_discount > 0.05 AS documented, l_orderkey || ':' || l_linenumber AS loc FROM lineitem)
SELECT id, coalesce(min(loc) FILTER (is_def AND documented), min(loc) FILTER (is_def)) AS def,
       coalesce(md5(array_to_string(list_sort(list(DISTINCT loc) FILTER (NOT is_def)), ',')), md5('')) AS decl
FROM l GROUP BY id""")
def merged_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documented definition first; declarations sorted without repeats."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_linestatus") == "F").alias("is_def"), (F.col("l_discount") > 0.05).alias("documented"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("loc"))
    return merge.merge_locations(l).select("id", "def", F.md5(F.array_join("decl", ",")).alias("decl"))


@query("""
WITH lists AS (SELECT o_custkey AS id, o_orderkey AS seq, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_suppkey) AS pos, l_suppkey AS child FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
once AS (SELECT id, child, min((seq, pos)) AS place FROM lists GROUP BY id, child)
SELECT id, md5(array_to_string(list(child ORDER BY place), ',')) AS children, count(*) AS n FROM once GROUP BY id""")
def merged_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's suppliers in first-seen order."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    per = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("children"))
    lists = o.join(per, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), "children")
    out = merge.merge_children(lists, "seq", "children")
    return out.select("id", F.md5(F.array_join("children", ",")).alias("children"), F.size("children").cast("bigint").alias("n"))


@query("""
SELECT l_partkey % 500 AS id, l_linenumber AS pos, arg_min(l_returnflag, (l_orderkey, l_linenumber, l_partkey)) AS name, arg_min(l_suppkey, (l_orderkey, l_linenumber, l_partkey)) AS type_id
FROM lineitem GROUP BY 1, 2""")
def merged_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters merged by position; of lines with equal keys the first read,
    null keys after all others."""
    l = placed(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("id"), F.col("l_linenumber").alias("pos"), F.struct(*merge.rising("l_orderkey", "l_linenumber", "l_partkey"), "place").alias("seq"), F.col("l_returnflag").alias("name"), F.col("l_suppkey").alias("type_id"))
    return merge.merge_params(l, "seq", ["name", "type_id"])


DOCS_SQL = """
WITH b AS (
    SELECT l_partkey AS symbol_id, CASE l_linenumber % 3 WHEN 0 THEN 'params' WHEN 1 THEN 'returns' ELSE 'document' END AS section, l_orderkey AS seq, (l_linenumber * 100000 + l_suppkey) * 100 + l_quantity::BIGINT AS pos,
           l_returnflag AS name, l_linestatus AS direction, 'text ' || l_quantity::BIGINT AS literal FROM lineitem
), r AS (
    SELECT *, row_number() OVER (PARTITION BY symbol_id, section, CASE WHEN section = 'params' THEN name END, CASE WHEN section = 'params' THEN direction END,
        CASE WHEN section = 'returns' THEN literal END, CASE WHEN section = 'document' THEN (seq, pos) END ORDER BY seq, pos) AS rn FROM b
)"""


@query(DOCS_SQL + " SELECT symbol_id, section, seq, pos, name, direction, literal FROM r WHERE rn = 1")
def merged_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Params by (name, direction), returns by text, document blocks appended."""
    return merge.merge_docs(doc_rows(spark, sf_dir), "seq")


def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = F.expr("case l_linenumber % 3 when 0 then 'params' when 1 then 'returns' else 'document' end")
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol_id"), section.alias("section"), F.col("l_orderkey").alias("seq"), ((F.col("l_linenumber") * 100000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("bigint")).alias("pos"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("direction"), F.concat(F.lit("text "), F.col("l_quantity").cast("bigint")).alias("literal"))


@query("""
SELECT o_custkey, o_orderpriority, count(*) AS n,
       array_to_string(list(o_orderkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderdate, o_orderkey), ',') AS members
FROM orders GROUP BY 1, 2 HAVING count(*) >= 2""")
def overload_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer and priority, ordered by status, date and key."""
    rank = F.expr("case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end")
    sets = overloads.fold_overloads(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], [rank, F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey")
    return sets.select("o_custkey", "o_orderpriority", "n", F.array_join("members", ",").alias("members"))


@query("""
WITH g AS (SELECT o_custkey AS id, count(DISTINCT o_orderstatus) FILTER (o_orderstatus <> 'O') AS n, min(o_orderstatus) FILTER (o_orderstatus <> 'O') AS b,
                  min(CASE WHEN o_orderkey % 9 = 0 THEN 'constructor' END) AS c, min(o_orderpriority) AS nm FROM orders GROUP BY 1)
SELECT id AS set_id, CASE WHEN n = 1 THEN b WHEN c IS NOT NULL THEN 'Constructors' WHEN n > 1 THEN nm || ' overloads' END AS brief FROM g""")
def consensus_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders have no brief."""
    brief = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), brief.alias("brief"), F.when(F.col("o_orderkey") % 9 == 0, "constructor").alias("func_class"), F.lit(None).cast("string").alias("readable_name"), F.col("o_orderpriority").alias("name"))
    return overloads.consensus_brief(o)


@query("""
WITH sets AS (SELECT p_brand || '/' || p_name AS set_id, p_partkey AS member, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 AS mp FROM part),
b AS (SELECT l_partkey AS symbol_id, CASE WHEN l_linenumber % 2 = 0 THEN 'params' ELSE 'returns' END AS section, l_orderkey * 10 + l_linenumber AS pos, l_returnflag AS name, l_linestatus AS literal FROM lineitem),
f AS (SELECT set_id, section, name, literal, mp, pos, row_number() OVER (PARTITION BY set_id, section, CASE WHEN section = 'params' THEN name ELSE literal END ORDER BY mp, pos) AS rn FROM sets JOIN b ON symbol_id = member)
SELECT set_id, section, row_number() OVER (PARTITION BY set_id, section ORDER BY mp, pos) - 1 AS pos, name, literal FROM f WHERE rn = 1""")
def union_of_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: docs of the parts of one brand and name, first occurrence of a key wins."""
    l = table(spark, sf_dir, "lineitem")
    sets = table(spark, sf_dir, "part").groupBy(F.concat_ws("/", "p_brand", "p_name").alias("set_id")).agg(F.array_sort(F.collect_list("p_partkey")).alias("members"))
    section = F.when(F.col("l_linenumber") % 2 == 0, "params").otherwise("returns")
    blocks = l.select(F.col("l_partkey").alias("symbol_id"), section.alias("section"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("literal"))
    return overloads.union_docs(blocks, sets).select("set_id", "section", F.col("pos").cast("bigint").alias("pos"), "name", "literal")


@query("""
WITH m AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS k FROM orders GROUP BY 1),
b AS (SELECT k, min(o_custkey) AS same_as FROM m GROUP BY k)
SELECT o_custkey AS set_id, same_as FROM m JOIN b USING (k) WHERE o_custkey <> same_as""")
def equivalent_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with the same set of priorities refer to the first one."""
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderpriority").alias("member"))
    return overloads.equivalent_sets(members, members)


@query("""
WITH s AS (SELECT p_brand, p_type, min(p_partkey) AS set_id, count(*) AS n, list(p_partkey) AS members FROM part GROUP BY 1, 2 HAVING count(*) > 1),
m AS (SELECT set_id, unnest(members) AS k FROM s)
SELECT l_orderkey AS using_id, coalesce(set_id, l_partkey) AS target_id, CASE WHEN set_id IS NULL THEN 'function' ELSE 'overloads' END AS kind, min(l_linenumber) AS pos
FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN m ON k = l_partkey GROUP BY 1, 2, 3""")
def resolved_shadows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts an order uses; parts of an overload set stand for the set."""
    p = table(spark, sf_dir, "part")
    sets = p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("set_id"), F.count(F.lit(1)).alias("n"), F.collect_list("p_partkey").alias("members")).where("n > 1")
    shadows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("using_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("shadow_id"))
    return overloads.resolve_shadows(shadows, p.select(F.col("p_partkey").alias("id"), F.lit("function").alias("kind")), sets)


SORT_SQL = """
WITH f AS (
    SELECT l_suppkey AS parent_id, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS name,
           CASE l_linenumber % 5 WHEN 0 THEN 'constructor' WHEN 1 THEN 'destructor' WHEN 2 THEN 'conversion' ELSE 'normal' END AS cls,
           CASE WHEN l_linenumber % 5 > 2 THEN CASE l_orderkey % 4 WHEN 0 THEN 'operator=' WHEN 1 THEN 'operator==' WHEN 2 THEN 'operator<' ELSE '' END ELSE '' END AS op,
           l_partkey % 3 AS pc, CASE WHEN l_partkey % 2 = 0 THEN 'lref' ELSE 'rref' END AS fk, l_suppkey + l_partkey % 2 AS fs, l_linestatus AS params
    FROM lineitem
)
SELECT id, row_number() OVER (PARTITION BY parent_id ORDER BY
    (cls <> 'constructor')::INT, (cls <> 'destructor')::INT, (op <> 'operator=')::INT, (op IN ('operator==', 'operator<'))::INT,
    CASE op WHEN 'operator==' THEN 28 WHEN 'operator<' THEN 30 ELSE 0 END, (cls = 'conversion')::INT,
    CASE WHEN (cls = 'constructor' OR op = 'operator=') AND pc = 1 THEN CASE WHEN fs = parent_id THEN CASE WHEN fk = 'lref' THEN 0 ELSE 1 END ELSE 2 END ELSE 0 END,
    name, pc, params, id) - 1 AS idx FROM f"""


@query(SORT_SQL)
def sorted_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a supplier in the member order."""
    cls = F.expr("case l_linenumber % 5 when 0 then 'constructor' when 1 then 'destructor' when 2 then 'conversion' else 'normal' end")
    op = F.expr("case when l_linenumber % 5 > 2 then case l_orderkey % 4 when 0 then 'operator=' when 1 then 'operator==' when 2 then 'operator<' else '' end else '' end")
    f = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("parent_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("name"), cls.alias("func_class"), op.alias("operator"),
        (F.col("l_partkey") % 3).alias("param_count"), F.when(F.col("l_partkey") % 2 == 0, "lref").otherwise("rref").alias("first_param_kind"), (F.col("l_suppkey") + F.col("l_partkey") % 2).alias("first_param_symbol"),
        F.lit(False).alias("is_template"), F.lit(0).alias("targ_count"), F.lit(0).alias("tparam_count"), F.col("l_linestatus").alias("params_text"),
    )
    return order.number_members(f, order.member_sort_keys(), ["parent_id"]).select("id", F.col("idx").cast("bigint").alias("idx"))


@query("SELECT o_orderkey, o_custkey * 2 AS ref_id FROM orders WHERE o_custkey * 2 IN (SELECT c_custkey FROM customer)")
def existing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to customers that exist."""
    refs = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("ref_id"))
    return resolve.existing(refs, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "ref_id")


@query("SELECT o_custkey, list_contains(list(o_orderpriority), '1-URGENT') AS urgent FROM orders GROUP BY 1")
def set_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an urgent order."""
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    return sets.select("o_custkey", merge.contains(F.col("p"), F.lit("1-URGENT")).alias("urgent"))


@query("""
SELECT p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, (p_size % 2)::INT, p_size % 3, p_size % 4, p_type, p_partkey) - 1 AS idx FROM part""")
def sorted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one name by template-ness, argument and parameter counts and
    texts."""
    z = F.col("p_size")
    r = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("parent_id"), F.col("p_name").alias("name"), F.lit(0).alias("param_count"), (z % 2 == 1).alias("is_template"),
        (z % 3).alias("targ_count"), (z % 4).alias("tparam_count"), F.col("p_type").alias("params_text"),
    )
    return order.number_members(r, order.tie_break_keys(), ["parent_id"]).select("id", F.col("idx").cast("bigint").alias("idx"))


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_name, sha1(p_partkey::VARCHAR) AS id FROM part),
n AS (SELECT *, lag(id) OVER w AS b, lead(id) OVER w AS a FROM p WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY id)),
c AS (SELECT *, greatest(coalesce(list_max(list_filter(range(1, 41), lambda k: left(id, k) = left(b, k))), 0), coalesce(list_max(list_filter(range(1, 41), lambda k: left(id, k) = left(a, k))), 0)) AS lcp FROM n)
SELECT p_partkey, CASE WHEN a IS NULL AND b IS NULL THEN p_name ELSE p_name || '-0' || left(id, lcp::INT + 1) END AS legible FROM c""")
def legible_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with one name in a brand get a separating id prefix."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("parent_id"), F.col("p_name").alias("raw"), legible.symbol_id(F.col("p_partkey").cast("string")).alias("id"))
    return legible.legible_names(p).select("p_partkey", "legible")


@query("""
SELECT p_partkey, sha1(p_brand || '-' || p_name) AS id, CASE WHEN p_size = 1 THEN '<unnamed record>' ELSE p_name END AS shown
FROM part""")
def symbol_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7, P8."""
    from tomeflow.operators.hierarchy import display_name

    name = F.when(F.col("p_size") == 1, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", legible.symbol_id(F.col("p_brand"), F.col("p_name")).alias("id"), display_name(name, F.lit("record")).alias("shown"))


@query("""
WITH o AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 17 <> 0 AND o_orderstatus <> 'P'),
c AS (SELECT * FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey % 8 <> 0)
SELECT o.o_orderkey, c.c_custkey AS record_id FROM o JOIN c ON c.c_custkey = o.o_custkey WHERE NOT (o.o_orderkey % 7 = 0)
UNION SELECT o.o_orderkey, c.c_custkey FROM o JOIN c ON c.c_custkey = o.o_custkey + 1 WHERE o.o_orderkey % 3 = 0 AND o.o_custkey % 10 = 0
UNION SELECT o.o_orderkey, c.c_custkey FROM o JOIN c ON c.c_custkey = o.o_orderkey % 1000
UNION SELECT o.o_orderkey, c.c_custkey FROM o JOIN customer r ON r.c_custkey = o.o_orderkey % 1000 JOIN c ON c.c_custkey = o.o_orderkey % 1000 + 2
      WHERE r.c_custkey % 8 <> 0 AND NOT (o.o_orderkey % 7 = 0 AND o.o_orderkey % 1000 <> o.o_custkey AND c.c_custkey = o.o_custkey)""")
def auto_relates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First parameter, its derived records if by reference, return type and its
    argument; every seventh order is a friend of its own customer. Some orders are
    dependencies, undocumented, methods or no namespace members, some customers are
    dependencies or no records."""
    o = table(spark, sf_dir, "orders")
    f = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("first_param_symbol"), F.when(F.col("o_orderkey") % 3 == 0, "lref").otherwise("named").alias("first_param_kind"), (F.col("o_orderkey") % 1000).alias("return_symbol"), (F.col("o_orderkey") % 1000 + 2).alias("return_targ_symbol"),
        F.when(F.col("o_orderkey") % 11 == 0, 3).otherwise(0).alias("extraction"), (F.col("o_orderkey") % 13 != 0).alias("has_doc"), (F.col("o_orderkey") % 17 == 0).alias("is_record_method"), F.when(F.col("o_orderstatus") == "P", "record").otherwise("namespace").alias("parent_kind"))
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 8 == 0, "typedef").when(k % 4 == 0, "enum").otherwise("record").alias("kind"), F.when(k % 6 == 0, 3).otherwise(0).alias("extraction"))
    bases = c.where("id % 10 = 0").select((F.col("id") + 1).alias("derived_id"), F.col("id").alias("base_id"))
    friends = o.where("o_orderkey % 7 = 0 and o_orderkey % 1000 <> o_custkey").select(F.col("o_custkey").alias("record_id"), F.col("o_orderkey").alias("friend_id"))
    return relates.auto_relates(f, c, bases, friends).select(F.col("function_id").alias("o_orderkey"), "record_id")


@query("""
SELECT l_suppkey AS record_id, array_to_string(list(DISTINCT lpad(l_orderkey::VARCHAR, 10, '0') ORDER BY lpad(l_orderkey::VARCHAR, 10, '0')), ',') AS related FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1""")
def related_back_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique back edges from functions to what they relate to."""
    l = table(spark, sf_dir, "lineitem")
    key = F.lpad(F.col("l_orderkey").cast("string"), 10, "0")
    rel = l.select(F.concat(key, F.when(F.col("l_linenumber") % 2 == 0, "f").otherwise("v")).alias("symbol_id"), F.col("l_suppkey").alias("target_id"), F.lit("x").alias("literal"))
    symbols = rel.select(F.col("symbol_id").alias("id")).distinct().select("id", F.when(F.endswith("id", F.lit("f")), "function").otherwise("variable").alias("kind"), F.substring("id", 1, 10).alias("name"))
    back, _ = relates.related_back_edges(rel, symbols)
    return relates.related_lists(back).select("record_id", F.array_join(F.transform("related", lambda x: F.substring(x, 1, 10)), ",").alias("related"))


@query("""
SELECT l_orderkey, l_partkey AS pos, m AS match_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY m DESC, l_partkey, l_linenumber) AS r FROM (
        SELECT *, CASE WHEN l_quantity <= 10 THEN 0 WHEN l_discount <= 0.02 THEN 1 WHEN l_tax <= 0.02 THEN 2 WHEN l_linestatus = 'F' THEN CASE WHEN l_linenumber > 4 THEN 5 WHEN l_suppkey % 2 <> 0 THEN 6 WHEN l_suppkey % 3 <> 0 THEN 7 WHEN l_suppkey % 5 <> 0 THEN 8 ELSE 9 END WHEN l_returnflag = 'N' THEN 4 ELSE 3 END AS m FROM lineitem))
WHERE r = 1""")
def best_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of an order's lines by a chain of criteria, the first of equals; a
    documented one is preferred only among those whose parameters do not match."""
    c = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_partkey", "l_linenumber").alias("pos"), (F.col("l_quantity") > 10).alias("m_targ_count"), (F.col("l_discount") > 0.02).alias("m_targs"), (F.col("l_tax") > 0.02).alias("m_param_count"),
        (F.col("l_returnflag") == "N").alias("m_documented"), (F.col("l_linestatus") == "F").alias("m_params"), (F.col("l_linenumber") <= 4).alias("m_qualifiers"),
        *[(F.col("l_suppkey") % n == 0).alias(f"m_noexcept_{part}") for part, n in (("definition", 2), ("kind", 3), ("operand", 5))],
    )
    return resolve.best_match(c, ["l_orderkey"]).select("l_orderkey", F.col("pos.l_partkey").alias("pos"), F.col("match_rank").cast("int").alias("match_rank"))


@query("""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'T *' WHEN 1 THEN 'T' WHEN 2 THEN 'const T &' WHEN 3 THEN 'T *' ELSE 'int' END AS type,
       CASE WHEN p_size % 3 = 0 THEN TRUE WHEN p_size % 3 = 1 THEN TRUE ELSE FALSE END AS same FROM part""")
def decayed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type texts normalised; names compared within a scope."""
    text = F.expr("case p_size % 5 when 0 then 'T [4]' when 1 then 'const  T' when 2 then 'const T &' when 3 then 'T * const' else 'volatile int' end")
    a = F.expr("case p_size % 3 when 0 then 'b::c' when 1 then 'c' else 'x::c' end")
    return table(spark, sf_dir, "part").select("p_partkey", resolve.decayed(text).alias("type"), resolve.same_name_in_context(a, F.lit("b::c"), F.lit("a::b")).alias("same"))


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER w - 1 AS index, row_number() OVER w = 1 AS first, lead(1) OVER w IS NULL AS last
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)""")
def iteration_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    out = order.iteration_variables(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")])
    return out.select("l_orderkey", "l_linenumber", F.col("index").cast("bigint").alias("index"), "first", "last")


@query("SELECT event_type, user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def first_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each (type, user)."""
    return order.first_entry(table(spark, sf_dir, "events"), ["event_type", "user_id"], [F.col("ts"), F.col("event_id")]).select("event_type", "user_id", "event_id")


@query("""
SELECT r_name AS scope, CASE WHEN c_acctbal < 0 THEN 'static-functions' WHEN c_mktsegment = 'BUILDING' THEN 'functions' ELSE 'variables' END AS grp, count(*) AS n
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2""")
def tranches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: members of a region by group."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    kids = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.when((F.col("c_mktsegment") == "BUILDING") | (F.col("c_acctbal") < 0), "function").otherwise("variable").alias("kind"), F.lit(None).cast("string").alias("access"), (F.col("c_acctbal") < 0).alias("is_static"), F.lit(None).cast("string").alias("name"))
    tops = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("namespace").alias("kind"), F.lit(None).cast("string").alias("access"), F.lit(False).alias("is_static"), F.col("r_name").alias("name"))
    t = filters.assign_tranches(kids.union(tops))
    return t.join(tops.select(F.col("id").alias("k"), F.col("name").alias("scope")), F.col("parent_id") == F.col("k")).groupBy("scope", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH op(k, operator, readable, short) AS (VALUES (0, 'operator+', 'Unary plus', 'pl'), (1, 'operator==', 'Equality', 'eq'), (2, 'operator*', 'Dereference', 'ml'), (3, 'operator()', 'Function call', 'cl'))
SELECT p_partkey, CASE WHEN p_size % 3 = 2 AND k = 0 THEN 'Addition' WHEN p_size % 3 = 2 AND k = 2 THEN 'Multiplication' ELSE readable END AS readable_name, short AS short_name
FROM part JOIN op ON k = p_partkey % 4""")
def operator_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator dimension by (operator, arity)."""
    op = F.expr("case p_partkey % 4 when 0 then 'operator+' when 1 then 'operator==' when 2 then 'operator*' else 'operator()' end")
    p = table(spark, sf_dir, "part").select("p_partkey", op.alias("operator"), (F.col("p_size") % 3).alias("param_count"))
    return names.with_operator_names(p).select("p_partkey", "readable_name", "short_name")


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'def' WHEN o_totalprice > 150000 THEN 'second' ELSE 'first' END AS loc FROM orders""")
def primary_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition if preferred, else the first documented declaration, else the
    first."""
    loc = lambda n, d: F.struct(F.lit(n).alias("path"), d.alias("documented"))
    decl = F.array(loc("first", F.lit(False)), loc("second", F.col("o_totalprice") > 150000))
    chosen = filters.primary_location(loc("def", F.lit(True)), decl, F.col("o_orderstatus") == "F")
    return table(spark, sf_dir, "orders").select("o_orderkey", chosen["path"].alias("loc"))


@query("""
SELECT parent_kind, count(*) AS n, bool_and(kind = 'namespace') AS only_namespaces
FROM (SELECT 'region' AS parent_kind, 'namespace' AS kind FROM nation UNION ALL SELECT 'nation', 'record' FROM customer) GROUP BY 1""")
def namespace_only_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    from tomeflow.operators.rollup import only_namespaces

    rows = table(spark, sf_dir, "nation").select(F.lit("region").alias("parent_id"), F.lit("namespace").alias("kind")).union(table(spark, sf_dir, "customer").select(F.lit("nation"), F.lit("record")))
    return only_namespaces(rows).join(rows.groupBy("parent_id").agg(F.count(F.lit(1)).alias("n")), "parent_id").select(F.col("parent_id").alias("parent_kind"), "n", "only_namespaces")


@query("""
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def undocumented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit("record").alias("kind"), F.lit(0).alias("extraction"))
    lacking, _ = filters.undocumented(d, table(spark, sf_dir, "labels"), id_col="doc_id", doc_id_col="doc_id")
    return lacking.select("doc_id")


@query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) >= 2")
def duplicate_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return lint.duplicates(table(spark, sf_dir, "conversations"), ["conv_id", "role"])


PARAM_SQL = """
WITH p AS (SELECT l_orderkey AS func_id, CASE WHEN l_linenumber <= 3 THEN l_linenumber - 1 ELSE l_linenumber * 3 - 1 END AS pos, CASE WHEN l_quantity > 45 THEN '' ELSE 'p' || l_linenumber END AS name FROM lineitem),
d AS (SELECT l_orderkey AS func_id, 'p' || (l_linenumber + (l_partkey % 11 = 0)::INT) AS name FROM lineitem WHERE l_returnflag <> 'A')"""


def _params(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf_dir, "lineitem")
    p = l.select(F.col("l_orderkey").alias("func_id"), F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber") - 1).otherwise(F.col("l_linenumber") * 3 - 1).alias("pos"), F.when(F.col("l_quantity") > 45, "").otherwise(F.concat(F.lit("p"), "l_linenumber")).alias("name"))
    d = l.where("l_returnflag <> 'A'").select(F.col("l_orderkey").alias("func_id"), F.concat(F.lit("p"), (F.col("l_linenumber") + (F.col("l_partkey") % 11 == 0).cast("int")).cast("string")).alias("name"))
    return p, d


@query(PARAM_SQL + """
SELECT 'missing' AS rule, func_id, name FROM (SELECT DISTINCT func_id, name FROM p WHERE name <> '' EXCEPT SELECT func_id, name FROM d)
UNION ALL SELECT 'unknown', func_id, name FROM (SELECT DISTINCT func_id, name FROM d EXCEPT SELECT func_id, name FROM p)""")
def param_doc_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and unknown parameter docs."""
    return lint.param_faults(*_params(spark, sf_dir))


@query(PARAM_SQL + """
, dd AS (SELECT DISTINCT func_id, name FROM d), m AS (SELECT func_id, count(*) AS m FROM dd GROUP BY 1)
SELECT p.func_id, bool_and(dd.name IS NOT NULL) AND count(*) = coalesce(min(m), 0) AS complete
FROM p LEFT JOIN dd USING (func_id, name) LEFT JOIN m ON m.func_id = p.func_id WHERE p.name <> '' GROUP BY p.func_id""")
def complete_param_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return lint.complete_params(*_params(spark, sf_dir))


LINT_SQL = PARAM_SQL + """
, s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'enum-constant' ELSE 'function' END AS kind, o_orderpriority AS name, o_orderkey % 2 = 0 AS has_doc,
               o_orderkey % 5 AS extraction, o_custkey % 3 = 0 AS deleted, 'q::' || o_orderpriority AS qn, CASE WHEN o_orderkey % 3 = 0 THEN 'void' ELSE 'int' END AS rt, 'f' || (o_custkey % 50) AS full_path, o_custkey AS line, 1 AS col FROM orders),
f AS (SELECT * FROM s WHERE extraction = 0 AND has_doc AND kind = 'function'),
dup AS (SELECT func_id, name FROM d GROUP BY 1, 2 HAVING count(*) > 1),
unk AS (SELECT DISTINCT func_id, name FROM d EXCEPT SELECT func_id, name FROM p),
mis AS (SELECT DISTINCT func_id, name FROM p WHERE name <> '' EXCEPT SELECT func_id, name FROM d),
brk AS (SELECT s.*, 'ref' || (l_partkey % 20) AS literal, row_number() OVER (PARTITION BY 'ref' || (l_partkey % 20), name ORDER BY full_path, line, col, id) AS r
        FROM lineitem JOIN s ON s.id = l_orderkey WHERE l_partkey % 4 = 0),
w AS (
    SELECT 'undocumented' AS rule, full_path, line, name || ': Symbol is undocumented' AS message FROM s WHERE NOT has_doc AND extraction = 0 AND kind <> 'enum-constant'
    UNION ALL SELECT 'duplicate-param', full_path, line, qn || ': Duplicate parameter documentation for ''' || dup.name || '''' FROM dup JOIN f ON id = func_id
    UNION ALL SELECT 'unknown-param', full_path, line, qn || ': Documented parameter ''' || unk.name || ''' does not exist' FROM unk JOIN f ON id = func_id
    UNION ALL SELECT 'missing-param', full_path, line, qn || ': Missing documentation for parameter ''' || mis.name || '''' FROM mis JOIN f ON id = func_id WHERE NOT deleted
    UNION ALL SELECT 'missing-return', full_path, line, qn || ': Missing documentation for return value' FROM f WHERE NOT deleted AND rt <> 'void' AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)
    UNION ALL SELECT 'undocumented-enum-value', full_path, line, qn || ': Missing documentation for enum value' FROM s WHERE extraction = 0 AND NOT has_doc AND kind = 'enum-constant'
    UNION ALL SELECT 'unnamed-param', full_path, line, qn || ': ' || CASE pos + 1 WHEN 1 THEN '1st' WHEN 2 THEN '2nd' WHEN 3 THEN '3rd' ELSE (pos + 1) || 'th' END || ' parameter is unnamed' FROM p JOIN f ON id = func_id WHERE p.name = ''
    UNION ALL SELECT 'broken-reference', full_path, line, name || ': Failed to resolve reference to ''' || literal || '''' FROM brk WHERE r = 1
)"""


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = _params(spark, sf_dir)
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 9 == 0, "enum-constant").otherwise("function").alias("kind"), F.col("o_orderpriority").alias("name"), (k % 2 == 0).alias("has_doc"), (k % 5).alias("extraction"), (F.col("o_custkey") % 3 == 0).alias("is_deleted"), F.concat(F.lit("q::"), "o_orderpriority").alias("qualified_name"),
        F.when(k % 3 == 0, "void").otherwise("int").alias("return_type"), F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("full_path"), F.col("o_custkey").alias("line"), F.lit(1).alias("col"),
    )
    l = table(spark, sf_dir, "lineitem")
    returns = l.where("l_linenumber = 4").select(F.col("l_orderkey").alias("func_id"))
    refs = l.select(F.col("l_orderkey").alias("symbol_id"), F.concat(F.lit("ref"), (F.col("l_partkey") % 20).cast("string")).alias("literal"), F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey")).alias("target_id"))
    return lint.lint(s, p, d, returns, refs)


@query(LINT_SQL + " SELECT rule, full_path, line, message FROM w")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lint rules; T6 is the order a report prints them in."""
    return order.warning_order(_diagnostics(spark, sf_dir)).select("rule", "full_path", "line", "message")


@query(LINT_SQL + " SELECT count(DISTINCT message) AS messages, 0::BIGINT AS errors, count(DISTINCT message) AS warnings FROM w")
def diagnostic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    from tomeflow.operators.rollup import diagnostic_totals as totals

    return totals(_diagnostics(spark, sf_dir))


@query(LINT_SQL + """
, g AS (SELECT full_path, line, list(message ORDER BY list_position(['undocumented', 'duplicate-param', 'unknown-param', 'missing-param', 'missing-return', 'undocumented-enum-value', 'unnamed-param', 'broken-reference'], rule), message) AS m FROM w GROUP BY 1, 2)
SELECT full_path, line, md5(array_to_string(list_transform(range(1, len(m) + 1), lambda i: i || ') ' || m[i]), chr(10))) AS messages FROM g""")
def grouped_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of a location in order of emission, repeated ones too, numbered."""
    g = lint.grouped_warnings(_diagnostics(spark, sf_dir))
    return g.select("full_path", "line", F.md5(F.array_join("messages", "\n")).alias("messages"))
