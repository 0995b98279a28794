"""Queries over the scope tree region -> nation -> customer -> order: qualified
names, extraction modes, roll-ups, name resolution, inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tomeflow.core import table
from tomeflow.functions.names import EXTRACTION, enum_name
from tomeflow.operators import filters, hierarchy, inherit, order, resolve, rollup
from tomeflow.plans.registry import query

RULES = filters.SymbolRules(include=["A*::**"], see_below=["*::NATION_1*"], implementation_defined=["*::*::Customer#*7"])

TREE_SQL = """
tree AS (
    SELECT 'r:' || r_regionkey AS id, NULL AS parent_id, 'namespace' AS kind, r_name AS name FROM region
    UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'namespace', n_name FROM nation
    UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'record', c_name FROM customer
    UNION ALL SELECT 'o:' || o_orderkey, 'c:' || o_custkey, 'function', o_orderpriority FROM orders
)"""


def scope_tree(spark: SparkSession, sf_dir: str, orders: bool = True) -> DataFrame:
    """Symbols (id, parent_id, kind, name)."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    row = lambda df, i, p, k, n: df.select(i.alias("id"), p.alias("parent_id"), F.lit(k).alias("kind"), F.col(n).alias("name"))
    out = row(t("region"), key("r:", "r_regionkey"), F.lit(None).cast("string"), "namespace", "r_name")
    out = out.union(row(t("nation"), key("n:", "n_nationkey"), key("r:", "n_regionkey"), "namespace", "n_name"))
    out = out.union(row(t("customer"), key("c:", "c_custkey"), key("n:", "c_nationkey"), "record", "c_name"))
    if orders:
        out = out.union(row(t("orders"), key("o:", "o_orderkey"), key("c:", "o_custkey"), "function", "o_orderpriority"))
    return out


NAMES_SQL = TREE_SQL + """,
l0 AS (SELECT id, parent_id, kind, name AS q, 0 AS depth FROM tree WHERE parent_id IS NULL),
l1 AS (SELECT t.id, t.parent_id, t.kind, p.q || '::' || t.name AS q, 1 AS depth FROM tree t JOIN l0 p ON t.parent_id = p.id),
l2 AS (SELECT t.id, t.parent_id, t.kind, p.q || '::' || t.name AS q, 2 AS depth FROM tree t JOIN l1 p ON t.parent_id = p.id),
l3 AS (SELECT t.id, t.parent_id, t.kind, p.q || '::' || t.name AS q, 3 AS depth FROM tree t JOIN l2 p ON t.parent_id = p.id),
named AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)"""


@query("WITH " + NAMES_SQL + " SELECT id, q AS qualified_name, depth FROM named")
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, P8."""
    return hierarchy.qualified_names(scope_tree(spark, sf_dir))


MODES_SQL = NAMES_SQL + """,
own AS (
    SELECT *, CASE WHEN regexp_matches(q, '^[^:]*::[^:]*::Customer#[^:]*7$') THEN 2
                   WHEN regexp_matches(q, '^[^:]*::NATION_1[^:]*$') THEN 1
                   WHEN regexp_matches(q, '^A[^:]*::.*$') THEN 0 END AS own
    FROM named
),
m1 AS (
    SELECT o.id, o.parent_id, coalesce(o.own, min(c.own), 3) AS mode, o.own IS NULL AS apart
    FROM own o LEFT JOIN own c ON c.parent_id = o.id WHERE o.depth = 1 GROUP BY o.id, o.parent_id, o.own
),
m0 AS (SELECT o.id, coalesce(min(b.mode), 3) AS mode FROM own o LEFT JOIN m1 b ON b.parent_id = o.id WHERE o.depth = 0 GROUP BY o.id),
m2 AS (
    SELECT o.id, o.parent_id,
           CASE WHEN p.apart THEN coalesce(o.own, 3) WHEN o.own = 2 OR p.mode = 2 THEN 2 WHEN o.own = 1 OR p.mode = 1 THEN 1
                WHEN o.own = 0 THEN 0 ELSE p.mode END AS mode
    FROM own o JOIN m1 p ON o.parent_id = p.id WHERE o.depth = 2
),
m3 AS (
    SELECT o.id, o.parent_id,
           CASE WHEN o.own = 2 OR p.mode = 2 THEN 2 WHEN o.own = 1 THEN 1 WHEN p.mode = 1 THEN 3 WHEN o.own = 0 THEN 0 ELSE p.mode END AS mode
    FROM own o JOIN m2 p ON o.parent_id = p.id WHERE o.depth = 3
),
modes AS (SELECT id, mode FROM m0 UNION ALL SELECT id, mode FROM m1 UNION ALL SELECT id, mode FROM m2 UNION ALL SELECT id, mode FROM m3)"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = scope_tree(spark, sf_dir)
    names = hierarchy.qualified_names(tree).select("id", "qualified_name")
    return filters.classify(tree.join(names, "id"), RULES)


@query("WITH " + MODES_SQL + """
SELECT kind, CASE mode WHEN 0 THEN 'regular' WHEN 1 THEN 'see-below' WHEN 2 THEN 'implementation-defined' ELSE 'dependency' END AS mode, count(*) AS n
FROM modes JOIN tree USING (id) GROUP BY ALL""")
def modes_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: F1, F4-F9, F10-F12, G1, G2, G6, A13, P11."""
    counts = rollup.counts_by_mode(classified(spark, sf_dir))
    return counts.select("kind", enum_name(F.col("extraction"), EXTRACTION).alias("mode"), "n")


@query("WITH " + MODES_SQL + """, s AS (
    SELECT m.id, m.mode, t.kind, try_cast(substr(m.id, 3) AS BIGINT) AS k, CASE WHEN t.kind = 'record' THEN t.parent_id END AS nation FROM modes m JOIN tree t USING (id) WHERE t.kind <> 'function'
), f AS (
    SELECT *, CASE WHEN kind <> 'record' THEN true WHEN k % 7 = 0 THEN k % 2 = 0 ELSE k % 11 <> 0 AND k % 13 <> 0 END AS type_ok,
           kind <> 'record' OR (nation <> 'n:3' AND k % 10 <> 5 AND k % 4 <> 3) AS file_ok FROM s
)
SELECT kind, CASE WHEN type_ok AND file_ok THEN mode ELSE 3 END AS extraction, count(*) AS n FROM f GROUP BY ALL""")
def classified_with_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, types (private, anonymous and implicit records) and files (a folder
    and a name excluded, an unknown ending) together."""
    tree = scope_tree(spark, sf_dir, orders=False)
    names = hierarchy.qualified_names(tree).select("id", "qualified_name")
    k, record = F.expr("try_cast(substring(id, 3) as bigint)"), F.col("kind") == "record"
    end = F.when(k % 4 == 3, ".ipp").otherwise(".hpp")
    path = F.when(record, F.concat(F.lit("/src/"), F.replace("parent_id", F.lit(":"), F.lit("")), F.lit("/c"), (k % 10).cast("string"), end)).otherwise("/src/all.hpp")
    flags = {"access": F.when(record & (k % 7 == 0), "private").when(record, "public"), "is_virtual": k % 2 == 0, "is_anonymous": record & (k % 13 == 0), "is_static": F.lit(False), "is_record_member": F.lit(False), "is_implicit": record & (k % 11 == 0), "full_path": path}
    rows = tree.join(names, "id").withColumns(flags)
    types_, files = filters.TypeRules(private_virtual=True), filters.FileRules(input=["/src"], exclude=["/src/n3"], exclude_patterns=["**/c5.*"])
    return rollup.counts_by_mode(filters.classify(rows, RULES, types_, files))


@query("WITH " + MODES_SQL + """
SELECT count(*) AS declarations, count(*) FILTER (mode = 0) AS regular, count(*) FILTER (mode = 1) AS see_below,
       count(*) FILTER (mode = 2) AS implementation_defined, count(*) FILTER (mode = 3) AS dependencies FROM modes""")
def extraction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11, S12."""
    return rollup.extraction_totals(classified(spark, sf_dir))


@query("WITH " + MODES_SQL + """
SELECT id, '/' || replace(lower(q), '::', '/') || '.html' AS url, '#' || replace(lower(q), '::', '-') AS anchor
FROM modes JOIN named USING (id) WHERE mode IN (0, 1) AND kind = 'record'""")
def visible_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, F14, P3."""
    shown = classified(spark, sf_dir).where(filters.visible_page()).where("kind = 'record'")
    path = F.split(F.lower("qualified_name"), "::")
    return shown.select("id", filters.page_url(path).alias("url"), filters.page_anchor(path).alias("anchor"))


@query("WITH " + NAMES_SQL + """
SELECT id, id AS ancestor, 0 AS dist FROM named
UNION ALL SELECT id, parent_id, 1 FROM named WHERE depth > 0
UNION ALL SELECT c.id, p.parent_id, 2 FROM named c JOIN named p ON c.parent_id = p.id WHERE c.depth > 1
UNION ALL SELECT o.id, n.parent_id, 3 FROM l3 o JOIN l2 c ON o.parent_id = c.id JOIN l1 n ON c.parent_id = n.id""")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    return hierarchy.ancestors(scope_tree(spark, sf_dir))


@query("""
WITH members AS (SELECT 'r:' || n_regionkey AS scope_id, 'n:' || n_nationkey AS child_id, n_name AS name FROM nation),
deep AS (SELECT m.scope_id, 'c:' || c_custkey AS child_id, c_name AS name FROM members m JOIN customer ON m.child_id = 'n:' || c_nationkey),
own AS (SELECT 'n:' || c_nationkey AS scope_id, 'c:' || c_custkey AS child_id, c_name AS name FROM customer),
a AS (SELECT *, 1 AS depth FROM members UNION ALL SELECT *, 1 FROM own UNION ALL SELECT *, 2 FROM deep)
SELECT scope_id, child_id, depth, row_number() OVER (PARTITION BY scope_id, depth ORDER BY name, child_id) AS idx FROM a""")
def traverse_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recursive, ordered traversal of every scope."""
    tree = scope_tree(spark, sf_dir, orders=False)
    members = tree.where("parent_id is not null").select("parent_id", F.lit("members").alias("grp"), F.lit(0).alias("pos"), F.col("id").alias("child_id"))
    return hierarchy.traverse(members, tree, ordered=True, skip_inherited=True, recursive=True).select("scope_id", "child_id", "depth", F.col("idx").cast("bigint").alias("idx"))


@query("WITH " + NAMES_SQL + ", " + """
kept AS (SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'),
c AS (SELECT DISTINCT t.parent_id AS id FROM tree t JOIN kept k ON t.id = k.id),
cc AS (SELECT t.* FROM tree t JOIN c ON t.id = c.id WHERE t.kind = 'record'),
nn AS (SELECT * FROM tree WHERE id IN (SELECT parent_id FROM cc)),
rr AS (SELECT * FROM tree WHERE id IN (SELECT parent_id FROM nn))
SELECT kind, count(*) AS n FROM (SELECT kind FROM cc UNION ALL SELECT kind FROM nn UNION ALL SELECT kind FROM rr UNION ALL SELECT 'function' FROM kept JOIN tree USING (id) WHERE parent_id IN (SELECT id FROM cc)) GROUP BY kind""")
def pruned_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only urgent orders stay; customers, nations and regions left empty go."""
    tree = scope_tree(spark, sf_dir).where("kind <> 'function' or name = '1-URGENT'").withColumn("has_doc", F.lit(False))
    return rollup.prune_empty(tree, ["namespace", "record"]).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


ROLL_SQL = """
WITH c AS (
    SELECT 'c:' || c_custkey AS id, 'n:' || c_nationkey AS parent_id,
           CASE WHEN c_acctbal < 0 THEN 3 WHEN c_mktsegment = 'BUILDING' THEN 1 WHEN c_mktsegment = 'MACHINERY' THEN 0 ELSE 2 END AS m FROM customer
), cf AS (SELECT * FROM c WHERE parent_id <> 'n:3' OR m = 2),
n AS (
    SELECT 'n:' || n_nationkey AS id, 'r:' || n_regionkey AS parent_id,
           CASE WHEN n_nationkey % 5 = 0 THEN 1 WHEN n_nationkey % 7 = 0 OR bool_or(m = 0) THEN 0 WHEN bool_and(m = 3) THEN 3 WHEN bool_and(m = 2) THEN 2 WHEN bool_or(m = 1) THEN 1 ELSE 0 END AS m
    FROM nation LEFT JOIN cf ON cf.parent_id = 'n:' || n_nationkey GROUP BY n_nationkey, n_regionkey
)
SELECT id, m AS extraction FROM n
UNION ALL
SELECT 'r:' || r_regionkey, CASE WHEN bool_or(m = 0) THEN 0 WHEN bool_and(m = 3) THEN 3 WHEN bool_and(m = 2) THEN 2 WHEN bool_or(m = 1) THEN 1 ELSE 0 END
FROM region LEFT JOIN n ON n.parent_id = 'r:' || r_regionkey GROUP BY r_regionkey"""


@query(ROLL_SQL)
def rolled_up_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation modes from their customers, region modes from nations; every
    fifth nation is see-below and stays so, every seventh is documented."""
    tree = scope_tree(spark, sf_dir, orders=False).join(table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), "c_custkey").alias("id"), "c_acctbal", "c_mktsegment"), "id", "left")
    number = F.when(F.startswith("id", F.lit("n:")), F.expr("try_cast(substring(id, 3) as int)"))
    m = F.when(F.col("kind") == "namespace", F.when(number % 5 == 0, 1).otherwise(0)).when(F.col("c_acctbal") < 0, 3).when(F.col("c_mktsegment") == "BUILDING", 1).when(F.col("c_mktsegment") == "MACHINERY", 0).otherwise(2)
    doc = number % 7 == 0
    rows = tree.select("id", "parent_id", "kind", F.coalesce(doc, F.lit(False)).alias("has_doc"), m.alias("extraction"))
    return rollup.roll_up_modes(rows.where("parent_id is null or parent_id <> 'n:3' or extraction = 2"))


@query("""
WITH ctx AS (SELECT 'c:' || c_custkey AS context_id, c_custkey % 6 AS ask, 'NATION_' || (c_custkey % 30) AS nation, r.r_name AS region, 'r:' || r.r_regionkey AS region_id, own.n_regionkey AS own_region
             FROM customer JOIN nation own ON own.n_nationkey = c_nationkey JOIN region r ON r.r_regionkey = c_custkey % 5),
x AS (SELECT *, CASE ask WHEN 0 THEN nation WHEN 1 THEN region WHEN 2 THEN region || '::' || nation WHEN 3 THEN '::' || region WHEN 4 THEN '::' || region || '::' || nation ELSE '::' || nation END AS name FROM ctx),
f AS (SELECT x.*, 'n:' || near.n_nationkey AS near_id, 'n:' || far.n_nationkey AS far_id
      FROM x LEFT JOIN nation near ON near.n_name = x.nation AND near.n_regionkey = x.own_region LEFT JOIN nation far ON far.n_name = x.nation AND 'r:' || far.n_regionkey = x.region_id)
SELECT context_id, name, CASE ask WHEN 0 THEN near_id WHEN 1 THEN region_id WHEN 2 THEN far_id WHEN 3 THEN region_id WHEN 4 THEN far_id END AS target_id,
       CASE ask WHEN 0 THEN CASE WHEN near_id IS NOT NULL THEN 2 END WHEN 1 THEN 3 WHEN 2 THEN CASE WHEN far_id IS NOT NULL THEN 3 END WHEN 3 THEN 0 WHEN 4 THEN CASE WHEN far_id IS NOT NULL THEN 0 END END AS dist
FROM f""")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers refer to nations and regions by bare names (the scopes around
    are tried outward, the global one at last), by names qualified from the global scope
    and by names that begin with '::'; a nation's bare name with '::' finds nothing."""
    tree = scope_tree(spark, sf_dir, orders=False).withColumn("is_inline", F.lit(False)).withColumn("scoped", F.lit(True))
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "region"), k % 5 == F.col("r_regionkey"))
    nation, region, top = F.concat(F.lit("NATION_"), (k % 30).cast("string")), F.col("r_name"), F.lit("::")
    names = F.array(nation, region, F.concat(region, top, nation), F.concat(top, region), F.concat(top, region, top, nation), F.concat(top, nation))
    refs = asked.select(F.concat(F.lit("c:"), "c_custkey").alias("context_id"), F.get(names, (k % 6).cast("int")).alias("name"))
    return resolve.resolve_scoped(refs, hierarchy.ancestors(tree), resolve.name_index(tree)).select("context_id", "name", "target_id", "dist")


INHERIT_SQL = """
WITH members AS (
    SELECT 's:' || s_suppkey AS rec, 's:' || s_suppkey || '/' || k AS child_id, CASE k WHEN 'name' THEN 'public' WHEN 'key' THEN 'private' ELSE 'protected' END AS access, k AS sig
    FROM supplier, (VALUES ('name'), ('key'), ('balance')) v(k)
    UNION ALL SELECT 'n:' || n_nationkey, 'n:' || n_nationkey || '/' || k, CASE k WHEN 'name' THEN 'public' WHEN 'key' THEN 'private' ELSE 'protected' END, k
    FROM nation, (VALUES ('name'), ('key'), ('flag')) v(k)
    UNION ALL SELECT 'r:' || r_regionkey, 'r:' || r_regionkey || '/' || k, 'public', k FROM region, (VALUES ('name'), ('area'), ('flag')) v(k)
),
edges AS (
    SELECT 's:' || s_suppkey AS d, 'n:' || s_nationkey AS b, CASE WHEN s_acctbal < 0 THEN 'protected' ELSE 'public' END AS acc, 0 AS pos FROM supplier
    UNION ALL SELECT 's:' || s_suppkey, 'r:' || (s_suppkey % 5), 'public', 1 FROM supplier
    UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'public', 0 FROM nation
),
one AS (
    SELECT e.d AS rec, m.child_id, CASE WHEN acc = 'public' THEN m.access ELSE 'protected' END AS access, m.sig, [pos] AS path, m.access AS was
    FROM edges e JOIN members m ON m.rec = e.b WHERE m.access <> 'private'
      AND NOT EXISTS (SELECT 1 FROM members o WHERE o.rec = e.d AND o.sig = m.sig AND o.access = CASE WHEN acc = 'public' THEN m.access ELSE 'protected' END)
),
two AS (
    SELECT e.d AS rec, m.child_id, CASE WHEN acc = 'public' THEN m.access ELSE 'protected' END AS access, m.sig, list_concat([pos], m.path) AS path, m.access AS was
    FROM edges e JOIN one m ON m.rec = e.b
    WHERE NOT EXISTS (SELECT 1 FROM members o WHERE o.rec = e.d AND o.sig = m.sig AND o.access = CASE WHEN acc = 'public' THEN m.access ELSE 'protected' END)
),
every AS (SELECT * FROM one UNION ALL SELECT * FROM two)
SELECT rec AS derived_id, child_id, access, sig AS name, len(path)::INT AS depth FROM every QUALIFY row_number() OVER (PARTITION BY rec, access, sig ORDER BY path[1], was <> 'public', child_id) = 1"""


def _bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    acc = F.when(F.col("s_acctbal") < 0, "protected").otherwise("public")
    a = s.select(F.concat(F.lit("s:"), "s_suppkey").alias("derived_id"), F.concat(F.lit("n:"), "s_nationkey").alias("base_id"), acc.alias("access"))
    return a.union(n.select(F.concat(F.lit("n:"), "n_nationkey"), F.concat(F.lit("r:"), "n_regionkey"), F.lit("public")))


@query(INHERIT_SQL)
def inherited_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers inherit from nations and then from a region, nations from regions."""

    def members(df: DataFrame, prefix: str, key: str, names: list[str], access: str) -> DataFrame:
        rec = F.concat(F.lit(prefix), key)
        rows = df.select(rec.alias("parent_id"), F.explode(F.array(*[F.lit(x) for x in names])).alias("name"))
        return rows.select("parent_id", F.concat("parent_id", F.lit("/"), "name").alias("child_id"), F.expr(access).alias("access"), F.lit("variable").alias("kind"), "name", F.lit("").alias("signature"), F.lit(None).cast("string").alias("func_class"))

    by = "case name when 'name' then 'public' when 'key' then 'private' else 'protected' end"
    rows = members(table(spark, sf_dir, "supplier"), "s:", "s_suppkey", ["name", "key", "balance"], by)
    rows = rows.union(members(table(spark, sf_dir, "nation"), "n:", "n_nationkey", ["name", "key", "flag"], by))
    rows = rows.union(members(table(spark, sf_dir, "region"), "r:", "r_regionkey", ["name", "area", "flag"], "'public'"))
    second = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("derived_id"), F.concat(F.lit("r:"), F.col("s_suppkey") % 5).alias("base_id"), F.lit("public").alias("access"), F.lit(1).alias("pos"))
    bases = _bases(spark, sf_dir).withColumn("pos", F.lit(0)).union(second)
    return inherit.base_members(bases, rows).select("derived_id", "child_id", "access", "name", "depth")


@query("""
WITH e AS (SELECT 's:' || s_suppkey AS d, 'n:' || s_nationkey AS b FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation)
SELECT d AS derived_id, b AS base_id FROM e UNION SELECT x.d, y.b FROM e x JOIN e y ON x.b = y.d""")
def transitive_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    return hierarchy.transitive(_bases(spark, sf_dir), "derived_id", "base_id")


@query("""
WITH e AS (SELECT 's:' || s_suppkey AS d, 'n:' || s_nationkey AS b, s_name AS name FROM supplier WHERE s_acctbal >= 0 AND s_suppkey % 5 <> 0
           UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, n_name FROM nation)
SELECT b AS base_id, array_to_string(list(d ORDER BY name, d), ',') AS derived FROM e GROUP BY b""")
def derived_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth supplier is a dependency, so not listed."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 5 == 0, 3).otherwise(0).alias("extraction"))
    symbols = s.unionByName(scope_tree(spark, sf_dir, orders=False).where("kind = 'namespace'").select("id", "name", F.lit(0).alias("extraction")))
    return inherit.derived_index(_bases(spark, sf_dir), symbols).select("base_id", F.array_join("derived", ",").alias("derived"))


@query("""
SELECT 's:' || s_suppkey AS derived_id, 'n:' || s_nationkey || '/m' AS child_id, n_nationkey % 2 = 1 AS copied,
       CASE WHEN n_nationkey % 2 = 1 THEN sha1('s:' || s_suppkey || '-n:' || s_nationkey || '/m') ELSE 'n:' || s_nationkey || '/m' END AS member_id
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def copied_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of odd nations are dependencies and are copied."""
    s = table(spark, sf_dir, "supplier")
    member = F.concat(F.lit("n:"), "s_nationkey", F.lit("/m"))
    inherited = s.select(F.concat(F.lit("s:"), "s_suppkey").alias("derived_id"), member.alias("child_id"), F.lit("public").alias("access"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), "n_nationkey", F.lit("/m")).alias("id"), F.when(F.col("n_nationkey") % 2 == 1, 3).otherwise(0).alias("extraction"))
    symbols = n.union(s.select(F.concat(F.lit("s:"), "s_suppkey"), F.lit(0)))
    return inherit.inherit(inherited, symbols).select("derived_id", "child_id", "copied", "member_id")


@query("""
WITH m AS (SELECT s_suppkey, s_nationkey, CASE s_nationkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS e, s_suppkey % 2 AS d FROM supplier)
SELECT 's:' || s_suppkey AS derived_id, sha1('s:' || s_suppkey || '-n:' || s_nationkey || '/m') AS member_id, CASE WHEN e = 3 THEN d ELSE e END::INT AS extraction FROM m""")
def copied_all_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members are copied; only dependencies take the derived record's mode."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    derived = F.concat(F.lit("s:"), "s_suppkey")
    inherited = s.select(derived.alias("derived_id"), F.concat(F.lit("n:"), "s_nationkey", F.lit("/m")).alias("child_id"), F.lit("public").alias("access"))
    own = n.select(F.concat(F.lit("n:"), "n_nationkey", F.lit("/m")).alias("id"), F.expr("case n_nationkey % 3 when 0 then 0 when 1 then 1 else 3 end").alias("extraction"))
    symbols = own.union(s.select(derived, (F.col("s_suppkey") % 2).cast("int")))
    return inherit.inherit(inherited, symbols, "copy-all").select("derived_id", "member_id", "extraction")


@query("""
WITH RECURSIVE a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 16 <> 0 THEN c_custkey - 1 END AS t FROM customer),
w AS (SELECT id, t, t AS cur FROM a WHERE t IS NOT NULL
      UNION ALL SELECT w.id, w.t, a.t FROM w JOIN a ON w.cur = a.id WHERE a.t IS NOT NULL)
SELECT id, min(cur) AS target_id FROM w GROUP BY id""")
def resolved_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of up to fifteen aliases, by pointer doubling."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 16 <> 0")
    return resolve.resolve_aliases(c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") - 1).alias("target_id")))


@query("""
SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN o_custkey * 2 END AS ref_id
FROM orders LEFT JOIN customer ON c_custkey = o_custkey * 2""")
def cleaned_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to missing customers become null."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("ref_id"))
    return resolve.clean_references(o, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "ref_id")


@query("""
WITH e AS (SELECT DISTINCT o_custkey AS key, l_partkey * 2 AS ref FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT key, coalesce(array_to_string(list(ref ORDER BY ref) FILTER (p_partkey IS NOT NULL), ','), '') AS refs
FROM e LEFT JOIN part ON p_partkey = ref GROUP BY key""")
def cleaned_reference_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19, arrays: references to missing parts are dropped."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    refs = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("key")).agg(F.array_sort(F.collect_set(F.col("l_partkey") * 2)).alias("refs"))
    out = resolve.clean_reference_arrays(refs, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "key", "refs")
    return out.select("key", F.array_join("refs", ",").alias("refs"))


@query("WITH " + NAMES_SQL + """
SELECT id, row_number() OVER (ORDER BY r, n NULLS FIRST, c NULLS FIRST) - 1 AS idx FROM (
    SELECT id, id AS r, NULL AS n, NULL AS c FROM l0
    UNION ALL SELECT id, parent_id, id, NULL FROM l1
    UNION ALL SELECT l2.id, l1.parent_id, l1.id, l2.id FROM l2 JOIN l1 ON l2.parent_id = l1.id)""")
def depth_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-first page numbers. Ranges of the sort path are counted and then
    numbered apart, so no task holds all pages."""
    from tomeflow.operators.numbering import global_number

    pages = hierarchy.page_order(scope_tree(spark, sf_dir, orders=False), F.col("id"))
    return global_number(pages, F.array_join("sort_path", "\u0001"), "idx").select("id", "idx")


@query("""
SELECT c_custkey, rank, o_orderkey FROM (
    SELECT o_custkey AS c_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders)
WHERE rank <= 3""")
def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return order.top_k(o, ["c_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("c_custkey", F.col("rank").cast("bigint").alias("rank"), "o_orderkey")
