"""Queries on fact sheets: extraction, variants, trees, and stores. Sheets are made from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import patterns
from plumbline.operators import explain, facts, perturb, tree
from plumbline.plans.corpus import _FRAMED
from plumbline.session import table
from plumbline.sources import tables as stores

#: A small sample of adjacent provisions; the real table is a parameter of the operators.
ADJACENT = [("IPC-302", 0, "IPC-300"), ("IPC-302", 1, "IPC-304"), ("IPC-304", 0, "IPC-302"), ("IPC-34", 0, "IPC-149"), ("Const-21", 0, "Const-14"), ("Const-21", 1, "Const-19")]


def adjacency(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ADJACENT, "section string, pos int, neighbour string")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for every customer: party types by segment, sections and evidence by key, amounts from the balance."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    kinds = F.array(*[F.lit(x) for x in ("FIR", "MedicalReport", "Witness", "Confession")])
    item = lambda i: F.struct(F.element_at(kinds, ((k + i) % 4 + 1).cast("int")).alias("evidence_type"), F.concat(F.lit("item "), (k + i).cast("string")).alias("description"))
    sections = F.array(*[F.lit(x) for x in ("IPC-302", "IPC-34", "IPC-304", "Const-21", "IPC-999")])
    sheet = F.struct(
        F.concat(F.lit("case "), k.cast("string")).alias("case_id"),
        F.struct(
            F.element_at(F.array(*[F.lit(x) for x in ("Individual", "Tenant", "Unknown", "State")]), (k % 4 + 1).cast("int")).alias("petitioner_type"),
            F.when(k % 3 == 0, F.lit("UnionOfIndia")).when(k % 3 == 1, F.lit("Minor")).alias("respondent_type"),
        ).alias("parties"),
        F.slice(F.array(item(0), item(1), item(1)), F.lit(1), (k % 4).cast("int")).alias("evidence_items"),
        F.slice(sections, (k % 3 + 1).cast("int"), (k % 4).cast("int")).alias("sections_cited"),
        F.struct(
            F.array(F.struct(F.abs(F.round("c_acctbal", 0)).alias("value"), F.lit("rupees").alias("unit"), F.lit("paid").alias("context"))).alias("amounts"),
            F.array(F.struct((k % 70 + 1).alias("value"), F.lit("years old").alias("descriptor"))).alias("ages"),
            F.array(F.struct((k % 9 + 1).cast("double").alias("value"), F.lit("years").alias("unit"), F.lit("in custody").alias("context"))).alias("durations"),
        ).alias("numerical_facts"),
        F.when(k % 5 > 0, F.element_at(F.array(F.lit("Allowed"), F.lit("Dismissed")), (k % 2 + 1).cast("int"))).alias("outcome"),
    )
    return c.select(k.alias("tree_id"), F.lit(0).cast("long").alias("node_id"), sheet.cast(facts.SHEET).alias("sheet"))


def qry1_sentences(spark, sf_dir):
    return sheets(spark, sf_dir).select("tree_id", facts.query_sentence(F.col("sheet")).alias("query"))


def fe6_rule_sheets(spark, sf_dir):
    from plumbline.plans.corpus import framed

    got = facts.extract_sheets(framed(spark, sf_dir).withColumnRenamed("text", "facts"))
    n = "sheet.numerical_facts"
    return got.select(
        "doc_id", F.col("sheet.case_id").alias("case_id"), F.array_join("sheet.sections_cited", ",").alias("sections"), F.col(f"{n}.amounts")[0]["value"].alias("amount"),
        F.col(f"{n}.ages")[0]["value"].alias("age"), F.size(f"{n}.amounts").alias("n_amounts"), F.array_join(F.transform("sheet.evidence_items", lambda e: e["evidence_type"]), ",").alias("evidence"),
        F.col("sheet.outcome").alias("outcome"),
    )


def fe3_validators(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    raw = F.array(F.col("p_brand"), F.concat(F.lit(" IPC "), F.col("p_size").cast("string")), F.lit("IPC-302"), F.lit("see below"))
    party = F.when(F.col("p_size") % 3 == 0, F.lit("Tenant")).when(F.col("p_size") % 3 == 1, F.col("p_type"))
    return p.select("p_partkey", facts.valid_party(party).alias("party"), F.array_join(facts.valid_sections(raw), "|").alias("sections"))


def per2_amounts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    return rows.select("o_orderkey", F.posexplode(perturb.amount_targets(F.col("value"))).alias("pos", "target"))


def per3_ages(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + F.col("p_partkey") % 30).cast("long").alias("age"))
    spread = rows.select("p_partkey", "age", F.explode(perturb.age_targets(F.col("age"))).alias("target"))
    return spread.withColumn("crossed", perturb.first_crossed(perturb.p.AGE_LIMITS, F.col("age"), F.col("target")).cast("long"))


def per4_durations(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 4).alias("value"))
    return rows.select("l_orderkey", "l_linenumber", F.explode(perturb.duration_targets(F.col("value"))).alias("target")).distinct()


def _edges(found: DataFrame) -> DataFrame:
    return found.select("tree_id", "source_pos", "item_pos", "variant_pos", "edge.original_value", "edge.perturbed_value", "edge.description")


def per6_sections(spark, sf_dir):
    nodes = sheets(spark, sf_dir)
    got = perturb.section_candidates(nodes, perturb.spans_of(nodes), adjacency(spark))
    return got.select("tree_id", "source_pos", "edge.original_value", "edge.perturbed_value", F.array_join("sheet.sections_cited", ",").alias("sections"))


def per7_adjacent(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.element_at(F.array(F.lit("ipc 302"), F.lit("IPC-34"), F.lit("const-21"), F.lit("none")), (F.col("c_custkey") % 4 + 1).cast("int")).alias("section"))
    return perturb.adjacent(s, adjacency(spark))


def per8_party(spark, sf_dir):
    return _edges(perturb.party_candidates(sheets(spark, sf_dir)))


def per9_evidence(spark, sf_dir):
    got = perturb.evidence_candidates(sheets(spark, sf_dir))
    return _edges(got).withColumn("n_items", F.lit(0)).drop("n_items").join(got.select("tree_id", "item_pos", "variant_pos", F.size("sheet.evidence_items").alias("n_items")), ["tree_id", "item_pos", "variant_pos"])


def per11_candidates(spark, sf_dir):
    got = perturb.candidates(sheets(spark, sf_dir), adjacency(spark))
    return got.select("tree_id", "cand_pos", "edge.fact_type", "edge.original_value", "edge.perturbed_value", "edge.description")


def val4_stats(spark, sf_dir):
    return perturb.validation_stats(perturb.validated(perturb.candidates(sheets(spark, sf_dir), adjacency(spark))))


def lists_by_hash(nodes: DataFrame) -> DataFrame:
    """A stand-in search: twelve cases by the hash of the node's query sentence."""
    first = nodes.select("tree_id", "node_id", F.pmod(F.xxhash64(facts.query_sentence(F.col("sheet"))), F.lit(4)).alias("h"))  # once per node, not per case
    return first.select("tree_id", "node_id", "h", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("rank")).select(
        "tree_id", "node_id", "rank", (F.col("rank") + F.col("h")).cast("string").alias("case_id")
    )


def tre3_expanded(spark, sf_dir):
    """Trees of all customers at the operator's own depth and children."""
    nodes, _ = tree.expand(sheets(spark, sf_dir).select("tree_id", "sheet"), adjacency(spark), lists_by_hash)
    return nodes.select("tree_id", "node_id", "parent_id", "depth", "edge.description")


def tre5_depth(spark, sf_dir):
    """Depths in the binary tree of all nations' keys."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node_id"))
    return tree.depths(n.select("node_id", F.when(F.col("node_id") > 0, F.floor((F.col("node_id") - 1) / 2)).alias("parent_id"))).select("node_id", F.col("depth").cast("int").alias("depth"))


def tre6_depth_counts(spark, sf_dir):
    """Trees of all customers, two children down to depth two."""
    nodes, _ = tree.expand(sheets(spark, sf_dir).select("tree_id", "sheet"), adjacency(spark), None, max_depth=2, max_children=2)
    return tree.depth_counts(nodes)


def exp4_explanations(spark, sf_dir):
    s = sheets(spark, sf_dir)
    rows = s.select(
        "tree_id", F.col("sheet.sections_cited").alias("query_sections"), F.array(F.lit("IPC-304"), F.lit("Const-21")).alias("act_sections"),
        F.col("sheet.parties.petitioner_type").alias("petitioner"), F.col("sheet.parties.respondent_type").alias("respondent"),
        F.when(F.col("tree_id") % 2 == 0, "A tenant and a minor").otherwise("nothing here").alias("text"),
        F.when(F.col("tree_id") % 5 == 0, F.array(F.lit("rent"))).otherwise(F.array().cast("array<string>")).alias("terms"),
    )
    return explain.explain_results(rows).select("tree_id", "explanation")


def exp6_edge_summaries(spark, sf_dir):
    got = perturb.party_candidates(sheets(spark, sf_dir)).select("tree_id", "item_pos", "variant_pos", "edge.*")
    cases = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(F.lit("c"), i.cast("string")))
    some = lambda m: F.slice(cases, F.lit(1), (F.col("tree_id") % m).cast("int"))
    rows = got.withColumns({"dropped": some(8), "new": some(3), "dropped_cite_original": F.lit(False), "new_cite_perturbed": F.lit(False)})
    return explain.explain_edges(rows).select("tree_id", "item_pos", "variant_pos", "summary")


def src2_profile(spark, sf_dir):
    """The customers' columns."""
    c = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")))
    return stores.profile(c, place=F.col("c_custkey")).select("column", "n_null", "n_values", F.array_join("samples", "|").alias("samples"))


def flt1_filters(spark, sf_dir):
    from plumbline.operators.ranking import metadata_filter

    where = metadata_filter({"$and": [{"p_size": {"$gt": 10}}, {"$or": [{"p_brand": "Brand#12"}, {"p_type": {"$in": ["PROMO BRUSHED TIN"]}}, {"p_size": {"$lte": 20, "$ne": 15}}]}]})
    return table(spark, sf_dir, "part").where(where).select("p_partkey", "p_size", "p_brand")


def fe8_not_yet_stored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("case_id"))
    return facts.not_yet_stored(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id")))


def snk2_new_rows(spark, sf_dir):
    """Customers, each twice, whose key no supplier has."""
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chunk_id"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("chunk_id"), "c_name")
    return stores.new_rows(old, c.unionByName(c), "chunk_id")


def snk3_upsert(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chunk_id"), F.col("s_name").alias("name"))
    new = table(spark, sf_dir, "customer").where(F.col("c_nationkey") < 10).select(F.col("c_custkey").alias("chunk_id"), F.col("c_name").alias("name"))
    return stores.upserted(old, new, "chunk_id")


QUERIES = {
    f.__name__: f
    for f in (
        qry1_sentences, fe3_validators, fe6_rule_sheets, fe8_not_yet_stored, per2_amounts, per3_ages, per4_durations, per6_sections, per7_adjacent, per8_party, per9_evidence,
        per11_candidates, val4_stats, tre3_expanded, tre5_depth, tre6_depth_counts, exp4_explanations, exp6_edge_summaries, src2_profile, flt1_filters, snk2_new_rows, snk3_upsert,
    )
}

_PARTY = """
c AS (SELECT c_custkey AS tree_id, CASE c_custkey % 4 WHEN 0 THEN 'Individual' WHEN 1 THEN 'Tenant' WHEN 2 THEN 'Unknown' ELSE 'State' END AS p,
  CASE c_custkey % 3 WHEN 0 THEN 'UnionOfIndia' WHEN 1 THEN 'Minor' END AS r FROM customer),
axis AS (SELECT * FROM (VALUES (0, 'Individual', 'Minor'), (1, 'Employee', 'Contractor'), (2, 'Tenant', 'Licensee'), (3, 'Individual', 'Corporation'), (4, 'State', 'UnionOfIndia')) t(pos, a, b)),
swap AS (SELECT pos, a AS old, b AS new FROM axis UNION ALL SELECT pos, b, a FROM axis),
e AS (
  SELECT tree_id, 2 AS source_pos, 0 AS item_pos, pos AS variant_pos, 'petitioner=' || old AS original_value, 'petitioner=' || new AS perturbed_value,
    'Petitioner type changed from ' || old || ' to ' || new AS description FROM c JOIN swap ON old = p WHERE p <> 'Unknown'
  UNION ALL SELECT tree_id, 2, 1, pos, 'respondent=' || old, 'respondent=' || new, 'Respondent type changed from ' || old || ' to ' || new FROM c JOIN swap ON old = r)"""
_EVIDENCE = """
k AS (SELECT c_custkey AS tree_id, CAST(c_custkey % 4 AS INTEGER) AS n FROM customer),
i AS (SELECT tree_id, n, v, CASE (tree_id + CASE WHEN v = 0 THEN 0 ELSE 1 END) % 4 WHEN 0 THEN 'FIR' WHEN 1 THEN 'MedicalReport' WHEN 2 THEN 'Witness' ELSE 'Confession' END AS kind,
  'item ' || CAST(tree_id + CASE WHEN v = 0 THEN 0 ELSE 1 END AS VARCHAR) AS what FROM k CROSS JOIN (VALUES (0), (1), (2)) t(v) WHERE v < n)"""

ORACLES = {
    "qry1_sentences": """
WITH c AS (SELECT c_custkey AS k, abs(round(c_acctbal, 0)) AS bal FROM customer),
s AS (SELECT k, bal,
  CASE k % 4 WHEN 0 THEN 'Individual' WHEN 1 THEN 'Tenant' WHEN 2 THEN 'Unknown' ELSE 'State' END AS p,
  CASE k % 3 WHEN 0 THEN 'UnionOfIndia' WHEN 1 THEN 'Minor' ELSE 'respondent' END AS r,
  array_to_string((['IPC-302', 'IPC-34', 'IPC-304', 'Const-21', 'IPC-999'])[CAST(k % 3 + 1 AS INTEGER) : CAST(k % 3 + k % 4 AS INTEGER)], ', ') AS cited FROM c),
i AS (SELECT k, CASE (k + CASE WHEN v = 0 THEN 0 ELSE 1 END) % 4 WHEN 0 THEN 'FIR' WHEN 1 THEN 'MedicalReport' WHEN 2 THEN 'Witness' ELSE 'Confession' END AS kind FROM c CROSS JOIN (VALUES (0), (1), (2)) t(v) WHERE v < k % 4),
e AS (SELECT k, string_agg(kind, ', ' ORDER BY kind) AS kinds FROM (SELECT DISTINCT k, kind FROM i) GROUP BY k)
SELECT s.k AS tree_id, 'This case involves a ' || p || ' against the ' || r || '.' || CASE WHEN s.k % 4 > 0 THEN ' The relevant legal provisions are ' || cited || '.' ELSE '' END
  || coalesce(' Evidence includes ' || kinds || '.', '')
  || ' Key facts include ' || CAST(CAST(bal AS BIGINT) AS VARCHAR) || '.0 rupees (paid), age ' || CAST(s.k % 70 + 1 AS VARCHAR) || ' (years old), ' || CAST(s.k % 9 + 1 AS VARCHAR) || '.0 years (in custody).'
  || CASE WHEN s.k % 5 > 0 THEN ' The outcome was: ' || CASE s.k % 2 WHEN 0 THEN 'Allowed' ELSE 'Dismissed' END || '.' ELSE '' END AS query
FROM s LEFT JOIN e ON e.k = s.k
""",
    "fe3_validators": r"""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Tenant' WHEN p_size % 3 = 1 THEN 'Unknown' END AS party,
  CASE WHEN regexp_matches(p_brand, '^[A-Za-z]\w*-[0-9]') THEN p_brand ELSE p_brand END || '|IPC-' || CAST(p_size AS VARCHAR) || '|IPC-302|see below' AS sections FROM part
""",
    "exp4_explanations": """
WITH c AS (SELECT c_custkey AS k FROM customer),
s AS (SELECT k, CASE k % 4 WHEN 0 THEN 'Individual' WHEN 1 THEN 'Tenant' WHEN 2 THEN 'Unknown' ELSE 'State' END AS p, CASE k % 3 WHEN 0 THEN 'UnionOfIndia' WHEN 1 THEN 'Minor' END AS r,
  k % 2 = 0 AS told, (['IPC-302', 'IPC-34', 'IPC-304', 'Const-21', 'IPC-999'])[CAST(k % 3 + 1 AS INTEGER) : CAST(k % 3 + k % 4 AS INTEGER)] AS cited FROM c),
w AS (SELECT k, CASE WHEN k % 4 = 0 THEN '' ELSE concat_ws(', ', CASE WHEN list_contains(cited, 'Const-21') THEN 'Const-21' END, CASE WHEN list_contains(cited, 'IPC-304') THEN 'IPC-304' END) END AS shared,
  told AND p = 'Tenant' AS two, told AND r = 'Minor' AS three, p, r FROM s),
x AS (SELECT k, CASE WHEN shared <> '' THEN 'This case involves ' || shared || ', which is also cited in your case.' END AS a,
  CASE WHEN two THEN 'This case also involves a ' || p || ' as the petitioner.' END AS b, CASE WHEN three THEN 'This case also involves a ' || r || ' as the respondent.' END AS c,
  CASE WHEN k % 5 = 0 THEN 'This case shares similar factual patterns involving rent.' END AS d FROM w),
y AS (SELECT k, list_filter([a, b, c], lambda z: z IS NOT NULL) AS abc, d FROM x)
SELECT k AS tree_id, CASE WHEN len(abc) >= 2 THEN array_to_string(abc[1:2], ' ') WHEN len(abc) = 1 THEN abc[1] || coalesce(' ' || d, '')
  ELSE coalesce(d, 'This case was retrieved based on overall semantic similarity to your case.') END AS explanation FROM y
""",
    "per6_sections": """
WITH c AS (SELECT c_custkey AS tree_id, CASE WHEN c_custkey % 4 = 0 THEN [] ELSE (['IPC-302', 'IPC-34', 'IPC-304', 'Const-21', 'IPC-999'])[CAST(c_custkey % 3 + 1 AS INTEGER) : CAST(c_custkey % 3 + c_custkey % 4 AS INTEGER)] END AS cited FROM customer),
s AS (SELECT tree_id, cited, unnest(cited) AS own, unnest(range(1, len(cited) + 1)) AS i FROM c),
m AS (SELECT tree_id, cited, i, (SELECT o.own FROM s o WHERE o.tree_id = s.tree_id AND contains(o.own, regexp_extract(s.own, '[0-9]+[A-Za-z]?')) ORDER BY o.i LIMIT 1) AS section FROM s),
a AS (SELECT * FROM (VALUES ('IPC-302', 0, 'IPC-300'), ('IPC-302', 1, 'IPC-304'), ('IPC-304', 0, 'IPC-302'), ('IPC-34', 0, 'IPC-149'), ('Const-21', 0, 'Const-14'), ('Const-21', 1, 'Const-19')) t(section, pos, neighbour))
SELECT DISTINCT m.tree_id, 1 AS source_pos, m.section AS original_value, a.neighbour AS perturbed_value, array_to_string(list_transform(cited, lambda z: CASE WHEN z = m.section THEN a.neighbour ELSE z END), ',') AS sections
FROM m JOIN a ON a.section = m.section
""",
    "fe6_rule_sheets": rf"""
WITH {_FRAMED}, p AS (
  SELECT doc_id, text, regexp_extract_all(text, '(?i){patterns.FACT_SECTION}', 1) AS s, regexp_extract_all(text, '(?i){patterns.FACT_ARTICLE}', 1) AS a,
    regexp_extract_all(text, '(?i){patterns.FACT_AMOUNT}', 1) AS m, regexp_extract_all(text, '(?i){patterns.FACT_AGE}', 1) AS g FROM framed),
l AS (SELECT doc_id, list_concat(list_transform(s[1:10], lambda n: 'IPC-' || n), list_transform(a[1:5], lambda n: 'Constitution-Article-' || n)) AS l FROM p),
u AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM l) GROUP BY doc_id, x),
c AS (SELECT doc_id, string_agg(x, ',' ORDER BY i) AS sections FROM u GROUP BY doc_id),
n AS (SELECT doc_id, list_filter(list_transform(m, lambda x: replace(x, ',', '')), lambda x: x <> '') AS m FROM p)
SELECT p.doc_id, coalesce(nullif(regexp_extract(text, '(?i){patterns.FACT_CASE}'), ''), 'unknown') AS case_id, coalesce(c.sections, '') AS sections, CAST(n.m[1] AS DOUBLE) AS amount, CAST(g[1] AS BIGINT) AS age, CAST(len(n.m) AS INTEGER) AS n_amounts,
  concat_ws(',', {", ".join(f"CASE WHEN regexp_matches(text, '(?i){x}') THEN '{kind}' END" for kind, _, x in patterns.FACT_EVIDENCE)}) AS evidence,
  CASE {" ".join(f"WHEN regexp_matches(text, '(?i){x}') THEN '{label}'" for label, x in patterns.FACT_OUTCOMES)} END AS outcome
FROM p LEFT JOIN c ON c.doc_id = p.doc_id JOIN n ON n.doc_id = p.doc_id
""",
    "fe8_not_yet_stored": "SELECT doc_id AS case_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "per2_amounts": """
WITH t AS (SELECT * FROM (VALUES (25000.0), (100000.0), (500000.0), (1000000.0), (10000000.0), (100000000.0)) t(x)),
o AS (SELECT o_orderkey, o_totalprice AS v FROM orders),
a AS (SELECT DISTINCT o_orderkey, v, CAST(CASE WHEN v < x THEN x + 1 ELSE greatest(1.0, x - 1) END AS DOUBLE) AS target FROM o CROSS JOIN t
  UNION SELECT o_orderkey, v, v * 2 FROM o UNION SELECT o_orderkey, v, v / 2 FROM o WHERE v > 2)
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY target) - 1 AS INTEGER) AS pos, target FROM a WHERE target <> v
""",
    "per3_ages": """
WITH p AS (SELECT p_partkey, CAST(p_size + p_partkey % 30 AS BIGINT) AS age FROM part), b AS (SELECT * FROM (VALUES (7), (12), (18), (21), (60)) t(x)),
t AS (SELECT DISTINCT p_partkey, age, CAST(CASE WHEN age >= x THEN x - 1 ELSE x END AS BIGINT) AS target FROM p CROSS JOIN b)
SELECT p_partkey, age, target, CAST(min(CASE WHEN (age >= x) <> (target >= x) THEN x END) AS BIGINT) AS crossed FROM t CROSS JOIN b WHERE target <> age GROUP BY p_partkey, age, target
""",
    "per4_durations": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity / 4 AS v FROM lineitem), b AS (SELECT * FROM (VALUES (1.0), (3.0), (6.0), (12.0)) t(x)),
t AS (SELECT l_orderkey, l_linenumber, v, CAST(CASE WHEN v < x THEN x + 0.5 ELSE greatest(0.5, x - 0.5) END AS DOUBLE) AS target FROM l CROSS JOIN b
  UNION SELECT l_orderkey, l_linenumber, v, v * 2 FROM l UNION SELECT l_orderkey, l_linenumber, v, v / 2 FROM l WHERE v > 0.5)
SELECT DISTINCT l_orderkey, l_linenumber, target FROM t WHERE target <> v
""",
    "per11_candidates": f"""
WITH {_PARTY}, {_EVIDENCE},
g AS (SELECT c_custkey AS tree_id, CAST(c_custkey % 70 + 1 AS BIGINT) AS age FROM customer), b AS (SELECT * FROM (VALUES (7), (12), (18), (21), (60)) t(x)),
t AS (SELECT DISTINCT tree_id, age, CAST(CASE WHEN age >= x THEN x - 1 ELSE x END AS BIGINT) AS target FROM g CROSS JOIN b),
y AS (SELECT tree_id, age, target, min(CASE WHEN (age >= x) <> (target >= x) THEN x END) AS crossed FROM t CROSS JOIN b WHERE target <> age GROUP BY tree_id, age, target),
cc AS (SELECT c_custkey AS tree_id, CASE WHEN c_custkey % 4 = 0 THEN [] ELSE (['IPC-302', 'IPC-34', 'IPC-304', 'Const-21', 'IPC-999'])[CAST(c_custkey % 3 + 1 AS INTEGER) : CAST(c_custkey % 3 + c_custkey % 4 AS INTEGER)] END AS cited FROM customer),
cs AS (SELECT tree_id, unnest(cited) AS own, unnest(range(1, len(cited) + 1)) AS i FROM cc),
cm AS (SELECT tree_id, i, (SELECT o.own FROM cs o WHERE o.tree_id = cs.tree_id AND contains(o.own, regexp_extract(cs.own, '[0-9]+[A-Za-z]?')) ORDER BY o.i LIMIT 1) AS section FROM cs),
adj AS (SELECT * FROM (VALUES ('IPC-302', 0, 'IPC-300'), ('IPC-302', 1, 'IPC-304'), ('IPC-304', 0, 'IPC-302'), ('IPC-34', 0, 'IPC-149'), ('Const-21', 0, 'Const-14'), ('Const-21', 1, 'Const-19')) t(section, pos, neighbour)),
sec AS (SELECT cm.tree_id, min(i) AS i, adj.pos, adj.section, adj.neighbour FROM cm JOIN adj ON adj.section = cm.section GROUP BY cm.tree_id, adj.pos, adj.section, adj.neighbour),
m AS (SELECT * FROM (VALUES (0, 'DyingDeclaration'), (1, 'Confession'), (2, 'MedicalReport')) t(p, kind)),
new AS (SELECT k.tree_id, m.kind, row_number() OVER (PARTITION BY k.tree_id ORDER BY m.p) - 1 AS v FROM k CROSS JOIN m WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.tree_id = k.tree_id AND i.kind = m.kind)),
u AS (
  SELECT tree_id, 0 AS s, 0 AS i, row_number() OVER (PARTITION BY tree_id ORDER BY target) AS v, 'Numerical' AS fact_type, 'age=' || CAST(age AS VARCHAR) AS original_value, 'age=' || CAST(target AS VARCHAR) AS perturbed_value,
    'Age changed from ' || CAST(age AS VARCHAR) || ' to ' || CAST(target AS VARCHAR) || coalesce(' (crossed boundary at ' || CAST(crossed AS VARCHAR) || ')', '') AS description FROM y
  UNION ALL SELECT tree_id, 1, i, pos, 'Section', section, neighbour, 'Section changed from ' || section || ' to ' || neighbour FROM sec
  UNION ALL SELECT tree_id, 2, item_pos, variant_pos, 'PartyType', original_value, perturbed_value, description FROM e
  UNION ALL SELECT tree_id, 3, 0, v, 'Evidence', 'present:' || kind, 'removed:' || kind, 'Evidence removed: ' || kind || ' (' || what || ')' FROM i
  UNION ALL SELECT tree_id, 3, 1, v, 'Evidence', 'absent:' || kind, 'added:' || kind, 'Evidence added: ' || kind FROM new)
SELECT tree_id, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY s, i, v) AS INTEGER) AS cand_pos, fact_type, original_value, perturbed_value, description FROM u
""",
    "per7_adjacent": """
SELECT * FROM (VALUES ('ipc 302', 0, 'IPC-300'), ('ipc 302', 1, 'IPC-304'), ('IPC-34', 0, 'IPC-149'), ('const-21', 0, 'Const-14'), ('const-21', 1, 'Const-19')) t(section, pos, neighbour)
""",
    "per8_party": f"WITH {_PARTY} SELECT tree_id, source_pos, item_pos, variant_pos, original_value, perturbed_value, description FROM e",
    "per9_evidence": f"""
WITH {_EVIDENCE}, m AS (SELECT * FROM (VALUES (0, 'DyingDeclaration'), (1, 'Confession'), (2, 'MedicalReport')) t(p, kind)),
a AS (SELECT k.tree_id, k.n, m.kind, row_number() OVER (PARTITION BY k.tree_id ORDER BY m.p) - 1 AS v FROM k CROSS JOIN m WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.tree_id = k.tree_id AND i.kind = m.kind))
SELECT tree_id, 3 AS source_pos, 0 AS item_pos, CAST(v AS INTEGER) AS variant_pos, 'present:' || kind AS original_value, 'removed:' || kind AS perturbed_value, 'Evidence removed: ' || kind || ' (' || what || ')' AS description, n - 1 AS n_items FROM i
UNION ALL SELECT tree_id, 3, 1, CAST(v AS INTEGER), 'absent:' || kind, 'added:' || kind, 'Evidence added: ' || kind, n + 1 FROM a
""",
    "tre6_depth_counts": """
SELECT c_custkey AS tree_id, depth, CAST(power(2, depth) AS BIGINT) AS n FROM customer CROSS JOIN (VALUES (0), (1), (2)) t(depth)
""",
    "tre5_depth": """
WITH RECURSIVE n AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey > 0 THEN CAST((n_nationkey - 1) // 2 AS BIGINT) END AS up FROM nation),
d AS (SELECT id, 0 AS depth FROM n WHERE up IS NULL UNION ALL SELECT n.id, d.depth + 1 FROM n JOIN d ON n.up = d.id)
SELECT id AS node_id, depth FROM d
""",
    "exp6_edge_summaries": f"""
WITH {_PARTY}, x AS (SELECT *, CAST(tree_id % 8 AS INTEGER) AS d, CAST(tree_id % 3 AS INTEGER) AS w FROM e),
l AS (SELECT * FROM (VALUES (0, ''), (1, 'c1'), (2, 'c1, c2'), (3, 'c1, c2, c3'), (4, 'c1, c2, c3, c4'), (5, 'c1, c2, c3, c4, c5'), (6, 'c1, c2, c3, c4, c5 (and 1 more)'), (7, 'c1, c2, c3, c4, c5 (and 2 more)')) t(n, s))
SELECT tree_id, item_pos, variant_pos, CASE WHEN d = 0 AND w = 0 THEN 'When ' || description || ', this fact change did not significantly alter the retrieval results, suggesting it is not a legally operative fact for precedent applicability.'
  ELSE 'When ' || description || ', ' || CASE WHEN d = 0 THEN 'no precedents dropped out of the top results.' ELSE CAST(d AS VARCHAR) || ' precedent' || CASE WHEN d = 1 THEN '' ELSE 's' END || ' dropped out of the top results, including ' || a.s
    || '. These cases involved a ' || original_value || ', but the perturbed case involves a different party type, which falls under different legal principles.' END || ' '
    || CASE WHEN w = 0 THEN 'No new precedents appeared.' ELSE CAST(w AS VARCHAR) || ' new precedent' || CASE WHEN w = 1 THEN '' ELSE 's' END || ' became applicable, including ' || b.s
    || '. These cases involve a ' || perturbed_value || ', which matches the altered party type.' END END AS summary
FROM x JOIN l a ON a.n = d JOIN l b ON b.n = w
""",
    "src2_profile": """
WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer),
l AS (SELECT c_custkey, 'c_custkey' AS col, CAST(c_custkey AS VARCHAR) AS v FROM c UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM c UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM c
  UNION ALL SELECT c_custkey, 'c_name', c_name FROM c UNION ALL SELECT c_custkey, 'c_acctbal', CAST(c_acctbal AS VARCHAR) FROM c),
d AS (SELECT col, v, row_number() OVER (PARTITION BY col ORDER BY c_custkey) AS k FROM l WHERE v IS NOT NULL),
s AS (SELECT col, string_agg(v, '|' ORDER BY k) AS samples FROM d WHERE k <= 3 GROUP BY col)
SELECT l.col AS "column", count(*) - count(v) AS n_null, count(v) AS n_values, s.samples FROM l JOIN s ON s.col = l.col GROUP BY l.col, s.samples
""",
    "flt1_filters": "SELECT p_partkey, p_size, p_brand FROM part WHERE p_size > 10 AND (p_brand = 'Brand#12' OR p_type = 'PROMO BRUSHED TIN' OR (p_size <= 20 AND p_size <> 15))",
    "snk2_new_rows": "SELECT c_custkey AS chunk_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "snk3_upsert": """
SELECT s_suppkey AS chunk_id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)
UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 10
""",
}

ORACLES["val4_stats"] = f"""
WITH k AS (SELECT fact_type, original_value, perturbed_value, count(*) AS n FROM ({ORACLES["per11_candidates"]}) GROUP BY fact_type, original_value, perturbed_value)
SELECT count(*) AS accepted, CAST(0 AS BIGINT) AS rejected, CAST(sum(n - 1) AS BIGINT) AS cached FROM k
"""
