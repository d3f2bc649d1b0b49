"""Term scores and sentences that explain results and edges."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.extract import terms
from plumbline.operators.facts import AGES, AMOUNTS, EVIDENCE, number_text
from plumbline.session import cut, python_ready, staged


def document_frequency(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """term, df: how many documents hold each term."""
    return docs.select(F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(frequency: DataFrame, n_docs: Column | int) -> DataFrame:
    """term, df, idf = ln((N + 1) / (df + 1)) + 1."""
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return frequency.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1)


def unseen_idf(n_docs: int) -> Column:
    return F.log(F.lit(n_docs + 1.0)) + 1


def top_shared_terms(pairs: DataFrame, weights: DataFrame, n_docs: int, keys: list[str], top_n: int = 3) -> DataFrame:
    """Per pair (keys, text_a, text_b): the shared terms with the greatest idf, ties by name (column ``terms``)."""
    shared = F.array_intersect(F.array_distinct(terms(F.col("text_a"))), F.array_distinct(terms(F.col("text_b"))))
    long = pairs.select(*keys, F.explode(shared).alias("term")).join(weights.select("term", "idf"), "term", "left")
    long = long.withColumn("idf", F.round(F.coalesce("idf", unseen_idf(n_docs)), 9))
    order = Window.partitionBy(*keys).orderBy(F.desc("idf"), "term")
    best = long.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n)
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))


FALLBACK = "This case was retrieved based on overall semantic similarity to your case."


def explain_results(results: DataFrame) -> DataFrame:
    """Results with a column ``explanation`` of at most two sentences.

    Columns read: query_sections and act_sections (arrays), petitioner, respondent, text, terms (see
    :func:`top_shared_terms`). Reasons come in order: shared sections, parties, shared terms if fewer than two so far.
    """
    shared = F.array_sort(F.array_intersect(F.coalesce("query_sections", F.array().cast("array<string>")), F.coalesce("act_sections", F.array().cast("array<string>"))))
    text = F.lower(F.coalesce("text", F.lit("")))
    named = lambda c: (F.coalesce(c, F.lit("")) != "") & F.contains(text, F.lower(F.coalesce(c, F.lit(""))))
    one = F.when(F.size(shared) > 0, F.concat(F.lit("This case involves "), F.array_join(shared, ", "), F.lit(", which is also cited in your case.")))
    two = F.when(named("petitioner"), F.concat(F.lit("This case also involves a "), F.col("petitioner"), F.lit(" as the petitioner.")))
    three = F.when(named("respondent"), F.concat(F.lit("This case also involves a "), F.col("respondent"), F.lit(" as the respondent.")))
    first = F.array_compact(F.array(one, two, three))
    four = F.when(F.size(F.coalesce("terms", F.array().cast("array<string>"))) > 0, F.concat(F.lit("This case shares similar factual patterns involving "), F.array_join("terms", ", "), F.lit(".")))
    reasons = F.when(F.size(first) < 2, F.array_compact(F.concat(first, F.array(four)))).otherwise(first)
    return results.withColumn("explanation", F.when(F.size(reasons) == 0, FALLBACK).otherwise(F.array_join(F.slice(reasons, 1, 2), " ")))


def _listed(cases: Column, first: int = 5) -> Column:
    more = F.when(F.size(cases) > first, F.concat(F.lit(" (and "), (F.size(cases) - first).cast("string"), F.lit(" more)"))).otherwise("")
    return F.concat(F.array_join(F.slice(cases, 1, first), ", "), more)


def explain_edges(edges: DataFrame) -> DataFrame:
    """Edges with a column ``summary``: the change, what dropped out and came in, and why.

    Columns read: description, fact_type, original_value, perturbed_value, dropped and new (arrays of case ids in rank
    order), dropped_cite_original and new_cite_perturbed (booleans: whether one of the first five cites the section).
    """
    n_dropped, n_new = F.size("dropped"), F.size("new")
    plural = lambda n: F.when(n == 1, "").otherwise("s")
    old, now, kind = F.col("original_value"), F.col("perturbed_value"), F.col("fact_type")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    why_dropped = (
        F.when(F.coalesce(old, F.lit("")) == "", None)
        .when((kind == "Section") & F.col("dropped_cite_original"), text("These cases cited ", old, ", which is no longer relevant after the change."))
        .when(kind == "PartyType", text("These cases involved a ", old, ", but the perturbed case involves a different party type, which falls under different legal principles."))
        .when(kind == "Evidence", text("These cases relied on ", old, " evidence, which was altered in this perturbation."))
        .when(kind == "Numerical", text("These cases were applicable under the original numerical value (", old, "), which was changed."))
    )
    why_new = (
        F.when(F.coalesce(now, F.lit("")) == "", None)
        .when((kind == "Section") & F.col("new_cite_perturbed"), text("These cases involve ", now, ", which matches the altered facts."))
        .when(kind == "PartyType", text("These cases involve a ", now, ", which matches the altered party type."))
        .when(kind == "Evidence", text("These cases involve ", now, " evidence, which matches the altered evidence profile."))
        .when(kind == "Numerical", text("These cases are applicable under the perturbed numerical value (", now, ")."))
    )
    dropped = F.when(
        n_dropped > 0,
        F.concat_ws(" ", text(n_dropped.cast("string"), " precedent", plural(n_dropped), " dropped out of the top results, including ", _listed(F.col("dropped")), "."), why_dropped),
    ).otherwise("no precedents dropped out of the top results.")
    new = F.when(
        n_new > 0, F.concat_ws(" ", text(n_new.cast("string"), " new precedent", plural(n_new), " became applicable, including ", _listed(F.col("new")), "."), why_new)
    ).otherwise("No new precedents appeared.")
    same = text(
        "When ", F.col("description"), ", this fact change did not significantly alter the retrieval results, suggesting it is not a legally operative fact for precedent applicability."
    )
    return edges.withColumn("summary", F.when((n_dropped == 0) & (n_new == 0), same).otherwise(F.concat_ws(" ", text("When ", F.col("description"), ","), dropped, new)))


def tree_json(nodes: DataFrame, diffs: DataFrame, scores: DataFrame) -> DataFrame:
    """Per tree: one JSON string with its nodes in order, each edge's differences, and sensitivities at the root.

    ``nodes``: tree_id, node_id, parent_id, depth, description; ``diffs``: see ``diff.rank_diff``; ``scores``: see
    ``diff.sensitivity``.
    """
    change = F.struct(F.col("dropped").alias("dropped_cases"), F.col("new").alias("newly_appeared_cases"), F.col("stable").alias("stable_cases"), "mean_displacement")
    own = nodes.join(diffs.select("tree_id", "node_id", change.alias("diff")), ["tree_id", "node_id"], "left")
    row = F.struct("node_id", "parent_id", "depth", "description", "diff")
    trees = own.groupBy("tree_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", row.alias("n")))), lambda x: x["n"]).alias("nodes"))
    sens = scores.groupBy("tree_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fact_type", F.round("sensitivity", 6))))).alias("sensitivity"))
    return trees.join(sens, "tree_id", "left").select("tree_id", F.to_json(F.struct("tree_id", "nodes", "sensitivity")).alias("json"))


def nested_json(nodes: DataFrame, columns: list[str], children: str = "children") -> DataFrame:
    """tree_id and json of every tree whose root has depth 0: objects of ``columns``, with their children in the order of ids.

    ``nodes``: tree_id, node_id, parent_id, depth and ``columns``. Trees of any depth are put together from below, a
    level per step: children are folded into one string for their parent, by a group-by and a join, and each level is cut.
    Null columns are left out of an object.
    """
    own = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    rows = nodes.select("tree_id", "node_id", "parent_id", "depth", F.substring(own, F.lit(1), F.length(own) - 1).alias("head"))
    below = None
    for depth in range(nodes.agg(F.max("depth")).first()[0] or 0, -1, -1):
        level = rows.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("inner", F.lit(""))
        else:
            folded = below.groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(
                F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "json"))), lambda x: x["json"]), ",").alias("inner")
            )
            level = level.join(folded, ["tree_id", "node_id"], "left")
        whole = F.concat("head", F.when(F.col("head") == "{", "").otherwise(","), F.lit(f'"{children}":['), F.coalesce("inner", F.lit("")), F.lit("]}"))
        below = cut(level.select("tree_id", "node_id", "parent_id", whole.alias("json")))
    return below.select("tree_id", "json")


def nodes_of_json(trees: DataFrame, columns: str, children: str = "children") -> DataFrame:
    """The inverse of :func:`nested_json`: tree_id, parent_id, depth and ``columns`` (a schema with node_id) of every object.

    Objects are taken apart a level per step until none has children, so no depth is fixed.
    """
    level = trees.select("tree_id", F.lit(None).cast("long").alias("parent_id"), "json")
    out, depth = None, 0
    while True:
        inner = F.from_json(F.get_json_object("json", f"$.{children}"), "array<string>")
        parsed = cut(level.select("tree_id", "parent_id", F.from_json("json", columns).alias("own"), inner.alias("inner")))
        part = parsed.select("tree_id", "parent_id", F.lit(depth).alias("depth"), "own.*")
        out = part if out is None else out.unionByName(part)
        level = parsed.select("tree_id", F.col("own.node_id").cast("long").alias("parent_id"), F.explode("inner").alias("json"))
        depth += 1
        if level.isEmpty():
            return out


def _known(small: DataFrame) -> DataFrame:
    """A staged side of a join: broadcast up to 10,000 rows, else never; the size of its files tells little about its rows."""
    return F.broadcast(small) if small.count() <= 10_000 else small.hint("merge")


def _packed(limit: int):
    """Joins texts (tree_id, root, text) that come in order into parts that end once they have ``limit`` characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size, kinds = None, [], 0, None

        def part() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of[0]], kinds[0]), pa.array([of[1]], kinds[1]), pa.array(["".join(held)], pa.string())], ["tree_id", "root", "json"])

        for batch in batches:
            kinds = [batch.column(i).type for i in (0, 1)]
            for tree, root, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2)]):
                if held and (size >= limit or of != (tree, root)):
                    yield part()
                    held, size = [], 0
                of = (tree, root)
                held.append(text)
                size += len(text)
        if held:
            yield part()

    return run


def nested_parts(nodes: DataFrame, columns: list[str], children: str = "children", limit: int = 1 << 18) -> DataFrame:
    """The documents of :func:`nested_json` in parts, for trees too large for one string: tree_id, root, part, json.

    The parts of a root (``root`` is a number of its own), put together in the order of ``part``, are its document. A part
    begins and ends between objects and has ``limit`` characters and at most one object's own more. Every object's text is
    made in its row: what it opens, and after a leaf the brackets of all that end with it. Places come down from the root
    by a join per level, and one range sort puts the texts in order, so no row, task or group holds a whole tree.
    """
    spark = nodes.sparkSession
    own = F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]))
    rows = staged(nodes.select("tree_id", "node_id", "parent_id", "depth", F.substring(own, F.lit(1), F.length(own) - 1).alias("head"), F.monotonically_increasing_id().alias("_row")))
    me, level, texts = F.struct("node_id", "_row"), None, []
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    for depth in range(deepest + 1):
        at = rows.where(F.col("depth") == depth)
        if level is None:
            at = at.select("tree_id", "node_id", "head", F.array(me).alias("path"), F.lit(True).alias("is_first"), F.lit(0).alias("ends"))
        else:
            above = _known(level.where("first IS NOT NULL").select("tree_id", F.col("node_id").alias("parent_id"), F.col("path").alias("_path"), "first", "last", F.col("ends").alias("_ends")))
            ends = F.when(me == F.col("last"), F.col("_ends") + 1).otherwise(0)
            at = at.join(above, ["tree_id", "parent_id"]).select("tree_id", "node_id", "head", F.concat("_path", F.array(me)).alias("path"), (me == F.col("first")).alias("is_first"), ends.alias("ends"))
        if depth < deepest:
            family = rows.where(F.col("depth") == depth + 1).groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.min(me).alias("first"), F.max(me).alias("last"))
            level = staged(at.join(family.hint("merge"), ["tree_id", "node_id"], "left"))
        else:
            level = staged(at.withColumn("first", F.when(F.lit(False), F.element_at("path", 1))))
        opened = F.concat(F.when(F.col("is_first"), "").otherwise(","), "head", F.when(F.col("head") == "{", "").otherwise(","), F.lit(f'"{children}":['))
        closed = F.when(F.col("first").isNull(), F.repeat(F.lit("]}"), F.col("ends") + 1)).otherwise("")
        texts.append(level.select("tree_id", "path", F.concat(opened, closed).alias("text")))
    every = reduce(DataFrame.unionByName, texts)
    n = max(spark.sparkContext.defaultParallelism, -(-every.count() // 250_000))
    ordered = every.repartitionByRange(n, "tree_id", "path").sortWithinPartitions("tree_id", "path")
    python_ready(spark, 4096)
    kind = nodes.schema["tree_id"].dataType.simpleString()
    packed = ordered.select("tree_id", F.col("path")[0]["_row"].alias("root"), "text").mapInArrow(_packed(limit), f"tree_id {kind}, root long, json string")
    return staged(packed.select("tree_id", "root", F.monotonically_increasing_id().alias("part"), "json"))


def objects_in(text: str, children: str, key: str = "node_id") -> tuple[list[tuple], list[tuple], int]:
    """A part's objects (depth, parent's id, own text without children), those still open at its end (depth, id), and its
    change of depth. Depths count from the part's start; ids are as written; a parent from an earlier part is None."""
    scan, found, open_, depth, at = json.JSONDecoder().scan_once, [], [], 0, 0
    while at < len(text):
        if text[at] == "{":
            here, end, own = at + 1, at + 1, None
            while True:
                name, here = scan(text, here)
                if name == children:
                    break
                begin = here + 1
                _, end = scan(text, begin)
                own = text[begin:end] if name == key else own
                here = end + 1
            found.append((depth, open_[-1][1] if open_ else None, text[at:end] + "}"))
            open_.append((depth, own))
            depth, at = depth + 1, here + 2
        elif text[at] == "]":
            depth, at = depth - 1, at + 2
            if open_:
                open_.pop()
        else:
            at += 1
    return found, open_, depth


def _objects(text: Column, children: str) -> Column:
    """:func:`objects_in` of a column."""

    @F.arrow_udf("struct<objects:array<struct<depth:int,parent:string,head:string>>,open:array<struct<depth:int,id:string>>,net:int>")
    def read(texts: pa.Array) -> pa.Array:
        got = [objects_in(t, children) for t in texts.to_pylist()]

        def lists(i: int, kinds: dict) -> pa.Array:
            sizes = [0]
            for g in got:
                sizes.append(sizes[-1] + len(g[i]))
            columns = [pa.array([x[k] for g in got for x in g[i]], kind) for k, kind in enumerate(kinds.values())]
            return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays(columns, list(kinds)))

        found = lists(0, {"depth": pa.int32(), "parent": pa.string(), "head": pa.string()})
        still = lists(1, {"depth": pa.int32(), "id": pa.string()})
        return pa.StructArray.from_arrays([found, still, pa.array([g[2] for g in got], pa.int32())], ["objects", "open", "net"])

    return read(text)


def nodes_of_parts(parts: DataFrame, columns: str, children: str = "children") -> DataFrame:
    """The inverse of :func:`nested_parts`: tree_id, parent_id, depth and ``columns`` (a schema with node_id) of every object.

    Every part is read by itself. Which objects are open where it begins follows from the few that each part leaves open.
    """
    python_ready(parts.sparkSession)
    read = staged(parts.select("tree_id", "root", "part", _objects(F.col("json"), children).alias("_r")).select("tree_id", "root", "part", "_r.*"))
    keys = ["tree_id", "root", "part"]
    before = Window.partitionBy("tree_id", "root").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(read.select(*keys, "open", F.coalesce(F.sum("net").over(before), F.lit(0)).cast("int").alias("start")))
    left = starts.select(*keys, F.lit(1).alias("_later"), "start", F.explode("open").alias("_o")).select(*keys, "_later", (F.col("start") + F.col("_o.depth")).alias("depth"), "_o.id")
    asked = starts.where("start > 0").select(*keys, F.lit(0).alias("_later"), F.explode(F.sequence(F.lit(0), F.col("start") - 1)).alias("depth"), F.lit(None).cast("string").alias("id"))
    latest = F.last("id", ignorenulls=True).over(Window.partitionBy("tree_id", "root", "depth").orderBy("part", "_later").rowsBetween(Window.unboundedPreceding, -1))
    known = left.unionByName(asked).withColumn("id", latest).where("_later = 0")
    stacks = known.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "id"))), lambda x: x["id"]).alias("stack"))
    stacks = staged(starts.select(*keys, "start").join(stacks.hint("merge"), keys, "left"))

    def placed(o: Column) -> Column:
        depth = F.col("start") + o["depth"]
        outer = F.when(depth > 0, F.get(F.col("stack"), depth - 1))
        return F.struct(depth.alias("depth"), F.coalesce(o["parent"], outer).alias("parent"), o["head"].alias("head"))

    flat = read.select(*keys, "objects").join(_known(stacks), keys).select("tree_id", F.explode(F.transform("objects", placed)).alias("_o"))
    parent = F.from_json(F.concat(F.lit('{"node_id":'), F.col("_o.parent"), F.lit("}")), columns)["node_id"].cast("long")
    return flat.select("tree_id", parent.alias("parent_id"), F.col("_o.depth").alias("depth"), F.from_json("_o.head", columns).alias("own")).select("tree_id", "parent_id", "depth", "own.*")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and MD5 of every document whose parts come one after the other."""
    of, n, md5, kinds = None, 0, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([of[0]], kinds[0]), pa.array([n], pa.int64()), pa.array([md5.hexdigest()], pa.string())], ["tree_id", "n_chars", "digest"])

    for batch in batches:
        kinds = [batch.column(i).type for i in (0, 1)]
        for tree, root, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2)]):
            if of != (tree, root):
                if of is not None:
                    yield row()
                of, n, md5 = (tree, root), 0, hashlib.md5()
            n += len(text)
            md5.update(text.encode())
    if of is not None:
        yield row()


def parts_digest(parts: DataFrame) -> DataFrame:
    """tree_id, n_chars and digest (MD5) of every document, which one task reads part by part, since MD5 goes in order."""
    python_ready(parts.sparkSession)
    kind = parts.schema["tree_id"].dataType.simpleString()
    ordered = parts.repartition("tree_id", "root").sortWithinPartitions("tree_id", "root", "part")
    return ordered.select("tree_id", "root", "json").mapInArrow(_digested, f"tree_id {kind}, n_chars long, digest string")


def fact_section(sheet: Column) -> Column:
    """A fact sheet in Markdown; missing parts vanish, missing names are N/A."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    known = lambda c: F.coalesce(c, F.lit("N/A"))
    said = lambda c: F.coalesce(c, F.lit(""))
    lines = lambda items, kind, one: F.transform(F.coalesce(items, F.array().cast(kind)), one)
    block = lambda title, items: F.when(F.size(items) > 0, text(f"**{title}:**\n\n", F.array_join(items, "\n")))
    number = lambda label: lambda x: text(f"- {label}: ", said(number_text(x["value"])), " ", said(x["unit"]), " (", said(x["context"]), ")")
    n, cited = sheet["numerical_facts"], F.coalesce(sheet["sections_cited"], F.array().cast("array<string>"))
    ages = lines(n["ages"], AGES, lambda x: text("- Age: ", said(x["value"].cast("string")), " (", said(x["descriptor"]), ")"))
    numbers = F.concat(lines(n["amounts"], AMOUNTS, number("Amount")), ages, lines(n["durations"], AMOUNTS, number("Duration")))
    return F.concat_ws(
        "\n\n",
        text("**Case ID:** ", known(sheet["case_id"])),
        text("| Role | Type |\n|------|------|\n| Petitioner | ", known(sheet["parties"]["petitioner_type"]), " |\n| Respondent | ", known(sheet["parties"]["respondent_type"]), " |"),
        F.when(F.size(cited) > 0, text("**Sections cited:** ", F.array_join(cited, ", "))),
        F.when(said(sheet["outcome"]) != "", text("**Outcome:** ", sheet["outcome"])),
        block("Evidence items", lines(sheet["evidence_items"], EVIDENCE, lambda e: text("- ", said(e["evidence_type"]), ": ", said(e["description"])))),
        block("Numerical facts", numbers),
    )


def report(sheets: DataFrame, precedents: DataFrame, summaries: DataFrame, scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per tree of ``sheets`` (tree_id, sheet): a Markdown report in four sections.

    ``precedents``: tree_id, rank, case_id, section_type, score, explanation, the first ten of each tree are listed;
    ``summaries``: tree_id, node_id, summary; ``scores``: tree_id, fact_type, sensitivity; ``nodes``: tree_id per node.
    """
    listed = lambda of, key, line: of.groupBy("tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), line), "\n").alias("lines"))
    found = F.struct("rank", "case_id", "section_type", F.format_string("%.4f", F.col("score").cast("double")).alias("score"), "explanation")
    first = precedents.where("rank <= 10")
    second = listed(first, found, lambda x: F.concat(F.lit("| "), F.concat_ws(" | ", x["rank"].cast("string"), x["case_id"], x["section_type"], x["score"], x["explanation"]), F.lit(" |")))
    edges = listed(summaries, F.struct("node_id", "summary"), lambda x: F.concat(F.lit("- "), x["summary"]))
    order = F.struct((-F.col("sensitivity")).alias("s"), "fact_type")
    table = listed(scores, order, lambda x: F.format_string("| %s | %.4f |", x["fact_type"], -x["s"]))
    top = scores.groupBy("tree_id").agg(F.min(order).alias("top"))
    total = nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))
    whole = sheets.select("tree_id", "sheet")
    for name, part in (("precedents", second), ("table", table), ("edges", edges)):
        whole = whole.join(part.withColumnRenamed("lines", name), "tree_id", "left")
    whole = whole.join(top, "tree_id", "left").join(total, "tree_id", "left")
    operative = F.format_string("The most legally operative fact for this case is **%s** with a sensitivity score of **%.2f**.", F.col("top.fact_type"), -F.col("top.s"))
    body = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Counterfactual report: tree "), F.col("tree_id").cast("string")),
        F.lit("## 1. Query case fact sheet"),
        fact_section(F.col("sheet")),
        F.lit("## 2. Top retrieved precedents"),
        F.coalesce(F.concat(F.lit("| Rank | Case ID | Section type | Score | Explanation |\n|------|---------|-------------|-------|-------------|\n"), F.col("precedents")), F.lit("No precedents were retrieved.")),
        F.lit("## 3. Counterfactual analysis"),
        F.concat(F.lit("| Fact type | Mean displacement |\n|---|---|\n"), F.col("table")),
        F.col("edges"),
        F.lit("## 4. Conclusion"),
        F.when(F.col("top").isNotNull(), operative).otherwise("Sensitivity scores are not available: they need a deeper tree with results."),
        F.concat(F.lit("Nodes of the tree: "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(".")),
    )
    return whole.select("tree_id", body.alias("markdown"))
