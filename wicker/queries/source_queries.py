"""Sources, extraction, keyed writes and freshness over inputs made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wicker.functions import text
from wicker.operators import extract, resolve, store, vector
from wicker.operators.components import saved
from wicker.queries.graph_queries import N, NE
from wicker.queries.registry import query
from wicker.queries.store_queries import _PAGE, D, _paths
from wicker.session import checkpoint_folder
from wicker.sources import adapters as A
from wicker.sources import files
from wicker.sources import published as P
from wicker.streaming import incremental

# Files


@query(f"select page_id, regexp_matches(path, '^(.*/)?[^/]*[.]py$') or (regexp_matches(path, '^(.*/)?[^/]*[.]js$') and not regexp_matches(path, '(^|/)node_modules/')) as inside from {_PAGE}")
def files_by_globs(spark, d):
    """Ordered globs: Python and JavaScript, but not what lies in node_modules."""
    globs = ["**/*.py", "**/*.js", "!**/node_modules/**"]
    return _paths(spark, d).select("page_id", files.overridden(F.col("path"), globs).alias("inside"))


@query("select doc_id, doc_id % 4 in (1, 2) as found from documents")
def binary_files(spark, d):
    """Text, text with a NUL, text that begins with no UTF-8, and text whose last character in view is cut."""
    body = F.encode(F.col("text"), "UTF-8")
    made = F.when(F.col("doc_id") % 4 == 0, body).when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("6100")), body)).when(F.col("doc_id") % 4 == 2, F.concat(F.unhex(F.lit("FF")), body))
    cut = F.concat(F.encode(F.repeat(F.lit("x"), files.SNIFF - 1), "UTF-8"), F.encode(F.lit("é"), "UTF-8"), body)
    return A.read(spark, d, "documents").select("doc_id", files.is_binary(F.coalesce(made, cut)).alias("found"))


_HEADS = [("#!/bin/bash", "Bash"), ("#!/usr/bin/env python3.11 -u", "Python"), ("#! /usr/bin/env -S node --flag", "JavaScript"), ("#!/usr/bin/ruby2.7", "Ruby"), ("plain", None), ("#!/opt/unknown", None), ("#!/usr/bin/env A=1 perl -w", "Perl")]


@query(f"select doc_id, case doc_id % 7 {' '.join(f'when {i} then {chr(39)}{x[1]}{chr(39)}' for i, x in enumerate(_HEADS) if x[1])} else '' end as language from documents")
def first_line_language(spark, d):
    head = F.element_at(F.array(*(F.lit(x[0]) for x in _HEADS)), (F.col("doc_id") % len(_HEADS) + 1).cast("int"))
    return A.read(spark, d, "documents").select("doc_id", F.coalesce(files.shebang_language(F.concat(head, F.lit("\n"), "text")), F.lit("")).alias("language"))


@query("select ending, language from (values " + ", ".join(f"('{e}', '{l}')" for e, l in sorted(files.BY_ENDING.items())) + ") as t(ending, language)")
def languages_by_ending(spark, d):
    """All endings of the fixed table, in upper case, in folders of another name."""
    rows = spark.createDataFrame([(e,) for e in files.BY_ENDING], "ending string")
    return rows.select("ending", files.language(F.concat(F.lit("a.py/x.y."), F.upper("ending"))).alias("language"))


@query("select ending, case ending when 'h' then 'C' when 'zig' then 'Zig' else language end as language from (values " + ", ".join(f"('{e}', '{l}')" for e, l in sorted((files.BY_ENDING | {"zig": "Zig"}).items())) + ") as t(ending, language)")
def parsers_by_ending(spark, d):
    rows = spark.createDataFrame([(e,) for e in (files.BY_ENDING | {"zig": "Zig"})], "ending string")
    return rows.select("ending", files.parser_language(F.concat(F.lit("a/x."), "ending")).alias("language"))


_LEFT_OUT = [(f"src/{x}/a.rs", "folder") for x in files.GENERATED_DIRS] + [(f"src/a{x.upper()}", "suffix") for x in files.IGNORED_SUFFIXES] + [("src/a.d.ts", "pattern"), ("src/a.bundle.ts", "pattern"), ("src/a.pb.go", "pattern"), ("src/a_pb2.py", "pattern"), ("src/a.rs", ""), ("node_modules", "")]


@query("select path, reason from (values " + ", ".join(f"('{p}', '{r}')" for p, r in _LEFT_OUT) + ") as t(path, reason)")
def skip_reasons_by_name(spark, d):
    """All folders and endings of the fixed tables."""
    rows = spark.createDataFrame([(p,) for p, _ in _LEFT_OUT], "path string")
    return rows.select("path", F.coalesce(files.skip_reason(F.col("path"), F.lit(1), None), F.lit("")).alias("reason"))


@query("select item_id, 'b' || item_id % 3 || '/f' || item_id || '.txt' as rel_path, strlen(text) as size, sha256(text) as sha256 from benchmark where item_id % 5 <> 4 and item_id % 3 <> 0")
def walked_files(spark, d):
    """A tree of files, its ignore files, and links and hidden histories left out.

    It lies in the shared folder, where the driver writes it and the workers read it.
    """
    import os

    root = f"{files.mounted(checkpoint_folder(spark))}/walk-{uuid.uuid4().hex}"
    os.makedirs(root)
    for r in A.read(spark, d, "benchmark").collect():  # a fixed small table
        folder = f"{root}/b{r['item_id'] % 3}"
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/f{r['item_id']}.txt" if r["item_id"] % 5 < 4 else f"{folder}/f{r['item_id']}.log", "w", encoding="utf-8") as f:
            f.write(r["text"])
    for path, text in ((f"{root}/.gitignore", "*.log\n# a remark\n"), (f"{root}/b0/.gitignore", "*\n!*.txt\n*.txt\n"), (f"{root}/.git", None)):
        if text is None:
            os.makedirs(path)
            open(f"{path}/HEAD", "w").close()
        else:
            with open(path, "w") as f:
                f.write(text)
    os.symlink(f"{root}/b1/f1.txt", f"{root}/b1/link.txt")
    return files.walk(spark, root).select(F.regexp_extract("rel_path", r"f(\d+)", 1).cast("long").alias("item_id"), "rel_path", "size", "sha256")


# Extraction: a small module of code for each supplier

_PY = "'def first_' || k || '(x):' || chr(10) || '    return second_' || k || '(x)' || chr(10) || chr(10) || 'class Thing' || k || '(Base' || (k % 3) || '):' || chr(10) || '    def act(self):' || chr(10) || '        return first_' || k || '(1)' || chr(10)"


def _modules(spark, d, language: str):
    k = F.col("s_suppkey").cast("string")
    n = F.lit("\n")
    python = F.concat(F.lit("def first_"), k, F.lit("(x):"), n, F.lit("    return second_"), k, F.lit("(x)"), n, n, F.lit("class Thing"), k, F.lit("(Base"), (F.col("s_suppkey") % 3).cast("string"), F.lit("):"), n, F.lit("    def act(self):"), n, F.lit("        return first_"), k, F.lit("(1)"), n)
    script = F.concat(F.lit("import x from './lib/mod"), k, F.lit("'"), n, F.lit("function go"), k, F.lit("(a) {"), n, F.lit('  const s = "}"; // }'), n, F.lit("  if (a) { return s }"), n, F.lit("}"), n, F.lit("class Box"), k, F.lit(" {"), n, F.lit("}"), n)
    text, ending = (python, ".py") if language == "Python" else (script, ".js")
    return A.read(spark, d, "supplier").select(F.concat(F.lit("m/"), k, F.lit(ending)).alias("rel_path"), F.lit(language).alias("language"), text.alias("text"))


_M = "with m as (select s_suppkey as k, 'm/' || s_suppkey || '.py' as p from supplier), j as (select s_suppkey as k, 'm/' || s_suppkey || '.js' as p from supplier) "


@query(_M + "select p as file_path, 'Module' as label, k::varchar as name, p || '::__file__' as qualified_name, 1 as start_line, 1 as end_line, 1.0::double as confidence from m union all select p, 'Function', 'first_' || k, p || '::Function::first_' || k, 1, 2, 1.0 from m union all select p, 'Class', 'Thing' || k, p || '::Class::Thing' || k, 4, 6, 1.0 from m union all select p, 'Method', 'act', p || '::Thing' || k || '::act', 5, 6, 1.0 from m")
def extracted_symbols(spark, d):
    return extract.nodes(_modules(spark, d, "Python")).drop("properties")


@query(_M + "select p as file_path, p || '::Function::first_' || k as source_qname, 'CALLS' as edge_type, 'second_' || k as target from m union all select p, p || '::Thing' || k || '::act', 'CALLS', 'first_' || k from m union all select p, p || '::Class::Thing' || k, 'TYPE_REF', 'Base' || k % 3 from m")
def extracted_references(spark, d):
    rows = extract.references(_modules(spark, d, "Python"))
    return rows.select("file_path", "source_qname", "edge_type", F.coalesce(F.get_json_object("properties", "$.callee_name"), F.get_json_object("properties", "$.type_name")).alias("target"))


@query(_M + "select p as file_path, 'Module' as label, k::varchar as name, p || '::__file__' as qualified_name, 1 as start_line, 1 as end_line, 1.0::double as confidence from j union all select p, 'Function', 'go' || k, p || '::Function::go' || k, 2, 5, 0.6 from j union all select p, 'Class', 'Box' || k, p || '::Class::Box' || k, 6, 7, 0.6 from j")
def extracted_by_braces(spark, d):
    """Spans end where their braces close; those in strings and remarks don't count."""
    return extract.nodes(_modules(spark, d, "JavaScript")).drop("properties")


@query(_M + "select p as file_path, p || '::__file__' as source_qname, 'mod' || k as imported, 'lib::mod' || k as path from j")
def extracted_imports(spark, d):
    rows = extract.references(_modules(spark, d, "JavaScript"))
    return rows.select("file_path", "source_qname", F.get_json_object("properties", "$.imported_name").alias("imported"), F.get_json_object("properties", "$.path").alias("path"))


@query("select 'm/' || s_suppkey || '.py' as rel_path, 'failed' as reason from supplier where s_suppkey % 3 = 0")
def extraction_failures(spark, d):
    rows = _modules(spark, d, "Python").withColumn("text", F.when(F.regexp_extract("rel_path", r"(\d+)", 1).cast("int") % 3 == 0, "def (").otherwise(F.col("text")))
    return extract.failures(rows)


@query(_M + "select 'm/' || k || '.py::Thing' || k || '::act' as source, 'm/' || k || '.py::Function::first_' || k as target, 'CALLS' as edge_type from m")
def indexed_repository(spark, d):
    """From files to edges in one job: extract, number, resolve."""
    modules = saved(_modules(spark, d, "Python"))
    nodes = extract.nodes(modules).withColumns({"id": F.pmod(F.xxhash64("qualified_name"), F.lit(1 << 62)), "project": F.lit("p")})
    nodes = saved(nodes)
    edges = resolve.persisted(resolve.resolve(nodes, extract.references(modules).withColumn("project", F.lit("p"))), "p")
    named = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("qualified_name").alias(side))
    return edges.join(named("source"), "source_id").join(named("target"), "target_id").select("source", "target", "edge_type")


_FILE_NODES = "file_nodes as (select -min(id) - 1 as id, file_path, regexp_replace(regexp_extract(file_path, '[^/]*$'), '[.][^.]*$', '') as stem from nodes group by file_path), wanted as (select id as source_id, 'x/' || regexp_replace(regexp_extract(file_path, '[^/]*$'), '[.][^.]*$', '') as path from nodes where label = 'Method')"


@query(N.rstrip() + f", {_FILE_NODES}, single as (select stem, min(id) as id from file_nodes group by 1 having count(*) = 1) select distinct source_id, s.id as target_id from wanted join single s on s.stem = regexp_replace(path, '^x/', '')")
def file_imports(spark, d):
    """Imports that mean no symbol, but the only file of that stem."""
    n = P.nodes(spark, d)
    found = n.groupBy("file_path").agg((-F.min("id") - 1).alias("id")).select("id", F.lit(A.PROJECT).alias("project"), F.lit("File").alias("label"), F.col("file_path").alias("name"), F.concat(F.lit("file::"), "file_path").alias("qualified_name"), "file_path", F.lit(1).cast("long").alias("start_line"), F.lit(1).cast("long").alias("end_line"), F.lit("{}").alias("properties"))
    path = F.concat(F.lit("x/"), F.regexp_replace(F.regexp_extract("file_path", "([^/]*)$", 1), "[.][^.]*$", ""))
    raw = n.filter("label = 'Method'").select("file_path", F.col("qualified_name").alias("source_qname"), F.lit("").alias("target_qname"), F.lit("IMPORTS").alias("edge_type"), F.to_json(F.struct(F.lit("nothing").alias("imported_name"), path.alias("path"))).alias("properties"))
    return resolve.file_imports(n.unionByName(found.select(*n.columns)), raw)


# Keyed writes


@query("select doc_id % 50 as file, case when doc_id % 50 % 14 = 0 then 'new' else 'old' end as target, count(*) as n from documents group by all")
def replaced_raw_edges(spark, d):
    """The raw references of some files give way as a whole."""
    old = A.read(spark, d, "documents").select((F.col("doc_id") % 50).alias("file_path"), F.lit("old").alias("target_qname"), "doc_id")
    new = old.filter("file_path % 7 = 0 and doc_id % 2 = 0").withColumn("target_qname", F.lit("new"))
    return store.replace_files(old, new, "file_path").groupBy(F.col("file_path").alias("file"), F.col("target_qname").alias("target")).agg(F.count("*").alias("n"))


@query(f"with {A.FILES_SQL} select coalesce(a.rel_path, b.rel_path) as rel_path, coalesce(a.sha256, b.sha256) as sha256, 8::bigint as last_indexed_generation from before b full join after a on a.rel_path = b.rel_path")
def stored_file_states(spark, d):
    """File states upserted by path, and all of them stamped with the next generation."""
    every = store.upsert(A.file_states(spark, d, False), A.file_states(spark, d, True), ["rel_path"])
    state = store.next_generation(spark.createDataFrame([(7,)], "generation long"))
    return store.stamped(every, state.first()["generation"]).select("rel_path", "sha256", "last_indexed_generation")  # one row


@query("select page_id, page_id % 3 = 0 as complete from pages")
def complete_providers(spark, d):
    p = A.read(spark, d, "pages")
    status = F.when(F.col("page_id") % 3 == 1, "rejected").otherwise("accepted")
    unsupported = F.when(F.col("page_id") % 3 == 2, F.array(F.lit("Calls"))).otherwise(F.array().cast("array<string>"))
    return store.provider_complete(p.select("page_id", status.alias("status"), unsupported.alias("unsupported"))).select("page_id", "complete")


@query("select n_regionkey, n_nationkey, case when n_nationkey % 5 = 0 then 'fresh' when n_nationkey % 5 = 1 then 'root mismatch' when n_nationkey % 5 = 2 then 'unknown' else 'stale' end as status, case when n_nationkey % 5 = 3 then 'branch,index_sha' when n_nationkey % 5 = 4 then 'scope_key' else '' end as reasons from nation where n_nationkey < 5")
def workspace_states(spark, d):
    """Workspaces as they were stored and as they are now."""
    out = None
    rows = A.read(spark, d, "nation").filter("n_nationkey < 5").select("n_nationkey", "n_regionkey").collect()  # five rows
    schema = "root_path string, branch string, head string, index_sha string, scope_key string"
    stored = spark.createDataFrame([("/r", "main", "h", "i", "s")], schema)
    kinds = [("/r", "main", "h", "i", "s"), ("/other", "main", "h", "i", "s"), ("/r", "main", None, "i", "s"), ("/r", "dev", "h", "j", "s"), ("/r", "main", "h", "i", "t")]
    for r in rows:
        found = store.workspace_status(stored, spark.createDataFrame([kinds[r["n_nationkey"] % 5]], schema)).select(F.lit(r["n_regionkey"]).alias("n_regionkey"), F.lit(r["n_nationkey"]).alias("n_nationkey"), "status", "reasons")
        out = found if out is None else out.union(found)
    return out


@query(D + "select k.kind, k.kind = 'same files' as metadata_only from (values ('same files'), ('changed files')) as k(kind)")
def metadata_only_changes(spark, d):
    """A new head alone needs no new index; changed files do."""
    schema = "root_path string, branch string, head string, index_sha string, scope_key string"
    status = store.workspace_status(spark.createDataFrame([("/r", "main", "h", "i", "s")], schema), spark.createDataFrame([("/r", "main", "g", "i", "s")], schema))
    before, after = A.file_states(spark, d, False), A.file_states(spark, d, True)
    same, changed = (store.only_metadata(status, store.file_diff(before, x)) for x in (before, after))
    return same.withColumn("kind", F.lit("same files")).union(changed.withColumn("kind", F.lit("changed files")))


@query("select doc_id, n_chars from documents where doc_id % 3 = 0")
def published_snapshot(spark, d):
    """A second generation replaces the first; a build that fails, and a writer that comes late, change nothing."""
    docs = A.read(spark, d, "documents").select("doc_id", "n_chars")
    folder = f"{checkpoint_folder(spark)}/published-{uuid.uuid4().hex}"
    snapshots = incremental.Snapshots(spark, folder)
    snapshots.publish(docs)
    late = incremental.Snapshots(spark, folder)
    late.generation = lambda: 1  # as it was when that writer began
    snapshots.publish(docs.filter("doc_id % 3 = 0"))
    for build in (lambda: snapshots.publish(docs.select("doc_id", F.raise_error(F.lit("broken")).alias("n_chars"))), lambda: late.publish(docs)):
        try:
            build()
        except Exception:  # noqa: S112
            continue
        raise AssertionError("a broken build was published")
    return snapshots.read()


@query("select doc_id, n_chars from documents where doc_id % 2 = 0")
def maintained_snapshot(spark, d):
    """Old generations go, and the last is there again in one file."""
    docs = A.read(spark, d, "documents").select("doc_id", "n_chars")
    snapshots = incremental.Snapshots(spark, f"{checkpoint_folder(spark)}/maintained-{uuid.uuid4().hex}")
    snapshots.publish(docs)
    snapshots.publish(docs.filter("doc_id % 2 = 0").repartition(7))
    snapshots.compact(1, "doc_id")
    assert snapshots.vacuum() == 2 and len(snapshots.read().inputFiles()) == 1 and snapshots.generation() == 3
    return snapshots.read()


@query("select event_id, '1970-01-01T00:00:00Z+' || (epoch_us(ts) // 1000000) || 's' as stamp from events")
def second_stamps(spark, d):
    return A.read(spark, d, "events").select("event_id", text.second_stamp(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).alias("stamp"))


# Vectors


@query(f"with {A.VECTORS_SQL} select count(*) as n from vectors where graph_generation = 2")
def guarded_scope(spark, d):
    """How many vectors a scope has, if they are few enough to scan."""
    return vector.guarded(vector.scoped(A.vectors(spark, d), graph_generation=2)).agg(F.count("*").alias("n"))


@query(f"with {A.VECTORS_SQL} select node_id, chunk_idx, case when node_id % 16 = 4 then 2 else graph_generation end as graph_generation from vectors where node_id % 16 = 4 or graph_generation = 2")
def refreshed_vectors(spark, d):
    """Vectors written anew by key, and older generations pruned."""
    old = A.vectors(spark, d)
    new = old.filter("node_id % 16 = 4").withColumn("graph_generation", F.lit(2).cast("long"))
    return vector.pruned(store.upsert(old, new, ["node_id", "chunk_idx"]), 2).select("node_id", "chunk_idx", "graph_generation")


@query(NE.rstrip() + ", scope as (select id, 'f' || id as name from nodes where label = 'Struct') select count(*) as n, min(id) as least, max(id) as largest from scope")
def points(spark, d):
    """Nodes and edges by their keys, one after the other."""
    n, e = P.nodes(spark, d), P.edges(spark, d)
    some = n.filter("label = 'Struct'").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("largest"))
    row = some.first()  # one row
    for key in ("least", "largest"):
        assert n.filter(F.col("id") == row[key]).count() == 1
    assert e.filter(F.col("id") == e.agg(F.min("id")).first()[0]).count() == 1
    return some


@query(NE + "select file_path, count(*) as n from edges join nodes n on n.id = source_id where edge_type = 'USAGE' group by 1")
def raw_edges_by_file(spark, d):
    """Raw references of a kind by the file they come from."""
    raw = P.edges(spark, d, ("USAGE",)).join(P.nodes(spark, d).select(F.col("id").alias("source_id"), "file_path"), "source_id")
    return raw.groupBy("file_path").agg(F.count("*").alias("n"))
