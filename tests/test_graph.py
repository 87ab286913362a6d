"""Relations and paths on hand-made registers."""

from pyspark.sql import functions as F

from loreloom.operators import graph


def register(spark, doc, columns, rows):
    df = spark.createDataFrame([(*r, i + 2) for i, r in enumerate(rows)], [*columns, "row_no"])
    return df.select(
        *columns, F.lit("kb").alias("base_id"), F.lit(doc).alias("doc_id"), F.lit(doc + "#1").alias("block_id"),
        F.col("row_no").cast("long"), F.lit(doc).alias("source"), F.lit("v1").alias("fingerprint"),
    )


def extract(spark, doc, columns, rows):
    df = register(spark, doc, columns, rows)
    return graph.extract_relations(df, graph.detect_roles(columns), confirmed=True)


def test_three_hop_chain_over_three_tables(spark):
    edges = (
        extract(spark, "a", ["设备编号", "工单编号"], [("DEV-01", "WO-01")])
        .unionByName(extract(spark, "b", ["工单编号", "问题编号", "问题摘要"], [("WO-01", "ISS-01", "leak")]))
        .unionByName(extract(spark, "c", ["问题编号", "规程编号"], [("ISS-01", "PROC-01")]))
    )
    nodes = graph.entities(edges)
    assert {r["type"]: r["n"] for r in nodes.groupBy("type").agg(F.count("*").alias("n")).collect()} == {
        "asset": 1, "work_order": 1, "issue": 1, "procedure": 1
    }
    queries = spark.createDataFrame([(1, "dev-01 依据哪个规程")], "query_id long, query string")
    seeds = graph.match_seeds(nodes, queries)
    assert seeds.count() == 1
    paths = graph.simple_paths(edges, seeds)
    ranked = graph.rank_paths(paths, queries).orderBy("rank").collect()
    assert [r["hops"] for r in ranked] == [3, 1, 2] and ranked[0]["end_type"] == "procedure"
    assert graph.validate_paths(paths, edges).filter("valid").count() == 3
    revised = edges.withColumn("revision", F.when(F.col("predicate") == "has_issue", 2).otherwise(F.col("revision")))
    assert graph.validate_paths(paths, revised).filter("valid").count() == 1
    assert graph.paths_within_document(paths, F.lit("a")).count() == 1
    cited = spark.createDataFrame([(1, "a", "a#1"), (1, "b", "b#1")], "query_id long, doc_id string, block_id string")
    complete = graph.fully_cited(paths, cited)
    assert sorted(r["complete"] for r in complete.collect()) == [False, True, True]
    ends = paths.withColumn("first_name", F.lit("DEV-01")).withColumn("last_name", F.element_at("names", -1))
    answers = spark.createDataFrame([(1, "what", "DEV-01 follows PROC-01")], "query_id long, question string, answer string")
    verdict = graph.answer_consistency(ends, complete, answers).collect()
    assert [(r["last_name"], r["supported"]) for r in verdict] == [("PROC-01", False)]


def test_same_station_name_on_two_lines_and_without_line(spark):
    edges = extract(spark, "x", ["设备编号", "车站", "线路"], [("DEV-1", "North", "L1"), ("DEV-1", "North", "L2")])
    for doc in ("y", "z"):
        edges = edges.unionByName(extract(spark, doc, ["设备编号", "车站"], [("DEV-1", "North")]))
    counts = {r["type"]: r["n"] for r in graph.entities(edges).groupBy("type").agg(F.count("*").alias("n")).collect()}
    assert counts == {"asset": 1, "station": 4, "line": 2}


def test_explicit_relation_and_repeats(spark):
    columns = ["subject_type", "subject_id", "relation", "object_type", "object_id"]
    edges = extract(spark, "x", columns, [("team", "T1", "owns", "tool", "K9"), ("team", "T1", "owns", "team", "T1")])
    row = edges.collect()
    assert [(r["predicate"], r["subject_name"], r["object_name"]) for r in row] == [("explicit:owns", "T1", "K9")]
    again = edges.unionByName(edges).dropDuplicates(["relation_id"])
    assert again.count() == 1
    rolled = graph.type_rollup(edges).first()
    assert (rolled["links"], rolled["predicates"]) == (1, ["explicit:owns"])


def test_budgets_skip_paths_that_do_not_fit(spark):
    rows = [(1, i, f"p{i}", [f"n{j}" for j in range(i % 4 + 2)], [(f"e{i}-{j}", 1, "d", "b") for j in range(i % 4 + 1)]) for i in range(1, 30)]
    ranked = spark.createDataFrame(rows, "query_id long, rank int, path_id string, node_ids array<string>, path array<struct<relation_id:string,revision:int,doc_id:string,block_id:string>>")
    nodes, edges, expected = set(), set(), []
    for _, rank, _, ids, path in rows:
        more, further = nodes | set(ids), edges | {e[0] for e in path}
        if len(expected) < 8 and len(more) <= 4 and len(further) <= 12:
            nodes, edges = more, further
            expected.append(rank)
    found = graph.select_paths(ranked, 8, 4, 12).orderBy("rank").collect()
    assert [r["rank"] for r in found] == expected


def test_visibility_and_short_queries(spark):
    edges = extract(spark, "a", ["设备编号", "设备名称", "工单编号"], [("DEV-01", "北站水泵", "WO-1")])
    docs = spark.createDataFrame([("a", "v2")], "doc_id string, fingerprint string")
    assert graph.visible_edges(edges, docs).count() == 0
    asked = spark.createDataFrame([(1, "水泵"), (2, "北站水泵在哪"), (3, "DEV-011")], "query_id long, query string")
    assert {r["query_id"] for r in graph.match_seeds(graph.entities(edges), asked).collect()} == {1, 2}


def test_progress_is_counted_before_documents_are_joined(spark):
    df = register(spark, "r", ["设备编号", "工单编号"], [("D-1", "W-1"), ("D-1", "W-2")])
    edges = graph.extract_relations(df, graph.detect_roles(df.columns))
    edges = edges.unionByName(edges.withColumn("status", F.lit("rejected"))).unionByName(edges.withColumn("fingerprint", F.lit("old")))
    documents = spark.createDataFrame([("r", "published", "v1", 1), ("s", "queued", "v1", 0)], "doc_id string, status string, fingerprint string, chunk_count int")
    progress = graph.construction_progress(documents, edges, spark.createDataFrame([("r", 3)], "doc_id string, entity_count long"))
    assert sorted(map(tuple, progress.collect())) == [("r", "source_changed", 2, 2, 2, 3), ("s", "parsing", 0, 0, 0, 0)]
    detail = graph.progress_detail(edges, documents.select("doc_id", "fingerprint"))
    assert [tuple(r) for r in detail.collect()] == [("r", "asset", "has_work_order", "work_order", 2, 2, 2)]
    for df in (progress, detail):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" in plan[plan.index("LeftOuter, (doc_id"):]


def test_repeated_relations_are_removed_without_shuffling_edges(spark):
    rows = [("DEV-1", "pump", "WO-1"), ("DEV-1", "pump", "WO-1"), ("DEV-2", "fan", "WO-2")]
    df = register(spark, "r", ["设备编号", "设备名称", "工单编号"], rows).withColumn("row_no", F.length("设备编号").cast("long"))
    edges = graph.extract_relations(df, graph.detect_roles(df.columns))
    assert edges.count() == 2 and "_home" not in edges.columns
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Aggregate") < plan.index("sha2(") < plan.index("Exchange hashpartitioning")


def parallel_edges(spark):
    """Two parallel edges a-b, three b-c, one c-d and one back c-a."""
    pairs = [("a", "b")] * 2 + [("b", "c")] * 3 + [("c", "d"), ("c", "a")]
    rows = [(f"r{i}", s, "t", s.upper(), o, "t", f"{o.upper()}{i}", "d", str(i), 1) for i, (s, o) in enumerate(pairs)]
    return spark.createDataFrame(rows, "relation_id string, subject_id string, subject_type string, subject_name string, object_id string, "
                                 "object_type string, object_name string, doc_id string, block_id string, revision int")


def listed(paths):
    return sorted((tuple(r["node_ids"]), tuple(e["relation_id"] for e in r["path"]), tuple(r["names"])) for r in paths.collect())


def walked_paths(edges, start, hops):
    steps = [(e[a], e[b], e["relation_id"], e[f"{b[:-3]}_name"]) for e in edges.collect() for a, b in (("subject_id", "object_id"), ("object_id", "subject_id"))]
    level, found = [((start,), (), ())], []
    for _ in range(hops):
        level = [((*n, to), (*r, rel), (*names, name)) for n, r, names in level for at, to, rel, name in steps if at == n[-1] and to not in n]
        found += level
    return sorted(found)


def test_paths_run_along_chains_with_every_choice_of_edges(spark):
    edges = parallel_edges(spark)
    seeds = spark.createDataFrame([(1, "a")], "query_id long, node_id string")
    assert listed(graph.simple_paths(edges, seeds, 3)) == walked_paths(edges, "a", 3)


def test_paths_to_named_ends_only(spark):
    edges = parallel_edges(spark)
    seeds = spark.createDataFrame([(1, "a")], "query_id long, node_id string")
    answers = spark.createDataFrame([(1, "q", "it is D5 here")], "query_id long, question string, answer string")
    found = graph.simple_paths(edges, seeds, 3, ends=lambda ends: graph.named_ends(ends, answers))
    assert listed(found) == [p for p in walked_paths(edges, "a", 3) if p[0][-1] == "d"]
    assert found.count() == 7


def star(spark, branches):
    """A node, ``branches`` neighbours and three further nodes at each of them; every second edge to a neighbour is doubled."""
    pairs = [("a", f"b{i}") for i in range(branches) for _ in range(1 + i % 2)] + [(f"b{i}", f"c{i}-{j}") for i in range(branches) for j in range(3)]
    rows = [(f"r{n}", s, "t", s, o, "work_order" if o[0] == "c" else "t", o, "d", str(n), 1) for n, (s, o) in enumerate(pairs)]
    return spark.createDataFrame(rows, "relation_id string, subject_id string, subject_type string, subject_name string, object_id string, "
                                 "object_type string, object_name string, doc_id string, block_id string, revision int")


def test_selection_goes_on_after_the_first_portion(spark):
    edges = star(spark, 9)
    seeds = spark.createDataFrame([(1, "a"), (2, "b1"), (3, "c0-0")], "query_id long, node_id string")
    queries = spark.createDataFrame([(q, "哪些工单") for q in (1, 2, 3)], "query_id long, query string")
    paths = graph.simple_paths(edges, seeds, 2)
    paths = spark.createDataFrame(paths.collect(), paths.schema).coalesce(2)
    in_order = {}
    for r in sorted(paths.collect(), key=lambda r: (r["query_id"], r["end_type"] != "work_order", r["hops"], r["path_id"])):
        in_order.setdefault(r["query_id"], []).append(r)
    for limits in ((7, 6, 9), (None, 7, 6), (50, 500, 500)):
        expected = []
        for query, ranked in in_order.items():
            nodes, found, taken = set(), set(), []
            for rank, r in enumerate(ranked, 1):
                more, further = nodes | set(r["node_ids"]), found | {e["relation_id"] for e in r["path"]}
                if all(m is None or n <= m for n, m in zip((len(taken) + 1, len(more), len(further)), limits)):
                    nodes, found = more, further
                    taken.append(rank)
            expected += [(query, rank, ranked[rank - 1]["path_id"], len(taken) < len(ranked)) for rank in taken]
        for portion in (8, 1000):
            picked = graph.rank_and_select(paths, queries, *limits, portion=portion)
            assert sorted((r["query_id"], r["rank"], r["path_id"], r["truncated"]) for r in picked.collect()) == expected, (limits, portion)
    # The cut it replaces: the first ranked paths only lose what fits later.
    cut = graph.select_paths(graph.rank_paths(paths, queries, 8), 7, 6, 9)
    assert cut.count() < graph.rank_and_select(paths, queries, 7, 6, 9, portion=8).count()


def test_first_ranked_paths_are_held_not_sorted(spark):
    edges = star(spark, 9)
    seeds = spark.createDataFrame([(1, "a"), (2, "b1")], "query_id long, node_id string")
    queries = spark.createDataFrame([(1, "哪些工单"), (2, "what"), (2, "what")], "query_id long, query string")
    paths = graph.simple_paths(edges, seeds, 2)
    paths = spark.createDataFrame(paths.collect(), paths.schema)
    every = graph.rank_paths(paths, queries)
    first = graph.rank_paths(paths, queries, 5)
    assert every.filter("query_id = 2").count() == 2 * paths.filter("query_id = 2").count()
    key = lambda df: sorted((r["query_id"], r["rank"], r["path_id"], r["end_type"]) for r in df.collect())
    assert key(first) == key(every.filter("rank <= 5"))
    assert "Window" not in first._jdf.queryExecution().executedPlan().toString()


def test_steps_judged_once_give_the_verdicts_of_stored_paths(spark):
    edges = parallel_edges(spark)
    seeds = spark.createDataFrame([(1, "a"), (2, "c"), (None, "b")], "query_id long, node_id string")
    revised = edges.filter("relation_id <> 'r6'").withColumn("revision", F.when(F.col("relation_id") == "r3", 2).otherwise(1))
    revised = revised.unionByName(revised.filter("relation_id = 'r5'").withColumn("subject_id", F.lit("x")))
    cited = spark.createDataFrame([(1, "d", str(i)) for i in (0, 2, 5)] + [(2, "d", str(i)) for i in (4, 5)], "query_id long, doc_id string, block_id string")
    plain = graph.simple_paths(edges, seeds, 3).cache()
    rows = lambda df, *by: sorted(map(repr, df.select(*by).collect()))
    for judge, stored, name in (
        (lambda steps: graph.live_steps(steps, revised), graph.validate_paths(plain, revised), "valid"),
        (lambda steps: graph.cited_steps(steps, cited), graph.fully_cited(plain, cited), "complete"),
    ):
        listed = graph.simple_paths(edges, seeds, 3, judge=judge)
        found = (graph.validate_paths if name == "valid" else graph.fully_cited)(listed)
        assert rows(found, "path_id", name) == rows(stored, "path_id", name) and 0 < found.filter(name).count() < found.count()
        # The verdict travels with the edge: no path is exploded or dealt by its id.
        counted = found.groupBy("query_id").agg(F.count_if(name))
        assert "path_id" not in "".join(x for x in counted._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)


def test_counted_paths_are_the_listed_ones(spark):
    edges = parallel_edges(spark).withColumn("object_type", F.when(F.col("relation_id").isin("r3", "r5"), "u").otherwise("t"))
    seeds = spark.createDataFrame([(1, "a"), (1, "d"), (None, "b")], "query_id long, node_id string")
    listed, expected = graph.simple_paths(edges, seeds, 3).collect(), {}
    for r in sorted(listed, key=lambda r: (r["node_ids"], [(e["relation_id"], str(e["revision"])) for e in r["path"]])):
        paths, ends, first = expected.get((r["query_id"], r["hops"], r["end_type"]), (0, set(), r["path_id"]))
        expected[r["query_id"], r["hops"], r["end_type"]] = (paths + 1, ends | {r["node_ids"][-1]}, first)
    counted = graph.count_paths(edges, seeds, 3)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in counted.collect()} == {k: (n, len(e), f) for k, (n, e, f) in expected.items()}


def test_tables_between_steps_are_packed(spark, tmp_path):
    from loreloom.session import cut_lineage

    ids = spark.range(20_000).select(graph.digest_id("relation_", F.col("id").cast("string")).alias("relation_id"))
    size = lambda df: sum(len(open(f.removeprefix("file:"), "rb").read()) for f in df.inputFiles())
    ids.write.option("compression", "snappy").parquet(str(tmp_path / "plain"))
    assert size(cut_lineage(ids)) < 0.7 * size(spark.read.parquet(str(tmp_path / "plain")))


def test_a_document_filter_reaches_its_register(spark):
    edges = extract(spark, "a", ["设备编号", "车站"], [("D-1", "North")]).unionByName(extract(spark, "b", ["设备编号", "工单编号"], [("D-1", "W-1")]))
    inside = graph.edges_in_document(edges, F.lit("a"))
    assert [r["doc_id"] for r in inside.collect()] == ["a"]
    assert "Union" not in inside._jdf.queryExecution().optimizedPlan().toString()


def test_neighbourhood_reads_the_edges_at_its_nodes(spark, monkeypatch):
    edges = parallel_edges(spark).withColumn("status", F.lit("confirmed"))
    seeds = spark.createDataFrame([(1, "a"), (2, "d")], "query_id long, node_id string")
    stored = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df, label="table": stored.append(df.columns) or df)
    found = graph.neighbourhood(edges, seeds, 2)
    assert sorted(map(tuple, found.collect())) == [(1, "a", 0), (1, "b", 1), (1, "c", 1), (1, "d", 2), (2, "a", 2), (2, "b", 2), (2, "c", 1), (2, "d", 0)]
    assert all("at" not in columns for columns in stored)
