"""Landed pages of skewed tables."""

import json
import time
import uuid
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from revlake.plans import ingest_queries
from revlake.sources import pages
from revlake.streaming import ingest, warehouse

SF = "/root/testdata/sf0.001"


def test_a_hot_customer_spreads_over_bounded_pages(spark, tmp_path):
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    hot = F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(F.col("o_custkey")).cast(orders.schema["o_custkey"].dataType)
    orders.withColumn("o_custkey", hot).write.parquet(f"{tmp_path}/orders.parquet")
    made = ingest_queries.request_pages(spark, str(tmp_path))
    size = F.size("data.repository.pullRequests.nodes")
    assert made.agg(F.max(size)).first()[0] <= 2 * ingest_queries.PAGE
    assert made.agg(F.sum(size)).first()[0] == orders.count()
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("ingest_pages", "ingest_rejects"):
        got = [tuple(r[c] for c in sorted(r.asDict())) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
        want = con.execute(entry.oracle_sql()[name]).df()
        assert sorted(got) == sorted(want[sorted(want.columns)].itertuples(index=False, name=None))
    requests = ingest_queries.ingest_requests(spark, str(tmp_path)).toPandas()
    want = con.execute(entry.oracle_sql()["ingest_requests"]).df()
    text = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None)[sorted(df.columns)].itertuples(index=False, name=None))
    assert text(requests) == text(want)


NODE = {"number": 1, "createdAt": "2022-05-06T07:08:09Z", "updatedAt": "2022-05-07T00:00:00Z", "author": {"login": "Mira"}}


def page(*nodes):
    return {"data": {"repository": {"nameWithOwner": "Lake/Rev", "pullRequests": {"nodes": nodes}}}}


def test_a_bad_time_within_an_item_sets_it_aside(spark, tmp_path):
    parts = {
        2: {"reviews": {"nodes": [{"id": "r", "submittedAt": "soon"}]}}, 3: {"comments": {"nodes": [{"id": "c", "createdAt": "32/13"}]}}, 4: {"mergedAt": "never"},
        5: {"reviewThreads": {"nodes": [{"comments": {"nodes": [{"id": "t", "createdAt": "x"}]}}]}}, 6: {"commits": {"nodes": [{"commit": {"oid": "a", "checkSuites": {"nodes": [{"checkRuns": {"nodes": [{"id": "k", "startedAt": "y"}]}}]}}}]}},
        7: {"reviews": {"nodes": [{"id": "ok", "submittedAt": None}]}},
    }
    (tmp_path / "p.json").write_text(json.dumps(page(NODE, *[NODE | {"number": k} | v for k, v in parts.items()])))
    good, bad = pages.split_rejects(pages.read_pr_pages(spark, str(tmp_path)))
    assert {r["node"]["number"] for r in good.collect()} == {1, 7}
    assert {r["item_key"] for r in bad.collect()} == {f"lake/rev#{k}" for k in (2, 3, 4, 5, 6)}


def test_a_later_batch_changes_rows_and_clears_no_reject(spark, tmp_path):
    land, root = tmp_path / "land", str(tmp_path / "tables")
    land.mkdir()
    (land / "1.json").write_text(json.dumps(page(NODE, NODE | {"number": 2, "createdAt": "?"}, NODE | {"number": 3, "createdAt": "2022-06-01T00:00:00Z"})))
    for k in range(2):  # the second run takes the same pages again
        ingest.ingest(spark, str(land), root, f"{tmp_path}/c{k}").awaitTermination()
    first = warehouse.state(spark, root)
    (land / "2.json").write_text(json.dumps(page(NODE | {"title": "renamed", "updatedAt": "2022-05-08T00:00:00Z"})))
    ingest.ingest(spark, str(land), root, f"{tmp_path}/c1").awaitTermination()
    got = {r["number"]: r["title"] for r in ingest.current(spark, root, "fact_pull_requests").collect()}
    assert got == {1: "renamed", 3: ""}
    assert [r["item_key"] for r in ingest.current(spark, root, "rejects").collect()] == ["lake/rev#2"]
    assert [str(r["cursor"]) for r in ingest.current(spark, root, "cursors").collect()] == ["2022-05-07 00:00:00"]  # held by the open reject
    at = warehouse.state(spark, root)
    assert at.parts("fact_pull_requests") == ["2022-05", "2022-06"]
    june, may = (at.folders["fact_pull_requests", m] for m in ("2022-06", "2022-05"))
    assert june == first.folders["fact_pull_requests", "2022-06"] and may != first.folders["fact_pull_requests", "2022-05"]  # the third batch left June alone
    ingest.drop_old_versions(spark, root, 1)
    assert not (tmp_path / "tables" / first.folders["fact_pull_requests", "2022-05"][0]).exists()
    assert {r["number"] for r in ingest.current(spark, root, "fact_pull_requests").collect()} == {1, 3}


def test_landed_pages_take_a_few_times_the_room_of_their_tables(spark, tmp_path):
    big = "/root/testdata/sf0.01"
    landed = ingest_queries._landed(ingest_queries.request_pages(spark, big), "pages")
    size = lambda *at: sum(f.stat().st_size for x in at for f in Path(x).rglob("*") if f.is_file()) + sum(Path(x).stat().st_size for x in at if Path(x).is_file())
    assert size(landed) < 10 * size(f"{big}/orders.parquet", f"{big}/lineitem.parquet")
    assert pages.read_pr_pages(spark, landed).count() == spark.read.parquet(f"{big}/orders.parquet").count()


def test_the_texts_of_one_language_are_dealt_over_tasks(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.withColumn("lang", F.when(F.col("doc_id") % 20 > 0, "en")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/conversations.parquet").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = ingest_queries.issue_pages(spark, str(tmp_path)).select(F.spark_partition_id().alias("task"), F.size("data.repository.issues.nodes").alias("n"), "data.repository.nameWithOwner").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["n"] for r in made) == docs.count()
    assert len({r["task"] for r in made if r["nameWithOwner"]}) > 1


def test_pages_that_come_again_rewrite_no_month_and_new_items_add_to_theirs(spark, tmp_path):
    land, root = tmp_path / "land", str(tmp_path / "tables")
    land.mkdir()
    body = json.dumps(page(NODE, NODE | {"number": 2, "mergedAt": "2022-05-08T00:00:00Z"}))
    (land / "1.json").write_text(body)
    ingest.ingest(spark, str(land), root, f"{tmp_path}/c", cut=False).awaitTermination()
    may = ("fact_pull_requests", "2022-05")
    first = warehouse.state(spark, root).folders[may]
    (land / "2.json").write_text(body)
    ingest.ingest(spark, str(land), root, f"{tmp_path}/c", cut=False).awaitTermination()
    assert warehouse.state(spark, root).folders[may] == first
    (land / "3.json").write_text(json.dumps(page(NODE | {"number": 2, "closedAt": "2022-05-08T00:00:00Z", "mergedAt": None}, NODE | {"number": 3})))
    ingest.ingest(spark, str(land), root, f"{tmp_path}/c", cut=False).awaitTermination()
    got = {r["number"]: (r["merged_at"] is None, r["closed_at"] is None) for r in ingest.current(spark, root, "fact_pull_requests").collect()}
    assert got == {1: (True, True), 2: (True, False), 3: (True, True)}


@pytest.mark.parametrize("name", ["ingest_reviews", "patch_backfill", "ingest_check_runs", "ingest_file_diffs", "ingest_pr_comments", "ingest_review_comments", "sink_months", "two_paths", "ingest_requests", "sink_csv", "sink_json", "ingest_entities", "ingest_repositories", "ingest_pages", "ingest_rejects"])
def test_orders_come_in_loads_that_leave_neither_pages_nor_shuffle_files(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(ingest_queries, "LOAD", 800)
    monkeypatch.setattr(ingest_queries.t, "shared_place", lambda _, kind: f"{tmp_path}/{kind}-{uuid.uuid4().hex}")
    landed, sizes = ingest_queries._landed, []

    def counted(df, kind):
        at = landed(df, kind)
        if kind == "pages":
            sizes.append(pages.read_pr_pages(spark, at).count())
        return at

    monkeypatch.setattr(ingest_queries, "_landed", counted)
    shuffled = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = shuffled()
    made = entry.queries()[name](spark, SF)
    until = time.time() + 10
    while shuffled() - before and time.time() < until:  # executors drop them a little later
        time.sleep(0.2)
    assert not shuffled() - before
    assert not [p for kind in ("pages", "search", "patches", "issues") for p in tmp_path.glob(f"{kind}-*")]
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert sum(sizes) == orders and max(sizes) < 0.6 * orders
    con = duckdb.connect()
    for table in ("orders", "lineitem", "documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    text = lambda rows, columns: sorted(tuple(str(r[c]) for c in sorted(columns)) for r in rows)
    rows = want.astype(object).where(want.notna(), None).to_dict("records")
    assert text((r.asDict() for r in made.collect()), made.columns) == text(rows, want.columns)


def test_pages_are_texts_made_by_even_tasks_and_hold_odd_values(spark, tmp_path):
    title = F.expr("CASE WHEN o_orderkey % 5 = 0 THEN 'a \"b\" \\\\ c\\n\\t\\u2028é' WHEN o_orderkey % 5 = 1 THEN '' WHEN o_orderkey % 5 > 2 THEN o_orderpriority END")
    none = lambda c, k, n: F.when(F.col(k) % n != 0, F.col(c))
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumn("o_orderpriority", title).withColumn("o_custkey", none("o_custkey", "o_orderkey", 19)).withColumn("o_orderdate", none("o_orderdate", "o_orderkey", 23))
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_orderkey % 7 <> 0")  # some orders have none
    for c, n in (("l_suppkey", 11), ("l_partkey", 13), ("l_shipdate", 17), ("l_returnflag", 5), ("l_linestatus", 29)):
        lines = lines.withColumn(c, none(c, "l_orderkey", n))
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    landed = ingest_queries._gzipped(ingest_queries.request_texts(spark, str(tmp_path)), f"{tmp_path}/pages")
    assert len(list(Path(landed).glob("part-*"))) > spark.sparkContext.defaultParallelism
    items = pages.read_pr_pages(spark, landed)
    got = {r["number"]: r for r in items.select("node.*", "header.nameWithOwner").collect()}
    want = orders.join(lines.groupBy("l_orderkey").agg(F.collect_list(F.struct(*lines.columns)).alias("x")), F.col("o_orderkey") == F.col("l_orderkey"), "left").collect()
    assert len(got) == len(want)
    for r in want:
        node, x = got[r["o_orderkey"]], r["x"] or []
        assert node["title"] == r["o_orderpriority"] and node["nameWithOwner"] == (None if r["o_custkey"] is None else f"Owner/Repo{r['o_custkey']}")
        assert (node["updatedAt"] is None) == (r["o_orderdate"] is None)
        assert sorted(str((n["state"], n["author"] and n["author"]["login"])) for n in node["reviews"]["nodes"]) == sorted(str((None if i["l_returnflag"] == "N" else i["l_returnflag"], None if i["l_suppkey"] is None else f"Dev{i['l_suppkey']}")) for i in x)
        assert len(node["reviewThreads"]["nodes"]) == sum(i["l_linestatus"] == "O" for i in x) and len(node["comments"]["nodes"]) == sum(i["l_linestatus"] not in ("O", None) for i in x)
        assert {n["path"] for n in node["files"]["nodes"]} == {None if i["l_partkey"] is None else f"src/{i['l_partkey']}" for i in x}
        first, last = (c["commit"] for c in node["commits"]["nodes"])
        assert first["oid"] == "old" and [k["id"][:6] for k in first["checkSuites"]["nodes"][0]["checkRuns"]["nodes"]] == ["old-K-"][: len(x)]
        assert len(last["checkSuites"]["nodes"][0]["checkRuns"]["nodes"]) == len(x)


def test_pages_are_parsed_and_judged_once_for_all_their_tables(spark, monkeypatch):
    plans, tables = [], pages.request_tables

    def watched(items, zone):
        plans.append(items._jdf.queryExecution().executedPlan().toString())
        return tables(items, zone)

    monkeypatch.setattr(pages, "request_tables", watched)
    entry.queries()["ingest_pages"](spark, SF)
    assert plans and not [p for p in plans if "lambda" in p or "Scan json" in p]


def test_the_half_that_is_merged_into_itself_is_parsed_once(spark, monkeypatch):
    plans, merge_table = [], ingest_queries.merge.merge_table

    def watched(name, old, batch, order):
        plans.append((old._jdf.queryExecution().executedPlan().toString(), batch._jdf.queryExecution().executedPlan().toString()))
        return merge_table(name, old, batch, order)

    monkeypatch.setattr(ingest_queries.merge, "merge_table", watched)
    entry.queries()["two_paths"](spark, SF)
    assert plans and all("Scan json" not in old and batch.count("Scan json") == 1 for old, batch in plans)
