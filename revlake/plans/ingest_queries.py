"""Queries that land JSON pages made of the given tables, and read them back through the ingest path."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import listing, merge
from ..operators.coverage import advance_cursors, gaps
from ..sources import pages, sinks
from ..sources import schema as S
from ..streaming import ingest
from . import tables as t

#: Nodes on a page, about: those of an owner with more are dealt over several by their hash, as a forge cuts its pages.
PAGE = 50
#: Orders of a load, about, and the most loads: disk has one load's shuffle files and pages beside the rows that are stored.
LOAD, MOST_LOADS = 250_000, 16
#: Files of what is landed at once, about: a stream takes 100 in a batch.
FILES = 96
Load = tuple[int, int]
WHOLE: Load = (0, 1)
ZONE = "America/Los_Angeles"


def _gzipped(df: DataFrame, path: str, *by: str) -> str:
    """Pages as gzip JSON lines, as a forge sends them: their keys repeat, so that they take about an eighth of the room, at
    the level that costs least. A column named value holds lines that are JSON already."""
    out = df.write.mode("append").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").partitionBy(*by)
    with t.shuffles_dropped(df.sparkSession):
        out.text(path) if "value" in df.columns else out.json(path)
    return path


def _landed(df: DataFrame, name: str) -> str:
    return _gzipped(df, t.shared_place(df.sparkSession, name))


def _own(df: DataFrame, key: str, load: Load) -> DataFrame:
    """A load's rows: orders and what belongs to them go by a hash of the order's key."""
    k, n = load
    return df if n == 1 else df.filter(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(n)) == k)


def _stored(spark: SparkSession, d: str, tables: Callable[[Load, Callable[[DataFrame, str], str]], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The tables that the loads bring, one load after another; tables gets a load and what lands pages for it. A load's pages
    go when its rows are stored, and its shuffle files when what wrote them ends."""
    n = max(1, min(MOST_LOADS, math.ceil(t.read(spark, d, "orders").count() / LOAD)))
    root, made = t.shared_place(spark, "stored"), {}
    with t.shuffles_dropped(spark):
        for k in range(n):
            landed: list[str] = []

            def land(df: DataFrame, name: str, write: Callable[[DataFrame, str], str] | None = None, landed: list[str] = landed) -> str:
                landed.append((write or _landed)(df, name))
                return landed[-1]

            made = tables((k, n), land)
            for name, df in made.items():
                df.write.mode("append").option("compression", "zstd").parquet(f"{root}/{name}")
            t.drop_places(spark, *landed)
    return {name: spark.read.schema(df.schema).parquet(f"{root}/{name}") for name, df in made.items()}


def _as_parquet(df: DataFrame, name: str) -> str:
    df.write.parquet(at := t.shared_place(df.sparkSession, name))
    return at


def _iso(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _nodes(nodes: Column) -> Column:
    return F.struct(nodes.alias("nodes"))


def _actor(login: Column, bot: Column | bool = False) -> Column:
    """Null without a login."""
    return F.when(login.isNotNull(), F.struct(login.alias("login"), F.when(F.lit(bot) if isinstance(bot, bool) else bot, "Bot").otherwise("User").alias("__typename")))


def _dev(key: Column | str) -> Column:
    return F.concat(F.lit("Dev"), F.col(key) if isinstance(key, str) else key)


def _dealt(df: DataFrame, owner: str, key: str) -> DataFrame:
    """With the number of a row's page among its owner's, which has about PAGE rows. df is narrow: an owner's rows meet."""
    many = df.groupBy(owner).agg(F.ceil(F.count("*") / PAGE).alias("n_pages")).filter("n_pages > 1")
    return df.join(many, owner, "left").withColumn("page", F.pmod(F.xxhash64(key), F.coalesce("n_pages", F.lit(1)))).drop("n_pages")


_ORDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_LINE = ["l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"]


def _text(c: Column | str) -> Column:
    """A JSON string of text that needs no escapes: numbers, times, and what is put around them."""
    return _joined('"', c, '"')


def _escaped(c: Column) -> Column:
    """A JSON string of any text."""
    one = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(one, F.lit(2), F.length(one) - 2))


def _joined(*parts: Column | str) -> Column:
    """One text of constants and columns."""
    out: list[Column | str] = []
    for c in parts:
        if isinstance(c, str) and out and isinstance(out[-1], str):
            out[-1] += c
        else:
            out.append(c)
    return F.concat(*[F.lit(c) if isinstance(c, str) else c for c in out])


def _object(**parts: Column | str | list[Column | str]) -> Column:
    """A JSON object of JSON texts; a list is a string's pieces, none of them null."""
    flat: list[Column | str] = []
    for name, c in parts.items():
        flat += [f',"{name}":', *(['"', *c, '"'] if isinstance(c, list) else [c] if isinstance(c, str) else [F.coalesce(c, F.lit("null"))])]
    return _joined("{" + flat[0][1:], *flat[1:], "}")


def _list(parts: Column) -> Column:
    """A JSON object with an array of JSON texts as its nodes; those that are null are left out."""
    return _joined('{"nodes":[', F.concat_ws(",", parts), "]}")


def _actor_text(key: Column, bot: Column) -> Column:
    """Null without a key."""
    return _joined('{"login":"Dev', key, F.when(bot, '","__typename":"Bot"}').otherwise('","__typename":"User"}'))


def _line_names(order: Column, x: Column) -> Column:
    """What the parts of a line item share: its key, actor, path and time."""
    k = F.concat_ws("-", order, x["l_linenumber"], x["l_suppkey"], x["l_partkey"])
    names = {"k": k, "who": _actor_text(x["l_suppkey"], x["l_suppkey"] % 9 == 0), "path": _joined('"src/', x["l_partkey"], '"'), "at": _text(_iso(x["l_shipdate"])), "l": x}
    return F.struct(*[c.alias(n) for n, c in names.items()])


def _line_parts(order: Column, x: Column) -> Column:
    """What a line item becomes: review, thread, comment, file and check run, as JSON texts."""
    k, who, path, at, line = x["k"], x["who"], x["path"], x["at"], x["l"]
    flag, open_, number = line["l_returnflag"], line["l_linestatus"] == "O", line["l_linenumber"].cast("string")
    bad = (order % 103 == 0) & (line["l_linenumber"] == 1)
    submitted = F.when(bad, '"yesterday"').when(line["l_linenumber"] != 7, at)
    review = _object(id=["R-", k], state=F.when(flag != "N", line["flag"]), body=F.when(flag == "R", '"please change"').otherwise('""'), submittedAt=submitted, author=who)
    said = lambda prefix, **more: _object(id=[prefix, k], body=_joined('"see ', line["l_partkey"], '"'), path=path, line=number, createdAt=at, **more)
    thread = lambda *nodes: _joined('{"comments":{"nodes":[', *nodes, "]}}")
    first = said("C-", author=who)
    threads = F.when(open_ & (flag == "R"), thread(first, ",", said("P-", replyTo=_object(id=["C-", k])))).when(open_, thread(first))
    note = _object(id=["N-", k], body='"note"', createdAt=at, author=who)
    file = _object(path=path, additions=line["l_quantity"].cast("long").cast("string"), deletions="0")
    run = lambda prefix: _object(id=[prefix, k], name=_joined('"ci-', number, '"'), conclusion=F.when(flag == "R", '"FAILURE"').when(flag == "A", '"SUCCESS"'), startedAt=at, completedAt=at)
    parts = {"r": review, "th": threads, "c": F.when(~open_, note), "f": file, "k": run("K-")}
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def _with_parts(o: Column) -> Column:
    """An order with its key as text and what its lines become. Each step is made once, as the next one reads its fields."""
    lines = F.transform(F.transform(o["lines"], lambda x: _line_names(o["o_orderkey"], x)), lambda x: _line_parts(o["o_orderkey"], x))
    return F.struct(o.alias("o"), lines.alias("p"))


def _request_text(x: Column, moved: bool = False, **more: Column | None) -> Column:
    """The JSON text of an order with its parts as a request. moved: created 40 days later, and updated then, as a forge may
    serve it after a transfer."""
    o, part, later = x["o"], x["p"], F.expr("interval 40 days")
    key, merged, date = o["o_orderkey"], o["o_orderstatus"] == "F", o["o_orderdate"]
    day, done = _text(_iso(date + later if moved else date)), F.when(merged, _text(_iso(date + F.expr("interval 30 hours"))))
    commit = lambda oid, runs: ('{"commit":{', oid, '"checkSuites":{"nodes":[{"checkRuns":', _list(runs), "}]}}}")
    earlier = F.transform(F.slice(part["k"], 1, 1), lambda run: _joined('{"id":"old-', F.substring(run, F.lit(8), F.length(run))))
    sha = F.when(key % 11 != 0, _joined('"oid":"sha', key, '",')).otherwise("")
    files = F.array_distinct(part["f"])
    node = {
        "number": key.cast("string"), "title": o["o_orderpriority"], "state": F.when(merged, '"MERGED"'), "createdAt": F.when(key % 97 == 0, '"not-a-timestamp"').otherwise(day), "updatedAt": day, "mergedAt": done, "closedAt": done,
        "baseRefName": '"main"', "headRefName": _joined('"f', key, '"'), "additions": o["o_totalprice"].cast("long").cast("string"), "changedFiles": F.size(files).cast("string"), "author": F.when(key % 89 != 0, _actor_text(o["o_custkey"], F.lit(False))),
        "mergedBy": F.when(merged, '{"login":"Merge[bot]","__typename":"User"}'), "reviews": _list(part["r"]), "reviewThreads": _list(part["th"]), "comments": _list(part["c"]), "files": _list(files),
        "commits": _joined('{"nodes":[', *commit('"oid":"old",', earlier), ",", *commit(sha, part["k"]), "]}"),
    }
    return _object(**node | more)


def _request_orders(spark: SparkSession, d: str, load: Load, moved: bool = False, tasks: int = 0) -> DataFrame:
    """o_custkey, orders: those of a page, with their parts. The given columns are shuffled, and become text on their page."""
    line = _own(t.read(spark, d, "lineitem"), "l_orderkey", load).select("l_orderkey", F.struct(*_LINE, _escaped(F.col("l_returnflag")).alias("flag")).alias("x"))
    lines = line.groupBy("l_orderkey").agg(F.collect_list("x").alias("lines"))
    title = F.col("o_orderpriority")
    own = _own(t.read(spark, d, "orders"), "o_orderkey", load).select(*_ORDER).withColumn("o_orderpriority", _escaped(F.concat(title, F.lit(" moved")) if moved else title))
    o = _dealt(own, "o_custkey", "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # even ones: the work is in these
    tasks = tasks or (min(many, FILES) if load == WHOLE else many)
    by = o.select("o_custkey", "page", F.struct(*_ORDER, "lines").alias("o")).repartition(tasks, "o_custkey", "page").groupBy("o_custkey", "page").agg(F.collect_list("o").alias("orders"))
    return by.select("o_custkey", F.transform("orders", _with_parts).alias("orders"))


def _repository_text(owner: Column) -> Column:
    """The fields of a repository."""
    return _joined('"nameWithOwner":', F.coalesce(_joined('"Owner/Repo', owner, '"'), F.lit("null")), ',"isFork":false,"primaryLanguage":{"name":"Rust"},"createdAt":"1992-01-01T00:00:00Z"')


def _as_pages(texts: DataFrame, schema: str) -> DataFrame:
    return texts.select(F.from_json("value", schema).alias("page")).select("page.*")


def request_texts(spark: SparkSession, d: str, load: Load = WHOLE, moved: bool = False, some: Callable[[Column], Column] | None = None) -> DataFrame:
    """value: pages of each customer with requests, as the wire has it: orders are requests, their line items what stands in
    them. some: which of the orders, by their key."""
    by = _request_orders(spark, d, load, moved)
    orders = F.filter("orders", lambda x: some(x["o"]["o_orderkey"])) if some else F.col("orders")
    nodes = F.concat_ws(",", F.transform(orders, lambda x: _request_text(x, moved)))
    return by.select(_joined('{"data":{"repository":{', _repository_text(F.col("o_custkey")), ',"pullRequests":{"nodes":[', nodes, "]}}}}").alias("value"))


def request_pages(spark: SparkSession, d: str, load: Load = WHOLE) -> DataFrame:
    """The same pages, read."""
    return _as_pages(request_texts(spark, d, load), S.PR_PAGE)


def search_texts(spark: SparkSession, d: str, load: Load = WHOLE, tasks: int = 0) -> DataFrame:
    """value, author: the same requests as a search by person finds them: each node has its repository, and nodes without a
    number come too. author: the login of the page's first request."""
    by = _request_orders(spark, d, load, tasks=tasks)
    repository = _joined("{", _repository_text(F.col("o_custkey")), "}")
    found = F.transform("orders", lambda x: _request_text(x, repository=repository))
    lost = F.transform(F.slice("orders", 1, 1), lambda x: _request_text(x, number=F.lit(None).cast("string"), repository=repository))
    first = F.col("orders")[0]["o"]
    author = F.when(first["o_orderkey"] % 89 != 0, _dev(first["o_custkey"]))
    return by.select(_joined('{"data":{"search":{"nodes":[', F.concat_ws(",", F.concat(found, lost)), "]}}}").alias("value"), author.alias("author"))


def issue_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each language with issues: documents are issues, the turns of a conversation of that number their comments."""
    turn = t.read(spark, d, "conversations")
    note = F.struct(F.concat_ws("-", F.lit("T"), "conv_id", "turn").alias("id"), F.col("text").alias("body"), F.lit("2024-03-10T10:30:00Z").alias("createdAt"), _actor(F.concat(F.lit("Dev"), F.col("conv_id") % 30), F.col("role") == "assistant").alias("author"))
    notes = turn.groupBy("conv_id").agg(F.collect_list(note).alias("c"))
    doc = t.read(spark, d, "documents")
    dealt = _dealt(doc.select("lang", "doc_id").distinct(), "lang", "doc_id").select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"), "page")  # a language's texts do not meet
    same = F.coalesce(F.col("lang") == F.col("_lang"), F.col("lang").isNull() & F.col("_lang").isNull())
    doc = doc.join(notes, F.col("doc_id") == F.col("conv_id"), "left").join(dealt, (F.col("doc_id") == F.col("_id")) & same, "left")
    k = F.col("doc_id")
    day = lambda n: _iso(F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int")).cast("timestamp"))
    created = F.when(k % 61 == 0, "2024-13-45").otherwise(day(k % 300))
    closed = k % 3 == 0
    stone = F.struct(F.concat(F.lit("M-"), "lang", F.lit("-"), "source").alias("id"), F.lit(1).cast("long").alias("number"), F.col("source").alias("title"), F.lit("OPEN").alias("state"), day(F.lit(400)).alias("dueOn"), day(F.lit(1)).alias("createdAt"))
    label = lambda *name: F.struct(F.concat_ws("-", F.lit("L"), "lang", *name).alias("id"), F.concat_ws("-", *name).alias("name"), F.when(k % 2 == 0, "ff0000").alias("color"))
    node = {
        "id": F.concat(F.lit("I-"), k), "number": k, "title": F.col("source"), "body": F.col("text"), "state": F.when(closed, "CLOSED").otherwise("OPEN"), "stateReason": F.when(closed, "COMPLETED"), "createdAt": created, "updatedAt": F.when(k % 5 != 0, day(k % 300 + 7)),
        "closedAt": F.when(closed, day(k % 300 + 7)), "author": _actor(F.when(k % 13 != 0, F.concat(F.lit("Dev"), k % 40))), "milestone": F.when(k % 4 == 0, stone), "labels": _nodes(F.array(label(F.lit("bug")), label(F.lit("from"), F.lit("docs")))),
        "assignees": _nodes(F.array(_actor(F.concat(F.lit("Dev"), k % 7)), _actor(F.concat(F.lit("DEV"), k % 7)))), "comments": _nodes(F.col("c")),
    }
    by = doc.groupBy("lang", "page").agg(F.collect_list(F.struct(*[c.alias(n) for n, c in node.items()])).alias("nodes"))
    return by.select(F.struct(F.struct(F.concat(F.lit("Docs/"), F.upper("lang")).alias("nameWithOwner"), F.struct("nodes").alias("issues")).alias("repository")).alias("data"))


def shown(df: DataFrame) -> DataFrame:
    """Dates and times as text."""
    text = {"date": lambda c: F.col(c).cast("string"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")}
    return df.select(*[text[kind](c).alias(c) if kind in text else F.col(c) for c, kind in df.dtypes])


def _loaded(spark: SparkSession, d: str, rows: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """What rows makes of the accepted and the rejected requests of each load."""
    return _stored(spark, d, lambda load, land: {"rows": rows(*_requests(spark, d, load, land))})["rows"]


def _requests(spark: SparkSession, d: str, load: Load = WHOLE, land: Callable[[DataFrame, str], str] = _landed) -> tuple[DataFrame, DataFrame]:
    return pages.split_rejects(pages.read_pr_pages(spark, land(request_texts(spark, d, load), "pages")))


def _issues(spark: SparkSession, d: str, land: Callable[[DataFrame, str], str] = _landed) -> tuple[DataFrame, DataFrame]:
    return pages.split_rejects(pages.read_issue_pages(spark, land(issue_pages(spark, d), "issues")))


QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# --- requests

_O = """o AS (SELECT *, 'owner/repo' || o_custkey AS repo_key, 'owner/repo' || o_custkey || '#' || o_orderkey AS pr_key FROM orders WHERE o_orderkey % 97 <> 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 103 = 0 AND l_linenumber = 1)),
l AS (SELECT lineitem.*, pr_key, repo_key, o_orderkey, l_orderkey || '-' || l_linenumber || '-' || l_suppkey || '-' || l_partkey AS k, CASE WHEN l_suppkey % 9 = 0 THEN 'bot:dev' ELSE 'user:dev' END || l_suppkey AS who, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS moment FROM lineitem JOIN o ON l_orderkey = o_orderkey)"""


def _day(c: str) -> str:
    return f"CAST(CAST({c} AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}' AS DATE) AS VARCHAR)"


def _hour(c: str) -> str:
    return f"strftime({c} AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}', '%H:00')"


_DONE = "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 HOUR END"
_REQUESTS = f"""WITH {_O}, n AS (SELECT l_orderkey, count(*) AS reviews, count(*) + count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS comments, count(DISTINCT (l_partkey, CAST(l_quantity AS BIGINT))) AS files FROM lineitem GROUP BY 1)
SELECT pr_key, o_orderkey AS number, repo_key, CASE WHEN o_orderkey % 89 = 0 THEN 'user:ghost' ELSE 'user:dev' || o_custkey END AS author_key, CASE WHEN o_orderstatus = 'F' THEN 'MERGED' ELSE 'OPEN' END AS state, FALSE AS is_draft, o_orderpriority AS title, '' AS body, 'main' AS base_ref, 'f' || o_orderkey AS head_ref,
strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_at, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS updated_at, strftime({_DONE}, '%Y-%m-%d %H:%M:%S') AS merged_at, strftime({_DONE}, '%Y-%m-%d %H:%M:%S') AS closed_at, CASE WHEN o_orderstatus = 'F' THEN 'bot:merge[bot]' END AS merged_by_key,
{_day("o_orderdate")} AS created_date_key, {_hour("o_orderdate")} AS created_time_key, {_day("o_orderdate")} AS updated_date_key, {_hour("o_orderdate")} AS updated_time_key, {_day(f"({_DONE})")} AS merged_date_key,
coalesce(comments, 0) AS comment_count, coalesce(reviews, 0) AS review_count, coalesce(files, 0) AS changed_files, CAST(trunc(o_totalprice) AS BIGINT) AS additions, CAST(0 AS BIGINT) AS deletions FROM o LEFT JOIN n ON l_orderkey = o_orderkey"""


@query(_REQUESTS)
def ingest_requests(spark: SparkSession, d: str) -> DataFrame:
    """The request facts themselves."""
    return shown(_loaded(spark, d, lambda good, _: pages.pull_requests(good, ZONE)))


@query(f"WITH {_O} SELECT 'R-' || k AS review_key, pr_key, who AS reviewer_key, CASE WHEN l_returnflag = 'N' THEN 'COMMENTED' ELSE l_returnflag END AS state, CASE WHEN l_returnflag = 'R' THEN 'please change' END AS body, moment AS submitted_at, {_day('l_shipdate')} AS submitted_date_key, {_hour('l_shipdate')} AS submitted_time_key FROM l WHERE l_linenumber <> 7")
def ingest_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Reviews that have been submitted."""
    return shown(_loaded(spark, d, lambda good, _: pages.reviews(good, ZONE)))


_SAID = f"pr_key, 'src/' || l_partkey AS path, CAST(l_linenumber AS BIGINT) AS line, 'see ' || l_partkey AS body, moment AS created_at, {_day('l_shipdate')} AS created_date_key, {_hour('l_shipdate')} AS created_time_key"


@query(f"WITH {_O} SELECT 'C-' || k AS comment_key, who AS author_key, NULL AS in_reply_to, {_SAID} FROM l WHERE l_linestatus = 'O' UNION ALL SELECT 'P-' || k, 'user:ghost', 'C-' || k, {_SAID} FROM l WHERE l_linestatus = 'O' AND l_returnflag = 'R'")
def ingest_review_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of all threads; one without an actor is the ghost's."""
    return shown(_loaded(spark, d, lambda good, _: pages.review_comments(good, ZONE)).drop("review_key"))


@query(f"WITH {_O} SELECT 'N-' || k AS comment_key, 'pull_request' AS parent_type, pr_key AS parent_key, who AS author_key, 'note' AS body, moment AS created_at, {_day('l_shipdate')} AS created_date_key, {_hour('l_shipdate')} AS created_time_key FROM l WHERE l_linestatus <> 'O'")
def ingest_pr_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of the conversation."""
    return shown(_loaded(spark, d, lambda good, _: pages.pr_comments(good, ZONE)).drop("in_reply_to"))


@query(f"WITH {_O} SELECT DISTINCT pr_key || ':src/' || l_partkey AS file_diff_key, pr_key, repo_key, 'src/' || l_partkey AS file_path, 'MODIFIED' AS change_type, CAST(l_quantity AS BIGINT) AS additions, CAST(0 AS BIGINT) AS deletions FROM l")
def ingest_file_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Changed files."""
    return _loaded(spark, d, lambda good, _: pages.file_diffs(good)).drop("previous_path", "patch")


@query(f"WITH {_O} SELECT 'K-' || k AS check_run_key, pr_key, 'sha' || o_orderkey AS head_sha, 'ci-' || l_linenumber AS name, 'COMPLETED' AS status, CASE l_returnflag WHEN 'R' THEN 'FAILURE' WHEN 'A' THEN 'SUCCESS' END AS conclusion, moment AS started_at, moment AS completed_at FROM l WHERE o_orderkey % 11 <> 0")
def ingest_check_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the last commit; none where its hash is missing."""
    return shown(_loaded(spark, d, lambda good, _: pages.check_runs(good)))


_DOC = "d AS (SELECT *, doc_id % 300 AS n FROM documents WHERE doc_id % 61 <> 0), tn AS (SELECT conversations.*, d.lang, CASE WHEN role = 'assistant' THEN 'bot:dev' ELSE 'user:dev' END || (conv_id % 30) AS who FROM conversations JOIN d ON doc_id = conv_id)"


@query(f"""WITH {_O}, {_DOC}, a AS (SELECT 'user:dev' || o_custkey AS entity_key, 'Dev' || o_custkey AS name FROM o WHERE o_orderkey % 89 <> 0 UNION SELECT 'bot:merge[bot]', 'Merge[bot]' FROM o WHERE o_orderstatus = 'F' UNION SELECT who, 'Dev' || l_suppkey FROM l
UNION SELECT 'user:dev' || (doc_id % 40), 'Dev' || (doc_id % 40) FROM d WHERE doc_id % 13 <> 0 UNION SELECT 'user:dev' || (doc_id % 7), 'DEV' || (doc_id % 7) FROM d UNION SELECT who, 'Dev' || (conv_id % 30) FROM tn UNION SELECT 'user:ghost', 'ghost')
SELECT entity_key, split_part(entity_key, ':', 1) AS entity_type, substr(entity_key, strpos(entity_key, ':') + 1) AS login, entity_key LIKE 'user:%' AS is_human, entity_key LIKE 'bot:%' AS is_bot, min(name) AS name FROM a GROUP BY 1""")
def ingest_entities(spark: SparkSession, d: str) -> DataFrame:
    """Actors of requests and issues in all places."""

    def tables(load: Load, land: Callable[[DataFrame, str], str]) -> dict[str, DataFrame]:
        issues = _issues(spark, d, land)[0] if load[0] == 0 else None  # all come with the first load
        return {"rows": pages.named_actors(_requests(spark, d, load, land)[0], issues)}

    return pages.entities_of(_stored(spark, d, tables)["rows"])


@query(f"WITH {_O} SELECT DISTINCT repo_key, 'owner' AS owner, 'repo' || o_custkey AS name, 'Rust' AS primary_language, FALSE AS is_fork, FALSE AS is_private, '1992-01-01 00:00:00' AS created_at FROM o")
def ingest_repositories(spark: SparkSession, d: str) -> DataFrame:
    """Repositories of the pages' headers."""
    return shown(_loaded(spark, d, lambda good, _: pages.repositories(good)).dropDuplicates(["repo_key"]).drop("default_branch"))


@query(f"""WITH {_O} SELECT 'dim_repositories' AS "table", count(DISTINCT o_custkey) AS n FROM o
UNION ALL SELECT 'dim_entities', count(DISTINCT k) FROM (SELECT 'user:dev' || o_custkey AS k FROM o WHERE o_orderkey % 89 <> 0 UNION SELECT who FROM l UNION SELECT 'bot:merge[bot]' FROM o WHERE o_orderstatus = 'F' UNION SELECT 'user:ghost')
UNION ALL SELECT 'fact_pull_requests', count(*) FROM o UNION ALL SELECT 'fact_reviews', count(*) FROM l WHERE l_linenumber <> 7
UNION ALL SELECT 'fact_file_diffs', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) FROM l)
UNION ALL SELECT 'fact_review_comments', count(*) + count(*) FILTER (l_returnflag = 'R') FROM l WHERE l_linestatus = 'O'
UNION ALL SELECT 'fact_issue_comments', count(*) FROM l WHERE l_linestatus <> 'O' UNION ALL SELECT 'fact_check_runs', count(*) FROM l WHERE o_orderkey % 11 <> 0""")
def ingest_pages(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each table that the landed pages fill."""
    dims = {"dim_repositories": "repo_key", "dim_entities": "entity_key"}  # several loads bring a row of these

    def tables(load: Load, land: Callable[..., str]) -> dict[str, DataFrame]:
        good = _requests(spark, d, load, land)[0]
        parsed = land(good, "items", _as_parquet)  # pages are parsed and judged once, and each table reads its own columns
        made = pages.request_tables(spark.read.schema(good.schema).parquet(parsed), "UTC")
        return {name: df.select(dims[name]) if name in dims else df.agg(F.count("*").alias("n")) for name, df in made.items()}

    out = None
    for name, df in sorted(_stored(spark, d, tables).items()):
        n = F.count_distinct(dims[name]) if name in dims else F.sum("n")
        one = df.agg(n.alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


_BAD = "o_orderkey % 97 = 0 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 103 = 0 AND l_linenumber = 1)"


@query(f"WITH a AS (SELECT 'owner/repo' || o_custkey AS repo_key, max(o_orderdate) FILTER (NOT bad) AS newest, min(o_orderdate) FILTER (bad) AS first_bad, count(*) FILTER (bad) AS rejected FROM (SELECT *, {_BAD} AS bad FROM orders) GROUP BY 1) SELECT repo_key, strftime(least(first_bad, newest), '%Y-%m-%d') AS cursor, rejected FROM a WHERE newest IS NOT NULL")
def ingest_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Per repository: rejected items and the cursor, the newest accepted time or the oldest rejected one, whichever is less."""

    def tables(load: Load, land: Callable[[DataFrame, str], str]) -> dict[str, DataFrame]:
        good, bad = _requests(spark, d, load, land)
        accepted = good.select(F.lower("header.nameWithOwner").alias("repo_key"), F.try_to_timestamp("node.updatedAt").alias("updated_at"))
        return {"accepted": accepted, "rejected": bad.select(F.split_part("item_key", F.lit("#"), F.lit(1)).alias("repo_key"), "updated_at")}

    accepted, rejected = _stored(spark, d, tables).values()
    old = accepted.limit(0).select("repo_key", F.col("updated_at").alias("cursor"))
    n = rejected.groupBy("repo_key").agg(F.count("*").alias("rejected"))
    return advance_cursors(old, accepted, rejected, ["repo_key"]).join(n, "repo_key", "left").select("repo_key", F.date_format("cursor", "yyyy-MM-dd").alias("cursor"), F.coalesce("rejected", F.lit(0)).cast("long").alias("rejected"))


@query(_REQUESTS)
def two_paths(spark: SparkSession, d: str) -> DataFrame:
    """Requests that repository pages and person searches both bring land once."""

    def tables(load: Load, land: Callable[[DataFrame, str], str]) -> dict[str, DataFrame]:
        found = pages.split_rejects(pages.read_search_pages(spark, land(search_texts(spark, d, load).select("value"), "search")))[0]
        by_repo, by_person = (pages.pull_requests(path_items, ZONE) for path_items in (_requests(spark, d, load, land)[0], found))
        some = by_repo.filter("number % 3 <> 0")
        half = spark.read.schema(some.schema).parquet(land(some, "half", _as_parquet))  # is old and in the batch: parsed once
        both = half.unionByName(by_person)
        return {"rows": merge.merge_table("fact_pull_requests", half, both, [F.desc("updated_at"), F.col("pr_key")])}

    return shown(_stored(spark, d, tables)["rows"])


@query(f"WITH {_O}, f AS (SELECT DISTINCT pr_key, l_partkey, CAST(l_quantity AS BIGINT) AS q FROM l) SELECT pr_key || ':src/' || l_partkey AS file_diff_key, q AS additions, CASE WHEN l_partkey % 2 = 0 THEN '@@ ' || l_partkey END AS patch, CASE WHEN l_partkey % 4 = 0 THEN 'old/' || l_partkey END AS previous_path FROM f")
def patch_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Patches of scanned files reach the diffs that exist; files that no request has are left out."""

    def tables(load: Load, land: Callable[[DataFrame, str], str]) -> dict[str, DataFrame]:
        diffs = pages.file_diffs(_requests(spark, d, load, land)[0])
        orders, lines = (_own(t.read(spark, d, table), key, load) for table, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")))
        line = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter("l_partkey % 2 = 0")
        pr_key = F.concat(F.lit("owner/repo"), "o_custkey", F.lit("#"), "o_orderkey")
        found = F.struct(F.concat(F.lit("src/"), "l_partkey").alias("filename"), F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("old/"), "l_partkey")).alias("previous_filename"), F.concat(F.lit("@@ "), "l_partkey").alias("patch"))
        lost = [found.withField("filename", F.concat(F.lit("gone/"), found["filename"])), found.withField("filename", F.lit(None).cast("string"))]
        scan = line.select(pr_key.alias("pr_key"), F.explode(F.array(found, *lost)).alias("x")).select("pr_key", "x.*")  # joined once
        patches = pages.read_patches(spark, land(scan, "patches"))
        return {"rows": merge.backfill_patches(diffs, patches).select("file_diff_key", "additions", "patch", "previous_path")}

    return _stored(spark, d, tables)["rows"]


# --- issues

_STAMP = "strftime(DATE '2024-01-01' + CAST({} AS INTEGER), '%Y-%m-%d %H:%M:%S')"
_CREATED = "DATE '2024-01-01' + CAST(n AS INTEGER)"


@query(f"WITH {_DOC}, c AS (SELECT conv_id, count(*) AS n_comments FROM conversations GROUP BY 1) SELECT 'I-' || doc_id AS id, 'docs/' || lang AS repo_key, doc_id AS number, source AS title, text AS body, CASE WHEN doc_id % 3 = 0 THEN 'closed' ELSE 'open' END AS state, CASE WHEN doc_id % 3 = 0 THEN 'completed' END AS state_reason, CASE WHEN doc_id % 13 = 0 THEN 'user:ghost' ELSE 'user:dev' || (doc_id % 40) END AS author_key, CASE WHEN doc_id % 4 = 0 THEN 'M-' || lang || '-' || source END AS milestone_id, coalesce(n_comments, 0) AS comment_count, {_STAMP.format('n')} AS created_at, CASE WHEN doc_id % 5 = 0 THEN {_STAMP.format('n')} ELSE {_STAMP.format('n + 7')} END AS updated_at, CASE WHEN doc_id % 3 = 0 THEN {_STAMP.format('n + 7')} END AS closed_at, {_day('CAST(' + _CREATED + ' AS TIMESTAMP)')} AS created_date_key FROM d LEFT JOIN c ON conv_id = doc_id")
def ingest_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issue rows; an update time that is missing is the creation's."""
    return shown(pages.issues(_issues(spark, d)[0], ZONE))


@query(f"WITH {_DOC} SELECT DISTINCT 'M-' || lang || '-' || source AS id, 'docs/' || lang AS repo_key, CAST(1 AS BIGINT) AS number, source AS title, 'open' AS state, {_STAMP.format('400')} AS due_on, {_STAMP.format('1')} AS created_at FROM d WHERE doc_id % 4 = 0")
def ingest_milestones(spark: SparkSession, d: str) -> DataFrame:
    """Milestones, once each."""
    return shown(pages.milestones(_issues(spark, d)[0]).drop("description"))


@query(f"WITH {_DOC} SELECT DISTINCT 'L-' || lang || '-' || w AS id, 'docs/' || lang AS repo_key, w AS name, '' AS description FROM d, (SELECT unnest(['bug', 'from-docs']) AS w)")
def ingest_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels, once each."""
    return pages.labels(_issues(spark, d)[0]).drop("color")


@query(f"WITH {_DOC} SELECT 'label' AS link, 'I-' || doc_id AS issue_id, 'L-' || lang || '-' || w AS linked FROM d, (SELECT unnest(['bug', 'from-docs']) AS w) UNION ALL SELECT 'assignee', 'I-' || doc_id, 'user:dev' || (doc_id % 7) FROM d")
def ingest_issue_links(spark: SparkSession, d: str) -> DataFrame:
    """Bridges of issues; an assignee named twice is one."""
    items = _issues(spark, d)[0]
    labels = pages.issue_labels(items).select(F.lit("label").alias("link"), "issue_id", F.col("label_id").alias("linked"))
    return labels.unionByName(pages.issue_assignees(items).select(F.lit("assignee").alias("link"), "issue_id", F.col("entity_key").alias("linked")))


@query(f"WITH {_DOC} SELECT 'T-' || conv_id || '-' || turn AS comment_key, 'issue' AS parent_type, 'I-' || conv_id AS parent_key, who AS author_key, text AS body, '2024-03-10 10:30:00' AS created_at, '2024-03-10' AS created_date_key, '03:00' AS created_time_key FROM tn")
def ingest_issue_comments(spark: SparkSession, d: str) -> DataFrame:
    """Comments of issues, on the day that clocks change."""
    return shown(pages.issue_comments(_issues(spark, d)[0], ZONE).drop("in_reply_to"))


@query("SELECT 'I-' || doc_id AS item_key, CASE WHEN doc_id % 5 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 300 + 7 AS INTEGER), '%Y-%m-%d %H:%M:%S') END AS updated_at FROM documents WHERE doc_id % 61 = 0")
def ingest_issue_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Issues whose times do not parse."""
    return shown(_issues(spark, d)[1].select("item_key", "updated_at"))


# --- streaming, merges by table, sinks


def _replayed(spark: SparkSession, d: str) -> str:
    """The tables after a streamed ingest of the landed pages and a second one of the same pages."""
    landing, root = _landed(request_texts(spark, d), "pages"), t.shared_place(spark, "warehouse")
    for k in range(2):
        ingest.ingest(spark, landing, root, f"{root}/checkpoint{k}", ZONE).awaitTermination()
        ingest.drop_old_versions(spark, root, 1)
    return root


@query(_REQUESTS)
def stream_replay(spark: SparkSession, d: str) -> DataFrame:
    """Requests after a stream and its replay."""
    return shown(ingest.current(spark, _replayed(spark, d), "fact_pull_requests"))


@query(f"WITH b AS (SELECT *, {_BAD} AS bad FROM orders) SELECT 'reject' AS kind, 'owner/repo' || o_custkey || '#' || o_orderkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS day FROM b WHERE bad UNION ALL SELECT 'cursor', 'repo:owner/repo' || o_custkey, strftime(least(min(o_orderdate) FILTER (bad), max(o_orderdate) FILTER (NOT bad)), '%Y-%m-%d') FROM b GROUP BY o_custkey HAVING count(*) FILTER (NOT bad) > 0")
def stream_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejects and cursors after a stream and its replay: each item once."""
    root = _replayed(spark, d)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day")
    bad = ingest.current(spark, root, "rejects").select(F.lit("reject").alias("kind"), F.col("item_key").alias("key"), day("updated_at"))
    return bad.unionByName(ingest.current(spark, root, "cursors").select(F.lit("cursor").alias("kind"), F.concat_ws(":", "source_type", "source_id").alias("key"), day("cursor")))


@query(_REQUESTS.replace("o_orderpriority AS title", "o_orderpriority || ' moved' AS title").replace("strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS updated_at", "strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d %H:%M:%S') AS updated_at").replace(f"{_day('o_orderdate')} AS updated_date_key, {_hour('o_orderdate')} AS updated_time_key", f"{_day('(o_orderdate + INTERVAL 40 DAY)')} AS updated_date_key, {_hour('(o_orderdate + INTERVAL 40 DAY)')} AS updated_time_key"))
def stream_moved(spark: SparkSession, d: str) -> DataFrame:
    """Requests that come again with another creation time: one row each, with the first time and the new title."""
    landing, root = _landed(request_texts(spark, d), "pages"), t.shared_place(spark, "warehouse")
    ingest.ingest(spark, landing, root, f"{root}/checkpoint0", ZONE).awaitTermination()
    _gzipped(request_texts(spark, d, moved=True), landing)
    ingest.ingest(spark, landing, root, f"{root}/checkpoint0", ZONE, cut=False).awaitTermination()
    return shown(ingest.current(spark, root, "fact_pull_requests"))


@query(f"WITH q AS ({_REQUESTS}) SELECT * FROM q")
def stream_two_paths(spark: SparkSession, d: str) -> DataFrame:
    """A stream of repository pages with some of the requests and one of person searches with all: each lands once."""
    source = F.concat(F.lit("author:"), F.lower(F.coalesce("author", F.lit("none"))))
    found = search_texts(spark, d, tasks=spark.sparkContext.defaultParallelism).select("value", F.concat(F.lit("author:"), F.pmod(F.xxhash64(source), F.lit(8))).alias("source_id"))
    searches = _gzipped(found, t.shared_place(spark, "search"), "source_id")
    root = t.shared_place(spark, "warehouse")
    pages_ = _landed(request_texts(spark, d, some=lambda key: key % 3 != 0), "pages")
    streams = [ingest.ingest(spark, at, root, f"{root}/checkpoint-{kind}", ZONE, kind) for kind, at in (("requests", pages_), ("searches", searches))]  # both at once
    for s in streams:
        s.awaitTermination()
    return shown(ingest.current(spark, root, "fact_pull_requests"))


def _moved(pages_: DataFrame, kind: str) -> DataFrame:
    """Pages whose items were created 40 days later, and updated then: as a forge may serve them after a transfer."""
    later = lambda c: F.coalesce(_iso(F.try_to_timestamp(c) + F.expr("interval 40 days")), c)
    new = lambda n: n.withField("createdAt", later(n["createdAt"])).withField("updatedAt", later(n["updatedAt"])).withField("title", F.concat(n["title"], F.lit(" moved")))
    nodes = F.transform(f"data.repository.{kind}.nodes", new)
    return pages_.withColumn("data", F.col("data").withField(f"repository.{kind}.nodes", nodes))


_ISSUE_MOVED = "o AS (SELECT *, doc_id % 3 = 0 AS gone FROM documents WHERE doc_id % 61 <> 0)"


@query(f"""WITH {_ISSUE_MOVED} SELECT 'issue' AS kind, 'I-' || doc_id AS key, source || ' moved' AS value, strftime(DATE '2024-01-01' + CAST(doc_id % 300 AS INTEGER), '%Y-%m-%d') AS day FROM o
UNION ALL SELECT 'label', 'I-' || doc_id, 'L-' || lang || '-' || w, NULL FROM o, (SELECT unnest(['bug', 'from-docs']) AS w) WHERE NOT gone
UNION ALL SELECT 'reject', 'I-' || doc_id, NULL, CASE WHEN doc_id % 5 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id % 300 + 47 AS INTEGER), '%Y-%m-%d') END FROM documents WHERE doc_id % 61 = 0""")
def stream_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues that come twice, the second time with another creation time and every third without labels: one row each with
    its first time, links as they are now, and items whose times do not parse as open rejects."""
    made = issue_pages(spark, d)
    landing, root = _landed(made, "issues"), t.shared_place(spark, "warehouse")
    ingest.ingest(spark, landing, root, f"{root}/checkpoint", ZONE, "issues").awaitTermination()
    bare = F.transform("data.repository.issues.nodes", lambda n: n.withField("labels", F.when(n["number"] % 3 != 0, n["labels"])))
    again = _moved(made, "issues").withColumn("data", F.col("data").withField("repository.issues.nodes", bare))
    _gzipped(again, landing)
    for _ in range(2):  # the third time nothing is new
        ingest.ingest(spark, landing, root, f"{root}/checkpoint", ZONE, "issues", cut=False).awaitTermination()
    day, none = lambda c: F.date_format(c, "yyyy-MM-dd").alias("day"), F.lit(None).cast("string")
    row = lambda name, kind, key, value, at: ingest.current(spark, root, name).select(F.lit(kind).alias("kind"), F.col(key).alias("key"), value.alias("value"), at)
    out = row("issues", "issue", "id", F.col("title"), day("created_at")).unionByName(row("issue_labels", "label", "issue_id", F.col("label_id"), none.alias("day")))
    return out.unionByName(row("rejects", "reject", "item_key", none, day("updated_at")))


@query(f"WITH {_O}, f AS (SELECT DISTINCT pr_key, l_partkey, CAST(l_quantity AS BIGINT) AS q FROM l) SELECT pr_key || ':src/' || l_partkey AS file_diff_key, min(q) AS least, count(DISTINCT q) AS n, CASE WHEN l_partkey % 2 = 0 THEN '@@ ' || l_partkey END AS patch FROM f GROUP BY pr_key, l_partkey")
def stream_patches(spark: SparkSession, d: str) -> DataFrame:
    """Patches that stream in after their requests reach the diffs that exist. A path that a request has twice is one diff."""
    root = t.shared_place(spark, "warehouse")
    ingest.ingest(spark, _landed(request_texts(spark, d), "pages"), root, f"{root}/checkpoint0", ZONE).awaitTermination()
    line = t.read(spark, d, "lineitem").join(t.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).filter("l_partkey % 2 = 0")
    pr_key = F.concat(F.lit("owner/repo"), "o_custkey", F.lit("#"), "o_orderkey")
    scan = line.select(pr_key.alias("pr_key"), F.concat(F.lit("src/"), "l_partkey").alias("filename"), F.concat(F.lit("@@ "), "l_partkey").alias("patch"))
    lost = scan.withColumn("filename", F.concat(F.lit("gone/"), "filename"))
    ingest.ingest(spark, _landed(scan.unionByName(lost), "patches"), root, f"{root}/checkpoint1", ZONE, "patches").awaitTermination()
    diffs = ingest.current(spark, root, "fact_file_diffs")
    line_q = t.read(spark, d, "lineitem").join(t.read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sizes = line_q.select(F.concat(pr_key, F.lit(":src/"), "l_partkey").alias("file_diff_key"), F.col("l_quantity").cast("long").alias("q")).groupBy("file_diff_key").agg(F.min("q").alias("least"), F.countDistinct("q").alias("n"))
    return diffs.join(sizes, "file_diff_key").select("file_diff_key", "least", "n", "patch")


@query(f"""WITH b AS (SELECT o_custkey, o_orderdate, {_BAD} AS bad FROM orders), s AS (SELECT o_custkey, count(*) AS items FROM b GROUP BY 1)
SELECT 'repo:owner/repo' || o_custkey AS entity, '1998-06-01' AS first_day, '1998-08-01' AS covered, items, '1998-08-02' AS gap_start, '1998-08-31' AS gap_end FROM s""")
def stream_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What a load of June and July covers, cut to its last complete day, and what is missing up to the end of August."""
    root, day = t.shared_place(spark, "warehouse"), lambda *x: date(1998, *x)
    ingest.ingest(spark, _landed(request_texts(spark, d), "pages"), root, f"{root}/checkpoint", ZONE, window=(day(6, 1), day(8, 31), day(8, 1))).awaitTermination()
    ranges = ingest.current(spark, root, "coverage")
    return shown(ranges.select("entity", F.col("start").alias("first_day"), F.col("end").alias("covered"), "items").join(gaps(ranges, F.lit(day(8, 31))), "entity"))


#: What a changed row may do to each column: R takes the new value, K keeps the first, C takes the new one unless it is null.
_RULES = """dim_entities entity_type:R is_human:R is_bot:R login:K name:K | dim_repositories primary_language:R is_fork:R is_private:R default_branch:R owner:K name:K created_at:C
| fact_pull_requests state:R is_draft:R title:R body:R base_ref:R head_ref:R updated_at:R merged_at:R closed_at:R merged_by_key:R updated_date_key:R updated_time_key:R merged_date_key:R comment_count:R review_count:R changed_files:R additions:R deletions:R number:K repo_key:K author_key:K created_at:K created_date_key:K created_time_key:K
| fact_reviews state:R body:R submitted_at:R submitted_date_key:R submitted_time_key:R pr_key:K reviewer_key:K | fact_review_comments in_reply_to:R path:R line:R body:R pr_key:K author_key:K review_key:K created_at:K created_date_key:K created_time_key:K
| fact_issue_comments body:R in_reply_to:R parent_type:K parent_key:K author_key:K created_at:K created_date_key:K created_time_key:K | fact_check_runs status:R conclusion:R started_at:R completed_at:R pr_key:K head_sha:K name:K
| fact_file_diffs previous_path:R change_type:R additions:R deletions:R patch:C pr_key:K repo_key:K file_path:K | issues title:R body:R state:R state_reason:R author_key:R milestone_id:R comment_count:R updated_at:R closed_at:R created_date_key:R repo_key:K number:K created_at:K
| labels name:R color:R description:R repo_key:K | milestones title:R description:R state:R due_on:R repo_key:K number:K created_at:K"""
_RULE_ROWS = ", ".join(f"('{table}', '{c}', '{rule}')" for table, *cols in (part.split() for part in _RULES.split("|")) for c, rule in (x.split(":") for x in cols))


@query(f"""WITH r(t, c, rule) AS (VALUES {_RULE_ROWS}), k AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 <> 0 THEN 'old' END AS was, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 <> 0 THEN 'new' END AS now, o_orderkey % 3 <> 0 AS had, o_orderkey % 2 = 0 AS has FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0)
SELECT t AS "table", c AS "column", CASE WHEN NOT has THEN was WHEN NOT had THEN now WHEN rule = 'R' THEN now WHEN rule = 'K' THEN was ELSE coalesce(now, was) END AS value, count(*) AS n FROM k, r GROUP BY ALL""")
def merge_policies(spark: SparkSession, d: str) -> DataFrame:
    """Every table's merge with a changed batch, which holds an older row of each key too: what its columns hold after it."""
    o, k, out = t.read(spark, d, "orders").select("o_orderkey"), F.col("o_orderkey"), None
    for table, *cols in (part.split() for part in _RULES.split("|")):
        key, names = merge.POLICIES[table][0][0], [c.split(":")[0] for c in cols]
        fill = lambda df, v: df.select(k.alias(key), *[v.alias(c) for c in names])  # noqa: B023, E731
        new = fill(o.filter(k % 2 == 0), F.when(k % 7 != 0, "new")).withColumn("_seq", F.lit(2)).unionByName(fill(o.filter(k % 2 == 0), F.lit("older")).withColumn("_seq", F.lit(1)))
        done = merge.merge_table(table, fill(o.filter(k % 3 != 0), F.lit("old")), new, [F.desc("_seq")])
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names])).alias("x")
        one = done.select(pairs).groupBy("x.column", "x.value").agg(F.count("*").alias("n")).select(F.lit(table).alias("table"), "column", "value", "n")
        out = one if out is None else out.unionByName(one)
    return out


def _output(spark: SparkSession, d: str) -> DataFrame:
    """The thirteen fields of a listing as files have them."""
    title = F.concat(F.lit('say "'), "title", F.lit('", then\nmore'))
    nobody = spark.createDataFrame([], "entity_key string, login string, entity_type string")
    named = lambda good: listing.with_authors(pages.pull_requests(good, "UTC"), nobody)
    return shown(_loaded(spark, d, lambda good, _: named(good).select("pr_key", "number", F.col("repo_key").alias("repo"), "author", "author_type", "state", title.alias("title"), "created_at", "merged_at", F.col("comment_count").alias("comments"), F.col("review_count").alias("reviews"), "additions", "deletions")))


_OUTPUT = f"""WITH q AS ({_REQUESTS}) SELECT pr_key, number, repo_key AS repo, substr(author_key, 6) AS author, 'user' AS author_type, state, 'say "' || title || '", then' || chr(10) || 'more' AS title, created_at, merged_at, comment_count AS comments, review_count AS reviews, additions, deletions FROM q"""


@query(_OUTPUT)
def sink_csv(spark: SparkSession, d: str) -> DataFrame:
    """A listing written as CSV and read back; quotes, commas and line feeds within a field survive."""
    out = _output(spark, d)
    sinks.write_csv(out, path := t.shared_place(spark, "csv"), "gzip")
    return spark.read.schema(out.schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


@query(_OUTPUT)
def sink_json(spark: SparkSession, d: str) -> DataFrame:
    """A listing written as JSON lines and read back."""
    out = _output(spark, d)
    sinks.write_json(out, path := t.shared_place(spark, "json"), "gzip")
    return spark.read.schema(out.schema).json(path)


@query(f"WITH {_O} SELECT strftime(o_orderdate, '%Y-%m') AS created_month, count(*) AS n, CAST(sum(CASE WHEN o_orderdate < DATE '1997-03-01' AND o_orderdate >= DATE '1997-02-01' THEN 1 ELSE 0 END) AS BIGINT) AS rewritten FROM o GROUP BY 1")
def sink_months(spark: SparkSession, d: str) -> DataFrame:
    """A fact in folders by month; a merge that touches one month writes that folder alone."""
    prs = _loaded(spark, d, lambda good, _: pages.pull_requests(good, "UTC")).withColumn("batch", F.lit(1))
    sinks.write_table(prs, path := t.shared_place(spark, "facts"), "created_at")
    touched = prs.filter("created_at >= timestamp'1997-02-01' AND created_at < timestamp'1997-03-01'").withColumn("batch", F.lit(2))
    sinks.write_table(touched, path, "created_at")
    again = F.count_if(F.col("batch") == 2)
    return spark.read.parquet(path).groupBy("created_month").agg(F.count("*").alias("n"), again.alias("rewritten"))
