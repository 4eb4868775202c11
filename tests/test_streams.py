"""Streams of landed pages into one warehouse."""

import datetime as dt
import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from revlake.operators import coverage
from revlake.streaming import ingest, warehouse

D = dt.date


def request(number=1, created="2022-05-06T07:08:09Z", updated="2022-05-07T00:00:00Z", **more):
    return {"number": number, "createdAt": created, "updatedAt": updated, "author": {"login": "Mira"}} | more


def page(*nodes, more=False, repo="Lake/Rev"):
    return {"data": {"repository": {"nameWithOwner": repo, "pullRequests": {"pageInfo": {"hasNextPage": more}, "nodes": nodes}}}}


def issue(i="I1", updated="2022-05-07T00:00:00Z", labels=(), **more):
    return {"id": i, "number": 1, "createdAt": "2022-05-06T07:08:09Z", "updatedAt": updated, "author": {"login": "Ann"}, "labels": {"nodes": [{"id": x, "name": x} for x in labels]}, "assignees": {"nodes": [{"login": "Mira"}]}, "comments": {"nodes": [{"id": f"{i}-c", "body": "hm", "createdAt": "2022-06-01T00:00:00Z", "author": {"login": "lint[bot]", "__typename": "Bot"}}]}} | more


def issue_page(*nodes):
    return {"data": {"repository": {"nameWithOwner": "Lake/Rev", "issues": {"nodes": nodes}}}}


class Land:
    def __init__(self, spark, tmp_path):
        self.spark, self.at, self.root, self.n = spark, tmp_path, str(tmp_path / "tables"), 0

    def put(self, kind, *bodies, under=""):
        to = self.at / kind / under
        to.mkdir(parents=True, exist_ok=True)
        for body in bodies:
            self.n += 1
            (to / f"{self.n:03d}.json").write_text(body if isinstance(body, str) else json.dumps(body))

    def run(self, kind, checkpoint="c", **more):
        ingest.ingest(self.spark, str(self.at / kind), self.root, str(self.at / f"{kind}-{checkpoint}"), kind=kind, **more).awaitTermination()

    def rows(self, name, *columns):
        return sorted((tuple(r[c] for c in columns) for r in ingest.current(self.spark, self.root, name).collect()), key=str)


@pytest.fixture
def land(spark, tmp_path):
    return Land(spark, tmp_path)


def test_a_request_that_comes_with_another_creation_time_stays_one_row(land):
    review = {"id": "r1", "submittedAt": "2022-05-06T09:00:00Z", "author": {"login": "Bo"}}
    land.put("requests", page(request(reviews={"nodes": [review]})))
    land.run("requests")
    land.put("requests", page(request(created="2022-06-06T07:08:09Z", updated="2022-06-07T00:00:00Z", title="moved", reviews={"nodes": [review | {"state": "APPROVED"}]})))
    land.run("requests")
    assert land.rows("fact_pull_requests", "pr_key", "created_at", "title") == [("lake/rev#1", dt.datetime(2022, 5, 6, 7, 8, 9), "moved")]
    assert land.rows("fact_reviews", "review_key", "state") == [("r1", "APPROVED")]
    # a review whose request is another now is still the same review, of its first request
    land.put("requests", page(request(2, created="2022-09-01T00:00:00Z", updated="2022-09-07T00:00:00Z", reviews={"nodes": [review]})))
    land.run("requests")
    assert land.rows("fact_reviews", "review_key", "pr_key", "state") == [("r1", "lake/rev#1", "COMMENTED")]
    # both times in one batch
    land.put("requests", page(request(3, created="2022-01-01T00:00:00Z", updated="2022-09-08T00:00:00Z"), request(3, created="2022-02-01T00:00:00Z", updated="2022-09-09T00:00:00Z")))
    land.run("requests")
    assert [r for r in land.rows("fact_pull_requests", "number", "created_at") if r[0] == 3] == [(3, dt.datetime(2022, 2, 1))]


def test_the_life_of_a_reject(land):
    land.put("requests", page(request(1, updated="2022-05-10T00:00:00Z"), request(2, created="?", updated="2022-05-20T00:00:00Z")))
    land.run("requests")
    cursor = lambda: land.rows("cursors", "newest", "cursor")
    assert cursor() == [(dt.datetime(2022, 5, 10), dt.datetime(2022, 5, 10))]  # not beyond what is kept
    land.put("requests", page(request(2, created="??", updated="2022-05-21T00:00:00Z"), request(3, updated="2022-05-30T00:00:00Z")))
    land.run("requests")
    assert land.rows("rejects", "item_key", "tries") == [("lake/rev#2", 2)]
    assert cursor() == [(dt.datetime(2022, 5, 30), dt.datetime(2022, 5, 21))]  # held by an open reject
    land.run("requests", "again", cut=False)  # all pages once more, as another load
    assert land.rows("rejects", "item_key", "tries")[0][0] == "lake/rev#2"
    land.put("requests", page(request(2, updated="2022-05-21T00:00:00Z")))
    land.run("requests")
    assert land.rows("rejects", "item_key") == [] and land.rows("fact_pull_requests", "number") == [(1,), (2,), (3,)]
    assert cursor() == [(dt.datetime(2022, 5, 30),) * 2]


def test_items_before_the_cursor_are_cut_and_those_at_it_are_not(land):
    land.put("requests", page(request(1, updated="2022-05-10T00:00:00Z")))
    land.run("requests")
    land.put("requests", page(request(2, updated="2022-05-09T00:00:00Z"), request(3, updated="2022-05-10T00:00:00Z"), request(4, updated=None)))
    land.run("requests")
    assert land.rows("fact_pull_requests", "number") == [(1,), (3,), (4,)]
    land.put("requests", page(request(5, updated="2022-05-09T00:00:00Z")))
    land.run("requests", cut=False)
    assert land.rows("fact_pull_requests", "number") == [(1,), (3,), (4,), (5,)]


def test_coverage_is_recorded_with_the_last_page_of_a_source(land):
    window = (D(2022, 5, 1), D(2022, 5, 31), D(2022, 5, 20))
    land.put("requests", page(request(1), more=True))
    land.run("requests", window=window)
    assert land.rows("coverage", "entity") == []
    land.put("requests", page(request(2)), page(more=False, repo="Lake/Empty"))
    land.run("requests", window=window)
    assert land.rows("coverage", "entity", "start", "end") == [("repo:lake/empty", D(2022, 5, 1), D(2022, 5, 20)), ("repo:lake/rev", D(2022, 5, 1), D(2022, 5, 20))]
    gaps = lambda: [tuple(r) for r in coverage.gaps(ingest.current(land.spark, land.root, "coverage"), ingest.F.lit(D(2022, 6, 10))).filter("entity = 'repo:lake/rev'").collect()]
    assert gaps() == [("repo:lake/rev", D(2022, 5, 21), D(2022, 6, 10))]
    land.put("requests", page(request(3, updated="2022-06-03T00:00:00Z")))
    land.run("requests", window=(D(2022, 5, 21), D(2022, 6, 10), D(2022, 6, 10)))
    assert gaps() == [] and land.rows("coverage", "entity", "items")[-1] == ("repo:lake/rev", 2)


def test_issues_searches_and_patches_stream_too(land):
    land.put("requests", page(request(1, files={"nodes": [{"path": "a.py", "additions": 3}]})))
    land.put("searches", {"data": {"search": {"nodes": [request(1, title="found", updated="2022-05-08T00:00:00Z") | {"repository": {"nameWithOwner": "LAKE/rev"}}, {"number": None}, request(9) | {"repository": {"nameWithOwner": "Lake/Other"}}]}}}, under="source_id=author:mira")
    land.put("issues", issue_page(issue(labels=["l1", "l2"]), issue("I2", labels=["l1"])))
    land.put("patches", '{"pr_key": "lake/rev#1", "filename": "a.py", "patch": "@@"}\n{"pr_key": "lake/rev#1", "filename": "b.py", "patch": "@@"}\n{"pr_key": "lake/rev#1", "patch": "@@"}')
    for kind in ("requests", "searches", "issues", "patches"):
        land.run(kind)
    assert land.rows("fact_pull_requests", "pr_key", "title") == [("lake/other#9", ""), ("lake/rev#1", "found")]
    assert land.rows("fact_file_diffs", "file_path", "patch", "additions") == [("a.py", "@@", 3)]
    assert land.rows("issue_labels", "issue_id", "label_id") == [("I1", "l1"), ("I1", "l2"), ("I2", "l1")]
    assert land.rows("dim_entities", "entity_key") == [("bot:lint[bot]",), ("user:ann",), ("user:ghost",), ("user:mira",)]
    assert land.rows("fact_issue_comments", "comment_key", "parent_type") == [("I1-c", "issue"), ("I2-c", "issue")]
    assert land.rows("cursors", "source_type", "source_id") == [("person", "author:mira"), ("repo", "lake/rev"), ("repo_issues", "lake/rev")]
    # a later page replaces the links of the issues that it holds, also by none
    land.put("issues", issue_page(issue(updated="2022-05-09T00:00:00Z"), issue("I3", labels=["l9"])))
    land.run("issues")
    assert land.rows("issue_labels", "issue_id", "label_id") == [("I2", "l1"), ("I3", "l9")]
    before = {n: land.rows(n, *[c for c in ingest.current(land.spark, land.root, n).columns]) for n in ("issues", "issue_labels", "issue_assignees", "labels", "fact_issue_comments", "fact_file_diffs")}
    for kind in ("issues", "patches"):
        land.run(kind, "again")
    assert before == {n: land.rows(n, *[c for c in ingest.current(land.spark, land.root, n).columns]) for n in before}


def test_streams_at_the_same_time(land):
    """Writers that meet do again what the other has changed, and all changes are there."""
    land.put("requests", *[page(request(k, author={"login": f"p{k}"})) for k in range(3)])
    land.put("issues", *[issue_page(issue(f"I{k}", author={"login": f"q{k}"})) for k in range(3)])
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(land.run, ["requests", "issues"]))
    assert len(land.rows("fact_pull_requests", "pr_key")) == 3 and len(land.rows("issues", "id")) == 3
    assert {f"user:{x}{k}" for x in "pq" for k in range(3)} <= {r[0] for r in land.rows("dim_entities", "entity_key")}
    assert warehouse.state(land.spark, land.root).version == 2


def test_a_commit_that_is_overtaken_runs_again_only_what_was_touched(spark, tmp_path):
    root, ran = str(tmp_path), []

    def job(name, value, first=None):
        def run(at):
            ran.append((name, value))
            if first:
                first()
            old = warehouse.read(spark, root, at, name, "v long, part string")
            made = warehouse.write(old.union(spark.createDataFrame([(value, "p")], "v long, part string")), root, name, "part")
            return warehouse.Change([(name, "p")], {(name, "p"): tuple(made.values())})

        return run

    other = iter([lambda: warehouse.apply(spark, root, "b", 0, {"x": job("x", 2)})])
    warehouse.apply(spark, root, "a", 0, {"x": job("x", 1, lambda: next(other, lambda: None)()), "y": job("y", 1)})
    at = warehouse.state(spark, root)
    assert sorted(r["v"] for r in warehouse.read(spark, root, at, "x", "v long, part string").collect()) == [1, 2]
    assert ran == [("x", 1), ("x", 2), ("y", 1), ("x", 1)] and at.version == 2
    warehouse.apply(spark, root, "a", 0, {"x": job("x", 3)})  # this batch is in
    assert warehouse.state(spark, root).version == 2
    warehouse.drop_old_versions(spark, root, 1)
    assert len(list((tmp_path / "x").iterdir())) >= 1 and warehouse.read(spark, root, at, "x", "v long, part string").count() == 2


def test_pages_of_a_source_in_several_batches_of_a_load_are_not_cut(land):
    """A batch takes 100 files; the newest come first."""
    land.put("requests", *[page(request(k, updated=f"2022-05-{28 - k // 10:02d}T00:00:{59 - k % 10:02d}Z")) for k in range(120)])
    land.run("requests")
    assert warehouse.state(land.spark, land.root).batches[str(land.at / "requests-c")] == 1  # two batches
    assert sorted(land.rows("fact_pull_requests", "number")) == [(k,) for k in range(120)]
    land.put("requests", page(request(500, updated="2022-05-01T00:00:00Z")))
    land.run("requests")  # the next load is cut
    assert len(land.rows("fact_pull_requests", "number")) == 120


def test_a_load_that_is_taken_up_again_keeps_its_cut(land, monkeypatch):
    """It fails in its second batch, and ends when it is begun again."""
    land.put("requests", *[page(request(k, updated=f"2022-05-{28 - k // 10:02d}T00:00:{59 - k % 10:02d}Z")) for k in range(120)])
    whole = ingest.merge_batch
    monkeypatch.setattr(ingest, "merge_batch", lambda *a: 1 / 0 if a[5] == 1 else whole(*a))
    with pytest.raises(Exception, match="division"):
        land.run("requests")
    monkeypatch.setattr(ingest, "merge_batch", whole)
    assert len(land.rows("fact_pull_requests", "number")) == 100
    land.run("requests")
    assert len(land.rows("fact_pull_requests", "number")) == 120


def test_rows_are_made_once_and_no_folder_is_left_that_no_commit_names(land, monkeypatch):
    review = lambda i, state="APPROVED": {"id": i, "state": state, "submittedAt": "2022-05-08T00:00:00Z", "author": {"login": "Ann"}}
    node = request(1, reviews={"nodes": [review("a"), review("b")]})
    written, write = [], warehouse.write

    def counted(rows, root, name, *more, **other):
        written.append(name)
        return write(rows, root, name, *more, **other)

    monkeypatch.setattr(warehouse, "write", counted)
    land.put("requests", page(node))
    land.run("requests", cut=False)
    assert written.count("items") == 1 and written.count("good") == 0 and written.count("fact_reviews") == 1
    land.put("requests", page(node | {"title": "new", "reviews": {"nodes": [review("a", "DISMISSED"), review("c"), review("c")]}}))  # known, new, twice
    land.run("requests", cut=False)
    assert sorted(land.rows("fact_reviews", "review_key", "state")) == [("a", "DISMISSED"), ("b", "APPROVED"), ("c", "APPROVED")]
    ingest.drop_old_versions(land.spark, land.root, 1)
    held = {f for folders in warehouse.state(land.spark, land.root).folders.values() for f in folders}
    found = {str(p.relative_to(land.root)) for p in (land.at / "tables").glob("fact_*/*/_part=*")}
    assert found == {f for f in held if f.startswith("fact_")}
