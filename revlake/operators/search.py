"""Ranked substring search over text corpora, by scan or by trigram postings.

A query is one literal of three characters or more, compared without case within one field. The rank is the negated
BM25 of the literal (lower is better), with each corpus's own counts. A corpus is read twice: for its counts, which are
one row, and for the matches. By postings, only candidates that hold all trigrams of the query are read for matches.
Snippets are cut from the rows that a limit leaves. text_index searches a stored index instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .listing import when_given, with_authors

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Trigrams of a snippet.
TOKENS = 12
DEFAULT_LIMIT = 20


def _quoted(query: str) -> str:
    return "(?=\\Q" + query.lower().replace("\\E", "\\E\\\\E\\Q") + "\\E)"


def occurrences(field: Column, query: str) -> Column:
    """How often the literal stands in the field; overlaps count."""
    return F.regexp_count(F.lower(F.coalesce(field, F.lit(""))), F.lit(_quoted(query)))


def trigram_count(field: Column) -> Column:
    return F.greatest(F.char_length(F.coalesce(field, F.lit(""))) - 2, F.lit(0))


def _folded_span(field: Column, query: str) -> Column:
    """begin and end, in characters of the field, of the first place where the literal stands in the lower-cased field. Where
    a letter's lower case is longer, the characters that the folded place covers are counted off one by one."""
    q, folded = query.lower(), F.lower(field)
    first = F.locate(q, folded)
    last = first + len(q) - 1
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("a"), F.lit(0).alias("b"))

    def step(s: Column, width: Column) -> Column:
        n = s["n"] + width
        return F.struct(n.alias("n"), (s["a"] + (n < first).cast("int")).alias("a"), (s["b"] + (n < last).cast("int")).alias("b"))

    walked = F.aggregate(F.transform(F.split(field, ""), lambda c: F.char_length(F.lower(c))), start, step, lambda s: F.struct((s["a"] + 1).alias("begin"), (s["b"] + 1).alias("end")))
    plain = F.struct(first.alias("begin"), last.alias("end"))
    return F.when(first == 0, None).when(F.char_length(folded) == F.char_length(field), plain).otherwise(walked)


def snippet(fields: list[Column], query: str, tokens: int = TOKENS) -> Column:
    """So many trigrams of the field with the most hits (the first of such) around its first hit, hits in brackets, and …
    where text is left out. A hit that is longer stays whole."""
    hits = F.array(*[occurrences(f, query) for f in fields])
    best = F.get(F.array(*[F.coalesce(f, F.lit("")) for f in fields]), (F.array_position(hits, F.array_max(hits)) - 1).cast("int"))

    def cut(x: Column) -> Column:
        field, begin, end, n = x["f"], x["s"]["begin"], x["s"]["end"], F.char_length(x["f"])
        wide = tokens + 2
        first = F.greatest(F.least(begin - F.greatest(F.floor((wide - (end - begin + 1)) / 2), F.lit(0)), n - wide + 1), F.lit(1)).cast("int")
        last = F.least(F.greatest(first + wide - 1, end), n).cast("int")
        more = F.regexp_replace(field.substr(end + 1, last - end), F.lit("(?iu)\\Q" + query.replace("\\E", "\\E\\\\E\\Q") + "\\E"), F.lit("[$0]"))
        return F.when(x["s"].isNotNull(), F.concat(F.when(first > 1, "…").otherwise(""), field.substr(first, begin - first), F.lit("["), field.substr(begin, end - begin + 1), F.lit("]"), more, F.when(last < n, "…").otherwise("")))

    return F.element_at(F.transform(F.array(F.struct(best.alias("f"), _folded_span(best, query).alias("s"))), cut), 1)


def _length(fields: list[str]) -> Column:
    return reduce(Column.__add__, [trigram_count(F.col(c)) for c in fields])


def _holds(fields: list[str], query: str) -> Column:
    return reduce(Column.__or__, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False)) for c in fields])


def corpus_sizes(corpus: DataFrame, fields: list[str], query: str | None = None) -> DataFrame:
    """One row: rows of the corpus, their average length in trigrams and, with a query, how many hold it."""
    df = F.count_if(_holds(fields, query)) if query else F.lit(None).cast("long")
    return corpus.agg(F.count("*").alias("_n"), F.greatest(F.avg(_length(fields)), F.lit(1.0)).alias("_avg"), df.alias("_df"))


def ranked(corpus: DataFrame, fields: list[str], query: str, kind: str, candidates: DataFrame | None = None) -> DataFrame:
    """The corpus's matching rows with all their columns, kind and rank. A query under three characters finds nothing.

    candidates (key) narrows the rows read for matches to those that can match.
    """
    if len(query) < 3:
        return corpus.limit(0).withColumns({"kind": F.lit(kind), "rank": F.lit(0.0)})
    rows = corpus if candidates is None else corpus.join(candidates, [c for c in candidates.columns], "left_semi")
    tf = reduce(Column.__add__, [occurrences(F.col(c), query) for c in fields]).cast("double")
    hits = rows.filter(_holds(fields, query)).withColumns({"_tf": tf, "_len": _length(fields)})
    sizes = corpus_sizes(corpus, fields, query if candidates is None else None)
    if candidates is not None:
        sizes = sizes.drop("_df").join(F.broadcast(hits.agg(F.count("*").alias("_df"))))  # one row each
    idf = F.greatest(F.log((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(LEAST_IDF))
    bm25 = idf * F.col("_tf") * (K1 + 1) / (F.col("_tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return hits.join(F.broadcast(sizes)).select(*corpus.columns, F.lit(kind).alias("kind"), (-bm25).alias("rank"))  # one row


def search_corpus(corpus: DataFrame, fields: list[str], query: str, kind: str, limit: int | None = DEFAULT_LIMIT, candidates: DataFrame | None = None) -> DataFrame:
    """kind, the corpus's columns but the fields, snippet, rank; the first limit rows by rank."""
    rest = [c for c in corpus.columns if c not in fields]
    out = ranked(corpus, fields, query, kind, candidates)
    out = out if limit is None else out.orderBy("rank", *rest).limit(limit)
    return out.select("kind", *rest, snippet([F.col(c) for c in fields], query).alias("snippet"), "rank")


def search_facts(corpus: DataFrame, fields: list[str], query: str, kind: str, facts: DataFrame, entities: DataFrame, repo: str | None = None, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """kind, key, repo, title, author, author_type, snippet, rank of hits whose fact is there, of one repository if given.

    corpus: fact_key, author_key and the fields. facts: fact_key, key (as shown), repo, title. Authors come last, for the
    rows that the limit leaves; a missing entity falls back to what its key says.
    """
    found = ranked(corpus, fields, query, kind).join(when_given(facts.withColumnRenamed("title", "_title"), "repo", None if repo is None else repo.lower()), "fact_key")
    found = found if limit is None else found.orderBy("rank", "key", "author_key").limit(limit)
    cut = found.select("kind", "key", "repo", F.col("_title").alias("title"), "author_key", snippet([F.col(c) for c in fields], query).alias("snippet"), "rank")
    return with_authors(cut, entities).select("kind", "key", "repo", "title", "author", "author_type", "snippet", "rank")


def parent_facts(prs: DataFrame, issues: DataFrame, repo: str | None = None) -> DataFrame:
    """Facts of comments by their parent: fact_key (type and key), key, repo, title of requests and issues, each of one
    repository if given."""
    one = lambda df, kind: when_given(df, "repo", None if repo is None else repo.lower()).select(F.concat(F.lit(f"{kind}:"), "parent_key").alias("fact_key"), F.col("parent_key").alias("key"), "repo", "title")
    return one(prs, "pull_request").unionByName(one(issues, "issue"))


def merge_hits(hits: list[DataFrame], limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Hits of several corpora, each cut already, by rank, then corpus, then key."""
    whole = reduce(DataFrame.unionByName, [h.withColumn("_corpus", F.lit(k)) for k, h in enumerate(hits)])
    return whole.orderBy("rank", "_corpus", "key").limit(limit).drop("_corpus")


def trigrams(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))"), 1))


def postings(corpus: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """gram, key: one row for each distinct trigram of a field."""
    return corpus.select(F.explode(F.array_distinct(F.flatten(F.array(*[trigrams(F.col(f)) for f in fields])))).alias("gram"), F.col(key))


def refresh_postings(old: DataFrame, changed: DataFrame, key: str, fields: list[str], gone: DataFrame | None = None) -> DataFrame:
    """Postings after rows were added, changed or (gone) removed."""
    touched = changed.select(key) if gone is None else changed.select(key).union(gone.select(key))
    return old.join(touched, key, "left_anti").select("gram", key).unionByName(postings(changed, key, fields))


def candidates(index: DataFrame, key: str, query: str) -> DataFrame:
    """Keys that hold all trigrams of the query."""
    grams = sorted({query.lower()[k : k + 3] for k in range(len(query) - 2)})
    return index.filter(F.col("gram").isin(grams)).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select(key)
