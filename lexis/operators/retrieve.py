"""Question answering over the document store: candidates, cosine, top-k,
content fetch and answer formatting, for a whole table of questions at once.

Plan shape (whole-store mode)::

    store (a row a line) -> hashed tf + norm, a row a line   (partition-local)
        x blocks of questions (written once)               (Spark broadcasts them while
                                                            they are small)
        k best of a chunk of lines for each question       (inside the task)
        row_number() <= k per question                     (partial limit before
                                                            the only shuffle)
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexis.functions.text import preprocess_text
from lexis.operators import packed as P
from lexis.operators.cluster import assigned_terms
from lexis.operators.vectorize import NUM_FEATURES, cosine_from_dot, vectors
from lexis.session import once

# Answer texts of the reference, verbatim.
NOT_TRAINED = ("O modelo ainda não foi treinado. Por favor, conclua o treinamento "
               "antes de fazer perguntas.")
NO_INFO = "Desculpe, não encontrei informações relevantes para sua pergunta."
HEADER_PREFIX = "Com base na sua pergunta '"
HEADER_SUFFIX = "', encontrei as seguintes informações relevantes:\n\n"
HIT_PREFIX = "- "

TOP_K = 5            # hits per answer
SAMPLE_SIZE = 1000   # candidates per question in sampling mode


def sample_order(keys: Sequence[str]) -> list[Column]:
    """Reproducible pseudo-random order: md5 of the key text, key as tie-break."""
    key_text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys])
    return [F.md5(key_text)] + [F.col(k) for k in keys]


def candidate_sample(store: DataFrame, keys: Sequence[str], n: int = SAMPLE_SIZE) -> DataFrame:
    """n stored documents without replacement (sort-limit: top-n per partition)."""
    return store.orderBy(*sample_order(keys)).limit(n)


def question_vectors(queries: DataFrame, num_features: int = NUM_FEATURES) -> DataFrame:
    """(query_id, feature, tf, norm) of the preprocessed question text."""
    q = queries.select("query_id", preprocess_text("query").alias("_pq"))
    return vectors(q, ["query_id"], "_pq", num_features, lowercase=False) \
        .withColumnRenamed("tf", "qtf").withColumnRenamed("norm", "qnorm")


def _scores(qvec: DataFrame, dvec: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positive cosine scores for every (question, document) sharing a feature."""
    joined = dvec.join(once(qvec, "questions"), "feature")
    return (joined.groupBy("query_id", *keys)
                  .agg(F.sum(F.col("tf") * F.col("qtf")).alias("_dot"),
                       F.max("norm").alias("_dn"), F.max("qnorm").alias("_qn"))
                  .select("query_id", *keys,
                          cosine_from_dot(F.col("_dot"), F.col("_qn"), F.col("_dn"))
                          .alias("similarity")))


def _top_k(scored: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(),
                                               *[F.col(c) for c in keys])
    return scored.withColumn("rank", F.row_number().over(w).cast("bigint")) \
                 .filter(F.col("rank") <= k)


def _keys_literal(rows, keys: Sequence[str]) -> Column:
    """A bounded list of key tuples as one constant-folded array<struct> literal."""
    schema = f"array<struct<{','.join(k + ':bigint' for k in keys)}>>"
    payload = json.dumps([{k: int(r[k]) for k in keys} for r in rows])
    return F.from_json(F.lit(payload), schema)


def _pair_with(queries: DataFrame, rows, keys: Sequence[str]) -> DataFrame:
    """Each question with each of a bounded list of documents (explode, no join)."""
    return (queries.select("query_id", F.explode(_keys_literal(rows, keys)).alias("_d"))
                   .select("query_id", *[F.col("_d")[k].alias(k) for k in keys]))


def score_candidates(queries: DataFrame, store: DataFrame, keys: Sequence[str],
                     n: int = SAMPLE_SIZE, num_features: int = NUM_FEATURES) -> DataFrame:
    """Sampling mode: every (question, sampled document) with its cosine.

    Documents sharing no feature with the question keep similarity 0.0.  The
    sample holds at most ``n`` keys, so it is broadcast and its keys are
    shipped to the questions as a literal.
    """
    keys = list(keys)
    sample = once(candidate_sample(store, keys, n), "sample")  # n rows, with their content
    return _score_sample(queries, sample, keys, num_features)


def _score_sample(queries: DataFrame, sample: DataFrame, keys: Sequence[str],
                  num_features: int = NUM_FEATURES) -> DataFrame:
    rows = sample.select(*keys).collect()  # n rows at most
    dvec = vectors(sample, keys, "content", num_features, lowercase=False)
    pos = _scores(question_vectors(queries, num_features), dvec, keys)
    return (_pair_with(queries, rows, keys).join(pos, ["query_id", *keys], "left")
                 .withColumn("similarity", F.coalesce("similarity", F.lit(0.0))))


def rank_content(queries: DataFrame, store: DataFrame, keys: Sequence[str] = ("doc_id", "line_no"),
                 k: int = TOP_K, candidates: int | None = None,
                 num_features: int = NUM_FEATURES, doc_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, keys..., similarity): top-k documents per question.

    ``candidates=None`` ranks the whole store; ``candidates=n`` ranks a
    reproducible n-document sample shared by the question batch.  Ties keep
    key order.  When fewer than k documents share a term with a question, the
    list is padded with the lowest-key documents at similarity 0.0 (as a
    sorted candidate list would be), never beyond the store size.
    ``doc_vectors`` (keys..., feature, tf, norm) may be given when they were
    computed at ingest (the store is then only read for padding keys).
    Similarities are unrounded, and ranked so.
    """
    keys = list(keys)
    if candidates is not None:
        return once(_top_k(score_candidates(queries, store, keys, candidates, num_features), keys, k), "hits")
    qvec = question_vectors(queries, num_features)
    dvec = P.packed(doc_vectors, keys) if doc_vectors is not None else \
        P.vector_table(store, keys, "content", num_features, lowercase=False)
    # The ranking pass runs once: its (questions x k) result is written to the
    # shared folder and read back.
    hits = once(_top_k(P.best_hits(dvec, keys, once(qvec, "questions"), k), keys, k), "hits")
    return _padded(hits, queries, store, keys, k)


def _padded(hits: DataFrame, queries: DataFrame, store: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``hits``, filled up to k with the documents of the lowest keys at similarity 0."""
    full = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k)
    short = queries.select("query_id").join(full, "query_id", "left_anti")
    if short.limit(1).count() == 0:
        return hits
    # Padding (rare): the k lowest keys (a bounded sort-limit) at similarity 0.
    pad_rows = store.select(*keys).orderBy(*keys).limit(k).collect()
    pad = _pair_with(short, pad_rows, keys).withColumn("similarity", F.lit(0.0))
    merged = (hits.drop("rank").unionByName(pad)
                  .groupBy("query_id", *keys).agg(F.max("similarity").alias("similarity")))
    return _top_k(merged, keys, k)


# ---------------------------------------------------------------------------
# Ranking by clusters (K5 on the text store): exact, whole clusters are passed over.
# ---------------------------------------------------------------------------

def cluster_cells(doc_vectors: DataFrame, keys: Sequence[str], centroids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a model says of a store's documents, to be kept with its version: members (keys..., cluster_id, with their vectors,
    those of a cluster side by side in every file), directions (cluster_id, feature, value: centres of length 1) and cells (cluster_id, least: the
    least cosine of a member with its centre's direction)."""
    keys = list(keys)
    terms, apart = assigned_terms(doc_vectors, keys, centroids)
    terms = once(terms.sortWithinPartitions("cluster_id"), "members")
    length = Window.partitionBy("cluster_id")
    directions = once(centroids.withColumn("_n", F.sqrt(F.sum(F.col("value") * F.col("value")).over(length)))
                      .where("_n > 0").select("cluster_id", "feature", (F.col("value") / F.col("_n")).alias("value")), "directions")
    least = P.least_cosines(terms, directions).groupBy("cluster_id").agg(F.min("least").alias("least"))
    return terms, directions, once(least, "cells")  # k rows


def rank_by_clusters(queries: DataFrame, store: DataFrame, keys: Sequence[str], doc_vectors: DataFrame, members: DataFrame,
                     directions: DataFrame, cells: DataFrame, k: int = TOP_K, num_features: int = NUM_FEATURES,
                     report: list | None = None) -> DataFrame:
    """The same hits as ``rank_content``.  Let a be the angle between a question and a cluster's direction, and r
    the widest angle of a member: no member is nearer than a - r.  First the cluster with the best bound is
    ranked for each question; then those whose bound reaches its k-th hit; the others are not looked
    at.  ``report`` receives (question-cluster pairs ranked, all such pairs)."""
    keys = list(keys)
    qvec = once(question_vectors(queries, num_features), "questions")
    angle = lambda c: F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))
    met = (qvec.join(directions, "feature").groupBy("query_id", "cluster_id").agg(
        F.sum(F.col("qtf") * F.col("value") / F.col("qnorm")).alias("cos")))
    ids = F.from_json(F.lit(json.dumps([r["cluster_id"] for r in cells.select("cluster_id").collect()])), "array<int>")  # k numbers
    every = qvec.select("query_id").distinct().select("query_id", F.explode(ids).alias("cluster_id"))
    apart = angle(F.coalesce("cos", F.lit(0.0))) - angle(F.col("least"))
    bounds = once(every.join(cells, "cluster_id").join(met, ["query_id", "cluster_id"], "left").select(
        "query_id", "cluster_id", F.cos(F.greatest(apart, F.lit(0.0))).alias("bound")), "bounds")
    best = bounds.groupBy("query_id").agg(F.min(F.struct(-F.col("bound"), F.col("cluster_id").alias("cluster_id"))).alias("b")).select("query_id", "b.cluster_id")
    # a cluster's members side by side in every file, so that a chunk holds members of one
    vectors_of = members if "features" in members.columns else once(
        P.packed(doc_vectors, keys).join(members.select(*keys, "cluster_id"), keys)
        .select(*keys, "cluster_id", "features", "tf", "norm").sortWithinPartitions("cluster_id"), "members")

    def ranked(pairs: DataFrame) -> DataFrame:
        asked = once(qvec.join(pairs, "query_id"), "asked")
        return once(_top_k(P.best_hits(vectors_of, keys, asked, k, ["cluster_id"]), keys, k), "hits")

    first = ranked(best)
    line = first.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("line"))
    # a little below the line, for rounding in the angles
    rest = once(bounds.join(best, ["query_id", "cluster_id"], "left_anti").join(line, "query_id", "left")
                .where(F.col("bound") >= F.coalesce("line", F.lit(0.0)) - 1e-9).select("query_id", "cluster_id"), "rest")
    if report is not None:
        report.append((best.count() + rest.count(), bounds.count()))
    hits = once(_top_k(ranked(rest).unionByName(first).drop("rank"), keys, k), "hits")
    return _padded(hits, queries, store, keys, k)


def attach_content(ranked: DataFrame, store: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(query_id, rank, content) in rank order; ids missing from the store drop."""
    hits = ranked.select("query_id", "rank", *keys)
    return store.select(*keys, "content").join(hits, list(keys)) \
                .select("query_id", "rank", "content")


def generate_response(queries: DataFrame, info: DataFrame) -> DataFrame:
    """(query_id, answer): header + one ``- content`` line per hit, or apology.

    Left join from the questions so a question without hits keeps a row.
    """
    per_q = info.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("_hits"))
    joined = queries.select("query_id", "query").join(per_q, "query_id", "left")
    body = F.array_join(F.transform(F.col("_hits"),
                                    lambda h: F.concat(F.lit(HIT_PREFIX), h["content"], F.lit("\n"))),
                        "")
    answer = F.when(F.coalesce(F.size("_hits"), F.lit(0)) <= 0, F.lit(NO_INFO)).otherwise(
        F.concat(F.lit(HEADER_PREFIX), F.col("query"), F.lit(HEADER_SUFFIX), body))
    return joined.select("query_id", answer.alias("answer"))


def answer_queries(queries: DataFrame, store: DataFrame, keys: Sequence[str] = ("doc_id", "line_no"),
                   k: int = TOP_K, candidates: int | None = None,
                   content_store: DataFrame | None = None,
                   num_features: int = NUM_FEATURES) -> DataFrame:
    """Questions -> answers.  An empty store answers every question with the
    'not trained' text.  ``content_store`` may be a cheaper view of the store
    used only to fetch the hit contents (defaults to ``store``)."""
    keys = list(keys)
    trained = store.limit(1).count() > 0
    if not trained:
        return queries.select("query_id", F.lit(NOT_TRAINED).alias("answer"))
    ranked = rank_content(queries, store, keys, k, candidates, num_features)
    info = attach_content(ranked, content_store if content_store is not None else store, keys)
    return generate_response(queries, info)
