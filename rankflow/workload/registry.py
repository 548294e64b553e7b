"""The registered queries, by name."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions import gates
from rankflow.functions import replies as R
from rankflow.functions import text as X
from rankflow.functions import vectors as V
from rankflow.operators import complete as C
from rankflow.operators import (dense, fusion, judge, lexical, metrics, queries, ranking, render,
                                repair, rerank, sessions)
from rankflow.plans import chat as CH
from rankflow.plans import evaluate as E
from rankflow.plans import recommend as P
from rankflow.plans import repair as RP
from rankflow.plans import retrieval as T
from rankflow.session import scratch_path, shared_dir
from rankflow.sources import sinks, splits, tables
from rankflow.streaming import turns as S
from rankflow.workload.views import Views, scores_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TOPK = 20
LISTS = ("query_id", "item_id", "rank", "score")
KNOWN_MEAN = 4.4


def query(build: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Views(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def rounded(name: str, digits: int = ranking.SCORE_DECIMALS) -> F.Column:
    return F.round(name, digits).alias(name)


def _index(v: Views, name: str, items: DataFrame) -> lexical.LexicalIndex:
    """Index of the running application for one table, built at its first use."""
    app = v.spark.sparkContext.applicationId
    where = hashlib.sha256(v.root.encode()).hexdigest()[:12]
    return lexical.open_index(items, f"{shared_dir(v.spark)}/rankflow/{app}/{where}/{name}", check=False)


def document_index(v: Views) -> lexical.LexicalIndex:
    return _index(v, "documents", v.documents)


def catalog_index(v: Views) -> lexical.LexicalIndex:
    return _index(v, "catalog", v.catalog.select(
        F.col("track_id").alias("item_id"), X.lexical_text().alias("text")))


# -- session shaping ------------------------------------------------------------------


@query
def last_user_turn(v: Views) -> DataFrame:
    return sessions.last_user_turn(v.turns)


@query
def all_user_turns(v: Views) -> DataFrame:
    return sessions.all_user_turns(v.turns).drop("pos")


@query
def turn_grid(v: Views) -> DataFrame:
    return sessions.turn_grid(v.shop_turns)


@query
def turn_grid_last_only(v: Views) -> DataFrame:
    return sessions.turn_grid(v.shop_turns, 8, 8)


@query
def history_theta(v: Views) -> DataFrame:
    rows = sessions.history(v.turns, sessions.last_user_turn(v.turns))
    return rows.groupBy("session_id", "target_turn").agg(
        F.count("*").alias("n_rows"),
        X.in_order(F.struct("turn_number", "pos"), F.col("content")).alias("history_text"))


@query
def history_window(v: Views) -> DataFrame:
    return sessions.history_window(v.shop_turns).select(
        "session_id", "turn_number", F.size("history").cast("long").alias("n_rows"),
        F.array_join(F.transform("history", lambda h: h["content"]), "|").alias("history_text"))


@query
def role_remap(v: Views) -> DataFrame:
    return sessions.remap_roles(v.shop_turns, v.catalog)


@query
def role_remap_system(v: Views) -> DataFrame:
    return sessions.remap_roles(v.turns, v.catalog, system_too=True)


@query
def session_memory(v: Views) -> DataFrame:
    return sessions.session_memory(v.shop_turns, v.shop_targets, v.catalog).select(
        "session_id", "target_turn", "seq.turn_number", "seq.pos", "role", "content")


@query
def memory_packed(v: Views) -> DataFrame:
    memory = sessions.memory_array(sessions.session_memory(v.shop_turns, v.shop_targets, v.catalog))
    return memory.select("session_id", F.array_join(F.transform(
        "memory", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("memory"))


@query
def profile_text(v: Views) -> DataFrame:
    return sessions.profiles(v.users)


@query
def ground_truth_first(v: Views) -> DataFrame:
    return sessions.ground_truth_first(v.shop_turns)


@query
def ground_truth_last(v: Views) -> DataFrame:
    return sessions.ground_truth_last(v.shop_turns)


# -- catalogue and texts --------------------------------------------------------------


def _two_splits(v: Views) -> DataFrame:
    """The catalogue, and a second split that replaces some of its tracks."""
    newer = v.catalog.filter(F.col("track_id").cast("long") % 3 == 0).withColumn(
        "track_name", F.concat("track_name", F.lit(" (new)")))
    return v.catalog.withColumn("split_no", F.lit(0)).unionByName(newer.withColumn("split_no", F.lit(1)))


@query
def catalog_dedupe(v: Views) -> DataFrame:
    return splits.last_wins(_two_splits(v), "track_id", "split_no").select("track_id", "track_name")


@query
def catalog_splits(v: Views) -> DataFrame:
    """The two splits written out, read back with a missing one skipped, settled."""
    root = scratch_path(v.spark, "splits")
    rows = _two_splits(v)
    for no, name in enumerate(("base", "newer")):
        rows.filter(F.col("split_no") == no).drop("split_no").write.parquet(f"{root}/split={name}")
    read = splits.read_splits(v.spark, root, ["base", "absent", "newer"], skip_missing=True)
    settled = tables.normalize_catalog(read)
    first = splits.read_preferred(v.spark, root, "train").select("track_id").withColumn("in_base", F.lit(1))
    return settled.join(first, "track_id", "left").select(
        "track_id", "track_name", F.array_join("artist_name", "+").alias("artists"),
        F.array_join("tag_list", "+").alias("tags"), "release_date", "in_base")


@query
def catalog_text_lexical(v: Views) -> DataFrame:
    return v.catalog.select("track_id", X.lexical_text().alias("text"))


@query
def catalog_text_dense(v: Views) -> DataFrame:
    return v.catalog.select("track_id", X.passage_text().alias("text"))


@query
def catalog_text_fields(v: Views) -> DataFrame:
    return v.catalog.select("track_id", X.field_dump().alias("text"))


@query
def catalog_text_display(v: Views) -> DataFrame:
    return v.catalog.select("track_id", X.display_text().alias("text"))


@query
def plain_query(v: Views) -> DataFrame:
    return queries.plain_query(v.turns, sessions.last_user_turn(v.turns)).select("session_id", "query_text")


@query
def weighted_query_text(v: Views) -> DataFrame:
    parts = queries.query_parts(v.shop_turns, v.shop_targets, v.catalog)
    return queries.query_text(parts).select("session_id", "query_text")


def _shop_texts(v: Views) -> DataFrame:
    return queries.query_parts(v.shop_turns, v.shop_targets, v.catalog).select(
        F.col("session_id").alias("query_id"), "text", "weight")


@query
def weighted_query_terms(v: Views) -> DataFrame:
    return queries.query_terms(_shop_texts(v))


@query
def tokenize(v: Views) -> DataFrame:
    return lexical.term_counts(v.documents)


@query
def postings(v: Views) -> DataFrame:
    return lexical.postings(v.documents).select(
        "item_id", "term", F.col("tf").cast("long"), F.col("len").cast("long"))


# -- retrieval ------------------------------------------------------------------------


@query
def bm25_topk(v: Views) -> DataFrame:
    return lexical.bm25_topk(document_index(v), queries.query_terms(v.last_texts), TOPK)


@query
def bm25_rank_score(v: Views) -> DataFrame:
    return lexical.bm25_rank_scored(document_index(v), queries.query_terms(v.last_texts), TOPK).select(
        "query_id", "item_id", "rank", rounded("score"))


@query
def bm25_weighted_topk(v: Views) -> DataFrame:
    return lexical.bm25_topk(catalog_index(v), queries.query_terms(_shop_texts(v)), TOPK)


@query
def segmented_topk(v: Views) -> DataFrame:
    """An index of most documents, some with an older text, brought up to date by a segment; then searched."""
    path = scratch_path(v.spark, "segments")
    last = F.col("item_id") % 10
    old = v.documents.where(last != 9).withColumn("text", F.when(last == 3, F.concat(F.lit("older text of "), "text")).otherwise(F.col("text")))
    index = lexical.update_index(lexical.build_index(old, path), v.documents.where(last.isin(3, 9)), v.documents.where(last == 7).select("item_id"))
    return lexical.bm25_topk(index, queries.query_terms(v.last_texts), TOPK)


@query
def compacted_topk(v: Views) -> DataFrame:
    """The same documents, found out by comparison with an index of other ones, after all segments became one."""
    path = scratch_path(v.spark, "compacted")
    last = F.col("item_id") % 10
    lexical.build_index(v.documents.where(last != 9).withColumn("text", F.when(last == 3, F.lit("gone")).otherwise(F.col("text"))), path)
    index = lexical.compact_index(lexical.open_index(v.documents.where(last != 7), path))
    return lexical.bm25_topk(index, queries.query_terms(v.last_texts), TOPK)


def _with_zero(v: Views) -> DataFrame:
    e = v.embeddings.select("vec_id", F.transform(
        V.as_double(F.col("embedding")), lambda x: x * (1 + F.col("vec_id") % 3)).alias("embedding"))
    zero = v.embeddings.groupBy().agg((F.max("vec_id") + 1).alias("vec_id"),
                                      F.array_repeat(F.lit(0.0), 64).alias("embedding"))
    return e.unionByName(zero)


@query
def normalize_vectors(v: Views) -> DataFrame:
    unit = _with_zero(v).select("vec_id", V.normalize(F.col("embedding")).alias("v"))
    return unit.select("vec_id", F.posexplode("v").alias("i", "x")).select("vec_id", "i", rounded("x"))


def _self_queries(v: Views) -> DataFrame:
    return v.embeddings.select(F.col("vec_id").alias("query_id"),
                               V.normalize(F.col("embedding")).alias("vector"))


@query
def dense_topk(v: Views) -> DataFrame:
    items = dense.vectors_table(v.embeddings, "vec_id", "embedding")
    return dense.dense_topk(dense.vector_index(items), _self_queries(v), TOPK)


@query
def precomputed_topk(v: Views) -> DataFrame:
    """A named vector column, divided into cells, opened again from its saved index."""
    items = v.item_vectors.withColumnRenamed("vector", "taste")
    path = scratch_path(v.spark, "vectors")
    dense.vector_index(dense.vectors_table(items, "item_id", "taste"), path)
    return dense.dense_topk(dense.load_vectors(v.spark, path), _self_queries(v), TOPK)


def _taste(v: Views) -> DataFrame:
    return v.user_vectors.withColumnRenamed("user_id", "query_id")


@query
def cf_user_topk(v: Views) -> DataFrame:
    return T.retrieve("cf", T.Indexes(collaborative=dense.vector_index(v.item_vectors)),
                      T.Queries(user_vectors=_taste(v)), topk=TOPK)


@query
def hybrid_topk(v: Views) -> DataFrame:
    indexes = T.Indexes(document_index(v), dense.vector_index(v.document_vectors))
    return T.retrieve("hybrid", indexes, T.Queries(v.last_texts, v.last_vectors), topk=TOPK,
                      candidate_k=100).select(*LISTS[:3], rounded("score"))


def _facets(v: Views) -> DataFrame:
    """(query_id, facets): facet queries out of a reply object, as a model would give it."""
    last = v.last_texts.select(F.col("query_id").alias("session_id"), "text")
    first = sessions.with_role(v.turns, "user").groupBy("session_id").agg(
        F.min_by("content", "turn_number").alias("opening"))
    rows = last.join(first, "session_id")
    reply = F.when(F.col("session_id") % 5 != 0, F.to_json(F.struct(
        F.col("text").alias("q1"), F.col("opening").alias("q2"))))
    return rows.select(F.col("session_id").alias("query_id"),
                       R.facet_queries(reply, F.col("text")).alias("facets"))


@query
def multi_query_topk(v: Views) -> DataFrame:
    facets = T.facet_table(_facets(v))
    vectors = v.assigned_vectors(facets.select("query_id", "parent_id", "list_no"), "query_id",
                                 F.col("parent_id") + F.col("list_no"))
    indexes = T.Indexes(document_index(v), dense.vector_index(v.document_vectors))
    ranked = T.retrieve("multi_query", indexes, T.Queries(
        facets.select("query_id", "text"), vectors, facets=facets), topk=50)
    return ranked.select(*LISTS[:3], rounded("score"))


# -- fusion and reranking -------------------------------------------------------------


@query
def rrf(v: Views) -> DataFrame:
    lists = [lexical.bm25_topk(document_index(v), queries.query_terms(v.last_texts), TOPK),
             dense.dense_topk(dense.vector_index(v.document_vectors), v.last_vectors, TOPK)]
    return fusion.rrf(lists).select(*LISTS[:3], rounded("score"))


@query
def rrf_weighted(v: Views) -> DataFrame:
    indexes = T.Indexes(catalog_index(v), collaborative=dense.vector_index(v.item_vectors))
    return T.retrieve("bm25_cf", indexes, T.Queries(_shop_texts(v), user_vectors=_taste(v)), topk=TOPK,
                      lexical_weight=0.7, collaborative_weight=0.3).select(*LISTS[:3], rounded("score"))


@query
def profile_rerank(v: Views) -> DataFrame:
    return rerank.profile_rerank(v.ranked, v.query_users, v.user_vectors, v.item_vectors)


@query
def listwise_merge(v: Views) -> DataFrame:
    ids = v.replies.select("query_id", R.parse_id_array(F.col("reply"), F.col("ids"), 12).alias("ids"))
    return rerank.listwise_merge(v.ranked, rerank.answer_rows(ids), TOPK)


@query
def rerank_chain(v: Views) -> DataFrame:
    return P.rerank_chain(v.ranked, v.query_users, v.user_vectors, v.item_vectors,
                          v.replies.select("query_id", "reply"), window=10, topk=15)


# -- replies --------------------------------------------------------------------------


def _joined(name: str) -> F.Column:
    return F.array_join(name, ",").alias(name)


@query
def parse_id_array(v: Views) -> DataFrame:
    return v.replies.select("query_id", R.parse_id_array(F.col("reply"), F.col("ids"), 10).alias("ranked")
                            ).select("query_id", _joined("ranked"))


@query
def parse_id_array_lazy(v: Views) -> DataFrame:
    return v.replies.select("query_id", R.parse_id_array(
        F.concat("reply", F.lit(" see also [1]")), F.col("ids"), greedy=False).alias("ranked")
        ).select("query_id", _joined("ranked"))


@query
def parse_rank_object(v: Views) -> DataFrame:
    rows = v.replies.select("query_id", R.parse_rank_object(F.col("reply"), F.col("ids")).alias("r"))
    return rows.select("query_id", F.array_join("r.ranked", ",").alias("ranked"), "r.response")


@query
def strip_fences(v: Views) -> DataFrame:
    return v.replies.select("query_id", R.strip_fences(F.col("reply")).alias("text"))


@query
def entity_query(v: Views) -> DataFrame:
    rows = v.shop_targets.join(sessions.ground_truth_last(v.shop_turns), ["session_id", "turn_number"], "left")
    c = v.catalog.withColumnRenamed("track_id", "truth")
    s = F.col("session_id")
    full = F.concat(F.lit('{"artists": ["'), F.array_join("artist_name", '", "'), F.lit('", ""], "genres": ["'),
                    F.array_join("tag_list", '", "'), F.lit('"], "era": "'), F.substring("release_date", 1, 4),
                    F.lit('", "moods": [], "user_query": "'), F.col("query"), F.lit('"}'))
    reply = (F.when(s % 4 == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
             .when(s % 4 == 1, full).when(s % 4 == 2, F.lit('{"artists": [], "era": ""}')).otherwise("not json"))
    return rows.join(c, "truth", "left").select(
        "session_id", R.entity_query(reply, F.col("query")).alias("query_text"))


@query
def facet_queries(v: Views) -> DataFrame:
    return T.facet_table(_facets(v)).select("query_id", "parent_id", F.col("list_no").cast("long"), "text")


@query
def parse_scores(v: Views) -> DataFrame:
    s = F.col("session_id")
    p, e = (s % 7).cast("string"), (s % 6).cast("string")
    number = F.concat(F.lit('Scores: {"personalization": '), p, F.lit(', "explanation": "'), e,
                      F.lit('", "reasoning": "case '), p, F.lit('"} done'))
    reply = F.when(s % 11 == 0, "no scores").otherwise(number)
    rows = v.shop_targets.select("session_id", R.parse_scores(reply).alias("s"))
    return rows.select("session_id", "s.*")


# -- rendering ------------------------------------------------------------------------


def _render(style: str, view: Callable[[Views], DataFrame], **options) -> Callable[[Views], DataFrame]:
    def build(v: Views) -> DataFrame:
        turns = view(v)
        targets = sessions.last_user_turn(turns)
        past = sessions.history(turns, targets)
        return render.render_turns(past, style, v.catalog, targets)

    build.__name__ = f"render_turns_{style}"
    return query(build)


_render("roles", lambda v: v.turns)
_render("played", lambda v: v.shop_turns)
_render("previously", lambda v: v.shop_turns)


@query
def render_turns_quoted(v: Views) -> DataFrame:
    return render.render_turns(v.shop_turns, "quoted")


@query
def render_turns_judge(v: Views) -> DataFrame:
    return render.render_turns(v.turns, "judge")


def _render_candidates(style: str) -> Callable[[Views], DataFrame]:
    def build(v: Views) -> DataFrame:
        return render.render_candidates(v.ranked, v.catalog, style, n=5 if style in ("bullet", "quoted") else None)

    build.__name__ = f"render_candidates_{style}"
    return query(build)


for _style in render.STYLE_TAGS:
    _render_candidates(_style)


@query
def template_response(v: Views) -> DataFrame:
    return render.template_response(v.ranked, v.catalog)


@query
def system_prompts(v: Views) -> DataFrame:
    return sessions.profiles(v.users).select("user_id", render.system_prompt(
        "You recommend.", "Be brief.", "The listener:", F.col("profile")).alias("system"))


@query
def response_gates(v: Views) -> DataFrame:
    return v.responses.select(
        "session_id", gates.gate_reason(F.col("text")).alias("plain"),
        gates.gate_reason(F.col("text"), gates.USER_FIRST).alias("user_first"),
        gates.gate_reason(F.col("text"), gates.EXPLAINED).alias("explained"))


# -- metrics --------------------------------------------------------------------------


def _relevant(v: Views) -> DataFrame:
    return sessions.with_role(v.shop_turns, "music").select(
        F.col("session_id").alias("query_id"), F.col("content").alias("item_id"))


@query
def ndcg_set(v: Views) -> DataFrame:
    return metrics.ndcg_set(v.ranked, _relevant(v)).select("query_id", rounded("ndcg"))


@query
def ndcg_set_ideal(v: Views) -> DataFrame:
    return metrics.ndcg_set(v.ranked, _relevant(v), ideal_hits=True).select("query_id", rounded("ndcg"))


@query
def ndcg_single(v: Views) -> DataFrame:
    return metrics.ndcg_single(v.predictions, sessions.ground_truth_last(v.shop_turns)).select(
        "session_id", "turn_number", rounded("ndcg"))


@query
def ndcg_mean(v: Views) -> DataFrame:
    scored = metrics.ndcg_single(v.predictions, sessions.ground_truth_last(v.shop_turns))
    return metrics.ndcg_mean(scored).select(rounded("ndcg20"), "n", "skipped")


def _per_turn(v: Views) -> DataFrame:
    """The last prediction of a session repeated for its last two turns."""
    earlier = v.predictions.filter(F.col("turn_number") > 1).withColumn(
        "turn_number", F.col("turn_number") - 1)
    return v.predictions.unionByName(earlier)


@query
def last_turn_filter(v: Views) -> DataFrame:
    return metrics.last_turn_only(_per_turn(v)).select("session_id", "turn_number", "predicted_response")


@query
def lexical_diversity(v: Views) -> DataFrame:
    return metrics.lexical_diversity(v.predictions, "session_id", "predicted_response", metrics.BUCKET_TEXTS).select(rounded("lexdiv"))


def _evaluated(v: Views, all_turns: bool, bucket_texts: int | None = None) -> DataFrame:
    return E.evaluate(_per_turn(v), sessions.ground_truth_last(v.shop_turns), all_turns, bucket_texts=bucket_texts).select(
        "mode", rounded("ndcg20"), rounded("lexdiv"), "n")


@query
def evaluate_last_turn(v: Views) -> DataFrame:
    return _evaluated(v, False, metrics.BUCKET_TEXTS)


@query
def evaluate_all_turns(v: Views) -> DataFrame:
    return _evaluated(v, True)


# -- judging and repair ---------------------------------------------------------------


@query
def judge_means(v: Views) -> DataFrame:
    return judge.judge_means(v.scores_a).select(
        rounded("mean_p"), rounded("mean_e"), rounded("mean_combined"), "n_scored", "n_failed")


@query
def bias_corrected(v: Views) -> DataFrame:
    return judge.bias_corrected(v.scores_a, KNOWN_MEAN).select(
        "session_id", rounded("proxy_avg"), rounded("corrected_avg"), rounded("bias_factor"))


@query
def worst_best(v: Views) -> DataFrame:
    rows = judge.bias_corrected(v.scores_a, KNOWN_MEAN).withColumn("corrected_avg", F.round("corrected_avg", 6))
    return judge.extremes(rows, 20, "corrected_avg").select("session_id", "corrected_avg", "side")


@query
def score_compare(v: Views) -> DataFrame:
    return judge.comparison(v.scores_a, v.scores_b).select(rounded("delta"), "n_worse")


@query
def largest_drops(v: Views) -> DataFrame:
    return judge.largest_drops(v.scores_a, v.scores_b)


@query
def targets_mean(v: Views) -> DataFrame:
    return repair.targets_mean(v.scores_a)


@query
def targets_band(v: Views) -> DataFrame:
    return repair.targets_band(v.scores_a)


@query
def targets_floor(v: Views) -> DataFrame:
    return repair.worst_first(repair.targets_floor(v.scores_a), "explanation")


@query
def work_rows(v: Views) -> DataFrame:
    return _work(v).select("session_id", "avg", "predicted_response", "conversation", "candidates")


def _work(v: Views) -> DataFrame:
    shown = render.render_candidates(v.ranked, v.catalog, "quoted", n=3, tags=5)
    return repair.work_rows(repair.targets_band(v.scores_a), v.predictions,
                            render.render_turns(v.shop_turns, "quoted"),
                            shown.withColumnRenamed("query_id", "session_id"))


@query
def unmatched_targets(v: Views) -> DataFrame:
    known = v.predictions.filter(F.col("predicted_response") != "")
    return repair.unmatched(repair.targets_mean(v.scores_a), known, sessions.last_user_turn(v.shop_turns))


@query
def guard_live(v: Views) -> DataFrame:
    return repair.guard_live(v.guard_rows)


@query
def guard_strict(v: Views) -> DataFrame:
    return repair.guard_strict(v.guard_rows)


def _cleared(v: Views) -> DataFrame:
    return repair.cleared(repair.guard_live(v.guard_rows)).select(
        "session_id", F.concat(F.lit("Patched at "), F.col("new_score").cast("string")).alias("response"))


@query
def patch(v: Views) -> DataFrame:
    return repair.patch(v.predictions, _cleared(v)).select(
        "session_id", "turn_number", F.array_join("predicted_track_ids", ",").alias("ids"), "predicted_response")


@query
def merge_responses(v: Views) -> DataFrame:
    source = v.predictions.filter(F.col("session_id") % 3 != 0)
    return repair.merge_responses(v.predictions, source).select("session_id", "predicted_response")


@query
def validate_lists(v: Views) -> DataFrame:
    return repair.validated(v.defective).select("session_id", "has_duplicates", "is_short")


@query
def repair_counts(v: Views) -> DataFrame:
    answered = v.responses.filter(F.col("text").isNotNull())
    return repair.counts(v.responses, answered, repair.guard_live(v.guard_rows))


# -- caller-supplied functions --------------------------------------------------------


def length_completer(prompt: str) -> str | None:
    """Stand-in for a model: a judge reply that depends on the prompt's length."""
    n = len(prompt)
    if n % 9 == 0:
        raise RuntimeError("no answer")
    return f'Scores: {{"personalization": {1 + n % 5}, "explanation": {1 + n % 7}, "reasoning": "n={n}"}}'


def count_encoder(texts: Sequence[str]) -> np.ndarray:
    """Stand-in for an encoder: counts of a few letters, and 1."""
    return np.array([[t.count("a"), t.count("e"), t.count("o"), 1.0] for t in texts])


@query
def batch_complete(v: Views) -> DataFrame:
    rows = v.turns.select("session_id", "turn_number", F.concat_ws(": ", "role", "content").alias("prompt"))
    answered = C.complete(rows, length_completer, accept=F.contains("reply", F.lit("=")), max_tries=2)
    return C.with_fallback(answered, "reply", F.lit("none")).select(
        "session_id", "turn_number", "reply", "is_fallback")


@query
def batch_encode(v: Views) -> DataFrame:
    rows = v.documents.select("item_id", C.encode(F.col("text"), count_encoder).alias("v"))
    return rows.select("item_id", *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(4)])


JUDGE_TEMPLATE = "Conversation:\n{conversation}\nResponse:\n{response}\nTracks:\n{tracks}"


@query
def score_predictions(v: Views) -> DataFrame:
    v.write_turns()
    prompts = E.judge_prompts(v.predictions, v.shop_turns, v.catalog, JUDGE_TEMPLATE)
    return E.score_predictions(prompts, length_completer).drop("turn_number")


def quoting_completer(prompt: str) -> str:
    """Stand-in for a writer: quotes the last line of the prompt back to the user."""
    last = prompt.rsplit("\n", 1)[-1]
    return f"You will know this one — {last} is close to what was played before."


WORK_TEMPLATE = "Conversation:\n{conversation}\nTracks:\n{tracks}"


@query
def repair_run(v: Views) -> DataFrame:
    result = RP.repair(v.predictions, _work(v), quoting_completer, WORK_TEMPLATE, gates.EXPLAINED,
                       length_completer, JUDGE_TEMPLATE)
    return result.predictions.select("session_id", "predicted_response")


def _turn_work(v: Views) -> DataFrame:
    """Work rows of single turns: weak ones of a session's last two, each with what was said up to it."""
    predictions = _per_turn(v)
    scores = predictions.select("session_id", "turn_number", *scores_of(F.col("session_id") + F.col("turn_number"), 7, 5, 13))
    shown = render.render_candidates(v.ranked, v.catalog, "quoted", n=3, tags=5)
    return repair.work_rows(repair.targets_band(scores), predictions, render.render_upto(v.shop_turns, predictions, "quoted"),
                            shown.withColumnRenamed("query_id", "session_id"))


@query
def work_rows_turns(v: Views) -> DataFrame:
    return _turn_work(v).select("session_id", "turn_number", "avg", "predicted_response", "conversation", "candidates")


@query
def repair_run_turns(v: Views) -> DataFrame:
    """Several predictions a session, each judged and patched on its own."""
    result = RP.repair(_per_turn(v), _turn_work(v), quoting_completer, WORK_TEMPLATE, gates.EXPLAINED,
                       length_completer, JUDGE_TEMPLATE)
    return result.predictions.select("session_id", "turn_number", "predicted_response")


@query
def repair_run_counts(v: Views) -> DataFrame:
    """What the repair of single turns counted on its way."""
    counts = RP.repair(_per_turn(v), _turn_work(v), quoting_completer, WORK_TEMPLATE, gates.EXPLAINED, length_completer, JUDGE_TEMPLATE).counts
    return v.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} long" for name in counts))


@query
def score_predictions_turns(v: Views) -> DataFrame:
    """The predictions of a session's last two turns, judged by what was said up to each."""
    v.write_turns()
    turn = F.col("turn_number")
    rows = _per_turn(v).withColumn("predicted_response", F.concat("predicted_response", F.lit("@"), turn.cast("string")))
    return E.score_predictions(E.judge_prompts(rows, v.shop_turns, v.catalog, JUDGE_TEMPLATE), length_completer)


@query
def response_stage(v: Views) -> DataFrame:
    """Responses from the first item's display text and the conversation."""
    talk = render.render_turns(v.shop_turns, "quoted").withColumnRenamed("session_id", "query_id")
    system = v.query_users.join(sessions.profiles(v.users), "user_id").select("query_id", render.system_prompt(
        "You recommend.", "Be brief.", "The listener:", F.col("profile")).alias("system"))
    return P.responses(v.ranked, v.catalog, talk, system, quoting_completer, "{system}\n{conversation}\n{item}")


@query
def recommend(v: Views) -> DataFrame:
    """Sessions to prediction rows: weighted query, text and taste, template response."""
    indexes = T.Indexes(catalog_index(v), collaborative=dense.vector_index(v.item_vectors))
    rows = P.recommend(v.shop_turns, v.session_users, v.catalog, indexes, "bm25_cf",
                       user_vectors=v.user_vectors)
    return rows.select("session_id", "user_id", "turn_number",
                       F.array_join("predicted_track_ids", ",").alias("ids"), "predicted_response")


def tagging_completer(prompt: str) -> str:
    """Stand-in for a rewriter: a genre and the last line of the prompt."""
    said = prompt.rsplit("\n", 1)[-1]
    if len(said) % 5 == 0:
        raise RuntimeError("no answer")
    return json.dumps({"genres": ["steel"], "user_query": said})


def facet_completer(prompt: str) -> str:
    """Stand-in for a model of facets: the last line, the same with a word more, and a word."""
    said = prompt.rsplit("\n", 1)[-1]
    return "none" if len(said) % 5 == 0 else json.dumps({"q1": said, "q2": f"steel {said}", "q3": "small"})


def reversing_completer(prompt: str) -> str:
    """Stand-in for a ranker: the ids of the candidate lines from the last to the first."""
    ids = re.findall(r"^\d+\. \[([^\]]+)\]", prompt, re.M)
    return "no idea" if int(ids[0]) % 4 == 0 else json.dumps(ids[::-1])


def _chat(v: Views) -> CH.Chat:
    system = sessions.profiles(v.users).select("user_id", render.system_prompt(
        "You recommend.", "Be brief.", "The listener:", F.col("profile")).alias("system"))
    return CH.Chat(
        rewrite=CH.Rewrite(tagging_completer, "Query:\n{query}"), profile=CH.Profile(v.user_vectors, v.item_vectors),
        rank=CH.Rank(reversing_completer, "{conversation}\nCandidates:\n{candidates}", "tagged", 12),
        respond=CH.Respond(quoting_completer, "{system}\n{conversation}\n{item}", system))


def _predicted(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("session_id").cast("long").alias("session_id"), "user_id", F.col("turn_number").cast("long").alias("turn_number"),
                       F.array_join("predicted_track_ids", ",").alias("ids"), "predicted_response")


@query
def chat_turns(v: Views) -> DataFrame:
    """The whole turn: rewritten query, retrieval, reranking by taste and by a list, response."""
    return _predicted(CH.chat(v.shop_turns, v.session_users, v.catalog, T.Indexes(catalog_index(v)), _chat(v)))


@query
def chat_facets(v: Views) -> DataFrame:
    """Three facet queries a turn, searched apart and fused, with the template's response."""
    plan = CH.Chat("multi_query", rewrite=CH.Rewrite(facet_completer, "{query}", facets=3), options={"dense_weight": 0.0})
    return _predicted(CH.chat(v.shop_turns, v.session_users, v.catalog, T.Indexes(catalog_index(v)), plan))


@query
def stream_chat(v: Views) -> DataFrame:
    """The last turns of all sessions as a stream of files, each taken through the whole turn."""
    out, feed = scratch_path(v.spark, "stream"), scratch_path(v.spark, "feed")
    last = v.shop_targets.select(F.col("session_id").cast("string").alias("session_id"), F.col("turn_number").cast("int").alias("turn_number"))
    S.turn_events(v.shop_turns).join(last, ["session_id", "turn_number"], "left_semi").repartition(4, "session_id").write.parquet(feed)
    stream = S.start_chat(S.read_turn_events(v.spark, feed), v.session_users, v.catalog, T.Indexes(catalog_index(v)), _chat(v),
                          f"{out}/rows", f"{out}/checkpoint", f"{out}/replies", available_now=True)
    stream.awaitTermination()
    return _predicted(S.read_ranked(v.spark, f"{out}/rows"))


@query
def stream_retrieve(v: Views) -> DataFrame:
    """All user turns with their histories as a stream of files, ranked turn by turn."""
    out, feed = scratch_path(v.spark, "stream"), scratch_path(v.spark, "feed")
    S.turn_events(v.turns).repartition(4, "session_id").write.parquet(feed)
    stream = S.start_ranking(S.read_turn_events(v.spark, feed), document_index(v), f"{out}/lists",
                             f"{out}/checkpoint", TOPK, available_now=True)
    stream.awaitTermination()
    return S.read_ranked(v.spark, f"{out}/lists").select(P.turn_key().alias("query_id"), "item_id", "rank", "score")


# -- sources and sinks ----------------------------------------------------------------


@query
def prediction_roundtrip(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "predictions")
    sinks.write_predictions(v.predictions, path)
    return tables.read_predictions(v.spark, path).select(
        "session_id", "user_id", F.col("turn_number").cast("long"),
        F.array_join("predicted_track_ids", ",").alias("ids"), "predicted_response")


@query
def index_roundtrip(v: Views) -> DataFrame:
    index = document_index(v)
    return index.terms.select("term", "df", rounded_idf(index).alias("idf"))


def rounded_idf(index: lexical.LexicalIndex) -> F.Column:
    return F.round(lexical.idf(F.col("df"), index.n_items), 6)


@query
def judge_roundtrip(v: Views) -> DataFrame:
    """Scores written as files of a hundred sessions each with their header, read back as a table."""
    path = scratch_path(v.spark, "scores")
    sinks.write_judge_scores(v.scores_a.withColumn("reasoning", F.lit("ok")), path, KNOWN_MEAN, sessions_per_object=100)
    return tables.read_judge_scores(v.spark, path, multiline=False).withColumn("proxy_avg", F.round("proxy_avg", 6))


@query
def metrics_roundtrip(v: Views) -> DataFrame:
    path = sinks.write_metrics(_evaluated(v, False), scratch_path(v.spark, "metrics"), "run")
    return v.spark.read.schema("mode string, ndcg20 double, lexdiv double, n long").json(path)


@query
def nested_sessions(v: Views) -> DataFrame:
    """Turns nested into sessions, written, read with the declared schema, flattened."""
    path = scratch_path(v.spark, "sessions")
    turn = F.struct(F.col("turn_number").cast("int").alias("turn_number"), "role", "content")
    v.shop_turns.groupBy(F.col("session_id").cast("string").alias("session_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn_number", "pos", turn.alias("turn")))),
                    lambda r: r["turn"]).alias("conversations")).withColumn(
        "user_id", F.col("session_id")).write.parquet(path)
    flat = sessions.flatten_sessions(tables.first_sessions(tables.read_sessions(v.spark, path), None))
    return sessions.last_user_turn(flat).select("session_id", F.col("turn_number").cast("long"), "query")


@query
def users_settled(v: Views) -> DataFrame:
    """Users written as two splits, all splits read, the last one winning."""
    root = scratch_path(v.spark, "users")
    users = v.users.withColumn("user_id", F.col("user_id").cast("string"))
    newer = users.filter(F.col("gender").isNull()).withColumn("gender", F.lit("y"))
    users.write.parquet(f"{root}/split=first")
    newer.write.parquet(f"{root}/split=second")
    return tables.normalize_users(splits.read_splits(v.spark, root))


@query
def first_sessions(v: Views) -> DataFrame:
    """The first 50 sessions by id, as the limit of a trial run is."""
    return tables.first_sessions(v.shop_targets.withColumn("session_id", F.col("session_id").cast("string")), 50)


@query
def encoder_query(v: Views) -> DataFrame:
    return v.last_texts.select("query_id", X.query_text(F.col("text")).alias("text"))


@query
def short_ids(v: Views) -> DataFrame:
    """Leading characters of the hashed session ids, as reports show them."""
    return v.shop_targets.select("session_id", X.short_id(F.md5(F.col("session_id").cast("string"))).alias("short"))


@query
def tasks_without_result(v: Views) -> DataFrame:
    """Sessions that the judge gave no score."""
    return repair.without_result(v.shop_targets, v.scores_a.filter(F.col("personalization").isNotNull())).select("session_id")


@query
def empty_replies(v: Views) -> DataFrame:
    """Prompts put to the completer that says nothing."""
    rows = v.turns.select("session_id", "turn_number", F.concat_ws(": ", "role", "content").alias("prompt"))
    return C.complete(rows, C.empty_completer).select("session_id", "turn_number", "reply")
