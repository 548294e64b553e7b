"""Sessions to predictions: query, retrieve, rerank, respond."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions import replies as R
from rankflow.functions import text as X
from rankflow.operators import complete as C
from rankflow.operators import queries as Q
from rankflow.operators import render, rerank, sessions
from rankflow.operators.joins import lookup
from rankflow.operators.ranking import truncate
from rankflow.operators.repair import require_unique
from rankflow.plans.retrieval import Indexes, Queries, retrieve
from rankflow.session import materialize
from rankflow.sources.sinks import pack_ranked, prediction_rows


def turn_key(session: Column | str = "session_id", turn: Column | str = "turn_number") -> Column:
    """Query id of one turn of a session."""
    return F.concat_ws("/", F.col(session).cast("string") if isinstance(session, str) else session,
                       F.col(turn).cast("string") if isinstance(turn, str) else turn)


def targets_of(turns: DataFrame, mode: str = "last", grid: tuple[int, int] = (1, 8)) -> DataFrame:
    """Turns to predict: each session's last user turn, all of them, or a fixed grid."""
    if mode == "last":
        return sessions.last_user_turn(turns)
    if mode == "all":
        return sessions.all_user_turns(turns).drop("pos")
    if mode == "grid":
        return sessions.turn_grid(turns, *grid)
    raise ValueError(f"unknown target mode: {mode}")


def weighted_texts(turns: DataFrame, targets: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Weighted query texts (query_id, text, weight) of the targets."""
    return Q.query_parts(turns, targets, catalog).select(
        turn_key(turn="target_turn").alias("query_id"), "text", "weight")


def plain_texts(turns: DataFrame, targets: DataFrame) -> DataFrame:
    """Plain conversation queries (query_id, text)."""
    return Q.plain_query(turns, targets).select(
        turn_key(turn="target_turn").alias("query_id"), F.col("query_text").alias("text"))


def reformulated_texts(targets: DataFrame, prompts: DataFrame, completer: C.Completer,
                       **options) -> DataFrame:
    """Entity queries (query_id, text) through a completer; the raw query if it fails.

    ``prompts`` is (session_id, turn_number, prompt).
    """
    rows = targets.join(prompts, ["session_id", "turn_number"])
    answered = C.complete(rows, completer, **options)
    return answered.select(turn_key().alias("query_id"),
                           R.entity_query(F.col("reply"), F.col("query")).alias("text"))


def facet_rows(targets: DataFrame, prompts: DataFrame, completer: C.Completer, n: int = 3,
               **options) -> DataFrame:
    """Facet queries (query_id, facets) through a completer.

    ``prompts`` is (session_id, turn_number, prompt, conversation); the conversation
    stands in when no facet comes back.
    """
    rows = targets.join(prompts, ["session_id", "turn_number"])
    answered = C.complete(rows, completer, **options)
    return answered.select(turn_key().alias("query_id"), R.facet_queries(
        F.col("reply"), F.col("conversation"), n).alias("facets"))


def rerank_chain(ranked: DataFrame, users: DataFrame | None = None,
                 user_vectors: DataFrame | None = None, item_vectors: DataFrame | None = None,
                 answers: DataFrame | None = None, window: int | None = None,
                 topk: int = 20) -> DataFrame:
    """Profile reranking, then listwise answers, then the cut; each stage optional.

    ``answers`` is (query_id, reply): raw replies holding an array of item ids.
    """
    out = ranked
    if users is not None:
        out = rerank.profile_rerank(out, users, user_vectors, item_vectors)
    if answers is not None:
        if users is not None:
            # written once: the offer and the merge both read the lists, which would be reranked twice
            out = materialize(out, "offered")
        offered = pack_ranked(rerank.candidate_window(out, window), ["query_id"])
        ids = answers.join(offered, "query_id").select("query_id", R.parse_id_array(
            F.col("reply"), F.col("predicted_track_ids"), topk).alias("ids"))
        out = rerank.listwise_merge(out, rerank.answer_rows(ids), topk)
    return truncate(out, topk).select("query_id", "item_id", "rank")


def listwise_replies(ranked: DataFrame, conversations: DataFrame, catalog: DataFrame,
                     completer: C.Completer, template: str, style: str = "fields",
                     window: int | None = None, **options) -> DataFrame:
    """(query_id, reply): a completer's ranking of each query's offered candidates.

    ``template`` has places ``{conversation}`` and ``{candidates}``; ``conversations``
    is (query_id, conversation).
    """
    offered = rerank.candidate_window(ranked, window)
    shown = render.render_candidates(offered, catalog, style)
    rows = shown.join(conversations, "query_id").select("query_id", render.fill_prompt(
        template, conversation=F.col("conversation"), candidates=F.col("candidates")).alias("prompt"))
    return C.complete(rows, completer, **options).select("query_id", "reply")


def responses(ranked: DataFrame, catalog: DataFrame, conversations: DataFrame,
              system: DataFrame, completer: C.Completer, template: str, **options) -> DataFrame:
    """(query_id, response) generated from the first item's display text.

    ``template`` has places ``{system}``, ``{conversation}`` and ``{item}``; ``system`` is
    (query_id, system). A query without any item, or whose call fails, gets an
    empty response.
    """
    shown = catalog.select(F.col("track_id").alias("item_id"), X.display_text().alias("item"))
    first = lookup(ranked.filter(F.col("rank") == 1).select("query_id", "item_id"), shown,
                   ["item_id"], "left")
    rows = (conversations.join(first, "query_id", "left").join(system, "query_id", "left")
            .select("query_id", render.fill_prompt(
                template, system=F.col("system"), conversation=F.col("conversation"),
                item=F.coalesce("item", F.concat(F.lit("track_id: "), F.col("item_id")))).alias("prompt")))
    return C.complete(rows, completer, **options).select(
        "query_id", F.coalesce("reply", F.lit("")).alias("response"))


def recommend(turns: DataFrame, users: DataFrame, catalog: DataFrame, indexes: Indexes,
              kind: str = "bm25", mode: str = "last", query_vectors: DataFrame | None = None,
              user_vectors: DataFrame | None = None, weighted: bool = True, topk: int = 20,
              **options) -> DataFrame:
    """Prediction rows of the sessions with template responses, no model involved.

    ``users`` is (session_id, user_id).
    """
    # written once: the pick over the whole turn table serves texts, taste and prediction rows
    targets = materialize(targets_of(turns, mode).join(users, "session_id").withColumn("query_id", turn_key()), "targets")
    texts = weighted_texts(turns, targets, catalog) if weighted else plain_texts(turns, targets)
    keyed = targets.select("query_id", "session_id", "user_id", "turn_number")
    taste = None
    if user_vectors is not None:
        taste = keyed.select("query_id", "user_id").join(user_vectors, "user_id").select(
            "query_id", "vector")
    ranked = materialize(retrieve(kind, indexes, Queries(texts, query_vectors, taste), topk=topk, **options),
                         "ranked")
    text = render.template_response(ranked, catalog)
    ids = keyed.select("query_id", "session_id", "turn_number")
    rows = prediction_rows(keyed, ranked.join(ids, "query_id"), text.join(ids, "query_id"), topk,
                           missing=render.NO_TRACKS)
    return require_unique(rows)
