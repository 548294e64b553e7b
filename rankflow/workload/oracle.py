"""The registered queries as SQL over the same tables, for comparison with DuckDB.

``VIEWS`` holds named common table expressions in order of definition; a query
takes those it names, directly or through others.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from rankflow.functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _tokens(text: str) -> str:
    words = f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    return f"list_filter({words}, lambda w: w NOT IN ({_STOP}))"


def _postings(source: str) -> str:
    return f"""
    SELECT item_id, term, count(*) AS tf, any_value(len) AS len FROM (
      SELECT item_id, len(words) AS len, unnest(words) AS term
      FROM (SELECT item_id, {_tokens('text')} AS words FROM {source})) GROUP BY item_id, term"""


def _bm25(items: str, postings: str, terms: str) -> str:
    return f"""
    SELECT query_id, item_id, round(sum(w * tf / (1.5 * (1 - 0.75 + 0.75 * len / mean_len) + tf)), 6) AS score
    FROM (SELECT query_id, q.term, qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) AS w, mean_len
          FROM {terms} q JOIN (SELECT term, count(*) AS df FROM {postings} GROUP BY term) USING (term),
               (SELECT (SELECT count(*) FROM {items}) AS n,
                       (SELECT sum(tf) FROM {postings}) / (SELECT count(*) FROM {items}) AS mean_len))
    JOIN {postings} p USING (term) GROUP BY query_id, item_id"""


def _top(source: str, k: int, order: str = "score DESC, item_id") -> str:
    return f"""
    SELECT query_id, item_id, rank::INTEGER AS rank, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM {source})
    WHERE rank <= {k}"""


def _dense(items: str, queries: str) -> str:
    return f"""
    SELECT query_id, item_id, round(list_dot_product(q.vector, i.vector), 6) AS score
    FROM {queries} q, {items} i"""


def _rrf(stacked: str) -> str:
    return f"""
    SELECT query_id, item_id, round(sum(w / (60 + rank)), 10) AS score, min((list_no, rank)) AS seen
    FROM {stacked} GROUP BY query_id, item_id"""


_RRF_ORDER = "score DESC, seen, item_id"

_UNIT = ("CASE WHEN sqrt(list_sum(list_transform({v}, lambda x: x * x))) = 0 THEN {v} "
         "ELSE list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y)))) END")


def _unit(v: str) -> str:
    return _UNIT.format(v=v)


def _assigned(source: str, id_col: str, number: str) -> str:
    return f"""
    SELECT {id_col}, e.vector FROM {source} s
    JOIN unit_embeddings e ON e.vec_id = ({number}) % (SELECT count(*) FROM embeddings)"""


def _scores(p: int, e: int, gap: int, source: str = "shop_targets", number: str = "session_id", key: str = "session_id") -> str:
    def half(f: int) -> str:
        return f"CASE WHEN {number} % {gap} <> 0 THEN 1 + ({number} * {f} % 9) / 2.0::DOUBLE END"

    return f"SELECT {key}, {half(p)} AS personalization, {half(e)} AS explanation FROM {source}"


def _repaired(work: str, key: str) -> dict[str, str]:
    """Views of a repair run over the work rows ``work``; the last is (key, response)."""
    end = work.removeprefix("work")
    judged = (f"SELECT {key}, {_judge_reply('head || response || tail')} FROM live_prompts{end}",
              f"SELECT {key}, {_judge_reply('head || predicted_response || tail')} FROM live_prompts{end}")
    return {
        f"regenerated{end}": f"""
    SELECT *, 'You will know this one — ' || regexp_extract(candidates, '[^\n]*$') ||
              ' is close to what was played before.' AS response FROM {work}""",
        f"live_prompts{end}": f"""
    SELECT {key}, avg, response, 'Conversation:' || chr(10) || conversation || chr(10) || 'Response:' || chr(10) AS head,
           predicted_response, chr(10) || 'Tracks:' || chr(10) || candidates AS tail FROM regenerated{end}""",
        f"live_new{end}": judged[0],
        f"live_old{end}": judged[1],
        f"repaired{end}": f"""
    SELECT {key}, r.response FROM regenerated{end} r
    JOIN live_new{end} n USING ({key}) JOIN live_old{end} o USING ({key})
    WHERE CASE WHEN n.personalization IS NULL THEN false
               WHEN o.personalization IS NULL THEN (n.personalization + n.explanation) / 2 > r.avg
               ELSE n.personalization + n.explanation > o.personalization + o.explanation END"""}


_STRIP_FENCES = (r"trim(regexp_replace(regexp_replace(reply, '(?m)^```(?:json)?\s*', '', 'g'), "
                 r"'(?m)```\s*$', '', 'g'), E' \t\n\r')")


def _array_ids(pattern: str, reply: str = "reply") -> str:
    part = f"regexp_extract({_STRIP_FENCES.replace('reply', reply)}, '{pattern}')"
    return f"CASE WHEN json_valid({part}) THEN from_json({part}, '[\"VARCHAR\"]') END"


def _distinct(ids: str) -> str:
    return f"list_filter({ids}, lambda x, i: list_position({ids}, x) = i)"


_FIELD_VALUES = {
    "track_name": "track_name", "artist_name": "array_to_string(artist_name, '{s}')",
    "album_name": "album_name", "release_date": "release_date", "tag_list": "array_to_string(tag_list, '{s}')",
}
_LEXICAL = ("track_name", "artist_name", "album_name", "tag_list")


def _labelled(sep: str) -> str:
    fields = ", ".join(f"'{f}: ' || " + _FIELD_VALUES[f].format(s=", ") for f in _LEXICAL)
    return f"concat_ws({sep}, {fields})"


def _conversation(source: str, line: str, key: str = "session_id") -> str:
    return f"""
    SELECT {key}, string_agg({line}, chr(10) ORDER BY turn_number, pos) AS body
    FROM {source} GROUP BY {key}"""


_MUSIC_JOIN = "LEFT JOIN shop_catalog c ON r.role = 'music' AND c.track_id = trim(r.content)"
_TRACK = "coalesce(c.track_name, trim(r.content))"
_ARTIST = "coalesce(array_to_string(c.artist_name, ', '), 'Unknown Artist')"


def _named_lines(label: str) -> str:
    return (f"CASE role WHEN 'music' THEN '[{label}: ' || {_TRACK} || ' by ' || {_ARTIST} || ']' "
            "WHEN 'user' THEN 'User: ' || content END")


def _candidates(line: str, where: str = "true") -> str:
    return f"""
    SELECT query_id, string_agg({line}, chr(10) ORDER BY rank) AS candidates
    FROM ranked r LEFT JOIN shop_catalog c ON c.track_id = r.item_id WHERE {where} GROUP BY query_id"""


def _tags(n: int) -> str:
    return f"coalesce(array_to_string(tag_list[1:{n}], ', '), '')"


_NAME = "coalesce(track_name, item_id)"
_CAND_ARTIST = "coalesce(array_to_string(artist_name, ', '), 'Unknown Artist')"


def _bracket(n: int) -> str:
    return f"CASE WHEN {_tags(n)} <> '' THEN ' [' || {_tags(n)} || ']' ELSE '' END"


_YEAR = "coalesce(' (' || substr(release_date, 1, 4) || ')', '')"

_MARKERS = ("you", "your", "since you", "you mentioned", "you asked", "you said", "you love", "you wanted")
_WIDE = (*_MARKERS, "you kept", "you''ve")


def _gate(markers: tuple[str, ...], window: int, connectors: bool, shortest: int) -> str:
    cases = ["WHEN text IS NULL THEN 'missing'"]
    if markers:
        first = "lower(split_part(text, '.', 1))"
        hits = " OR ".join(f"starts_with({first}, '{m}') OR contains(substr({first}, 1, {window}), ' {m}')"
                           for m in markers)
        cases.append(f"WHEN NOT ({hits}) THEN 'not_user_first'")
    if connectors:
        cases.append("WHEN NOT (contains(text, ' — ') OR contains(text, ' - ')) THEN 'no_connector'")
    cases.append("WHEN starts_with(text, '{') OR starts_with(text, '[') THEN 'json'")
    cases.append(f"WHEN length(text) < {shortest} THEN 'too_short'")
    return f"CASE {' '.join(cases)} END"


def _judge_reply(prompt: str) -> str:
    """(p, e, n) of the stand-in judge; null where it gives no answer."""
    n = f"length({prompt})"
    return (f"CASE WHEN {n} % 9 <> 0 AND 1 + {n} % 7 <= 5 THEN 1.0 + {n} % 5 END::DOUBLE AS personalization, "
            f"CASE WHEN {n} % 9 <> 0 AND 1 + {n} % 7 <= 5 THEN 1.0 + {n} % 7 END::DOUBLE AS explanation, "
            f"CASE WHEN {n} % 9 = 0 THEN 'no reply' WHEN 1 + {n} % 7 > 5 THEN 'parse error' "
            f"ELSE 'n=' || {n} END AS reasoning")


def _lexdiv_whole(source: str, key: str) -> str:
    return f"""
    (WITH s AS (SELECT {key}::VARCHAR AS id, list_distinct(regexp_extract_all(lower(predicted_response), '\\S+')) AS w
                FROM {source} WHERE predicted_response <> ''),
          p AS (SELECT a.w AS x, b.w AS y FROM s a JOIN s b ON a.id < b.id)
     SELECT coalesce(avg(CASE WHEN len(list_distinct(x || y)) > 0
                         THEN 1 - len(list_intersect(x, y)) / len(list_distinct(x || y)) END), 0) FROM p)"""


def _lexdiv(source: str, key: str) -> str:
    return f"""
    (WITH t AS (SELECT {key}::VARCHAR AS id, predicted_response AS v FROM {source} WHERE predicted_response <> ''),
          s AS (SELECT id, list_distinct(regexp_extract_all(lower(v), '\\S+')) AS w,
                  ('0x' || substr(md5(id), 1, 8))::BIGINT % greatest((SELECT ceil(count(*) / 64.0)::BIGINT FROM t), 1) AS bucket
                FROM t),
          p AS (SELECT a.w AS x, b.w AS y FROM s a JOIN s b ON a.bucket = b.bucket AND a.id < b.id)
     SELECT coalesce(avg(CASE WHEN len(list_distinct(x || y)) > 0
                         THEN 1 - len(list_intersect(x, y)) / len(list_distinct(x || y)) END), 0) FROM p)"""


def _evaluated(source: str, mode: str, diversity: Callable[[str, str], str] = _lexdiv) -> str:
    return f"""
    SELECT '{mode}' AS mode, round(coalesce(avg(ndcg), 0), 6) AS ndcg20,
           round((SELECT * FROM {diversity(f"(SELECT * FROM {source} WHERE ndcg IS NOT NULL)",
                                         "session_id || '/' || turn_number")}), 6) AS lexdiv,
           count(ndcg) AS n
    FROM {source}"""


def _ndcg(source: str) -> str:
    return f"""
    SELECT p.*, truth, CASE WHEN truth IS NULL THEN NULL
      WHEN list_position(ids[1:20], truth) > 0 THEN 1 / log2(list_position(ids[1:20], truth) + 1) ELSE 0 END AS ndcg
    FROM {source} p LEFT JOIN truth_last USING (session_id, turn_number)"""


VIEWS: dict[str, str] = {
    # conversations and documents
    "turns": "SELECT conv_id AS session_id, turn AS turn_number, 0 AS pos, role, text AS content FROM conversations",
    "targets": """
    SELECT session_id, max(turn_number) AS turn_number, arg_max(content, turn_number) AS query
    FROM turns WHERE role = 'user' GROUP BY session_id""",
    "last_texts": "SELECT session_id AS query_id, query AS text FROM targets",
    "doc_items": "SELECT doc_id AS item_id, text FROM documents",
    "doc_postings": _postings("doc_items"),
    "last_terms": f"""
    SELECT query_id, term, count(*) AS qtf FROM (
      SELECT query_id, unnest({_tokens('text')}) AS term FROM last_texts) GROUP BY query_id, term""",
    "stream_texts": """
    SELECT session_id || '/' || turn_number AS query_id, content AS text FROM turns WHERE role = 'user' UNION ALL
    SELECT u.session_id || '/' || u.turn_number, h.content FROM turns u JOIN turns h USING (session_id)
    WHERE u.role = 'user' AND h.turn_number < u.turn_number""",
    "stream_terms": f"""
    SELECT query_id, term, count(*) AS qtf FROM (
      SELECT query_id, unnest({_tokens('text')}) AS term FROM stream_texts) GROUP BY query_id, term""",
    "stream_scores": _bm25("doc_items", "doc_postings", "stream_terms"),
    "stream_bm25": _top("stream_scores", 20),
    "last_scores": _bm25("doc_items", "doc_postings", "last_terms"),
    "last_bm25": _top("last_scores", 20),
    "kept_items": "SELECT * FROM doc_items WHERE item_id % 10 <> 7",
    "kept_postings": _postings("kept_items"),
    "kept_scores": _bm25("kept_items", "kept_postings", "last_terms"),
    "kept_bm25": _top("kept_scores", 20),
    "last_bm25_wide": _top("last_scores", 100),
    "unit_embeddings": f"SELECT vec_id, {_unit('embedding::DOUBLE[]')} AS vector FROM embeddings",
    "doc_vectors": _assigned("doc_items", "item_id", "item_id"),
    "last_vectors": _assigned("last_texts", "query_id", "query_id"),
    "last_dense_scores": _dense("doc_vectors", "last_vectors"),
    "last_dense": _top("last_dense_scores", 20),
    "last_dense_wide": _top("last_dense_scores", 100),
    "self_queries": "SELECT vec_id AS query_id, vector FROM unit_embeddings",
    "self_items": "SELECT vec_id AS item_id, vector FROM unit_embeddings",
    "facets": """
    SELECT t.session_id || '#' || list_no AS query_id, t.session_id AS parent_id, list_no::BIGINT AS list_no, text
    FROM (SELECT session_id, query, arg_min(content, t.turn_number) AS opening
          FROM targets JOIN turns t USING (session_id) WHERE role = 'user' GROUP BY session_id, query) t,
         LATERAL (SELECT 0 AS list_no, query AS text UNION ALL
                  SELECT 1, opening WHERE session_id % 5 <> 0)""",
    "facet_terms": f"""
    SELECT query_id, term, count(*) AS qtf FROM (
      SELECT query_id, unnest({_tokens('text')}) AS term FROM facets) GROUP BY query_id, term""",
    "facet_vectors": _assigned("facets", "query_id", "parent_id + list_no"),
    "facet_scores": _bm25("doc_items", "doc_postings", "facet_terms"),
    "facet_bm25": _top("facet_scores", 100),
    "facet_dense_scores": _dense("doc_vectors", "facet_vectors"),
    "facet_dense": _top("facet_dense_scores", 100),
    "facet_stacked": """
    SELECT query_id, item_id, rank, 0 AS list_no, 1.0::DOUBLE AS w FROM facet_bm25 UNION ALL
    SELECT query_id, item_id, rank, 1, 1.0 FROM facet_dense""",
    "facet_fused": _rrf("facet_stacked"),
    "facet_hybrid": _top("facet_fused", 100, _RRF_ORDER),
    "parent_stacked": """
    SELECT parent_id AS query_id, item_id, rank, list_no, 1.0::DOUBLE AS w
    FROM facet_hybrid JOIN facets USING (query_id)""",
    "parent_fused": _rrf("parent_stacked"),
    "hybrid_stacked": """
    SELECT query_id, item_id, rank, 0 AS list_no, 1.0::DOUBLE AS w FROM last_bm25_wide UNION ALL
    SELECT query_id, item_id, rank, 1, 1.0 FROM last_dense_wide""",
    "hybrid_fused": _rrf("hybrid_stacked"),
    "rrf_stacked": """
    SELECT query_id, item_id, rank, 0 AS list_no, 1.0::DOUBLE AS w FROM last_bm25 UNION ALL
    SELECT query_id, item_id, rank, 1, 1.0 FROM last_dense""",
    "rrf_fused": _rrf("rrf_stacked"),
    # shop
    "shop_catalog": """
    SELECT p_partkey::VARCHAR AS track_id, p_name AS track_name, [p_brand] AS artist_name, p_type AS album_name,
           strftime(shipped, '%Y-%m-%d') AS release_date,
           list_append(string_split(p_name, ' '), lower(p_type)) AS tag_list
    FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY l_partkey)
    USING (p_partkey)""",
    "shop_orders": """
    SELECT o_custkey AS session_id,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS turn_number,
           coalesce(p_name || ' ' || p_brand, o_orderpriority) AS wish, p_partkey
    FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, min(l_partkey) AS p_partkey
                           FROM lineitem GROUP BY l_orderkey) USING (o_orderkey)
    LEFT JOIN part USING (p_partkey)""",
    "shop_turns": """
    SELECT session_id, turn_number, 0 AS pos, 'user' AS role, wish AS content FROM shop_orders UNION ALL
    SELECT session_id, turn_number, 1, 'music', p_partkey::VARCHAR FROM shop_orders WHERE p_partkey IS NOT NULL""",
    "shop_targets": """
    SELECT session_id, max(turn_number) AS turn_number, arg_max(content, turn_number) AS query
    FROM shop_turns WHERE role = 'user' GROUP BY session_id""",
    "shop_history": """
    SELECT h.*, t.turn_number AS target_turn FROM shop_turns h JOIN shop_targets t
    ON h.session_id = t.session_id AND h.turn_number < t.turn_number""",
    "truth_last": """
    SELECT session_id, turn_number, arg_max(trim(content), pos) AS truth
    FROM shop_turns WHERE role = 'music' GROUP BY session_id, turn_number""",
    "shop_users": """
    SELECT c_custkey AS user_id, c_mktsegment AS age_group,
           CASE WHEN c_custkey % 5 <> 0 THEN 'x' END AS gender, n_name AS country
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "profiles": """
    SELECT user_id, concat_ws(', ', 'age_group: ' || age_group, 'gender: ' || gender, 'country: ' || country) AS profile
    FROM shop_users""",
    "item_vectors": _assigned("(SELECT p_partkey, p_partkey::VARCHAR AS item_id FROM part)",
                              "item_id", "p_partkey"),
    "user_means": """
    SELECT user_id, list(m ORDER BY i) AS v FROM (
      SELECT session_id AS user_id, i, avg(vector[i]) AS m
      FROM shop_turns JOIN item_vectors ON item_id = content, range(1, 65) r(i)
      WHERE role = 'music' GROUP BY session_id, i) GROUP BY user_id""",
    "user_vectors": f"SELECT user_id, {_unit('v')} AS vector FROM user_means",
    "taste": "SELECT user_id AS query_id, vector FROM user_vectors",
    "taste_scores": _dense("item_vectors", "taste"),
    "taste_top": _top("taste_scores", 20),
    "taste_wide": _top("taste_scores", 50),
    # weighted queries
    "query_parts": """
    SELECT session_id, 1 AS section, turn_number, pos, content AS text, 1 AS weight
    FROM shop_history WHERE role = 'user' UNION ALL
    SELECT session_id, 2, max(turn_number), arg_max(pos, turn_number), arg_max(content, turn_number), 1
    FROM shop_history WHERE role = 'user' GROUP BY session_id UNION ALL
    SELECT session_id, 3, turn_number, 0, query, 3 FROM shop_targets UNION ALL
    SELECT session_id, 0, turn_number, pos,
           concat_ws(' ', array_to_string(artist_name, ' '), array_to_string(tag_list[1:5], ' ')), 1
    FROM shop_history JOIN shop_catalog ON track_id = trim(content) WHERE role = 'music'""",
    "weighted_terms": f"""
    SELECT query_id, term, sum(weight)::BIGINT AS qtf FROM (
      SELECT session_id AS query_id, weight, unnest({_tokens('text')}) AS term FROM query_parts)
    GROUP BY query_id, term""",
    "shop_items": f"""
    SELECT track_id AS item_id, concat_ws(' ', track_name, array_to_string(artist_name, ' '), album_name,
           array_to_string(tag_list, ' ')) AS text FROM shop_catalog""",
    "shop_postings": _postings("shop_items"),
    "shop_scores": _bm25("shop_items", "shop_postings", "weighted_terms"),
    "shop_top": _top("shop_scores", 20),
    "shop_wide": _top("shop_scores", 50),
    "chat_texts": """
    SELECT session_id AS query_id, CASE WHEN length(query) % 5 = 0 THEN query ELSE 'steel ' || query END AS text FROM shop_targets""",
    "chat_terms": f"""
    SELECT query_id, term, count(*) AS qtf FROM (
      SELECT query_id, unnest({_tokens('text')}) AS term FROM chat_texts) GROUP BY query_id, term""",
    "chat_scores": _bm25("shop_items", "shop_postings", "chat_terms"),
    "chat_found": _top("chat_scores", 50),
    "chat_blended": """
    SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank
    FROM (SELECT query_id, item_id, rank, round(CASE WHEN u.vector IS NULL THEN 1.0::DOUBLE / rank
            ELSE 0.7 / rank + 0.3 * coalesce(list_dot_product(u.vector, i.vector), 0) END, 6) AS score
          FROM chat_found LEFT JOIN user_vectors u ON u.user_id = query_id LEFT JOIN item_vectors i USING (item_id))""",
    "chat_ranked": """
    SELECT query_id, item_id, rank FROM (
      SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY
        CASE WHEN r <= 12 AND best::BIGINT % 4 <> 0 THEN -r END NULLS LAST, r) AS rank
      FROM (SELECT query_id, item_id, rank AS r, first_value(item_id) OVER (PARTITION BY query_id ORDER BY rank) AS best
            FROM chat_blended)) WHERE rank <= 20""",
    "facet_texts": """
    SELECT session_id AS parent_id, session_id || '#' || k AS query_id, k AS list_no,
           CASE k WHEN 0 THEN query WHEN 1 THEN 'steel ' || query ELSE 'small' END AS text
    FROM shop_targets, range(3) r(k) WHERE k = 0 OR length(query) % 5 <> 0""",
    "facet_words": f"""
    SELECT query_id, term, count(*) AS qtf FROM (
      SELECT query_id, unnest({_tokens('text')}) AS term FROM facet_texts) GROUP BY query_id, term""",
    "facet_found": _bm25("shop_items", "shop_postings", "facet_words"),
    "facet_top": _top("facet_found", 100),
    "chat_facet_stacked": """
    SELECT parent_id AS query_id, item_id, rank, list_no, 1.0::DOUBLE AS w FROM facet_top JOIN facet_texts USING (query_id)""",
    "chat_facet_fused": _rrf("chat_facet_stacked"),
    "weighted_stacked": """
    SELECT query_id, item_id, rank, 0 AS list_no, 0.7::DOUBLE AS w FROM shop_wide UNION ALL
    SELECT query_id, item_id, rank, 1, 0.3 FROM taste_wide""",
    "weighted_fused": _rrf("weighted_stacked"),
    "recommend_stacked": """
    SELECT query_id, item_id, rank, 0 AS list_no, 0.5::DOUBLE AS w FROM shop_wide UNION ALL
    SELECT query_id, item_id, rank, 1, 0.5 FROM taste_wide""",
    "recommend_fused": _rrf("recommend_stacked"),
    "recommended": _top("recommend_fused", 20, _RRF_ORDER),
    # synthetic predictions, replies and scores
    "raw_lists": """
    SELECT session_id AS query_id, r AS rank,
           CASE WHEN session_id % 10 = 0 AND r = 1 + (session_id // 10) % 20 AND truth IS NOT NULL THEN truth
                ELSE ((session_id * 31 + r * 17) % (SELECT count(*) FROM part))::VARCHAR END AS item_id
    FROM shop_targets LEFT JOIN truth_last USING (session_id, turn_number), range(1, 21) t(r)""",
    "ranked": """
    SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
    FROM (SELECT query_id, item_id, min(rank) AS rank FROM raw_lists GROUP BY query_id, item_id)""",
    "packed": "SELECT query_id, list(item_id ORDER BY rank) AS ids FROM ranked GROUP BY query_id",
    "predictions": """
    SELECT session_id, session_id AS user_id, turn_number, ids,
           CASE WHEN session_id % 7 = 0 THEN '' ELSE 'You asked for ' || query || '.' END AS predicted_response
    FROM shop_targets JOIN packed ON query_id = session_id""",
    "per_turn": """
    SELECT * FROM predictions UNION ALL
    SELECT * REPLACE (turn_number - 1 AS turn_number) FROM predictions WHERE turn_number > 1""",
    "last_per_turn": """
    SELECT * FROM per_turn WHERE (session_id, turn_number) IN
      (SELECT (session_id, max(turn_number)) FROM per_turn GROUP BY session_id)""",
    "scored_single": _ndcg("predictions"),
    "scored_all": _ndcg("per_turn"),
    "scored_last": _ndcg("last_per_turn"),
    "clean_replies": """
    SELECT query_id, ids, list_reverse(ids) AS back,
           '["' || array_to_string(list_reverse(ids), '","') || '"]' AS clean FROM packed""",
    "replies": """
    SELECT query_id, ids, CASE query_id % 8
      WHEN 0 THEN clean
      WHEN 1 THEN '```json' || chr(10) || clean || chr(10) || '```'
      WHEN 2 THEN 'Here is the ranking: ' || clean || ' as requested.'
      WHEN 3 THEN '["none-1","' || back[1] || '",' || substr(clean, 2)
      WHEN 4 THEN '["' || back[1] || '",'
      WHEN 6 THEN '[]'
      WHEN 7 THEN '{"ranked_tracks": ' || clean || ', "response": " These fit. "}' END AS reply
    FROM clean_replies""",
    "reply_ids": f"SELECT query_id, ids, {_array_ids('(?s)\\[.*\\]')} AS found FROM replies",
    "reply_valid": "SELECT query_id, list_filter(found, lambda x: list_contains(ids, x)) AS found FROM reply_ids",
    "reply_ranked": f"SELECT query_id, {_distinct('found')} AS ranked FROM reply_valid",
    "scores_a": _scores(7, 5, 13),
    "scores_b": _scores(4, 2, 17),
    "scores_c": _scores(3, 8, 19),
    "guard_rows": """
    SELECT session_id, (b.personalization + b.explanation) / 2 AS new_score,
           (a.personalization + a.explanation) / 2 AS live_score, (c.personalization + c.explanation) / 2 AS stored_score
    FROM scores_a a JOIN scores_b b USING (session_id) JOIN scores_c c USING (session_id)""",
    "guarded": """
    SELECT *, CASE WHEN new_score IS NULL THEN 'keep_failed'
      WHEN live_score IS NULL THEN CASE WHEN new_score > coalesce(stored_score, 3.5) THEN 'patch_stored' ELSE 'keep_failed' END
      WHEN new_score > live_score THEN 'patch' ELSE 'keep' END AS decision FROM guard_rows""",
    "responses": """
    SELECT session_id, CASE session_id % 7
      WHEN 0 THEN 'You asked for ' || query || ' — and this set follows it closely, note by note.'
      WHEN 1 THEN 'These tracks fit ' || query || ' — a tight set in the same colour, picked for you.'
      WHEN 2 THEN '{"response": "you mentioned ' || query || ' - and this is long enough to pass."}'
      WHEN 3 THEN 'You said - yes.'
      WHEN 4 THEN 'Since you love ' || query || ' - these should work well on a quiet evening.'
      WHEN 6 THEN 'Your ' || query || ' pick has company here, all in the same spirit and colour.' END AS text
    FROM shop_targets""",
    "corrected": """
    SELECT s.*, CASE WHEN m <> 0 THEN (personalization + explanation) / 2 END AS proxy_avg,
           CASE WHEN m <> 0 THEN 4.4 / m ELSE 1.0 END AS bias_factor
    FROM scores_a s, (SELECT (avg(personalization) + avg(explanation)) / 2 AS m FROM scores_a)""",
    "drops": """
    SELECT session_id, (a.personalization + a.explanation) / 2 AS primary_avg,
           (b.personalization + b.explanation) / 2 AS other_avg
    FROM scores_a a JOIN scores_b b USING (session_id)
    WHERE a.personalization IS NOT NULL AND b.personalization IS NOT NULL""",
    "talk": _conversation("shop_turns", "CASE role WHEN 'user' THEN 'User: \"' || content || '\"' "
                                        "WHEN 'music' THEN '[Track played: ' || content || ']' END"),
    "talk_judge": _conversation("shop_turns", "CASE role WHEN 'user' THEN 'User: ' || content "
                                              "WHEN 'music' THEN '[Track played: ' || content || ']' END"),
    "work_candidates": _candidates(
        f"r.rank || '. \"' || {_NAME} || '\" by ' || {_CAND_ARTIST} || {_bracket(5)}", "rank <= 3"),
    "bullets": _candidates(
        f"'- ' || {_NAME} || ' by ' || coalesce(array_to_string(artist_name, ', '), 'Unknown') || ' | ' || {_tags(4)}",
        "rank <= 5"),
    "work": """
    SELECT session_id, avg, predicted_response, body AS conversation, candidates
    FROM (SELECT session_id, coalesce((personalization + explanation) / 2, 0) AS avg FROM scores_a)
    JOIN predictions USING (session_id) JOIN talk USING (session_id)
    LEFT JOIN work_candidates ON query_id = session_id WHERE avg > 3 AND avg <= 3.99""",
    **_repaired("work", "session_id"),
    "turn_scores": _scores(7, 5, 13, "per_turn", "(session_id + turn_number)", "session_id, turn_number"),
    "talk_upto": """
    SELECT p.session_id, p.turn_number,
           string_agg(CASE role WHEN 'user' THEN 'User: "' || content || '"' WHEN 'music' THEN '[Track played: ' || content || ']' END,
                      chr(10) ORDER BY h.turn_number, pos) AS body,
           string_agg(CASE role WHEN 'user' THEN 'User: ' || content WHEN 'music' THEN '[Track played: ' || content || ']' END,
                      chr(10) ORDER BY h.turn_number, pos) AS judged
    FROM per_turn p JOIN shop_turns h ON h.session_id = p.session_id AND h.turn_number <= p.turn_number
    GROUP BY p.session_id, p.turn_number""",
    "work_turns": """
    SELECT session_id, turn_number, avg, predicted_response, body AS conversation, candidates
    FROM (SELECT session_id, turn_number, coalesce((personalization + explanation) / 2, 0) AS avg FROM turn_scores)
    JOIN per_turn USING (session_id, turn_number) JOIN talk_upto USING (session_id, turn_number)
    LEFT JOIN work_candidates ON query_id = session_id WHERE avg > 3 AND avg <= 3.99""",
    **_repaired("work_turns", "session_id, turn_number"),
}


def _template(ranked: str) -> str:
    return f"""
    SELECT query_id, CASE WHEN picks IS NULL THEN 'Here are some tracks I think you''ll enjoy based on our conversation!'
      ELSE 'Here are my top picks for you: ' ||
        CASE WHEN len(picks) > 1 THEN array_to_string(picks[1:len(picks) - 1], ', ') || ', and ' || picks[len(picks)]
             ELSE picks[1] END
        || ' — plus ' || (n_items - len(picks)) || ' more tracks I think you''ll love. '
        || 'Let me know if you''d like something more specific!' END AS response
    FROM (SELECT query_id, count(*) AS n_items FROM {ranked} GROUP BY query_id)
    LEFT JOIN (SELECT query_id, list(pick ORDER BY rank) AS picks FROM (
      SELECT query_id, min(rank) AS rank,
             arg_min('"' || track_name || '" by ' || array_to_string(artist_name, ' '), rank) AS pick
      FROM {ranked} JOIN shop_catalog ON track_id = item_id WHERE rank <= 5
      GROUP BY query_id, lower(array_to_string(artist_name, ' '))) GROUP BY query_id) USING (query_id)"""


VIEWS["recommend_text"] = _template("recommended")
VIEWS["chat_facet_ranked"] = _top("chat_facet_fused", 20, _RRF_ORDER)
VIEWS["chat_facet_text"] = _template("chat_facet_ranked")


def _packed_rows(ranked: str, response: str, text: str) -> str:
    return f"""
    SELECT t.session_id, t.session_id AS user_id, turn_number, coalesce(ids, '') AS ids, {response} AS predicted_response
    FROM shop_targets t
    LEFT JOIN (SELECT query_id, array_to_string(list(item_id ORDER BY rank), ',') AS ids FROM {ranked} GROUP BY query_id) i
    ON i.query_id = t.session_id LEFT JOIN ({text}) x ON x.query_id = t.session_id"""

_WORD = re.compile(r"[A-Za-z_]\w*")


def _with_views(final: str) -> str:
    """The query with the views it needs in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(_WORD.findall(text)) & VIEWS.keys() - needed:
            needed.add(name)
            visit(VIEWS[name])

    visit(final)
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in VIEWS.items() if name in needed)
    return f"WITH {ctes}\nSELECT * FROM ({final})" if ctes else final


_LIST = "SELECT query_id, item_id, rank, score FROM "

_DISPLAY = """concat_ws(', ', 'track_id: ' || track_id, 'track_name: ' || lower(track_name),
    'artist_name: ' || lower(array_to_string(artist_name[1:5], ', ')), 'album_name: ' || lower(album_name),
    'release_date: ' || substr(release_date, 1, 4), 'tag_list: ' || lower(array_to_string(tag_list[1:5], ', ')))"""

_CHAT = _packed_rows("chat_ranked", "'You will know this one — ' || coalesce(display, '') || ' is close to what was played before.'",
                     f"SELECT query_id, {_DISPLAY} AS display FROM chat_ranked JOIN shop_catalog ON track_id = item_id WHERE rank = 1")

_PAST = """(SELECT h.*, t.turn_number AS target_turn, t.query FROM turns h JOIN targets t
    ON h.session_id = t.session_id AND h.turn_number < t.turn_number)"""


def _with_query(line: str, last: str, source: str, targets: str) -> str:
    return f"""
    SELECT t.session_id, concat_ws(chr(10), nullif(body, ''), '{last}' || t.query) AS conversation
    FROM {targets} t LEFT JOIN ({_conversation(source, line)}) b ON b.session_id = t.session_id"""


_FINAL: dict[str, str] = {
    "last_user_turn": "SELECT session_id, turn_number, query FROM targets",
    "all_user_turns": "SELECT session_id, turn_number, content AS query FROM turns WHERE role = 'user'",
    "turn_grid": """
    SELECT session_id, turn_number, arg_min(content, pos) AS query FROM shop_turns
    WHERE turn_number BETWEEN 1 AND 8 GROUP BY session_id, turn_number""",
    "turn_grid_last_only": """
    SELECT session_id, turn_number, arg_min(content, pos) AS query FROM shop_turns
    WHERE turn_number = 8 GROUP BY session_id, turn_number""",
    "history_theta": f"""
    SELECT session_id, target_turn, count(*) AS n_rows, string_agg(content, chr(10) ORDER BY turn_number, pos) AS history_text
    FROM {_PAST} GROUP BY session_id, target_turn""",
    "history_window": """
    SELECT u.session_id, u.turn_number, count(h.session_id) AS n_rows,
           coalesce(string_agg(h.content, '|' ORDER BY h.turn_number, h.pos), '') AS history_text
    FROM shop_turns u LEFT JOIN shop_turns h ON h.session_id = u.session_id AND h.turn_number < u.turn_number
    WHERE u.role = 'user' GROUP BY u.session_id, u.turn_number""",
    "role_remap": f"""
    SELECT session_id, turn_number, pos, CASE role WHEN 'music' THEN 'assistant' ELSE role END AS role,
           CASE role WHEN 'music' THEN coalesce({_DISPLAY}, 'track_id: ' || content) ELSE content END AS content
    FROM shop_turns r {_MUSIC_JOIN}""",
    "role_remap_system": """
    SELECT session_id, turn_number, pos, CASE role WHEN 'system' THEN 'assistant' ELSE role END AS role, content FROM turns""",
    "session_memory": f"""
    SELECT session_id, target_turn, turn_number, pos, CASE role WHEN 'music' THEN 'assistant' ELSE role END AS role,
           CASE role WHEN 'music' THEN '[Played: ' || {_TRACK} || coalesce(' by ' || array_to_string(c.artist_name, ', '), '') || ']'
                     ELSE content END AS content
    FROM shop_history r {_MUSIC_JOIN} UNION ALL
    SELECT session_id, turn_number, turn_number, 0, 'user', query FROM shop_targets""",
    "memory_packed": f"""
    SELECT session_id, string_agg(line, '|' ORDER BY turn_number, pos) AS memory FROM (
      SELECT session_id, turn_number, pos, CASE role WHEN 'music' THEN 'assistant=[Played: ' || {_TRACK}
             || coalesce(' by ' || array_to_string(c.artist_name, ', '), '') || ']' ELSE role || '=' || content END AS line
      FROM shop_history r {_MUSIC_JOIN} UNION ALL
      SELECT session_id, turn_number, 0, 'user=' || query FROM shop_targets) GROUP BY session_id""",
    "profile_text": "SELECT user_id, profile FROM profiles",
    "ground_truth_first": """
    SELECT session_id, turn_number, arg_min(content, pos) AS truth FROM shop_turns WHERE role = 'music'
    GROUP BY session_id, turn_number""",
    "ground_truth_last": "SELECT session_id, turn_number, truth FROM truth_last",
    "catalog_dedupe": """
    SELECT track_id, CASE WHEN track_id::BIGINT % 3 = 0 THEN track_name || ' (new)' ELSE track_name END AS track_name
    FROM shop_catalog""",
    "catalog_splits": """
    SELECT track_id, CASE WHEN track_id::BIGINT % 3 = 0 THEN track_name || ' (new)' ELSE track_name END AS track_name,
           array_to_string(artist_name, '+') AS artists, array_to_string(tag_list, '+') AS tags, release_date, 1 AS in_base
    FROM shop_catalog""",
    "catalog_text_lexical": "SELECT item_id AS track_id, text FROM shop_items",
    "catalog_text_dense": f"SELECT track_id, 'passage: ' || {_labelled(chr(39) + '; ' + chr(39))} AS text FROM shop_catalog",
    "catalog_text_fields": f"SELECT track_id, {_labelled('chr(10)')} AS text FROM shop_catalog",
    "catalog_text_display": f"SELECT track_id, {_DISPLAY} AS text FROM shop_catalog",
    "plain_query": f"""
    SELECT t.session_id, coalesce(body, '') || chr(10) || 'User: ' || t.query AS query_text FROM targets t
    LEFT JOIN ({_conversation(_PAST, "role || ': ' || content")}) USING (session_id)""",
    "weighted_query_text": """
    SELECT session_id, string_agg(CASE weight WHEN 3 THEN text || ' ' || text || ' ' || text ELSE text END, ' '
      ORDER BY CASE section WHEN 2 THEN 1 ELSE section END, turn_number, pos, section) AS query_text
    FROM query_parts GROUP BY session_id""",
    "weighted_query_terms": "SELECT query_id, term, qtf FROM weighted_terms",
    "tokenize": f"""
    SELECT term, count(*) AS n, count(DISTINCT item_id) AS n_items FROM (
      SELECT item_id, unnest({_tokens('text')}) AS term FROM doc_items) GROUP BY term""",
    "postings": "SELECT item_id, term, tf, len FROM doc_postings",
    "bm25_topk": _LIST + "last_bm25",
    "bm25_rank_score": "SELECT query_id, item_id, rank, round(1.0::DOUBLE / rank, 6) AS score FROM last_bm25",
    "bm25_weighted_topk": _LIST + "shop_top",
    "normalize_vectors": f"""
    SELECT vec_id, (i - 1)::INTEGER AS i, round(v[i], 6) AS x FROM (
      SELECT vec_id, {_unit('raw')} AS v FROM (
        SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (1 + vec_id % 3)) AS raw FROM embeddings
        UNION ALL SELECT max(vec_id) + 1, list_transform(range(64), lambda x: 0.0::DOUBLE) FROM embeddings)),
      range(1, 65) r(i)""",
    "dense_topk": f"{_top('(' + _dense('self_items', 'self_queries') + ')', 20)}",
    "precomputed_topk": f"{_top('(' + _dense('item_vectors', 'self_queries') + ')', 20)}",
    "cf_user_topk": _LIST + "taste_top",
    "hybrid_topk": f"SELECT query_id, item_id, rank, round(score, 6) AS score FROM ({_top('hybrid_fused', 20, _RRF_ORDER)})",
    "multi_query_topk": f"SELECT query_id, item_id, rank, round(score, 6) AS score FROM ({_top('parent_fused', 50, _RRF_ORDER)})",
    "rrf": f"SELECT query_id, item_id, rank, round(score, 6) AS score FROM ({_top('rrf_fused', 40, _RRF_ORDER)})",
    "rrf_weighted": f"SELECT query_id, item_id, rank, round(score, 6) AS score FROM ({_top('weighted_fused', 20, _RRF_ORDER)})",
    "profile_rerank": """
    SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank)::INTEGER AS rank, score
    FROM (SELECT query_id, item_id, rank, round(CASE WHEN u.vector IS NULL THEN 1.0::DOUBLE / rank
            ELSE 0.7 / rank + 0.3 * coalesce(list_dot_product(u.vector, i.vector), 0) END, 6) AS score
          FROM ranked LEFT JOIN user_vectors u ON u.user_id = query_id LEFT JOIN item_vectors i USING (item_id))""",
    "listwise_merge": """
    SELECT query_id, item_id, rank::INTEGER AS rank FROM (
      SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY
        nullif(list_position(ranked[1:12], item_id), 0) NULLS LAST, rank) AS rank
      FROM ranked JOIN reply_ranked USING (query_id)) WHERE rank <= 20""",
    "rerank_chain": """
    WITH blended AS (
      SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS rank
      FROM (SELECT query_id, item_id, rank, round(CASE WHEN u.vector IS NULL THEN 1.0::DOUBLE / rank
              ELSE 0.7 / rank + 0.3 * coalesce(list_dot_product(u.vector, i.vector), 0) END, 6) AS score
            FROM ranked LEFT JOIN user_vectors u ON u.user_id = query_id LEFT JOIN item_vectors i USING (item_id))),
    placed AS (
      SELECT query_id, item_id, rank, CASE WHEN rank <= 10 THEN
        nullif(list_position(found, item_id), 0) END AS told FROM blended JOIN reply_ids USING (query_id))
    SELECT query_id, item_id, rank::INTEGER AS rank FROM (
      SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY told NULLS LAST, rank) AS rank
      FROM placed) WHERE rank <= 15""",
    "parse_id_array": """
    SELECT query_id, CASE WHEN len(ranked) > 0 THEN array_to_string(ranked[1:10], ',') END AS ranked FROM reply_ranked""",
    "parse_id_array_lazy": f"""
    SELECT query_id, CASE WHEN len(kept) > 0 THEN array_to_string({_distinct('kept')}, ',') END AS ranked FROM (
      SELECT query_id, list_filter(found, lambda x: list_contains(ids, x)) AS kept FROM (
        SELECT query_id, ids, {_array_ids('(?s)\\[.*?\\]', "(reply || '' see also [1]'')".replace("''", "'"))} AS found FROM replies))""",
    "parse_rank_object": """
    SELECT query_id, CASE WHEN query_id % 8 = 7 THEN array_to_string(list_reverse(ids), ',') END AS ranked,
           CASE WHEN query_id % 8 = 7 THEN 'These fit.' END AS response FROM packed""",
    "strip_fences": f"SELECT query_id, {_STRIP_FENCES} AS text FROM replies",
    "entity_query": """
    SELECT t.session_id, CASE WHEN t.session_id % 4 < 2 AND track_id IS NOT NULL THEN
        array_to_string(artist_name, ', ') || ' ' || array_to_string(tag_list, ', ') || ' '
        || substr(release_date, 1, 4) || ' ' || query ELSE query END AS query_text
    FROM shop_targets t LEFT JOIN truth_last USING (session_id, turn_number) LEFT JOIN shop_catalog ON track_id = truth""",
    "facet_queries": "SELECT query_id, parent_id, list_no, text FROM facets",
    "parse_scores": """
    SELECT session_id, CASE WHEN ok THEN p END::DOUBLE AS personalization, CASE WHEN ok THEN e END::DOUBLE AS explanation,
           CASE WHEN ok THEN 'case ' || p END AS reasoning
    FROM (SELECT session_id, session_id % 7 AS p, session_id % 6 AS e,
                 session_id % 11 <> 0 AND p BETWEEN 1 AND 5 AND e BETWEEN 1 AND 5 AS ok FROM shop_targets)""",
    "render_turns_roles": _with_query(
        "upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || content", "User: ", _PAST, "targets"),
    "render_turns_played": _with_query(
        _named_lines("Track played"), "User (latest): ", f"shop_history r {_MUSIC_JOIN}", "shop_targets"),
    "render_turns_previously": _with_query(
        _named_lines("Previously played"), "User: ", f"shop_history r {_MUSIC_JOIN}", "shop_targets"),
    "render_turns_quoted": "SELECT session_id, coalesce(body, '(no prior conversation)') AS conversation FROM talk",
    "render_turns_judge": f"""
    SELECT session_id, coalesce(body, '(no history)') AS conversation FROM ({_conversation('turns',
        "CASE role WHEN 'user' THEN 'User: ' || content WHEN 'assistant' THEN 'Assistant: ' || substr(content, 1, 100) || '...' END")})""",
    "render_candidates_tagged": _candidates(
        f"r.rank || '. [' || item_id || '] ' || {_NAME} || ' — ' || {_CAND_ARTIST} || ' | tags: ' || {_tags(6)}"),
    "render_candidates_dated": _candidates(
        f"r.rank || '. [' || item_id || '] ' || {_NAME} || {_YEAR} || ' — ' || {_CAND_ARTIST} || ' | ' || {_tags(6)}"),
    "render_candidates_quoted": _candidates(
        f"r.rank || '. \"' || {_NAME} || '\" by ' || {_CAND_ARTIST} || {_bracket(6)}", "rank <= 5"),
    "render_candidates_bullet": "SELECT query_id, candidates FROM bullets",
    "render_candidates_fields": _candidates("""
      r.rank || '. [track_id: ' || item_id || '] ' || concat_ws(' | ', 'track_name: ' || track_name,
      'artist_name: ' || array_to_string(artist_name, ', '), 'album_name: ' || album_name,
      'release_year: ' || substr(release_date, 1, 4), 'tag_list: ' || array_to_string(tag_list, ', '))"""),
    "template_response": _template("ranked"),
    "system_prompts": """
    SELECT user_id, 'You recommend.' || chr(10) || 'Be brief.' || coalesce(chr(10) || 'The listener:' || chr(10) || nullif(profile, ''), '') AS system
    FROM profiles""",
    "response_gates": f"""
    SELECT session_id, {_gate((), 0, False, 50)} AS plain, {_gate(_MARKERS, 40, False, 50)} AS user_first,
           {_gate(_WIDE, 50, True, 60)} AS explained FROM responses""",
    "ndcg_set": """
    SELECT query_id, round(coalesce(sum(CASE WHEN rank <= 20 AND (query_id, item_id) IN
      (SELECT (session_id, content) FROM shop_turns WHERE role = 'music') THEN 1 / log2(rank + 1) END), 0), 6) AS ndcg
    FROM ranked GROUP BY query_id""",
    "ndcg_set_ideal": """
    SELECT query_id, round(dcg / list_sum(list_transform(range(1, least(coalesce(n, 1), 20) + 1), lambda r: 1 / log2(r + 1))), 6) AS ndcg
    FROM (SELECT query_id, coalesce(sum(CASE WHEN rank <= 20 AND (query_id, item_id) IN
            (SELECT (session_id, content) FROM shop_turns WHERE role = 'music') THEN 1 / log2(rank + 1) END), 0) AS dcg
          FROM ranked GROUP BY query_id)
    LEFT JOIN (SELECT session_id AS query_id, count(DISTINCT content) AS n FROM shop_turns WHERE role = 'music'
               GROUP BY session_id) USING (query_id)""",
    "ndcg_single": "SELECT session_id, turn_number, round(ndcg, 6) AS ndcg FROM scored_single",
    "ndcg_mean": """
    SELECT round(coalesce(avg(ndcg), 0), 6) AS ndcg20, count(ndcg) AS n, count(*) - count(ndcg) AS skipped FROM scored_single""",
    "last_turn_filter": "SELECT session_id, turn_number, predicted_response FROM last_per_turn",
    "lexical_diversity": f"SELECT round((SELECT * FROM {_lexdiv('predictions', 'session_id')}), 6) AS lexdiv",
    "evaluate_last_turn": _evaluated("scored_last", "last-turn-only"),
    "evaluate_all_turns": _evaluated("scored_all", "all-turns", _lexdiv_whole),
    "judge_means": """
    SELECT round(avg(personalization), 6) AS mean_p, round(avg(explanation), 6) AS mean_e,
           round((avg(personalization) + avg(explanation)) / 2, 6) AS mean_combined,
           count(personalization) AS n_scored, count(*) - count(personalization) AS n_failed FROM scores_a""",
    "bias_corrected": """
    SELECT session_id, round(proxy_avg, 6) AS proxy_avg, round(CASE WHEN proxy_avg IS NOT NULL THEN
      least(5.0, proxy_avg * bias_factor) END, 6) AS corrected_avg, round(bias_factor, 6) AS bias_factor FROM corrected""",
    "worst_best": """
    WITH c AS (SELECT session_id, round(least(5.0, proxy_avg * bias_factor), 6) AS corrected_avg FROM corrected
               WHERE personalization IS NOT NULL)
    (SELECT session_id, corrected_avg, 'worst' AS side FROM c ORDER BY corrected_avg, session_id LIMIT 20) UNION ALL
    (SELECT session_id, corrected_avg, 'best' AS side FROM c ORDER BY corrected_avg DESC, session_id DESC LIMIT 20)""",
    "score_compare": """
    SELECT round((SELECT (avg(personalization) + avg(explanation)) / 2 FROM scores_a)
               - (SELECT (avg(personalization) + avg(explanation)) / 2 FROM scores_b), 6) AS delta,
           count(*) FILTER (primary_avg < other_avg) AS n_worse FROM drops""",
    "largest_drops": """
    SELECT session_id, primary_avg, other_avg, other_avg - primary_avg AS "drop" FROM drops
    WHERE other_avg > primary_avg ORDER BY other_avg - primary_avg DESC, session_id LIMIT 10""",
    "targets_mean": """
    SELECT session_id, avg FROM (SELECT session_id, coalesce((personalization + explanation) / 2, 0) AS avg FROM scores_a)
    WHERE avg <= 3""",
    "targets_band": """
    SELECT session_id, avg FROM (SELECT session_id, coalesce((personalization + explanation) / 2, 0) AS avg FROM scores_a)
    WHERE avg > 3 AND avg <= 3.99""",
    "targets_floor": """
    SELECT session_id, (personalization + explanation) / 2 AS avg, explanation FROM scores_a WHERE explanation <= 2""",
    "work_rows": "SELECT session_id, avg, predicted_response, conversation, candidates FROM work",
    "unmatched_targets": """
    SELECT session_id, avg FROM (SELECT session_id, coalesce((personalization + explanation) / 2, 0) AS avg FROM scores_a)
    WHERE avg <= 3 AND session_id NOT IN (SELECT session_id FROM predictions WHERE predicted_response <> '')""",
    "guard_live": "SELECT session_id, new_score, live_score, stored_score, decision FROM guarded",
    "guard_strict": """
    SELECT *, CASE WHEN new_score IS NULL OR live_score IS NULL THEN 'keep_failed'
      WHEN new_score > live_score THEN 'patch' ELSE 'keep' END AS decision FROM guard_rows""",
    "patch": """
    SELECT session_id, turn_number, array_to_string(ids, ',') AS ids,
           CASE WHEN decision IN ('patch', 'patch_stored') THEN 'Patched at ' || new_score ELSE predicted_response END AS predicted_response
    FROM predictions JOIN guarded USING (session_id)""",
    "merge_responses": """
    SELECT session_id, CASE WHEN session_id % 3 <> 0 THEN predicted_response ELSE '' END AS predicted_response FROM predictions""",
    "validate_lists": """
    SELECT session_id, len(ids) <> len(list_distinct(ids)) AS has_duplicates, len(ids) < 20 AS is_short FROM (
      SELECT session_id, CASE session_id % 50 WHEN 0 THEN ids[1:1] || ids[1:1] || ids[3:20]
             WHEN 1 THEN ids[1:15] ELSE ids END AS ids FROM predictions)""",
    "repair_counts": """
    SELECT (SELECT count(*) FROM responses) AS n_tasks, (SELECT count(text) FROM responses) AS n_responses,
           count(*) FILTER (starts_with(decision, 'patch')) AS n_patched FROM guarded""",
    "batch_complete": """
    SELECT session_id, turn_number, CASE WHEN n % 9 = 0 THEN 'none' ELSE 'Scores: {"personalization": ' || (1 + n % 5)
      || ', "explanation": ' || (1 + n % 7) || ', "reasoning": "n=' || n || '"}' END AS reply, n % 9 = 0 AS is_fallback
    FROM (SELECT session_id, turn_number, length(role || ': ' || content) AS n FROM turns)""",
    "batch_encode": """
    SELECT item_id, round(a / l, 6) AS v0, round(e / l, 6) AS v1, round(o / l, 6) AS v2, round(1 / l, 6) AS v3 FROM (
      SELECT *, sqrt(a * a + e * e + o * o + 1) AS l FROM (
        SELECT item_id, (length(text) - length(replace(text, 'a', '')))::DOUBLE AS a,
               (length(text) - length(replace(text, 'e', '')))::DOUBLE AS e,
               (length(text) - length(replace(text, 'o', '')))::DOUBLE AS o FROM doc_items))""",
    "score_predictions": f"""
    SELECT session_id, {_judge_reply('prompt')} FROM (
      SELECT session_id, 'Conversation:' || chr(10) || body || chr(10) || 'Response:' || chr(10) || predicted_response
             || chr(10) || 'Tracks:' || chr(10) || candidates AS prompt
      FROM predictions JOIN talk_judge USING (session_id) JOIN bullets ON query_id = session_id)""",
    "repair_run": """
    SELECT session_id, coalesce(response, predicted_response) AS predicted_response
    FROM predictions LEFT JOIN repaired USING (session_id)""",
    "segmented_topk": _LIST + "kept_bm25",
    "compacted_topk": _LIST + "kept_bm25",
    "work_rows_turns": "SELECT * FROM work_turns",
    "repair_run_turns": """
    SELECT session_id, turn_number, coalesce(response, predicted_response) AS predicted_response
    FROM per_turn LEFT JOIN repaired_turns USING (session_id, turn_number)""",
    "repair_run_counts": """
    SELECT count(*) AS n_tasks, count(r.response) AS n_responses, count(*) - count(r.response) AS n_failed,
      count(*) FILTER (d IN ('patch', 'patch_stored')) AS n_patched, count(*) FILTER (d = 'patch_stored') AS n_fallbacks,
      count(*) FILTER (d = 'keep') AS n_kept, count(*) FILTER (d = 'keep_failed') AS n_skipped
    FROM regenerated_turns r JOIN (
      SELECT session_id, turn_number, CASE WHEN n.personalization IS NULL THEN 'keep_failed'
          WHEN o.personalization IS NULL THEN CASE WHEN (n.personalization + n.explanation) / 2 > avg THEN 'patch_stored' ELSE 'keep_failed' END
          WHEN n.personalization + n.explanation > o.personalization + o.explanation THEN 'patch' ELSE 'keep' END AS d
      FROM live_prompts_turns JOIN live_new_turns n USING (session_id, turn_number) JOIN live_old_turns o USING (session_id, turn_number))
    USING (session_id, turn_number)""",
    "score_predictions_turns": f"""
    SELECT session_id, turn_number, {_judge_reply('prompt')} FROM (
      SELECT session_id, turn_number, 'Conversation:' || chr(10) || judged || chr(10) || 'Response:' || chr(10) || predicted_response
             || '@' || turn_number || chr(10) || 'Tracks:' || chr(10) || candidates AS prompt
      FROM per_turn JOIN talk_upto USING (session_id, turn_number) JOIN bullets ON query_id = session_id)""",
    "response_stage": f"""
    SELECT query_id, 'You will know this one — ' || {_DISPLAY} || ' is close to what was played before.' AS response
    FROM ranked JOIN shop_catalog ON track_id = item_id WHERE rank = 1""",
    "recommend": """
    SELECT session_id, session_id AS user_id, turn_number, array_to_string(list(item_id ORDER BY rank), ',') AS ids,
           response AS predicted_response
    FROM shop_targets JOIN recommended ON query_id = session_id JOIN recommend_text USING (query_id)
    GROUP BY session_id, turn_number, response""",
    "chat_turns": _CHAT,
    "stream_chat": _CHAT,
    "chat_facets": _packed_rows("chat_facet_ranked", "coalesce(response, 'Here are some tracks I think you''ll enjoy based on our conversation!')",
                                "SELECT * FROM chat_facet_text"),
    "stream_retrieve": _LIST + "stream_bm25",
    "prediction_roundtrip": """
    SELECT session_id::VARCHAR AS session_id, user_id::VARCHAR AS user_id, turn_number,
           array_to_string(ids, ',') AS ids, predicted_response FROM predictions""",
    "index_roundtrip": """
    SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf
    FROM doc_postings GROUP BY term""",
    "judge_roundtrip": """
    SELECT session_id::VARCHAR AS session_id, personalization, explanation, 'ok' AS reasoning, 4.4::DOUBLE AS known_gemini,
           (SELECT round(avg((personalization + explanation) / 2), 6) FROM scores_a) AS proxy_avg FROM scores_a""",
    "users_settled": """
    SELECT c_custkey::VARCHAR AS user_id, c_mktsegment AS age_group, CASE WHEN c_custkey % 5 <> 0 THEN 'x' ELSE 'y' END AS gender,
           n_name AS country FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
    "first_sessions": """
    SELECT session_id::VARCHAR AS session_id, turn_number, query FROM shop_targets ORDER BY session_id::VARCHAR LIMIT 50""",
    "encoder_query": "SELECT query_id, 'query: ' || text AS text FROM last_texts",
    "short_ids": "SELECT session_id, substr(md5(session_id::VARCHAR), 1, 8) AS short FROM shop_targets",
    "tasks_without_result": "SELECT session_id FROM scores_a WHERE personalization IS NULL",
    "empty_replies": "SELECT session_id, turn_number, '' AS reply FROM turns",
    "metrics_roundtrip": _evaluated("scored_last", "last-turn-only", _lexdiv_whole),
    "nested_sessions": "SELECT session_id::VARCHAR AS session_id, turn_number, query FROM shop_targets",
}

ORACLE: dict[str, str] = {name: _with_views(sql) for name, sql in _FINAL.items()}
