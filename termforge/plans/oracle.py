"""DuckDB SQL for the registered queries, written from the definitions alone."""

from __future__ import annotations

from .oracle_stems import stems

# The stop lists, stated apart from the library's.
ENGLISH_STOPS = "a an the and or not is are was were be been have has had do does did will would could should may to of in for on with at by from as it its this that i you he she we they me him her us them my your his our their"
RUSSIAN_STOPS = "и в во не что он на я с как а то она так его но да ты к у же вы за бы по только ее от это о из ему когда или ни быть был до вас уже там где для мы их чем была без раз тоже под будет кто этот при об про всё нас"


def tokens(stops: str = ENGLISH_STOPS, source: str = "documents", stemmed: bool = False) -> str:
    """CTEs for tokens (tk), postings, df and N; a term is stemmed after stop words went."""
    left = ", ".join(f"'{w}'" for w in stops.split())
    lowered = f"low AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, lower(t) AS t FROM raw WHERE strlen(lower(t)) >= 2 AND lower(t) NOT IN ({left}))"
    kept = f"{stems('low')}, tk AS (SELECT DISTINCT doc_id, pos, stem AS term FROM low JOIN stems USING (t))" if stemmed else "tk AS (SELECT DISTINCT doc_id, pos, t AS term FROM low)"
    return rf"""raw AS (SELECT doc_id, unnest(toks) AS t, generate_subscripts(toks, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{Nd}}\-]+') AS toks FROM {source})),
{lowered}, {kept},
post AS (SELECT term, doc_id, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM tk GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
n AS (SELECT count(DISTINCT doc_id) AS n FROM documents)"""


TOKENS = tokens()
STEMMED = tokens(stemmed=True)
TWICE = tokens(source="(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, substr(text, 11) FROM documents)")


def with_tokens(select: str, more: str = "", base: str = TOKENS) -> str:
    return f"WITH {base}{', ' + more if more else ''} {select}"


def having(term: str) -> str:
    return f"SELECT DISTINCT doc_id FROM tk WHERE term = '{term}'"


def starting(term: str) -> str:
    return f"SELECT DISTINCT doc_id FROM tk WHERE starts_with(term, '{term}')"


ALL = "SELECT DISTINCT doc_id FROM documents"
NESTED = f"(({having('thing')}) INTERSECT ({having('thtion')})) UNION (({having('attion')}) INTERSECT (({ALL}) EXCEPT ({having('erble')})))"


def phrase(*steps: tuple[str, int], prefix: bool = False) -> str:
    """A self-join on positions; steps are (term, offset)."""
    test = (lambda a, t: f"starts_with({a}.term, '{t}')") if prefix else (lambda a, t: f"{a}.term = '{t}'")
    joins = " ".join(f"JOIN tk t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {d} AND {test(f't{i}', t)}" for i, (t, d) in enumerate(steps) if i)
    return f"SELECT DISTINCT t0.doc_id FROM tk t0 {joins} WHERE {test('t0', steps[0][0])}"


def cells(times: dict[str, int]) -> str:
    values = ", ".join(f"('{t}', {k})" for t, k in times.items())
    return f"""q(term, times) AS (VALUES {values}),
cell AS (SELECT doc_id, times, ln(n / df) AS idf, (1 + ln(tf)) * ln(n / df) AS w FROM post JOIN q USING (term) JOIN dfs USING (term), n)"""


def tfidf(docs: str, times: dict[str, int], k: int = 0, base: str = TOKENS) -> str:
    more = f"""{cells(times)}, s AS (SELECT doc_id, sum(times * w) AS x FROM cell GROUP BY doc_id HAVING sum(times * w) > 0)"""
    return with_tokens(f"SELECT doc_id, round(x, 6) AS score FROM s WHERE doc_id IN (SELECT doc_id FROM ({docs})) ORDER BY score DESC, doc_id{f' LIMIT {k}' if k else ''}", more, base)


def vsm(docs: str, times: dict[str, int]) -> str:
    more = f"""{cells(times)}, qn AS (SELECT sqrt(sum(power(times * ln(n / df), 2))) AS qn FROM q JOIN dfs USING (term), n),
s AS (SELECT doc_id, sum(times * idf * w) AS dot, sqrt(sum(w * w)) AS own FROM cell GROUP BY doc_id)"""
    return with_tokens(f"SELECT doc_id, round(dot / (own * qn), 6) AS score FROM s, qn WHERE own > 0 AND qn > 0 AND doc_id IN (SELECT doc_id FROM ({docs})) ORDER BY score DESC, doc_id", more)


CHAMPIONS = """champ AS (SELECT term, doc_id, score, row_number() OVER (PARTITION BY term ORDER BY score DESC, doc_id) AS rnk
  FROM (SELECT term, doc_id, round((1 + ln(tf)) * ln(n / df), 6) AS score FROM post JOIN dfs USING (term), n))"""


def champions(size: int) -> str:
    return with_tokens(f"SELECT term, doc_id, score, CAST(rnk AS INTEGER) AS rnk FROM champ WHERE rnk <= {size}", CHAMPIONS)


def tiered(k: int) -> str:
    times = {"thing": 1, "attion": 1, "ering": 1}
    more = f"""{CHAMPIONS}, {cells(times)}, best AS (SELECT doc_id, min(rnk) AS best FROM champ WHERE term IN ('thing', 'attion', 'ering') GROUP BY doc_id),
tier AS (SELECT CASE WHEN count(*) FILTER (WHERE best <= 100) >= {5 * k} THEN 100 WHEN count(*) FILTER (WHERE best <= 1000) >= {5 * k} THEN 1000 ELSE 10000 END AS size FROM best),
s AS (SELECT doc_id, sum(times * w) AS x FROM cell GROUP BY doc_id HAVING sum(times * w) > 0)"""
    return with_tokens(f"SELECT doc_id, round(x, 6) AS score FROM s JOIN best USING (doc_id), tier WHERE best <= size ORDER BY score DESC, doc_id{f' LIMIT {k}' if k else ''}", more)


LOG = """log AS (SELECT 'user_' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS key, value, event_id AS seq, event_type = 'error' AS dead FROM events),
top AS (SELECT key, arg_max(value, seq) AS value, arg_max(dead, seq) AS dead, max(seq) AS seq FROM log GROUP BY key)"""


def with_log(select: str, more: str = "") -> str:
    return f"WITH {LOG}{', ' + more if more else ''} {select}"


LIVE = "SELECT key, value FROM top WHERE NOT dead"
_DOCS_AND = f"({having('thing')}) INTERSECT ({having('thtion')})"
_DOCS_OR = f"({having('thing')}) UNION ({having('attion')})"

POSTINGS = "SELECT doc_id, count(*) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tk WHERE term = 'thing' GROUP BY doc_id"
RANGE = f"{LIVE} AND key >= 'user_00000010' AND key < 'user_00000060' ORDER BY key LIMIT 100"

ORACLE_SQL: dict[str, str] = {
    "analyze_tokens": with_tokens("SELECT doc_id, pos, term FROM tk"),
    "analyze_tokens_english": with_tokens("SELECT doc_id, pos, term FROM tk", base=STEMMED),
    "analyze_tokens_russian": with_tokens("SELECT doc_id, pos, term FROM tk", base=tokens(RUSSIAN_STOPS)),
    "stemmed_bool_and": with_tokens(f"({having('thing')}) INTERSECT ({having('thtion')})", base=STEMMED),
    "stemmed_rank_tfidf": tfidf(ALL, {"thing": 1, "attion": 1, "ere": 1}, 10, STEMMED),
    "stemmed_phrase": with_tokens(phrase(("erin", 0), ("thanea", 1)), base=STEMMED),
    "document_snippets": """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CASE WHEN strlen(text) <= 72 THEN text
  ELSE substr(text, 1, CAST(list_max(list_filter(range(0, 73), lambda n: strlen(substr(text, 1, CAST(n AS BIGINT))) <= 72)) AS BIGINT)) || '…' END AS snippet FROM documents""",
    "index_postings": with_tokens("SELECT term, doc_id, tf, CAST(first_pos AS BIGINT) AS first_pos, CAST(last_pos AS BIGINT) AS last_pos FROM post"),
    "term_df": with_tokens("SELECT term, df FROM dfs"),
    "corpus_size": "SELECT count(DISTINCT doc_id) AS n FROM documents",
    "universe": ALL,
    "lookup_postings": with_tokens(POSTINGS),
    "merged_postings": with_tokens(POSTINGS, base=TWICE),
    "merged_term_df": with_tokens("SELECT term, df FROM dfs", base=TWICE),
    "saved_bool_nested": with_tokens(NESTED),
    "saved_phrase": with_tokens(phrase(("eriner", 0), ("thanea", 1))),
    "saved_rank_tfidf": tfidf(NESTED, {"thing": 1, "attion": 1, "ering": 1}),
    "saved_rank_vsm": vsm(NESTED, {"thing": 1, "attion": 1, "ering": 1}),
    "saved_tiered_search": tiered(60),
    "champions_tier2": champions(10_000),
    "kv_flushed_get": with_log(f"{LIVE} AND key = 'user_00000012'"),
    "kv_flushed_range_scan": with_log(RANGE),
    "kv_flushed_bounds": with_log("SELECT min(key) AS least, max(key) AS greatest FROM log"),
    "kv_leveled": with_log(LIVE),
    "kv_leveled_range_scan": with_log(RANGE),
    "bloom_saved": "SELECT count(DISTINCT event_id) AS members, CAST(0 AS BIGINT) AS missed, true AS rate_met FROM events",
    "term_exact": with_tokens(having("thing")),
    "term_prefix": with_tokens(starting("thing")),
    "term_prefix_ther": with_tokens(starting("ther")),
    "bool_and": with_tokens(_DOCS_AND),
    "bool_or": with_tokens(f"({having('thing')}) UNION ({having('thtion')})"),
    "bool_not": with_tokens(f"({ALL}) EXCEPT ({having('thing')})"),
    "bool_nested": with_tokens(NESTED),
    "bool_stopword_term": with_tokens(having("thing")),
    "bool_not_stopword": ALL,
    "bool_nil": with_tokens(having("thing")),
    "phrase_bigram": with_tokens(phrase(("eriner", 0), ("thanea", 1))),
    "phrase_trigram": with_tokens(phrase(("anea", 0), ("eriner", 1), ("thanea", 2))),
    "phrase_stop_gap": with_tokens(phrase(("attion", 0), ("thanedble", 2))),
    "phrase_prefix": with_tokens(phrase(("erin", 0), ("thane", 1), prefix=True)),
    "phrase_in_bool": with_tokens(f"({phrase(('eriner', 0), ('thanea', 1))}) EXCEPT ({having('thing')})"),
    "rank_tfidf": tfidf(NESTED, {"thing": 1, "attion": 1, "ering": 1}),
    "rank_tfidf_repeated": tfidf(_DOCS_OR, {"thing": 2, "attion": 1}),
    "rank_tfidf_top5": tfidf(_DOCS_AND, {"thing": 1, "thtion": 1}, 5),
    "rank_vsm": vsm(NESTED, {"thing": 1, "attion": 1, "ering": 1}),
    "rank_vsm_repeated": vsm(_DOCS_OR, {"thing": 2, "attion": 1}),
    "champions_tier0": champions(100),
    "champions_tier1": champions(1000),
    "tiered_search_k3": tiered(3),
    "tiered_search_k60": tiered(60),
    "tiered_search_k100": tiered(100),
    "tiered_search_k0": tiered(0),
    "docset_cardinality": "SELECT count(DISTINCT doc_id) AS cardinality FROM documents",
    "docset_bitmap_or": with_tokens(f"SELECT count(*) AS cardinality FROM (({having('thing')}) UNION ({having('thtion')}))"),
    "docset_bitmap_and": with_tokens(f"SELECT count(*) AS cardinality FROM ({_DOCS_AND})"),
    "docset_minus": with_tokens(f"({having('thing')}) EXCEPT ({having('thtion')})"),
    "docset_round_trip": with_tokens(having("thing")),
    "kv_latest": with_log(LIVE),
    "kv_get": with_log(f"{LIVE} AND key = 'user_00000012'"),
    "kv_range_scan": with_log(RANGE),
    "kv_range_scan_open": with_log(f"{LIVE} AND key >= 'user_00000100' ORDER BY key LIMIT 20"),
    "kv_put": with_log("SELECT key, CASE WHEN key LIKE '%7' THEN -1.0::DOUBLE ELSE value END AS value FROM top WHERE NOT dead OR key LIKE '%7'"),
    "kv_delete": with_log(f"{LIVE} AND key > 'user_00000050'"),
    "kv_merge": with_log(
        "SELECT key, count(*) AS ops, round(sum(value), 4) AS total FROM log LEFT JOIN ends USING (key) WHERE NOT dead AND (last IS NULL OR seq > last) GROUP BY key",
        "ends AS (SELECT key, max(seq) AS last FROM log WHERE dead GROUP BY key)",
    ),
    "kv_compact": with_log("SELECT key, value, seq FROM top WHERE NOT dead"),
    "kv_bounds": with_log("SELECT min(key) AS least, max(key) AS greatest FROM log"),
    "bloom_members": "SELECT count(DISTINCT user_id) AS members, CAST(0 AS BIGINT) AS missed FROM events",
}
