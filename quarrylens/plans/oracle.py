"""The catalogue's queries in SQL for DuckDB, over the same tables."""

from __future__ import annotations

from quarrylens.plans import oracle_values as values

ONE = "NATION_7"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---- shared parts -------------------------------------------------------------------------------------------------------

TICKS = "ticks AS (SELECT n_name AS company, o_orderdate AS ts, o_totalprice AS price, o_orderkey AS tie FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"


def stocks(unit: str) -> str:
    return f"""{TICKS}, bars AS (
  SELECT company, CAST(date_trunc('{unit}', ts) AS DATE) AS date, first(price ORDER BY ts, tie) AS "Open", max(price) AS "High", min(price) AS "Low", last(price ORDER BY ts, tie) AS "Close", CAST(count(*) AS DOUBLE) AS "Volume"
  FROM ticks GROUP BY ALL),
stocks AS (SELECT company, date, variable, value FROM (UNPIVOT bars ON "Open", "High", "Low", "Close", "Volume" INTO NAME variable VALUE value))"""


RATIOS = """g AS (
  SELECT n_name AS company, concat(year(o_orderdate), 'Q', quarter(o_orderdate)) AS period,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS ext, CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS disc,
    CAST(sum(CAST(l_extendedprice * l_tax AS DECIMAL(18,4))) AS DOUBLE) AS tax, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qty, CAST(count(*) AS DOUBLE) AS n,
    CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS ret, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS op, CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS ords
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
w AS (SELECT company, period, round(ext / nullif(ext - disc, 0), 6) AS "Price-to-Earnings", round(ext / nullif(qty, 0), 6) AS "Price-to-Book", round((ext + tax) / nullif(ext - disc, 0), 6) AS "EV-to-Sales",
    round((ext - disc) / nullif(ext, 0), 6) AS "Gross Margin", round((ext - disc - tax) / nullif(ext, 0), 6) AS "Net Profit Margin", round(ret / nullif(n, 0), 6) AS "Return on Equity",
    round((n - op) / nullif(op, 0), 6) AS "Current Ratio", round(tax / nullif(disc, 0), 6) AS "Cash Ratio", round(n / nullif(ords, 0), 6) AS "Asset Turnover Ratio", round(qty / nullif(n, 0), 6) AS "Inventory Turnover Ratio",
    round(disc / nullif(tax, 0), 6) AS "Debt-to-Equity Ratio", round((ext - disc) / nullif(ext - tax, 0), 6) AS "Cash Conversion Efficiency" FROM g),
ratios AS (SELECT company, metric, period, value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE (company, period)) INTO NAME metric VALUE value))"""

_has = lambda parts: "(" + " OR ".join(f"contains(lower(metric), {q(p)})" for p in parts) + ")"
GOOD = "CASE " + " ".join(f"WHEN {_has(p)} THEN {str(g).lower()}" for p, g in values.DIRECTION_RULES) + " ELSE true END"
PRESSED = f"CASE WHEN abs(value) >= 1e6 OR {_has(values.COMPRESSED)} THEN sign(value) * log10(abs(value) + 1) ELSE value END"
GROUPS = "groups AS (SELECT * FROM (VALUES " + ", ".join(f"({q(c)}, {q(m)})" for c, ms in values.RATIO_GROUPS.items() for m in ms) + ") t(category, metric))"
ADJ = f"{RATIOS}, a0 AS (SELECT *, {GOOD} AS good FROM ratios), adj AS (SELECT *, CASE WHEN good THEN {PRESSED} ELSE -({PRESSED}) END AS adj FROM a0), {GROUPS}"
SCORE = """SELECT company, period, category, count(norm) AS n_metrics, round(avg(norm) * 100.0, 2) AS score, round(100 - round(avg(norm) * 100.0, 2), 2) AS risk FROM normed GROUP BY ALL"""
NO_PEERS = """spread AS (SELECT company, period, category, adj, min(adj) OVER p AS lo, max(adj) OVER p AS hi FROM adj JOIN groups USING (metric) WINDOW p AS (PARTITION BY company, period, category)),
normed AS (SELECT company, period, category, CASE WHEN abs(hi - lo) <= 1e-8 + 1e-5 * abs(lo) THEN 0.5 ELSE least(greatest((adj - lo) / nullif(hi - lo, 0), 0.0), 1.0) END AS norm FROM spread)"""
PEERS = """bounds AS (SELECT period, metric, quantile_cont(adj, 0.01) AS lo, quantile_cont(adj, 0.99) AS hi, min(adj) AS mn, max(adj) AS mx, avg(adj) AS mu, stddev_pop(adj) AS sd FROM {0} GROUP BY ALL),
x AS (SELECT company, period, metric, adj, mn, mx, mu, sd, CASE WHEN lo IS NULL THEN adj ELSE least(greatest(adj, lo), hi) END AS x, lo IS NOT NULL AS has FROM adj LEFT JOIN bounds USING (period, metric))"""
RANKED = "r AS (SELECT x.company, x.period, x.metric, any_value(x.adj) AS adj, any_value(x.has) AS has, (count(p.adj) FILTER (p.adj < x.x) + 0.5 * count(p.adj) FILTER (p.adj = x.x)) / count(p.adj) AS norm FROM x LEFT JOIN {0} p USING (period, metric) GROUP BY ALL)"


def peers(norm: str) -> str:
    return f"WITH {ADJ}, {PEERS.format('adj')}, normed AS (SELECT company, period, category, {norm} AS norm FROM x JOIN groups USING (metric)) {SCORE}"


def cdf(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * (abs({z}) / sqrt(2.0))))"
    poly = f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"
    return f"0.5 * (1 + sign({z}) * (1 - ({poly}) * exp(-(abs({z}) / sqrt(2.0)) * (abs({z}) / sqrt(2.0)))))"


FILINGS = """f1 AS (SELECT accession_number AS accession, upper(trim(ticker)) AS ticker, regexp_replace(upper(trim(form)), '/A$', '') AS form, filing_date AS date FROM filings WHERE accession_number IS NOT NULL),
f2 AS (SELECT * FROM f1 QUALIFY row_number() OVER (PARTITION BY accession ORDER BY date DESC NULLS LAST, ticker DESC NULLS LAST, form DESC NULLS LAST) = 1),
f3 AS (SELECT f2.*, display_name AS company FROM f2 JOIN companies USING (ticker)),
fil AS (SELECT accession, company, form, date, CASE WHEN date IS NULL THEN NULL WHEN form = '10-Q' THEN concat('Q', row_number() OVER (PARTITION BY company, form, year(date) ORDER BY date, accession), '_', year(date)) WHEN form = '10-K' THEN concat('FY_', year(date)) END AS period FROM f3),
chain AS (SELECT *, row_number() OVER c AS seq, lead(accession) OVER c AS next FROM fil WHERE date IS NOT NULL WINDOW c AS (PARTITION BY company, form ORDER BY date, accession))"""
CHUNKS = "ch AS (SELECT *, coalesce(item_heading, 'Not Found') AS heading FROM sec_chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) = 1)"
KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
CALLS = f"""names AS (SELECT {KEY.format('display_name')} AS k, min(display_name) AS name FROM companies GROUP BY 1),
t1 AS (SELECT * FROM transcript_chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST) = 1),
calls AS (SELECT t1.* EXCLUDE (company), name AS company, concat_ws('_', fiscal_quarter, fiscal_year) AS period, concat_ws('_', name, concat_ws('_', fiscal_quarter, fiscal_year)) AS transcript_id FROM t1 JOIN names ON {KEY.format('t1.company')} = k)"""
SORT_KEY = "CASE WHEN regexp_matches({0}, '^Q[0-9]+_[0-9]{{4}}$') THEN CAST(right({0}, 4) AS INT) * 100 + CAST(regexp_extract({0}, '^Q([0-9]+)_', 1) AS INT) WHEN regexp_matches({0}, '^FY_[0-9]{{4}}$') THEN CAST(substr({0}, 4) AS INT) * 100 + 99 END"
SUB = "CASE WHEN sub_headings IS NULL THEN '{}' ELSE concat('{', array_to_string(list_transform(list_sort(map_entries(sub_headings)), lambda e: concat('\"', e.key, '\":\"', e.value, '\"')), ','), '}') END"
PARENTS = f"par AS (SELECT fil.company, accession, fil.form, period, fil.date, heading, chunk_id AS parent_id, parent_chunk AS parent_text, is_table, {SUB} AS sub_heading, child_chunks FROM ch JOIN fil ON accession_no = accession)"
KIDS = "kids AS (SELECT par.* EXCLUDE (child_chunks), u.e.key AS child_id, u.e.value AS child_text FROM par, UNNEST(map_entries(child_chunks)) AS u(e))"
TURNS = "turns AS (SELECT * FROM conversation_turns WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY asked_at DESC NULLS LAST) = 1)"
LABELS = "CASE WHEN coalesce(len({y}), 0) > 0 AND coalesce(len({z}), 0) > 0 THEN flatten(list_transform({y}, lambda y: list_transform({z}, lambda z: concat(z, '_', y)))) WHEN coalesce(len({y}), 0) > 0 THEN list_transform({y}, lambda y: concat('FY_', y)) ELSE [] END"
VEC = "v AS (SELECT vec_id AS id, embedding, label FROM embeddings), qv AS (SELECT embedding AS qe FROM embeddings WHERE vec_id = 0), s AS (SELECT id, label, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[])) AS c FROM v, qv)"
SIX = "round(c, 6) AS cosine, round((1 + c) / 2, 6) AS score"
CITED = "cited AS (SELECT id AS turn, modif_query AS q, pos - 1 AS pos, c.child_chunk_id AS child_id, c.score AS score FROM (SELECT id, modif_query, unnest(sec_context) AS c, generate_subscripts(sec_context, 1) AS pos FROM turns WHERE modif_query IS NOT NULL)), one AS (SELECT * FROM cited WHERE child_id <> '' QUALIFY row_number() OVER (PARTITION BY turn, child_id ORDER BY pos) = 1)"
TEXTS = f"WITH {FILINGS}, {CHUNKS}, {TURNS}, {PARENTS}, {KIDS}, {CITED}, bodies AS (SELECT company, period, form, heading, accession, sub_heading, parent_text, child_id, child_text FROM kids UNION ALL SELECT company, period, form, heading, accession, sub_heading, parent_text, parent_id, parent_text FROM par), cite AS (SELECT * FROM one JOIN bodies USING (child_id))"


EMB = "emb AS (SELECT DISTINCT id AS child_id, CAST(openai_embedding AS DOUBLE[]) AS vec FROM chunk_embeddings WHERE id IS NOT NULL AND NOT list_contains(list_transform(openai_embedding, lambda x: x IS NULL OR isnan(x)), true) AND list_sum(list_transform(openai_embedding, lambda x: abs(x))) > 0)"
CALL_VECTORS = f"""{TURNS}, {CALLS}, {EMB}, ask AS (SELECT CAST(embedding_trans AS DOUBLE[]) AS qe FROM turns WHERE len(embedding_trans) = 128 ORDER BY id LIMIT 1),
piece AS (SELECT company, period, transcript_id, speaker, chunk_id AS parent_id, chunk AS parent_text, u.e.key AS child_id FROM calls, UNNEST(map_entries(child_chunks)) AS u(e) UNION ALL SELECT company, period, transcript_id, speaker, chunk_id, chunk, chunk_id FROM calls),
cs AS (SELECT piece.*, list_cosine_similarity(vec, qe) AS c FROM piece JOIN emb USING (child_id), ask WHERE len(vec) = 128)"""


def _n(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '[ \\n]+'), lambda w: w <> ''))"


def words_of(x: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: length(w) >= 3))"


def contained(a: str, b: str) -> str:
    return f"CASE WHEN len({words_of(a)}) > 0 THEN len(list_intersect({words_of(a)}, {words_of(b)})) / len({words_of(a)}) ELSE 0.0 END"


RERANKED = f"{TEXTS}, sc AS (SELECT *, {contained('q', 'parent_text')} AS rerank_score FROM cite), top3 AS (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY rerank_score DESC, score DESC, child_id) AS rerank FROM sc QUALIFY rerank <= 3)"


def like(text: str, cue: str) -> str:
    return f"regexp_matches(lower(coalesce({text}, '')), {q(cue)})"


NORM = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"
_cues = "[" + ", ".join(f"CASE WHEN {{low}} AND regexp_matches(lower(q), {q(c)}) THEN {q(h)} END" for c, h in values.SECTION_CUES) + "]"


def in_order(x: str) -> str:
    """A list without repeats, first ones kept."""
    return f"list_filter({x}, lambda e, i: list_position({x}, e) = i)"


_found = f"list_filter({_cues.format(low='true')}, lambda h: h IS NOT NULL)"
_MDA = q("management discussion and analysis of financial condition and results of operations")
SYN = f"syn AS (SELECT DISTINCT ticker, {NORM.format('s')} AS gram FROM (SELECT ticker, unnest(list_concat(synonyms, [lower(ticker), canonical_name, display_name])) AS s FROM companies) WHERE {NORM.format('s')} <> '')"


def parse(out: str, source: str) -> str:
    """CTEs that end in `out`: the rows of `source` (q_id, q and others), parsed."""
    place = "instr(' ' || norm || ' ', ' ' || gram || ' ')"
    return f"""{out}_n AS (SELECT *, {NORM.format('q')} AS norm FROM {source}),
{out}_h AS (SELECT q_id, ticker, min(length(regexp_replace(substr(' ' || norm || ' ', 1, {place}), '[^ ]', '', 'g'))) AS place, max(length(gram)) AS n FROM {out}_n JOIN syn ON contains(' ' || norm || ' ', ' ' || gram || ' ') GROUP BY ALL),
{out}_t AS (SELECT q_id, list(ticker ORDER BY place, n DESC, ticker) AS tickers FROM {out}_h GROUP BY q_id),
{out}_0 AS (SELECT {out}_n.* EXCLUDE (norm), coalesce(tickers, []) AS tickers, list_sort(list_distinct(list_transform(list_filter(string_split(norm, ' '), lambda w: regexp_full_match(w, '(19|20)[0-9][0-9]')), lambda w: CAST(w AS INT)))) AS years,
  list_sort(list_distinct(list_transform(list_filter(string_split(norm, ' '), lambda w: regexp_full_match(w, 'q[1-4]')), lambda w: upper(w)))) AS quarters,
  {in_order(_found)}[:4] AS found FROM {out}_n LEFT JOIN {out}_t USING (q_id)),
{out} AS (SELECT *, CASE WHEN len(quarters) > 0 OR regexp_matches(lower(q), '\\bquarter(s|ly)?\\b') THEN '10-Q' WHEN len(years) > 0 OR regexp_matches(lower(q), '\\b(fy|annual(ly)?|yearly)\\b') THEN '10-K' ELSE 'UNKNOWN' END AS filing_type_hint,
  CASE WHEN len(found) > 0 THEN found ELSE [{_MDA}] END AS section_hints,
  CASE WHEN len(tickers) = 0 AND len(years) = 0 THEN 'GENERAL' WHEN {like('q', values.COMPARISON_CUES)} OR len(tickers) > 1 THEN 'COMPARISON' WHEN {like('q', values.CHANGE_CUES)} THEN 'CHANGE_DETECTION' WHEN {like('q', values.BROAD_CUES)} THEN 'BROAD' ELSE 'SIMPLE' END AS query_type FROM {out}_0)"""


PARSED = f"{TURNS}, {SYN}, qs AS (SELECT id AS q_id, modif_query AS q FROM turns WHERE modif_query IS NOT NULL), {parse('p', 'qs')}"
_labels = LABELS.format(y="years", z="quarters")
_many = f"""flatten(list_transform(CASE WHEN len(tickers) > 0 THEN tickers ELSE [''] END, lambda t: list_transform(CASE WHEN len(l) > 0 THEN l ELSE [''] END, lambda x: concat_ws(' ', nullif(t, ''), nullif(x, ''), section_hints[1]))))"""
JOBS = f"""{PARSED}, d0 AS (SELECT *, {_labels} AS l FROM p), d1 AS (SELECT *, {in_order(_many)} AS many FROM d0),
d2 AS (SELECT * EXCLUDE (many, found), CASE WHEN query_type IN ('BROAD', 'COMPARISON') AND len(many) >= 2 THEN many[:5] ELSE [q] END AS subs FROM d1),
d3 AS (SELECT q_id AS of, tickers AS b_t, l AS b_l, filing_type_hint AS b_f, section_hints AS b_h, unnest(subs) AS q, generate_subscripts(subs, 1) AS job_no FROM d2), d4 AS (SELECT *, concat(of, '|', job_no) AS q_id FROM d3), {parse('s', 'd4')}"""
_form = "CASE {0} WHEN '10-Q' THEN '10-Q' WHEN '10-K' THEN '10-K' ELSE {1} END"
RETRIEVER = "CASE query_type WHEN 'SIMPLE' THEN 'simple' WHEN 'BROAD' THEN 'multi' WHEN 'COMPARISON' THEN 'multi' WHEN 'CHANGE_DETECTION' THEN 'path' ELSE 'none' END"
_focus = "CASE " + " ".join(f"WHEN {like('q', c)} THEN {q(n)}" for n, c, _ in values.TONE_CUES) + " ELSE 'GENERAL' END"
_ask = "CASE WHEN trim(lower(q)) = '' THEN " + q(values.DEFAULT_TONE) + " " + " ".join(f"WHEN {like('q', c)} THEN {q(t)}" for _, c, t in values.TONE_CUES) + f" ELSE {q(values.GENERAL_TONE)} END"
_INPUT = f"CASE WHEN {like('modif_query', values.SMALL_TALK_CUES)} THEN 'SMALL_TALK' WHEN {like('modif_query', values.PERSONAL_CUES)} THEN 'PERSONAL_INFO' WHEN {like('modif_query', values.ADVICE_ASK_CUES)} THEN 'INVESTMENT_ADVICE_REQUEST' WHEN {like('modif_query', values.FINANCE_CUES)} THEN 'FINANCE_RESEARCH_OK' ELSE 'OUT_OF_SCOPE' END"
_INBAD = f"({like('modif_query', values.HARM_CUES)} OR {_INPUT} <> 'FINANCE_RESEARCH_OK')"
_OUTBAD = f"({like('llm_response_sec', values.HARM_CUES)} OR {like('llm_response_sec', values.ADVICE_GIVEN_CUES)})"
AUDITED = f"{RERANKED}, ctx AS (SELECT turn, string_agg(parent_text, ' ' ORDER BY rerank, parent_text) AS ctx, count(*) AS n_hits FROM top3 GROUP BY turn), au AS (SELECT id, modif_query, llm_response_sec, turn_id, parsed_metadata AS m, n_hits, {contained('llm_response_sec', 'ctx')} AS faith, {contained('modif_query', 'llm_response_sec')} AS rel FROM turns LEFT JOIN ctx ON turn = id)"
_SQ = "[modif_query, concat('  ', upper(modif_query)), transcript_query, ' ', concat_ws('   ', transcript_query, id)]"
_FLAT = f"list_filter(list_transform({_SQ}, lambda s: regexp_replace(regexp_replace(s, '\\s+', ' ', 'g'), '^ | $', '', 'g')), lambda s: s IS NOT NULL AND s <> '')"
NA = "coalesce(CAST({} AS VARCHAR), 'N/A')"
_trim = "coalesce(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '')"
_N = "chr(10)"
_rule = f"concat({_N}, {_N}, '---', {_N}, {_N})"
SEC_BLOCK = "concat('--- EVIDENCE ID: ', " + NA.format("accession") + ", ' ---', " + _N + ", " + ", ".join(f"'{a}: ', {v}, {_N}" for a, v in (("Company", NA.format("company")), ("Period", NA.format("period")), ("Form", NA.format("form")), ("Section", NA.format("heading")), ("Sub Sections", "coalesce(sub_heading, '{}')"), ("Content", _trim.format("parent_text")))) + ")"
CALL_BLOCK = "concat(" + ", ".join(f"'{a}: ', {v}, {_N}" for a, v in (("Company", NA.format("company")), ("Period", NA.format("period")), ("Speaker", NA.format("speaker")), ("Title", NA.format("title")), ("Content", _trim.format("chunk")))) + ")"
assert values.RULE == "\n\n---\n\n"

# ---- queries ------------------------------------------------------------------------------------------------------------

_pivot = ", ".join(f"max(value) FILTER (period = '{y}Q{k}') AS \"p_{y}Q{k}\"" for y in range(1995, 2002) for k in range(1, 5))
_ITEM = "item_heading IS NOT NULL"

ORACLE: dict[str, str] = {
    "chart_quarterly_series": f"WITH {stocks('quarter')} SELECT 'quarterly' AS timeframe, strftime(date, '%Y-%m-%d') AS date, company, variable, round(value, 4) AS value FROM stocks",
    **{f"chart_{n}_series": f"WITH {stocks(u)} SELECT strftime(date, '%Y-%m-%d') AS date, company, variable, round(value, 4) AS value FROM stocks" for n, u in (("daily", "day"), ("weekly", "week"), ("yearly", "year"))},
    "timeframe_routing": f"WITH {stocks('year')} SELECT strftime(date, '%Y-%m-%d') AS date, company, variable, round(value, 4) AS value FROM stocks",
    "key_fallback": f"""WITH {stocks('year')} SELECT company, strftime(date, '%Y-%m-%d') AS date, round(max(value) FILTER (variable = 'Open'), 4) AS open, round(max(value) FILTER (variable = 'Close'), 4) AS close, CAST(NULL AS DOUBLE) AS volume FROM stocks GROUP BY ALL""",
    "metric_direction_override": f"WITH {ADJ}, o AS (SELECT *, CASE metric WHEN 'Current Ratio' THEN false WHEN 'Price-to-Book' THEN true ELSE good END AS up FROM adj) SELECT company, period, metric, up AS good, round(CASE WHEN up = good THEN adj ELSE -adj END, 6) AS adj FROM o",
    "csv_filing_scan": "SELECT DISTINCT upper(trim(ticker)) AS ticker, strftime(filing_date, '%Y-%m-%d') AS filing_date, accession_number FROM filings WHERE ticker IS NOT NULL AND filing_date IS NOT NULL AND accession_number IS NOT NULL AND year(filing_date) > 2010",
    "json_chunk_scan": f"WITH {CHUNKS} SELECT chunk_id, accession_no, form, strftime(filing_date, '%Y-%m-%d') AS filing_date, heading AS item_heading, coalesce(is_table, false) AS is_table, md5(parent_chunk) AS digest, CAST(coalesce(cardinality(child_chunks), 0) AS INT) AS n_children FROM ch",
    "graph_sink": f"""WITH {FILINGS}, {CHUNKS}, kid AS (SELECT chunk_id, unnest(map_entries(child_chunks)) AS e FROM ch), k AS (
SELECT DISTINCT 'company' AS label, company AS src, CAST(NULL AS VARCHAR) AS dst FROM fil UNION ALL SELECT 'filing', accession, period FROM fil UNION ALL SELECT DISTINCT 'heading', heading, accession_no FROM ch UNION ALL SELECT 'parent_chunk', chunk_id, md5({SUB}) FROM ch
UNION ALL SELECT 'child_chunk', e.key, md5(e.value) FROM kid UNION ALL SELECT DISTINCT 'filed', company, accession FROM fil UNION ALL SELECT DISTINCT 'has_section', accession_no, concat_ws('|', heading, accession_no) FROM (SELECT ch.* FROM ch JOIN fil ON accession_no = accession)
UNION ALL SELECT DISTINCT 'has_content', concat_ws('|', heading, accession_no), chunk_id FROM ch UNION ALL SELECT DISTINCT 'has_child', chunk_id, e.key FROM kid)
SELECT label, src, dst FROM k""",
    "vector_index_topk": f"WITH {VEC} SELECT id, {SIX} FROM s ORDER BY c DESC, id LIMIT 10",
    "conversation_scan": f"""WITH {TURNS}, f AS (SELECT min(conversation_id) AS c FROM turns WHERE modif_query IS NOT NULL) SELECT id, turn_id, modif_query, coalesce(len(sec_context), 0) AS n_sec_context, coalesce(len(trans_context), 0) AS n_trans_context, coalesce(len(embedding), 0) AS n_embedding, coalesce(len(embedding_trans), 0) AS n_embedding_trans
FROM turns, f WHERE conversation_id = c AND modif_query IS NOT NULL""",
    "accepted_tables": f"WITH {CHUNKS} SELECT is_table, len(string_split(lower(parent_chunk), 'item')) - 1 < 2 AS accepted, count(*) AS n FROM ch WHERE parent_chunk IS NOT NULL GROUP BY ALL",
    "contents_found": f"""WITH {CHUNKS}, c AS (SELECT accession_no AS doc_id, CAST(string_split(chunk_id, '#')[-1] AS INT) AS table_no, lower(item_heading) AS t, lower(string_split(item_heading, ':')[1]) AS item FROM ch WHERE form = '10-K' AND item_heading IS NOT NULL),
i AS (SELECT doc_id, list_sort(list_distinct(list(item))) AS items FROM c GROUP BY doc_id), u AS (SELECT doc_id, table_no, string_agg(t, ' | ') OVER (PARTITION BY doc_id ORDER BY table_no ROWS UNBOUNDED PRECEDING) AS t FROM c)
SELECT doc_id, CAST(min(table_no) AS BIGINT) AS table_no FROM u JOIN i USING (doc_id) WHERE len(list_filter(items[:CAST(greatest(1, ceil(len(items) * 0.3)) AS INT)], lambda x: NOT contains(u.t, x))) = 0 GROUP BY doc_id""",
    # a part's texts pile up; a header that holds an item's heading closes what is long enough and switches to that item
    "chunk_10q_items": f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT accession_no AS doc_id, part_heading AS part, item_heading AS h0, trim(regexp_replace(item_heading, '[^!-~]+', ' ', 'g')) AS h, trim(regexp_replace(parent_chunk, '[^!-~]+', ' ', 'g')) AS t,
  row_number() OVER (PARTITION BY accession_no, part_heading ORDER BY CAST(string_split(chunk_id, '#')[-1] AS INT)) AS i, count(*) OVER (PARTITION BY accession_no, part_heading) AS n FROM ch WHERE form = '10-Q' AND item_heading IS NOT NULL AND part_heading IS NOT NULL AND parent_chunk IS NOT NULL),
sw AS (SELECT doc_id, part, list(DISTINCT {{'item': string_split(h0, ':')[1], 'key': lower(trim(string_split(h0, ':')[2])), 'heading': concat(string_split(h0, ':')[1], ': ', trim(string_split(h0, ':')[2]))}}) AS s FROM (SELECT accession_no AS doc_id, part_heading AS part, item_heading AS h0 FROM ch WHERE form = '10-Q' AND item_heading IS NOT NULL AND part_heading IS NOT NULL) GROUP BY ALL),
e AS (SELECT c.*, list_sort(list_filter(s, lambda x: x.key <> '' AND contains(lower(h), x.key)))[1].heading AS hit FROM c JOIN sw USING (doc_id, part)),
m AS (SELECT doc_id, part, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS item, '' AS buf, CAST(NULL AS VARCHAR) AS out_item, CAST(NULL AS VARCHAR) AS out_text FROM (SELECT DISTINCT doc_id, part FROM e)
UNION ALL SELECT m.doc_id, m.part, e.i, coalesce(hit, item), CASE WHEN hit IS NOT NULL AND {_n('buf')} > 20 THEN t WHEN buf = '' THEN t WHEN t = '' THEN buf ELSE buf || chr(10) || t END,
  CASE WHEN hit IS NOT NULL AND {_n('buf')} > 20 THEN item END, CASE WHEN hit IS NOT NULL AND {_n('buf')} > 20 THEN buf END FROM m JOIN e ON e.doc_id = m.doc_id AND e.part = m.part AND e.i = m.i + 1)
SELECT doc_id, part, out_item AS item, md5(out_text) AS digest FROM m WHERE out_text IS NOT NULL
UNION ALL SELECT m.doc_id, m.part, item, md5(buf) FROM m JOIN (SELECT doc_id, part, max(i) AS i FROM e GROUP BY ALL) l ON l.doc_id = m.doc_id AND l.part = m.part AND l.i = m.i WHERE {_n('buf')} > 20""",
    "chart_monthly_series": f"WITH {stocks('month')} SELECT strftime(date, '%Y-%m-%d') AS date, company, variable, round(value, 4) AS value FROM stocks",
    "chart_skip_missing_variable": f"WITH {stocks('quarter')} SELECT strftime(date, '%Y-%m-%d') AS date, \"Volume\", \"Close\" FROM bars WHERE company = '{ONE}' ORDER BY 1",
    "chart_candlestick": f"WITH {stocks('quarter')} SELECT epoch_ms(CAST(date AS TIMESTAMP)) AS x, 'candles' AS name, \"Open\" AS o, \"High\" AS h, \"Low\" AS l, \"Close\" AS c FROM bars WHERE company = '{ONE}'",
    "ratios_reindex": f"WITH {RATIOS} SELECT ord, asked.metric, period, value FROM (VALUES (1, 'Gross Margin'), (2, 'No Such Metric'), (3, 'Cash Ratio')) asked(ord, metric) LEFT JOIN (SELECT * FROM ratios WHERE company = '{ONE}') r ON r.metric = asked.metric",
    "ratios_period_pivot": f"WITH {RATIOS} SELECT metric, {_pivot} FROM ratios WHERE company = '{ONE}' GROUP BY metric",
    "performance_point": f"WITH {RATIOS} SELECT company, period, metric, value FROM ratios WHERE period = '1996Q3'",
    "period_codes": f"""WITH {FILINGS}, {CALLS}, p AS (SELECT period FROM calls UNION SELECT period FROM fil), k AS (SELECT period, {SORT_KEY.format('period')} AS sort_key FROM p WHERE period IS NOT NULL)
SELECT period, regexp_replace(regexp_replace(period, '^Q([0-9]+)_([0-9]+)$', '\\2Q\\1'), '^FY_([0-9]+)$', '\\1') AS code, sort_key,
strftime(CASE WHEN sort_key % 100 = 99 THEN make_date(CAST(floor(sort_key / 100) AS INT), 1, 1) WHEN sort_key % 100 <= 4 THEN make_date(CAST(floor(sort_key / 100) AS INT), (sort_key % 100) * 3 - 2, 1) END, '%Y-%m-%d') AS starts FROM k""",
    "nonfinite_sanitize": "SELECT l_linenumber, count(*) AS n, count(v) AS n_finite, round(sum(v), 2) AS total FROM (SELECT l_linenumber, CASE WHEN l_linenumber > 3 THEN l_quantity END AS v FROM lineitem) GROUP BY 1",
    "metric_direction_and_transform": f"WITH {ADJ} SELECT company, period, metric, good, round(adj, 6) AS adj FROM adj",
    "risk_scores_no_peers": f"WITH {ADJ}, {NO_PEERS} {SCORE}",
    "risk_scores_peers_percentile": f"WITH {ADJ}, {PEERS.format('adj')}, {RANKED.format('adj')}, normed AS (SELECT company, period, category, norm FROM r JOIN groups USING (metric)) {SCORE}",
    # a company and period without any peer is scored within its categories
    "risk_scores_peer_table": f"""WITH {ADJ}, pe AS (SELECT period, metric, adj FROM adj WHERE metric IN ('Gross Margin', 'Current Ratio', 'Price-to-Book') AND CAST(left(period, 4) AS INT) < 1996), {PEERS.format('pe')}, {RANKED.format('pe')},
c AS (SELECT r.*, category, bool_or(has) OVER (PARTITION BY company, period) AS any_peer, min(adj) OVER k AS c_lo, max(adj) OVER k AS c_hi FROM r JOIN groups USING (metric) WINDOW k AS (PARTITION BY company, period, category)),
normed AS (SELECT company, period, category, CASE WHEN NOT any_peer THEN CASE WHEN abs(c_hi - c_lo) <= 1e-8 + 1e-5 * abs(c_lo) THEN 0.5 ELSE (adj - c_lo) / nullif(c_hi - c_lo, 0) END WHEN has THEN norm ELSE least(greatest(adj, 0.0), 1.0) END AS norm FROM c) {SCORE}""",
    "risk_scores_peers_minmax": peers("CASE WHEN abs(mx - mn) <= 1e-8 + 1e-5 * abs(mn) THEN 0.5 ELSE least(greatest((x - mn) / nullif(mx - mn, 0), 0.0), 1.0) END"),
    "risk_scores_peers_zscore": peers(f"{cdf('(CASE WHEN sd > 1e-12 THEN (x - mu) / sd ELSE 0.0 END)')}"),
    "risk_point_lookup": f"WITH {ADJ}, {NO_PEERS}, sc AS ({SCORE}), cats AS (SELECT DISTINCT category FROM groups) SELECT category, n_metrics, score, risk FROM cats LEFT JOIN (SELECT * FROM sc WHERE company = '{ONE}' AND period = (SELECT max(period) FROM ratios WHERE company = '{ONE}')) USING (category)",
    "metric_average_rank": f"WITH {RATIOS} SELECT company, period, metric, round(rank() OVER (PARTITION BY period, metric ORDER BY value) + (count(*) OVER (PARTITION BY period, metric, value) - 1) / 2, 1) AS rank FROM ratios",
    "display_format": f"WITH {RATIOS} SELECT company, period, metric, printf('%.2f', CAST(round(CAST(value AS DECIMAL(18,6)), 2) AS DOUBLE)) AS shown, least(greatest(round(CASE WHEN value <= 1 THEN value * 100 ELSE value END, 0), 0.0), 100.0) AS percent FROM ratios",
    "price_returns": f"""WITH {stocks('quarter')}, v AS (SELECT company, date, value AS p FROM stocks WHERE variable = 'Close'), r AS (SELECT company, date, p / nullif(lag(p) OVER (PARTITION BY company ORDER BY date), 0) - 1 AS ret FROM v)
SELECT company, strftime(date, '%Y-%m-%d') AS date, round(ret, 6) AS return, round(exp(sum(CASE WHEN ret > -1 THEN ln(1 + ret) END) OVER u) - 1, 6) AS cumulative_return, round(stddev_samp(ret) OVER u, 6) AS volatility FROM r WINDOW u AS (PARTITION BY company ORDER BY date ROWS UNBOUNDED PRECEDING)""",
    "filing_periods": f"WITH {FILINGS} SELECT accession, company, form, strftime(date, '%Y-%m-%d') AS date, period FROM fil",
    "filings_after_year": f"WITH {FILINGS} SELECT company, form, count(*) AS n FROM fil WHERE year(date) > 2015 GROUP BY ALL",
    "filing_next_edges": f"WITH {FILINGS} SELECT accession AS src, next AS dst FROM chain WHERE next IS NOT NULL",
    "transcript_next_chronological": f"WITH {CALLS}, t AS (SELECT DISTINCT transcript_id AS id, company, period FROM calls), e AS (SELECT id AS src, lead(id) OVER (PARTITION BY company ORDER BY {SORT_KEY.format('period')}, id) AS dst FROM t) SELECT * FROM e WHERE dst IS NOT NULL",
    "transcript_next_lexicographic": f"WITH {CALLS}, t AS (SELECT DISTINCT transcript_id AS id, company, period FROM calls), e AS (SELECT id AS src, lead(id) OVER (PARTITION BY company ORDER BY period, id) AS dst FROM t) SELECT * FROM e WHERE dst IS NOT NULL",
    "graph_nodes_edges": f"""WITH {FILINGS}, {CHUNKS}, kid AS (SELECT chunk_id, unnest(map_keys(child_chunks)) AS child_id FROM ch), k AS (
SELECT DISTINCT 'company' AS label, company AS k, '' AS o FROM fil UNION ALL SELECT 'filing', accession, '' FROM fil UNION ALL SELECT DISTINCT 'heading', heading, accession_no FROM ch UNION ALL SELECT 'parent_chunk', chunk_id, '' FROM ch
UNION ALL SELECT 'child_chunk', child_id, chunk_id FROM kid UNION ALL SELECT DISTINCT 'filed', company, accession FROM fil UNION ALL SELECT DISTINCT 'has_section', accession_no, heading FROM (SELECT ch.* FROM ch JOIN fil ON accession_no = accession)
UNION ALL SELECT DISTINCT 'has_content', concat_ws('|', heading, accession_no), chunk_id FROM ch UNION ALL SELECT DISTINCT 'has_child', chunk_id, child_id FROM kid)
SELECT label, count(*) AS n, count(DISTINCT k) AS n_keys, min(k) AS least, max(k) AS most FROM k GROUP BY label""",
    "graph_section_edges": f"WITH {CHUNKS} SELECT DISTINCT accession_no AS src, concat_ws('|', heading, accession_no) AS dst FROM ch WHERE accession_no IS NOT NULL",
    "transcript_filing_match": f"WITH {FILINGS}, {CALLS} SELECT chunk_id, company, period, transcript_id FROM calls WHERE (company, period) IN (SELECT (company, period) FROM fil WHERE form = '10-Q' AND period IS NOT NULL)",
    "transcript_speakers": f"WITH {CALLS} SELECT company, coalesce(speaker, 'N/A') AS speaker, coalesce(nullif(title, ''), 'N/A') AS title, count(*) AS n FROM calls GROUP BY ALL",
    "hierarchy_filter": f"WITH {FILINGS}, {CHUNKS}, {PARENTS}, {KIDS} SELECT company, accession, form, period, heading, parent_id, child_id FROM kids WHERE contains(lower(company), 'inc') AND form = '10-Q' AND (contains(lower(heading), 'risk factors') OR contains(lower(heading), 'legal'))",
    "change_detection": f"""WITH {FILINGS}, {CHUNKS}, {PARENTS}, top AS (SELECT company FROM chain WHERE form = '10-Q' GROUP BY company ORDER BY count(*) DESC, company LIMIT 1), own AS (SELECT * FROM chain WHERE company = (SELECT company FROM top)),
ends AS (SELECT arg_min(period, seq) AS a, arg_max(period, seq) AS z FROM own WHERE form = '10-Q'), span AS (SELECT x.form, x.seq AS s0, y.seq AS s1 FROM own x JOIN own y USING (form), ends WHERE x.period = a AND y.period = z),
path AS (SELECT DISTINCT accession, seq FROM own JOIN span USING (form) WHERE seq BETWEEN s0 AND s1)
SELECT DISTINCT company, period, seq, accession, form, heading, parent_id, sub_heading FROM par JOIN path USING (accession) WHERE contains(lower(heading), 'risk factors')""",
    "change_records": f"""WITH {FILINGS}, {CHUNKS}, {PARENTS} SELECT par.company, par.period, heading, parent_id, sub_heading, concat('Company=', par.company, ';Filing=', accession, ';Heading=', heading, ';ParentChunk=', parent_id) AS nodes, 'FILED>HAS_SECTION>HAS_CONTENT' AS rels,
row_number() OVER (PARTITION BY par.company ORDER BY seq, heading, parent_id) AS place FROM par JOIN chain USING (accession) WHERE chain.form = '10-Q' AND contains(lower(heading), 'risk factors')""",
    "change_detection_bounds": f"""WITH {TURNS}, l AS (SELECT id, {LABELS.format(y='parsed_metadata.years', z='parsed_metadata.quarters')} AS l FROM turns WHERE parsed_metadata IS NOT NULL),
s AS (SELECT id, l, list_sort(list_transform(l, lambda p: {{'k': {SORT_KEY.format('p')}, 'p': p}})) AS k, list_sort(l) AS t FROM l)
SELECT id, coalesce(array_to_string(l, ','), '') AS labels, k[1].p AS first, k[-1].p AS last, t[1] AS first_text, t[-1] AS last_text FROM s""",
    "embedding_lookup": f"WITH {CHUNKS}, kid AS (SELECT form, unnest(map_keys(child_chunks)) AS child_id FROM ch) SELECT form, child_id IN (SELECT id FROM chunk_embeddings WHERE id IS NOT NULL) AS has_vector, count(*) AS n FROM kid GROUP BY ALL",
    "parent_numbers": f"WITH {CHUNKS}, k AS (SELECT chunk_id, accession_no, row_number() OVER (PARTITION BY accession_no ORDER BY chunk_id) AS n FROM ch WHERE len(list_filter(string_split_regex(parent_chunk, '\\s+'), lambda w: w <> '')) > 20) SELECT chunk_id, n, concat(accession_no, '#', n) AS parent_id FROM k",
    "vector_topk_exact": f"WITH {VEC} SELECT id, label, {SIX} FROM s ORDER BY c DESC, id LIMIT 10",
    "vector_topk_postfilter": f"WITH {VEC}, n AS (SELECT * FROM s ORDER BY c DESC, id LIMIT 300) SELECT id, label, {SIX} FROM n WHERE label = 3 ORDER BY c DESC, id LIMIT 10",
    "vector_topk_prefilter": f"WITH {VEC} SELECT id, label, {SIX} FROM s WHERE label = 3 ORDER BY c DESC, id LIMIT 10",
    "vector_topk_allowed": f"WITH {VEC}, n AS (SELECT * FROM s ORDER BY c DESC, id LIMIT 150) SELECT id, label AS \"group\", {SIX} FROM n WHERE label IN (1, 2) ORDER BY c DESC, id LIMIT 5",
    "multi_query_topk_union": """WITH j AS (SELECT label AS job_id, arg_min(embedding, vec_id) AS qe, min(vec_id) AS q_id FROM embeddings GROUP BY label), s AS (SELECT job_id, vec_id AS id, (1 + list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qe AS DOUBLE[]))) / 2 AS sc FROM embeddings JOIN j ON label = job_id AND vec_id <> q_id)
SELECT job_id, id, round(sc, 6) AS score, row_number() OVER (PARTITION BY job_id ORDER BY sc DESC, id) AS rank FROM s QUALIFY rank <= 3""",
    "transcript_topk": f"""WITH {CALL_VECTORS}, n AS (SELECT * FROM cs ORDER BY c DESC, child_id LIMIT 150)
SELECT child_id, company, period, coalesce(speaker, 'N/A') AS speaker, {SIX} FROM n WHERE TRY_CAST(right(period, 4) AS INT) >= 2010 ORDER BY c DESC, child_id LIMIT 5""",
    "transcript_records": f"""WITH {CALL_VECTORS} SELECT child_id, md5(parent_text) AS digest, transcript_id, round((1 + c) / 2, 6) AS score, concat('Company=', company, ';Transcript=', transcript_id, ';ParentChunk=', parent_id, ';ChildChunk=', child_id) AS nodes, 'HOSTED>HAS_CONTENT>HAS_CHILD' AS rels
FROM cs ORDER BY c DESC, child_id LIMIT 5""",
    "multi_query_budgets": f"""WITH {FILINGS}, {CHUNKS}, {PARENTS}, {KIDS}, {TURNS}, {CALLS}, {EMB},
job AS (SELECT id AS job_id, modif_query AS q, parsed_metadata.companies[1].name AS who, embedding AS qs, embedding_trans AS qt FROM turns WHERE modif_query IS NOT NULL AND parsed_metadata.companies[1].name IS NOT NULL AND len(embedding) = 128 AND len(embedding_trans) = 128),
sec AS (SELECT company, child_id, parent_text FROM kids UNION ALL SELECT company, parent_id, parent_text FROM par), cal AS (SELECT company, u.e.key AS child_id, u.e.value AS parent_text FROM calls, UNNEST(map_entries(child_chunks)) AS u(e) UNION ALL SELECT company, chunk_id, chunk FROM calls),
s1 AS (SELECT job_id, q, 'filings' AS source, child_id, parent_text, list_cosine_similarity(vec, CAST(qs AS DOUBLE[])) AS c FROM sec JOIN emb USING (child_id) JOIN job ON company = who WHERE len(vec) = 128 QUALIFY c IS NOT NULL AND NOT isnan(c) AND row_number() OVER (PARTITION BY job_id ORDER BY c DESC, child_id) <= 10),
s2 AS (SELECT job_id, q, 'calls' AS source, child_id, parent_text, list_cosine_similarity(vec, CAST(qt AS DOUBLE[])) AS c FROM cal JOIN emb USING (child_id) JOIN job ON company = who WHERE len(vec) = 128 QUALIFY c IS NOT NULL AND NOT isnan(c) AND row_number() OVER (PARTITION BY job_id ORDER BY c DESC, child_id) <= 5),
r AS (SELECT job_id, source, child_id, row_number() OVER (PARTITION BY job_id, source ORDER BY {contained('q', 'parent_text')} DESC, c DESC, child_id) AS place FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2))
SELECT job_id, source, child_id, place FROM r WHERE place <= CASE source WHEN 'filings' THEN 3 ELSE 2 END""",
    "transcript_rerank_lexical": f"""WITH {CALLS}, k AS (SELECT company, period, u.e.key AS child_id, u.e.value AS t, 'operating margin and revenue outlook for the next quarter' AS q FROM calls, UNNEST(map_entries(child_chunks)) AS u(e)), s AS (SELECT *, {contained('q', 't')} AS sc FROM k)
SELECT company, period, child_id, round(sc, 6) AS rerank_score, row_number() OVER (PARTITION BY company ORDER BY sc DESC, child_id) AS rerank FROM s QUALIFY rerank <= 5""",
    "dedupe_first": f"WITH {TURNS}, {CITED} SELECT turn, child_id, pos, round(score, 6) AS score FROM one",
    "dedupe_first_overall": f"WITH {TURNS}, {CITED} SELECT child_id, turn, pos FROM cited WHERE child_id <> '' QUALIFY row_number() OVER (PARTITION BY child_id ORDER BY turn, pos) = 1",
    "rerank_lexical": f"{RERANKED} SELECT turn, child_id, round(rerank_score, 6) AS rerank_score, rerank FROM top3",
    "evidence_context": f"{RERANKED}, c AS (SELECT turn, count(*) AS n_blocks, string_agg({SEC_BLOCK}, {_rule} ORDER BY rerank) AS x FROM top3 GROUP BY turn) SELECT turn, n_blocks, md5(x) AS digest, length(x) AS n_chars FROM c",
    "transcript_context": f"WITH {CALLS} SELECT transcript_id, count(*) AS n_blocks, md5(string_agg({CALL_BLOCK}, {_rule} ORDER BY chunk_id)) AS digest FROM calls GROUP BY transcript_id",
    "retrieval_record_struct": f"WITH {FILINGS}, {CHUNKS}, {PARENTS}, {KIDS} SELECT child_id, company, sub_heading, 5 AS n_nodes, concat('Company=', company, ';Filing=', accession, ';Heading=', heading, ';ParentChunk=', parent_id, ';ChildChunk=', child_id) AS nodes, 'FILED>HAS_SECTION>HAS_CONTENT>HAS_CHILD' AS rels FROM kids",
    "turn_envelopes": f"WITH {TURNS}, l AS (SELECT *, {LABELS.format(y='parsed_metadata.years', z='parsed_metadata.quarters')} AS l FROM turns) SELECT id, concat('Company: ', coalesce(parsed_metadata.companies[1].name, 'N/A'), ', Period: ', coalesce(l[1], 'N/A'), ', Query: ', modif_query) AS text FROM l WHERE modif_query IS NOT NULL",
    "child_chunk_windows": """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 31) + 1, 90)) AS p0 FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(floor(p0 / 90) AS BIGINT) AS piece_no, len(w[p0 + 1 : p0 + 120]) AS n_words, md5(array_to_string(w[p0 + 1 : p0 + 120], ' ')) AS digest FROM s""",
    # windows of 120 words without overlap: only the last can be short, and is then glued to the one before, word to word
    "child_chunk_fold": """WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n FROM documents), p AS (SELECT doc_id, n, CAST(floor((n - 1) / 120) AS BIGINT) + 1 AS k, n - 120 * CAST(floor((n - 1) / 120) AS BIGINT) AS last FROM w WHERE n > 220),
c AS (SELECT *, unnest(range(0, CASE WHEN last <= 50 THEN k - 1 ELSE k END)) AS key FROM p)
SELECT doc_id, k AS n_pieces, key, CASE WHEN key < k - 2 THEN 120 WHEN key = k - 2 THEN CASE WHEN last <= 50 THEN 119 + last ELSE 120 END ELSE last END AS n_words FROM c""",
    "page_furniture": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS n FROM l WHERE contains(lower(line), 'part') OR contains(lower(line), 'item') OR regexp_matches(line, {q(values.FOOTER)}) OR regexp_matches(line, {q(values.PAGE_NUMBER)}) GROUP BY doc_id",
    "toc_item_headings_10k": f"""WITH {CHUNKS}, t AS (SELECT DISTINCT accession_no AS doc_id, string_split(item_heading, ':')[1] AS item, trim(string_split(item_heading, ':')[2]) AS heading FROM ch WHERE form = '10-K' AND {_ITEM}) SELECT doc_id, item, concat(item, ': ', min(heading)) AS heading FROM t GROUP BY doc_id, item""",
    "toc_item_headings_10q": f"""WITH {CHUNKS}, t AS (SELECT DISTINCT accession_no AS doc_id, part_heading AS part, string_split(item_heading, ':')[1] AS item, trim(string_split(item_heading, ':')[2]) AS heading FROM ch WHERE form = '10-Q' AND {_ITEM} AND part_heading IS NOT NULL) SELECT doc_id, part, item, concat(item, ': ', heading) AS heading FROM t""",
    "query_parse": f"WITH {PARSED} SELECT q_id, coalesce(array_to_string(tickers, ','), '') AS tickers, coalesce(array_to_string(years, ','), '') AS years, coalesce(array_to_string(quarters, ','), '') AS quarters, filing_type_hint, array_to_string(section_hints, ',') AS section_hints, coalesce(array_to_string({LABELS.format(y='years', z='quarters')}, ','), '') AS periods FROM p",
    "query_classes": f"WITH {PARSED} SELECT q_id, query_type, CASE WHEN {like('q', values.TRANSCRIPT_CUES)} AND NOT {like('q', values.FILING_CUES)} THEN 'TRANSCRIPT' ELSE 'SEC' END AS source, {RETRIEVER} AS retriever FROM p",
    "tone_focus": f"WITH {TURNS} SELECT id AS q_id, {_focus} AS focus, {_ask} AS tone_query FROM (SELECT id, modif_query AS q FROM turns WHERE modif_query IS NOT NULL)",
    "subquery_validate": f"""WITH {TURNS}, f AS (SELECT id, modif_query, {_FLAT} AS f FROM turns WHERE modif_query IS NOT NULL), o AS (SELECT id, modif_query, list_filter(f, lambda s, i: list_position(list_transform(f, lambda x: lower(x)), lower(s)) = i) AS o FROM f)
SELECT id, CASE WHEN len(o) < 2 THEN modif_query ELSE array_to_string(o[:5], '|') END AS sub_queries FROM o""",
    "retrieval_jobs": f"""WITH {JOBS} SELECT of AS q_id, CAST(job_no AS INT) AS job_no, q, coalesce(tickers[1], b_t[1]) AS ticker, coalesce(array_to_string(CASE WHEN len({_labels}) > 0 THEN {_labels} ELSE b_l END, ','), '') AS periods,
{_form.format('filing_type_hint', _form.format('b_f', "'10-Q,10-K'"))} AS forms, array_to_string(section_hints, ',') AS headings FROM s""",
    "history_fill": f"""WITH {TURNS} SELECT id, last_value(parsed_metadata.companies[1].ticker IGNORE NULLS) OVER h AS ticker_filled, last_value(parsed_metadata.years[1] IGNORE NULLS) OVER h AS year_filled FROM turns WINDOW h AS (PARTITION BY conversation_id ORDER BY turn_id ROWS UNBOUNDED PRECEDING)""",
    "memory_upsert_latest": f"WITH {TURNS} SELECT id, conversation_id, turn_id, query_type, strftime(asked_at, '%Y-%m-%d %H:%M:%S') AS asked_at FROM turns WHERE turn_id IS NOT NULL",
    "memory_next_turn": "SELECT conversation_id, coalesce(max(turn_id), -1) + 1 AS next_turn_id FROM conversation_turns GROUP BY conversation_id",
    "memory_last_turns": f"WITH {TURNS}, r AS (SELECT id, conversation_id, turn_id, row_number() OVER (PARTITION BY conversation_id ORDER BY turn_id DESC, id) AS r FROM turns QUALIFY r <= 3) SELECT id, conversation_id, turn_id, row_number() OVER (PARTITION BY conversation_id ORDER BY r DESC) AS place FROM r",
    "context_reuse": f"""WITH {TURNS}, s AS (SELECT a.id, b.id AS reuse_id, b.turn_id AS pt, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM turns a JOIN turns b ON a.conversation_id = b.conversation_id AND b.turn_id < a.turn_id WHERE len(a.embedding) > 0 AND len(b.embedding) = len(a.embedding))
SELECT id, reuse_id, round(sim, 6) AS sim FROM s WHERE sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, pt, reuse_id DESC) = 1""",
    "context_reuse_again": f"""WITH {TURNS}, both_ AS (SELECT id, conversation_id, turn_id, parsed_metadata, embedding FROM turns UNION ALL SELECT concat(id, '+'), conversation_id, turn_id + 1000, parsed_metadata, embedding FROM turns),
s AS (SELECT a.id, b.id AS reuse_id, b.turn_id AS pt, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim, a.parsed_metadata AS x, b.parsed_metadata AS y FROM both_ a JOIN both_ b ON a.conversation_id = b.conversation_id AND b.turn_id < a.turn_id WHERE len(a.embedding) > 0 AND len(b.embedding) = len(a.embedding))
SELECT id, reuse_id, round(sim, 6) AS sim FROM s WHERE sim >= 0.7 AND x.companies IS NOT DISTINCT FROM y.companies AND list_sort(coalesce(x.years, [])) = list_sort(coalesce(y.years, [])) AND list_sort(coalesce(x.quarters, [])) = list_sort(coalesce(y.quarters, [])) AND x.filing_type_hint IS NOT DISTINCT FROM y.filing_type_hint
AND len(x.section_hints) > 0 AND len(y.section_hints) > 0 AND len(list_intersect(x.section_hints, y.section_hints)) / len(list_distinct(x.section_hints)) >= 0.95 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, pt, reuse_id DESC) = 1""",
    "context_reuse_strict": f"""WITH {TURNS}, s AS (SELECT a.id, b.id AS reuse_id, b.turn_id AS pt, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim, a.parsed_metadata AS x, b.parsed_metadata AS y FROM turns a JOIN turns b ON a.conversation_id = b.conversation_id AND b.turn_id < a.turn_id WHERE len(a.embedding) > 0 AND len(b.embedding) = len(a.embedding))
SELECT id, reuse_id FROM s WHERE sim >= 0.7 AND x.companies IS NOT DISTINCT FROM y.companies AND list_sort(coalesce(x.years, [])) = list_sort(coalesce(y.years, [])) AND list_sort(coalesce(x.quarters, [])) = list_sort(coalesce(y.quarters, [])) AND x.filing_type_hint IS NOT DISTINCT FROM y.filing_type_hint
AND len(x.section_hints) > 0 AND len(y.section_hints) > 0 AND len(list_intersect(x.section_hints, y.section_hints)) / len(list_distinct(x.section_hints)) >= 0.95 QUALIFY row_number() OVER (PARTITION BY id ORDER BY sim DESC, pt, reuse_id DESC) = 1""",
    "safety_gate": f"WITH {TURNS} SELECT id, {like('modif_query', values.HARM_CUES)} AS harmful, {_INPUT} AS input_class, {_INBAD} AS input_fails, {_OUTBAD} AS output_fails FROM turns",
    "audit_scores": f"{AUDITED} SELECT id, round(faith, 6) AS faithfulness, round(rel, 6) AS relevancy, coalesce(faith >= 0.5 AND rel >= 0.5, false) AS analysis_ok FROM au",
    "route_decision": f"""{AUDITED}, d AS (SELECT *, coalesce(faith >= 0.5 AND rel >= 0.5, false) AS ok, coalesce(n_hits, 0) >= 1 AS enough, {_INBAD} AS in_bad, {_OUTBAD} AS out_bad, coalesce(len(m.companies), 0) AS n, turn_id % 4 AS retries FROM au)
SELECT id, n <= 0 OR (coalesce(len(m.years), 0) <= 0 AND coalesce(len(m.quarters), 0) <= 0) AS needs_refinement, CASE WHEN enough THEN 'exit' WHEN retries >= 3 THEN 'fail' ELSE 'retry' END AS after_research,
CASE WHEN in_bad OR out_bad THEN 'fail' WHEN ok THEN 'accept' WHEN retries < 3 THEN 'retry' ELSE 'exhausted' END AS after_audit,
md5(CASE WHEN in_bad THEN {q(values.TEXTS['query_harmful'])} WHEN out_bad THEN {q(values.TEXTS['response_harmful'])} WHEN n = 0 THEN {q(values.TEXTS['no_company'])} WHEN NOT enough AND retries >= 3 THEN {q(values.TEXTS['research_fail'])}
WHEN llm_response_sec <> '' THEN concat('## From the filings', chr(10), chr(10), llm_response_sec) ELSE '' END) AS final_digest FROM d""",
}
