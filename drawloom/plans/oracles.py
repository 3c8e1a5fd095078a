"""DuckDB SQL that gives the rows of the queries in registry."""

from __future__ import annotations

from .registry import MANY, SEED, TICKETS

BASE = """base AS (SELECT o_orderkey, any_value(o_orderdate) AS d, list_sort(list(DISTINCT CAST(l_partkey % 37 + 1 AS INTEGER))) AS numbers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
draws AS (SELECT row_number() OVER (ORDER BY d, o_orderkey) - 1 AS ord, CAST(o_orderkey AS VARCHAR) AS draw_id, numbers, strftime(d, '%Y-%m-%d') AS date FROM base),
counts AS (SELECT number, count(*) AS count FROM (SELECT unnest(numbers) AS number FROM draws) GROUP BY number)"""
SCORES = """scores AS (SELECT number, (0.7e0 * (CAST(count AS DOUBLE) / greatest(max(count) OVER (), 1)) + 0.3e0 * 0e0) / (0.7e0 + 0.3e0) AS score FROM counts)"""
# Counts before each split by a window over the draws, whatever the number of splits.
COUNTED = """train_counts AS (SELECT split_id, number, count, last_ord FROM (
    SELECT number, split_id, sum(n) OVER w AS count, max(o) OVER w AS last_ord FROM (
        SELECT number, CAST(greatest(0, ceil((ord - train + 1) / test)) AS INTEGER) AS split_id, count(*) AS n, max(ord) AS o FROM draws, sizes, unnest(numbers) AS u(number) GROUP BY ALL
        UNION ALL SELECT number, split_id, 0, NULL FROM split_ids, (SELECT number FROM counts)) GROUP BY number, split_id, n, o
    WINDOW w AS (PARTITION BY number ORDER BY split_id RANGE UNBOUNDED PRECEDING)) WHERE count > 0 AND split_id < (SELECT splits FROM sizes) GROUP BY ALL)"""


def _sizes(test: str) -> str:
    return f"""sizes AS (SELECT n, greatest(n // 2, 1) AS train, {test} AS test, (n - greatest(n // 2, 1)) // ({test}) AS splits FROM (SELECT count(*) AS n FROM draws)),
split_ids AS (SELECT CAST(unnest(range(splits)) AS INTEGER) AS split_id FROM sizes),
test_rows AS (SELECT CAST((ord - train) // test AS INTEGER) AS split_id, ord, draw_id, numbers, train, test FROM draws, sizes WHERE ord >= train AND ord < train + splits * test)"""


SIZES = f"""{_sizes("greatest(n // 20, 1)")},
train_counts AS (SELECT split_id, number, count(*) AS count FROM split_ids, sizes, draws, unnest(numbers) AS u(number) WHERE ord < train + split_id * test GROUP BY ALL)"""
EACH = f"""{_sizes("1")},
{COUNTED}"""


def _uniform(stream: str, seed: str) -> str:
    return f"((CAST(('0x' || substr(md5('{stream}|' || CAST({seed} AS VARCHAR) || '|' || CAST(ticket_no AS VARCHAR) || '|' || CAST(number AS VARCHAR)), 1, 8)) AS BIGINT) + 1) / 4294967297e0)"


def _greedy(tickets: str, most: int = 10, overlap: int = 4) -> str:
    """At most ``most`` tickets that share ``overlap`` numbers at most; a fold over single-ticket lists."""
    return f"list_reduce(list_transform({tickets}, lambda t: [t]), lambda acc, x: CASE WHEN len(acc) < {most} AND len(list_filter(acc, lambda s: len(list_intersect(s, x[1])) > {overlap})) = 0 THEN acc || x ELSE acc END)"


def _masks(tickets: str, most: int, overlap: int) -> str:
    """The same fold over tickets as sets of bits, for long lists."""
    return f"list_reduce(list_transform({tickets}, lambda t: [t]), lambda acc, x: CASE WHEN len(acc) < {most} AND len(list_filter(acc, lambda s: bit_count(s & x[1]) > {overlap})) = 0 THEN acc || x ELSE acc END)"


MASK = "list_sum(list_transform({}, lambda n: CAST(1 AS BIGINT) << n))::BIGINT"


def _race(scores: str, seed: str, count: int = TICKETS) -> str:
    """(split_id, ticket_no, ticket): the six smallest keys."""
    return f"""raced AS (SELECT split_id, ticket_no, number, {_uniform("engine", seed)} AS u, score FROM {scores}, range({count}) AS r(ticket_no)),
    keyed AS (SELECT *, row_number() OVER (PARTITION BY split_id, ticket_no ORDER BY CASE WHEN score > 0 THEN -ln(u) / score ELSE 'inf'::DOUBLE END, u, number) AS k FROM raced),
    tickets AS (SELECT split_id, ticket_no, list(number ORDER BY number) AS ticket FROM keyed WHERE k <= 6 GROUP BY ALL),
    firsts AS (SELECT split_id, ticket, min(ticket_no) AS first FROM tickets GROUP BY ALL)"""


RECOMMENDED = f"""recommended AS (SELECT split_id, {_greedy("list(ticket ORDER BY first)")} AS chosen FROM firsts GROUP BY split_id)"""


def _walk(sizes: str) -> str:
    return f"""WITH {BASE}, {sizes},
split_scores AS (SELECT split_id, number, (0.7e0 * (CAST(count AS DOUBLE) / greatest(max(count) OVER (PARTITION BY split_id), 1)) + 0.3e0 * 0e0) / (0.7e0 + 0.3e0) AS score FROM train_counts),
{_race("split_scores", f"({SEED} + split_id)")}, {RECOMMENDED}"""


def _cases(walk: str) -> str:
    return f"""{walk},
uniform AS (SELECT split_id, ticket_no, number, {_uniform("baseline", f"({SEED} + 10000 + split_id)")} AS u FROM recommended, range(len(chosen)) AS r(ticket_no), range(1, 38) AS m(number)),
base_keyed AS (SELECT *, row_number() OVER (PARTITION BY split_id, ticket_no ORDER BY u, number) AS k FROM uniform),
base_tickets AS (SELECT split_id, ticket_no, list(number ORDER BY number) AS ticket FROM base_keyed WHERE k <= 6 GROUP BY ALL),
ours AS (SELECT ord, max(m) AS best, sum(m) AS total FROM (SELECT t.ord, len(list_intersect(s.ticket, t.numbers)) AS m FROM test_rows t JOIN (SELECT split_id, unnest(chosen) AS ticket FROM recommended) s USING (split_id)) GROUP BY ord),
theirs AS (SELECT ord, max(m) AS best, sum(m) AS total FROM (SELECT t.ord, len(list_intersect(s.ticket, t.numbers)) AS m FROM test_rows t JOIN base_tickets s USING (split_id)) GROUP BY ord),
cases AS (SELECT t.split_id, t.ord, CAST(train + t.split_id * test AS BIGINT) AS train_size, CAST(test AS BIGINT) AS test_size, CAST({TICKETS} AS BIGINT) AS generated_ticket_count, CAST(len(chosen) AS BIGINT) AS recommended_ticket_count, draw_id AS test_draw_id,
    CAST(o.best AS BIGINT) AS best_match, CAST(o.total AS BIGINT) AS total_matches, CAST(h.best AS BIGINT) AS baseline_best_match, CAST(h.total AS BIGINT) AS baseline_total_matches
    FROM test_rows t JOIN recommended USING (split_id) JOIN ours o ON o.ord = t.ord JOIN theirs h ON h.ord = t.ord)"""


WALK = _walk(SIZES)
CASES = _cases(WALK)
SUMMARY = """count(*) AS case_count, max(best_match) AS best_match, CAST(sum(total_matches) AS BIGINT) AS total_matches, CAST(sum(total_matches) AS DOUBLE) / count(*) AS average_matches,
max(baseline_best_match) AS baseline_best_match, CAST(sum(baseline_total_matches) AS BIGINT) AS baseline_total_matches, CAST(sum(baseline_total_matches) AS DOUBLE) / count(*) AS baseline_average_matches"""
STRETCHED = "stretched AS (SELECT event_id, (epoch_us(ts) - 1704067200000000) * 80 + 788918400000000 AS moment FROM events)"
SHOWN = "ord, draw_id, array_to_string(numbers, ',') AS numbers, date"
FREQUENCY = f"WITH {BASE}, frequency AS (SELECT number, count, count / sum(count) OVER () AS frequency FROM counts)"
LISTS = f"WITH {BASE}, first_seen AS (SELECT ord // 40 AS list, numbers, min(ord % 40) AS first FROM draws GROUP BY ALL), lists AS (SELECT list, list(numbers ORDER BY first) AS tickets FROM first_seen GROUP BY list)"
EXPLODED = "SELECT list, CAST(pos - 1 AS BIGINT) AS pos, array_to_string(tickets[pos], ',') AS ticket FROM chosen, range(1, len(tickets) + 1) AS r(pos)"
PAIRS = f"WITH {BASE}, pairs AS (SELECT a.ord, a.numbers, b.numbers AS other FROM draws a JOIN draws b ON a.ord = b.ord + 1)"

SQL = {
    "dataset_statistics": f"WITH {BASE} SELECT count(*) AS draw_count, CAST(sum(len(numbers)) AS BIGINT) AS number_count, min(list_min(numbers)) AS minimum, max(list_max(numbers)) AS maximum FROM draws",
    "lottery_summary": f"WITH {BASE} SELECT count(*) AS draw_count, CAST(sum(len(numbers)) AS BIGINT) AS total_numbers, min(list_min(numbers)) AS minimum_number, max(list_max(numbers)) AS maximum_number FROM draws",
    "number_frequency": f"{FREQUENCY} SELECT * FROM frequency",
    "frequency_for": f"{FREQUENCY} SELECT * FROM frequency WHERE number = 7",
    "most_frequent": f"{FREQUENCY} SELECT * FROM frequency ORDER BY count DESC, number LIMIT 10",
    "least_frequent": f"{FREQUENCY} SELECT * FROM frequency ORDER BY count, number LIMIT 10",
    "draws_in_order": f"WITH {BASE} SELECT {SHOWN} FROM draws",
    "csv_file_draws": f"WITH {BASE} SELECT {SHOWN} FROM draws",
    "draw_at": f"WITH {BASE} SELECT {SHOWN} FROM draws WHERE ord = 100",
    "latest_draw": f"WITH {BASE} SELECT {SHOWN} FROM draws ORDER BY ord DESC LIMIT 1",
    "append_draw": f"WITH {BASE} SELECT {SHOWN} FROM draws UNION ALL SELECT (SELECT count(*) FROM draws), 'new', '1,2,3,4,5,6', NULL",
    "draw_validation": f"""WITH {BASE}, broken AS (SELECT draw_id AS key, CASE WHEN o % 7 = 1 THEN '' ELSE draw_id END AS draw_id,
        CASE o % 7 WHEN 2 THEN CAST([] AS INTEGER[]) WHEN 3 THEN numbers || numbers[1:1] WHEN 4 THEN numbers || [0] WHEN 5 THEN numbers || CAST([NULL] AS INTEGER[]) ELSE numbers END AS numbers FROM (SELECT *, CAST(draw_id AS BIGINT) AS o FROM draws))
        SELECT key, CASE WHEN draw_id = '' THEN 'draw_id cannot be empty' WHEN len(numbers) = 0 THEN 'A draw must contain at least one number' WHEN len(list_filter(numbers, lambda x: x IS NULL)) > 0 THEN 'All lottery numbers must be integers'
        WHEN len(list_filter(numbers, lambda x: x <= 0)) > 0 THEN 'Lottery numbers must be positive' WHEN len(list_distinct(numbers)) <> len(numbers) THEN 'Lottery numbers must be unique' ELSE 'valid' END AS verdict FROM broken""",
    "score_numbers": f"WITH {BASE}, {SCORES} SELECT * FROM scores",
    "score_with_recency": f"WITH {BASE} SELECT number, (0.7e0 * (CAST(count AS DOUBLE) / greatest(max(count) OVER (), 1)) + 0.3e0 * CASE WHEN number % 3 <> 0 THEN (number % 5) / 4e0 ELSE 0e0 END) / (0.7e0 + 0.3e0) AS score FROM counts",
    "rank_numbers": f"WITH {BASE}, {SCORES} SELECT number, score, CAST(row_number() OVER (ORDER BY score DESC, number) AS INTEGER) AS rank FROM scores",
    "ticket_overlap": f"{PAIRS} SELECT ord, CAST(len(list_intersect(numbers, other)) AS BIGINT) AS overlap FROM pairs",
    "ticket_jaccard": f"{PAIRS} SELECT ord, CAST(len(list_intersect(numbers, other)) AS DOUBLE) / len(list_distinct(numbers || other)) AS jaccard FROM pairs",
    "distinct_ticket_lists": f"{LISTS}, chosen AS (SELECT * FROM lists) {EXPLODED}",
    "optimize_tickets": f"{LISTS}, chosen AS (SELECT list, {_greedy('tickets')} AS tickets FROM lists) {EXPLODED}",
    "select_tickets": f"""WITH {BASE}, firsts AS (SELECT numbers, min(ord) AS first FROM draws GROUP BY numbers),
        one AS (SELECT {_greedy("list(numbers ORDER BY first)")} AS tickets FROM firsts)
        SELECT CAST(pos - 1 AS BIGINT) AS pos, array_to_string(tickets[pos], ',') AS ticket FROM one, range(1, len(tickets) + 1) AS r(pos)""",
    "csv_rows": """WITH made AS (SELECT o_orderkey AS k, CASE WHEN k % 2 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date FROM orders),
        listed AS (SELECT k, date, CASE WHEN k % 11 = 6 THEN '' ELSE CAST(k AS VARCHAR) END AS draw_id,
            CASE k % 11 WHEN 1 THEN [] WHEN 2 THEN ['1', NULL, '3'] WHEN 3 THEN [] WHEN 4 THEN [CAST(k % 7 + 1 AS VARCHAR), CAST(k % 7 + 1 AS VARCHAR)] WHEN 5 THEN ['4', '0']
            ELSE [CAST(k % 7 + 1 AS VARCHAR), CAST(k % 5 + 11 AS VARCHAR), CAST(k % 3 + 31 AS VARCHAR)] END AS numbers FROM made)
        SELECT k AS ord, draw_id, array_to_string(numbers, ',') AS numbers, date,
            CASE k % 11 WHEN 1 THEN 'numbers cannot be empty' WHEN 2 THEN 'numbers must contain integers' WHEN 3 THEN 'A draw must contain at least one number' WHEN 4 THEN 'Lottery numbers must be unique'
            WHEN 5 THEN 'Lottery numbers must be positive' WHEN 6 THEN 'draw_id cannot be empty' END AS error FROM listed""",
    "walk_forward_splits": f"WITH {BASE}, {SIZES} SELECT split_id, CAST(train + split_id * test AS BIGINT) AS train_size, CAST(test AS BIGINT) AS test_size, ord, draw_id FROM test_rows",
    "sql_walk_forward": f"WITH {BASE}, {SIZES} SELECT split_id, CAST(train + split_id * test AS BIGINT) AS train_size, count(*) AS draws, CAST(sum(len(numbers)) AS BIGINT) AS numbers, min(ord) AS first_ord, max(ord) AS last_ord FROM test_rows GROUP BY ALL",
    "walk_forward_frequency": f"WITH {BASE}, {SIZES} SELECT split_id, number, count FROM train_counts",
    "generate_tickets": f"WITH {BASE}, {SCORES}, one AS (SELECT 0 AS split_id, * FROM scores), {_race('one', str(SEED))} SELECT ticket_no, array_to_string(ticket, ',') AS ticket FROM tickets",
    "baseline_tickets": f"""WITH requests AS (SELECT s_suppkey AS request_id, unnest(range(s_suppkey % 3 + 1)) AS ticket_no, s_suppkey % 4 + 1 AS low, s_suppkey % 11 + 37 AS high FROM supplier),
        uniform AS (SELECT request_id, ticket_no, number, {_uniform("baseline", f"'{SEED}/' || request_id")} AS u FROM (SELECT request_id, ticket_no, unnest(range(low, high + 1)) AS number FROM requests)),
        keyed AS (SELECT *, row_number() OVER (PARTITION BY request_id, ticket_no ORDER BY u, number) AS k FROM uniform)
        SELECT request_id, ticket_no, array_to_string(list(number ORDER BY number), ',') AS ticket FROM keyed WHERE k <= 6 GROUP BY request_id, ticket_no""",
    "reservoir_tickets": f"WITH one AS (SELECT 0 AS split_id, p_partkey + 1 AS number, CAST(p_retailprice AS DOUBLE) AS score FROM part), {_race('one', str(SEED))} SELECT ticket_no, array_to_string(ticket, ',') AS ticket FROM tickets",
    "recommend_many": f"""WITH {BASE}, {SCORES}, one AS (SELECT 0 AS split_id, * FROM scores), {_race('one', str(SEED), MANY)},
        masks AS (SELECT {MASK.format("ticket")} AS m, ticket, first FROM firsts), chosen AS (SELECT {_masks("list(m ORDER BY first)", 500, 3)} AS c FROM masks)
        SELECT CAST(list_position(c, m) - 1 AS BIGINT) AS pos, array_to_string(ticket, ',') AS ticket FROM masks, chosen WHERE list_contains(c, m)""",
    "diverse_draws": f"""WITH {BASE}, masks AS (SELECT {MASK.format("numbers")} AS m, numbers, min(ord) AS first FROM draws GROUP BY ALL), chosen AS (SELECT {_masks("list(m ORDER BY first)", 100_000, 2)} AS c FROM masks),
        places AS (SELECT c[i] AS m, CAST(i - 1 AS BIGINT) AS pos FROM chosen, range(1, len(c) + 1) AS r(i))
        SELECT pos, array_to_string(numbers, ',') AS ticket FROM masks JOIN places USING (m)""",
    "number_gaps": f"WITH {BASE} SELECT ord, number, coalesce(ord - lag(ord) OVER (PARTITION BY number ORDER BY ord) - 1, -1) AS gap FROM (SELECT ord, unnest(numbers) AS number FROM draws)",
    "frequency_cube": f"""WITH {BASE}, each AS (SELECT unnest(numbers) AS number, CAST(substr(date, 1, 4) AS INTEGER) AS year, CAST(substr(date, 6, 2) AS INTEGER) AS month FROM draws)
        SELECT coalesce(number, 0) AS number, coalesce(year, 0) AS year, coalesce(month, 0) AS month, CAST(grouping(number, year, month) AS INTEGER) AS grouping, count(*) AS count FROM each
        GROUP BY GROUPING SETS ((number, year, month), (number, year), (number), (year), ())""",
    "pair_cube": f"""WITH {BASE}, each AS (SELECT a AS first, b AS second, CAST(substr(date, 1, 4) AS INTEGER) AS year FROM draws, unnest(numbers) AS u(a), unnest(numbers) AS v(b) WHERE a < b)
        SELECT coalesce(first, 0) AS first, coalesce(second, 0) AS second, coalesce(year, 0) AS year, CAST(grouping(first, second, year) AS INTEGER) AS grouping, count(*) AS count FROM each GROUP BY GROUPING SETS ((first, second, year), (first, second), ())""",
    "latest_draw_before_events": f"""WITH {BASE}, days AS (SELECT epoch_us(CAST(date AS TIMESTAMP)) AS since, max(ord) AS ord, max_by(draw_id, ord) AS draw_id FROM draws GROUP BY date), {STRETCHED}
        SELECT event_id, coalesce(ord, -1) AS ord, coalesce(draw_id, '') AS draw_id FROM stretched ASOF LEFT JOIN days ON moment >= since""",
    "events_in_test_spans": f"""WITH {BASE}, {SIZES}, {STRETCHED}, spans AS (SELECT split_id, min(epoch_us(CAST(date AS TIMESTAMP))) AS b, max(epoch_us(CAST(date AS TIMESTAMP))) + 86400000000 AS e FROM test_rows JOIN draws USING (ord) GROUP BY split_id)
        SELECT split_id, event_id FROM spans JOIN stretched ON moment >= b AND moment < e""",
    "gap_recency_scores": f"""WITH {BASE}, last_seen AS (SELECT number, (SELECT count(*) FROM draws) - 1 - max(ord) AS gap FROM (SELECT ord, unnest(numbers) AS number FROM draws) GROUP BY number)
        SELECT number, gap, (0.7e0 * (CAST(count AS DOUBLE) / greatest(max(count) OVER (), 1)) + 0.3e0 * (1e0 / (1e0 + gap))) / (0.7e0 + 0.3e0) AS score FROM counts JOIN last_seen USING (number)""",
    "walk_forward_each_draw": f"""WITH {BASE}, {EACH}, gaps AS (SELECT *, train - 1 + split_id - last_ord AS gap FROM train_counts, sizes)
        SELECT split_id, number, CAST(count AS BIGINT) AS count, CAST(gap AS BIGINT) AS gap, (0.7e0 * (CAST(count AS DOUBLE) / greatest(max(count) OVER (PARTITION BY split_id), 1)) + 0.3e0 * (1e0 / (1e0 + gap))) / (0.7e0 + 0.3e0) AS score FROM gaps""",
    "backtest_each_draw": f"{_cases(_walk(EACH))}, s AS (SELECT {SUMMARY} FROM cases) SELECT (SELECT n FROM sizes) AS dataset_size, *, average_matches - baseline_average_matches AS average_difference, total_matches - baseline_total_matches AS total_difference FROM s",
    "recommend": f"WITH {BASE}, {SCORES}, one AS (SELECT 0 AS split_id, * FROM scores), {_race('one', str(SEED))}, {RECOMMENDED} SELECT CAST(pos - 1 AS BIGINT) AS pos, array_to_string(chosen[pos], ',') AS ticket FROM recommended, range(1, len(chosen) + 1) AS r(pos)",
    "backtest_matches": f"{WALK} SELECT split_id, ord, CAST(pos - 1 AS BIGINT) AS pos, CAST(len(list_intersect(chosen[pos], numbers)) AS BIGINT) AS matches FROM test_rows JOIN recommended USING (split_id), range(1, len(chosen) + 1) AS r(pos)",
    "backtest_cases": f"{CASES} SELECT * FROM cases",
    "backtest_variants": f"{CASES} SELECT * FROM cases WHERE best_match >= 3",
    "span_sketches": f"""WITH {BASE}, {SIZES}, spans AS (SELECT split_id AS span_id, min(date) AS a, max(date) AS b FROM test_rows JOIN draws USING (ord) GROUP BY split_id)
        SELECT span_id, count(*) AS n, true AS distinct_near, true AS quartiles_near, true AS top_exact FROM spans JOIN orders ON strftime(o_orderdate, '%Y-%m-%d') BETWEEN a AND b GROUP BY span_id""",
    "backtest_summary": f"{CASES} SELECT {SUMMARY} FROM cases",
    "match_thresholds": f"{CASES} SELECT threshold, CAST(count(*) FILTER (best_match >= threshold) AS BIGINT) AS match_count, CAST(count(*) FILTER (baseline_best_match >= threshold) AS BIGINT) AS baseline_match_count FROM cases, range(1, 7) AS r(threshold) GROUP BY threshold",
    "backtest_report": f"{CASES}, s AS (SELECT {SUMMARY} FROM cases) SELECT (SELECT n FROM sizes) AS dataset_size, *, average_matches - baseline_average_matches AS average_difference, total_matches - baseline_total_matches AS total_difference FROM s",
    "entries_desc": "SELECT event_id AS id, event_type AS message, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events ORDER BY id DESC",
    "entry_by_id": "SELECT event_id AS id, event_type AS message, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events WHERE event_id = 17",
}
