"""The registered queries in DuckDB's SQL, written from their definitions."""

from __future__ import annotations

SIGMA = 4.0

_EVENTS = """series AS (
  SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos, value::DOUBLE AS v FROM events)"""
_ORDERS = """series AS (
  SELECT o_custkey::VARCHAR AS series_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pos, o_totalprice::DOUBLE AS v FROM orders)"""


def _base(series: str = _EVENTS, rate: float = 1.0, name: str = "base", first: bool = True) -> str:
    own = f"{series}, " if first else ""
    return own + f"""{name} AS (
  SELECT series_id, pos, v, n, {rate} / n AS k, exp(-({rate} / n) * (n - pos)) AS w
  FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series))"""


def _rank(a: str) -> str:
    return f"list_transform({a}, lambda x: list_position(list_sort({a}), x))"


def _pre(p: str, m: int) -> str:
    return _rank(f"{p}[1:{m - 1}]")


def _suf(p: str, m: int) -> str:
    return _rank(f"{p}[2:{m}]")


def _text(p: str) -> str:
    return f"'[' || array_to_string({p}, ', ') || ']'"


def _windows(m: int, base: str = "base", out: str = "w") -> str:
    return f"""{out}{m} AS (
  SELECT series_id, pos, n, k, w, {_rank('a')} AS p FROM (
    SELECT *, list(v) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN {m - 1} PRECEDING AND CURRENT ROW) AS a FROM {base})
  WHERE len(a) = {m} AND len(list_distinct(a)) = {m})"""


def _support(m: int, w: str = "w", out: str = "s") -> str:
    return f"""{out}{m} AS (
  SELECT series_id, {m} AS m, p, sum(w) AS support, count(*) AS cnt, min(pos) AS first_pos, max(pos) AS last_pos, max(n) AS n, max(k) AS k
  FROM {w}{m} GROUP BY series_id, p)"""


def _frequent(m: int, sigma: float, s: str = "s", out: str = "f") -> str:
    if m == 2:
        return f"{out}2 AS (SELECT * FROM {s}2 WHERE support >= {sigma})"
    known = " AND ".join(f"EXISTS (SELECT 1 FROM {out}{m - 1} x WHERE x.series_id = {s}{m}.series_id AND x.p = {part(f'{s}{m}.p', m)})" for part in (_pre, _suf))
    return f"{out}{m} AS (SELECT * FROM {s}{m} WHERE support >= {sigma} AND {known})"


def _levels(m: int, sigma: float = SIGMA, base: str = "base", tag: str = "") -> str:
    w, s, f = f"w{tag}", f"s{tag}", f"f{tag}"
    return ", ".join(x for n in range(2, m + 1) for x in (_windows(n, base, w), _support(n, w, s), _frequent(n, sigma, s, f)))


_SHOWN = f"series_id, m, {_text('p')} AS pattern, round(support, 6) AS support, cnt, first_pos, last_pos"
_UP_TO = {m: f"WITH {_base()}, {_levels(m)}" for m in (2, 3, 4, 5, 6)}


def _pairs(m: int, extra: str = "") -> str:
    return f"""pairs AS (
  SELECT a.series_id, a.m, a.n, a.k, a.p AS p, b.p AS q, a.support AS ps, b.support AS qs, a.cnt AS pc, b.cnt AS qc,
    a.first_pos AS pf, b.first_pos AS qf, a.last_pos AS pl, b.last_pos AS ql
  FROM f{m} a JOIN f{m} b ON a.series_id = b.series_id AND {_suf('a.p', m)} = {_pre('b.p', m)}{extra})"""


def _group(p: str, m: int) -> str:
    if m == 2:
        return f"CASE WHEN {p}[1] < {p}[2] THEN 1 ELSE 2 END"
    return f"CASE WHEN {p}[1] < {p}[2] THEN CASE WHEN {p}[2] < {p}[3] THEN 1 ELSE 2 END ELSE CASE WHEN {p}[2] < {p}[3] THEN 3 ELSE 4 END END"


def _union(levels, select: str) -> str:
    return " UNION ALL ".join(f"SELECT {select} FROM f{m}" for m in levels)


_BOUNDS = """b AS (
  SELECT *, greatest(pf + 1, qf) AS low, least(pl + 1, ql) AS high, least(ps * exp(k), qs) AS residual,
    least(pc, qc) * exp(-k * (n - least(pl + 1, ql))) AS card FROM pairs)"""

# Occurrences counted for each pair by its own range.
_TIERS = f"""WITH {_base(_ORDERS)}, {_levels(3, 1.0)}, {_pairs(3)}, {_BOUNDS},
c AS (
  SELECT *, row_number() OVER () AS id,
    CASE WHEN residual + 1e-12 < 1.5 THEN 'residual' WHEN low > high THEN 'span' WHEN card + 1e-12 < 1.5 THEN 'card' END AS early FROM b),
r AS (
  SELECT c.id, least(count(*) FILTER (WHERE o.p = c.p AND o.pos BETWEEN c.low - 1 AND c.high - 1), count(*) FILTER (WHERE o.p = c.q AND o.pos BETWEEN c.low AND c.high))
    * exp(-any_value(c.k) * (any_value(c.n) - any_value(c.high))) AS ranged
  FROM c LEFT JOIN w3 o ON o.series_id = c.series_id WHERE early IS NULL GROUP BY c.id)
SELECT CASE WHEN early IS NOT NULL THEN early WHEN ranged + 1e-12 < 1.5 THEN 'range' ELSE 'pass' END AS tier, count(*) AS pairs,
  round(sum(residual), 4) AS residual, round(sum(card), 4) AS card, round(sum(ranged), 4) AS ranged
FROM c LEFT JOIN r USING (id) GROUP BY ALL"""


_FOUR = f"{_UP_TO[4]}, {_pairs(4)}, {_BOUNDS}"

_SKEW = f"""{_FOUR}
SELECT series_id, m, count(*) AS pairs, round(count(*) FILTER (WHERE greatest(pc, qc) >= 256 AND greatest(pc, qc) >= 8 * least(pc, qc)) / count(*), 6) AS skew_rate FROM pairs GROUP BY ALL"""

_PRUNE = f"""{_FOUR}, x AS (SELECT series_id, m, residual + 1e-12 < {SIGMA} AS r, low > high AS s, card + 1e-12 < {SIGMA} AS c FROM b)
SELECT series_id, m, count(*) AS pairs, count(*) FILTER (WHERE r) AS by_residual, count(*) FILTER (WHERE s) AS by_span, count(*) FILTER (WHERE c) AS by_card,
  round(count(*) FILTER (WHERE r OR s OR c) / count(*), 6) AS prune_rate FROM x GROUP BY ALL"""

# Levels of each threshold: windows and supports once, closures apart.
_SWEEP, _SWEEP3 = [8.0, 30.0, 90.0, 200.0], [40.0, 48.0, 52.0, 56.0, 60.0, 200.0]
#: Levels written out; the last is empty at the scale of the comparison.
_TOP = 9


def _sweep(sigmas, top: int, shown) -> str:
    shared = [x for m in range(2, top + 1) for x in (_windows(m), _support(m))]
    closures = [_frequent(m, sigma, out=f"g{i}_") for i, sigma in enumerate(sigmas) for m in range(2, top + 1)]
    parts = [f"SELECT series_id, {sigma}::DOUBLE AS minsup, m, support FROM g{i}_{m}" for i, sigma in enumerate(sigmas) for m in shown]
    return f"WITH {_base()}, {', '.join(shared + closures)}, every AS ({' UNION ALL '.join(parts)})"


# The same patterns of three ranks by comparing three neighbours.
_FUSED = """fused AS (
  SELECT series_id, [1 + (x > y)::INT + (x > v)::INT, 1 + (y > x)::INT + (y > v)::INT, 1 + (v > x)::INT + (v > y)::INT] AS p, w FROM (
    SELECT *, lag(v, 2) OVER o AS x, lag(v) OVER o AS y FROM base WINDOW o AS (PARTITION BY series_id ORDER BY pos))
  WHERE x <> y AND x <> v AND y <> v),
neighbours AS (SELECT series_id, p, round(sum(w), 6) AS support FROM fused GROUP BY ALL)"""


def _lines(decimals: int) -> str:
    line = f"printf('\"%s\",%.{decimals}f', {_text('p')}, support)"
    return f"sha256(string_agg({line}, chr(10) ORDER BY {line}))"


_STRATEGIES = f"""WITH {_base()}, {_windows(3)}, {_support(3)}, {_FUSED},
a AS (SELECT series_id, p, round(support, 6) AS support FROM s3),
x AS (SELECT series_id, {_lines(10)} AS h10, {_lines(6)} AS h6 FROM a GROUP BY series_id),
y AS (SELECT series_id, {_lines(10)} AS h10, {_lines(6)} AS h6 FROM neighbours GROUP BY series_id),
d AS (
  SELECT coalesce(a.series_id, b.series_id) AS series_id, bool_and(a.p IS NOT NULL AND b.p IS NOT NULL) AS same_set, max(abs(a.support - b.support)) AS diff
  FROM a FULL JOIN neighbours b ON a.series_id = b.series_id AND a.p = b.p GROUP BY 1),
t AS (
  SELECT CASE WHEN x.h10 = y.h10 THEN 'r' WHEN x.h6 = y.h6 THEN 'n' WHEN same_set AND diff <= 1e-6 THEN 't' ELSE 'f' END AS kind
  FROM d LEFT JOIN x USING (series_id) LEFT JOIN y USING (series_id))
SELECT count(*) FILTER (WHERE kind = 'r') AS raw, count(*) FILTER (WHERE kind = 'n') AS normalized, count(*) FILTER (WHERE kind = 't') AS tolerance, count(*) FILTER (WHERE kind = 'f') AS failed FROM t"""
_CASES = f"""{_UP_TO[3]}, a AS (SELECT series_id, p, round(support, 6) AS support FROM f3),
b AS (
  SELECT series_id, p, support + CASE series_id WHEN 'click' THEN 1e-8 WHEN 'error' THEN 6e-7 WHEN 'purchase' THEN 0.5 ELSE 0 END AS support
  FROM a WHERE (series_id <> 'signup' OR p[1] <> 1) AND series_id <> 'view'),
x AS (SELECT series_id, {_lines(10)} AS h10, {_lines(6)} AS h6 FROM a GROUP BY series_id),
y AS (SELECT series_id, {_lines(10)} AS h10, {_lines(6)} AS h6 FROM b GROUP BY series_id),
g AS (
  SELECT coalesce(a.series_id, b.series_id) AS series_id, count(a.p) AS n_a, count(b.p) AS n_b, count(*) FILTER (WHERE b.p IS NULL) AS only_a, count(*) FILTER (WHERE a.p IS NULL) AS only_b,
    coalesce(max(abs(a.support - b.support)), 0) AS diff FROM a FULL JOIN b ON a.series_id = b.series_id AND a.p = b.p GROUP BY 1)
SELECT series_id, n_a, n_b, only_a, only_b, round(diff, 4) AS max_diff,
  CASE WHEN x.h10 = y.h10 THEN 'SHA256_MATCH' WHEN x.h6 = y.h6 THEN 'NORMALIZED_SHA256_MATCH' WHEN n_a = 0 OR n_b = 0 THEN 'MISSING_FILE'
    WHEN only_a + only_b > 0 THEN 'PATTERN_SET_MISMATCH' WHEN diff > 1e-6 THEN 'SUPPORT_MISMATCH' ELSE 'CONTENT_MATCH_TOLERANCE' END AS status
FROM g LEFT JOIN x USING (series_id) LEFT JOIN y USING (series_id)"""


def _mass(m: int) -> str:
    return f"""SELECT a.series_id, a.m, count(DISTINCT a.p) AS patterns, count(b.p) AS pairs, round(count(b.p) / count(DISTINCT a.p), 6) AS fan_out
FROM f{m} a LEFT JOIN f{m} b ON a.series_id = b.series_id AND {_suf('a.p', m)} = {_pre('b.p', m)} GROUP BY a.series_id, a.m"""


def _trace(m: int) -> str:
    following = f"(SELECT count(*) FROM f{m + 1} x WHERE x.series_id = a.series_id)"
    return f"""SELECT a.series_id, a.m, count(*) AS input_patterns, sum(cnt)::BIGINT AS input_occurrences,
  round(sum(cnt) / sum(last_pos - first_pos + 1), 9) AS density, {following} AS output_patterns,
  (SELECT count(*) FROM f{m} x JOIN f{m} y ON x.series_id = y.series_id AND {_suf('x.p', m)} = {_pre('y.p', m)} WHERE x.series_id = a.series_id) AS pairs
FROM f{m} a GROUP BY a.series_id, a.m"""


_RUNS = """s AS (
  SELECT l_returnflag AS Dataset, 'c' || l_linenumber AS Configuration, count(l_extendedprice) AS n_runs, avg(l_extendedprice) AS mean,
    coalesce(stddev_samp(l_extendedprice), 0) AS std, median(l_extendedprice) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
    exp(avg(ln(l_extendedprice))) AS geo_mean FROM lineitem GROUP BY ALL)"""

_TWICE = f"WITH {_base()}, {_base(rate=2.0, name='base2', first=False)}, {_levels(4)}, {_levels(4, base='base2', tag='t')}"

SQL = {
    "series_weights": f"WITH {_base()} SELECT series_id, pos, v, n, round(w, 9) AS w FROM base",
    "step_directions": f"""WITH {_EVENTS}, d AS (SELECT *, lag(v) OVER (PARTITION BY series_id ORDER BY pos) AS b FROM series)
SELECT series_id, count(*) FILTER (WHERE v > b) AS ups, count(*) FILTER (WHERE v < b) AS downs, count(*) FILTER (WHERE b IS NULL OR v = b) AS ties FROM d GROUP BY series_id""",
    "seed_support_m2": f"{_UP_TO[2]} SELECT {_SHOWN} FROM f2",
    **{f"window_ranks_m{m}": f"WITH {_base()}, {_windows(m)} SELECT series_id, pos, {_text('p')} AS pattern FROM w{m}" for m in (3, 4, 5)},
    **{f"support_threshold_m{m}": f"WITH {_base()}, {_windows(m)}, {_support(m)} SELECT {_SHOWN} FROM s{m} WHERE support >= {SIGMA}" for m in (3, 4, 5)},
    **{f"closure_m{m}": f"{_UP_TO[m]} SELECT {_SHOWN} FROM f{m}" for m in (3, 4, 5, 6)},
    **{
        f"candidate_pairs_m{m}": f"""{_UP_TO[m]}, {_pairs(m)} SELECT series_id, {_text('p')} AS p, {_text('q')} AS q,
  (({_group('p', m)}) IN (1, 3) AND ({_group('q', m)}) IN (1, 2)) OR (({_group('p', m)}) IN (2, 4) AND ({_group('q', m)}) IN (3, 4)) AS compatible FROM pairs"""
        for m in (3, 4)
    },
    **{f"position_fusion_m{m}": f"WITH {_base()}, {_windows(m)}, {_support(m)} SELECT {_SHOWN} FROM s{m}" for m in (3, 4)},
    "closure_all": f"WITH {_base()}, {_levels(9)} {_union(range(2, 10), _SHOWN)}",
    "closure_orders": f"WITH {_base(_ORDERS)}, {_levels(8, 2.5)} {_union(range(2, 9), _SHOWN)}",
    "mine_threshold": f"WITH {_base()}, " + ", ".join(f"{_windows(m)}, {_support(m)}" for m in (2, 3, 4)) + " " + " UNION ALL ".join(f"SELECT {_SHOWN} FROM s{m} WHERE support >= {SIGMA}" for m in (2, 3, 4)),
    "minsup_sweep": f"{_sweep(_SWEEP3, _TOP, range(2, _TOP + 1))} SELECT series_id, minsup, count(*) AS patterns, max(m) AS longest, round(sum(support), 6) AS mass FROM every GROUP BY ALL",
    "sweep_closure": f"{_sweep(_SWEEP, _TOP, range(2, _TOP + 1))} SELECT series_id, minsup, m, count(*) AS patterns, round(sum(support), 6) AS mass FROM every GROUP BY ALL",
    "prefix_suffix_keys": f"{_UP_TO[4]} SELECT series_id, {_text('p')} AS pattern, {_text(_pre('p', 4))} AS pre, {_text(_suf('p', 4))} AS suf FROM f4",
    "pair_mass_by_level": f"{_UP_TO[4]} " + " UNION ALL ".join(_mass(m) for m in (2, 3, 4)),
    "group_labels": f"{_UP_TO[3]} SELECT series_id, {_text('p')} AS pattern, {_group('p', 3)} AS grp FROM f3",
    "bound_tiers": _TIERS,
    "skew_rate": _SKEW,
    "prune_rate": _PRUNE,
    "occurrence_density": f"{_UP_TO[4]} SELECT series_id, m, sum(cnt)::BIGINT AS occurrences, sum(last_pos - first_pos + 1)::BIGINT AS covered, round(sum(cnt) / sum(last_pos - first_pos + 1), 9) AS density FROM f4 GROUP BY ALL",
    "work_counters": f"""{_UP_TO[3]}, {_pairs(3)},
o AS (SELECT w3.series_id, w3.pos FROM w3 JOIN f3 ON f3.series_id = w3.series_id AND f3.p = w3.p),
c AS (SELECT series_id, count(*) AS pair_checks, sum(CASE WHEN p[1] = q[3] THEN 2 ELSE 1 END)::BIGINT AS candidates FROM pairs GROUP BY series_id),
x AS (SELECT a.series_id, count(*) AS support_ops FROM o a JOIN o b ON a.series_id = b.series_id AND b.pos = a.pos + 1 GROUP BY a.series_id)
SELECT f.series_id, f.m, f.n AS freq_patterns, coalesce(pair_checks, 0) AS pair_checks, coalesce(candidates, 0) AS candidates, coalesce(pair_checks, 0) AS fusions, coalesce(support_ops, 0) AS support_ops
FROM (SELECT series_id, m, count(*) AS n FROM f3 GROUP BY ALL) f LEFT JOIN c USING (series_id) LEFT JOIN x USING (series_id)""",
    "generation_trace": f"WITH {_base()}, {_levels(_TOP)} " + " UNION ALL ".join(_trace(m) for m in range(2, _TOP)),
    "canonical_text": f"{_UP_TO[3]} SELECT series_id, printf('\"%s\",%.10f', {_text('p')}, round(support, 6)) AS line FROM f3",
    "compare_sets": f"""{_TWICE}, j AS (
  SELECT coalesce(a.series_id, b.series_id) AS series_id, a.support AS sa, b.support AS sb FROM f4 a FULL JOIN ft4 b ON a.series_id = b.series_id AND a.p = b.p),
g AS (SELECT series_id, count(sa) AS n_a, count(sb) AS n_b, count(*) FILTER (WHERE sb IS NULL) AS only_a, count(*) FILTER (WHERE sa IS NULL) AS only_b,
  round(coalesce(max(abs(sa - sb)), 0), 6) AS max_diff FROM j GROUP BY series_id)
SELECT *, CASE WHEN n_a = 0 OR n_b = 0 THEN 'MISSING_FILE' WHEN only_a + only_b > 0 THEN 'PATTERN_SET_MISMATCH' WHEN max_diff > 1e-6 THEN 'SUPPORT_MISMATCH' ELSE 'SHA256_MATCH' END AS status FROM g""",
    "compare_strategies": _STRATEGIES,
    "status_cases": _CASES,
    "common_patterns": f"{_UP_TO[4]}, t AS (SELECT series_id, m, {_text('p')} AS pattern FROM f3 UNION ALL SELECT series_id, m, {_text('p')} FROM f4) "
    + " INTERSECT ".join(f"SELECT m, pattern FROM t WHERE series_id = '{x}'" for x in ("click", "purchase", "view")),
    "variant_ratios": """WITH t AS (SELECT l_returnflag, l_suppkey, l_linenumber AS c, avg(l_extendedprice) AS t FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL)
SELECT a.l_returnflag, a.l_suppkey, round(a.t, 6) AS base, round(b.t, 6) AS variant, round(a.t / b.t, 6) AS ratio
FROM t a JOIN t b ON a.l_returnflag = b.l_returnflag AND a.l_suppkey = b.l_suppkey AND a.c = 1 AND b.c = 2""",
    "set_differences": f"""{_UP_TO[4]}, t AS (SELECT series_id, {_text('p')} AS p, round(support, 6) AS support FROM f4),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY p) AS r FROM t WHERE support < 52)
SELECT series_id, string_agg(p, ';' ORDER BY p) AS only_a, '' AS only_b FROM r WHERE r <= 5 GROUP BY series_id""",
    "normalized_sha": f"{_UP_TO[3]}, t AS (SELECT series_id, printf('\"%s\",%.4f', {_text('p')}, round(support, 4)) AS line FROM f3) SELECT series_id, sha256(string_agg(line, chr(10) ORDER BY line)) AS sha256 FROM t GROUP BY series_id",
    "repeat_series": f"WITH {_EVENTS}, n AS (SELECT series_id, count(*) AS n FROM series GROUP BY series_id) SELECT series_id, r.r * n + pos AS pos, v FROM series JOIN n USING (series_id), (SELECT unnest(range(3)) AS r) r",
    "unpivot_clients": " UNION ALL ".join(f"SELECT '{c}' AS series_id, l_orderkey * 10 + l_linenumber AS pos, {c}::DOUBLE AS v FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "interleave_series": "SELECT 'both' AS series_id, (o_orderkey - 1) * 2 + 1 AS pos, o_totalprice::DOUBLE AS v FROM orders UNION ALL SELECT 'both', (o_orderkey - 1) * 2 + 2, o_custkey * 2.0::DOUBLE FROM orders",
    "concatenate_series": f"WITH {_EVENTS} SELECT 'joined' AS series_id, row_number() OVER (ORDER BY series_id, pos) AS pos, v FROM series WHERE series_id IN ('click', 'purchase', 'view')",
    "concatenated_sizes": f"WITH {_EVENTS} SELECT 'clients_3' AS series_id, row_number() OVER (ORDER BY series_id, pos) AS pos, v FROM series WHERE series_id IN ('click', 'error', 'purchase') UNION ALL SELECT 'clients_1', pos, v FROM series WHERE series_id = 'click'",
    "number_text_lines": f"WITH {_EVENTS} SELECT series_id, (pos - 1) // 20 AS line_no, string_agg(floor(v)::BIGINT::VARCHAR, ' ' ORDER BY pos) AS value FROM series GROUP BY ALL",
    "client_stats": f"WITH {_EVENTS} SELECT series_id AS client, count(*) AS n_rows, count(*) FILTER (WHERE v <> 0) AS non_zero, min(pos) FILTER (WHERE v <> 0) AS first_non_zero_row, greatest(0.0::DOUBLE, max(v)) AS max_value FROM series GROUP BY series_id",
    "bench_summary": f"WITH {_RUNS} SELECT Dataset, Configuration, n_runs, " + ", ".join(f"round({c}, 4) AS {c}" for c in ("mean", "std", "median", "min", "max", "geo_mean")) + " FROM s",
    "best_config": f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY Dataset ORDER BY median, Configuration) AS r FROM s) SELECT Dataset, Configuration AS best, round(median, 4) AS best_value FROM r WHERE r = 1",
    "win_counts": f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY Dataset ORDER BY median, Configuration) AS r FROM s) SELECT Configuration, count(*) FILTER (WHERE r = 1) AS wins FROM r GROUP BY Configuration",
    "relative_to_baseline": f"WITH {_RUNS} SELECT a.Dataset, a.Configuration, round(a.median / b.median, 6) AS ratio FROM s a JOIN s b ON a.Dataset = b.Dataset AND b.Configuration = 'c1'",
    "pivot_methods": f"WITH {_RUNS} SELECT Dataset, " + ", ".join(f"round(max(CASE WHEN Configuration = '{c}' THEN median END), 4) AS {c}" for c in ("c1", "c2", "c3")) + " FROM s GROUP BY Dataset",
    "unstable_counters": "SELECT l_returnflag AS Dataset, 'c' || l_linenumber AS Configuration, 'run' AS counter FROM lineitem GROUP BY ALL HAVING min(l_suppkey % 10) <> max(l_suppkey % 10) UNION ALL SELECT l_returnflag, 'c' || l_linenumber, 'Fusions' FROM lineitem GROUP BY ALL HAVING min(l_quantity) <> max(l_quantity)",
    "same_work": "SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS variants, count(DISTINCT o_orderstatus) = 1 AS same FROM orders GROUP BY o_orderpriority",
    "run_averages": "SELECT l_orderkey AS Dataset, arg_min(l_quantity, l_extendedprice) AS Fusions, count(*) AS Runs, round(avg(l_extendedprice), 7) AS Time_s, round(avg(l_tax), 7) AS MaxMem_MB, round(coalesce(stddev_samp(l_extendedprice), 0), 7) AS Time_s_std, round(coalesce(stddev_samp(l_tax), 0), 7) AS MaxMem_MB_std FROM lineitem GROUP BY l_orderkey",
    "topk_patterns": f"{_UP_TO[4]}, r AS (SELECT series_id, p, round(support, 6) AS support, row_number() OVER (PARTITION BY series_id ORDER BY round(support, 6) DESC, p) AS rank FROM f4) SELECT series_id, {_text('p')} AS pattern, support, rank FROM r WHERE rank <= 10",
}
_NUMBERS = f"""WITH {_EVENTS}, lines AS (SELECT series_id, (pos - 1) // 20 AS line_no, string_agg(floor(v)::BIGINT::VARCHAR, ' ' ORDER BY pos) AS line FROM series GROUP BY ALL),
files AS (SELECT series_id || '.txt' AS file, string_agg(line || chr(10), '' ORDER BY line_no) AS content FROM lines GROUP BY series_id)"""
_FILES = "SELECT l_returnflag || '.txt' AS Dataset, l_linestatus, l_linenumber, round(min(l_extendedprice), 2) AS Time_s, max(l_quantity)::BIGINT AS Fusions FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL"

SQL |= {
    "closure_all_positions": SQL["closure_all"],
    "positions_by_range": f"WITH {_EVENTS} SELECT * FROM series",
    # Of a rising series only the pattern 1, 2, .., m occurs, at every position from m on.
    "closure_rising": f"""WITH {_base(_ORDERS)}, x AS (SELECT a.series_id, a.pos AS m, sum(b.w) AS support, count(*) AS cnt, min(b.pos) AS first_pos, max(b.pos) AS last_pos
  FROM base a JOIN base b ON a.series_id = b.series_id AND b.pos >= a.pos AND a.pos >= 2 GROUP BY ALL)
SELECT series_id, m::INT AS m, '[' || array_to_string(range(1, m + 1), ', ') || ']' AS pattern, round(support, 6) AS support, cnt, first_pos, last_pos FROM x WHERE support >= 0.5""",
    "canonical_files": f"{_UP_TO[3]}, t AS (SELECT series_id, {_text('p')} AS pattern, round(support, 6) AS support FROM f3) "
    + " UNION ALL ".join(f"SELECT series_id || '_minsup_{label}.csv' AS file, pattern, support FROM t WHERE support >= {sigma}" for label, sigma in (("4", 4), ("200", 200))),
    "text_files": f"WITH {_EVENTS} SELECT series_id || '.txt' AS series_id, pos, floor(v) AS v FROM series WHERE series_id IN ('click', 'view')",
    "file_checksums": f"{_NUMBERS} SELECT file, strlen(content) AS bytes, sha256(content) AS sha256 FROM files",
    "client_report": f"WITH {_EVENTS} SELECT series_id AS Client, count(*) AS Rows, count(*) FILTER (WHERE v <> 0) AS NonZero, min(pos) FILTER (WHERE v <> 0) AS FirstNonZeroRow, greatest(0.0::DOUBLE, max(v)) AS MaxValue, series_id || '.txt' AS OutputFile FROM series GROUP BY series_id",
    "semicolon_clients": "SELECT 'MT_001' AS series_id, o_orderkey AS pos, round(o_totalprice, 2)::DOUBLE AS v FROM orders UNION ALL SELECT 'MT_003', o_orderkey, o_orderkey::DOUBLE FROM orders",
    "run_files": f"WITH t AS ({_FILES}) SELECT Dataset, l_linenumber AS run, Time_s, Fusions, (SELECT string_agg(i::VARCHAR, ',' ORDER BY i) FROM range(1, 9) AS r(i) WHERE i NOT IN (SELECT l_linenumber FROM t WHERE l_linestatus = 'F')) AS missing FROM t WHERE l_linestatus = 'F'",
    "method_files": f"WITH t AS ({_FILES}) SELECT CASE l_linestatus WHEN 'F' THEN 'a' ELSE 'b' END AS method, replace(Dataset, '.txt', '') AS Dataset, 2.5::DOUBLE AS minsup, Time_s, Fusions FROM t WHERE l_linestatus = 'F' AND l_linenumber = 1 OR l_linestatus <> 'F' AND l_linenumber = 2",
    "text_patterns": f"{_UP_TO[4]} SELECT series_id, {_text('p')} AS pattern, p[4]::INT AS last, ceil(log2(cnt))::INT AS bits FROM f4",
    "result_differences": f"{_UP_TO[3]} SELECT series_id, 0::BIGINT AS part, count(*) AS lines_a, CASE series_id WHEN 'click' THEN count(*) FILTER (WHERE p[1] <> 1) ELSE count(*) END AS lines_b FROM f3 WHERE series_id IN ('click', 'view') GROUP BY series_id",
    "file_comparison": f"""{_CASES[: _CASES.index('SELECT series_id, n_a')].rstrip()},
fa AS (SELECT series_id, sha256('pattern,support' || chr(10) || string_agg(printf('"%s",%.10f', {_text('p')}, support) || chr(10), '' ORDER BY {_text('p')})) AS raw FROM a GROUP BY series_id),
fb AS (SELECT series_id, sha256('pattern,support' || chr(10) || string_agg(printf('"%s",%.10f', {_text('p')}, support) || chr(10), '' ORDER BY {_text('p')})) AS raw FROM b GROUP BY series_id)
SELECT g.series_id || '_minsup_4.csv' AS file, round(diff, 4) AS max_diff, fa.raw AS raw_a, fb.raw AS raw_b,
  CASE WHEN fa.raw = fb.raw THEN 'SHA256_MATCH' WHEN x.h6 = y.h6 THEN 'NORMALIZED_SHA256_MATCH' WHEN n_a = 0 OR n_b = 0 THEN 'MISSING_FILE'
    WHEN only_a + only_b > 0 THEN 'PATTERN_SET_MISMATCH' WHEN diff > 1e-6 THEN 'SUPPORT_MISMATCH' ELSE 'CONTENT_MATCH_TOLERANCE' END AS status
FROM g LEFT JOIN x USING (series_id) LEFT JOIN y USING (series_id) LEFT JOIN fa USING (series_id) LEFT JOIN fb USING (series_id)""",
    "summary_file": f"WITH {_base()}, {_levels(_TOP)}, u AS ({_union(range(2, _TOP + 1), 'series_id, m, support, n')}) SELECT series_id AS Dataset, {SIGMA}::DOUBLE AS minsup, max(n) AS Length, count(*) AS FreqPatterns, max(m)::BIGINT AS MaxPattern, round(sum(support), 6) AS Support FROM u GROUP BY series_id",
    "hot_medians": "SELECT l_linestatus, count(l_extendedprice) AS n_runs, round(median(l_extendedprice), 4) AS median, min(l_extendedprice) AS min, max(l_extendedprice) AS max FROM lineitem GROUP BY l_linestatus",
}
