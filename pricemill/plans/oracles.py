"""The registered queries in SQL, for an independent engine.

Written from the definitions, not from the Spark plans: whole tables, one statement each.
Double literals carry an exponent, since a bare decimal literal is exact in SQL.
"""

from __future__ import annotations

CATALOG = """
catalog AS (
  SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS sku,
    replace(p_brand, '#', '') || ' ' || p_name || ' ' || p_type || ' '
      || chr(CAST(97 + p_partkey % 8 AS INTEGER)) || CAST(10 + (p_partkey // 8) % 90 AS VARCHAR) AS name,
    replace(p_brand, '#', '') AS brand, p_type AS category,
    CAST(round(p_retailprice * 100) AS BIGINT) AS our,
    CAST(round(p_retailprice * 100) AS BIGINT) * (55 + p_partkey % 25) // 100 AS cost,
    CAST(p_partkey % 97 AS INTEGER) AS stock,
    CASE p_type WHEN 'ECONOMY' THEN -20e-1 WHEN 'MEDIUM' THEN -24e-1 WHEN 'STANDARD' THEN -28e-1
      WHEN 'PROMO' THEN -22e-1 WHEN 'SMALL' THEN -18e-1 WHEN 'LARGE' THEN -30e-1 END AS e
  FROM part)"""

FEED = f"""{CATALOG},
feed AS (
  SELECT c.sku, c.k, CAST(l_suppkey % 4 AS VARCHAR) AS competitor,
    c.our * (8500 + CAST(round(l_extendedprice * 100) AS BIGINT) % 3001) // 10000 AS price,
    l_returnflag <> 'R' AS in_stock, CAST(l_shipdate AS DATE) AS date,
    l_shipdate, l_orderkey, l_linenumber
  FROM lineitem JOIN catalog c ON l_partkey = c.k)"""

PRICES = f"""{FEED},
prices AS (
  SELECT sku, k, competitor, price, in_stock, date FROM feed
  QUALIFY row_number() OVER (PARTITION BY k, competitor, date
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1)"""

ANALYSIS = f"""{PRICES},
ends AS (
  SELECT *, first_value(price) OVER w AS first_price, count(*) OVER w AS points,
    row_number() OVER (PARTITION BY sku, competitor ORDER BY date DESC) AS rn
  FROM prices WINDOW w AS (PARTITION BY sku, competitor ORDER BY date
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
positions AS (
  SELECT sku, competitor, price AS latest, in_stock, points,
    CASE WHEN points < 2 THEN 0e0 ELSE CAST(price - first_price AS DOUBLE) / first_price END AS trend
  FROM ends WHERE rn = 1),
stats AS (
  SELECT sku, count(*) AS comps, count(*) FILTER (in_stock) AS n,
    CAST(sum(latest) FILTER (in_stock) AS BIGINT) AS s,
    min(latest) FILTER (in_stock) AS lo, max(latest) FILTER (in_stock) AS hi, avg(trend) AS trend
  FROM positions GROUP BY sku),
analysis AS (
  SELECT c.*, coalesce(comps, 0) AS comps, coalesce(n, 0) AS n, s, lo, hi,
    CASE WHEN n > 0 THEN (2 * s + n) // (2 * n) END AS mean,
    c.our * n - s AS gn, c.our * n AS gd, t.trend,
    coalesce(n > 0 AND abs(c.our * n - s) * 10000 >= 300 * c.our * n
      AND (c.our * n - s <= 0 OR (s - c.cost * n) * 10000 >= 1500 * s), false) AS flagged
  FROM catalog c LEFT JOIN stats t USING (sku))"""

NOTE = """CASE WHEN n > 0 THEN
    CASE WHEN gn > 0 THEN 'Overpriced' ELSE 'Underpriced' END || ' vs market by '
    || CAST((2000 * abs(gn) + gd) // (2 * gd) // 10 AS VARCHAR) || '.'
    || CAST((2000 * abs(gn) + gd) // (2 * gd) % 10 AS VARCHAR) || '%, trend '
    || CASE WHEN round(trend * 1e3) < 0 THEN '-' ELSE '+' END
    || CAST(CAST(abs(round(trend * 1e3)) AS BIGINT) // 10 AS VARCHAR) || '.'
    || CAST(CAST(abs(round(trend * 1e3)) AS BIGINT) % 10 AS VARCHAR) || '%'
  ELSE 'No in-stock competitor prices available' END"""

GAP4 = """CASE WHEN n > 0 THEN sign(gn) * ((20000 * abs(gn) + gd) // (2 * gd)) / 1e4 END"""

VIOLATION = """CASE WHEN ({p} - {c}) * 10000 < 1500 * {p} THEN 'below_min_margin'
  WHEN abs({p} - {o}) * 10000 > 2500 * {o} THEN 'exceeds_max_price_change'
  WHEN {p} > {o} AND {s} <= 10 THEN 'low_stock_blocks_raise' ELSE 'none' END"""

SALES = f"""{CATALOG},
items AS (
  SELECT c.sku, c.category, c.e, l_quantity >= 46 AS capped, l_linenumber,
    CAST(20 + c.k % 30 AS DOUBLE) AS base,
    CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 1601 - 800 AS DOUBLE) / 1e4 AS gap
  FROM lineitem JOIN catalog c ON l_partkey = c.k),
raw AS (SELECT *, floor(base * (1e0 + e * gap) + 5e-1) + (l_linenumber % 3 - 1) AS r FROM items),
sales AS (SELECT sku, category, gap, CASE WHEN capped THEN least(base, r) ELSE r END AS units, capped FROM raw),
fits AS (
  SELECT sku, category, count(*) AS observations,
    regr_slope(units, gap) / regr_intercept(units, gap) AS e
  FROM sales WHERE NOT capped GROUP BY sku, category
  HAVING count(*) >= 8 AND stddev_samp(gap) >= 1e-4 AND avg(units) >= 1 AND regr_intercept(units, gap) > 0),
estimates AS (SELECT category, round(median(e), 3) AS elasticity FROM fits GROUP BY category),
known AS (SELECT DISTINCT category, e AS known FROM catalog)"""


def _candidates(objective: str = "profit", points: int = 21) -> str:
    gaps = points - 1
    unit = "CAST(p - cost AS DOUBLE)" if objective == "profit" else "CAST(p AS DOUBLE)"
    return f"""{ANALYSIS},
bounds AS (
  SELECT *, (cost * 10000 + 8499) // 8500 AS floor_, (our * 7500 + 9999) // 10000 AS down,
    CASE WHEN stock <= 10 THEN least(our * 12500 // 10000, our) ELSE our * 12500 // 10000 END AS up,
    coalesce(nullif(mean, 0), our) AS ref FROM analysis),
ranges AS (
  SELECT *, CASE WHEN greatest(down, floor_) > up THEN floor_ ELSE greatest(down, floor_) END AS low,
    CASE WHEN greatest(down, floor_) > up THEN floor_ ELSE up END AS high FROM bounds),
grid AS (
  SELECT DISTINCT ranges.*, low + (2 * (high - low) * i + {gaps}) // {2 * gaps} AS p
  FROM ranges, range({points}) AS steps(i)),
demanded AS (
  SELECT *, least(1e0 * greatest(0e0, 1e0 + e * ((CAST(p AS DOUBLE) - CAST(ref AS DOUBLE)) / CAST(ref AS DOUBLE))),
    CAST(stock AS DOUBLE)) AS units FROM grid),
candidates AS (
  SELECT *, {unit} * units AS value, CAST(greatest(0, our - p) AS DOUBLE) * units AS spend FROM demanded),
best AS (
  SELECT * FROM candidates QUALIFY row_number() OVER (
    PARTITION BY sku ORDER BY value DESC, abs(p - our), p) = 1)"""


JOINT = f"""{_candidates()},
joint AS (
  SELECT *, count(*) OVER c AS in_category, sum(our) OVER c * 1e-1 AS budget, sum(spend) OVER c AS total_spend
  FROM best WHERE flagged WINDOW c AS (PARTITION BY category))"""

# one price per product under a budget that binds: hull steps by value per spend up to the first that does
# not fit, then rounds of each product's steepest move that fits the rest
TIGHT = f"""{_candidates()},
limits AS (
  SELECT category, count(*) AS skus, CAST(sum(our) AS DOUBLE) * 2e0 / 1e4 AS budget, sum(spend) AS free_spend
  FROM best GROUP BY category),
useful AS (
  SELECT c.sku, c.category, c.our, c.p, c.value, c.spend FROM candidates c ANTI JOIN candidates o
    ON o.sku = c.sku AND o.spend <= c.spend AND o.value >= c.value AND (o.spend < c.spend OR o.value > c.value
      OR abs(o.p - o.our) < abs(c.p - c.our) OR (abs(o.p - o.our) = abs(c.p - c.our) AND o.p < c.p))),
starts AS (
  SELECT * FROM useful QUALIFY row_number() OVER (
    PARTITION BY sku ORDER BY spend, value DESC, abs(p - our), p) = 1),
hull AS (
  SELECT sku, category, -1 AS k, CAST('infinity' AS DOUBLE) AS ratio, 0e0 AS dspend, p, value, spend FROM starts
  UNION ALL
  SELECT h.sku, h.category, h.k + 1, least((c.value - h.value) / (c.spend - h.spend), h.ratio), c.spend - h.spend,
    c.p, c.value, c.spend
  FROM hull h JOIN useful c ON c.sku = h.sku AND c.spend > h.spend AND c.value > h.value
  QUALIFY row_number() OVER (PARTITION BY h.sku
    ORDER BY (c.value - h.value) / (c.spend - h.spend) DESC, c.spend DESC, c.value DESC, c.p DESC) = 1),
rooms AS (
  SELECT category, any_value(budget) - sum(spend) AS room FROM starts JOIN limits USING (category) GROUP BY category),
ordered AS (
  SELECT hull.*, room, sum(dspend) OVER (PARTITION BY category ORDER BY ratio DESC, sku, k) AS reached
  FROM hull JOIN rooms USING (category) WHERE k >= 0),
lambdas AS (SELECT category, max(ratio) AS lam FROM ordered WHERE reached > room + 1e-6 GROUP BY category),
stepwise AS (
  SELECT sku, category, p, value, spend FROM (
    SELECT * FROM hull WHERE k = -1 UNION ALL
    SELECT sku, category, k, ratio, dspend, p, value, spend FROM ordered WHERE reached <= room + 1e-6)
  QUALIFY row_number() OVER (PARTITION BY sku ORDER BY k DESC) = 1),
relaxed AS (
  SELECT category, greatest(0e0, any_value(budget) - sum(spend)) AS rest,
    sum(value) + coalesce(any_value(lam), 0e0) * greatest(0e0, any_value(budget) - sum(spend)) AS bound
  FROM stepwise JOIN limits USING (category) LEFT JOIN lambdas USING (category) GROUP BY category),
rounds AS (
  SELECT 0 AS round, sku, category, p, value, spend, rest FROM stepwise JOIN relaxed USING (category)
  UNION ALL
  SELECT round, sku, category, CASE WHEN takes THEN new_p ELSE p END, CASE WHEN takes THEN new_value ELSE value END,
    CASE WHEN takes THEN new_spend ELSE spend END, rest - used
  FROM (
    SELECT *, coalesce(sum(CASE WHEN takes THEN new_spend - spend END) OVER (PARTITION BY category), 0e0) AS used,
      bool_or(takes) OVER (PARTITION BY category) AS moved
    FROM (
      SELECT *, ratio IS NOT NULL AND sum(CASE WHEN ratio IS NULL THEN 0e0 ELSE new_spend - spend END) OVER (
          PARTITION BY category ORDER BY ratio DESC NULLS LAST, sku) <= rest + 1e-6 AS takes
      FROM (
        SELECT s.round + 1 AS round, s.sku, s.category, s.p, s.value, s.spend, s.rest,
          c.p AS new_p, c.value AS new_value, c.spend AS new_spend,
          (c.value - s.value) / greatest(c.spend - s.spend, 1e-6) AS ratio
        FROM rounds s LEFT JOIN useful c ON c.sku = s.sku AND c.value - s.value > 1e-6
          AND c.spend - s.spend <= s.rest + 1e-6 AND c.spend - s.spend >= -1e-6
        QUALIFY row_number() OVER (PARTITION BY s.sku
          ORDER BY (c.value - s.value) / greatest(c.spend - s.spend, 1e-6) DESC NULLS LAST, c.spend - s.spend, c.p DESC) = 1)))
  WHERE moved),
joint_tight AS (
  SELECT * FROM rounds QUALIFY row_number() OVER (PARTITION BY sku ORDER BY round DESC) = 1)"""

SUGGESTED = f"""{ANALYSIS},
suggestions AS (
  SELECT k, sku, CASE WHEN k % 50 = 1 THEN 0 ELSE our * (72 + k % 57) // 100 END AS price,
    CAST(50 + k % 52 AS DOUBLE) / 1e2 AS confidence, 'suggested for ' || name AS reasoning
  FROM catalog WHERE k % 4 <> 3),
usable AS (SELECT * FROM suggestions WHERE price >= 1 AND confidence BETWEEN 0 AND 1),
priced AS (
  SELECT a.*, coalesce(u.price, nullif(a.mean, 0), a.our) AS p, coalesce(u.confidence, 5e-1) AS confidence,
    coalesce(u.reasoning, 'Rule: no usable suggestion, matched to the competitor average.') AS reasoning
  FROM analysis a LEFT JOIN usable u USING (sku) WHERE flagged),
recs AS (
  SELECT *, NOT (p > our AND (p - our) * 20000 > 2500 * our) AS reversible,
    {VIOLATION.format(p="p", c="cost", o="our", s="stock")} AS violation
  FROM priced WHERE abs(p - our) * 10000 <= 2500 * our),
routed AS (
  SELECT *, CASE WHEN confidence >= 9e-1 AND violation = 'none' AND reversible
    THEN 'auto_approved' ELSE 'queued_for_review' END AS outcome FROM recs)"""

LISTINGS = f"""{PRICES},
parts AS (
  SELECT *, string_split(substr(name, length(brand) + 2), ' ') AS rest FROM catalog),
swapped AS (
  SELECT *, list_transform(rest, lambda w, i: CASE WHEN i = 2 AND k % 7 = 0
    THEN w[1] || w[3] || w[2] || w[4:] ELSE w END) AS ws FROM parts),
named AS (
  SELECT sku, k, k AS true_k, CASE k % 5
    WHEN 0 THEN brand || ' ' || array_to_string(ws, ' ')
    WHEN 1 THEN upper(brand) || ' ' || array_to_string(ws, ' ')
    WHEN 2 THEN brand || ' ' || array_to_string(list_reverse(ws), ' ')
    WHEN 3 THEN brand || ' ' || array_to_string(ws, ' ') || ' (2026 Edition)'
    ELSE lower(brand || ' ' || array_to_string(ws, ' ')) END AS listing_name FROM swapped
  UNION ALL
  SELECT sku, k, NULL, brand || ' zephyr lite z' || CAST(10 + k % 90 AS VARCHAR) FROM catalog WHERE k % 10 = 0),
listings AS (
  SELECT p.competitor, n.listing_name, p.date, max_by(p.price, n.k) AS price,
    max_by(p.in_stock, n.k) AS in_stock, CAST(max(n.true_k) AS VARCHAR) AS true_sku
  FROM prices p JOIN named n USING (sku) GROUP BY ALL),
texts AS (
  SELECT listing_name, list_sort(list_distinct(list_filter(
      string_split_regex(trim(regexp_replace(lower(listing_name), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g')), '\\s+'),
      lambda w: w <> ''))) AS words,
    list_sort(list_distinct(regexp_extract_all(lower(listing_name), '\\b[a-z]\\d{{2}}\\b'))) AS models
  FROM (SELECT DISTINCT listing_name FROM listings)),
names AS (
  SELECT sku, lower(brand) AS brand, list_sort(list_distinct(string_split(lower(name), ' '))) AS words,
    list_distinct(regexp_extract_all(lower(name), '\\b[a-z]\\d{{2}}\\b')) AS models FROM catalog),
brands AS (SELECT brand, min(sku) AS first_sku FROM names GROUP BY brand),
blocked AS (
  SELECT t.listing_name, any_value(t.words) AS words, any_value(t.models) AS models,
    coalesce(min_by(b.brand, b.first_sku), '') AS block
  FROM texts t LEFT JOIN brands b ON list_contains(t.words, b.brand) GROUP BY t.listing_name)"""

# Similarity of each (listing, product) pair of a block. The longest common subsequence keeps one
# bit per pattern position in a 128-bit integer; `pos` maps a character to its positions.
MATCHES = f"""{LISTINGS},
pairs AS (
  SELECT DISTINCT b.block, b.words AS tw, n.words AS nw
  FROM blocked b JOIN names n ON b.block = '' OR n.brand = b.block),
rests AS (
  SELECT *, array_to_string(list_sort(list_filter(tw, lambda w: list_contains(nw, w))), ' ') AS s,
    array_to_string(list_sort(list_filter(tw, lambda w: NOT list_contains(nw, w))), ' ') AS a,
    array_to_string(list_sort(list_filter(nw, lambda w: NOT list_contains(tw, w))), ' ') AS b FROM pairs),
alone AS (SELECT DISTINCT a FROM rests WHERE a <> ''),
bits AS (
  SELECT a, c, sum(CAST(1 AS HUGEINT) << CAST(i - 1 AS HUGEINT)) AS m
  FROM (SELECT a, i, a[i] AS c FROM alone, range(1, 200) AS r(i) WHERE i <= length(a)) GROUP BY a, c),
maps AS (SELECT a, map(list(c), list(m)) AS pos FROM bits GROUP BY a),
combos AS (SELECT DISTINCT a, b FROM rests WHERE a <> '' AND b <> ''),
runs AS (
  SELECT a, b, list_reduce(list_prepend((CAST(1 AS HUGEINT) << CAST(length(a) AS HUGEINT)) - 1,
      list_transform(string_split(b, ''), lambda c: coalesce(pos[c], CAST(0 AS HUGEINT)))),
    lambda v, m: (((v + (v & m)) | (v & xor(m, (CAST(1 AS HUGEINT) << CAST(length(a) AS HUGEINT)) - 1)))
      & ((CAST(1 AS HUGEINT) << CAST(length(a) AS HUGEINT)) - 1))) AS v
  FROM combos JOIN maps USING (a)),
common AS (SELECT a, b, length(a) - bit_count(v) AS lcs FROM runs),
scored AS (
  SELECT block, tw, nw, CASE WHEN s <> '' AND (a = '' OR b = '') THEN 1e2 ELSE greatest(
    1e2 - 1e2 * (length(a) + length(b) - 2 * coalesce(lcs, 0))
      / (2 * length(s) + 2 * CAST(s <> '' AS INTEGER) + length(a) + length(b)),
    CASE WHEN s = '' THEN 0e0 ELSE 1e2 - 1e2 * (1 + length(a)) / (2 * length(s) + 1 + length(a)) END,
    CASE WHEN s = '' THEN 0e0 ELSE 1e2 - 1e2 * (1 + length(b)) / (2 * length(s) + 1 + length(b)) END) END AS raw
  FROM rests LEFT JOIN common USING (a, b)),
shortlist AS (
  SELECT t.listing_name, t.models AS tm, n.sku, n.models AS nm, raw, row_number() OVER (
    PARTITION BY t.listing_name ORDER BY raw DESC, n.sku) AS place
  FROM blocked t JOIN scored s ON s.block = t.block AND s.tw = t.words
    JOIN names n ON n.words = s.nw AND (t.block = '' OR n.brand = t.block)
  QUALIFY place <= 5),
adjusted AS (
  SELECT *, CASE WHEN len(tm) = 0 THEN raw WHEN list_has_any(tm, nm) THEN least(1e2, raw + 10) ELSE raw - 15 END AS adj
  FROM shortlist),
winners AS (SELECT * FROM adjusted QUALIFY row_number() OVER (PARTITION BY listing_name ORDER BY adj DESC, place) = 1),
matches AS (
  SELECT t.listing_name, CASE WHEN adj >= 80 THEN sku END AS matched_sku, coalesce(greatest(adj, 0e0), 0e0) AS score
  FROM blocked t LEFT JOIN winners USING (listing_name)),
matched AS (SELECT l.*, matched_sku FROM listings l JOIN matches USING (listing_name))"""

def _tests(name: str, key: str, rows: str, **rules: str) -> str:
    """Each row of a table with each of its rules; a null breaks none but `_missing`."""
    each = ", ".join(f"{{'rule': '{rule}', 'bad': NOT coalesce({test}, true)}}" for rule, test in rules.items())
    return f"""SELECT '{name}' AS "table", {key} AS key, unnest([{each}], recursive := true) FROM ({rows})"""


def _there(columns: str) -> dict[str, str]:
    return {f"{c}_missing": f"{c} IS NOT NULL" for c in columns.split()}


_TESTS = (
    _tests(
        "catalog", "sku",
        """SELECT sku, name, brand, category, CASE WHEN k % 13 <> 0 THEN our END AS our_price,
          CASE WHEN k % 17 <> 0 THEN cost ELSE 0 END AS cost, CASE WHEN k % 19 <> 0 THEN stock ELSE -1 END AS stock
          FROM catalog""",
        **_there("sku name brand category our_price cost stock"),
        our_price_not_positive="our_price > 0", cost_not_positive="cost > 0", stock_negative="stock >= 0",
    ),
    _tests(
        "prices", "sku",
        """SELECT CASE WHEN l_orderkey % 503 = 0 THEN 'x' ELSE '' END || sku AS sku, competitor, date,
          CASE WHEN l_orderkey % 501 = 0 THEN 0 ELSE price END AS price,
          CASE WHEN l_orderkey % 509 <> 0 THEN in_stock END AS in_stock FROM feed""",
        **_there("sku competitor price in_stock date"), price_not_positive="price > 0",
    ),
    _tests(
        "listings", "competitor",
        """SELECT competitor, listing_name, date, CASE WHEN day(date) <> 13 THEN price ELSE 0 END AS price,
          CASE WHEN day(date) <> 17 THEN in_stock END AS in_stock FROM listings""",
        **_there("competitor listing_name price in_stock date"), price_not_positive="price > 0",
    ),
    _tests(
        "suggestions", "sku", "SELECT * FROM suggestions",
        recommended_price_too_low="price >= 1", confidence_out_of_range="confidence BETWEEN 0 AND 1",
    ),
    _tests(
        "recommendations", "sku",
        """SELECT sku, p, CASE WHEN k % 7 <> 0 THEN violation ELSE 'odd' END AS violation,
          CASE WHEN k % 11 <> 0 THEN confidence ELSE 2e0 END AS confidence FROM recs""",
        recommended_price_not_positive="p > 0", confidence_out_of_range="confidence BETWEEN 0 AND 1",
        guardrail_violation_unknown="""violation IN (
          'none', 'below_min_margin', 'exceeds_max_price_change', 'low_stock_blocks_raise')""",
    ),
    _tests(
        "pending", "sku",
        """SELECT CASE WHEN k % 3 <> 0 THEN 'r1' END AS run_id, sku, our AS current_price, p AS recommended_price,
          confidence, CASE WHEN k % 5 <> 0 THEN 'pending' ELSE 'lost' END AS status FROM recs""",
        **_there("run_id sku current_price recommended_price confidence"),
        status_unknown="status IN ('pending', 'approved', 'rejected')",
    ),
)
RULES = f"""{SUGGESTED}{LISTINGS.removeprefix(PRICES)},
tests AS ({" UNION ALL ".join(_TESTS)})"""

# the same similarity over listings that name no known brand
UNBRANDED = MATCHES.replace(
    "FROM (SELECT DISTINCT listing_name FROM listings)",
    """FROM (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN tail ELSE 'q' || brand || ' ' || tail END AS listing_name FROM (
      SELECT k, brand, array_to_string(list_transform(rest, lambda w, i:
        CASE WHEN i = 2 AND k % 4 = 1 THEN w || 'x' ELSE w END), ' ') AS tail
      FROM parts WHERE k % 20 = 3 OR k % 20 = 6))""",
)

DAYS = f"""{PRICES},
daily AS (
  SELECT sku, k, date AS day, count(*) FILTER (in_stock) AS ni, CAST(sum(price) FILTER (in_stock) AS BIGINT) AS si,
    count(*) AS na, CAST(sum(price) AS BIGINT) AS sa FROM prices GROUP BY ALL),
days AS (
  SELECT d.sku, d.day, c.our, c.cost, c.stock, c.e, CAST(20 + c.k % 30 AS DOUBLE) AS base,
    CASE WHEN ni > 0 THEN (2 * si + ni) // (2 * ni) ELSE (2 * sa + na) // (2 * na) END AS market
  FROM daily d JOIN catalog c USING (sku)),
targets AS (
  SELECT *, CAST(round(CAST(market AS DOUBLE) * (e - 1e0) / (2e0 * e) + CAST(cost AS DOUBLE) / 2e0) AS BIGINT) AS optimum,
    row_number() OVER (PARTITION BY sku ORDER BY day) AS i FROM days)"""

FOLD = """
  SELECT sku, day, i, {start} AS before, greatest(
    greatest(({start} * 7500 + 9999) // 10000, (cost * 10000 + 8499) // 8500),
    least(greatest(greatest(({start} * 7500 + 9999) // 10000, (cost * 10000 + 8499) // 8500), {start} * 12500 // 10000),
      {target})) AS price"""


def _followed(name: str, target: str) -> str:
    first = FOLD.format(start="our", target=target)
    again = FOLD.format(start="f.price", target=f"t.{target}")
    again = again.replace("SELECT sku, day, i,", "SELECT t.sku, t.day, t.i,").replace("cost", "t.cost")
    return f"""{name} AS ({first} FROM targets WHERE i = 1 UNION ALL {again}
  FROM {name} f JOIN targets t ON t.sku = f.sku AND t.i = f.i + 1)"""


EVENTS = """
rows_ AS (
  SELECT event_id AS e, ts, 'r' || CAST(user_id % 20 AS VARCHAR) AS run_id, event_type,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"""

RECS = f"""{EVENTS},
recs AS (
  SELECT run_id, j AS position, CAST(e * 3 + j AS VARCHAR) AS sku, 80 + (k * 7 + j * 13) % 60 AS price,
    CASE j WHEN 1 THEN 'optimizer' ELSE 'llm' END AS source,
    CASE WHEN (e + j) % 11 <> 0 THEN 90 END AS lo, 110 AS hi,
    CASE WHEN (k + j) % 5 <> 0 THEN ((k + j * 3) % 40 - 20) END AS trend_thousandths
  FROM rows_, range(3) AS r(j) WHERE event_type = 'purchase'),
suspicious AS (
  SELECT * FROM recs WHERE source = 'llm' AND lo IS NOT NULL AND (price < lo OR price > hi)
    AND NOT coalesce(abs(trend_thousandths) >= 10, false))"""

CALLS = f"""{EVENTS},
sized AS (
  SELECT *, CASE WHEN event_type = 'error' AND k % 2 = 0 THEN 4 WHEN event_type = 'error' AND k % 10 = 9 THEN 5
    WHEN event_type = 'error' THEN 6 ELSE 1 + k % 3 END AS n FROM rows_),
tried AS (
  SELECT *, i = n - 1 AND NOT (event_type = 'error' AND k % 2 = 1) AS ok
  FROM sized, range(6) AS r(i) WHERE i < n),
calls AS (
  SELECT run_id, e * 10 + i AS seq, 'q' || CAST(e AS VARCHAR) AS request_key, 'm' || CAST(i // 3 AS VARCHAR) AS model,
    i // 3 AS model_rank, i % 3 + 1 AS attempt, ok,
    CASE WHEN ok OR i % 2 = 0 THEN 500 + k * 3 + i END AS tokens_in,
    CASE WHEN ok OR i % 2 = 0 THEN 50 + k END AS tokens_out, k * 10 + i AS latency_ms FROM tried),
requests AS (
  SELECT run_id, e AS seq, 'q' || CAST(e AS VARCHAR) AS request_key FROM rows_, range(2) AS r(t)
  WHERE t = 0 OR event_type = 'purchase')"""

COST = "(tokens_in / 1e6 * 15e0 + tokens_out / 1e6 * 30e0)"


def _q(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select}"


RUN_METRICS = _q(
    RECS + """,
    tools AS (SELECT run_id, round(avg(CASE WHEN event_type <> 'error' THEN 1e0 ELSE 0e0 END), 6) AS tool_success_rate,
      round(CAST(sum(least(1 + k % 5, k % 4)) FILTER (event_type = 'click') AS DOUBLE)
        / sum(1 + k % 5) FILTER (event_type = 'click'), 6) AS schema_success_rate FROM rows_ GROUP BY run_id),
    made AS (SELECT run_id, count(*) FILTER (source = 'llm') AS l, count(*) FILTER (source = 'optimizer') AS o
      FROM recs GROUP BY run_id),
    bad AS (SELECT run_id, count(*) AS b FROM suspicious GROUP BY run_id)""",
    """SELECT run_id, tool_success_rate, schema_success_rate, coalesce(l, 0) AS llm_recommendations,
      coalesce(o, 0) AS optimizer_recommendations, coalesce(b, 0) AS hallucination_flags
      FROM tools LEFT JOIN made USING (run_id) LEFT JOIN bad USING (run_id)""",
)

ORACLES: dict[str, str] = {
    "market_analysis": _q(
        ANALYSIS,
        f"""SELECT sku, category, our / 1e2 AS our_price, cost / 1e2 AS cost, stock,
          lo / 1e2 AS min_competitor_price, hi / 1e2 AS max_competitor_price, mean / 1e2 AS avg_competitor_price,
          {GAP4} AS price_delta_pct, CASE WHEN n > 0 THEN round(trend, 4) END AS avg_competitor_trend_pct,
          round((our - cost) / CAST(our AS DOUBLE), 6) AS current_margin_pct, comps AS competitor_count,
          flagged AS needs_decision, {NOTE} AS notes FROM analysis""",
    ),
    "flagged_market": _q(
        ANALYSIS,
        f"""SELECT sku, our / 1e2 AS our_price, mean / 1e2 AS avg_competitor_price, {GAP4} AS price_delta_pct,
          {NOTE} AS notes FROM analysis WHERE flagged""",
    ),
    "competitor_trend": _q(
        ANALYSIS,
        """SELECT sku, competitor, latest / 1e2 AS latest_price, in_stock, points,
          round(trend, 6) AS trend_pct FROM positions""",
    ),
    "market_price_daily": _q(
        PRICES,
        """SELECT sku, date, round(coalesce(avg(price) FILTER (in_stock), avg(price)), 4) AS market_cents
          FROM prices GROUP BY sku, date""",
    ),
    "trailing_trend": _q(
        PRICES,
        """SELECT sku, competitor, date, first_value(price) OVER w AS first_cents, price AS latest_cents,
          count(*) OVER w AS points,
          round(CAST(price - first_value(price) OVER w AS DOUBLE) / first_value(price) OVER w, 6) AS trend_pct
          FROM prices WINDOW w AS (PARTITION BY sku, competitor ORDER BY date
            RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""",
    ),
    "trailing_market": _q(
        PRICES + """,
        spans AS (SELECT *, first_value(price) OVER (PARTITION BY sku, competitor ORDER BY date
          RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS f FROM prices)""",
        """SELECT sku, date, count(*) AS competitor_count, count(*) FILTER (in_stock) AS in_stock_count,
          CAST(sum(price) FILTER (in_stock) AS BIGINT) AS in_stock_sum,
          round(avg(CAST(price - f AS DOUBLE) / f), 6) AS trend FROM spans GROUP BY sku, date""",
    ),
    "guardrail_eval": _q(
        PRICES,
        f"""SELECT p.sku, competitor, date, price / 1e2 AS candidate_price,
          (price - cost) * 10000 >= 1500 * price AS margin_ok, abs(price - our) * 10000 <= 2500 * our AS change_ok,
          price <= our OR stock > 10 AS stock_ok,
          {VIOLATION.format(p="price", c="cost", o="our", s="stock")} AS guardrail_violation
          FROM prices p JOIN catalog c USING (sku)""",
    ),
    "guard_bounds": _q(
        CATALOG,
        """SELECT sku, greatest((our * 7500 + 9999) // 10000, (cost * 10000 + 8499) // 8500) / 1e2 AS low,
          greatest((our * 7500 + 9999) // 10000, (cost * 10000 + 8499) // 8500, our * 12500 // 10000) / 1e2 AS high,
          (20000 * (our - cost) + our) // (2 * our) / 1e4 AS margin FROM catalog""",
    ),
    "catalog_profile": _q(
        CATALOG,
        """SELECT category, count(*) AS skus, round(avg(CAST(our - cost AS DOUBLE) / our), 4) AS mean_margin_pct,
          count(*) FILTER (stock <= 10) AS low_stock FROM catalog GROUP BY category""",
    ),
    "missing_skus": _q(
        ANALYSIS, "SELECT sku FROM catalog WHERE sku NOT IN (SELECT sku FROM positions WHERE in_stock)"
    ),
    "research_summary": _q(
        ANALYSIS,
        """SELECT count(*) AS skus_requested, count(*) FILTER (n > 0) AS skus_found,
          count(*) FILTER (n = 0) AS errors FROM analysis""",
    ),
    "history_of_flagged": _q(
        ANALYSIS,
        """SELECT sku, competitor, price / 1e2 AS price, in_stock, date FROM prices
          WHERE sku IN (SELECT sku FROM analysis WHERE flagged)""",
    ),
    "sku_lookup": _q(
        PRICES, "SELECT sku, competitor, price / 1e2 AS price, in_stock, date FROM prices WHERE sku = '42'"
    ),
    "distinct_days": _q(PRICES, "SELECT DISTINCT date, competitor FROM prices ORDER BY ALL"),
    "constraint_violations": _q(
        FEED,
        """SELECT CASE WHEN l_orderkey % 503 = 0 THEN 'x' ELSE '' END || sku AS sku, competitor, date,
          l_orderkey * 10 + l_linenumber AS arrival, concat_ws(',',
            CASE WHEN l_orderkey % 509 = 0 THEN 'in_stock_missing' END,
            CASE WHEN l_orderkey % 501 = 0 THEN 'price_not_positive' END) AS violations
          FROM feed WHERE l_orderkey % 509 = 0 OR l_orderkey % 501 = 0""",
    ),
    "duplicate_price_keys": _q(
        FEED,
        "SELECT sku, competitor, date, count(*) AS rows FROM feed GROUP BY ALL HAVING count(*) > 1",
    ),
    "orphan_prices": _q(
        FEED,
        """SELECT 'x' || sku AS sku, competitor, date, l_orderkey * 10 + l_linenumber AS arrival
          FROM feed WHERE l_orderkey % 503 = 0""",
    ),
    "latest_upsert": _q(
        PRICES, "SELECT sku, competitor, price / 1e2 AS price, in_stock, date FROM prices"
    ),
    "catalog_upsert": _q(
        SUGGESTED,
        """SELECT c.sku, name, brand, category, coalesce(s.price, our) / 1e2 AS our_price, cost / 1e2 AS cost, stock
          FROM catalog c LEFT JOIN (SELECT sku, price FROM suggestions WHERE price > 0) s USING (sku)""",
    ),
    "stored_price_upsert": _q(
        FEED,
        """SELECT sku, competitor, date, price / 1e2 AS price, in_stock FROM feed QUALIFY row_number() OVER (
          PARTITION BY sku, competitor, date ORDER BY l_linenumber > 4 DESC, l_orderkey DESC, l_linenumber DESC) = 1""",
    ),
    "run_log_events": _q(
        EVENTS,
        """SELECT run_id, 'tool' AS agent, event_type AS event, CASE WHEN e % 41 <> 0 THEN event_type <> 'error' END AS success,
          CASE WHEN e % 41 <> 0 THEN CAST(k AS DOUBLE) END AS payload_ms, CAST(k AS DOUBLE) AS latency_ms,
          CASE WHEN e % 41 = 0 THEN '{"success": tru' END AS damaged FROM rows_ WHERE run_id = 'r7'
        UNION ALL
        SELECT run_id, NULL, NULL, NULL, NULL, NULL, '{"timestamp": broken ' || CAST(e AS VARCHAR)
          FROM rows_ WHERE run_id = 'r7' AND e % 37 = 0""",
    ),
    "catalog_csv": _q(
        CATALOG, "SELECT sku, name, brand, category, our / 1e2 AS our_price, cost / 1e2 AS cost, stock FROM catalog"
    ),
    "elasticity_lookup": _q(
        CATALOG,
        """SELECT sku, category, CASE WHEN category IN ('MEDIUM', 'LARGE') THEN -15e-1 ELSE e END AS stored,
          -15e-1 AS without_file FROM catalog""",
    ),
    "rule_counts": _q(
        RULES,
        """SELECT "table", rule, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) AS BIGINT) AS broken, count(*) AS rows
          FROM tests GROUP BY "table", rule""",
    ),
    "rule_violations": _q(
        RULES,
        """SELECT "table", key, rule, count(*) AS broken FROM tests WHERE bad GROUP BY "table", key, rule""",
    ),
    "first_n_per_category": _q(
        CATALOG,
        """SELECT category, sku, name FROM catalog
          QUALIFY row_number() OVER (PARTITION BY category ORDER BY sku) <= 5""",
    ),
    "product_briefs": _q(
        ANALYSIS,
        """SELECT sku, printf('Product %s (%s): our price $%s, cost $%s, minimum margin 15%%. Competitors in stock: '
            || 'min $%s, max $%s, average $%s, trend %s%s (%s), %d tracked. '
            || 'Keep the margin and change the price by at most 25%%.', sku, name,
            printf('%d.%02d', our // 100, our % 100), printf('%d.%02d', cost // 100, cost % 100),
            printf('%d.%02d', lo // 100, lo % 100), printf('%d.%02d', hi // 100, hi % 100),
            printf('%d.%02d', mean // 100, mean % 100),
            CASE WHEN round(round(trend, 4) * 1e3) < 0 THEN '-' ELSE '+' END,
            printf('%d.%d%%', CAST(abs(round(round(trend, 4) * 1e3)) AS BIGINT) // 10,
              CAST(abs(round(round(trend, 4) * 1e3)) AS BIGINT) % 10),
            CASE WHEN round(trend, 4) > 1e-2 THEN 'rising' WHEN round(trend, 4) < -1e-2 THEN 'falling' ELSE 'flat' END,
            comps) AS brief FROM analysis WHERE flagged""",
    ),
    "elasticity_estimates": _q(SALES, "SELECT category, elasticity FROM estimates"),
    "sku_elasticity": _q(
        SALES, "SELECT sku, category, observations, round(e, 4) AS elasticity FROM fits"
    ),
    "merged_elasticity": _q(
        SALES, "SELECT sku, category, observations, round(e, 4) AS elasticity FROM fits"
    ),
    "elasticity_error": _q(
        SALES,
        """SELECT category, known, elasticity AS estimated, round(abs(known - elasticity), 3) AS abs_error
          FROM estimates JOIN known USING (category)""",
    ),
    "elasticity_mean_error": _q(
        SALES,
        "SELECT round(avg(abs(known - elasticity)), 3) AS mean_abs_error FROM estimates JOIN known USING (category)",
    ),
    "sales_gaps": _q(
        PRICES + """,
        daily AS (SELECT sku, date, count(*) AS units,
          coalesce(avg(price) FILTER (in_stock), avg(price)) AS market FROM prices GROUP BY sku, date)""",
        """SELECT sku, category, count(*) AS days, round(avg((CAST(our AS DOUBLE) - market) / market), 6) AS mean_gap,
          count(*) FILTER (units >= stock) AS capped_days FROM daily JOIN catalog USING (sku) GROUP BY sku, category""",
    ),
    "price_candidates": _q(
        _candidates(),
        """SELECT sku, category, p AS price_c, round(units, 3) AS units, round(value, 3) AS value,
          round(spend, 3) AS spend FROM candidates""",
    ),
    "optimum_price": _q(
        _candidates(),
        """SELECT sku, category, our AS current_c, p AS price_c, round(value, 3) AS value,
          round(spend, 3) AS spend FROM best""",
    ),
    "revenue_optimum_price": _q(
        _candidates("revenue", 11),
        """SELECT sku, category, our AS current_c, p AS price_c, round(value, 3) AS value,
          round(spend, 3) AS spend FROM best""",
    ),
    # the best prices together are the joint optimum exactly where they fit the budget
    "optimized_prices": _q(
        JOINT,
        """SELECT sku, category, our AS current_c, p AS price_c, round(value, 3) AS value, round(spend, 3) AS spend
          FROM joint WHERE in_category >= 2 AND total_spend <= budget""",
    ),
    "optimized_categories": _q(
        JOINT,
        """SELECT category, count(*) AS skus, round(any_value(budget), 2) AS budget, 'free' AS state,
          round(sum(value), 2) AS value, round(sum(spend), 2) AS spend, 0e0 AS gap
          FROM joint WHERE in_category >= 2 AND total_spend <= budget GROUP BY category""",
    ),
    "tight_budget_categories": _q(
        TIGHT,
        """SELECT category, any_value(skus) AS skus, round(any_value(budget), 2) AS budget, 'binding' AS state,
          round(sum(value), 2) AS value, round(sum(spend), 2) AS spend,
          round(greatest(any_value(bound) - sum(value), 0e0), 2) AS gap
          FROM joint_tight JOIN limits USING (category) JOIN relaxed USING (category) GROUP BY category""",
        recursive=True,
    ),
    "tight_budget_prices": _q(
        TIGHT,
        """SELECT t.sku, t.category, c.our AS current_c, t.p AS price_c, round(t.value, 3) AS value,
          round(t.spend, 3) AS spend FROM joint_tight t JOIN catalog c USING (sku)""",
        recursive=True,
    ),
    "joint_recommendations": _q(
        JOINT,
        f"""SELECT sku, our / 1e2 AS current_price, p / 1e2 AS recommended_price,
          CASE WHEN abs(p - our) * 10000 <= 500 * our THEN 92e-2 ELSE 85e-2 END AS confidence,
          'Joint price for category ' || category || ': most profit within budget, margin and stock limits.' AS reasoning,
          (20000 * (p - cost) + p) // (2 * p) / 1e4 AS projected_margin_pct, true AS reversible,
          {VIOLATION.format(p="p", c="cost", o="our", s="stock")} AS guardrail_violation, 'optimizer' AS source
          FROM joint WHERE in_category >= 2 AND abs(p - our) * 10000 <= 2500 * our""",
    ),
    "suggestion_recs": _q(
        SUGGESTED,
        """SELECT sku, our / 1e2 AS current_price, p / 1e2 AS recommended_price, confidence, reasoning,
          sign(p - cost) * ((20000 * abs(p - cost) + p) // (2 * p)) / 1e4 AS projected_margin_pct, reversible,
          violation AS guardrail_violation, 'llm' AS source FROM recs""",
    ),
    "sanity_rejections": _q(
        SUGGESTED,
        """SELECT sku, our / 1e2 AS current_price, p / 1e2 AS recommended_price, 'change_exceeds_maximum' AS reason
          FROM priced WHERE abs(p - our) * 10000 > 2500 * our""",
    ),
    "model_numbers": _q(
        LISTINGS, "SELECT listing_name, array_to_string(models, ',') AS models FROM texts"
    ),
    "brand_blocking": _q(LISTINGS, "SELECT listing_name, block FROM blocked"),
    "listing_containment": _q(
        LISTINGS,
        """SELECT block, array_to_string(t.words, ' ') AS text_key, count(DISTINCT n.words) AS names,
          min(n.sku) AS first_sku
          FROM (SELECT DISTINCT block, words FROM blocked) t JOIN names n ON (t.block = '' OR n.brand = t.block)
            AND (list_has_all(t.words, n.words) OR list_has_all(n.words, t.words)) GROUP BY ALL""",
    ),
    "listing_matches": _q(
        MATCHES, "SELECT listing_name, matched_sku, round(score, 6) AS match_score FROM matches"
    ),
    "unbranded_matches": _q(
        UNBRANDED, "SELECT listing_name, matched_sku, round(score, 6) AS match_score FROM matches"
    ),
    "ingested_prices": _q(
        MATCHES,
        """SELECT matched_sku AS sku, competitor, price / 1e2 AS price, in_stock, date FROM matched
          WHERE matched_sku IS NOT NULL QUALIFY row_number() OVER (
            PARTITION BY matched_sku, competitor, date ORDER BY listing_name DESC, price DESC) = 1""",
    ),
    "published_prices": _q(
        MATCHES,
        """SELECT matched_sku AS sku, competitor, price / 1e2 AS price, in_stock, date FROM matched
          WHERE matched_sku IS NOT NULL QUALIFY row_number() OVER (
            PARTITION BY matched_sku, competitor, date ORDER BY listing_name DESC, price DESC) = 1""",
    ),
    "matching_quality": _q(
        MATCHES + """,
        latest AS (SELECT matched_sku AS m, true_sku AS t FROM matched
          QUALIFY row_number() OVER (PARTITION BY competitor, listing_name ORDER BY date DESC) = 1),
        counted AS (SELECT count(*) AS listings, count(*) FILTER (m = t) AS tp,
          count(*) FILTER (m IS NOT NULL AND m IS DISTINCT FROM t) AS fp,
          count(*) FILTER (t IS NOT NULL AND m IS DISTINCT FROM t) AS fn,
          count(*) FILTER (t IS NULL) AS decoys, count(*) FILTER (t IS NULL AND m IS NOT NULL) AS wrong FROM latest)""",
        """SELECT listings, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 4) AS precision,
          round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 4) AS recall, decoys, wrong AS decoys_wrongly_matched FROM counted""",
    ),
    "routing": _q(
        SUGGESTED,
        "SELECT sku, violation AS guardrail_violation, reversible, outcome FROM routed",
    ),
    "routing_totals": _q(
        SUGGESTED,
        """SELECT count(*) AS recommendations, count(*) FILTER (outcome = 'auto_approved') AS auto_approved,
          count(*) FILTER (outcome <> 'auto_approved' AND violation = 'none') AS escalated,
          count(*) FILTER (violation <> 'none') AS blocked_by_guardrail FROM routed""",
    ),
    "outcome_counts": _q(
        SUGGESTED, "SELECT outcome, count(*) AS recommendations FROM routed GROUP BY outcome"
    ),
    "execution": _q(
        SUGGESTED,
        """SELECT sku, outcome, our / 1e2 AS old_price,
          CASE WHEN outcome = 'auto_approved' THEN p ELSE our END / 1e2 AS new_price,
          outcome = 'auto_approved' AS executed FROM routed""",
    ),
    "updated_catalog": _q(
        SUGGESTED,
        """SELECT c.sku, coalesce(r.p, c.our) / 1e2 AS our_price, c.stock FROM catalog c
          LEFT JOIN (SELECT sku, p FROM routed WHERE outcome = 'auto_approved') r USING (sku)""",
    ),
    "approval_resolution": _q(
        EVENTS,
        """SELECT run_id, 's' || CAST(e AS VARCHAR) AS sku, CASE WHEN event_type = 'view' OR k * 7 > 300 THEN 'timed_out'
          WHEN event_type = 'error' THEN 'human_rejected' ELSE 'human_approved' END AS outcome FROM rows_""",
    ),
    "run_metrics": RUN_METRICS,
    # a report holds what was written
    "run_report": RUN_METRICS,
    "review_queue": _q(
        SUGGESTED,
        """SELECT run_id, sku, our / 1e2 AS current_price, p / 1e2 AS recommended_price, confidence,
          violation AS guardrail_violation, reasoning, 'pending' AS status, true AS stamped
          FROM routed, (VALUES ('first'), ('second')) AS runs(run_id)
          WHERE outcome = 'queued_for_review' AND (run_id = 'first' OR violation <> 'none')""",
    ),
    "logged_decisions": _q(
        SUGGESTED + """,
        placed AS (SELECT sku, p, row_number() OVER (ORDER BY sku) - 1 AS place FROM recs)""",
        """SELECT 'logged' AS run_id, place // 1000 AS batch, place % 1000 AS position, sku, p / 1e2 AS recommended_price
          FROM placed""",
    ),
    # without an answer in time an item is closed once the stream's watermark has passed its limit
    "stream_approvals_resolved": _q(
        EVENTS + """,
        passed AS (SELECT least(max(ts), max(ts + to_seconds(k * 7)) FILTER (event_type <> 'view')) - INTERVAL 60 SECONDS AS mark
          FROM rows_)""",
        """SELECT run_id, 's' || CAST(e AS VARCHAR) AS sku,
          CASE WHEN event_type <> 'view' AND k * 7 <= 300 THEN
              CASE event_type WHEN 'error' THEN 'human_rejected' ELSE 'human_approved' END
            WHEN ts + INTERVAL 300 SECONDS < mark THEN 'timed_out' ELSE 'pending' END AS outcome FROM rows_, passed""",
    ),
    "hallucination_flags": _q(RECS, "SELECT run_id, position, sku FROM suspicious"),
    "run_summary": _q(
        JOINT,
        """SELECT 'daily' AS run_id, (SELECT count(*) FROM catalog) AS skus_requested,
          (SELECT count(DISTINCT sku) FROM prices) AS skus_found,
          (SELECT count(*) FROM analysis WHERE flagged) AS flagged, count(*) AS recommendations,
          count(*) FILTER (abs(p - our) * 10000 <= 500 * our AND (p - cost) * 10000 >= 1500 * p
            AND (p <= our OR stock > 10)) AS executed,
          count(*) FILTER (NOT (abs(p - our) * 10000 <= 500 * our AND (p - cost) * 10000 >= 1500 * p
            AND (p <= our OR stock > 10))) AS queued_for_review
          FROM joint WHERE abs(p - our) * 10000 <= 2500 * our""",
    ),
    "market_context": _q(
        SUGGESTED,
        """SELECT sku, p / 1e2 AS recommended_price, lo / 1e2 AS min_competitor_price, hi / 1e2 AS max_competitor_price,
          round(trend, 4) AS avg_competitor_trend_pct FROM recs""",
    ),
    "audit_summary": """
        SELECT doc_id, CASE WHEN len(w) > 20 THEN '<' || CAST(len(w) AS VARCHAR) || ' items>'
          ELSE CAST(to_json(w) AS VARCHAR) END AS logged
        FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
    "call_costs": _q(CALLS, f"SELECT run_id, seq, round({COST}, 6) AS cost_usd FROM calls"),
    "call_stats": _q(
        CALLS + f""",
        answered AS (SELECT run_id, request_key, bool_or(ok) AS a,
          NOT bool_or(ok) AND bool_or(model_rank = 1 AND attempt = 3) AS by_rule FROM calls GROUP BY ALL),
        asked AS (SELECT run_id, count(*) AS n, count(*) FILTER (a OR by_rule) AS done FROM requests LEFT JOIN answered
          USING (run_id, request_key) GROUP BY run_id),
        ruled AS (SELECT run_id, count(*) FILTER (by_rule) AS r FROM answered GROUP BY run_id),
        used AS (SELECT run_id, string_agg(model || '=' || CAST(c AS VARCHAR), ',' ORDER BY model) AS models_used
          FROM (SELECT run_id, model, count(*) AS c FROM calls WHERE ok GROUP BY ALL) GROUP BY run_id),
        sums AS (SELECT run_id, count(tokens_in) AS llm_calls, count(*) FILTER (NOT ok AND attempt <= 2) AS retries,
          count(*) FILTER (ok AND model_rank > 0) AS fallback_model_used, CAST(sum(tokens_in) AS BIGINT) AS input_tokens,
          CAST(sum(tokens_out) AS BIGINT) AS output_tokens, round(sum({COST}), 6) AS estimated_cost_usd,
          list_sort(list(latency_ms) FILTER (tokens_in IS NOT NULL)) AS lat FROM calls GROUP BY run_id)""",
        """SELECT run_id, n AS generate_attempts, done AS generate_successes, r AS rule_fallback_used, llm_calls, retries,
          fallback_model_used, input_tokens, output_tokens, estimated_cost_usd, models_used,
          lat[len(lat) // 2 + 1] AS latency_p50_ms
          FROM asked JOIN ruled USING (run_id) JOIN used USING (run_id) JOIN sums USING (run_id)""",
    ),
    "budget_cutoff": _q(
        CALLS + f""",
        spent AS (SELECT run_id, seq, count(tokens_in) OVER (PARTITION BY run_id ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS i,
          coalesce(sum({COST}) OVER (PARTITION BY run_id ORDER BY seq
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before
          FROM calls)""",
        "SELECT run_id, seq, round(before, 6) AS spent_before FROM spent WHERE i < 100 AND before < 1e0",
    ),
    "answered_requests": _q(
        CALLS,
        """SELECT r.run_id, r.request_key, r.seq, c.model FROM requests r
          LEFT JOIN (SELECT run_id, request_key, model FROM calls WHERE ok) c USING (run_id, request_key)""",
    ),
    "guarded_follow": _q(
        DAYS + "," + _followed("followed", "market"),
        "SELECT sku, day, before AS before_c, price AS price_c FROM followed",
        recursive=True,
    ),
    "strategy_optimum": _q(
        DAYS,
        """SELECT sku, day, greatest(greatest((our * 7500 + 9999) // 10000, (cost * 10000 + 8499) // 8500),
          least(greatest((our * 7500 + 9999) // 10000, (cost * 10000 + 8499) // 8500, our * 12500 // 10000), optimum))
          AS price_c FROM targets""",
    ),
    "price_moves": _q(
        PRICES,
        """SELECT competitor AS strategy, sku, date AS day, coalesce(lag(price) OVER w, price) / 1e2 AS before_price,
          abs(price / 1e2 - coalesce(lag(price) OVER w, price) / 1e2) > 5e-3 AS moved
          FROM prices WINDOW w AS (PARTITION BY competitor, sku ORDER BY date)""",
    ),
    "strategy_scorecard": _q(
        DAYS + "," + _followed("followed", "market") + "," + _followed("best", "optimum") + """,
        priced AS (
          SELECT 'static' AS strategy, *, our AS p FROM targets
          UNION ALL SELECT 'match', *, market FROM targets
          UNION ALL SELECT 'match_guarded', t.*, f.price FROM targets t JOIN followed f USING (sku, i)
          UNION ALL SELECT 'optimum', t.*, f.price FROM targets t JOIN best f USING (sku, i)),
        sold AS (SELECT *, coalesce(lag(p) OVER (PARTITION BY strategy, sku ORDER BY day), our) AS before,
          least(base * greatest(0e0, 1e0 + e * ((CAST(p AS DOUBLE) - CAST(market AS DOUBLE)) / CAST(market AS DOUBLE))),
            CAST(stock AS DOUBLE)) AS units FROM priced),
        totals AS (SELECT strategy, sum(p / 1e2 * units) AS revenue, sum((p / 1e2 - cost / 1e2) * units) AS profit,
          count(*) FILTER ((p - cost) * 10000 < 1500 * p OR abs(p - before) * 10000 > 2500 * before) AS bad,
          count(*) FILTER (p <> before) AS moves FROM sold GROUP BY strategy),
        compared AS (SELECT *, max(profit) FILTER (strategy = 'static') OVER () AS b,
          max(profit) FILTER (strategy = 'optimum') OVER () AS o FROM totals)""",
        """SELECT strategy, round(profit) AS gross_profit, round(revenue) AS revenue,
          round(100 * (profit - b) / b, 2) AS profit_vs_baseline_pct,
          round(100 * (profit - b) / nullif(o - b, 0), 1) AS share_of_bound_uplift_pct,
          round(100 * profit / revenue, 2) AS avg_margin_pct, bad AS guardrail_violations, moves AS price_changes
          FROM compared""",
        recursive=True,
    ),
    # windows that the watermark, ten minutes behind the newest event, has closed
    "stream_success_rate": """
        SELECT date_trunc('hour', ts) AS window_start, count(*) AS events,
          round(avg(CASE WHEN event_type <> 'error' THEN 1e0 ELSE 0e0 END), 6) AS success_rate
        FROM events GROUP BY 1
        HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
    "stream_price_feed": _q(
        PRICES, "SELECT sku, competitor, price / 1e2 AS price, in_stock, date FROM prices"
    ),
}
