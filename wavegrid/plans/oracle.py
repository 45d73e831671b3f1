"""SQL for the queries, written on its own for an independent engine."""

from __future__ import annotations

from wavegrid.functions.columns import CHANNEL_MASKS, DEPTH_CODES, MASK_BITS, RATE_CODES
from wavegrid.operators.framing import LEVELS
from wavegrid.operators.metadata import AIFF_TEXTS, CAF_KEYS, CAF_OTHER_DATE, INFO_KEYS, MASK_KEY
from wavegrid.operators.planning import EXTENSIONS
from wavegrid.plans.queries import COEFFICIENTS, QUERIES

B = "CAST({} AS BIGINT)".format
EV = "ev AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS i, CAST(round(value * 100) AS BIGINT) - 25000 AS x FROM events)"
FR = EV + ", fr AS (SELECT user_id, i // 16 AS frame, i % 16 AS j, x, CAST(count(*) OVER (PARTITION BY user_id, i // 16) AS BIGINT) AS n FROM ev)"
ST = EV + ", st AS (SELECT user_id, i // 2 AS i, x AS l, nxt AS r FROM (SELECT *, lead(x) OVER (PARTITION BY user_id ORDER BY i) AS nxt FROM ev) WHERE i % 2 = 0 AND nxt IS NOT NULL)"
TOT = "tot AS (SELECT user_id, CAST(count(*) AS BIGINT) AS total FROM events GROUP BY user_id)"
FOLD = "CASE WHEN r >= 0 THEN 2 * r ELSE -2 * r - 1 END"


def bits(v: str) -> str:
    return f"CASE WHEN ({v}) = 0 THEN 0 ELSE length(bin(CAST({v} AS BIGINT))) END"


def log2(v: str) -> str:
    return f"greatest(({bits(v)}) - 1, 0)"


def width(low: str, high: str) -> str:
    return f"CASE WHEN {low} = 0 AND {high} = 0 THEN 0 WHEN ({bits(f'greatest({high}, -{low} - 1)')}) + 1 <= 31 THEN ({bits(f'greatest({high}, -{low} - 1)')}) + 1 END"


def pmod(v: str, m: int) -> str:
    return f"((({v}) % {m} + {m}) % {m})"


def difference(k: int, by: str) -> str:
    terms = {0: "x", 1: "x - lag(x, 1) OVER w", 2: "x - 2 * lag(x, 1) OVER w + lag(x, 2) OVER w", 3: "x - 3 * lag(x, 1) OVER w + 3 * lag(x, 2) OVER w - lag(x, 3) OVER w", 4: "x - 4 * lag(x, 1) OVER w + 6 * lag(x, 2) OVER w - 4 * lag(x, 3) OVER w + lag(x, 4) OVER w"}
    return f"SELECT {by}, frame, n, j, CAST({k} AS BIGINT) AS k, {terms[k]} AS r FROM fr WINDOW w AS (PARTITION BY {by}, frame ORDER BY j)"


def residuals(by: str = "user_id", orders=range(5)) -> str:
    return "rs AS (SELECT * FROM (" + " UNION ALL ".join(difference(k, by) for k in orders) + ") WHERE j >= k)"


def partitions(by: str = "user_id") -> str:
    """From fr on: the costs of each partition by both methods."""

    def method(m: int, size: int, most: int) -> str:
        e = f"least(e, {most})"
        escape, zero, rice = f"{size + 5} + c * ({width('low', 'high')})", f"CASE WHEN {e} <= 2 THEN {size} + folded + c END", f"{size} + q{m} + c * ({e} + 1)"
        best = f"least({escape}, coalesce({zero}, {rice}), {rice})"
        return f""", {B(best)} AS bits{m}, CASE WHEN {escape} = {best} THEN 'escape' ELSE 'rice' END AS kind{m},
          {B(f"CASE WHEN {escape} = {best} THEN {width('low', 'high')} WHEN ({zero}) = {best} THEN 0 ELSE {e} END")} AS parameter{m}"""

    orders = "CASE " + " ".join(f"WHEN n % {1 << p} = 0 AND (n >> {p}) > k THEN {p}" for p in range(6, -1, -1)) + " END"
    return f"""{residuals(by)},
    hi AS (SELECT *, {orders} AS h, {FOLD} AS u FROM rs),
    pt AS (SELECT {by}, frame, n, k, j, r, u, CAST(p AS BIGINT) AS p, j // (n >> p) AS part FROM (SELECT *, unnest(list_distinct([h, greatest(h - 1, 0), 0])) AS p FROM hi WHERE h IS NOT NULL)),
    es AS (SELECT *, {log2("CAST(sum(u) OVER z // count(*) OVER z AS BIGINT)")} AS e FROM pt WINDOW z AS (PARTITION BY {by}, frame, k, p, part)),
    sm AS (SELECT {by}, frame, n, k, p, part, CAST(count(*) AS BIGINT) AS c, CAST(sum(u) AS BIGINT) AS folded, min(r) AS low, max(r) AS high, max(e) AS e, CAST(sum(u >> least(e, 14)) AS BIGINT) AS q0, CAST(sum(u >> least(e, 30)) AS BIGINT) AS q1 FROM es GROUP BY ALL),
    pc AS (SELECT {by}, frame, n, k, p, part, c, folded, low, high {method(0, 4, 14)} {method(1, 5, 30)} FROM sm)"""


def choices(by: str = "user_id") -> str:
    return f"""{partitions(by)},
    ps AS (SELECT {by}, frame, n, k, p, CAST(sum(bits0) AS BIGINT) + 6 AS b0, CAST(sum(bits1) AS BIGINT) + 6 AS b1, {log2("CAST(sum(folded) // sum(c) AS BIGINT)")} AS e, min(low) AS low, max(high) AS high FROM pc GROUP BY ALL),
    op AS (SELECT {by}, frame, n, k, p, CAST(0 AS BIGINT) AS method, b0 AS bits FROM ps WHERE low >= -1073741824 AND high <= 1073741823 UNION ALL SELECT {by}, frame, n, k, p, 1, b1 FROM ps WHERE e > 14 AND low >= -1073741824 AND high <= 1073741823),
    rc AS (SELECT {by}, frame, n, k, p, method, bits FROM (SELECT *, row_number() OVER (PARTITION BY {by}, frame, k ORDER BY bits, p DESC, method) AS rn FROM op) WHERE rn = 1)"""


def subframes(depth: int, by: str = "user_id") -> str:
    return f"""{choices(by)},
    fo AS (
      SELECT {by}, frame, n, CASE WHEN min(x) = max(x) THEN {8 + depth} END AS bits, 0 AS rank, 'constant' AS kind, NULL AS k, NULL AS p, NULL AS method FROM fr GROUP BY {by}, frame, n
      UNION ALL SELECT DISTINCT {by}, frame, n, 8 + n * {depth}, 1, 'verbatim', NULL, NULL, NULL FROM fr
      UNION ALL SELECT {by}, frame, n, bits + 8 + k * {depth}, 2 + k, 'fixed', k, p, method FROM rc),
    sf AS (SELECT {by}, frame, n, kind, {B('k')} AS "order", {B('p')} AS p, {B('method')} AS method, {B('bits')} AS bits FROM (SELECT *, row_number() OVER (PARTITION BY {by}, frame ORDER BY bits, rank) AS rn FROM fo WHERE bits IS NOT NULL) WHERE rn = 1)"""


def case(column: str, values: dict, otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in values.items()) + f" ELSE {otherwise} END"


def adaptive() -> str:
    """From fr on: predictors of order 1 and 2 by their closed forms (ad: shift, c1, c2), and their residuals (lr)."""
    shifts = "(SELECT unnest(range(0, 16)) AS shift)"
    tiny = "2.220446049250313e-16"
    q = lambda a: f"sign({a}) * floor(abs({a} * pow(2.0, shift)) + 0.5)"
    return f"""ac AS (SELECT user_id, frame, n, CAST(sum(x * x) AS DOUBLE) AS r0, CAST(coalesce(sum(x * y), 0) AS DOUBLE) AS r1, CAST(coalesce(sum(x * z), 0) AS DOUBLE) AS r2
        FROM (SELECT *, lag(x, 1) OVER w AS y, lag(x, 2) OVER w AS z FROM fr WINDOW w AS (PARTITION BY user_id, frame ORDER BY j)) GROUP BY user_id, frame, n),
      l1 AS (SELECT *, r1 / r0 AS k1 FROM ac WHERE r0 > 0 AND n > 1), e1 AS (SELECT *, r0 * (1 - k1 * k1) AS err FROM l1),
      l2 AS (SELECT *, (r2 - k1 * r1) / err AS k2 FROM e1 WHERE err > {tiny} AND n > 2), e2 AS (SELECT *, err * (1 - k2 * k2) AS err2 FROM l2),
      pr AS (SELECT user_id, frame, n, CAST(1 AS BIGINT) AS k, k1 AS a1, 0.0 AS a2 FROM e1 WHERE err > {tiny} UNION ALL SELECT user_id, frame, n, 2, k1 - k2 * k1, k2 FROM e2 WHERE err2 > {tiny}),
      qs AS (SELECT *, {q('a1')} AS s1, {q('a2')} AS s2 FROM pr CROSS JOIN {shifts}),
      qe AS (SELECT *, (a1 - s1 / pow(2.0, shift)) * (a1 - s1 / pow(2.0, shift)) + (a2 - s2 / pow(2.0, shift)) * (a2 - s2 / pow(2.0, shift)) AS e FROM qs WHERE greatest(abs(s1), abs(s2)) <= 16383),
      ad AS (SELECT user_id, frame, n, k, CAST(shift AS BIGINT) AS shift, CAST(s1 AS BIGINT) AS c1, CAST(s2 AS BIGINT) AS c2 FROM (SELECT *, row_number() OVER (PARTITION BY user_id, frame, k ORDER BY e, shift DESC) AS rn FROM qe) WHERE rn = 1),
      lr AS (SELECT ad.user_id, ad.frame, ad.n, j, k, shift, c1, c2, x - CAST(floor((c1 * y + c2 * coalesce(z, 0)) / pow(2.0, shift)) AS BIGINT) AS r
        FROM ad JOIN (SELECT *, lag(x, 1) OVER w AS y, lag(x, 2) OVER w AS z FROM fr WINDOW w AS (PARTITION BY user_id, frame ORDER BY j)) s ON ad.user_id = s.user_id AND ad.frame = s.frame WHERE j >= k)"""


def checksums(name: str, poly: int, width: int) -> str:
    """A column's checksum over the bytes bs, one after another, by the remainders of all bytes."""
    remainders, top = [], 1 << (width - 1)
    for b in range(256):
        r = b << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ (poly if r & top else 0)) & ((1 << width) - 1)
        remainders.append(r)
    step = f"xor((a * 256) & {(1 << width) - 1}, {remainders}[xor(a // {1 << (width - 8)}, b) + 1])"
    return f"{B(f'list_reduce(list_prepend(0, bs), lambda a, b: {step})')} AS {name}"


def with_adaptive(depth: int) -> str:
    by = "user_id, lpc"
    own = "rs AS (SELECT user_id, false AS lpc, frame, n, j, k, r FROM (" + " UNION ALL ".join(difference(k, "user_id") for k in range(5)) + ") WHERE j >= k UNION ALL SELECT user_id, true, frame, n, j, k, r FROM lr)"
    return f"""{adaptive()}, {choices(by).replace(residuals(by), own)},
    fo AS (
      SELECT user_id, frame, n, CASE WHEN min(x) = max(x) THEN {8 + depth} END AS bits, 0 AS rank, 'constant' AS kind, NULL AS k, NULL AS p, NULL AS method FROM fr GROUP BY user_id, frame, n
      UNION ALL SELECT DISTINCT user_id, frame, n, 8 + n * {depth}, 1, 'verbatim', NULL, NULL, NULL FROM fr
      UNION ALL SELECT user_id, frame, n, bits + 8 + k * {depth} + CASE WHEN lpc THEN 9 + 15 * k ELSE 0 END, CASE WHEN lpc THEN 10 ELSE 2 END + k, CASE WHEN lpc THEN 'lpc' ELSE 'fixed' END, k, p, method FROM rc),
    sf AS (SELECT user_id, frame, n, kind, {B('k')} AS "order", {B('p')} AS p, {B('method')} AS method, {B('bits')} AS bits FROM (SELECT *, row_number() OVER (PARTITION BY user_id, frame ORDER BY bits, rank) AS rn FROM fo WHERE bits IS NOT NULL) WHERE rn = 1)"""


PLAN = TOT + ", pl AS (SELECT user_id, total, frame, frame * 16 AS sample_offset, least(16, total - frame * 16) AS block_size FROM (SELECT *, unnest(range(0, (total + 15) // 16)) AS frame FROM tot))"
SCHEDULE = "sc AS (SELECT frame, CAST(coalesce(sum(block_size) OVER (ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sample_offset, block_size FROM (SELECT frame, 16 + frame * 7 % 33 AS block_size FROM (SELECT unnest(range(0, (SELECT max(event_id) FROM events) // 16 + 1)) AS frame)))"
COMMENTS = "c AS (SELECT conv_id, turn AS pos, upper(role) AS key, substring(text, 1, 40) AS value FROM conversations)"
FRAMES = f"{FR}, {subframes(17)}, fm AS (SELECT user_id, frame, n AS block_size, (bits + 7) // 8 + 8 AS frame_size FROM sf)"
DIGEST = FR.replace("// 16", "// 64").replace("% 16", "% 64") + ", dg AS (SELECT user_id, md5(string_agg(d, '' ORDER BY frame)) AS digest FROM (SELECT user_id, frame, md5(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS d FROM fr GROUP BY user_id, frame) GROUP BY user_id)"
DIGESTS = EV + ", hx AS (SELECT user_id, i, ((x % 16777216) + 16777216) % 16777216 AS u FROM ev), sd AS (SELECT user_id, CAST(count(*) AS BIGINT) AS samples, md5(unhex(string_agg(printf('%02X%02X%02X', u % 256, u // 256 % 256, u // 65536), '' ORDER BY i))) AS md5 FROM hx GROUP BY user_id)"
HEX8 = "'0x' || lpad(lower(hex({})), 8, '0')".format
MASKS = case("v", CHANNEL_MASKS, "NULL")

SQL: dict[str, str] = {
    "q_frame_roundtrip": f"WITH {FR} SELECT user_id, frame, j, x FROM fr",
    "q_frame_fixed": f"WITH {FR} SELECT user_id, frame, j, n, x FROM fr",
    "q_frame_plan": f"WITH {PLAN} SELECT user_id, total, frame, sample_offset, block_size FROM pl",
    "q_frame_variable": f"WITH {SCHEDULE}, e AS (SELECT event_id AS i, CAST(round(value * 100) AS BIGINT) - 25000 AS x FROM events) SELECT frame, sample_offset, block_size, {B('count(*)')} AS n, {B('sum(x)')} AS total FROM e JOIN sc ON i >= sample_offset AND i < sample_offset + block_size GROUP BY ALL",
    "q_frame_validate": f"WITH {TOT}, p AS (SELECT user_id, total, user_id % 11 AS channels, user_id * 4001 AS rate, user_id % 40 AS bits, user_id % 64 AS block_size FROM tot) SELECT *, CASE WHEN NOT channels BETWEEN 1 AND 8 THEN 'channels' WHEN NOT rate BETWEEN 1 AND 1048575 THEN 'rate' WHEN NOT bits BETWEEN 4 AND 32 THEN 'bits' WHEN NOT block_size BETWEEN 16 AND 65535 THEN 'block_size' WHEN NOT total BETWEEN 0 AND 68719476735 THEN 'total' END AS fault FROM p",
    "q_levels": "WITH lv(level, block_size, max_fixed_order, max_lpc_order, max_partition_order, mid_side) AS (VALUES " + ", ".join(f"({', '.join(f'CAST({v} AS BIGINT)' for v in row[:5])}, {str(row[5]).lower()})" for row in LEVELS) + ") SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, lv.* FROM nation JOIN lv ON n_nationkey % 9 = level",
    "q_pack_chunks": f"WITH t AS (SELECT count(*) AS total FROM events), p AS (SELECT frame, least(16, total - frame * 16) AS block_size FROM (SELECT total, unnest(range(0, (total + 15) // 16)) AS frame FROM t)) SELECT frame // 256 AS batch, {B('count(*)')} AS frames, {B('sum(block_size)')} AS samples FROM p GROUP BY 1",
    "q_pack_variable": f"""WITH RECURSIVE {TOT}, s AS (SELECT user_id % 5 AS stream, user_id AS frame, total AS size, row_number() OVER (PARTITION BY user_id % 5 ORDER BY user_id) AS k FROM tot),
      f AS (SELECT stream, frame, k, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS held, size AS samples FROM s WHERE k = 1
        UNION ALL SELECT s.stream, s.frame, s.k, CASE WHEN held >= 4 OR samples + size > 250 THEN batch + 1 ELSE batch END, CASE WHEN held >= 4 OR samples + size > 250 THEN 1 ELSE held + 1 END, CASE WHEN held >= 4 OR samples + size > 250 THEN size ELSE samples + size END FROM f JOIN s ON s.stream = f.stream AND s.k = f.k + 1)
      SELECT stream, batch, {B('count(*)')} AS frames, min(frame) AS first FROM f GROUP BY stream, batch""",
    "q_deinterleave": f"WITH {EV} SELECT user_id, i // 2 AS t, max(CASE WHEN i % 2 = 0 THEN x END) AS c0, max(CASE WHEN i % 2 = 1 THEN x END) AS c1 FROM ev GROUP BY 1, 2",
    "q_interleave": f"WITH {ST} SELECT user_id, i * 2 AS k, {B('0')} AS channel, l AS x FROM st UNION ALL SELECT user_id, i * 2 + 1, 1, r FROM st",
    "q_midside": f"WITH {ST} SELECT user_id, i, CAST(floor((l + r) / 2.0) AS BIGINT) AS mid, l - r AS side FROM st",
    "q_midside_inverse": f"WITH {ST} SELECT user_id, i, l, r FROM st",
    "q_leftside_inverse": f'WITH {ST} SELECT user_id, i, l AS "left", r AS "right" FROM st',
    "q_sideright_inverse": f'WITH {ST} SELECT user_id, i, l AS "left", r AS "right" FROM st',
    "q_stereo_choice": f"WITH {ST}, s AS (SELECT user_id, i // 16 AS frame, CAST(sum(abs(l) + abs(r)) AS BIGINT) AS independent_cost, CAST(sum(abs(CAST(floor((l + r) / 2.0) AS BIGINT)) + abs(l - r)) AS BIGINT) AS mid_side_cost FROM st GROUP BY 1, 2) SELECT *, mid_side_cost < independent_cost AS mid_side FROM s",
    **{f"q_fixed_residual_o{k}": f"WITH {FR}, {residuals(orders=[k])} SELECT user_id, frame, j, r FROM rs" for k in range(5)},
    "q_fixed_restore": f"WITH {FR}, z AS (SELECT user_id, frame, j, x, coalesce(lag(x, 1) OVER w, 0) AS a, coalesce(lag(x, 2) OVER w, 0) AS b, coalesce(lag(x, 3) OVER w, 0) AS c, coalesce(lag(x, 4) OVER w, 0) AS d FROM fr WINDOW w AS (PARTITION BY user_id, frame ORDER BY j)) SELECT {B('1')} AS k, user_id, frame, j, x - a AS d, x FROM z UNION ALL SELECT 2, user_id, frame, j, x - 2 * a + b, x FROM z UNION ALL SELECT 3, user_id, frame, j, x - 3 * a + 3 * b - c, x FROM z UNION ALL SELECT 4, user_id, frame, j, x - 4 * a + 6 * b - 4 * c + d, x FROM z",
    "q_autocorr": f"WITH {FR}, l AS (SELECT unnest(range(0, 5)) AS lag) SELECT a.user_id, a.frame, l.lag, {B('coalesce(sum(a.x * b.x), 0)')} AS value FROM fr a CROSS JOIN l LEFT JOIN fr b ON a.user_id = b.user_id AND a.frame = b.frame AND a.j - l.lag = b.j GROUP BY 1, 2, 3",
    "q_autocorr_embed": "WITH e AS (SELECT vec_id, CAST(floor(CAST(v AS DOUBLE) * 32768) AS BIGINT) AS x, i FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings)) SELECT a.vec_id, " + ", ".join(f"{B(f'coalesce(sum(CASE WHEN a.i - b.i = {m} THEN a.x * b.x END), 0)')} AS a{m}" for m in range(3)) + " FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i - b.i BETWEEN 0 AND 2 GROUP BY 1",
    "q_lpc_quantise": "WITH c(id, c) AS (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), CAST({v} AS DOUBLE))" for i, _, v in COEFFICIENTS) + "), s AS (SELECT id, c, shift, sign(c) * floor(abs(c * pow(2.0, shift)) + 0.5) AS q FROM c CROSS JOIN (SELECT unnest(range(0, 16)) AS shift)), g AS (SELECT id, shift, sum((c - q / pow(2.0, shift)) * (c - q / pow(2.0, shift))) AS error, max(abs(q)) AS most FROM s GROUP BY 1, 2) SELECT id, CAST(shift AS BIGINT) AS shift FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY error, shift DESC) AS rn FROM g WHERE most <= 16383) WHERE rn = 1",
    "q_lpc_residual": f"WITH {FR} SELECT user_id, frame, j, r FROM (SELECT user_id, frame, j, x - CAST(floor((29491 * lag(x, 1) OVER w - 13107 * lag(x, 2) OVER w) / 16384.0) AS BIGINT) AS r FROM fr WINDOW w AS (PARTITION BY user_id, frame ORDER BY j)) WHERE j >= 2",
    "q_lpc_restore": f"WITH {FR} SELECT user_id, frame, j, x FROM fr",
    "q_lpc_orders": "WITH lv(level, most) AS (VALUES " + ", ".join(f"(CAST({r[0]} AS BIGINT), {r[3]})" for r in LEVELS) + """), r(rate, n) AS (VALUES (CAST(8000 AS BIGINT), CAST(4096 AS BIGINT)), (44100, 4096), (48000, 10), (96000, 4096), (192000, 20), (96000, 1)),
      l AS (SELECT level, rate, n, least(most, 32, CASE WHEN rate <= 48000 THEN 12 ELSE 32 END, n - 1) AS m FROM lv CROSS JOIN r) SELECT level, rate, n, CAST(unnest(CASE WHEN m <= 4 THEN range(1, m + 1) ELSE list_distinct(list_filter([8, 12, m], lambda o: o <= m)) END) AS BIGINT) AS "order" FROM l""",
    "q_warmup": f"WITH {FR} SELECT user_id, frame, k, string_agg(CAST(x AS VARCHAR), ',' ORDER BY j) AS warmup FROM fr JOIN (SELECT unnest(range(1, 5)) AS k) ON j < k GROUP BY 1, 2, 3",
    "q_fold": f"WITH {EV} SELECT user_id, i, x, {FOLD.replace('r ', 'x ').replace(' r', ' x')} AS u FROM ev",
    "q_unfold": f"WITH {EV} SELECT user_id, i, CASE WHEN x >= 0 THEN 2 * x ELSE -2 * x - 1 END AS u, x FROM ev",
    "q_rice_param": f"WITH {FR}, {residuals(orders=[1])}, g AS (SELECT user_id, frame, {B(f'sum({FOLD})')} AS folded, {B('count(*)')} AS n FROM rs GROUP BY 1, 2) SELECT *, {B('least(' + log2('folded // n') + ', 14)')} AS four, {B('least(' + log2('folded // n') + ', 30)')} AS five, {log2('folded // n')} <= 2 AS zero_too FROM g",
    "q_rice_cost": f"WITH {FR}, {residuals(orders=[1])}, g AS (SELECT user_id, frame, {FOLD} AS u, unnest(range(0, 15)) AS parameter FROM rs) SELECT user_id, frame, parameter, {B('sum((u >> parameter) + 1 + parameter) + 4')} AS bits FROM g GROUP BY 1, 2, 3",
    "q_escape_cost": f"WITH {FR}, {residuals(orders=[2])}, g AS (SELECT user_id, frame, {B('count(*)')} AS n, min(r) AS low, max(r) AS high FROM rs GROUP BY 1, 2) SELECT *, {B(width('low', 'high'))} AS width, {B(f'9 + n * ({width("low", "high")})')} AS bits FROM g",
    "q_partition_choice": f"WITH {FR}, {partitions()} SELECT user_id, frame, k, p, part, c AS count, bits0, kind0, parameter0, bits1, kind1, parameter1 FROM pc",
    "q_partition_orders": f"WITH {PLAN}, s AS (SELECT DISTINCT block_size AS n FROM pl UNION SELECT unnest([576, 1152, 4096, 4608, 1000])), r AS (SELECT n, unnest(range(0, 5)) AS k FROM s), h AS (SELECT n, k, CASE " + " ".join(f"WHEN n % {1 << p} = 0 AND (n >> {p}) > k THEN {p}" for p in range(6, -1, -1)) + f" END AS h FROM r) SELECT {B('n')} AS n, {B('k')} AS k, {B('p')} AS p FROM (SELECT n, k, unnest(list_distinct([h, greatest(h - 1, 0), 0])) AS p FROM h WHERE h IS NOT NULL)",
    "q_residual_choice": f"WITH {FR}, {choices()} SELECT user_id, frame, k, p, method, bits FROM rc",
    "q_constant_block": f"WITH o AS (SELECT o_orderstatus AS status, o_orderkey // 4 AS frame, CAST(round(o_totalprice * 100) AS BIGINT) // 10000000 AS x FROM orders) SELECT status, frame, {B('count(*)')} AS n, min(x) = max(x) AS constant FROM o GROUP BY 1, 2",
    "q_subframe_choice": f"WITH {FR}, {subframes(17)} SELECT * FROM sf",
    "q_frame_cost": f"""WITH {ST}, pn AS (SELECT user_id, {B('0')} AS c, i, l AS x FROM st UNION ALL SELECT user_id, 1, i, r FROM st UNION ALL SELECT user_id, 2, i, CAST(floor((l + r) / 2.0) AS BIGINT) FROM st UNION ALL SELECT user_id, 3, i, l - r FROM st),
      fr AS (SELECT user_id, c AS ch, i // 16 AS frame, i % 16 AS j, x, CAST(count(*) OVER (PARTITION BY user_id, c, i // 16) AS BIGINT) AS n FROM pn), {subframes(16, 'user_id, ch')},
      b AS (SELECT user_id, ch, frame, bits + CASE WHEN ch < 3 THEN 0 WHEN kind = 'verbatim' THEN n WHEN kind = 'constant' THEN 1 ELSE "order" END AS bits FROM sf),
      s AS (SELECT user_id, frame, {B('sum(CASE WHEN ch < 2 THEN bits END)')} AS independent, {B('sum(CASE WHEN ch > 1 THEN bits END)')} AS mid_side_bits FROM b GROUP BY 1, 2),
      q AS (SELECT user_id, i // 16 AS frame, sum(abs(CAST(floor((l + r) / 2.0) AS BIGINT)) + abs(l - r)) < sum(abs(l) + abs(r)) AS ms FROM st GROUP BY 1, 2)
      SELECT s.*, CASE WHEN ms THEN mid_side_bits ELSE independent END AS bits FROM s JOIN q ON s.user_id = q.user_id AND s.frame = q.frame""",
    "q_streaminfo": f"WITH {FR}, {subframes(17)}, s AS (SELECT *, (bits + 7) // 8 AS fb, max(frame) OVER (PARTITION BY user_id) AS last FROM sf) SELECT user_id, min(CASE WHEN NOT (frame = last AND last > 0 AND n < 16) THEN n END) AS min_block, max(n) AS max_block, min(fb) AS min_frame, max(fb) AS max_frame, {B('sum(n)')} AS total FROM s GROUP BY user_id",
    "q_summary": f"WITH {FR}, {subframes(17)} SELECT user_id, {B('count(*)')} AS frames, {B('sum(n)')} AS samples, {B('sum(bits)')} AS bits, {B("count(*) FILTER (kind = 'fixed')")} AS fixed, {B("count(*) FILTER (kind = 'verbatim')")} AS verbatim FROM sf GROUP BY user_id",
    "q_stream_md5": f"WITH {DIGEST} SELECT user_id, digest FROM dg",
    "q_md5_verify": f"WITH {DIGEST}, e AS (SELECT user_id, digest, CASE user_id % 3 WHEN 0 THEN repeat('0', 32) WHEN 1 THEN digest ELSE reverse(digest) END AS expected FROM dg) SELECT user_id, expected, expected = repeat('0', 32) OR expected = digest AS verified FROM e",
    "q_pack_sample": f"WITH {EV} SELECT user_id, i, {pmod('x', 64)} * 4 AS p8, ({pmod('x', 4096)} - 2048) * 16 AS p16, x * 16 AS p24 FROM ev",
    "q_unpack_sample": f"WITH {EV}, u AS (SELECT user_id, i, x, {pmod('x * 16', 1 << 24)} AS u FROM ev) SELECT user_id, i, u % 256 AS b0, (u >> 8) % 256 AS b1, u >> 16 AS b2, x FROM u",
    "q_container_bits": f"SELECT v, {B('((v + 7) // 8) * 8')} AS bits FROM (SELECT unnest(range(1, 33)) AS v)",
    "q_channel_mask": f"SELECT v, {B(MASKS)} AS mask, CASE WHEN v <= 8 THEN {HEX8(MASKS)} END AS text FROM (SELECT unnest(range(1, 10)) AS v)",
    "q_mask_valid": f"SELECT *, mask <= {MASK_BITS} AND bit_count(mask) <= channels AS valid FROM (SELECT o_orderkey, o_orderkey * 2654435761 % 1048576 AS mask, o_orderkey % 8 + 1 AS channels FROM orders)",
    "q_blocksize_code": "SELECT v, CAST(code AS BIGINT) AS code, CAST(CASE code WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END AS BIGINT) AS extra FROM (SELECT v, CASE WHEN v = 192 THEN 1 WHEN v IN (576, 1152, 2304, 4608) THEN 2 + " + "CAST(log2(v / 576) AS INTEGER)" + " WHEN v IN (256, 512, 1024, 2048, 4096, 8192, 16384, 32768) THEN 8 + CAST(log2(v / 256) AS INTEGER) WHEN v <= 256 THEN 6 ELSE 7 END AS code FROM (SELECT unnest(range(1, 5000)) AS v))",
    "q_rate_code": f"WITH r AS (SELECT v * 350 + CASE WHEN v % 7 = 0 THEN 1 ELSE 0 END + 1 AS rate FROM (SELECT unnest(range(0, 3000)) AS v) UNION ALL SELECT unnest({list(RATE_CODES.values())})) SELECT {B('rate')} AS rate, {B('coalesce(' + case('rate', {v: k for k, v in RATE_CODES.items()}, 'NULL') + ', CASE WHEN rate % 1000 = 0 AND rate <= 255000 THEN 12 WHEN rate <= 65535 THEN 13 WHEN rate % 10 = 0 AND rate <= 655350 THEN 14 ELSE 0 END)')} AS code FROM r",
    "q_depth_code": f"SELECT v, {B(case('v', {v: k for k, v in DEPTH_CODES.items()}, '0'))} AS code FROM (SELECT unnest(range(4, 33)) AS v)",
    "q_varint_len": f"WITH o AS (SELECT o_orderkey, o_orderkey * 7919 * 7919 % 68719476736 AS v FROM orders UNION ALL SELECT -k - 1, CAST(1 AS BIGINT) << k FROM (SELECT unnest(range(0, 36)) AS k)) SELECT o_orderkey, v, {B('CASE WHEN v < 128 THEN 1 ELSE (length(bin(v)) + 3) // 5 END')} AS bytes FROM o",
    "q_streaminfo_pack": f"WITH {TOT} SELECT user_id, CAST((user_id * 977 + 8000) * 17592186044416 + user_id % 8 * 2199023255552 + (user_id % 29 + 3) * 68719476736 + total AS BIGINT) AS packed, user_id * 977 + 8000 AS rate, user_id % 8 + 1 AS channels, user_id % 29 + 4 AS bits, total FROM tot",
    "q_padded_sizes": "SELECT v, (v + 1) // 2 * 2 AS riff, (v + 7) // 8 * 8 AS w64 FROM (SELECT unnest(range(0, 200)) AS v)",
    "q_progress_text": f"WITH e AS (SELECT event_id AS i, {pmod('(CAST(round(value * 100) AS BIGINT) - 25000) * 7', 100000)} AS s FROM events) SELECT i, CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS clock, '[' || repeat('=', CAST(20 * (s % 1000) // 1000 AS INTEGER)) || repeat(' ', 20 - CAST(20 * (s % 1000) // 1000 AS INTEGER)) || ']' AS bar, CASE WHEN length('signal-' || s) <= 9 THEN 'signal-' || s ELSE substring('signal-' || s, 1, 8) || '…' END AS name FROM e",
    "q_comment_split": "WITH e AS (SELECT conv_id, turn, substring(CASE turn % 5 WHEN 0 THEN text WHEN 1 THEN '=' || text ELSE role || '=' || text END, 1, 60) AS entry FROM conversations) SELECT conv_id, turn, CASE WHEN strpos(entry, '=') > 1 THEN substring(entry, 1, strpos(entry, '=') - 1) END AS key, CASE WHEN strpos(entry, '=') > 1 THEN substring(entry, strpos(entry, '=') + 1) END AS value FROM e",
    "q_mask_text": f"SELECT o_orderkey, {HEX8('m')} AS text, m AS mask FROM (SELECT o_orderkey, o_orderkey * 2654435761 % 262144 AS m FROM orders)",
    "q_comments_visible": f"WITH {COMMENTS} SELECT * FROM c WHERE pos NOT IN (1, 2)",
    "q_comments_group": f"WITH {COMMENTS} SELECT conv_id, key, {B('count(*)')} AS n, arg_min(value, pos) AS first, arg_max(value, pos) AS last FROM c GROUP BY 1, 2",
    "q_comments_replace": f"WITH {COMMENTS}, d AS (SELECT * FROM c WHERE key <> 'USER' UNION ALL SELECT DISTINCT conv_id, CAST(4611686018427387904 AS BIGINT), 'user', 'new' FROM conversations) SELECT conv_id, key, {B('count(*)')} AS n, arg_max(value, pos) AS last FROM d GROUP BY 1, 2",
    "q_comments_remove": f"WITH {COMMENTS} SELECT conv_id, {B("count(*) FILTER (key = 'USER')")} AS removed, {B("count(*) FILTER (key <> 'USER')")} AS \"left\" FROM c GROUP BY 1",
    "q_comments_listagg": f"WITH {COMMENTS} SELECT conv_id, key, string_agg(value, ',' ORDER BY pos) AS value FROM c GROUP BY 1, 2",
    "q_info_keys": "WITH i(chunk) AS (VALUES " + ", ".join(f"('{k}')" for k in [*INFO_KEYS, "XXXX"]) + f") SELECT chunk, {case('chunk', INFO_KEYS, 'NULL')} AS key FROM i",
    "q_info_projection": f"WITH k AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'Artist' WHEN 2 THEN 'mood' ELSE 'GENRE' END AS k FROM conversations) SELECT * FROM (SELECT *, {case('upper(k)', {v: k for k, v in INFO_KEYS.items()}, 'NULL')} AS chunk FROM k) WHERE chunk IS NOT NULL",
    "q_text_projection": f"WITH c AS (SELECT conv_id, turn, {[*INFO_KEYS, 'XXXX']}[turn % 10 + 1] AS chunk, CASE WHEN conv_id % 2 = 0 THEN '1999' ELSE substring(text, 1, 8) END AS value FROM conversations) SELECT conv_id, turn, chunk, {case('chunk', AIFF_TEXTS, 'NULL')} AS aiff, CASE WHEN chunk = 'ICRD' AND NOT regexp_full_match(value, '[0-9]{{4}}') THEN '{CAF_OTHER_DATE}' ELSE {case('chunk', CAF_KEYS, 'NULL')} END AS caf FROM c",
    "q_cue_normalise": f"WITH {EV}, {TOT}, d AS (SELECT DISTINCT user_id, {pmod('x', 150)} AS sample_offset FROM ev), k AS (SELECT d.user_id, sample_offset, count(*) OVER (PARTITION BY d.user_id) AS n FROM d JOIN tot ON d.user_id = tot.user_id WHERE sample_offset < total) SELECT user_id, {B('row_number() OVER (PARTITION BY user_id ORDER BY sample_offset) - 1')} AS pos, sample_offset FROM k WHERE n <= 99",
    "q_cue_points": f"WITH {EV}, t AS (SELECT user_id, i AS track, i // 2 * 588 + CASE WHEN i % 3 = 0 AND i % 2 = 1 THEN 588 ELSE 0 END AS sample_offset FROM ev WHERE i < 20), g AS (SELECT user_id, sample_offset, min(track) AS track FROM t GROUP BY 1, 2) SELECT user_id, {B('row_number() OVER (PARTITION BY user_id ORDER BY track) - 1')} AS pos, sample_offset FROM g",
    "q_blob_dictionary": f"WITH d AS (SELECT doc_id % 7 AS stream, doc_id AS ordinal, text, min(doc_id) OVER (PARTITION BY doc_id % 7, text) AS first FROM documents) SELECT stream, ordinal, {B('dense_rank() OVER (PARTITION BY stream ORDER BY first) - 1')} AS idx FROM d",
    "q_chunk_precedence": "WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 6 = 5 THEN 'fxmd' WHEN turn % 2 = 0 THEN 'LIST' ELSE 'cue ' END AS chunk FROM conversations) SELECT * FROM c WHERE chunk = 'fxmd' OR conv_id NOT IN (SELECT conv_id FROM c WHERE chunk = 'fxmd')",
    "q_block_order": f"WITH {TOT} SELECT user_id, {B('o')} AS ordinal, {B('CASE WHEN user_id % 4 = 0 THEN 2 - o ELSE 4 + o END')} AS block_type FROM tot CROSS JOIN (SELECT unnest([0, 1]) AS o)",
    "q_seek_points": f"WITH {TOT}, s AS (SELECT user_id, total, least(total, 7) AS m, unnest(range(0, least(total, 7))) AS slot FROM tot) SELECT user_id, slot, CASE WHEN m = total THEN slot ELSE slot * (total - 1) // (m - 1) END AS frame FROM s",
    "q_seek_offsets": f"WITH {FRAMES} SELECT user_id, frame, frame_size, {B('coalesce(sum(frame_size) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)')} AS frame_offset FROM fm",
    "q_seek_validate": f"WITH {EV}, p AS (SELECT user_id, i AS pos, CASE WHEN i % 17 = 16 THEN 9223372036854775807 ELSE i * 100 - CASE WHEN i % 10 = 9 THEN 150 ELSE 0 END END AS sample_number FROM ev), l AS (SELECT *, lag(sample_number) OVER (PARTITION BY user_id ORDER BY pos) AS b FROM p) SELECT user_id, pos, sample_number, CASE WHEN b = 9223372036854775807 AND sample_number <> 9223372036854775807 THEN 'after placeholder' WHEN sample_number <> 9223372036854775807 AND sample_number <= b THEN 'not ascending' END AS fault FROM l",
    "q_running_progress": f"WITH {FRAMES} SELECT user_id, frame, block_size, frame_size AS frame_bytes, {B('sum(block_size) OVER w')} AS samples_done, {B('count(*) OVER w')} AS frames_done, {B('sum(frame_size) OVER w + 42')} AS bytes_done FROM fm WINDOW w AS (PARTITION BY user_id ORDER BY frame)",
    "q_two_phase": f"WITH {PLAN}, p AS (SELECT user_id, frame, {B('ph')} AS phase, total, {B('sum(block_size) OVER (PARTITION BY user_id, ph ORDER BY frame)')} AS phase_done FROM pl CROSS JOIN (SELECT unnest([0, 1]) AS ph)) SELECT user_id, frame, phase, phase_done, phase_done + phase * total AS overall_done, total * 2 AS overall_total FROM p",
    "q_batch_rollup": f"SELECT user_id, event_id, 3 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS done, {B('3 * count(*) OVER (ORDER BY event_id)')} AS batch_done FROM events",
    "q_rate_eta": f"""WITH {EV}, {TOT}, u AS (SELECT ev.user_id, i, least(i // 2 * 2, total) AS done, i * 90 AS ms, total FROM ev JOIN tot ON ev.user_id = tot.user_id),
      a AS (SELECT *, CASE WHEN done > coalesce(lag(done) OVER (PARTITION BY user_id ORDER BY i), 0) THEN 1 ELSE 0 END AS adv FROM u),
      c AS (SELECT *, sum(adv) OVER w AS n, min(CASE WHEN adv = 1 THEN ms END) OVER w AS f FROM a WINDOW w AS (PARTITION BY user_id ORDER BY i)), k AS (SELECT *, coalesce(n >= 2 AND ms - f >= 250 AND ms > 0 AND done > 0, false) AS warm FROM c)
      SELECT user_id, i, warm, CASE WHEN warm THEN done * 1000 // ms END AS rate, CASE WHEN warm THEN (total - done) * ms // done END AS eta_ms FROM k""",
    "q_peak_inflight": f"WITH {EV}, e AS (SELECT user_id, i * 3 AS a, i * 3 + {pmod('x', 40)} + 1 AS b FROM ev) SELECT p.user_id, {B('max(c)')} AS peak FROM (SELECT s.user_id, s.a, count(*) AS c FROM e s JOIN e o ON s.user_id = o.user_id AND o.a <= s.a AND o.b > s.a GROUP BY 1, 2) p GROUP BY 1",
    "q_byte_counters": f"WITH {PLAN} SELECT user_id, frame, {B('2 * sum(block_size) OVER (PARTITION BY user_id ORDER BY frame) + 44')} AS bytes_done FROM pl",
    "q_ordered_drain": f"WITH {PLAN}, a AS (SELECT user_id, frame, (frame * 7 + user_id) % 10 AS arrival FROM pl) SELECT *, max(arrival) OVER (PARTITION BY user_id ORDER BY frame) AS released FROM a",
    "q_reconcile": f"WITH {TOT}, p AS (SELECT user_id, total + user_id % 3 - 1 AS planned FROM tot WHERE user_id % 7 <> 0), a AS (SELECT user_id, total AS found FROM tot WHERE user_id % 5 <> 0) SELECT coalesce(p.user_id, a.user_id) AS user_id, planned, found, CASE WHEN found IS NULL THEN 'missing' WHEN planned IS NULL THEN 'unplanned' WHEN found < planned THEN 'early end' WHEN found > planned THEN 'surplus' ELSE 'ok' END AS state FROM p FULL JOIN a ON p.user_id = a.user_id",
    "q_worklist": "WITH f AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '.wav' WHEN 1 THEN '.AIFF' WHEN 2 THEN '.txt' ELSE '.caf' END AS display FROM pages) SELECT display, '/in/' || display AS path, '/in/' || regexp_replace(display, '\\.[^./]*$', '') || '.flac' AS output, page_id AS phase_total, page_id * 2 AS overall_total FROM f WHERE len(string_split(display, '/')) <= 2 AND page_id % 4 <> 2",
    "q_output_family": f"WITH p AS (SELECT page_id, ['wav', 'RF64', 'w64', 'aif', 'aifc', 'caf', 'flac', 'mp3'][page_id % 8 + 1] AS e FROM pages) SELECT page_id, 'a.b/c.' || e AS path, {case('lower(e)', EXTENSIONS, 'NULL')} AS container FROM p",
    "q_sniff": "WITH h(head) AS (VALUES ('FORMxxxxAIFF'), ('caff'), ('RIFF'), ('RF64'), ('riff'), ('FOR'), ('')) SELECT head, CASE WHEN head LIKE 'FORM%' THEN 'aiff' WHEN head LIKE 'caff%' THEN 'caf' ELSE 'riff' END AS family FROM h",
    "q_container_resolve": "WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) * 150 AS data, ['auto', 'wave', 'rf64'][o_orderkey % 3 + 1] AS requested, o_orderkey % 4 + 1 AS channels FROM orders), s AS (SELECT *, 24 + data + data % 2 + 20 AS size FROM o) SELECT o_orderkey, requested, size, CASE WHEN requested = 'auto' AND size > 4294967295 THEN 'rf64' WHEN requested = 'auto' THEN 'wave' WHEN requested = 'wave' AND size > 4294967295 THEN NULL ELSE requested END AS container, channels <= 2 AS plain FROM s",
    "q_comments_append": f"""WITH c AS (SELECT conv_id, turn AS pos, upper(role) AS key, md5(text) AS value FROM conversations), g AS (SELECT conv_id, max(pos) + 1 AS nxt FROM c GROUP BY 1),
      a AS (SELECT * FROM c WHERE key <> '{MASK_KEY}' UNION ALL SELECT conv_id, nxt, lower('{MASK_KEY}'), '0x1' FROM g WHERE conv_id % 3 = 0 AND conv_id % 2 <> 0),
      m AS (SELECT conv_id, conv_id % 8 + 1 AS v, CASE WHEN conv_id % 4 = 0 THEN 3 ELSE 5 END AS mask FROM g WHERE conv_id % 2 = 0)
      SELECT * FROM a UNION ALL SELECT m.conv_id, nxt, '{MASK_KEY}', {HEX8('mask')} FROM m JOIN g ON m.conv_id = g.conv_id WHERE mask <> {MASKS}""",
    "q_blocks_edited": f"WITH {TOT}, k(origin, block_type, o) AS (VALUES ('preserved', CAST(4 AS BIGINT), 0), ('preserved', 6, 1), ('draft', 4, 2), ('draft', 5, 3)) SELECT user_id, origin, block_type, {B('CASE WHEN user_id % 3 = 0 THEN o - 2 ELSE o END')} AS ordinal FROM tot CROSS JOIN k WHERE (user_id % 3 = 0) = (origin = 'draft')",
    "q_cues_set": f"""WITH {EV}, {TOT}, d AS (SELECT DISTINCT user_id, CASE WHEN user_id % 10 = 5 THEN 2 * {pmod('x', 150)} ELSE {pmod('x', 150)} END AS sample_offset FROM ev WHERE user_id % 10 <> 0),
      k AS (SELECT d.user_id, sample_offset, count(*) OVER (PARTITION BY d.user_id) AS n FROM d JOIN tot ON d.user_id = tot.user_id WHERE sample_offset < total)
      SELECT user_id, {B('row_number() OVER (PARTITION BY user_id ORDER BY sample_offset) - 1')} AS pos, sample_offset FROM k WHERE n <= 99""",
    "q_stream_digest": f"WITH {DIGESTS} SELECT user_id, samples, md5 FROM sd",
    "q_digest_verify": f"WITH {DIGESTS} SELECT user_id, CASE user_id % 3 WHEN 0 THEN repeat('0', 32) WHEN 1 THEN md5 ELSE reverse(md5) END AS expected, user_id % 3 <> 2 OR md5 = reverse(md5) AS verified FROM sd",
    "q_decode_batches": f"""WITH RECURSIVE {FRAMES}, s AS (SELECT user_id, frame, block_size AS n, frame_size AS b, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS k FROM fm),
      f AS (SELECT user_id, frame, k, n, b, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS held, CAST(n AS BIGINT) AS hn, CAST(b AS BIGINT) AS hb FROM s WHERE k = 1
        UNION ALL SELECT user_id, frame, k, n, b, CASE WHEN cut THEN batch + 1 ELSE batch END, CASE WHEN cut THEN 1 ELSE held + 1 END, CASE WHEN cut THEN n ELSE hn + n END, CASE WHEN cut THEN b ELSE hb + b END
          FROM (SELECT s.*, f.batch, f.held, f.hn, f.hb, f.held >= 4 OR f.hn >= 60 OR f.hb >= 150 OR f.hn + s.n > 60 OR f.hb + s.b > 150 AS cut FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1))
      SELECT user_id, batch, {B('count(*)')} AS frames, {B('sum(n)')} AS samples, {B('sum(b)')} AS bytes, min(frame) AS first FROM f GROUP BY user_id, batch""",
    "q_portions": f"""WITH {PLAN}, b AS (SELECT user_id, frame AS block, sample_offset AS a, sample_offset + block_size AS z FROM pl),
      t AS (SELECT user_id, take, (take * 7 + 3) % 25 AS budget FROM (SELECT user_id, unnest(range(0, total // 14 + 1)) AS take FROM tot)),
      u AS (SELECT user_id, take, CAST(sum(budget) OVER w - budget AS BIGINT) AS a, CAST(sum(budget) OVER w AS BIGINT) AS z FROM t WINDOW w AS (PARTITION BY user_id ORDER BY take)),
      o AS (SELECT * FROM u UNION ALL SELECT user_id, NULL, max(z), 1000000000 FROM u GROUP BY user_id)
      SELECT b.user_id, block, take, greatest(b.a, o.a) - b.a AS first, least(b.z, o.z) - greatest(b.a, o.a) AS samples FROM b JOIN o ON b.user_id = o.user_id AND greatest(b.a, o.a) < least(b.z, o.z)""",
    "q_lifecycle": """WITH p AS (SELECT chr(97) || chr(9) || 'b/' || page_id AS file, page_id AS bytes, page_id * 7 % 100 * 10 AS a, page_id * 7 % 100 * 10 + page_id % 13 * 31 + 1 AS z, page_id % 7 = 0 AS bad FROM pages),
      e AS (SELECT file, bytes, a, a AS at_ms, 'file_begin' AS event FROM p UNION ALL SELECT file, bytes, a, z, CASE WHEN bad THEN 'file_error' ELSE 'file_finish' END FROM p)
      SELECT row_number() OVER (ORDER BY at_ms, event <> 'file_begin', file) - 1 AS seq, at_ms, event, file, 'event=' || event || chr(9) || 'kind=encode' || chr(9) || 'batch_mode=1' || chr(9) || 'filename=' || replace(file, chr(9), ' ') || chr(9) || 'input_bytes=' || bytes
        || chr(9) || 'elapsed_seconds=' || printf('%.9f', CAST(at_ms - a AS DOUBLE) / 1000) || chr(9) || 'command_elapsed_seconds=' || printf('%.9f', CAST(at_ms - (SELECT min(a) FROM p) AS DOUBLE) / 1000) AS line FROM e""",
    "q_worklist_deep": """WITH f AS (SELECT page_id, page_id % 5 + 1 AS lv, repeat('d/', CAST(page_id % 5 AS INTEGER)) || page_id AS stem, ['.wav', '.AIFF', '.txt', '.caf'][page_id % 4 + 1] AS e FROM pages WHERE page_id % 11 <> 0 AND page_id % 4 <> 2)
      SELECT stem || e AS display, '/in/' || stem || e AS path, '/in/' || stem || '.flac' AS output, page_id AS phase_total, page_id * 2 AS overall_total, CAST(0 AS BIGINT) AS depth FROM f
      UNION ALL SELECT stem || e, '/in/' || stem || e, '/in/' || stem || '.flac', page_id, page_id, 3 FROM f WHERE lv <= 3""",
    "q_enabled_container": """WITH o AS (SELECT o_orderkey, o_orderkey % 2 = 1 AS w, o_orderkey // 2 % 2 = 1 AS a, o_orderkey // 4 % 2 = 1 AS c, CAST(round(o_totalprice * 100) AS BIGINT) * 150 AS size, ['auto', 'wave', 'rf64', 'wave64', 'aiff', 'aifc', 'caf'][o_orderkey % 7 + 1] AS requested FROM orders),
      f AS (SELECT *, CASE WHEN requested IN ('wave', 'rf64', 'wave64') THEN 'wave' WHEN requested IN ('aiff', 'aifc') THEN 'aiff' WHEN requested = 'caf' THEN 'caf' END AS family FROM o)
      SELECT o_orderkey, requested, size, family, CASE WHEN requested = 'auto' THEN CASE WHEN w THEN CASE WHEN size > 4294967295 THEN 'rf64' ELSE 'wave' END WHEN a THEN 'aiff' WHEN c THEN 'caf' END
        WHEN NOT (family = 'wave' AND w OR family = 'aiff' AND a OR family = 'caf' AND c) OR (requested = 'wave' AND size > 4294967295) THEN NULL ELSE requested END AS container FROM f""",
    "q_lpc_candidates": f"WITH {FR}, {adaptive()} SELECT user_id, frame, k, shift, CASE WHEN k = 1 THEN CAST(c1 AS VARCHAR) ELSE c1 || ',' || c2 END AS coefficients, {B('sum(abs(r))')} AS magnitude FROM lr GROUP BY ALL",
    "q_subframe_lpc": f"WITH {FR}, {with_adaptive(17)} SELECT * FROM sf",
    "q_crc": f"WITH h AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS t FROM pages), b AS (SELECT page_id, list_transform(range(0, length(t) // 2), lambda i: CAST('0x' || substr(t, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS bs FROM h) SELECT page_id, {checksums('crc8', 0x07, 8)}, {checksums('crc16', 0x8005, 16)} FROM b",
    "q_text_payload": "SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 1) AND text <> '' THEN text WHEN turn % 4 = 3 THEN role END AS text FROM conversations",
}

#: Some of the SQL above cuts what its query doesn't: prefixes of texts, the first events of a stream, streams on neither side. It stands as it is; under names that end in
#: _whole the same queries have the same SQL without the cuts: what is cut, and what stands for the whole.
CUTS: dict[str, list[tuple[str, str]]] = {
    **dict.fromkeys(["q_comments_visible", "q_comments_group", "q_comments_replace", "q_comments_listagg"], [("substring(text, 1, 40)", "text")]),
    "q_comment_split": [("substring(CASE turn", "(CASE turn"), ("END, 1, 60)", "END)")],
    "q_cue_points": [(" FROM ev WHERE i < 20", " FROM ev")],
    "q_reconcile": [("WHERE user_id % 5 <> 0)", "WHERE user_id % 5 <> 0 OR user_id % 7 = 0)")],
}
for _name, _cuts in CUTS.items():
    _sql = SQL[_name]
    for _cut, _all in _cuts:
        _sql = _sql.replace(_cut, _all)
    SQL[f"{_name}_whole"] = _sql
    QUERIES[f"{_name}_whole"] = QUERIES[_name]
