"""The queries as SQL for an independent engine (DuckDB), from shared common table expressions."""

from __future__ import annotations

from ..functions import codes

_FROM, _TO, _TO_N = "etaoinshrdlcumwfgypbvkjxqz ", "acgtacgtacgtacgtacgtacgtacg", "acgtacgtacgtacgtacgtacgtang"


def quoted(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


#: Fixed values, stated here once more so that the SQL doesn't share the implementation's table: score, offsets in the
#: reversed window, motifs.
_RBS = """
27 5 10 ggagga
26 3 4 ggagga
25 11 12 ggagga
24 5 10 ggagg
23 3 4 ggagg
22 5 10 gagga
21 3 4 gagga
20 11 12 gagga|ggagg
19 5 10 ggaaga|ggacga|ggatga|ggcgga|ggggga|ggtgga
18 3 4 ggaaga|ggacga|ggatga|ggcgga|ggggga|ggtgga
17 11 12 ggaaga|ggacga|ggatga|ggcgga|ggggga|ggtgga
16 5 10 gagg|ggag
15 5 10 agga
14 5 10 ggcgg|ggggg|ggtgg
13 5 10 agg|gag|gga
12 11 12 agga|gagg|ggag
11 3 4 agga|gagg|ggag
10 13 15 gagga|ggagg|ggagga
9 5 10 gaaga|gacga|gatga
8 3 4 ggcgg|ggggg|ggtgg
7 11 12 ggcgg|ggggg|ggtgg
6 11 12 agg|gag|gga
5 3 4 gaaga|gacga|gatga
4 11 12 gaaga|gacga|gatga
3 13 15 agga|gagg|ggag
2 13 15 agg|gag|gga|ggaaga|ggacga|ggatga|ggcgg|ggggg|ggtgg
1 3 4 agg|gag|gga
"""


def rbs(window: str) -> str:
    rows = [line.split() for line in _RBS.strip().splitlines()]
    rules = " ".join(f"WHEN regexp_matches(reverse({window}), '^.{{{a},{b}}}(?:{m})') THEN {s}" for s, a, b, m in rows)
    return f"(CASE {rules} ELSE 0 END)"


def rc(x: str, n: str = "a") -> str:
    return f"translate(reverse({x}), 'acgtn', 'tgca{n}')"


def contigs(masked: bool = False) -> str:
    return f"c AS (SELECT doc_id AS contig_id, translate(regexp_replace(lower(coalesce(text, '')), '[^a-z ]', '', 'g'), '{_FROM}', '{_TO_N if masked else _TO}') AS seq FROM documents), k AS (SELECT *, CAST(length(seq) AS INTEGER) AS len FROM c)"


POS = "p AS (SELECT contig_id, seq, len, unnest(range(1, len - 1)) AS pos FROM k WHERE len >= 3), t AS (SELECT contig_id, len, CAST(pos AS INTEGER) AS pos, CAST((pos - 1) % 3 + 1 AS INTEGER) AS frame, substr(seq, pos, 3) AS codon FROM p)"


def orfs(table: int = 11, closed: bool = False, mask: bool = False, min_len: int = 90, own: bool = False) -> str:
    starts, stops = quoted(codes.start_codons(table) if own else codes.caller_starts(table)), quoted(codes.stop_codons(table))
    r = rc("codon")
    open_ = "false" if closed else "true"
    masked = "WHERE NOT contains(span, 'n')" if mask else ""
    return f"""{POS},
    h AS (SELECT contig_id, len, pos, frame, codon IN ({starts}) AS fs, codon IN ({stops}) AS fe, {r} IN ({starts}) AS rs, {r} IN ({stops}) AS re FROM t),
    w AS (SELECT *, last_value(CASE WHEN re THEN pos END IGNORE NULLS) OVER (PARTITION BY contig_id, frame ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prev,
        first_value(CASE WHEN fe THEN pos END IGNORE NULLS) OVER (PARTITION BY contig_id, frame ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt,
        max(CASE WHEN re THEN pos END) OVER (PARTITION BY contig_id, frame) AS far, max(pos) OVER (PARTITION BY contig_id, frame) AS fin FROM h),
    s AS (SELECT contig_id, len, pos AS start, CAST(coalesce(nxt, len - (len - (frame - 1)) % 3 - 2) AS INTEGER) AS stop, frame FROM w WHERE (fs OR ({open_} AND pos <= 3)) AND (nxt IS NOT NULL OR {open_})
        UNION ALL SELECT contig_id, len, pos, CAST(coalesce(prev, frame) AS INTEGER), -frame FROM w WHERE (rs OR ({open_} AND pos = fin)) AND (far > pos OR {open_})),
    x AS (SELECT s.*, seq AS whole, substr(seq, least(start, stop), greatest(start, stop) + 2 - least(start, stop) + 1) AS span FROM s JOIN k USING (contig_id) WHERE greatest(start, stop) + 2 - least(start, stop) + 1 >= {min_len}),
    y AS (SELECT *, CASE WHEN frame > 0 THEN span ELSE {rc("span")} END AS oseq,
        CASE WHEN frame > 0 THEN lpad(substr(whole, greatest(start - 20, 1), least(start, 21)), 21, 'a') ELSE {rc("substr(whole, start + 3, 21)")} END AS win FROM x {masked}),
    z AS (SELECT *, (length(oseq) - length(replace(oseq, 'a', ''))) / length(oseq) AS qa, (length(oseq) - length(replace(oseq, 't', ''))) / length(oseq) AS qt, (length(oseq) - length(replace(oseq, 'g', ''))) / length(oseq) AS qg FROM y),
    o AS (SELECT contig_id, len, start, stop, frame, substr(oseq, 1, 3) AS start_codon, {rbs("win")} AS rbs_score, qt * qa * qa + qt * qg * qa + qt * qa * qg AS pstop, oseq FROM z)"""


def orf_rows(masked: bool = False, **options) -> str:
    return f"WITH {contigs(masked)}, {orfs(mask=masked, **options)} SELECT contig_id, start, stop, frame, start_codon, rbs_score, round(CASE WHEN pstop > 0 THEN ln(pstop) END, 7) AS ln_pstop, md5(oseq) AS seq_md5 FROM o"


def regions(table: int, both: bool = True, name: str = "g", min_len: int = 90) -> str:
    """Regions of forward and reverse strands as table `name`."""
    strands = f"SELECT contig_id, '+' AS strand, seq, len FROM k" + (f" UNION ALL SELECT contig_id, '-', {rc('seq', 'n')}, len FROM k" if both else "")  # noqa: F541
    return f"""{name}1 AS ({strands}), {name}2 AS (SELECT contig_id, strand, len, seq, unnest(range(0, len - 2)) AS q FROM {name}1 WHERE len >= 3),
    {name}3 AS (SELECT contig_id, strand, CAST(q % 3 AS INTEGER) AS frame, CAST(q AS INTEGER) AS region_end, 3 AS w FROM {name}2 WHERE substr(seq, q + 1, 3) IN ({quoted(codes.stop_codons(table))})
        UNION ALL SELECT contig_id, strand, CAST(unnest(range(3)) AS INTEGER), len, 4 FROM {name}1),
    {name} AS (SELECT * FROM (SELECT contig_id, strand, frame, CAST(coalesce(lag(region_end) OVER (PARTITION BY contig_id, strand, frame ORDER BY region_end, w) + 3, frame) AS INTEGER) AS region_start, region_end FROM {name}3) WHERE region_end - region_start >= {min_len})"""


def stats(table: int, name: str) -> str:
    return f"""{regions(table, name=name)}, {name}s AS (SELECT k.contig_id, coalesce(avg(region_end - region_start), 0.0) AS mean_len, CAST(coalesce(max(region_end - region_start), 0) AS INTEGER) AS max_len FROM k LEFT JOIN {name} USING (contig_id) GROUP BY k.contig_id)"""


def plain_signal(table: int, target: str, siblings: tuple[str, ...], name: str) -> str:
    return f"""{regions(table, False, name + "r")}, {name}t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY region_end - region_start DESC, region_start) AS r FROM {name}r) WHERE r <= 20),
    {name}c AS (SELECT contig_id, unnest(range(region_start, region_end - 5, 3)) AS q FROM {name}t),
    {name}n AS (SELECT contig_id, count(*) AS n, count(*) FILTER (substr(seq, q + 1, 3) = '{target}') AS x, count(*) FILTER (substr(seq, q + 1, 3) IN ({quoted(siblings)})) AS y FROM {name}c JOIN k USING (contig_id) GROUP BY contig_id),
    {name}b AS (SELECT contig_id, len(list_filter(l, lambda v: v = '{target}')) / len(l) AS bg FROM (SELECT contig_id, list_transform(range(0, len - 2, 3), lambda q: substr(seq, q + 1, 3)) AS l FROM k WHERE len >= 3)),
    {name} AS (SELECT k.contig_id, least(3.0, CASE WHEN coalesce(y, 0) > 0 THEN x / y WHEN coalesce(bg, 0) > 0 AND coalesce(n, 0) > 0 THEN x / n / bg ELSE 0.0 END) AS signal FROM k LEFT JOIN {name}n USING (contig_id) LEFT JOIN {name}b USING (contig_id) WHERE len >= 300)"""


def sliding_signal(table: int, targets: tuple[str, ...], name: str) -> str:
    ratio = [f"CASE WHEN b{i} > 0 THEN (x{i} / n) / (b{i} / m) ELSE 0.0 END" for i in range(len(targets))]
    return f"""{name}w AS (SELECT contig_id, size, w, substr(seq, w + 1, size) AS seq FROM (SELECT contig_id, seq, least(greatest(len, 3000), 9000) AS size, unnest(range(0, len - least(greatest(len, 3000), 9000) + 1, CAST(floor(least(greatest(len, 3000), 9000) / 5) AS BIGINT))) AS w FROM k WHERE len >= 3000)),
    {name}q AS (SELECT contig_id, w, size, seq, unnest(range(0, size - 2)) AS q FROM {name}w),
    {name}e AS (SELECT contig_id, w, q % 3 AS frame, q AS e, 3 AS v FROM {name}q WHERE substr(seq, q + 1, 3) IN ({quoted(codes.stop_codons(table))}) UNION ALL SELECT contig_id, w, unnest(range(3)), size, 4 FROM {name}w),
    {name}r AS (SELECT contig_id, w, coalesce(lag(e) OVER (PARTITION BY contig_id, w, frame ORDER BY e, v) + 3, frame) AS s, e FROM {name}e),
    {name}t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contig_id, w ORDER BY e - s DESC, s) AS r FROM {name}r WHERE e - s >= 90) WHERE r <= 10),
    {name}c AS (SELECT contig_id, w, unnest(range(s, e - 5, 3)) AS q FROM {name}t),
    {name}n AS (SELECT contig_id, w, count(*) AS n, {", ".join(f"count(*) FILTER (substr(seq, q + 1, 3) = '{c}') AS x{i}" for i, c in enumerate(targets))} FROM {name}c JOIN {name}w USING (contig_id, w) GROUP BY contig_id, w HAVING count(*) >= 300),
    {name}b AS (SELECT contig_id, w, count(*) AS m, {", ".join(f"count(*) FILTER (substr(seq, q + 1, 3) = '{c}') AS b{i}" for i, c in enumerate(targets))} FROM {name}q WHERE q % 3 = 0 GROUP BY contig_id, w),
    {name}g AS (SELECT contig_id, w, least(3.0, {", ".join(ratio)}) AS signal FROM {name}n JOIN {name}b USING (contig_id, w)),
    {name}k AS (SELECT *, row_number() OVER (PARTITION BY contig_id ORDER BY signal DESC, w) AS r, count(*) OVER (PARTITION BY contig_id) AS n FROM {name}g),
    {name}m AS (SELECT contig_id, avg(signal) AS m FROM {name}k WHERE r <= greatest(n // 4, 1) GROUP BY contig_id),
    {name} AS (SELECT k.contig_id, coalesce(least(greatest(m - 0.5, 0.0), 3.0), 0.0) AS signal FROM k LEFT JOIN {name}m USING (contig_id) WHERE len >= 300)"""


EXCLUSIVE = f"""{regions(11, False, "xr")}, x AS (SELECT k.contig_id, count(*) FILTER (substr(seq, region_start + 1, 3) IN ('att', 'atc', 'ata', 'gtg')) AS n FROM k LEFT JOIN xr USING (contig_id) GROUP BY k.contig_id)"""


def scores() -> str:
    """Common table expressions up to `ranked`."""
    parts = [contigs(), *(stats(t, f"g{t}_") for t in codes.CANDIDATES), plain_signal(4, "tga", ("tgg",), "s4_"), plain_signal(25, "tga", ("gga", "ggc", "ggg", "ggt"), "s25_"), sliding_signal(15, ("tag",), "s15_"), EXCLUSIVE]
    signal = {1: "SELECT contig_id, 1.0 AS signal FROM k", 11: "SELECT contig_id, 1.0 AS signal FROM k"} | {t: f"SELECT contig_id, signal FROM s{t}_" for t in (4, 15, 25)}
    every = " UNION ALL ".join(f'SELECT v.contig_id, {t} AS "table", mean_len, max_len, signal FROM g{t}_s v JOIN ({signal[t]}) u USING (contig_id)' for t in codes.CANDIDATES)
    parts.append(f"""e AS ({every}), f AS (SELECT e.*, mean_len / bm AS mol, max_len / bx AS far, n FROM e JOIN (SELECT contig_id, greatest(mean_len, 1.0) AS bm, greatest(max_len, 1) AS bx FROM g11_s) USING (contig_id) JOIN x USING (contig_id) JOIN k USING (contig_id) WHERE len >= 300),
    sc AS (SELECT *, mol * signal * (CASE WHEN "table" IN (1, 11) OR signal > 0.6 THEN 1.0 WHEN signal > 0.3 THEN (CASE WHEN far > 2 THEN 1.0 ELSE 0.7 END) WHEN far > 2.5 THEN 0.7 ELSE 0.4 END) AS composite FROM f),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY contig_id ORDER BY composite DESC, CASE WHEN "table" = 11 AND n > 0 THEN 0 ELSE "table" END) AS INTEGER) AS rank FROM sc)""")
    return "WITH " + ", ".join(parts)


_BATCH = """, tops AS (SELECT contig_id, max("table") FILTER (rank = 1) AS t1, max(composite) FILTER (rank = 1) AS c1, max("table") FILTER (rank = 2) AS t2, max(composite) FILTER (rank = 2) AS c2 FROM ranked GROUP BY contig_id),
    batch AS (SELECT k.contig_id, len, coalesce(t1, 11) AS recommended, CASE WHEN t1 IS NULL THEN 'too_short' WHEN c2 <= 0 THEN (CASE WHEN c1 > 0 THEN 'high' ELSE 'low' END) WHEN c1 / c2 > 2 THEN 'high' WHEN c1 / c2 > 1.2 THEN 'medium' ELSE 'low' END AS confidence,
    coalesce(c1, 0.0) AS top_score, coalesce(t2, 11) AS runner_up, coalesce(c2, 0.0) AS runner_up_score FROM k LEFT JOIN tops USING (contig_id))"""

_GC = "q1 AS (SELECT contig_id, len, unnest(range(1, len + 1)) AS pos, seq FROM k WHERE len > 0), q2 AS (SELECT contig_id, len, pos, CASE WHEN substr(seq, pos, 1) IN ('c', 'g') THEN 1 ELSE 0 END AS b FROM q1), q3 AS (SELECT contig_id, len, pos, sum(b) OVER (PARTITION BY contig_id, pos % 3 ORDER BY pos ROWS BETWEEN 19 PRECEDING AND 20 FOLLOWING) AS gc FROM q2), gc AS (SELECT * FROM (SELECT contig_id, len, pos, gc AS gc1, lead(gc, 1) OVER (PARTITION BY contig_id ORDER BY pos) AS gc2, lead(gc, 2) OVER (PARTITION BY contig_id ORDER BY pos) AS gc3 FROM q3) WHERE pos <= len - 2)"


def _max_idx(a: str, b: str, c: str) -> str:
    return f"(CASE WHEN {a} > {b} AND {a} > {c} THEN 1 WHEN {b} > {c} THEN 2 ELSE 3 END)"


def _min_idx(a: str, b: str, c: str) -> str:
    return f"(CASE WHEN {a} > {b} AND {b} > {c} THEN 3 WHEN {a} > {b} THEN 2 WHEN {a} > {c} THEN 3 ELSE 1 END)"


_TRAIN = "tr AS (SELECT contig_id, arg_max(start, abs(start - stop) * 10 + frame) AS start, stop, arg_max(frame, abs(start - stop) * 10 + frame) AS frame FROM o WHERE start_codon = 'atg' GROUP BY contig_id, stop)"
_BIAS = f"""b1 AS (SELECT contig_id, frame > 0 AS ahead, unnest(CASE WHEN frame > 0 THEN range(start + (stop - start) // 8 * 3, stop - 36, 3) ELSE range(start - (start - stop) // 8 * 3, stop + 36, -3) END) AS pos FROM tr),
    b2 AS (SELECT contig_id, CASE WHEN ahead THEN gc1 ELSE gc3 END AS x, gc2 AS y, CASE WHEN ahead THEN gc3 ELSE gc1 END AS z FROM b1 JOIN gc USING (contig_id, pos)),
    b3 AS (SELECT contig_id, {_max_idx("x", "y", "z")} AS hi, {_min_idx("x", "y", "z")} AS lo FROM b2),
    b4 AS (SELECT k.contig_id, idx, 1 + count(*) FILTER (hi = idx) AS a, 1 + count(*) FILTER (lo = idx) AS b FROM k CROSS JOIN (SELECT unnest([1, 2, 3]) AS idx) LEFT JOIN b3 USING (contig_id) GROUP BY k.contig_id, idx),
    bias AS (SELECT contig_id, idx, a / max(a) OVER (PARTITION BY contig_id) AS pmax, b / max(b) OVER (PARTITION BY contig_id) AS pmin FROM b4)"""
_GRID = "(SELECT contig_id, len, unnest(range(28)) AS score FROM k)"
_BG = f"""u1 AS (SELECT contig_id, unnest(range(1, len + 1)) AS pos, seq FROM k WHERE len > 0), u2 AS (SELECT contig_id, substr(seq, pos, 21) AS piece FROM u1),
    u3 AS (SELECT contig_id, {rbs("piece")} AS score FROM u2 UNION ALL SELECT contig_id, {rbs(rc("piece"))} FROM u2),
    u4 AS (SELECT contig_id, score, count(*) AS n FROM u3 GROUP BY contig_id, score), bg AS (SELECT contig_id, CAST(score AS INTEGER) AS score, (coalesce(n, 0) + 1) / (2 * len + 28) AS p FROM {_GRID} LEFT JOIN u4 USING (contig_id, score))"""
_TRAINED = f"v1 AS (SELECT contig_id, rbs_score AS score, count(*) AS n FROM o GROUP BY contig_id, rbs_score), v2 AS (SELECT contig_id, sum(n) AS total FROM v1 GROUP BY contig_id), trained AS (SELECT contig_id, CAST(score AS INTEGER) AS score, (coalesce(n, 0) + 1) / (total + 28) AS p FROM {_GRID} JOIN v2 USING (contig_id) LEFT JOIN v1 USING (contig_id, score))"
_OTHER = "oe AS (SELECT contig_id, pos, arg_max(other, rank) AS other FROM (SELECT contig_id, stop AS pos, CASE WHEN max(frame) > 0 THEN min(start) ELSE max(start) END AS other, 0 AS rank FROM o GROUP BY contig_id, stop UNION ALL SELECT contig_id, start, max(stop), 1 FROM o GROUP BY contig_id, start) GROUP BY contig_id, pos)"
_NODES = "nd AS (SELECT DISTINCT contig_id, start AS pos, 'start' AS type, frame FROM o UNION SELECT contig_id, stop, 'stop', frame FROM o)"
_DESERT = "ds AS (SELECT contig_id, last, b FROM (SELECT contig_id, a AS b, CAST(coalesce(max(z) OVER (PARTITION BY contig_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS last FROM (SELECT DISTINCT contig_id, least(start, stop) AS a, least(greatest(start, stop), len - 1) AS z FROM o)) WHERE b - last > 500)"
_COUNTS = "count(*) AS n, sum(src_pos) AS src_sum, sum(dst_pos) AS dst_sum, round(sum(ln(CASE WHEN cost < 1e12 THEN trunc(cost * 1000) ELSE cost * 1000 END)), 4) AS ln_sum"
_GP = """gp AS (SELECT contig_id, a * a * a + a * g * a + a * a * g AS gp FROM
    (SELECT contig_id, length(translate(seq, 'cgn', '')) / (2 * len) AS a, length(translate(seq, 'atn', '')) / (2 * len) AS g FROM k WHERE len > 0))"""
_C, _O = contigs(), orfs()
#: Text with an `a` for each byte of a character beyond ASCII.
_BYTES = "text"
for _first, _last, _n in (("80", "7FF", 2), ("800", "FFFF", 3), ("10000", "10FFFF", 4)):
    _BYTES = f"regexp_replace({_BYTES}, '[\\x{{{_first}}}-\\x{{{_last}}}]', '{'a' * _n}', 'g')"


def _gap(length: str, p: str, switch: int = 0) -> str:
    return f"(CASE WHEN {length} > 300 THEN pow(1 - {p}, 100) + {length} ELSE pow(1 - {p}, -({length}) / 3) + {switch} END)"


def _is(side: str, kind: str, sign: str) -> str:
    return f"({side}.type = '{kind}' AND {side}.frame {sign} 0)"


_NEAR = f"""{_OTHER}, {_NODES}, {_GP}, kn AS (SELECT contig_id, stop AS pos, start AS other, max(pstop) AS own FROM o GROUP BY ALL),
    nn AS (SELECT nd.*, other, coalesce(own, gp) AS own, gp FROM nd JOIN gp USING (contig_id) LEFT JOIN oe USING (contig_id, pos) LEFT JOIN kn USING (contig_id, pos, other)),
    pr AS (SELECT l.contig_id, l.pos AS lp, r.pos AS rp, l.type AS lt, r.type AS rt, l.frame AS lf, r.frame AS rf, r.pos - l.pos - 3 AS gap, r.pos - l.pos + 3 AS lap, (l.own + r.own) / 2 AS mean, l.gp, CASE WHEN ({_is("l", "stop", ">")} AND {_is("r", "start", ">")}) OR ({_is("l", "start", "<")} AND {_is("r", "stop", "<")}) THEN 'gap_same'
        WHEN (({_is("l", "start", ">")} AND {_is("r", "stop", ">")}) OR ({_is("l", "stop", "<")} AND {_is("r", "start", "<")})) AND l.frame <> r.frame AND r.pos < l.other AND r.other < l.pos THEN 'overlap_same'
        WHEN ({_is("l", "stop", ">")} AND {_is("r", "stop", "<")}) OR ({_is("l", "start", "<")} AND {_is("r", "start", ">")} AND r.pos - l.pos > 2) THEN 'gap_diff'
        WHEN ({_is("l", "stop", "<")} AND {_is("r", "stop", ">")} AND r.other + 3 < l.pos AND r.pos < l.other) OR ({_is("l", "start", ">")} AND {_is("r", "start", "<")} AND r.other < l.pos AND r.pos < l.other) THEN 'overlap_diff' END AS kind
        FROM nn l JOIN nn r ON l.contig_id = r.contig_id AND r.pos > l.pos AND r.pos - l.pos < 500),
    en AS (SELECT contig_id, kind, CASE WHEN kind LIKE 'gap%' THEN lp ELSE rp END AS src_pos, CASE WHEN kind LIKE 'gap%' THEN lt ELSE rt END AS src_type, CASE WHEN kind LIKE 'gap%' THEN lf ELSE rf END AS src_frame,
        CASE WHEN kind LIKE 'gap%' THEN rp ELSE lp END AS dst_pos, CASE WHEN kind LIKE 'gap%' THEN rt ELSE lt END AS dst_type, CASE WHEN kind LIKE 'gap%' THEN rf ELSE lf END AS dst_frame,
        CASE kind WHEN 'gap_same' THEN {_gap("gap", "gp")} WHEN 'gap_diff' THEN {_gap("gap", "gp", 20)} WHEN 'overlap_same' THEN pow(1 - mean, -lap) ELSE pow(1 - mean, -lap) + 20 END AS cost FROM pr WHERE kind IS NOT NULL)"""
_OVER = f"""{_DESERT}, dp AS (SELECT ds.contig_id, l.pos AS src_pos, l.type AS src_type, l.frame AS src_frame, r.pos AS dst_pos, r.type AS dst_type, r.frame AS dst_frame, r.pos - l.pos - 3 AS gap, gp,
        CASE WHEN ({_is("l", "stop", ">")} AND {_is("r", "start", ">")}) OR ({_is("l", "start", "<")} AND {_is("r", "stop", "<")}) THEN 'desert_same'
        WHEN ({_is("l", "stop", ">")} AND {_is("r", "stop", "<")}) OR ({_is("l", "start", "<")} AND {_is("r", "start", ">")}) THEN 'desert_diff' END AS kind
        FROM ds JOIN gp USING (contig_id) JOIN nd l ON l.contig_id = ds.contig_id AND l.pos > greatest(last - 500, 0) AND l.pos <= last + 1 JOIN nd r ON r.contig_id = ds.contig_id AND r.pos >= b - 1 AND r.pos < b + 500),
    ed AS (SELECT contig_id, kind, src_pos, src_type, src_frame, dst_pos, dst_type, dst_frame, CASE kind WHEN 'desert_same' THEN {_gap("gap", "gp")} ELSE {_gap("gap", "gp", 20)} END AS cost FROM dp WHERE kind IS NOT NULL)"""
_ENDS = f"""et AS (SELECT contig_id, 'source' AS kind, 0 AS src_pos, 'source' AS src_type, 0 AS src_frame, pos AS dst_pos, type AS dst_type, frame AS dst_frame, {_gap("pos", "gp")} AS cost
        FROM nd JOIN gp USING (contig_id) WHERE pos <= 2000 AND ((type = 'start' AND frame > 0) OR (type = 'stop' AND frame < 0))
        UNION ALL SELECT contig_id, 'target', pos, type, frame, len + 1, 'target', 0, {_gap("(len - pos)", "gp")}
        FROM nd JOIN k USING (contig_id) JOIN gp USING (contig_id) WHERE len - pos BETWEEN 0 AND 2000 AND ((type = 'start' AND frame < 0) OR (type = 'stop' AND frame > 0)))"""
_CODE_ROWS = ", ".join(f"({t}, '{c}', '{aa}', {str(aa == '*').lower()}, {str(c in codes.STARTS[t]).lower()}, {str(c in codes.caller_starts(t)).lower()}, CAST({codes.start_weights(t).get(c, 1.0)!r} AS DOUBLE))" for t in codes.TABLES for c, aa in codes.codons(t).items())


def translation(seq: str, table: int) -> str:
    pairs = ", ".join(f"'{c}': '{aa}'" for c, aa in codes.codons(table).items())
    return f"list_aggregate(list_transform(range(0, CAST(ceil(length({seq}) / 3) AS BIGINT)), lambda i: coalesce(map_extract(MAP {{{pairs}}}, substr({seq}, 3 * i + 1, 3))[1], 'X')), 'string_agg', '')"


def _folded(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10) || '$', '')"


def texts(fmt: str, start: str, stop: str, strand: str, score: str, bases: str) -> tuple[str, str, str]:
    """What a format has before a contig's genes, for each gene, and after them."""
    place = f"{start} || '..' || {stop}"
    place = f"CASE WHEN {strand} = '-' THEN 'complement(' || {place} || ')' ELSE {place} END"
    fasta = lambda seq: f"'>' || contig_id || '_' || {start} || '_' || {stop} || ' ' || {strand} || chr(10) || {_folded(seq)} || chr(10)"
    line = {
        "gbk": f"'     CDS             ' || {place} || chr(10) || repeat(' ', 21) || '/note=\"score=' || {score} || '\"' || chr(10)",
        "sco": f"{start} || chr(9) || {stop} || chr(9) || {strand} || chr(9) || {score} || chr(10)",
        "gff": f"contig_id || chr(9) || 'orfweave' || chr(9) || 'CDS' || chr(9) || {start} || chr(9) || {stop} || chr(9) || {score} || chr(9) || {strand} || chr(9) || '0' || chr(9)"
        f" || 'ID=CDS_' || {start} || '_' || {stop} || ';score=' || {score} || chr(10)",
        "nucleotide": fasta(bases),
        "protein": fasta(translation(bases, 11)),
    }[fmt]
    head = {
        "gff": "'##gff-version 3' || chr(10)",
        "gbk": "'LOCUS       ' || contig_id || ' ' || lpad(CAST(len AS VARCHAR), 10, ' ') || ' bp    DNA             PHG' || chr(10) || 'DEFINITION  ' || contig_id || chr(10)"
        " || 'FEATURES             Location/Qualifiers' || chr(10) || '     source          1..' || len || chr(10)",
    }.get(fmt, "''")
    lines = "list_transform(range(0, len, 60), lambda i: lpad(CAST(i + 1 AS VARCHAR), 9, ' ') || ' ' || rtrim(regexp_replace(substr(seq, i + 1, 60), '(.{10})', '\\1 ', 'g')))"
    tail = f"'ORIGIN' || chr(10) || chr(10) || coalesce(array_to_string({lines}, chr(10)), '') || chr(10) || '//' || chr(10)" if fmt == "gbk" else "''"
    return head, line, tail


def written(fmt: str) -> str:
    head, line, tail = texts(fmt, "len", "'1'", "'-'", "'-1.23E3'", "turned")
    # The reverse complement is made once a row, not once a codon.
    source = f"(SELECT *, {rc('seq')} AS turned FROM k)" if fmt in ("protein", "nucleotide") else "k"
    return f"WITH {_C} SELECT contig_id, md5({head} || CASE WHEN len > 0 THEN {line} ELSE '' END || {tail}) AS text_md5 FROM {source}"


ORACLE_SQL: dict[str, str] = {
    "normalize_seq": f"SELECT doc_id, md5(regexp_replace(translate({_BYTES}, 'ACGTNUuSsBbVv', 'acgtnttgggggg'), '[^acgtn]', 'a', 'g')) AS seq_md5 FROM documents",
    "rev_comp": f"WITH {_C} SELECT contig_id, md5({rc('seq')}) AS rc_md5 FROM k",
    "rev_comp_detect": f"WITH {contigs(True)} SELECT contig_id, md5({rc('seq', 'n')}) AS rc_md5 FROM k",
    "genetic_code": f'SELECT * FROM (VALUES {_CODE_ROWS}) v("table", codon, aa, is_stop, is_start, is_caller_start, start_weight)',
    "base_composition": f"WITH {_C} SELECT contig_id, CAST(len AS BIGINT) AS len, " + ", ".join(f"CAST(length(seq) - length(replace(seq, '{b}', '')) AS BIGINT) AS n_{b}" for b in "acgtn") + " FROM k",
    "genome_pstop": f"WITH {_C}, q AS (SELECT contig_id, (length(translate(seq, 'cgn', ''))) / (2 * len) AS a, (length(translate(seq, 'atn', ''))) / (2 * len) AS g FROM k WHERE len > 0) SELECT contig_id, round(a * a * a + a * g * a + a * a * g, 9) AS pstop FROM q",
    "codon_counts": f"WITH {_C}, {POS} SELECT frame, codon, {rc('codon')} AS rc_codon, count(*) AS n FROM t GROUP BY ALL",
    "n_runs": f"WITH {contigs(True)}, a AS (SELECT contig_id, seq, unnest(range(1, len + 1)) AS pos FROM k), b AS (SELECT contig_id, pos, pos - row_number() OVER (PARTITION BY contig_id ORDER BY pos) AS g FROM a WHERE substr(seq, pos, 1) = 'n') SELECT contig_id, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) AS INTEGER) AS stop FROM b GROUP BY contig_id, g",
    "score_rbs": f"WITH {_C}, a AS (SELECT seq, unnest(range(1, len + 1)) AS pos FROM k), b AS (SELECT substr(seq, pos, 21) AS piece FROM a) SELECT {rbs('piece')} AS score, count(*) AS n FROM b GROUP BY 1",
    "rbs_background": f"WITH {_C}, {_BG} SELECT contig_id, score, round(p, 9) AS p FROM bg",
    "orfs_open": orf_rows(), "orfs_closed": orf_rows(closed=True), "orfs_masked": orf_rows(masked=True), "orfs_minlen": orf_rows(min_len=300),
    "rbs_training": f"WITH {_C}, {_O}, {_TRAINED} SELECT contig_id, score, round(p, 9) AS p FROM trained",
    "rbs_odds": f"WITH {_C}, {_O}, {_TRAINED}, {_BG} SELECT contig_id, score, round(trained.p / bg.p, 6) AS odds FROM trained JOIN bg USING (contig_id, score)",
    "gc_frame": f"WITH {_C}, {_GC} SELECT contig_id, count(*) AS n, sum(gc1) AS gc1, sum(gc2) AS gc2, sum(gc3) AS gc3 FROM gc GROUP BY contig_id",
    "training_orfs": f"WITH {_C}, {_O}, {_TRAIN} SELECT * FROM tr",
    "frame_bias": f"WITH {_C}, {_O}, {_TRAIN}, {_GC}, {_BIAS} SELECT contig_id, idx, round(pmax, 9) AS pmax, round(pmin, 9) AS pmin FROM bias",
    "other_end": f"WITH {_C}, {_O}, {_OTHER} SELECT * FROM oe",
    "nodes": f"WITH {_C}, {_O}, {_NODES} SELECT * FROM nd",
    "deserts": f"WITH {_C}, {_O}, {_DESERT} SELECT contig_id, last, b FROM ds",
    "edges_near": f"WITH {_C}, {_O}, {_NEAR} SELECT contig_id, kind, {_COUNTS} FROM en GROUP BY contig_id, kind",
    "edges_desert": f"WITH {_C}, {_O}, {_NODES}, {_GP}, {_OVER} SELECT contig_id, kind, {_COUNTS} FROM ed GROUP BY contig_id, kind",
    "edges_terminal": f"WITH {_C}, {_O}, {_NODES}, {_GP}, {_ENDS} SELECT contig_id, kind, {_COUNTS} FROM et GROUP BY contig_id, kind",
    "mean_max_region": f"WITH {_C}, {stats(11, 'g')} SELECT contig_id, round(mean_len, 6) AS mean_len, max_len FROM gs",
    "background_codon_freq": f"WITH {_C}, {POS} SELECT contig_id, count(*) AS total, count(*) FILTER (codon = 'tga') AS bg_tga, count(*) FILTER (codon = 'tag') AS bg_tag FROM t WHERE frame = 1 GROUP BY contig_id",
    "hopping_windows": f"WITH {_C}, s AS (SELECT *, least(greatest(len, 3000), 9000) AS size FROM k WHERE len >= 3000), h AS (SELECT *, unnest(range(0, len - size + 1, CAST(floor(size / 5) AS BIGINT))) AS w FROM s) SELECT contig_id, CAST(w AS INTEGER) AS w, size, md5(substr(seq, w + 1, size)) AS piece_md5 FROM h",
    "exclusive_starts": f"WITH {_C}, {EXCLUSIVE} SELECT contig_id, n FROM x",
    "table_scores": scores() + ' SELECT contig_id, "table", round(mean_len, 6) AS mean_orf_len, round(mol, 6) AS mol_ratio, round(signal, 6) AS reassignment_signal, round(composite, 6) AS composite, rank FROM ranked',
    "batch_detect_tsv": scores() + _BATCH + " SELECT contig_id, contig_id || chr(9) || len || chr(9) || recommended || chr(9) || confidence || chr(9) || printf('%.4f', top_score) || chr(9) || runner_up || chr(9) || printf('%.4f', runner_up_score) AS line FROM batch",
    "batch_matrix": scores() + _BATCH + " SELECT batch.contig_id, any_value(len) AS len, any_value(recommended) AS recommended, any_value(confidence) AS confidence, " + ", ".join(f'round(coalesce(max(composite) FILTER ("table" = {t}), 0.0), 6) AS t{t}' for t in (1, 4, 6, 11, 15, 25)) + " FROM batch LEFT JOIN ranked USING (contig_id) GROUP BY batch.contig_id",
    "fasta_parse": f"WITH {_C} SELECT '>c' || contig_id AS contig_id, len, md5(seq) AS seq_md5 FROM k",
    "genbank_parse": f"WITH {_C} SELECT 'c' || contig_id AS contig_id, len, md5(seq) AS seq_md5 FROM k",
}
ORACLE_SQL |= {f"translate_t{t}": f"WITH {_C} SELECT contig_id, md5(coalesce({translation('seq', t)}, '')) AS aa_md5 FROM k" for t in codes.TABLES}
ORACLE_SQL |= {f"orfs_table{t}": orf_rows(table=t) for t in (4, 6, 15, 25)}
ORACLE_SQL |= {f"find_orfs_t{t}": orf_rows(table=t, own=True) for t in (1, 11)}
ORACLE_SQL |= {f"open_regions_t{t}": f"WITH {_C}, {regions(t)} SELECT contig_id, strand, frame, region_start, region_end FROM g" for t in (4, 11, 15)}
ORACLE_SQL |= {f"signal_t{t}": f"WITH {_C}, {plain_signal(t, 'tga', s, 's')} SELECT contig_id, round(signal, 6) AS signal FROM s" for t, s in ((4, ("tgg",)), (25, ("gga", "ggc", "ggg", "ggt")))}
ORACLE_SQL |= {f"signal_t{t}": f"WITH {_C}, {sliding_signal(t, s, 's')} SELECT contig_id, round(signal, 6) AS signal FROM s" for t, s in ((15, ("tag",)), (6, ("taa", "tag")))}
ORACLE_SQL |= {f"write_{f}": written(f) for f in ("sco", "gff", "gbk", "nucleotide", "protein")}
_HOLD = f"""cd AS (SELECT contig_id, start, stop, frame, unnest(CASE WHEN frame > 0 THEN range(start, stop, 3) ELSE range(stop + 3, start + 1, 3) END) AS pos FROM o),
    ix AS (SELECT contig_id, start, stop, frame, CASE WHEN frame > 0 THEN {_max_idx("gc1", "gc2", "gc3")} ELSE {_max_idx("gc3", "gc2", "gc1")} END AS hi,
        CASE WHEN frame > 0 THEN {_min_idx("gc1", "gc2", "gc3")} ELSE {_min_idx("gc3", "gc2", "gc1")} END AS lo FROM cd JOIN gc USING (contig_id, pos)),
    hs AS (SELECT ix.contig_id, start, stop, frame, sum(x.pmax * y.pmin) AS t FROM ix JOIN bias x ON x.contig_id = ix.contig_id AND x.idx = hi JOIN bias y ON y.contig_id = ix.contig_id AND y.idx = lo GROUP BY ALL),
    wt AS (SELECT o.contig_id, o.start, o.stop, o.frame, trained.p / bg.p AS odds, ln(1 - pstop) * coalesce(t, 0) AS hold,
        ln(CASE start_codon WHEN 'gtg' THEN 0.10 / 0.85 WHEN 'ttg' THEN 0.05 / 0.85 ELSE 1.0 END) AS first
        FROM o LEFT JOIN hs ON hs.contig_id = o.contig_id AND hs.start = o.start AND hs.stop = o.stop AND hs.frame = o.frame
        JOIN trained ON trained.contig_id = o.contig_id AND trained.score = rbs_score JOIN bg ON bg.contig_id = o.contig_id AND bg.score = rbs_score)"""
ORACLE_SQL["orf_weight"] = f"""WITH {_C}, {_O}, {_TRAIN}, {_GC}, {_BIAS}, {_TRAINED}, {_BG}, {_HOLD}
    SELECT contig_id, start, stop, frame, round(odds, 6) AS weight_rbs, round(hold, 6) AS ln_hold, round(first + ln(odds) - hold, 6) AS ln_weight FROM wt"""
ORACLE_SQL["edges_orf"] = f"""WITH {_C}, {_O}, {_TRAIN}, {_GC}, {_BIAS}, {_TRAINED}, {_BG}, {_HOLD}
    SELECT contig_id, 'orf' AS kind, CASE WHEN frame > 0 THEN start ELSE stop END AS src_pos, CASE WHEN frame > 0 THEN 'start' ELSE 'stop' END AS src_type, frame AS src_frame,
        CASE WHEN frame > 0 THEN stop ELSE start END AS dst_pos, CASE WHEN frame > 0 THEN 'stop' ELSE 'start' END AS dst_type, frame AS dst_frame,
        CASE WHEN w >= 1 THEN round(ln(floor(w)), 6) END AS ln_cost FROM (SELECT *, exp(first + ln(odds) - hold) * 1000 AS w FROM wt)"""

# Shortest paths: rounds over all edges at once, in which only a lower cost replaces another; of equals the first edge by
# family and place wins. A node is one number, of its position, type and frame.
_KINDS = ("orf", "desert_same", "desert_diff", "gap_same", "overlap_same", "gap_diff", "overlap_diff", "source", "target")
_TYPES = ("start", "stop", "source", "target")


def _coded(side: str) -> str:
    return f"(CAST({side}_pos AS BIGINT) * 4 + list_position([{quoted(_TYPES)}], {side}_type) - 1) * 7 + {side}_frame + 3"


_PATH = f"""{_C}, {_O}, {_TRAIN}, {_GC}, {_BIAS}, {_TRAINED}, {_BG}, {_HOLD}, {_NEAR}, {_OVER}, {_ENDS},
    eo AS (SELECT contig_id, 'orf' AS kind, CASE WHEN frame > 0 THEN start ELSE stop END AS src_pos, CASE WHEN frame > 0 THEN 'start' ELSE 'stop' END AS src_type, frame AS src_frame,
        CASE WHEN frame > 0 THEN stop ELSE start END AS dst_pos, CASE WHEN frame > 0 THEN 'stop' ELSE 'start' END AS dst_type, frame AS dst_frame, -exp(first + ln(odds) - hold) AS cost FROM wt),
    ea AS (FROM en UNION ALL BY NAME FROM ed UNION ALL BY NAME FROM et UNION ALL BY NAME FROM eo),
    e AS MATERIALIZED (SELECT contig_id, {_coded("src")} AS src, {_coded("dst")} AS dst, {{src_pos: src_pos, src_frame: src_frame, kind: src_type}} AS place,
        list_position([{quoted(_KINDS)}], kind) AS rank, CAST(trunc(cost * 1000) AS BIGNUM) AS w FROM ea),
    bf(contig_id, node, cost, prev) USING KEY (contig_id, node) AS (SELECT DISTINCT contig_id, src, CAST(0 AS BIGNUM), CAST(NULL AS BIGINT) FROM e WHERE src // 7 % 4 = 2
        UNION SELECT contig_id, dst, min(c), arg_min(src, {{c: c, rank: rank, place: place}}) FROM
            (SELECT e.contig_id, e.dst, e.src, e.rank, e.place, bf.cost + e.w AS c FROM bf JOIN e ON e.contig_id = bf.contig_id AND e.src = bf.node
            LEFT JOIN recurring.bf old ON old.contig_id = e.contig_id AND old.node = e.dst WHERE old.cost IS NULL OR bf.cost + e.w < old.cost) GROUP BY contig_id, dst),
    back(contig_id, node, prev, up) AS (SELECT contig_id, node, prev, 0 FROM bf WHERE node // 7 % 4 = 3
        UNION ALL SELECT bf.contig_id, bf.node, bf.prev, up + 1 FROM back JOIN bf ON bf.contig_id = back.contig_id AND bf.node = back.prev),
    sp AS (SELECT contig_id, CAST(max(up) OVER (PARTITION BY contig_id) - up - 1 AS INTEGER) AS step, prev, node FROM back),
    pa AS (SELECT contig_id, step, CAST(prev // 28 AS INTEGER) AS src_pos, [{quoted(_TYPES)}][prev // 7 % 4 + 1] AS src_type, CAST(prev % 7 - 3 AS INTEGER) AS src_frame,
        CAST(node // 28 AS INTEGER) AS dst_pos, [{quoted(_TYPES)}][node // 7 % 4 + 1] AS dst_type, CAST(node % 7 - 3 AS INTEGER) AS dst_frame FROM sp WHERE prev IS NOT NULL)"""
ORACLE_SQL["shortest_path"] = f"WITH RECURSIVE {_PATH} SELECT * FROM pa"
_GENES = f"""{_PATH},
    gn AS (SELECT contig_id, step, frame, CASE WHEN frame > 0 THEN src_pos ELSE dst_pos END AS start, CASE WHEN frame > 0 THEN dst_pos ELSE src_pos END AS stop FROM (SELECT *, src_frame AS frame FROM pa)
        WHERE src_frame = dst_frame AND ((src_frame > 0 AND src_type = 'start' AND dst_type = 'stop') OR (src_frame < 0 AND src_type = 'stop' AND dst_type = 'start'))),
    ge AS (SELECT contig_id, step, CAST(CASE WHEN frame > 0 THEN start ELSE start + 2 END AS INTEGER) AS start, CAST(CASE WHEN frame > 0 THEN stop + 2 ELSE stop END AS INTEGER) AS stop,
        CASE WHEN frame > 0 THEN '+' ELSE '-' END AS strand, first + ln(odds) - hold AS ln_score, start_codon, oseq
        FROM gn JOIN wt USING (contig_id, start, stop, frame) JOIN o USING (contig_id, start, stop, frame))"""
ORACLE_SQL["genes"] = f"WITH RECURSIVE {_GENES} SELECT contig_id, step, start, stop, strand, round(ln_score, 6) AS ln_score, start_codon, md5(oseq) AS seq_md5 FROM ge"


def annotated(fmt: str) -> str:
    """Texts of the genes; a contig without ORFs has a line of its own."""
    score = "regexp_replace(regexp_replace(printf('%.2E', -exp(ln_score)), 'E[+]0*([0-9])', 'E\\1'), 'E-0*([0-9])', 'E-\\1')"
    head, line, tail = texts(fmt, "start", "stop", "strand", score, "oseq")
    return f"""WITH RECURSIVE {_GENES}, ln AS (SELECT contig_id, string_agg(line, '' ORDER BY step) AS body FROM (SELECT contig_id, step, {line} AS line FROM ge) GROUP BY contig_id)
    SELECT contig_id, md5(CASE WHEN contig_id NOT IN (SELECT contig_id FROM o) THEN '#id:' || chr(9) || contig_id || ' NO ORFS FOUND' || chr(10) ELSE {head} || coalesce(body, '') || {tail} END) AS text_md5
    FROM k LEFT JOIN ln USING (contig_id)"""


ORACLE_SQL |= {f"annotate_{f}": annotated(f) for f in ("sco", "gff", "gbk", "nucleotide", "protein")}
