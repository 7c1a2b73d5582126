"""SQL of the segment and speaker operators, in pieces: each function gives common table expressions over others by name.

What goes on from row to row is a recursive expression with a step for each row.
"""

from __future__ import annotations

from tertulia.operators import quality, speakers


def low(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def norm(x: str) -> str:
    return low(f"regexp_replace({x}, '[^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]', '', 'g')")


def fold(x: str) -> str:
    return f"replace(replace(translate({x}, 'áéíóúüñ', 'aeiouun'), '¿', ''), '¡', '')"


def plain(x: str) -> str:
    return fold(norm(x))


def n_words(x: str) -> str:
    return f"len(list_filter(string_split_regex({low(x)}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> ''))"


def known(text: str = "text", t0: str = "t0", t1: str = "t1") -> str:
    p = plain(text)
    return f"""(({" OR ".join(f"contains({p}, '{x}')" for x in quality.HALLUCINATION_PARTS)}) OR ({p} IN ({", ".join(f"'{x}'" for x in quality.HALLUCINATION_PHRASES)}) AND {t1} - {t0} <= 300))"""


def stretches(prompt: str, name: str = "sub") -> str:
    """name (x, l): every stretch of the prompt, and its length; the plain prompt must be ASCII."""
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT substr(p, i, l) AS x, l FROM (SELECT {plain(f"'{prompt}'")} AS p), range(1, 200) a(i), range(1, 200) b(l) WHERE i + l - 1 <= length(p))"""


def runs(src: str, out: str, group: str = "interview_id") -> str:
    """out (group, first_pos, last_pos, n) of the loops in src (group, k from 0, pos, text)."""
    on = " AND ".join(f"n.{g} = w.{g}" for g in group.split(", "))
    cols = lambda t: ", ".join(f"{t}.{g}" for g in group.split(", "))
    same = "(w.anchor <> '' AND n.m <> '' AND (w.anchor = n.m OR (least(strlen(w.anchor), strlen(n.m)) >= 15 AND (contains(w.anchor, n.m) OR contains(n.m, w.anchor)))))"
    return f"""{out}_m AS MATERIALIZED (SELECT {group}, k, pos, {norm("text")} AS m FROM {src}),
{out}_w AS (SELECT {group}, k, pos, m AS anchor, pos AS first_pos FROM {out}_m WHERE k = 0
UNION ALL SELECT {cols("n")}, n.k, n.pos, CASE WHEN {same} THEN w.anchor ELSE n.m END, CASE WHEN {same} THEN w.first_pos ELSE n.pos END FROM {out}_w w JOIN {out}_m n ON {on} AND n.k = w.k + 1),
{out} AS MATERIALIZED (SELECT {group}, first_pos, max(pos) AS last_pos, count(*) AS n FROM {out}_w GROUP BY {group}, first_pos, anchor HAVING anchor <> '' AND count(*) >= CASE WHEN strlen(anchor) >= 15 THEN 3 ELSE 4 END)"""


def reasons(src: str, out: str, group: str = "interview_id") -> str:
    """Q5: src (group, k from 0, t0, t1, text) with reason; sub has the stretches of the prompt."""
    on = " AND ".join(f"a.{g} = b.{g}" for g in group.split(", "))
    cols = ", ".join(f"a.{g}" for g in group.split(", "))
    return f"""{out}_n AS MATERIALIZED (SELECT *, {norm("text")} AS m, {plain("text")} AS p FROM {src}),
{out}_r AS (SELECT {cols}, a.k, bool_or(b.m <> '' AND a.m <> '' AND (contains(b.m, a.m) OR contains(a.m, b.m))) AS rep FROM {out}_n a JOIN {out}_n b ON {on} AND b.k BETWEEN a.k - 3 AND a.k + 3 AND a.k <> b.k GROUP BY ALL),
{out}_e AS (SELECT {cols}, a.k, max(l) AS copied FROM {out}_n a JOIN sub ON l >= 25 AND contains(a.p, sub.x) WHERE strlen(a.p) >= 25 GROUP BY ALL),
{out} AS MATERIALIZED (SELECT a.* EXCLUDE (m, p), CASE WHEN {known("a.text", "a.t0", "a.t1")} THEN 'known' WHEN length(a.text) * 100 > greatest(a.t1 - a.t0, 0) * 35 + 1000 AND coalesce(rep, false) THEN 'dense_repeat'
WHEN 2 * copied >= strlen(a.p) THEN 'prompt_echo' END AS reason FROM {out}_n a LEFT JOIN {out}_r b USING ({group}, k) LEFT JOIN {out}_e c USING ({group}, k))"""


def spliced(src: str, ranges: str, new: str, out: str) -> str:
    """M2: rows of src in ranges (interview_id, run_id, first_pos, last_pos) replaced by those of new (interview_id, run_id, k, t0, t1, text)."""
    return f"""{out} AS MATERIALIZED (SELECT interview_id, row_number() OVER (PARTITION BY interview_id ORDER BY p, q) - 1 AS pos, t0, t1, text FROM (
SELECT interview_id, pos AS p, -1 AS q, t0, t1, text FROM {src} x WHERE NOT EXISTS (SELECT 1 FROM {ranges} g WHERE g.interview_id = x.interview_id AND x.pos BETWEEN g.first_pos AND g.last_pos)
UNION ALL SELECT interview_id, g.first_pos AS p, n.k AS q, n.t0, n.t1, n.text FROM {new} n JOIN {ranges} g USING (interview_id, run_id)))"""


_CLOCK = lambda x: f"format('{{:02d}}:{{:02d}}', {x} // 100 // 60, {x} // 100 % 60)"


def marked(src: str, loops: str, out: str) -> str:
    """out (interview_id, run_id, k, t0, t1, text): for each loop its first row and the marker."""
    return f"""{out} AS MATERIALIZED (SELECT f.interview_id, l.first_pos AS run_id, u.k, CASE WHEN u.k = 0 THEN f.t0 ELSE f.t1 END AS t0, CASE WHEN u.k = 0 THEN f.t1 ELSE z.t1 END AS t1,
CASE WHEN u.k = 0 THEN f.text ELSE '[audio no transcrito ' || {_CLOCK("f.t1")} || '-' || {_CLOCK("z.t1")} || ']' END AS text
FROM {loops} l JOIN {src} f ON f.interview_id = l.interview_id AND f.pos = l.first_pos JOIN {src} z ON z.interview_id = l.interview_id AND z.pos = l.last_pos, (VALUES (0), (1)) u(k))"""


def unpunctuated(src: str, out: str) -> str:
    """Out (interview_id, run_id, first_pos, last_pos, n, span_cs)."""
    return f"""{out}_c AS (SELECT *, regexp_matches(text, '[.,?!¿]') AS p, sum(CASE WHEN regexp_matches(text, '[.,?!¿]') THEN 1 ELSE 0 END) OVER (PARTITION BY interview_id ORDER BY pos) AS run FROM {src}),
{out} AS MATERIALIZED (SELECT interview_id, min(pos) AS run_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n, arg_max(t1, pos) - arg_min(t0, pos) AS span_cs FROM {out}_c WHERE NOT p GROUP BY interview_id, run HAVING arg_max(t1, pos) - arg_min(t0, pos) >= 6000)"""


def repaired(src: str, ranges: str, retries: str, out: str) -> str:
    """Q7: ranges replaced by what Q5 leaves of their retries (interview_id, run_id, k from 0, t0, t1, text), if A9 accepts that."""
    return f"""{reasons(retries, out + "_j", "interview_id, run_id")},
{out}_k AS MATERIALIZED (SELECT interview_id, run_id, row_number() OVER (PARTITION BY interview_id, run_id ORDER BY k) - 1 AS k, k AS pos, t0, t1, text FROM {out}_j WHERE reason IS NULL),
{runs(out + "_k", out + "_l", "interview_id, run_id")},
{out}_s AS (SELECT interview_id, run_id, count(*) AS n, count(*) FILTER (regexp_matches(text, '[.,?!¿]')) AS p, sum({n_words("text")}) AS words FROM {out}_k GROUP BY 1, 2),
{out}_o AS (SELECT g.interview_id, g.run_id, sum({n_words("x.text")}) AS words FROM {src} x JOIN {ranges} g ON g.interview_id = x.interview_id AND x.pos BETWEEN g.first_pos AND g.last_pos GROUP BY 1, 2),
{out}_a AS MATERIALIZED (SELECT g.* FROM {ranges} g JOIN {out}_s s USING (interview_id, run_id) JOIN {out}_o o USING (interview_id, run_id) WHERE s.p * 2 >= s.n AND s.words * 10 >= o.words * 7 AND (g.interview_id, g.run_id) NOT IN (SELECT interview_id, run_id FROM {out}_l)),
{spliced(src, out + "_a", out + "_k", out)}"""


def recovered(src: str, new: str, out: str) -> str:
    """Q8: src with the rows of new (interview_id, run_id, k from 0, t0, t1, text) that Q5 leaves, of gaps without a loop, put in by start."""
    return f"""{reasons(new, out + "_j", "interview_id, run_id")},
{out}_k AS MATERIALIZED (SELECT interview_id, run_id, row_number() OVER (PARTITION BY interview_id, run_id ORDER BY k) - 1 AS k, k AS pos, t0, t1, text FROM {out}_j WHERE reason IS NULL),
{runs(out + "_k", out + "_l", "interview_id, run_id")},
{out} AS MATERIALIZED (SELECT interview_id, row_number() OVER (PARTITION BY interview_id ORDER BY t0, src, pos) - 1 AS pos, t0, t1, text FROM (SELECT interview_id, pos, t0, t1, text, 0 AS src FROM {src}
UNION ALL SELECT interview_id, pos, t0, t1, text, 1 AS src FROM {out}_k WHERE (interview_id, run_id) NOT IN (SELECT interview_id, run_id FROM {out}_l)))"""


def nearest(points: str, turns: str, out: str, key: str) -> str:
    """Out (interview_id, key…, speaker_id) of points (interview_id, key…, x): the longest turn around each, else the nearest; turns (interview_id, start_ms, end_ms, speaker_id, old)."""
    cols = ", ".join(f"p.{k}" for k in key.split(", "))
    return f"""{out}_r AS (SELECT p.interview_id, {cols}, d.speaker_id, row_number() OVER (PARTITION BY p.interview_id, {cols} ORDER BY CASE WHEN d.start_ms <= x AND x < d.end_ms THEN 0 ELSE 1 END, greatest(0, d.start_ms - x, x - d.end_ms), d.start_ms - d.end_ms, d.start_ms, d.end_ms, d.old) AS nth
FROM {points} p JOIN {turns} d ON p.interview_id = d.interview_id), {out} AS MATERIALIZED (SELECT * EXCLUDE nth FROM {out}_r WHERE nth = 1)"""


def dominant(spans: str, turns: str, out: str, key: str) -> str:
    """Out (interview_id, key…, speaker_id, ms, second_ms, n_speakers) of spans (interview_id, key…, s, e)."""
    cols = ", ".join(f"x.{k}" for k in key.split(", "))
    return f"""{out}_o AS (SELECT x.interview_id, {cols}, d.speaker_id, sum(least(x.e, d.end_ms) - greatest(x.s, d.start_ms)) AS ms FROM {spans} x JOIN {turns} d ON x.interview_id = d.interview_id AND d.start_ms < x.e AND x.s < d.end_ms WHERE x.e > x.s AND d.end_ms > d.start_ms GROUP BY ALL),
{out}_n AS (SELECT *, row_number() OVER (PARTITION BY interview_id, {key} ORDER BY ms DESC, speaker_id) AS nth FROM {out}_o),
{out} AS MATERIALIZED (SELECT interview_id, {key}, max(speaker_id) FILTER (nth = 1) AS speaker_id, max(ms) FILTER (nth = 1) AS ms, coalesce(max(ms) FILTER (nth = 2), 0) AS second_ms, count(*) AS n_speakers FROM {out}_n GROUP BY ALL)"""


_ENDS = lambda w: f"right({w}, 1) IN ('.', '?', '!')"

#: §2.10, 2 to 5: pieces over sg (interview_id, pos, a, b, text) and turns vc (interview_id, start_ms, end_ms, speaker_id, old).
PIECES = f"""sp AS MATERIALIZED (SELECT interview_id, pos, a AS s, b AS e FROM sg), {dominant("sp", "vc", "dm", "pos")},
wl AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM sg),
wa AS MATERIALIZED (SELECT wl.*, len(ws) AS nw, dm.speaker_id, len(list_filter(ws[1:len(ws) - 1], lambda w: {_ENDS("w")})) + 1 AS n_sentences,
coalesce(n_speakers > 1 AND (ms * 100 < greatest(b - a, 1) * {speakers.DOMINANT_PERCENT} OR second_ms >= {speakers.SECOND_MS}) AND len(ws) >= {speakers.SPLIT_WORDS}, false) AS cut FROM wl LEFT JOIN dm USING (interview_id, pos)),
pw AS (SELECT interview_id, pos, (a + b) // 2 AS x FROM wa WHERE NOT cut AND speaker_id IS NULL), {nearest("pw", "vc", "nw1", "pos")},
out1 AS (SELECT interview_id, pos, 0 AS piece, a AS start_ms, b AS end_ms, coalesce(wa.speaker_id, nw1.speaker_id) AS speaker_id, text FROM wa LEFT JOIN nw1 USING (interview_id, pos) WHERE NOT cut),
ex AS MATERIALIZED (SELECT *, a + (b - a) * k // nw AS ws0, a + (b - a) * (k + 1) // nw AS ws1, ws[k + 1] AS w FROM (SELECT *, unnest(range(len(ws))) AS k FROM wa WHERE cut)),
se AS (SELECT *, coalesce(sum(CASE WHEN {_ENDS("w")} THEN 1 ELSE 0 END) OVER (PARTITION BY interview_id, pos ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM ex WHERE n_sentences >= 2),
st AS MATERIALIZED (SELECT interview_id, pos, sentence, arg_min(ws0, k) AS s, greatest(arg_max(ws1, k), arg_min(ws0, k) + 1) AS e, string_agg(w, ' ' ORDER BY k) AS part, min(a) AS a, min(b) AS b, min(text) AS text FROM se GROUP BY 1, 2, 3),
{dominant("st", "vc", "ds", "pos, sentence")},
pt AS (SELECT interview_id, pos, sentence, (s + e) // 2 AS x FROM st WHERE (interview_id, pos, sentence) NOT IN (SELECT interview_id, pos, sentence FROM ds)), {nearest("pt", "vc", "ns", "pos, sentence")},
sk AS (SELECT st.*, coalesce(ds.speaker_id, ns.speaker_id) AS speaker_id FROM st LEFT JOIN ds USING (interview_id, pos, sentence) LEFT JOIN ns USING (interview_id, pos, sentence)),
so AS (SELECT *, CASE WHEN row_number() OVER v = 1 OR lag(speaker_id) OVER v IS DISTINCT FROM speaker_id THEN 1 ELSE 0 END AS o FROM sk WINDOW v AS (PARTITION BY interview_id, pos ORDER BY sentence)),
sq AS (SELECT *, sum(o) OVER (PARTITION BY interview_id, pos ORDER BY sentence) - 1 AS piece FROM so),
sr AS (SELECT interview_id, pos, piece, CASE WHEN piece = 0 THEN min(a) ELSE arg_min(s, sentence) END AS start_ms, min(b) AS b, min(speaker_id) AS speaker_id, string_agg(part, ' ' ORDER BY sentence) AS part, min(text) AS text FROM sq GROUP BY 1, 2, 3),
out2 AS (SELECT interview_id, pos, piece, start_ms, CASE WHEN lead(start_ms) OVER v IS NULL THEN b ELSE greatest(start_ms, lead(start_ms) OVER v) END AS end_ms, speaker_id, CASE WHEN count(*) OVER (PARTITION BY interview_id, pos) = 1 THEN text ELSE part END AS text FROM sr WINDOW v AS (PARTITION BY interview_id, pos ORDER BY piece)),
xp AS (SELECT interview_id, pos, k, (ws0 + ws1) // 2 AS x FROM ex WHERE n_sentences < 2), {nearest("xp", "vc", "nx", "pos, k")},
xw AS MATERIALIZED (SELECT ex.*, nx.speaker_id AS who FROM ex LEFT JOIN nx USING (interview_id, pos, k) WHERE n_sentences < 2),
xo AS (SELECT *, CASE WHEN k = 0 OR lag(who) OVER (PARTITION BY interview_id, pos ORDER BY k) IS DISTINCT FROM who THEN 1 ELSE 0 END AS o FROM xw),
xr AS MATERIALIZED (SELECT interview_id, pos, sum(o) OVER (PARTITION BY interview_id, pos ORDER BY k) AS r, k AS head, who, nw FROM xo WHERE o = 1),
xs AS MATERIALIZED (SELECT *, coalesce(lead(head) OVER (PARTITION BY interview_id, pos ORDER BY r), nw) AS stop FROM xr),
ab AS (SELECT interview_id, pos, r, nw, stop >= {speakers.MIN_RUN_WORDS} OR stop = nw AS kept, stop >= {speakers.MIN_RUN_WORDS} OR stop = nw AS any_kept, 0 AS head, who AS last_who FROM xs WHERE r = 1
UNION ALL SELECT x.interview_id, x.pos, x.r, x.nw, CASE WHEN any_kept THEN stop - x.head >= {speakers.MIN_RUN_WORDS} AND x.who IS DISTINCT FROM last_who ELSE true END, true, CASE WHEN any_kept THEN x.head ELSE 0 END,
CASE WHEN NOT any_kept OR (stop - x.head >= {speakers.MIN_RUN_WORDS} AND x.who IS DISTINCT FROM last_who) THEN x.who ELSE last_who END FROM ab JOIN xs x ON x.interview_id = ab.interview_id AND x.pos = ab.pos AND x.r = ab.r + 1),
ah AS MATERIALIZED (SELECT interview_id, pos, nw, head, last_who AS who, row_number() OVER v AS h, coalesce(lead(head) OVER v, nw) AS stop FROM ab WHERE kept WINDOW v AS (PARTITION BY interview_id, pos ORDER BY r)),
op AS MATERIALIZED (SELECT interview_id, pos, k + 1 AS opening FROM xw WHERE {_ENDS("w")} AND k + 1 < nw),
ne AS MATERIALIZED (SELECT ah.*, (SELECT arg_min(opening, abs(opening - head) * 1000000 + opening) FROM op WHERE op.interview_id = ah.interview_id AND op.pos = ah.pos AND abs(opening - head) <= {speakers.SNAP_WORDS}) AS near FROM ah),
sn AS (SELECT interview_id, pos, h, nw, 1 AS piece_no, head AS begins, who FROM ne WHERE h = 1
UNION ALL SELECT n.interview_id, n.pos, n.h, n.nw, CASE WHEN near IS NOT NULL OR least(n.head, n.nw - n.head) > {speakers.EDGE_WORDS} THEN piece_no + 1 ELSE piece_no END,
CASE WHEN near IS NOT NULL OR least(n.head, n.nw - n.head) > {speakers.EDGE_WORDS} THEN least(greatest(coalesce(near, n.head), begins + 1), greatest(n.stop - 1, begins + 1)) ELSE begins END,
CASE WHEN near IS NOT NULL OR least(n.head, n.nw - n.head) > {speakers.EDGE_WORDS} OR n.stop - n.head > n.head - begins THEN n.who ELSE sn.who END FROM sn JOIN ne n ON n.interview_id = sn.interview_id AND n.pos = sn.pos AND n.h = sn.h + 1),
sh AS (SELECT interview_id, pos, piece_no, min(nw) AS nw, min(begins) AS begins, arg_max_null(who, h) AS who FROM sn GROUP BY 1, 2, 3),
si AS (SELECT *, CASE WHEN row_number() OVER v = 1 OR lag(who) OVER v IS DISTINCT FROM who THEN 1 ELSE 0 END AS o FROM sh WINDOW v AS (PARTITION BY interview_id, pos ORDER BY piece_no)),
sj AS MATERIALIZED (SELECT interview_id, pos, who, begins, row_number() OVER v - 1 AS piece, coalesce(lead(begins) OVER v, nw) AS stop, count(*) OVER (PARTITION BY interview_id, pos) AS n FROM si WHERE o = 1 WINDOW v AS (PARTITION BY interview_id, pos ORDER BY piece_no)),
sx AS (SELECT j.interview_id, j.pos, j.piece, CASE WHEN j.piece = 0 THEN min(a) ELSE arg_min(ws0, k) END AS start_ms, min(b) AS b, min(j.who) AS speaker_id, CASE WHEN min(n) = 1 THEN min(text) ELSE string_agg(w, ' ' ORDER BY k) END AS text FROM sj j JOIN xw ON xw.interview_id = j.interview_id AND xw.pos = j.pos AND k >= begins AND k < stop GROUP BY 1, 2, 3),
out3 AS (SELECT interview_id, pos, piece, start_ms, greatest(start_ms, coalesce(lead(start_ms) OVER v, b)) AS end_ms, speaker_id, text FROM sx WINDOW v AS (PARTITION BY interview_id, pos ORDER BY piece)),
pc AS MATERIALIZED (SELECT * FROM out1 UNION ALL SELECT * FROM out2 UNION ALL SELECT * FROM out3)"""


def roles(pieces: str, out: str) -> str:
    """Out (interview_id, speaker_id, role) of pieces (interview_id, speaker_id, start_ms, end_ms, text)."""
    return f"""{out}_c AS MATERIALIZED (SELECT interview_id, speaker_id, sum(end_ms - start_ms) AS talk, count(*) FILTER (regexp_matches(text, '[?¿]')) / count(*) AS score, min(start_ms) AS first FROM {pieces} WHERE speaker_id IS NOT NULL GROUP BY 1, 2),
{out}_o AS (SELECT *, row_number() OVER (PARTITION BY interview_id ORDER BY score DESC, speaker_id) AS r, count(*) OVER (PARTITION BY interview_id) AS n FROM {out}_c),
{out}_a AS (SELECT * FROM {out}_o WHERE r = 1 AND n >= 2), {out}_b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY interview_id ORDER BY talk DESC, r) AS q FROM {out}_o WHERE r > 1) WHERE q = 1),
{out}_p AS (SELECT a.interview_id, abs(a.score - b.score) < 0.05 AND (b.talk < a.talk OR (b.talk = a.talk AND b.first < a.first)) AS swap, a.speaker_id AS sa, b.speaker_id AS sb, a.score AS ca, b.score AS cb FROM {out}_a a JOIN {out}_b b USING (interview_id)),
{out}_f AS (SELECT interview_id, CASE WHEN swap THEN sb ELSE sa END AS i, CASE WHEN swap THEN sa ELSE sb END AS u, CASE WHEN swap THEN cb ELSE ca END AS ci, CASE WHEN swap THEN ca ELSE cb END AS cu FROM {out}_p),
{out} AS (SELECT c.interview_id, c.speaker_id, CASE WHEN c.speaker_id = i THEN 'interviewer' WHEN c.speaker_id = u THEN 'subject' WHEN abs(c.score - ci) < abs(c.score - cu) THEN 'interviewer' ELSE 'subject' END AS role FROM {out}_c c JOIN {out}_f USING (interview_id))"""
