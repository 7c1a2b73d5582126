"""Queries on text primitives, segment quality and speakers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tertulia.functions import formats, text
from tertulia.operators import quality, speakers
from tertulia.plans import segment_sql, views
from tertulia.plans.views import SEGMENTS_SQL, TURNS_SQL, VOICES_SQL
from tertulia.session import checkpointed

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


_low, _norm = segment_sql.low, segment_sql.norm
PLAIN = segment_sql.plain("text")
_CHANGES = "c AS (SELECT DISTINCT interview_id, line, original, term FROM glossary_changes)"


def _changes(spark, d):
    return views.table(spark, d, "glossary_changes").distinct()


@query("t1_t2_trim_lower", f"WITH {_CHANGES} SELECT interview_id, line, trim(original, ' ' || chr(9) || chr(13) || chr(10)) AS trimmed, {_low('term')} AS lowered FROM c")
def t1(spark, d):
    return _changes(spark, d).select("interview_id", "line", text.trim("original").alias("trimmed"), text.lower_ascii("term").alias("lowered"))


@query("t3_levenshtein", f"WITH {_CHANGES} SELECT interview_id, line, CAST(levenshtein(original, term) AS INT) AS distance FROM c WHERE original IS NOT NULL AND term IS NOT NULL")
def t3(spark, d):
    return _changes(spark, d).where("original is not null and term is not null").select("interview_id", "line", text.levenshtein_bytes("original", "term").alias("distance"))


@query("t4_t5_normalized", f"WITH {TURNS_SQL} SELECT interview_id, pos, {_norm('text')} AS normalized, {PLAIN} AS plain FROM t")
def t4(spark, d):
    return views.turns(spark, d).select("interview_id", "pos", text.normalized("text").alias("normalized"), quality.plain("text").alias("plain"))


@query("t6_words", f"WITH {TURNS_SQL} SELECT interview_id, pos, array_to_string(list_transform(list_filter(string_split_regex({_low('text')}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> ''), lambda x: {segment_sql.fold('x')}), ' ') AS words FROM t")
def t6(spark, d):
    return views.turns(spark, d).select("interview_id", "pos", F.array_join(text.words("text"), " ").alias("words"))


@query("t7_t12_marks", f"""WITH {TURNS_SQL} SELECT interview_id, pos, length(text) AS n_chars, strlen(text) AS n_bytes, regexp_matches(text, '[.,?!¿]') AS punctuated, right(text, 1) IN ('.', '?', '!') AS ends,
right(text, 1) IN ('.', '?', '!', ':') AS ends_paragraph, regexp_matches(text, '[?¿]') AS question FROM t""")  # fmt: skip
def t7(spark, d):
    ends = lambda marks: text.ends_sentence("text", marks)
    return views.turns(spark, d).select("interview_id", "pos", F.char_length("text").alias("n_chars"), F.octet_length("text").alias("n_bytes"), text.has_punctuation("text").alias("punctuated"), ends(".?!").alias("ends"), ends(".?!:").alias("ends_paragraph"), text.is_question("text").alias("question"))


@query("t8_common_substring", f"WITH {SEGMENTS_SQL}, {segment_sql.stretches(quality.STYLE_PROMPT)}, p AS (SELECT interview_id, pos, {PLAIN} AS p FROM s) SELECT interview_id, pos, CAST(coalesce(max(l), 0) AS INT) AS n_bytes FROM p LEFT JOIN sub ON contains(p.p, sub.x) GROUP BY 1, 2")
def t8(spark, d):
    return views.segments(spark, d).select("interview_id", "pos", text.common_substring(quality.plain("text"), quality.plain(F.lit(quality.STYLE_PROMPT))).alias("n_bytes"))


@query("t13_valid_utf8", f"""WITH {TURNS_SQL}, h AS (SELECT interview_id, pos, text, pos % 4 AS k FROM t)
SELECT interview_id, pos, CASE k WHEN 0 THEN text || chr(65533) WHEN 1 THEN chr(65533) || chr(65533) || text || 'ñ' WHEN 2 THEN 'a' || chr(65533) || 'b' || text ELSE text END AS text FROM h""")  # fmt: skip
def t13(spark, d):
    """Turns as bytes, spoilt: a sequence cut off at the end, bytes that begin none, a sequence with a wrong last byte, and left whole."""
    k, raw, byte = F.col("pos") % 4, F.encode("text", "UTF-8"), lambda x: F.unhex(F.lit(x))
    spoilt = F.when(k == 0, F.concat(raw, byte("C3"))).when(k == 1, F.concat(byte("80FF"), raw, byte("C3B1"))).when(k == 2, F.concat(byte("61E28261"), byte("62"), raw)).otherwise(raw)
    return views.turns(spark, d).select("interview_id", "pos", text.valid_text(spoilt).alias("text"))


@query("t14_t15_lines", "SELECT doc_id, trim(replace(replace(text, chr(10), ' '), chr(13), ' '), ' ' || chr(9) || chr(13) || chr(10)) AS line, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10)) <> '')) AS n_lines FROM documents WHERE text IS NOT NULL")
def t14(spark, d):
    return views.table(spark, d, "documents").where("text is not null").select("doc_id", text.single_line("text").alias("line"), F.size(text.lines("text")).cast("bigint").alias("n_lines"))


@query("t16_whole_words", f"""WITH {TURNS_SQL}, w AS (SELECT interview_id, pos, text, ' ' || regexp_replace(text, '([^0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}])', ' \\1 ', 'g') || ' ' AS spaced FROM t)
SELECT interview_id, pos, (length(spaced) - length(replace(spaced, ' de ', ''))) // 4 AS n_hits FROM w""")  # fmt: skip
def t16(spark, d):
    return views.turns(spark, d).select("interview_id", "pos", text.count_whole_words("text", F.lit("de")).cast("bigint").alias("n_hits"))


@query("t17_clock", f"WITH {SEGMENTS_SQL} SELECT interview_id, pos, format('{{:02d}}:{{:02d}}', t0 // 100 // 60, t0 // 100 % 60) AS clock FROM s")
def t17(spark, d):
    return views.segments(spark, d).select("interview_id", "pos", text.clock_cs("t0").alias("clock"))


@query("t18_plausible", f"WITH {_CHANGES} SELECT interview_id, line, strlen({_norm('original')}) > 0 AND strlen({_norm('term')}) > 0 AND 2 * levenshtein({_norm('original')}, {_norm('term')}) <= greatest(strlen({_norm('original')}), strlen({_norm('term')})) AS plausible FROM c WHERE original IS NOT NULL AND term IS NOT NULL")
def t18(spark, d):
    return _changes(spark, d).where("original is not null and term is not null").select("interview_id", "line", text.plausible_pair("original", "term").alias("plausible"))


@query("x10_plausible_correction", f"WITH {_CHANGES} SELECT interview_id, line, strlen(term) > 0 AND CASE WHEN strlen(original) < 15 THEN strlen(term) < 40 ELSE strlen(term) * 10 >= strlen(original) * 6 AND strlen(term) * 10 <= strlen(original) * 16 END AS plausible FROM c WHERE original IS NOT NULL AND term IS NOT NULL")
def x10(spark, d):
    return _changes(spark, d).where("original is not null and term is not null").select("interview_id", "line", formats.plausible_correction("original", "term").alias("plausible"))


_KNOWN = segment_sql.known()
_DENSE = "(length(text) * 100 > greatest(t1 - t0, 0) * 35 + 1000)"
_NEAR = f"""n AS (SELECT *, {_norm("text")} AS m FROM s), r AS (SELECT a.interview_id, a.pos, bool_or(b.m <> '' AND a.m <> '' AND (contains(b.m, a.m) OR contains(a.m, b.m))) AS rep FROM n a JOIN n b ON a.interview_id = b.interview_id AND b.pos BETWEEN a.pos - 3 AND a.pos + 3 AND a.pos <> b.pos GROUP BY 1, 2)"""


@query("q1_known", f"WITH {SEGMENTS_SQL} SELECT interview_id, pos, text FROM s WHERE {_KNOWN}")
def q1(spark, d):
    return views.segments(spark, d).where(quality.known_hallucination("text", "t0", "t1")).select("interview_id", "pos", "text")


@query("q2_density", f"WITH {SEGMENTS_SQL} SELECT interview_id, pos FROM s WHERE {_DENSE}")
def q2(spark, d):
    return views.segments(spark, d).where(quality.too_dense("text", "t0", "t1")).select("interview_id", "pos")


@query("j10_neighbour_repeats", f"WITH {SEGMENTS_SQL}, {_NEAR} SELECT s.interview_id, s.pos FROM s JOIN r USING (interview_id, pos) WHERE rep")
def j10(spark, d):
    return quality.with_repeats(views.segments(spark, d)).where("repeats").select("interview_id", "pos")


@query("q3_dense_repeat", f"WITH {SEGMENTS_SQL}, {_NEAR} SELECT s.interview_id, s.pos FROM s JOIN r USING (interview_id, pos) WHERE rep AND {_DENSE}")
def q3(spark, d):
    return quality.with_repeats(views.segments(spark, d)).where(F.col("repeats") & quality.too_dense("text", "t0", "t1")).select("interview_id", "pos")


_ECHO_PROMPT = "Cuénteme un poco del trámite. ¿Qué cambió después de la mudanza?"


@query("q4_prompt_echo", f"""WITH {SEGMENTS_SQL}, {segment_sql.stretches(_ECHO_PROMPT)}, p AS (SELECT interview_id, pos, text, {PLAIN} AS p FROM s)
SELECT interview_id, pos, text FROM p JOIN sub ON l >= 25 AND contains(p, x) WHERE strlen(p) >= 25 GROUP BY interview_id, pos, text, p HAVING 2 * max(l) >= strlen(p)""")  # fmt: skip
def q4(spark, d):
    return quality.with_echo(views.segments(spark, d), _ECHO_PROMPT).where("echo").select("interview_id", "pos", "text")


@query("q5_drop_reasons", f"WITH {SEGMENTS_SQL}, z AS (SELECT *, pos AS k FROM s), {segment_sql.stretches(_ECHO_PROMPT)}, {segment_sql.reasons('z', 'q')} SELECT interview_id, pos, reason FROM q")
def q5(spark, d):
    return quality.with_drop_reason(views.segments(spark, d), _ECHO_PROMPT).select("interview_id", "pos", "reason")


@query("w5_gaps", f"WITH {SEGMENTS_SQL}, g AS (SELECT interview_id, t0, coalesce(max(t1) OVER (PARTITION BY interview_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM s) SELECT interview_id, reach AS gap_start, t0 AS gap_end FROM g WHERE t0 - reach >= 800")
def w5(spark, d):
    return quality.gaps(views.segments(spark, d))


@query("w6_unpunctuated", f"""WITH {SEGMENTS_SQL}, f AS (SELECT *, regexp_matches(text, '[.,?!¿]') AS p FROM s), l AS (SELECT *, CASE WHEN lag(p) OVER w IS DISTINCT FROM p THEN 1 ELSE 0 END AS o FROM f WINDOW w AS (PARTITION BY interview_id ORDER BY pos)),
g AS (SELECT *, sum(o) OVER (PARTITION BY interview_id ORDER BY pos) AS run FROM l)
SELECT interview_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n, arg_max(t1, pos) - arg_min(t0, pos) AS span_cs FROM g WHERE NOT p GROUP BY interview_id, run HAVING arg_max(t1, pos) - arg_min(t0, pos) >= 6000""")  # fmt: skip
def w6(spark, d):
    return quality.unpunctuated_runs(views.segments(spark, d))


@query("a8_a9_word_counts", f"WITH {SEGMENTS_SQL} SELECT interview_id, count(*) AS n_segments, count(*) FILTER (regexp_matches(text, '[.,?!¿]')) AS n_punctuated, CAST(sum(len(list_filter(string_split_regex({_low('text')}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> ''))) AS BIGINT) AS n_words FROM s GROUP BY 1")
def a8(spark, d):
    return quality.word_counts(views.segments(spark, d))


_INDEXED = f"{SEGMENTS_SQL}, z AS MATERIALIZED (SELECT *, pos AS k FROM s)"
_LOOPS = f"{_INDEXED}, {segment_sql.runs('z', 'lp')}"


@query("f1_loops", f"WITH RECURSIVE {_LOOPS} SELECT * FROM lp")
def f1(spark, d):
    return quality.repeat_runs(views.segments(spark, d))


_LOOP_RANGES = "lg AS MATERIALIZED (SELECT interview_id, first_pos AS run_id, first_pos, last_pos FROM lp)"


@query("f2_loop_markers", f"WITH RECURSIVE {_LOOPS}, {_LOOP_RANGES}, {segment_sql.marked('s', 'lg', 'mk')}, {segment_sql.spliced('s', 'lg', 'mk', 'f')} SELECT * FROM f")
def f2(spark, d):
    return quality.loops_replaced(checkpointed(views.segments(spark, d)))


def _full_stops(segments, ranges):
    """A second attempt at each unpunctuated stretch: its rows with a full stop."""
    rows = segments.join(ranges.select("interview_id", "run_id", "first_pos", "last_pos"), "interview_id").where("pos between first_pos and last_pos")
    return rows.select("interview_id", "run_id", (F.col("pos") - F.col("first_pos")).alias("pos"), "t0", "t1", F.concat("text", F.lit(".")).alias("text"))


def _full_stops_sql(src: str, ranges: str, out: str) -> str:
    return f"{out} AS MATERIALIZED (SELECT x.interview_id, run_id, x.pos - first_pos AS k, t0, t1, text || '.' AS text FROM {src} x JOIN {ranges} g ON g.interview_id = x.interview_id AND x.pos BETWEEN first_pos AND last_pos)"


_STYLE = segment_sql.stretches(quality.STYLE_PROMPT)


@query("q7_unpunctuated_retry", f"WITH RECURSIVE {SEGMENTS_SQL}, {_STYLE}, {segment_sql.unpunctuated('s', 'u')}, {_full_stops_sql('s', 'u', 'y')}, {segment_sql.repaired('s', 'u', 'y', 'q')} SELECT * FROM q")
def q7(spark, d):
    """Each unpunctuated stretch with a retry that has a full stop behind each row, taken where it is accepted."""
    s = checkpointed(views.segments(spark, d))
    ranges = checkpointed(quality.unpunctuated_runs(s).withColumn("run_id", F.col("first_pos")))
    return quality.repaired(s, ranges, _full_stops(s, ranges))


@query("m1_q8_recovered", f"""WITH {SEGMENTS_SQL}, n AS (SELECT interview_id, pos, t0 + 1 AS t0, t1, 'recuperado' AS text, 1 AS src FROM s WHERE pos % 10 = 4), u AS (SELECT *, 0 AS src FROM s UNION ALL SELECT * FROM n)
SELECT interview_id, row_number() OVER (PARTITION BY interview_id ORDER BY t0, src, pos) - 1 AS pos, t0, t1, text FROM u""")  # fmt: skip
def m1(spark, d):
    s = checkpointed(views.segments(spark, d))
    recovered = s.where("pos % 10 = 4").withColumn("run_id", F.col("pos")).withColumn("t0", F.col("t0") + 1).withColumn("text", F.lit("recuperado"))
    return quality.with_recovered(s, quality.accepted_recovered(recovered))


_Q9_STEP = f"""{_LOOPS}, {_STYLE}, {_LOOP_RANGES},
rt AS MATERIALIZED (SELECT g.interview_id, g.run_id, u.k, x.t0, x.t1, CASE WHEN u.k = 0 OR g.run_id % 3 = 0 THEN 'Esto se oyó al repetir.' ELSE 'Y esto después, aparte.' END AS text FROM lg g JOIN s x ON x.interview_id = g.interview_id AND x.pos = g.first_pos, (VALUES (0), (1), (2)) u(k) WHERE g.run_id % 3 < 2),
rl AS (SELECT interview_id, run_id FROM rt WHERE run_id % 3 = 0), {segment_sql.marked("s", "lg", "mk")},
nw AS MATERIALIZED (SELECT * FROM rt WHERE (interview_id, run_id) NOT IN (SELECT * FROM rl) UNION ALL SELECT * FROM mk WHERE run_id % 3 <> 1), {segment_sql.spliced("s", "lg", "nw", "c1")},
c1k AS MATERIALIZED (SELECT *, pos AS k FROM c1), {segment_sql.reasons("c1k", "c2")}, c3 AS MATERIALIZED (SELECT interview_id, row_number() OVER (PARTITION BY interview_id ORDER BY pos) - 1 AS pos, t0, t1, text FROM c2 WHERE reason IS NULL)"""


@query("q9_cleaned", f"""WITH RECURSIVE {_Q9_STEP}, {segment_sql.unpunctuated("c3", "u")}, {_full_stops_sql("c3", "u", "y")}, {segment_sql.repaired("c3", "u", "y", "c4")},
gp AS MATERIALIZED (SELECT interview_id, pos AS run_id, 0 AS k, t0 + 1 AS t0, t1, 'recuperado ' || pos AS text FROM s WHERE pos % 10 = 4), {segment_sql.recovered("c4", "gp", "c5")}
SELECT interview_id, pos, t0 * 10 AS start_ms, t1 * 10 AS end_ms, text FROM c5""")  # fmt: skip
def q9(spark, d):
    """All steps: of the loops a third is tried again well, a third with another loop, a third not at all; stretches get full stops; every tenth row a recovered one behind it."""
    s = checkpointed(views.segments(spark, d))
    loops = quality.repeat_runs(s).where("first_pos % 3 < 2").withColumn("run_id", F.col("first_pos"))
    first = s.join(loops.select("interview_id", F.col("first_pos").alias("pos"), "run_id"), ["interview_id", "pos"])
    tried = first.withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    said = F.when((F.col("k") == 0) | (F.col("run_id") % 3 == 0), "Esto se oyó al repetir.").otherwise("Y esto después, aparte.")
    retries = checkpointed(tried.select("interview_id", "run_id", F.col("k").alias("pos"), "t0", "t1", said.alias("text")))
    so_far = checkpointed(quality.cleaned(s, loop_retries=retries)).withColumn("t0", F.floor(F.col("start_ms") / 10)).withColumn("t1", F.floor(F.col("end_ms") / 10))
    ranges = quality.unpunctuated_runs(so_far).withColumn("run_id", F.col("first_pos"))
    recovered = s.where("pos % 10 = 4").select("interview_id", F.col("pos").alias("run_id"), F.lit(0).alias("pos"), (F.col("t0") + 1).alias("t0"), "t1", F.concat(F.lit("recuperado "), "pos").alias("text"))
    return quality.cleaned(s, loop_retries=retries, stretch_retries=checkpointed(_full_stops(so_far, ranges)), recovered=recovered)


_OVER = f"""{SEGMENTS_SQL}, {VOICES_SQL}, o AS (SELECT s.interview_id, s.pos AS id, d.speaker_id, CAST(sum(least(s.t1 * 10, d.end_ms) - greatest(s.t0 * 10, d.start_ms)) AS BIGINT) AS ms
FROM s JOIN d ON s.interview_id = d.interview_id AND d.start_ms < s.t1 * 10 AND s.t0 * 10 < d.end_ms WHERE s.t1 > s.t0 GROUP BY 1, 2, 3)"""


@query("j2_overlap", f"WITH {_OVER} SELECT * FROM o")
def j2(spark, d):
    return speakers.overlap_by_speaker(views.spans(spark, d), speakers.ordered_turns(views.voices(spark, d)))


@query("a4_a5_dominant", f"""WITH {_OVER}, r AS (SELECT *, row_number() OVER (PARTITION BY interview_id, id ORDER BY ms DESC, speaker_id) AS r FROM o)
SELECT interview_id, id, max(speaker_id) FILTER (r = 1) AS speaker_id, max(ms) FILTER (r = 1) AS ms, coalesce(max(ms) FILTER (r = 2), 0) AS second_ms, CAST(sum(ms) AS BIGINT) AS total_ms, count(*) AS n_speakers FROM r GROUP BY 1, 2""")  # fmt: skip
def a4(spark, d):
    return speakers.dominant(speakers.overlap_by_speaker(views.spans(spark, d), speakers.ordered_turns(views.voices(spark, d))))


@query("a2_a3_relevance", f"""WITH {TURNS_SQL}, {VOICES_SQL}, c AS (SELECT interview_id, speaker_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, count(*) AS n_turns FROM d GROUP BY 1, 2)
SELECT *, n_turns >= 3 AND talk_ms * 100 >= 3 * sum(talk_ms) OVER (PARTITION BY interview_id) AS relevant FROM c""")  # fmt: skip
def a3(spark, d):
    return speakers.relevance(views.voices(spark, d))


@query("j3_speaker_at", f"""WITH {SEGMENTS_SQL}, {VOICES_SQL}, p AS (SELECT interview_id, pos AS id, (t0 * 10 + t1 * 10) // 2 AS x FROM s),
c AS (SELECT p.interview_id, p.id, d.speaker_id, CASE WHEN d.start_ms <= x AND x < d.end_ms THEN 0 ELSE greatest(0, d.start_ms - x, x - d.end_ms) END AS gap,
row_number() OVER (PARTITION BY p.interview_id, p.id ORDER BY CASE WHEN d.start_ms <= x AND x < d.end_ms THEN 0 ELSE 1 END, greatest(0, d.start_ms - x, x - d.end_ms), d.start_ms - d.end_ms, d.start_ms, d.end_ms, d.speaker_id) AS r FROM p JOIN d ON p.interview_id = d.interview_id)
SELECT interview_id, id, speaker_id, gap FROM c WHERE r = 1""")  # fmt: skip
def j3(spark, d):
    middle = F.floor((F.col("s") + F.col("e")) / 2)
    points = views.spans(spark, d).select("interview_id", "id", middle.alias("s"), middle.alias("e"))
    return speakers.nearest(points, speakers.ordered_turns(views.voices(spark, d)))


_REASSIGN = f"""{VOICES_SQL}, c AS (SELECT interview_id, speaker_id, sum(end_ms - start_ms) AS talk_ms, count(*) AS n_turns FROM d GROUP BY 1, 2),
v AS (SELECT *, n_turns >= 3 AND talk_ms * 100 >= 3 * sum(talk_ms) OVER (PARTITION BY interview_id) AS relevant FROM c), k AS (SELECT d.*, relevant FROM d JOIN v USING (interview_id, speaker_id)),
b AS (SELECT x.interview_id, x.start_ms, x.end_ms, x.speaker_id AS old, y.speaker_id, row_number() OVER (PARTITION BY x.interview_id, x.start_ms, x.end_ms, x.speaker_id ORDER BY greatest(0, y.start_ms - x.end_ms, x.start_ms - y.end_ms),
CASE WHEN y.start_ms < x.end_ms AND x.start_ms < y.end_ms THEN 0 ELSE 1 END, y.start_ms - y.end_ms, y.start_ms, y.end_ms, y.speaker_id) AS r FROM k x JOIN k y ON x.interview_id = y.interview_id AND NOT x.relevant AND y.relevant)"""


@query("j4_nearest_relevant", f"""WITH {TURNS_SQL}, {_REASSIGN} SELECT interview_id, start_ms, end_ms, speaker_id FROM k WHERE relevant UNION ALL SELECT interview_id, start_ms, end_ms, speaker_id FROM b WHERE r = 1
UNION ALL SELECT k.interview_id, start_ms, end_ms, speaker_id FROM k WHERE NOT relevant AND interview_id NOT IN (SELECT interview_id FROM k WHERE relevant)""")  # fmt: skip
def j4(spark, d):
    return speakers.reassigned(views.voices(spark, d)).drop("k")


def _voiced(spark, d):
    """Segments in ms with words spread evenly, and the acoustic turns."""
    s = views.segments(spark, d).select("interview_id", "pos", (F.col("t0") * 10).alias("start_ms"), (F.col("t1") * 10).alias("end_ms"), "text")
    return speakers.projected_words(s), views.voices(spark, d)


@query("w15_projected_words", f"""WITH {SEGMENTS_SQL}, w AS (SELECT interview_id, pos, t0 * 10 AS a, t1 * 10 AS b, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM s), e AS (SELECT *, len(ws) AS n, unnest(range(len(ws))) AS k FROM w)
SELECT interview_id, pos, k, a + (b - a) * k // n AS start_ms, a + (b - a) * (k + 1) // n AS end_ms, ws[k + 1] AS word FROM e""")  # fmt: skip
def w15(spark, d):
    s, _ = _voiced(spark, d)
    return s.select("interview_id", "pos", F.posexplode("words").alias("k", "w")).select("interview_id", "pos", "k", "w.start_ms", "w.end_ms", F.col("w.text").alias("word"))


@query("q11_words_of_tokens", f"""WITH {SEGMENTS_SQL}, w AS (SELECT interview_id, pos, t0 * 10 AS a, t1 * 10 AS b, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM s), e AS (SELECT *, unnest(range(len(ws))) AS k FROM w)
SELECT interview_id, pos AS seg, k + 1 AS w, a + CASE WHEN pos % 9 = 0 THEN (b - a) * k // len(ws) ELSE k * 20 * (b - a) // (len(ws) * 20) END AS start_ms, a + CASE WHEN pos % 9 = 0 THEN (b - a) * (k + 1) // len(ws) ELSE (k + 1) * 20 * (b - a) // (len(ws) * 20) END AS end_ms, ws[k + 1] AS text FROM e""")  # fmt: skip
def q11(spark, d):
    """Each word of a segment as one or two tokens of 20 ticks in all, special ones between; every ninth segment without raw times."""
    s = views.segments(spark, d).where("text <> ''")
    word = s.select("interview_id", F.col("pos").alias("seg"), (F.col("t0") * 10).alias("start_ms"), (F.col("t1") * 10).alias("end_ms"), F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("k", "w"))
    half = F.floor(F.char_length("w") / 2).cast("int")
    token = lambda p, a, b, x: F.struct(F.lit(p).alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b"), x.alias("text"))
    parts = F.array(token(0, 0, 0, F.lit("[_TT_7]")), token(1, 0, 9, F.concat(F.lit(" "), F.substring(F.col("w"), F.lit(1), half))), token(2, 9, 20, F.substring(F.col("w"), half + 1, F.char_length("w"))))
    raw = lambda c: F.when(F.col("seg") % 9 == 0, F.lit(0)).otherwise(F.col("k") * 20 + F.col(c)).cast("bigint")
    tokens = word.select("*", F.explode(parts).alias("t")).select("interview_id", "seg", (F.col("k") * 3 + F.col("t.p")).alias("pos"), raw("t.a").alias("raw_start"), raw("t.b").alias("raw_end"), "t.text", "start_ms", "end_ms")
    return speakers.words_of_tokens(tokens).select("interview_id", "seg", F.explode("words").alias("x")).select("interview_id", "seg", "x.*")


_SPOKEN = f"""{SEGMENTS_SQL}, {_REASSIGN}, sg AS MATERIALIZED (SELECT interview_id, pos, t0 * 10 AS a, t1 * 10 AS b, text FROM s WHERE text <> ''),
vc AS MATERIALIZED (SELECT interview_id, start_ms, end_ms, speaker_id, speaker_id AS old FROM k WHERE relevant UNION ALL SELECT interview_id, start_ms, end_ms, speaker_id, old FROM b WHERE r = 1
UNION ALL SELECT interview_id, start_ms, end_ms, speaker_id, speaker_id AS old FROM k WHERE NOT relevant AND interview_id NOT IN (SELECT interview_id FROM k WHERE relevant)), {segment_sql.PIECES}"""


@query("f7_f8_pieces", f"WITH RECURSIVE {_SPOKEN} SELECT * FROM pc")
def f7(spark, d):
    return speakers.pieces(*_voiced(spark, d))


@query("a6_cluster_stats", f"""WITH {TURNS_SQL}, x AS (SELECT interview_id, CASE speaker WHEN 'interviewer' THEN 1 WHEN 'subject' THEN 2 END AS speaker_id, start_ms, end_ms, text FROM t WHERE end_ms > start_ms AND text <> '')
SELECT interview_id, speaker_id, CAST(sum(end_ms - start_ms) AS BIGINT) AS talk_ms, count(*) AS n_pieces, count(*) FILTER (regexp_matches(text, '[?¿]')) AS n_questions, min(start_ms) AS first_ms FROM x WHERE speaker_id IS NOT NULL GROUP BY 1, 2""")  # fmt: skip
def a6(spark, d):
    return speakers.cluster_stats(_coded(spark, d)).drop("score")


def _coded(spark, d):
    code = F.when(F.col("speaker") == "interviewer", 1).when(F.col("speaker") == "subject", 2)
    return views.turns(spark, d).where("end_ms > start_ms and text <> ''").withColumn("speaker_id", code)


@query("a7_roles", f"""WITH {TURNS_SQL}, x AS (SELECT interview_id, CASE WHEN speaker = 'interviewer' THEN 1 WHEN speaker = 'subject' THEN 2 ELSE 3 END AS speaker_id, start_ms, end_ms, text FROM t WHERE end_ms > start_ms AND text <> ''), {segment_sql.roles("x", "f")} SELECT * FROM f""")
def a7(spark, d):
    code = F.when(F.col("speaker") == "interviewer", 1).when(F.col("speaker") == "subject", 2).otherwise(3)
    parts = views.turns(spark, d).where("end_ms > start_ms and text <> ''").withColumn("speaker_id", code)
    return speakers.elected_roles(speakers.cluster_stats(parts))


@query("assign_speakers", f"WITH RECURSIVE {_SPOKEN}, {segment_sql.roles('pc', 'rr')} SELECT interview_id, pos, piece, start_ms, end_ms, role AS speaker, text FROM pc LEFT JOIN rr USING (interview_id, speaker_id)")
def assign(spark, d):
    return speakers.assigned(*_voiced(spark, d))


@query("w8_filled_roles", f"""WITH {TURNS_SQL} SELECT interview_id, pos, coalesce(last_value(speaker IGNORE NULLS) OVER (PARTITION BY interview_id ORDER BY pos ROWS UNBOUNDED PRECEDING),
first_value(speaker IGNORE NULLS) OVER (PARTITION BY interview_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS speaker FROM t""")  # fmt: skip
def w8(spark, d):
    return speakers.filled_roles(views.turns(spark, d)).select("interview_id", "pos", "speaker")
