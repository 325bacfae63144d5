"""DuckDB SQL for the queries of catalog.py: shared parts, and one statement per query."""

from __future__ import annotations

_PARTS = {
    "lines": ("", r"SELECT conv_id, turn, role, i - 1 AS line, parts[i] AS text FROM (SELECT conv_id, turn, role, string_split(text, chr(10)) AS parts FROM conversations), unnest(range(1, len(parts) + 1)) AS t(i)"),
    "numbered": ("lines", r"SELECT conv_id, turn, role, text, len(regexp_extract_all(text, '\S+'))::BIGINT AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) - 1 AS seq FROM lines"),
    "ended": ("numbered", "SELECT *, greatest(1, words) * 400 AS dur_ms, (sum(greatest(1, words) * 400) OVER (PARTITION BY conv_id ORDER BY seq))::BIGINT AS e FROM numbered"),
    "segments": ("ended", "SELECT conv_id AS source_id, seq, turn, role, text, words, e - dur_ms AS start_ms, e AS end_ms, lp AS avg_logprob, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, exp(lp))), 4) AS confidence FROM (SELECT *, -((conv_id * 31 + seq * 17) % 100) / 100.0::DOUBLE AS lp FROM ended)"),
    "diar": ("segments", "SELECT source_id, turn AS dseq, role AS speaker, min(start_ms) + ((turn * 37 + source_id) % 7 - 3) * 200 AS start_ms, max(end_ms) + ((turn * 53 + source_id) % 5 - 2) * 300 AS end_ms FROM segments WHERE (source_id + turn) % 7 <> 0 GROUP BY source_id, turn, role"),
    "results": ("segments", "SELECT source_id, 'es' AS language, max(end_ms) AS duration_ms, CASE WHEN source_id % 3 <> 0 THEN '/audio/' || source_id || '.wav' END AS source FROM segments GROUP BY source_id"),
    "overlap": ("segments diar", "SELECT s.source_id, s.seq, d.speaker, sum(least(s.end_ms, d.end_ms) - greatest(s.start_ms, d.start_ms))::BIGINT AS overlap_ms, min(d.dseq) AS first_dseq FROM segments s JOIN diar d ON s.source_id = d.source_id AND s.start_ms < d.end_ms AND s.end_ms > d.start_ms WHERE least(s.end_ms, d.end_ms) > greatest(s.start_ms, d.start_ms) GROUP BY ALL"),
    "best": ("overlap", "SELECT * FROM overlap QUALIFY row_number() OVER (PARTITION BY source_id, seq ORDER BY overlap_ms DESC, first_dseq) = 1"),
    "dominant": ("segments best", "SELECT s.*, b.speaker FROM segments s LEFT JOIN best b USING (source_id, seq)"),
    "labelled": ("dominant", "SELECT * EXCLUDE (speaker), coalesce(last_value(speaker IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS speaker FROM dominant"),
    "marked": ("labelled", "SELECT *, (sum(n) OVER (PARTITION BY source_id ORDER BY seq))::BIGINT - 1 AS turn_index FROM (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY source_id ORDER BY seq) = speaker THEN 0 ELSE 1 END AS n FROM labelled)"),
    "turns": ("marked", r"SELECT source_id, turn_index, first(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, seq) AS end_ms, string_agg(regexp_replace(text, '^\s+|\s+$', '', 'g'), ' ' ORDER BY seq) AS text, count(*) AS n_segments, avg(confidence) AS mean, list({'start': round(start_ms / 1000.0::DOUBLE, 3), 'end': round(end_ms / 1000.0::DOUBLE, 3), 'text': regexp_replace(text, '^\s+|\s+$', '', 'g'), 'confidence': confidence} ORDER BY seq) AS segs FROM marked GROUP BY source_id, turn_index"),
    "stats": ("turns", r"SELECT source_id, speaker, sum(end_ms - start_ms)::BIGINT AS total_ms, count(*) AS turn_count, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS word_count, row_number() OVER (PARTITION BY source_id ORDER BY min(turn_index)) - 1 AS place FROM turns GROUP BY source_id, speaker"),
    "speech": ("diar", "SELECT source_id, speaker, sum(end_ms - start_ms)::BIGINT AS total_ms, min(dseq) AS first_dseq FROM diar GROUP BY source_id, speaker"),
    "ranked": ("speech", "SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY total_ms, first_dseq) - 1 AS r FROM speech"),
    "moments": ("", "SELECT user_id AS source_id, event_id, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // 1000 AS at_ms FROM events"),
    "ends": ("moments", "SELECT source_id, max(at_ms) AS total_ms FROM moments GROUP BY source_id"),
    "gaps": ("moments", "SELECT source_id, s AS start_ms, e AS end_ms FROM (SELECT source_id, lag(at_ms) OVER (PARTITION BY source_id ORDER BY at_ms, event_id) AS s, at_ms AS e FROM moments) WHERE e - s >= 6 * 3600000"),
    "gap_lists": ("ends gaps", "SELECT ends.source_id, total_ms, coalesce(list({'size': end_ms - start_ms, 'neg': -start_ms, 'a': start_ms, 'b': end_ms} ORDER BY start_ms) FILTER (WHERE start_ms IS NOT NULL), []) AS g FROM ends LEFT JOIN gaps USING (source_id) GROUP BY ends.source_id, total_ms"),
    "steps": (
        "gap_lists",
        """SELECT source_id, total_ms, g, 0::BIGINT AS cursor, NULL::BIGINT AS cut FROM gap_lists
        UNION ALL
        SELECT source_id, total_ms, g, c, c FROM (
            SELECT *, CASE WHEN (best.a + best.b) // 2 > cursor THEN (best.a + best.b) // 2 ELSE cursor + 216000000 END AS c FROM (
                SELECT *, list_max(list_filter(g, lambda x: x.a < cursor + 172800000 + 900000 AND x.b > cursor + 172800000 - 900000)) AS best FROM steps WHERE cursor + 172800000 < total_ms
            )
        ) WHERE c < total_ms""",
    ),
    "cuts": ("steps", "SELECT source_id, total_ms, row_number() OVER (PARTITION BY source_id ORDER BY cut) - 1 AS cut_index, cut FROM steps WHERE cut IS NOT NULL"),
    "pieces": ("segments", "SELECT source_id, idx, idx * 20000 AS start_ms, least(idx * 20000 + 20000, total_ms) AS end_ms, CASE WHEN idx > 0 THEN 2000 ELSE 0 END::BIGINT AS overlap_start_ms FROM (SELECT source_id, max(end_ms) AS total_ms FROM segments GROUP BY source_id), unnest(range(0, (total_ms - 1) // 20000 + 1)) AS t(idx)"),
    "heard": ("segments pieces", "SELECT s.source_id, p.idx, s.seq, s.start_ms, s.end_ms, s.text, s.confidence, p.start_ms AS chunk_start_ms, p.overlap_start_ms FROM segments s JOIN pieces p ON s.source_id = p.source_id AND s.start_ms >= p.start_ms - p.overlap_start_ms AND s.start_ms < p.end_ms"),
    "kept": ("heard", "SELECT * FROM heard WHERE idx = 0 OR end_ms > chunk_start_ms + overlap_start_ms"),
    "done": ("heard", "SELECT DISTINCT source_id, idx FROM heard WHERE (source_id + idx) % 3 <> 0"),
    "outputs": ("", "SELECT DISTINCT conv_id AS stem, unnest(CASE conv_id % 4 WHEN 0 THEN ['.txt', '.json', '.srt'] WHEN 1 THEN ['.txt'] WHEN 2 THEN ['.txt', '.srt'] ELSE ['.json'] END) AS ext FROM conversations"),
    "batch": ("", "SELECT user_id AS batch, event_id, CASE WHEN event_id % 37 = 0 THEN 'HALT' WHEN event_id % 5 = 0 THEN 'FAILED' ELSE 'OK' END AS status FROM events"),
}


def _with(*names: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _PARTS[name][0].split():
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    recursive = "RECURSIVE " if "steps" in order else ""
    return f"WITH {recursive}" + ", ".join(f"{n} AS ({_PARTS[n][1]})" for n in order) + " "


_SRT = lambda s: f"printf('%02d:%02d:%02d,%03d', ms({s}) // 3600000, ms({s}) // 60000 % 60, ms({s}) // 1000 % 60, ms({s}) % 1000)".replace(f"ms({s})", f"trunc({s} * 1000)::BIGINT")
_HMS = lambda s: f"printf('%d:%02d:%02d', trunc({s})::BIGINT // 3600, trunc({s})::BIGINT // 60 % 60, trunc({s})::BIGINT % 60)"
_STRIP = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_S = lambda c: f"({c} / 1000.0::DOUBLE)"
#: The mean of confidences of four decimals, half a unit rounded up: whole numbers, so that neither the order of rows nor binary fractions decide a tie.
_MEAN = "(2 * sum((confidence * 10000)::BIGINT) + count(*)) // (2 * count(*)) / 10000.0::DOUBLE"
_KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]', '', 'g')"
_NAMES = f"WITH names AS (SELECT url AS name FROM pages UNION ALL SELECT upper(url) FROM pages WHERE page_id % 10 = 0), keyed AS (SELECT {_KEY.format('name')} AS k, count(*) AS n, min(name) AS name FROM names GROUP BY 1) "
_ROLE = "CASE r WHEN 0 THEN '{}' WHEN 1 THEN '{}' ELSE 'SPEAKER_' || r END AS role"

SQL = {
    "segment_duration": _with("segments") + f"SELECT source_id, seq, {_S('(end_ms - start_ms)')} AS duration_s FROM segments",
    "logprob_confidence": _with("segments") + "SELECT source_id, seq, confidence FROM segments",
    "srt_time": _with("segments") + f"SELECT source_id, seq, {_SRT(_S('start_ms'))} AS begins, {_SRT(_S('end_ms'))} AS ends FROM segments",
    "hms_time": _with("segments") + f"SELECT source_id, seq, {_HMS(_S('start_ms'))} AS begins FROM segments",
    "overlap_by_speaker": _with("overlap") + "SELECT source_id, seq, speaker, overlap_ms FROM overlap",
    "interval_align": _with("dominant") + "SELECT source_id, seq, speaker FROM dominant",
    "carry_forward": _with("labelled") + "SELECT source_id, seq, speaker FROM labelled",
    "align_unknown": _with("segments") + "SELECT source_id, seq, 'UNKNOWN' AS speaker FROM segments",
    "turns": _with("turns") + f"SELECT source_id, turn_index, speaker, {_S('start_ms')} AS start_s, {_S('end_ms')} AS end_s, text, n_segments FROM turns",
    "speaker_stats": _with("stats") + f"SELECT source_id, speaker, {_S('total_ms')} AS total_speech_s, turn_count, word_count, place FROM stats",
    "speech_share": _with("stats") + "SELECT source_id, speaker, total_ms * 100.0::DOUBLE / CASE WHEN sum(total_ms) OVER w = 0 THEN 1000 ELSE (sum(total_ms) OVER w)::BIGINT END AS share_pct FROM stats WINDOW w AS (PARTITION BY source_id)",
    "speech_totals": _with("speech") + f"SELECT source_id, speaker, {_S('total_ms')} AS total_s FROM speech",
    "speakers_found": _with("diar") + "SELECT source_id, string_agg(DISTINCT speaker, ',' ORDER BY speaker) AS speakers FROM diar GROUP BY source_id",
    "diar_sorted": _with("diar") + "SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY start_ms, dseq) - 1 AS place, speaker, start_ms, end_ms FROM diar",
    "role_map": _with("ranked") + f"SELECT source_id, speaker, {_ROLE.format('INTERVIEWER', 'INTERVIEWEE')} FROM ranked",
    "role_map_flipped": _with("ranked") + f"SELECT source_id, speaker, {_ROLE.format('INTERVIEWEE', 'INTERVIEWER')} FROM ranked",
    "role_filter": _with("ranked", "turns") + f"SELECT source_id, turn_index, speaker, role FROM turns JOIN (SELECT source_id, speaker, {_ROLE.format('INTERVIEWER', 'INTERVIEWEE')} FROM ranked) USING (source_id, speaker) WHERE role = 'INTERVIEWEE'",
    "role_filter_interviewer": _with("ranked", "turns") + f"SELECT source_id, turn_index, speaker, role FROM turns JOIN (SELECT source_id, speaker, {_ROLE.format('INTERVIEWER', 'INTERVIEWEE')} FROM ranked) USING (source_id, speaker) WHERE role = 'INTERVIEWER'",
    "align_full": _with("ranked", "turns") + f"SELECT source_id, turn_index, coalesce(role, speaker) AS speaker, {_S('start_ms')} AS start_s, {_S('end_ms')} AS end_s, text, n_segments FROM turns LEFT JOIN (SELECT source_id, speaker, {_ROLE.format('INTERVIEWER', 'INTERVIEWEE')} FROM ranked) USING (source_id, speaker)",
    "avg_confidence": _with("segments") + f"SELECT source_id, {_MEAN} AS avg_confidence FROM segments GROUP BY source_id",
    "full_text": _with("segments") + f"SELECT source_id, string_agg({_STRIP}, ' ' ORDER BY seq) AS body FROM segments GROUP BY source_id",
    "labelled_text": _with("turns") + "SELECT source_id, string_agg('[' || speaker || '] ' || text, chr(10) || chr(10) ORDER BY turn_index) AS body FROM turns GROUP BY source_id",
    "preview_turns": _with("turns") + "SELECT source_id, turn_index, '[' || speaker || '] ' || printf('%d:%02d', trunc(start_ms / 1000.0::DOUBLE)::BIGINT // 60, trunc(start_ms / 1000.0::DOUBLE)::BIGINT % 60) || ' ' || CASE WHEN length(text) > 120 THEN text[1:120] || '…' ELSE text END AS line, greatest(0, n - 5) AS more_turns FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM turns) WHERE turn_index < 5",
    "render_txt": _with("segments") + f"SELECT source_id, string_agg({_STRIP}, ' ' ORDER BY seq) AS body FROM segments GROUP BY source_id",
    "render_srt": _with("segments") + f"SELECT source_id, string_agg((seq + 1) || chr(10) || {_SRT(_S('start_ms'))} || ' --> ' || {_SRT(_S('end_ms'))} || chr(10) || {_STRIP} || chr(10), chr(10) ORDER BY seq) AS body FROM segments GROUP BY source_id",
    "render_json": _with("segments", "results") + f"SELECT source_id, to_json({{'language': language, 'duration': round({_S('duration_ms')}, 3), 'average_confidence': mean, 'source': source, 'segments': segs}})::VARCHAR AS body FROM results JOIN (SELECT source_id, {_MEAN} AS mean, list({{'start': round({_S('start_ms')}, 3), 'end': round({_S('end_ms')}, 3), 'text': {_STRIP}, 'confidence': confidence}} ORDER BY seq) AS segs FROM segments GROUP BY source_id) USING (source_id)",
    "render_turn_txt": _with("turns", "stats", "results") + f"SELECT r.source_id, repeat('═', 56) || chr(10) || 'Interview transcript' || chr(10) || printf('Duration : %.1f min  |  Language: %s', duration_ms / 60000.0::DOUBLE, language) || chr(10) || 'Speakers : ' || who || chr(10) || coalesce('Source   : ' || string_split(source, '/')[-1] || chr(10), '') || repeat('═', 56) || chr(10) || chr(10) || blocks AS body FROM results r JOIN (SELECT source_id, string_agg(speaker || ' (' || turn_count || ' turns, ~' || word_count || ' words)', ' · ' ORDER BY place) AS who FROM stats GROUP BY source_id) USING (source_id) JOIN (SELECT source_id, string_agg('[' || speaker || '] ' || {_HMS(_S('start_ms'))} || chr(10) || text || chr(10), chr(10) ORDER BY turn_index) AS blocks FROM turns GROUP BY source_id) USING (source_id)",
    "render_turn_json": _with("turns", "stats", "results", "segments") + r"SELECT r.source_id, len(ts) AS n_turns, to_json(ts)::VARCHAR AS turns, who AS speakers, round(duration_ms / 1000.0::DOUBLE, 3) AS duration_s, mean AS avg_confidence FROM results r JOIN (SELECT source_id, list({'turn_index': turn_index, 'speaker': speaker, 'start': round(start_ms / 1000.0::DOUBLE, 3), 'end': round(end_ms / 1000.0::DOUBLE, 3), 'duration': round((end_ms - start_ms) / 1000.0::DOUBLE, 3), 'word_count': len(regexp_extract_all(text, '\S+')), 'text': text, 'segments': segs} ORDER BY turn_index) AS ts FROM turns GROUP BY source_id) USING (source_id) JOIN (SELECT source_id, string_agg(speaker || ':' || turn_count || ':' || word_count, ',' ORDER BY place) AS who FROM stats GROUP BY source_id) USING (source_id) JOIN (SELECT source_id, " + _MEAN + " AS mean FROM segments GROUP BY source_id) USING (source_id)",
    "json_roundtrip": _with("segments") + "SELECT source_id, seq, start_ms, end_ms, text, confidence FROM segments",
    "silence_rows": _with("moments") + "SELECT source_id, min(at_ms) AS start_ms, max(at_ms) AS end_ms, count(*) AS n_rows FROM (SELECT *, sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER (PARTITION BY source_id ORDER BY at_ms, event_id ROWS UNBOUNDED PRECEDING) AS island FROM moments) WHERE value < 20 GROUP BY source_id, island HAVING count(*) >= 3",
    "cut_points": _with("cuts") + "SELECT source_id, cut_index, cut AS cut_ms FROM cuts",
    "chunk_boundaries": _with("cuts", "ends") + "SELECT source_id, idx, a AS start_ms, b AS end_ms, a - greatest(0, a - 200) AS overlap_start_ms, least(total_ms, b + 200) - b AS overlap_end_ms FROM (SELECT source_id, total_ms, a, lead(a) OVER w AS b, row_number() OVER w - 1 AS idx FROM (SELECT source_id, total_ms, cut AS a, cut_index AS o FROM cuts UNION ALL SELECT source_id, total_ms, 0, -1 FROM ends UNION ALL SELECT source_id, total_ms, total_ms, 1000000 FROM ends) WINDOW w AS (PARTITION BY source_id ORDER BY o)) WHERE b IS NOT NULL",
    "shift_timestamps": _with("heard") + "SELECT source_id, idx, seq, start_ms, end_ms FROM heard",
    "overlap_drop": _with("kept") + "SELECT source_id, idx, seq, start_ms, end_ms FROM kept",
    "reassemble": _with("kept") + "SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY idx, seq) - 1 AS seq, idx, start_ms, end_ms, text FROM kept",
    "tail_head_words": _with("heard") + r"SELECT source_id, idx, lower(array_to_string(w[1:30], ' ')) AS head, lower(array_to_string(w[greatest(1, len(w) - 29):], ' ')) AS tail FROM (SELECT source_id, idx, flatten(list(regexp_extract_all(text, '\S+') ORDER BY seq)) AS w FROM heard GROUP BY source_id, idx)",
    "accumulated_tails": _with("kept") + r"SELECT source_id, idx, lower(array_to_string(w[greatest(1, len(w) - 29):], ' ')) AS tail FROM (SELECT source_id, idx, flatten(list(w) OVER (PARTITION BY source_id ORDER BY idx ROWS UNBOUNDED PRECEDING)) AS w FROM (SELECT source_id, idx, flatten(list(regexp_extract_all(text, '\S+') ORDER BY seq)) AS w FROM kept GROUP BY source_id, idx) WHERE len(w) > 0)",
    "resume_pending": _with("pieces", "done") + "SELECT source_id, idx FROM pieces ANTI JOIN done USING (source_id, idx)",
    "resume_guard": _with("pieces") + "SELECT source_id, n AS total_chunks FROM (SELECT source_id, count(*) AS n FROM pieces GROUP BY source_id) WHERE source_id % 5 <> 0 AND source_id % 7 <> 0 AND source_id % 11 <> 0",
    "checkpoint_documents": _with("heard") + "SELECT source_id, idx, CASE WHEN idx % 4 = 1 THEN 'es' ELSE 'en' END AS language, CASE WHEN idx % 4 = 2 THEN 0.0::DOUBLE ELSE 20.0::DOUBLE END AS duration, count(*) AS n_segments, sum(start_ms - chunk_start_ms)::BIGINT AS starts_ms, string_agg(text, chr(10) ORDER BY seq) AS text FROM heard WHERE source_id % 5 <> 0 AND source_id % 7 <> 0 GROUP BY source_id, idx",
    "latest_checkpoints": _with("heard") + "SELECT source_id, idx, source_id * 1000 + CASE WHEN (source_id + idx) % 3 = 0 THEN 3 WHEN (source_id + idx) % 2 = 0 THEN 2 ELSE 1 END AS source_size_bytes, count(*) AS n_segments FROM heard GROUP BY source_id, idx",
    "stage_guard": _with("segments") + "SELECT source_id, count(*) AS n_segments, string_agg(text, chr(10) ORDER BY seq) AS text FROM segments WHERE source_id % 5 <> 0 AND source_id % 7 <> 0 GROUP BY source_id",
    "ordered_results": _with("pieces", "heard") + "SELECT p.source_id, p.idx, count(h.seq) AS n_segments FROM pieces p LEFT JOIN heard h USING (source_id, idx) GROUP BY ALL HAVING count(h.seq) > 0",
    "progress": _with("pieces", "done") + "SELECT source_id, n_done, n_total, n_done || '/' || n_total || ' (' || n_done * 100 // greatest(n_total, 1) || '%)' AS label FROM (SELECT p.source_id, count(d.idx) AS n_done, count(*) AS n_total FROM pieces p LEFT JOIN done d USING (source_id, idx) GROUP BY p.source_id)",
    "skip_existing": _with("outputs") + "SELECT DISTINCT conv_id AS stem FROM conversations WHERE conv_id NOT IN (SELECT stem FROM outputs WHERE ext IN ('.txt', '.srt') GROUP BY stem HAVING count(DISTINCT ext) = 2)",
    "batch_prefix": _with("batch") + "SELECT batch, event_id FROM (SELECT *, min(CASE WHEN status = 'HALT' THEN event_id END) OVER (PARTITION BY batch) AS halt FROM batch) WHERE (halt IS NULL OR event_id < halt) AND status <> 'FAILED'",
    "batch_summary": _with("batch") + "SELECT batch, count(*) AS n, count(*) FILTER (WHERE status = 'OK') AS n_ok, count(*) FILTER (WHERE status = 'FAILED') AS n_failed FROM batch GROUP BY batch",
    "scan_paths": r"SELECT url AS path, row_number() OVER (ORDER BY url) AS place FROM pages WHERE lower(url) LIKE '%.html'",
    "rename_plan": r"SELECT url AS old_name, 'song_n_' || row_number() OVER (ORDER BY url) || '.html' AS new_name FROM pages WHERE url LIKE '%.html'",
    "fuzzy_name_lookup": _NAMES + f"SELECT replace(url, '/', '_') AS asked, name FROM pages JOIN keyed ON {_KEY.format(chr(114) + 'eplace(url, chr(47), chr(95))')} = k WHERE n = 1 AND k <> ''",
    "turn_lines": _with("turns") + f"SELECT source_id, turn_index, '[' || speaker || '] ' || printf('%.1f', {_S('start_ms')}) || 's–' || printf('%.1f', {_S('end_ms')}) || 's: ' || text[1:80] AS line FROM turns",
    "chunk_names": _with("pieces") + "SELECT source_id, idx, source_id || '_chunk' || CASE WHEN idx < 1000 THEN lpad(idx::VARCHAR, 3, '0') ELSE idx::VARCHAR END || '.wav' AS name FROM pieces",
    "completed_ids": _with("done") + "SELECT source_id, string_agg(idx::VARCHAR, ',' ORDER BY idx) AS idxs FROM done GROUP BY source_id",
    "chunk_headers": _with("pieces", "done") + "SELECT source_id, coalesce(first, 'es') AS language, duration_ms, source_id::VARCHAR AS source FROM (SELECT source_id, max(end_ms)::BIGINT AS duration_ms FROM pieces GROUP BY source_id) LEFT JOIN (SELECT source_id, arg_min(CASE WHEN idx % 2 = 0 THEN 'en' ELSE 'fr' END, idx) AS first FROM done GROUP BY source_id) USING (source_id)",
    "turns_by_table_function": _with("turns") + "SELECT source_id, turn_index, speaker, start_ms, end_ms, text, n_segments FROM turns",
    "orphaned_results": _with("heard") + "SELECT source_id, idx, count(*) AS n_segments FROM heard WHERE (source_id + idx) % 5 = 0 GROUP BY source_id, idx",
    "chunk_edges": _with("kept") + r"SELECT source_id, idx, n_rows, n_left, lower(array_to_string(w[1:30], ' ')) AS head, lower(array_to_string(w[greatest(1, len(w) - 29):], ' ')) AS whole, lower(array_to_string(c[greatest(1, len(c) - 29):], ' ')) AS cut, n_left > 0 AND n_left < n_rows AS cuts FROM (SELECT *, CASE WHEN n_left > 0 THEN l ELSE w END AS c FROM (SELECT source_id, idx, count(*) AS n_rows, (count(*) FILTER (start_ms >= chunk_start_ms + overlap_start_ms))::BIGINT AS n_left, flatten(list(regexp_extract_all(text, '\S+') ORDER BY seq)) AS w, coalesce(flatten(list(regexp_extract_all(text, '\S+') ORDER BY seq) FILTER (start_ms >= chunk_start_ms + overlap_start_ms)), []) AS l FROM kept GROUP BY source_id, idx))",
    "real_time_factor": _with("pieces") + f"SELECT source_id, idx, CASE WHEN idx % 4 > 0 THEN {_S('(end_ms - start_ms)')} / (idx % 4)::DOUBLE ELSE 0.0::DOUBLE END AS factor FROM pieces",
}
