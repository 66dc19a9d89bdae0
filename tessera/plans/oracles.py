"""The queries' results in plain SQL for DuckDB, worked out apart from the DataFrame forms."""

from __future__ import annotations

from tessera.plans.fixtures import duckdb_sql


def _resize(h: str, w: str, low: str, high: str) -> dict[str, str]:
    """SQL for the resize rule's height, width and error."""
    def near(x):
        return f"greatest(28, CAST(round_even(({x}) / 28.0, 0) * 28 AS BIGINT))"

    h0, w0 = near(h), near(w)
    area = f"({h0}) * ({w0})"

    def side(x, x0):
        down = f"CAST(floor(({x}) / sqrt(CAST({h} AS DOUBLE) * ({w}) / CAST({high} AS DOUBLE)) / 28.0) * 28 AS BIGINT)"
        up = f"CAST(ceil(({x}) * sqrt(CAST({low} AS DOUBLE) / (CAST({h} AS DOUBLE) * ({w}))) / 28.0) * 28 AS BIGINT)"
        return f"CASE WHEN {area} > {high} THEN {down} WHEN {area} < {low} THEN {up} ELSE {x0} END"

    bad = f"(least({h}, {w}) <= 0 OR greatest({h}, {w}) > 200 * least({h}, {w}))"
    hh, ww = side(h, h0), side(w, w0)
    return {"h": f"CASE WHEN NOT {bad} THEN {hh} END", "w": f"CASE WHEN NOT {bad} THEN {ww} END", "error": f"CASE WHEN {bad} THEN 'ratio' WHEN ({hh}) = 0 OR ({ww}) = 0 THEN 'zero_side' END"}


def _count(fps: str, nframes: str, max_frames: str) -> tuple[str, str]:
    """SQL for a video's frame count (before errors) and its error."""
    bound = f"least(least(greatest(total_frames / video_fps * coalesce({fps}, 2.0), 2.0), floor(coalesce({max_frames}, least(768, total_frames)) / 2.0) * 2), total_frames)"
    n = f"CASE WHEN {nframes} IS NOT NULL THEN CAST(round_even({nframes} / 2.0, 0) * 2 AS BIGINT) ELSE CAST(floor({bound} / 2.0) * 2 AS BIGINT) END"
    return n, f"CASE WHEN {fps} IS NOT NULL AND {nframes} IS NOT NULL THEN 'fps_and_nframes' WHEN ({n}) < 2 OR ({n}) > total_frames THEN 'nframes_range' END"


_EL = """el0 AS (SELECT conv_id, turn, from_json(content, '["JSON"]') AS l FROM messages WHERE starts_with(content, '[')),
el AS (SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS elem_pos, l[i] AS e FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM el0) x),
parts AS (SELECT conv_id, turn, elem_pos, e, json_keys(e) AS k, e->>'type' AS type, e->>'text' AS txt, e->>'image' AS image, e->>'image_url' AS image_url, CASE WHEN json_type(e->'video') <> 'ARRAY' THEN e->>'video' END AS video, CASE WHEN json_type(e->'video') = 'ARRAY' THEN from_json(e->'video', '["VARCHAR"]') END AS frames, e->>'audio' AS audio,
    CAST(e->>'resized_height' AS BIGINT) AS rh, CAST(e->>'resized_width' AS BIGINT) AS rw, CAST(e->>'min_pixels' AS BIGINT) AS lo, CAST(e->>'max_pixels' AS BIGINT) AS hi, CAST(e->>'fps' AS DOUBLE) AS fps FROM el)"""
_VIS = f"""{_EL},
vis0 AS (SELECT *, CASE WHEN list_contains(k, 'image') OR list_contains(k, 'image_url') THEN 'image' WHEN list_contains(k, 'video') THEN 'video' END AS modality FROM parts
    WHERE list_contains(k, 'image') OR list_contains(k, 'image_url') OR list_contains(k, 'video') OR type IN ('image', 'image_url', 'video')),
vis1 AS (SELECT *, CASE modality WHEN 'image' THEN CASE WHEN list_contains(k, 'image') THEN image ELSE image_url END WHEN 'video' THEN video END AS uri FROM vis0),
vis AS (SELECT *, CASE WHEN modality IS NULL THEN 'no_media_key' WHEN modality = 'image' AND starts_with(uri, 'data:image') AND NOT contains(uri, 'base64,') THEN 'image_unrecognised' END AS error,
    TRY_CAST(regexp_extract(uri, '([0-9]+)\\.[a-z0-9]+$', 1) AS BIGINT) AS media_id FROM vis1)"""
_GIVEN = "(rh IS NOT NULL AND rw IS NOT NULL)"
_H, _W = f"(CASE WHEN {_GIVEN} THEN rh ELSE m.height END)", f"(CASE WHEN {_GIVEN} THEN rw ELSE m.width END)"
_IMG = _resize(_H, _W, f"(CASE WHEN {_GIVEN} THEN 50176 ELSE coalesce(lo, 50176) END)", f"(CASE WHEN {_GIVEN} THEN 1254400 ELSE coalesce(hi, 1254400) END)")
_LIST = _resize(_H, _W, f"(CASE WHEN {_GIVEN} THEN 50176 ELSE coalesce(lo, 12544) END)", f"(CASE WHEN {_GIVEN} THEN 1254400 ELSE coalesce(hi, 100352) END)")
_N, _NERR = _count("fps", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
_VID = _resize("height", "width", "12544", "budget")
_BUDGET = "least(coalesce(mp, greatest(least(100352.0, 90316800.0 / n * 2), 13171.0)), greatest(least(100352.0, 90316800.0 / n * 2), 13171.0))"
_ATOK = "CAST(floor((floor((mel_len - 1) / 2.0) - 1) / 2.0) + 1 AS BIGINT)"
_FRAMES = f"""lf0 AS (SELECT conv_id, turn, elem_pos, rh, rw, lo, hi, frames, unnest(range(1, len(frames) + 1)) AS i FROM vis WHERE modality = 'video' AND frames IS NOT NULL),
lf1 AS (SELECT conv_id, turn, elem_pos, i, TRY_CAST(regexp_extract(frames[i], '([0-9]+)\\.[a-z0-9]+$', 1) AS BIGINT) AS image_id, rh, rw, lo, hi FROM lf0),
lf AS (SELECT lf1.*, m.height, m.width, {_LIST['h']} AS h, {_LIST['w']} AS w, {_LIST['error']} AS error FROM lf1 LEFT JOIN image_meta m ON m.image_id = lf1.image_id),
lists_ AS (SELECT conv_id, turn, elem_pos, CAST(ceil(count(*) / 2.0) * 2 AS BIGINT) AS n, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY i) || CASE WHEN count(*) % 2 = 1 THEN ',' || CAST(arg_max(image_id, i) AS VARCHAR) ELSE '' END AS shown, first(h ORDER BY i) AS h, first(w ORDER BY i) AS w, first(height ORDER BY i) AS height, first(width ORDER BY i) AS width,
    coalesce((list(error ORDER BY i) FILTER (WHERE error IS NOT NULL))[1], CASE WHEN count(DISTINCT (coalesce(h, -1), coalesce(w, -1))) > 1 THEN 'frame_sizes_differ' END) AS error FROM lf GROUP BY ALL
    UNION ALL SELECT conv_id, turn, elem_pos, 0, '', NULL, NULL, NULL, NULL, 'frame_sizes_differ' FROM vis WHERE modality = 'video' AND len(frames) = 0)"""
_PLANNED = f"""{_VIS}, {_FRAMES},
imgs AS (SELECT vis.conv_id, vis.turn, vis.elem_pos, m.height, m.width, {_IMG['h']} AS h, {_IMG['w']} AS w, coalesce(vis.error, CASE WHEN m.image_id IS NULL THEN 'not_in_catalog' END, {_IMG['error']}) AS error FROM vis LEFT JOIN image_meta m ON media_id = image_id WHERE modality = 'image'),
vids0 AS (SELECT conv_id, turn, elem_pos, v.height, v.width, v.total_frames, v.video_fps, vis.fps, CAST(NULL AS DOUBLE) AS mp FROM vis LEFT JOIN video_meta v ON media_id = video_id WHERE modality = 'video' AND frames IS NULL),
vids1 AS (SELECT *, {_NERR} AS nerr, CASE WHEN ({_NERR}) IS NULL THEN {_N} END AS n FROM vids0),
vids2 AS (SELECT *, {_BUDGET} AS budget FROM vids1),
vids AS (SELECT *, CASE WHEN n IS NOT NULL THEN {_VID['h']} END AS h, CASE WHEN n IS NOT NULL THEN {_VID['w']} END AS w, coalesce(CASE WHEN total_frames IS NULL THEN 'not_in_catalog' END, nerr, {_VID['error']}) AS error FROM vids2),
auds AS (SELECT p.conv_id, p.turn, p.elem_pos, mel_len, CASE WHEN NOT list_contains(k, 'audio') THEN 'audio_unknown' WHEN m.audio_id IS NULL THEN 'not_in_catalog' WHEN channels > 1 THEN 'audio_not_mono' END AS error FROM parts p LEFT JOIN audio_meta m ON TRY_CAST(regexp_extract(audio, '([0-9]+)\\.[a-z0-9]+$', 1) AS BIGINT) = audio_id WHERE type = 'audio'),
pe0 AS (SELECT conv_id, turn, elem_pos, 'text' AS role, 'text' AS modality, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS sample_fps, CAST(NULL AS BIGINT) AS h, CAST(NULL AS BIGINT) AS w, CAST(NULL AS BIGINT) AS height, CAST(NULL AS BIGINT) AS width, CAST(ceil(length(txt) / 4.0) AS BIGINT) AS tokens, CAST(NULL AS VARCHAR) AS error FROM parts WHERE type = 'text'
    UNION ALL SELECT conv_id, turn, 0, 'text', 'text', NULL, NULL, NULL, NULL, NULL, NULL, CAST(ceil(length(content) / 4.0) AS BIGINT), NULL FROM messages WHERE NOT starts_with(content, '[')
    UNION ALL SELECT conv_id, turn, elem_pos, 'vision', 'image', NULL, NULL, h, w, height, width, CAST(floor(1 * floor(h / 14.0) * floor(w / 14.0) / 4.0) AS BIGINT), error FROM imgs
    UNION ALL SELECT conv_id, turn, elem_pos, 'vision', 'video', n, n / greatest(CAST(total_frames AS DOUBLE), 1e-6) * video_fps, h, w, height, width, CAST(floor(ceil(n / 2.0) * floor(h / 14.0) * floor(w / 14.0) / 4.0) AS BIGINT), error FROM vids
    UNION ALL SELECT conv_id, turn, elem_pos, 'vision', 'video', n, 2.0, h, w, height, width, CAST(floor(ceil(n / 2.0) * floor(h / 14.0) * floor(w / 14.0) / 4.0) AS BIGINT), error FROM lists_
    UNION ALL SELECT conv_id, turn, elem_pos, 'vision', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM vis WHERE modality IS NULL
    UNION ALL SELECT conv_id, turn, elem_pos, 'audio', 'audio', NULL, NULL, NULL, NULL, NULL, NULL, {_ATOK}, error FROM auds
    UNION ALL SELECT conv_id, turn, elem_pos, 'track', 'audio', NULL, NULL, NULL, NULL, v.height, v.width, NULL, CASE WHEN NOT list_contains(k, 'video') THEN 'video_unknown' WHEN NOT coalesce(v.has_audio, false) THEN 'no_audio_track' END FROM parts LEFT JOIN video_meta v ON TRY_CAST(regexp_extract(video, '([0-9]+)\\.[a-z0-9]+$', 1) AS BIGINT) = v.video_id WHERE type = 'video'),
pe AS (SELECT * REPLACE (CASE WHEN error IS NULL THEN tokens END AS tokens) FROM pe0)"""
_AUD = """aref AS (SELECT conv_id, turn, elem_pos, type AS source, CASE WHEN type = 'audio' THEN audio ELSE video END AS uri, k FROM parts WHERE type IN ('audio', 'video')),
arefs AS (SELECT a.*, CASE WHEN source = 'audio' AND NOT list_contains(k, 'audio') THEN 'audio_unknown' WHEN source = 'video' AND NOT list_contains(k, 'video') THEN 'video_unknown' WHEN source = 'video' AND NOT coalesce(v.has_audio, false) THEN 'no_audio_track' END AS error
    FROM aref a LEFT JOIN video_meta v ON a.uri = 'file:///v/' || CAST(v.video_id AS VARCHAR) || '.mp4')"""
_N2, _N2ERR = _count("fps", "nframes", "max_frames")
_VM = f"""vm0 AS (SELECT *, max_pixels AS mp, {_N2ERR} AS nerr, CASE WHEN ({_N2ERR}) IS NULL THEN {_N2} END AS n FROM video_meta),
vm1 AS (SELECT *, {_BUDGET} AS budget FROM vm0),
vm AS (SELECT *, CASE WHEN n IS NOT NULL THEN {_VID['h']} END AS h, CASE WHEN n IS NOT NULL THEN {_VID['w']} END AS w, coalesce(nerr, {_VID['error']}) AS error FROM vm1)"""
_IM = _resize("height", "width", "50176", "1254400")
_FR = _resize("m.height", "m.width", "12544", "100352")
_ALEN = "CAST(floor((mel_len - 1) / 2.0) + 1 AS BIGINT)"
_CHUNKS = "ch AS (SELECT audio_id, c AS chunk, least(200, mel_len - c * 200) AS len FROM audio_meta CROSS JOIN LATERAL unnest(range(0, CAST(ceil(mel_len / 200.0) AS BIGINT))) AS u(c))"
_GRIDS = "gr AS (SELECT sample_id * 1000 + seg_no AS media_id, grid_t, grid_h, grid_w FROM segments WHERE kind IN ('image', 'video'))"
_TILES = """cells AS (SELECT media_id, c AS cell, c // ((grid_h // 2) * (grid_w // 2)) AS t, (c % ((grid_h // 2) * (grid_w // 2))) // (grid_w // 2) AS y, c % (grid_w // 2) AS x FROM gr CROSS JOIN LATERAL unnest(range(0, grid_t * (grid_h // 2) * (grid_w // 2))) AS u(c)),
placed AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY t, y // 4, x // 4, y, x) - 1 AS idx FROM cells),
tiles AS (SELECT media_id, t, y // 4 AS ty, x // 4 AS tx, min(idx) AS first, count(*) AS n FROM placed GROUP BY ALL)"""
_STARTS = """sp AS (SELECT *, CASE WHEN kind IN ('image', 'video') THEN greatest(CAST(trunc((grid_t - 1) * sec * 25) AS BIGINT), grid_h // 2 - 1, grid_w // 2 - 1) + 1 ELSE len END AS span FROM segments),
st AS (SELECT a.*, CAST(coalesce((SELECT sum(b.span) FROM sp b WHERE b.sample_id = a.sample_id AND b.seg_no < a.seg_no), 0) AS BIGINT) AS start, CAST(coalesce((SELECT sum(b.len) FROM sp b WHERE b.sample_id = a.sample_id AND b.seg_no < a.seg_no), 0) AS BIGINT) AS off FROM sp a)"""


def _cuts(source: str, name: str, width: int) -> str:
    """Chunks by stepping row by row: at most one cut before a row."""
    return f"""{name} AS (SELECT item, i, t, t AS t0, CAST(0 AS BIGINT) AS chunk FROM {source} WHERE i = 0
    UNION ALL SELECT s.item, s.i, s.t, p.t0, p.chunk + CASE WHEN s.t - p.t0 >= (p.chunk + 1) * {width} THEN 1 ELSE 0 END FROM {name} p JOIN {source} s ON s.item = p.item AND s.i = p.i + 1)"""


_IDS = "il AS (SELECT item, list(code ORDER BY pos) AS ids FROM codes GROUP BY item)"
_VEC = "ev AS (SELECT vec_id, CAST(i - 1 AS BIGINT) AS dim, CAST(embedding[i] AS DOUBLE) * 10 AS x FROM embeddings CROSS JOIN LATERAL unnest(range(1, len(embedding) + 1)) AS u(i))"
_FEAT = "fl AS (SELECT item, pos, vec_id, CAST(i - 1 AS BIGINT) AS dim, CAST(vec[i] AS DOUBLE) AS x, CAST(vec[1] AS DOUBLE) AS s FROM features CROSS JOIN LATERAL unnest(range(1, len(vec) + 1)) AS u(i))"

_COUNTS = """mk AS (SELECT sample_id, pos, CASE WHEN token_id = 90001 AND lead(token_id) OVER (PARTITION BY sample_id ORDER BY pos) = 90005 THEN 90006 ELSE token_id END AS token_id FROM tokens),
mb AS (SELECT a.sample_id, a.token_id, coalesce(p.token_id, l.token_id) AS before FROM mk a LEFT JOIN mk p ON p.sample_id = a.sample_id AND p.pos = a.pos - 1 JOIN (SELECT sample_id, arg_max(token_id, pos) AS token_id FROM mk GROUP BY sample_id) l ON l.sample_id = a.sample_id),
mc AS (SELECT sample_id, count(*) FILTER (WHERE token_id = 90006) AS audios, count(*) FILTER (WHERE token_id = 90001) AS starts, count(*) FILTER (WHERE token_id = 90003) AS ai, count(*) FILTER (WHERE token_id = 90004) AS av, count(*) FILTER (WHERE before = 90001 AND token_id = 90003) AS i, count(*) FILTER (WHERE before = 90001 AND token_id = 90004) AS v FROM mb GROUP BY sample_id),
mcount AS (SELECT sample_id, CASE WHEN audios = 0 THEN i WHEN ai > 0 THEN starts ELSE 0 END AS images, CASE WHEN audios = 0 THEN v WHEN av > 0 THEN starts ELSE 0 END AS videos, audios, CASE WHEN audios > 0 AND ((ai > 0 AND av > 0) OR starts <> 1) THEN 'vision_mix' END AS error FROM mc)"""
_LISTS = f"""fr AS (SELECT video_id, frame_no, f.image_id, {_FR['h']} AS h, {_FR['w']} AS w, {_FR['error']} AS error FROM frame_lists f LEFT JOIN image_meta m ON f.image_id = m.image_id),
lists AS (SELECT coalesce((list(error ORDER BY frame_no) FILTER (WHERE error IS NOT NULL))[1], CASE WHEN count(DISTINCT (coalesce(h, -1), coalesce(w, -1))) > 1 THEN 'frame_sizes_differ' END) AS error FROM fr GROUP BY video_id)"""
def _walk(ids: str, audios: str, paired: bool) -> str:
    """SQL for positions by a reader that steps from medium to medium, and for what each of its steps covers."""
    audio = "WHEN q.kind = 'audio' THEN au.heard"
    both, of_q = f"kind = 'video' AND {str(paired).lower()}", f"q.kind = 'video' AND {str(paired).lower()}"
    return f"""u AS (SELECT sample_id, pos, token_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS i FROM {ids} WHERE mask = 1),
    nx AS (SELECT sample_id, i, min(CASE token_id WHEN 90003 THEN i END) OVER w AS ni, min(CASE token_id WHEN 90004 THEN i END) OVER w AS nv, min(CASE token_id WHEN 90005 THEN i END) OVER w AS na FROM u WINDOW w AS (PARTITION BY sample_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    gr AS (SELECT sample_id, modality AS kind, k, grid_t AS gt, grid_h // 2 AS gh, grid_w // 2 AS gw, CAST(CASE modality WHEN 'image' THEN 1 ELSE sec END AS FLOAT) AS sec FROM id_grids),
    au AS (SELECT sample_id, k, CAST(floor((floor((mel_len - 1) / 2.0) - 1) / 2.0) + 1 AS BIGINT) AS heard FROM {audios}),
    pair AS (SELECT g.sample_id * 1000 + g.k AS item, g.*, au.heard FROM gr g JOIN (SELECT v.sample_id, row_number() OVER (PARTITION BY v.sample_id ORDER BY v.i) - 1 AS k, (SELECT count(*) FROM u a WHERE a.sample_id = v.sample_id AND a.i < v.i AND a.token_id = 90006) - 1 AS ak FROM u v JOIN u p ON p.sample_id = v.sample_id AND p.i = v.i - 1 WHERE v.token_id = 90004 AND p.token_id <> 90004) x
        ON x.sample_id = g.sample_id AND x.k = g.k JOIN au ON au.sample_id = x.sample_id AND au.k = x.ak WHERE g.kind = 'video' AND {str(paired).lower()}),
    pv AS (SELECT item, c AS i, CAST(trunc(CAST(c // (gh * gw) AS FLOAT) * sec * CAST(25 AS FLOAT)) AS BIGINT) AS t, (c % (gh * gw)) // gw AS h, c % gw AS w FROM pair CROSS JOIN LATERAL unnest(range(0, gt * gh * gw)) AS q(c)),
    pa AS (SELECT item, c AS i, c AS t, c AS h, c AS w FROM pair CROSS JOIN LATERAL unnest(range(0, heard)) AS q(c)),
    {_cuts('pv', 'pvw', 50)}, {_cuts('pa', 'paw', 50)},
    pm AS (SELECT item, chunk, 0 AS r, i, t, h, w FROM pvw JOIN pv USING (item, i, t) UNION ALL SELECT item, chunk, 1, i, t, h, w FROM paw JOIN pa USING (item, i, t)),
    po AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY chunk, r, i) - 1 AS o FROM pm),
    pf AS (SELECT item, max(greatest(t, h, w)) AS top, max_by(top_of_part, chunk * 2 + r) + 1 AS step, count(*) AS m FROM (SELECT *, max(greatest(t, h, w)) OVER (PARTITION BY item, chunk, r) AS top_of_part FROM po) z GROUP BY item),
    rd AS (SELECT sample_id, CAST(0 AS BIGINT) AS st0, CAST(0 AS BIGINT) AS start0, CAST(NULL AS VARCHAR) AS kind, CAST(-1 AS BIGINT) AS ed, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS base, CAST(0 AS BIGINT) AS reach, CAST(0 AS BIGINT) AS st, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS ii, CAST(0 AS BIGINT) AS vi, CAST(0 AS BIGINT) AS ai FROM (SELECT DISTINCT sample_id FROM u) b
        UNION ALL SELECT sample_id, st, start, kind, ed, m, base, base + span, ed + m + CASE WHEN {both} THEN 2 ELSE 1 END, base + step + 1, ii + CAST(kind = 'image' AS INT), vi + CAST(kind = 'video' AS INT), ai + CAST(kind = 'audio' OR ({both}) AS INT) FROM (
            SELECT q.*, CASE {audio} WHEN {of_q} THEN pf.m ELSE gr.gt * gr.gh * gr.gw END AS m, CASE {audio} WHEN {of_q} THEN pf.top + 1 ELSE greatest(CAST(trunc(CAST(gr.gt - 1 AS FLOAT) * gr.sec * CAST(25 AS FLOAT)) AS BIGINT), gr.gh - 1, gr.gw - 1) + 1 END AS span,
                CASE {audio} WHEN {of_q} THEN pf.step ELSE greatest(CAST(trunc(CAST(gr.gt - 1 AS FLOAT) * gr.sec * CAST(25 AS FLOAT)) AS BIGINT), gr.gh - 1, gr.gw - 1) + 1 END AS step, q.start + (q.ed - q.st) - CASE WHEN {of_q} THEN 1 ELSE 0 END AS base
            FROM (SELECT rd.sample_id, rd.st, rd.start, rd.ii, rd.vi, rd.ai, least(ni, nv, na) AS ed, CASE least(ni, nv, na) WHEN na THEN 'audio' WHEN ni THEN 'image' ELSE 'video' END AS kind FROM rd JOIN nx ON nx.sample_id = rd.sample_id AND nx.i = rd.st WHERE least(ni, nv, na) IS NOT NULL) q
            LEFT JOIN gr ON gr.sample_id = q.sample_id AND gr.kind = q.kind AND gr.k = CASE q.kind WHEN 'image' THEN ii ELSE vi END LEFT JOIN au ON au.sample_id = q.sample_id AND au.k = ai AND q.kind = 'audio' LEFT JOIN pf ON pf.item = q.sample_id * 1000 + vi) s)"""


def _stepped(ids: str, audios: str, paired: bool) -> str:
    """The query over :func:`_walk`: every row's place in the step that covers it."""
    both = f"s.kind = 'video' AND {str(paired).lower()}"
    cell = lambda x: f"s.base + CASE WHEN s.kind = 'audio' THEN u.i - s.ed WHEN {both} THEN po.{x[0]} ELSE {x[1]} END"
    axis = lambda x: f"CASE WHEN s.kind IS NULL THEN z.start + u.i - z.st WHEN u.i < s.ed THEN s.start0 + u.i - s.st0 - CASE WHEN {both} AND u.i = s.ed - 1 THEN 1 ELSE 0 END WHEN u.i < s.ed + s.m THEN {cell(x)} ELSE s.next - 1 END"
    t = axis(("t", "CAST(trunc(CAST((u.i - s.ed) // (gr.gh * gr.gw) AS FLOAT) * gr.sec * CAST(25 AS FLOAT)) AS BIGINT)"))
    h, w = axis(("h", "((u.i - s.ed) % (gr.gh * gr.gw)) // gr.gw")), axis(("w", "(u.i - s.ed) % gr.gw"))
    return f"""WITH RECURSIVE {_walk(ids, audios, paired)},
    s AS (SELECT sample_id, st0, start0, kind, ed, m, base, st, start AS next, CASE kind WHEN 'image' THEN ii ELSE vi END - 1 AS k, vi - 1 AS v FROM rd WHERE kind IS NOT NULL),
    z AS (SELECT sample_id, max(st) AS st, max_by(start, st) AS start FROM rd GROUP BY sample_id),
    bad AS (SELECT sample_id FROM (SELECT sample_id, count(*) AS n FROM u WHERE token_id = 90005 GROUP BY sample_id) a JOIN (SELECT sample_id, sum(heard) AS n FROM au GROUP BY sample_id) b USING (sample_id) WHERE a.n <> b.n),
    placed AS (SELECT u.sample_id, u.pos, {t} AS t, {h} AS h, {w} AS w FROM u JOIN z ON z.sample_id = u.sample_id LEFT JOIN s ON s.sample_id = u.sample_id AND u.i >= s.st0 AND u.i < s.st LEFT JOIN gr ON gr.sample_id = s.sample_id AND gr.kind = s.kind AND gr.k = s.k LEFT JOIN po ON po.item = s.sample_id * 1000 + s.v AND po.o = u.i - s.ed AND {both}),
    del AS (SELECT sample_id, max(greatest(t, h, w)) + 1 - count(*) AS delta FROM placed GROUP BY sample_id)
    SELECT a.sample_id, CAST(a.pos AS BIGINT) AS pos, CASE WHEN b.sample_id IS NOT NULL THEN NULL WHEN a.mask = 0 THEN 1 ELSE CAST(p.t AS BIGINT) END AS t, CASE WHEN b.sample_id IS NOT NULL THEN NULL WHEN a.mask = 0 THEN 1 ELSE CAST(p.h AS BIGINT) END AS h, CASE WHEN b.sample_id IS NOT NULL THEN NULL WHEN a.mask = 0 THEN 1 ELSE CAST(p.w AS BIGINT) END AS w,
        CASE WHEN b.sample_id IS NULL THEN CAST(delta AS BIGINT) END AS delta, CASE WHEN b.sample_id IS NOT NULL THEN 'grid_len_mismatch' END AS error
    FROM {ids} a LEFT JOIN placed p ON p.sample_id = a.sample_id AND p.pos = a.pos LEFT JOIN del ON del.sample_id = a.sample_id LEFT JOIN bad b ON b.sample_id = a.sample_id"""


_BODIES = {
    "positions_from_ids": _stepped("ids", "id_audios", False),
    "positions_audio_in_video": _stepped("av_ids", "av_audios", True),
    "conversations_assembled": "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, sha256(string_agg(content, '|' ORDER BY turn)) AS content_sha FROM messages GROUP BY conv_id",
    "inline_payload": f"WITH {_VIS} SELECT conv_id, turn, elem_pos, CASE WHEN contains(uri, 'base64,') THEN hex(from_base64(substr(uri, strpos(uri, 'base64,') + 7))) END AS payload, CASE WHEN NOT contains(uri, 'base64,') THEN modality || '_unrecognised' END AS error FROM vis WHERE starts_with(uri, 'data:')",
    "remote_payload": f"WITH {_VIS} SELECT conv_id, turn, elem_pos, uri, payload, CASE WHEN payload IS NULL THEN 'not_fetched' END AS error FROM vis LEFT JOIN remote ON uri = url WHERE starts_with(uri, 'http://') OR starts_with(uri, 'https://')",
    "content_elements": f"WITH {_EL} SELECT conv_id, turn, elem_pos, type, array_to_string(k, ',') AS keys FROM parts",
    "vision_elements": f"WITH {_VIS} SELECT conv_id, turn, elem_pos, type, uri FROM vis",
    "audio_elements": f"WITH {_EL} SELECT conv_id, turn, elem_pos, audio AS uri, CASE WHEN NOT list_contains(k, 'audio') THEN 'audio_unknown' END AS error FROM parts WHERE type = 'audio'",
    "audio_refs_with_video": f"WITH {_EL}, {_AUD} SELECT conv_id, turn, elem_pos, source, uri, error FROM arefs",
    "uri_scheme_counts": f"""WITH {_VIS} SELECT modality, CASE WHEN uri IS NULL THEN 'null' WHEN starts_with(uri, 'http://') THEN 'http' WHEN starts_with(uri, 'https://') THEN 'https' WHEN starts_with(uri, 'file://') THEN 'file' WHEN starts_with(uri, 'data:image') THEN 'data_image' ELSE 'path' END AS scheme, count(*) AS n FROM vis GROUP BY ALL""",
    "media_by_modality": f"WITH {_VIS} SELECT conv_id, turn, elem_pos, modality, error FROM vis",
    "masked_features": "SELECT item, CAST(pos AS BIGINT) AS pos, row_number() OVER (PARTITION BY item ORDER BY pos) - 1 AS k, vec_id, round(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM features WHERE vec_id % 11 <> 0",
    "right_padding_check": "SELECT sample_id, mask = 0 AS right_padded FROM tokens QUALIFY pos = max(pos) OVER (PARTITION BY sample_id)",
    "quarantine_counts": f"""WITH {_PLANNED}, {_LISTS}, {_COUNTS} SELECT error, count(*) AS n FROM (SELECT error FROM pe
        UNION ALL SELECT CASE WHEN mask = 0 THEN 'right_padding' END FROM (SELECT mask FROM tokens QUALIFY pos = max(pos) OVER (PARTITION BY sample_id)) p
        UNION ALL SELECT error FROM lists UNION ALL SELECT error FROM mcount
        UNION ALL SELECT 'audio_len_mismatch' FROM (SELECT sample_id, count(*) AS n FROM ids WHERE token_id = 90005 GROUP BY sample_id) a JOIN (SELECT sample_id, sum({_ATOK}) AS n FROM id_audios GROUP BY sample_id) b USING (sample_id) WHERE a.n <> b.n
        UNION ALL SELECT 'batch_audio' FROM requests WHERE speech AND batch > 1
        UNION ALL SELECT 'unknown_speaker' FROM requests WHERE speaker NOT IN (SELECT name FROM speakers)) x WHERE error IS NOT NULL GROUP BY error""",
    "image_resize_plan": f"SELECT image_id, {_IM['h']} AS h, {_IM['w']} AS w, {_IM['error']} AS error FROM image_meta",
    "video_frame_count": f"WITH {_VM} SELECT video_id, n, n / greatest(CAST(total_frames AS DOUBLE), 1e-6) * video_fps AS sample_fps FROM vm",
    "video_frame_samples": f"WITH {_VM} SELECT video_id, k, CAST(round_even(k * ((total_frames - 1) / (n - 1)), 0) AS BIGINT) AS frame FROM vm CROSS JOIN LATERAL unnest(range(0, n)) AS u(k) WHERE n IS NOT NULL",
    "video_resize_plan": f"WITH {_VM} SELECT video_id, round(budget, 6) AS budget, h, w, error FROM vm",
    "video_trim": "SELECT video_id, count(*) AS total_frames, min(frame_no) AS first_frame FROM frame_pts WHERE pts >= CASE WHEN video_id % 3 <> 0 THEN video_id % 5 ELSE 0 END AND (video_id % 4 = 0 OR pts <= video_id % 5 + 2.5) GROUP BY video_id",
    "frame_list_videos": f"""WITH fr AS (SELECT video_id, frame_no, f.image_id, {_FR['h']} AS h, {_FR['w']} AS w, {_FR['error']} AS error FROM frame_lists f LEFT JOIN image_meta m ON f.image_id = m.image_id)
        SELECT video_id, CAST(ceil(count(*) / 2.0) * 2 AS BIGINT) AS n, string_agg(CAST(image_id AS VARCHAR), ',' ORDER BY frame_no) || CASE WHEN count(*) % 2 = 1 THEN ',' || CAST(arg_max(image_id, frame_no) AS VARCHAR) ELSE '' END AS frames,
        first(h ORDER BY frame_no) AS h, first(w ORDER BY frame_no) AS w, CAST(2.0 AS DOUBLE) AS fps, coalesce((list(error ORDER BY frame_no) FILTER (WHERE error IS NOT NULL))[1], CASE WHEN count(DISTINCT (coalesce(h, -1), coalesce(w, -1))) > 1 THEN 'frame_sizes_differ' END) AS error FROM fr GROUP BY video_id""",
    "vision_token_counts": f"WITH {_VM} SELECT video_id, CAST(floor(ceil(n / 2.0) * floor(h / 14.0) * floor(w / 14.0) / 4.0) AS BIGINT) AS tokens FROM vm WHERE error IS NULL",
    "audio_token_counts": f"SELECT audio_id, {_ALEN} AS frames, {_ATOK} AS tokens FROM audio_meta",
    "token_budget": f"""WITH {_PLANNED}, s AS (SELECT conv_id, {', '.join(f"CAST(coalesce(sum(tokens) FILTER (WHERE modality = '{m}'), 0) AS BIGINT) AS {m}_tokens" for m in ('text', 'image', 'video', 'audio'))} FROM pe WHERE error IS NULL AND role <> 'track' GROUP BY conv_id)
        SELECT *, text_tokens + image_tokens + video_tokens + audio_tokens AS total_tokens, text_tokens + image_tokens + video_tokens + audio_tokens <= 4096 AS fits FROM s""",
    "planned_elements": f"WITH {_PLANNED} SELECT * EXCLUDE (sample_fps) FROM pe",
    "frame_lists_of_messages": f"WITH {_VIS}, {_FRAMES} SELECT conv_id, turn, elem_pos, n, shown AS frames, h, w, CAST(2.0 AS DOUBLE) AS fps, error FROM lists_",
    "vision_flat": f"""WITH {_PLANNED}, al AS (SELECT * FROM pe WHERE error IS NULL AND role = 'vision')
        SELECT conv_id, modality, row_number() OVER (PARTITION BY conv_id, modality ORDER BY turn, elem_pos) - 1 AS idx, count(*) OVER (PARTITION BY conv_id, modality) AS n, h, w, height, width, sample_fps FROM al""",
    "vision_result": f"""WITH {_PLANNED}, al AS (SELECT * FROM pe WHERE error IS NULL AND role = 'vision')
        SELECT conv_id, {', '.join(f"string_agg({a} || 'x' || {b}, ',' ORDER BY turn, elem_pos) FILTER (WHERE modality = '{m}') AS {n}" for m, n, a, b in (('image', 'img_resized_hw', 'h', 'w'), ('image', 'img_ori_hw', 'height', 'width'), ('video', 'video_resized_hw', 'h', 'w'), ('video', 'video_ori_hw', 'height', 'width')))},
        string_agg(CAST(CAST(round(sample_fps * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY turn, elem_pos) FILTER (WHERE modality = 'video') AS milli_fps FROM al GROUP BY conv_id""",
    "audio_chunks": f"WITH {_CHUNKS} SELECT audio_id, chunk, len, CAST(floor((len - 1) / 2.0) + 1 AS BIGINT) AS half FROM ch",
    "chunk_offsets": f"WITH {_CHUNKS}, hv AS (SELECT *, CAST(floor((len - 1) / 2.0) + 1 AS BIGINT) AS half FROM ch) SELECT audio_id, chunk, CAST(sum(half) OVER w - half AS BIGINT) AS start, CAST(sum(half) OVER w AS BIGINT) AS stop FROM hv WINDOW w AS (PARTITION BY audio_id ORDER BY chunk)",
    "frame_offsets": f"WITH {_GRIDS} SELECT media_id, f AS frame, f * grid_h * grid_w AS start, (f + 1) * grid_h * grid_w AS stop FROM gr CROSS JOIN LATERAL unnest(range(0, grid_t)) AS u(f)",
    "spatial_tiles": f"WITH {_GRIDS}, {_TILES} SELECT p.media_id, p.idx, p.cell, CAST((SELECT count(*) FROM tiles b WHERE b.media_id = p.media_id AND b.first < a.first) AS BIGINT) AS tile, a.first * 4 AS tile_start, a.n * 4 AS tile_cells FROM placed p JOIN tiles a ON a.media_id = p.media_id AND a.t = p.t AND a.ty = p.y // 4 AND a.tx = p.x // 4",
    "grid_coords": f"WITH {_GRIDS}, c AS (SELECT media_id, i // (grid_h * grid_w) AS t, (i % (grid_h * grid_w)) // grid_w AS h, i % grid_w AS w FROM gr CROSS JOIN LATERAL unnest(range(0, grid_t * grid_h * grid_w)) AS u(i)) SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY t, h // 2, w // 2, h % 2, w % 2) - 1 AS idx, h, w FROM c",
    "permutation_roundtrip": f"WITH {_GRIDS} SELECT media_id, c AS cell, c * 7 + media_id AS value FROM gr CROSS JOIN LATERAL unnest(range(0, grid_t * (grid_h // 2) * (grid_w // 2))) AS u(c)",
    "positions_text": """WITH p AS (SELECT sample_id, pos, mask, CASE WHEN mask = 0 THEN 1 ELSE (SELECT sum(b.mask) FROM tokens b WHERE b.sample_id = a.sample_id AND b.pos <= a.pos) - 1 END AS position FROM tokens a)
        SELECT sample_id, CAST(pos AS BIGINT) AS pos, CAST(position AS BIGINT) AS position, CAST(max(position) OVER (PARTITION BY sample_id) + 1 - sum(mask) OVER (PARTITION BY sample_id) AS BIGINT) AS delta FROM p""",
    "positions_multimodal": f"""WITH {_STARTS}, tk AS (SELECT sample_id, off + i AS idx, start, i, kind, grid_h // 2 AS gh, grid_w // 2 AS gw, sec, start + span AS stop FROM st CROSS JOIN LATERAL unnest(range(0, len)) AS u(i)),
        tot AS (SELECT sample_id, CAST(max(start + span) - sum(len) AS BIGINT) AS delta FROM st GROUP BY sample_id)
        SELECT sample_id, idx, start + CASE WHEN kind IN ('image', 'video') THEN CAST(trunc((i // (gh * gw)) * sec * 25) AS BIGINT) ELSE i END AS t, start + CASE WHEN kind IN ('image', 'video') THEN (i % (gh * gw)) // gw ELSE i END AS h, start + CASE WHEN kind IN ('image', 'video') THEN i % gw ELSE i END AS w, delta FROM tk JOIN tot USING (sample_id)""",
    "time_chunks": f"WITH RECURSIVE {_cuts('timed', 'walk', 10)} SELECT item, CAST(i AS BIGINT) AS i, t, chunk FROM walk",
    "av_interleave": f"""WITH RECURSIVE vs AS (SELECT item, i // 2 AS i, t FROM timed WHERE i % 2 = 0), au AS (SELECT item, i // 2 AS i, t FROM timed WHERE i % 2 = 1), {_cuts('vs', 'vw', 50)}, {_cuts('au', 'aw', 50)},
        al AS (SELECT item, chunk, 0 AS r, i, t, t + 3 AS m FROM vw UNION ALL SELECT item, chunk, 1, i, t, t FROM aw),
        fin AS (SELECT item, m AS top FROM (SELECT item, chunk, r, max(m) AS m FROM al GROUP BY ALL) g QUALIFY row_number() OVER (PARTITION BY item ORDER BY chunk DESC, r DESC) = 1)
        SELECT item, row_number() OVER (PARTITION BY item ORDER BY chunk, r, i) - 1 AS idx, CASE r WHEN 0 THEN 'video' ELSE 'audio' END AS kind, CAST(i AS BIGINT) AS i, t, chunk, top + 1 AS next_start FROM al JOIN fin USING (item)""",
    "media_counts": f"WITH {_COUNTS} SELECT * FROM mcount",
    "visible_context": "SELECT q.sample_id, CAST(q.pos AS BIGINT) AS pos, CAST(sum(k.mask) AS BIGINT) AS visible, CAST(sum(CASE WHEN k.pos > q.pos - 16 THEN k.mask ELSE 0 END) AS BIGINT) AS visible_16 FROM tokens q JOIN tokens k ON k.sample_id = q.sample_id AND k.pos <= q.pos GROUP BY ALL",
    "continuation_positions": "WITH c AS (SELECT conv, batch, len, sum(len) OVER (PARTITION BY conv ORDER BY batch) - len AS seen FROM steps) SELECT conv, CAST(batch AS BIGINT) AS batch, i, CAST(seen - conv % 5 + i AS BIGINT) AS position, CAST(seen - conv % 5 - conv % 3 + i AS BIGINT) AS thinker_position FROM c CROSS JOIN LATERAL unnest(range(0, len)) AS u(i)",
    "placeholder_join": """WITH t AS (SELECT sample_id, CAST(pos AS BIGINT) AS pos, CAST(token_id AS BIGINT) AS token_id, CASE token_id WHEN 90003 THEN 'image' WHEN 90004 THEN 'video' WHEN 90005 THEN 'audio' END AS modality FROM tokens),
        r AS (SELECT *, CASE WHEN modality IS NOT NULL THEN count(*) OVER (PARTITION BY sample_id, modality ORDER BY pos) - 1 END AS k0 FROM t),
        v AS (SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS x0 FROM embeddings)
        SELECT r.sample_id, pos, token_id, modality, k0 AS k, v.vec_id, coalesce(v.x0, o.x0) AS x, CASE WHEN v.vec_id IS NOT NULL THEN 0.0::DOUBLE ELSE o.x0 END AS x_text FROM r JOIN v o ON o.vec_id = r.token_id % (SELECT count(*) FROM embeddings) LEFT JOIN v ON v.vec_id = (r.sample_id * 13 + k0) % (SELECT count(*) FROM embeddings) AND k0 < CASE WHEN modality = 'audio' THEN 40 ELSE 70 END""",
    "speaker_lookup": "SELECT req_id, speaker, bos_token FROM requests JOIN speakers ON name = speaker",
    "unknown_speakers": "SELECT req_id, speaker FROM requests WHERE speaker NOT IN (SELECT name FROM speakers)",
    "segment_lookup": f"""WITH {_STARTS}, e AS (SELECT sample_id, seg_no, start, lead(start) OVER (PARTITION BY sample_id ORDER BY seg_no) AS stop FROM st),
        pt AS (SELECT DISTINCT sample_id, start + CASE WHEN kind IN ('image', 'video') THEN CAST(trunc((i // ((grid_h // 2) * (grid_w // 2))) * sec * 25) AS BIGINT) ELSE i END AS pos FROM st CROSS JOIN LATERAL unnest(range(0, len)) AS u(i))
        SELECT t.sample_id, t.pos, e.seg_no FROM pt t JOIN e ON e.sample_id = t.sample_id AND t.pos >= e.start AND (e.stop IS NULL OR t.pos < e.stop)""",
    "block_band_join": "SELECT a.item, CAST(a.pos AS BIGINT) AS pos_a, CAST(b.pos AS BIGINT) AS pos_b FROM codes a JOIN codes b ON a.item = b.item AND a.pos // 2 - b.pos // 2 BETWEEN 0 AND 1",
    "stream_positions": "WITH c AS (SELECT user_id AS conv, event_id AS batch, 1 + CAST(floor(value) AS BIGINT) % 20 AS len FROM events), d AS (SELECT *, sum(len) OVER w - len AS seen, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY conv ORDER BY batch)) SELECT conv, batch, i, CAST(seen - conv % 5 + i AS BIGINT) AS position, CASE WHEN k = 1 THEN 'm' || batch END AS media FROM d CROSS JOIN LATERAL unnest(range(0, len)) AS u(i)",
    "stream_reply_zip": "WITH s AS (SELECT user_id AS conv, event_id AS batch, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT a.conv, a.batch, a.step, b.batch * 10 AS reply FROM s a JOIN s b ON b.conv = a.conv AND b.step = least(a.step, a.n - 1, 4 + a.conv % 7)",
    "stream_token_budget": f"""WITH {_PLANNED}, s AS (SELECT conv_id, {', '.join(f"CAST(coalesce(sum(tokens) FILTER (WHERE modality = '{m}'), 0) AS BIGINT) AS {m}_tokens" for m in ('text', 'image', 'video', 'audio'))} FROM pe WHERE error IS NULL AND role <> 'track' GROUP BY conv_id)
        SELECT *, text_tokens + image_tokens + video_tokens + audio_tokens AS total_tokens, text_tokens + image_tokens + video_tokens + audio_tokens <= 4096 AS fits FROM s""",
    "stream_media_plan": f"WITH {_PLANNED} SELECT * EXCLUDE (sample_fps) FROM pe",
    "batch_inference": f"WITH {_IDS} SELECT item AS sample_id, CAST(list_sum(ids) % 1000 + 5 AS VARCHAR) || CASE WHEN len(ids) = 1 THEN '' ELSE ',' || CAST(len(ids) + 3 AS VARCHAR) END AS completion FROM il",
    "interval_lookup": "WITH p AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY pos) - 1 AS pos FROM tokens WHERE mask = 1), o AS (SELECT *, CAST(sum(len) OVER (PARTITION BY sample_id ORDER BY seg_no) AS BIGINT) - len AS off FROM segments), e AS (SELECT sample_id, seg_no, off - 3 AS start, off + len + 3 AS stop FROM o WHERE kind IN ('image', 'video', 'audio')) SELECT p.sample_id, pos, start, stop, seg_no FROM p LEFT JOIN e ON e.sample_id = p.sample_id AND pos >= start AND pos < stop",
    "conversation_inference": f"""WITH {_PLANNED}, tx AS (SELECT conv_id, turn, elem_pos, length(txt) AS chars FROM parts UNION ALL SELECT conv_id, turn, 0, length(content) FROM messages WHERE NOT starts_with(content, '[')),
        pr AS (SELECT conv_id, tokens, CASE role WHEN 'text' THEN list_sum(list_transform(range(1, tokens + 1), lambda i: (chars * 31 + i) % 50000)) ELSE tokens * CASE modality WHEN 'image' THEN 90003 WHEN 'video' THEN 90004 ELSE 90005 END END AS total FROM pe JOIN tx USING (conv_id, turn, elem_pos) WHERE error IS NULL AND role <> 'track' AND tokens > 0),
        sm AS (SELECT conv_id, CAST(sum(total) AS BIGINT) AS total, CAST(sum(tokens) AS BIGINT) AS n FROM pr GROUP BY conv_id)
        SELECT conv_id AS sample_id, CAST(total % 1000 + 5 AS VARCHAR) || CASE WHEN n = 1 THEN '' ELSE ',' || CAST(n + 3 AS VARCHAR) END AS completion FROM sm""",
    "clamped_zip": "WITH r AS (SELECT conv, batch, event_id FROM steps WHERE batch < 5 + conv % 7), n AS (SELECT conv, count(*) AS n FROM r GROUP BY conv) SELECT s.conv, CAST(s.batch AS BIGINT) AS step, CAST(r.batch AS BIGINT) AS idx, r.event_id AS reply FROM steps s JOIN n ON n.conv = s.conv JOIN r ON r.conv = s.conv AND r.batch = least(s.batch, n.n - 1)",
    "valid_lengths": "SELECT sample_id, CAST(sum(mask) AS BIGINT) AS length FROM tokens GROUP BY sample_id",
    "pair_pooling": f"WITH {_FEAT} SELECT a.item, CAST(a.pos // 2 AS BIGINT) AS pair, a.dim, round((a.x + b.x) / 2, 6) AS value FROM fl a JOIN fl b ON a.item = b.item AND a.dim = b.dim AND a.pos % 2 = 0 AND b.pos = a.pos + 1",
    "stats_pooling": f"""WITH {_FEAT}, e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY item)) AS w FROM fl), m AS (SELECT item, dim, avg(x) AS mu, sum(w * x) / sum(w) AS sm FROM e GROUP BY item, dim)
        SELECT e.item, e.dim, round(any_value(mu), 6) AS mean, round(sqrt(greatest(avg((x - mu) * (x - mu)), 1e-12)), 6) AS std, round(any_value(sm), 6) AS soft_mean, round(sqrt(greatest(sum(w * (x - sm) * (x - sm)) / sum(w), 1e-12)), 6) AS soft_std FROM e JOIN m ON m.item = e.item AND m.dim = e.dim GROUP BY e.item, e.dim""",
    "masked_nll": """WITH q AS (SELECT a.vec, CASE WHEN b.vec_id % 9 = 0 THEN -100 ELSE b.vec_id % 64 END AS label FROM features a JOIN features b ON b.item = a.item AND b.pos = a.pos + 1 WHERE b.vec_id % 11 <> 0)
        SELECT round(avg(ln(list_sum(list_transform(vec, lambda x: exp(CAST(x AS DOUBLE))))) - CAST(vec[label + 1] AS DOUBLE)), 6) AS loss, count(*) AS n FROM q WHERE label >= 0""",
    "padding_plan": f"WITH {_CHUNKS} SELECT audio_id, max(len) AS width, count(*) AS chunks, CAST(sum(len) AS BIGINT) AS kept, CAST(sum(floor((len - 1) / 2.0) + 1) AS BIGINT) AS kept_half, round(1 - sum(len) / (count(*) * max(len)), 6) AS waste FROM ch GROUP BY audio_id",
    "completion_slice": f"WITH {_IDS} SELECT item, array_to_string(ids[item % 4 + 1:], ',') AS text, array_to_string(ids[item % 4 + 1:len(ids) - 1], ',') AS codec FROM il",
    "talker_inputs": f"WITH {_IDS} SELECT item AS sample_id, array_to_string(ids, ',') || ',1007,' || item * 3 AS ids, repeat('8292,', len(ids)) || '8293,8294' AS codes, repeat('1,', len(ids)) || '1,1' AS mask FROM il",
    "offsets_dedup": "SELECT a.item, CAST(a.i AS BIGINT) AS i, a.t FROM timed a LEFT JOIN timed b ON b.item = a.item AND b.i = a.i - 1 WHERE b.t IS NULL OR b.t <> a.t",
    "rollout_fanout": "SELECT conv_id, g FROM (SELECT DISTINCT conv_id FROM conversations) c CROSS JOIN (SELECT unnest(range(0, 8)) AS g) r",
    "rollout_media_fanout": "WITH m AS (SELECT sample_id, seg_no, kind FROM segments WHERE kind IN ('image', 'video', 'audio')) SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY g, seg_no) - 1 AS idx, g, kind FROM m CROSS JOIN (SELECT unnest(range(0, 4)) AS g) r",
    "codec_repeat": "SELECT item, CAST(pos * 2 + k AS BIGINT) AS pos, code FROM codes CROSS JOIN (SELECT unnest(range(0, 2)) AS k) r",
    "mel_to_db": f"WITH {_VEC} SELECT vec_id, dim, round(greatest(-1.0, least(1.0, 2 * ((20 * log10(greatest(pow(10, -115 / 20.0), exp(x))) - 20 + 115) / 115) - 1)), 6) AS db FROM ev",
    "clamp_unit": f"WITH {_VEC} SELECT vec_id, dim, round(greatest(-1.0, least(1.0, x)), 6) AS x FROM ev",
    "sinusoid_features": "SELECT p_partkey, i AS dim, round(CASE WHEN i < 8 THEN sin(p_size * exp(-ln(10000.0) / 7 * i)) ELSE cos(p_size * exp(-ln(10000.0) / 7 * (i - 8))) END, 6) AS x FROM part CROSS JOIN (SELECT unnest(range(0, 16)) AS i) r",
    "param_routing": """SELECT c_custkey,
        concat_ws(',', CASE WHEN c_custkey % 4 = 0 THEN 'attention_mask=' || c_custkey % 94 END, 'max_new_tokens=1024', CASE WHEN c_custkey % 2 = 0 THEN 'top_k=' || c_custkey % 92 END) AS thinker,
        concat_ws(',', 'max_new_tokens=4096', 'top_k=' || CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 93 AS VARCHAR) ELSE '40' END) AS talker,
        concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'max_new_tokens=' || c_custkey % 97 END, CASE WHEN c_custkey % 5 = 0 THEN 'steps=' || c_custkey % 95 END) AS token2wav FROM customer""",
    "strip_special": f"WITH {_IDS} SELECT item, array_to_string(list_filter(list_transform(ids, lambda x: x % 10), lambda x: x NOT IN (0, 3, 7)), ',') AS ids FROM il",
    "linear_resample": """WITH p AS (SELECT item, ts, value, lead(ts) OVER w AS t1, lead(value) OVER w AS v1 FROM series WINDOW w AS (PARTITION BY item ORDER BY ts, event_id)),
        g AS (SELECT item, unnest(range(CAST(ceil(min(ts) / 21600) AS BIGINT), CAST(floor(max(ts) / 21600) AS BIGINT) + 1)) AS grid FROM series GROUP BY item)
        SELECT g.item, g.grid, round(value + (v1 - value) * (grid * 21600.0 - ts) / (t1 - ts), 6) AS value FROM g JOIN p ON p.item = g.item AND p.ts <= grid * 21600.0 AND p.t1 > grid * 21600.0""",
    "training_mix": "WITH d AS (SELECT doc_id, lang || CASE WHEN doc_id % 7 = 0 THEN '_multi' ELSE '' END AS dataset FROM documents) SELECT doc_id, dataset FROM d QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= CASE dataset WHEN 'en' THEN 100 WHEN 'de' THEN 40 WHEN 'en_multi' THEN 30 ELSE 1000000000 END",
    "length_limits": "SELECT doc_id, n_chars AS prompt_tokens, least(n_chars * 3, 2048) AS completion_tokens FROM documents WHERE n_chars <= 2000",
    "reward_sum": "SELECT event_id, round(k + k_ratio + a, 6) AS reward FROM rollouts",
    "group_advantage": "WITH r AS (SELECT event_id, prompt, grp, k + k_ratio + a AS reward FROM rollouts), s AS (SELECT prompt, grp, avg(reward) AS mu, coalesce(stddev_samp(reward), 0) AS sd FROM r GROUP BY ALL) SELECT event_id, round((reward - mu) / (sd + 1e-4), 4) AS advantage FROM r JOIN s USING (prompt, grp)",
}

ORACLES = {name: duckdb_sql(body) for name, body in _BODIES.items()}
